import hashlib
import random
from collections import Counter, defaultdict

import numpy as np

from gridtrack.llm import repeats

SCHEMA = "doc_id long, text string, d long, k string, spans int"


def brute(rows, least, passage):
    texts = [(t or "").encode() for _, t in rows]
    owners = defaultdict(set)
    for (d, _), t in zip(rows, texts):
        for i in range(len(t) - passage + 1):
            owners[t[i : i + passage]].add((d, t))
    seen = Counter(t[i : i + least] for t in texts for i in range(len(t) - least + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - least + 1):
            if seen[t[i : i + least]] > 1:
                gone[i : i + least] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((str(d), len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest(), any(len(owners[t[i : i + passage]]) > 1 for i in range(len(t) - passage + 1))))
    return sorted(out)


def fixture(seed, n=60):
    rng = random.Random(seed)
    text = lambda k: "".join(rng.choice("abcdé \n") for _ in range(k))
    shared = [text(k) for k in (40, 60, 75, 120, 300)]
    rows = [(1, None), (2, ""), (3, "a" * 500), (4, "ab" * 300), (5, "abc" * 20), (5, "abc" * 20), (None, text(90)), (6, shared[4]), (6, shared[4])]
    for d in range(10, 10 + n):
        parts = []
        for _ in range(rng.randint(1, 6)):
            s = rng.choice(shared)
            a = rng.randrange(len(s))
            parts += [text(rng.choice([0, 3, 30])), s[a : a + rng.randint(20, 200)], text(rng.choice([0, 5]))]
        rows.append((d, "".join(parts)))
    for d in range(200, 230):  # many texts that share one passage
        rows.append((d, text(20) + shared[3] + text(20)))
    return rows


def check(spark, rows, least, q, passage):
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.repeated) for r in repeats.counted(df, least, q, passage).collect())
    assert got == brute(rows, least, passage)


def test_against_brute_force(spark):
    check(spark, fixture(1), 50, 16, 50)
    check(spark, fixture(3), 60, 12, 35)


def test_large_groups(spark, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP", 2)
    check(spark, fixture(2), 50, 16, 30)


def test_production_length(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    check(spark, [(1, t), (2, t[:399] + "!" + t[500:899]), (3, t[600:1000] + "?" + t[1200:]), (4, t[:400]), (5, "x" * 1000), (6, t[:270] + "," + t[900:1100]), (7, t[1300:1559])], 400, 48, 260)


def test_pieces(monkeypatch):
    rng = random.Random(1)
    t = "".join(rng.choice("ab") for _ in range(5000)).encode()
    whole = {(h, p, s) for h, p, a, b in repeats.anchors(t, 50, 16) for s in range(a, b + 1)}
    monkeypatch.setattr(repeats, "PIECE", 512)
    cut = {(h, p, s) for h, p, a, b in repeats.anchors(t, 50, 16) for s in range(a, b + 1)}
    assert len(whole) == 5000 - 49
    assert {(p, s) for _, p, s in whole} >= set() and len(cut) == len(whole)


def test_maximal_repeats():
    got = {(left, right, tuple(sorted(m))) for left, right, m in repeats.maximal_repeats([(b"xxabcQdefyy", 5), (b"zzabcQdefww", 5), (b"kkkbcQdeguu", 5)], 5)}
    assert got == {(3, 4, (0, 1)), (2, 3, (0, 1, 2))}


def test_empty(spark):
    assert repeats.counted(spark.createDataFrame([], SCHEMA)).count() == 0


def test_occurrences_are_whole(spark):
    """Each repeat lists every place of its string, and every string that occurs twice lies in one of them."""
    rows = [(d, t) for d, t in fixture(5, 25) if d is not None and len(t or "") < 3000]
    texts = {d: (t or "").encode() for d, t in rows}
    rows = sorted({d: t for d, t in rows}.items())
    least = 40
    got = defaultdict(set)
    for r in repeats.occurrences(spark.createDataFrame(rows, "doc_id long, text string"), least, 12).collect():
        got[r.repeat, texts[r.doc_id][r.start : r.end]].add((r.doc_id, r.start))
    assert len(got) == len({name for name, _ in got}) and got
    places = lambda s: {(d, i) for d, t in texts.items() for i in range(len(t) - len(s) + 1) if t.startswith(s, i)}
    starts = defaultdict(set)
    for d, t in texts.items():
        for i in range(len(t) - least + 1):
            starts[t[i : i + least]].add((d, i))
    for (_, s), own in got.items():
        assert len(s) >= least and len(own) > 1 and own == places(s)
    listed = {(d, i + k) for (_, s), own in got.items() for d, i in own for k in range(len(s) - least + 1)}
    assert listed >= {p for own in starts.values() if len(own) > 1 for p in own}
