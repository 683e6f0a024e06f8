import random

import pytest

from gridtrack.llm import chunks

SCHEMA = "doc_id long, text string, row int, d1 string, t long"


def test_cuts_resist_insertions():
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(20000))
    ends = chunks.cuts(data, 40, 20, 160)
    assert ends[-1] == len(data) and all(a < b <= a + 160 for a, b in zip([0, *ends], ends))
    assert all(b - a >= 20 for a, b in zip([0, *ends], ends[:-1]))
    other = data[:5000] + b"inserted" + data[5000:]
    pieces = lambda d, e: {d[a:b] for a, b in zip([0, *e], e)}
    own, new = pieces(data, ends), pieces(other, chunks.cuts(other, 40, 20, 160))
    assert len(own - new) <= 4


def test_hash_depends_on_the_last_bytes():
    import numpy as np

    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 256, 500, dtype=np.uint8), rng.integers(0, 256, 700, dtype=np.uint8)
    b[-100:] = a[-100:]
    assert (chunks.gear(a)[-84:] == chunks.gear(b)[-84:]).all()
    assert len(chunks.cuts(b"", 40, 20, 160)) == 0 and chunks.cuts(b"x" * 700, 40, 20, 160)[-1] == 700


def brute(rows):
    """First occurrence by doc_id, null last, stays."""
    cut = []
    for d, t in rows:
        data = (t or "").encode()
        ends = chunks.cuts(data, 40, 20, 160)
        cut.append([(a, b, data[a:b]) for a, b in zip([0, *ends], ends)])
    first, holders = {}, {}
    for (d, _), cs in zip(rows, cut):
        key = chunks.LAST if d is None else d
        for c in {x for *_, x in cs}:
            first[c] = min(first.get(c, key), key)
            holders.setdefault(c, set()).add(key)
    out = []
    for (d, t), cs in zip(rows, cut):
        key, seen, gone, shared = chunks.LAST if d is None else d, set(), [], 0
        for a, b, c in cs:
            if len(holders[c]) > 1:
                shared += b - a
            if c in seen or key > first[c]:
                gone.append((a, b))
            seen.add(c)
        spans = []
        for a, b in gone:
            if spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        spans = [(a, b) for a, b in spans if b - a >= 120]
        out.append((str(d), len((t or "").encode()), len(cs), shared, sum(b - a for a, b in spans), len(spans), ",".join(f"{a}:{b}" for a, b in spans)))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(2, 8)))
    passages = [" ".join(word() for _ in range(90)) for _ in range(5)]
    rows = [(1, None), (2, ""), (3, "a" * 3000), (4, passages[0]), (4, passages[0]), (None, passages[1]), (5, passages[2] + passages[2])]
    rows += [(d, " ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(passages) + " ".join(word() for _ in range(30))) for d in range(10, 60)]
    df = spark.createDataFrame([(d, t, 0, "", 1) for d, t in rows], SCHEMA)
    got = chunks.deduplicated(df).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_chunks, r.n_shared, r.n_removed, r.n_spans, r.spans) for r in got) == brute(rows)
    assert all(r.n_removed > 250 for r in got if r.doc_id and r.doc_id >= 40)


def test_passages_go_and_shared_phrases_stay(spark):
    """Of documents with phrases of four words in common all bytes stay; passages of 51 words go but for their edges."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    phrases, passage = [text(4) for _ in range(20)], text(51)
    clean = [(d, " ".join(text(rng.randint(5, 12)) + " " + rng.choice(phrases) for _ in range(15))) for d in range(100)]
    held = [(d, text(40) + " " + passage + " " + text(40)) for d in range(100, 200)]
    got = {r.doc_id: r.n_removed for r in chunks.deduplicated(spark.createDataFrame(clean + held, "doc_id long, text string")).collect()}
    assert all(got[d] == 0 for d, _ in clean)
    assert got[100] == 0 and all(120 <= got[d] <= len(passage) for d in range(101, 200))


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_empty(spark, rows):
    got = chunks.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_bytes, r.n_chunks, r.spans) for r in got] == [(0, 0, "")] * len(rows)
