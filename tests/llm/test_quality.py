import random
import re

from gridtrack.llm import quality

SCHEMA = "doc_id long, text string, source string, host string, n_docs int"


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered = {i + k for v in seen.values() if len(v) > 1 for i in v for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(covered)


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", " \n\t", "one", "é ü\n\né ü", "a b c d e a b c d e", "a " * 70000, "\x0b\x0cx\r\ny z w"]
    for _ in range(200):
        out.append("".join(rng.choice(["a ", "b ", "c\n", "dd ", "#", "é ", "\n", "a b c d e f ", "\t"]) for _ in range(rng.randint(1, 80))))
    return out


def test_counts():
    for t in texts(1):
        assert quality.counted((t or "").encode()) == brute(t)


def test_verdicts(spark):
    rng = random.Random(2)
    good = lambda: " ".join(f"word{rng.randrange(10**6)}" for _ in range(40))
    rows = [(i, good(), rng.choice(["h0", "h0", "h1", None]), "z", 1) for i in range(300)]
    rows += [(1000 + i, "short" if i % 10 else good(), "bad", "z", 1) for i in range(100)]
    rows += [(2000, "short", "tiny", "z", 1), (2001, None, "h1", "z", 1), (3, rows[3][1], rows[3][2], "z", 1), (None, good(), "h0", "z", 1)]
    got = quality.judged(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(300)) and by[None].kept
    assert not any(r.kept for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1100)
    assert by[1000].host_failed and not by[1000].base_failed
    assert not by[2000].kept and not by[2001].kept and by[2001].n_words == 0
    assert all(r.kept == (not r.base_failed and not r.host_failed) for r in got)


def test_empty(spark):
    assert quality.judged(spark.createDataFrame([], SCHEMA)).count() == 0
