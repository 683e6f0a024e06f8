import random

import pytest

import xxhash
from pyspark.sql import functions as F

from gridtrack.llm import simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, t string, fp string, k int"


def brute(rows):
    def fp(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        if not w:
            return 0
        k = min(3, len(w))
        hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), seed=42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(t) for _, t in rows]
    comp = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(i):
                if bin(fps[i] ^ fps[j]).count("1") <= 3:
                    comp[i] = comp[j] = min(comp[i], comp[j])
    ids = {}
    for (d, _), c in zip(rows, comp):
        if d is not None:
            ids[c] = min(ids.get(c, d), d)
    return sorted((-1 if d is None else d, f"{f:016x}", ids.get(c, -1)) for (d, _), f, c in zip(rows, fps, comp))


def fixture():
    rng = random.Random(5)
    rows = [(7, None), (8, ""), (9, "  \n"), (10, "one"), (11, "One"), (12, "one two"), (10, "one"), (None, "lone words here now"), (13, "É é")]
    for d in range(20, 60):
        w = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.choice([5, 60, 400]))]
        for c in range(rng.choice([1, 1, 4])):
            v = list(w)
            for _ in range(c):
                v[rng.randrange(len(v))] = "x"
            rows.append((100 * d + c, " ".join(v)))
    rows.append((1, "long " * 70000))
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(d, t, None, None, None, "a", "b", 1) for d, t in rows], DOCS)
    got = simhash.near_duplicates(df).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.fingerprint, -1 if r.component_id is None else r.component_id) for r in got) == brute(rows)


def test_large_buckets_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    fps = list({base ^ sum(1 << b for b in rng.sample(range(63), rng.randint(0, 4))) for _ in range(300)})
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = sorted((min(a, b), max(a, b)) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 3)
    for bucket in (7, 5000):
        assert sorted(map(tuple, simhash.links(df, bucket=bucket).collect())) == want


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_one_of_each_group_stays(spark):
    df = spark.createDataFrame([(1, "a b c d", 5), (2, "A b c d", 6), (2, "A b c d", 6), (3, "other words entirely", 7), (3, "other words entirely", 7), (None, "a b c d", 8), (4, None, 9)], "doc_id long, text string, _gone int")
    got = simhash.deduplicated(df.withColumnRenamed("_gone", "n"))
    assert got.columns == ["doc_id", "text", "n"]
    assert sorted(r.doc_id for r in got.where(F.col("doc_id").isNotNull()).collect()) == [1, 3, 4]


def shingle_set(t, k=5):
    w = (t or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def test_similar_texts_leave_one(spark):
    rng = random.Random(8)
    rows, groups = [], []
    for g in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([150, 400]))]
        group = []
        for c in range(rng.choice([1, 1, 2, 5])):
            v = list(base)
            for k in rng.sample(range(len(v)), len(v) // 100 if c else 0):
                v[k] = "changed"
            rows.append((100 * g + c, " ".join(v), "x"))
            group.append(100 * g + c)
        groups.append(group)
    rows += [(9000, None, "x"), (9001, "", "x"), (9002, "few words", "x"), (9003, "Few  words", "x"), (9004, "few words", "x"), (9004, "few words", "x")]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, _n string"), width=5, similarity=0.8)
    ids = sorted(r.doc_id for r in got.collect())
    text = {d: shingle_set(t) for d, t, _ in rows}
    alike = [(a, b) for g in groups for a in g for b in g if a < b and len(text[a] & text[b]) / len(text[a] | text[b]) >= 0.85]
    kept = set(ids)
    assert sum(a in kept and b in kept for a, b in alike) == 0
    assert all(g[0] in kept for g in groups)
    assert [i for i in ids if i >= 9000] == [9000, 9002]


def test_signature_estimates_similarity():
    rng = random.Random(2)
    a = [f"w{rng.randrange(9999)}" for _ in range(800)]
    b = a[:700] + [f"x{rng.randrange(9999)}" for _ in range(100)]
    ta, tb = " ".join(a).encode(), " ".join(b).encode()
    true = len(shingle_set(ta.decode()) & shingle_set(tb.decode())) / len(shingle_set(ta.decode()) | shingle_set(tb.decode()))
    x, y = (int.from_bytes(simhash.signature(t)[1], "big") for t in (ta, tb))
    assert abs(1 - 2 * (x ^ y).bit_count() / simhash.SIGNATURE - true) < 0.1


def test_every_pair_of_a_block_is_compared(spark):
    rng = random.Random(21)
    word = lambda: f"w{rng.randrange(10**9)}"
    boiler, rows = [word() for _ in range(140)], []
    for g in range(500):
        own = [word() for _ in range(60)]
        rows += [(10 * g, " ".join(boiler + own)), (10 * g + 1, " ".join(boiler + own[:-20] + [word() for _ in range(20)]))]
    text = {d: shingle_set(t) for d, t in rows}
    assert all(0.8 < len(text[10 * g] & text[10 * g + 1]) / len(text[10 * g] | text[10 * g + 1]) < 0.83 for g in range(500))
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8)
    assert sorted(r.doc_id for r in got.collect()) == [10 * g for g in range(500)]


def test_similarity_is_exact_at_the_limit(spark):
    rng = random.Random(22)
    rows, want = [], []
    for g in range(300):
        words = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        shared = (80, 79, 77, 75, 72, 70)[g % 6]  # of 100 shingles
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[: shared + 4]))]
        assert len(shingle_set(rows[-1][1])) == shared and shingle_set(rows[-1][1]) < shingle_set(rows[-2][1])
        want += [10 * g] if shared >= 80 else [10 * g, 10 * g + 1]
    got = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), width=5, similarity=0.8)
    assert sorted(r.doc_id for r in got.collect()) == want


@pytest.mark.parametrize("work", [1, 1 << 24])
def test_components_of_similar_texts_equal_brute_force(spark, work):
    """With and without the way of rare shingles; a boilerplate half, chains of copies, empty and null texts, clashing names."""
    rng = random.Random(23)
    word = lambda: f"w{rng.randrange(10**9)}"
    boiler, rows = [word() for _ in range(100)], []
    for g in range(40):
        own = boiler + [word() for _ in range(80)]
        for c in range(4):
            rows.append((10 * g + c, " ".join(own)))
            for k in rng.sample(range(100, 180), 3):
                own[k] = word()
    rows += [(9000, None), (9001, ""), (9002, "few words")]
    sets, root = {d: shingle_set(t) for d, t in rows}, {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "g long, text string, sig int, root int")
    got = {r.g: r.root for r in simhash.similar_components(df.withColumnRenamed("g", "doc_id"), ["doc_id"], work=work).withColumnRenamed("doc_id", "g").collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(got[d], d)
    assert {d: first[got[d]] for d in sets} == {d: find(d) for d in sets}


def test_names_that_clash_stay(spark):
    df = spark.createDataFrame([(1, "a b c", 5, 6), (2, "a b c", 7, 8), (3, "d e f", 9, 10)], "doc_id long, text string, _d int, _H int")
    got = simhash.deduplicated(df)
    assert got.columns == ["doc_id", "text", "_d", "_H"]
    assert sorted(map(tuple, got.collect())) == [(1, "a b c", 5, 6), (3, "d e f", 9, 10)]
