import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gridtrack.llm import mixing


def fill(total, nodes):
    """Budget by weight, in rounds: who would get over capacity is set to it, and the rest is shared anew."""
    out, left, open_ = {}, total, dict(nodes)
    while open_:
        w = sum(x[1] for x in open_.values())
        full = [k for k, (c, x) in open_.items() if left * x / w >= c]
        if not full:
            return out | {k: left * x / w for k, (c, x) in open_.items()}
        for k in full:
            out[k] = open_.pop(k)[0]
        left = total - sum(out.values())
    return out


def brute(leaves, total, weights, epochs):
    caps = defaultdict(lambda: defaultdict(dict))
    for (d, l, s), t in leaves.items():
        caps[d][l][s] = t * epochs
    w = lambda level, name: weights.get((level, name), 1.0)
    out = {}
    tops = fill(total, {d: (sum(sum(x.values()) for x in ls.values()), w("domain", d)) for d, ls in caps.items()})
    for d, ls in caps.items():
        mids = fill(tops[d], {l: (sum(x.values()), w("lang", l)) for l, x in ls.items()})
        for l, x in ls.items():
            for s, b in fill(mids[l], {s: (c, w("source", s)) for s, c in x.items()}).items():
                out[d, l, s] = b
    return out


@pytest.mark.parametrize("total", [0, 1000, 30_000, 90_000, 10**7])
def test_budgets(spark, total):
    rng = random.Random(total)
    leaves = {(d, l, f"s{k}"): rng.choice([1, 50, 500, 5000]) for d in ("web", "books", "x") for l in ("en", "fr", "?") for k in range(rng.randint(1, 4))}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, total, epochs=3).collect()}
    want = brute(leaves, total, mixing.WEIGHTS, 3)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) <= 1 for k in want)


def test_prefixes(spark):
    rng = random.Random(4)
    rows = [(i if i % 17 else None, rng.choice(["w " * rng.randint(0, 30), None, ""]) if i % 5 == 0 else "a b\tc\n" * rng.randint(1, 20), rng.choice(["en", "en", "fr", None]), rng.choice(["src0"] * 5 + ["src1", "src2", None, "site"]), 1, "x") for i in range(800)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, epoch string")
    got = mixing.mixed(df, share=1.2, epochs=3, buckets=8)
    assert got.columns == ["doc_id", "domain", "lang", "source", "epoch", "n_tokens", "take_tokens"]
    leaves, total = defaultdict(int), 0
    for _, t, l, s, *_ in rows:
        d = mixing.DOMAINS[(int(s[3:]) if s and s.startswith("src") else 0) % 4]
        leaves[d, l or "?", s or "?"] += len((t or "").split())
    total = sum(leaves.values())
    want = brute({k: v for k, v in leaves.items() if v}, total * 1.2, mixing.WEIGHTS, 3)
    out = defaultdict(list)
    for r in got.collect():
        assert 0 < r.take_tokens <= r.n_tokens
        out[r.domain, r.lang, r.source].append(r)
    for k, b in want.items():
        taken = sum(r.take_tokens for r in out[k])
        assert abs(taken - b) <= 1
        assert sum(r.take_tokens < r.n_tokens for r in out[k]) <= 1
        for e in range(int(taken // leaves[k])):
            assert sum(r.take_tokens for r in out[k] if r.epoch == e) == leaves[k]
    again = mixing.mixed(df.repartition(7), share=1.2, epochs=3, buckets=64)
    key = lambda r: str(tuple(r))
    assert sorted(map(key, again.collect())) == sorted(key(r) for rs in out.values() for r in rs)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert mixing.mixed(empty).count() == 0
    assert mixing.mixed(empty.union(spark.createDataFrame([(1, "", "en", "s")], empty.schema))).count() == 0


def test_tokens(spark):
    texts = [None, "", " \n", "a", " a  b\x0bc\n", "é b c"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(mixing.n_tokens(F.col("t"))).collect()]
    assert got == [0, 0, 0, 1, 3, 2]


@pytest.mark.parametrize("total", [7, 1001, 29_999.7])
def test_no_token_is_lost(spark, total):
    """Many small leaves: their whole budgets add up to the target, and those of each node to its share within a token."""
    rng = random.Random(3)
    leaves = {(d, l, f"s{k}"): rng.choice([1, 50, 500]) for d in ("web", "books", "x") for l in ("en", "fr", "?", "de") for k in range(30)}
    df = spark.createDataFrame([(*k, v) for k, v in leaves.items()], "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in mixing.budgets(df, total, epochs=2).collect()}
    want = brute(leaves, total, mixing.WEIGHTS, 2)
    assert sum(got.values()) == int(total)
    assert all(abs(got[k] - want[k]) <= 1 and got[k] <= 2 * leaves[k] for k in want)
    for depth in (1, 2):
        for node in {k[:depth] for k in want}:
            assert abs(sum(v for k, v in got.items() if k[:depth] == node) - sum(v for k, v in want.items() if k[:depth] == node)) <= 1


def test_prefix_order(spark):
    """The prefix of a leaf against a plain walk through its documents in the epoch's order, a very long text among them."""
    rng = random.Random(9)
    rows = [(i, "a " * (200_000 if i == 7 else rng.randint(1, 40)) + str(i), "en", "src0") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    keys = df.select("doc_id", *[F.xxhash64(F.lit(17), F.lit(e), "doc_id", F.xxhash64("text")).alias(f"k{e}") for e in range(2)]).collect()
    sizes = {d: len(t.split()) for d, t, *_ in rows}
    for share in (0.3, 1.6):
        left, want = int(sum(sizes.values()) * share), []
        for e in range(2):
            for r in sorted(keys, key=lambda r: r[f"k{e}"]):  # noqa: B023
                take = min(sizes[r.doc_id], left)
                want += [(r.doc_id, e, take)] if take else []
                left -= take
        got = mixing.mixed(df, share=share, epochs=2, buckets=16)
        assert sorted((r.doc_id, r.epoch, r.take_tokens) for r in got.collect()) == sorted(want)
