import random
import time

import pytest
from pyspark.sql import functions as F

from gridtrack.llm import common, jaccard

SCHEMA = "doc_id long, text string, g long, s int, t string, root string"


def brute(rows, percent=85):
    sets = []
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        n = min(4, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    comp = list(range(len(rows)))

    def top(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                comp[b] = a
    ids = {}
    for k, (d, _) in enumerate(rows):
        if d is not None:
            ids[top(k)] = min(ids.get(top(k), d), d)
    return sorted((-1 if d is None else d, len(sets[k]), ids.get(top(k), -1) if sets[k] else (-1 if d is None else d)) for k, (d, _) in enumerate(rows))


def found(spark, rows):
    frame = spark.createDataFrame([(d, t, 5, 6, "x", "y") for d, t in rows], SCHEMA)
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.joined(frame).collect())


def fixture(rng):
    """Odd cases, groups of near copies around the threshold, a passage that many share, texts of ever fewer changes."""
    rows = [(7, None), (8, ""), (9, " \n"), (10, "one"), (11, "One"), (12, "one two"), (10, "one"), (None, "a lone text of some words"), (None, "a lone text of some words"), (None, "one"), (10, "another text with the same id"), (1, "long " * 70000), (2, " ".join(f"w{k}" for k in range(30_000)))]
    passage = [f"p{k}" for k in range(60)]
    for d in range(20, 100):
        w = [rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.choice([6, 40, 150, 400]))]
        if d % 2:
            w[len(w) // 2 : len(w) // 2] = passage
        for c in range(rng.choice([1, 1, 3, 6])):
            v = list(w)
            for _ in range(rng.choice([0, 1, 2, 3])):
                v[rng.randrange(len(v))] = f"x{rng.randrange(9)}"
            rows.append((100 * d + c, " ".join(v)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("common", [jaccard.COMMON, 4])
def test_against_brute_force(spark, monkeypatch, common):
    monkeypatch.setattr(jaccard, "COMMON", common)
    monkeypatch.setattr(jaccard, "CROWDED", 5 * common)
    rows = fixture(random.Random(common))
    assert found(spark, rows) == brute(rows)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """More copies than COMMON, each with changes of its own, in two families between which few pairs are similar."""
    monkeypatch.setattr(jaccard, "COMMON", 8)
    rng, rows = random.Random(3), []
    base = [f"w{k}" for k in range(200)]
    other = base[:14] + [f"o{k}" for k in range(14)] + base[28:]
    for d in range(160):
        v = list((base, other)[d % 2])
        for _ in range(rng.choice([0, 1, 2])):
            v[rng.randrange(len(v))] = f"x{d}"
        rows.append((d, " ".join(v)))
    want = brute(rows)
    assert found(spark, rows) == want and len({c for _, _, c in want}) < 10


def test_parts_of_large_lists(spark):
    """Lists that are compared part by part give the same links."""
    rows = fixture(random.Random(9))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    whole = jaccard.links
    try:
        jaccard.links = lambda *a: whole(*a, classes=(1,), bucket=2)
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in jaccard.joined(frame).collect())
    finally:
        jaccard.links = whole
    assert got == brute(rows)


def test_blocks_that_are_skipped_hold_no_partner(spark):
    """Every pair of entries that can match is of a block that is visited."""
    percent = 85
    rows = [(s, p) for s in (*range(1, 60), 99, 100, 117, 118, 400, 470, 5000, 5882) for p in sorted({0, 1, jaccard.prefix(s, percent) // 2, jaccard.prefix(s, percent) - 1}) if p < jaccard.prefix(s, percent)]
    frame = spark.createDataFrame(rows, "s long, p int")
    visits = [(r.s, r.p, {(x.c, x.q) for x in r.x}) for r in frame.select("s", "p", jaccard.visited(percent).alias("x")).collect()]
    blocks = [(r.s, r.p, (r.c, r.q)) for r in frame.select("s", "p", *jaccard.own_block(percent)).collect()]
    skipped = 0
    for s, p, seen in visits:
        for t, q, block in blocks:
            need = -(-percent * (s + t) // (100 + percent))
            if s - p >= need and t - q >= need and 100 * min(s, t) >= percent * max(s, t):
                assert block in seen
            else:
                skipped += block not in seen
    assert skipped > 0.8 * len(visits) * len(blocks)


def rows_of_joins(node):
    own = node.metrics().get("numOutputRows").get().value() if "Join" in node.nodeName() else 0
    return own + sum(rows_of_joins(node.children().apply(k)) for k in range(node.children().size()))


def test_pairs_of_near_copies_leave_one_list_only(spark):
    """Sets that share nine lists in which they can match: a pair leaves the join once, of the first list that both are in."""
    held = {g: list(range(g == 11, 9)) for g in range(12)}
    rows = [(t, g, 100, p, g, 12 - (t == 0), 11 - (t == 0), 0, ts, [0] * jaccard.WORDS) for g, ts in held.items() for p, t in enumerate(ts)]
    frame = spark.createDataFrame(rows, "t long, g long, s long, p int, r long, n long, m long, most long, lists array<long>, sig array<long>")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for bucket in (3, 1 << 14):
            pairs = jaccard.met(frame, 85, bucket)
            assert sorted(map(tuple, pairs.collect())) == [(u, v) for u in range(12) for v in range(u + 1, 12)]
            assert rows_of_joins(pairs._jdf.queryExecution().executedPlan()) == 66
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def shuffled(node):
    own = node.metrics().get("shuffleRecordsWritten").get().value() if node.nodeName() == "Exchange" else 0
    return own + sum(shuffled(node.children().apply(k)) for k in range(node.children().size()))


def collected(frame):
    """The rows of ``frame`` and how many were shuffled on the way; a frame that is collected again shuffles nothing."""
    return frame.collect(), shuffled(frame._jdf.queryExecution().executedPlan())


@pytest.fixture
def plain(spark):
    """Plans as for large tables: no adaptive ones, nothing broadcast."""
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k in confs:
        spark.conf.unset(k)


def test_only_bitmaps_of_sets_in_pairs_are_shuffled(spark, plain):
    nodes = spark.createDataFrame([(g, 8, [g] * 8) for g in range(1000)], "g long, s long, sig array<long>")
    pairs = spark.createDataFrame([(1, 2), (1, 1 << 9)], "u long, v long")
    got = jaccard.possible(pairs, nodes, 85)
    assert sorted(map(tuple, got.collect())) == []
    alike = jaccard.possible(pairs, nodes.withColumn("sig", F.array([F.lit(0).cast("long")] * 8)), 85)
    rows, n = collected(alike)
    assert sorted(map(tuple, rows)) == [(1, 2), (1, 512)] and 0 < n < 30


def test_prefixes_are_not_shuffled_to_tell_late_sets(spark, plain, monkeypatch):
    """Sets with a common shingle come by the reread prefix only, the others as they are: no join of the two."""
    nodes = spark.createDataFrame([(g, 4, [g, 7000 + g % 50 if g % 2 else 8000 + g]) for g in range(400)], "g long, s long, first array<long>")
    monkeypatch.setattr(jaccard, "COMMON", 4)
    entries, whole = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: entries.setdefault(name, df) and whole(df, name))
    reread = lambda again, bits: again.select("g", F.lit(4).cast("long").alias("s"), F.array(F.col("g"), F.lit(-1).cast("long")).alias("set"))
    jaccard.indexed(nodes, reread, 85)
    rows, n = collected(entries["entries"].select("g", "s", "p", "t"))
    assert {tuple(r) for r in rows} == {(g, 4, p, t) for g in range(400) for p, t in enumerate([g, -1 if g % 2 else 8000 + g])} and n == 0


def test_shuffle_files_go_with_the_stored_table(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.toString() for f in (disk.getAllFiles().apply(k) for k in range(disk.getAllFiles().size())) if f.getName().startswith("shuffle_")}
    before, setting = files(), spark.conf.get(common.CLEANUP)
    out = common.stored(spark.range(5000).groupBy((F.col("id") % 999).alias("k")).count(), "counts")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before and out.count() == 999 and spark.conf.get(common.CLEANUP) == setting


def test_empty_table(spark):
    assert jaccard.joined(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert found(spark, [(3, None)]) == [(3, 0, 3)]
