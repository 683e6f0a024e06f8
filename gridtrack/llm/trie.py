"""Prefix trie of conversations: shared openings as nodes, in preorder intervals that come from distributed prefix sums."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Bytes of a piece of the list of members that end at a node; a node with more has several pieces.
PIECE = 1 << 16

#: What joins a running value with that of the ranges before.
_JOINED = {
    "sum": (F.sum, lambda a, b: a + b),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(rows: DataFrame, by: list[Column | str], group: list[str], **sums: tuple[str, Column]) -> DataFrame:
    """``rows`` with running values in the order of ``by``, started anew for each ``group`` (columns that ``by`` begins with).

    ``sums`` maps a name to ("sum", "xor" or "max", column).  Rows are dealt by ranges of ``by``, so a group of any
    size is spread over tasks; each range runs on its own and takes over what its first group had in earlier
    ranges.  That is a row for each range at most, which is what is broadcast.
    """
    dealt = stored(rows.repartitionByRange(*by).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_range", *group).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_range", *group).agg(*[_JOINED[how][0](c).alias(name) for name, (how, c) in sums.items()])
    base = parts.select("_range", *group, F.row_number().over(Window.partitionBy(*group).orderBy("_range")).alias("_nth"), *[_JOINED[how][0](name).over(earlier).alias(f"_{name}") for name, (how, _) in sums.items()])
    out = dealt.withColumns({name: _JOINED[how][0](c).over(inside) for name, (how, c) in sums.items()})
    out = out.join(F.broadcast(base.where("_nth > 1").drop("_nth")), ["_range", *group], "left")
    both = {name: F.when(F.col(f"_{name}").isNull(), F.col(name)).otherwise(F.coalesce(_JOINED[how][1](F.col(f"_{name}"), F.col(name)), F.col(f"_{name}"))) for name, (how, _) in sums.items()}
    return out.withColumns(both).drop("_range", *[f"_{name}" for name in sums])


def rebuilt(turns: DataFrame, splice: int = 6, of: int = 100) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): every conversation takes over the opening of the one that its hundred begins with.

    Turns (conv_id, turn, role, text) are put in order by turn, null first; those of one turn by the digest of role and
    text.  Conversation c begins with the first h = crc32(c) % ``splice`` turns of conversation c - c % ``of`` (all,
    if that has fewer; none, if it is absent) and goes on with its own after its first h.  Null roles and texts are
    empty ones, rows without conv_id belong to no conversation.  The results are (c), a row for each conversation even if
    nothing is left of it, and (c, d, da, db, len): turn d from 1, digests of its role and text, code points of its text.
    """
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in ("role", "text"))
    rows = turns.select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), *[F.xxhash64(F.lit(k), role, text).alias(x) for k, x in ((1, "da"), (2, "db"))], F.length(text).cast("long").alias("len"))
    # The last key deals even equal turns to several ranges; it is stored, so that it stays what it is.
    rows = stored(rows.where("c IS NOT NULL").withColumn("row", F.monotonically_increasing_id()), "turns")
    rows = stored(running(rows, ["c", "turn", "da", "db", "row"], ["c"], p=("sum", F.lit(1).cast("long"))).drop("turn", "row"), "placed")
    first = rows.where((F.col("c") % of == 0) & (F.col("p") < splice)).groupBy(F.col("c").alias("base")).agg(F.array_sort(F.collect_list(F.struct("p", "da", "db", "len"))).alias("head"))
    convs = rows.select("c").distinct().withColumns({"base": F.col("c") - F.col("c") % of, "h": F.crc32(F.col("c").cast("string").cast("binary")) % splice}).join(first, "base", "left")
    convs = stored(convs.withColumn("k", F.least("h", F.coalesce(F.size("head"), F.lit(0)))), "conversations")
    opening = convs.select("c", F.posexplode(F.slice("head", F.lit(1), F.col("k").cast("int"))).alias("i", "x")).select("c", (F.col("i") + 1).cast("long").alias("d"), "x.da", "x.db", "x.len")
    own = rows.join(convs.select("c", "h", "k"), "c").where("p > h").select("c", (F.col("k") + F.col("p") - F.col("h")).alias("d"), "da", "db", "len")
    return convs.select("c"), opening.union(own)


def _pieces(most: int):
    """Kernel from rows (m, d, c) in order to (m, d, first, piece): the decimal c of a node, joined by commas, cut after ``most`` bytes and where a batch ends."""

    def cut(rows):
        for (m, d), group in groupby(rows, lambda x: x[:2]):
            held, size = [], 0
            for _, _, c in group:
                held.append(c)
                size += len(str(c)) + 1
                if size > most:
                    yield m, d, held[0], ",".join(map(str, held))
                    held, size = [], 0
            if held:
                yield m, d, held[0], ",".join(map(str, held))

    def kernel(batches):
        for b in batches:
            out = list(cut(zip(*(b.column(k).to_pylist() for k in range(3)))))
            yield pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, x)) for x in out], schema=_PIECES)

    return kernel


def _hashed(batches):
    """(m, d, sha) of pieces in order: SHA-256 of a node's pieces, joined by commas; only the running hash is held."""
    at, sha = None, None
    for b in batches:
        out = []
        for m, d, piece in zip(*(b.column(k).to_pylist() for k in (0, 1, 3))):
            if at == (m, d):
                sha.update(b",")
            else:
                if at:
                    out.append((*at, sha.hexdigest()))
                at, sha = (m, d), hashlib.sha256()
            sha.update(piece.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(("m", "d", "sha"), x)) for x in out], schema=_SHA)
    if at:
        yield pa.RecordBatch.from_pylist([{"m": at[0], "d": at[1], "sha": sha.hexdigest()}], schema=_SHA)


_PIECES = pa.schema([("m", pa.int64()), ("d", pa.int64()), ("first", pa.int64()), ("piece", pa.string())])
_SHA = pa.schema([("m", pa.int64()), ("d", pa.int64()), ("sha", pa.string())])


def ends_hashed(ends: DataFrame) -> DataFrame:
    """(m, d, sha): SHA-256 of the conversations c that end at each node (m, d), in order.

    Sorting and joining them to pieces is spread over ranges; only the pieces of a node, a row for some thousands of
    conversations, come to one task, as a stream.
    """
    pieces = ends.repartitionByRange("m", "d", "c").sortWithinPartitions("m", "d", "c").mapInArrow(_pieces(PIECE), "m long, d long, first long, piece string")
    pieces = stored(pieces, "pieces")
    return pieces.repartition("m", "d").sortWithinPartitions("m", "d", "first").mapInArrow(_hashed, "m long, d long, sha string")


def trie(turns: DataFrame, splice: int = 6, of: int = 100) -> DataFrame:
    """One row for each distinct opening (node) of the rebuilt conversations of :func:`rebuilt`, the empty one (root) included.

    conv_id: smallest member (conversation that begins so); depth: turns; parent_conv_id: smallest member of the opening that is a
    turn shorter (root: null); n_convs: members; n_children; n_leaves: nodes without children in its subtree, itself
    included; saved_tokens: sum over its subtree of (n_convs - 1) * code points of a node's last text, what a
    prefix cache saves; ends_sha256: of the members that end here.  No conversations: no rows.

    Openings are told apart by 128 bits: the exclusive or of digests of place, role and text, which is a running value as
    well.  A run is the stretch of nodes with one smallest member; a run's key lists (depth, smallest member) of the runs on
    its way from the root, deeper branches first.  In the order of the keys the nodes stand in preorder: siblings by
    smallest member, the first of them being the run's own next node.  Positions, leaves and savings are running sums over
    that order; each node's subtree is an interval, and its leaves and savings are differences of two of the sums.
    """
    convs, rows = rebuilt(turns, splice, of)
    marks = rows.select("c", "d", "len", *[F.xxhash64("d", x).alias(x) for x in ("da", "db")])
    marks = running(marks, ["c", "d"], ["c"], a=("xor", F.col("da")), b=("xor", F.col("db"))).select("c", "d", "a", "b", "len")
    root = [F.lit(0).cast("long").alias(x) for x in ("d", "a", "b", "len")]
    marks = stored(marks.union(convs.select("c", *root)), "openings")
    nodes = stored(marks.groupBy("a", "b").agg(F.min("c").alias("m"), F.count("*").alias("n"), F.max("d").alias("d"), F.max("len").alias("len")), "nodes")
    spans = marks.join(nodes.select("a", "b", "m"), ["a", "b"]).groupBy("c", "m").agg(F.min("d").alias("d0"), F.max("d").alias("d1"))
    paths = stored(spans.groupBy("c").agg(F.array_sort(F.collect_list(F.struct("d0", "m"))).alias("path"), F.max("d1").alias("d1")), "paths")

    runs = paths.where(F.element_at("path", -1)["m"] == F.col("c")).select(F.col("c").alias("m"), F.element_at("path", -1)["d0"].alias("d0"), "d1", F.try_element_at("path", F.lit(-2))["m"].alias("up"), "path")
    branched = runs.where("up IS NOT NULL").select(F.col("up").alias("m"), (F.col("d0") - 1).alias("d1")).distinct().withColumn("leaf", F.lit(0).cast("long"))
    runs = runs.join(nodes.groupBy("m").agg(F.sum((F.col("n") - 1) * F.col("len")).alias("v")), "m").join(branched, ["m", "d1"], "left").withColumn("leaf", F.coalesce("leaf", F.lit(1).cast("long")))
    runs = runs.withColumn("key", F.flatten(F.transform("path", lambda x: F.array(-x["d0"], x["m"]))))
    runs = running(runs, ["key"], [], pos=("sum", F.col("d1") - F.col("d0") + 1), leaves=("sum", F.col("leaf")), saved=("sum", F.col("v")))
    runs = stored(runs.select("m", "d0", "d1", "up", "path", "leaf", F.struct("pos", "leaves", "saved").alias("last")), "runs")

    # Of every node that runs branch off: where the last subtree below it ends, and how many runs begin there.
    step = F.transform(F.sequence(F.lit(1), F.size("path") - 1), lambda i: F.struct(F.get("path", i - 1)["m"].alias("m"), (F.get("path", i)["d0"] - 1).alias("d"), (i == F.size("path") - 1).cast("long").alias("kid")))
    below = runs.where(F.size("path") > 1).select(F.explode(step).alias("x"), "last").groupBy("x.m", "x.d").agg(F.max("last").alias("below"), F.sum("x.kid").alias("kids"))
    x = nodes.select("m", "d", "n", ((F.col("n") - 1) * F.col("len")).alias("v")).join(runs.drop("path"), "m").join(below, ["m", "d"], "left")
    x = x.withColumn("end", F.coalesce("below", F.when(F.col("d") == F.col("d1"), F.col("last"))))
    x = running(x, ["m", F.desc("d")], ["m"], rest=("sum", F.col("v")), until=("max", F.col("end")))
    x = x.join(ends_hashed(paths.select(F.element_at("path", -1)["m"].alias("m"), F.col("d1").alias("d"), "c")), ["m", "d"], "left")
    return x.select(
        F.col("m").alias("conv_id"), F.col("d").alias("depth"), F.when(F.col("d") > F.col("d0"), F.col("m")).otherwise(F.col("up")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), ((F.col("d") < F.col("d1")).cast("long") + F.coalesce("kids", F.lit(0).cast("long"))).alias("n_children"),
        (F.col("until.leaves") - (F.col("last.leaves") - F.col("leaf"))).alias("n_leaves"), (F.col("until.saved") - (F.col("last.saved") - F.col("rest"))).alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("last.pos") - F.col("d1") + F.col("d")).alias("preorder"), F.col("until.pos").alias("preorder_end"),
    )


def oracle() -> str:
    """DuckDB SQL of :func:`trie`, without the preorder: openings as lists, subtrees by joining each node with every opening of its members."""
    return """
WITH RECURSIVE turns AS (
  SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
         struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) AS x
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list(x ORDER BY p) AS xs FROM turns GROUP BY c),
crc AS (  -- CRC-32 of the decimal id, a byte at a time and its eight bits by a table of one expression
  SELECT c, CAST(c AS VARCHAR) AS s, 1 AS i, CAST(4294967295 AS BIGINT) AS v FROM own
  UNION ALL
  SELECT c, s, i + 1, list_reduce(list_prepend(xor(v, CAST(ascii(substr(s, i, 1)) AS BIGINT)), range(8)),
    lambda a, b: xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END)) FROM crc WHERE i <= length(s)),
heads AS (SELECT c, xor(v, 4294967295) % 6 AS h FROM crc WHERE i = length(s) + 1),
rebuilt AS (
  SELECT o.c, list_concat(coalesce(b.xs[1:h], []), o.xs[h + 1:]) AS xs
  FROM own o JOIN heads USING (c) LEFT JOIN own b ON b.c = o.c - o.c % 100),
openings AS (SELECT c, d, xs[1:d] AS xs, len(xs) = d AS done FROM rebuilt, unnest(range(len(xs) + 1)) u(d)),
nodes AS (
  SELECT xs, min(c) AS conv_id, min(d) AS depth, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE done), '')) AS ends_sha256,
         (count(*) - 1) * coalesce(length(xs[-1].t), 0) AS v
  FROM openings GROUP BY xs),
kids AS (SELECT xs[1:depth - 1] AS xs, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
inside AS (
  SELECT n.xs[1:k] AS xs, sum(v) AS saved, count(*) FILTER (WHERE kids.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids USING (xs), unnest(range(n.depth + 1)) u(k) GROUP BY 1)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN inside USING (xs) LEFT JOIN kids USING (xs)
LEFT JOIN nodes up ON n.depth > 0 AND up.xs = n.xs[1:n.depth - 1]
"""
