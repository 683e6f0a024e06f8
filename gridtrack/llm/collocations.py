"""Phrase collocations: distinct pieces with multiplicities, weighted n-grams counted by hash bucket in duckdb, parts looked up by shuffled requests."""

from __future__ import annotations

import tempfile
from collections import Counter
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Letters A-Z to lower case, ends of pieces to line feeds, tabs to blanks: fixed values.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
#: Entries that a task combines before they leave it, and memory of the counting of a bucket; beyond that duckdb uses the task's disk.
COMBINED, MEMORY = 400_000, "256MB"
#: Bits of the filter that spares windows with a rare part: its size is fixed, so a fuller filter spares fewer and loses none.
FILTER = 1 << 25


class _Combined:
    """Weights by (lang, key), given out as record batches whenever ``most`` keys are held."""

    def __init__(self, schema: pa.Schema, most: int):
        self.schema, self.most, self.held = schema, most, {}

    def of(self, lang: str) -> Counter:
        return self.held.setdefault(lang, Counter())

    def batches(self, rest: bool = False):
        if not rest and sum(map(len, self.held.values())) < self.most:
            return
        for lang, held in self.held.items():
            keys, n = list(held), list(held.values())
            for at in range(0, len(keys), 20_000):
                part = pa.array(keys[at : at + 20_000], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), part, pa.array(n[at : at + 20_000], pa.int64())], schema=self.schema)
        self.held = {}


def _schema(name: str) -> pa.Schema:
    return pa.schema([("lang", pa.string()), (name, pa.string()), ("n", pa.int64())])


def pieces(docs: DataFrame) -> DataFrame:
    """(lang, piece, n): the distinct pieces of all texts, their words joined by single blanks, and how often each occurs.

    Pieces end at ``.,;:!?`` and line ends; pieces without words are left out.  Null texts have none, a null lang is ``und``.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    most = COMBINED

    def kernel(batches):
        out = _Combined(_schema("piece"), most)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                found = text.translate(_PLAIN).split(b"\n")
                out.of(lang).update(x for x in (b" ".join(p.split(b" ")) if b"  " not in p else b" ".join(p.split()) for p in map(bytes.strip, found)) if x)
                yield from out.batches()
        yield from out.batches(rest=True)

    return rows.mapInArrow(kernel, "lang string, piece string, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def _places(keys: list[bytes], size: int) -> np.ndarray:
    """Two places in a filter of ``size`` bits for each key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.stack([h % np.uint64(size), (h >> np.uint64(32)) % np.uint64(size)])


def filter_of(grams: DataFrame) -> np.ndarray:
    """FILTER bits, of which those of every gram in column gram (any lang) are set.  What comes to the driver are the filter's words of 32 bits that are not 0, a million at most."""
    size = FILTER

    def kernel(batches):
        for b in batches:
            at = np.unique(_places(b.column(0).cast(pa.binary()).to_pylist(), size).ravel())
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(5)).astype(np.int64)), pa.array((np.int64(1) << (at & np.uint64(31)).astype(np.int64)))], names=["at", "bit"])

    words = grams.select("gram").mapInArrow(kernel, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()
    out = np.zeros(size >> 5, np.uint32)
    out[words["at"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).astype(np.uint32)
    return out


def _held(bits: np.ndarray, keys: list[bytes]) -> np.ndarray:
    """Which keys may be in the filter."""
    at = _places(keys, 32 * len(bits))
    return (((bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1)) == 1).all(0)


def windows(distinct: DataFrame, shortest: int, longest: int, bits=None, part: int = 0) -> DataFrame:
    """(lang, gram, n): from every word of every piece the longest stretch of ``shortest`` to ``longest`` words all whose ``part``-grams may be in the filter ``bits`` (a broadcast).

    All n-grams that begin at the word are beginnings of the stretch.  Rows of one stretch are combined within a task, weighted by the pieces' multiplicities.
    """

    held_most = COMBINED

    def kernel(batches):
        out, known = _Combined(_schema("gram"), held_most), bits.value if bits is not None else None
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                rows = b.slice(at, 2048)
                words = [p.split(b" ") for p in rows.column(1).cast(pa.binary()).to_pylist()]
                flat, sizes = list(chain.from_iterable(words)), np.fromiter(map(len, words), np.int64, len(words))
                ends = np.repeat(sizes.cumsum(), sizes)
                places = np.arange(len(flat))
                if known is None:
                    most = np.ones(len(flat), np.int64)
                else:
                    whole = np.flatnonzero(places + part <= ends)
                    good = np.zeros(len(flat) + 1, bool)
                    good[whole] = _held(known, [flat[i] for i in whole] if part == 1 else [b" ".join(flat[i : i + part]) for i in whole])
                    # The next place from each on whose part is not good; up to there every part is.
                    bad = np.where(good, len(flat), np.arange(len(flat) + 1))
                    run = np.minimum.accumulate(bad[::-1])[::-1][:-1] - places
                    most = np.where(run > 0, np.minimum(np.minimum(run + part - 1, ends - places), longest), 0)
                of = np.repeat(np.arange(len(words)), sizes)
                langs = rows.column(0).dictionary_encode()
                code, weight = langs.indices.to_numpy()[of], rows.column(2).to_numpy()[of]
                for k, lang in enumerate(langs.dictionary.to_pylist()):
                    mine, held = (code == k) & (most >= shortest), out.of(lang)
                    once = np.flatnonzero(mine & (weight == 1))
                    held.update([flat[i] for i in once] if longest == 1 else [b" ".join(flat[i : i + m]) for i, m in zip(once.tolist(), most[once].tolist())])
                    for i in np.flatnonzero(mine & (weight > 1)).tolist():
                        held[b" ".join(flat[i : i + most[i]])] += int(weight[i])
                yield from out.batches()
        yield from out.batches(rest=True)

    return distinct.select("lang", "piece", "n").mapInArrow(kernel, "lang string, gram string, n long")


def counted(found: DataFrame, shortest: int, longest: int, least: int) -> DataFrame:
    """(lang, gram, k, a): the grams of k words, ``shortest`` to ``longest``, that occur ``least`` times or more.

    The stretches are dealt to hash buckets by their first ``shortest`` words, so all of a gram's occurrences meet in one bucket, where
    duckdb counts the beginnings of the stretches, on disk where the memory is full.  A gram comes once from each task at most for every
    COMBINED entries, so a frequent one is few rows.
    """
    query = f"""
        SELECT lang, gram, k, CAST(sum(n) AS BIGINT) AS a FROM (
          SELECT lang, array_to_string(w[1:k], ' ') AS gram, k, n
          FROM (SELECT lang, string_split(gram, ' ') AS w, n FROM rows), unnest(range({shortest}, {longest} + 1)) u(k) WHERE k <= len(w))
        GROUP BY lang, gram, k HAVING sum(n) >= {least}"""

    def kernel(batches):
        with tempfile.TemporaryDirectory() as spill, duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": spill, "preserve_insertion_order": False}) as con:
            con.register("rows", pa.RecordBatchReader.from_batches(_schema("gram"), batches))
            for b in con.sql(query).to_arrow_reader(10_000):
                yield b.cast(pa.schema([("lang", pa.string()), ("gram", pa.string()), ("k", pa.int64()), ("a", pa.int64())]))

    bucket = F.xxhash64("lang", F.substring_index("gram", " ", shortest))
    return found.repartition(bucket).mapInArrow(kernel, "lang string, gram string, k long, a long")


def frequent(distinct: DataFrame, longest: int, least: int) -> DataFrame:
    """(lang, gram, k, a): all grams of 1 to ``longest`` words that occur ``least`` times or more in the pieces, with their exact counts.

    First words, then pairs of frequent words, then longer stretches of frequent pairs: a gram is never more frequent than its parts.
    """
    spark, out, part = distinct.sparkSession, None, 0
    for shortest, most in ((1, 1), (2, 2), (3, longest)):
        if shortest > longest:
            break
        bits = spark.sparkContext.broadcast(filter_of(out.where(F.col("k") == part))) if part else None
        now = stored(counted(windows(distinct, shortest, min(most, longest), bits, part), shortest, min(most, longest), least), "grams")
        out, part = now if out is None else out.union(now), shortest
    return out


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's best phrases of 2 to ``longest`` words that occur ``least`` times or more.

    With a, l and r the occurrences of the phrase and of its two parts at a cut and n those of all words of the lang, a cut's score is
    floor(1000 * a * n / (l * r)); the lowest of the cuts counts, of equal ones that after the fewest words.  A phrase is dropped if a longer
    one that contains it occurs as often.  The first ``top`` by score, a (both descending) and phrase remain.  Null texts have no
    words, a null lang is ``und``, repeated rows count each time, and a table without words has no rows in the result.
    """
    distinct = stored(pieces(docs), "pieces")
    spark = distinct.sparkSession
    grams = frequent(distinct, longest, least)
    total = distinct.groupBy("lang").agg(F.sum(F.col("n") * (F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1)).alias("total"))
    words = F.split("gram", " ")
    joined = lambda a, b: F.array_join(F.slice(words, a, b), " ")

    # A longer phrase that is as frequent has a stretch one word longer, and as frequent, in it.
    shorter = grams.where("k >= 3").select("lang", F.explode(F.array(joined(F.lit(1), F.col("k").cast("int") - 1), joined(F.lit(2), F.col("k").cast("int") - 1))).alias("gram"), "a")
    longer = shorter.groupBy("lang", "gram").agg(F.max("a").alias("longer"))
    phrases = grams.where("k >= 2").join(longer, ["lang", "gram"], "left").where("longer IS NULL OR longer < a").drop("longer")

    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k").cast("int") - 1)))
    sides = F.array(F.struct(F.lit("l").alias("side"), joined(F.lit(1), F.col("cut")).alias("asked")), F.struct(F.lit("r").alias("side"), joined(F.col("cut") + 1, F.col("k").cast("int") - F.col("cut")).alias("asked")))
    asked = stored(cuts.select("lang", "gram", "a", "cut", F.explode(sides).alias("x")).select("lang", "gram", "a", "cut", "x.side", "x.asked"), "requests")
    answers = asked.join(grams.select("lang", F.col("gram").alias("asked"), F.col("a").alias("f")), ["lang", "asked"])
    both = answers.groupBy("lang", "gram", "a", "cut").agg(F.max(F.when(F.col("side") == "l", F.col("f"))).alias("l"), F.max(F.when(F.col("side") == "r", F.col("f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr("(1000 * wide_a * wide_n) div (wide_l * wide_r)")
    both = both.join(total.withColumnRenamed("total", "n"), "lang")
    both = both.withColumns({f"wide_{c}": wide(c) for c in "anlr"}).withColumn("score", score)
    best = both.groupBy("lang", "gram", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x")).select("lang", F.col("gram").alias("phrase"), "a", "x.l", "x.r", "n", "x.score")

    # The first of every part of a lang, then the first of those: at most top rows of each part meet in a task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = F.pmod(F.xxhash64("phrase"), F.lit(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    best = best.withColumn("part", parts).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def oracle(least: int = 100, longest: int = 5, top: int = 2000) -> str:
    """DuckDB SQL of :func:`collocations`: every gram of every piece is a row."""
    return f"""
WITH pieces AS (
  SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)),
grams AS (
  SELECT lang, w[i:i + k - 1] AS g, k, count(*) AS a
  FROM pieces, unnest(range(1, len(w) + 1)) s(i), unnest(range(1, {longest} + 1)) t(k)
  WHERE i + k - 1 <= len(w) GROUP BY ALL),
totals AS (SELECT lang, sum(a) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM grams WHERE k >= 2 AND a >= {least}),
inner_ones AS (
  SELECT c.lang, c.g[i:i + t.k - 1] AS g, max(a) AS longer
  FROM candidates c, unnest(range(1, len(c.g) + 1)) s(i), unnest(range(2, len(c.g))) t(k)
  WHERE i + t.k - 1 <= len(c.g) GROUP BY ALL),
kept AS (SELECT c.* FROM candidates c LEFT JOIN inner_ones i USING (lang, g) WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (
  SELECT c.lang, c.g, c.a, cut, l.a AS l, r.a AS r, n,
         (CAST(1000 AS HUGEINT) * c.a * n) // (CAST(l.a AS HUGEINT) * r.a) AS score
  FROM (SELECT kept.*, unnest(range(1, k)) AS cut FROM kept) c
  JOIN grams l ON l.lang = c.lang AND l.g = c.g[1:cut] JOIN grams r ON r.lang = c.lang AND r.g = c.g[cut + 1:]
  JOIN totals ON totals.lang = c.lang),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
ranked AS (
  SELECT *, array_to_string(g, ' ') AS phrase,
         row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= {top}
"""
