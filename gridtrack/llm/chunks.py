"""Substring dedup by content-defined chunks: a gear rolling hash cuts, digests of the variable chunks decide."""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: A cut depends on this many bytes before it, through as many low bits of the hash.
SPAN = 16
_GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint32)
LAST = 0x7FFFFFFFFFFFFFFF
#: Least bytes of a stretch of repeated chunks that goes: about twenty words.
RUN = 120


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, its low SPAN bits: the sum of the table's entries of the last SPAN bytes, each shifted by its age."""
    h = _GEAR[data]
    step = 1
    while step < SPAN:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h & np.uint32((1 << SPAN) - 1)


def cuts(data: bytes, mean: int, least: int, most: int) -> list[int]:
    """The ends of the chunks: after a byte whose hash is in the lowest 1/``mean`` of its range and which is ``least`` or more from the last cut, else after ``most`` bytes."""
    if not data:
        return []
    marks = (np.flatnonzero(gear(np.frombuffer(data, np.uint8)) < np.uint32((1 << SPAN) // mean)) + 1).tolist()
    out, at, k = [], 0, 0
    while at < len(data):
        k = bisect_left(marks, at + least, k)
        end = marks[k] if k < len(marks) and marks[k] <= at + most else min(at + most, len(data))
        out.append(end)
        at = end
    return out


def chunked(docs: DataFrame, mean: int = 40, least: int = 20, most: int = 160) -> DataFrame:
    """(doc_id, row, seq, start, len, d1, d2, again): a row for each chunk of each row of ``docs``, and one with null seq for an empty or null text.

    ``d1`` and ``d2`` are the halves of a 128-bit BLAKE2b digest; ``again`` marks a chunk
    that the same text has before.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("text").cast("string").cast("binary").alias("t"))
    names = ["doc_id", "row", "seq", "start", "len", "d1", "d2", "again"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]

    def kernel(batches):
        digest = hashlib.blake2b
        for b in batches:
            doc, row, seq, start, size, dig, again = [], [], [], [], [], [], []
            for d, r, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "row", "t"))):
                ends = cuts(t, mean, least, most) if t else []
                if not ends:
                    doc.append(d), row.append(r), seq.append(None), start.append(0), size.append(0), dig.append(b"\0" * 16), again.append(False)
                    continue
                begins = [0, *ends[:-1]]
                own = [digest(t[x:y], digest_size=16).digest() for x, y in zip(begins, ends)]
                seen: set[bytes] = set()
                for x in own:
                    again.append(x in seen)
                    seen.add(x)
                n = len(ends)
                doc += [d] * n
                row += [r] * n
                seq += range(n)
                start += begins
                size += [y - x for x, y in zip(begins, ends)]
                dig += own
            d12 = np.frombuffer(b"".join(dig), np.int64).reshape(-1, 2)
            cols = [doc, row, seq, start, size, np.ascontiguousarray(d12[:, 0]), np.ascontiguousarray(d12[:, 1]), again]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=names)

    return rows.mapInArrow(kernel, "doc_id long, row long, seq int, start int, len int, d1 long, d2 long, again boolean")


def marked(docs: DataFrame, **sizes: int) -> DataFrame:
    """The chunks of :func:`chunked` with ``shared`` (another document holds it too) and ``repeat`` (it is not the one that stays).

    Of equal chunks the first stays: the one of the smallest doc_id (null counts as
    largest), and the first in its text.  Rows with the same doc_id, or without any, count
    as one document, and each keeps what its other rows hold too.
    """
    c = stored(chunked(docs, **sizes), "chunks")
    order = F.coalesce("doc_id", F.lit(LAST))
    # Stored on its own, so that both sides of the join are shuffled and a chunk of very many documents can be split.
    several = stored(c.where("seq IS NOT NULL AND NOT again").groupBy("d1", "d2").agg(F.min(order).alias("first"), F.max(order).alias("last")).where("first < last"), "several")
    out = c.join(several, ["d1", "d2"], "left")
    shared = F.col("first").isNotNull() & F.col("seq").isNotNull()
    return out.withColumn("shared", shared).withColumn("repeat", F.col("again") | (shared & F.coalesce(order > F.col("first"), F.lit(False))))


def deduplicated(docs: DataFrame, run: int = RUN, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_shared, n_removed, n_spans, spans): one row for each row of ``docs``.

    What goes are stretches of adjoining repeated chunks (:func:`marked`) of ``run`` bytes or
    more; shorter ones are phrases that texts share by chance, and stay.
    ``n_shared`` counts the bytes of chunks that another document holds too, first or not;
    ``n_removed`` those that go; ``spans`` lists the removed stretches, start:end in bytes
    of the UTF-8 text.  A null or empty text has one row with zeros and no spans; a null
    doc_id stays null; other columns are not read.
    """
    m = marked(docs, **sizes)
    gone = F.when(F.col("repeat"), F.struct("start", (F.col("start") + F.col("len")).alias("end")))
    rows = m.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sum(F.col("len").cast("long")).alias("n_bytes"), F.count("seq").alias("n_chunks"), F.sum(F.when(F.col("shared"), F.col("len").cast("long")).otherwise(0)).alias("n_shared"), F.array_sort(F.collect_list(gone)).alias("gone"))
    starts, ends = F.transform("gone", lambda s: s["start"]), F.transform("gone", lambda s: s["end"])
    # Where one repeated chunk ends and the next one starts, the stretch goes on.
    joined = F.zip_with(F.array_except(starts, ends), F.array_except(ends, starts), lambda s, e: F.struct(s.alias("s"), e.alias("e")))
    rows = rows.withColumn("runs", F.filter(joined, lambda x: x["e"] - x["s"] >= run))
    removed = F.aggregate("runs", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    spans = F.array_join(F.transform("runs", lambda x: F.concat_ws(":", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return rows.select("doc_id", "n_bytes", "n_chunks", "n_shared", removed.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), spans.alias("spans"))
