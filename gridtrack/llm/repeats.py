"""Suffix-array dedup: bytes of strings that occur again anywhere, by enhanced suffix arrays over anchored contexts.

A string of ``passage`` bytes is found through its anchor: the place of the smallest q-gram
hash within it, the leftmost on ties.  Equal strings have equal anchors at equal places,
so only contexts whose anchor occurs twice are compared, and those of one anchor meet in
one group.  Within a group the texts from the anchor on are a sparse suffix array; its
common-prefix intervals, split by common left extension, are the maximal repeats through
the anchor with all their occurrences.  A longer string of ``least`` bytes is found through the
anchor of its first ``passage`` bytes, and contexts reach far enough to hold it whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, stored

#: Bytes of the strings that are removed where they occur again, and of those that only mark a document.
LEAST, PASSAGE = 400, 260
Q = 48
#: Contexts of one anchor that a task compares; larger groups are cut by the places of their strings.
GROUP = 1024
#: Widths of the stretches of places into which a larger group is cut, one after the other.
CUTS = (64, 16, 4, 1)
PIECE = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.default_rng(400)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWER = _INVERSE = None


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each q-gram, the same wherever it stands: a polynomial modulo 2^64 in table values, mixed."""
    global _POWER, _INVERSE
    if _POWER is None:
        _POWER, _INVERSE = _powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _POWER[: len(data)], out=total[1:])
    h = (total[q:] - total[:-q]) * _INVERSE[: len(data) - q + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def sliding_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Minima of all windows of ``w`` values: of a block's end and the next one's beginning."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    before = np.minimum.accumulate(blocks, 1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def anchors(text: bytes, least: int = LEAST, q: int = Q) -> list[tuple[int, int, int, int]]:
    """(hash, place, first, last) for each anchor of ``text``: the strings of ``least`` bytes that start at first..last have it."""
    out = []
    for at in range(0, len(text) - least + 1, PIECE - least):
        data = np.frombuffer(text, np.uint8)[at : at + PIECE - 1]
        if len(data) < least:
            break
        h = gram_hashes(data, q)
        low = np.uint64(PIECE - 1)
        key = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_minimum(key, least - q + 1) & low).astype(np.int64)
        n = min(len(place), PIECE - least)  # the next piece has the rest
        place = place[:n]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        last = np.append(first[1:], n) - 1
        p = place[first]
        out += zip(h[p].view(np.int64).tolist(), (p + at).tolist(), (first + at).tolist(), (last + at).tolist())
    return out


def common(x: bytes, y: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    low, high = 0, n  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        if x[low:mid] == y[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, length): the intervals of the common-prefix tree with length ``least`` or more, children first; lcp[i] is between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, v in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][1] > v:
            first, length = stack.pop()
            if length >= least:
                yield first, i, length
        if v >= 0 and (not stack or stack[-1][1] < v):
            stack.append((first, v))


def maximal_repeats(contexts: list[tuple[bytes, int]], least: int = LEAST) -> Iterator[tuple[int, int, list[int]]]:
    """(left, right, members): maximal repeats of ``least`` bytes or more through the anchors of the contexts (bytes, place of the anchor).

    Members agree from ``left`` bytes before the anchor to ``right`` bytes after its start;
    they differ in what follows (or some context ends), and in what precedes.
    """
    rights = [b[p:] for b, p in contexts]
    lefts = [b[:p][::-1] for b, p in contexts]
    order = sorted(range(len(contexts)), key=rights.__getitem__)
    place = {m: r for r, m in enumerate(order)}
    rank = {m: r for r, m in enumerate(sorted(range(len(contexts)), key=lefts.__getitem__))}
    longest = max(map(len, lefts), default=0)
    lcp = [common(rights[a], rights[b]) for a, b in zip(order, order[1:])]
    for first, last, right in intervals(lcp, max(1, least - longest)):
        members = sorted(order[first : last + 1], key=rank.__getitem__)
        before = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for i, j, left in intervals(before, max(0, least - right)):
            own = members[i : j + 1]
            if common(rights[min(own, key=place.__getitem__)], rights[max(own, key=place.__getitem__)]) == right:
                yield left, right, own


def _key(docs: DataFrame) -> DataFrame:
    """(d, k, doc_id, t): a row for each row of ``docs``; rows with equal d and k have equal doc_id and text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), t.cast("binary").alias("t")).select(F.coalesce("doc_id", F.lit(-1)).alias("d"), F.xxhash64("doc_id", "t").alias("k"), "doc_id", "t")


def anchored(docs: DataFrame, least: int, q: int, passage: int) -> DataFrame:
    """(d, k, a, c, lo, off, span, len): a row for each anchor of each text: its hash, its context's hash, where the context starts, the anchor's place in it, how many strings start in it besides the first, and its bytes, which end with the text or hold ``least`` from each of these starts."""

    def kernel(batches):
        digest = xxhash.xxh3_64_intdigest
        for b in batches:
            d, k, a, c, lo, off, span, size = [], [], [], [], [], [], [], []
            for own_d, own_k, t in zip(*(b.column(x).to_pylist() for x in ("d", "k", "t"))):
                found = anchors(t, passage, q)
                d += [own_d] * len(found)
                k += [own_k] * len(found)
                for h, p, first, last in found:
                    a.append(h)
                    context = t[first : last + least]
                    c.append(digest(context, p - first))
                    lo.append(first)
                    off.append(p - first)
                    span.append(last - first)
                    size.append(len(context))
            cols = [pa.array(x, pa.int64()) for x in (d, k, a)] + [pa.array(np.array(c, np.uint64).view(np.int64))] + [pa.array(x, pa.int32()) for x in (lo, off, span, size)]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "k", "a", "c", "lo", "off", "span", "len"])

    return _key(docs).where(F.length("t") >= passage).select("d", "k", "t").mapInArrow(kernel, "d long, k long, a long, c long, lo int, off int, span int, len int")


def contexts(rows: DataFrame) -> DataFrame:
    """(a, c, n, size, d, k, k2, lo, off, span, len): a row for each distinct context whose anchor occurs twice or more.

    ``n`` rows have the context, ``size`` contexts share the anchor; d, k, lo stand for one of
    the places, and k2 is another text's key if several have it.  Both counts are partial sums, so a passage that a
    third of the texts share is combined before it moves.
    """
    first = F.min(F.struct("k", "d", "lo", "off", "span", "len"))
    own = rows.groupBy("a", "c").agg(F.count("*").alias("n"), first.alias("x"), F.max("k").alias("k2")).select("a", "c", "n", "k2", "x.*")
    # Both stored on their own, so that both sides of the join are shuffled and an anchor of very many contexts can be split.
    own = stored(own, "contexts")
    every = stored(own.groupBy("a").agg(F.sum("n").alias("places"), F.count("*").alias("size")).where("places > 1").drop("places"), "anchors")
    return own.join(every.hint("merge"), "a")


_ASKED = ("a", "c", "n", "size", "k2", "lo", "off", "span", "len")
_EDGE = "a long, c long, n long, size long, k long, k2 long, off int, span int, b binary"


def _with_bytes(docs: DataFrame, edges: DataFrame, passage: int) -> DataFrame:
    """(a, c, n, size, k, k2, off, span, b): the contexts with their bytes."""
    asked = edges.groupBy("d", "k").agg(F.collect_list(F.struct(*_ASKED)).alias("asked"))

    def kernel(batches):
        for b in batches:
            out, seen = [], set()
            for d, k, t, asked in zip(*(b.column(x).to_pylist() for x in ("d", "k", "t", "asked"))):
                if (d, k) in seen:  # a repeated row
                    continue
                seen.add((d, k))
                out += [x | {"k": k, "b": t[x["lo"] : x["lo"] + x["len"]]} for x in asked]
            cols = [pa.array([x[c] for x in out], pa.int64()) for c in ("a", "c", "n", "size", "k", "k2")] + [pa.array([x[c] for x in out], pa.int32()) for c in ("off", "span")] + [pa.array([x["b"] for x in out], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["a", "c", "n", "size", "k", "k2", "off", "span", "b"])

    return _key(docs).where(F.length("t") >= passage).join(asked.hint("merge"), ["d", "k"]).select("d", "k", "t", "asked").mapInArrow(kernel, _EDGE)


def _groups(small: DataFrame, flush, schema: str) -> DataFrame:
    """Applies ``flush`` to the contexts of each anchor, every context once; it gives lists of the columns of ``schema``."""
    of = {"long": pa.int64(), "int": pa.int32()}
    fields = [(n, of[t]) for n, t in (x.split() for x in schema.split(", "))]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

    def kernel(batches):
        group: dict[int, dict] = {}
        anchor = None
        for b in batches:
            out: list[tuple] = []
            for x in b.to_pylist():
                if anchor != x["a"]:
                    flush(list(group.values()), out)
                    group, anchor = {}, x["a"]
                group[x["c"]] = x
            yield batch(out)
        out = []
        flush(list(group.values()), out)
        yield batch(out)

    return small.select("a", "c", "n", "off", "span", "k", "k2", "b").repartition("a").sortWithinPartitions("a").mapInArrow(kernel, schema)


def _in_groups(small: DataFrame, least: int, passage: int) -> DataFrame:
    """(c, a, start, end): the stretches of contexts, from their starts, that maximal repeats of ``least`` bytes of their anchor's group cover; start = end = 0 marks a context with one of ``passage`` bytes that another text has."""

    def flush(members, out):
        spans: list[set[tuple[int, int]]] = [set() for _ in members]
        several: set[int] = set()
        for left, right, of in maximal_repeats([(x["b"], x["off"]) for x in members], passage):
            if min(members[m]["k"] for m in of) != max(members[m]["k2"] for m in of):
                several.update(of)
            if left + right >= least:
                for m in of:
                    if members[m]["n"] == 1:  # a context that several places have is covered anyway
                        spans[m].add((members[m]["off"] - left, members[m]["off"] + right))
        for m, (x, own) in enumerate(zip(members, spans)):
            out += [(x["a"], x["c"], *s) for s in [*joined_spans(own), *[(0, 0)] * (m in several)]]

    return _groups(small, flush, "a long, c long, start int, end int")


def _cut(rows: DataFrame, width: int, least: int) -> DataFrame:
    """Cuts contexts at a fixed grid of ``width`` places before the anchor: (a, c, n, k, k2, off, first, last, b, core, sub).

    ``first``..``last`` are the string starts of a piece, from the context's start; ``core`` hashes what
    all strings of its grid stretch have in common, ``sub`` the piece's bytes.
    """

    def kernel(batches):
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                b, off, at = x["b"], x["off"], x["first"]
                shift = x["first"]  # b starts at this place of the context
                while at <= x["last"]:
                    grid = (at - off) // width
                    low, high = grid * width + off, grid * width + width - 1 + off
                    last = min(high, x["last"])
                    core = digest(b[high - shift : max(high, low + least) - shift], grid & 0xFFFFFFFF)
                    piece = b[at - shift : last + least - shift]
                    out.append(x | {"first": at, "last": last, "b": piece, "core": core, "sub": digest(piece, at - low)})
                    at = last + 1
            ints = [pa.array([x[c] for x in out], pa.int64()) for c in ("a", "c", "n", "k", "k2")] + [pa.array([x[c] for x in out], pa.int32()) for c in ("off", "first", "last")]
            hashes = [pa.array(np.array([x[c] for x in out], np.uint64).view(np.int64)) for c in ("core", "sub")]
            yield pa.RecordBatch.from_arrays([*ints, pa.array([x["b"] for x in out], pa.binary()), *hashes], names=["a", "c", "n", "k", "k2", "off", "first", "last", "b", "core", "sub"])

    return rows.select("a", "c", "n", "k", "k2", "off", "first", "last", "b").mapInArrow(kernel, "a long, c long, n long, k long, k2 long, off int, first int, last int, b binary, core long, sub long")


def _in_cuts(large: DataFrame, length: int) -> DataFrame:
    """(a, c, start, end, k, k2): as :func:`_in_groups` for strings of ``length`` bytes of anchors with any number of contexts; k and k2 are the least and largest key of the texts that have the stretch.

    A group is cut by place and common core.  A piece that several contexts have is covered; of
    equal pieces one goes on, and only where a core has unequal pieces is it cut finer, down to
    single strings.  So the work of a passage's edge is a few rows for each text that has it,
    and no task gathers a group.
    """
    found = None
    last = F.least(F.col("span"), F.length("b") - length)
    rows = large.select("a", "c", "n", "k", "k2", "off", F.lit(0).alias("first"), last.alias("last"), "b").where("last >= 0")
    for width in CUTS:
        x = stored(_cut(rows, width, length), "cuts")
        # Both are stored, so that the pieces of a core that very many texts have can be split in the join.
        piece = stored(x.groupBy("a", "core", "sub").agg(F.sum("n").alias("m"), F.min("c").alias("one"), F.min("k").alias("k_min"), F.max("k2").alias("k_max")), "pieces")
        several = stored(piece.groupBy("a", "core").agg(F.sum("m").alias("places"), F.count("*").alias("kinds")).where("places > 1"), "cores")
        piece = stored(piece.join(several.hint("merge"), ["a", "core"]).where("m > 1 OR kinds > 1"), "pieces")
        x = x.drop("k", "k2").join(piece.hint("merge"), ["a", "core", "sub"])
        own = x.where("m > 1").select("a", "c", F.col("first").alias("start"), (F.col("last") + length).alias("end"), F.col("k_min").alias("k"), F.col("k_max").alias("k2"))
        found = own if found is None else found.union(own)
        rows = x.where("kinds > 1 AND c = one").select("a", "c", F.col("m").alias("n"), F.col("k_min").alias("k"), F.col("k_max").alias("k2"), "off", "first", "last", "b")
    return found


def _found(docs: DataFrame, least: int, q: int, passage: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored rows of anchors that occur twice or more, their contexts, and the contexts with their bytes."""
    each = stored(anchored(docs, least, q, passage), "anchors")
    # Most anchors occur once: they go before anything but their hash moves.
    twice = stored(each.groupBy("a").agg(F.count("*").alias("places")).where("places > 1").select("a"), "twice")
    rows = stored(each.join(twice.hint("merge"), "a", "left_semi"), "anchors")
    released(each, twice)
    every = stored(contexts(rows), "contexts")
    return rows, every, stored(_with_bytes(docs, every.where("size > 1"), passage), "edges")


def covered(docs: DataFrame, least: int = LEAST, q: int = Q, passage: int | None = None) -> DataFrame:
    """(d, k, spans, repeated): for each text with a string of ``passage`` bytes that another text has too (``repeated``), or with one of ``least`` bytes that also starts elsewhere: array<struct<start,end>> of the bytes in such of ``least``, not yet joined."""
    passage = min(passage or PASSAGE, least)
    rows, every, edges = _found(docs, least, q, passage)
    twice = every.where("n > 1")
    mark = [F.lit(0).alias("start"), F.lit(0).alias("end")]
    found = twice.where(F.col("len") >= least).select("a", "c", F.lit(0).alias("start"), F.col("len").alias("end")).union(twice.where("k <> k2").select("a", "c", *mark))
    found = found.union(_in_groups(edges.where(F.col("size") <= GROUP), least, passage))
    large = edges.where(F.col("size") > GROUP)
    if not large.isEmpty():
        found = found.union(_in_cuts(large, least).select("a", "c", "start", "end")).union(_in_cuts(large, passage).where("k <> k2").select("a", "c", *mark))
    parts = F.collect_set(F.when(F.col("end") > F.col("start"), F.struct("start", "end"))).alias("parts")
    found = stored(found.groupBy("a", "c").agg(parts, F.max(F.col("end") == F.col("start")).alias("repeated")), "found")
    released(every, edges)
    placed = rows.select("d", "k", "a", "c", "lo").join(found.hint("merge"), ["a", "c"]).select("d", "k", "repeated", F.transform("parts", lambda s: F.struct((s["start"] + F.col("lo")).alias("start"), (s["end"] + F.col("lo")).alias("end"))).alias("parts"))
    out = stored(placed.groupBy("d", "k").agg(F.flatten(F.collect_set("parts")).alias("spans"), F.max("repeated").alias("repeated")), "covered")
    released(rows, found)
    return out


def occurrences(docs: DataFrame, least: int = LEAST, q: int = Q) -> DataFrame:
    """(repeat, doc_id, start, end): the maximal repeats of ``least`` bytes or more with all their occurrences, in bytes of the texts.

    ``repeat`` hashes the string.  A repeat is maximal within the contexts of its anchor: a
    longer string comes as several that overlap, one for each anchor in it.  An anchor with one
    context gives the whole context; one of more than GROUP contexts gives the pieces of
    :func:`_in_cuts`, each with those that are cut like it.
    """

    def flush(members, out):
        members = members + [x for x in members if x["n"] > 1]  # what several places have whole is a repeat too
        for left, right, of in maximal_repeats([(x["b"], x["off"]) for x in members], least):
            at = members[of[0]]["off"] - left
            if at > members[of[0]]["span"]:  # not all that hold this string have it in this group, but those of its own anchor
                continue
            name = xxhash.xxh3_64_intdigest(members[of[0]]["b"][at : at + left + right])
            name -= (name >> 63) << 64
            out += [(members[m]["a"], members[m]["c"], members[m]["off"] - left, members[m]["off"] + right, name) for m in {members[m]["c"]: m for m in of}.values()]

    rows, every, edges = _found(docs, least, q, least)
    found = _groups(edges.where(F.col("size") <= GROUP), flush, "a long, c long, start int, end int, repeat long")
    found = found.union(every.where("size = 1").select("a", "c", F.lit(0), "len", "c"))
    large = edges.where(F.col("size") > GROUP)
    if not large.isEmpty():
        text = large.select("a", "c", "b")
        found = found.union(_in_cuts(large, least).join(text, ["a", "c"]).select("a", "c", "start", "end", F.xxhash64(F.expr("substring(b, start + 1, end - start)"))))
    return rows.join(stored(found, "occurrences").hint("merge"), ["a", "c"]).select("repeat", F.when(F.col("d") >= 0, F.col("d")).alias("doc_id"), (F.col("lo") + F.col("start")).alias("start"), (F.col("lo") + F.col("end")).alias("end")).distinct()


def joined_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def deduplicated(docs: DataFrame, least: int = LEAST, q: int = Q, passage: int | None = None) -> DataFrame:
    """(doc_id, spans, kept, repeated): one row for each row of ``docs``; ``spans`` are the maximal removed runs in bytes of the UTF-8 text, ``kept`` the remaining bytes.

    Every byte of a string of ``least`` bytes that starts at another place too goes, in this
    or another row, repeated rows included; strings are judged on the input.  ``repeated``
    says that the text has a string of ``passage`` bytes (PASSAGE, about fifty words, and ``least`` at most)
    that the text of another row holds too; rows with equal doc_id and text count as one here.
    Null text is empty; texts under ``passage`` bytes lose and have nothing.
    """
    both = _key(docs).join(covered(docs, least, q, passage).hint("merge"), ["d", "k"], "left")

    def kernel(batches):
        for b in batches:
            spans, kept = [], []
            for t, s in zip(b.column("t").to_pylist(), b.column("spans").to_pylist()):
                runs = joined_spans([(x["start"], x["end"]) for x in s or []])
                spans.append([{"start": x, "end": y} for x, y in runs])
                at, pieces = 0, []
                for x, y in runs:
                    pieces.append(t[at:x])
                    at = y
                kept.append(b"".join([*pieces, t[at:]]))
            of = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, of), pa.array(kept, pa.binary()), b.column("repeated")], names=["doc_id", "spans", "kept", "repeated"])

    return both.select("doc_id", "t", "spans", F.coalesce("repeated", F.lit(False)).alias("repeated")).mapInArrow(kernel, "doc_id long, spans array<struct<start:int,end:int>>, kept binary, repeated boolean")


def counted(docs: DataFrame, least: int = LEAST, q: int = Q, passage: int | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeated): the figures of :func:`deduplicated`."""
    rows = deduplicated(docs, least, q, passage)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return rows.select("doc_id", (removed + F.length("kept")).alias("n_bytes"), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "repeated")
