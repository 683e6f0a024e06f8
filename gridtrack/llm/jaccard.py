"""Exact similarity join of shingle sets: prefix index lists, skipped by block, and answers derived from those of very similar sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, released, stored
from .simhash import company

#: 64-bit words of the parity bitmap of a small set, to which others are folded in crowded lists: those of more comparisons than CROWDED.
WORDS, CROWDED = 8, 1 << 12
#: A shingle that stands in the prefix of more sets than this comes last in the order of the shingles, as does any that shares
#: its bit of a filter of fixed size: every task uses the same filter, so the order is one order whatever falls together.
COMMON, FILTER = 64, 1 << 25
#: Blocks of a list are of one size class and one of this many stretches of the prefix.
STRETCHES = 4


def shingle_set(text: bytes, width: int = 4) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of ``width`` words, A-Z in lower case; fewer words are one shingle, no words none."""
    words = text.lower().split()
    n = min(width, len(words))
    shingles = {b" ".join(x) for x in zip(*(words[k:] for k in range(n)))} if words else set()
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles)))


def parities(hashes: np.ndarray) -> np.ndarray:
    """Bitmap of a set, two to four bits an element: a bit is the parity of the elements that fall on it, so two sets differ in as many elements at least as their bitmaps in bits.

    The bitmap of half the words is the exclusive or of the two halves.
    """
    words = max(WORDS, 1 << (2 * len(hashes) // 64).bit_length())
    odd = np.bincount((hashes % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


#: Bits in which bitmaps a and b differ, the longer one folded to the shorter one's words.
DIFFER = """aggregate(sequence(0, least(size(a), size(b)) - 1), 0, (n, i) -> n + bit_count(
  aggregate(sequence(i, size(a) - 1, least(size(a), size(b))), 0L, (x, j) -> x ^ a[j]) ^ aggregate(sequence(i, size(b) - 1, least(size(a), size(b))), 0L, (x, j) -> x ^ b[j])))"""


def possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose bitmaps do not show already that they differ in too much.

    A filter of fixed size tells which sets may be in a pair; only their bitmaps are shuffled.
    """
    pairs = stored(pairs, "met")
    wanted = pairs.sparkSession.sparkContext.broadcast(filter_of(pairs.select(F.explode(F.array("u", "v")).alias("t"))))

    def kernel(batches):
        for b in batches:
            yield b.filter(pa.array(_in(wanted.value, b.column("g").to_numpy().view(np.uint64))))

    met = nodes.select("g", "s", "sig").mapInArrow(kernel, "g long, s long, sig array<long>")
    side = lambda x, y: pairs.join(met.select(F.col("g").alias(x), F.col("s").alias(f"s{x}"), F.col("sig").alias(y)), x)
    both = side("u", "a").join(side("v", "b"), ["u", "v"])
    return both.where(F.expr(DIFFER) <= F.col("su") + F.col("sv") - 2 * at_least(F.col("su"), F.col("sv"), percent)).select("u", "v")


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)))


def _slices(batches, rows: int = 256):
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def sets_of(rows: DataFrame, asked: DataFrame, width: int, percent: int | None = None, bits=None) -> DataFrame:
    """(g, s, set) of those of ``rows`` (doc_id, h, t) that ``asked`` (g, d, k) names by d and k: the s shingle hashes in order as unsigned numbers.

    With ``bits``, a broadcast filter of common hashes, only the prefix, common ones last.  No text is shuffled: a filter of fixed
    size tells which rows may be meant, and the join with ``asked`` follows on what is made of them.
    """
    wanted = rows.sparkSession.sparkContext.broadcast(filter_of(asked.select(F.xxhash64("d", "k").alias("t"))))

    def kernel(batches):
        for b in _slices(batches):
            b = b.filter(pa.array(_in(wanted.value, b.column("key").to_numpy().view(np.uint64))))
            own = [shingle_set(t or b"", width) for t in b.column("t").to_pylist()]
            sizes = pa.array([len(x) for x in own], pa.int64())
            if bits is not None:
                own = [x[np.argsort(_in(bits.value, x), kind="stable")[: prefix(len(x), percent)]] for x in own]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), sizes, _lists(own)], names=["doc_id", "h", "s", "set"])

    made = rows.select("doc_id", "h", F.xxhash64("doc_id", "h").alias("key"), "t").mapInArrow(kernel, "doc_id long, h long, s long, set array<long>")
    return made.join(asked, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("k"))).select("g", "s", "set")


def _in(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes % np.uint64(32 * len(bits))
    return (bits[at >> np.uint64(5)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1


def filter_of(hashes: DataFrame) -> np.ndarray:
    """FILTER bits, of which those of every hash in column t are set; words of 32 bits that are not 0 come to the driver, a million at most."""
    at = F.shiftrightunsigned("t", 5).bitwiseAND(F.lit((FILTER >> 5) - 1))
    words = hashes.groupBy(at.alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(t & 31 AS INT))")).alias("bit")).toPandas()
    out = np.zeros(FILTER >> 5, np.uint32)
    out[words["at"].to_numpy(np.int64)] = words["bit"].to_numpy(np.int64).astype(np.uint32)
    return out


def at_least(s: Column, t: Column, percent: int) -> Column:
    """Elements that sets of sizes s and t have to share to be similar: the smallest o with 100 o >= percent (s + t - o)."""
    return F.floor((percent * (s + t) + 99 + percent) / (100 + percent))


def prefix(s: Column | int, percent: int):
    """Elements of a set of size s, the first in any common order, of which each similar set has one in its own prefix: similar sets share percent % of the larger one."""
    return s - (percent * s + 99) // 100 + 1 if isinstance(s, int) else s - F.floor((percent * s + 99) / 100) + 1


def can_match(a: str, b: str, percent: int) -> Column:
    """Whether sets of list entries a and b (size s, place p of the shared shingle) can be similar, if the shingle is the first that they share."""
    s, t = F.col(f"{a}.s"), F.col(f"{b}.s")
    need = at_least(s, t, percent)
    return (100 * F.least(s, t) >= percent * F.greatest(s, t)) & (s - F.col(f"{a}.p") >= need) & (t - F.col(f"{b}.p") >= need)


def _size_class(s: Column, percent: int) -> Column:
    """Sizes of one class are within percent % of each other, so similar sets are of neighbouring classes."""
    return F.floor(F.log(s.cast("double")) / float(np.log(100 / percent))).cast("int")


def visited(percent: int) -> Column:
    """The blocks (size class c, stretch q of the prefix) in which a list entry (s, p) can have partners; all others are skipped.

    A partner of size t needs t - place >= o and s - p >= o, o = percent (s + t) / (100 + percent): the later p, the
    smaller t has to be, and the smaller t, the earlier its own place.
    """
    share, s = percent / (100 + percent), F.col("s").cast("double")
    most = F.least(s * 100 / percent, (s - F.col("p")) / share - s) * (1 + 1e-9) + 1e-6
    blocks = F.array(*[F.struct((_size_class(F.col("s"), percent) + k).alias("c"), F.lit(q).alias("q")) for k in range(-2, 3) for q in range(STRETCHES)])

    def worth(x):
        low, high = (F.pow(F.lit(100 / percent), (x["c"] + k).cast("double")) for k in (0, 1))
        t = F.least(most, high * (1 + 1e-9))
        early = x["q"] * (1 - percent / 100) / STRETCHES * t <= (1 - share) * t - share * s + 1
        return (low * (1 - 1e-9) <= most) & (t >= s * percent / 100 * (1 - 1e-9)) & early

    return F.filter(blocks, worth)


def own_block(percent: int) -> list[Column]:
    """The block (c, q) of a list entry."""
    q = F.floor(F.col("p") * STRETCHES * 100 / (F.col("s") * (100 - percent)))
    return [_size_class(F.col("s"), percent).alias("c"), F.least(q, F.lit(STRETCHES - 1)).cast("int").alias("q")]


def indexed(nodes: DataFrame, prefixes, percent: int) -> DataFrame:
    """The index lists: (t, g, s, p) for each shingle t in the prefix of set g, at place p, if another set has it in its prefix.

    The order of the shingles is that of their hashes, but those that more than COMMON sets have in their hash-ordered
    prefix come last.  Only sets with such a shingle in that prefix are read again for the prefix proper, by
    ``prefixes`` (a function of a table of g and the filter).
    """
    at = nodes.select("g", "s", F.posexplode("first").alias("p", "t"))
    bits = nodes.sparkSession.sparkContext.broadcast(filter_of(at.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") > COMMON).select("t")))

    def late(b) -> np.ndarray:
        first = b.column("first")
        hit = _in(bits.value, first.values.to_numpy(zero_copy_only=False).view(np.uint64))
        of = np.repeat(np.arange(b.num_rows), np.diff(first.offsets.to_numpy()))
        return np.isin(np.arange(b.num_rows), of[hit[first.offsets[0].as_py() :][: len(of)]])

    # A set's own shingles tell whether it is late, so neither kind of sets has to be joined with the other.
    known = nodes.select("g", "s", "first")
    again = stored(known.mapInArrow(lambda batches: (b.select(["g"]).filter(pa.array(late(b))) for b in batches), "g long"), "late")
    other = prefixes(again, bits).select("g", "s", F.posexplode("set").alias("p", "t"))
    early = known.mapInArrow(lambda batches: (b.filter(pa.array(~late(b))) for b in batches), "g long, s long, first array<long>")
    at = stored(early.select("g", "s", F.posexplode("first").alias("p", "t")).union(other), "entries")
    several = stored(at.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t"), "lists")
    out = stored(at.join(several, "t"), "index")
    released(at)
    return out


def links(nodes: DataFrame, sets, prefixes, percent: int, classes: tuple[int, ...] = (1, 8), bucket: int = 1 << 14) -> DataFrame:
    """(g, root): components of the sets of ``nodes`` (g, s, first, sig) under similarity of ``percent`` % or more, for sets with a link.

    In rounds each set is compared with a leader of its lists (one for each class of sets), which joins nearly all that can
    be joined: the leader is the one with fewest rarer shingles, so of copies with changes that with the fewest; then the entries of a list that are still of different components are compared, those outside the list's
    commonest component with all, block by block (:func:`visited`), and large lists part by part.
    """
    entries = indexed(nodes, prefixes, percent)
    near, roots = None, None
    for n in classes:
        # At first every set is a component of its own, so every list has company.
        rows = entries.withColumn("r", F.col("g")) if roots is None else _apart(entries, roots, ["t"])
        k = F.pmod(F.xxhash64(F.lit(n), "g"), F.lit(n))
        leaders = stored(rows.groupBy("t", k.alias("k")).agg(F.min(F.struct("p", F.xxhash64("g").alias("h"), "g", "s", "r")).alias("x")).select("t", "x.*"), "leaders")
        pairs = rows.alias("a").join(leaders.alias("b"), [F.col("a.t") == F.col("b.t"), F.col("a.r") != F.col("b.r"), can_match("a", "b", percent)])
        shared = stored(overlaps(possible(pairs.select(F.col("a.g").alias("u"), F.col("b.g").alias("v")).distinct(), nodes, percent), sets), "shared")
        released(leaders, *([] if roots is None else [rows]))
        now = shared.where(_similar("o", percent))
        # Those within half of what a pair may differ in are near enough for answers to carry over.
        close = shared.where(_similar("o", (100 + percent) // 2)).select(F.col("u").alias("g"), F.col("v").alias("lead"), "o")
        near = close if near is None else near.union(close)
        roots = _joined(now, roots)
    near = stored(near.groupBy("g").agg(F.max(F.struct("o", "lead")).alias("x")).select("g", "x.lead", "x.o"), "near")

    rows = _apart(entries, roots, ["t", "n", "m", "most"])
    crowded = F.col("m") * F.col("n") > CROWDED
    folded = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.aggregate(F.sequence(i, F.size("sig") - 1, F.lit(WORDS)), F.lit(0).cast("long"), lambda x, j: x.bitwiseXOR(F.get("sig", j))))
    # The crowded lists of a set in the order of its shingles, which is the same for all sets.
    own = rows.where(crowded).groupBy("g").agg(F.array_sort(F.collect_list(F.struct("p", "t", "s", "r", "n", "m", "most"))).alias("x"))
    own = own.join(nodes.select("g", folded.alias("sig")), "g").select("g", "sig", F.col("x.t").alias("lists"), F.explode("x").alias("x"))
    dense = stored(own.select("g", "sig", "lists", "x.*"), "crowded")
    pairs = met_few(rows.where(~crowded), percent).union(met(dense, percent, bucket)).distinct()
    return _joined(derived(possible(pairs, nodes, percent), near, nodes.select("g", "s"), sets, percent), roots)


def met_few(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs as of :func:`met`, of lists of up to CROWDED comparisons: so few that each entry is sent once and no block is skipped."""
    kept = ["t", "g", "s", "p", "r"]
    left, right = rows.where("r <> most").select(*kept).alias("a"), rows.select(*kept, (F.col("r") != F.col("most")).alias("both")).alias("b")
    once = ~F.col("b.both") | (F.col("a.g") < F.col("b.g"))
    return _pairs(left.join(right, [F.col("a.t") == F.col("b.t"), once, F.col("a.r") != F.col("b.r"), can_match("a", "b", percent)])).distinct()


def met(rows: DataFrame, percent: int, bucket: int) -> DataFrame:
    """Pairs (u, v), u < v, of entries (t, g, s, p, r, n, m, most, lists, sig) of the same list that are of other components r and can match, which the bitmaps sig have to allow too.

    One of such a pair is not of the list's commonest component (``most``), so only those m entries are
    compared with all n, and those only in the blocks where partners can be.  Both sides are dealt to parts of ``bucket``,
    and each pair of parts is compared on its own.  A pair leaves the first of its sets' ``lists`` that both are in and no
    other: near copies share very many.
    """
    parts = {"i": F.ceil(F.col("m") / bucket).cast("int"), "j": F.ceil(F.col("n") / bucket).cast("int")}
    rows = rows.withColumns({f"of_{c}": x for c, x in parts.items()})
    mine = {c: F.pmod(F.xxhash64("g"), F.col(f"of_{c}")).cast("int").alias(c) for c in parts}
    every = {c: F.explode(F.sequence(F.lit(0), F.col(f"of_{c}") - 1)).alias(c) for c in parts}
    kept = ["t", "g", "s", "p", "r", "sig", "lists"]
    left = rows.where("r <> most").select(*kept, "of_j", mine["i"], F.explode(visited(percent)).alias("x")).select(*kept, "of_j", "i", "x.c", "x.q").select(*kept, "c", "q", "i", every["j"]).alias("a")
    right = rows.select(*kept, (F.col("r") != F.col("most")).alias("both"), *own_block(percent), "of_i", mine["j"]).select(*kept, "both", "c", "q", "j", every["i"]).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("t", "c", "q", "i", "j")]
    once = ~F.col("b.both") | (F.col("a.g") < F.col("b.g"))
    s, t = F.col("a.s"), F.col("b.s")
    differ = sum((F.bit_count(F.col("a.sig")[k].bitwiseXOR(F.col("b.sig")[k])) for k in range(WORDS)), F.lit(0))
    fits = can_match("a", "b", percent) & (differ <= s + t - 2 * at_least(s, t, percent))
    first = F.get(F.array_intersect("a.lists", "b.lists"), F.lit(0)) == F.col("a.t")
    return _pairs(left.join(right, [*same, once, F.col("a.r") != F.col("b.r"), fits, first]))


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.g", "b.g").alias("u"), F.greatest("a.g", "b.g").alias("v"))


def _apart(entries: DataFrame, roots: DataFrame, of_list: list[str]) -> DataFrame:
    """The entries of the lists that hold two components yet, with their component r and the columns ``of_list`` of :func:`company`."""
    rows = _rooted(entries, roots)
    lists = stored(company(rows, ["t"]).select(*of_list), "company")
    out = stored(rows.join(lists, "t"), "apart")
    released(rows, lists)
    return out


def _rooted(entries: DataFrame, roots: DataFrame) -> DataFrame:
    return stored(entries.join(roots, "g", "left").withColumn("r", F.coalesce("root", "g")).drop("root"), "rooted")


def _joined(more: DataFrame, roots: DataFrame | None) -> DataFrame:
    more = more.select("u", "v")
    more = more if roots is None else more.union(roots.select(F.col("g").alias("u"), F.col("root").alias("v")))
    return stored(connected_components(more).withColumnRenamed("node", "g"), "roots")


def _similar(o: str, percent: int) -> Column:
    return 100 * F.col(o) >= percent * (F.col("su") + F.col("sv") - F.col(o))


def overlaps(pairs: DataFrame, sets) -> DataFrame:
    """(u, v, su, sv, o): sizes of the two sets of each pair and the elements that they share; only sets that are in a pair are read."""
    pairs = stored(pairs, "pairs")
    own = stored(sets(pairs.select(F.explode(F.array("u", "v")).alias("g")).distinct()), "sets")
    # Each side on its own: where there are few pairs, they go to the sets.
    side = lambda x: pairs.join(own.select(F.col("g").alias(x), F.col("s").alias(f"s{x}"), F.col("set").alias(f"set{x}")), x)
    both = side("u").join(side("v"), ["u", "v"])
    return both.select("u", "v", "su", "sv", F.size(F.array_intersect("setu", "setv")).cast("long").alias("o"))


def derived(pairs: DataFrame, near: DataFrame, sizes: DataFrame, sets, percent: int) -> DataFrame:
    """The similar ones of ``pairs`` (u, v).

    A set that is near a leader has nearly its leader's answers.  Elements that the two leaders share are counted once for all
    pairs of theirs; from them, what a set lacks of its leader and what it has beyond bound the pair's own count
    from both sides.  Only where the bounds leave it open the two sets themselves are compared.
    """
    pairs = stored(pairs, "open")
    # A leader stands for itself: it lacks nothing and has nothing beyond.
    side = sizes.join(pairs.select(F.explode(F.array("u", "v")).alias("g")).distinct(), "g", "left_semi").join(near, "g", "left").select("g", "s", F.coalesce("lead", "g").alias("lead"), F.coalesce("o", "s").alias("o"))
    side = stored(side.join(sizes.select(F.col("g").alias("lead"), F.col("s").alias("ls")), "lead").select("g", "lead", "s", (F.col("ls") - F.col("o")).alias("lacks"), (F.col("s") - F.col("o")).alias("beyond")), "sides")
    of = lambda x: side.select(*[F.col(c).alias(x if c == "g" else f"{c}{x}") for c in side.columns])
    both = stored(pairs.join(of("u"), "u").join(of("v"), "v").withColumns({"x": F.least("leadu", "leadv"), "y": F.greatest("leadu", "leadv")}), "sided")
    answers = overlaps(both.select(F.col("x").alias("u"), F.col("y").alias("v")).distinct(), sets).select(F.col("u").alias("x"), F.col("v").alias("y"), "o")
    both = both.join(stored(answers, "answers"), ["x", "y"])
    both = stored(both.select("u", "v", "su", "sv", (F.col("o") - F.col("lacksu") - F.col("lacksv")).alias("low"), (F.col("o") + F.col("beyondu") + F.col("beyondv")).alias("high")), "bounded")
    certain, possible = _similar("low", percent), _similar("high", percent)
    rest = overlaps(both.where(~certain & possible).select("u", "v"), sets).where(_similar("o", percent))
    return both.where(certain).select("u", "v").union(rest.select("u", "v"))


def joined(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``; documents link when their shingle sets are similar by ``percent`` % or more.

    A set holds the distinct shingles of ``width`` words, A-Z in lower case; fewer words are one shingle.  Documents without
    words (null and empty texts too) link with nothing: component_id is their doc_id.  Equal sets are one in all that
    follows, so copies cost nothing.  component_id is the smallest doc_id reachable over links, a null one only where the component
    has no other; repeated rows stay repeated.
    """
    text = F.col("text").cast("string").cast("binary")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("t"))

    def kernel(batches):
        for b in _slices(batches):
            own = [shingle_set(t or b"", width) for t in b.column("t").to_pylist()]
            g = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in own), np.uint64, len(own)).view(np.int64)
            first = _lists([x[: prefix(len(x), percent)] if len(x) else x for x in own])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("h"), pa.array(g), pa.array([len(x) for x in own], pa.int64()), first, _lists([parities(x) for x in own])], names=["doc_id", "h", "g", "s", "first", "sig"])

    wide = stored(rows.mapInArrow(kernel, "doc_id long, h long, g long, s long, first array<long>, sig array<long>"), "sets")
    every = stored(wide.select("doc_id", "h", "g", "s"), "rows")
    nodes = stored(wide.where("s > 0").groupBy("g").agg(F.first("s").alias("s"), F.first("first").alias("first"), F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "h")).alias("rep")), "distinct")
    released(wide)
    repeated = not every.groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1").isEmpty()

    def sets(which: DataFrame, *order) -> DataFrame:
        # One document for each set, by its id and the digest of its text; only rows alike in both come more than once.
        asked = stored(nodes.join(which, "g").select("g", F.col("rep.doc_id").alias("d"), F.col("rep.h").alias("k")), "asked")
        found = sets_of(rows, asked, width, *order)
        return found.dropDuplicates(["g"]) if repeated else found

    roots = links(nodes, sets, lambda which, bits: sets(which, percent, bits), percent)
    named = nodes.select("g", "doc_id").join(roots, "g", "left").withColumn("root", F.coalesce("root", "g"))
    named = stored(named.join(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("g", "component_id"), "components")
    out = every.where("s > 0").join(named, "g").select("doc_id", F.col("s").alias("n_shingles"), "component_id")
    return out.union(every.where("s = 0").select("doc_id", "s", F.col("doc_id").alias("component_id")))


def oracle(width: int = 4, percent: int = 85) -> str:
    """DuckDB SQL of :func:`joined`: all pairs of sets that share a shingle, then the smallest id by rounds."""
    return f"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {width} THEN [array_to_string(w, ' ')]
    ELSE list_distinct([array_to_string(w[i:i + {width - 1}], ' ') for i in range(1, len(w) - {width - 2})]) END AS s
  FROM words),
distinct_sets AS (SELECT min(doc_id) AS g, s FROM (SELECT doc_id, list_sort(s) AS s FROM sets) WHERE len(s) > 0 GROUP BY s),
held AS (SELECT g, len(s) AS n, unnest(s) AS x FROM distinct_sets),
links AS (
  SELECT a.g AS u, b.g AS v FROM held a JOIN held b ON a.x = b.x AND a.g < b.g AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
  GROUP BY a.g, b.g, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
both_ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reached AS (SELECT g AS u, g AS v FROM distinct_sets UNION SELECT r.u, b.v FROM reached r JOIN both_ways b ON b.u = r.v),
named AS (SELECT u AS g, min(v) AS c FROM reached GROUP BY u)
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(c, d.doc_id) AS component_id
FROM sets d LEFT JOIN distinct_sets x ON len(d.s) > 0 AND x.s = list_sort(d.s) LEFT JOIN named USING (g)
"""
