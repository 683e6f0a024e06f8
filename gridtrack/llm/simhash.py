"""SimHash near-duplicates: 64-bit fingerprints, blocks by the pigeonhole principle, verified Hamming distance."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, released, stored

#: Shingles whose bits are counted at once: bounds the memory of a very long text.
PIECE = 1 << 16


def fingerprint(text: bytes, width: int = 3) -> int:
    """SimHash of the lower-cased (A-Z only) words: a bit is 1 where it is set in over half of the shingles' XXH64.

    Repeated shingles count each time.  Fewer words than ``width``: the whole sequence is
    the one shingle; no words: 0.
    """
    words = text.lower().split()
    if not words:
        return 0
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    n = len(words) - width + 1
    hashes = np.fromiter((digest(s, 42) for s in shingles), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        ones += np.unpackbits(hashes[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint32)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3, keys: list[str] | None = None) -> DataFrame:
    """(doc_id or the long columns ``keys``, fp): one row for each row of ``docs``; fp is the fingerprint as a signed long."""
    keys = keys or ["doc_id"]
    rows = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").cast("binary").alias("t"))

    def kernel(batches):
        for b in batches:
            fps = [fingerprint(t or b"", width) for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fps, pa.int64())], names=[*keys, "fp"])

    return rows.mapInArrow(kernel, ", ".join(f"{k} long" for k in keys) + ", fp long")


def block_masks(bits: int, blocks: int) -> list[int]:
    """Masks of ``blocks - bits`` whole blocks each: two fingerprints that differ in ``bits`` bits or fewer agree under one of them at least."""
    edges = [round(64 * k / blocks) for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    out = [sum(c) for c in combinations(parts, blocks - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def links(fps: DataFrame, bits: int = 3, blocks: int = 6, bucket: int = 1024) -> DataFrame:
    """Pairs (u, v), u < v, of the distinct fingerprints in column fp that differ in ``bits`` bits or fewer.

    Fingerprints are dealt to buckets by each mask of ``blocks - bits`` blocks; only buckets
    with company go on.  A bucket of up to ``bucket`` fingerprints is joined with itself; a
    larger one is dealt to k parts, and each pair of parts is compared in a task of its
    own, so no bucket has to fit one task and none is capped.  The distance is part of
    the join's condition: only true links leave it.
    """
    one = fps.select("fp").distinct()
    masks = block_masks(bits, blocks)
    rows = one.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("b"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for k, m in enumerate(masks)])).alias("x")).select("fp", "x.b", "x.k")
    # Stored on its own, so that both sides of the join are shuffled and a crowded bucket can be split.
    full = stored(rows.groupBy("b", "k").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    rows = rows.join(full, ["b", "k"]).withColumn("parts", F.ceil(F.col("n") / bucket).cast("int"))
    rows = rows.withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    left = rows.select("b", "k", F.col("fp").alias("u"), F.col("p").alias("i"), F.explode(F.sequence("p", F.col("parts") - 1)).alias("j")).alias("l")
    right = rows.select("b", "k", F.col("fp").alias("v"), F.explode(F.sequence(F.lit(0), "p")).alias("i"), F.col("p").alias("j")).alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("b", "k", "i", "j")]
    near = (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= bits) & ((F.col("l.i") < F.col("l.j")) | (F.col("u") < F.col("v")))
    pairs = left.join(right, [*same, near])
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(rows: DataFrame, bits: int = 3, blocks: int = 6) -> DataFrame:
    """(fp, root): the component of each distinct fingerprint in column fp, named by its smallest one."""
    roots = connected_components(links(rows, bits, blocks)).withColumnRenamed("node", "fp")
    return rows.select("fp").distinct().join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, width: int = 3, bits: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, fingerprint, component_id, n_component): one row for each row of ``docs``.

    ``fingerprint`` has 16 lowercase hex digits; ``component_id`` is the smallest doc_id
    reachable over links of ``bits`` differing bits or fewer, the document's own included;
    ``n_component`` counts the rows of the component.  Null and empty texts have
    fingerprint 0 and link like any other.  A null doc_id is kept and is never a
    component's id unless the component has no other.  Repeated rows stay repeated.
    """
    rows = stored(fingerprints(docs, width), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).join(components(rows, bits, blocks), "fp")
    whole = nodes.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_component"))
    named = stored(nodes.join(whole, "root").select("fp", "component_id", "n_component"), "components")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_component")


#: Bits of the wide signature, blocks of samples, samples in a block.
SIGNATURE, SAMPLES, SAMPLE = 512, 8, 2
_rng = np.random.default_rng(512)
_ODD = _rng.integers(0, 1 << 31, SIGNATURE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, SIGNATURE, dtype=np.uint32)


def shingles_of(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles.  No words: one, that of the empty shingle."""
    words = text.lower().split()
    n = min(width, len(words))
    shingles = {b" ".join(x) for x in zip(*(words[k:] for k in range(n)))} if words else {b""}
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, shingles), np.uint64, len(shingles)))


def signature(text: bytes, width: int = 5) -> tuple[int, bytes, np.ndarray]:
    """(set, bits, keys) of a text's distinct shingles.

    ``set`` hashes them all.  A bit is the lowest one of the smallest of the shingles under its own
    permutation, so bits of two texts differ with probability (1 - J) / 2, where J is the
    similarity of their shingle sets; ``keys`` hash the first SAMPLE smallest of each block.
    No words: all zero, a text like any other without words.
    """
    h = shingles_of(text, width)
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    least = np.full(SIGNATURE, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 256):
        x = low[at : at + 256, None] * _ODD + _ADD
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        np.minimum(least, x.min(0), out=least)
    keys = least[: SAMPLES * SAMPLE].astype(np.uint64).reshape(SAMPLES, SAMPLE)
    key = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
    for k in range(1, SAMPLE):
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93) + keys[:, k]
    bits = np.packbits((least & np.uint32(1)).astype(bool)).tobytes()
    return xxhash.xxh3_64_intdigest(h.tobytes()), bits, key


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(g, set): the shingle hashes of each row of ``texts`` (g, t)."""

    def kernel(batches):
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                own = [shingles_of(t or b"", width).view(np.int64) for t in part.column("t").to_pylist()]
                ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("g"), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own)))], names=["g", "set"])

    return texts.select("g", "t").mapInArrow(kernel, "g long, set array<long>")


def apart(a: str, b: str):
    """Differing bits of the signatures in two columns."""
    return sum((F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(SIGNATURE // 64)), F.lit(0))


def company(rows: DataFrame, by: list[str]) -> DataFrame:
    """The groups ``by`` of ``rows`` that hold two roots (column r) at least: n rows, of which m are not of the root ``most`` that has most."""
    each = rows.groupBy(*by, "r").agg(F.count("*").alias("c"))
    groups = each.groupBy(*by).agg(F.sum("c").alias("n"), F.max(F.struct("c", "r")).alias("x"), F.count("*").alias("roots")).where("roots > 1")
    return groups.select(*by, "n", (F.col("n") - F.col("x.c")).alias("m"), F.col("x.r").alias("most"))


def met(rows: DataFrame, by: list[str], differ: int, bucket: int) -> DataFrame:
    """Pairs (u, v), u < v, of the rows (g, r, sig, n, m, most and ``by``) of each group that have other roots r and signatures apart by ``differ`` bits or fewer.

    Of the blocks (b, k) a pair comes from the first that it shares only, which the rows' array ``key`` tells.
    One of such a pair is not of the group's commonest root, so only those m rows are
    compared with all n.  Both are dealt to parts of ``bucket`` and each pair of parts is
    compared on its own.  Roots and distance are part of the join's condition.
    """
    parts = {c: F.ceil(F.col(x) / bucket).cast("int") for c, x in (("i", "m"), ("j", "n"))}
    rows = rows.withColumns({f"of_{c}": x for c, x in parts.items()})
    at, others = {c: F.pmod(F.xxhash64("g"), F.col(f"of_{c}")).cast("int").alias(c) for c in parts}, {c: F.explode(F.sequence(F.lit(0), F.col(f"of_{c}") - 1)).alias(c) for c in parts}
    own = ["g", "r", "sig", *(["key"] if "key" in rows.columns else [])]
    left = rows.where("r <> most").select(*by, *own, at["i"], others["j"]).alias("a")
    right = rows.select(*by, *own, (F.col("r") != F.col("most")).alias("both"), at["j"], others["i"]).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*by, "i", "j")]
    once = ~F.col("b.both") | (F.col("a.g") < F.col("b.g"))
    first = [(F.col("a.b") <= k) | (F.col("a.key")[k] != F.col("b.key")[k]) for k in range(SAMPLES - 1)] if "key" in own else []
    pairs = left.join(right, [*same, once, F.col("a.r") != F.col("b.r"), *first, apart("a.sig", "b.sig") <= differ])
    return pairs.select(F.least("a.g", "b.g").alias("u"), F.greatest("a.g", "b.g").alias("v")).distinct()


def hubs(rows: DataFrame, by: list[str], differ: int, classes: int) -> DataFrame:
    """Pairs as of :func:`met`, but each row only with the heaviest (column w) of its group in each of ``classes`` classes of texts: as many pairs as rows, times ``classes``."""
    k = F.pmod(F.xxhash64(F.lit(classes), "g"), F.lit(classes)).alias("class")
    # Stored on its own, so that the join below is a plain one whose crowded groups can be split.
    hub = stored(rows.groupBy(*by, k).agg(F.max(F.struct("w", "g", "r", "sig")).alias("x")).select(*by, "x.g", "x.r", "x.sig"), "hubs").alias("b")
    rows = rows.alias("a")
    pairs = rows.join(hub, [*[F.col(f"a.{c}") == F.col(f"b.{c}") for c in by], F.col("a.r") != F.col("b.r"), apart("a.sig", "b.sig") <= differ])
    return pairs.select(F.least("a.g", "b.g").alias("u"), F.greatest("a.g", "b.g").alias("v")).distinct()


def rare(sets: DataFrame, similarity: float) -> DataFrame:
    """(g, t): of each set its rarest shingles, so many that two sets of ``similarity`` or more share one (prefix filter); those of one set only are left out.

    Two such sets share ``similarity`` of the larger one at least, so under any common order
    of the shingles one lies among the first n - ceil(similarity n) + 1 of both.
    """
    each = sets.select("g", F.size("set").alias("size"), F.explode("set").alias("t"))
    often = stored(each.groupBy("t").agg(F.count("*").alias("n")).where("n > 1"), "shingles")
    held = each.join(often, "t").groupBy("g").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("n", "t"))).alias("l"))
    first = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1 - (F.col("size") - F.size("l"))
    return held.select("g", F.explode(F.slice("l", 1, F.greatest(first, F.lit(0)).cast("int"))).alias("x")).select("g", "x.t")


def similar_components(docs: DataFrame, keys: list[str], width: int = 5, similarity: float = 0.8, slack: float = 0.1, rounds: tuple[int, ...] = (1, 8), work: int = 1 << 24, bucket: int = 1024) -> DataFrame:
    """(keys, root): components of texts whose shingle sets have a similarity of ``similarity`` or more.

    The radius that such a similarity means is far too wide for whole blocks of one
    fingerprint, so blocks hash small samples of the shingles, which similar texts share
    with probability J^2 each, and the exact similarity of the shingle sets decides.  The Hamming distance of 512-bit signatures only spares hopeless pairs that: ``slack`` is 3.8 errors of its estimate.
    Texts with equal sets are one.  Every pair that shares a block is compared unless links
    join its texts already.  ``rounds`` first compare each text with a few heavy ones of its
    blocks (those that share most blocks with others), which joins nearly all that can be
    joined; then what is still apart in a block is compared pair by pair, those outside its
    commonest component with all.  Where that is over ``work`` comparisons, texts meet by
    their rarest shingles instead (:func:`rare`), which loses no pair, so a passage that
    very many different texts share brings no pairs; groups over ``bucket`` are dealt to parts.
    """
    rows = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], F.col("text").cast("string").cast("binary").alias("t"))
    texts, words = rows, SIGNATURE // 64

    def kernel(batches):
        for b in batches:
            got = [signature(t or b"", width) for t in b.column("t").to_pylist()]
            sets = np.array([g[0] for g in got], np.uint64).view(np.int64)
            sig = np.frombuffer(b"".join(g[1] for g in got), np.int64)
            key = np.concatenate([g[2] for g in got]).view(np.int64) if got else np.zeros(0, np.int64)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), n).cast(pa.list_(pa.int64())) for x, n in ((sig, words), (key, SAMPLES))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(sets), *lists], names=[*keys, "g", "sig", "key"])

    rows = stored(rows.mapInArrow(kernel, ", ".join(f"{k} long" for k in keys) + ", g long, sig array<long>, key array<long>"), "signatures")
    nodes = stored(rows.groupBy("g").agg(F.first("sig").alias("sig"), F.first("key").alias("key"), F.min(F.struct(*keys)).alias("rep")), "sets")
    at = nodes.select("g", F.posexplode("key").alias("b", "k"))
    full = at.groupBy("b", "k").agg(F.count("*").alias("n")).where("n > 1")
    at = stored(at.join(full, ["b", "k"]), "blocks")
    weight = at.groupBy("g").agg(F.sum("n").alias("w"))
    # Only texts with company are hashed again; repeated rows of the one that stands for its set count once.
    standing = stored(nodes.join(weight, "g").select("g", "w", "sig", "key", "rep.*"), "standing")
    sets = stored(shingle_sets(texts.join(standing.select("g", *keys), keys).groupBy(*keys, "g").agg(F.first("t").alias("t")), width), "shingles")
    blocks, at = at, stored(at.select("b", "k", "g").join(standing.select("g", "w", "sig", "key"), "g"), "members")
    released(blocks, nodes)
    differ, by = int((1 - similarity + slack) / 2 * SIGNATURE), ["b", "k"]

    def verified(pairs: DataFrame) -> DataFrame:
        near = stored(pairs, "near")
        both = near.join(sets.select(F.col("g").alias("u"), F.col("set").alias("a")), "u").join(sets.select(F.col("g").alias("v"), F.col("set").alias("b")), "v")
        shared = F.size(F.array_intersect("a", "b"))
        both = both.select("u", "v", shared.alias("x"), (F.size("a") + F.size("b")).alias("n"))
        out = stored(both.where(F.col("x") >= similarity * (F.col("n") - F.col("x")) - 1e-9).select("u", "v"), "linked")
        released(near)
        return out

    def apart_yet() -> DataFrame:
        """The members of the blocks that hold two roots yet, with n, m and most of :func:`company`."""
        own = at.withColumn("r", F.col("g")) if roots is None else at.join(roots, "g", "left").withColumn("r", F.coalesce("root", "g")).drop("root")
        own = stored(own, "rooted")
        out = stored(own.join(stored(company(own, by), "company"), by), "apart")
        released(own)
        return out

    roots = None
    for classes in rounds:
        more = verified(hubs(apart_yet(), by, differ, classes))
        more = more if roots is None else more.union(roots.select(F.col("g").alias("u"), F.col("root").alias("v")))
        roots = stored(connected_components(more).withColumnRenamed("node", "g"), "roots")
    members = apart_yet()
    direct = F.col("m") * F.col("n") <= work
    few = met(members.where(direct), by, differ, bucket)
    crowded = stored(members.where(~direct).select("g", "r", "sig").dropDuplicates(["g"]), "crowded")
    if not crowded.isEmpty():
        own = stored(rare(sets.join(crowded.select("g"), "g", "left_semi"), similarity).join(crowded, "g"), "rare")
        few = few.union(met(own.join(stored(company(own, ["t"]), "company"), "t"), ["t"], differ, bucket)).distinct()
    more = verified(few).union(roots.select(F.col("g").alias("u"), F.col("root").alias("v")))
    roots = stored(connected_components(more).withColumnRenamed("node", "g"), "roots")
    return rows.select(*keys, "g").join(roots, "g", "left").select(*keys, F.coalesce("root", "g").alias("root"))


def deduplicated(docs: DataFrame, width: int = 3, bits: int = 3, blocks: int = 6, similarity: float | None = None) -> DataFrame:
    """The rows of ``docs`` with one document of each component: that of the smallest doc_id (null counts as largest), on ties of the smallest hash of its columns.

    With ``similarity`` the components are those of :func:`similar_components` over shingles of
    ``width`` words, else those of fingerprints that differ in ``bits`` bits or fewer.
    All columns are kept; repeated rows count as copies, so one of them stays.
    """
    names, keys = docs.columns, fresh(docs, "_d", "_h")
    keyed = docs.withColumn(keys[1], F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])).withColumn(keys[0], F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)))
    if similarity is None:
        rows = stored(fingerprints(keyed, width, keys), "fingerprints")
        rows = rows.join(stored(components(rows, bits, blocks), "components"), "fp")
    else:
        rows = similar_components(keyed, keys, width, similarity)
    named = stored(rows.groupBy("root", *keys).agg(F.count("*").alias("n")), "members")
    # Stored on its own, so that the members of a large group can be split in the join.
    first = stored(named.groupBy("root").agg(F.min(F.struct(*keys)).alias("first")), "first")
    named = named.join(first, "root")
    is_first = F.struct(*keys) == F.col("first")
    kept = keyed.join(named.where(~is_first).select(*keys), keys, "left_anti")
    again = named.where(is_first & (F.col("n") > 1)).select(*keys)
    if not again.isEmpty():  # repeated rows of one that stays
        kept = kept.join(again, keys, "left_anti").unionByName(kept.join(again, keys, "left_semi").dropDuplicates(keys))
    return kept.select(*[F.col(f"`{c}`") for c in names])
