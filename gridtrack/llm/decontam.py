"""Benchmark decontamination: the q-gram lemma in overlapping diagonal bands, then banded alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, released, stored

Q = 10
#: Characters of a window, the step between windows of an item, share of edits allowed. Items under LEAST characters are looked for exactly.
PASSAGE, STEP, RATE, LEAST = 64, 8, 1 / 16, 24
#: q-grams that a window and its match share at least, so that bands of one chance q-gram are never aligned.
SHARED = 3
#: Characters of items that one pass holds; more items take more passes.
BLOCK_CHARS = 4_000_000
#: An item longer than this is indexed in parts that overlap by a window.
PART = 1 << 16
#: Hits of a stretch of text that are counted at once.
HITS = 1 << 22
_BLANK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FILTER_BITS = 22


def normalised(text: str) -> bytes:
    """Lower-cased, with each run of other than ASCII letters and digits and non-ASCII characters one blank."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split())


def grams(text: bytes) -> np.ndarray:
    """A 64-bit hash of each q-gram."""
    n = len(text) - Q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.ndarray((n,), "<u8", text, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += np.ndarray((n,), "<u2", text, Q - 2, (1,))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h


def budget(length: int) -> int:
    """Edits allowed in a window: a sixteenth of it, and no more than leave SHARED common q-grams by the lemma."""
    return max(0, min(int(RATE * length), (length - Q + 1 - SHARED) // Q))


def windows(length: int) -> list[tuple[int, int]]:
    """The (start, length) of the windows of an item of so many characters."""
    n = min(PASSAGE, length)
    return [(at, n) for at in sorted({*range(0, length - n + 1, STEP), length - n})]


def banded_distance(a: bytes, b: bytes, low: int, high: int, most: int) -> int:
    """Least edits that turn ``a`` into a stretch of ``b`` on diagonals (place in b minus place in a) low..high; ``most`` + 1 if over ``most``."""
    if b.find(a, max(0, low), max(0, high) + len(a)) >= 0:
        return 0
    width, big = high - low + 1, most + 1
    row = [0 if 0 <= low + d <= len(b) else big for d in range(width)]
    for i, c in enumerate(a, 1):
        new, best = [big] * width, big
        for d in range(width):
            j = i + low + d
            if 0 <= j <= len(b):
                v = row[d] + (j == 0 or b[j - 1] != c) if j > 0 else big
                if d + 1 < width:
                    v = min(v, row[d + 1] + 1)
                if d:
                    v = min(v, new[d - 1] + 1)
                new[d] = v = min(v, big)
                best = min(best, v)
        if best > most:
            return big
        row = new
    return min(row)


class Index:
    """The q-grams of a block of items with their places, and the items that are too short for them."""

    def __init__(self, items: list[tuple[int, str]]):
        self.parts: list[tuple[int, bytes]] = []
        self.short: dict[int, dict[bytes, list[int]]] = {}  # words, item, ids
        for item, text in items:
            s = normalised(text or "")
            if len(s) >= LEAST:
                self.parts += [(item, s[at : at + PART + PASSAGE]) for at in range(0, max(1, len(s) - PASSAGE), PART)]
            elif s:
                self.short.setdefault(s.count(b" ") + 1, {}).setdefault(s, []).append(item)
        sizes = [max(0, len(p) - Q + 1) for _, p in self.parts]
        key = np.concatenate([np.zeros(0, np.uint64), *(grams(p) for _, p in self.parts)])
        order = np.argsort(key, kind="stable")
        self.part = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[order]
        self.place = np.concatenate([np.zeros(0, np.int32), *(np.arange(n, dtype=np.int32) for n in sizes)])[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.count = np.diff(np.append(self.first, len(key)))
        lengths = [min(PASSAGE, len(p)) for _, p in self.parts]
        self.edits = np.array([budget(n) for n in lengths], np.int64)
        self.least = np.array([n - Q + 1 - budget(n) * Q for n in lengths], np.int64)
        self.fewest = int(self.least.min()) if lengths else 1 << 30
        self.reach = max(lengths, default=0) + int(self.edits.max(initial=0)) - Q
        self.maybe = np.zeros(1 << _FILTER_BITS, bool)
        self.maybe[self.slot(self.keys)] = True

    @staticmethod
    def slot(g: np.ndarray) -> np.ndarray:
        return (g >> np.uint64(64 - _FILTER_BITS)).view(np.int64)

    def found(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item, start, end, edits) for each window or short item verified in the normalised text, by start; overlapping ones of an item are merged."""
        s = normalised(text)
        out = self.found_short(s) if self.short else []
        ahead = PASSAGE + 2 * int(RATE * PASSAGE)  # no match is longer
        for at in range(0, max(len(s) - Q + 1, 0), 1 << 20):
            out += self.found_in(s, at, min(at + (1 << 20) + ahead, len(s) - Q + 1), ahead)
        return merged(out)

    def found_short(self, s: bytes) -> list[tuple[int, int, int, int]]:
        words, out, at = s.split(b" "), [], 0
        for i, word in enumerate(words):
            for n, items in self.short.items():
                own = b" ".join(words[i : i + n])
                out += [(item, at, at + len(own), 0) for item in items.get(own, ())]
            at += len(word) + 1
        return out

    def found_in(self, s: bytes, low: int, high: int, ahead: int) -> list[tuple[int, int, int, int]]:
        """Of the windows whose matches have their q-grams at low..high - 1: a stretch with too many hits is halved, the halves overlap by a match."""
        g = grams(s[low : high + Q - 1])
        i = np.flatnonzero(self.maybe[self.slot(g)])
        k = np.searchsorted(self.keys, g[i])
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == g[i] if len(self.keys) else np.zeros(len(i), bool)
        i, k = i[ok] + low, k[ok]
        # A match has so many of its q-grams that close together.
        start = np.flatnonzero(i[self.fewest - 1 :] - i[: max(0, len(i) - self.fewest + 1)] <= self.reach)
        if not len(start):
            return []
        close = np.zeros(len(i) + 1, np.int64)
        np.add.at(close, start, 1)
        np.add.at(close, start + self.fewest, -1)
        close = np.cumsum(close[:-1]) > 0
        i, k = i[close], k[close]
        n = self.count[k]
        if n.sum() > HITS and high - low > 4 * ahead:
            mid = (low + high) // 2
            return self.found_in(s, low, mid + ahead, ahead) + self.found_in(s, mid, high, ahead)
        row = np.repeat(self.first[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        part, j = self.part[row].astype(np.int64), self.place[row].astype(np.int64)
        # Bands are twice the budget wide (and two more) and overlap by half, so a true match lies whole in one of them.
        shift = PART + 2 * PASSAGE
        at = (np.repeat(i, n) - j + shift) // (self.edits[part] + 1)
        span = len(s) + 2 * shift
        order = np.argsort(part * span + at, kind="stable")
        half, j = (part * span + at)[order], j[order]
        band, first, count = np.unique(half, return_index=True, return_counts=True)
        # A band's hits are those of its lower half and of the half above it.
        after = np.searchsorted(band, band + 1)
        after[after == len(band)] = 0
        upper = np.where(band[after] == band + 1, count[after], 0)
        below = np.flatnonzero(np.append(True, band[1:] != band[:-1] + 1)) if len(band) else np.zeros(0, np.int64)
        keys = np.concatenate([band, band[below] - 1])
        total = np.concatenate([count + upper, count[below]])
        out = []
        for key in keys[total >= self.least[(keys + 1) // span]].tolist():
            p, b = (key + 1) // span, (key + 1) % span - 1
            ends = np.searchsorted(band, [key, key + 2])
            js = np.sort(j[first[ends[0]] : first[ends[1]] if ends[1] < len(first) else len(j)])
            item, a = self.parts[p]
            edits = int(self.edits[p])
            lo, hi = b * (edits + 1) - shift, (b + 2) * (edits + 1) - 1 - shift
            for start, length in windows(len(a)):
                if np.searchsorted(js, start + length - Q, "right") - np.searchsorted(js, start) < self.least[p]:
                    continue
                left = max(0, start + lo - edits)
                d = banded_distance(a[start : start + length], s[left : start + hi + edits + length + edits], start + lo - left - edits, start + hi - left + edits, edits)
                if d <= edits:
                    out.append((item, max(0, start + lo), min(len(s), start + hi + length), d))
        return out


def merged(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    out: list[tuple[int, int, int, int]] = []
    by_item = lambda x: (x[0] is None, x[0] or 0)  # noqa: E731  items without an id come last
    for item, start, end, d in sorted(found, key=lambda x: (by_item(x), x[1:])):
        if out and out[-1][0] == item and start <= out[-1][2]:
            out[-1] = (item, out[-1][1], max(end, out[-1][2]), min(d, out[-1][3]))
        else:
            out.append((item, start, end, d))
    return sorted(out, key=lambda x: (x[1], by_item(x)))


def _regions(docs: DataFrame, items: DataFrame, block_chars: int, name: str) -> DataFrame:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-chars // block_chars))
    shape = "array<struct<item:long,start:int,end:int,edits:int>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{name}` {shape}"
    of = pa.list_(pa.struct([("item", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))
    out = docs.withColumn(name, F.lit(None).cast(shape))
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        index = docs.sparkSession.sparkContext.broadcast(Index([tuple(r) for r in own.collect()]))  # about block_chars

        def kernel(batches, index=index):
            for b in batches:
                texts, before = b.column("text").cast(pa.string()).to_pylist(), b.column(name).to_pylist()
                new = [(x or []) + [dict(zip(("item", "start", "end", "edits"), r)) for r in (index.value.found(t) if t else [])] for t, x in zip(texts, before)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(new, of)], names=b.schema.names)

        last, out = out, out.mapInArrow(kernel, schema)
        if passes > 1:  # one block at a time is alive
            out = stored(out, "regions")
            index.destroy()
            if k:
                released(last)
    return out


def regions(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with ``_regions`` (with more underscores if ``docs`` has that name), array<struct<item,start,end,edits>>: where windows of ``items`` (item_id, text) lie in the normalised text.

    Items are dealt to passes of about ``block_chars`` characters, each stored before the
    next, so what a task holds is bounded whatever the benchmark's size; documents are never shuffled.
    """
    return _regions(docs, items, block_chars, fresh(docs, "_regions")[0])


def judged(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, contaminated, n_regions, items, regions): one row for each row of ``docs``.

    ``items`` is the sorted array of the item ids found; ``regions`` lists item:start:end:edits
    by start, in characters of the normalised UTF-8 text.  An item is found by a window of 64
    characters with four edits, one of 24 to 64 characters whole with a sixteenth of edits, and a shorter one by its
    exact words.  Items without an id count as one item, of id null; those without a letter
    or digit are nowhere.  Null text has no regions; an empty benchmark finds nothing;
    repeated rows and null ids stay as they are.
    """
    rows = regions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), items)
    said = F.array_join(F.transform("_regions", lambda r: F.concat_ws(":", F.coalesce(r["item"].cast("string"), F.lit("null")), r["start"].cast("string"), r["end"].cast("string"), r["edits"].cast("string"))), ",")
    return rows.select("doc_id", (F.size("_regions") > 0).alias("contaminated"), F.size("_regions").cast("long").alias("n_regions"), F.array_sort(F.array_distinct(F.transform("_regions", lambda r: r["item"]))).alias("items"), said.alias("regions"))


def cleaned(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of ``items`` is found (see :func:`judged`); all columns stay, a null text too."""
    name = fresh(docs, "_regions")[0]
    return _regions(docs, items, BLOCK_CHARS, name).where(F.size(name) == 0).drop(name)
