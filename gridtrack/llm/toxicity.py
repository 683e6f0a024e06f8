"""Toxicity: a convolutional text classifier over hashed word embeddings, trained on all labelled rows in numpy kernels whose steps Spark averages."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .langid import remainder

ROWS_LOG2 = 17
ROWS = 1 << ROWS_LOG2
DIM = 8
WIDTHS = (1, 2, 3)
FILTERS = 8
#: Lengths in bytes of the word beginnings that share in a word's embedding: inflected forms have these in common.
PREFIXES = (4, 5, 6)
TABLES = 2 + len(PREFIXES)
#: Words in the wide window, and the factor that brings its mean near the other features' size.
WIDE, WIDE_SCALE = 64, 16.0
PIECE = 1 << 16
#: Bytes that are hashed at once, words after which a step is taken with fewer than 32 texts, labelled rows that are
#: trained in a stretch between two averages, places of a change's binary point.
BYTES, BATCH, STRETCH, POINT = 1 << 20, 1 << 20, 4096, 24

#: ASCII letters and digits stay, bytes over 127 stay, all else is blank.
_BLANK = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def word_rows(text: str) -> np.ndarray:
    """The embedding rows of each lower-cased word of the whole text (words by TABLES): two for the word, by two parts of its hash, and one for each beginning."""
    raw = text.lower().encode("utf-8", "replace").translate(_BLANK)
    out, at = [np.empty((0, TABLES), np.int32)], 0
    while at < len(raw):
        end = raw.find(b" ", at + BYTES)
        end = len(raw) if end < 0 else end
        out.append(_rows(raw[at:end]))
        at = end
    return np.concatenate(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _rows(raw: bytes) -> np.ndarray:
    """:func:`word_rows` of blank-separated words: a word's hash is the sum of its bytes times powers of a number, mixed."""
    c = np.frombuffer(raw, np.uint8)
    on = np.concatenate([[False], c != 32, [False]])
    edges = np.flatnonzero(on[1:] != on[:-1])
    n = edges[1::2] - edges[::2]
    out = np.empty((len(n), TABLES), np.int32)
    if not len(n):
        return out
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    powers = np.multiply.accumulate(np.full(n.max(), 0x9E3779B97F4A7C15, np.uint64))
    v = (c[on[1:-1]].astype(np.uint64) + np.uint64(1)) * powers[place]
    h = _mixed(np.add.reduceat(v, first))
    out[:, 0] = h & np.uint64(ROWS - 1)
    out[:, 1] = (h >> np.uint64(64 - ROWS_LOG2)) + np.uint64(ROWS)
    for k, length in enumerate(PREFIXES, 2):
        h = _mixed(np.add.reduceat(v * (place < length), first))
        out[:, k] = (h >> np.uint64(64 - ROWS_LOG2)) + np.uint64(k * ROWS)
    return out


@dataclass
class Model:
    """emb: the rows of a word add up to its embedding. The features are the maxima of the filters over the text, and of the wide window's mean of the one-word filters."""

    emb: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def embedded(self, rows: np.ndarray) -> np.ndarray:
        return sum(self.emb.take(rows[..., k], 0) for k in range(TABLES))

    def pooled(self, rows: np.ndarray, whole: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The features (0 where nothing fires) and the places of the maxima; ``whole`` is the embedding of all ``rows``, if it is there."""
        best = np.zeros((len(WIDTHS) + 1) * FILTERS, np.float32)
        where = np.full(len(best), -1, np.int64)

        def keep(k: int, y: np.ndarray, at: int) -> None:
            top = y.argmax(0)
            value = y[top, np.arange(FILTERS)]
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            more = value > best[own]
            best[own] = np.where(more, value, best[own])
            where[own] = np.where(more, top + at, where[own])

        for at in range(0, len(rows), PIECE):
            part = rows[at : at + PIECE + WIDE - 1]
            x = self.embedded(part) if whole is None else whole[at : at + len(part)]
            for k, w in enumerate(WIDTHS):
                if len(part) < w:
                    continue
                y = sum(x[j : len(part) - w + 1 + j] @ self.filters[k][j] for j in range(w)) + self.biases[k]
                keep(k, y, at)
                if k == 0:
                    wide = min(WIDE, len(rows))
                    total = np.cumsum(np.maximum(y, 0), 0, dtype=np.float64)
                    total[wide:] -= total[:-wide].copy()
                    if len(part) >= wide:
                        keep(len(WIDTHS), (total[wide - 1 :] * (WIDE_SCALE / wide)).astype(np.float32), at)
        return best, where

    def logit(self, rows: np.ndarray) -> float:
        return float(self.pooled(rows)[0] @ self.out + self.out_bias)

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.scale * self.logit(rows) + self.shift, -30, 30))))


def start(texts: list[np.ndarray], y: np.ndarray, seed: int, lean: bool = True) -> Model:
    """:func:`begun` with the counts of ``texts``."""
    df = np.zeros((2, TABLES * ROWS))
    for rows, label in zip(texts, y):
        df[int(label), np.unique(rows)] += 1
    return begun(df, (1 - y).sum(), y.sum(), seed, lean)


def begun(df: np.ndarray, n0: float, n1: float, seed: int, lean: bool = True) -> Model:
    """Seeded random weights; with ``lean`` the first two embedding dimensions hold how far a row's texts lean to the toxic ones, in standard errors, for words and for beginnings, and the first two filters of each width read them.

    ``df`` counts the texts of each label (n0 and n1 in all) that have a row.
    """
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.02, (TABLES * ROWS, DIM)).astype(np.float32)
    out = np.zeros((len(WIDTHS) + 1) * FILTERS, np.float32)
    filters = [rng.normal(0, 0.2, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
    if not lean:
        return Model(emb, filters, biases, rng.normal(0, 0.2, len(out)).astype(np.float32), 0.0)
    n1, n0 = max(n1, 1), max(n0, 1)
    p = (df.sum(0) + 0.5) / (n1 + n0 + 1)
    z = (df[1] - n1 * p) / np.sqrt(n1 * p * (1 - p) * n0 / (n1 + n0) + 0.25)
    lean = np.clip(z / 6, -1, 2)
    emb[: 2 * ROWS, 0], emb[2 * ROWS :, 0] = lean[: 2 * ROWS] / 2, 0
    emb[: 2 * ROWS, 1], emb[2 * ROWS :, 1] = 0, lean[2 * ROWS :] / len(PREFIXES)
    for k in range(len(WIDTHS)):
        for f in range(2):
            filters[k][:, :, f] = 0
            filters[k][:, f, f] = 1
            biases[k][f] = -0.6
    out[[0, 1, len(WIDTHS) * FILTERS, len(WIDTHS) * FILTERS + 1]] = 1.0, 1.0, 2.0, 2.0
    return Model(emb, filters, biases, out, -2.0)


class Adam:
    """Steps for a model, 32 texts at a time: gradients pass the places of the maxima only (of the wide window to the filters only), and moments are kept for all but the embedding, which takes plain steps."""

    def __init__(self, m: Model, rate: float):
        self.m, self.rate, self.n, self.b1, self.b2 = m, rate, 0, 0.0, 0.0
        self.params = [m.out, *m.filters, *m.biases]
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.params]

    def step(self, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray) -> None:
        m, rate, size = self.m, self.rate, len(texts)
        xs = [m.embedded(rows) for rows in texts]
        got = [m.pooled(rows, x) for rows, x in zip(texts, xs)]
        best, where = np.stack([g[0] for g in got]), np.stack([g[1] for g in got])
        z = np.clip(best @ m.out + m.out_bias, -30, 30)
        d = weight * (1 / (1 + np.exp(-z)) - y) / size
        g_bias = d.sum()
        # What did not fire has no gradient.
        g = np.where(where >= 0, d[:, None] * m.out, 0).astype(np.float32)
        grads = [(d @ best).astype(np.float32), *[np.zeros_like(p) for p in self.params[1:]]]

        def window(of: list[np.ndarray], c: slice, w: int) -> np.ndarray:
            """The w lines from each maximum on, the text's last one again where it ends before; texts without words have zeros."""
            out = np.zeros((size, FILTERS, w, of[0].shape[1]), of[0].dtype)
            for i, lines in enumerate(of):
                if len(lines):
                    out[i] = lines[np.minimum(np.maximum(where[i, c], 0)[:, None] + np.arange(w), len(lines) - 1)]
            return out

        lines, changes = [], []
        for k, w in enumerate(WIDTHS):
            c = slice(k * FILTERS, (k + 1) * FILTERS)
            grads[1 + k] += np.einsum("bf,bfwd->wdf", g[:, c], window(xs, c, w))
            grads[1 + len(WIDTHS) + k] += g[:, c].sum(0)
            fired = g[:, c] != 0
            lines.append(window(texts, c, w)[fired].reshape(-1))
            changes.append(np.repeat(((rate * g[:, c])[:, :, None, None] * m.filters[k].transpose(2, 0, 1))[fired].reshape(-1, DIM), TABLES, 0))
        c = slice(len(WIDTHS) * FILTERS, None)
        words = np.minimum(np.array([len(rows) for rows in texts]), WIDE)
        share = g[:, c] * np.float32(WIDE_SCALE) / np.maximum(words, 1).astype(np.float32)[:, None]
        part = window(xs, c, WIDE)
        active = (np.einsum("bfwd,df->bfw", part, m.filters[0][0]) + m.biases[0][:, None] > 0) & (np.arange(WIDE) < words[:, None, None])
        grads[1][0] += np.einsum("bf,bfwd,bfw->df", share, part, active.astype(np.float32), optimize=True)
        grads[1 + len(WIDTHS)] += (share * active.sum(2)).sum(0)
        at = np.concatenate(lines).astype(np.int64)[:, None] * DIM + np.arange(DIM)
        np.subtract.at(m.emb.reshape(-1), at.reshape(-1), np.concatenate(changes).astype(np.float32).reshape(-1))
        self.n += 1
        for p, g, (v1, v2) in zip(self.params, grads, self.moments):
            g = g + 1e-4 * p
            v1 += 0.1 * (g - v1)
            v2 += 0.001 * (g * g - v2)
            p -= rate * (v1 / (1 - 0.9**self.n)) / (np.sqrt(v2 / (1 - 0.999**self.n)) + 1e-8)
        self.b1 += 0.1 * (g_bias - self.b1)
        self.b2 += 0.001 * (g_bias * g_bias - self.b2)
        m.out_bias -= rate * (self.b1 / (1 - 0.9**self.n)) / (np.sqrt(self.b2 / (1 - 0.999**self.n)) + 1e-8)


def weights(y: np.ndarray, n0: float, n1: float) -> np.ndarray:
    """Of each row, so that both labels count alike where n0 and n1 rows have them."""
    return np.where(y > 0, (n0 + n1) / (2 * max(n1, 1)), (n0 + n1) / (2 * max(n0, 1)))


def train(texts: list[np.ndarray], y: np.ndarray, epochs: int, rate: float, seed: int, lean: bool = True) -> Model:
    """Logistic loss with classes weighted alike, by the steps of :class:`Adam`, over texts in memory."""
    m = start(texts, y, seed, lean)
    rng, weight, adam = np.random.default_rng(seed + 1), weights(y, (1 - y).sum(), y.sum()), Adam(m, rate)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), 32):
            own = order[at : at + 32]
            adam.step([texts[i] for i in own], y[own], weight[own])
    return m


def flat(m: Model) -> np.ndarray:
    """All weights but the embedding in lines of DIM, the last one filled up."""
    own = np.concatenate([m.out, *[x.ravel() for x in (*m.filters, *m.biases)], [m.out_bias]]).astype(np.float32)
    return np.append(own, np.zeros(-len(own) % DIM, np.float32)).reshape(-1, DIM)


def moved(m: Model, rows: np.ndarray, by: np.ndarray) -> Model:
    """``m`` with ``by`` added to lines ``rows``: those of the embedding, then those of :func:`flat`."""
    emb, own, last = m.emb.copy(), flat(m), rows >= len(m.emb)
    emb[rows[~last]] += by[~last]
    own[rows[last] - len(m.emb)] += by[last]
    own, at, parts = own.ravel(), 0, []
    for like in (m.out, *m.filters, *m.biases):
        parts.append(own[at : at + like.size].reshape(like.shape).copy())
        at += like.size
    k = 1 + len(m.filters)
    return Model(emb, parts[1:k], parts[k:], parts[0], float(own[at]))


def averaged(rows: DataFrame, m: Model, n0: float, n1: float, rate: float) -> Model:
    """``m`` after each stretch of ``rows`` (piece, toxic, text) has trained it on its own: a weight's change is the mean of the stretches that changed it, weighted by their rows.

    A stretch is up to STRETCH rows of a piece, read 32 texts at a time.  Changes are summed as whole numbers, so the order of
    the tasks does not count; what comes to the driver is a line for each line of the model at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(m)

    def kernel(batches):
        base, before = shared.value, flat(shared.value)
        piece, n, adam, wait = None, 0, None, []

        def take() -> None:
            nonlocal adam, n
            y = np.array([label for label, _ in wait], float)
            adam = adam or Adam(moved(base, np.zeros(0, np.int64), np.zeros((0, DIM), np.float32)), rate)
            adam.step([r for _, r in wait], y, weights(y, n0, n1))
            n += len(wait)
            wait.clear()

        def change() -> pa.RecordBatch:
            nonlocal adam, n
            at = np.flatnonzero((adam.m.emb != base.emb).any(1))
            by = np.concatenate([adam.m.emb[at] - base.emb[at], flat(adam.m) - before])
            at = np.concatenate([at, len(base.emb) + np.arange(len(before))])
            by = np.rint(n * by.astype(float) * (1 << POINT)).astype(np.int64)
            cols = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n)), *map(pa.array, by.T.copy())]
            adam, n = None, 0
            return pa.RecordBatch.from_arrays(cols, names=["line", "n", *names])

        for b in batches:
            for p, label, text in zip(b.column("piece").to_pylist(), b.column("toxic").to_pylist(), b.column("text")):
                if p != piece or n >= STRETCH:
                    if wait:
                        take()
                    if n:
                        yield change()
                    piece = p
                wait.append((label, word_rows(text.as_py())))
                if len(wait) == 32 or sum(len(r) for _, r in wait) > BATCH:
                    take()
        if wait:
            take()
        if n:
            yield change()

    names = [f"d{k}" for k in range(DIM)]
    made = rows.select("piece", "toxic", "text").mapInArrow(kernel, "line int, n long, " + ", ".join(f"{c} long" for c in names))
    mean = [(F.sum(c) / F.sum("n") / (1 << POINT)).cast("float").alias(c) for c in names]
    got = made.groupBy("line").agg(*mean).toArrow()
    return moved(m, got["line"].to_numpy(), np.stack([got[c].to_numpy() for c in names], 1))


def text_counts(rows: DataFrame) -> np.ndarray:
    """Texts of each label that have each row of the embedding (2 by TABLES * ROWS), over ``rows`` (toxic, text): summed in Spark, as many sums come to the driver at most."""

    def kernel(batches):
        df = np.zeros((2, TABLES * ROWS), np.int64)
        for b in batches:
            for label, text in zip(b.column("toxic").to_pylist(), b.column("text")):
                df[label, np.unique(word_rows(text.as_py()))] += 1
        label, row = np.nonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(row), pa.array(df[label, row])], names=["toxic", "row", "n"])

    got = rows.select("toxic", "text").mapInArrow(kernel, "toxic long, row long, n long").groupBy("toxic", "row").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros((2, TABLES * ROWS))
    df[got["toxic"].to_numpy(), got["row"].to_numpy()] = got["n"].to_numpy()
    return df


def calibrated(rows: DataFrame, rounds: int = 30, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept from logit to probability over ``rows`` (logit, toxic), by Newton's method as in :func:`langid.logistic`: each round's sums are Spark's, over all rows."""
    a, b, x = 1.0, 0.0, F.col("logit")
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), a * x + b))))
        w = p * (1 - p)
        s = rows.agg(*[F.sum(c).alias(f"s{k}") for k, c in enumerate(((p - F.col("toxic")) * x, p - F.col("toxic"), w * x * x, w * x, w))]).first()
        da, db = np.linalg.solve([[s.s2 + ridge, s.s3], [s.s3, s.s4]], [s.s0 + ridge * (a - 1), s.s1])
        a, b = float(a - np.clip(da, -1, 1)), float(b - np.clip(db, -1, 1))
        if max(abs(da), abs(db)) < 1e-9:
            break
    return max(round(a, 9), 1e-3), round(b, 9)


def thresholds(rows: DataFrame, m: Model) -> dict[str, float]:
    """For each language of ``rows`` (lang, logit, toxic) with 20 rows and both labels the threshold of best F1, the middle one of several; a row for each language comes to the driver."""
    cuts = np.linspace(0.05, 0.95, 19)
    s = rows.select("lang", "toxic", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), m.scale * F.col("logit") + m.shift))))).alias("s")).where("lang IS NOT NULL")
    counts = [F.sum(F.when(F.col("s") >= float(c), x).otherwise(0)).alias(f"{n}{k}") for k, c in enumerate(cuts) for n, x in (("all", F.lit(1)), ("hit", F.col("toxic")))]
    out = {}
    for r in s.groupBy("lang").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), *counts).where("n >= 20 AND t > 0 AND t < n").collect():
        f1 = np.array([2 * r[f"hit{k}"] / max(r[f"all{k}"] + r.t, 1) for k in range(len(cuts))])
        out[r.lang] = round(float(cuts[np.flatnonzero(f1 == f1.max()).mean().astype(int)]), 2)
    return out


def marked(labels: DataFrame) -> DataFrame:
    """(_id, toxic): a row for each labelled document; one labelled twice is toxic if one of the labels says so."""
    return labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic"))


def sampled(marks: DataFrame, per_class: int, seed: int) -> DataFrame:
    """About ``per_class`` hashed-out rows of each label."""
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}  # 2 rows
    share = {k: int(min(1.0, per_class / v) * 1_000_000) for k, v in n.items()}
    return marks.where(F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share.get(1, 0)).otherwise(share.get(0, 0)))


def fit(docs: DataFrame, labels: DataFrame, per_class: int | None = None, max_chars: int | None = None, epochs: int = 4, rate: float = 0.01, seed: int = 3, lean: bool = True) -> Model | None:
    """Trains on all documents (doc_id, text, lang) that ``labels`` (doc_id, toxic) names; ``lean`` is as of :func:`begun`.

    The start's counts, the steps (:func:`averaged`, once an epoch), scale and shift of the score and each language's threshold
    of best F1 (0.7 where there are under 20 rows or one label only) are sums over all those rows; a fifth of them, by hash
    of doc_id, is for the last two.  Only a caller that asks for it gets less: ``per_class`` hashed-out rows a label, cut where a
    label's texts have ``max_chars`` characters.  None where a label is missing.
    """
    marks = marked(labels) if per_class is None else sampled(marked(labels), per_class, seed)
    own = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    if max_chars is not None:
        sizes = own.join(marks, "_id").select("_id", "toxic", F.length("text").alias("n"), F.xxhash64(F.lit(seed + 1), "_id").alias("h"))
        so_far = F.sum("n").over(Window.partitionBy("toxic").orderBy("h", "n").rowsBetween(Window.unboundedPreceding, 0))
        marks = marks.join(sizes.withColumn("n", so_far).where(F.col("n") <= max_chars).select("_id").distinct(), "_id")
    # As many pieces as stretches, dealt by id: the same ones however the tables lie.
    marks = stored(marks, "marks")
    pieces = max(1, -(-marks.count() // STRETCH))
    rows = own.repartition(pieces, "_id").join(marks.repartition(pieces, "_id").hint("merge"), "_id").withColumns({"piece": F.spark_partition_id(), "held": F.pmod(F.xxhash64(F.lit(seed + 2), "_id"), F.lit(5)) == 4})
    rows = stored(rows.sortWithinPartitions(F.xxhash64(F.lit(seed + 3), "_id"), F.xxhash64("text")), "labelled")
    n = {(r.held, r.toxic): r.n for r in rows.groupBy("held", "toxic").agg(F.count("*").alias("n")).collect()}  # 4 rows
    n0, n1 = n.get((False, 0), 0), n.get((False, 1), 0)
    if not n0 or not n1:
        return None
    learned = rows.where("NOT held")
    m = begun(text_counts(learned) if lean else np.zeros((2, 0)), n0, n1, seed, lean)
    for _ in range(epochs):
        m = averaged(learned, m, n0, n1, rate)
    own = rows.where("held") if min(n.get((True, 0), 0), n.get((True, 1), 0)) >= 3 else rows
    shared = docs.sparkSession.sparkContext.broadcast(m)

    def kernel(batches):
        for b in batches:
            z = [shared.value.logit(word_rows(t.as_py())) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("toxic"), pa.array(z, pa.float64())], names=["lang", "toxic", "logit"])

    logits = stored(own.select("lang", "toxic", "text").mapInArrow(kernel, "lang string, toxic int, logit double"), "logits")
    m.scale, m.shift = calibrated(logits)
    m.thresholds = thresholds(logits, m)
    return m


def scored(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang, score): one row for each row of ``docs`` with doc_id, text and lang; a null text is scored as an empty one, 0 where nothing was learned."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        m = shared.value
        for b in batches:
            s = [m.score(word_rows(t)) if m else 0.0 for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("lang"), pa.array(s, pa.float64())], names=["doc_id", "lang", "score"])

    return rows.mapInArrow(kernel, "doc_id long, lang string, score double")


def judged(docs: DataFrame, labels: DataFrame, per_class: int | None = None, threshold: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted, lang_threshold, flagged): one row for each row of ``docs``.

    Labels of rows whose remainder by 3 is 1 (``held_out``) are not learned.  ``predicted``
    compares with ``threshold``; ``flagged`` with the threshold of the row's language, which
    is no input of the score.
    """
    own = docs.select("doc_id", "text", "lang")
    model = fit(own, labels.where(remainder(labels, 3) != 1), per_class)
    cut = F.lit(threshold)
    for lang, value in sorted((model.thresholds if model else {}).items()):
        cut = F.when(F.col("lang") == lang, F.lit(value)).otherwise(cut)
    out = scored(own, model)
    held = F.coalesce(remainder(out, 3) == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), cut.alias("lang_threshold"), (F.col("score") >= cut).alias("flagged"))
