"""Language identification by error-correcting output codes over byte n-gram classifiers."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDERS = (2, 3, 4)
BITS = 15
PIECE = 1 << 20

#: ASCII letters stay (lower-cased before), bytes over 127 stay, all else is blank.
_BLANK = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def buckets(text: str) -> list[np.ndarray]:
    """Hash buckets of all byte n-grams of the lower-cased text with other than letters blanked, an array for each order and piece."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_BLANK).split()) + b" "
    out = []
    for at in range(0, len(raw), PIECE):
        piece = raw[max(0, at - 3) : at + PIECE] + b"\0\0\0"
        grams = np.ndarray((len(piece) - 3,), "<u4", piece, strides=(1,))
        for n in ORDERS:
            g = (grams[: len(piece) - 3 - n + 1] & np.uint32((1 << 8 * n) - 1)) + np.uint32(n)
            out.append((g * np.uint32(2654435761)) >> np.uint32(32 - BITS))
    return out


def code_matrix(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of +1 and -1: all distinct splits of up to 6 classes, else the best of seeded dense random codes by smallest distance."""
    if k <= 6:
        return np.array([[1] + [1 if (b >> i) & 1 else -1 for i in range(k - 1)] for b in range(2 ** (k - 1) - 1)], np.float32).reshape(-1, k).T
    rng, n = np.random.default_rng(seed), int(np.ceil(10 * np.log2(k)))
    best, code = -1, None
    for _ in range(200):
        m = rng.choice([-1.0, 1.0], (k, n))
        m = m[:, np.abs(m.sum(1 - 1)) < k]
        d = min((a != b).sum() for a, b in combinations(m, 2))
        if d > best:
            best, code = d, m
    return code.astype(np.float32)


@dataclass
class Model:
    """weights: bucket by bit; scale and bias turn a bit's sum over n-grams, divided by the root of their number, into a logit."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    def logits(self, parts: list[np.ndarray]) -> np.ndarray:
        n = sum(map(len, parts))
        total = sum((self.weights[p].sum(0, dtype=np.float64) for p in parts), np.zeros(self.code.shape[1]))
        return self.scale * total / np.sqrt(max(n, 1)) + self.bias

    def decode(self, logits: np.ndarray) -> tuple[int, float, float]:
        """The codeword of least logistic loss, its share among all codewords, and its lead over the next."""
        loss = np.logaddexp(0, -self.code * logits).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        return int(order[0]), float(1 / share.sum()), float(loss[order[1]] - loss[order[0]]) if len(loss) > 1 else np.inf


def training_rows(docs: DataFrame, per_lang: int, segments: int, seed: int) -> DataFrame:
    """(lang, segment): from about ``per_lang`` hashed-out rows of each language, up to ``segments`` stretches of 12 to 400 characters at seeded places."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return rows.select("lang", F.col("text").alias("segment"))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(1.0, per_lang / n) * 1_000_000)))])
    rows = rows.where(F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000)) < share[F.col("lang")])

    def cut(batches):
        for b in batches:
            langs, out = [], []
            for d, text, lang in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "lang"))):
                rng = np.random.default_rng([seed, d & 0x7FFFFFFF])
                for _ in range(segments):
                    n = int(np.exp(rng.uniform(np.log(12), np.log(400))))
                    at = int(rng.integers(0, max(1, len(text) - n + 1)))
                    langs.append(lang)
                    out.append(text[at : at + n])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.string())], names=["lang", "segment"])

    return rows.mapInArrow(cut, "lang string, segment string")


def fit(docs: DataFrame, per_lang: int = 2000, segments: int = 4, seed: int = 11) -> Model | None:
    """Trains on a sample of at most about ``per_lang`` labelled rows of each language; None where no row is labelled.

    Each bit's classifier holds the log-odds of n-gram buckets between the languages with
    the bit set and those without, each language counting the same.  Four fifths of the
    segments give the log-odds, the rest a logistic scale and bias for each bit; under fifty
    segments all give both.
    """
    got = training_rows(docs, per_lang, segments, seed).toPandas()  # per_lang * segments * 400 characters a language at most
    langs = sorted(set(got["lang"]))
    if not langs:
        return None
    got = got.sort_values(["lang", "segment"], kind="stable").reset_index(drop=True)
    parts = [np.concatenate(buckets(s)) for s in got["segment"]]
    y = got["lang"].map({v: i for i, v in enumerate(langs)}).to_numpy()
    held = np.arange(len(y)) % 5 == 4
    if len(y) < 50:
        held[:] = False
    counts = np.zeros((len(langs), 1 << BITS))
    for i in range(len(langs)):
        own = [p for p, k, h in zip(parts, y, held) if k == i and not h]
        if own:
            counts[i] = np.bincount(np.concatenate(own), minlength=1 << BITS)
    rate = (counts + 0.5) / (counts.sum(1, keepdims=True) + 0.5 * (1 << BITS))
    code = code_matrix(len(langs))
    weights = np.stack([np.log(rate[c > 0].mean(0)) - np.log(rate[c < 0].mean(0)) for c in code.T], 1).astype(np.float32) if code.shape[1] else np.zeros((1 << BITS, 0), np.float32)
    model = Model(langs, code, weights, np.ones(code.shape[1]), np.zeros(code.shape[1]))
    use = np.flatnonzero(held if held.any() else ~held)
    x = np.array([model.logits([parts[i]]) for i in use]).reshape(len(use), -1)
    for b in range(code.shape[1]):
        model.scale[b], model.bias[b] = logistic(x[:, b], code[y[use], b] > 0)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[float, float]:
    """Slope and intercept by Newton's method, the slope drawn towards 1."""
    a, b = 1.0, 0.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + ridge * (a - 1), (p - y).sum() + ridge * b])
        w = p * (1 - p)
        h = np.array([[(w * x * x).sum() + ridge, (w * x).sum()], [(w * x).sum(), w.sum() + ridge]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
    return max(a, 1e-3), b


def predicted(docs: DataFrame, model: Model | None, min_score: float = 0.6, names: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous; whole texts are read, all columns and rows stay.

    ``und`` with score 0 where text is null or has no letter, or nothing was learned.
    ``ambiguous`` marks a decoded language whose share among the codewords is under ``min_score``.
    Columns of these names in ``docs`` are replaced; ``names`` can give others.
    """
    docs = docs.drop(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    model_b = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches):
        m = model_b.value
        for b in batches:
            langs, scores, doubt = [], [], []
            for text in b.column("text").cast(pa.string()).to_pylist():
                if m is None or not text or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    doubt.append(False)
                    continue
                k, share, _ = m.decode(m.logits(buckets(text)))
                langs.append(m.langs[k])
                scores.append(share)
                doubt.append(share < min_score)
            out = [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(doubt, pa.bool_())]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, *names])

    return docs.mapInArrow(kernel, ", ".join([schema, *(f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean")))]))


def remainder(docs: DataFrame, mod: int):
    """crc32 of doc_id as text, modulo ``mod``; null for a null id."""
    return F.pmod(F.crc32(docs["doc_id"].cast("long").cast("string")), F.lit(mod))


def identified(docs: DataFrame, per_lang: int = 2000, min_score: float = 0.6) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous): one row for each row of ``docs``.

    Rows whose remainder by 4 is 2, and rows without doc_id, are not learned from; the
    former are ``held_out``.
    """
    own = docs.select("doc_id", "text", "lang")
    model = fit(own.where(remainder(own, 4) != 2), per_lang)
    rows = own.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(remainder(own, 4) == 2, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return predicted(rows, model, min_score).drop("text")
