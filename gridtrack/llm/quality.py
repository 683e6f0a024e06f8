"""Quality rules at host level: failures by host, rates shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 5
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"

#: The rules: a document fails where the SQL condition holds. The host shares in the verdict of all.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 12 * n_words",
}
BASE = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words found twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    one = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = (h ^ one[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    seen: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(twice).tolist():  # equal hashes are looked at word by word
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    edge = np.zeros(len(words) + 1, np.int64)
    for found in seen.values():
        if len(found) > 1:
            edge[found] += 1
            edge[np.array(found) + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counted(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words of a UTF-8 text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    joined = np.frombuffer(b"".join(words), np.uint8)
    return len(words), int(((joined & 0xC0) != 0x80).sum()), int(_SYMBOL[joined].sum()), len(lines), len(lines) - len(set(lines)), repeated_words(words)


def counts(docs: DataFrame, host: str = "source") -> DataFrame:
    """(doc_id, host, counts of :func:`counted`): one row for each row of ``docs``; null text has no words."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host).cast("string").alias("host"), F.col("text").cast("string").cast("binary").alias("t"))

    def kernel(batches):
        for b in batches:
            got = [counted(t or b"") for t in b.column("t").to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*got)] if got else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("host"), *cols], names=["doc_id", "host", *(c.split()[0] for c in COUNTS.split(", "))])

    return rows.mapInArrow(kernel, f"doc_id long, host string, {COUNTS}")


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n_docs, rate_<rule>...): failure rates by host, shrunk towards all hosts'.

    The prior of a rule is the beta distribution with the mean m and variance v of the raw
    rates over hosts; its weight m(1-m)/v - 1 is held between 1 and 1000 documents.
    Null hosts count as one host of their own.
    """
    hosts = rows.groupBy("host").agg(F.count("*").alias("n_docs"), *[F.sum(F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END")).alias(f"f_{r}") for r, c in RULES.items()])
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in RULES}
    one = hosts.agg(*[x for r in RULES for x in (F.avg(rate[r]).alias(f"m_{r}"), F.var_pop(rate[r]).alias(f"v_{r}"))]).first()  # one row
    out = []
    for r in RULES:
        m, v = one[f"m_{r}"] or 0.0, one[f"v_{r}"] or 0.0
        weight = min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 1e-12 else 1000.0
        out.append(((F.col(f"f_{r}") + m * weight) / (F.col("n_docs") + weight)).alias(f"rate_{r}"))
    return hosts.select("host", "n_docs", *out)


def judged(docs: DataFrame, host: str = "source", limit: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_failed, host_rate, kept).

    One row for each row of ``docs``.  A host fails where the shrunk rate of any rule is
    over ``limit``; ``host_rate`` is its highest.  ``kept`` is false for a document that
    fails the base rule or whose host fails.  Hosts of all sizes are counted by partial
    sums; the verdicts, a row for each host, join back.
    """
    rows = stored(counts(docs, host), "quality")
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    hosts = host_rates(rows).select(F.col("host").alias("_host"), worst.alias("host_rate"))
    out = rows.join(hosts, rows["host"].eqNullSafe(hosts["_host"])).withColumn("base_failed", F.expr(BASE)).withColumn("host_failed", F.col("host_rate") > limit)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "host_failed", F.round("host_rate", 9).alias("host_rate"), (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"))


def oracle(limit: float = 0.5) -> str:
    """DuckDB SQL for :func:`judged` over the table documents, whose doc_id is unique."""
    sums = ", ".join(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) / count(*) AS p_{r}, sum(CASE WHEN {c} THEN 1 ELSE 0 END) AS f_{r}" for r, c in RULES.items())
    prior = ", ".join(f"avg(p_{r}) AS m_{r}, var_pop(p_{r}) AS v_{r}" for r in RULES)
    weight = {r: f"CASE WHEN v_{r} > 1e-12 THEN least(greatest(m_{r} * (1 - m_{r}) / v_{r} - 1, 1), 1000) ELSE 1000 END" for r in RULES}
    worst = ", ".join(f"(f_{r} + m_{r} * ({weight[r]})) / (n_docs + ({weight[r]}))" for r in RULES)
    return rf"""
WITH base AS (
  SELECT doc_id, source AS host, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM base),
five AS (SELECT doc_id, i, x || {' || '.join(f"' ' || lead(x, {k}) OVER o" for k in range(1, WINDOW))} AS s FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM five WHERE s IS NOT NULL),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM win, generate_series(0, {WINDOW - 1}) AS g(k) WHERE c > 1 GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
counts AS (
  SELECT b.doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN rep r USING (doc_id) LEFT JOIN lines l USING (doc_id)),
hosts AS (SELECT host, count(*) AS n_docs, {sums} FROM counts GROUP BY host),
prior AS (SELECT {prior} FROM hosts),
verdict AS (SELECT host, greatest({worst}) AS host_rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE}) AS base_failed, host_rate > {limit} AS host_failed,
  round(host_rate, 9) AS host_rate, NOT ({BASE}) AND NOT host_rate > {limit} AS kept
FROM counts c JOIN verdict v ON c.host IS NOT DISTINCT FROM v.host"""
