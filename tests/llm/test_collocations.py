import random
import re
from collections import Counter, defaultdict

import duckdb

from gridtrack.llm import collocations
from gridtrack.llm.queries import op11_collocations

SCHEMA = "doc_id long, text string, lang string, n long, gram string, piece string"


def brute(rows, least, longest=5, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = tuple(x for x in re.split("[\x20\x09]+", piece) if x)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(w[i : i + k] for i in range(len(w)) for k in range(1, longest + 1) if i + k <= len(w))
    out = []
    for lang, c in f.items():
        phrases = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        inner = {h[i : i + k] for h, a in phrases.items() for k in range(2, len(h)) for i in range(len(h) - k + 1) if 100 * a >= 100 * c[h[i : i + k]]}
        best = []
        for g, a in phrases.items():
            if g not in inner:
                score, _, left, right = min((1000 * a * n[lang] // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
                best.append((-score, -a, " ".join(g).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(best)[:top], 1)]
    return sorted(out)


def fixture():
    rng, rows = random.Random(2), [(1, None, "en", 1, "", ""), (2, "", "en", 1, "", ""), (3, ".,;\n \t", None, 1, "", ""), (None, "a b a b É É\x85x", None, 1, "", ""), (4, "a b c d e f g. " * 20000, "en", 1, "", "")]
    fixed = ["new york", "Rio de\tJaneiro", "of the", "the end of the line", "a a a a a a a"]
    for d in range(10, 160):
        parts = [" ".join(rng.choice(["the", "of", "a", "b", "é", "und"]) for _ in range(rng.randrange(6))) for _ in range(rng.randrange(20))]
        parts += rng.choices(fixed, k=6)
        rng.shuffle(parts)
        rows.append((d, "".join(p + rng.choice([" ", "  ", ". ", ",", "\r\n", "\x0b"]) for p in parts), rng.choice(["en", "fr", None, "und"]), 1, "", ""))
    return rows + rows[20:60]


def test_against_brute_force(spark, monkeypatch):
    rows = fixture()
    frame = spark.createDataFrame(rows, SCHEMA)
    for least, top in ((3, 2000), (20, 7)):
        assert sorted(map(tuple, collocations.collocations(frame, least, top=top).collect())) == brute(rows, least, top=top)
    # What leaves a task in several parts, and a filter so full that it spares nothing, change nothing.
    monkeypatch.setattr(collocations, "COMBINED", 5)
    monkeypatch.setattr(collocations, "FILTER", 64)
    assert sorted(map(tuple, collocations.collocations(frame, 3).collect())) == brute(rows, 3)


def test_numbers_over_64_bits(spark):
    """A score whose product 1000 a n has 70 bits is exact."""
    pieces = spark.createDataFrame([("en", "x y", 10**9 + 7), ("en", "x", 3), ("en", "z", 10**12)], "lang string, piece string, n long")
    whole, collocations.pieces = collocations.pieces, lambda docs: docs
    try:
        got = collocations.collocations(pieces, 100).collect()
    finally:
        collocations.pieces = whole
    a = 10**9 + 7
    n = 2 * a + 3 + 10**12
    assert [tuple(r) for r in got] == [("en", 1, "x y", a, a + 3, a, n, 1000 * a * n // ((a + 3) * a))]


def test_as_the_sql(spark, tmp_path):
    frame = spark.createDataFrame(fixture(), SCHEMA)
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, op11_collocations(spark, str(tmp_path)).collect())) == sorted(con.sql(collocations.oracle()).fetchall())


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), (".", "en")], "text string, lang string")).count() == 0
