"""Secret scan in DataFrame functions only: pattern spans, and a battery of randomness tests with false-discovery control."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

# The pattern kinds in the order in which their spans are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

#: What the randomness tests look at: unbroken runs of the characters that encodings use.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LOWER, UPPER, DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encoding, the tokens it fits (first that fits counts), its alphabet in value order.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?:[0-9a-f]+|[0-9A-F]+)$", DIGIT + "abcdef"),
    ("base32", r"^(?=.*[2-7])[A-Z2-7]+=*$", UPPER + "234567"),
    ("base36", r"^(?=.*[0-9])(?:[0-9a-z]+|[0-9A-Z]+)$", DIGIT + LOWER),
    ("letters", r"^(?:[a-z]+|[A-Z]+|[A-Z][a-z]+)$", LOWER),
    ("base64", r"", UPPER + LOWER + DIGIT + "+/"),
)
#: Natural text: sums of the squares and cubes of letter frequencies (about those of English; the second pair where a
#: seventh are capitals, which are other letters then), how often neighbours are of different classes (camel-cased words
#: of five and four letters), and the correlation of neighbours: characters of a class stand together, vowels do not.
SQUARES, CUBES = {"one case": 0.066, "mixed": 0.049}, {"one case": 0.0056, "mixed": 0.0035}
TURNS = {"one case": 0.2, "mixed": 0.25}
TOGETHER, VOWELS = 0.3, -0.35
#: A change of class: between letters and digits, and from a small letter to a capital.
TURN = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])"
#: Upper bounds of the length classes within which discoveries are controlled.
CLASSES = (23, 31, 47, 1 << 30)
STEPS = 400


#: Scans of an array go by blocks of this many entries, since an array that grows entry by entry is copied each time.
BLOCK = 64


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also where lambdas read it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _scan(values: Column, first: Column, op) -> Column:
    grown = F.aggregate(values, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))
    return F.slice(grown, 1, F.size(values))


def running(values: Column, first: Column, op) -> Column:
    """For each entry ``op`` over ``first`` and all entries before it: within blocks, and over the blocks' results."""

    def over(blocks):
        before = _scan(F.transform(blocks, lambda b: F.aggregate(b, first, op)), first, op)
        return F.flatten(F.zip_with(blocks, before, lambda b, at: _scan(b, at, op)))

    cuts = lambda v: F.sequence(F.lit(0), F.greatest(F.size(v) - 1, F.lit(0)), F.lit(BLOCK))
    return _let(values, lambda v: _let(F.transform(cuts(v), lambda k: F.slice(v, k + 1, F.lit(BLOCK))), over))


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start,end,hit>> of the leftmost non-overlapping matches, in code points: what a split leaves between the matches gives their places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def placed(pairs):
        before = running(F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"])), F.lit(0), lambda a, b: a + b)
        start = lambda p, at: at + F.length(p["gap"])
        return F.zip_with(pairs, before, lambda p, at: F.struct(start(p, at).alias("start"), (start(p, at) + F.length(p["hit"])).alias("end"), p["hit"].alias("hit")))

    pairs = _let(hits, lambda h: F.zip_with(F.slice(gaps, 1, F.size(h)), h, lambda g, x: F.struct(g.alias("gap"), x.alias("hit"))))
    return F.when(text.rlike(pattern), _let(pairs, placed)).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,hit:string>>)"))


def pattern_spans(text: Column) -> Column:
    """array<struct<start,rank,end>> of the three pattern kinds, by start and then kind; rank is the kind's place in KINDS.

    An assignment's value has 6 characters or more; a shorter one uses up its match.
    """
    value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6
    kind = lambda a, k: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("rank"), s["end"].alias("end")))
    found = [F.filter(spans_of(text, ASSIGN), value), spans_of(text, ACCESS), spans_of(text, HEX)]
    return F.array_sort(F.concat(*[kind(a, k) for k, a in enumerate(found)]))


def normal_tail(z: Column) -> Column:
    """P(Z > z) for a standard normal Z, by a polynomial in 1/(1 + 0.2316419 |z|) with absolute error under 1e-7."""
    # The coefficients of Abramowitz and Stegun 26.2.17.
    b = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def _codes(word: Column, alphabet: str) -> Column:
    return F.transform(F.split(word, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)


def token_tests(tokens: DataFrame) -> DataFrame:
    """Adds to rows with a string ``tok``: encoding, p_chi (uniformity), p_runs, p_serial, and p_natural.

    The first three are p-values under independent uniform characters of the inferred
    alphabet.  p_natural combines the same three tests against natural text: how uniform its
    characters are, how many runs of a class it has and how little its neighbours have to do with each other,
    each in standard errors, their sum over the root of their number.  Uniformity is left out for hex digits, which
    natural text cannot be told by, and runs for letters of one case, which have one.
    """
    kind, size, values = F.lit(None).cast("string"), F.lit(None).cast("double"), F.lit(None).cast("array<int>")
    bare = F.regexp_replace("tok", "=+$", "")
    for name, fits, alphabet in reversed(ENCODINGS):
        word = F.lower(bare) if name in ("hex", "base36", "letters") else F.translate(bare, "-_", "+/")
        codes = _codes(word, alphabet)
        test = F.col("tok").rlike(fits) if fits else F.lit(True)
        kind, size, values = F.when(test, F.lit(name)).otherwise(kind), F.when(test, F.lit(float(len(alphabet)))).otherwise(size), F.when(test, codes).otherwise(values)
    names = tokens.columns
    t = tokens.withColumns({"encoding": kind, "_a": size, "_v": F.filter(values, lambda v: v >= 0)})
    t = t.withColumn("_n", F.greatest(F.size("_v"), F.lit(2)).cast("double"))
    letters, mixed = F.col("encoding") == "letters", F.col("encoding") == "base64"
    vowels = F.transform(F.split(F.lower(bare), ""), lambda c: (F.instr(F.lit("aeiou"), c) > 0).cast("double"))
    t = t.withColumn("_s", F.when(letters, vowels).otherwise(F.transform("_v", lambda v: v.cast("double"))))
    t = t.withColumn("_m", _sum(F.col("_s")) / F.size("_s"))
    squares = _sum(F.transform(F.array_distinct("_v"), lambda d: F.pow(F.size(F.filter(F.col("_v"), lambda v: v == d)).cast("double"), 2)))
    middle = (F.col("_a") - 1) / 2
    after = lambda c: F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0)))
    before = lambda c: F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))
    turns = _sum(F.zip_with(after("_v"), before("_v"), lambda x, y: ((x > middle) != (y > middle)).cast("int")))
    product = _sum(F.zip_with(after("_v"), before("_v"), lambda x, y: (x - middle) * (y - middle)))
    spread = _sum(F.transform("_s", lambda x: (x - F.col("_m")) * (x - F.col("_m"))))
    together = _sum(F.zip_with(after("_s"), before("_s"), lambda x, y: (x - F.col("_m")) * (y - F.col("_m")))) / F.when(spread > 1e-9, spread)
    word = F.regexp_replace("tok", "[-_+/=]", "")
    t = t.withColumns({"_x": F.col("_a") / F.col("_n") * squares - F.col("_n"), "_turns": turns, "_prod": product, "_r": together, "_t": F.regexp_count(word, F.lit(TURN)).cast("double"), "_w": F.length(word).cast("double")})
    a, n, x, dof = F.col("_a"), F.col("_n"), F.col("_x"), F.col("_a") - 1
    # The cube root of a chi-squared over its degrees is close to normal.
    z_chi = (F.cbrt(F.greatest(x, F.lit(0.0)) / dof) - (1 - 2 / (9 * dof))) / F.sqrt(2 / (9 * dof))
    z_runs = (F.col("_turns") - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    z_serial = F.col("_prod") / ((a * a - 1) / 12 * F.sqrt(n - 1))
    of = lambda x: F.when(mixed, F.lit(x["mixed"])).otherwise(F.lit(x["one case"]))
    mean = dof + (n - 1) * (a * of(SQUARES) - 1)
    uniform = (mean - x) / F.sqrt(2 * dof + 4 * n * a * a * (of(CUBES) - of(SQUARES) * of(SQUARES)))
    changes = (F.col("_t") - 0.5 - of(TURNS) * (F.col("_w") - 1)) / F.sqrt(of(TURNS) * (1 - of(TURNS)) * F.greatest(F.col("_w") - 1, F.lit(1.0)))
    apart = F.when(letters, (F.col("_r") - VOWELS) * F.sqrt(n) / (1 - VOWELS**2)).otherwise((TOGETHER - F.col("_r")) * F.sqrt(n) / (1 - TOGETHER**2))
    apart = F.coalesce(apart, F.lit(-6.0))  # one character only
    z = F.when(F.col("encoding") == "hex", (changes + apart) / math.sqrt(2)).when(letters, (uniform + apart) / math.sqrt(2)).otherwise((uniform + changes + apart) / math.sqrt(3))
    return t.select(*names, "encoding", normal_tail(z_chi).alias("p_chi"), (2 * normal_tail(F.abs(z_runs))).alias("p_runs"), (2 * normal_tail(F.abs(z_serial))).alias("p_serial"), normal_tail(z).alias("p_natural"))


def _class(length: Column) -> Column:
    out = F.lit(len(CLASSES) - 1)
    for k in range(len(CLASSES) - 2, -1, -1):
        out = F.when(length <= CLASSES[k], F.lit(k)).otherwise(out)
    return out


def _step(p: Column) -> Column:
    """Twentieths of a power of ten, rounded up to the larger p: 0 stands for p of 1."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-19))) * 20), F.lit(STEPS)).cast("int")


def cutoffs(tokens: DataFrame, q: float) -> list[int]:
    """For each length class the lowest step of p_natural that counts as a discovery at false-discovery rate ``q`` (step-up rule).

    p-values are counted on a fixed scale of steps, rounded to the larger side, so the rule
    sees all tokens through a table of a few hundred counts a class.
    """
    counts = tokens.groupBy(_class(F.length("tok")).alias("c"), _step(F.col("p_natural")).alias("s")).agg(F.count("*").alias("n")).collect()  # 4 classes of 401 steps at most
    out = []
    for c in range(len(CLASSES)):
        own = {r.s: r.n for r in counts if r.c == c}
        total, up_to, cut = sum(own.values()), 0, STEPS + 1
        for s in sorted(own, reverse=True):
            up_to += own[s]
            if 10 ** (-s / 20) * total <= q * up_to:
                cut = s
        out.append(cut)
    return out


def free_tokens(rows: DataFrame) -> DataFrame:
    """(_row, start, end, tok) from rows with ``_row``, ``_base`` and ``_tokens``: one row for each token that no pattern span touches.

    A token is touched if a span that starts no later ends after its start, or one that starts no earlier starts before its end.
    """
    one = lambda s, hit: F.struct(s["start"].alias("start"), s["end"].alias("end"), hit.alias("tok"))
    tokens, spans = F.transform("_tokens", lambda s: one(s, s["hit"])), F.transform("_base", lambda s: one(s, F.lit(None).cast("string")))
    some = F.size("_base") > 0
    alone = rows.where(~some).select("_row", F.inline(tokens))
    both = rows.where(some & (F.size("_tokens") > 0)).select("_row", F.inline(F.concat(tokens, spans)))
    span = F.col("tok").isNull()
    # Running values from either end: a frame that looks ahead would be gone through anew for each row.
    up = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("_row").orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("_until", F.max(F.when(span, F.col("end"))).over(up)).withColumn("_from", F.min(F.when(span, F.col("start"))).over(down))
    apart = (F.coalesce("_until", F.lit(0)) <= F.col("start")) & (F.coalesce("_from", F.col("end")) >= F.col("end"))
    return alone.unionByName(both.where(~span & apart).drop("_until", "_from"))


def candidates(rows: DataFrame) -> DataFrame:
    """The tokens of :func:`free_tokens`, tested."""
    return token_tests(free_tokens(rows))


def scanned(docs: DataFrame, q: float = 0.01, alpha: float = 1e-3) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans): one row for each row of ``docs``.

    A token of 20 characters or more outside the pattern spans is a further finding, kind
    ``random``, if no test of the battery rejects randomness at level ``alpha`` and their
    combination is a discovery against natural text at rate ``q`` among tokens of its length class.
    Null text counts as empty; repeated rows and null ids are kept as they are; positions
    are code points, ends exclusive.  Columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.col("doc_id").cast("long").alias("doc_id"), pattern_spans(text).alias("_base"), spans_of(text, TOKEN).alias("_tokens")), "secrets")
    tested = stored(candidates(rows), "tokens")
    cut = cutoffs(tested, q)
    limit = F.element_at(F.array(*[F.lit(c) for c in cut]), _class(F.length("tok")) + 1)
    found = tested.where((F.least("p_chi", "p_runs", "p_serial") >= alpha) & (_step(F.col("p_natural")) >= limit))
    more = found.groupBy("_row").agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end")).alias("_more"))
    out = rows.join(more, "_row", "left").withColumn("_all", F.array_sort(F.concat("_base", F.coalesce("_more", F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)")))))
    count = lambda k: F.size(F.filter("_all", lambda s: s["rank"] == k)).cast("long")
    names = F.array(*[F.lit(k) for k in KINDS])
    said = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return out.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), count(3).alias("n_random"), F.sha2(said("_base"), 256).alias("base_sha256"), said("_all").alias("spans"))


def redacted(docs: DataFrame, q: float = 0.01, alpha: float = 1e-3) -> DataFrame:
    """``docs`` with each finding in ``text`` replaced by ``[SECRET]`` (overlapping findings by one); all rows and columns stay, ``n_chars`` follows where there is one.

    The cutoffs of :func:`cutoffs` come from a first pass over all rows; the second pass
    needs them only, so text is not shuffled.  Null text stays null; columns whose names
    the scan uses stay as they are.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.monotonically_increasing_id().alias("_row"), pattern_spans(text).alias("_base"), spans_of(text, TOKEN).alias("_tokens")).where(F.size("_tokens") > 0)
    first = stored(first, "secrets")
    tested = stored(candidates(first), "tokens")
    cut = cutoffs(tested, q)
    limit = F.element_at(F.array(*[F.lit(c) for c in cut]), _class(F.length("tok")) + 1)
    # What is found depends on the token alone, so distinct tokens are the whole verdict.
    found = tested.where((F.least("p_chi", "p_runs", "p_serial") >= alpha) & (_step(F.col("p_natural")) >= limit)).select("tok").distinct()
    return _replaced(docs, text, found)


def _replaced(docs: DataFrame, text: Column, found: DataFrame) -> DataFrame:
    names = docs.columns
    row, base, tokens, more, every = fresh(docs, "_row", "_base", "_tokens", "_more", "_all")
    rows = docs.withColumns({row: F.monotonically_increasing_id(), base: pattern_spans(text), tokens: spans_of(text, TOKEN)})
    rows = stored(rows, "redact")
    token = free_tokens(rows.select(F.col(row).alias("_row"), F.col(base).alias("_base"), F.col(tokens).alias("_tokens"))).withColumnRenamed("_row", row)
    hits = token.join(found, "tok", "left_semi").groupBy(row).agg(F.collect_list(F.struct("start", F.lit(3).alias("rank"), "end")).alias(more))
    none = F.lit(None).cast("array<struct<start:int,rank:int,end:int>>")
    # Only texts that hold a token can have more than pattern spans: the others are not shuffled.
    rows = rows.where(F.size(tokens) > 0).join(hits, row, "left").unionByName(rows.where(F.size(tokens) == 0).withColumn(more, none))
    spans = F.array_sort(F.concat(base, F.coalesce(more, F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))))

    def clean(blocks):
        def cut(a, b):
            first = F.floor(a / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.floor((b - 1) / BLOCK).cast("int") - first + 1), "")
            return F.when(a < b, F.substring(near, a - first * BLOCK + 1, b - a)).otherwise("")

        reach = running(F.transform(every, lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))
        pieces = F.zip_with(every, reach, lambda s, at: F.when(s["start"] < at, F.lit("")).otherwise(F.concat(cut(at, s["start"]), F.lit("[SECRET]"))))
        return F.concat(F.array_join(pieces, ""), cut(F.array_max(F.transform(every, lambda s: s["end"])), F.length(text)))

    # A text in blocks, so that a piece is not looked for from the text's start.
    clean = _let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), clean)
    rows = rows.withColumn(every, spans).withColumn("text", F.when(F.size(every) > 0, clean).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.when(F.size(every) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*[F.col(f"`{c}`") for c in names])
