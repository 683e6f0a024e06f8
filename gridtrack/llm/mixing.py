"""Mixing sources to target weights: budgets down a domain-language-source tree, then token-prefixes of seeded epochs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKETS = 1024
LEVELS = ("domain", "lang", "source")
#: A place this close under a whole one counts as it; the sums of budgets are off by less.
SLACK = 1 / 16

#: Target weights of the production query: a node not listed has weight 1 among its siblings.
WEIGHTS = {("domain", "web"): 0.5, ("domain", "books"): 0.3, ("domain", "code"): 0.2, ("lang", "en"): 0.55, ("lang", "fr"): 0.15, ("lang", "de"): 0.15, ("lang", "es"): 0.15}
DOMAINS = ("web", "books", "code", "web")


def domain_of(source: Column) -> Column:
    """The domain of a source by its number (0 where it has none), round DOMAINS."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("long"), F.lit(0))
    return F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), (F.pmod(number, F.lit(len(DOMAINS))) + 1).cast("int"))


def n_tokens(text: Column) -> Column:
    """Words of a text (stretches without blank space); 0 for null."""
    bare = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(F.length(bare) > 0, F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).otherwise(0).cast("long")


def _named(column: str) -> Column:
    name = F.col(column).cast("string")
    return F.when(name.startswith("?"), F.concat(F.lit("?"), name)).otherwise(F.coalesce(name, F.lit("?")))


def _weight(level: str, weights: dict[tuple[str, str], float]) -> Column:
    out = F.lit(1.0)
    for (at, name), w in weights.items():
        if at == level:
            out = F.when(F.col(level) == name, F.lit(float(w))).otherwise(out)
    return out


def filled(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to siblings with weight, capacity and parent_budget: the parent's budget by weight, and what a sibling cannot hold goes to the others by weight, until it is used up or all are full.

    In closed form: in order of capacity per weight, a sibling is full if its share of what
    the fuller ones leave would be over its capacity.
    """
    by = Window.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), *[F.col(c) for c in LEVELS if c in nodes.columns])
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    after = by.rowsBetween(0, Window.unboundedFollowing)
    x = nodes.withColumns({"_full": F.coalesce(F.sum("capacity").over(before), F.lit(0)), "_rest": F.sum("weight").over(after)})
    x = x.withColumn("_level", (F.col("parent_budget") - F.col("_full")) / F.col("_rest"))
    x = x.withColumn("_level", F.when(F.col("_level") < F.col("capacity") / F.col("weight"), F.col("_level")))
    # The first sibling that is not full sets the level of all after it.
    level = F.first("_level", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    x = x.withColumn("_set", level)
    budget = F.when(F.col("_set").isNull(), F.col("capacity").cast("double")).otherwise(F.greatest(F.col("_set"), F.lit(0.0)) * F.col("weight"))
    return x.withColumn("budget", F.least(budget, F.col("capacity").cast("double"))).drop("_full", "_rest", "_level", "_set")


def budgets(leaves: DataFrame, total: float, weights: dict[tuple[str, str], float] = WEIGHTS, epochs: int = 4) -> DataFrame:
    """(domain, lang, source, tokens, budget): how many tokens each leaf gives, at most ``epochs`` times its own.

    Weights are propagated from the root; a node that cannot use its share leaves the rest
    to its siblings, and only what they all cannot hold rises to the parent's siblings,
    since a node's capacity is the sum of its leaves'.  Whole tokens: the tree's leaves in order
    divide a line of the total's length, and what lies between two whole places is a leaf's, so no
    node is off by a token and none is lost.
    """
    leaf = leaves.select(*LEVELS, "tokens", (F.col("tokens") * epochs).alias("capacity")).where("tokens > 0")
    lang = leaf.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"))
    top = lang.groupBy("domain").agg(F.sum("capacity").alias("capacity"))
    top = filled(top.withColumns({"weight": _weight("domain", weights), "parent_budget": F.lit(float(total)), "parent_at": F.lit(0.0), "_root": F.lit(0)}), ["_root"])
    own = [F.col("budget").alias("parent_budget"), F.col("at").alias("parent_at")]
    lang = filled(lang.withColumn("weight", _weight("lang", weights)).join(_placed(top, ["_root"]).select("domain", *own), "domain"), ["domain"])
    lang = _placed(lang, ["domain"]).select("domain", "lang", *own)
    leaf = filled(leaf.withColumn("weight", _weight("source", weights)).join(lang, ["domain", "lang"]), ["domain", "lang"])
    whole = lambda x: F.floor(x + SLACK)
    leaf = _placed(leaf, ["domain", "lang"]).withColumn("budget", F.least(whole(F.col("at") + F.col("budget")) - whole(F.col("at")), F.col("capacity")))
    return leaf.select(*LEVELS, "tokens", "budget")


def _placed(nodes: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``at``: where a node begins on the line of its parent, after its earlier siblings."""
    earlier = Window.partitionBy(*parent).orderBy(*[F.col(c) for c in LEVELS if c in nodes.columns]).rowsBetween(Window.unboundedPreceding, -1)
    return nodes.withColumn("at", F.col("parent_at") + F.coalesce(F.sum("budget").over(earlier), F.lit(0.0)))


def mixed(docs: DataFrame, share: float = 0.5, weights: dict[tuple[str, str], float] = WEIGHTS, epochs: int = 4, seed: int = 17, buckets: int = BUCKETS, domain: Column | None = None) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens, take_tokens): the mixture of ``share`` of all tokens.

    A leaf's order in epoch e is by a hash of seed, e and document; its epochs follow one
    another and the prefix of its budget's length is taken, so ``take_tokens`` is short of
    ``n_tokens`` for the last document of a leaf only.  Null lang or source is a leaf of
    its own, named ``?``; a name that begins so has one more.  A document without tokens is never taken.  Repeated rows are
    documents of their own.  Weights must be positive.

    A leaf of any size is ordered in ``buckets`` hash ranges: token sums by range place each
    range in the prefix, and only within a range are rows sorted.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    source, lang = _named("source"), _named("lang")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (domain_of(source) if domain is None else domain).alias("domain"), lang.alias("lang"), source.alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64(F.col("text").cast("string")).alias("h"))
    rows = stored(rows.where("n_tokens > 0"), "mix")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = budgets(leaves, total * share, weights, epochs).where("budget > 0")
    # Whole epochs are taken entire; the epoch in which the budget ends, up to it.
    part = plan.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("budget") - 1) / F.col("tokens")).cast("int"))))
    part = part.withColumn("left", F.least(F.col("budget") - F.col("epoch") * F.col("tokens"), F.col("tokens")))
    part = stored(part.select(*LEVELS, "epoch", "left", (F.col("left") == F.col("tokens")).alias("entire")), "plan")
    dealt = rows.join(part, list(LEVELS))
    cut = dealt.where("NOT entire").withColumn("k", F.xxhash64(F.lit(seed), "epoch", "doc_id", "h"))
    cut = cut.withColumn("bucket", F.floor((F.shiftright("k", 32) + F.lit(1 << 31)) / F.lit((1 << 32) // buckets)).cast("int"))
    leaf = [*LEVELS, "epoch"]
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("t")).withColumn("base", F.coalesce(F.sum("t").over(before), F.lit(0))).drop("t")
    cut = cut.join(sums, [*leaf, "bucket"]).where(F.col("base") < F.col("left"))
    inside = Window.partitionBy(*leaf, "bucket").orderBy("k", "doc_id", "h").rowsBetween(Window.unboundedPreceding, -1)
    cut = cut.withColumn("at", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where(F.col("at") < F.col("left"))
    out = ["doc_id", *leaf, "n_tokens"]
    return cut.select(*out, F.least("n_tokens", F.col("left") - F.col("at")).alias("take_tokens")).unionByName(dealt.where("entire").select(*out, F.col("n_tokens").alias("take_tokens")))


