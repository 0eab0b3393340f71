"""Mixing sources to target weights over a domain-language-source tree.

Weights propagate down the tree: a node's budget is divided among its children
by weight, and no child gets more than all it can give (``max_epochs`` times its
tokens). What a child cannot use goes to its siblings by their weights; only what a
whole family cannot use leaves it, because its parent already counts no more
than the family can give. The division is the water level of the family, found
by one window over the children in the order in which they run full.

Every leaf then takes a prefix of its epochs. Epoch e orders its documents by a
hash of (seed, e, document); whole epochs are taken as they are, and of the last
one the documents until the budget is reached. The order is cut into buckets by
the hash: those before the cut are taken whole, those behind it not at all, and
only the bucket with the cut is ordered, so no window spans a leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as Wd, functions as F

from .common import free_names, written

LEVELS = ("domain", "lang", "source")


def token_count(text: Column) -> Column:
    """Whitespace-separated words plus an end token; a null text has one."""
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda w: w != ""))
    return (words + 1).cast("long")


def _divide(children: DataFrame, family: list[str], budget: str, out: str) -> DataFrame:
    """Budgets of children with ``w`` and ``cap``: min(cap, level * w), the level
    such that they sum to the family's budget or every child is full."""
    of = Wd.partitionBy(*family)
    order = of.orderBy("full_at", "node").rowsBetween(Wd.unboundedPreceding, -1)
    run = children.withColumn("full_at", F.col("cap") / F.col("w"))
    run = run.withColumns({
        "cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0)).cast("double"),
        "w_left": F.sum("w").over(of) - F.coalesce(F.sum("w").over(order), F.lit(0)),
    })
    # Were this child and all later ones not full, the level would be:
    level = (F.col(budget) - F.col("cap_before")) / F.col("w_left")
    run = run.withColumn("open", level < F.col("full_at"))
    found = F.min(F.when(F.col("open"), F.struct("full_at", "node", level.alias("level")))).over(of)
    run = run.withColumn("level", found["level"])
    share = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("level") * F.col("w"))))
    return run.withColumn(out, F.greatest(share, F.lit(0)).cast("long"))


def budgets(leaves: DataFrame, total: int, max_epochs: int, power: float) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens).
    A node's weight is its share of the tokens raised to ``power``: 1 keeps the
    shares, 0 makes siblings equal."""
    cap = leaves.withColumn("cap", F.col("tokens") * max_epochs)

    def up(by: list[str]) -> DataFrame:
        node = cap.groupBy(*by).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("sum"))
        return node.withColumns({"w": F.pow(F.col("sum").cast("double"), F.lit(power)), "node": F.col(by[-1])})

    tops = _divide(up(["domain"]).withColumn("b0", F.lit(total).cast("double")), [], "b0", "b1").select("domain", "b1")
    langs = _divide(up(["domain", "lang"]).join(tops, "domain"), ["domain"], "b1", "b2").select("domain", "lang", "b2")
    ends = _divide(up(["domain", "lang", "source"]).join(langs, ["domain", "lang"]), ["domain", "lang"], "b2", "budget")
    return ends.select("domain", "lang", "source", F.col("sum").alias("tokens"), "budget")


def mix(
    docs: DataFrame, domain: Column, total: int | None = None, max_epochs: int = 2, power: float = 0.7, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", bucket: int = 20_000,
) -> DataFrame:
    """One row per document and epoch it is taken in: id, text hash ``th``, domain,
    lang, source, ``epoch`` (from 0), ``n_tokens``.

    ``total``: tokens to take; by default as many as there are. A leaf takes
    documents while the tokens before them are below its budget, so it ends at
    most one document above it. Null ids, languages, sources and domains count as
    '' ; a null text has one token. Rows that repeat id and text stay rows of
    their own, each with its tokens. An empty table gives no rows.
    """
    level = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    rows = written(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), level(domain).alias("domain"), level(F.col(lang_col)).alias("lang"),
        level(F.col(source_col)).alias("source"), token_count(F.col(text_col)).alias("n_tokens"),
    ))
    by = list(LEVELS)
    leaves = written(rows.groupBy(*by).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows")))
    if total is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
    given = budgets(leaves.drop("rows"), total, max_epochs, power).join(leaves.select(*by, "rows"), by)
    # Tokens above zero in every leaf: a document has its end token.
    given = written(given.withColumns({"whole": F.floor(F.col("budget") / F.col("tokens")), "rest": F.col("budget") % F.col("tokens")}))
    joined = rows.join(given, by)
    full = joined.filter("whole > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("whole").cast("int") - 1)))
    keep = ["id", "th", *by, "epoch", "n_tokens"]

    # The epoch that ends inside: buckets of its hashed order.
    last = joined.filter("rest > 0").withColumn("epoch", F.col("whole").cast("int"))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    at = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    last = last.withColumns({"h": digest, "b": F.floor(at * F.ceil(F.col("rows") / bucket))})
    sums = last.groupBy(*by, "b").agg(F.sum("n_tokens").alias("t"))
    before = Wd.partitionBy(*by).orderBy("b").rowsBetween(Wd.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("t").over(before), F.lit(0)))
    placed = last.join(starts, [*by, "b"]).filter("before < rest")
    inside = placed.filter("before + t <= rest")
    cut = placed.filter("before + t > rest")
    run = Wd.partitionBy(*by, "b").orderBy("h", "id", "th").rowsBetween(Wd.unboundedPreceding, -1)
    taken = cut.withColumn("ahead", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0))).filter("ahead < rest")
    return full.select(*keep).unionByName(inside.select(*keep)).unionByName(taken.select(*keep))


def mixed_documents(docs: DataFrame, domain: Column, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that ``mix`` takes, as often as it takes them, with all
    their columns. Of rows that repeat id and text one stands for all, as often as
    any of them is taken."""
    taken = mix(docs, domain, id_col=id_col, text_col=text_col, **options)
    key, n, many = free_names(docs, ["mix_hash", "mix_times", "mix_many"])
    # Written, so that the plan that moves the texts does not hold the whole division.
    times = written(taken.groupBy("id", "th").agg(F.count("*").cast("int").alias(n)).withColumnsRenamed({"id": "_mid", "th": "_mth"}))
    keyed = docs.withColumn(key, F.xxhash64(text_col))
    again = keyed.groupBy(F.col(id_col).alias("_aid"), F.col(key).alias("_ath")).agg(F.count("*").alias("_c")).filter("_c > 1")
    again = written(again.select("_aid", "_ath", F.lit(True).alias(many)))
    joined = keyed.join(times, keyed[id_col].eqNullSafe(times["_mid"]) & (keyed[key] == times["_mth"]))
    joined = joined.join(again, joined[id_col].eqNullSafe(again["_aid"]) & (joined[key] == again["_ath"]), "left")
    one = joined.filter(F.col(many)).dropDuplicates([id_col, key])
    rows = joined.filter(F.col(many).isNull()).unionByName(one)
    return rows.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
