"""How filters of a cascade interact: every order of them, step by step.

Each document gets a mask with one bit per filter it fails, counted inside its
row; only "same text as a document with a smaller id" needs a shuffle, of digests.
Documents then fold to mask cells: counts per (part, mask), at most 2^filters rows
a part. From there on the size of the corpus does not matter.

A recursive query enumerates the orders. It starts at the empty prefix; every
level joins the cells of the part and extends each prefix by every letter not yet
applied, carries the bits applied so far, and emits the metrics of that step.
Orders share prefixes, so 5 filters take 325 prefixes, not 600 steps.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import factorial

from pyspark.sql import Column, DataFrame, functions as F

from .common import written

COUNTS = ("n", "good", "toxic")


def text_failures(
    text: Column, min_words: int = 200, distinct_share: int = 50, upper_share: int = 3, symbols: str = "[#$%&*|]",
) -> list[Column]:
    """Whether a text is too short, repeats its words, shouts, or holds a symbol.
    A null text counts as empty. Words are runs without ASCII white space."""
    whole = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(whole, r"[ \t-\r]+"), lambda w: w != "")
    upper = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return [
        F.size(words) < min_words, F.size(F.array_distinct(words)) * 100 < F.size(words) * distinct_share,
        upper * 100 > F.length(whole) * upper_share, whole.rlike(symbols),
    ]


def masks(docs: DataFrame, failures: Sequence[Column], id_col: str, text_col: str, part_col: str) -> DataFrame:
    """(id, part, mask) per row: bit i for failures[i], the next bit for a text that
    a row with a smaller id holds as well. A null id is no smaller than any and
    larger than all; rows that repeat an id are no copies of each other."""
    whole = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(failures)), F.lit(0))
    rows = written(docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), bits.alias("bits"),
        F.sha2(whole, 256).alias("body"),
    ))
    # The texts of several rows, folded before they are shuffled; written, so that
    # Spark may split the join where a third of all rows hold one text.
    first = written(rows.groupBy("body").agg(F.min("id").alias("least"), F.count("*").alias("n")).filter("n > 1").select("body", "least"))
    joined = rows.join(first, "body", "left")
    copy = F.coalesce(F.col("least") < F.col("id"), F.col("least").isNotNull() & F.col("id").isNull())
    return joined.select("id", "part", (F.col("bits") + F.when(copy, 1 << len(failures)).otherwise(0)).cast("int").alias("mask"))


def cells(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id", good: str = "quality", toxic: str = "toxic") -> DataFrame:
    """(part, cells): per part its mask cells (mask, n, good, toxic). Of judgements
    that repeat an id, one that says 1 counts."""
    told = labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("told")).agg(
        F.max((F.col(good) == 1).cast("long")).alias("good"), F.max((F.col(toxic) == 1).cast("long")).alias("toxic"))
    seen = masked.join(told, F.col("id") == F.col("told"), "left")
    folded = seen.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("good", "toxic")])
    return folded.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("mask", *COUNTS))).alias("cells"))


def _sum(of: str, where: str) -> str:
    return f"aggregate(t.cells, 0L, (a, c) -> a + if({where}, c.{of}, 0L))"


def prefixes(folded: DataFrame, letters: str) -> DataFrame:
    """The recursive query over the prefixes of the orders: (part, prefix, step,
    letter, applied, and the metrics of the prefix's last step)."""
    spark = folded.sparkSession
    filters = ", ".join(f"named_struct('letter', '{c}', 'bit', {1 << i})" for i, c in enumerate(letters))
    here = "c.mask & s.applied = 0 AND c.mask & f.bit <> 0"
    metrics = {
        "kept": _sum("n", "c.mask & (s.applied | f.bit) = 0"), "removed": _sum("n", here),
        "redundant": _sum("n", "c.mask & s.applied <> 0 AND c.mask & f.bit <> 0"), "unique_fails": _sum("n", "c.mask = f.bit"),
        "good_lost": _sum("good", here), "toxic_lost": _sum("toxic", here),
    }
    query = f"""
    WITH RECURSIVE steps(part, prefix, step, letter, applied, {", ".join(metrics)}) MAX RECURSION LEVEL {len(letters) + 1} AS (
        SELECT part, '', 0, '', 0, {", ".join(["0L"] * len(metrics))} FROM {{cells}}
        UNION ALL
        SELECT s.part, concat(s.prefix, f.letter), s.step + 1, f.letter, s.applied | f.bit, {", ".join(metrics.values())}
        FROM steps s JOIN {{cells}} t ON s.part = t.part
        LATERAL VIEW inline(filter(array({filters}), x -> s.applied & x.bit = 0)) f
    )
    SELECT * FROM steps WHERE step > 0
    """
    # Spark stops a recursion that makes more rows than its limit; here their number is known.
    n, k, limit = folded.count(), len(letters), "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    rows = n * sum(factorial(k) // factorial(k - i) for i in range(k + 1))
    try:
        if 0 <= int(before) <= rows:
            spark.conf.set(limit, str(rows + 1))
        return written(spark.sql(query, cells=folded))
    finally:
        spark.conf.set(limit, before)


def audit(
    docs: DataFrame, labels: DataFrame, failures: Sequence[Column] | None = None, id_col: str = "doc_id", text_col: str = "text",
    part_col: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step: ``part``, ``filter_order``,
    ``step`` (from 1), ``kept`` after the step, ``removed`` by it, ``redundant`` (fail
    its filter, removed earlier), ``unique_fails`` (fail no other filter),
    ``good_lost`` and ``toxic_lost`` among the removed, and ``shapley``: what the
    filter removes, summed over all orders.

    Filters are the letters from A: ``failures`` and, last, the copies of a text.
    Null texts count as empty, and empty texts are copies of each other; null
    parts count as ''. A null id is larger than any other. Rows that repeat an id
    count each, but are no copies of each other. Labels of unknown ids count
    nothing. Other columns are not read. An empty table gives no rows.
    """
    failures = text_failures(F.col(text_col)) if failures is None else list(failures)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[:len(failures) + 1]
    k = len(letters)
    folded = written(cells(masks(docs, failures, id_col, text_col, part_col), labels, id_col))
    found = prefixes(folded, letters)
    # A prefix of i letters begins (k - i)! orders.
    orders = F.element_at(F.array(*[F.lit(factorial(k - i)) for i in range(1, k + 1)]), F.col("step"))
    shapley = found.groupBy("part", "letter").agg(F.sum(F.col("removed") * orders).cast("long").alias("shapley"))
    whole = found.filter(F.col("step") == k).select("part", F.col("prefix").alias("filter_order"), F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    whole = whole.withColumns({"prefix": F.expr("left(filter_order, step)"), "letter": F.expr("substr(filter_order, step, 1)")})
    metrics = found.drop("step", "letter", "applied")
    return whole.join(metrics, ["part", "prefix"]).join(shapley, ["part", "letter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley",
    )
