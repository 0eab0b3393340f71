"""Quality rules whose cutoffs come from quantile sketches per language and source.

A first pass counts per document, inside its row: no text is shuffled. Each
measure then goes into a sketch per (language, source): counts per bin, where a
bin keeps the six leading binary digits of the measure, so a quantile is read
with an error below 1/32. Sketches merge by adding counts; the merges give the
sketches of a language and of all documents, which stand in for sources with few
documents. Fences four box heights beyond the quartiles replace fixed cutoffs, and
a join on (language, source) filters. No cutoff is a constant: where the
quartiles coincide, the box is taken to be as high as a few events (symbols,
letters, repeated lines or words) weigh in the group's median document, which
comes from a sketch as well. Counts are combined before they are
shuffled, so a source with a third of all rows costs what any other costs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as Wd, functions as F

from .common import once, same, written

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5


@dataclass(frozen=True)
class Measure:
    """A whole number per document, how much a few events weigh in it, and whether
    there is a lower fence as well."""

    name: str
    value: str  # SQL over the counts; whole numbers only
    unit: str
    both: bool = False


MEASURES = [
    Measure("word_length", "100 * word_chars div n_words", "400 div n_words", True),  # hundredths of a character; four letters
    Measure("symbols", "1000 * n_symbols div word_chars", "4000 div word_chars"),  # per thousand characters; four symbols
    Measure("dup_lines", "1000 * n_dup_lines div n_lines", "1000 div n_lines"),  # per thousand lines; one line
    Measure("repeat_words", "1000 * n_repeat_words div n_words", "10000 div n_words"),  # per thousand words; two windows
]


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines and
    n_repeat_words of the whole text (null: no words).

    Words are runs without ASCII white space. n_repeat_words counts the words
    inside windows of five words that occur twice or more in the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    filled = lambda a: F.filter(a, lambda x: x != "")
    one = once(
        docs.drop("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"),
        _ws=filled(F.split(text, "[ \\t-\\r]+")),
        _lines=F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        _solid=F.translate(text, SPACE, ""),
    )
    n = F.size("_ws")
    windows = F.transform(
        F.sequence(F.lit(1), n - WINDOW + 1), lambda i: F.xxhash64(F.slice("_ws", i, F.lit(WINDOW))),
    )
    two = once(one, _grams=F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # Only texts in which a window occurs again are sorted by (window, place).
    again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    pairs = F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = once(two, _pairs=F.when(again, pairs))
    alike = lambda x, k: F.coalesce(x["h"] == F.get("_pairs", k)["h"], F.lit(False))
    found = F.filter("_pairs", lambda x, k: alike(x, k - 1) | alike(x, k + 1))
    four = once(three, _starts=F.array_sort(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("_starts", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - s, F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    kept = [c for c in docs.columns if c.lower() not in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")]
    return four.select(
        *kept, n.cast("long").alias("n_words"), F.length("_solid").cast("long").alias("word_chars"),
        (F.length("_solid") - F.length(F.translate("_solid", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def bin_of(value: Column) -> Column:
    """The value with all but its six leading binary digits cleared."""
    low = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def fences(measured: DataFrame, measures: list[Measure], min_docs: int = 100, reach: int = 4) -> DataFrame:
    """One row per (lang, source): ``low_<measure>`` and ``high_<measure>``, from the
    documents that do not fail the base rule. Groups of fewer than ``min_docs``
    such documents take the sketch of their language, and languages of fewer the
    sketch of all."""
    kinds = [n for m in measures for n in (m.name, f"{m.name}_unit")]
    entries = F.array(*[F.struct(F.lit(n).alias("measure"), bin_of(F.col(n)).alias("bin")) for n in kinds])
    sketch = measured.filter(~F.col("base_failed")).select("lang", "source", F.inline(entries)).groupBy("lang", "source", "measure", "bin").agg(F.count("*").alias("n"))
    sketch = written(sketch)
    groups = measured.select("lang", "source").distinct()

    def quartiles(merged: DataFrame, by: list[str]) -> DataFrame:
        of = Wd.partitionBy(*by, "measure")
        run = merged.withColumns({"c": F.sum("n").over(of.orderBy("bin")), "t": F.sum("n").over(of)})
        return run.groupBy(*by, "measure").agg(
            F.max("t").alias("t"), F.min(F.when(F.col("c") * 4 >= F.col("t"), F.col("bin"))).alias("q1"),
            F.min(F.when(F.col("c") * 2 >= F.col("t"), F.col("bin"))).alias("q2"),
            F.min(F.when(F.col("c") * 4 >= F.col("t") * 3, F.col("bin"))).alias("q3"),
        )

    def level(by: list[str], tag: str) -> DataFrame:
        merged = sketch.groupBy(*by, "measure", "bin").agg(F.sum("n").alias("n"))
        return quartiles(merged, by).select(*[F.col(c).alias(f"{tag}_{c}") for c in by], F.col("measure").alias(f"{tag}_m"), F.struct("t", "q1", "q2", "q3").alias(tag))

    leaf, lang, whole = level(["lang", "source"], "leaf"), level(["lang"], "lng"), level([], "all")
    names = F.explode(F.array(*[F.lit(n) for n in kinds]))
    rows = groups.select("lang", "source", names.alias("measure"))
    rows = rows.join(leaf, same(rows["lang"], leaf["leaf_lang"]) & same(rows["source"], leaf["leaf_source"]) & (rows["measure"] == leaf["leaf_m"]), "left")
    rows = rows.join(lang, same(rows["lang"], lang["lng_lang"]) & (rows["measure"] == lang["lng_m"]), "left")
    rows = rows.join(whole, rows["measure"] == whole["all_m"], "left")
    q = F.when(F.col("leaf.t") >= min_docs, F.col("leaf")).when(F.col("lng.t") >= min_docs, F.col("lng")).otherwise(F.col("all"))
    rows = rows.select("lang", "source", "measure", q.alias("q"))
    of = lambda m, f: F.max(F.when(F.col("measure") == m, F.col(f"q.{f}")))
    out = []
    for m in measures:
        q1, q3 = of(m.name, "q1"), of(m.name, "q3")
        box = F.greatest(q3 - q1, of(f"{m.name}_unit", "q2"), F.lit(1))
        out.append((q3 + reach * box).alias(f"high_{m.name}"))
        if m.both:
            out.append((q1 - reach * box).alias(f"low_{m.name}"))
    return rows.groupBy("lang", "source").agg(*out)


def apply_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    measures: list[Measure] = MEASURES, min_docs: int = 100, reach: int = 4, min_words: int = 10, repeat_share: int = 20,
) -> DataFrame:
    """One row per document: the id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, ``base_failed`` (fewer than ``min_words`` words, or more than
    ``repeat_share`` percent of them in repeated windows), ``kept`` and ``failed``,
    the comma-joined names of the measures outside their fences.

    The quantiles are those of the documents that pass the base rule. A null
    text has no words and fails. Null languages and sources form groups of their
    own; repeated rows count each; an empty table gives no rows.
    """
    plain = docs.select(
        F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        F.col(text_col).alias("text"),
    )
    rows = written(counts(plain).drop("text"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_share * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed)
    sql = {n: e for m in measures for n, e in ((m.name, m.value), (f"{m.name}_unit", m.unit))}
    measured = rows.withColumns({n: F.when(F.col("n_words") > 0, F.expr(f"cast({e} as bigint)")) for n, e in sql.items()})
    limits = fences(measured, measures, min_docs, reach)
    limits = limits.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})
    joined = measured.join(limits, same(F.col("lang"), F.col("of_lang")) & same(F.col("source"), F.col("of_source")), "left")
    outside = []
    for m in measures:
        bad = F.col(m.name) > F.col(f"high_{m.name}")
        if m.both:
            bad = bad | (F.col(m.name) < F.col(f"low_{m.name}"))
        outside.append(F.when(bad, F.lit(m.name)))
    broken = F.concat_ws(",", *outside)
    return joined.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (broken == "")).alias("kept"), broken.alias("failed"),
    )
