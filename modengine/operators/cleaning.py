"""Text cleaners as chains of projections.

A step that tests its input and then changes it names the input several times.
Nested as one expression, nine such steps would multiply into thousands of
copies; as a chain of ``withColumn`` every step is computed once, and the chain
still runs as one generated stage without a shuffle.

A later filter on the clean text would undo that: Spark moves filters below
projections and puts the whole chain into them. So the chain ends in the
explode of a one-element array, which filters stay above and which drops and
adds no row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon, text
from ..sources.checkpoint import cut_lineage

Step = Callable[[Column], Column]


def through(df: DataFrame, col: str, out: str, steps: Sequence[Step]) -> DataFrame:
    """Apply the steps to ``col`` one after the other and store them in ``out``."""
    df = df.withColumn(out, F.col(col))
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    return computed_once(df, out)


def computed_once(df: DataFrame, col: str) -> DataFrame:
    """Keep later filters on ``col`` from repeating what computed it."""
    return df.withColumn(col, F.explode(F.array(col)))


def clean_basic(
    df: DataFrame, col: str = "text", out: str = "clean", words: Sequence[str] = tuple(lexicon.STOP_WORDS),
    exceptions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Lower, word characters only, squeeze, stop words out, lemmas."""
    return through(df, col, out, [
        text.text_or_empty, text.lower_text, partial(text.strip_punct, mode="basic"), text.squeeze_ws,
        partial(text.drop_and_lemmatize, words=words, exceptions=exceptions),
    ])


def clean_thorough(
    df: DataFrame, col: str = "text", out: str = "clean", words: Sequence[str] = tuple(lexicon.STOP_WORDS),
    exceptions: Mapping[str, str] | None = None,
) -> DataFrame:
    """Lower, fold to ASCII, strip markup, URLs, e-mails, handles, entities,
    punctuation and digits, shorten runs, squeeze, stop words out, lemmas."""
    return through(df, col, out, [text.text_or_empty, text.lower_text, text.thorough(words, exceptions)])


def clean_contractions(df: DataFrame, col: str = "text", out: str = "clean") -> DataFrame:
    """The cleaner that keeps digits and stop words and spells contractions out."""
    return through(df, col, out, [
        text.text_or_empty, text.lower_text, partial(text.strip_urls, mode="contractions"),
        partial(text.strip_emails, repl=""), partial(text.strip_html, repl=""),
        partial(text.strip_handles, repl=""), text.expand_contractions,
        partial(text.strip_punct, mode="contractions"), text.collapse_punct, text.squeeze_ws,
    ])


def distinct_words(df: DataFrame, col: str, word: str = "word") -> DataFrame:
    """The different words of word lists, folded before they are shuffled."""
    return df.select(F.explode(col).alias(word)).distinct()


def replace_words(
    df: DataFrame, key: str, col: str, table: DataFrame | Callable[[DataFrame], DataFrame], out: str = "clean",
    could: Step | None = None, salts: int = 16,
) -> DataFrame:
    """Replace words of squeezed texts by a table (word, lemma), which may be large,
    or by the table that a function makes of the corpus' different words.

    Each text's different words (only those that ``could`` change, where that is
    known from the word alone) are found in one pass and written; all that follows
    reads those. The corpus' different words meet the table once; only words that
    change go on. A text gets a map back, no larger than the text. The changes are
    written and repeated for each of ``salts`` numbers, drawn from the text's key, so
    that a word of nearly every text spreads over as many tasks; the join's sides
    are plain tables, which Spark may split further.
    """
    sent = text.tokens(F.col(col))
    if could is not None:
        sent = F.filter(sent, could)
    salt = F.pmod(F.xxhash64(key), F.lit(salts)).cast("int")
    held = cut_lineage(df.select(key, salt.alias("salt"), F.array_distinct(sent).alias("words")))
    words = held.select(key, "salt", F.explode("words").alias("word"))
    corpus = distinct_words(held, "words")
    made = table(corpus) if callable(table) else corpus.join(table.groupBy("word").agg(F.min("lemma").alias("lemma")), "word")
    changes = cut_lineage(made.filter("lemma <> word"))
    spread = changes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    found = words.join(spread, ["word", "salt"]).groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("word", "lemma"))).alias("_lemma")
    )
    lemma = lambda t: F.coalesce(F.col("_lemma")[t], t)
    looked_up = F.transform(text.tokens(F.col(col)), lemma if could is None else lambda t: F.when(could(t), lemma(t)).otherwise(t))
    replaced = F.when(F.col("_lemma").isNull(), F.col(col)).otherwise(F.array_join(looked_up, " "))
    return df.join(found, key, "left").withColumn(out, replaced).drop("_lemma")


def lemma_table(words: DataFrame, vocabulary: DataFrame, irregular: Mapping[str, str] | None = None,
                rules: Sequence[tuple[str, str]] = tuple(lexicon.DETACHMENTS)) -> DataFrame:
    """(word, lemma) for every word: an irregular form's lemma, else the longest of
    the word itself and what the suffix rules make of it that the vocabulary holds
    (of equals the first in order), else the word."""
    irregular = lexicon.LEMMA_IRREGULAR if irregular is None else irregular
    w = F.col("word")
    detached = [F.when(F.endswith(w, F.lit(s)) & (F.length(w) > len(s)), F.concat(F.expr(f"left(word, length(word) - {len(s)})"), F.lit(e))) for s, e in rules]
    candidates = words.select("word", F.explode(F.array_compact(F.array(w, *detached))).alias("candidate"))
    held = candidates.join(vocabulary.select(F.col("word").alias("candidate")).distinct(), "candidate")
    best = held.groupBy("word").agg(F.min(F.struct((-F.length("candidate")).alias("n"), "candidate"))["candidate"].alias("found"))
    ruled = words.select("word").distinct().join(best, "word", "left").withColumn("lemma", F.coalesce("found", "word"))
    if irregular:
        table = F.create_map(*[F.lit(x) for pair in irregular.items() for x in pair])
        ruled = ruled.withColumn("lemma", F.when(w.isin(*irregular), table[w]).otherwise(F.col("lemma")))
    return ruled.select("word", "lemma")


def detachable(irregular: Mapping[str, str], rules: Sequence[tuple[str, str]]) -> Step:
    """Whether a word may have another lemma: it has an ending of the rules, of
    which only those are tested that end in no other one, or is irregular."""
    endings = {s for s, _ in rules}
    tested = [F.lit(s) for s in sorted(endings) if not any(s != e and s.endswith(e) for e in endings)]
    return lambda t: reduce(Column.__or__, [F.endswith(t, s) for s in tested], t.isin(*irregular) if irregular else F.lit(False))


def lemmatize_by_vocabulary(
    df: DataFrame, key: str, col: str, vocabulary: DataFrame, out: str = "clean", irregular: Mapping[str, str] | None = None,
    rules: Sequence[tuple[str, str]] = tuple(lexicon.DETACHMENTS), salts: int = 16,
) -> DataFrame:
    """Lemmatize squeezed texts with a vocabulary of lemmas (a table with ``word``):
    suffixes are detached, and the longest result that is a word wins. Candidates
    are made of the corpus' different words, not of its texts."""
    irregular = lexicon.LEMMA_IRREGULAR if irregular is None else irregular
    return replace_words(df, key, col, lambda words: lemma_table(words, vocabulary, irregular, rules), out, detachable(irregular, rules), salts)


def lemmatize_with_table(df: DataFrame, key: str, col: str, lemmas: DataFrame, out: str = "clean") -> DataFrame:
    """Lemmatize squeezed texts by a table (word, lemma) too large for a literal."""
    return replace_words(df, key, col, lemmas, out)
