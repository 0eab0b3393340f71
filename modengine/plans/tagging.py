"""Queries of tags, filters and corpus statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon, text as tx
from ..operators import cleaning, tagging
from ..operators.metrics import apply_thresholds
from ..sources.comments import attach_labels as attach
from . import inputs as inp
from .inputs import BASE, COMMENTS, LABELLED, LABELS, THRESHOLDS, comments, labelled, q, scores
from .registry import query
from .text import S, W, sql_basic, sql_n_tokens, sql_thorough

_ANY = lambda words: "(" + " OR ".join(f"contains(lower(text), {q(w)})" for w in words) + ")"
_WORD = f"regexp_matches(lower(text), {q(f'(^|[^{W}])({chr(124).join(lexicon.IDENTITY_TERMS)})([^{W}]|$)')})"


def sql_weak(t: str = "lower(text)") -> dict[str, str]:
    hit = lambda words: "(" + " OR ".join(f"contains({t}, {q(w)})" for w in words) + ")"
    insult, death, obscene = hit(lexicon.INSULT_WORDS), hit(lexicon.DEATH_WORDS), hit(lexicon.OBSCENE_WORDS)
    threat = f"({hit(['kill'])} OR ({hit(['find'])} AND {hit(['you'])}))"
    hate = f"({hit(['[group]'])} AND {hit(lexicon.GROUP_WORDS)})"
    rules = {
        "toxic": " OR ".join([insult, death, obscene, threat, hate]), "severe_toxic": f"{death} OR {threat}",
        "obscene": obscene, "threat": threat, "insult": insult, "identity_hate": hate,
    }
    return {label: f"({rules[label]})::INT" for label in LABELS}


@query("has_identity", f"WITH {COMMENTS} SELECT doc_id, {_ANY(lexicon.IDENTITY_TERMS)}::INT AS has_identity FROM comments")
def has_identity(spark, d):
    return tagging.with_identity(comments(spark, d)).select("doc_id", "has_identity")


@query("has_identity_word", f"WITH {COMMENTS} SELECT doc_id, {_WORD}::INT AS has_identity FROM comments")
def has_identity_word(spark, d):
    return tagging.with_identity(comments(spark, d), mode="word").select("doc_id", "has_identity")


@query(
    "identity_matches",
    f"WITH {COMMENTS}, terms AS (SELECT unnest([{inp.sql_list(lexicon.IDENTITY_TERMS)}]) AS term) "
    "SELECT doc_id, term FROM comments JOIN terms ON contains(lower(text), term)",
)
def identity_matches(spark, d):
    return tagging.identity_matches(comments(spark, d)).select("doc_id", "term")


@query(
    "min_tokens",
    f"WITH {COMMENTS}, c AS (SELECT doc_id, {sql_thorough()} AS clean FROM comments) "
    f"SELECT doc_id, {sql_n_tokens('clean')} AS n FROM c WHERE {sql_n_tokens('clean')} > 4",
)
def min_tokens(spark, d):
    clean = cleaning.clean_thorough(comments(spark, d))
    return tagging.min_tokens(clean, 5).select("doc_id", tx.n_tokens(F.col("clean")).alias("n"))


_DIGITS_ONLY = "regexp_replace(text, '[^0-9]+', ' ', 'g')"


@query("drop_empty", f"WITH t AS (SELECT doc_id, {_DIGITS_ONLY} AS clean FROM documents) "
                     "SELECT doc_id, clean FROM t WHERE length(trim(clean)) > 0")
def drop_empty(spark, d):
    digits = inp.table(spark, d, "documents").withColumn("clean", F.regexp_replace("text", "[^0-9]+", " "))
    return tagging.drop_empty(digits).select("doc_id", "clean")


@query("emptiness_report", f"WITH t AS (SELECT trim({_DIGITS_ONLY}) AS c FROM documents) SELECT count(*) AS n_rows, "
                           "count(*) FILTER (c <> '') AS n_kept, count(*) FILTER (c = '') AS n_removed FROM t")
def emptiness_report(spark, d):
    digits = inp.table(spark, d, "documents").withColumn("clean", F.regexp_replace("text", "[^0-9]+", " "))
    return tagging.emptiness_report(digits)


@query("attach_labels", "SELECT d.doc_id, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic "
                        "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def attach_labels(spark, d):
    docs = inp.table(spark, d, "documents").select("doc_id")
    return attach(docs, inp.table(spark, d, "labels"), "doc_id", ["quality", "toxic"])


@query("judged_only", f"WITH {COMMENTS}, {LABELLED}, l AS (" + " UNION ALL ".join(
    f"SELECT doc_id, {q(l)} AS label, {l} AS y FROM labelled" for l in LABELS
) + ") SELECT * FROM l WHERE y >= 0")
def judged_only(spark, d):
    return tagging.judged(tagging.to_long(labelled(spark, d, text=False), ["doc_id"]))


def _predict(name: str, op: str, thresholds: dict[str, float]) -> None:
    cases = " ".join(f"WHEN {q(l)} THEN {t}::DOUBLE" for l, t in thresholds.items())
    sql = f"WITH {BASE} SELECT id, model, label, y, p, (p {op} CASE label {cases} END)::INT AS pred FROM scores"

    @query(name, sql)
    def run(spark, d):
        predicted = apply_thresholds(scores(spark, d), thresholds, op)
        return predicted.select("id", "model", "label", "y", "p", "pred")


_predict("predict_gt", ">", {label: 0.4 for label in LABELS})
_predict("predict_ge", ">=", {label: 0.4 for label in LABELS})
_predict("predict_default", ">", lexicon.DEFAULT_THRESHOLDS)


@query("weak_labels", f"WITH {COMMENTS} SELECT doc_id, " + ", ".join(f"{e} AS {l}" for l, e in sql_weak().items())
       + " FROM comments")
def weak_labels(spark, d):
    return tagging.weak_labels(comments(spark, d)).select("doc_id", *LABELS)


_FLAGS = {
    "leet": r"[A-Za-z][0-9@$!|*]+[A-Za-z]|(^|[^A-Za-z0-9])[0-9@$]+[A-Za-z]{2}",
    "spaced": rf"(^|[{S}])([^{S}][{S}]{{1,3}}){{3,}}[^{S}]([{S}]|$)",
    "zero_width": r"[\x{200b}-\x{200d}\x{2060}\x{feff}]",
    "mixed_script": r"\p{Latin}[\p{Cyrillic}\p{Greek}]|[\p{Cyrillic}\p{Greek}]\p{Latin}",
    "mid_case": r"\p{Ll}\p{Lu}",
    "joined": r"[A-Za-z0-9][_.*#@$%][A-Za-z0-9][_.*#@$%][A-Za-z0-9]",
    "repeated": "|".join(chr(c) + "{3}" for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xDF, 0xF7), *range(0xF8, 0x100)]),
}


@query("obfuscation_flags", f"WITH {COMMENTS}, f AS (SELECT doc_id, "
       + ", ".join(f"regexp_matches(text, {q(p)})::INT AS {n}" for n, p in _FLAGS.items())
       + f" FROM comments) SELECT *, greatest({', '.join(_FLAGS)}) AS is_obfuscated FROM f")
def obfuscation_flags(spark, d):
    return tagging.obfuscation_flags(comments(spark, d)).drop("text")


@query("label_distribution", f"WITH {COMMENTS}, {LABELLED} " + " UNION ALL ".join(
    f"SELECT {q(l)} AS label, count(*) FILTER ({l} = 1) AS positives FROM labelled" for l in LABELS))
def label_distribution(spark, d):
    return tagging.label_distribution(labelled(spark, d, text=False))


@query("pos_weights", f"WITH {COMMENTS}, {LABELLED} " + " UNION ALL ".join(
    f"SELECT {q(l)} AS label, count(*) FILTER ({l} >= 0) AS total, count(*) FILTER ({l} = 1) AS positives, "
    f"round((count(*) FILTER ({l} = 0))::DOUBLE / nullif(count(*) FILTER ({l} = 1), 0), 9) AS pos_weight "
    "FROM labelled" for l in LABELS))
def pos_weights(spark, d):
    return inp.rounded(tagging.pos_weights(labelled(spark, d, text=False)))


@query("length_stats", f"WITH {COMMENTS}, n AS (SELECT {sql_n_tokens(sql_basic())} AS n FROM comments) "
       "SELECT min(n) AS min_tokens, max(n) AS max_tokens, round(avg(n), 9) AS mean_tokens, median(n) AS median_tokens FROM n")
def length_stats(spark, d):
    return inp.rounded(tagging.length_stats(cleaning.clean_basic(comments(spark, d))))


@query("cleaning_effectiveness",
       f"WITH {COMMENTS}, s AS (SELECT sum({sql_n_tokens('text')})::BIGINT AS o, sum({sql_n_tokens(sql_thorough())})::BIGINT AS k "
       "FROM comments) SELECT o AS original_tokens, k AS clean_tokens, round((o - k) / o * 100, 2) AS reduction_pct FROM s")
def cleaning_effectiveness(spark, d):
    return tagging.cleaning_effectiveness(cleaning.clean_thorough(comments(spark, d)))


@query("moderation_overview",
       f"WITH {COMMENTS}, c AS (SELECT doc_id, {sql_thorough()} AS clean, {_ANY(lexicon.IDENTITY_TERMS)}::INT AS has_identity "
       f"FROM comments) SELECT has_identity, count(*) AS n_rows, count(*) FILTER (toxic = 1) AS n_toxic, "
       f"count(*) FILTER (toxic >= 0) AS n_judged, round(avg({sql_n_tokens('clean')}), 9) AS mean_tokens "
       f"FROM c LEFT JOIN labels l ON c.doc_id = l.doc_id WHERE {sql_n_tokens('clean')} > 4 GROUP BY has_identity")
def moderation_overview(spark, d):
    """Clean, tag, drop short texts, attach labels, summarize: the main path."""
    rows = tagging.with_identity(comments(spark, d))
    rows = cleaning.clean_thorough(rows).withColumn("n", tx.n_tokens(F.col("clean"))).filter(F.col("n") > 4)
    rows = attach(rows.select("doc_id", "has_identity", "n"), inp.table(spark, d, "labels"), "doc_id", ["toxic"])
    return inp.rounded(rows.groupBy("has_identity").agg(
        F.count("*").alias("n_rows"), F.count_if(F.col("toxic") == 1).alias("n_toxic"),
        F.count_if(F.col("toxic") >= 0).alias("n_judged"), F.avg("n").alias("mean_tokens"),
    ))
