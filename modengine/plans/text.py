"""Queries of the text functions."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..functions import lexicon, text as tx
from ..functions.unicode import ascii_fold
from ..operators import cleaning
from .inputs import COMMENTS, comments, q, sql_list, table
from .registry import query

S = tx.S
W = tx.W


# -- SQL forms -------------------------------------------------------------------

def sub(t: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(repl)}, 'g')"


def sql_squeeze(t: str) -> str:
    return f"trim({sub(t, f'[{S}]+', ' ')})"


# Characters whose runs the SQL form of collapse_repeats can see.
_RUN_CHARS = [chr(c) for c in [*range(32, 127), *range(0xC0, 0x180), 0x3C5, 0x200B]]


def sql_collapse(t: str, keep: int, chars=_RUN_CHARS) -> str:
    """Without back-references: cut into runs and single characters, shorten runs."""
    special = r"\.+*?()|[]{}^$"
    runs = "|".join(("\\" + c if c in special else c) + "{3,}" for c in chars)
    return (
        f"array_to_string(list_transform(regexp_extract_all({t}, {q(f'(?s){runs}|.')}), "
        f"lambda r: CASE WHEN length(r) > 1 THEN repeat(r[1], {keep}) ELSE r END), '')"
    )


def sql_stop(t: str) -> str:
    return f"list_filter(string_split({t}, ' '), lambda w: w NOT IN ({sql_list(lexicon.STOP_WORDS)}))"


def sql_lemma(w: str) -> str:
    cases = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in lexicon.LEMMA_EXCEPTIONS.items())
    return (
        f"CASE {w} {cases} ELSE CASE WHEN NOT suffix({w}, 's') OR length({w}) < 4 "
        f"OR right({w}, 2) IN ('ss', 'us', 'is') THEN CASE WHEN suffix({w}, 'men') AND length({w}) > 5 "
        f"THEN left({w}, length({w}) - 2) || 'an' ELSE {w} END "
        f"WHEN suffix({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y' "
        f"WHEN right({w}, 4) IN ('ches', 'shes', 'sses', 'zzes') OR suffix({w}, 'xes') THEN left({w}, length({w}) - 2) "
        f"ELSE left({w}, length({w}) - 1) END END"
    )


def sql_stop_lemma(t: str) -> str:
    return f"array_to_string(list_transform({sql_stop(t)}, lambda w: {sql_lemma('w')}), ' ')"


def sql_fold(t: str) -> str:
    return sub(f"strip_accents({sql_compat(t)})", r"[^\x00-\x7f]", "")


def sql_compat(t: str) -> str:
    """Compatibility forms of the texts' endings: SQL has no NFKC."""
    return f"replace(replace(nfc_normalize({t}), '\ufb01', 'fi'), '\uff57', 'w')"


SQL_STEPS = {
    "html": lambda t, r=" ": sub(t, r"<[^>\n]*>", r),
    "urls": lambda t: sub(t, rf"https?://[^{S}]+|www\.[^{S}]+", " "),
    "urls_c": lambda t: sub(t, rf"http[^{S}]+|www[^{S}]+|https[^{S}]+", ""),
    "emails": lambda t, r=" ": sub(t, rf"[^{S}]+@[^{S}]+", r),
    "handles": lambda t, r=" ": sub(t, rf"@[{W}]+|#[{W}]+", r),
    "entities": lambda t: sub(t, rf"&[{W}]+;", " "),
    "punct": lambda t: sub(t, rf"[^{W}{S}']", " "),
    "punct_b": lambda t: sub(t, rf"[^{W}]", " "),
    "punct_c": lambda t: sub(t, rf"[^a-zA-Z0-9{S}.,!?']", " "),
    "digits": lambda t: sub(t, r"\p{Nd}+", " "),
    "dots": lambda t: sub(sub(t, r"[!?]{2,}", "!"), r"\.{2,}", "."),
}


def sql_contractions(t: str) -> str:
    for short, full in lexicon.CONTRACTIONS:
        t = f"replace({t}, {q(short)}, {q(full)})"
    return t


def sql_thorough(t: str = "text") -> str:
    t = sql_fold(f"lower({t})")
    for step in ("html", "urls", "emails", "handles", "entities", "punct", "digits"):
        t = SQL_STEPS[step](t)
    return sql_stop_lemma(sql_squeeze(sql_collapse(t, 2, [chr(c) for c in range(32, 127)])))


def sql_basic(t: str = "text") -> str:
    return sql_stop_lemma(sql_squeeze(SQL_STEPS["punct_b"](f"lower({t})")))


def sql_cleaner_c(t: str = "text") -> str:
    t = SQL_STEPS["urls_c"](f"lower({t})")
    t = SQL_STEPS["handles"](SQL_STEPS["html"](SQL_STEPS["emails"](t, ""), ""), "")
    return sql_squeeze(SQL_STEPS["dots"](SQL_STEPS["punct_c"](sql_contractions(t))))


def sql_normalize(t: str = "text") -> str:
    t = sub(sql_compat(t), rf"[^{W}]+", " ")
    return f"lower(replace({sql_collapse(t, 1)}, ' ', ''))"


def sql_n_tokens(t: str) -> str:
    return f"len(regexp_extract_all({t}, {q(f'[^{S}]+')}))"


def over_comments(expr: str, name: str = "out") -> str:
    return f"WITH {COMMENTS} SELECT doc_id, {expr} AS {name} FROM comments"


def _column_query(name: str, fn, expr: str) -> None:
    @query(name, over_comments(expr))
    def run(spark, d, fn=fn):
        return comments(spark, d).select("doc_id", fn(F.col("text")).alias("out"))


def _page_query(name: str, fn, expr: str) -> None:
    """The same function on the raw markup of the pages."""
    @query(f"{name}_pages", f"SELECT page_id, {expr} AS out FROM pages")
    def run(spark, d, fn=fn):
        return table(spark, d, "pages").select("page_id", fn(F.col("html")).alias("out"))


def _frame_query(name: str, fn, expr: str) -> None:
    @query(name, over_comments(expr, "clean"))
    def run(spark, d, fn=fn):
        return fn(comments(spark, d)).select("doc_id", "clean")


_column_query("lower_text", tx.lower_text, "lower(text)")
_column_query("ascii_fold", ascii_fold, sql_fold("text"))
_column_query("strip_html", tx.strip_html, SQL_STEPS["html"]("text"))
_page_query("strip_html", tx.strip_html, SQL_STEPS["html"]("html"))
_column_query("strip_urls", tx.strip_urls, SQL_STEPS["urls"]("text"))
_page_query("strip_urls", partial(tx.strip_urls, mode="contractions"), SQL_STEPS["urls_c"]("html"))
_column_query("strip_emails", tx.strip_emails, SQL_STEPS["emails"]("text"))
_column_query("strip_handles", tx.strip_handles, SQL_STEPS["handles"]("text"))
_page_query("strip_handles", tx.strip_handles, SQL_STEPS["handles"]("html"))
_column_query("strip_entities", tx.strip_entities, SQL_STEPS["entities"]("text"))
_page_query("strip_entities", tx.strip_entities, SQL_STEPS["entities"]("html"))
_column_query("strip_punct", tx.strip_punct, SQL_STEPS["punct"]("text"))
_column_query("strip_punct_basic", partial(tx.strip_punct, mode="basic"), SQL_STEPS["punct_b"]("text"))
_column_query("strip_punct_allowed", partial(tx.strip_punct, mode="contractions"), SQL_STEPS["punct_c"]("text"))
_column_query("strip_digits", tx.strip_digits, SQL_STEPS["digits"]("text"))
_column_query("collapse_repeats", tx.collapse_repeats, sql_collapse("text", 2))
_column_query("collapse_repeats_to_one", partial(tx.collapse_repeats, keep=1), sql_collapse("text", 1))
_column_query("collapse_punct", tx.collapse_punct, SQL_STEPS["dots"]("text"))
_column_query("expand_contractions", tx.expand_contractions, sql_contractions("text"))
_column_query("squeeze_ws", tx.squeeze_ws, sql_squeeze("text"))
_column_query(
    "remove_stopwords", lambda c: tx.remove_stopwords(tx.clean_light(c)),
    f"array_to_string({sql_stop(sql_squeeze('lower(text)'))}, ' ')",
)
_column_query(
    "lemmatize", lambda c: tx.lemmatize(tx.clean_light(c)),
    f"array_to_string(list_transform(string_split({sql_squeeze('lower(text)')}, ' '), lambda w: {sql_lemma('w')}), ' ')",
)
_column_query("clean_light", tx.clean_light, sql_squeeze("lower(text)"))
_column_query("normalize_obfuscation", tx.normalize_obfuscation, sql_normalize())
_column_query(
    "truncate_tokens", partial(tx.truncate_tokens, n=128),
    f"array_to_string(string_split({sql_squeeze('text')}, ' ')[1:128], ' ')",
)
_column_query("token_counts", tx.n_tokens, sql_n_tokens("text"))

_HEADS = {w: head for head, ws in reversed(lexicon.SYNONYMS.items()) for w in ws}
_column_query(
    "fold_synonyms", tx.fold_synonyms,
    f"array_to_string(list_transform(regexp_extract_all(text, {q(f'[{W}]+|[^{W}]+')}), lambda w: CASE lower(w) "
    + " ".join(f"WHEN {q(w)} THEN {q(h)}" for w, h in _HEADS.items()) + " ELSE w END), '')",
)

_frame_query("clean_basic", cleaning.clean_basic, sql_basic())
_frame_query("clean_thorough", cleaning.clean_thorough, sql_thorough())
_frame_query("clean_contractions", cleaning.clean_contractions, sql_cleaner_c())


@query("clean_thorough_pages", f"SELECT page_id, {sql_thorough('html')} AS clean FROM pages")
def clean_thorough_pages(spark, d):
    return cleaning.clean_thorough(table(spark, d, "pages"), "html").select("page_id", "clean")


@query(
    "lemmatize_with_table",
    f"WITH {COMMENTS}, lemmas AS (SELECT DISTINCT w AS word, left(w, length(w) - 1) AS lemma FROM "
    f"(SELECT unnest(string_split({sql_squeeze('lower(text)')}, ' ')) AS w FROM benchmark) WHERE suffix(w, 's')), "
    f"words AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i "
    f"FROM (SELECT doc_id, {sql_squeeze('lower(text)')} AS t FROM comments)) "
    "SELECT doc_id, string_agg(coalesce(lemma, w), ' ' ORDER BY i) AS clean FROM words LEFT JOIN lemmas ON w = word "
    "GROUP BY doc_id",
)
def lemmatize_with_table(spark, d):
    """A lemma table that Spark derives from another text table."""
    words = table(spark, d, "benchmark").select(F.explode(F.split(tx.clean_light(F.col("text")), " ")).alias("word"))
    lemmas = words.filter(F.endswith("word", F.lit("s"))).distinct().withColumn(
        "lemma", F.left("word", F.length("word") - 1)
    )
    light = comments(spark, d).withColumn("light", tx.clean_light(F.col("text")))
    return cleaning.lemmatize_with_table(light, "doc_id", "light", lemmas).select("doc_id", "clean")


# A vocabulary of lemmas that Spark derives from a text table, and words of the endings.
_KNOWN = ["church", "wish", "baby", "age", "woman", "box", "film", "word", "cookie", "link", "analysis", "wife"]
_PLURALS = "churches wishes babies ages women boxes films words cookies links analyses wives children physics"
_CANDIDATES = " UNION ALL ".join(
    f"SELECT w, left(w, length(w) - {len(s)}) || {q(e)} AS c FROM corpus WHERE suffix(w, {q(s)}) AND length(w) > {len(s)}" for s, e in lexicon.DETACHMENTS
)
_IRREGULAR = " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in lexicon.LEMMA_IRREGULAR.items())


@query(
    "lemmatize_by_vocabulary",
    f"WITH {COMMENTS}, light AS (SELECT doc_id, {sql_squeeze(f"lower(text) || ' {_PLURALS}'")} AS t FROM comments), "
    f"words AS (SELECT doc_id, unnest(string_split(t, ' ')) AS w, generate_subscripts(string_split(t, ' '), 1) AS i FROM light), "
    f"vocabulary AS (SELECT unnest(string_split({sql_squeeze('lower(text)')}, ' ')) AS v FROM benchmark UNION SELECT unnest([{sql_list(_KNOWN)}])), "
    f"corpus AS (SELECT DISTINCT w FROM words), candidates AS (SELECT w, w AS c FROM corpus UNION ALL {_CANDIDATES}), "
    "best AS (SELECT w, arg_min(c, (-length(c), c)) AS lemma FROM candidates JOIN vocabulary ON c = v GROUP BY w) "
    f"SELECT doc_id, string_agg(CASE x.w {_IRREGULAR} ELSE coalesce(lemma, x.w) END, ' ' ORDER BY i) AS clean FROM words x LEFT JOIN best b ON b.w = x.w GROUP BY doc_id",
)
def lemmatize_by_vocabulary(spark, d):
    known = spark.range(1).select(F.explode(F.array(*map(F.lit, _KNOWN))).alias("word"))
    vocabulary = table(spark, d, "benchmark").select(F.explode(F.split(tx.clean_light(F.col("text")), " ")).alias("word")).union(known)
    light = comments(spark, d).withColumn("light", tx.clean_light(F.concat("text", F.lit(f" {_PLURALS}"))))
    return cleaning.lemmatize_by_vocabulary(light, "doc_id", "light", vocabulary).select("doc_id", "clean")
