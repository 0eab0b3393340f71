"""Queries of attacks, resilience and the defence."""

from __future__ import annotations

import string

from pyspark.sql import functions as F

from ..functions import lexicon
from ..operators import attacks, resilience, tagging
from . import inputs as inp
from .inputs import COMMENTS, LABELS, comments, macro_micro_sql, q, rounded, sql_rand
from .registry import query
from .tagging import sql_weak
from .text import W, sql_collapse, sql_compat, sub

SEED = 42


# -- attacks in SQL ------------------------------------------------------------------

def _chars(t: str) -> str:
    return f"regexp_extract_all({t}, '(?s).')"


def _stream(t: str, key: str, salt: str, symbols) -> str:
    """As many random symbols as ``t`` has characters."""
    share = 16 // len(symbols)
    exact = share * len(symbols) == 16
    blocks = f"greatest(ceil(length({t}) / {32 if exact else 28}::DOUBLE)::BIGINT + {0 if exact else 1}, 1)"
    digests = f"list_transform(range(1, {blocks} + 1), lambda b: md5(concat_ws(':', {key}, {q(salt)}, b)))"
    image = q("".join(s * share for s in symbols))
    drawn = f"translate(array_to_string({digests}, ''), '0123456789abcdef', {image})"
    return f"left({drawn if exact else f'{drawn} || repeat({q(symbols[0])}, length({t}))'}, length({t}))"


def _zipped(t: str, key: str, salt: str, symbols, each: str) -> str:
    """``each`` per character z[1] with its symbol z[2]."""
    return (
        f"array_to_string(list_transform(list_zip({_chars(t)}, {_chars(_stream(t, key, salt, symbols))}), lambda z: {each}), '')"
    )


def _map(value: str, pairs: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in pairs.items()) + " END"


def _append(t: str, key: str, salt: str, symbols) -> str:
    return _zipped(t, key, salt, symbols, "CASE WHEN z[1] = chr(10) THEN z[1] ELSE z[1] || z[2] END")


def _leet(t: str, key: str) -> str:
    first = {a: v[0] for a, v in lexicon.LEET.items()}
    last = {a: v[-1] for a, v in lexicon.LEET.items()}
    pick = f"coalesce(CASE WHEN z[2] = '1' THEN {_map('z[1]', last)} ELSE {_map('z[1]', first)} END, z[1])"
    return _zipped(t, key, "leetspeak", "01", pick)


def _words(t: str, key: str) -> str:
    rand = sql_rand(key, "'word_substitution:' || (i - 1)")
    cases = " ".join(
        f"WHEN {q(w)} THEN [{inp.sql_list(s)}][1 + floor({rand} * {len(s)})::INT]" for w, s in lexicon.SYNONYMS.items()
    )
    pieces = f"regexp_extract_all({t}, {q(f'[{W}]+|[^{W}]+')})"
    return f"array_to_string(list_transform({pieces}, lambda w, i: CASE lower(w) {cases} ELSE w END), '')"


_ASCII = string.ascii_lowercase
SQL_ATTACKS = {
    "leetspeak": _leet,
    "space_injection": lambda t, k: sub(t, r"([^\n])", r"\1 "),
    "char_repetition": lambda t, k: _zipped(
        t, k, "char_repetition", "01",
        "CASE WHEN z[1] = chr(10) THEN z[1] WHEN z[2] = '1' THEN repeat(z[1], 3) ELSE repeat(z[1], 2) END"),
    "special_chars": lambda t, k: _append(t, k, "special_chars", lexicon.SPECIAL_CHARS),
    "case_variation": lambda t, k: _zipped(
        t, k, "case_variation", "01",
        f"CASE WHEN z[2] = '1' THEN translate(z[1], '{_ASCII}', '{_ASCII.upper()}') "
        f"ELSE translate(z[1], '{_ASCII.upper()}', '{_ASCII}') END"),
    "unicode": lambda t, k: sql_compat(t),
    "word_substitution": _words,
    "character_swapping": lambda t, k: sub(t, f"([{W}])([{W}])", r"\2\1"),
    "emoji_injection": lambda t, k: _append(t, k, "emoji_injection", lexicon.EMOJI),
    "zero_width": lambda t, k: sub(t, r"([^\n])", r"\1" + lexicon.ZERO_WIDTH),
}


# -- single attacks --------------------------------------------------------------------

def _attack_query(name: str, pattern: str) -> None:
    @query(name, f"WITH {COMMENTS} SELECT doc_id, {SQL_ATTACKS[pattern]('text', 'doc_id')} AS attacked FROM comments")
    def run(spark, d):
        return attacks.obfuscated(comments(spark, d), "text", "doc_id", pattern, "attacked").drop("text")


for _name, _pattern in {
    "ob_leetspeak": "leetspeak", "ob_space": "space_injection", "ob_repeat": "char_repetition",
    "ob_special": "special_chars", "ob_case": "case_variation", "ob_unicode": "unicode",
    "ob_synonym": "word_substitution", "ob_swap": "character_swapping", "ob_emoji": "emoji_injection",
    "ob_zero_width": "zero_width",
}.items():
    _attack_query(_name, _pattern)


def variants_sql(patterns) -> str:
    """CTE ``variants`` (doc_id, text, pattern, attacked)."""
    parts = ["SELECT doc_id, text, 'original' AS pattern, text AS attacked FROM comments"] + [
        f"SELECT doc_id, text, {q(p)}, {SQL_ATTACKS[p]('text', 'doc_id')} FROM comments" for p in patterns
    ]
    return f"{COMMENTS}, variants AS ({' UNION ALL '.join(parts)})"


@query("obfuscation_variants", f"WITH {variants_sql(lexicon.PATTERNS)} SELECT doc_id, pattern, length(attacked) AS n_chars, "
                               "md5(attacked) AS digest FROM variants")
def obfuscation_variants(spark, d):
    variants = attacks.obfuscation_variants(comments(spark, d), "text", "doc_id")
    return variants.select("doc_id", "pattern", F.length("attacked").alias("n_chars"), F.md5("attacked").alias("digest"))


# -- attack sets ------------------------------------------------------------------------

def _base(spark, d):
    """Documents with a class: judged toxic, else by keywords, else clean."""
    weak = tagging.weak_labels(comments(spark, d)).withColumnRenamed("toxic", "_weak")
    rows = weak.join(inp.table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    cls = (
        F.when(F.col("toxic") == 1, "toxic").when(F.col("threat") == 1, "threat")
        .when(F.col("severe_toxic") == 1, "severe_toxic").when(F.col("identity_hate") == 1, "identity_hate")
        .when(F.col("obscene") == 1, "obscene").when(F.col("insult") == 1, "insult").otherwise("clean")
    )
    return rows.select(F.col("doc_id").alias("base_id"), "text", cls.alias("class"))


_WEAK = sql_weak()
_BASE = (
    f"{COMMENTS}, base AS (SELECT c.doc_id AS base_id, text, CASE WHEN toxic = 1 THEN 'toxic' WHEN {_WEAK['threat']} = 1 "
    f"THEN 'threat' WHEN {_WEAK['severe_toxic']} = 1 THEN 'severe_toxic' WHEN {_WEAK['identity_hate']} = 1 THEN 'identity_hate' "
    f"WHEN {_WEAK['obscene']} = 1 THEN 'obscene' WHEN {_WEAK['insult']} = 1 THEN 'insult' "
    "ELSE 'clean' END AS class FROM comments c LEFT JOIN labels l ON c.doc_id = l.doc_id)"
)


def _attack_set_sql() -> str:
    """CTEs up to ``attacked``: three stages of at most one attack each."""
    names = ", ".join(f"{{'h': md5(concat_ws(':', k, {q(p)})), 'p': {q(p)}}}" for p in lexicon.PATTERNS)
    stages = [
        f"{_BASE}",
        "rows AS (SELECT *, class = 'clean' AS clean, concat_ws(':', '42', base_id, variant) AS k FROM base, "
        "range(1, 4) v(variant) WHERE class <> 'clean' OR variant = 1)",
        f"stage0 AS MATERIALIZED (SELECT *, text AS t, CASE WHEN clean THEN [] ELSE list_transform(list_sort([{names}]), lambda s: s.p)"
        f"[1:2 + floor({sql_rand('k', q('count'))} * 2)::INT] END AS names FROM rows)",
    ]
    for i in (1, 2, 3):
        cases = " ".join(f"WHEN {q(p)} THEN {f('t', f'concat(k, {q(f':{i}')})')}" for p, f in SQL_ATTACKS.items())
        stages.append(
            f"stage{i} AS MATERIALIZED (SELECT * EXCLUDE (t), CASE coalesce(names[{i}], '') {cases} ELSE t END AS t FROM stage{i - 1})"
        )
    return ", ".join(stages)


_SET = _attack_set_sql()


@query("attack_set",
       f"WITH {_SET} SELECT base_id, variant, length(t) AS n_chars, md5(t) AS digest, "
       "CASE WHEN clean THEN 'clean' ELSE array_to_string(names, '+') END AS pattern, class, (NOT clean)::INT AS is_toxic, "
       f"round(CASE WHEN clean THEN 0.8::DOUBLE + 0.2::DOUBLE * {sql_rand('k', q('confidence'))} "
       f"ELSE 0.7::DOUBLE + 0.3::DOUBLE * {sql_rand('k', q('confidence'))} END, 9) AS confidence, len(names) AS obfuscation_level FROM stage3")
def attack_set(spark, d):
    rows = attacks.attack_rows(_base(spark, d), seed=SEED)
    return rounded(rows.select(
        "base_id", "variant", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "pattern", "class",
        "is_toxic", "confidence", "obfuscation_level",
    ))


@query("attack_set_stats",
       f"WITH {_SET.split(', stage1 AS')[0]} SELECT CASE WHEN clean THEN 'clean' ELSE array_to_string(names, '+') END AS pattern, "
       "count(*) AS n_rows, count(*) FILTER (NOT clean) AS n_toxic, avg((NOT clean)::INT) AS toxic_share FROM stage0 GROUP BY ALL")
def attack_set_stats(spark, d):
    return tagging.set_stats(attacks.attack_rows(_base(spark, d), seed=SEED))


@query("attack_set_totals",
       f"WITH {_SET.split(', stage1 AS')[0]} SELECT count(*) AS n_rows, count(*) FILTER (NOT clean) AS n_toxic, count(*) FILTER (clean) AS n_clean, "
       "avg((NOT clean)::INT) AS toxic_share, count(DISTINCT CASE WHEN clean THEN 'clean' ELSE array_to_string(names, '+') END) AS n_patterns FROM stage0")
def attack_set_totals(spark, d):
    return tagging.set_totals(attacks.attack_rows(_base(spark, d), seed=SEED))


_DRAWN = (
    "numbered AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY md5(concat_ws(':', '42', base_id)), base_id) - 1 AS pos, "
    "count(*) OVER (PARTITION BY class) AS size FROM base), "
    "spots AS (SELECT class, i, floor(" + sql_rand("'42'", "class", "i", "'draw'")
    + " * size)::BIGINT AS pos FROM (SELECT DISTINCT class, size FROM numbered), range(71) r(i))"
)


@query("attack_set_draws",
       f"WITH {_BASE}, {_DRAWN} SELECT concat_ws('/', base_id, i) AS base_id, class, md5(text) AS digest "
       "FROM spots JOIN numbered USING (class, pos)")
def attack_set_draws(spark, d):
    drawn = attacks.draw_per_class(_base(spark, d), 500 // (len(LABELS) + 1), SEED)
    return drawn.select("base_id", "class", F.md5("text").alias("digest"))


# -- resilience and defence ----------------------------------------------------------------

def _pairs_sql(source: str, keys: str, y: str, p: str) -> str:
    """Keyword labels of two texts as rows (keys, label, y, pred)."""
    wy, wp = sql_weak(f"lower({y})"), sql_weak(f"lower({p})")
    return " UNION ALL ".join(
        f"SELECT {keys}, {q(l)} AS label, {wy[l]} AS y, {wp[l]} AS pred FROM {source}" for l in LABELS
    )


@query("resilience_by_pattern",
       f"WITH {variants_sql(lexicon.PATTERNS)}, mv AS MATERIALIZED (SELECT * FROM variants), "
       f"pairs AS ({_pairs_sql('mv', 'pattern', 'text', 'attacked')}), f AS ({macro_micro_sql('pattern', 'pairs')}) "
       "SELECT pattern, round(f1_macro, 9) AS f1_macro, round(c, 9) AS f1_clean, round(f1_macro / nullif(c, 0), 9) AS resilience "
       "FROM f, (SELECT f1_macro AS c FROM f WHERE pattern = 'original')")
def resilience_by_pattern(spark, d):
    variants = attacks.obfuscation_variants(resilience.with_truth(comments(spark, d)), "text", "doc_id")
    preds = resilience.attack_predictions(variants, ["pattern"], truth="truth")
    return rounded(resilience.resilience_ratio(preds))


@query("resilience_by_level",
       f"WITH {_SET}, leveled AS (SELECT len(names) AS level, text, t FROM stage3 WHERE NOT clean UNION ALL "
       f"SELECT 0, text, text FROM base), pairs AS ({_pairs_sql('leveled', 'level', 'text', 't')}), "
       f"f AS ({macro_micro_sql('level', 'pairs')}) SELECT level, round(f1_macro, 9) AS f1_macro, round(c, 9) AS f1_clean, "
       "round(f1_macro / nullif(c, 0), 9) AS resilience FROM f, (SELECT f1_macro AS c FROM f WHERE level = 0)")
def resilience_by_level(spark, d):
    base = resilience.with_truth(_base(spark, d))
    attacked = attacks.attack_rows(base, seed=SEED, keep=["truth"]).filter(F.col("is_toxic") == 1).select(
        F.col("obfuscation_level").alias("level"), "truth", F.col("text").alias("attacked")
    )
    rows = attacked.unionByName(base.select(F.lit(0).alias("level"), "truth", F.col("text").alias("attacked")))
    preds = resilience.attack_predictions(rows, ["level"], truth="truth")
    return rounded(resilience.resilience_ratio(preds, "level", 0))


_LETTERS = [*string.ascii_letters, *string.digits, "_", *[chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha()]]


def _normalize(t: str) -> str:
    spaced = sub(sql_compat(t), rf"[^{W}]+", " ")
    return f"lower(replace({sql_collapse(spaced, 1, _LETTERS)}, ' ', ''))"


def _defence_sql() -> str:
    y, a, n = (sql_weak(c) for c in ("lower(text)", "lower(attacked)", "norm"))
    rows = " UNION ALL ".join(
        f"SELECT pattern, {q(l)} AS label, {y[l]} AS y, {a[l]} AS a, {n[l]} AS n FROM normed" for l in LABELS
    )
    cells = {
        "positives": "y = 1", "found_attacked": "y = 1 AND a = 1", "found_normalized": "y = 1 AND n = 1",
        "false_attacked": "y = 0 AND a = 1", "false_normalized": "y = 0 AND n = 1",
    }
    return (
        f"WITH {variants_sql(lexicon.PATTERNS)}, normed AS MATERIALIZED (SELECT *, {_normalize('attacked')} AS norm FROM variants), "
        f"w AS ({rows}) SELECT pattern, label, "
        + ", ".join(f"count(*) FILTER ({c}) AS {k}" for k, c in cells.items()) + " FROM w GROUP BY ALL"
    )


@query("defence_gain", _defence_sql())
def defence_gain(spark, d):
    variants = attacks.obfuscation_variants(resilience.with_truth(comments(spark, d)), "text", "doc_id")
    return resilience.defence_gain(variants, truth="truth")
