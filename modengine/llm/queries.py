"""The queries of this subpackage: name to callable, and name to checking SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import chat_tree, filter_audit, license_scan, line_dedup, minhash_dedup, mixing, packing, periodic_runs, quality_classifier, quality_rules, sharding, simhash_dedup, topk

from .common import free_names, once, written

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op2_simhash_dedup")
def op2_simhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return simhash_dedup.simhash_groups(table(spark, d, "documents"))


@query("op7_packing")
def op7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("byte_bpe_50k.tiktoken"))


_ENOUGH = 10
_OP1_SQL = f"""
WITH lines AS (
    SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS p, unnest(string_split(text, chr(10))) AS raw FROM documents
), units AS (
    SELECT doc_id, p, raw, trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS line,
        sum((trim(raw, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '')::INT) OVER (PARTITION BY doc_id ORDER BY p) AS u
    FROM lines
), named AS (
    SELECT doc_id, u, line, len(regexp_extract_all(line, '\\S+')) AS w,
        sum(len(regexp_extract_all(line, '\\S+'))) OVER (PARTITION BY doc_id ORDER BY u) AS c
    FROM units WHERE line <> ''
), blocks AS (
    SELECT a.doc_id, a.u AS s, min(e.u) AS e FROM named a JOIN named e
        ON a.doc_id = e.doc_id AND e.u BETWEEN a.u AND a.u + {_ENOUGH} AND e.c - a.c + a.w >= {_ENOUGH} GROUP BY a.doc_id, a.u
    UNION
    SELECT e.doc_id, max(a.u) AS s, e.u AS e FROM named a JOIN named e
        ON a.doc_id = e.doc_id AND e.u BETWEEN a.u AND a.u + {_ENOUGH} AND e.c - a.c + a.w >= {_ENOUGH} GROUP BY e.doc_id, e.u
), content AS (
    SELECT b.doc_id, b.s, b.e, list(n.line ORDER BY n.u) AS body
    FROM blocks b JOIN named n ON n.doc_id = b.doc_id AND n.u BETWEEN b.s AND b.e GROUP BY ALL
), ranked AS (
    SELECT doc_id, s, e, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS r FROM content
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(s::BIGINT, e::BIGINT)) AS u FROM ranked WHERE r > 1
), kept AS (
    SELECT t.doc_id, rtrim(coalesce(string_agg(raw, chr(10) ORDER BY p) FILTER (g.u IS NULL), ''), chr(10)) AS text
    FROM units t LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.u = t.u GROUP BY t.doc_id
), removed AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n, 0) AS n_removed_lines, CASE WHEN r.n IS NULL THEN d.text ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id LEFT JOIN removed r ON r.doc_id = d.doc_id
"""


@query("op1_line_dedup", _OP1_SQL)
def op1_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, min_words=_ENOUGH).select("doc_id", "n_removed_lines", "text")


_OP3_MEASURES = "word_length symbols dup_lines repeat_words".split()
_OP3_SQL = """
WITH words AS (
    SELECT doc_id, coalesce(lang, '<null>') AS lang, coalesce(source, '<null>') AS source, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
    FROM documents
), starts AS (
    SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM words WHERE len(ws) >= 5
), again AS (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i+4]) AS n FROM starts
), repeated AS (
    SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS k FROM again WHERE n > 1) GROUP BY 1
), base AS (
    SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%%&|<>]'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words
    FROM words w LEFT JOIN repeated r ON r.doc_id = w.doc_id
), measured AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        CASE WHEN n_words > 0 THEN 100 * word_chars // n_words END AS word_length,
        CASE WHEN n_words > 0 THEN 1000 * n_symbols // word_chars END AS symbols,
        CASE WHEN n_words > 0 THEN 1000 * n_dup_lines // n_lines END AS dup_lines,
        CASE WHEN n_words > 0 THEN 1000 * n_repeat_words // n_words END AS repeat_words,
        CASE WHEN n_words > 0 THEN 400 // n_words END AS word_length_unit, CASE WHEN n_words > 0 THEN 4000 // word_chars END AS symbols_unit,
        CASE WHEN n_words > 0 THEN 1000 // n_lines END AS dup_lines_unit, CASE WHEN n_words > 0 THEN 10000 // n_words END AS repeat_words_unit
    FROM base
), long AS (
    SELECT lang, source, u.m, u.v FROM (SELECT lang, source, unnest([%s]) AS u FROM measured WHERE NOT base_failed)
), sketch AS (
    SELECT lang, source, m, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bin, count(*) AS n FROM long GROUP BY ALL
), levels AS (
    SELECT lang, source, m, bin, sum(n) AS n, grouping(lang, source) AS g FROM sketch
    GROUP BY GROUPING SETS ((lang, source, m, bin), (lang, m, bin), (m, bin))
), run AS (
    SELECT *, sum(n) OVER (PARTITION BY g, lang, source, m ORDER BY bin) AS c, sum(n) OVER (PARTITION BY g, lang, source, m) AS t FROM levels
), q AS (
    SELECT g, lang, source, m, max(t) AS t, min(bin) FILTER (4 * c >= t) AS q1, min(bin) FILTER (2 * c >= t) AS q2, min(bin) FILTER (4 * c >= 3 * t) AS q3 FROM run GROUP BY ALL
), chosen AS (
    SELECT g.lang, g.source, g.m, CASE WHEN a.t >= 100 THEN a.q1 WHEN b.t >= 100 THEN b.q1 ELSE c.q1 END AS q1,
        CASE WHEN a.t >= 100 THEN a.q2 WHEN b.t >= 100 THEN b.q2 ELSE c.q2 END AS q2, CASE WHEN a.t >= 100 THEN a.q3 WHEN b.t >= 100 THEN b.q3 ELSE c.q3 END AS q3
    FROM (SELECT DISTINCT lang, source, unnest([%s]) AS m FROM measured) g
    LEFT JOIN q a ON a.g = 0 AND a.lang = g.lang AND a.source = g.source AND a.m = g.m
    LEFT JOIN q b ON b.g = 1 AND b.lang = g.lang AND b.m = g.m LEFT JOIN q c ON c.g = 3 AND c.m = g.m
), fence AS (
    SELECT v.lang, v.source, v.m, v.q1 - 4 * greatest(v.q3 - v.q1, u.q2, 1) AS low, v.q3 + 4 * greatest(v.q3 - v.q1, u.q2, 1) AS high
    FROM chosen v JOIN chosen u ON u.lang = v.lang AND u.source = v.source AND u.m = v.m || '_unit'
), failed AS (
    SELECT d.doc_id, %s AS failed FROM measured d %s
)
SELECT d.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed
FROM measured d JOIN failed f ON f.doc_id = d.doc_id
""" % (
    ", ".join(f"{{'m': '{m}{u}', 'v': {m}{u}}}" for m in _OP3_MEASURES for u in ("", "_unit")),
    ", ".join(f"'{m}{u}'" for m in _OP3_MEASURES for u in ("", "_unit")),
    "concat_ws(',', " + ", ".join(
        f"CASE WHEN {m.name} > f{k}.high" + (f" OR {m.name} < f{k}.low" if m.both else "")
        + f" THEN '{m.name}' END" for k, m in enumerate(quality_rules.MEASURES)
    ) + ")",
    " ".join(
        f"LEFT JOIN fence f{k} ON f{k}.lang = d.lang AND f{k}.source = d.source AND f{k}.m = '{m.name}'"
        for k, m in enumerate(quality_rules.MEASURES)
    ),
)


@query("op3_quality_rules", _OP3_SQL)
def op3_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, d, "documents"))


@query("op10_sharding")
def op10_sharding(spark: SparkSession, d: str) -> DataFrame:
    return sharding.shard(table(spark, d, "documents"))


_OP4_SQL = """
WITH fit AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM fit q JOIN fit c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_topk", _OP4_SQL)
def op4_topk(spark: SparkSession, d: str) -> DataFrame:
    return topk.top_k(table(spark, d, "embeddings"))


def domain_of_source() -> Column:
    """The tables name no domain: sources form four by their number."""
    return F.concat(F.lit("d"), (F.regexp_extract(F.coalesce("source", F.lit("")), "([0-9]+)$", 1).try_cast("int") % 4).cast("string"))


def _divide_sql(source: str, family: str, budget: str, out: str, keys: str) -> str:
    of = f"PARTITION BY {family}" if family else ""
    order = f"({of} ORDER BY full_at, node ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return (
        f"SELECT {keys}, sum, greatest(CASE WHEN lev IS NULL THEN cap ELSE least(cap, floor(lev * w)) END, 0)::BIGINT AS {out} FROM ("
        f"SELECT *, first_value(CASE WHEN open THEN l END) OVER ({of} ORDER BY open DESC, full_at, node ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lev FROM ("
        f"SELECT *, l < full_at AS open FROM (SELECT *, ({budget} - coalesce(sum(cap) OVER {order}, 0)::DOUBLE) / "
        f"(sum(w) OVER ({of}) - coalesce(sum(w) OVER {order}, 0)) AS l FROM (SELECT *, cap / w AS full_at FROM {source}))))"
    )


_UP = "(SELECT {k}, sum(tokens * 2) AS cap, sum(tokens) AS sum, pow(sum(tokens)::DOUBLE, 0.7) AS w, {n} AS node FROM leaves GROUP BY {k})"
_AT = "(('0x' || substr(h, 1, 8))::BIGINT::DOUBLE / 4294967296.0)"
_OP5_SQL = f"""
WITH docs AS (
    SELECT doc_id, coalesce('d' || (try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS INT) % 4), '') AS domain, coalesce(lang, '') AS lang,
        coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens
    FROM documents
), leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens FROM docs GROUP BY ALL),
tops AS ({_divide_sql("(SELECT *, (SELECT sum(tokens) FROM leaves)::DOUBLE AS b0 FROM " + _UP.format(k="domain", n="domain") + ")", "", "b0", "b1", "domain")}),
langs AS ({_divide_sql("(SELECT u.*, b1 FROM " + _UP.format(k="domain, lang", n="lang") + " u JOIN tops USING (domain))", "domain", "b1", "b2", "domain, lang")}),
ends AS ({_divide_sql("(SELECT u.*, b2 FROM " + _UP.format(k="domain, lang, source", n="source") + " u JOIN langs USING (domain, lang))", "domain, lang", "b2", "budget", "domain, lang, source")}),
given AS (SELECT domain, lang, source, floor(budget / sum)::INT AS whole, budget % sum AS rest FROM ends),
joined AS (SELECT * FROM docs JOIN given USING (domain, lang, source)),
last AS (
    SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead
    FROM (SELECT *, md5(concat_ws(':', '17', whole::VARCHAR, doc_id::VARCHAR)) AS h FROM joined WHERE rest > 0)
)
SELECT doc_id, domain, lang, source, unnest(generate_series(0, whole - 1))::INT AS epoch, n_tokens FROM joined WHERE whole > 0
UNION ALL SELECT doc_id, domain, lang, source, whole AS epoch, n_tokens FROM last WHERE coalesce(ahead, 0) < rest
"""


@query("op5_mixing", _OP5_SQL)
def op5_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), domain_of_source()).withColumnRenamed("id", "doc_id").drop("th")


_TEMPLATES = [*license_scan.PHRASES, *license_scan.NOTICES]
_OP6_SQL = f"""
WITH templates(template, label, phrase, k, n_t) AS (VALUES {", ".join(f"({n}, '{t.label}', {t.phrase}, {t.k}, {len(t.words)})" for n, t in enumerate(_TEMPLATES))}),
grams(template, tpos, gram) AS (VALUES {", ".join(f"({n}, {i}, '{' '.join(t.words[i:i + t.k])}')" for n, t in enumerate(_TEMPLATES) for i in range(len(t.words) - t.k + 1))}),
docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents
), words AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS i FROM docs),
rolling AS (
    SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i+1], ' ') AS gram FROM words UNION ALL
    SELECT doc_id, i - 1 AS pos, array_to_string(ws[i:i+2], ' ') AS gram FROM words WHERE i + 2 <= len(ws)
), votes AS (
    SELECT doc_id, t.template, label, phrase, k, n_t, pos - tpos AS diagonal, list(DISTINCT tpos) AS tpos, min(pos) AS low, max(pos) AS high
    FROM rolling JOIN grams USING (gram) JOIN templates t USING (template) GROUP BY ALL
), islands AS (
    SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS island FROM (
        SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > 2, true) AS fresh FROM votes WHERE NOT phrase)
), spans AS (
    SELECT doc_id, label, k, n_t, flatten(list(tpos)) AS tpos, min(low) AS low, max(high) + k AS high FROM islands GROUP BY doc_id, template, island, label, k, n_t
), shares AS (
    SELECT *, len(list_distinct(flatten(list_transform(tpos, lambda t: generate_series(t, t + k - 1))))) / n_t AS share FROM spans
), best AS (
    SELECT doc_id, label, diagonal AS place, 1.0::DOUBLE AS score FROM votes WHERE phrase AND len(tpos) = n_t - k + 1 UNION ALL
    SELECT doc_id, CASE WHEN share >= 0.8 AND (high - low) * 4 <= n_t * 5 + 8 THEN label END, NULL, share FROM shares
), found AS (
    SELECT doc_id, count(place) AS n_base, min(place) AS first_word, max(place) AS last_word,
        string_agg(DISTINCT CASE WHEN place IS NOT NULL THEN label END, ',' ORDER BY CASE WHEN place IS NOT NULL THEN label END) AS base_labels,
        string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score
    FROM best GROUP BY doc_id
)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM docs d LEFT JOIN found f ON f.doc_id = d.doc_id
"""


@query("op6_license_scan", _OP6_SQL)
def op6_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(table(spark, d, "documents"))


_TRICKY = f"{chat_tree.END}{chat_tree.START}assistant ok"


@query("op8_chat_tree")
def op8_chat_tree(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([(-1, 0, "user", _TRICKY), (-1, 1, "assistant", _TRICKY)], "conv_id long, turn long, role string, text string")
    turns = table(spark, d, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_tree.digests(written(chat_tree.tree(turns)))


@query("op9_quality_classifier")
def op9_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "source")
    return quality_classifier.score_documents(docs, table(spark, d, "labels")).select("doc_id", "p_text", "p_meta", "score", "kept")


_OP11_SQL = """
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM words WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
    JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id GROUP BY ALL HAVING 100 * count(*) >= 80 * (any_value(m.n) + any_value(n.n) - count(*))
), reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
roots AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(b, w.doc_id)) AS component_id, least(w.doc_id, coalesce(b, w.doc_id)) = w.doc_id AS kept
FROM words w LEFT JOIN sizes s ON s.doc_id = w.doc_id LEFT JOIN roots r ON r.a = w.doc_id
"""


@query("op11_minhash_dedup", _OP11_SQL)
def op11_minhash_dedup(spark: SparkSession, d: str) -> DataFrame:
    return minhash_dedup.minhash_groups(table(spark, d, "documents"), words=4, percent=80)


_OP12_ORDERS = "WITH RECURSIVE letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l), o(p) AS (SELECT '' UNION ALL SELECT p || l FROM o JOIN letters ON NOT contains(p, l))"
_OP12_BIT = "(1 << (ascii(substr(p, step, 1)) - 65))"
_OP12_SQL = f"""
{_OP12_ORDERS}, words AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), masked AS (
    SELECT part, doc_id,
        (len(ws) < 200)::INT + 2 * (100 * len(list_distinct(ws)) < 50 * len(ws))::INT
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
        + 16 * (doc_id > min(doc_id) OVER (PARTITION BY text))::INT AS mask
    FROM words
), cells AS (
    SELECT part, mask, count(*) AS n, count(*) FILTER (l.quality = 1) AS good, count(*) FILTER (l.toxic = 1) AS toxic
    FROM masked m LEFT JOIN labels l ON l.doc_id = m.doc_id GROUP BY ALL
), orders AS (
    SELECT p, step, {_OP12_BIT} AS bit, coalesce((SELECT sum(1 << (ascii(x) - 65)) FROM unnest(string_split(p[1:step - 1], '')) AS t(x) WHERE x <> ''), 0)::INT AS before
    FROM (SELECT p, unnest([1, 2, 3, 4, 5])::INT AS step FROM o WHERE length(p) = 5)
), metrics AS (
    SELECT part, p AS filter_order, step, bit,
        coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM cells, orders GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM metrics
"""


@query("op12_filter_audit", _OP12_SQL)
def op12_filter_audit(spark: SparkSession, d: str) -> DataFrame:
    return filter_audit.audit(table(spark, d, "documents"), table(spark, d, "labels"))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents as op13 reads them: of about a tenth, chosen by a checksum of the
    id, the tail repeats itself with a period drawn from it."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = h % 10 == 0
    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t-\r]+"), lambda w: w != "")
    rows = once(docs.select("doc_id", "text"), _ws=F.when(chosen, words))
    n, g = F.size("_ws").cast("long"), F.floor(h / 10)
    start = F.when(n > 0, g % n)
    rows = once(rows, _a=start, _p=1 + F.floor((n - start) / (3 + g % 8)))
    told = F.transform("_ws", lambda w, i: F.when(i < F.col("_a"), w).otherwise(F.get("_ws", (F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int"))))
    return rows.select("doc_id", F.when(chosen & (n > 0), F.array_join(told, " ")).otherwise(F.col("text")).alias("text"))


@query("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, d: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_periods(table(spark, d, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = lambda f: F.col(f"best_run.{f}").alias(f)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best("start"), best("length"), best("period"),
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
