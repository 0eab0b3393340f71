"""Input tables of the queries, as DataFrames and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import lexicon
from ..functions.rand import det_rand
from ..operators.metrics import apply_thresholds
from ..sources.comments import attach_labels

LABELS = lexicon.LABELS

# The documents are prose without links, markup, contractions or identity terms.
# Every text gets one of these endings, by its id, so that each rule has work.
ENDINGS = [
    "She is a woman and can't wait!!!",
    "The old man won't say it...",
    "A muslim and a christian aren't far apart.",
    "Mail me at jo.doe@example.org now",
    "see http://example.org/a?b=1 or www.example.com/x, today",
    "@maria_1 likes #spring &amp; tea &nbsp; 4ever",
    "<b>Bold</b> words, sooooo <i>cooool</i> cafés",
    "You're stupid and worthless women, foolish babies",
    "I'd kill for 100 cookies, they've won 3 boxes",
    "hope it doesn't die, wishes fade??!",
    "black and white films; I'm gay and She's asian",
    "It's what we'll find for you in churches",
    "What the sh*t is this",
    "He said all [group] should leave",
    "Y\u043eu call sTuPid w\u200bords \ufb01ne \uff57ork b a d l y",
    "",
]

# Share of positives of the labels that the tables do not judge.
PREVALENCE = {"severe_toxic": 0.05, "obscene": 0.15, "threat": 0.04, "insult": 0.2, "identity_hate": 0.03}
# Weight of the truth in each model's made score; the rest is noise.
MODELS = {"trees": 0.35, "linear": 0.25}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXT_TASKS = "spark.modengine.textTasks"


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' texts, in the splits of the scan. A session that sets
    ``spark.modengine.textTasks`` gets that many instead: one small file with a
    single row group is one task otherwise."""
    docs, tasks = table(spark, sf_dir, "documents").select("doc_id", "text"), spark.conf.get(TEXT_TASKS, None)
    return docs.repartition(int(tasks), "doc_id") if tasks else docs


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): every document with its ending."""
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (F.col("doc_id") % len(ENDINGS) + 1).cast("int"))
    return texts(spark, sf_dir).select("doc_id", F.concat_ws(" ", "text", ending).alias("text"))


def labelled(spark: SparkSession, sf_dir: str, text: bool = True) -> DataFrame:
    """(doc_id, text, six labels): toxic as judged, -1 where it was not; the
    others drawn per document."""
    docs = comments(spark, sf_dir) if text else table(spark, sf_dir, "documents").select("doc_id")
    rows = attach_labels(docs, table(spark, sf_dir, "labels"), "doc_id", ["toxic"])
    return rows.withColumns({
        label: (det_rand(F.col("doc_id"), f"y:{label}") < share).cast("int") for label, share in PREVALENCE.items()
    })


def scores_of(rows: DataFrame, keep: list[str] = []) -> DataFrame:
    """Long scores (id, keep…, model, label, y, p) of both models. All rows of a
    document come from one input row, so nothing is shuffled."""
    cells = []
    for model, weight in MODELS.items():
        for label in LABELS:
            noise = (1 - weight) * det_rand(F.col("doc_id"), f"{model}:{label}")
            raw = weight * F.greatest(F.col(label), F.lit(0)) + noise
            cells.append(F.struct(
                F.lit(model).alias("model"), F.lit(label).alias("label"), F.col(label).alias("y"),
                (F.floor(raw * 10000) / 10000).alias("p"),
            ))
    return rows.select(F.col("doc_id").alias("id"), *keep, F.inline(F.array(*cells)))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores_of(labelled(spark, sf_dir, text=False))


def predictions_of(long: DataFrame, op: str = ">") -> DataFrame:
    return apply_thresholds(long.filter(F.col("y") >= 0), lexicon.DEFAULT_THRESHOLDS, op)


def predictions(spark: SparkSession, sf_dir: str, op: str = ">") -> DataFrame:
    return predictions_of(scores(spark, sf_dir), op)


# -- the same in SQL ------------------------------------------------------------

def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(words) -> str:
    return ", ".join(q(w) for w in words)


def sql_rand(*parts: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT / 4294967296::DOUBLE)"


COMMENTS = (
    "comments AS (SELECT doc_id, concat_ws(' ', text, CASE doc_id % " + str(len(ENDINGS)) + " "
    + " ".join(f"WHEN {i} THEN {q(e)}" for i, e in enumerate(ENDINGS)) + " END) AS text FROM documents)"
)

_DRAWN = ", ".join(f"({sql_rand('doc_id', q('y:' + l))} < {s}::DOUBLE)::INT AS {l}" for l, s in PREVALENCE.items())
LABELLED = (
    "labelled AS (SELECT d.doc_id, d.text, coalesce(l.toxic, -1) AS toxic, " + _DRAWN.replace("doc_id", "d.doc_id")
    + " FROM comments d LEFT JOIN labels l ON d.doc_id = l.doc_id)"
)
SCORES = "scores AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS id, text, {q(m)} AS model, {q(l)} AS label, {l} AS y, "
    f"floor(({w}::DOUBLE * greatest({l}, 0) + (1 - {w}::DOUBLE) * {sql_rand('doc_id', q(m + ':' + l))}) * 10000) / 10000 AS p "
    "FROM labelled" for m, w in MODELS.items() for l in LABELS
) + ")"
THRESHOLDS = "thresholds(label, threshold) AS (VALUES " + ", ".join(
    f"({q(l)}, {t}::DOUBLE)" for l, t in lexicon.DEFAULT_THRESHOLDS.items()
) + ")"
PREDS = (
    "preds AS (SELECT s.*, (p > threshold)::INT AS pred FROM scores s JOIN thresholds t ON s.label = t.label WHERE y >= 0)"
)
BASE = ", ".join([COMMENTS, LABELLED, SCORES])
BASE_PREDS = ", ".join([BASE, THRESHOLDS, PREDS])


def counts_sql(by: str, source: str = "preds") -> str:
    return (
        f"SELECT {by}, count(*) FILTER (y = 1 AND pred = 1) AS tp, count(*) FILTER (y = 0 AND pred = 1) AS fp, "
        f"count(*) FILTER (y = 1 AND pred = 0) AS fn, count(*) FILTER (y = 0 AND pred = 0) AS tn "
        f"FROM {source} GROUP BY {by}"
    )


def div0(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0 ELSE ({a})::DOUBLE / ({b}) END)"


P, R, F1 = div0("tp", "(tp + fp)"), div0("tp", "(tp + fn)"), div0("2 * tp", "(2 * tp + fp + fn)")
ACC = div0("tp + tn", "(tp + tn + fp + fn)")


def macro_micro_sql(by: str, source: str = "preds") -> str:
    """Macro and micro P, R, F1 per ``by``, unrounded."""
    keys = f"{by}, label"
    pooled = {n: e.replace("tp", "sum(tp)").replace("fp", "sum(fp)").replace("fn", "sum(fn)") for n, e in
              {"precision": P, "recall": R, "f1": F1}.items()}
    return (
        f"SELECT {by}, avg({P}) AS precision_macro, avg({R}) AS recall_macro, avg({F1}) AS f1_macro, "
        + ", ".join(f"{e} AS {n}_micro" for n, e in pooled.items())
        + f" FROM ({counts_sql(keys, source)}) GROUP BY {by}"
    )


def curve_sql(by: str, source: str = "scores") -> str:
    """Running counts per distinct score, by a plain window."""
    return (
        f"SELECT {by}, p, pos, neg, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, "
        f"sum(pos) OVER (PARTITION BY {by}) AS n_pos, sum(neg) OVER (PARTITION BY {by}) AS n_neg "
        f"FROM (SELECT {by}, p, sum(y) AS pos, sum(1 - y) AS neg FROM {source} WHERE y >= 0 GROUP BY {by}, p) "
        f"WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)"
    )


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Floating-point columns rounded for comparison."""
    return df.select(*[
        F.round(F.col(f.name), places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name)
        for f in df.schema.fields
    ])
