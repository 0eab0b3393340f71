"""Comment tables: tolerant and strict CSV scans, labels, embeddings."""

from __future__ import annotations

from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import lexicon
from ..operators.tagging import require_columns

_CORRUPT = "_bad_record"

COMMENT_SCHEMA = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("comment_text", T.StringType())]
    + [T.StructField(label, T.IntegerType()) for label in lexicon.LABELS]
)
ATTACK_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("original_text", T.StringType()),
    T.StructField("pattern", T.StringType()), T.StructField("class", T.StringType()),
    T.StructField("is_toxic", T.IntegerType()), T.StructField("confidence", T.DoubleType()),
    T.StructField("obfuscation_level", T.IntegerType()),
])


def _csv(spark: SparkSession, multi_line: bool = True):
    # multiLine keeps quoted line feeds. Such a file cannot be split: large inputs
    # come as many files, or without line feeds in quotes and ``multi_line=False``.
    return spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')


def _first_lines(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """Files by their first line. A scan of the text on the executors keeps one line
    per file; the driver gets as many as it lists files anyway."""
    lines = spark.read.text(path).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.filter("file_block_start = 0").withColumn("n", F.monotonically_increasing_id())
    found: dict[str, list[str]] = {}
    for row in first.groupBy("file_path").agg(F.min_by("value", "n").alias("line")).orderBy("file_path").collect():
        found.setdefault(row["line"].removeprefix("\ufeff").rstrip("\r"), []).append(unquote(row["file_path"]))
    return found


def read_comments(
    spark: SparkSession, path: str, schema: T.StructType = COMMENT_SCHEMA, multi_line: bool = True, unparsed: str | None = None,
    same_header: bool = False,
) -> DataFrame:
    """CSV scan that takes columns by their header names, drops rows with more
    fields than the header and pads short ones with null.

    Of several files each is read by its own header: those with equal headers in
    one scan, then united by name. That takes a pass over their first lines;
    ``same_header`` promises that all are alike and saves it.

    A column of the schema that a file lacks is null, others of the file are left
    out. A value that is no number where the schema wants one becomes null; with
    ``unparsed``, a column of that name lists the columns where this happened.
    """
    if not same_header and len(spark.read.text(path).inputFiles()) > 1:
        scans = [_read_alike(spark, files, schema, multi_line, unparsed) for files in _first_lines(spark, path).values()]
        return reduce(DataFrame.unionByName, scans)
    return _read_alike(spark, path, schema, multi_line, unparsed)


def _read_alike(spark: SparkSession, path: str | list[str], schema: T.StructType, multi_line: bool, unparsed: str | None) -> DataFrame:
    header = _csv(spark, multi_line).csv(path).columns
    wide = T.StructType([T.StructField(c, T.StringType()) for c in [*header, _CORRUPT]])
    rows = (
        _csv(spark, multi_line).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _CORRUPT)
        .option("enforceSchema", True).option("columnPruning", False).schema(wide).csv(path)
    )
    # Spark flags long and short rows alike; the commas outside quotes tell.
    commas = F.length(F.regexp_replace(F.regexp_replace(_CORRUPT, r'"[^"]*"', ""), r"[^,]+", ""))
    # Spark wants a data column beside the corrupt one, also where rows are only counted.
    read = F.coalesce(F.length(f"`{header[0]}`"), F.lit(0)) >= 0
    fitting = rows.filter(read & (F.col(_CORRUPT).isNull() | (commas < len(header))))
    cells = {f.name: F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast("string") for f in schema.fields}
    values = {f.name: cells[f.name].try_cast(f.dataType) for f in schema.fields}
    out = [v.alias(n) for n, v in values.items()]
    if unparsed is not None:
        out.append(F.array_compact(F.array(*[
            F.when(cells[n].isNotNull() & v.isNull(), F.lit(n)) for n, v in values.items()
        ])).alias(unparsed))
    return fitting.select(*out)


def read_strict(spark: SparkSession, path: str, schema: T.StructType = COMMENT_SCHEMA, multi_line: bool = True) -> DataFrame:
    """CSV scan that fails on the first row that does not fit the schema, and on a
    file whose header does not name its columns in order. Without line feeds in
    quotes, ``multi_line=False`` lets Spark split the files."""
    return _csv(spark, multi_line).option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)


def read_required(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV scan by header names; a missing file or column is an error."""
    try:
        df = _csv(spark).csv(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise
    return require_columns(df, columns)


def load_attack_set(spark: SparkSession, path: str, schema: T.StructType = ATTACK_SCHEMA) -> DataFrame:
    return read_comments(spark, path, schema)


def attach_labels(texts: DataFrame, labels: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Labels kept in another table, by key; -1 where a text has none."""
    joined = texts.join(labels.select(key, *columns), key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.lit(-1)) for c in columns})


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_embeddings(df: DataFrame, path: str, key: str, col: str = "embedding") -> None:
    """Vectors as parquet arrays next to their key."""
    df.select(key, F.col(col).cast("array<float>").alias(col)).write.mode("overwrite").parquet(path)
