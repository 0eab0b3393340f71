"""Attack variants and attack sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import lexicon
from ..functions.obfuscation import obfuscate, obfuscate_by, obfuscate_in_turn
from ..functions.rand import det_rand, hash_hex, det_index
from .cleaning import computed_once
from .ranking import ranked

ATTACK_COLUMNS = ["text", "original_text", "pattern", "class", "is_toxic", "confidence", "obfuscation_level"]


def obfuscated(df: DataFrame, col: str, key: str, pattern: str, out: str | None = None) -> DataFrame:
    """The table with one text column attacked."""
    return computed_once(df.withColumn(out or col, obfuscate(F.col(col), F.col(key), pattern)), out or col)


def obfuscation_variants(
    df: DataFrame, col: str, key: str, patterns: Sequence[str] = tuple(lexicon.PATTERNS), out: str = "attacked"
) -> DataFrame:
    """One row per text and pattern, and one for the original.

    The rows multiply before the attack runs, so a variant is built when its row
    is and a text with all its variants is never held at once.
    """
    names = F.array(*[F.lit(p) for p in ["original", *patterns]])
    fanned = df.withColumn("pattern", F.explode(names))
    attacked = fanned.withColumn(out, obfuscate_by(F.col(col), F.col(key), F.col("pattern"), patterns))
    return computed_once(attacked, out)


def _drawn_patterns(key: Column, patterns: Sequence[str]) -> Column:
    """Two or three different patterns in random order: the names sorted by hash."""
    named = F.array(*[F.struct(hash_hex(key, p).alias("h"), F.lit(p).alias("p")) for p in patterns])
    count = (det_index(key, "count", 2) + 2).cast("int")
    return F.slice(F.transform(F.array_sort(named), lambda s: s["p"]), F.lit(1), count)


def attack_rows(
    base: DataFrame, variants: int = 3, seed: int = 42, patterns: Sequence[str] = tuple(lexicon.PATTERNS),
    clean_class: str = "clean", keep: Sequence[str] = (),
) -> DataFrame:
    """Attack set from base rows (base_id, text, class), with the columns of ``keep``.

    Every row gives ``variants`` rows, each attacked by two or three patterns
    one after the other; rows of the clean class are passed on once as they are.
    """
    clean = F.col("class") == clean_class
    copies = F.sequence(F.lit(1), F.when(clean, 1).otherwise(variants))
    rows = base.withColumn("variant", F.explode(copies)).withColumn("original_text", F.col("text"))
    key = F.concat_ws(":", F.lit(str(seed)), F.col("base_id").cast("string"), F.col("variant").cast("string"))
    rows = rows.withColumn("_key", key).withColumn(
        "_names", F.when(clean, F.array().cast("array<string>")).otherwise(_drawn_patterns(F.col("_key"), patterns))
    )
    attacked = obfuscate_in_turn(F.col("text"), F.col("_key"), F.col("_names"))
    rows = computed_once(rows.withColumn("text", attacked), "text")
    sure = det_rand(F.col("_key"), "confidence")
    return rows.select(
        "base_id", "variant", "text", "original_text",
        F.when(clean, F.lit("clean")).otherwise(F.array_join("_names", "+")).alias("pattern"), "class",
        (~clean).cast("int").alias("is_toxic"),
        F.when(clean, 0.8 + 0.2 * sure).otherwise(0.7 + 0.3 * sure).alias("confidence"),
        F.size("_names").alias("obfuscation_level"), *keep,
    )


def draw_per_class(base: DataFrame, per_class: int, seed: int = 42, prefix: int = 4) -> DataFrame:
    """Exactly ``per_class`` rows of every class, drawn with replacement.

    ``base_id`` names a row. Only ids and classes are ranked (``prefix`` as in
    ``ranked``); the texts join the few ids that were drawn.
    """
    ids = base.select("base_id", "class")
    placed = ranked(ids, hash_hex(seed, F.col("base_id")), ["base_id"], by=["class"], out="_pos", total="_size", prefix=prefix)
    sizes = placed.groupBy("class").agg(F.max("_size").alias("_size"))
    draws = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(per_class - 1))))
    spot = det_index(F.concat_ws(":", F.lit(str(seed)), "class", F.col("_draw").cast("string")), "draw", F.col("_size"))
    picked = draws.select("class", "_draw", spot.alias("_pos")).join(placed.drop("_size"), ["class", "_pos"])
    found = picked.select("base_id", "_draw").join(base, "base_id").select("_draw", *base.columns)
    return found.withColumn(
        "base_id", F.concat_ws("/", F.col("base_id").cast("string"), F.col("_draw").cast("string"))
    ).drop("_draw")


def build_attack_set(base: DataFrame, n: int = 500, seed: int = 42, variants: int = 3) -> DataFrame:
    """Balanced attack set: n // 7 base texts per class (six classes and clean)."""
    return attack_rows(draw_per_class(base, n // (len(lexicon.LABELS) + 1), seed), variants, seed)
