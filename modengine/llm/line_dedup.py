"""Repeated runs of lines, found by prefix doubling over line ids; later copies go.

The corpus is a set of sequences of line ids. Suffixes are classed by their first
1, 2, 4, ... lines: the class of a block twice as long is the pair of the classes
of its halves, named by the first place (document, line) where the pair occurs.
Suffixes that share a class are neighbours in the suffix array with a common
prefix at least that long, and a block of any other length is the overlap of two
classed blocks. A line that occurs once ends every repeat, so only lines that
occur again take part after the first round.

A run counts from ``min_words`` words on. The intervals of the longest common
prefix that matter are those of the shortest such blocks: from every line on
the shortest block that has the words, and up to every line likewise. Every
maximal run with that many words is the union of such blocks inside it, so a
line goes exactly if a run of enough words over it has an earlier copy. Blocks
hold at most ``min_words`` lines, which bounds the rounds, whatever the data.

Hot lines: counts are combined before the shuffle, and the classes are written
before they meet their places. Both sides of that join are then plain exchanges,
so Spark broadcasts few classes and splits large partitions of places. No window
spans a class; the only windows are over one document. The copies of every round
are written too: the last plan only reads them, so the driver never runs the joins
of all rounds at once.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as Wd, functions as F

from ..operators.ranking import join_null_safe
from .common import free_names, once, same, written

# A unit is a line that holds more than white space, with the blank lines after it.
UNITS = r"(?<=\n)(?=[^\S\n]*\S)"


def _words(line: Column, enough: int) -> Column:
    """Words of a line without outer white space, or ``enough`` if there are more."""
    head = F.size(F.split(F.substring(line, 1, 16 * enough), r"\s+"))
    full = F.when(head > enough, F.lit(enough + 1)).otherwise(F.size(F.split(line, r"\s+")))
    return F.when(line == "", F.lit(0)).otherwise(F.least(full, F.lit(enough)))


def _here(at: str = "at") -> Column:
    return F.struct("id", "th", F.col(at).alias("at"))


def _reach(forward: bool, enough: int) -> Column:
    """Lines of the shortest block with enough words that starts (or ends) here;
    null if the lines that occur again end before it has them."""
    within = Wd.partitionBy("id", "th").orderBy("at")
    near = F.collect_list(F.struct("at", "w")).over(within.rowsBetween(0, enough - 1) if forward else within.rowsBetween(1 - enough, 0))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("words"))

    def step(acc: Column, x: Column) -> Column:
        apart = x["at"] - F.col("at") if forward else F.col("at") - x["at"]
        goes_on = (acc["words"] < enough) & (apart == acc["n"])
        return F.struct(
            (acc["n"] + F.when(goes_on, 1).otherwise(0)).alias("n"),
            (acc["words"] + F.when(goes_on, x["w"]).otherwise(0)).alias("words"),
        )

    return F.aggregate(near if forward else F.reverse(near), start, step, lambda acc: F.when(acc["words"] >= enough, acc["n"]))


def repeated_units(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """(id, th, gone): per document the numbers of its units to delete; th is a
    hash of the text, so that rows that share an id stay apart."""
    text = F.col(text_col)
    units = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.split(text, UNITS)).alias("at", "unit"))
    lines = once(units, line=F.regexp_replace("unit", r"^\s+|\s+$", "")).filter("line <> ''")
    ids = written(lines.select(
        "id", "th", "at", F.xxhash64("line").alias("h"), F.hash("line").alias("h2"), _words(F.col("line"), min_words).alias("w"),
    ))

    # Round 0: the class of a line is the first place where it stands.
    first = written(ids.groupBy("h", "h2").agg(F.count("*").alias("n"), F.min(_here()).alias("rank")).filter("n > 1").drop("n"))
    live = written(ids.join(first, ["h", "h2"]).select("id", "th", "at", "w", "rank"))
    gone = live.filter((F.col("w") >= min_words) & (F.col("rank") != _here())).select("id", "th", "at")

    # Blocks of several lines: where short lines that occur again follow each other.
    single = live.groupBy("id", "th", "at").agg(F.min("w").alias("w"), F.min("rank").alias("rank"))
    sized = single.withColumns({"ahead": _reach(True, min_words), "back": _reach(False, min_words)})
    blocks = written(sized.select("id", "th", F.inline(F.array(
        F.struct(F.col("at").alias("at"), F.col("ahead").alias("m")),
        F.struct((F.col("at") - F.col("back") + 1).alias("at"), F.col("back").alias("m")),
    ))).filter("m > 1").distinct())
    inside = blocks.select("id", "th", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")).distinct()
    level = written(join_null_safe(single.select("id", "th", "at", "rank"), inside, ["id", "th", "at"]))

    by_place = Wd.partitionBy("id", "th").orderBy("at")
    for k in range(1, int(math.log2(max(min_words, 1))) + 1):
        half = 1 << (k - 1)
        # Classes of blocks of 2**k lines from those of their halves.
        pairs = level.withColumn("next", F.max("rank").over(by_place.rangeBetween(half, half))).filter("next is not null")
        named = written(pairs.groupBy("rank", "next").agg(F.min(_here()).alias("new")))
        level = written(pairs.join(named, ["rank", "next"]).select("id", "th", "at", F.col("new").alias("rank")))
        # Blocks of 2**k to 2**(k+1)-1 lines: two classed blocks that overlap.
        size = 1 << k
        mine = blocks.filter(f"m >= {size} and m < {2 * size}")
        head = join_null_safe(mine, level, ["id", "th", "at"])
        tail = level.select("id", "th", F.col("at").alias("tail_at"), F.col("rank").alias("tail"))
        both = written(join_null_safe(head.withColumn("tail_at", F.col("at") + F.col("m") - size), tail, ["id", "th", "tail_at"]))
        start = written(both.groupBy("rank", "tail", "m").agg(F.min(_here()).alias("first")))
        copies = written(both.join(start, ["rank", "tail", "m"]).filter(F.col("first") != _here()).select("id", "th", "at", "m"))
        gone = gone.union(copies.select("id", "th", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("at")))
    return gone.groupBy("id", "th").agg(F.collect_set("at").alias("gone"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 10, removed: str = "n_removed_lines",
) -> DataFrame:
    """The documents without the later copies of repeated line runs.

    A run is a sequence of lines (blank ones do not count) with ``min_words``
    words or more in all; lines equal but for outer white space are equal. Of
    equal runs the first in the order (id, text hash, line) stays, in whole; a
    line of any other goes, with the blank lines after it. A text that lost lines
    ends without line breaks. ``removed`` counts the lines that went. No row is
    dropped: a document that is all copies keeps an empty text. Null texts stay
    null; null ids come first; rows that repeat id and text are one document
    and all come out alike. Other columns are kept.
    """
    gone = repeated_units(docs, id_col, text_col, min_words)
    th, at, removed = free_names(docs, ["text_hash", "gone_at", removed])
    found = gone.select(F.col("id").alias("_gid"), F.col("th").alias(th), F.col("gone").alias(at))
    keyed = docs.withColumn(th, F.xxhash64(text_col))
    joined = keyed.join(found, same(keyed[id_col], found["_gid"]) & (keyed[th] == found[th]), "left").drop("_gid", found[th])
    units = F.split(text_col, UNITS)
    stay = F.array_except(F.sequence(F.lit(0), F.size(units) - 1), F.col(at))
    rest = F.rtrim(F.array_join(F.transform(stay, lambda i: F.get(F.col(th), i)), ""), F.lit("\n"))
    cut = once(joined.drop(th), **{th: units})
    return cut.select(
        *[F.when(F.col(at).isNull(), F.col(c)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.coalesce(F.size(at), F.lit(0)).cast("long").alias(removed),
    )
