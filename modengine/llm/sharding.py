"""Shards that keep equal texts together and hold the same number of rows.

Documents with equal texts are linked. All a round of label propagation needs is
how many members of a group each shard holds, so the labels live on rows (group,
shard, members), never on pairs. In every round a join finds for each group the
shard that most members are in, its members elsewhere ask to move there, and
the quota of the shard admits them in hashed order until it is full. Groups with
one member have no links and never ask. After the rounds, shards above their
size give rows to those below it, rows without links first, so that row counts
differ by one at most.

Hot groups: counts are combined before they are shuffled; a group larger than a
shard fills several shards. Rows are numbered in buckets, never by a window over
a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as Wd, functions as F

from .common import numbered, written


def _uniform(*cols: str) -> Column:
    """Uniform double in [0, 1) drawn from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def _capacity(spark: SparkSession, total: int, shards: int) -> DataFrame:
    return spark.range(shards).select(
        F.col("id").cast("int").alias("shard"),
        (F.lit(total // shards) + F.when(F.col("id") < total % shards, 1).otherwise(0)).cast("long").alias("room"),
    )


def propagate(members: DataFrame, shards: int, room: int, rounds: int = 4) -> DataFrame:
    """(grp, shard, n) after the rounds, from (grp, shard, n); ``room`` is how many
    rows a shard may hold while labels move."""
    labels = members.withColumn("h", F.xxhash64("grp", "shard"))
    for step in range(rounds):
        held = labels.groupBy("shard").agg(F.sum("n").alias("held"))
        # The most members win among the shards with room; of equal counts the one
        # with the larger hash, so that ties do not pile up in one shard. Only
        # members in shards that hold fewer move: full shards keep what they have.
        sides = labels.join(held, "shard").groupBy("grp").agg(
            F.collect_list(F.struct("n", "h", "shard", (F.col("held") < room).alias("open"))).alias("sides"),  # at most one for each shard
        )
        best = sides.withColumn("best", F.array_max(F.filter("sides", lambda x: x["open"]))).filter("best is not null")
        fewer = F.filter("sides", lambda x: x < F.col("best"))
        asks = best.select(
            "grp", F.col("best.shard").alias("shard"), F.col("best.n").alias("best_n"), F.col("best.h").alias("best_h"),
            F.aggregate(fewer, F.lit(0).cast("long"), lambda acc, x: acc + x["n"]).alias("wants"),
        ).filter("wants > 0").withColumn("slice", F.floor(_uniform("grp") * 4096).cast("int"))
        # Running sums in two steps: slices of a shard, then groups inside a slice.
        sums = asks.groupBy("shard", "slice").agg(F.sum("wants").alias("w"))
        over = Wd.partitionBy("shard").orderBy("slice").rowsBetween(Wd.unboundedPreceding, -1)
        starts = sums.select("shard", "slice", F.coalesce(F.sum("w").over(over), F.lit(0)).alias("before"))
        inside = Wd.partitionBy("shard", "slice").orderBy("grp").rowsBetween(Wd.unboundedPreceding, -1)
        queue = asks.join(starts, ["shard", "slice"]).withColumn("before", F.col("before") + F.coalesce(F.sum("wants").over(inside), F.lit(0)))
        quota = queue.join(held, "shard").withColumn("free", F.lit(room) - F.col("held") - F.col("before"))
        moves = quota.withColumn("take", F.least("wants", "free")).filter("take > 0")
        moves = written(moves.select("grp", F.col("shard").alias("to"), "best_n", "best_h", "take"))
        # Members leave the shards that hold fewest until ``take`` of them have moved.
        joined = labels.join(moves, "grp", "left")
        before = Wd.partitionBy("grp").orderBy("n", "h").rowsBetween(Wd.unboundedPreceding, -1)
        less = (F.col("n") < F.col("best_n")) | ((F.col("n") == F.col("best_n")) & (F.col("h") < F.col("best_h")))
        away = F.when(less, F.col("n")).otherwise(0)
        seen = joined.withColumn("seen", F.coalesce(F.sum(away).over(before), F.lit(0)))
        leave = F.greatest(F.lit(0), F.least(away, F.coalesce("take", F.lit(0)) - F.col("seen")))
        stay = seen.select("grp", "shard", (F.col("n") - leave).alias("n"), "h")
        come = moves.select("grp", F.col("to").alias("shard"), F.col("take").alias("n"), F.col("best_h").alias("h"))
        labels = written(stay.unionByName(come).groupBy("grp", "shard", "h").agg(F.sum("n").alias("n")).filter("n > 0"))
    return labels.drop("h")


def shard(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int = 4,
) -> DataFrame:
    """One row per document: the id, ``size`` (UTF-8 bytes plus 1), ``text_crc32``,
    ``law`` ("rows"), ``shard``, ``slot`` (gapless from 0 in its shard) and
    ``grown_shard`` (null: the law is not by key).

    A null text counts as empty. Row counts of shards differ by at most one; the
    first shards take the rest. Every row is placed, repeated ones too; which of
    several equal rows gets which slot is arbitrary. Null ids are placed like
    others. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = written(docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.md5(raw).alias("grp"),
    ))
    total = rows.count()
    room = -(-total // shards)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    start = F.pmod(F.xxhash64("id", "grp"), F.lit(shards)).cast("int")
    linked = sizes.filter("n > 1")
    members = rows.join(linked.select("grp"), "grp", "left_semi").groupBy("grp", start.alias("shard")).agg(F.count("*").alias("n"))
    # While labels move, a shard may take as many linked rows as it holds rows in the end.
    labels = propagate(written(members), shards, room, rounds)

    # Which member of a group goes where: members are numbered, shards take ranges.
    over = Wd.partitionBy("grp").orderBy("shard").rowsBetween(Wd.unboundedPreceding, -1)
    ranges = labels.select("grp", "shard", "n", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("from"))
    counted = rows.join(linked, "grp", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    many = numbered(written(counted.filter("n > 1").drop("n")), ["grp"], _uniform("id"), ["id"], "place")
    many = many.join(ranges, "grp").filter("place >= from and place < from + n").select("id", "size", "text_crc32", "grp", "shard", F.lit(1).alias("linked"))
    ones = counted.filter("n = 1").select("id", "size", "text_crc32", "grp", start.alias("shard"), F.lit(0).alias("linked"))
    placed = written(many.unionByName(ones))

    # Even counts: rows beyond a shard's size fill the gaps of the others in turn.
    spread = F.when(F.col("linked") == 1, _uniform("grp") * F.col("share")).otherwise(F.col("share") + _uniform("id", "grp") * (1 - F.col("share")))
    share = placed.groupBy("shard").agg(F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), F.avg("linked"))).alias("share"))
    ordered = numbered(placed.join(share, "shard"), ["shard"], spread, [F.desc("linked"), "grp", "id"], "slot")
    return _even(spark, written(ordered.drop("share")), total, shards, id_col)


def _even(spark: SparkSession, ordered: DataFrame, total: int, shards: int, id_col: str) -> DataFrame:
    target = _capacity(spark, total, shards)
    held = ordered.groupBy("shard").agg(F.count("*").alias("held"))
    table = target.join(held, "shard", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    order = Wd.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Wd.unboundedPreceding, -1)  # as many rows as shards
    plus, minus = F.greatest(F.col("held") - F.col("room"), F.lit(0)), F.greatest(F.col("room") - F.col("held"), F.lit(0))
    table = table.withColumns({
        "given": F.coalesce(F.sum(plus).over(order), F.lit(0)), "taken": F.coalesce(F.sum(minus).over(order), F.lit(0)), "gap": minus,
    })
    sides = written(table)
    with_room = ordered.join(sides.select("shard", "room", "given"), "shard")
    stay = with_room.filter("slot < room").select("id", "size", "text_crc32", "shard", "slot")
    move = with_room.filter("slot >= room").withColumn("turn", F.col("given") + F.col("slot") - F.col("room"))
    gaps = sides.filter("gap > 0").select(F.col("shard").alias("to"), "held", "taken", "gap")
    # One row per shard at most, so an array of them fits beside every row.
    holes = gaps.agg(F.sort_array(F.collect_list(F.struct("taken", "gap", "to", "held"))).alias("holes")).scalar()
    found = move.withColumn("holes", holes)
    found = found.withColumn("hole", F.filter("holes", lambda h: (h["taken"] <= F.col("turn")) & (F.col("turn") < h["taken"] + h["gap"]))[0])
    moved = found.select("id", "size", "text_crc32", F.col("hole.to").alias("shard"), (F.col("hole.held") + F.col("turn") - F.col("hole.taken")).alias("slot"))
    return stay.unionByName(moved).select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
