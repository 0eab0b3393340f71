"""Near-duplicate documents by SimHash fingerprints and vantage-point trees.

A fingerprint is the bitwise majority over the XXH64 hashes of all word shingles
of the whole text. Two fingerprints link when at most ``max_bits`` bits differ;
components of links are the groups.

Search. Whole 64-bit distances of unrelated texts crowd around 32, so shells that
overlap by ``max_bits`` would hold nearly everything. The fingerprints therefore
stand in ``max_bits // 2 + 1`` trees, each measuring the Hamming distance over one
block of bits: two fingerprints within ``max_bits`` differ in at most ``slack`` (0 or
1) bits of at least one block. A node that holds more than ``shard`` fingerprints
takes some of its members as vantage points and splits at the median distance from
each: near holds the distances up to the median plus ``slack``, far those above the
median. By the triangle inequality a pair within ``slack`` stands in one of the two
together; only the rows on the boundary go to both. All nodes of a level are split
by the same Spark jobs, whose aggregates are combined before the shuffle, and every
level is written. A node that its vantage points do not divide (one pattern of the
block, many fingerprints) is cut into blocks that meet in every pair of blocks.
Inside a task the members of a shard stand sorted by distance to a vantage point,
and only those whose distances differ by ``max_bits`` or less are compared. A task
returns a spanning forest of the links it found, never all pairs; the components
are unchanged.

Exact: no link is lost, and every pair is checked with all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, free_names, written


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash of the text; 0 for a text without words.

    A-Z are lower-cased; words are runs of anything but ASCII white space;
    shingles of ``words`` words, repeats included, joined by a space (a shorter
    text is one shingle)."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    n = len(parts) - words + 1
    joined = b" ".join(parts)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist())]
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65_536):
        block = np.array(hashes[at:at + 65_536], dtype=">u8")
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprint_udf(words: int):
    """Fingerprints as signed 64-bit integers, the whole text each."""

    @F.pandas_udf("long")
    def signed(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in part], dtype=np.uint64).view(np.int64))

    return signed


def blocks_of(max_bits: int) -> list[int]:
    """Bit masks of ``max_bits // 2 + 1`` blocks over the 64 bits, sizes at most one apart."""
    n = max_bits // 2 + 1
    cuts = [round(i * 64 / n) for i in range(n + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def local_links(values: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Spanning forest of the links among distinct fingerprints: vantage point
    first, shells by distance, comparisons only where the triangle bound allows."""
    values = np.unique(values)
    n = len(values)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    bits = values.view(np.uint64)
    from_vantage = np.bitwise_count(bits ^ bits[0])
    order = np.argsort(from_vantage, kind="stable")
    bits, far, out = bits[order], from_vantage[order].astype(np.int64), []
    until = np.searchsorted(far, far + max_bits, side="right")
    for i in range(n - 1):
        others = bits[i + 1:until[i]]
        for j in np.flatnonzero(np.bitwise_count(others ^ bits[i]) <= max_bits):
            a, b = root(i), root(i + 1 + int(j))
            if a != b:
                parent[b] = a
                out.append((int(bits[i].view(np.int64)), int(others[j].view(np.int64))))
    return out


def vantage_shards(fps: DataFrame, max_bits: int = 4, shard: int = 4096, points: int = 3) -> DataFrame:
    """(tree, node, n, fp): the leaves of the trees over the distinct fingerprints
    ``fp`` and their sizes. Any two within ``max_bits`` share a leaf. Leaves hold at
    most ``shard`` fingerprints, but for those that ``points`` vantage points left at
    more than nine tenths of their parent."""
    masks, keys = blocks_of(max_bits), ["tree", "node"]
    slack = max_bits // len(masks)
    trees = [F.struct(F.lit(t).alias("tree"), F.lit(_signed(m)).alias("mask")) for t, m in enumerate(masks)]
    rows = fps.select("fp", F.inline(F.array(*trees)), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"))
    leaves = []
    while True:
        rows = written(rows)
        sizes = written(rows.groupBy(*keys).agg(
            F.count("*").alias("n"), F.max("parent").alias("parent"),
            *[F.min_by("fp", F.xxhash64("fp", F.lit(p))).alias(f"v{p}") for p in range(points)],
        ))
        ends = (F.col("n") <= shard) | F.coalesce(F.col("n") * 10 > F.col("parent") * 9, F.lit(False))
        rows = rows.drop("parent")
        leaves.append(written(rows.join(sizes.filter(ends).select(*keys, "n"), keys).select(*keys, "n", "fp")))
        large = sizes.filter(~ends).drop("parent")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, leaves)
        far = {f"d{p}": F.bit_count((F.col("fp").bitwiseXOR(F.col(f"v{p}"))).bitwiseAND(F.col("mask"))) for p in range(points)}
        # The median, but never so far out that near is the whole node.
        cuts = written(rows.join(large, keys).withColumns(far).groupBy(*keys, "n", *[f"v{p}" for p in range(points)]).agg(*[
            F.least(F.percentile_approx(f"d{p}", 0.5), F.max(f"d{p}") - slack - 1).alias(f"m{p}") for p in range(points)
        ]))
        inside = rows.join(cuts, keys).withColumns(far)

        def belongs(child: int) -> Column:
            sides = [F.col(f"d{p}") > F.col(f"m{p}") if child >> p & 1 else F.col(f"d{p}") <= F.col(f"m{p}") + slack for p in range(points)]
            return F.when(reduce(lambda a, b: a & b, sides), F.lit(child))

        children = F.array_compact(F.array(*[belongs(c) for c in range(1 << points)]))
        rows = inside.select("fp", "tree", "mask", "node", F.col("n").alias("parent"), F.explode(children).alias("child"))
        rows = rows.withColumn("node", F.xxhash64("node", "child")).drop("child")


def fingerprint_links(fps: DataFrame, max_bits: int = 4, shard: int = 4096) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` (long) that connect
    exactly the components of all pairs within ``max_bits`` bits."""
    keys = ["tree", "node"]
    leaves = vantage_shards(fps, max_bits, shard).filter("n > 1")
    small = leaves.filter(F.col("n") <= shard).select(*keys, F.lit("").alias("part"), "fp")
    # Leaves that no vantage point divides: blocks, each with each.
    large = leaves.filter(F.col("n") > shard).withColumn("k", F.ceil(F.col("n") / shard).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    meets = F.transform(
        F.sequence(F.lit(0), F.col("k") - 1),
        lambda other: F.concat_ws(".", F.least(other, F.col("block")), F.greatest(other, F.col("block"))),
    )
    return _forests(small, large.select(*keys, F.explode(meets).alias("part"), "fp"), max_bits)


def _forests(small: DataFrame, large: DataFrame, max_bits: int) -> DataFrame:
    arrays = small.unionByName(large).groupBy("tree", "node", "part").agg(F.collect_list("fp").alias("fps"))

    @F.pandas_udf("array<struct<a:long,b:long>>")
    def forests(lists: pd.Series) -> pd.Series:
        out = []
        for members in lists:
            if len(members) == 2:
                a, b = np.asarray(members, dtype=np.int64).view(np.uint64)
                hit = int(a ^ b).bit_count() <= max_bits
                out.append([{"a": int(members[0]), "b": int(members[1])}] if hit else [])
            else:
                out.append([{"a": a, "b": b} for a, b in local_links(np.asarray(members, dtype=np.int64), max_bits)])
        return pd.Series(out)

    return arrays.select(F.inline(forests("fps"))).distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, th, fp) and, for every fingerprint, its component's first row
    (``first``: no_id, id, th); th is a hash of the text."""
    text = F.col(text_col)
    rows = written(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("th"), fingerprint_udf(words)(text).alias("fp")))
    first = F.struct(F.col("id").isNull().alias("no_id"), "id", "th")
    fps = written(rows.groupBy("fp").agg(F.min(first).alias("first")))
    roots = components(docs.sparkSession, fingerprint_links(fps.select("fp"), max_bits))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    named = written(named.select("fp", "root", "first"))
    return rows, named.select("fp", "root").join(named.groupBy("root").agg(F.min("first").alias("first")), "root").drop("root")


def simhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (16 hex digits) and
    ``component_id``, the smallest id reachable over links, its own included.

    A null text counts as empty; texts without words have fingerprint 0 and are
    linked like any other. Rows that repeat an id stay rows of their own. A null
    id names a component only if no member has an id. An empty table gives an
    empty table; other columns are not read.
    """
    rows, firsts = _grouped(docs, id_col, text_col, words, max_bits)
    return rows.join(firsts, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("first.id").alias("component_id"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each group, the one with the smallest id, with all its
    columns. Of rows that repeat both id and text one stays."""
    _, firsts = _grouped(docs, id_col, text_col, words, max_bits)
    (key,) = free_names(docs, ["row_key"])
    stays = firsts.select(F.concat_ws(":", F.col("first.id").cast("string"), F.col("first.th")).alias(key)).distinct()
    keyed = docs.withColumn(key, F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col)))
    return keyed.join(stays, key, "left_semi").dropDuplicates([key]).drop(key)
