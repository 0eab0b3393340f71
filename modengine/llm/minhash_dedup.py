"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

Documents with the same shingle set form one class; a class has a signature of
``coordinates`` minima. It posts under its (coordinate, value) pairs, and classes
that collide in at least ``matches`` coordinates are compared on their full sets.

Finding those that collide so often does not need all postings:

- A value that no other class has cannot collide, so it is not posted, and a class
  with fewer than ``matches`` other values has no partner at all.
- Prefix: values stand rarest first. Two classes with enough collisions meet
  already among the first ``s - matches + 1`` of their s shared values, so only those
  are merged, and passages that many documents share stay out.
- Skip: the long lists of the other values are never merged; a pair that has met
  probes them in its two signatures.

A list of m classes is not expanded into its pairs. First every list compares its
leader, the member with the most shared values, with all others; members that come
to one component need no further comparison. Where a list still holds several
components, about four more members and then all others meet the rest of their
list across components. So every pair that could join two components is compared
in the end, on full sets, unless it is plain that it collides too seldom or can't
be similar. The first shows in the lowest bits of the two signatures, where equal
values agree; so members of a long list that share little but a few passages make
no pairs. The second shows in sizes and bitmaps of the sets: a bit that only one of
two sets has stands for a shingle that only this one has. Where all members of a
list meet, a pair is made in the first list that holds both: a posting names the
lists before it, and the pair is passed over where both name the same one.

The sets decide: a link has |intersection| / |union| of at least ``percent``. A pair
at exactly 0.8 collides in fewer than 32 of 64 coordinates with a probability of
2e-8, a more similar one less often.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .common import components, written

BITMAP = 16  # long integers
PLANES = 4  # lowest bits of a coordinate
BEFORE = 8  # lists that a posting names
FEW_BODIES = 500_000  # hashes of eight bytes that are broadcast
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class Shingles:
    """Shingle sets as sorted 64-bit hashes, made of the hashes of the words."""

    def __init__(self, words: int, keep: int = 500_000):
        rng = np.random.default_rng(words)
        self.words, self.keep, self.known = words, keep, {}
        self.weights = np.concatenate([_MIX, rng.integers(1, 1 << 62, max(0, words - len(_MIX))).astype(np.uint64) | np.uint64(1)])[:words]

    def _hashes(self, parts: list[bytes]) -> np.ndarray:
        known = self.known
        new = set(parts).difference(known)
        if new:
            if len(known) + len(new) > self.keep:
                known.clear()
                new = set(parts)
            digest = xxhash.xxh64_intdigest
            known.update((w, digest(w, 42)) for w in new)
        return np.fromiter(map(known.__getitem__, parts), dtype=np.uint64, count=len(parts))

    def __call__(self, text: str | None) -> np.ndarray:
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not parts:
            return np.empty(0, dtype=np.uint64)
        each = self._hashes(parts)
        n = max(len(each) - self.words + 1, 1)
        total = np.full(n, len(each) if len(each) < self.words else self.words, dtype=np.uint64)
        for k, w in enumerate(self.weights[:len(each)]):
            total += each[k:k + n] * w
        total ^= total >> np.uint64(29)
        total *= _MIX[1]
        return np.unique(total ^ (total >> np.uint64(32)))


def signature(hashes: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """Per coordinate the least 32-bit value."""
    least = np.full(len(multipliers), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at:at + 2048, None] * multipliers).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """The set folded to ``64 * BITMAP`` bits."""
    bits = np.zeros(64 * BITMAP, dtype=np.uint8)
    bits[(hashes >> np.uint64(7)) % np.uint64(len(bits))] = 1
    return np.packbits(bits).view(np.int64)


def planes(signatures: pd.Series) -> list[np.ndarray]:
    """The lowest bits of every signature, one bit of 64 coordinates a long; unused
    places are zero."""
    out = []
    for values in signatures:
        bits = (np.asarray(values)[None, :] >> np.arange(PLANES)[:, None] & 1).astype(np.uint8)
        out.append(np.packbits(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 64))), axis=1).view(np.int64).ravel())
    return out


def signed_documents(docs: DataFrame, id_col: str, text_col: str, words: int, coordinates: int) -> DataFrame:
    """(id, body, n, class, signature) per row; body is a hash of the text, class
    names the set by 128 bits and is null for a text without words."""
    multipliers = np.random.default_rng(11).integers(0, 1 << 63, coordinates).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    @F.pandas_udf("n long, class binary, signature array<int>")
    def signed(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for part in parts:
            rows = []
            for text in part:
                found = shingles(text)
                if len(found):
                    rows.append((len(found), xxhash.xxh128_digest(found.tobytes()), signature(found, multipliers)))
                else:
                    rows.append((0, None, None))
            yield pd.DataFrame(rows, columns=["n", "class", "signature"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), signed(text).alias("s")).select("id", "body", "s.*")


def full_sets(docs: DataFrame, text_col: str, own: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """(class, hashes, signature, bits, planes) of the classes in ``needed``; the shingles
    are cut again from one text of each, and only these texts are moved."""
    @F.pandas_udf("class binary, hashes array<long>, bits array<long>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingles = Shingles(words)
        for part in parts:
            sets = [shingles(text) for text in part]
            yield pd.DataFrame({
                "class": [xxhash.xxh128_digest(x.tobytes()) for x in sets], "hashes": [x.view(np.int64) for x in sets],
                "bits": [bitmap(x) for x in sets],
            })

    @F.pandas_udf("array<long>")
    def lowest(part: pd.Series) -> pd.Series:
        return pd.Series(planes(part))

    # Texts of equal hash give equal sets or, if ever, sets of classes of their own.
    kept = written(own.join(needed, "class", "left_semi").groupBy("class").agg(F.min("body").alias("body"), F.first("signature").alias("signature")))
    bodies = written(kept.select("body").distinct())
    # Broadcast while that takes a few megabytes; beyond it the texts meet their hashes in a shuffle.
    few = F.broadcast(bodies) if bodies.count() <= FEW_BODIES else bodies
    texts = docs.select(F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).join(few, "body", "left_semi")
    one = texts.groupBy("body").agg(F.first("text").alias("text"))
    sets = one.select(found("text").alias("s")).select("s.*").groupBy("class").agg(F.first("hashes").alias("hashes"), F.first("bits").alias("bits"))
    return sets.join(kept.select("class", "signature", lowest("signature").alias("planes")), "class")


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """(key, class, n, shared): the prefix of every class's values that others have
    as well, rarest first; ``shared`` is how many such values it has."""
    rows = classes.select("class", F.posexplode("signature").alias("at", "value"))
    rows = rows.select("class", (F.shiftleft(F.col("at").cast("long"), 32) + F.col("value")).alias("key"))
    # Most values are unique; written, the others are small and the join may be split.
    often = written(rows.groupBy("key").agg(F.count("*").alias("df")).filter("df > 1"))
    held = rows.join(often, "key").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("held"))
    held = held.filter(F.size("held") >= matches).select("class", F.size("held").alias("shared"), F.expr(f"slice(held, 1, size(held) - {matches - 1})").alias("prefix"))
    return held.join(classes.select("class", "n"), "class").select(F.explode("prefix.key").alias("key"), "class", "n", "shared")


def share_of(name: str) -> Column:
    """A uniform number in [0, 1) drawn from the class."""
    return F.pmod(F.xxhash64(name), F.lit(1 << 52)) / float(1 << 52)


def may_link(percent: int) -> Column:
    """Whether the sets a and b can be that similar, by their sizes (n_a, n_b) and
    bitmaps (bits_0_a, …)."""
    only = lambda x, y: sum((F.bit_count(F.col(f"bits_{i}_{x}").bitwiseAND(F.bitwise_not(f"bits_{i}_{y}"))) for i in range(BITMAP)), F.lit(0))
    enough = lambda most: most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent
    sizes = F.least(F.col("n_a"), F.col("n_b")) * 100 >= F.greatest(F.col("n_a"), F.col("n_b")) * percent
    return sizes & enough(F.col("n_a") - only("a", "b")) & enough(F.col("n_b") - only("b", "a"))


def may_collide(coordinates: int, matches: int) -> Column:
    """Whether a and b can collide so often, by the lowest bits of their signatures
    (planes_0_a, …): equal values agree in all of them."""
    words = -(-coordinates // 64)
    agree = F.lit(words * -64 + coordinates)  # unused places always agree
    for w in range(words):
        differ = [F.col(f"planes_{p * words + w}_a").bitwiseXOR(F.col(f"planes_{p * words + w}_b")) for p in range(PLANES)]
        agree += F.bit_count(F.bitwise_not(reduce(Column.bitwiseOR, differ)))
    return agree >= matches


def confirmed(pairs: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """The pairs (a, b, n_a, n_b) with enough collisions and similar full sets."""
    def both(rows: DataFrame, column: str) -> DataFrame:
        for side in ("b", "a"):
            rows = rows.join(sets.select(F.col("class").alias(side), F.col(column).alias(f"{column}_{side}")), side)
        return rows

    alike = F.filter(F.zip_with("signature_a", "signature_b", lambda x, y: x == y), lambda x: x)
    met = both(pairs, "signature").filter(F.size(alike) >= matches)
    met = both(met.select("a", "b", "n_a", "n_b"), "hashes")
    common = F.size(F.array_intersect("hashes_a", "hashes_b"))
    met = met.select("a", "b", "n_a", "n_b", common.alias("common"))
    return met.filter(F.col("common") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("common")) * percent).select("a", "b")


def _open_lists(posted: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, class, n, shared, root, m): the postings of the lists that hold several
    components, with the component and the size of the list."""
    if roots is None:
        rows = posted.withColumn("root", F.col("class"))
    else:
        rows = posted.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    rows = written(rows)
    lists = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"))
    return written(rows.join(written(lists.filter("low <> high").select("key", "m")), "key"))


def _meet(rows: DataFrame, leads: Column, sets: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """Different pairs (a, b, n_a, n_b) of a leader and another row of its list in
    another component that may link."""
    if "before" not in rows.columns:
        rows = rows.withColumn("before", F.array().cast("array<long>"))
    # Never null: without null checks the condition is small enough to be compiled.
    flat = {"planes": PLANES * -(-coordinates // 64), "bits": BITMAP}
    bits = sets.select("class", *[F.coalesce(F.col(c)[i], F.lit(0)).alias(f"{c}_{i}") for c, n in flat.items() for i in range(n)])
    whole = rows.select("key", "class", "n", "root", "before", leads.alias("leads")).join(bits, "class")
    names = ["n", "root", "before", "leads", *bits.columns[1:]]
    side = lambda of, x: of.select("key", F.col("class").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])
    met = side(whole.filter("leads"), "a").join(side(whole, "b"), "key")
    met = met.filter((F.col("root_a") != F.col("root_b")) & ((F.col("a") < F.col("b")) | ~F.col("leads_b")))
    met = met.filter(may_collide(coordinates, matches) & may_link(percent) & ~F.arrays_overlap("before_a", "before_b"))
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return met.select(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b")).distinct()


def _after_others(rows: DataFrame) -> DataFrame:
    """(key, class, n, root, before): the postings with up to ``BEFORE`` lists of the
    class that come before theirs. The least list of two classes is named by neither
    with another that both have."""
    held = rows.groupBy("class").agg(F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_list("key")).alias("held"))
    each = held.select("class", "n", "root", "held", F.posexplode("held").alias("at", "key"))
    before = F.slice("held", F.greatest(F.col("at") - BEFORE, F.lit(0)) + 1, F.least(F.col("at"), F.lit(BEFORE)))
    return each.select("key", "class", "n", "root", before.alias("before"))


def class_links(sets: DataFrame, posted: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame | None:
    """(node, root): the components of the classes that have a link; None without links."""
    links, roots = None, None

    def compare(rows: DataFrame, leads: Column) -> None:
        nonlocal links, roots
        pairs = written(_meet(rows, leads, sets, coordinates, matches, percent))
        if pairs.isEmpty():
            return
        found = written(confirmed(pairs, sets, matches, percent))
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            roots = written(components(sets.sparkSession, links))

    rows = _open_lists(posted, None)
    order = F.struct((-F.col("shared")).alias("order"), share_of("class").alias("share"), F.col("class"))
    heads = written(rows.groupBy("key").agg(F.min(order).alias("head")).select("key", F.col("head.class").alias("head")))
    compare(rows.join(heads, "key"), F.col("class") == F.col("head"))
    at = share_of("class") * F.col("m")  # of m members, those below 4 lead first, then all others
    rows = _open_lists(rows.drop("root", "m"), roots)
    if not rows.isEmpty():
        compare(rows, at < 4)
        rows = _open_lists(rows.drop("root", "m"), roots)
        compare(_after_others(rows.filter(at >= 4)), F.lit(True))
    return roots


def minhash_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, coordinates: int = 64,
    matches: int = 32,
) -> DataFrame:
    """One row per document: the id, ``n_shingles`` (size of its set of ``words``-word
    shingles), ``component_id`` (the smallest id reachable over links, its own
    included) and ``kept`` (whether that is its own).

    A-Z are lower-cased; words are runs without ASCII white space; a text with
    fewer words is one shingle. Texts without words, null ones too, have no
    shingles and link with nothing. Rows that repeat an id stay rows of their own.
    A null id names a component only if no member has an id. Other columns are
    not read; an empty table gives an empty table.
    """
    rows = written(signed_documents(docs, id_col, text_col, words, coordinates))
    own = rows.filter("class is not null")
    classes = written(own.groupBy("class").agg(F.first("n").alias("n"), F.first("signature").alias("signature")))
    posted = written(postings(classes, matches))
    needed = posted.select("class").distinct()
    sets = written(full_sets(docs, text_col, own, written(needed), words))
    roots = class_links(sets, posted, coordinates, matches, percent)
    named = own.select("id", "n", "class")
    if roots is not None:
        named = named.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("class", F.coalesce("root", "class")).drop("root")
    least = written(named.groupBy("class").agg(F.min("id").alias("component_id")))
    out = named.join(least, "class").select("id", "n", "component_id")
    out = out.unionByName(rows.filter("class is null").select("id", "n", F.col("id").alias("component_id")))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
