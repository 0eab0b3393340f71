"""Exact top-k search by inner product with two cover trees.

Vectors and queries are indexed together. The upper level is one net of centres,
chosen far from each other on a bounded sample; every vector belongs to its
nearest centre, and the balls of a centre are cut into nodes of bounded size. A
node keeps its covering radius. For a query group with centre c and radius s, and
a node with centre x and radius r, no product exceeds
``c.x + |c| r + |x| s + r s``; a pair of nodes below the group's worst kth score is
pruned. Every query first meets the nodes of its own centre, which gives that
score; the surviving pairs of the upper level follow from the radii alone. Inside
a task both sides are split into small cover-tree nodes and pruned the same way,
best bound first, while the worst kth score rises.

Scores are exact whole numbers; bounds are widened for rounding, so nothing that
could count is pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as Wd, functions as F

from .common import written

NODE = 64  # vectors of the lowest nodes


def net(points: np.ndarray, n: int) -> np.ndarray:
    """Indices of at most ``n`` points, each farthest from those before it: the
    centres of one level of a cover tree."""
    chosen = [0]
    gap = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(points)):
        far = int(gap.argmax())
        if gap[far] <= 0:
            break
        chosen.append(far)
        gap = np.minimum(gap, ((points - points[far]) ** 2).sum(axis=1))
    return np.array(chosen)


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of every point; the first of equals."""
    out = np.empty(len(points), dtype=np.int64)
    norms = (centres ** 2).sum(axis=1)
    for at in range(0, len(points), 4096):
        out[at:at + 4096] = (norms - 2 * points[at:at + 4096] @ centres.T).argmin(axis=1)
    return out


class Level:
    """The lowest nodes of one block of vectors."""

    def __init__(self, points: np.ndarray):
        centres = points[net(points, max(1, len(points) // NODE))]
        at = nearest(points, centres)
        self.members = [m for m in (np.flatnonzero(at == c) for c in range(len(centres))) if len(m)]
        self.centre = np.array([points[m].mean(axis=0) for m in self.members])
        self.radius = np.array([np.sqrt(((points[m] - c) ** 2).sum(axis=1).max()) for m, c in zip(self.members, self.centre)])


def bound(c, s, x, r):
    """Largest product of a vector within s of c and one within r of x."""
    cn, xn = np.sqrt((c ** 2).sum(axis=-1)), np.sqrt((x ** 2).sum(axis=-1))
    exact = c @ x.T + cn[:, None] * r[None, :] + s[:, None] * xn[None, :] + s[:, None] * r[None, :]
    return exact + 1e-6 * (1 + np.abs(exact))


def search(q_ids, queries, worst, ids, data, copies, k: int) -> Iterator[tuple[int, int, int]]:
    """(place of the query, vector, score): the k best rows of this block for every
    query, as far as they reach the query's ``worst`` score; ties go to the smaller
    vector id. A vector stands for ``copies`` rows; one of them may be the query."""
    q_level, d_level = Level(queries), Level(data)
    bounds = bound(q_level.centre, q_level.radius, d_level.centre, d_level.radius)
    exact_ints = np.abs(queries).max(initial=0) * np.abs(data).max(initial=0) * max(1, data.shape[1]) >= 2 ** 53
    for g, members in enumerate(q_level.members):
        floor = worst[members].astype(np.float64).copy()
        best: list[list[tuple[int, int]]] = [[] for _ in members]
        for node in np.argsort(-bounds[g]):
            if bounds[g, node] < floor.min():
                break
            rows = d_level.members[node]
            if exact_ints:
                left, right = queries[members].astype(np.int64).astype(object), data[rows].astype(np.int64).astype(object)
                scores = left @ right.T
            else:
                scores = queries[members] @ data[rows].T
            for i, q in enumerate(members):
                hits = np.flatnonzero(scores[i] >= floor[i])
                if len(hits):
                    found = best[i]
                    for j in hits:
                        at = rows[j]
                        own = ids[at] == q_ids[q] and np.array_equal(data[at], queries[q])
                        found = found + [(-int(scores[i][j]), int(ids[at]))] * min(k, int(copies[at]) - own)
                    best[i] = sorted(found)[:k]
                    if len(best[i]) == k:
                        floor[i] = max(floor[i], float(-best[i][-1][0]))
        for i, q in enumerate(members):
            for score, vec in best[i]:
                yield int(q), vec, -score


def whole_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v, copies): floor(scale * x) of every component as double; vectors that
    are null or hold null or non-finite components, and null ids, take no part.
    Rows that share an id and a vector are counted; other rows of one id stay apart."""
    x = F.transform(vec_col, lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    fit = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform(vec_col, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return fit.select(F.col(id_col).cast("long").alias("id"), whole.alias("v")).groupBy("id", "v").agg(F.count("*").alias("copies"))


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256,
    centres: int = 64, sample: int = 4096, block: int = 4096,
) -> DataFrame:
    """query_id, rank, vec_id, score: for every vector whose id is divisible by
    ``every`` its ``k`` best others (all, if fewer) by inner product of
    floor(``scale`` * component); ties go to the smaller id.

    Every row is a candidate and, by its id, a query; a row is never its own answer,
    but other rows of its id are. Only vectors of equal length meet. At most ``centres`` centres are chosen on at
    most ``sample`` vectors; every vector is indexed and searched, so the sample
    shapes the tree and never the result. ``block`` bounds the rows of a task's
    side. An empty table gives no rows. Scores are exact below 2**63.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, id_col, vec_col, scale))
    picked = rows.orderBy(F.xxhash64("id")).limit(sample).select("v").toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in picked:
        by_dim.setdefault(len(v), []).append(np.asarray(v, dtype=np.float64))
    nets = {n: (p := np.array(v).reshape(len(v), n))[net(p, centres)] for n, v in by_dim.items()}
    shared = spark.sparkContext.broadcast(nets)  # at most ``centres`` vectors for each length in the sample

    @F.pandas_udf("int")
    def home(parts: pd.Series) -> pd.Series:
        out = np.zeros(len(parts), dtype=np.int32)
        lengths = np.array([len(v) for v in parts])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n and n in shared.value:
                out[at] = nearest(np.array([parts.iloc[i] for i in at], dtype=np.float64), shared.value[n])
        return pd.Series(out)

    placed = written(rows.select("id", "v", "copies", F.size("v").alias("dim"), home("v").alias("ball")))
    keys = ["dim", "ball"]
    sizes = placed.groupBy(*keys).agg(
        F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.ceil(F.count_if(F.col("id") % every == 0) / block).cast("int").alias("q_blocks"),
    )
    cut = placed.join(sizes, keys)
    data = cut.select(*keys, "id", "v", "copies", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("part"))
    queries = cut.filter(F.col("id") % every == 0).select(*keys, "id", "v", F.xxhash64("v").alias("vh"), "copies", F.pmod(F.xxhash64("id"), "q_blocks").cast("int").alias("q_part"))
    own = queries.select(*keys, F.col("ball").alias("q_ball"), "q_part", "id", "v", "vh", "copies", F.lit(None).cast("long").alias("worst"))
    first = written(_meet(spark, data, own, sizes, k))

    # Worst kth score, centre and radius of every query group and data node; at
    # most ``centres`` of each for every length, whatever the number of rows.
    kth = first.groupBy("query", "qh").agg(F.when(F.count("*") >= k, F.min("score")).alias("worst"))
    judged = written(queries.join(kth, (queries["id"] == kth["query"]) & (queries["vh"] == kth["qh"]), "left").select(*keys, "q_part", "id", "v", "vh", "copies", "worst"))
    nodes = _nodes(data, shared).select("dim", F.col("ball"), F.col("radius"))
    groups = _nodes(judged, shared).join(
        judged.groupBy(*keys).agg(F.when(F.count("worst") == F.count("*"), F.min("worst")).alias("worst")), keys,
    )
    pairs = []
    node_rows, group_rows = nodes.collect(), groups.collect()
    for dim in {r["dim"] for r in group_rows}:
        if not dim:
            continue
        d_side, q_side = [r for r in node_rows if r["dim"] == dim], [r for r in group_rows if r["dim"] == dim]
        at = lambda rs: (_centres(shared.value, dim, [r["ball"] for r in rs]), np.array([r["radius"] for r in rs]))
        c, s = at(q_side)
        x, r = at(d_side)
        for i, j in np.argwhere(bound(c, s, x, r) >= np.array([-np.inf if g["worst"] is None else g["worst"] for g in q_side])[:, None]):
            if q_side[i]["ball"] != d_side[j]["ball"]:
                pairs.append((dim, int(q_side[i]["ball"]), int(d_side[j]["ball"])))
    left = spark.createDataFrame(pairs, "dim int, q_ball int, ball int")
    others = judged.withColumnRenamed("ball", "q_ball").join(F.broadcast(left), ["dim", "q_ball"])  # at most centres**2 pairs
    rest = _meet(spark, data, others.select(*keys, "q_ball", "q_part", "id", "v", "vh", "copies", "worst"), sizes, k)
    merged = first.unionByName(rest)
    order = Wd.partitionBy("query", "qh").orderBy(F.desc("score"), "vec")  # at most k rows from each node
    ranked = merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    # Queries that repeat id and vector get their answers each.
    ranked = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "q_copies")))
    return ranked.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec").alias("vec_id"), "score")


def _centres(nets: dict, dim: int, balls: list[int]) -> np.ndarray:
    """The centres by number; the origin for lengths that the sample lacks."""
    return nets[dim][balls] if dim in nets else np.zeros((len(balls), dim))


def _nodes(rows: DataFrame, shared) -> DataFrame:
    """(dim, ball, radius): how far the members of a ball are from its centre."""

    @F.pandas_udf("double")
    def far(v: pd.Series, ball: pd.Series) -> pd.Series:
        out = []
        for x, b in zip(v, ball):
            centre = _centres(shared.value, len(x), [int(b)])[0] if len(x) else np.zeros(0)
            out.append(float(np.sqrt(((np.asarray(x, dtype=np.float64) - centre) ** 2).sum())))
        return pd.Series(out)

    return rows.select("dim", "ball", far("v", "ball").alias("far")).groupBy("dim", "ball").agg(F.max("far").alias("radius"))


def _meet(spark, data: DataFrame, queries: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """(query, qh, q_copies, vec, score) of every query block and every data block of its ball."""
    keys = ["dim", "ball", "part", "q_ball", "q_part"]
    blocks = sizes.select("dim", "ball", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))
    asked = queries.join(blocks, ["dim", "ball"])
    wanted = queries.select("dim", "ball", "q_ball", "q_part").distinct()
    there = data.join(wanted, ["dim", "ball"])

    def run(_, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(d):
            matrix = lambda f: np.array(f["v"].tolist(), dtype=np.float64).reshape(len(f), -1)
            worst = q["worst"].astype("float64").fillna(-np.inf).to_numpy()
            found = list(search(q["id"].to_numpy(), matrix(q), worst, d["id"].to_numpy(), matrix(d), d["copies"].to_numpy(), k))
        at, vec, score = (np.array(c, dtype=np.int64) for c in zip(*found)) if found else [np.zeros(0, dtype=np.int64)] * 3
        about = {out: q[c].to_numpy()[at] if len(at) else at for out, c in (("query", "id"), ("qh", "vh"), ("q_copies", "copies"))}
        return pd.DataFrame(about | {"vec": vec, "score": score})

    fresh = lambda f: f.select(*[F.col(c).alias(f"{c}_").alias(c) for c in f.columns])  # noqa: E731  both stem from one table
    asked, there = fresh(asked), fresh(there)
    return asked.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInPandas(run, "query long, qh long, q_copies long, vec long, score long")
