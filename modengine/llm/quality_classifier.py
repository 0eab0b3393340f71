"""Quality of documents by co-training of two views.

One classifier reads the text content: hashed words and how they repeat. The
other reads the page's metadata: language, source, length and layout (characters
per line, shares of character kinds). Both are logistic and learn from the same
judged documents. Over rounds each view scores every document without a
judgement; what it is surest of, in the proportion of the judged classes, joins
the other's training data. At the end each view is calibrated on judged documents
that neither has seen, the calibrated views are combined on them too, and every
document is scored over its whole text.

Features are counted once, on the executors, and written in compact form; rounds
read only them. Spark ML fits the views on the executors. The fits see at most
``judged`` judged documents (those with the smallest hashes) and ``per_round``
pseudo-labels a round; candidates for these are all documents. The driver holds
weights, and two numbers for each judged document kept for calibration.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vector, Vectors, VectorUDT
from pyspark.sql import DataFrame, functions as F

from .common import free_names, written

WORDS = 2048  # hashed words
KINDS = 320  # hashed language and source
_UPPER = np.arange(65, 91)
_DIGIT = np.arange(48, 58)
_SPACE = np.array([9, 10, 11, 12, 13, 32])
_PUNCT = np.array([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])
CONTENT = WORDS + 4
META = KINDS + 9
FIT_ROWS = 10_000  # rows of a fit in one task


class Features:
    """Both views of a document as vectors; remembers where words go."""

    def __init__(self, keep: int = 300_000):
        self.keep = keep
        self.place: dict[str, int] = {}

    def content(self, text: str | None) -> np.ndarray:
        words = (text or "").lower().split()
        out = np.zeros(CONTENT, dtype=np.float32)
        n = len(words)
        if not n:
            return out
        place = self.place
        different = set(words)
        new = different.difference(place)
        if new:
            if len(place) + len(new) > self.keep:
                place.clear()
                new = different
            for w in new:
                place[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORDS
        counts = np.log1p(np.bincount([place[w] for w in words], minlength=WORDS))
        out[:WORDS] = counts / np.sqrt((counts ** 2).sum())
        again = sum(a == b for a, b in zip(words, words[1:]))
        out[WORDS:] = again / n, len(different) / n, np.log1p(n) / 10, sum(map(len, different)) / len(different) / 20
        return out

    def meta(self, text: str | None, lang: str | None, source: str | None) -> np.ndarray:
        out = np.zeros(META, dtype=np.float32)
        raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
        for kind, value in ("lang", lang), ("source", source):
            out[zlib.crc32(f"{kind}:{'' if value is None else value}".encode("utf-8", "surrogatepass")) % KINDS] += 1
        hist, n = np.bincount(raw, minlength=256), max(len(raw), 1)
        lines = int(hist[10]) + 1
        out[KINDS:] = (
            np.log1p(n) / 10, np.log1p(lines) / 5, np.log1p(n / lines) / 10, hist[_UPPER].sum() / n, hist[_DIGIT].sum() / n,
            hist[_SPACE].sum() / n, hist[_PUNCT].sum() / n, hist[128:].sum() / n, (hist / n).max(),
        )
        return out


@dataclass
class Logistic:
    """Weights over standardised columns."""

    weights: np.ndarray
    bias: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.asarray(x, dtype=np.float32) @ self.weights + self.bias


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(np.asarray(x, dtype=np.float64) / 2))


def calibrated(logits: np.ndarray, y: np.ndarray, penalty: float = 1e-4, steps: int = 400) -> Logistic:
    """Logistic fit on one or two columns of logits by accelerated gradient steps."""
    x = np.asarray(logits, dtype=np.float64)
    mean, spread = x.mean(axis=0), x.std(axis=0)
    scale = np.where(spread > 1e-6, 1 / np.maximum(spread, 1e-6), 0)
    width = max(1.0, np.sqrt(x.shape[1]))
    z = (x - mean) * scale / width
    w = prev = np.zeros(x.shape[1])
    b = prev_b = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for step in range(steps):
        push = step / (step + 3)
        at, at_b = w + push * (w - prev), b + push * (b - prev_b)
        gap = sigmoid(z @ at + at_b) - y
        prev, prev_b = w, b
        w, b = at - 3.0 * (z.T @ gap / len(y) + penalty * at), at_b - 3.0 * float(gap.mean())
    weights = w * scale / width
    return Logistic(weights.astype(np.float32), float(b - mean @ weights))


def packed(row: np.ndarray) -> bytes:
    """The places and values of a vector that are not zero."""
    at = np.flatnonzero(row)
    return at.astype("<u2").tobytes() + row[at].astype("<f4").tobytes()


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 6
    return np.frombuffer(raw, dtype="<u2", count=n), np.frombuffer(raw, dtype="<f4", offset=2 * n)


VIEWS = {"content": CONTENT, "meta": META}


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, content, meta): both views of every document with an id, packed."""
    @F.pandas_udf("content binary, meta binary")
    def views(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        make = Features()
        for texts, langs, sources in parts:
            yield pd.DataFrame({
                "content": [packed(make.content(t)) for t in texts],
                "meta": [packed(make.meta(*r)) for r in zip(texts, langs, sources)],
            })

    both = views(F.col(text_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string"))
    return docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), both.alias("v")).select("id", "v.*")


def fit_view(rows: DataFrame, view: str, trust: float = 0.3, penalty: float = 1e-3, steps: int = 30) -> Logistic:
    """Spark ML's logistic regression on the rows (view, y, told); a pseudo-label
    (``told``) weighs ``trust``."""
    width = VIEWS[view]

    @F.udf(VectorUDT())
    def sparse(raw: bytes) -> Vector:  # a bounded number of rows; Arrow has no sparse vectors
        at, values = unpacked(bytes(raw))
        return Vectors.sparse(width, at.astype(np.int32), values.astype(np.float64))

    table = rows.select(sparse(view).alias("x"), F.col("y").cast("double").alias("y"), F.when(F.col("told"), trust).otherwise(1.0).alias("w"))
    model = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", regParam=penalty, maxIter=steps).fit(table)
    return Logistic(model.coefficients.toArray().astype(np.float32), float(np.clip(model.intercept, -30, 30)))


def view_logits(rows: DataFrame, views: dict[str, Logistic]) -> DataFrame:
    """The rows with the logit of either view, from the packed features."""
    shared = rows.sparkSession.sparkContext.broadcast(views)  # a few thousand numbers

    @F.pandas_udf("content double, meta double")
    def logits(content: pd.Series, meta: pd.Series) -> pd.DataFrame:
        def of(view: str, parts: pd.Series) -> list[float]:
            model, out = shared.value[view], []
            for raw in parts:
                at, values = unpacked(raw)
                out.append(float(model.weights[at] @ values) + model.bias)
            return out

        return pd.DataFrame({"content": of("content", content), "meta": of("meta", meta)})

    return rows.withColumn("logit", logits("content", "meta")).drop("content", "meta")


def co_train(known: DataFrame, table: DataFrame, told: DataFrame, rounds: int = 2, sure: float = 0.95, per_round: int = 1000) -> dict:
    """Both views, their calibrations and the combination. ``known`` has judged rows
    (id, y, held, content, meta); those with ``held`` are kept for calibration. In
    every round each view gives the other rows of ``table`` (id, content, meta) that
    nobody judged (``told`` has the ids of the others), up to ``per_round`` and a quarter of the judged ones: its surest, those beyond ``sure`` by
    its calibration, each class in its share of the judged rows."""
    seen = known.filter(~F.col("held"))
    by_class = known.groupBy("held", "y").agg(F.count("*").alias("n")).collect()
    counts = {r["y"]: r["n"] for r in by_class if not r["held"]}
    # Views are calibrated on the rows kept for it, if they hold both classes.
    spare = known.filter("held") if len({r["y"] for r in by_class if r["held"]}) == 2 else known
    share = {y: n / sum(counts.values()) for y, n in counts.items()}
    given: dict[str, DataFrame | None] = dict.fromkeys(VIEWS)
    base = {view: seen.select(view, "y", F.lit(False).alias("told")) for view in VIEWS}
    other = {"content": "meta", "meta": "content"}

    def fitted(view: str) -> Logistic:
        rows = base[view] if given[view] is None else base[view].unionByName(given[view].select(view, "y", F.lit(True).alias("told")))
        # Every step of a fit is a job, and every stage of a job costs the driver blocks
        # of some MB. So no more tasks than the rows ask for, also where the scan cuts
        # files (one task sums without a second stage), and one fit after the other.
        return fit_view(written(rows.coalesce(tasks)).coalesce(tasks), view)

    def both() -> dict[str, Logistic]:
        return {view: fitted(view) for view in VIEWS}

    def surest(scored: DataFrame, view: str, y: int) -> DataFrame:
        """(id, taught, y, sure): what ``view`` can teach the other as class ``y``."""
        taught, sign = other[view], 1 if y else -1
        rows = scored if given[taught] is None else scored.join(given[taught].select("id"), "id", "left_anti")
        found = rows.select("id", F.lit(taught).alias("taught"), F.lit(y).alias("y"), (F.col(f"logit.{view}") * sign).alias("sure"))
        return found.filter(F.col("sure") >= bar)

    total = sum(counts.values())
    tasks = math.ceil((total + rounds * min(per_round, total // 4)) / FIT_ROWS)
    views = both()
    bar = float(np.log(sure / (1 - sure)))
    for _ in range(rounds):
        # A view is as sure as its calibration on rows it has not seen allows.
        scaled = calibrations(spare, views)[0]
        scored = view_logits(table, views).select("id", F.struct(*[
            (F.col(f"logit.{v}") * float(m.weights[0]) + m.bias).alias(v) for v, m in scaled.items()
        ]).alias("logit"))
        scored = written(scored.join(told.select("id"), "id", "left_anti"))
        # All picks of a round are counted, taken and given their features together.
        sides = {(view, y): surest(scored, view, y) for view in VIEWS for y in share}
        beyond = {(r["taught"], r["y"]): r["n"] for r in reduce(DataFrame.unionByName, sides.values()).groupBy("taught", "y").agg(F.count("*").alias("n")).collect()}
        picks = []
        for view in VIEWS:
            # The rarer class says how many there are; the other follows in its share.
            most = min(per_round, total // 4)
            for y, part in sorted(share.items(), key=lambda x: x[1]):
                n = min(round(most * part), beyond.get((other[view], y), 0))
                most = min(most, round(n / part))
                if n:
                    picks.append(sides[view, y].orderBy(F.col("sure").desc(), "id").limit(n).drop("sure"))
        if not picks:
            break
        picked = written(reduce(DataFrame.unionByName, picks).dropDuplicates(["taught", "id"]))
        # At most per_round ids a view: the features stay where they are.
        fresh = written(table.join(F.broadcast(picked), "id"))
        for view in VIEWS:
            mine = fresh.filter(F.col("taught") == view).drop("taught")
            given[view] = mine if given[view] is None else given[view].unionByName(mine)
        views = both()
    scaled, pairs, y = calibrations(spare, views)
    return {"views": views, "scaled": scaled, "both": calibrated(pairs, y)}


def calibrations(spare: DataFrame, views: dict[str, Logistic]) -> tuple[dict[str, Logistic], np.ndarray, np.ndarray]:
    """Every view's calibration, the calibrated logits of the judged rows ``spare``
    it was made on, and their classes."""
    rows = view_logits(spare, views).select("id", "y", "logit.content", "logit.meta").orderBy("id", "y", "content", "meta").collect()
    y = np.array([r["y"] for r in rows], dtype=np.float64)
    logits = {view: np.array([[r[view]] for r in rows]) for view in VIEWS}
    scaled = {view: calibrated(logits[view], y) for view in VIEWS}
    return scaled, np.column_stack([scaled[view].logit(logits[view]) for view in VIEWS]), y


def learn(
    docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str, label_col: str,
    judged: int, rounds: int, per_round: int, seed: int = 7,
) -> dict | None:
    """The co-trained model, or None where the judged documents lack a class."""
    told = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    told = written(told)
    # Rows that repeat an id are one judged document, the first in the order of the features.
    table = written(features(docs, id_col, text_col, lang_col, source_col))
    key = F.col("id").cast("string")
    wanted = told.join(table.select("id"), "id", "left_semi").orderBy(F.xxhash64(key, F.lit(seed)), "id").limit(judged)
    here = table.join(F.broadcast(written(wanted)), "id")  # at most ``judged`` ids
    here = here.groupBy("id", "y").agg(F.min(F.struct("content", "meta")).alias("v")).select("id", "y", "v.*")
    known = written(here.withColumn("held", F.crc32(key) % 5 == 0))
    classes = known.groupBy("held").agg(F.countDistinct("y").alias("n")).collect()
    n = {r["held"]: r["n"] for r in classes}
    if n.get(False, 0) < 2:
        if known.select("y").distinct().count() < 2:
            return None
        known = known.withColumn("held", F.lit(False))
    return co_train(known, table, told, rounds, per_round=per_round)


def score_documents(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    source_col: str = "source", label_col: str = "quality", judged: int = 8000, rounds: int = 2, per_round: int = 1000,
    reject_below: float = 0.35,
) -> DataFrame:
    """The documents with ``p_text``, ``p_meta`` (calibrated views), ``score`` (both;
    the probability of good quality) and ``kept`` (score at or above
    ``reject_below``).

    Null texts count as empty, null languages and sources as ''. Of judgements
    that share an id the lower counts; others than 0 and 1 do not. Without
    judged documents of both classes nothing can be learned: all scores are null
    and every document is kept. Rows that repeat come out alike. Clashing column
    names of the documents stay, and the new ones get underscores before theirs.
    """
    names = free_names(docs, ["p_text", "p_meta", "score", "kept"])
    model = learn(docs, labels, id_col, text_col, lang_col, source_col, label_col, judged, rounds, per_round)
    if model is None:
        nothing = F.lit(None).cast("double")
        return docs.select("*", *[nothing.alias(n) for n in names[:3]], F.lit(True).alias(names[3]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("p_text double, p_meta double, score double")
    def scored(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        make, m = Features(), shared.value
        for texts, langs, sources in parts:
            rows = [(make.content(t), make.meta(t, a, c)) for t, a, c in zip(texts, langs, sources)]
            logits = np.array([[m["views"][v].logit(x) for v, x in zip(VIEWS, row)] for row in rows]).reshape(-1, 2)
            scaled = np.column_stack([m["scaled"][v].logit(logits[:, i:i + 1]) for i, v in enumerate(VIEWS)])
            p = sigmoid(np.column_stack([scaled, m["both"].logit(scaled)]))
            yield pd.DataFrame(p, columns=["p_text", "p_meta", "score"])

    (held,) = free_names(docs, ["co_scores"])
    out = docs.withColumn(held, scored(F.col(text_col), F.col(lang_col).cast("string"), F.col(source_col).cast("string")))
    return out.select(
        *docs.columns, *[F.col(f"{held}.{n}").alias(c) for n, c in zip(("p_text", "p_meta", "score"), names)],
        (F.col(f"{held}.score") >= reject_below).alias(names[3]),
    )
