"""Licence notices in texts by diagonal voting.

Every rolling word k-gram of a text is joined to the places where it stands in a
template. A match at word ``p`` of the text and word ``t`` of the template votes
for the diagonal ``p - t``, the place where the template would start; votes are
counted per diagonal. Phrases are short templates: all their k-grams on one
diagonal are exactly one place. For longer templates neighbouring diagonals merge,
since a word put in or left out shifts the rest, and the span is verified by the
template words it covers, in a stretch of about the template's length.

k-grams that stand in no template are left out before rows are made of them, by
their hash; the join compares the words themselves. All of it is built from
DataFrame functions; the template table is a fixed list.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window as Wd, functions as F

from .common import ASCII_LOWER, ASCII_UPPER, once, same, written

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    phrase: bool = False  # found only word for word

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def k(self) -> int:
        return 2 if self.phrase else 3


PHRASES = [
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
]
# Opening words of widely used public licence notices, lower case without punctuation.
NOTICES = [
    Template("apache", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    Template("gpl", "this work is licensed under the gnu general public license version 3"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
]


def gram_hash(words: Sequence[str]) -> int:
    """What ``xxhash64(w1, w2, ...)`` gives, as a signed integer."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """(gram, template, tpos): every k-gram of every template."""
    rows = [
        (" ".join(t.words[i:i + t.k]), n, i)
        for n, t in enumerate(templates) for i in range(len(t.words) - t.k + 1)
    ]
    return spark.createDataFrame(rows, "gram string, template int, tpos int")


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: Sequence[Template] = PHRASES,
    notices: Sequence[Template] = NOTICES, coverage: float = 0.8, drift: int = 2,
) -> DataFrame:
    """One row per document: the id, n_words, n_base (places of phrases),
    first_word and last_word (smallest and largest start, else null), base_labels,
    labels (those of verified notices as well) and ``score``: 1 if a phrase stands
    in the text, else the largest share of a notice's words that one span covers.

    A span is verified if it covers ``coverage`` of the words and is at most a
    quarter and two words longer than the notice; diagonals up to ``drift`` apart
    merge. A null text counts as empty. Rows that repeat id and text come out
    alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    templates = [*phrases, *notices]
    low = F.translate(F.coalesce(F.col(text_col), F.lit("")), ASCII_UPPER, ASCII_LOWER)
    lowered = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), low.alias("low"))
    worded = once(lowered, ws=F.filter(F.split("low", NOT_WORD), lambda w: w != ""))

    def found(k: int) -> Column:
        wanted = sorted({gram_hash(t.words[i:i + k]) for t in templates if t.k == k for i in range(len(t.words) - k + 1)})
        hashes = F.transform("ws", lambda w, i: F.struct(
            F.xxhash64(w, *[F.get("ws", i + j) for j in range(1, k)]).alias("h"), i.alias("pos"),
        ))
        return F.transform(
            F.filter(hashes, lambda x: x["h"].isin(wanted)),
            lambda x: F.struct(x["pos"].alias("pos"), F.concat_ws(" ", F.slice("ws", x["pos"] + 1, F.lit(k))).alias("gram")),
        )

    narrow = written(worded.select("id", "th", F.size("ws").cast("long").alias("n_words"), F.concat(found(2), found(3)).alias("hits")))
    hits = narrow.filter(F.size("hits") > 0).select("id", "th", F.inline("hits")).distinct()
    votes = hits.join(template_grams(spark, templates), "gram").groupBy("id", "th", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.collect_set("tpos").alias("tpos"), F.min("pos").alias("low"), F.max("pos").alias("high"),
    )
    shapes = spark.createDataFrame(
        [(n, t.label, t.phrase, t.k, len(t.words)) for n, t in enumerate(templates)],
        "template int, label string, phrase boolean, k int, n_t int",
    )
    votes = written(votes.join(shapes, "template"))
    places = votes.filter(F.col("phrase") & (F.size("tpos") == F.col("n_t") - F.col("k") + 1)).select(
        "id", "th", "label", F.col("diagonal").cast("long").alias("place"), F.lit(1.0).alias("score"),
    )
    along = Wd.partitionBy("id", "th", "template").orderBy("diagonal")
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > drift, F.lit(True))
    merged = votes.filter(~F.col("phrase")).withColumn("island", F.sum(fresh.cast("int")).over(along))
    spans = merged.groupBy("id", "th", "template", "island", "label", "k", "n_t").agg(
        F.flatten(F.collect_list("tpos")).alias("tpos"), F.min("low").alias("low"), (F.max("high") + F.first("k")).alias("high"),
    )
    words = F.array_distinct(F.flatten(F.transform("tpos", lambda t: F.sequence(t, t + F.col("k") - 1))))
    spans = once(spans, share=F.size(words) / F.col("n_t"))
    fits = (F.col("share") >= coverage) & ((F.col("high") - F.col("low")) * 4 <= F.col("n_t") * 5 + 8)
    spans = spans.select("id", "th", F.when(fits, F.col("label")).alias("label"), F.lit(None).cast("long").alias("place"), F.col("share").alias("score"))
    joined = F.array_join(F.array_sort(F.collect_set("label")), ",")
    best = places.unionByName(spans).groupBy("id", "th").agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("place").isNotNull(), F.col("label")))), ",").alias("base_labels"),
        joined.alias("labels"), F.max("score").alias("score"),
    ).withColumnsRenamed({"id": "_bid", "th": "_bth"})
    out = narrow.join(best, same(F.col("id"), F.col("_bid")) & (F.col("th") == F.col("_bth")), "left")
    zero = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return out.select(
        F.col("id").alias(id_col), "n_words", zero("n_base", 0), "first_word", "last_word", zero("base_labels", ""),
        zero("labels", ""), zero("score", 0.0),
    )
