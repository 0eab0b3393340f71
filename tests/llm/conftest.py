from __future__ import annotations

import pytest

DATA = "/root/testdata/sf0.001"
EDGE_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, id string, th string, score string, kept string, "
    "text_hash string, n_removed_lines string, shard string, low string"
)


def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows; columns whose names
    operators use themselves."""
    line = "one line of rather more than ten words that stands in several documents here"
    texts = [
        (1, None), (2, ""), (3, "   \n\n \t"), (4, "short"), (5, f"{line}\nalpha beta\n\n{line}"), (6, f"{line}\nalpha beta"),
        (7, "word " * 30_000), (7, "word " * 30_000), (None, "no id at all but five words"), (None, None),
        (9, f"alpha beta\n{line}\r\n  \ntail"), (10, "a b c d e f g h i j k l m n o p"), (11, "a b c d e f g h i j k l m n o p"),
        (12, "Licensed under CC BY 4.0. All rights reserved. cc by"), (13, "日本語 の テキスト é"), (14, "x" * 50_000),
    ]
    return [
        (i, t, None if n % 5 == 0 else "en", None if n % 4 == 0 else f"src{n % 3}", None, "a", "b", "c", "d", "e", "f", "g", "h")
        for n, (i, t) in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
