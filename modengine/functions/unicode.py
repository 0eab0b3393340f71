"""Unicode normalization.

Folding and the normalizer are Arrow UDFs over whole texts: Python's forms are
compiled, while a table of some thousand characters costs the JVM a lookup per
character. NFKC of single characters also has a form in the JVM.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def points(t: str) -> np.ndarray:
    """Code points of one text."""
    return np.frombuffer(t.encode("utf-32-le"), dtype="<u4")


def of_points(a: np.ndarray) -> str:
    """The text of code points."""
    return a.astype("<u4", copy=False).tobytes().decode("utf-32-le")


def is_ascii(c: Column) -> Column:
    """True when every character takes one byte; no regex, no decoding."""
    return F.octet_length(c) == F.char_length(c)


@lru_cache(maxsize=1)
def word_points() -> np.ndarray:
    """For every code point whether it is a letter, a number or the underscore."""
    return np.array([chr(i).isalnum() or i == ord("_") for i in range(sys.maxunicode + 1)])


@lru_cache(maxsize=1)
def _compat_table() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that NFKC changes: one-character and longer images."""
    single, multi = {}, {}
    for cp in range(128, sys.maxunicode + 1):
        ch = chr(cp)
        image = unicodedata.normalize("NFKC", ch) if unicodedata.decomposition(ch) else ch
        if image != ch:
            (single if len(image) == 1 else multi)[ch] = image
    return single, multi


def _char_class(chars) -> str:
    """Regex class of the characters, runs of neighbours as ranges."""
    points = sorted(ord(c) for c in chars)
    out, start = [], points[0]
    for a, b in zip(points, points[1:] + [-1]):
        if b != a + 1:
            out.append(f"\\x{{{start:x}}}-\\x{{{a:x}}}")
            start = b
    return "[" + "".join(out) + "]"


def _mapped(c: Column, single: dict[str, str], multi: dict[str, str]) -> Column:
    """Each character of the tables replaced by its image."""
    # One literal for the whole map: folded once, and cheap to ship in the plan.
    long_image = F.from_json(F.lit(json.dumps(multi)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(c, ""), lambda ch: F.coalesce(long_image[ch], ch)), "")
    # Spell out only where such a character occurs at all. The full class is slow
    # to test, so a class of a few ranges that holds it is tested first.
    first = min(ch for ch in multi if ch > "\xff")
    likely = _char_class([ch for ch in multi if ch <= "\xff"])[:-1] + f"\\x{{{ord(first):x}}}-\\x{{10ffff}}]"
    expanded = F.when(c.rlike(likely) & c.rlike(_char_class(multi)), spelled).otherwise(c)
    return F.translate(expanded, "".join(single), "".join(single.values()))


@F.pandas_udf(T.StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


def ascii_fold(c: Column) -> Column:
    """NFKD, then drop what is not ASCII: é gives e, ½ gives 12, ß vanishes. Texts that
    are ASCII already are sent to Python as null, i.e. for free."""
    return F.coalesce(_folded(F.when(~is_ascii(c), c)), c)


def _squashed(t: str) -> str:
    chars = points(unicodedata.normalize("NFKC", t))
    at = np.flatnonzero(word_points()[chars])
    kept = chars[at]
    starts = np.flatnonzero(np.concatenate([[True], (kept[1:] != kept[:-1]) | (np.diff(at) > 1)])[:len(kept)])
    lengths = np.diff(starts, append=len(kept))
    return of_points(np.repeat(kept[starts], np.where(lengths > 2, 1, lengths)))


@F.pandas_udf(T.StringType())
def _squashed_text(s: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _squashed(t) for t in s], dtype=object)


def squashed(c: Column) -> Column:
    """NFKC of the text, its word characters only, runs of three or more of one."""
    return _squashed_text(c)


def nfkc_chars(c: Column, only: Column | None = None) -> Column:
    """NFKC of every character by itself; rows where ``only`` is false are kept."""
    wanted = ~is_ascii(c) if only is None else (~is_ascii(c) & only)
    return F.when(wanted, _mapped(c, *_compat_table())).otherwise(c)
