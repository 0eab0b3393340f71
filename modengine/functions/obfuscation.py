"""The ten text attacks as Column functions.

Random choices come from digests of the row key and not from a generator, so an
attack is repeatable. Attacks that go character by character are array operations
over a text's code points in one Arrow UDF: in the JVM every character would become
an array element, at twenty times the cost. Choices per character are one string of
symbols per text; line feeds are left alone, as ``.`` would.

An attacked text may be many times as long as the text. The UDFs take a batch's texts
one by one and hand their results on as soon as a few megabytes are together, so
neither side ever holds an attacked batch; attacks in turn are one call.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from . import lexicon
from .arrow import in_parts, rows
from .rand import det_index, drawn_index, symbol_stream
from .tags import contains_any
from .text import W
from .unicode import is_ascii, of_points, points, word_points

_LF = ord("\n")


# -- character by character, for one text ------------------------------------------------

def _choices(zero: Mapping[str, str], one: Mapping[str, str]) -> np.ndarray:
    """Images of the ASCII characters where the bit is 0, and where it is 1."""
    return np.array([[ord(images.get(chr(i), chr(i))) for i in range(128)] for images in (zero, one)], dtype="<u4")


_LEET = _choices({a: v[0] for a, v in lexicon.LEET.items()}, {a: v[-1] for a, v in lexicon.LEET.items()})
_CASE = _choices(
    dict(zip(string.ascii_uppercase, string.ascii_lowercase)), dict(zip(string.ascii_lowercase, string.ascii_uppercase))
)


def _chosen(images: np.ndarray, salt: str) -> Callable[[str, str | None], str]:
    """Every ASCII character by one of its two images."""
    def attack(t: str, key: str | None) -> str:
        chars = points(t)
        bits = symbol_stream(key, salt, len(chars), 2)
        return of_points(np.where(chars < 128, images[bits, np.minimum(chars, 127)], chars))
    return attack


def _appended(symbols: Sequence[str], salt: str) -> Callable[[str, str | None], str]:
    """One of the symbols after every character."""
    table = np.array([ord(s) for s in symbols], dtype="<u4")

    def attack(t: str, key: str | None) -> str:
        chars = points(t)
        out = np.empty((len(chars), 2), dtype="<u4")
        out[:, 0] = chars
        out[:, 1] = table[symbol_stream(key, salt, len(chars), len(table))] if len(table) > 1 else table[0]
        if "\n" not in t:
            return of_points(out)
        kept = np.ones(out.shape, bool)
        kept[:, 1] = chars != _LF
        return of_points(out[kept])
    return attack


def _repeated(t: str, key: str | None) -> str:
    chars = points(t)
    times = 2 + symbol_stream(key, "char_repetition", len(chars), 2)
    return of_points(np.repeat(chars, np.where(chars == _LF, 1, times)))


def _swapped(t: str, key: str | None) -> str:
    chars = points(t)
    word, place = word_points()[chars], np.arange(len(chars))
    outside = np.maximum.accumulate(np.where(word, -1, place)) if len(chars) else place
    first = np.flatnonzero(word[:-1] & word[1:] & ((place - outside)[:-1] % 2 == 1))
    out = chars.copy()
    out[first], out[first + 1] = chars[first + 1], chars[first]
    return of_points(out)


class _Images(dict):
    """NFKC of single characters, found as they are met."""

    def __missing__(self, point: int) -> str:
        self[point] = unicodedata.normalize("NFKC", chr(point))
        return self[point]


_NFKC = _Images()

_BY_CHARACTER = {
    "leetspeak": _chosen(_LEET, "leetspeak"), "space_injection": _appended(" ", ""), "char_repetition": _repeated,
    "special_chars": _appended(lexicon.SPECIAL_CHARS, "special_chars"), "case_variation": _chosen(_CASE, "case_variation"),
    "unicode": lambda t, key: t.translate(_NFKC), "emoji_injection": _appended(lexicon.EMOJI, "emoji_injection"),
    "zero_width": _appended(lexicon.ZERO_WIDTH, ""), "character_swapping": _swapped,
}

_PIECES = re.compile(r"\w+|\W+")


def _substituted(t: str, key: str | None) -> str:
    """``word_substitution`` of one text."""
    low = t.lower()
    if not any(word in low for word in lexicon.SYNONYMS):
        return t
    pieces = _PIECES.findall(t)
    for i, piece in enumerate(pieces):
        mine = lexicon.SYNONYMS.get(piece.lower())
        if mine is not None:
            pieces[i] = mine[drawn_index(key, f"word_substitution:{i}", len(mine))]
    return "".join(pieces)


_BY_TEXT = {**_BY_CHARACTER, "word_substitution": _substituted}

@F.arrow_udf(T.StringType())
def _rewritten(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from in_parts(None if t is None else _BY_CHARACTER[p](t, k) for t, k, p in rows(batches))


def _in_turn(t: str, key: str, names: Sequence[str]) -> str:
    for stage, name in enumerate(names, 1):
        if name in _BY_TEXT:
            t = _BY_TEXT[name](t, f"{key}:{stage}")
    return t


@F.arrow_udf(T.StringType())
def _rewritten_in_turn(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    yield from in_parts(None if t is None else _in_turn(t, k, names) for t, k, names in rows(batches))


def _by_character(c: Column, key, name: Column, only: Column | None = None) -> Column:
    """The attack of the row's name; rows where ``only`` is false go to Python as null
    and come back as they are, and so do ASCII texts that have no other form."""
    sent = (name != "unicode") | ~is_ascii(c)
    key = F.lit(None).cast("string") if key is None else (key if isinstance(key, Column) else F.lit(key)).cast("string")
    return F.coalesce(_rewritten(F.when(sent if only is None else only & sent, c), key, name), c)


# -- as columns ----------------------------------------------------------------------------

def leetspeak(c: Column, key) -> Column:
    """Some small letters as digits or symbols, of two choices where there are two."""
    return _by_character(c, key, F.lit("leetspeak"))


def space_injection(c: Column, key=None) -> Column:
    return _by_character(c, key, F.lit("space_injection"))


def char_repetition(c: Column, key) -> Column:
    """Every character two or three times."""
    return _by_character(c, key, F.lit("char_repetition"))


def special_chars(c: Column, key) -> Column:
    """One of five symbols after every character."""
    return _by_character(c, key, F.lit("special_chars"))


def case_variation(c: Column, key) -> Column:
    """Every ASCII letter in random case."""
    return _by_character(c, key, F.lit("case_variation"))


def unicode_form(c: Column, key=None) -> Column:
    """NFKC of every character by itself."""
    return _by_character(c, key, F.lit("unicode"))


def word_substitution(c: Column, key, synonyms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Every listed word by one of its synonyms, drawn per occurrence; the case of
    the replaced word is not kept."""
    table = lexicon.SYNONYMS if synonyms is None else synonyms
    options = F.create_map(*[x for w, s in table.items() for x in (F.lit(w), F.array(*map(F.lit, s)))])

    def replace(t: Column, i: Column) -> Column:
        mine = options[F.lower(t)]
        pick = det_index(key, F.concat(F.lit("word_substitution:"), i.cast("string")), F.size(mine))
        return F.when(F.lower(t).isin(*table), F.element_at(mine, (pick + 1).cast("int"))).otherwise(t)

    pieces = F.regexp_extract_all(c, F.lit(rf"[{W}]+|[^{W}]+"), F.lit(0))
    listed = contains_any(F.lower(c), list(table))
    return F.when(listed, F.array_join(F.transform(pieces, replace), "")).otherwise(c)


def character_swapping(c: Column, key=None) -> Column:
    """Word characters swapped in pairs, left to right."""
    return _by_character(c, key, F.lit("character_swapping"))


def emoji_injection(c: Column, key) -> Column:
    return _by_character(c, key, F.lit("emoji_injection"))


def zero_width(c: Column, key=None) -> Column:
    return _by_character(c, key, F.lit("zero_width"))


ATTACKS = {
    "leetspeak": leetspeak, "space_injection": space_injection, "char_repetition": char_repetition,
    "special_chars": special_chars, "case_variation": case_variation, "unicode": unicode_form,
    "word_substitution": word_substitution, "character_swapping": character_swapping,
    "emoji_injection": emoji_injection, "zero_width": zero_width,
}


def obfuscate(c: Column, key, pattern: str) -> Column:
    """The named attack; an unknown name leaves the text as it is."""
    attack = ATTACKS.get(pattern)
    return c if attack is None else attack(c, key)


def obfuscate_by(c: Column, key, pattern: Column, patterns: Sequence[str] = tuple(lexicon.PATTERNS)) -> Column:
    """The attack that a column names, row by row. Only the row's own branch is
    evaluated; the Arrow one sees null for the rows of the others."""
    arrow = [name for name in patterns if name in _BY_CHARACTER]
    mine = F.coalesce(pattern.isin(*arrow), F.lit(False))
    out = _by_character(c, key, pattern, mine) if arrow else c
    for name in patterns:
        if name in ATTACKS and name not in arrow:
            out = F.when(pattern == name, ATTACKS[name](c, key)).otherwise(out)
    return out


def obfuscate_in_turn(c: Column, key: Column, names: Column) -> Column:
    """The attacks that an array names, one after the other, each with the key
    ``key:place`` (from 1 on). One call makes them all, so the text of no stage but
    the last leaves Python. Unknown names change nothing; rows without names go to
    Python as null."""
    return F.coalesce(_rewritten_in_turn(F.when(F.size(names) > 0, c), key.cast("string"), names), c)
