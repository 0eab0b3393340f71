"""Text cleaning as Column functions.

Each step is a function of its own; ``operators.cleaning`` chains them.
Java and Python differ in what ``\\w``, ``\\s``, ``\\d`` and ``.`` mean, so the
classes are spelled out with their Python meaning. Rare steps sit behind a plain
substring test: a byte scan is far cheaper than starting a regex engine on a
text that cannot match.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from . import lexicon
from .arrow import OfWords, in_parts
from .unicode import squashed

# Members of Python's \w and \s (inside a class), for Unicode text.
W = r"\p{L}\p{N}_"
S = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _only_if(found: Column, c: Column, changed: Column) -> Column:
    return F.when(found, changed).otherwise(c)


def text_or_empty(c: Column) -> Column:
    """A missing text counts as empty."""
    return F.coalesce(c, F.lit(""))


def lower_text(c: Column) -> Column:
    return F.lower(c)


def strip_html(c: Column, repl: str = " ") -> Column:
    """Tags ``<...>`` within one line."""
    return _only_if(c.contains("<") & c.contains(">"), c, F.regexp_replace(c, r"<[^>\n]*>", repl))


def strip_urls(c: Column, mode: str = "thorough") -> Column:
    """``thorough``: http(s)://… and www.… to a space. ``contractions``: any word
    part from http or www on to nothing."""
    if mode == "thorough":
        pattern, repl = rf"https?://[^{S}]+|www\.[^{S}]+", " "
    elif mode == "contractions":
        pattern, repl = rf"http[^{S}]+|www[^{S}]+", ""
    else:
        raise ValueError(f"unknown mode: {mode}")
    return _only_if(c.contains("http") | c.contains("www"), c, F.regexp_replace(c, pattern, repl))


def strip_emails(c: Column, repl: str = " ") -> Column:
    """Whole words with an inner @. Anchored at the word start, so a long word
    without @ is scanned once and not once per character."""
    return _only_if(c.contains("@"), c, F.regexp_replace(c, rf"(?<![^{S}])[^{S}]+?@[^{S}]+", repl))


def strip_handles(c: Column, repl: str = " ") -> Column:
    """@mentions and #hashtags."""
    return _only_if(c.contains("@") | c.contains("#"), c, F.regexp_replace(c, rf"[@#][{W}]+", repl))


def strip_entities(c: Column) -> Column:
    """HTML entities such as ``&amp;``."""
    return _only_if(c.contains("&"), c, F.regexp_replace(c, rf"&[{W}]+;", " "))


def strip_punct(c: Column, mode: str = "thorough") -> Column:
    """``thorough`` keeps apostrophes, ``basic`` keeps word characters only,
    ``contractions`` keeps ASCII letters, digits, spaces and ``.,!?'``."""
    pattern = {
        "thorough": rf"[^{W}{S}']",
        "basic": rf"[^{W}]",
        "contractions": rf"[^a-zA-Z0-9{S}.,!?']",
    }[mode]
    return F.regexp_replace(c, pattern, " ")


def strip_digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\p{Nd}+", " ")


def collapse_repeats(c: Column, keep: int = 2) -> Column:
    """Runs of three or more equal characters become ``keep`` of them."""
    return F.regexp_replace(c, r"([^\n])\1{2,}", "$1" * keep)


def collapse_punct(c: Column) -> Column:
    """Runs of ! and ? become one !, runs of dots become one dot."""
    return F.regexp_replace(F.regexp_replace(c, r"[!?]{2,}", "!"), r"\.{2,}", ".")


def expand_contractions(c: Column) -> Column:
    """won't to will not, and so on, in the fixed order."""
    out = c
    for short, full in lexicon.CONTRACTIONS:
        out = F.replace(out, F.lit(short), F.lit(full))
    return _only_if(c.contains("'"), c, out)


def squeeze_ws(c: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.trim(F.regexp_replace(c, rf"[{S}]+", " "))


def tokens(c: Column) -> Column:
    """Words of a squeezed text; an empty text has none."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def remove_stopwords(c: Column, words: Sequence[str] = tuple(lexicon.STOP_WORDS)) -> Column:
    """Drop stop words from a squeezed text. ``isin`` on many literals is a hash
    lookup, unlike ``array_contains``."""
    return F.array_join(F.filter(F.split(c, " "), lambda t: ~t.isin(*words)), " ")


def lemma(t: Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Singular of one English noun by plural rules and exceptions."""
    exceptions = lexicon.LEMMA_EXCEPTIONS if exceptions is None else exceptions
    drop1 = F.left(t, F.length(t) - 1)
    drop2 = F.left(t, F.length(t) - 2)
    sibilant = F.right(t, F.lit(4)).isin("ches", "shes", "sses", "zzes") | F.endswith(t, F.lit("xes"))
    plural = (
        F.when(F.length(t) < 4, t)
        .when(F.right(t, F.lit(2)).isin("ss", "us", "is"), t)
        .when(F.endswith(t, F.lit("ies")), F.concat(F.left(t, F.length(t) - 3), F.lit("y")))
        .when(sibilant, drop2)
        .otherwise(drop1)
    )
    people = F.when(F.endswith(t, F.lit("men")) & (F.length(t) > 5), F.concat(drop2, F.lit("an"))).otherwise(t)
    ruled = F.when(F.endswith(t, F.lit("s")), plural).otherwise(people)
    if not exceptions:
        return ruled
    table = F.create_map(*[F.lit(x) for kv in exceptions.items() for x in kv])
    return F.when(t.isin(*exceptions), table[t]).otherwise(ruled)


def lemmatize(c: Column, exceptions: Mapping[str, str] | None = None) -> Column:
    """Lemma of every word of a squeezed text."""
    return F.array_join(F.transform(F.split(c, " "), lambda t: lemma(t, exceptions)), " ")


def drop_and_lemmatize(
    c: Column, words: Sequence[str] = tuple(lexicon.STOP_WORDS), exceptions: Mapping[str, str] | None = None
) -> Column:
    """Stop words out and lemmas, with one split and one join."""
    kept = F.filter(F.split(c, " "), lambda t: ~t.isin(*words))
    return F.array_join(F.transform(kept, lambda t: lemma(t, exceptions)), " ")


# The thorough steps on a text that is ASCII already, as Python has them.
_FULL = r"[^\t-\r\x1c-\x20]"
_TAG, _URL = re.compile(r"<[^>\n]*>"), re.compile(rf"https?://{_FULL}+|www\.{_FULL}+")
_EMAIL = re.compile(rf"(?<!{_FULL}){_FULL}+?@{_FULL}+")
_HANDLE, _ENTITY = re.compile(r"[@#]\w+", re.ASCII), re.compile(r"&\w+;", re.ASCII)
_KEPT = {chr(i): chr(i) if chr(i).isalpha() or chr(i) in "_'" or chr(i).isspace() else " " for i in range(128)}
_LETTERS_ONLY = str.maketrans(_KEPT)
_RUN = re.compile(r"([^\n])\1{2,}")


def _lemma_of(t: str, exceptions: Mapping[str, str]) -> str:
    """``lemma`` of one word."""
    if t in exceptions:
        return exceptions[t]
    if t.endswith("s"):
        if len(t) < 4 or t.endswith(("ss", "us", "is")):
            return t
        if t.endswith("ies"):
            return t[:-3] + "y"
        return t[:-2] if t.endswith(("ches", "shes", "sses", "zzes", "xes")) else t[:-1]
    return t[:-2] + "an" if t.endswith("men") and len(t) > 5 else t


def _thorough_words(t: str) -> list[str]:
    """The words that the steps of ``operators.cleaning.clean_thorough`` from folding to
    squeezing leave of one lowered text. Only tags, URLs and names need an expression, and few texts
    hold them; digits go with the punctuation, since both leave spaces."""
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode("ascii")
    if "<" in t and ">" in t:
        t = _TAG.sub(" ", t)
    if "http" in t or "www" in t:
        t = _URL.sub(" ", t)
    if "@" in t:
        t = _EMAIL.sub(" ", t)
    if "@" in t or "#" in t:
        t = _HANDLE.sub(" ", t)
    if "&" in t:
        t = _ENTITY.sub(" ", t)
    t = t.translate(_LETTERS_ONLY)
    chars = np.frombuffer(t.encode("ascii"), np.uint8)
    same = chars[1:] == chars[:-1]
    if (same[1:] & same[:-1] & (chars[2:] > 32)).any():
        t = _RUN.sub(r"\1\1", t)
    return t.split() or [""]


def thorough(words: Sequence[str], exceptions: Mapping[str, str] | None = None) -> Callable[[Column], Column]:
    """All thorough steps on lowered texts, then stop words and lemmas, as one Arrow UDF:
    a regex engine of the JVM tests every character against sets of all scripts,
    which is most of what the steps cost one by one."""
    dropped, exceptions = frozenset(words), dict(lexicon.LEMMA_EXCEPTIONS if exceptions is None else exceptions)

    @F.arrow_udf(T.StringType())
    def cleaned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        word = OfWords(lambda w: None if w in dropped else _lemma_of(w, exceptions)).__getitem__

        def clean(t: str) -> str:
            return " ".join([w for w in map(word, _thorough_words(t)) if w is not None])

        yield from in_parts(None if (t := x.as_py()) is None else clean(t) for batch in batches for x in batch)

    return cleaned


def clean_light(c: Column) -> Column:
    """Lower and squeeze, nothing else."""
    return squeeze_ws(lower_text(text_or_empty(c)))


def normalize_obfuscation(c: Column) -> Column:
    """Undo attacks: NFKC, word characters only, runs to one, no spaces, lower.
    The result has no spaces, so lexicons must be matched by ``contains``."""
    return F.lower(squashed(text_or_empty(c)))


def n_tokens(c: Column) -> Column:
    """Number of white-space separated words; 0 for null and empty."""
    words = F.filter(F.split(text_or_empty(c), f"[{S}]+"), lambda t: t != "")
    return F.size(words)


def truncate_tokens(c: Column, n: int) -> Column:
    """First ``n`` words, joined by single spaces."""
    return F.array_join(F.slice(tokens(squeeze_ws(c)), 1, n), " ")


def fold_synonyms(c: Column, synonyms: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Every listed synonym back to its head word; the first head wins."""
    heads: dict[str, str] = {}
    for head, alternatives in (lexicon.SYNONYMS if synonyms is None else synonyms).items():
        for word in alternatives:
            heads.setdefault(word, head)
    table = F.create_map(*[F.lit(x) for kv in heads.items() for x in kv])
    folded = F.transform(
        F.regexp_extract_all(c, F.lit(rf"[{W}]+|[^{W}]+"), F.lit(0)),
        lambda t: F.when(F.lower(t).isin(*heads), table[F.lower(t)]).otherwise(t),
    )
    hit = F.lower(c).rlike("|".join(heads))
    return _only_if(hit, c, F.array_join(folded, ""))
