"""Row predicates and tags as Column functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, functions as F

from . import lexicon
from .text import W, S, text_or_empty


def contains_any(c: Column, words: Sequence[str]) -> Column:
    """True if one of the words is a substring. Words that hold another listed
    word add nothing and are not tested."""
    needed = [w for w in words if not any(v != w and v in w for v in words)]
    return reduce(lambda a, b: a | b, [c.contains(w) for w in needed])


def has_identity(c: Column, mode: str = "substring", terms: Sequence[str] = tuple(lexicon.IDENTITY_TERMS)) -> Column:
    """1 if the lowered text names an identity term, as substring or whole word."""
    low = F.lower(text_or_empty(c))
    if mode == "substring":
        hit = contains_any(low, terms)
    elif mode == "word":
        hit = low.rlike(rf"(?<![{W}])(?:{'|'.join(terms)})(?![{W}])")
    else:
        raise ValueError(f"unknown mode: {mode}")
    return hit.cast("int")


def identity_terms_in(c: Column, terms: Sequence[str] = tuple(lexicon.IDENTITY_TERMS)) -> Column:
    """Array of the identity terms that occur in the text, as substrings."""
    return terms_in_lowered(F.lower(text_or_empty(c)), terms)


def terms_in_lowered(low: Column, terms: Sequence[str] = tuple(lexicon.IDENTITY_TERMS)) -> Column:
    """The same for a text that is lowered already."""
    return F.array_compact(F.array(*[F.when(low.contains(t), F.lit(t)) for t in terms]))


def keyword_hits(low: Column) -> Column:
    """Which keyword groups an already lowered text holds, as one struct."""
    insult = contains_any(low, lexicon.INSULT_WORDS)
    death = contains_any(low, lexicon.DEATH_WORDS)
    obscene = contains_any(low, lexicon.OBSCENE_WORDS)
    threat = low.contains(lexicon.THREAT_WORD) | (
        low.contains(lexicon.THREAT_PAIR[0]) & low.contains(lexicon.THREAT_PAIR[1])
    )
    hate = low.contains(lexicon.GROUP_MARK) & contains_any(low, lexicon.GROUP_WORDS)
    groups = {"insult": insult, "death": death, "obscene": obscene, "threat": threat, "hate": hate}
    return F.struct(*[hit.alias(name) for name, hit in groups.items()])


def labels_of_hits(hits: Column) -> dict[str, Column]:
    """The six keyword labels from the groups. Where ``hits`` is a column of its own,
    the text is searched once for each word, whatever the labels share."""
    insult, death, obscene, threat, hate = (hits[g] for g in ("insult", "death", "obscene", "threat", "hate"))
    rules = {
        "toxic": insult | death | obscene | threat | hate,
        "severe_toxic": death | threat,
        "obscene": obscene,
        "threat": threat,
        "insult": insult,
        "identity_hate": hate,
    }
    return {label: rules[label].cast("int") for label in lexicon.LABELS}


def weak_label_columns(low: Column) -> dict[str, Column]:
    """The six keyword labels of an already lowered text."""
    return labels_of_hits(keyword_hits(low))


def obfuscation_flag_columns(c: Column) -> dict[str, Column]:
    """One 0/1 flag per trick that a text may have been disguised with."""
    rules = {
        # digit or symbol between or before letters of one word
        "leet": c.rlike(r"[A-Za-z][0-9@$!|*]+[A-Za-z]|(?<![A-Za-z0-9])[0-9@$]+[A-Za-z]{2}"),
        # four or more single characters, each set apart by white space
        "spaced": c.rlike(rf"(?:(?<![^{S}])[^{S}][{S}]{{1,3}}){{3,}}[^{S}](?![^{S}])"),
        "repeated": c.rlike(r"(\p{L})\1{2,}"),
        "zero_width": c.rlike(r"[\x{200b}-\x{200d}\x{2060}\x{feff}]"),
        "mixed_script": c.rlike(
            r"\p{IsLatin}[\p{IsCyrillic}\p{IsGreek}]|[\p{IsCyrillic}\p{IsGreek}]\p{IsLatin}"
        ),
        # upper case after lower case inside a word
        "mid_case": c.rlike(r"\p{Ll}\p{Lu}"),
        # letters tied together by joiners
        "joined": c.rlike(r"[A-Za-z0-9][_.*#@$%][A-Za-z0-9][_.*#@$%][A-Za-z0-9]"),
    }
    return {name: rule.cast("int") for name, rule in rules.items()}
