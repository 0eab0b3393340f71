"""Arrow batches row by row: what a UDF makes of a batch is handed on in parts."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa

# Words whose result is remembered at a time.
REMEMBERED = 1 << 18
# Characters of results that are handed on together; a text with more goes alone.
HANDED_ON = 1 << 20


def in_parts(texts: Iterable[str | None], most: int = HANDED_ON) -> Iterator[pa.Array]:
    """The texts as arrays of about ``most`` characters, each made when it is asked for."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += 0 if t is None else len(t)
        if held >= most:
            yield pa.array(part, pa.string())
            part, held = [], 0
    yield pa.array(part, pa.string())


def rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple]:
    """The rows of Arrow batches, one at a time."""
    for columns in batches:
        for row in zip(*columns):
            yield tuple(x.as_py() for x in row)


class OfWords(dict):
    """What a function makes of a word, found when the word is first met."""

    def __init__(self, of: Callable[[str], object]):
        super().__init__()
        self.of = of

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.of(word)
        return found
