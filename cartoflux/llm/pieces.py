"""The piece vocabulary of a SentencePiece model, and a cache of what is known of frequent words.

In these models white space is a marker character at the start of a piece and nowhere after another
character, so a text falls into chunks (markers, then other characters) that can be treated one by one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

MARKER = "▁"
_CHUNK = re.compile(" *[^ ]+| +")


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, their scores, and the ids of the byte pieces; its size is that of the model file."""

    pieces: list[str]
    scores: list[float]
    normal: frozenset[int]
    bytes_: dict[int, int]
    unknown: int

    @property
    def splits(self) -> bool:
        """Whether no piece has a marker after another character."""
        return not any(re.search(f"[^{MARKER}]{MARKER}", self.pieces[i]) for i in self.normal)


def load(path: str) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(sp.get_piece_size())
    odd = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)}
    return Vocabulary(
        [sp.id_to_piece(i) for i in ids],
        [sp.get_score(i) for i in ids],
        frozenset(ids) - odd,
        {int(sp.id_to_piece(i)[1:-1], 16): i for i in ids if sp.is_byte(i)},
        sp.unk_id(),
    )


def chunks(text: str, splits: bool = True) -> list[str]:
    """A text, with the dummy space the models put first, as chunks; a space stands for a marker."""
    if not text:
        return []
    text = " " + text.replace(MARKER, " ")
    return _CHUNK.findall(text) if splits else [text]


class WordCache(dict):
    """chunk -> value, computed on first use. Of two generations the older is dropped when the younger is
    full, so memory is bounded and frequent words stay."""

    def __init__(self, compute: Callable, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.older = compute, most, longest, {}

    def __missing__(self, chunk: str):
        value = self.older.get(chunk)
        if value is None:
            value = self.compute(chunk)
        if len(chunk) <= self.longest:
            self[chunk] = value
        return value

    def turn(self) -> None:
        """Call between texts."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
