"""What both token operators need of a merge-type SentencePiece model.

Symbols are numbered by merge order: first the single characters, then the longer
pieces by falling score.  Two neighbours merge when their joined text is a piece.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import sentencepiece

from .common import ship

MARK = "▁"


class Vocabulary:
    """Symbols, merges and output ids of a model; small (bounded by the vocabulary)."""

    def __init__(self, model: bytes):
        self.model = model
        sp = self.processor()
        ids = range(sp.get_piece_size())
        if not all(sp.is_byte(i) for i in [sp.piece_to_id("<0x00>"), sp.piece_to_id("<0xFF>")]):
            raise ValueError("the model has no byte pieces")
        plain = {sp.id_to_piece(i): i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        long = sorted((p for p in plain if len(p) > 1), key=lambda p: (-sp.get_score(plain[p]), plain[p]))
        inner = set(chain.from_iterable(long))
        chars = sorted(inner | {p for p in plain if len(p) == 1})
        self.text = [*chars, *long]
        self.symbol = {p: i for i, p in enumerate(self.text)}
        #: Ids that a symbol gives if it is left at the end.
        self.out = [(plain[p],) if p in plain else tuple(byte[b] for b in p.encode()) for p in self.text]
        self.byte, self.singles = byte, len(chars)
        #: Characters that never merge end a word; so does a mark after anything else, unless a piece has one inside.
        self.newline_splits = "\n" not in inner
        self.mark_splits = not any(MARK in p.lstrip(MARK) for p in long) and sp.normalize("a") == MARK + "a"
        self.merge = {(a, b): self.symbol[p] for p in long for a, b in ((self.symbol.get(p[:k]), self.symbol.get(p[k:])) for k in range(1, len(p))) if a is not None and b is not None}

    def processor(self) -> sentencepiece.SentencePieceProcessor:
        return sentencepiece.SentencePieceProcessor(model_proto=self.model)


class Words:
    """Splits normalised texts into words that merge apart from each other."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.sp = vocabulary, vocabulary.processor()

    def split(self, text: str | None) -> list[str]:
        """The words of a text, each with its leading marks; joined they are the normalised text."""
        if not text:
            return []
        norm = self.sp.normalize(text)
        if not self.v.mark_splits:
            return [norm]
        parts = norm.replace("\n", " \n ") if self.v.newline_splits else norm  # no space is left in a normalised text
        parts = list(filter(None, parts.replace(MARK, " " + MARK).split(" ")))
        if MARK * 2 not in norm:
            return parts
        out, marks = [], ""
        for x in parts:  # several marks in a row belong to the word that follows
            if x == MARK:
                marks += x
            elif x[0] == MARK:
                out.append(marks + x)
                marks = ""
            else:
                out += [marks, x] if marks else [x]
                marks = ""
        return [*out, marks] if marks else out


def code_points(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points of the words, and the words' lengths."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32), np.fromiter(map(len, words), np.int64, len(words))


ship(__name__)
