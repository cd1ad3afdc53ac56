"""A SentencePiece BPE vocabulary in Python: merges, which pieces may stand side by side, and where a text can be cut.

A string's encoding is the one sequence of pieces in which every neighbouring pair encodes to itself. This local rule
turns byte-pair encoding into a path problem, which both the prefix counter and the transducer solve.
"""

from __future__ import annotations

import functools
import re

import sentencepiece

from simplicia.llm.common import Memo

#: The mark that SentencePiece puts in place of a space (fixed value).
SPACE = "▁"
_RUNS = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class Pieces:
    """Pieces, scores and ids of a model file, and the merge order that they imply."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.names)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {self.names[i]: sp.get_score(i) for i in plain}
        self.id = {self.names[i]: i for i in plain}
        self.byte_id = {int(self.names[i][1:-1], 16): i for i in range(len(self.names)) if sp.is_byte(i)}
        self.longest = max(map(len, self.score))
        self.inside = {p[i : i + 2] for p in self.score for i in range(len(p) - 1)}
        self.pair: dict[tuple[str, str], bool] = Memo()
        if odd := [p for p in self.score if SPACE in p.lstrip(SPACE) or "\n" in p]:
            raise ValueError(f"pieces that cross words: {odd[:5]}")
        if len(self.byte_id) != 256:
            raise ValueError("the model has no byte fallback")
        if odd := {c for p in self.score for c in p} - set(self.score):
            raise ValueError(f"characters of pieces that are no pieces: {sorted(odd)[:5]}")

    def merge(self, text: str) -> list[str]:
        """Merge the pair of the best score, leftmost first, until no pair is a piece."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, left: str, right: str) -> bool:
        """Whether ``left`` then ``right`` survives merging; an empty ``left`` asks about ``right`` alone."""
        key = (left, right)
        known = self.pair.get(key)
        if known is None:
            if len(self.pair) >= 200_000:
                self.pair.clear()
            known = self.pair[key] = self.merge(left + right) == ([left, right] if left else [right])
        return known

    def units(self, text: str) -> list[str]:
        """Keys of the stretches that no merge crosses, in order; :meth:`written` gives each one's characters.

        A key without a mark or newline in front stands for itself behind one mark, as most words do."""
        if not text:
            return []
        parts = text.replace(SPACE, " ").replace("\n", " \n").split(" ")
        if "" in parts:
            written = SPACE + text.replace(" ", SPACE)
            parts = []
            for x in _RUNS.findall(written):
                if x[0] == SPACE and len(x) > 1 and x[1] != SPACE:
                    parts.append(x[1:])
                elif parts and parts[-1] == "\n" and x[0] not in (SPACE, "\n"):
                    parts[-1] = "\n" + x
                else:
                    parts.append(x)
        return parts

    def stretches(self, written: str) -> list[str]:
        """Cut where two characters meet that no piece holds side by side: no merge crosses."""
        inside, out, start = self.inside, [], 0
        for i in range(1, len(written)):
            if written[i - 1 : i + 1] not in inside:
                out.append(written[start:i])
                start = i
        out.append(written[start:])
        return out

    @staticmethod
    def written(unit: str) -> str:
        return unit if unit[0] in (SPACE, "\n") else SPACE + unit


def _number(raw: bytes, at: int) -> tuple[int, int]:
    """A variable-length whole number and where it ends."""
    out = shift = 0
    while True:
        out |= (raw[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if raw[at - 1] < 128:
            return out, at


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message; values are bytes or whole numbers."""
    at = 0
    while at < len(raw):
        key, at = _number(raw, at)
        if key & 7 == 0:
            value, at = _number(raw, at)
        else:
            size, at = _number(raw, at) if key & 7 == 2 else (4 if key & 7 == 5 else 8, at)
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


def specification(path: str) -> tuple[bool, bool]:
    """Of a model file's normaliser: whether a mark goes in front of a text, and whether spaces become marks.

    Field numbers are the file format's. Models that also map characters or drop spaces are refused."""
    with open(path, "rb") as file:
        told = dict(_fields(dict(_fields(file.read())).get(3, b"")))
    if told.get(2) or told.get(4, 1):
        raise ValueError("the model's normaliser maps characters or drops spaces")
    return bool(told.get(3, 1)), bool(told.get(5, 1))


@functools.lru_cache(maxsize=4)
def load(path: str) -> Pieces:
    return Pieces(path)
