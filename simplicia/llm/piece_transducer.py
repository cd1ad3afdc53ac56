"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model file: the normaliser (from the model's own specification: a mark in front,
spaces to marks), the lexicon (a trie of pieces, each weighing 1, with byte fallback for characters that no piece has)
and the context acceptor, which gives two neighbouring pieces weight 0 if they survive merging side by side and infinity
if not. :func:`compose` joins machines, and :func:`shortest_path` finds the least total weight in the tropical semiring
(min, +). A byte-pair model's weights leave exactly one path finite, so the search of the composed machine that every
document takes, :meth:`Transducer.path`, follows the longest arcs first and turns back where the weight is infinite.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
from array import array
from collections.abc import Hashable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, BooleanType, LongType, StructField, StructType

from simplicia.llm.common import Cache, only, text_rows, workers
from simplicia.llm.pieces import SPACE, Pieces, load, specification

#: An arc: what it reads (None: nothing), what it writes (None: nothing), its weight, and the state it leads to.
Arc = tuple[Hashable, Hashable, float, Hashable]


class Text:
    """The machine of one input: it writes a text's characters one after the other."""

    start = 0

    def __init__(self, text: str):
        self.text = text

    def arcs(self, state: int) -> Iterator[Arc]:
        if state < len(self.text):
            yield self.text[state], self.text[state], 0.0, state + 1

    def final(self, state: int) -> bool:
        return state == len(self.text)


@dataclass(frozen=True)
class Normaliser:
    """Characters to marked characters: state 0 is before the text, 1 in it."""

    prefix: bool
    escape: bool
    start = 0

    def on(self, state: int, symbol: str | None) -> Iterator[tuple[Hashable, float, Hashable]]:
        """(written, weight, next) of the arcs that read ``symbol``."""
        if state == 0:
            if symbol is None and self.prefix:
                yield SPACE, 0.0, 1
            elif symbol is not None and not self.prefix:
                yield self.written(symbol), 0.0, 1
        elif symbol is not None:
            yield self.written(symbol), 0.0, 1

    def written(self, symbol: str) -> str:
        return SPACE if self.escape and symbol == " " else symbol

    def final(self, state: int) -> bool:
        return True


class Lexicon:
    """Characters to pieces: states are nodes of a trie; where a piece ends, an arc writes it and goes back to the root."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.nodes: list[dict[str, int]] = [{}]
        self.ends: dict[int, str] = {}
        for name in pieces.score:
            at = 0
            for c in name:
                if c not in self.nodes[at]:
                    self.nodes[at][c] = len(self.nodes)
                    self.nodes.append({})
                at = self.nodes[at][c]
            self.ends[at] = name
        self.start = 0

    def on(self, state: int, symbol: str | None) -> Iterator[tuple[Hashable, float, Hashable]]:
        if symbol is None:
            if state in self.ends:
                yield self.ends[state], 1.0, 0
        elif symbol in self.nodes[state]:
            yield None, 0.0, self.nodes[state][symbol]
        elif state == 0:  # byte fallback
            yield symbol.encode("utf-8", "surrogatepass"), 1.0, 0

    def final(self, state: int) -> bool:
        return state == 0


class Context:
    """Pieces to pieces: the state is the last piece; an arc that would not survive merging has infinite weight, that is, isn't there."""

    start = ""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces

    def on(self, state: str, symbol: Hashable) -> Iterator[tuple[Hashable, float, Hashable]]:
        if isinstance(symbol, bytes):  # nothing merges with a character that no piece has
            yield symbol, 0.0, ""
        elif symbol is not None and self.pieces.stands(state, symbol):
            yield symbol, 0.0, symbol

    def final(self, state: str) -> bool:
        return True


class Composed:
    """``first`` writes what ``second`` reads; arcs are made where the search asks for them."""

    def __init__(self, first, second):
        self.first, self.second, self.start = first, second, (first.start, second.start)

    def arcs(self, state) -> Iterator[Arc]:
        a, b = state
        for out, weight, to in self.second.on(b, None):
            yield None, out, weight, (a, to)
        for read, out, weight, to in self.first.arcs(a):
            if out is None:
                yield read, None, weight, (to, b)
            else:
                for written, more, then in self.second.on(b, out):
                    yield read, written, weight + more, (to, then)

    def final(self, state) -> bool:
        return self.first.final(state[0]) and self.second.final(state[1])


def compose(first, *others):
    return functools.reduce(Composed, others, first)


def shortest_path(machine) -> tuple[float, list[Hashable]]:
    """Least weight from the start to a final state and what that path writes, by Dijkstra's algorithm; infinity if there is none."""
    count = itertools.count()
    queue, seen = [(0.0, next(count), machine.start, None)], set()
    while queue:
        weight, _, state, path = heapq.heappop(queue)
        if state in seen:
            continue
        seen.add(state)
        if machine.final(state):
            out = []
            while path is not None:
                symbol, path = path
                out.append(symbol)
            return weight, out[::-1]
        for _, symbol, more, to in machine.arcs(state):
            if to not in seen:
                heapq.heappush(queue, (weight + more, next(count), to, path if symbol is None else (symbol, path)))
    return float("inf"), []


class Transducer:
    def __init__(self, pieces: Pieces, prefix: bool = True, escape: bool = True):
        if not (prefix and escape):
            raise ValueError("texts are cut at spaces, which needs a model that puts marks in front and for spaces")
        self.pieces = pieces
        self.normaliser, self.context = Normaliser(prefix, escape), Context(pieces)
        self.raw = np.array([n.replace(SPACE, " ").encode() for n in pieces.names], dtype=object)
        for b, i in pieces.byte_id.items():
            self.raw[i] = bytes((b,))
        self.parts = Cache(lambda part: array("I", self.path(part)).tobytes(), limit=80_000)
        self.packed = Cache(lambda unit: b"".join(map(self.parts.__getitem__, pieces.stretches(pieces.written(unit)))), limit=160_000)

    @functools.cached_property
    def lexicon(self) -> Lexicon:
        return Lexicon(self.pieces)

    def memos(self) -> tuple:
        return self.parts, self.packed, self.pieces.pair

    def composed(self, text: str):
        """The whole cascade for one input."""
        return compose(Text(text), self.normaliser, self.lexicon, self.context)

    def ids(self, written: list[Hashable]) -> list[int]:
        return [i for x in written for i in ([self.pieces.byte_id[b] for b in x] if isinstance(x, bytes) else [self.pieces.id[x]])]

    def path(self, written: str) -> list[int]:
        """Ids on the one path of finite weight through the lattice of a stretch, marks written out.

        Each position is reached by one path at most, so a position that leads nowhere is left for good."""
        p, n = self.pieces, len(written)
        own, pair, stands, longest = p.id, p.pair, p.stands, p.longest
        out: list[str] = []
        dead: set[int] = set()
        at, last, end = 0, "", min(n, longest)
        while at < n:
            while end > at:
                piece = written[at:end]
                if piece in own and end not in dead and (stands(last, piece) if (known := pair.get((last, piece))) is None else known):
                    break
                end -= 1
            else:
                if written[at] in own:  # no arc is left here: turn back
                    dead.add(at)
                    end = at - 1
                    piece = out.pop()
                    at -= len(piece)
                    last = out[-1] if out and out[-1] in own else ""
                    continue
                piece, end = written[at].encode("utf-8", "surrogatepass"), at + 1
            out.append(piece)
            at, last = end, "" if type(piece) is bytes else piece
            end = min(n, at + longest)
        return self.ids(out)

    def encode_packed(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.packed.__getitem__, self.pieces.units(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype="<u4").tolist()

    def decode(self, ids) -> str:
        """The inverse machine: pieces to characters, byte runs to UTF-8, marks to spaces, the mark in front gone."""
        text = b"".join(self.raw[np.asarray(ids, dtype=np.int64)].tolist()).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_machines: dict[str, Transducer] = {}


def machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(load(path), *specification(path))
    return _machines[path]


def with_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with token_ids (packed little-endian unsigned 32-bit), n_tokens and round_trip behind its own columns.

    round_trip: decoding gives the normalised text (a literal mark reads as a space). Null text: empty, no ids.
    Repeated rows: each on its own. Empty table: no rows. A column of ``docs`` that has one of the new names is
    replaced; all others pass through."""
    workers(docs.sparkSession)
    docs = docs.drop("token_ids", "n_tokens", "round_trip")
    at = docs.columns.index("text")
    schema = StructType([*docs.schema.fields, StructField("token_ids", BinaryType()), StructField("n_tokens", LongType()), StructField("round_trip", BooleanType())])

    def run(batches):
        m = machine(model_path)
        only(*m.memos())
        for batch in batches:
            texts = [t or "" for t in batch.column(at).cast(pa.string()).to_pylist()]
            packed = [m.encode_packed(t) for t in texts]
            right = [m.decode(np.frombuffer(p, dtype="<u4")) == t.replace(SPACE, " ") for p, t in zip(packed, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(packed, pa.binary()), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(right, pa.bool_())],
                names=[*batch.schema.names, "token_ids", "n_tokens", "round_trip"],
            )

    return docs.mapInArrow(run, schema)


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text from doc_id and token_ids as :func:`with_pieces` gives them. Null ids: null text."""
    workers(encoded.sparkSession)

    def run(batches):
        m = machine(model_path)
        for batch in batches:
            back = [None if p is None else m.decode(np.frombuffer(p, dtype="<u4")) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(run, "doc_id long, text string")


def encoding_digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, text_sha256 of the decoded text, round_trip: :func:`with_pieces` without its long column.

    Hashes are taken beside the encoder, so neither ids nor texts leave the worker. Null doc_id: kept. Other edge cases
    as there; other columns are ignored."""
    workers(docs.sparkSession)

    def run(batches):
        m = machine(model_path)
        only(*m.memos())
        for batch in batches:
            texts = batch.column(1).to_pylist()
            packed = [m.encode_packed(t) for t in texts]
            back = [m.decode(np.frombuffer(p, dtype="<u4")) for p in packed]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed]),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back]),
                    pa.array([b == t.replace(SPACE, " ") for b, t in zip(back, texts, strict=True)]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "text_sha256", "round_trip"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, text_sha256 string, round_trip boolean")
