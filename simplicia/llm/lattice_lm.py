"""Document likelihood from a lattice of subwords.

A document is its words, each behind a mark, and an end. Arcs of a word's lattice are vocabulary pieces and UTF-8 bytes
where a character is no piece; an arc that ends the word has a weight of its own. No piece crosses a mark, so a
document's probability, summed over all segmentations, is a product over words, and the log-space forward recursion runs
once for each distinct word, many words side by side.

Weights come from the existing vocabulary's scores (a BPE score is minus a rank, so 1 / (rank + 2)), which stay in them
as PRIOR pseudo-uses, and from the expected uses of each piece in all segmentations of all training words. Words seen in
training are arcs too: each gives up a discount, whose total is the share of the pieces, so a word's probability is
(c - discount) / words + share * (sum over segmentations). Word counts are over all documents.
"""

from __future__ import annotations

import functools
import math
import os
import uuid
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.llm.common import fold, forget, gathered, text_rows, workers, write_table
from simplicia.llm.pieces import SPACE, load

#: Most frequent words whose figures every worker holds; rarer words meet theirs in a join.
HEAD_WORDS = 150_000
#: Rounds of expectation-maximisation.
ROUNDS = 2
#: Uses of the whole vocabulary, dealt by its scores, that are added to those expected from training words.
PRIOR = 200.0
#: Distinct words that a task counts before it hands them on.
FLUSH = 300_000
#: Bytes of the words' rows that are summed at a time: words of one length go side by side, so many words gain.
WORD_BYTES = 2 << 20
#: Words of up to so many characters are summed without logarithms, and again with them if the sum is below _SMALL.
PLAIN = 60
_SMALL = 1e-250
_PLAIN = {"add": np.add, "times": np.multiply, "zero": 0.0, "one": 1.0}
_LANES = 4096  # words side by side
_MULT = np.uint64(0x100000001B3)


class Lattice:
    """Forward and backward recursions over many words of one length at a time."""

    def __init__(self, path: str):
        p = load(path)
        self.names = list(p.score)
        self.rank = np.array([-p.score[n] for n in self.names])
        self.longest = p.longest
        self.size = len(self.names) + 256  # bytes come last
        self.first = np.array([n.startswith(SPACE) for n in self.names] + [False] * 256)
        # what is known of each beginning of a piece: twice its number from 1 (0 if it is none), odd if a longer piece begins so
        known: dict[int, int] = {}
        for i, name in enumerate(self.names):
            h = 0
            for k, c in enumerate(name, 1):
                h = (h * int(_MULT) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                known[h] = known.get(h, 0) | (1 if k < len(name) else 2 * (i + 1))
        hashes = np.array(list(known), dtype=np.uint64)
        self.bits = max(18, (4 * len(known)).bit_length())
        self.keys, self.info = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int32)
        for h, at, info in zip(hashes, self._slot(hashes).tolist(), known.values(), strict=True):
            while self.info[at]:
                at = (at + 1) % len(self.info)
            self.keys[at], self.info[at] = h, info

    def _slot(self, h):
        return (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def prior(self) -> np.ndarray:
        """Shares of pieces and bytes from the vocabulary's scores alone, as (goes on, ends the word); bytes share a thousandth."""
        w = 1 / (np.minimum(self.rank, len(self.names)) + 2)
        return np.stack([np.concatenate([0.999 * w / w.sum(), np.full(256, 0.001 / 256)]) / 2] * 2)

    def weights(self, uses: np.ndarray, prior: float = PRIOR) -> np.ndarray:
        """Log weights (goes on, ends) from expected uses: those with the mark in front share one, all others share one."""
        q = uses + prior * self.prior()
        for group in (self.first, ~self.first):
            q[:, group] /= q[:, group].sum()
        return np.log(q)

    def find(self, h: np.ndarray) -> np.ndarray:
        """What is known of each hash; 0 of one that begins no piece."""
        at = self._slot(h).astype(np.int64)
        held = self.info[at]
        same = self.keys[at] == h
        out = np.where(same, held, np.int32(0))
        left = np.flatnonzero((held > 0) & ~same)  # another beginning is in the slot
        while len(left):
            at[left] = (at[left] + 1) % len(self.info)
            held, same = self.info[at[left]], self.keys[at[left]] == h[left]
            out[left[same]] = held[same]
            left = left[(held > 0) & ~same]
        return out

    def _arcs(self, words: list[str], n: int):
        """Arcs of words of ``n`` characters, whose places are start * words + word: for each length (places, pieces, how
        many of them don't end the word), then the places where bytes stand in and, for each, which of ``spelled`` they are.

        A start is followed only while a longer piece begins so."""
        rows = len(words)
        codes = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(rows, n).T.ravel()
        plus = codes.astype(np.uint64) + np.uint64(1)
        live, h, arcs = np.arange(n * rows), np.zeros(n * rows, np.uint64), [None]
        for length in range(1, min(n, self.longest) + 1):
            inside = np.searchsorted(live, (n - length + 1) * rows)
            live, h = live[:inside], h[:inside]
            if not len(live):
                break
            h = h * _MULT + plus[live + (length - 1) * rows]
            info = self.find(h)
            piece = info > 1
            places = live[piece]
            arcs.append((places, (info[piece] >> 1) - 1, int(np.searchsorted(places, (n - length) * rows))))
            if length == 1:
                lacks = np.flatnonzero(~piece)
            goes = (info & 1) > 0
            live, h = live[goes], h[goes]
        distinct, which = np.unique(codes[lacks], return_inverse=True)
        spelled = [[len(self.names) + x for x in chr(code).encode("utf-8", "surrogatepass")] for code in distinct.tolist()]
        return arcs, lacks, which, spelled

    @staticmethod
    def _weights(found, rows: int, n: int, logp: np.ndarray, plain: bool) -> list:
        """weights[l][i]: those of the words' arcs of length l from i, logarithms or, ``plain``, themselves."""
        arcs, lacks, which, spelled = found
        table, out = np.exp(logp) if plain else logp, [None]
        for length, (places, ids, goes) in enumerate(arcs[1:], 1):
            own = np.full((n - length + 1) * rows, 0.0 if plain else -np.inf)
            own[places[:goes]], own[places[goes:]] = table[0][ids[:goes]], table[1][ids[goes:]]
            if length == 1 and len(lacks):
                both = np.array([[logp[0][x[:-1]].sum() + logp[k][x[-1]] for x in spelled] for k in (0, 1)])
                both = both[(lacks >= (n - 1) * rows).astype(int), which]
                own[lacks] = np.exp(both) if plain else both
            out.append(own.reshape(n - length + 1, rows))
        return out

    @staticmethod
    def _forward(weights, rows: int, n: int, add=np.logaddexp, times=np.add, zero=-np.inf, one=0.0) -> np.ndarray:
        """Sums over all segmentations of each beginning, a row for each end, in log space unless told otherwise."""
        a = np.full((n + 1, rows), zero)
        a[0] = one
        for j in range(1, n + 1):
            total = times(a[j - 1], weights[1][j - 1])
            for length in range(2, min(j, len(weights) - 1) + 1):
                total = add(total, times(a[j - length], weights[length][j - length]))
            a[j] = total
        return a

    @staticmethod
    def _backward(weights, rows: int, n: int, add=np.logaddexp, times=np.add, zero=-np.inf, one=0.0) -> np.ndarray:
        b = np.full((n + 1, rows), zero)
        b[n] = one
        for i in range(n - 1, -1, -1):
            total = times(b[i + 1], weights[1][i])
            for length in range(2, min(n - i, len(weights) - 1) + 1):
                total = add(total, times(b[i + length], weights[length][i]))
            b[i] = total
        return b

    def groups(self, words: list[str]):
        """(positions, n) of words of one length, a bounded number at a time."""
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for n, at in by.items():
            lanes = max(1, min(_LANES, 400_000 // n))
            for k in range(0, len(at), lanes):
                yield at[k : k + lanes], n

    def log_likelihood(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Natural log of the summed probability of each word's segmentations into pieces; words carry their mark."""
        out = np.zeros(len(words))
        for at, n in self.groups(words):
            out[at] = self._log_likelihood([words[i] for i in at], n, logp, n <= PLAIN)
        return out

    def _log_likelihood(self, words: list[str], n: int, logp: np.ndarray, plain: bool) -> np.ndarray:
        rows = len(words)
        a = self._forward(self._weights(self._arcs(words, n), rows, n, logp, plain), rows, n, **(_PLAIN if plain else {}))[n]
        if not plain:
            return a
        small = np.flatnonzero(a < _SMALL)
        out = np.log(np.maximum(a, _SMALL))
        if len(small):
            out[small] = self._log_likelihood([words[i] for i in small], n, logp, False)
        return out

    def expected(self, words: list[str], counts: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """Expected uses (goes on, ends) of each piece over the words, each word as often as counted."""
        out, counts = np.zeros((2, self.size)), np.asarray(counts, dtype=float)
        for at, n in self.groups(words):
            self._expect([words[i] for i in at], n, counts[at], logp, n <= PLAIN, out)
        return out

    def _expect(self, words: list[str], n: int, counts: np.ndarray, logp: np.ndarray, plain: bool, out: np.ndarray) -> None:
        rows, kind = len(words), _PLAIN if plain else {}
        found = self._arcs(words, n)
        weights = self._weights(found, rows, n, logp, plain)
        a, b = self._forward(weights, rows, n, **kind), self._backward(weights, rows, n, **kind)
        if plain:
            small = np.flatnonzero(a[n] < _SMALL)
            if len(small):
                self._expect([words[i] for i in small], n, counts[small], logp, False, out)
            b *= np.where(a[n] < _SMALL, 0.0, counts / np.maximum(a[n], _SMALL))
        else:
            b += np.log(counts) - a[n]
        a, b = a.ravel(), b.ravel()

        def share(length, places):
            own, end = weights[length].ravel()[places], b[places + length * rows]
            return a[places] * own * end if plain else np.exp(a[places] + own + end)

        arcs, lacks, which, spelled = found
        pieces, uses = [], []
        for length, (places, ids, goes) in enumerate(arcs[1:], 1):
            pieces += [ids[:goes], ids[goes:] + self.size]
            uses.append(share(length, places))
        out += np.bincount(np.concatenate(pieces), weights=np.concatenate(uses), minlength=2 * self.size).reshape(2, -1)
        if len(lacks):
            used = share(1, lacks)
            every = np.bincount(which, weights=used)
            last = np.bincount(which, weights=np.where(lacks >= (n - 1) * rows, used, 0.0))
            for x, u, v in zip(spelled, every.tolist(), last.tolist(), strict=True):
                for y in x[:-1]:
                    out[0][y] += u
                out[0][x[-1]] += u - v
                out[1][x[-1]] += v


@functools.lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def _tokens(text: str) -> list[bytes]:
    return text.encode().lower().split()  # on bytes: ASCII case and the blanks 20, 09-0D only


def word_counts(docs: DataFrame) -> DataFrame:
    """word (UTF-8 bytes), c (tokens in training rows), total (in all rows) over all documents; ``docs`` has text and held_out."""

    def run(batches):
        train, rest = Counter(), Counter()

        def flush():
            words = list(train.keys() | rest.keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), pa.array([train[w] for w in words], pa.int64()), pa.array([train[w] + rest[w] for w in words], pa.int64())], names=["word", "c", "total"]
            )
            train.clear()
            rest.clear()

        for batch in batches:
            for text, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (rest if held else train).update(_tokens(text))
                if len(train) + len(rest) > FLUSH:
                    yield from flush()
        yield from flush()

    counted = docs.select("text", "held_out").mapInArrow(run, "word binary, c long, total long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def _fit(words: DataFrame, path: str) -> np.ndarray:
    """Log weights of pieces and bytes after ROUNDS of expectation-maximisation over all training words."""
    spark, lat = words.sparkSession, lattice(path)
    logp = lat.weights(np.zeros((2, lat.size)))
    sample = words.where("c > 0").select("word", "c")
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(logp)

        def expect(batches, sent=sent):
            own = lattice(path)
            total = np.zeros((2, own.size))
            for table in gathered(batches, WORD_BYTES):
                total += own.expected([SPACE + w.decode() for w in table.column(0).to_pylist()], table.column(1).to_numpy(), sent.value)
            flat = total.ravel()
            at = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["piece", "uses"])

        found = sample.mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toArrow()  # two rows a piece at most
        uses = np.zeros(2 * lat.size)
        uses[found["piece"].to_numpy()] = found["uses"].to_numpy()
        logp = lat.weights(uses.reshape(2, -1))
        sent.unpersist()
    return logp


def _frequent(words: DataFrame, head: int) -> pa.Table:
    """The most frequent words, ``head`` at most: all whose total reaches a bound that a histogram of totals gives."""
    band = F.floor(F.log2("total") * 8).cast("int")
    least, n = None, 0
    for r in sorted(words.groupBy(band.alias("band")).count().collect(), key=lambda r: -r.band):  # eight rows a power of two
        n += r["count"]
        if n > head:
            break
        least = r.band
    return words.where(band >= least if least is not None else F.lit(False)).select("word", "c", "logp", "pieces").toArrow()


_head: dict[str, dict] = {}  # the worker's frequent words, under the name of their run


def score_documents(docs: DataFrame, model_path: str, parts: int = 7, held: int = 2, head: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score of every whole text.

    Trained on rows whose crc32(doc_id as text) mod ``parts`` isn't ``held``. base_score: add-one word unigram; score:
    log10 probability with pieces and words as arcs; lattice_score: with pieces alone. Null text: empty, only its end.
    Null doc_id: a training row. Repeated rows: each counted and scored. Empty table: no rows. No training rows: pieces
    keep the vocabulary's weights and words have no arcs. Other columns are ignored.

    Two passes over the text. Frequent words (at most ``head``) are scored where they stand; the others go to their
    word's row once for each document, summed up front."""
    spark = workers(docs.sparkSession)
    rows = text_rows(docs).withColumn("held_out", F.coalesce(fold("doc_id", parts) == held, F.lit(False)))
    counts = write_table(word_counts(rows), "word-counts")
    n_docs = rows.where("not held_out").count()
    is_count = lambda k: F.count(F.when(F.col("c") == k, 1))
    n_words, distinct, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), is_count(1), is_count(2)).first()
    n, v = n_words + n_docs, distinct + (n_docs > 0)
    sent = spark.sparkContext.broadcast(_fit(counts, model_path))
    discount = once / (once + 2 * twice) if once and twice else 0.5
    share = discount * distinct / n_words if n_words else 1.0
    end = (n_docs + 1) / (n + 2)
    log_word, log_end, base_all = math.log10(1 - end), math.log10(end), math.log10(n + v + 1)

    def weigh(batches):
        lat = lattice(model_path)
        for table in gathered(batches, WORD_BYTES):
            words, c = table.column(0).to_pylist(), table.column(1).to_numpy()
            by_pieces = lat.log_likelihood([SPACE + w.decode() for w in words], sent.value)
            with np.errstate(divide="ignore"):
                by_word = np.log(np.maximum(c - discount, 0) / max(n_words, 1))
            both = np.logaddexp(by_pieces + math.log(share), by_word)
            yield from pa.Table.from_arrays([*table.columns, pa.array(both / math.log(10) + log_word), pa.array(by_pieces / math.log(10) + log_word)], names=["word", "c", "total", "logp", "pieces"]).to_batches()

    weighed = write_table(counts.mapInArrow(weigh, "word binary, c long, total long, logp double, pieces double"), "word-weights")
    forget(counts)
    name, known = uuid.uuid4().hex, spark.sparkContext.broadcast(_frequent(weighed, head))

    def frequent_words() -> dict:
        if name not in _head:
            _head.clear()
            t = known.value
            c = t["c"].to_numpy()
            _head[name] = dict(zip(t["word"].to_pylist(), zip(np.log10(c + 1).tolist(), t["logp"].to_pylist(), t["pieces"].to_pylist(), (c > 0).tolist(), strict=True), strict=True))
        return _head[name]

    def score(batches):
        frequent = frequent_words()
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                tokens = _tokens(text)
                n_known, base, total, pieces, tail, times = 0, math.log10(n_docs + 1), log_end, log_end, [], []
                for w, k in Counter(tokens).items():
                    found = frequent.get(w)
                    if found is None:
                        tail.append(w)
                        times.append(k)
                    else:
                        base += k * found[0]
                        total += k * found[1]
                        pieces += k * found[2]
                        if found[3]:
                            n_known += k
                row = int.from_bytes(os.urandom(8), "little", signed=True)
                for x, y in zip(out, (row, len(tokens) + 1, n_known + (n_docs > 0), base, total, pieces, [{"word": w, "k": k} for w, k in zip(tail, times, strict=True)]), strict=True):
                    x.append(y)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("word", pa.binary()), ("k", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True))], names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "total", "pieces", "tail"])

    scored = rows.mapInArrow(score, "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, total double, pieces double, tail array<struct<word:binary,k:long>>")
    scored = write_table(scored, "scored")  # the random row numbers are fixed from here on
    rare = scored.select(F.coalesce("doc_id", F.lit(-1)).alias("key"), "row", F.inline("tail")).join(weighed.select("word", "c", "logp", F.col("pieces").alias("piece")), "word")
    rare = rare.groupBy("key", "row").agg(
        F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("rare_base"), F.sum(F.col("k") * F.col("logp")).alias("rare_total"), F.sum(F.col("k") * F.col("piece")).alias("rare_pieces"),
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"),
    )
    both = scored.drop("tail").withColumn("key", F.coalesce("doc_id", F.lit(-1))).join(rare, ["key", "row"], "left")
    zero = F.lit(0.0)
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", zero) - F.col("n_tokens") * F.lit(base_all)).alias("base_score"), (F.col("total") + F.coalesce("rare_total", zero)).alias("score"),
        (F.col("pieces") + F.coalesce("rare_pieces", zero)).alias("lattice_score"),
    )
