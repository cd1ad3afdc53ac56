"""Token counts by prefix dynamic programming.

For every prefix of a stretch that no merge crosses, the table holds the last piece of its encoding and its exact
number of tokens. A prefix of a text is whole stretches and a prefix of one, so counts at all prefixes of a text,
truncation to a budget and budget questions follow without encoding again: tables of stretches are kept, a byte an entry
(those of up to 64 characters, the most recent ones; others are rebuilt when asked for).
"""

from __future__ import annotations

import itertools
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from simplicia.llm.common import Cache, text_rows, workers
from simplicia.llm.pieces import Pieces, load


class PrefixCounter:
    """Exact token counts at prefixes, as the SentencePiece library counts without begin and end."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.parts = Cache(self._packed, limit=500_000)
        self.totals = Cache(lambda unit: sum(self.parts[part][-1] for part in pieces.stretches(pieces.written(unit))))

    def _packed(self, part: str) -> bytes | array:
        """The prefix table of a stretch, a byte an entry while counts fit one."""
        t = self.table(part)
        return bytes(t) if max(t) < 256 else array("I", t)

    def prefixes(self, written: str) -> list[int]:
        """The same as :meth:`table` of a whole unit, from the kept tables of its stretches."""
        out = [0]
        for part in self.pieces.stretches(written):
            before = out[-1]
            out.extend(before + x for x in self.parts[part][1:])
        return out

    def table(self, written: str) -> list[int]:
        """``table[i]``: tokens of the first ``i`` characters of a stretch, marks written out.

        The last piece of prefix ``i`` is the only one that stands beside the last piece of what is before it."""
        p, n = self.pieces, len(written)
        score, stands, pair = p.score, p.stands, p.pair
        counts, last = [0] * (n + 1), [""] * (n + 1)
        for i in range(1, n + 1):
            for j in range(max(0, i - p.longest), i):
                t = written[j:i]
                if t in score:
                    known = pair.get((last[j], t))
                    if stands(last[j], t) if known is None else known:
                        last[i], counts[i] = t, counts[j] + 1
                        break
            else:  # byte fallback; nothing merges with such a character
                last[i], counts[i] = "", counts[i - 1] + len(written[i - 1].encode("utf-8", "surrogatepass"))
        return counts

    def count(self, text: str) -> int:
        return sum(map(self.totals.__getitem__, self.pieces.units(text)))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every ``i`` from 0 to its length."""
        out, before = [0], 0
        for k, unit in enumerate(self.pieces.units(text)):
            t = self.prefixes(self.pieces.written(unit))
            out.extend(before + x for x in t[1 if k else 2 :])  # the first mark is no character of the text
            before += t[-1]
        return np.asarray(out, dtype=np.int64)

    def truncate(self, text: str, budget: int) -> int:
        """Characters of the longest prefix for which it and all shorter ones have at most ``budget`` tokens.

        Whole stretches come from the running sum; only the unit in which the budget ends is looked into, by its kept tables."""
        units = self.pieces.units(text)
        sums = list(itertools.accumulate(map(self.totals.__getitem__, units)))
        at = 0
        for k, unit in enumerate(units):
            written, before = self.pieces.written(unit), sums[k - 1] if k else 0
            skip = 1 if k == 0 else 0  # the mark in front of the text
            if sums[k] + len(written) > budget:  # a shorter prefix of a stretch can have more tokens than the whole
                t = self.prefixes(written)
                for i in range(1, len(t)):
                    if before + t[i] > budget:
                        return max(0, at + i - 1 - skip)
            at += len(written) - skip
        return len(text)


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(load(path))
    return _counters[path]


def count_tokens(docs: DataFrame, model_path: str, budget: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and cut_chars (characters that fit the budget) of each whole text.

    Null text: empty, with no tokens. Null doc_id: kept. Repeated rows: each on its own. Empty table: no rows.
    Other columns are ignored. Works row by row in Arrow batches, with no shuffle and a bounded cache per worker."""
    workers(docs.sparkSession)

    def run(batches):
        c = counter(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_tokens = [c.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(t.encode()) for t in texts], pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > budget for n in n_tokens]),
                    pa.array([c.truncate(t, budget) if n > budget else len(t) for t, n in zip(texts, n_tokens, strict=True)], pa.int64()),
                ],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "cut_chars"],
            )

    return text_rows(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut_chars long")
