"""Quality classifier: a sparse ensemble of rules.

Statistics of a text feed shallow trees; every path from a root is a conjunction of conditions, a rule. A lasso
logistic model weighs the rules, and those of non-zero weight are compiled into one Spark column expression. The
model is fitted in one task on a bounded sample and comes back as one row; no rows go to the driver.
"""

from __future__ import annotations

import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from simplicia.llm.common import fold, free_name, only, text_rows, workers

#: Labelled rows that the model is fitted on, at most: those of the smallest hash of doc_id.
SAMPLE = 20_000
TREES, DEPTH, LEAF = 40, 3, 20
#: Rows that each tree is grown on, at most: drawn from the fitted ones with replacement. The lasso sees all of those.
TREE_ROWS = 4000
#: Lasso penalty. It chooses from all distinct rules, TREES * (2 ** (DEPTH + 1) - 2) at most.
PENALTY = 4e-3
STATISTICS = (
    "chars", "words", "word_length", "symbols", "capitals", "digits", "stops", "letters", "distinct_words", "top_word", "distinct_lines", "words_a_line", "bars", "longest_word", "marked_words",
)
_SYMBOLS, _STOPS, _DIGITS = b"#$%&*+<=>@^_`~{}[]\\|", b".,;:!?'\"()-", b"0123456789"
_CAPITALS = bytes(range(65, 91))
_LETTERS = _CAPITALS + bytes(range(97, 123)) + bytes(range(128, 256))


def statistics(text: str) -> tuple[float, ...]:
    """The figures named in STATISTICS, from the whole text."""
    raw = text.encode()
    n = max(1, len(raw))
    words = raw.split()
    count = Counter(words)
    k = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda chars: (len(raw) - len(raw.translate(None, chars))) / n
    letters = share(_LETTERS)
    marked = sum(c for w, c in count.items() if w[-1] in b"#$%&*!|" and len(w) > 1)
    return (
        float(len(text)), float(len(words)), len(raw) / k, share(_SYMBOLS), share(_CAPITALS) / max(letters, 1e-9), share(_DIGITS), share(_STOPS), letters,
        len(count) / k, max(count.values(), default=0) / k, len(set(lines)) / max(1, len(lines)), len(words) / max(1, len(lines)), raw.count(b"|") / k, float(max(map(len, count), default=0)), marked / k,
    )


def with_statistics(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with an array of the statistics behind its own columns, and that column's name, which no other has."""
    workers(docs.sparkSession)
    at, name = docs.columns.index("text"), free_name("quality_statistics", docs.columns)
    schema = StructType([*docs.schema.fields, StructField(name, ArrayType(DoubleType(), False), False)])

    def run(batches):
        only()
        for batch in batches:
            rows = [statistics(t or "") for t in batch.column(at).cast(pa.string()).to_pylist()]
            flat = pa.array(np.array(rows, dtype=np.float64).ravel())
            ends = pa.array(np.arange(0, len(flat) + 1, len(STATISTICS), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema), name


#: A condition: statistic's number, whether it is above (else at most) a value, and that value.
Condition = tuple[int, bool, float]


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self, name: str) -> Column:
        """The score as one expression over the array column of statistics; sums are nested in a balanced way, so the tree stays flat."""
        at = f"`{name}`"
        terms = [f"CASE WHEN {' AND '.join(f'{at}[{j}] {('>' if above else '<=')} {value!r}D' for j, above, value in c)} THEN {w!r}D ELSE 0D END" for w, c in self.rules]
        terms.insert(0, f"{self.bias!r}D")
        while len(terms) > 1:
            terms = ["(" + " + ".join(terms[i : i + 8]) + ")" for i in range(0, len(terms), 8)]
        return F.expr(f"1D / (1D + exp(-{terms[0]}))")

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same in numpy, for rows of statistics."""
        total = np.full(len(x), self.bias)
        for weight, conditions in self.rules:
            total += weight * holds(x, conditions)
        return 1 / (1 + np.exp(-total))

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "rules": self.rules})

    @staticmethod
    def from_json(text: str) -> RuleModel:
        told = json.loads(text)
        return RuleModel(told["bias"], tuple((w, tuple((j, above, value) for j, above, value in c)) for w, c in told["rules"]))


def holds(x: np.ndarray, conditions) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for j, above, value in conditions:
        out &= (x[:, j] > value) if above else (x[:, j] <= value)
    return out


def _paths(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, before: tuple[Condition, ...] = ()) -> list[tuple[Condition, ...]]:
    """Paths of one tree that splits by the largest fall of squared error among a random third of the statistics."""
    n = len(y)
    if not depth or n < 2 * LEAF or y.min() == y.max():
        return []
    best = (1e-9, -1, 0.0)
    for j in rng.choice(x.shape[1], size=max(1, x.shape[1] // 3), replace=False):
        order = np.argsort(x[:, j], kind="stable")
        v, s = x[order, j], np.cumsum(y[order])
        k = np.arange(1, n)
        fall = s[:-1] ** 2 / k + (s[-1] - s[:-1]) ** 2 / (n - k) - s[-1] ** 2 / n
        fall[(v[1:] == v[:-1]) | (k < LEAF) | (n - k < LEAF)] = 0
        at = int(fall.argmax())
        if fall[at] > best[0]:
            best = (float(fall[at]), int(j), float((v[at] + v[at + 1]) / 2))
    if best[1] < 0:
        return []
    out = []
    for above in (False, True):
        path = (*before, (best[1], above, best[2]))
        side = (x[:, best[1]] > best[2]) == above
        out += [path, *_paths(x[side], y[side], rng, depth - 1, path)]
    return out


def _lasso(masks: list[np.ndarray], y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression on rules with an L1 penalty on all but the bias, by accelerated proximal gradient.

    Rules are scaled by their spread, as common in rule ensembles, so that rare ones aren't favoured."""
    n, k = len(y), len(masks)
    scale = np.array([1.0, *(max(m.std(), 1e-6) for m in masks)])
    design = np.ones((n, k + 1), np.float32)
    for j, m in enumerate(masks):
        design[:, j + 1] = m / scale[j + 1]
    step = 4 * n / max(float(np.linalg.eigvalsh((design.T @ design).astype(float))[-1]), 1e-9)
    w, v, t = np.zeros(k + 1), np.zeros(k + 1), 1.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(design @ v.astype(np.float32)))) - y
        new = v - step * (design.T @ error.astype(np.float32)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v, w = new + (before - 1) / t * (new - w), new
    return float(w[0]), w[1:] / scale[1:]


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 7, tree_rows: int = TREE_ROWS) -> RuleModel:
    """Rules and weights from rows of statistics and 0/1 labels; each tree is grown on ``tree_rows`` at most. One class or no rows: a constant score."""
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(p / (1 - p))), ())
    rng = np.random.default_rng(seed)
    found: dict[tuple, None] = {}
    for _ in range(TREES):
        rows = np.sort(rng.choice(len(y), size=max(1, min(len(y), tree_rows)), replace=True))
        for path in _paths(x[rows], y[rows], rng, DEPTH):
            found.setdefault(path)
    distinct: dict[bytes, tuple[tuple, np.ndarray]] = {}  # rules that hold for the same rows are one
    for rule in found:
        mask = holds(x, rule)
        distinct.setdefault(np.packbits(mask).tobytes(), (rule, mask))
    bias, w = _lasso([m for _, m in distinct.values()], y, PENALTY)
    return RuleModel(bias, tuple((float(a), r) for a, (r, _) in zip(w, distinct.values(), strict=True) if a))


def train(docs: DataFrame, labels: DataFrame, parts: int = 5, held: int = 0, sample: int = SAMPLE) -> RuleModel:
    """Fit on at most ``sample`` labelled documents whose crc32(doc_id as text) mod ``parts`` isn't ``held``.

    Rows without doc_id or label are no examples; repeated labels of a document are averaged and a tie is left out. Where
    rows share a doc_id, the one of the least statistics is the example. Empty tables: a constant score."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna().where(fold("doc_id", parts) != held)
    marked = marked.groupBy("doc_id").agg(F.avg("quality").alias("quality")).where("quality <> 0.5")
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    rows, name = with_statistics(text_rows(docs).join(F.broadcast(chosen), "doc_id"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(name, "quality")).alias("s")).select("doc_id", F.col(f"s.{name}").alias("x"), "s.quality")

    def fit(batches):
        ids, x, y = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            x += batch.column(1).to_pylist()
            y += batch.column(2).to_pylist()
        order = np.argsort(np.array(ids, dtype=np.int64))
        cells = np.array(x, dtype=np.float64).reshape(-1, len(STATISTICS))[order]
        model = fit_rules(cells, (np.array(y, dtype=np.float64) > 0.5).astype(np.float64)[order])
        yield pa.RecordBatch.from_arrays([pa.array([model.to_json()])], names=["model"])

    # one task on at most ``sample`` rows of figures
    told = rows.repartition(1).mapInArrow(fit, "model string").first()
    return RuleModel.from_json(told.model) if told else fit_rules(np.empty((0, len(STATISTICS))), np.empty(0))


def score_quality(docs: DataFrame, model: RuleModel, parts: int = 5, held: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text.

    Null text: empty, scored as such. Null doc_id: kept, not held out. Repeated rows: each on its own. Empty table: no
    rows. Other columns, among them labels, lang and source, are no inputs."""
    rows, name = with_statistics(text_rows(docs))
    scored = rows.select("doc_id", F.coalesce(fold("doc_id", parts) == held, F.lit(False)).alias("held_out"), model.column(name).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """Rows of ``docs``, all columns, whose score reaches ``threshold``; nothing is shuffled.

    Null text: empty, judged as such. Null doc_id and repeated rows: each on its own. Empty table: no rows. Columns of
    any name pass through."""
    rows, name = with_statistics(docs)
    return rows.where(model.column(name) >= threshold).select(*(F.col(f"`{c}`") for c in docs.columns))
