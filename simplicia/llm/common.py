"""What the operators of this package share: the shared folder, written tables, folds, shipping to workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a one-column id table that may be broadcast; beyond it the join shuffles.
BROADCAST_IDS = 200_000
#: Records and bytes in one Arrow batch, at most (a batch always holds one record); documents may be long.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one on a local master."""
    global _own_folder
    set_by_cluster = spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_folder is None:
        _own_folder = "file://" + tempfile.mkdtemp(prefix="shared-")
    return _own_folder


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here, and lost executors cost no rework.

    :func:`forget` removes it once nothing reads it; tables that a result still reads stay until the caller clears the folder."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    out = write_at(df, path)
    out.written_at = path
    return out


def forget(*tables: DataFrame) -> None:
    """Remove tables of :func:`write_table` that neither a result nor a later step reads."""
    for df in tables:
        drop_path(df.sparkSession, df.written_at)


def free_name(base: str, columns: list[str]) -> str:
    """A column name that none of ``columns`` has, in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base


def write_at(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a written table that no later read needs."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def workers(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, and keep the session's Arrow batches small in rows and bytes; smaller settings stay."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))
    return spark


def gathered(batches, size: int):
    """Tables of consecutive Arrow batches that hold ``size`` bytes or a little more, for work that gains by larger ones."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if held:
        yield pa.Table.from_batches(held)


def text_rows(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, a null text as the empty one; other columns can't clash with what operators add."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def dealt(df: DataFrame, column: str, n: int, keep: str | None = None) -> DataFrame:
    """``df`` with the rows of number k of ``column`` (0 to n - 1) in a task of their own: each number meets the key that hashes to its task.

    The key stays in a column ``keep`` if named: what is grouped by it and more columns needs no further shuffle."""
    keys = df.sparkSession.range(0, 40 * n + 400).select(F.col("id").cast("int").alias("key"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("k"))
    found = dict(keys.groupBy("k").agg(F.min("key")).collect())  # a row a task
    if len(found) < n:
        raise RuntimeError("too few keys")
    name = keep or free_name("task", df.columns)
    keyed = df.withColumn(name, F.array(*(F.lit(found[k]) for k in range(n)))[F.col(column)])
    keyed = keyed.repartition(n, name)
    return keyed if keep else keyed.drop(name)


def fold(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of one byte a character take the fast ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text: str) -> str:
    """The Python twin of :func:`ascii_lower`."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def without(docs: DataFrame, ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` whose doc_id is not in ``ids``. The ids are counted first: up to ``limit`` they are broadcast, beyond it the join shuffles."""
    ids = ids.select("doc_id")
    small = ids.limit(limit + 1).count() <= limit
    return docs.join(F.broadcast(ids) if small else ids.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


_memos: weakref.WeakSet = weakref.WeakSet()


class Memo(dict):
    """What a worker remembers from batch to batch; :func:`only` empties those that a task doesn't use."""

    def __init__(self):
        super().__init__()
        _memos.add(self)

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other


class Cache(Memo):
    """A dict that computes what it lacks and forgets its older half when full. Long keys aren't kept."""

    def __init__(self, compute: Callable, limit: int = 600_000, longest: int = 64):
        super().__init__()
        self.compute, self.limit, self.longest, self.old = compute, limit, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def only(*used: Memo) -> None:
    """Empty all memos of this worker but ``used``: one worker serves many stages, and its memory is theirs in turn."""
    for memo in list(_memos):
        if not any(memo is x for x in used) and memo:
            memo.clear()
            if isinstance(memo, Cache):
                memo.old = {}
    pa.default_memory_pool().release_unused()
