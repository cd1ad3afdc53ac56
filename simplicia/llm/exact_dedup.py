"""Exact deduplication by a tree-merge of sorted digest runs, in DataFrame operations only.

Rows are reduced to digests. Each input partition makes a run: its distinct digests in order, with the smallest doc_id
and a count, cut by digest prefix into slices of a bounded size. In every round runs meet in pairs (run r joins run
r // 2): slices of one prefix are put end to end and merged by a sort that takes ordered stretches as they are, equal
neighbours are verified by length and a second hash and become one, and the smallest identifier survives. After the last
round one run is left, spread over all tasks by prefix.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simplicia.llm.common import forget, free_name, text_rows, without, write_table

#: One space in place of these (fixed pattern).
BLANKS = r"[\x20\x09-\x0D]+"
#: Digests in a slice of the last run, about.
SLICE = 4096
_DIGEST = ["text_sha256", "n_bytes", "check"]


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the normalised text: sha256, and its length and xxhash64 to verify a match by."""
    norm = text_rows(docs).select("doc_id", F.regexp_replace("text", BLANKS, " ").alias("norm"))
    return norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").alias("n_bytes"), F.xxhash64("norm").alias("check"))


def _same(x: Column, y: Column) -> Column:
    return (x["text_sha256"] == y["text_sha256"]) & (x["n_bytes"] == y["n_bytes"]) & (x["check"] == y["check"])


def _met(every: Column, fan_in: int) -> Column:
    """Distinct digests of an ordered array column that holds each at most ``fan_in`` times: the first of equal neighbours takes the others in, and they go."""

    def first(x: Column, i: Column) -> Column:
        keep, size = x["keep_id"], x["group_size"]
        for j in range(1, fan_in):
            other = F.get(every, i + j)
            joins = F.coalesce(_same(x, other), F.lit(False))
            keep = F.when(joins, F.least(keep, other["keep_id"])).otherwise(keep)  # least passes over nulls
            size = F.when(joins, size + other["group_size"]).otherwise(size)
        own = F.struct(*(x[c].alias(c) for c in _DIGEST), keep.alias("keep_id"), size.alias("group_size"))
        return F.when(F.coalesce(_same(x, F.get(every, i - 1)), F.lit(False)), None).otherwise(own)

    return F.filter(F.transform(every, first), lambda x: x.isNotNull())


def leaf_runs(rows: DataFrame, slice_rows: int = SLICE) -> tuple[DataFrame, int]:
    """run, slice, entries (ordered) of the runs of ``rows``' partitions, and how many runs there are."""
    leaves = max(1, rows.rdd.getNumPartitions())
    bits = max(0, math.ceil(math.log2(max(1, rows.count()) / slice_rows)))
    prefix = F.shiftright(F.conv(F.substring("text_sha256", 1, 8), 16, 10).cast("long"), 32 - min(bits, 31)) if bits else F.lit(0).cast("long")
    own = rows.select(F.pmod(F.spark_partition_id(), F.lit(leaves)).alias("run"), *_DIGEST, F.col("doc_id").alias("keep_id"))
    own = own.groupBy("run", *_DIGEST).agg(F.min("keep_id").alias("keep_id"), F.count("*").alias("group_size"))
    entry = F.struct(*_DIGEST, "keep_id", "group_size")
    return own.groupBy("run", prefix.alias("slice")).agg(F.sort_array(F.collect_list(entry)).alias("entries")), leaves


def merge_runs(rows: DataFrame, fan_in: int = 2, slice_rows: int = SLICE) -> DataFrame:
    """Digest, keep_id (smallest doc_id; null if all are) and group_size, one row a digest.

    A digest that a third of all rows share is one entry of each run, so no task gathers it; a task merges slices of
    about ``slice_rows`` entries in the end and fewer before. Each round's runs are written to the shared folder."""
    runs, leaves = leaf_runs(rows, slice_rows)
    runs = write_table(runs, "digest-runs")
    while leaves > 1:
        met = runs.groupBy(F.floor(F.col("run") / fan_in).cast("int").alias("run"), "slice").agg(F.collect_list("entries").alias("runs"))
        # ordered arrays lie end to end, so the sort (Java's, which finds ordered stretches) only merges them; it is done
        # before neighbours are looked at, else it would be done again for each
        ordered = met.select("run", "slice", F.explode(F.array(F.sort_array(F.flatten("runs")))).alias("every"))
        merged = write_table(ordered.select("run", "slice", _met(F.col("every"), fan_in).alias("entries")), "digest-runs")
        forget(runs)
        runs, leaves = merged, -(-leaves // fan_in)
    return runs.select(F.inline("entries"))


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Null text: empty. Null doc_id: loses to any number; a group of only nulls keeps null. Repeated rows (same doc_id
    and text): each counted, all with the same answer. Empty table: no rows. Other columns are ignored."""
    rows = write_table(digests(docs), "digests")
    return rows.join(merge_runs(rows), _DIGEST).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that stay, all columns; doc_id is the key, and of repeated rows (same doc_id and text) one stays.

    Null text: empty. Rows without doc_id can't be named and stay. Empty table: no rows. Columns of any name pass through."""
    found = write_table(exact_duplicates(docs), "duplicates")
    kept = without(docs, found.where("not kept and doc_id is not null").select("doc_id").distinct())
    twice = found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return kept
    name = free_name("normalised", docs.columns)
    again = kept.join(twice, "doc_id", "left_semi").select(*docs.columns).withColumn(name, F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), BLANKS, " "))
    return without(kept, twice).unionByName(again.dropDuplicates(["doc_id", name]).drop(name))
