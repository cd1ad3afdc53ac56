"""Near-duplicate detection: universal-hash minima, banding, signature and exact verification, large-star/small-star.

Texts with equal shingle sets form a class, and one representative stands for it from there on. In a band bucket every
member is compared with the bucket's smallest id (a star, never all pairs), and once components are joined, members
outside a bucket's main component with one more member of it. Those still outside are compared with all other members,
in blocks. Two members of one component need no comparison, so components are those of all links that share a bucket.
"""

from __future__ import annotations

import functools
import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simplicia.llm.common import Cache, dealt, forget, only, text_rows, without, workers, write_table

#: A pair at the asked similarity shares no band with at most about this probability, and a banding takes at most so many hashes.
MISS, HASHES = 3e-6, 400
#: Sets of one side that a task compares, about.
BLOCK = 256
_MULT = np.uint64(0x9E3779B97F4A7C15)


@functools.lru_cache(maxsize=8)
def banding(percent: int) -> tuple[int, int]:
    """Bands and hash rows in each for pairs at ``percent`` similarity: the most rows whose bands take at most HASHES hashes.

    At 80: 42 bands of 6, which miss a pair with probability (1 - 0.8**6)**42 = 3e-6. From 25 on a banding exists."""
    if not 25 <= percent <= 100:
        raise ValueError("percent is 25 to 100")
    s = min(percent, 99) / 100
    for rows in range(6, 0, -1):
        n = round(math.log(MISS) / math.log(1 - s**rows))
        if n * rows <= HASHES:
            return n, rows
    raise ValueError("no banding")


@functools.lru_cache(maxsize=8)
def universal(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of multiply-add-shift hashing of 32-bit keys (2-independent), from a fixed seed."""
    rng = np.random.default_rng(20240229)
    return tuple(rng.integers(0, 1 << 64, hashes, dtype=np.uint64) for _ in range(2))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_word_hash = Cache(xxhash.xxh3_64_intdigest, limit=100_000)


def shingle_set(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``size``-word shingles; of the whole sequence if it has fewer words."""
    tokens = text.encode().lower().split()  # on bytes: ASCII case and the blanks 20, 09-0D only
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash.__getitem__, tokens), np.uint64, len(tokens))
    k = min(size, len(h))
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= _MULT
        out += h[j : len(h) - k + 1 + j]
    return np.unique(_mix(out + np.uint64(k)))


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """Minima of all universal hashes, 32 bits each."""
    a, b = universal(hashes)
    keys = shingles >> np.uint64(32)
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(keys), 512):
        h = np.multiply.outer(a, keys[k : k + 512])
        h += b[:, None]
        np.minimum(least, h.min(axis=1), out=least)
    return least >> np.uint64(32)


def bands(minima: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit key for each band; the band's number is part of it."""
    rows = minima.reshape(n, -1)
    h = np.arange(1, n + 1, dtype=np.uint64)
    for j in range(rows.shape[1]):
        h = _mix(h * _MULT + rows[:, j])
    return h.view(np.int64)


def _sketch(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), bands, agree (low bytes of the minima)."""
    n, depth = banding(percent)

    def run(batches):
        only(_word_hash)
        for batch in batches:
            counts, digests, keys, low = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, size)
                counts.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                m = signature(s, n * depth) if len(s) else None
                keys.append([] if m is None else bands(m, n))
                low.append(b"" if m is None else m.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(low, pa.binary())],
                names=["doc_id", "n_shingles", "digest", "bands", "agree"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, agree binary")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, size).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def _side(df: DataFrame, column: str, end: str) -> DataFrame:
    return df.select(F.col("doc_id").alias(end), F.col(column).alias(f"{column}_{end}"))


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union.

    Sizes and signatures rule out most pairs (those whose minima agree in a share five standard deviations below the
    asked one); sets are built again only for documents of pairs that are left."""
    n, depth = banding(percent)
    hashes, asked = n * depth, percent / 100
    agreed = asked - 5 * math.sqrt(asked * (1 - asked) / hashes) - 0.01

    def agree(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, hashes) for i in (2, 3))
                keep = (x == y).mean(axis=1) >= agreed
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    def confirm(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    light = sketches.select("doc_id", F.struct("n_shingles", "agree").alias("s"))
    near = pairs.join(_side(light, "s", "a"), "a").join(_side(light, "s", "b"), "b")
    fits = 100 * F.least("s_a.n_shingles", "s_b.n_shingles") >= percent * F.greatest("s_a.n_shingles", "s_b.n_shingles")
    near = near.where(fits).select("a", "b", F.col("s_a.agree").alias("x"), F.col("s_b.agree").alias("y"))
    near = write_table(near.mapInArrow(agree, "a long, b long"), "near-pairs")
    wanted = near.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = write_table(_sets(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), size), "shingle-sets")
    full = near.join(_side(sets, "shingles", "a"), "a").join(_side(sets, "shingles", "b"), "b").select("a", "b", "shingles_a", "shingles_b")
    links = write_table(full.mapInArrow(confirm, "a long, b long").distinct(), "links")
    forget(near, sets)
    return links


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) for the nodes of ``edges`` (a, b), by alternating large-star and small-star.

    Self-loops and repeated edges are harmless; nodes without an edge to another node are absent. Each round is written
    to the shared folder. Neighbours are never gathered: a node's smallest neighbour is an aggregate and joins back."""
    edges = write_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written first: a hub's row then meets its many neighbours in a join that Spark can split
        least = write_table(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = write_table(large, "large-star")
        forget(edges, least)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = write_table(small, "small-star")
        forget(large)
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = found


def _mixed(crowded: DataFrame, groups: DataFrame) -> DataFrame:
    """key, doc_id, component, main, in_main for buckets whose members are of several components; main is a bucket's largest."""
    placed = crowded.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    placed = write_table(placed, "placed")
    sizes = placed.groupBy("key", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("key").agg(F.max(F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1").select("key", F.col("main.component").alias("main"))
    main = write_table(main, "main")
    mixed = write_table(placed.join(main, "key").select("key", "doc_id", "component", "main", (F.col("component") == F.col("main")).alias("in_main")), "mixed")
    forget(placed, main)
    return mixed


def _outsider_links(mixed: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) of outsiders with members of other components, by exact sets, for every pair that shares a bucket.

    For each main component its outsiders meet all members of the buckets concerned, in blocks: a task holds two blocks
    of at most about BLOCK sets, compares them in place and emits one link for each component that a document reaches.
    No pair becomes a row. A large group is many pairs of blocks, dealt out in turn, so that tasks are even. A document
    travels once for each block of the other side, so work grows with a group's outsiders times its members: what an
    exact answer costs where many documents come close to the asked similarity without reaching it."""
    placed = mixed.groupBy("main", "doc_id").agg(F.first("component").alias("component"), F.first("in_main").alias("in_main"))
    placed = write_table(placed, "outsiders")
    counts = placed.groupBy("main").agg(F.count("*").alias("n"), F.count(F.when(~F.col("in_main"), 1)).alias("outside"))
    counts = write_table(counts.select("main", F.ceil(F.col("n") / BLOCK).cast("int").alias("right_blocks"), F.ceil(F.col("outside") / BLOCK).cast("int").alias("left_blocks")), "blocks")
    wanted = placed.select("doc_id").distinct()
    sets = write_table(_sets(docs.join(wanted, "doc_id", "left_semi").select("doc_id", "text"), size).where("octet_length(shingles) > 0").dropDuplicates(["doc_id"]), "outsider-sets")
    sized = placed.join(counts, "main")
    number = lambda n: F.pmod(F.xxhash64("doc_id"), n).cast("int")
    left = sized.where("not in_main").select("main", "doc_id", "component", "right_blocks", F.lit(0).alias("side"), number(F.col("left_blocks")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("right_blocks") - 1)).alias("j"))
    right = sized.select("main", "doc_id", "component", "right_blocks", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1)).alias("i"), number(F.col("right_blocks")).alias("j"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    turn = F.pmod(F.xxhash64("main") + F.col("i") * F.col("right_blocks") + F.col("j"), F.lit(tasks)).cast("int")
    met = dealt(left.unionByName(right.select(*left.columns)).join(sets, "doc_id").withColumn("turn", turn), "turn", tasks, keep="task")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        own = [np.frombuffer(b, np.uint64) for b in y["shingles"]]
        out: list[tuple[int, int]] = []
        if len(x) and own:
            sizes = np.array([len(s) for s in own])
            hashes, owners = np.concatenate(own), np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            ids, parts = y["doc_id"].to_numpy(), y["component"].to_numpy()
            for doc_id, part, raw in zip(x["doc_id"], x["component"], x["shingles"], strict=True):
                s = np.frombuffer(raw, np.uint64)
                low, high = np.searchsorted(hashes, s, "left"), np.searchsorted(hashes, s, "right")
                n = high - low
                at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                common = np.bincount(owners[at], minlength=len(own))
                linked = (100 * common >= percent * (len(s) + sizes - common)) & (parts != part)
                reached: dict[int, int] = {}
                for k in np.flatnonzero(linked):
                    reached[parts[k]] = min(ids[k], reached.get(parts[k], ids[k]))
                out += [(min(doc_id, k), max(doc_id, k)) for k in reached.values()]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    links = write_table(met.groupBy("task", "main", "i", "j").applyInPandas(compare, "a long, b long").distinct(), "outsider-links")
    forget(placed, counts, sets)
    return links


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row, where documents with 100 * intersection >= percent * union link.

    Null or blank text: no shingles, linked with nothing. Null doc_id: linked with nothing, component null, kept.
    Repeated rows: one answer. Rows of one doc_id with different texts: doc_id names them all, so they are linked.
    Empty table: no rows. Other columns are ignored."""
    workers(docs.sparkSession)
    rows = text_rows(docs)
    sketches = write_table(_sketch(rows, size, percent), "sketches")
    usable = sketches.where("n_shingles > 0 and doc_id is not null")
    if not usable.groupBy("doc_id").agg((F.min("digest") != F.max("digest")).alias("several")).where("several").isEmpty():
        return _with_split_ids(docs, size, percent)
    # a class is a shingle set; its smallest doc_id represents it
    # written first: a join of two plain exchanges is one that Spark splits where a class holds very many rows
    classes = write_table(usable.groupBy("digest").agg(F.min("doc_id").alias("rep")), "class-heads")
    member = write_table(usable.join(classes, "digest").select("doc_id", "rep"), "classes")
    reps = write_table(usable.join(member.where("doc_id = rep").select("doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"]), "representatives")

    keys = reps.select(F.explode("bands").alias("key"), "doc_id")
    buckets = keys.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "first")
    crowded = write_table(keys.join(buckets, "key"), "buckets")
    stars = crowded.where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")).distinct()
    links = _verified(stars, reps, rows, size, percent)
    groups = components(links)

    # outsiders against one member of the main component and one other outsider of each bucket: stars again
    mixed = _mixed(crowded, groups)
    outside = mixed.where("not in_main").select("key", "doc_id", "component")
    pivots = mixed.groupBy("key", "in_main").agg(F.min(F.struct(F.xxhash64("key", "doc_id").alias("h"), "doc_id", "component")).alias("p")).select("key", F.col("p.doc_id").alias("pivot"), F.col("p.component").alias("pivot_component"))
    again = outside.join(pivots := write_table(pivots, "pivots"), "key").where("component <> pivot_component")
    again = again.select(F.least("doc_id", "pivot").alias("a"), F.greatest("doc_id", "pivot").alias("b")).distinct().join(stars, ["a", "b"], "left_anti")
    again = write_table(again, "second-stars")
    more = _verified(again, reps, rows, size, percent)
    if not more.isEmpty():
        before = links, mixed
        links = write_table(links.unionByName(more), "links")
        groups = components(links)
        mixed = _mixed(crowded, groups)
        forget(*before)
    forget(pivots, again, more)

    more = _outsider_links(mixed, rows, size, percent)
    if not more.isEmpty():
        groups = components(links.unionByName(more))
    forget(classes, reps, crowded, mixed, links, more)

    named = member.select("doc_id", "rep").join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component_id")).distinct()
    return sketches.select("doc_id", "n_shingles").join(named, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("component_id", "doc_id").eqNullSafe(F.col("doc_id")).alias("kept")
    )


def _with_split_ids(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The answer where one doc_id names different texts: each text gets an id of its own, then ids that share a doc_id are linked.

    Own ids follow the order of doc_id, so the smallest own id reachable belongs to the smallest doc_id reachable."""
    rows = text_rows(docs).withColumn("hash", F.xxhash64("text"))
    texts = rows.where("doc_id is not null").dropDuplicates(["doc_id", "hash"])
    ordered = write_table(texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "hash").withColumn("own", F.monotonically_increasing_id()), "own-ids")
    found = near_duplicates(ordered.select(F.col("own").alias("doc_id"), "text"), size, percent)
    found = write_table(found.withColumnRenamed("doc_id", "own").join(ordered.select("own", "doc_id", "hash"), "own"), "own-found")
    by_id = found.groupBy("doc_id").agg(F.min("own").alias("b"))
    joined = found.select(F.col("own").alias("a"), F.col("component_id").alias("b")).unionByName(found.select("doc_id", F.col("own").alias("a")).join(by_id, "doc_id").select("a", "b"))
    groups = components(joined).withColumnRenamed("node", "own")
    first = ordered.select(F.col("own").alias("component"), F.col("doc_id").alias("component_id"))
    named = found.drop("component_id").join(groups, "own", "left").withColumn("component", F.coalesce("component", "own")).join(first, "component")
    named = named.select(F.col("doc_id").alias("id"), F.col("hash").alias("h"), "n_shingles", F.col("component_id").alias("c"))
    unnamed = rows.where("doc_id is null")
    lone = _sketch(unnamed.select("doc_id", "text"), size, percent).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    whole = rows.where("doc_id is not null").join(named, (F.col("doc_id") == F.col("id")) & (F.col("hash") == F.col("h")))
    return whole.select("doc_id", "n_shingles", F.col("c").alias("component_id"), (F.col("c") == F.col("doc_id")).alias("kept")).unionByName(lone)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs``, all columns, but for documents that aren't the smallest doc_id of their component.

    Null or blank texts and rows without doc_id stay. Repeated rows: all stay or go. Empty table: no rows. Columns of any
    name pass through."""
    found = near_duplicates(docs, size, percent)
    return without(docs, write_table(found.where("not kept and doc_id is not null").select("doc_id").distinct(), "near-duplicates"))
