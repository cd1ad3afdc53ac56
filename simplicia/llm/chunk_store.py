"""A content-addressed store of token-id streams.

Each document's ids are cut where a rolling hash of the last ids has its low bits zero, so equal passages give equal
chunks wherever they stand. A chunk's address is its hash; the first document (by doc_id, then place) that holds it
stores it, others refer to it. File format, Parquet in one folder:

``packs``      in ascending doc_id order: doc_id, row (tells equal doc_ids apart), part (number of the doc_id range),
               before (ids of earlier documents of the part), n_tokens, own (the chunks stored here, one after the
               other, ids as little-endian unsigned ``width``-byte integers), recipe (address, length and kind of every
               chunk: 0 own, 1 own and used elsewhere, 2 stored elsewhere) and root (Merkle root over the addresses)
``manifest``   per part: offset (ids of all earlier parts), documents, n_tokens, and the root of the Merkle tree over
               its documents' roots

Reading first holds every part against the manifest (documents, ids, root), then puts documents together from their
recipes, hashes every chunk again and compares Merkle roots.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import math
import os
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simplicia.llm.common import dealt, drop_path, gathered, shared_folder, text_rows, workers, write_at

#: Bytes of text that are encoded at once: new words of so many meet the library together.
GATHER = 12 << 20
#: Chunk lengths in ids: at least, on average beyond that, at most; ids under the rolling hash.
LEAST, MEAN, MOST, SPAN = 64, 256, 1024, 16
_STOPS = ".,!?;:#$%&*"
#: Rules of a tokenizer file under which letters and the stops behind them are always parted and case is dropped.
_KNOWN_RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
    "</w>", None,
)
_RECIPE = "array<struct<address:binary,length:int,kind:int>>"


@functools.lru_cache(maxsize=2)
def gears(size: int) -> np.ndarray:
    """A fixed pseudo-random 64-bit word for each id (splitmix64 of the id)."""
    x = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one document."""
    n = len(ids)
    if n <= LEAST:
        return [n] if n else []
    g = gears(65536)[ids & 0xFFFF]
    h = g.copy()
    for j in range(1, SPAN):
        h[j:] += g[:-j] << np.uint64(j)
    found = np.flatnonzero((h >> np.uint64(SPAN)) & np.uint64(MEAN - 1) == 0) + 1
    out, start = [], 0
    for end in (*found.tolist(), n):
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end - start >= LEAST or (end == n and end > start):
            out.append(end)
            start = end
    return out


def address(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


class Tree:
    """A binary hash tree over leaves that come one by one; an odd node moves up as it is. Holds one node a level."""

    def __init__(self):
        self.nodes: list[tuple[int, bytes]] = []
        self.leaves = 0

    def add(self, leaf: bytes) -> None:
        level = 0
        while self.nodes and self.nodes[-1][0] == level:
            leaf, level = address(self.nodes.pop()[1] + leaf), level + 1
        self.nodes.append((level, leaf))
        self.leaves += 1

    def root(self) -> bytes:
        """Without leaves the hash of nothing."""
        if not self.nodes:
            return address(b"")
        out = self.nodes[-1][1]
        for _, node in self.nodes[-2::-1]:
            out = address(node + out)
        return out


def merkle(leaves: list[bytes]) -> bytes:
    tree = Tree()
    for leaf in leaves:
        tree.add(leaf)
    return tree.root()


#: Letters of Latin-1 and stops behind them.
_PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,!?;:#$%&*]*$"


def _byte_letters() -> dict[int, str]:
    """Lower-case letters of Latin-1 beyond ASCII as byte-level models write them: printable bytes stand for themselves, the others for 256 and on."""
    printable = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or 174 <= b]
    place = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in printable)}
    return {c: "".join(place[b] for b in chr(c).encode()) for c in range(0xDF, 0x100) if c != 0xF7}


class Encoder:
    """Ids by the tokenizers library, word by word: space and newline always part words, so words are encoded once.

    A word of plain letters, with stops behind it or not, is its letters in lower case and the stops, which the file's
    rules always part. Letters need no more of these rules, so the new ones of a batch go to the library's model at once,
    parted by spaces; each ends in a token that ends a word. All other words take the whole tokenizer. Words are numbered
    and looked up by Arrow, and known ones lie side by side, so hardly any becomes a Python object."""

    def __init__(self, path: str, limit: int = 1_000_000, longest: int = 64):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.limit, self.longest = limit, longest
        self.words, self.sizes, self.flat = pa.array([], pa.string()), np.empty(0, np.int64), np.empty(0, self.kind)
        self.tails: dict[str, np.ndarray] = {}
        told = json.loads(self.tokenizer.to_str())
        self.quick = (told["normalizer"], told["pre_tokenizer"], told["model"].get("end_of_word_suffix"), told["model"].get("dropout")) == _KNOWN_RULES
        if self.quick:
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.ends = np.zeros(size, bool)
            self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
            self.letters = _byte_letters()

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words of lower-case letters."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, self.kind)
        text = " ".join([w if w.isascii() else w.translate(self.letters) for w in words])
        ids = np.asarray(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            raise ValueError("a word has not one end")
        return np.diff(ends, prepend=0), ids

    def _new(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of words, one after the other."""
        plain = pc.match_substring_regex(words, _PLAIN).to_numpy(zero_copy_only=False) if self.quick else np.zeros(len(words), bool)
        odd = [self._whole(w) for w in words.filter(pa.array(~plain)).to_pylist()]
        own = words.filter(pa.array(plain))
        cores = pc.utf8_rtrim(own, _STOPS)
        coded = pc.utf8_lower(cores).dictionary_encode()
        core_sizes, core_ids = self._letters(coded.dictionary.to_pylist())
        which = coded.indices.to_numpy(zero_copy_only=False)
        # pieces in the order of the words: a core and its tail, or an odd word
        stops = pc.subtract(pc.utf8_length(own), pc.utf8_length(cores)).to_numpy(zero_copy_only=False)
        tail_words = [w[-n:] for w, n in zip(own.filter(pa.array(stops > 0)).to_pylist(), stops[stops > 0].tolist(), strict=True)]
        names = list(dict.fromkeys(tail_words))
        place = {t: len(core_sizes) + i for i, t in enumerate(names)}
        others = [*map(self._whole, names), *odd]
        sizes = np.concatenate([core_sizes, np.fromiter(map(len, others), np.int64, len(others)), [0]])
        flat = np.concatenate([core_ids, np.fromiter(itertools.chain.from_iterable(others), self.kind)])
        first, second = np.empty(len(words), np.int64), np.full(len(words), len(sizes) - 1)
        first[plain] = which
        first[~plain] = len(core_sizes) + len(names) + np.arange(len(odd))
        second[np.flatnonzero(plain)[stops > 0]] = [place[t] for t in tail_words]
        return sizes[first] + sizes[second], _gather(flat, sizes, np.stack([first, second], axis=1).ravel())

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the returned sizes and ids each of ``words`` (distinct) has. Beyond ``limit`` words only this batch's stay known."""
        found = pc.index_in(words, value_set=self.words)
        missing = pc.is_null(found)
        new = words.filter(missing)
        sizes, flat = self._new(new)
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[at < 0] = len(self.words) + np.arange(len(new))
        all_sizes, all_flat = np.concatenate([self.sizes, sizes]), np.concatenate([self.flat, flat])
        if len(self.words) + len(new) <= self.limit:
            self.words, self.sizes, self.flat = pa.concat_arrays([self.words, new]), all_sizes, all_flat
        else:
            short = pc.less_equal(pc.utf8_length(words), self.longest).to_numpy(zero_copy_only=False)
            self.words, self.sizes, self.flat = words.filter(pa.array(short)), all_sizes[at[short]], _gather(all_flat, all_sizes, at[short])
        return at, all_sizes, all_flat

    def __call__(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, each with ``end`` behind it, and where each text's ids end."""
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        at, sizes, flat = self.learn(coded.dictionary)
        closes = np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))
        words = np.insert(at[coded.indices.to_numpy(zero_copy_only=False)], closes, len(sizes))
        sizes, flat = np.append(sizes, 1), np.append(flat, self.kind.type(end))
        ends = np.cumsum(sizes[words])
        return _gather(flat, sizes, words), ends[closes + np.arange(len(closes))]


def _gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` (of the given sizes, one after the other) that ``which`` names, in its order."""
    lengths = sizes[which]
    ends = np.cumsum(lengths)
    at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - lengths), lengths)
    at += np.arange(len(at))
    return flat[at]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


@dataclass(frozen=True)
class Store:
    """A written store: its folder and the bytes of an id."""

    path: str
    width: int

    def packs(self, spark: SparkSession) -> DataFrame:
        """A row a document."""
        return self.rows(spark).where("recipe is not null")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(
            f"doc_id long, row long, part int, before long, n_tokens long, own binary, recipe {_RECIPE}, root binary"
        ).parquet(f"{self.path}/packs")

    def manifest(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("part int, offset long, documents long, n_tokens long, root binary").parquet(f"{self.path}/manifest")


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, path: str | None = None) -> Store:
    """Encode every whole text, append ``end_id``, and write the store; see the module for its format.

    Null text: empty, only the end id. Null doc_id: first in order. Repeated rows and rows of one doc_id: each kept,
    in the order of their contents. Empty table: a store without rows. Other columns are ignored.

    A part is a range of doc_id between quantiles, one a shuffle partition. Payload moves once; who stores a chunk is settled on addresses alone."""
    spark = workers(docs.sparkSession)
    path = path or f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    kind = encoder(tokenizer_path).kind

    def encode(batches):
        enc = encoder(tokenizer_path)
        for table in gathered(batches, GATHER):
            out: dict[str, list] = {"ids": [], "ends": [], "addresses": []}
            flat, stops = enc(table.column(1).combine_chunks(), end_id)
            for a, b in zip([0, *stops.tolist()], stops.tolist(), strict=False):
                ends, raw = cuts(flat[a:b]), flat[a:b].tobytes()
                out["ids"].append(raw)
                out["ends"].append(ends)
                out["addresses"].append([address(raw[x * kind.itemsize : y * kind.itemsize]) for x, y in zip([0, *ends], ends, strict=False)])
            yield pa.RecordBatch.from_arrays(
                [table.column(0).combine_chunks(), pa.array(out["ids"], pa.binary()), pa.array(out["ends"], pa.list_(pa.int32())), pa.array(out["addresses"], pa.list_(pa.binary()))],
                names=["doc_id", *out],
            )

    encoded = text_rows(docs).mapInArrow(encode, "doc_id long, ids binary, ends array<int>, addresses array<binary>")
    encoded = write_at(encoded, f"{path}/encoded").withColumn("row", F.xxhash64("ids"))

    used = encoded.select("doc_id", "row", F.posexplode("addresses").alias("place", "address"))
    owner = F.struct(F.col("doc_id").isNotNull().alias("numbered"), "doc_id", "row", "place")
    shared = used.groupBy("address").agg(F.min(owner).alias("owner"), F.count("*").alias("uses")).where("uses > 1").select("address", "owner")
    roles = used.join(shared, "address").select("doc_id", "row", "place", (F.col("owner") == owner).alias("owns"))

    rows = encoded.select("doc_id", "row", F.lit(1).alias("payload"), "ids", "ends", "addresses", F.lit(None).cast("int").alias("place"), F.lit(None).cast("boolean").alias("owns"))
    marks = roles.select("doc_id", "row", F.lit(0).alias("payload"), F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("array<int>").alias("ends"), F.lit(None).cast("array<binary>").alias("addresses"), "place", "owns")
    # ranges of doc_id from its quantiles, each dealt to one task, where a document's marks come right before it
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = encoded.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 100 * n)).first()[0] if n > 1 else None
    edges = sorted(set(edges or []))
    ordered = dealt(rows.unionByName(marks).withColumn("part", _range_of(F.col("doc_id"), edges)), "part", len(edges) + 1).sortWithinPartitions("doc_id", "row", "payload")

    def pack(batches):
        part, before, tree = None, 0, Tree()
        key, seen, done = None, {}, set()  # what the marks of a document say
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            doc_ids, row_ids, payload, places, owns, parts = (cols[n].to_pylist() for n in ("doc_id", "row", "payload", "place", "owns", "part"))
            out = []
            for i in range(batch.num_rows):
                if parts[i] != part:
                    if part is not None:
                        out.append((None, None, part, tree.leaves, before, None, None, tree.root()))
                    part, before, tree = parts[i], 0, Tree()
                if (doc_ids[i], row_ids[i]) != key:
                    key, seen, done = (doc_ids[i], row_ids[i]), {}, set()
                if not payload[i]:
                    seen[places[i]] = max(owns[i], seen.get(places[i], False))
                    continue
                raw, ends, names = cols["ids"][i].as_py(), cols["ends"][i].as_py(), cols["addresses"][i].as_py()
                own, recipe = [], []
                for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                    # a repeated row has the same key and place as its twin: only the first stores
                    role = 0 if k not in seen else 1 if seen[k] and k not in done else 2
                    if role == 1:
                        done.add(k)
                    if role < 2:
                        own.append(raw[a * kind.itemsize : b * kind.itemsize])
                    recipe.append({"address": names[k], "length": b - a, "kind": role})
                n, root = len(raw) // kind.itemsize, merkle(names)
                out.append((doc_ids[i], row_ids[i], part, before, n, b"".join(own), recipe, root))
                tree.add(root)
                before += n
            yield _packed(out)
        if part is not None:
            yield _packed([(None, None, part, tree.leaves, before, None, None, tree.root())])

    # rows without a recipe close a part: their before counts documents
    packed = ordered.mapInArrow(pack, f"doc_id long, row long, part int, before long, n_tokens long, own binary, recipe {_RECIPE}, root binary")
    packed.write.option("compression", "zstd").parquet(f"{path}/packs")
    drop_path(spark, f"{path}/encoded")

    store = Store(path, kind.itemsize)
    parts = store.rows(spark).where("recipe is null").select("part", F.col("before").alias("documents"), "n_tokens", "root")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a part, of which there are as many as shuffle partitions
    parts.select("part", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("offset"), "documents", "n_tokens", "root").write.parquet(f"{path}/manifest")
    return store


def _range_of(doc_id: Column, edges: list[int]) -> Column:
    """How many of the sorted ``edges`` are below an id, looked up in two steps; 0 for null."""
    if not edges:
        return F.lit(0)
    wide = math.isqrt(len(edges)) + 1
    below = lambda values: F.size(F.filter(values, lambda e: e < doc_id))
    first = below(F.array(*map(F.lit, edges[wide - 1 :: wide]))) if len(edges) >= wide else F.lit(0)
    return F.when(doc_id.isNull(), 0).otherwise(first * wide + below(F.slice(F.array(*map(F.lit, edges)), first * wide + 1, F.lit(wide))))


_PACK = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("part", pa.int32()), ("before", pa.int64()), ("n_tokens", pa.int64()), ("own", pa.binary()),
    ("recipe", pa.list_(pa.struct([("address", pa.binary()), ("length", pa.int32()), ("kind", pa.int32())]))), ("root", pa.binary()),
])


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) if rows else [()] * len(_PACK)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cells, _PACK, strict=True)], schema=_PACK)


def _slices(own: bytes, recipe: list[dict], width: int):
    """(place, kind, chunk) of the chunks that a document stores."""
    at = 0
    for place, piece in enumerate(recipe):
        if piece["kind"] < 2:
            size = piece["length"] * width
            yield place, piece["kind"], own[at : at + size]
            at += size


def broken_parts(spark: SparkSession, store: Store) -> DataFrame:
    """part of those whose documents' number, ids or tree root differ from the manifest's, or that only one of both has."""
    order = store.packs(spark).select("part", "before", "n_tokens", "root").repartition("part").sortWithinPartitions("part", "before")

    def build(batches):
        part, n, tree, whole = None, 0, Tree(), True

        def row():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([tree.leaves], pa.int64()), pa.array([n], pa.int64()), pa.array([tree.root()], pa.binary()), pa.array([whole])], names=["part", "documents", "n_tokens", "root", "whole"])

        for batch in batches:
            for p, before, size, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != part:
                    if part is not None:
                        yield row()
                    part, n, tree, whole = p, 0, Tree(), True
                whole = whole and before == n  # documents follow one another without a gap
                tree.add(root)
                n += size
        if part is not None:
            yield row()

    found = order.mapInArrow(build, "part int, documents long, n_tokens long, root binary, whole boolean")
    told = store.manifest(spark).select("part", *(F.col(c).alias(f"told_{c}") for c in ("documents", "n_tokens", "root")))
    same = F.col("whole")
    for c in ("documents", "n_tokens", "root"):
        same = same & (F.col(c) == F.col(f"told_{c}"))
    return found.join(told, "part", "full").where(~F.coalesce(same, F.lit(False))).select("part")


def read_store(spark: SparkSession, store: Store, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (binary; left out on request), ids_crc32, n_chunks, stored_chunks, root (hex).

    Parts are held against the manifest first: lost, doubled, moved or changed rows raise ValueError here. Then every
    document is put together from its recipe and verified: addresses of all its chunks, lengths and Merkle root. Only
    documents that refer to others are shuffled, and a chunk used by many moves once for each use."""
    workers(spark)
    if wrong := [r.part for r in broken_parts(spark, store).limit(5).collect()]:
        raise ValueError(f"parts {wrong} of the store differ from its manifest")
    width = store.width
    packs = store.packs(spark)
    foreign = F.exists("recipe", lambda x: x["kind"] == 2)
    columns = ["doc_id", "part", "before", "n_tokens", "chunks", "recipe", "root"]

    whole = packs.where(~foreign).select("doc_id", "part", "before", "n_tokens", F.array("own").alias("chunks"), "recipe", "root")

    def lend(batches):
        for batch in batches:
            names, chunks = [], []
            for own, recipe in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for place, role, chunk in _slices(own, recipe, width):
                    if role == 1:
                        names.append(recipe[place]["address"])
                        chunks.append(chunk)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(chunks, pa.binary())], names=["address", "chunk"])

    lent = packs.where(F.exists("recipe", lambda x: x["kind"] == 1)).select("own", "recipe").mapInArrow(lend, "address binary, chunk binary")

    def have(batches):
        for batch in batches:
            out = []
            for part, before, own, recipe in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(part, before, place, chunk) for place, _, chunk in _slices(own, recipe, width)]
            cells = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, (pa.int32(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "before", "place", "chunk"])

    borrowing = packs.where(foreign)
    needed = borrowing.select("part", "before", F.posexplode("recipe").alias("place", "piece")).where("piece.kind = 2")
    fetched = needed.select("part", "before", "place", F.col("piece.address").alias("address")).join(lent, "address").select("part", "before", "place", "chunk")
    kept = borrowing.select("part", "before", "own", "recipe").mapInArrow(have, "part int, before long, place int, chunk binary")
    joined = fetched.unionByName(kept).groupBy("part", "before").agg(F.array_sort(F.collect_list(F.struct("place", "chunk"))).alias("chunks"))
    meta = borrowing.select("doc_id", "part", "before", "n_tokens", "recipe", "root")
    # (part, before) is a document's place in the store and so its key
    built = meta.join(joined, ["part", "before"], "left").withColumn("chunks", F.transform("chunks", lambda x: x["chunk"])).select(*columns)

    def verify(batches):
        for batch in batches:
            cols = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            every = [b"".join(x or ()) for x in cols["chunks"]]
            for doc_id, n, ids, recipe, root in zip(cols["doc_id"], cols["n_tokens"], every, cols["recipe"], cols["root"], strict=True):
                at, names = 0, []
                for piece in recipe:
                    size = piece["length"] * width
                    names.append(address(ids[at : at + size]))
                    at += size
                if names != [p["address"] for p in recipe] or at != len(ids) or at != n * width or merkle(names) != root:
                    raise ValueError(f"document {doc_id} does not match its Merkle root")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), batch.column(3), *([pa.array(every, pa.binary())] if with_ids else []),
                 pa.array([_crc32(x, width) for x in every], pa.int64()),
                 pa.array([len(r) for r in cols["recipe"]], pa.int32()), pa.array([sum(p["kind"] < 2 for p in r) for r in cols["recipe"]], pa.int32()),
                 pa.array([r.hex() for r in cols["root"]])],
                names=["doc_id", "part", "before", "n_tokens", *ids_column, "ids_crc32", "n_chunks", "stored_chunks", "root"],
            )

    ids_column = ["ids"] if with_ids else []
    checked = whole.unionByName(built).mapInArrow(
        verify, f"doc_id long, part int, before long, n_tokens long, {'ids binary, ' if with_ids else ''}ids_crc32 long, n_chunks int, stored_chunks int, root string"
    )
    offsets = store.manifest(spark).select("part", "offset")  # one row a part
    return checked.join(F.broadcast(offsets), "part").select(
        "doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", *ids_column, "ids_crc32", "n_chunks", "stored_chunks", "root"
    )


def _crc32(ids: bytes, width: int) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, dtype="<u2").astype("<u4").tobytes())
