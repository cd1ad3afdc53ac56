"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

A window is ``size`` consecutive words of a benchmark item (a shorter item is one window). The index stores postings
(term, document, position) of the rarest words of every window, where rarity is counted over the whole corpus. A posting
moved back by its word's place in an item gives a shift, at which the item would lie in the document. Lists are
intersected by shift: a window is proposed where all its listed words, the rarest first, agree on one. Only proposals
meet the words of their documents, which decide on the words that have no list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simplicia.llm.common import BROADCAST_IDS, ascii_lower, forget, text_rows, without, write_table

#: A word after A-Z is lower case (fixed pattern): all but 00-2F, 3A-60 and 7B-7F, written without a negated class,
#: which Java matches twenty times slower.
WORD = r"[0-9a-z\x80-\x{10FFFF}]+"
#: Windows looked up in one pass over the corpus: bounds what is broadcast (words of at most so many windows).
BLOCK_WINDOWS = 200_000
#: Index lists that a window's proposal needs, those of its rarest words.
LISTS = 2


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(WORD), F.lit(0))


def item_texts(benchmark: DataFrame) -> DataFrame:
    """item_id, text_id, words of items that have any; equal texts have one id."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("words")).where("size(words) > 0")
    return items.withColumn("text_id", F.sha2(F.array_join("words", " "), 256))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows and a key that tells apart rows of one doc_id with different texts."""
    return text_rows(docs).withColumn("row", F.xxhash64("text"))


def term_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: occurrences in the whole corpus of each of ``terms`` (a bounded table); terms that never occur are absent."""
    used = text_rows(docs).select(F.explode(words(F.col("text"))).alias("term"))
    return used.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """The written index: term, doc_id, row, position (from 1) of every occurrence of ``terms`` (a bounded table)."""
    tokens = _keyed(docs).select("doc_id", "row", F.posexplode(words(F.col("text"))).alias("p", "term"))
    return write_table(tokens.join(F.broadcast(terms), "term").select("term", "doc_id", "row", (F.col("p") + 1).alias("position")), "postings")


def occurrences(docs: DataFrame, texts: DataFrame, size: int, block: int = BLOCK_WINDOWS) -> DataFrame:
    """doc_id, row, text_id, start (from 1), length: every occurrence of every window of ``texts`` (text_id, words).

    Texts are taken in blocks of about ``block`` windows, each a pass over the corpus, so that what is broadcast stays
    bounded. Null text: no words. Null doc_id: as any other. Repeated rows: one answer. Empty tables: no rows."""
    texts = texts.select("text_id", "words").dropDuplicates(["text_id"])
    n_windows = texts.agg(F.sum(F.greatest(F.lit(1), F.size("words") - size + 1))).first()[0] or 0
    n_blocks = max(1, -(-n_windows // block))
    found = None
    for k in range(n_blocks):
        part = texts.where(F.pmod(F.xxhash64("text_id"), F.lit(n_blocks)) == k) if n_blocks > 1 else texts
        one = _block_occurrences(docs, part, size)
        found = one if found is None else found.unionByName(one)
    return found


def chosen_lists(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """text_id, p (first word, from 0), length, q (place in the text) and term of the LISTS rarest words of every window.

    Windows with a word that the corpus lacks can't occur and are left out."""
    placed = texts.select("text_id", F.size("words").alias("n_words"), F.posexplode("words").alias("q", "term"))
    counts = write_table(term_counts(docs, placed.select("term").distinct()), "term-counts")
    rated = placed.join(F.broadcast(counts), "term", "left")
    first, last = F.greatest(F.lit(0), F.col("q") - size + 1), F.least(F.col("q"), F.greatest(F.lit(0), F.col("n_words") - size))
    inside = rated.withColumn("p", F.explode(F.sequence(first, last)))
    window = Window.partitionBy("text_id", "p")
    rank = F.row_number().over(window.orderBy("n", "term", "q"))
    missing = F.count(F.when(F.col("n").isNull(), 1)).over(window)
    lists = inside.withColumn("missing", missing).where("missing = 0").withColumn("rank", rank).where(F.col("rank") <= LISTS)
    lists = write_table(lists.select("text_id", "p", F.least(F.col("n_words"), F.lit(size)).alias("length"), "q", "term"), "lists")
    forget(counts)
    return lists


def intersected(postings: DataFrame, lists: DataFrame) -> DataFrame:
    """doc_id, row, text_id, shift, windows (array of p, length): windows whose lists all have a posting at one shift.

    A word's place is a bit, modulo 64, so that lists meet in plain aggregates; longer texts may propose more."""
    bit = F.expr("shiftleft(1L, q % 64)")
    slots = lists.select("text_id", "q", "term").distinct()
    wanted = lists.groupBy("text_id", "p", "length").agg(F.bit_or(bit).alias("mask"))
    wanted = wanted.groupBy("text_id").agg(F.collect_list(F.struct("p", "length", "mask")).alias("windows"), F.min(F.bit_count("mask")).alias("least"))
    aligned = postings.join(F.broadcast(slots), "term").select("doc_id", "row", "text_id", (F.col("position") - F.col("q")).alias("shift"), bit.alias("bit"))
    met = aligned.groupBy("doc_id", "row", "text_id", "shift").agg(F.bit_or("bit").alias("got")).join(F.broadcast(wanted), "text_id").where(F.bit_count("got") >= F.col("least"))
    agreed = F.filter("windows", lambda w: (w["mask"].bitwiseAND(F.col("got")) == w["mask"]) & (F.col("shift") + w["p"] >= 1))
    return met.withColumn("windows", F.transform(agreed, lambda w: F.struct(w["p"].alias("p"), w["length"].alias("length")))).where("size(windows) > 0").drop("got", "least")


def _block_occurrences(docs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    lists = chosen_lists(docs, texts, size)
    postings = build_index(docs, lists.select("term").distinct())
    proposed = write_table(intersected(postings, lists), "proposals")
    forget(lists, postings)

    # the documents of proposals, and of these the words at the shift
    ids = proposed.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).distinct()
    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    keyed = _keyed(docs)
    same = keyed["doc_id"].eqNullSafe(F.col("hit_id")) & (keyed["row"] == F.col("hit_row"))
    asked = keyed.join(F.broadcast(ids) if small else ids, same, "left_semi").dropDuplicates(["doc_id", "row"]).select("doc_id", "row", words(F.col("text")).alias("own"))
    asked = asked.withColumnsRenamed({"doc_id": "hit_id", "row": "hit_row"})
    met = proposed.join(asked, proposed["doc_id"].eqNullSafe(asked["hit_id"]) & (proposed["row"] == asked["hit_row"])).join(F.broadcast(texts), "text_id")
    equal = F.filter("windows", lambda w: F.slice("own", F.col("shift") + w["p"], w["length"]) == F.slice("words", w["p"] + 1, w["length"]))
    return met.select("doc_id", "row", "text_id", "shift", F.explode(equal).alias("w")).select("doc_id", "row", "text_id", (F.col("shift") + F.col("w.p")).alias("start"), F.col("w.length").alias("length"))


def phrase_matches(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """doc_id, row, window_id, start (from 1), length: every exact occurrence of every whole phrase (window_id, window).

    Edge cases as :func:`occurrences`; phrases without words match nothing."""
    texts = phrases.where("size(window) > 0").select(F.col("window_id").alias("text_id"), F.col("window").alias("words"))
    longest = texts.agg(F.max(F.size("words"))).first()[0] or 1
    return occurrences(docs, texts, longest).withColumnRenamed("text_id", "window_id")


def proximity_matches(docs: DataFrame, phrases: DataFrame, span: int) -> DataFrame:
    """doc_id, row, window_id, start: places from which all distinct words of a phrase lie within ``span`` words, in any order.

    From the same kind of index: lists of all the phrases' words meet within a sliding range of positions. Words that a
    third of all text consists of make long lists, so give this rare phrases; :func:`phrase_matches` needs only rare
    lists. Null text: no words. Null doc_id: as any other. Repeated rows: one answer. Empty tables, and phrases without
    words: no rows. Phrases are a bounded table, as their words are broadcast."""
    wanted = phrases.where("size(window) > 0").select("window_id", F.array_distinct("window").alias("terms"))
    slots = write_table(wanted.select("window_id", F.size("terms").alias("needed"), F.explode("terms").alias("term")), "slots")
    postings = build_index(docs, slots.select("term").distinct()).dropDuplicates(["doc_id", "row", "position"])
    near = Window.partitionBy("doc_id", "row", "window_id").orderBy("position").rangeBetween(0, span - 1)
    placed = postings.join(F.broadcast(slots), "term")
    return placed.withColumn("met", F.size(F.collect_set("term").over(near))).where("met = needed").select("doc_id", "row", "window_id", F.col("position").alias("start"))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit (words inside any occurrence), n_items, items_sha256, contaminated, items for every row.

    Null text: no words. Null doc_id: kept. Repeated rows: each has the answer of its text. Empty tables: no rows, or
    no hits. item_id may repeat (its texts then belong together). Other columns are ignored."""
    tests = write_table(item_texts(benchmark), "item-texts")
    hits = write_table(occurrences(docs, tests, size), "matches")

    # words under the union of all occurrences: each adds what reaches beyond those before it
    spans = hits.groupBy("doc_id", "row", "start").agg(F.max("length").alias("length"))
    end = F.col("start") + F.col("length")
    earlier = Window.partitionBy("doc_id", "row").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(end).over(earlier), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), end - F.greatest(F.col("start"), reached))).groupBy("doc_id", "row").agg(F.sum("new").alias("n_hit"))
    items = hits.select("doc_id", "row", "text_id").distinct().join(F.broadcast(tests.select("text_id", "item_id").distinct()), "text_id").groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    found = covered.withColumnsRenamed({"doc_id": "hit_id", "row": "hit_row"}).join(
        items.withColumnsRenamed({"doc_id": "item_doc", "row": "item_row"}), F.col("hit_id").eqNullSafe(F.col("item_doc")) & (F.col("hit_row") == F.col("item_row"))
    )

    base = _keyed(docs).select("doc_id", "row", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    same = base["doc_id"].eqNullSafe(found["hit_id"]) & (base["row"] == found["hit_row"])
    none = F.array().cast("array<string>")
    return base.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"), F.coalesce("items", none).alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """Rows of ``docs``, all columns, whose doc_id has no occurrence of a benchmark window. Rows without doc_id stay.

    Null text: no words, stays. Repeated rows: all stay or go. Empty tables: no rows, or all stay. Columns of any name pass through."""
    hits = occurrences(docs, write_table(item_texts(benchmark), "item-texts"), size)
    return without(docs, write_table(hits.where("doc_id is not null").select("doc_id").distinct(), "contaminated"))
