"""Operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

P = pytest.importorskip("public_tokenizers")

from simplicia.llm import chunk_store, decontaminate, exact_dedup, lattice_lm, near_dedup, piece_transducer, pii_spans, quality_rules, token_counts, toxicity  # noqa: E402

PIECES, WORDS = P.path("piece_bpe_32k.model"), P.path("word_bpe_49k.json")
LONG = " ".join(f"wort{i % 977}x, Übung {i}" for i in range(4000))
BASE = " ".join(f"alpha{i}" for i in range(60))
TEXTS = [
    (1, "The  cat\nsat."), (2, "The cat sat."), (3, None), (4, ""), (5, " \n\t "), (6, BASE), (7, BASE.replace("alpha7", "beta7")), (8, BASE + " tail words"), (9, LONG), (2, "The cat sat."),
    (None, "no id here"), (11, "İ# <|endoftext|> <s> ▁▁ x  y"), (12, "mail a.b@c.de or +1 (555) 123-4567 and 10.0.0.1"), (13, "one"), (14, "日本語 テキスト \U0001f600"),
]
SCHEMA = "doc_id long, text string, kept string, score string, row string, n_tokens string, text_sha256 string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "k", "s", "r", "n", "h") for i, t in TEXTS], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _words(text):
    return (text or "").encode().lower().split()


def test_token_counts_and_transducer(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = sorted((i or -1, len(sp.encode(t or ""))) for i, t in TEXTS)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in token_counts.count_tokens(docs, PIECES).collect()) == expected
    got = piece_transducer.with_pieces(docs, PIECES)
    assert sorted((r.doc_id or -1, np.frombuffer(r.token_ids, "<u4").tolist()) for r in got.collect()) == sorted((i or -1, sp.encode(t or "")) for i, t in TEXTS)
    assert all(r.round_trip for r in got.collect())
    back = {r.doc_id: r.text for r in piece_transducer.decode_pieces(got, PIECES).collect()}
    assert back[9] == LONG and back[3] == ""
    assert token_counts.count_tokens(empty, PIECES).count() == piece_transducer.encoding_digest(empty, PIECES).count() == 0
    c = token_counts.counter(PIECES)
    for text in ("\n a  b▁c", "hello world\nthere", " "):
        counts = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
        assert c.prefix_counts(text).tolist() == counts
        assert c.truncate(text, 2) == next((i - 1 for i, n in enumerate(counts) if n > 2), len(text))


def test_budgets_are_answered_from_kept_tables(monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    c, text = token_counts.PrefixCounter(token_counts.load(PIECES)), "Hello unbelievable-world \n\u65e5\u672c \u00dcbung 12345x " * 3
    counts = [len(sp.encode(text[:i])) for i in range(len(text) + 1)]
    assert c.count(text) == counts[-1]
    monkeypatch.setattr(c, "table", lambda part: pytest.fail("encoded again"))
    assert c.prefix_counts(text).tolist() == counts
    assert [c.truncate(text, b) for b in range(12)] == [next(i - 1 for i, n in enumerate(counts) if n > b) for b in range(12)]


def test_chunk_store(spark, docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    store = chunk_store.write_store(docs, WORDS, 2)
    rows = chunk_store.read_store(spark, store).orderBy("start").collect()
    keys = [r.doc_id for r in rows]
    assert keys == sorted(keys, key=lambda k: (k is not None, k)) and len(rows) == len(TEXTS)
    texts = dict(TEXTS)
    start = 0
    for r in rows:
        ids = tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        start += len(ids)
    assert chunk_store.read_store(spark, chunk_store.write_store(empty, WORDS, 2)).count() == 0


def test_manifest_finds_lost_changed_and_doubled_rows(spark, docs, tmp_path):
    import pyarrow.parquet as pq

    for name, change in (("lost", lambda t: t.slice(1)), ("doubled", lambda t: pa.concat_tables([t.slice(0, 1), t])), ("changed", lambda t: t.set_column(7, "root", pa.array([bytes(16)] * len(t), pa.binary())))):
        store = chunk_store.write_store(docs, WORDS, 2, path=f"file://{tmp_path}/{name}")
        assert chunk_store.broken_parts(spark, store).isEmpty()
        file = max((tmp_path / name / "packs").glob("*.parquet"), key=lambda f: pq.read_metadata(f).num_rows)
        table = change(pq.read_table(file))
        file.with_name(f".{file.name}.crc").unlink()
        pq.write_table(table, file)
        with pytest.raises(ValueError, match="manifest"):
            chunk_store.read_store(spark, store)
    store = chunk_store.write_store(docs, WORDS, 2, path=f"file://{tmp_path}/bytes")
    file = max((tmp_path / "bytes/packs").glob("*.parquet"), key=lambda f: pq.read_metadata(f).num_rows)
    table = pq.read_table(file)
    own = [x and bytes([x[0] ^ 1]) + x[1:] for x in table["own"].to_pylist()]
    file.with_name(f".{file.name}.crc").unlink()
    pq.write_table(table.set_column(5, "own", pa.array(own, pa.binary())), file)
    with pytest.raises(Exception, match="Merkle root"):
        chunk_store.read_store(spark, store).count()


def test_store_shares_chunks_between_documents(spark):
    shared = " ".join(f"word{i * 7919 % 5003}" for i in range(5000))
    rows = [(i, f"lead{i} {shared} tail{i}") for i in (5, 3, 9)]
    store = chunk_store.write_store(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, 2)
    got = {r.doc_id: r for r in chunk_store.read_store(spark, store).collect()}
    assert got[3].stored_chunks == got[3].n_chunks > 8 and got[5].stored_chunks < 4 > got[9].stored_chunks
    enc = chunk_store.encoder(WORDS)
    for i, text in rows:
        assert np.frombuffer(got[i].ids, enc.kind).tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_tree_and_forgetful_encoder():
    for n in range(10):
        level = [bytes([i]) for i in range(n)] or [chunk_store.address(b"")]
        while len(level) > 1:
            level = [chunk_store.address(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        assert chunk_store.merkle([bytes([i]) for i in range(n)]) == level[0]
    rng, letters = np.random.default_rng(1), list("aeiouthesin\u00c4\u00d6\u00df\u00e9\u00c9\u00ff \u00b5\u00ba \n\t.,#'12\u65e5\U0001f600e\u0301-_<\u0130\u017fK")
    texts = ["".join(rng.choice(letters, rng.integers(0, 14))) for _ in range(3000)] + ["<|endoftext|> a<|startoftext|>b", "don't we've I'LL", "", "x" * 200]
    enc = chunk_store.Encoder(WORDS, limit=500)
    for k in range(0, len(texts), 400):
        flat, stops = enc(pa.array(texts[k : k + 400]), 2)
        for text, ids in zip(texts[k : k + 400], np.split(flat, stops[:-1]), strict=True):
            assert ids.tolist() == enc.tokenizer.encode(text, add_special_tokens=False).ids + [2]


def test_exact_dedup(docs, empty):
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    groups = {}
    for i, t in TEXTS:
        groups.setdefault(norm(t), []).append(i)
    expected = sorted((i or -1, min((x for x in groups[norm(t)] if x), default=None) or -1, len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in TEXTS)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted((r.doc_id or -1, r.keep_id or -1, r.group_size, r.text_sha256) for r in got) == expected
    left = exact_dedup.drop_exact_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in left.collect()) == [-1, 1, 3, 5, 6, 7, 8, 9, 11, 12, 13, 14]
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_sorted_runs_meet_in_pairs(spark, monkeypatch):
    keys = {i: hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)}
    made = spark.createDataFrame([(i, keys[i % 10] if i < 60 else keys[i % 40], 1, 1) for i in range(120)] + [(None, keys[3], 1, 1)] * 2, "doc_id long, text_sha256 string, n_bytes long, `check` long").repartition(6)
    made = exact_dedup.write_table(made, "test-digests")  # its files are its partitions
    seen, write = [], exact_dedup.write_table

    def spy(df, name):
        table = write(df, name)
        seen.append(table.collect())
        return table

    monkeypatch.setattr(exact_dedup, "write_table", spy)
    merged = {r.text_sha256: (r.keep_id, r.group_size) for r in exact_dedup.merge_runs(made, slice_rows=8).collect()}
    expected = {}
    for r in made.collect():
        least, n = expected.get(r.text_sha256, (None, 0))
        expected[r.text_sha256] = (min((x for x in (least, r.doc_id) if x is not None), default=None), n + 1)
    assert merged == expected and len(merged) == 40
    runs, slices = [{r.run for r in rows} for rows in seen], [{r.slice for r in rows} for rows in seen]
    n = len(runs[0])
    assert [len(x) for x in runs] == [n, *(-(-n // 2**k) for k in range(1, len(runs)))] and runs[-1] == {0} and max(slices[-1]) > 3
    for rows in seen:  # every slice is in order and holds a digest once
        for r in rows:
            digests = [e.text_sha256 for e in r.entries]
            assert digests == sorted(set(digests))


def test_near_dedup(spark, docs, empty):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs, 4, 80).collect() if r.doc_id}
    sets = {i: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if (w := _words(t)) else set() for i, t in TEXTS}
    label = {i: i for i in sets if i}
    for _ in label:
        for a, b in itertools.combinations(sorted(label), 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(sets[i]), label[i]) for i in label}
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.drop_near_duplicates(docs).columns == docs.columns
    split = spark.createDataFrame([(1, BASE), (1, "something else entirely and more"), (2, "something else entirely and more"), (3, "x")], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in near_dedup.near_duplicates(split, 4, 80).collect()) == [(1, 1), (1, 1), (2, 1), (3, 3)]


def test_near_dedup_of_a_chain(spark):
    """Neighbours link, ends don't: components follow links that no star holds."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 4 : k * 4 + 80])) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in near_dedup.near_duplicates(docs, 4, 80).collect()} == {0}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 100), (5, 5)], "a long, b long")
    assert {(r.node, r.component) for r in near_dedup.components(edges).collect()} == {(i, 0) for i in range(31)} | {(100, 100), (101, 100)}


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, "alpha3 alpha4 alpha5 alpha6 alpha7 alpha8 alpha9 alpha10 alpha11 alpha12 alpha13"), (20, "Cat sat"), (3, None), (4, "..."), (5, "one")], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[6].n_words, got[6].n_hit, got[6].items) == (60, 11, ["1"])
    assert (got[7].n_hit, got[8].n_hit, got[2].n_hit, got[2].items, got[13].items) == (0, 11, 2, ["20"], ["5"])
    assert got[3].n_words == 0 and got[3].items_sha256 == hashlib.sha256(b"").hexdigest() and not got[3].contaminated
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.where("false")).where("contaminated").count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and {1, 2, 6, 8, 13}.isdisjoint({r.doc_id for r in kept.collect()})
    phrase = spark.createDataFrame([("p", ["alpha9", "alpha7"])], "window_id string, window array<string>")
    assert {(r.doc_id, r.start) for r in decontaminate.proximity_matches(docs, phrase, 4).collect()} == {(6, 8), (8, 8)}
    assert {(r.doc_id, r.start, r.length) for r in decontaminate.phrase_matches(docs, phrase.selectExpr("window_id", "reverse(window) as window").unionByName(spark.createDataFrame([("q", ["one"]), ("r", ["alpha4", "alpha5"])], phrase.schema))).collect()} == {(13, 1, 1), (6, 5, 2), (7, 5, 2), (8, 5, 2)}


def test_lists_meet_before_words_are_compared(spark, monkeypatch):
    """Random texts of few words against brute force; a window is proposed only if its rarest words agree on a shift."""
    rng = np.random.default_rng(4)
    vocabulary = [f"w{i}" for i in range(12)] + ["rare1", "rare2", "rare3"]
    weights = np.array([1.0] * 12 + [0.08] * 3)
    make = lambda n: " ".join(rng.choice(vocabulary, n, p=weights / weights.sum()))
    texts = {i: make(n) for i, n in enumerate([62, 50, 5, 3, 1, 4])}
    rows = [(d, make(200)) for d in range(40)]
    rows += [(100 + i, make(9) + " " + " ".join(t.split()[k : k + 30]) + " " + make(9)) for i, t in texts.items() for k in (0, 20, 40)] + [(None, texts[2]), (500, texts[0]), (500, texts[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame(list(texts.items()), "item_id long, text string")
    proposals, intersected = [], decontaminate.intersected

    def spy(postings, lists):
        out = decontaminate.write_table(intersected(postings, lists), "spied")
        terms = {(r.text_id, r.p): sorted((x.q, x.term) for x in lists.where((lists.text_id == r.text_id) & (lists.p == r.p)).collect()) for r in lists.select("text_id", "p").distinct().limit(12).collect()}
        proposals.extend((r.doc_id, r.text_id, r["shift"], w.p, terms.get((r.text_id, w.p))) for r in out.collect() for w in r.windows)
        return out

    monkeypatch.setattr(decontaminate, "intersected", spy)
    got = sorted((r.doc_id or -1, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items, 6).collect())
    expected = []
    for d, text in rows:
        own, hit, seen = text.split(), set(), set()
        for i, t in texts.items():
            t = t.split()
            for p in range(max(1, len(t) - 5)):
                w = t[p : p + 6]
                for at in range(len(own) - len(w) + 1):
                    if own[at : at + len(w)] == w:
                        hit |= set(range(at, at + len(w)))
                        seen.add(str(i))
        expected.append((d or -1, len(hit), sorted(seen)))
    assert got == sorted(expected) and any(n > 20 for _, n, _ in got)
    words = {d: t.split() for d, t in rows if d is not None and d < 40}  # other ids name several texts
    checked = [x for x in proposals if x[0] in words and x[4]]
    assert checked and all(words[d][shift + q - 1] == term for d, _, shift, _, terms in checked for q, term in terms)


def _brute_word(lat, names, logp, w):
    """Sum over all segmentations of a word with its mark, arc by arc."""

    def rest(at):
        if at == len(w):
            return 1.0
        total = 0.0
        for j in range(at + 1, len(w) + 1):
            last = int(j == len(w))
            if w[at:j] in names:
                total += math.exp(logp[last][names[w[at:j]]]) * rest(j)
            elif j == at + 1:
                own = [len(lat.names) + b for b in w[at].encode()]
                total += math.exp(logp[0][own[:-1]].sum() + logp[last][own[-1]]) * rest(j)
        return total

    return rest(0)


def _long_word(lat, names, logp, word):
    """Log probability by one recursion over the ends, term by term."""
    total = [0.0]
    for j in range(1, len(word) + 1):
        terms, k = [], int(j == len(word))
        for i in range(j):
            if word[i:j] in names:
                terms.append(total[i] + logp[k][names[word[i:j]]])
            elif j - i == 1:
                *first, last = [len(lat.names) + x for x in word[i:j].encode()]
                terms.append(total[i] + sum(logp[0][x] for x in first) + logp[k][last])
        total.append(float(np.logaddexp.reduce(terms)))
    return total[-1]


def test_lattice(spark, docs, empty):
    lat = lattice_lm.lattice(PIECES)
    names = {n: i for i, n in enumerate(lat.names)}
    start = lat.weights(np.zeros((2, lat.size)))
    assert [np.exp(start[:, g]).sum() for g in (lat.first, ~lat.first)] == pytest.approx([1, 1])
    words = ["\u2581then", "\u2581\u00f1m\u00ed", "\u2581\U0001f600x", "\u2581", "\u2581" + "ab" * 40]
    assert lat.log_likelihood(words[:4], start) == pytest.approx([math.log(_brute_word(lat, names, start, w)) for w in words[:4]])
    by_logs, plain = [], lattice_lm.PLAIN
    for limit in (0, 1000):
        lattice_lm.PLAIN = limit
        by_logs.append(lat.expected(words, np.array([1, 2, 3, 4, 5]), start))
    lattice_lm.PLAIN = plain
    assert by_logs[0] == pytest.approx(by_logs[1]) and by_logs[0][1].sum() == pytest.approx(15)  # every word ends once

    rare = ["\u2581" + "\U0001f600\U00012345" * 25, "\u2581abc"]  # without logarithms the first one's sum is 0
    uses = lat.expected(rare, np.array([3, 2]), start)
    assert np.isfinite(uses).all() and uses[1].sum() == pytest.approx(5)
    assert lat.log_likelihood(rare, start) == pytest.approx([_long_word(lat, names, start, rare[0]), math.log(_brute_word(lat, names, start, rare[1]))])

    train = [(i, t) for i, t in TEXTS if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    count = {}
    for _, t in train:
        for w in _words(t):
            count[w] = count.get(w, 0) + 1
    n_words = sum(count.values())
    n, v = n_words + len(train), len(count) + 1
    own, c = list(count), np.array(list(count.values()))
    logp = start
    for _ in range(lattice_lm.ROUNDS):
        logp = lat.weights(lat.expected([lattice_lm.SPACE + w.decode() for w in own], c, logp))
    once, twice = (c == 1).sum(), (c == 2).sum()
    d = once / (once + 2 * twice)
    end = (len(train) + 1) / (n + 2)
    every = {w for _, t in TEXTS for w in _words(t)}
    by_lattice = dict(zip(every, np.exp(lat.log_likelihood([lattice_lm.SPACE + w.decode() for w in every], logp)), strict=True))
    for head in (0, 3, 100_000):
        rows = {r.doc_id: r for r in lattice_lm.score_documents(docs, PIECES, head=head).collect()}
        for i, t in TEXTS:
            words = _words(t)
            base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in words) + math.log10((len(train) + 1) / (n + v + 1))
            assert rows[i].base_score == pytest.approx(base) and rows[i].train_tokens == n and rows[i].n_tokens == len(words) + 1
            assert rows[i].n_known == 1 + sum(w in count for w in words)
            assert rows[i].lattice_score == pytest.approx(math.log10(end) + sum(math.log10((1 - end) * by_lattice[w]) for w in words))
            known = lambda w: max(count.get(w, 0) - d, 0) / n_words + d * len(count) / n_words * by_lattice[w]
            assert rows[i].score == pytest.approx(math.log10(end) + sum(math.log10((1 - end) * known(w)) for w in words))
    assert lattice_lm.score_documents(empty, PIECES).count() == 0


def test_personal_data(docs, empty):
    rows = {r.doc_id: r for r in pii_spans.find_personal_data(docs).collect()}
    assert rows[12].spans == "email:5:13,ip:39:47,phone:17:34" or rows[12].spans.startswith("email:5:13,ip:39:47,phone:17:34")
    assert all(rows[i].base_sha256 == pii_spans.base_digest(t or "") for i, t in TEXTS)
    assert pii_spans.find_personal_data(empty).count() == 0
    assert all(r.n_spans == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == (len(r.spans.split(",")) if r.spans else 0) for r in rows.values())


def _plain_spans(text):
    """Base spans by the patterns as they are defined."""
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def right(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == "ip":
            return all(int(x) <= 255 for x in found.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits[::-1])]
            return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return {k: [m.span() for m in re.finditer(p, text) if right(k, m.group())] for k, p in patterns.items()}


def test_base_spans_equal_the_patterns():
    rng = np.random.default_rng(9)
    for letters in ("ab.@-_%+ 1", "0123456789.-+ ()", "25.0 1+", "4111 -"):
        for n in rng.integers(0, 60, 800):
            text = "".join(rng.choice(list(letters), n))
            assert pii_spans.base_spans(text) == _plain_spans(text), text
    for text in ("4111 1111 1111 1111", "4111-1111-1111-1112", "x 999.1.1.1 10.0.0.1.7", "+1 (555) 123-4567 +12", "a@b.c@d.e", "..@a.b.c", "\u0664\u0665@x.y 1" * 3):
        assert pii_spans.base_spans(text) == _plain_spans(text), text


def test_candidates_are_rejected_where_votes_are_against(spark):
    rng = np.random.default_rng(5)
    secret = lambda: "".join(rng.choice(list("0123456789abcdef"), 40))
    rows = [(i, f'the token = "{secret()}" is used') for i in range(60)]
    rows += [(100 + i, f"see {rng.integers(10**15, 10**16)}$$$ for more") for i in range(40)]
    rows += [(200 + i, f"page some_long_path_name_number_{i}/and_more_of_it here") for i in range(40)]
    rows = [(i, t) for i, t in rows if not any(_plain_spans(t).values())]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii_spans.find_personal_data(table).collect()}
    assert all(r.n_added == 1 and r.n_rejected == 0 for i, r in got.items() if i < 100)
    assert all(r.n_added == 0 and r.n_rejected == 1 and not r.spans for i, r in got.items() if i >= 100)
    report = {r["kind"]: r for r in pii_spans.labeler_report(table)}
    assert report["number"]["accepted"] == 0 < report["number"]["spans"] and report["secret"]["accepted"] == 60 < report["secret"]["spans"]
    assert all(p_real > p_not for p_real, p_not in (report["secret"][k] for k in ("shape", "gazetteer", "context")))


def test_candidates_of_long_texts_take_linear_time():
    import time

    text = " ".join(f'a{i}@mail.org token = "{i:039x}f"' for i in range(20_000))
    began = time.process_time()
    base = pii_spans.base_spans(text)
    assert len(base["email"]) == 20_000 and len(pii_spans.candidates(text, base)) == 20_000
    assert time.process_time() - began < 10


def test_secrets_of_any_length():
    for n in (19, 20, 200, 201, 5000):
        body = ("a1B2c3D4e5" * n)[:n]
        assert pii_spans.candidates(f"token={body} end", pii_spans.base_spans("")) == ([("secret", 6, 6 + n)] if n >= 20 else [])


def test_span_classifier_reads_features():
    for kind, cast, binned in itertools.product(pii_spans.ADDED, [(0, 1, 2, 1), (2, 2, 2, 0)], [(3, 2, 1, 2), (0, 3, 2, 0)]):
        assert pii_spans.unpack(pii_spans.pattern(kind, cast, binned)) == (kind, cast, binned)
    assert pii_spans.features('key="a1b2c3d4e5f6a7b8c9d0" x', 5, 25) == (1, 2, 1, 1)
    short, long = (0, 0, 0, 0), (3, 3, 1, 1)
    number = lambda cast, binned: pii_spans.pattern("secret", cast, binned)
    sure, unsure, against = (1, 1, 1, 1), (2, 2, 2, 1), (0, 2, 0, 0)
    model = pii_spans.fit_spans({number(sure, long): 50, number(unsure, long): 5, number(unsure, short): 5, number(against, short): 50})
    assert model.accepted[number(unsure, long)] > model.accepted[number(unsure, short)]


@pytest.fixture(scope="module")
def judged(spark):
    good = [(i, " ".join(f"plain{(i * 7 + k) % 50}" for k in range(30)), 1, 0) for i in range(200)]
    bad = [(200 + i, " ".join(f"junk{i}$$$" for k in range(30)), 0, 1) for i in range(100)]
    bad = [(i, t + " vile", q, x) for i, t, q, x in bad]
    rows = good + bad
    return spark.createDataFrame([(i, t, "x") for i, t, *_ in rows], "doc_id long, text string, score string"), spark.createDataFrame([(i, q, x) for i, _, q, x in rows] + [(None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")


def test_quality(judged, docs, empty):
    table, labels = judged
    model = quality_rules.train(table, labels)
    rows = quality_rules.score_quality(table, model).collect()
    assert all(r.predicted == (r.doc_id < 200) for r in rows) and all(0 <= r.score <= 1 for r in rows)
    assert quality_rules.keep_quality(table, model).columns == table.columns and quality_rules.keep_quality(table, model).count() == 200
    x = np.array([quality_rules.statistics(r.text) for r in table.collect()])
    assert sorted(model.score(x)) == pytest.approx(sorted(r.score for r in rows))
    assert quality_rules.score_quality(docs, model).count() == len(TEXTS)
    assert quality_rules.score_quality(empty, quality_rules.train(empty, labels)).count() == 0


def test_lasso_chooses_from_rules_of_all_trees(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, len(quality_rules.STATISTICS)))
    y = (x[:, :6].sum(1) + rng.normal(size=3000) > 0).astype(float)
    grown, offered, paths, lasso = [], [], quality_rules._paths, quality_rules._lasso

    def grow(x, y, rng, depth, before=()):
        out = paths(x, y, rng, depth, before)
        if not before:
            grown.append((len(y), out))
        return out

    monkeypatch.setattr(quality_rules, "_paths", grow)
    monkeypatch.setattr(quality_rules, "_lasso", lambda masks, *a: offered.extend(masks) or lasso(masks, *a))
    quality_rules.fit_rules(x, y, tree_rows=1000)
    wanted = {quality_rules.holds(x, p).tobytes() for _, tree in grown for p in tree}
    assert {m.tobytes() for m in offered} == wanted and len(wanted) > 400
    assert [n for n, _ in grown] == [1000] * quality_rules.TREES


def test_toxicity(judged, docs, empty):
    table, labels = judged
    model = toxicity.train(table, labels)
    assert list(model.thresholds) == sorted(model.thresholds)
    assert all(r.toxic == (r.doc_id >= 200) for r in toxicity.score_toxicity(table, model).collect())
    assert toxicity.score_toxicity(docs, model).count() == len(TEXTS)
    assert toxicity.score_toxicity(empty, toxicity.train(empty, labels)).count() == 0
