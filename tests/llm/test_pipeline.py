"""The corpus pipeline, stage by stage and as a whole, against brute force."""

import hashlib
import re

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from simplicia.llm import common, near_dedup, quality_rules  # noqa: E402

PIECES = P.path("piece_bpe_32k.model")
RNG = np.random.default_rng(11)
WORDS = [f"{a}{b}{c}" for a in "bdfgklmnprst" for b in ("a", "e", "io", "u") for c in ("n", "r", "st", "ly")]


def prose(n):
    return " ".join(RNG.choice(WORDS, n))


ITEM = prose(25)
FIRST = prose(120)
CLEAN = [prose(int(n)) for n in RNG.integers(40, 160, 60)]
JUNK = [" ".join(f"{w}$$$" for w in RNG.choice(WORDS, 40)) for _ in range(40)]
LONG = prose(180_000)  # over a megabyte


def near(text, every):
    words = text.split()
    words[::every] = ["changed"] * len(words[::every])
    return " ".join(words)


ROWS = [(i, t) for i, t in enumerate(CLEAN)] + [(100 + i, t) for i, t in enumerate(JUNK)] + [
    (200, FIRST), (201, FIRST.replace(" ", "  ")), (202, FIRST + " " + prose(3)), (203, near(FIRST, 60)), (204, near(FIRST, 4)),
    (210, prose(30) + " " + ITEM.upper() + " " + prose(30)), (211, prose(30) + " " + " ".join(ITEM.split()[3:12]) + " " + prose(20)),
    (220, LONG), (220, LONG), (221, LONG + " \n"), (None, CLEAN[0]), (None, None), (230, None), (231, ""), (232, " \t"), (240, "İ ß 日本語 \U0001f600 \n x" + prose(30)), (5, CLEAN[5]),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, score string, row string, `quality_statistics` string, normalised string, task string, n_tokens string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame([(i, t, "x", "s", len(t or ""), "k", "s", "r", "q", "n", "t", "n") for i, t in ROWS], SCHEMA).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100)) for i in [*range(60), *range(100, 140)]] + [(None, 1), (3, 1), (200, None)], "doc_id long, quality int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([("a", ITEM), ("b", None), ("c", "...")], "item_id string, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def brute_quality(spark, rows, folder):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_rules.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    scores = model.score(np.array([quality_rules.statistics(t or "") for _, t in rows]))
    return [r for r, s in zip(rows, scores, strict=True) if s >= 0.3]


def brute_exact(rows):
    least, out, seen = {}, [], set()
    norm = lambda t: re.sub(r"[\x20\x09-\x0d]+", " ", t or "")
    for i, t in rows:
        if i is not None:
            least[norm(t)] = min(i, least.get(norm(t), i))
    for i, t in rows:
        if i is None or (least[norm(t)] == i and (i, norm(t)) not in seen):
            seen.add((i, norm(t)))
            out.append((i, t))
    return out


def shingles(text, size):
    words = (text or "").encode().lower().split()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def brute_near(rows, size=5, percent=80):
    label = {i: i for i, _ in rows if i is not None}
    own = {i: shingles(t, size) for i, t in rows if i is not None}
    links = [(a, b) for a in own for b in own if a < b and own[a] and 100 * len(own[a] & own[b]) >= percent * len(own[a] | own[b])]
    for _ in range(len(links)):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if all(label[a] == label[b] for a, b in links):
            break
    return [(i, t) for i, t in rows if i is None or label[i] == i]


def brute_contamination(rows, size=10):
    words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
    item = words(ITEM)
    grams = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)}
    hit = lambda t: any(tuple(w[k : k + size]) in grams for w in [words(t)] for k in range(len(w) - size + 1))
    return [(i, t) for i, t in rows if i is None or not hit(t)]


def number(doc_id):
    return -1 if doc_id is None else doc_id


def key(rows):
    return sorted((number(i), hashlib.md5((t or "").encode()).hexdigest(), t is None) for i, t in rows)


def test_stages_and_run_equal_brute_force(spark, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), ROWS
    columns = docs.columns
    brute = [lambda r: brute_quality(spark, r, folder), brute_exact, brute_near, brute_contamination]
    for (name, stage), slow in zip(corpus_pipeline.STAGES[:-1], brute, strict=True):
        before = len(rows)
        docs, rows = common.write_table(stage(spark, docs, folder), "stage"), slow(rows)
        assert docs.columns == columns, name
        assert key((r.doc_id, r.text) for r in docs.collect()) == key(rows), name
        assert len(rows) < before, name
    left = {i for i, _ in rows}
    assert {200, 204, 211, 220, 230, 240} <= left and left.isdisjoint({100, 139, 201, 202, 203, 210, 221, 231})
    assert all(i in left for i in range(60))
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert sorted((number(r.doc_id), np.frombuffer(r.token_ids, "<u4").tolist()) for r in last) == sorted((number(i), sp.encode(t or "")) for i, t in rows)
    got = corpus_pipeline.run(spark, folder).collect()
    digest = lambda t: hashlib.sha256(np.array(sp.encode(t or ""), "<u4").tobytes()).hexdigest()
    assert sorted((number(r.doc_id), r.n_tokens, r.ids_sha256, r.round_trip) for r in got) == sorted((number(i), len(sp.encode(t or "")), digest(t), True) for i, t in rows)


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("percent", [60, 80])
def test_near_links_of_families_equal_brute_force(spark, percent):
    """Families whose members lie close to the asked similarity, on both sides."""
    rng = np.random.default_rng(percent)
    rows = []
    for f in range(8):
        base = [f"f{f}w{k}" for k in range(100)]
        for m in range(14):
            own = list(base)
            for at in rng.choice(100, int(rng.integers(0, 9 if percent == 80 else 16)), replace=False):
                own[at] = f"x{f}y{m}z{at}"
            rows.append((f * 100 + m, " ".join(own)))
    kept = {i for i, _ in brute_near(rows, 4, percent)}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, percent).collect()
    assert {r.doc_id for r in got if r.kept} == kept and 8 < len(kept) < len(rows) - 30
    assert near_dedup.banding(80) == (42, 6)
    with pytest.raises(ValueError, match="percent"):
        near_dedup.banding(10)
