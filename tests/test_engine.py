import math
from collections import Counter
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simplicia.functions import distances as D
from simplicia.functions import filters as L
from simplicia.functions.linkage import cluster
from simplicia.functions.scale import Fixed, Histogram
from simplicia.operators import colour, inspect, knn, laplacian, lsh, pairs
from simplicia.operators.cover import Filter, extra_bins, level_sets
from simplicia.plans.pipeline import Params, mapper
from simplicia.plans.session import Session
from simplicia.streaming.parameters import ParameterStream, apply_message


def points(spark, rows):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rows)], "index long, features array<double>")


@pytest.mark.parametrize(("overlap", "extra"), [(0, 0), (0.25, 1), (0.5, 1), (0.6, 2), (0.75, 3)])
def test_extra_bins(overlap, extra):
    assert extra_bins(overlap) == extra


def test_cover_of_half_overlapping_bins(spark):
    cells = level_sets(points(spark, [[v] for v in range(9)]), (Filter(L.Feature(0), 3, 0.5),))
    low = {}
    for r in cells.collect():
        low.setdefault(int(r.features[0]), set()).add(r.level_set[0] * 2)
    assert low == {v: {v // 2 * 2 - 2, v // 2 * 2} for v in range(9)}


def test_balanced_cuts_are_exact_ranks(spark):
    rng = np.random.default_rng(8)
    x = np.round(np.concatenate([rng.normal(size=60_007), np.repeat(rng.normal(size=40), 500)]), 6)
    p = spark.createDataFrame(pd.DataFrame({"index": np.arange(len(x)), "x": x})).select("index", F.array("x").alias("features"))
    f = Filter(L.Feature(0), 10, 0.25, balanced=True)
    s = np.sort(x)
    cuts = s[[max(1, -(-k * len(x) // 10)) - 1 for k in range(11)]]
    place = (x[:, None] >= cuts).sum(1) - 1
    top = np.floor(np.round(place / (10 / (10 - 9 * 0.25) * 0.75), 9)).astype(int)
    expected = Counter((top - 1).tolist()) + Counter(top.tolist())
    got = level_sets(p, (f,)).groupBy(F.col("level_set")[0].alias("bin")).count().collect()
    assert {r["bin"]: r["count"] for r in got} == dict(expected)


def test_constant_lens_has_one_bin(spark):
    assert {tuple(r.level_set) for r in level_sets(points(spark, [[3], [3]]), (Filter(L.Feature(0), 5, 0.5),)).collect()} == {(0,)}
    with pytest.raises(ValueError):
        Filter(L.Feature(0), 5, 1.0)


def test_eccentricity_and_density(spark):
    p = points(spark, [(0, 0), (0, 2), (2, 0), (2, 2)])
    values = lambda lens: [r.value for r in lens.frame(p).orderBy("index").collect()]
    assert values(L.Eccentricity(1, D.EUCLIDEAN)) == pytest.approx([(4 + 8**0.5) / 4] * 4)
    assert values(L.Eccentricity(math.inf, D.MANHATTAN)) == pytest.approx([4] * 4)
    assert values(L.Density(1.0, D.EUCLIDEAN)) == pytest.approx([2 * math.exp(-2) + math.exp(-4)] * 4)
    assert L.Eccentricity(1).frame(points(spark, [(1, 1)])).count() == 0


def test_blocks_don_t_change_neighbours(spark, monkeypatch):
    p = points(spark, [(i % 3, i // 3) for i in range(9)])
    edges = lambda: sorted((r.src, r.dst, r.distance, r.rank) for r in knn.exact_knn(p, 2, D.EUCLIDEAN).collect())
    whole = edges()
    assert len(whole) == 18 and all(d == 1.0 for _, _, d, _ in whole)
    monkeypatch.setattr(pairs.block_pairs, "__defaults__", (None, 2, None))
    assert edges() == whole


def test_fast_neighbours_keep_their_recall(spark, tmp_path):
    """Vectors without clusters, as in the tables: recall of the registered query, and the same blocks for any partitions."""
    from simplicia import registry

    x = np.random.default_rng(3).normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert registry.fast_accuracy(spark, str(tmp_path)).first().accuracy >= 0.9
    p = registry.vectors(spark, str(tmp_path))
    edges = lambda: {(r.src, r.dst, r.distance) for r in knn.fast_knn(p, 10, D.EUCLIDEAN, **registry._FAST).collect()}
    few = edges()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert edges() == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_fast_neighbours_in_one_block_are_exact(spark):
    p = points(spark, [(i % 3, i // 3) for i in range(9)])
    for d in (D.EUCLIDEAN, D.MANHATTAN):
        assert {tuple(r) for r in knn.fast_knn(p, 2, d, tables=1).collect()} == {tuple(r) for r in knn.exact_knn(p, 2, d).collect()}


def test_symmetric_graph(spark):
    g = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0)], "src long, dst long, distance double")
    either = {(r.src, r.dst): r.distance for r in knn.symmetricize(g, halve=True).collect()}
    assert either == {(0, 1): 1.0, (1, 0): 1.0, (1, 2): 1.0, (2, 1): 1.0}
    assert {(r.src, r.dst) for r in knn.symmetricize(g, mutual=True).collect()} == {(0, 1), (1, 0)}


def test_tanimoto_affinities_of_signed_points(spark):
    x = np.array([(1, 2), (-1, -2), (2, -1), (-3, 1), (0, 0), (0, 0)], float)
    inner = x @ x.T
    below = np.diag(inner)[:, None] + np.diag(inner) - inner
    expected = {(i, j): math.exp(-((1 - inner[i, j] / below[i, j]) ** 2) / 2) for i in range(6) for j in range(6) if i != j and below[i, j]}
    assert {(r.i, r.j): r.value for r in laplacian.tanimoto_affinities(points(spark, x)).collect()} == pytest.approx(expected)


def test_tanimoto_embedding_of_signed_points(spark):
    x = np.random.default_rng(5).normal(size=(60, 4))
    inner = x @ x.T
    a = np.exp(-((1 - inner / (np.diag(inner)[:, None] + np.diag(inner) - inner)) ** 2) / 2)
    np.fill_diagonal(a, 0)
    rows = laplacian.tanimoto_embedding(points(spark, x), 3).orderBy("index").collect()
    got, expected = np.array([r["values"] for r in rows]), laplacian.local_embedding(a, 3)
    assert got.shape == (60, 3) and np.abs(got) == pytest.approx(np.abs(expected), abs=1e-6)
    assert laplacian.tanimoto_embedding(points(spark, [[1, 2]])).count() == 0


def shuffled(spark):
    """Bytes that all stages so far have written to be dealt out."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def tanimoto_matrix(x):
    inner = x @ x.T
    a = np.exp(-((1 - inner / (np.diag(inner)[:, None] + np.diag(inner) - inner)) ** 2) / 2)
    np.fill_diagonal(a, 0)
    return a


def test_leading_tanimoto_vector_deals_out_no_pairs(spark):
    x = np.random.default_rng(6).normal(size=(1500, 6)).round(3)
    before = shuffled(spark)
    got = np.array([r["values"] for r in laplacian.tanimoto_vectors(points(spark, x), 1).orderBy("index").collect()])
    assert shuffled(spark) - before < 4_000_000  # 1500 times 1500 entries are more
    degree = tanimoto_matrix(x).sum(1)
    assert got[:, 0] == pytest.approx(np.sqrt(degree / degree.sum()), abs=1e-12)


def test_products_of_slices_and_blocks_are_those_of_the_matrix(spark, monkeypatch):
    monkeypatch.setattr(pairs, "SENT", 8 * pairs.PACKED * 3 * 2)  # two blocks at a time
    x = np.random.default_rng(9).normal(size=(5 * pairs.PACKED - 7, 3))
    numbered = spark.createDataFrame(pd.DataFrame({"n": range(len(x)), "features": x.tolist()}))
    blocks, a = pairs.pack(numbered), tanimoto_matrix(x)
    for width in (2, pairs.NARROW + 1):  # a pair of blocks made once, and twice
        v = np.random.default_rng(width).normal(size=(len(x), width))
        assert pairs.multiply(blocks, laplacian._similar, v) == pytest.approx(a @ v, abs=1e-9)


def test_tanimoto_vectors_of_odd_points(spark):
    x = np.array([(1, 2), (0, 0), (-1, 1), (float("nan"), 1), (0, 0), (3, 1)])
    rows = laplacian.tanimoto_vectors(points(spark, x), 1).orderBy("index").collect()
    entries = {(r.i, r.j): r.value for r in laplacian.tanimoto_affinities(points(spark, x)).collect()}
    degree = np.array([sum(v for (i, _), v in entries.items() if i == k) for k in (0, 1, 2, 4, 5)])
    assert [r["index"] for r in rows] == [0, 1, 2, 4, 5]  # what has no entry has no row
    assert [r["values"][0] for r in rows] == pytest.approx(np.sqrt(degree / degree.sum()), abs=1e-12)
    for none in ([[0, 0], [0, 0]], [[1, 2]]):
        assert laplacian.tanimoto_vectors(points(spark, none)).count() == 0
    one = laplacian.tanimoto_vectors(points(spark, [[1, 0], [0, 1]]), 1).collect()  # values 1 and -1
    assert [r["values"][0] for r in one] == pytest.approx([math.sqrt(0.5)] * 2)


def test_tanimoto_embedding_of_many_points_deals_out_no_pairs(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(1000, 4)), np.repeat(rng.normal(size=(1, 4)), 200, 0)])  # copies too
    before = shuffled(spark)
    rows = laplacian.tanimoto_embedding(points(spark, x), 3).orderBy("index").collect()
    assert shuffled(spark) - before < 4_000_000
    got, expected = np.array([r["values"] for r in rows]), laplacian.local_embedding(tanimoto_matrix(x), 3)
    assert got.shape == (1200, 3) and np.abs(got) == pytest.approx(np.abs(expected), abs=1e-6)


def test_solver_by_products_begins_anew_when_it_holds_too_much(spark, monkeypatch):
    monkeypatch.setattr(laplacian, "HELD", 30)
    monkeypatch.setattr(laplacian, "START", 1)  # a mixture of the features, so that more products are needed
    x = np.random.default_rng(3).normal(size=(600, 5))
    got = np.array([r["values"] for r in laplacian.tanimoto_embedding(points(spark, x), 4).orderBy("index").collect()])
    assert np.abs(got) == pytest.approx(np.abs(laplacian.local_embedding(tanimoto_matrix(x), 4)), abs=1e-6)


def test_mapper_and_session(spark):
    p = points(spark, [[v] for v in (*range(0, 10), *range(50, 60))])
    params = Params((Filter(L.Feature(0), 4, 0.5),), D.EUCLIDEAN, scale=Histogram(10), colouring=colour.cluster_size(5))
    graph = mapper(p, params)
    clusters = graph.clusters.collect()
    assert {i for c in clusters for i in c.members} == set(range(20))
    edges = {(r.src, r.dst) for r in graph.edges.collect()}
    members = {c.cluster_id: set(c.members) for c in clusters}
    assert {frozenset(e) for e in edges} == {frozenset((a, b)) for a in members for b in members if a < b and members[a] & members[b]}
    assert inspect.components(graph.clusters, graph.edges).count() == len(clusters)
    assert "--" in inspect.to_dot(graph.clusters, graph.edges) or not edges
    session = Session(p)
    assert {c.cluster_id for c in session.update(params).clusters.collect()} == set(members)
    built = list(session.computed)
    session.update(params)
    assert session.computed == built
    session.update(params.with_collapse(False))
    assert session.computed[len(built) :] == ["clusters", "edges", "colours"]
    assert len(list(session.run([params, params, params.with_bins(9, 3), params.with_bins(0, 3)]))) == 2
    session.close()


def test_parameter_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"seq": 1, "setting": "bins", "filter": 0, "value": 3}\n{"seq": 2, "setting": "collapse", "value": 0}\n')
    seen = []
    stream = ParameterStream(Session(points(spark, [[v] for v in range(8)])), Params((Filter(L.Feature(0), 4, 0.5),)), lambda g: seen.append(g.clusters.count()))
    stream.start(spark, str(tmp_path / "in"), str(tmp_path / "state")).awaitTermination()
    assert len(seen) == 2 and stream.params.filters[0].bins == 3 and not stream.params.collapse


def test_empty_tables(spark):
    p = spark.createDataFrame([], "index long, features array<double>")
    assert knn.fast_knn(p, 3, D.EUCLIDEAN).count() == knn.exact_knn(p, 3, D.EUCLIDEAN).count() == 0
    assert all(lsh.sketch(p, lsh.Params(2, 1.0, D.EUCLIDEAN), kind).count() == 0 for kind in ("mean", "random", "median"))
    assert L.PrincipalComponent(0).frame(p).count() == 0
    assert laplacian.embedding(laplacian.affinities(knn.exact_knn(p, 3, D.EUCLIDEAN))).count() == 0
    assert mapper(p, Params((Filter(L.Feature(0), 4, 0.5),))).clusters.count() == 0


def test_sketches(spark):
    p = points(spark, [(0, 0), (0.1, 0), (0.2, 0), (50, 50), (50.1, 50)])
    params = lsh.Params(3, 10.0, D.EUCLIDEAN, seed=1)
    groups = {tuple(r.members): r.features for r in lsh.sketch(p, params).collect()}
    assert sorted(i for g in groups for i in g) == list(range(5)) and all({0, 1, 2} >= set(g) or {3, 4} >= set(g) for g in groups)
    x = np.array([(0, 0), (0.1, 0), (0.2, 0), (50, 50), (50.1, 50)])
    assert all(f == pytest.approx(x[list(g)].mean(0)) for g, f in groups.items())
    for kind in ("random", "median", lsh.median_candidate(2)):
        assert all(list(r.features) in x[list(r.members)].tolist() for r in lsh.sketch(p, params, kind).collect())
    assert {r["index"] for r in lsh.lookup(lsh.sketch(p, params)).collect()} == set(range(5))
    assert sum(r["size"] * r.prototypes for r in lsh.sketch_frequencies(lsh.sketch(p, params)).collect()) == 5
    with pytest.raises(ValueError, match="prototype"):
        lsh.sketch(p, params, "none")
    y = np.random.default_rng(2).normal(size=(200, 3))
    sums = np.abs(y[:, None] - y[None]).sum(2).sum(1)
    assert lsh.exact_median(y, D.MANHATTAN) == sums.argmin() and sums[lsh.approximate_median(y, 5)] < np.quantile(sums, 0.2)
    # a lens on prototypes: points of one signature have one value
    values = {r["index"]: r.value for r in L.Sketched(L.Eccentricity(1, D.EUCLIDEAN), params).frame(p).collect()}
    assert all(len({values[i] for i in g}) == 1 for g in groups) and len(values) == 5
    graph = mapper(p, Params((Filter(L.Sketched(L.Density(20.0, D.EUCLIDEAN), params), 3, 0.5),), D.EUCLIDEAN))
    assert {i for c in graph.clusters.collect() for i in c.members} == set(range(5))


@pytest.mark.parametrize("distance", [D.EUCLIDEAN, D.MANHATTAN, D.COSINE, D.lp_norm(0.5)], ids=lambda d: d.name)
def test_signatures_of_near_points_agree(spark, distance):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(30, 8))
    p = points(spark, np.concatenate([base, base + 1e-4, -base]))
    params = lsh.Params(6, 4.0, distance, seed=2)
    sig = [tuple(r.s) for r in p.orderBy("index").select(lsh.signature(params, 8).alias("s")).collect()]
    share = lambda a, b: np.mean([x == y for x, y in zip(sig[a], sig[b], strict=True)])
    assert np.mean([share(i, 30 + i) for i in range(30)]) > 0.95 > np.mean([share(i, 60 + i) for i in range(30)])
    with pytest.raises(ValueError, match="hash family"):
        lsh.hash_functions(lsh.Params(2, 1.0, D.JACCARD), 8)


def test_fast_graph_in_jobs_and_symmetric(spark):
    p = points(spark, np.random.default_rng(3).normal(size=(120, 4)))
    params = knn.FastParams(k=4, distance=D.EUCLIDEAN, tables=4, share=0.4, lsh=lsh.Params(4, 1.0, D.EUCLIDEAN))
    edges = lambda x: {(r.src, r.dst) for r in knn.fast_graph(p, x).collect()}
    whole = edges(params)
    assert whole == edges(replace(params, jobs=4))
    assert edges(replace(params, symmetry=knn.Symmetry(mutual=True))) == {(a, b) for a, b in whole if (b, a) in whole}
    assert params.exact() == (4, D.EUCLIDEAN)


def test_batch_pipeline_with_a_graph_lens_and_a_provider(spark):
    p = points(spark, [[v] for v in (*range(0, 10), *range(50, 60))])
    graph = knn.symmetricize(knn.exact_knn(p, 12, D.EUCLIDEAN))
    lens = L.LaplacianEigenVector(0, distance=D.EUCLIDEAN)
    with pytest.raises(ValueError, match="neighbour graph"):
        mapper(p, Params((Filter(lens, 3, 0.5),), D.EUCLIDEAN))
    seen = mapper(p, Params((Filter(lens, 3, 0.5),), D.EUCLIDEAN), knn={"euclidean": graph}).clusters.collect()
    assert {i for c in seen for i in c.members} == set(range(20))

    def wider(x, distance, method):
        return cluster(3 * x, distance, method)

    cut = Params((Filter(L.Feature(0), 2, 0.0),), D.EUCLIDEAN, scale=Fixed(1.5))
    assert sorted(sorted(c.members) for c in mapper(p, cut).clusters.collect()) == [list(range(10)), list(range(10, 19)), [19]]
    assert sorted(sorted(c.members) for c in mapper(p, replace(cut, provider=wider)).clusters.collect()) == [[i] for i in range(20)]


def test_messages_change_parameters():
    params = Params((Filter(L.Feature(0), 4, 0.5),))
    assert apply_message(params, "distance", None, None, "cosine").distance is D.COSINE
    assert apply_message(params, "linkage", None, None, "Ward").method == "ward"
    assert apply_message(params, "colour", None, 5, "size").colouring is not params.colouring
    for setting, name in (("distance", "none"), ("linkage", "none"), ("colour", "none"), ("none", "x"), ("bins", None)):
        assert apply_message(params, setting, 0, None, name) == params
    assert apply_message(params, "overlap", 0, 0.25).filters[0].overlap == 0.25 and apply_message(params, "resolution", None, 7).scale == Histogram(7)


def test_palettes():
    assert colour.palette("Set1", 3) == ["#e41a1c", "#377eb8", "#4daf4a"] and len(colour.palette("Paired", 12)) == 12
    assert colour.palette("Blues", 3)[0] == colour.ANCHORS["Blues"][0] and len(colour.ANCHORS) + len(colour.QUALITATIVE) == 35
    assert colour.palette("YlGn", 3, {"YlGn": {3: ["#a", "#b", "#c"]}}) == ["#a", "#b", "#c"]
    with pytest.raises(ValueError, match="colours"):
        colour.palette("Set1", 10)


def test_exports(spark):
    p = points(spark, [[v] for v in range(12)])
    g = mapper(p, Params((Filter(L.Feature(0), 3, 0.5),), D.EUCLIDEAN))
    told = inspect.to_graph_dict(g.clusters, g.edges)
    assert [n["label"] for n in told["nodes"]] == [str(i) for i in range(g.clusters.count())] and len(told["edges"]) == g.edges.count() > 0
    dot = inspect.to_dot(g.clusters, g.edges, "g").splitlines()
    assert dot[0] == "graph g {" and dot[-1] == "}" and sum("--" in x for x in dot) == len(told["edges"])
    assert {e["source"] for e in told["edges"]} <= {n["id"] for n in told["nodes"]}


def test_registered_sql_has_queries():
    from simplicia import registry

    assert set(registry.oracle_sql()) == set(registry.queries())
