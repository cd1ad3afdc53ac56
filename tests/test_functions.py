import time
import tracemalloc

import numpy as np
import pytest

from simplicia.functions import distances as D
from simplicia.functions import linkage
from simplicia.functions.linkage import METHODS, cluster, local_labels
from simplicia.functions.scale import BiggestGap, Danifold, FirstGap, Histogram

SQUARES = np.array([[x + i, x + j] for x in (1, 4) for i in (0, 1) for j in (0, 1)], float)


@pytest.mark.parametrize(("selector", "heights", "expected"), [
    (Histogram(10), [10, 22], 11.2), (Histogram(10), [10, 11.2, 22], 11.2), (Danifold(10), [1, 1, 1, 2, 3, 4, 11], 5.5),
    (Danifold(10), [1, 1, 1, 2, 3, 5, 11], 4.4), (FirstGap(20), [1, 1, 1, 2, 3, 4, 11], 7.5), (BiggestGap(), [1, 1, 1, 2, 3, 4, 11], 7.5), (Histogram(10), [2, 2], 2), (Histogram(10), [], 0), (Histogram(10), [7], 7),
])
def test_scale(selector, heights, expected):
    assert selector(np.array(heights, float)) == pytest.approx(expected)


def test_single_linkage_heights_and_labels():
    tree = cluster(SQUARES, D.EUCLIDEAN)
    assert tree.heights == pytest.approx([1] * 6 + [8**0.5])
    assert tree.diameter == pytest.approx(32**0.5)
    assert local_labels(SQUARES, D.EUCLIDEAN, "single", Histogram(10)).tolist() == [0] * 4 + [1] * 4
    assert local_labels(SQUARES[:2], D.EUCLIDEAN, "single", Histogram(10)).tolist() == [0, 1]
    assert local_labels(SQUARES[:1], D.EUCLIDEAN, "single", Histogram(10)).tolist() == [0]


@pytest.mark.parametrize("method", METHODS)
def test_linkages_separate_squares(method):
    assert cluster(SQUARES, D.EUCLIDEAN, method).labels(2.0).tolist() == [0] * 4 + [1] * 4
    with pytest.raises(ValueError):
        cluster(SQUARES, D.EUCLIDEAN, "none")


def _naive(x, method):
    """Heights by the linkages' definitions, from the points themselves."""
    groups, heights = [[i] for i in range(len(x))], []
    centre = {(i,): x[i] for i in range(len(x))}  # the median of wpgmc depends on the merges
    mean = {((i,), (j,)): np.linalg.norm(x[i] - x[j]) for i in range(len(x)) for j in range(len(x))}  # so does wpgma

    def apart(a, b):
        d = [np.linalg.norm(x[i] - x[j]) for i in a for j in b]
        if method == "single":
            return min(d)
        if method == "complete":
            return max(d)
        if method == "upgma":
            return float(np.mean(d))
        if method == "wpgma":
            return mean[tuple(a), tuple(b)]
        if method == "wpgmc":
            return np.linalg.norm(centre[tuple(a)] - centre[tuple(b)])
        gap = np.linalg.norm(x[a].mean(0) - x[b].mean(0))
        return gap if method == "upgmc" else gap * (2 * len(a) * len(b) / (len(a) + len(b))) ** 0.5

    while len(groups) > 1:
        h, a, b = min((apart(a, b), a, b) for k, a in enumerate(groups) for b in groups[k + 1 :])
        heights.append(h)
        groups = [g for g in groups if g not in (a, b)]
        for g in groups:
            mean[tuple(a + b), tuple(g)] = mean[tuple(g), tuple(a + b)] = (mean[tuple(a), tuple(g)] + mean[tuple(b), tuple(g)]) / 2
        centre[tuple(a + b)] = (centre[tuple(a)] + centre[tuple(b)]) / 2
        groups.append(a + b)
    return heights


@pytest.mark.parametrize("method", METHODS)
def test_heights_equal_the_definitions(method):
    x = np.random.default_rng(6).normal(size=(18, 3))
    assert cluster(x, D.EUCLIDEAN, method).heights == pytest.approx(_naive(x, method))


@pytest.mark.parametrize("distance", [D.EUCLIDEAN, D.MANHATTAN, D.COSINE], ids=lambda d: d.name)
def test_tree_by_blocks_equals_all_edges(distance, monkeypatch):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(60, 4)), rng.normal(size=(8, 4)).repeat(4, axis=0), rng.integers(1, 3, size=(20, 4))]) + 100
    every = linkage.distance_matrix(x, distance)
    i, j = np.triu_indices(len(x), 1)
    _, _, w = linkage._forest(len(x), [(i, j, every[i, j])])
    for size in (7, 2000):
        monkeypatch.setattr(linkage, "BLOCK", size)
        tree = cluster(x, distance)
        assert tree.heights == pytest.approx(np.sort(w), abs=1e-12) and tree.diameter == pytest.approx(every.max())
        cutoff = float(np.median(w)) + 1e-9
        near = every < cutoff
        for _ in range(8):
            near = near @ near
        labels = tree.labels(cutoff)
        assert (labels[:, None] == labels).tolist() == near.tolist()


def _seconds(f):
    start = time.process_time()
    f()
    return time.process_time() - start


def test_single_linkage_costs_less_than_a_row_of_distances_a_point():
    x = np.random.default_rng(9).normal(size=(4000, 64))
    rows = _seconds(lambda: [D.EUCLIDEAN.block(x[:1], x) for _ in range(200)]) * 20
    assert _seconds(lambda: cluster(x, D.EUCLIDEAN)) < 0.7 * rows


@pytest.mark.parametrize("method", [m for m in METHODS if m != "single"])
def test_linkages_cost_less_than_a_scan_of_the_matrix_a_merge(method):
    x = np.random.default_rng(9).normal(size=(1600, 4))
    d = linkage.distance_matrix(x, D.EUCLIDEAN)
    scans = _seconds(lambda: [d.argmin() for _ in range(100)]) * 16
    assert _seconds(lambda: cluster(x, D.EUCLIDEAN, method)) < 0.7 * scans


@pytest.mark.parametrize("method", ["complete", "ward", "wpgmc"])
def test_a_large_cell_needs_less_than_its_matrix(method):
    x = np.random.default_rng(11).normal(size=(6000, 3))
    tracemalloc.start()
    try:
        tree = cluster(x, D.EUCLIDEAN, method)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 0.7 * 8 * len(x) ** 2
    assert len(tree.merges) == 5999 and sorted(tree.merges.ravel()) == list(range(2 * 6000 - 2))


@pytest.mark.parametrize("distance", [D.EUCLIDEAN, D.MANHATTAN, D.COSINE], ids=lambda d: d.name)
@pytest.mark.parametrize("method", [m for m in METHODS if m != "single"])
def test_linkages_from_points_equal_those_of_the_matrix(method, distance, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(90, 6)) + 3, rng.normal(size=(8, 6)).repeat(4, axis=0), rng.normal(size=(30, 6)) / 10 + 5])
    matrix = linkage._lance_williams(linkage.distance_matrix(x, distance), method)
    for most, rows, kept in ((3, 1000, 4000), (2, 20000, 1), (40, 1 << 19, 1 << 23)):
        for name, value in (("MATRIX", most), ("ROWS", rows), ("KEPT", kept)):
            monkeypatch.setattr(linkage, name, value)
        tree = cluster(x, distance, method)
        assert tree.heights == pytest.approx(matrix.heights, abs=2e-7) and tree.diameter == pytest.approx(matrix.diameter)
        groups = [[frozenset([i]) for i in range(len(x))] for _ in range(2)]
        for found, t in zip(groups, (tree, matrix), strict=True):
            for a, b in t.merges:
                found.append(found[a] | found[b])
        assert set(groups[0][len(x) + 24 :]) == set(groups[1][len(x) + 24 :])  # 24 merges of copies may come in any order


@pytest.mark.parametrize("odd", [np.nan, np.inf])
@pytest.mark.parametrize("method", [m for m in METHODS if m != "single"])
@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_linkages_from_points_end_on_odd_values(method, odd, monkeypatch):
    monkeypatch.setattr(linkage, "MATRIX", 3)
    x = np.random.default_rng(12).normal(size=(40, 2))
    x[[3, 17], 1] = odd
    for distance in (D.EUCLIDEAN, D.MANHATTAN):
        assert sorted(cluster(x, distance, method).merges.ravel()) == list(range(78))
    assert cluster(np.ones((40, 2)), D.EUCLIDEAN, method).heights.tolist() == [0] * 39


def test_one_feature_path_equals_the_tree():
    x = np.random.default_rng(1).normal(size=(40, 1))
    assert cluster(x, D.MANHATTAN).heights == pytest.approx(cluster(np.hstack([x, np.zeros_like(x)]), D.MANHATTAN).heights)


@pytest.mark.parametrize("distance", [*D.NAMED.values(), D.minkowski(3), D.lp_norm(0.5)], ids=lambda d: d.name)
def test_column_and_block_agree(spark, distance):
    from simplicia.operators import pairs

    x = np.round(np.random.default_rng(2).normal(size=(12, 5)), 1) + 0.05
    x[:, 0] = np.arange(12) % 2
    points = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "index long, features array<double>")
    by_column = {(r.src, r.dst): r.distance for r in pairs.pair_column(points, distance.column).collect()}
    by_block = {(r.src, r.dst): r.distance for r in pairs.distances(points, distance).collect()}
    assert by_column.keys() == by_block.keys() and len(by_block) == 66
    assert all(by_column[k] == pytest.approx(by_block[k]) for k in by_block)
