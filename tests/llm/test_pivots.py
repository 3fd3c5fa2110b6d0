import numpy as np
import pytest

from brindle.llm import pivots


def _brute(ids, vectors, threshold):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    led = {}
    for i in range(len(ids)):
        if i not in led:
            led[i], todo = i, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if j not in led:
                        led[j] = i
                        todo.append(j)
    return {int(ids[i]): (int(near[i].sum()), int(ids[led[i]]), led[i] == i) for i in range(len(ids))}


def _planted(n, groups, seed):
    """Random vectors in 64 dimensions and groups of near copies with pairwise cosines of about 0.96; some are equal."""
    rng = np.random.default_rng(seed)
    parts = [rng.normal(size=(n - sum(groups), 64))]
    for size in groups:
        parts.append(rng.normal(size=(1, 64)) + rng.normal(size=(size, 64)) * rng.uniform(0.1, 0.24, (size, 1)))
    vectors = np.concatenate(parts)[rng.permutation(n)]
    vectors[1::97] = vectors[0]
    return vectors


def _run(spark, vectors, threshold):
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = pivots.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), threshold=threshold)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}


@pytest.mark.parametrize(("n", "groups", "threshold"), [(2000, [660, 30, 5], 0.95), (6000, [2500, 400, 100], 0.95), (1000, [300], 0.5), (300, [40], -0.1)])
def test_all_links_of_planted_groups(spark, n, groups, threshold):
    vectors = _planted(n, groups, n)
    want, got = _brute(np.arange(n), vectors, threshold), _run(spark, vectors, threshold)
    assert sum(w[0] for w in want.values()) > groups[0] * (groups[0] - 1) / 2
    assert got == want


def test_cut_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(pivots, "CELL", 100)
    monkeypatch.setattr(pivots, "BLOCK_HOMES", 70)
    monkeypatch.setattr(pivots, "BLOCK_PROBES", 110)
    vectors = _planted(1500, [500, 60], 3)
    assert _run(spark, vectors, 0.95) == _brute(np.arange(1500), vectors, 0.95)


def test_bound_leaves_out_cells_but_no_pair():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    vectors = np.repeat(centres, 50, axis=0) + rng.normal(size=(2000, 64)) * 0.3
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    points = pivots._apart(unit[::7], 40)
    assert (points @ points.T - np.eye(len(points))).max() < pivots.APART
    home, looks = pivots._places(vectors, points, 0.95)
    a, b = np.nonzero(np.triu(unit @ unit.T >= 0.95, 1))
    first, second = np.where(home[a] <= home[b], a, b), np.where(home[a] <= home[b], b, a)
    assert len(a) and looks[first, home[second]].all()
    assert looks.mean() < 0.5


def test_unusable_vectors_link_with_nothing(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [1.0, 0.0]), (8, [1.0, 0.0])]
    found = pivots.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 8: (2, 1, False), 3: (0, 3, True), 4: (0, 4, True), 5: (0, 5, True), 6: (0, 6, True), None: (0, None, True)}


def test_lengths_and_sizes_of_components(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(size=8), rng.normal(size=8), rng.normal(size=8)
    rows = [(1, a), (2, a * 1e-200), (3, a * 1e200), (4, b * 1e-200), (5, -a), (6, np.array([3.0, 4.0])), (7, np.array([3.0, 4.1])), (8, np.array([4.0, -3.0])), (9, c * 5e-324 / np.abs(c).max()), (10, np.array([2.0])), (11, np.array([1.0])), (12, np.array([-1.0]))]
    df = spark.createDataFrame([(i, [float(x) for x in v], 1) for i, v in rows], "vec_id bigint, embedding array<double>, v int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in pivots.near_vectors(df).collect()}
    assert got == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4), 5: (0, 5), 6: (1, 6), 7: (1, 6), 8: (0, 8), 9: (0, 9), 10: (1, 10), 11: (1, 10), 12: (0, 12)}


def test_empty_table(spark):
    assert pivots.near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>")).collect() == []


def test_recall_of_the_default_settings(spark):
    """Every link of three clusterings is found; the contract asks for nine tenths."""
    for seed in (1, 2, 3):
        vectors = _planted(3000, [500 * seed, 200, 50, 7], seed)
        want, got = _brute(np.arange(3000), vectors, 0.95), _run(spark, vectors, 0.95)
        links = sum(w[0] for w in want.values())
        assert links and sum(min(got[i][0], w[0]) for i, w in want.items()) >= 0.9 * links
        assert all(got[i][0] <= w[0] for i, w in want.items())
