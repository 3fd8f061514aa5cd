from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm.neighbours import _code_errors, _codes, _units, fit_forest, search_leaves, similar_pairs, similar_vectors

SCHEMA = "chunk_id string, vector array<float>"


def brute(rows: dict[str, list[float]], k: int) -> dict[str, list[str]]:
    ids = sorted(rows)
    x = np.array([rows[i] for i in ids])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    out = {}
    for n, i in enumerate(ids):
        order = sorted((j for j in range(len(ids)) if j != n), key=lambda j: (-round(s[n, j], 9), ids[j]))
        out[i] = [ids[j] for j in order[:k]]
    return out


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    rows = {f"v{i:04d}": (centres[i % 40] + 0.5 * rng.standard_normal(16)).astype(np.float32).tolist() for i in range(2000)}
    got = similar_vectors(spark.createDataFrame(list(rows.items()), SCHEMA), dim=16, k=5, leaf_rows=128, probes=16).collect()
    truth = brute(rows, 5)
    found = {}
    for r in got:
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour_id"]))
    assert set(found) == set(rows)
    recall = np.mean([len({n for _, n in found[i]} & set(truth[i])) / 5 for i in rows])
    assert recall >= 0.9
    assert all(sorted(r for r, _ in v) == [1, 2, 3, 4, 5] for v in found.values())


def test_only_the_asked_ids_come_out(spark):
    rng = np.random.default_rng(3)
    rows = {f"v{i:03d}": rng.standard_normal(8).astype(np.float32).tolist() for i in range(300)}
    asked = F.col("chunk_id").isin("v007", "v100")
    got = similar_vectors(spark.createDataFrame(list(rows.items()), SCHEMA), dim=8, k=3, queries=asked, leaf_rows=32, probes=60).collect()
    truth = brute(rows, 3)
    assert {r["id"] for r in got} == {"v007", "v100"} and all(r["neighbour_id"] == truth[r["id"]][r["rank"] - 1] for r in got)


def test_a_third_of_near_copies(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal(16) + 0.01 * rng.standard_normal((500, 16)), rng.standard_normal((1000, 16))]).astype(np.float32)
    frame = spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], SCHEMA)
    got = similar_vectors(frame, dim=16, k=4, floor=0.9, leaf_rows=64).collect()
    assert sum(r["id"] < "v0500" for r in got) == 500 * 4


def recall(found, x: np.ndarray, k: int) -> float:
    """Share of the true ``k`` nearest of every row (named by its number) that are listed."""
    x = x.astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    truth = np.argsort(-s, axis=1)[:, :k]
    listed = {(int(r["id"]), int(r["neighbour_id"])) for r in found}
    return float(np.mean([(i, int(j)) in listed for i, row in enumerate(truth) for j in row]))


@pytest.mark.parametrize("spread", [0.2, 0.45])  # all cosines above the floor, and most below it
def test_a_third_in_one_bundle_over_many_leaves(spark, spread):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.choice([-1.0, 1.0], 32) + spread * rng.standard_normal((3000, 32)), rng.standard_normal((6000, 32))]).astype(np.float32)
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SCHEMA)
    near = similar_vectors(frame, dim=32, k=5, floor=0.9, leaf_rows=128).collect()
    unit = x[:3000].astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    s = unit @ unit.T
    np.fill_diagonal(s, -2)
    truth = {(i, int(j)) for i in range(3000) for j in np.argsort(-s[i])[:5] if s[i, j] >= 0.9}
    listed = {(int(r["id"]), int(r["neighbour_id"])) for r in near}
    assert len(truth) > 1000 and len(truth & listed) >= 0.999 * len(truth)


@pytest.mark.parametrize(("rows", "floor"), [(25, 0.9), (500, 0.9), (500, None)])
def test_the_nearest_of_near_copies_survive_the_codes(spark, rows, floor):
    rng = np.random.default_rng(8)
    x = (rng.standard_normal(64) + 0.01 * rng.standard_normal((rows, 64))).astype(np.float32)
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SCHEMA)
    assert recall(similar_vectors(frame, dim=64, k=5, floor=floor, leaf_rows=1024).collect(), x, 5) == 1.0


def test_no_cosine_lies_farther_from_that_of_the_codes_than_the_errors(spark):
    rng = np.random.default_rng(9)
    x = rng.standard_normal((300, 64)) * rng.choice([0.01, 1.0], (300, 64), p=[0.9, 0.1])
    u = _units(x)
    c = _codes(u)
    e = _code_errors(u, c).astype(np.float64)
    d = c / np.linalg.norm(c.astype(np.float64), axis=1, keepdims=True)
    assert (np.abs(u.astype(np.float64) @ u.T - d @ d.T) <= e[:, None] + e[None] + 1e-7).all()


def test_crowded_rows_go_in_blocks(spark, monkeypatch):
    monkeypatch.setattr("granary.llm.neighbours._CROWD_BLOCK", 100)
    rng = np.random.default_rng(7)
    x = (1 + 0.2 * rng.standard_normal((400, 16))).astype(np.float32)
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SCHEMA)
    assert recall(similar_vectors(frame, dim=16, k=5, floor=0.5, leaf_rows=64).collect(), x, 5) == 1.0


@pytest.mark.parametrize("noise", [1e-2, 1e-3, 1e-4])
def test_a_third_of_near_copies_keeps_its_nearest(spark, noise):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.standard_normal(64) + noise * rng.standard_normal((1500, 64)), rng.standard_normal((3000, 64))]).astype(np.float32)
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SCHEMA)
    found = [r for r in similar_vectors(frame, dim=64, k=5, floor=0.9).collect() if int(r["id"]) < 1500]
    assert recall(found, x[:1500], 5) >= 0.99


def test_large_leaves_are_dealt_on_both_sides(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((600, 16)).astype(np.float32)
    frame = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x)], SCHEMA)
    whole = sorted(map(tuple, similar_vectors(frame, dim=16, k=3, leaf_rows=200, probes=6).collect()))
    monkeypatch.setattr("granary.llm.neighbours._LEAF_TASK_ROWS", 60)
    assert sorted(map(tuple, similar_vectors(frame, dim=16, k=3, leaf_rows=200, probes=6).collect())) == whole


def test_copies_ties_and_unusable_rows(spark):
    e = np.eye(4, dtype=np.float32).tolist()
    rows = [(f"copy{i}", e[0]) for i in range(9)] + [("copy0", e[0])] * 3
    rows += [("near", [1.0, 0.1, 0.0, 0.0]), ("zero", [0.0] * 4), ("short", [1.0, 0.0]), ("none", None), (None, e[0]), ("nan", [float("nan"), 0.0, 0.0, 1.0]), ("hole", [None, 1.0, 0.0, 0.0])]
    got = similar_vectors(spark.createDataFrame(rows, SCHEMA), dim=4, k=3, floor=0.9).collect()
    near = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        near.setdefault(r["id"], []).append(r["neighbour_id"])
    assert near["copy5"] == ["copy0", "copy1", "copy2"]
    assert near["copy1"] == ["copy0", "copy2", "copy3"]
    assert near["near"] == ["copy0", "copy1", "copy2"]
    assert set(near) == {f"copy{i}" for i in range(9)} | {"near"}


def test_one_id_with_two_vectors_counts_once(spark):
    rows = [("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("b", [1.0, 0.0]), ("c", [0.0, 1.0])]
    got = similar_vectors(spark.createDataFrame(rows, SCHEMA), dim=2, k=1, floor=0.99).collect()
    assert len({r["neighbour_id"] for r in got if r["id"] == "a"}) == 1


def test_pairs_come_once_and_empty_table(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 0.01]), ("c", [0.0, 1.0])]
    near = similar_vectors(spark.createDataFrame(rows, SCHEMA), dim=2, k=2, floor=0.9)
    assert [(r["id_a"], r["id_b"]) for r in similar_pairs(near).collect()] == [("a", "b")]
    assert similar_vectors(spark.createDataFrame([], SCHEMA), dim=2).count() == 0


def test_clashing_columns_are_not_read(spark):
    rows = [("a", [1.0, 0.0], 1, 2, True), ("b", [1.0, 0.0], 3, 4, False)]
    frame = spark.createDataFrame(rows, "chunk_id string, vector array<float>, h1 int, id int, v boolean")
    assert {(r["id"], r["neighbour_id"]) for r in similar_vectors(frame, dim=2, k=1).collect()} == {("a", "b"), ("b", "a")}


@pytest.mark.parametrize("probes", [3, 10])
def test_every_row_has_its_own_leaf_in_each_tree(probes):
    x = np.random.default_rng(2).standard_normal((500, 8)).astype(np.float32)
    forest = fit_forest(x[:300], trees=3, leaf_rows=20, seed=5)
    found, home = search_leaves(forest, x, probes)
    assert (home.sum(1) == 3).all()
    assert (found[home] > 0).all()
    live = np.sort(np.where(found > 0, found, -np.arange(found.shape[1])), axis=1)
    assert (np.diff(live, axis=1) != 0).all()


def test_copies_in_the_sample_can_be_split():
    forest = fit_forest(np.ones((100, 4), np.float32), trees=2, leaf_rows=10, seed=1)
    assert forest.leaves >= 20
