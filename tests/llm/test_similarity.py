"""Storylines and neighbours against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediagauge.llm.neighbours import nearest_neighbours, nearest_pairs
from mediagauge.llm.storylines import PLAN, describe_storylines, described_leaves, found_storylines, storylines
from mediagauge.llm.vectors import Plan, bisect, new_tree, pack_rows, unpack_rows

SCHEMA = "embedding_id long, article_id string, embedding_dim int, embedding_vector array<float>, status string, embedded_at string, dim int, rep string, q int"
SMALL = Plan(trees=PLAN.trees, bits=8, cell_rows=60, sample_rows=400)
DEEP = Plan(trees=PLAN.trees, bits=8, cell_rows=20, sample_rows=300, max_cells=6)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).withColumn("embedded_at", F.col("embedded_at").cast("timestamp"))


def made(seed=0, groups=45, dim=24):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for g in range(groups):
        centre = rng.normal(size=dim)
        for _ in range(int(rng.integers(1, 12)) if g else 160):  # one group holds a third of all rows
            v = centre + rng.normal(size=dim) * rng.uniform(0.05, 0.5)
            n += 1
            rows.append((n, f"a{n}", dim, [float(x) for x in v * rng.choice([0.25, 1, 8])], "complete", "2025-01-01"))
    for k in range(90):  # copies of one vector
        n += 1
        rows.append((n, f"c{k}", dim, rows[3][3], "complete", "2025-01-01"))
    return rows


def unit(rows):
    x = np.array([np.array(r[3], np.float32) for r in rows], np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def true_storylines(rows, link=0.8, least=4):
    x, ids = unit(rows), [r[0] for r in rows]
    root = np.arange(len(rows))
    s = x @ x.T >= link
    while True:
        new = np.array([root[s[i]].min() for i in range(len(rows))])
        new = np.minimum(new, root)
        if (new == root).all():
            break
        root = new
    sizes = np.bincount(root, minlength=len(rows))
    return {ids[i]: ids[root[i]] for i in range(len(rows)) if sizes[root[i]] >= least}


def true_pairs(rows, top=3, least=0.9):
    x, ids = unit(rows), np.array([r[0] for r in rows])
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(rows)):
        near = [j for j in np.flatnonzero(s[i] >= least) if j != i]
        for j in sorted(near, key=lambda j: (-s[i, j], ids[j]))[:top]:
            out.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


@pytest.mark.parametrize("plan", [PLAN, SMALL, DEEP])
def test_storylines_equal_brute_force(spark, plan):
    rows = made()
    got = {r[0]: r[1] for r in found_storylines(table(spark, rows), plan=plan).collect()}
    expected = true_storylines(rows)
    same = sum(got.get(k) == v for k, v in expected.items())
    assert same >= (1.0 if plan is PLAN else 0.9) * len(expected)
    assert set(got) <= set(expected) or plan is not PLAN


def test_neighbours_have_recall(spark):
    rows = made(3)
    expected = true_pairs(rows)
    for plan in (None, Plan(trees=(2,), cell_rows=60, sample_rows=400), Plan(trees=(2,), cell_rows=20, sample_rows=300, max_cells=6)):
        got = {(r[0], r[1]) for r in nearest_pairs(table(spark, rows), **({"plan": plan} if plan else {})).collect()}
        assert len(got & expected) >= 0.95 * len(expected)
        assert len(got - expected) <= 0.05 * len(got)


def test_selection_and_edge_cases(spark):
    v, w = [1.0, 0.0], [0.0, 1.0]
    nan = float("nan")
    rows = [
        (1, "a", 2, w, "complete", "2025-01-01"),
        (2, "a", 2, v, "complete", "2025-01-02"),
        (2, "a", 2, v, "complete", "2025-01-02"),
        (3, "b", 2, v, "failed", "2025-01-02"),
        (4, "b", 2, [2.0, 0.0], "complete", None),
        (5, "c", 3, v, "complete", "2025-01-01"),
        (6, "d", 2, [0.0, 0.0], "complete", "2025-01-01"),
        (7, "e", 2, [nan, 1.0], "complete", "2025-01-01"),
        (8, "f", 2, [None, 1.0], "complete", "2025-01-01"),
        (9, "g", 2, None, "complete", "2025-01-01"),
        (10, None, 2, v, "complete", "2025-01-01"),
        (11, None, 2, v, "complete", "2025-01-01"),
        (None, "h", 2, v, "complete", "2025-01-01"),
        (12, "i", 3, [1.0, 0.0, 0.0], "complete", "2025-01-01"),
        (13, "j", 2, [float("inf"), 1.0], "complete", "2025-01-01"),
        (14, "k", 0, [], "complete", "2025-01-01"),
    ]
    df = table(spark, rows)
    members, _, _ = storylines(df)
    assert {(r["embedding_id"], r["storyline_id"], r["size"]) for r in members.collect()} == {(i, 2, 4) for i in (2, 4, 10, 11)} | {(12, 12, 1)}
    assert {(r[0], r[1]) for r in nearest_pairs(df).collect()} == {(2, 4), (2, 10), (2, 11), (4, 10), (4, 11), (10, 11)}
    empty = df.limit(0)
    assert found_storylines(empty).count() == 0 and nearest_pairs(empty).count() == 0


def test_description(spark):
    rows = [(i, f"a{i}", 2, [1.0, 0.01 * i], "complete", "2025-01-01") for i in range(1, 6)] + [(9, "z", 2, [0.0, 1.0], "complete", "2025-01-01")]
    strength = spark.createDataFrame([("r", 1, "a1", 1, 0.5, 0), ("r", 1, "a1", 1, 0.5, 0), ("r", 1, "a2", 2, None, 0), ("r", 1, "a3", 3, 7.0, 0), ("r", 1, "a4", 4, float("nan"), 0), ("r", 2, "a5", 5, 0.25, 0)], "run_id string, cluster_id long, article_id string, embedding_id long, membership_strength double, is_noise int")
    got = describe_storylines(table(spark, rows), strength).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["storyline_id"], r["size"], r["typical_ids"], r["earlier_votes"], r["mean_strength"]) == (1, 5, "3,2,4", 2, 0.375)
    assert describe_storylines(table(spark, rows).limit(0), strength).count() == 0


def test_bisect_limits_hold():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8))
    x[100:200] = x[0]  # copies cannot be told apart
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = bisect(x, 0.9, 500)
    assert (leaf >= 0).all() and len(set(leaf[100:200])) == 1
    for k in set(leaf):
        c = x[leaf == k].sum(axis=0)
        assert (x[leaf == k] @ (c / np.linalg.norm(c))).min() >= 0.9 - 1e-9
    assert np.bincount(bisect(x, -2.0, 40)).max() <= 40
    tree = new_tree(x.astype(np.float32), len(x), 0)
    y = tree.project(x.astype(np.float32))
    for _ in range(6):
        tree.grow(y, 40, 64)
        node = tree.descend(y)
        tree.update({int(k): (int((node == k).sum()), y[node == k].sum(axis=0)) for k in np.unique(node)})
    assert tree.rows[0] == 500 == tree.rows[tree.cells].sum() and len(tree.cells) > 10 and (tree.dispersion >= -1e-6).all()
    for bits, slack in ((8, 1e-2), (16, 1e-4)):
        y = unpack_rows(pack_rows(x.astype(np.float32), bits), 8)
        assert np.abs(y @ y.T - x @ x.T).max() < slack * 2


def test_leaves(spark):
    rows = made()
    df = table(spark, rows)
    leaves = described_leaves(df, plan=SMALL).collect()
    x, ids = unit(rows), [r[0] for r in rows]
    assert sum(r["size"] for r in leaves) == len(rows) and min(r["least_cosine"] for r in leaves) >= 0.84
    assert len({r["leaf"] for r in leaves}) == len(leaves) and {r["size"] for r in leaves} >= {1}
    for r in leaves:
        named = [int(i) for i in r["typical_ids"].split(",")]
        assert len(named) <= min(3, r["size"]) and all(i in ids for i in named)
        s = x[[ids.index(i) for i in named]]
        assert (s @ s.T).min() > 0.3
    assert described_leaves(df.limit(0)).count() == 0


def test_storylines_need_the_forest(spark, monkeypatch):
    """Without the cells of the trees no two rows meet."""
    from mediagauge.llm import storylines as module

    df = table(spark, made())
    assert found_storylines(df).count() > 0
    plain = module.route
    monkeypatch.setattr(module, "route", lambda *a, **k: plain(*a, **k).withColumn("cell", F.col("embedding_id") * (1 << 20)).where("home").dropDuplicates(["embedding_id"]))
    assert {r["storyline_id"] for r in found_storylines(df).collect()} <= {4}  # the copies alone


def test_descent_adds_what_the_start_misses(spark):
    """From one cell a vector, nothing crosses a border; from two the rounds find what both cells lack."""
    rows = made(4, groups=60)
    df, expected = table(spark, rows), true_pairs(rows)
    plan = Plan(trees=(2,), cell_rows=25, sample_rows=600)
    recall = [len({(r[0], r[1]) for r in nearest_pairs(df, plan=plan, max_rounds=n).collect()} & expected) / len(expected) for n in (0, 8)]
    assert recall[1] > recall[0] and recall[1] >= 0.95


def test_neighbours_of_any_similarity(spark):
    rows = made(6, groups=30)
    x, ids = unit(rows), np.array([r[0] for r in rows])
    got: dict[int, list] = {}
    for r in nearest_neighbours(table(spark, rows)).collect():
        got.setdefault(r["q"], []).append(r)
    assert set(got) == set(ids.tolist()) and all(sorted(r["rank"] for r in g) == [1, 2, 3] for g in got.values())
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -2)
    hits = 0
    for i, q in enumerate(ids):
        best = np.sort(s[i])[-3:]
        hits += sum(s[i, int(np.flatnonzero(ids == r["other"])[0])] >= best[0] - 1e-6 for r in got[q])
    assert hits >= 0.97 * 3 * len(ids)


def test_graph_search(spark):
    from mediagauge.llm.neighbours import neighbour_graph, search_graph
    from mediagauge.llm.vectors import select_vectors

    rows = made(5, groups=25)
    v = select_vectors(table(spark, rows))
    graph, _ = neighbour_graph(v, floor=None)
    x, ids = unit(rows), np.array([r[0] for r in rows])
    rng = np.random.default_rng(8)
    asked = [(i, [float(a) for a in x[i] + rng.normal(0, 0.01, x.shape[1])], "k") for i in range(0, 200, 10)] + [(-7, [float(a) for a in x[3]], "k")]
    odd = [(900, [0.0] * x.shape[1], "k"), (901, [float("nan")] * x.shape[1], "k"), (902, [1.0], "k"), (903, None, "k"), (None, asked[0][1], "k")]
    queries = spark.createDataFrame(asked + odd, "query_id long, vector array<double>, node string")
    got: dict[int, list] = {}
    for r in search_graph(v, graph, queries).collect():
        got.setdefault(r["query_id"], []).append(r)
    hits = 0
    for q, vector, _ in asked:
        s = x @ np.array(vector) / np.linalg.norm(vector)
        best = np.sort(s[ids != q])[-3:]
        assert len(got[q]) == 3 and q not in {r["embedding_id"] for r in got[q]}
        hits += sum(r["cosine"] >= best[0] - 2e-3 for r in got[q])
    assert hits >= 0.95 * 3 * len(asked) and not set(got) & {900, 901, 902, 903, None}
    assert search_graph(v, graph, queries.limit(0)).count() == 0
