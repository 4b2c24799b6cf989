"""Density clusters (HDBSCAN with excess of mass) and their stability under resampling, in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge.session import materialize


def reduce_rows(x: np.ndarray, components: int) -> np.ndarray:
    """Principal components of unit rows; the sign of each makes its largest entry positive."""
    lengths = np.sqrt((x * x).sum(axis=1, keepdims=True))
    x = np.divide(x, lengths, out=np.zeros_like(x), where=lengths > 0)
    x = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(x, full_matrices=False)
    axes = axes[: max(1, min(components, len(x) - 2))]
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return x @ (axes * signs[:, None]).T


def _spanning_tree(x: np.ndarray, min_samples: int) -> np.ndarray:
    """Edges (a, b, mutual reachability) of the minimum spanning tree, by Prim, one row of distances at a time."""
    n = len(x)
    square = (x * x).sum(axis=1)
    distance = lambda i: np.sqrt(np.maximum(0.0, square[i] + square - 2 * (x @ x[i])))
    k = min(min_samples, n - 1)
    core = np.array([np.partition(distance(i), k)[k] for i in range(n)])
    best, parent, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    edges, at = [], 0
    done[0] = True
    for _ in range(n - 1):
        d = np.maximum(np.maximum(distance(at), core), core[at])
        closer = ~done & (d < best)
        best[closer], parent[closer] = d[closer], at
        at = int(np.where(done, np.inf, best).argmin())
        edges.append((parent[at], at, best[at]))
        done[at] = True
    return np.array(sorted(edges, key=lambda e: e[2]))


def density_labels(x: np.ndarray, min_cluster: int = 3, min_samples: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Label of each row (-1 is noise) and its membership strength."""
    n = len(x)
    if n < max(2, min_cluster):
        return np.full(n, -1), np.zeros(n)
    # Single-linkage tree over the edges: node n + i joins two earlier nodes.
    root, size, left, right, height = list(range(2 * n - 1)), [1] * n, [], [], []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for a, b, d in _spanning_tree(x, min_samples):
        i, j = find(int(a)), find(int(b))
        node = n + len(left)
        left.append(i)
        right.append(j)
        height.append(max(float(d), 1e-12))
        size.append(size[i] + size[j])
        root[i] = root[j] = node
    # Condensed tree: walk down, a split into two large parts makes two clusters.
    clusters = {0: {"birth": 0.0, "parent": None, "points": [], "children": [], "mass": 0.0}}
    todo = [(2 * n - 2, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        lam = 1.0 / height[node - n]
        parts = [left[node - n], right[node - n]]
        big = [p for p in parts if size[p] >= min_cluster]
        if len(big) == 2:
            for p in parts:
                k = len(clusters)
                clusters[k] = {"birth": lam, "parent": c, "points": [], "children": [], "mass": 0.0}
                clusters[c]["children"].append(k)
                clusters[c]["mass"] += size[p] * (lam - clusters[c]["birth"])
                todo.append((p, k))
            continue
        for p in parts:
            if size[p] >= min_cluster:
                todo.append((p, c))
                continue
            stack = [p]
            while stack:
                q = stack.pop()
                if q < n:
                    clusters[c]["points"].append((q, lam))
                    clusters[c]["mass"] += lam - clusters[c]["birth"]
                else:
                    stack += [left[q - n], right[q - n]]
    # Excess of mass, children before parents; the root is never chosen.
    chosen, value = {}, {}
    for k in sorted(clusters, reverse=True):
        below = sum(value[ch] for ch in clusters[k]["children"])
        chosen[k] = k != 0 and clusters[k]["mass"] >= below
        value[k] = clusters[k]["mass"] if chosen[k] else below
    labels, strength, number = np.full(n, -1), np.zeros(n), 0
    todo = [0]
    while todo:
        k = todo.pop()
        if not chosen[k]:
            todo += clusters[k]["children"][::-1]
            continue
        stack, points = [k], []
        while stack:
            c = stack.pop()
            points += clusters[c]["points"]
            stack += clusters[c]["children"]
        top = max(lam for _, lam in points)
        for q, lam in points:
            labels[q], strength[q] = number, min(1.0, lam / top)
        number += 1
    return labels, strength


def cluster_windows(rows: DataFrame, window: list[str], components: int = 10, min_rows: int = 5) -> DataFrame:
    """``window`` columns, article_id, label, strength: density clusters of every scope window.

    ``rows`` have the window columns, article_id and vector. A window under ``min_rows`` rows is
    all noise. Distances are made one row at a time, so memory grows with the window, not its square.
    """
    schema = ", ".join(f"`{w}` {rows.schema[w].dataType.simpleString()}" for w in window) + ", article_id string, label int, strength double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("article_id")
        if len(pdf) < min_rows:
            labels, strength = np.full(len(pdf), -1), np.zeros(len(pdf))
        else:
            labels, strength = density_labels(reduce_rows(np.array(pdf["vector"].tolist(), dtype=np.float64), components))
        return pdf[[*window, "article_id"]].assign(label=labels.astype(np.int32), strength=np.round(strength, 6))

    return rows.select(*window, "article_id", "vector").groupBy(*window).applyInPandas(run, schema)


def _ari(a: np.ndarray, b: np.ndarray) -> float:
    pairs = lambda n: (n * (n - 1) / 2).sum()
    joint = np.unique(np.stack([a, b]), axis=1, return_counts=True)[1].astype(float)
    sa, sb, total = pairs(np.unique(a, return_counts=True)[1].astype(float)), pairs(np.unique(b, return_counts=True)[1].astype(float)), len(a) * (len(a) - 1) / 2
    expected = sa * sb / total if total else 0.0
    top = (sa + sb) / 2
    return 1.0 if top == expected else float((pairs(joint) - expected) / (top - expected))


def _nmi(a: np.ndarray, b: np.ndarray) -> float:
    """Mutual information over the mean of both entropies; 1 if both have one label or none."""
    (x, na), (y, nb) = (np.unique(v, return_inverse=True, return_counts=True)[1:] for v in (a, b))
    if len(na) == len(nb) <= 1:
        return 1.0
    cells, joint = np.unique(np.stack([x, y]), axis=1, return_counts=True)
    n = len(a)
    information = float((joint / n * np.log(n * joint / (na[cells[0]] * nb[cells[1]]))).sum())
    if information <= 1e-15:
        return 0.0
    entropy = lambda counts: float(-(counts / n * np.log(counts / n)).sum())
    return information / ((entropy(na) + entropy(nb)) / 2)


def _coherence(x: np.ndarray) -> float:
    """Mean cosine of rows to the mean of them, each within 0..1."""
    centre = x.mean(axis=0)
    lengths = np.sqrt((x * x).sum(axis=1)) * np.sqrt(centre @ centre)
    return float(np.clip(np.divide(x @ centre, lengths, out=np.zeros(len(x)), where=lengths > 0), 0.0, 1.0).mean())


#: Rows of a window from which every round of resampling is a task of its own.
APART = 20_000
_ROUND = "n int, noise_rows int, label int, size int, coherence double, ari double, nmi double, noise double, survival double, failed int"


def stability(rows: DataFrame, window: list[str], rounds: int = 25, share: float = 0.8, least: int = 5, components: int = 10) -> DataFrame:
    """Per window: how far clusterings of resampled rows agree with the full one.

    status (completed, all_noise, skipped_small_sample for a window under ``least`` rows), rows, noise rows
    and clusters of the full clustering; rounds that gave a clustering and failed_rounds; median, p10 and p90 of
    the adjusted Rand index, the normalised mutual information and the share of noise, and the mean of the
    latter. clusters has for each cluster its size, its coherence and, over the rounds that drew at least two
    of its members, the largest share of these that stayed together. Every round draws ``share`` of the rows,
    at least ``least``, without replacement. A value without rounds is null.
    """
    schema = ", ".join(f"`{w}` {rows.schema[w].dataType.simpleString()}" for w in window)
    sizes = rows.groupBy(*window).agg(F.when(F.count("*") >= APART, rounds).otherwise(1).alias("parts"))
    part = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    sizes = sizes.select(*[F.col(w).alias(f"s_{w}") for w in window], "parts")
    sized = rows.select(*window, "article_id", "vector").join(sizes, [F.col(w).eqNullSafe(F.col(f"s_{w}")) for w in window])
    spread = sized.select(*window, "article_id", "vector", "parts", part)
    columns = [c.split()[0] for c in _ROUND.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("article_id")
        n, parts, first, out = len(pdf), int(pdf["parts"].iloc[0]), int(pdf["part"].iloc[0]), []
        if n < least:
            out.append({"n": n})
        else:
            x = np.array(pdf["vector"].tolist(), dtype=np.float64)
            base, _ = density_labels(reduce_rows(x, components))
            names = [int(k) for k in np.unique(base) if k >= 0]
            if first == 0:
                out.append({"n": n, "noise_rows": int((base == -1).sum())})
                out += [{"label": k, "size": int((base == k).sum()), "coherence": _coherence(x[base == k])} for k in names]
            for seed in range(first, rounds, parts):
                take = np.sort(np.random.default_rng(42 + seed).choice(n, min(n, max(least, round(n * share))), replace=False))
                try:
                    again, _ = density_labels(reduce_rows(x[take], components))
                except Exception:  # a round that fails is counted
                    out.append({"failed": 1})
                    continue
                then = base[take]
                out.append({"failed": 0, "ari": _ari(then, again), "nmi": _nmi(then, again), "noise": float((again == -1).mean())})
                for k in names:
                    drawn = again[then == k]
                    if len(drawn) >= 2:
                        out.append({"label": k, "survival": np.unique(drawn, return_counts=True)[1].max() / len(drawn)})
        made = pd.DataFrame(out, columns=columns).astype({c: "Int32" for c in ("n", "noise_rows", "label", "size", "failed")})
        for i, w in enumerate(window):
            made.insert(i, w, [pdf[w].iloc[0]] * len(made))
        return made

    each = materialize(spread.groupBy(*window, "part").applyInPandas(run, f"{schema}, {_ROUND}"), "stability-rounds")
    spans = lambda c, name: [F.round(F.percentile(c, F.lit(q)), 4).alias(f"{name}_{n}") for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))]
    one = each.where("label is not null").groupBy(*window, "label").agg(F.max("size").alias("size"), F.round(F.max("coherence"), 4).alias("coherence"), F.count("survival").alias("rounds"), *spans("survival", "survival"))
    shape = "array<struct<label int, size int, coherence double, rounds bigint, survival_median double, survival_p10 double, survival_p90 double>>"
    entry = F.struct("label", "size", "coherence", "rounds", "survival_median", "survival_p10", "survival_p90")
    clusters = one.groupBy(*[F.col(w).alias(f"c_{w}") for w in window]).agg(F.sort_array(F.collect_list(entry)).cast(shape).alias("clusters"))
    whole = each.where("label is null").groupBy(*window).agg(
        F.max("n").alias("articles"), F.max("noise_rows").alias("noise_rows"), F.count("ari").alias("rounds"), F.coalesce(F.sum("failed"), F.lit(0)).alias("failed_rounds"),
        *spans("ari", "ari"), *spans("nmi", "nmi"), F.round(F.avg("noise"), 4).alias("noise_rate"), *spans("noise", "noise"),
    )
    both = whole.join(clusters, [F.col(w).eqNullSafe(F.col(f"c_{w}")) for w in window], "left").withColumn("clusters", F.coalesce("clusters", F.array().cast(shape)))
    status = F.when(F.col("noise_rows").isNull(), "skipped_small_sample").when(F.size("clusters") == 0, "all_noise").otherwise("completed")
    return both.select(*window, status.alias("status"), *[c for c in whole.columns if c not in window], "clusters")
