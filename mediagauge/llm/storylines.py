"""Storylines: bisecting k-means over all selected embeddings, leaves joined where texts are close.

The trees of ``vectors.route`` are split across the cluster down to cells; the cells of the first
one continue to split their own rows until each leaf is compact. A leaf is then compared with the
rows near it: a row can only be within the linking angle of a member of a leaf if its angle to
the leaf's centre is at most that angle plus the leaf's radius, so all other rows that visit the
cell are skipped without loss. Each row visits several cells of each tree, so leaves on both
sides of a border meet. Rows that are close enough link their leaves; the components of these
links are the storylines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagauge.llm.vectors import (
    Plan,
    Vectors,
    bisect,
    exact_cosines,
    maybe_broadcast,
    representatives,
    route,
    select_vectors,
    slack,
    tree_of,
    unpack_rows,
)
from mediagauge.operators.graph import connected_components
from mediagauge.session import materialize

#: Cosine from which two embeddings belong together.
LINK = 0.80
#: Smallest cosine of a member to its leaf's centre.
COMPACT = 0.85
LEAF, EDGE, UNSURE = 0, 1, 2
#: Rows of the leaves that are compared with the rows near them at once.
BLOCK_ROWS = 256
#: Leaves that a cell can number.
LEAVES = 1 << 20
#: Three trees, the first of which gives the leaves; a row visits three cells of each.
PLAN = Plan(trees=(3, 3, 3), bits=8)
_FOUND = "kind int, a bigint, b bigint, cosine float"


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """Smallest row number of each row's component."""
    root = np.arange(n)
    if len(pairs):
        while True:
            low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
            before = root.copy()
            np.minimum.at(root, pairs[:, 0], low)
            np.minimum.at(root, pairs[:, 1], low)
            root = root[root]
            if (root == before).all():
                break
    return root


def leaf_links(x: np.ndarray, home: np.ndarray, link: float, compact: float, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaf of each row at home in a cell, its cosine to the leaf's centre, pairs of close rows, and pairs too near the limit to tell."""
    mine = np.flatnonzero(home)
    y = x[mine]
    leaf = bisect(y, compact, len(y))
    count = int(leaf.max()) + 1
    order = np.argsort(leaf, kind="stable")
    starts = np.searchsorted(leaf[order], np.arange(count + 1))
    sums = np.add.reduceat(y[order], starts[:-1], axis=0)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    centres = np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 1e-6)
    to_own = np.clip(np.einsum("ij,ij->i", y, centres[leaf]), -1, 1)
    radius = np.arccos(np.minimum.reduceat(to_own[order], starts[:-1]))
    reach = np.where(norms[:, 0] > 1e-6, np.cos(np.minimum(np.pi, np.arccos(link - slack) + radius + 1e-2)), -2.0).astype(np.float32)
    sure, unsure = [], []
    edges = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(y), BLOCK_ROWS)), count))
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        # Rows that are near no leaf of the block are skipped.
        near = (x @ centres[low:high].T >= reach[None, low:high]).any(axis=1)
        _split(mine[order[starts[low] : starts[high]]], np.flatnonzero(near), x, link, slack, sure, unsure)
    return leaf, to_own, np.concatenate(sure), np.concatenate(unsure)


def _split(rows: np.ndarray, others: np.ndarray, x: np.ndarray, link: float, slack: float, sure: list, unsure: list) -> None:
    """Append the close pairs of ``rows`` and ``others``; of many sure ones those that span the components of their rows."""
    for at in range(0, len(rows), 512):
        part = rows[at : at + 512]
        s = x[part] @ x[others].T
        i, j = np.nonzero(s >= link - slack)
        a, b, c = part[i], others[j], s[i, j]
        keep = a != b
        pairs, clear = np.stack([a[keep], b[keep]], axis=1), c[keep] >= link + slack
        certain = pairs[clear]
        if len(certain) > 4 * len(x):
            root = _roots(len(x), certain)
            certain = np.stack([np.arange(len(x)), root], axis=1)[root != np.arange(len(x))]
        sure.append(certain)
        unsure.append(pairs[~clear])


def near_links(x: np.ndarray, home: np.ndarray, link: float, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of close rows with one at home in the cell, and pairs too near the limit to tell."""
    rows, everyone = np.flatnonzero(home), np.arange(len(x))
    none = np.zeros((0, 2), np.int64)
    sure, unsure = [none], [none]
    _split(rows, everyone, x, link, slack, sure, unsure)
    return np.concatenate(sure), np.concatenate(unsure)


def _cell(dim: int, link: float, compact: float, bits: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("embedding_id").to_numpy()
        x = unpack_rows(table.column("q").to_pylist(), dim)
        home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
        cell = table.column("cell")[0].as_py()
        none = np.zeros(0, np.int64)
        leaf_of, leaf, near = none, none, np.zeros(0, np.float32)
        if not home.any():
            sure = unsure = none.reshape(0, 2)
        elif tree_of(cell) == 0:
            leaf, near, sure, unsure = leaf_links(x, home, link, compact, slack(bits))
            leaf_of = ids[home]
        else:
            sure, unsure = near_links(x, home, link, slack(bits))
        root = _roots(len(ids), sure)
        # A doubtful pair whose rows are linked anyway need not be checked.
        unsure = unsure[root[unsure[:, 0]] != root[unsure[:, 1]]]
        least = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(least, root, ids)
        moved = np.flatnonzero(ids != least[root])
        kinds = np.repeat([LEAF, EDGE, UNSURE], [len(leaf_of), len(moved), len(unsure)]).astype(np.int32)
        a = np.concatenate([leaf_of, ids[moved], ids[unsure[:, 0]]])
        b = np.concatenate([leaf + cell * LEAVES, least[root[moved]], ids[unsure[:, 1]]])
        cosine = np.concatenate([near, np.zeros(len(kinds) - len(near))]).astype(np.float32)
        return pa.table({"kind": kinds, "a": a.astype(np.int64), "b": b.astype(np.int64), "cosine": cosine})

    return run


def _found(v: Vectors, link: float, compact: float, plan: Plan) -> tuple[DataFrame, DataFrame]:
    """Links between representatives, and the leaf of each."""
    reps = representatives(v)
    dims = [(r["dim"], r["n"]) for r in v.classes.groupBy("dim").agg(F.count("*").alias("n")).collect()]
    found = None
    for dim, n in dims:
        routed = route(reps.where(F.col("dim") == dim), dim, n, plan)
        part = materialize(routed.groupBy("cell").applyInArrow(_cell(dim, link, compact, plan.bits), _FOUND), "storyline-links")
        found = part if found is None else found.union(part)
    if found is None:
        found = v.rows.sparkSession.createDataFrame([], _FOUND)
    links = found.where(F.col("kind") == EDGE).select("a", "b")
    unsure = found.where(F.col("kind") == UNSURE).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    confirmed = exact_cosines(materialize(unsure, "storyline-doubts"), v.source).where(F.col("cosine") >= link).select("a", "b")
    leaves = found.where(F.col("kind") == LEAF).select(F.col("a").alias("rep"), F.col("b").alias("leaf"), "cosine")
    return links.union(confirmed), leaves


def storylines(embeddings: DataFrame, link: float = LINK, compact: float = COMPACT, plan: Plan = PLAN) -> tuple[DataFrame, DataFrame, Vectors]:
    """Members (``embedding_id, storyline_id, size, leaf``), leaves by representative, and the vectors.

    Two selected embeddings belong together if their cosine is at least ``link`` or a chain of
    such pairs connects them; storyline_id is the smallest embedding_id, size counts copies.
    Vectors of different dimension are never linked. Unusable vectors, null ids and superseded
    versions have no row; an empty table gives no rows. Pairs whose packed cosine is
    too near the limit are decided from the stored vectors in double precision. Every link found
    is a true one; the share of links found is measured in the tests.
    """
    v = select_vectors(embeddings)
    links, leaves = _found(v, link, compact, plan)
    roots = connected_components(links)
    classes = v.classes.join(roots.withColumnRenamed("id", "rep"), "rep", "left")
    classes = classes.withColumn("root", F.coalesce("root", "rep")).join(leaves.select("rep", "leaf"), "rep", "left")
    sizes_of = classes.groupBy("root").agg(F.sum("n").alias("size"))
    placed = materialize(classes.join(sizes_of, "root").select("rep", F.col("root").alias("storyline_id"), "size", "leaf"), "storylines")
    rep_of = v.rows.select("embedding_id").join(maybe_broadcast(v.copies.select("embedding_id", "rep")), "embedding_id", "left")
    members = rep_of.withColumn("rep", F.coalesce("rep", "embedding_id")).join(placed, "rep")
    return members.select("embedding_id", "storyline_id", "size", "leaf"), leaves, v


def found_storylines(embeddings: DataFrame, least: int = 4, **kw) -> DataFrame:
    """``embedding_id, storyline_id`` of the storylines with at least ``least`` embeddings."""
    members, _, _ = storylines(embeddings, **kw)
    return members.where(F.col("size") >= least).select("embedding_id", "storyline_id")


def described_leaves(embeddings: DataFrame, typical: int = 3, **kw) -> DataFrame:
    """One row per leaf of the tree: storyline_id, size, dispersion, least_cosine and the members nearest to its centre.

    ``size`` counts copies; ``typical_ids`` are up to ``typical`` embedding_ids by their cosine to
    the centre, joined by commas, of equal ones the smaller id first, each direction under its
    smallest id. ``dispersion`` is one less the mean cosine to the centre. Leaves of a single
    embedding and storylines of one leaf are included; an empty table gives no rows.
    """
    members, leaves, v = storylines(embeddings, **kw)
    storyline = members.groupBy("leaf").agg(F.min("storyline_id").alias("storyline_id"))
    rows = leaves.join(v.classes.select("rep", "n"), "rep").withColumn("cosine", F.round(F.col("cosine").cast("double"), 4))
    w = Window.partitionBy("leaf").orderBy(F.desc("cosine"), "rep")
    top = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= typical)
    named = top.groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "rep"))), lambda s: s["rep"].cast("string")), ",").alias("typical_ids"))
    sizes = rows.groupBy("leaf").agg(
        F.sum("n").alias("size"), F.round(1 - F.sum(F.col("cosine") * F.col("n")) / F.sum("n"), 4).alias("dispersion"), F.min("cosine").alias("least_cosine")
    )
    return sizes.join(named, "leaf").join(storyline, "leaf").select("leaf", "storyline_id", "size", "dispersion", "least_cosine", "typical_ids")


def describe_storylines(embeddings: DataFrame, memberships: DataFrame, typical: int = 3, least: int = 2, **kw) -> DataFrame:
    """One row per storyline: size, leaves, compactness, most typical members, earlier evidence.

    ``typical_ids`` are the ``typical`` embedding_ids nearest to the storyline's centre, joined by
    commas (ties: smaller id). ``mean_strength`` averages the membership_strength of earlier runs
    over members, exact copies of a row once, values that are null, NaN or outside 0..1 left out;
    null where none is left. Centres are summed per task first, so a storyline of any size is
    never gathered.
    """
    members, _, v = storylines(embeddings, **kw)
    chosen = materialize(members.where(F.col("size") >= least), "storyline-members")
    vectors = v.rows.select("embedding_id", "dim", "q", "scale").join(chosen.select("embedding_id", "storyline_id"), "embedding_id")
    vectors = materialize(vectors, "storyline-vectors")

    def by_length(pdf: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of each vector length and their unit vectors."""
        sizes = pdf["q"].map(len).to_numpy()
        for size in np.unique(sizes):
            rows = np.flatnonzero(sizes == size)
            x = np.frombuffer(b"".join(pdf["q"].iloc[rows]), np.int16).reshape(len(rows), -1).astype(np.float64)
            yield rows, x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for pdf in batches:
            for rows, x in by_length(pdf):
                names, group = np.unique(pdf["storyline_id"].to_numpy()[rows], return_inverse=True)
                order = np.argsort(group, kind="stable")
                for name, total in zip(names.tolist(), np.add.reduceat(x[order], np.searchsorted(group[order], np.arange(len(names))), axis=0), strict=True):
                    sums[name] = sums[name] + total if name in sums else total
            if len(sums) > 20_000:
                yield pd.DataFrame({"storyline_id": list(sums), "total": [x.tobytes() for x in sums.values()]})
                sums = {}
        yield pd.DataFrame({"storyline_id": list(sums), "total": [x.tobytes() for x in sums.values()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sum([np.frombuffer(t) for t in pdf["total"]], axis=0)
        return pd.DataFrame({"storyline_id": pdf["storyline_id"].head(1), "centre": [x.tobytes()]})

    sums = vectors.select("storyline_id", "q").mapInPandas(partial, "storyline_id bigint, total binary")
    centres = sums.groupBy("storyline_id").applyInPandas(total, "storyline_id bigint, centre binary")

    def distance(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cos = np.zeros(len(pdf))
            for rows, x in by_length(pdf):
                c = np.frombuffer(b"".join(pdf["centre"].iloc[rows])).reshape(len(rows), -1)
                norm = np.sqrt((c * c).sum(axis=1))
                cos[rows] = np.divide((x * c).sum(axis=1), norm, out=np.zeros(len(rows)), where=norm > 0)
            yield pdf[["embedding_id", "storyline_id"]].assign(cosine=cos)

    near = vectors.join(centres, "storyline_id").mapInPandas(distance, "embedding_id bigint, storyline_id bigint, cosine double")
    near = near.withColumn("cosine", F.round("cosine", 9))
    w = Window.partitionBy("storyline_id").orderBy(F.desc("cosine"), "embedding_id")
    top = near.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= typical)
    exemplars = top.groupBy("storyline_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "embedding_id"))), lambda s: s["embedding_id"].cast("string")), ",").alias("typical_ids")
    )
    tight = near.groupBy("storyline_id").agg(F.round(F.avg("cosine"), 4).alias("mean_cosine"), F.round(F.min("cosine"), 4).alias("least_cosine"))
    counts = chosen.groupBy("storyline_id").agg(F.count("*").alias("size"), F.countDistinct("leaf").alias("leaves"))
    valid = memberships.select("run_id", "cluster_id", "article_id", "embedding_id", "membership_strength", "is_noise").distinct()
    valid = valid.where("membership_strength >= 0 and membership_strength <= 1 and not isnan(membership_strength)")
    evidence = valid.join(chosen.select("embedding_id", "storyline_id"), "embedding_id").groupBy("storyline_id").agg(
        F.count("*").alias("earlier_votes"), F.round(F.avg("membership_strength"), 4).alias("mean_strength")
    )
    described = counts.join(tight, "storyline_id").join(exemplars, "storyline_id").join(evidence, "storyline_id", "left")
    return described.withColumn("earlier_votes", F.coalesce("earlier_votes", F.lit(0)))
