"""Selection of usable embedding vectors and their distribution over overlapping cells.

A forest of bisecting k-means trees gives the cells; every vector is sent to its nearest cells
of each tree. The trees split all rows across the cluster: a bounded sample proposes the splits
of a few levels, one aggregate over all rows gives every node's size, centre and dispersion, and
nodes that are still too large are split on. Each tree looks at the vectors through a random
whitened subspace of its own, so neighbours that one tree parts meet in another. Copies of one
direction are represented by one row, so a group of copies costs as much as a single vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediagauge.session import materialize

#: Rows whose nearest cell a cell should be.
CELL_ROWS = 1_500
#: Vectors that propose the splits of the trees.
SAMPLE_ROWS = 20_000
#: Cells of one tree; beyond it cells that are too large are split again by trees of their own.
MAX_CELLS = 1_024
#: Levels that the trees grow before the next aggregate over all rows, and how far a cell may exceed its size after it.
LEVELS_A_ROUND, LENIENCE = 8, 1.4
#: Rows and bytes up to which a side of a join is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 32 << 20


@dataclass
class Vectors:
    """source: the given table; rows: embedding_id, dim, k1, k2, q, scale, one per selected embedding;
    classes: one per direction; copies: members of directions that occur more than once."""

    source: DataFrame
    rows: DataFrame
    classes: DataFrame
    copies: DataFrame


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it was measured to hold at most BROADCAST_ROWS rows and BROADCAST_BYTES."""
    size = F.lit(8 * len(df.columns)).cast("bigint")
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            size = size + 32 * F.greatest(F.size(f.name), F.lit(0))
    rows, width = df.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and width <= BROADCAST_BYTES else df


def quantize(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """16-bit copies of unit vectors and the value of one step of each."""
    scale = np.maximum(np.abs(x).max(axis=1), 1e-9) / 32_767
    return np.rint(x / scale[:, None]).astype(np.int16), scale.astype(np.float32)


def dequantize(q: list[bytes], scale: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors in single precision of packed 16-bit copies."""
    x = np.frombuffer(b"".join(q), dtype=np.int16).reshape(-1, dim).astype(np.float32)
    x *= scale[:, None]
    return x


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("vec")
        offsets = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
        dims = np.diff(offsets).astype(np.int32)
        k1, k2 = np.zeros(len(dims), np.int64), np.zeros(len(dims), np.int64)
        packed: list = [None] * len(dims)
        scales = np.zeros(len(dims), np.float32)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            x = flat[offsets[rows][:, None] + np.arange(dim)]
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            # +0.0 turns -0.0 into 0.0
            directions = (np.round(x, 6) + 0.0).astype(np.float32)
            q, scale = quantize(x)
            scales[rows] = scale
            for i, d, v in zip(rows, directions, q, strict=True):
                d = d.tobytes()
                k1[i] = xxhash.xxh3_64_intdigest(d, 1) - (1 << 63)
                k2[i] = xxhash.xxh3_64_intdigest(d, 2) - (1 << 63)
                packed[i] = v.tobytes()
        yield pa.RecordBatch.from_arrays(
            [batch.column("owner"), batch.column("embedded_at"), batch.column("embedding_id"), *map(pa.array, (dims, k1, k2)), pa.array(packed, pa.binary()), pa.array(scales)],
            names=["owner", "embedded_at", "embedding_id", "dim", "k1", "k2", "q", "scale"],
        )


def usable_rows(embeddings: DataFrame) -> DataFrame:
    """Rows with status ``complete`` and embedding_dim finite vector elements, not all zero."""
    finite = F.forall("embedding_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return embeddings.select("embedding_id", "article_id", "status", "embedding_dim", "embedded_at", "embedding_vector").where(
        (F.col("status") == "complete")
        & F.col("embedding_id").isNotNull()
        & (F.col("embedding_dim") > 0)
        & (F.size("embedding_vector") == F.col("embedding_dim"))
        & finite
        & F.exists("embedding_vector", lambda x: x != 0)
    )


def select_vectors(embeddings: DataFrame) -> Vectors:
    """The selected embedding of each article, as defined for ``article_embeddings``.

    A row counts if its status is ``complete`` and its vector has embedding_dim finite elements,
    not all zero. Of an article's rows the latest embedded_at counts (null is earliest), of equal
    times the larger embedding_id. A row without article_id stands for itself; one without
    embedding_id is left out. Copies of a row count once.
    """
    owner = F.coalesce("article_id", F.concat(F.lit("embedding "), F.col("embedding_id").cast("string"))).alias("owner")
    slim = usable_rows(embeddings).select(owner, F.col("embedded_at").cast("timestamp").alias("embedded_at"), "embedding_id", F.col("embedding_vector").alias("vec"))
    packed = slim.mapInArrow(_pack, "owner string, embedded_at timestamp, embedding_id bigint, dim int, k1 bigint, k2 bigint, q binary, scale float")
    fields = ["embedding_id", "dim", "k1", "k2", "q", "scale"]
    latest = packed.groupBy("owner").agg(F.max_by(F.struct(*fields), F.struct("embedded_at", "embedding_id")).alias("r"))
    rows = materialize(latest.select("r.*"), "vectors")
    classes = materialize(rows.groupBy("dim", "k1", "k2").agg(F.min("embedding_id").alias("rep"), F.count("*").alias("n")), "vector-classes")
    shared = classes.where("n > 1")
    copies = rows.select("embedding_id", "dim", "k1", "k2").join(maybe_broadcast(shared), ["dim", "k1", "k2"])
    return Vectors(embeddings, rows, classes, materialize(copies.select("embedding_id", "rep", "n"), "vector-copies"))


def representatives(v: Vectors) -> DataFrame:
    """``embedding_id, dim, q, scale``: one row per direction."""
    extra = v.copies.where("embedding_id <> rep").select("embedding_id")
    return materialize(v.rows.select("embedding_id", "dim", "q", "scale").join(maybe_broadcast(extra), "embedding_id", "left_anti"), "vector-reps")


# ---- bisecting k-means ----


def _first_per_group(group: np.ndarray, value: np.ndarray, count: int) -> np.ndarray:
    """Row index with the smallest value of each group 0..count-1, every group being non-empty."""
    order = np.lexsort((value, group))
    g = group[order]
    return order[np.searchsorted(g, np.arange(count))]


def _centres(x: np.ndarray, group: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit mean direction and size of each group; an empty or cancelled group gets a zero vector."""
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(count))
    sizes = np.bincount(group, minlength=count)
    sums = np.zeros((count, x.shape[1]), dtype=x.dtype)
    full = sizes > 0
    if full.any():
        sums[full] = np.add.reduceat(x[order], starts[full], axis=0)
    norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
    return np.divide(sums, norms, out=np.zeros_like(sums), where=norms > 0), sizes


def _halves(x: np.ndarray, node: np.ndarray, count: int, far: np.ndarray | None = None, rounds: int = 3) -> np.ndarray:
    """Side 0 or 1 of each row after 2-means within each node, from its row ``far`` from the centre; neither side is empty."""
    if far is None:
        centre, _ = _centres(x, node, count)
        far = _first_per_group(node, np.einsum("ij,ij->i", x, centre[node]), count)
    a = x[far]
    b = x[_first_per_group(node, np.einsum("ij,ij->i", x, a[node]), count)]
    for _ in range(rounds):
        lean = np.einsum("ij,ij->i", x, (b - a)[node])
        side = (lean > 0).astype(np.int64)
        both, sizes = _centres(x, node * 2 + side, 2 * count)
        a, b = both[0::2], both[1::2]
        a = np.where(sizes[0::2, None] > 0, a, b)
        b = np.where(sizes[1::2, None] > 0, b, a)
    stuck = (np.bincount(node * 2 + side, minlength=2 * count).reshape(-1, 2) == 0).any(axis=1)
    if stuck.any():
        order = np.lexsort((np.arange(len(node)), lean, node))
        starts = np.searchsorted(node[order], np.arange(count))
        rank = np.empty(len(node), dtype=np.int64)
        rank[order] = np.arange(len(node)) - starts[node[order]]
        size = np.bincount(node, minlength=count)
        side = np.where(stuck[node], (rank >= (size[node] + 1) // 2).astype(np.int64), side)
    return side


def bisect(x: np.ndarray, compact: float, max_rows: int, rounds: int = 3) -> np.ndarray:
    """Leaf number of each unit vector after bisecting k-means.

    A node is split while some member's cosine to its centre is under ``compact`` or it holds
    more than ``max_rows`` rows. As the limits are those of single nodes, all nodes that miss
    them are split together; the leaves are the same as when splitting the largest dispersion
    first. A node that 2-means cannot divide is cut at the median, so both parts are smaller and
    the limits hold for every leaf in the end.
    """
    n = len(x)
    leaf = np.full(n, -1, dtype=np.int64)
    rows, node, next_leaf = np.arange(n), np.zeros(n, dtype=np.int64), 0
    while len(rows):
        _, node = np.unique(node, return_inverse=True)
        count = int(node.max()) + 1
        xs = x[rows]
        centre, sizes = _centres(xs, node, count)
        cosine = np.einsum("ij,ij->i", xs, centre[node])
        far = _first_per_group(node, cosine, count)
        done = ((cosine[far] >= compact) & (sizes <= max_rows)) | (sizes == 1)
        if done.any():
            numbers = np.where(done, next_leaf + np.cumsum(done) - 1, -1)
            settled = done[node]
            leaf[rows[settled]] = numbers[node[settled]]
            next_leaf += int(done.sum())
            rows, node, xs = rows[~settled], node[~settled], xs[~settled]
            if not len(rows):
                break
            kept = np.flatnonzero(~done)
            far_row = (np.cumsum(~settled) - 1)[far[kept]]
            node = np.searchsorted(kept, node)
            count = len(kept)
        else:
            far_row = far
        side = _halves(xs, node, count, far_row, rounds)
        node = node * 2 + side
    return leaf


def fit_cells(sample: np.ndarray, cells: int) -> np.ndarray:
    """Unit centres of cells by bisecting k-means until each holds at most 1/``cells`` of the sample."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]), np.float32)
    leaf = bisect(sample, -2.0, max(1, math.ceil(len(sample) / max(1, cells))))
    return _centres(sample, leaf, int(leaf.max()) + 1)[0].astype(np.float32)


@dataclass
class Tree:
    """A bisecting tree over unit vectors seen through ``axes`` after subtracting ``mean``.

    Node arrays: children (-1 where none), unit centre, rows, dispersion (1 - length of the mean
    vector) and whether the node may still be split.
    """

    mean: np.ndarray
    axes: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    rows: np.ndarray
    dispersion: np.ndarray
    open: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Unit vectors of the tree's subspace; a vector that vanishes there stays zero."""
        y = (x - self.mean) @ self.axes
        norm = np.sqrt((y * y).sum(axis=1, keepdims=True))
        return np.divide(y, norm, out=np.zeros_like(y), where=norm > 1e-9)

    def descend(self, y: np.ndarray) -> np.ndarray:
        """The node without children that each projected row falls into."""
        node = np.zeros(len(y), dtype=np.int64)
        todo = np.arange(len(y)) if self.left[0] >= 0 else np.zeros(0, np.int64)
        while len(todo):
            at = node[todo]
            lean = np.einsum("ij,ij->i", y[todo], self.centre[self.right[at]] - self.centre[self.left[at]])
            node[todo] = np.where(lean > 0, self.right[at], self.left[at])
            todo = todo[self.left[node[todo]] >= 0]
        return node

    @property
    def cells(self) -> np.ndarray:
        """Nodes without children, in order."""
        return np.flatnonzero(self.left < 0)

    def grow(self, y: np.ndarray, limit: int, most: int, levels: int = LEVELS_A_ROUND) -> None:
        """Split nodes of more than ``limit`` rows by 2-means of the sample ``y``, largest dispersion first, to at most ``most`` cells."""
        node = self.descend(y)
        for _ in range(levels):
            held = np.bincount(node, minlength=len(self.left))
            wanted = np.flatnonzero((self.left < 0) & self.open & (self.rows > limit))
            self.open[wanted[held[wanted] < 2]] = False
            ready = wanted[held[wanted] >= 2]
            ready = ready[np.lexsort((ready, -self.dispersion[ready] * self.rows[ready]))][: max(0, most - len(self.cells))]
            if not len(ready):
                return
            number = np.full(len(self.left), -1)
            number[ready] = np.arange(len(ready))
            inside = np.flatnonzero(number[node] >= 0)
            group = number[node[inside]]
            side = _halves(y[inside], group, len(ready))
            both, sizes = _centres(y[inside], group * 2 + side, 2 * len(ready))
            at = len(self.left)
            self.left[ready], self.right[ready] = at + 2 * np.arange(len(ready)), at + 2 * np.arange(len(ready)) + 1
            shares = np.repeat(self.rows[ready], 2) * sizes / np.repeat(sizes.reshape(-1, 2).sum(axis=1), 2)
            none = np.full(2 * len(ready), -1)
            self.left, self.right = np.append(self.left, none), np.append(self.right, none)
            self.centre = np.concatenate([self.centre, both.astype(np.float32)])
            self.rows = np.append(self.rows, shares.astype(np.int64))
            self.dispersion = np.append(self.dispersion, np.repeat(self.dispersion[ready], 2))
            self.open = np.append(self.open, none < 0)
            node[inside] = at + 2 * group + side

    def update(self, sums: dict[int, tuple[int, np.ndarray]]) -> None:
        """Sizes, centres and dispersions of all nodes from the rows and vector sums of those without children."""
        total = np.zeros((len(self.left), self.centre.shape[1]))
        rows = np.zeros(len(self.left), dtype=np.int64)
        for k, (n, vector) in sums.items():
            rows[k], total[k] = n, vector
        for k in range(len(self.left) - 1, -1, -1):  # children come after their parents
            if self.left[k] >= 0:
                rows[k] = rows[self.left[k]] + rows[self.right[k]]
                total[k] = total[self.left[k]] + total[self.right[k]]
        norm = np.sqrt((total * total).sum(axis=1))
        good = norm > 1e-9
        self.centre[good] = (total[good] / norm[good, None]).astype(np.float32)
        self.rows = rows
        self.dispersion = 1 - np.divide(norm, rows, out=np.zeros_like(norm), where=rows > 0)


def new_tree(sample: np.ndarray, rows: int, seed: int) -> Tree:
    """A tree of one node; ``axes`` whiten the sample and keep a random subspace of half the dimensions, of an eighth beyond 384."""
    dim = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(dim, np.float32)
    axes = np.eye(dim, dtype=np.float32)
    if len(sample) > dim >= 8:
        values, vectors = np.linalg.eigh(np.cov((sample - mean).T))
        spread = np.sqrt(np.maximum(values, 0))
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))[0][:, : max(min(dim // 2, 48), dim // 8)]
        axes = (vectors / (spread + 0.2 * np.sqrt((spread**2).mean()) + 1e-9)) @ turn
    else:
        mean = np.zeros_like(mean)
    none = np.array([-1])
    return Tree(mean.astype(np.float32), axes.astype(np.float32), none.copy(), none.copy(), np.zeros((1, axes.shape[1]), np.float32), np.array([rows]), np.ones(1), np.array([True]))


# ---- routing ----

#: A routed row: its cell, whether that is its home (the nearest of the tree), whether it is one of the others, and a mark that rows share which have met at home in the first tree.
ROUTED = "cell bigint, home boolean, other boolean, embedding_id bigint, q binary, place bigint"
# A cell's number: tree, cell of the tree, and after a second split 1 + part of that cell.
_TREE = 1 << 36
_CELL = 1 << 20


def tree_of(cell: int) -> int:
    """The tree to which a cell of either level belongs."""
    return cell // _TREE


def pack_rows(x: np.ndarray, bits: int) -> list[bytes]:
    """Unit vectors as a 4-byte step followed by 8-bit or 16-bit multiples of it."""
    most, kind = (127, np.int8) if bits == 8 else (32_767, np.int16)
    scale = (np.maximum(np.abs(x).max(axis=1), 1e-9) / most).astype(np.float32)
    q = np.rint(x / scale[:, None]).astype(kind)
    joined = np.concatenate([scale.view(np.uint8).reshape(-1, 4), q.view(np.uint8).reshape(len(x), -1)], axis=1)
    return [r.tobytes() for r in joined]


def unpack_rows(packed: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in single precision of rows packed by ``pack_rows``."""
    if not packed:
        return np.zeros((0, dim), np.float32)
    flat = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
    kind = np.int8 if flat.shape[1] == dim + 4 else np.int16
    x = np.ascontiguousarray(flat[:, 4:]).view(kind).astype(np.float32)
    x *= np.ascontiguousarray(flat[:, :4]).view(np.float32)
    return x


def slack(bits: int) -> float:
    """How far a cosine of packed rows may be from the exact one: eight standard deviations."""
    return 1e-2 if bits == 8 else 1e-4


def _nearest(x: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    s = x @ centres.T
    p = min(probes, s.shape[1])
    top = np.argpartition(-s, p - 1, axis=1)[:, :p] if p < s.shape[1] else np.tile(np.arange(p), (len(x), 1))
    order = np.argsort(-np.take_along_axis(s, top, axis=1), axis=1, kind="stable")
    return np.take_along_axis(top, order, axis=1).astype(np.int64)


def _routed(ids: pa.Array, packed: list[bytes], other: pa.Array, rows: np.ndarray, cell: np.ndarray, home: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """One routed row for each entry of ``rows``, an index into ids, packed and other."""
    at = pa.array(rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, pa.int64()), pa.array(home), other.take(at), ids.take(at), pa.array(packed, pa.binary()).take(at), pa.array(place, pa.int64())],
        names=["cell", "home", "other", "embedding_id", "q", "place"],
    )


@dataclass
class Plan:
    """How vectors are sent to cells: ``trees`` says of each tree to how many of its cells a row goes."""

    trees: tuple[int, ...] = (3, 3, 3)
    bits: int = 16
    cell_rows: int = CELL_ROWS
    sample_rows: int = SAMPLE_ROWS
    max_cells: int = MAX_CELLS


def _sample(reps: DataFrame, dim: int, rows: int, plan: Plan) -> np.ndarray:
    """About ``sample_rows`` vectors, chosen by a hash of the id; no sort, no limit before the filter."""
    whole = 1 << 30
    share = min(whole, math.ceil(1.2 * plan.sample_rows * whole / max(1, rows)))
    taken = reps.where(F.pmod(F.xxhash64("embedding_id"), F.lit(whole)) < share).select("q", "scale").toArrow()
    return dequantize(taken.column("q").to_pylist(), taken.column("scale").to_numpy(), dim) if taken.num_rows else np.zeros((0, dim), np.float32)


def _node_sums(reps: DataFrame, dim: int, trees: list[Tree]) -> list[dict[int, tuple[int, np.ndarray]]]:
    """Rows and vector sum of every node without children of each tree, over all rows; one aggregate."""
    width = trees[0].axes.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [(np.zeros(len(t.left), np.int64), np.zeros((len(t.left), width))) for t in trees]
        for batch in batches:
            if batch.num_rows:
                x = dequantize(batch.column("q").to_pylist(), batch.column("scale").to_numpy(), dim)
                for tree, (rows, total) in zip(trees, totals, strict=True):
                    y = tree.project(x)
                    node = tree.descend(y)
                    order = np.argsort(node, kind="stable")
                    seen, starts = np.unique(node[order], return_index=True)
                    rows[seen] += np.diff(np.append(starts, len(node)))
                    total[seen] += np.add.reduceat(y[order], starts, axis=0)
        at = [(t, int(k)) for t, (rows, _) in enumerate(totals) for k in np.flatnonzero(rows)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in at], pa.int32()), pa.array([k for _, k in at], pa.int32()), pa.array([int(totals[t][0][k]) for t, k in at], pa.int64()), pa.array([totals[t][1][k] for t, k in at], pa.list_(pa.float64()))],
            names=["tree", "node", "n", "total"],
        )

    parts = reps.select("q", "scale").mapInArrow(add, "tree int, node int, n bigint, total array<double>")
    summed = parts.groupBy("tree", "node").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
    out: list[dict] = [{} for _ in trees]
    for r in summed.collect():  # at most twice max_cells rows a tree
        out[r["tree"]][r["node"]] = (r["n"], np.array(r["total"]))
    return out


def fit_forest(reps: DataFrame, dim: int, rows: int, plan: Plan) -> list[Tree]:
    """Trees whose cells hold about ``cell_rows`` rows, LENIENCE times as many at most, or ``max_cells`` cells each."""
    sample = _sample(reps, dim, rows, plan) if rows > plan.cell_rows else np.zeros((0, dim), np.float32)
    trees = [new_tree(sample, rows, seed) for seed in range(len(plan.trees))]
    seen = [t.project(sample) for t in trees]
    limit = plan.cell_rows
    while True:
        before = sum(len(t.left) for t in trees)
        for tree, y in zip(trees, seen, strict=True):
            tree.grow(y, limit, plan.max_cells)
        limit = int(LENIENCE * plan.cell_rows)
        if sum(len(t.left) for t in trees) == before:
            return trees
        for tree, sums in zip(trees, _node_sums(reps, dim, trees), strict=True):
            tree.update(sums)


def route(reps: DataFrame, dim: int, rows: int, plan: Plan, others: DataFrame | None = None) -> DataFrame:
    """Every vector of ``reps`` (all of dimension ``dim``, ``rows`` many) in its nearest cells of each tree.

    A cell's number holds that of its tree. A cell of over twice ``cell_rows`` rows (where a tree
    would need more than ``max_cells``) is split by a tree of its own; a row goes on to the nearest
    part of every cell it visits, and at home to the two nearest. ``others`` are routed as well,
    but have no say in the cells.
    """
    forest = fit_forest(reps, dim, rows, plan)
    cells = [t.cells for t in forest]
    large = {t * _TREE + c * _CELL: math.ceil(forest[t].rows[k] / plan.cell_rows) for t, at in enumerate(cells) for c, k in enumerate(at) if forest[t].rows[k] > 2 * plan.cell_rows}
    bits, probes = plan.bits, plan.trees

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if n:
                x = dequantize(batch.column("q").to_pylist(), batch.column("scale").to_numpy(), dim)
                near = [_nearest(t.project(x), t.centre[at], p) * _CELL + k * _TREE for k, (t, at, p) in enumerate(zip(forest, cells, probes, strict=True))]
                place = near[0][:, 0]
                if large:  # rows of a cell that is split on need not meet
                    place = np.where(np.isin(place, list(large)), -1 - np.arange(n) - (xxhash.xxh3_64_intdigest(batch.column("q")[0].as_py()) >> 2), place)
                flat = np.concatenate(near, axis=1)
                home = np.concatenate([np.arange(a.shape[1]) == 0 for a in near])
                yield _routed(batch.column("embedding_id"), pack_rows(x, bits), batch.column("other"), np.repeat(np.arange(n), flat.shape[1]), flat.ravel(), np.tile(home, n), np.repeat(place, flat.shape[1]))

    everyone = reps.select("embedding_id", "q", "scale", F.lit(False).alias("other"))
    if others is not None:
        everyone = everyone.union(others.select("embedding_id", "q", "scale", F.lit(True)))
    routed = everyone.mapInArrow(send, ROUTED)
    if not large:
        return routed
    first = materialize(routed, "vector-cells")
    return first.where(~F.col("cell").isin(list(large))).union(_split_cells(first, dim, large, forest, plan))


def _split_cells(first: DataFrame, dim: int, large: dict[int, int], forest: list[Tree], plan: Plan) -> DataFrame:
    """Second level: the cells of ``large`` in so many parts each."""
    most = plan.max_cells
    # One row a large cell, at most max_cells a tree.
    told = first.sparkSession.createDataFrame([(c, min(p, most), min(1.0, 20.0 * min(p, most) / (p * plan.cell_rows))) for c, p in large.items()], "cell bigint, parts int, share double")
    whole = 1 << 30
    sample = first.where("home and not other").join(F.broadcast(told), "cell").where(F.pmod(F.xxhash64("embedding_id"), F.lit(whole)) < F.col("share") * whole).select("cell", "parts", "q")

    def fit(table: pa.Table) -> pa.Table:
        cell = table.column("cell")[0].as_py()
        y = forest[tree_of(cell)].project(unpack_rows(table.column("q").to_pylist(), dim))
        return pa.table({"cell": pa.array([cell], pa.int64()), "centres": pa.array([fit_cells(y, table.column("parts")[0].as_py()).tobytes()], pa.binary())})

    fitted = materialize(sample.groupBy("cell").applyInArrow(fit, "cell bigint, centres binary"), "cell-parts")
    salts = 16
    many = fitted.select("cell", "centres", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = first.join(F.broadcast(told.select("cell")), "cell", "left_semi").withColumn("salt", F.pmod(F.xxhash64("embedding_id"), F.lit(salts)).cast("int"))

    def resend(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        cell, n = key[0].as_py(), left.num_rows
        if not n:
            return pa.Table.from_batches([], _routed(pa.array([], pa.int64()), [], pa.array([], pa.bool_()), *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool), np.zeros(0, np.int64)).schema)
        packed, home = left.column("q").to_pylist(), left.column("home").to_numpy(zero_copy_only=False).astype(bool)
        tree = forest[tree_of(cell)]
        y = tree.project(unpack_rows(packed, dim))
        centres = np.frombuffer(right.column("centres")[0].as_py(), dtype=np.float32).reshape(-1, y.shape[1]) if right.num_rows else np.zeros((1, y.shape[1]), np.float32)
        near = _nearest(y, centres, 2) + cell + 1
        wanted = np.ones(near.shape, dtype=bool)
        wanted[~home, 1:] = False
        row, column = np.nonzero(wanted)
        ids, other, place = left.column("embedding_id").combine_chunks(), left.column("other").combine_chunks(), left.column("place").to_numpy()
        return pa.Table.from_batches([_routed(ids, packed, other, row, near[row, column], home[row] & (column == 0), place[row])])

    return salted.groupBy("cell", "salt").cogroup(many.groupBy("cell", "salt")).applyInArrow(resend, ROUTED)


def exact_cosines(pairs: DataFrame, source: DataFrame) -> DataFrame:
    """``a, b, cosine``: the cosine of each pair of ``pairs`` (a, b) in double precision from the stored vectors."""
    ids = pairs.select(F.col("a").alias("embedding_id")).union(pairs.select(F.col("b").alias("embedding_id"))).distinct()
    # The ids are those of usable rows; their elements need no second look.
    whole = source.where((F.col("status") == "complete") & (F.size("embedding_vector") == F.col("embedding_dim"))).select("embedding_id", "embedded_at", "embedding_vector")
    needed = whole.join(maybe_broadcast(ids), "embedding_id", "left_semi")
    order = F.struct(F.col("embedded_at").isNotNull(), "embedded_at")
    needed = needed.groupBy("embedding_id").agg(F.max_by("embedding_vector", order).alias("vec"))
    left = needed.select(F.col("embedding_id").alias("a"), F.col("vec").alias("va"))
    right = needed.select(F.col("embedding_id").alias("b"), F.col("vec").alias("vb"))

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = batch.column("va"), batch.column("vb")
            ox, oy = x.offsets.to_numpy(), y.offsets.to_numpy()
            fx, fy = (c.values.to_numpy(zero_copy_only=False).astype(np.float64) for c in (x, y))
            size = np.diff(ox)
            out = np.full(batch.num_rows, np.nan)
            for dim in np.unique(size):
                rows = np.flatnonzero((size == dim) & (np.diff(oy) == dim))
                p, q = fx[ox[rows][:, None] + np.arange(dim)], fy[oy[rows][:, None] + np.arange(dim)]
                square = (p * p).sum(axis=1) * (q * q).sum(axis=1)
                out[rows] = np.divide((p * q).sum(axis=1), np.sqrt(square), out=np.full(len(rows), np.nan), where=square > 0)
            out = np.where(np.isnan(out), None, out)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(out, pa.float64())], names=["a", "b", "cosine"])

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(cosine, "a bigint, b bigint, cosine double")
