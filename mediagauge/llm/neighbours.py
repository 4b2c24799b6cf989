"""Most similar vectors by NN-descent.

The graph starts from the neighbours that share a cell and from their reverse edges;
each round then joins the neighbours of neighbours that have not met, of which at least one edge
is new, scores the pairs on packed vectors, and keeps the best edges of each vector. Copies of
one direction are one node and are spread out at the end. Queries search the graph greedily.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagauge.llm.vectors import Plan, Vectors, _pack, exact_cosines, maybe_broadcast, representatives, route, select_vectors, slack, unpack_rows, usable_rows
from mediagauge.session import discard, materialize

#: Neighbours kept for each vector while the graph is built.
GRAPH_K = 8
#: Cosine under which an edge is dropped where the caller needs similar vectors only; None keeps the best of all.
FLOOR = 0.8
#: Two trees, two cells a vector in each: a start that has edges across the borders of cells.
PLAN = Plan(trees=(2, 2), bits=16)
#: For neighbours of any similarity: unlike vectors spread over more cells.
WIDE_PLAN = Plan(trees=(3, 3), bits=16)
#: Members of a node's neighbourhood that are joined, nearest first, reverse neighbours included.
POOL = 24
#: Rounds stop when fewer than this share of the edges is new.
SETTLED = 0.002
MAX_ROUNDS = 8
_EDGES = "u bigint, v bigint, sim double, pu bigint, pv bigint"


def cell_neighbours(x: np.ndarray, ids: np.ndarray, home: np.ndarray, k: int, floor: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs (i, j) and cosines: for each row at home its k nearest rows, with cosine of at least ``floor``.

    Of equal cosines the smaller id counts.
    """
    rows = np.flatnonzero(home)
    out_i, out_j, out_s = [], [], []
    for at in range(0, len(rows), 512):
        chunk = rows[at : at + 512]
        s = x[chunk] @ x.T
        s[np.arange(len(chunk)), chunk] = -2
        least = -1.5 if floor is None else floor
        if floor is None and s.shape[1] > 4 * k:  # whatever is under the k-th best cannot count
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k][:, None]
        i, j = np.nonzero(s >= least)
        c = s[i, j]
        order = np.lexsort((ids[j], -c, i))
        i, j, c = i[order], j[order], c[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        keep = rank < k
        out_i.append(chunk[i[keep]])
        out_j.append(j[keep])
        out_s.append(c[keep])
    return _joined(out_i, np.int64), _joined(out_j, np.int64), _joined(out_s, np.float32)


def _joined(parts: list[np.ndarray], kind: type) -> np.ndarray:
    return np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)


def _cell(dim: int, k: int, floor: float | None):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("embedding_id").to_numpy()
        x = unpack_rows(table.column("q").to_pylist(), dim)
        i, j, s = cell_neighbours(x, ids, table.column("home").to_numpy(zero_copy_only=False).astype(bool), k, floor)
        place = table.column("place").to_numpy()
        return pa.table({"u": ids[i], "v": ids[j], "sim": s.astype(np.float64), "pu": place[i], "pv": place[j]})

    return run


def _strangers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of one node's neighbourhood that have not met at home, at least one of whose edges is new."""
    for batch in batches:
        lists = batch.column("members")
        offsets, flat = lists.offsets.to_numpy(), lists.values
        sizes = np.diff(offsets)
        m, p, new = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        out: list[list[np.ndarray]] = [[], [], [], []]
        width = int(sizes.max()) if len(sizes) else 0
        at = np.arange(width)
        upper = at[:, None] < at[None, :]
        for begin in range(0, len(sizes), 2_000):
            size = sizes[begin : begin + 2_000]
            held = at[None, :] < size[:, None]
            index = np.where(held, offsets[begin : begin + len(size)][:, None] + at[None, :], 0)
            ids, places, fresh = m[index], p[index], new[index].astype(bool) & held
            wanted = upper & held[:, :, None] & held[:, None, :] & (places[:, :, None] != places[:, None, :])
            wanted &= (fresh[:, :, None] | fresh[:, None, :]) & (ids[:, :, None] != ids[:, None, :])
            r, i, j = np.nonzero(wanted)
            swap = ids[r, i] > ids[r, j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            for column, values in zip(out, (ids[r, i], ids[r, j], places[r, i], places[r, j]), strict=True):
                column.append(values)
        yield pa.RecordBatch.from_arrays([pa.array(_joined(c, np.int64), pa.int64()) for c in out], names=["a", "b", "pa", "pb"])


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cosines of packed vectors ``qa`` and ``qb``; null where their lengths differ."""
    for batch in batches:
        n = batch.num_rows
        sims = np.full(n, np.nan)
        qa, qb = batch.column("qa"), batch.column("qb")
        la, lb = np.diff(qa.buffers()[1] and np.frombuffer(qa.buffers()[1], np.int32)[qa.offset : qa.offset + n + 1]), np.diff(np.frombuffer(qb.buffers()[1], np.int32)[qb.offset : qb.offset + n + 1])
        la_list, lb_list = qa.to_pylist(), qb.to_pylist()
        for size in np.unique(la) if n else ():
            rows = np.flatnonzero((la == size) & (lb == size))
            for at in range(0, len(rows), 4_096):
                part = rows[at : at + 4_096]
                x, y = (np.frombuffer(b"".join([lists[i] for i in part]), np.int16).reshape(len(part), -1).astype(np.float64) for lists in (la_list, lb_list))
                sims[part] = (x * y).sum(axis=1)
        sims *= batch.column("sa").to_numpy() * batch.column("sb").to_numpy().astype(np.float64)
        rest = [batch.column(c) for c in batch.schema.names if c not in ("qa", "qb", "sa", "sb")]
        names = [c for c in batch.schema.names if c not in ("qa", "qb", "sa", "sb")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(sims, pa.float64(), from_pandas=True)], names=[*names, "sim"])


def _descend(edges: DataFrame, vectors: DataFrame, k: int, floor: float | None) -> DataFrame:
    """One round: the graph with what the neighbours of neighbours add; ``new`` marks added edges."""
    forward = edges.select(F.col("u").alias("node"), F.col("v").alias("m"), F.col("pv").alias("p"), "sim", "new")
    reverse = edges.select(F.col("v").alias("node"), F.col("u").alias("m"), F.col("pu").alias("p"), "sim", "new")
    both = forward.union(reverse).groupBy("node", "m").agg(F.max("sim").alias("sim"), F.max("p").alias("p"), F.max("new").alias("new"))
    nearest = Window.partitionBy("node").orderBy(F.desc("sim"), "m")
    pool = both.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= POOL)
    # Nodes all of whose neighbours share a home have nothing to introduce.
    pools = pool.groupBy("node").agg(F.collect_list(F.struct("m", "p", F.col("new").cast("int").alias("new"))).alias("members"), F.min("p").alias("low"), F.max("p").alias("high"), F.max("new").alias("any"))
    pools = pools.where((F.col("low") < F.col("high")) & F.col("any")).select("members")
    pairs = pools.mapInArrow(_strangers, "a bigint, b bigint, pa bigint, pb bigint").distinct()
    known = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    pairs = pairs.join(known, ["a", "b"], "left_anti")
    left = vectors.select(F.col("embedding_id").alias("a"), F.col("q").alias("qa"), F.col("scale").alias("sa"))
    right = vectors.select(F.col("embedding_id").alias("b"), F.col("q").alias("qb"), F.col("scale").alias("sb"))
    scored = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb", "qa", "sa", "qb", "sb").mapInArrow(_score, "a bigint, b bigint, pa bigint, pb bigint, sim double")
    scored = scored.where(F.col("sim").isNotNull() if floor is None else F.col("sim") >= floor)
    scored = materialize(scored, "neighbour-pairs")
    there = scored.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim", F.col("pa").alias("pu"), F.col("pb").alias("pv"))
    back = scored.select(F.col("b").alias("u"), F.col("a").alias("v"), "sim", F.col("pb").alias("pu"), F.col("pa").alias("pv"))
    old = edges.withColumn("new", F.lit(False))
    kept = materialize(_best(old.union(there.union(back).withColumn("new", F.lit(True))), k), "neighbour-graph")
    discard(scored)
    return kept


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` best edges of each vector, an edge found several times once."""
    best = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    once = edges.groupBy("u", "v").agg(*[F.max(c).alias(c) for c in ("sim", "pu", "pv")], F.min("new").alias("new"))
    return once.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).drop("rn")


def neighbour_graph(v: Vectors, k: int = GRAPH_K, floor: float | None = FLOOR, max_rounds: int = MAX_ROUNDS, plan: Plan = PLAN) -> tuple[DataFrame, list[int]]:
    """``u, v, sim``: up to ``k`` nearest representatives of each, with cosine of at least ``floor``; and the new edges of each round."""
    reps = representatives(v)
    graph, added = None, []
    for r in v.classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        mine = reps.where(F.col("dim") == r["dim"])
        routed = route(mine, r["dim"], r["n"], plan)
        found = materialize(routed.groupBy("cell").applyInArrow(_cell(r["dim"], k, floor), _EDGES), "neighbour-edges")
        # What is near in one direction is near in the other, too.
        back = found.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", F.col("pv").alias("pu"), F.col("pu").alias("pv"))
        edges = materialize(_best(found.union(back).withColumn("new", F.lit(True)), k), "neighbour-graph")
        discard(found)
        total = edges.count()
        for step in range(max_rounds):
            after = _descend(edges, mine, k, floor)
            discard(edges)
            edges, new = after, after.where("new").count()
            added = added[:step] + [(added[step] if step < len(added) else 0) + new] + added[step + 1 :]
            if new <= SETTLED * total:
                break
        part = edges.select("u", "v", "sim")
        graph = part if graph is None else graph.union(part)
    return graph if graph is not None else v.rows.sparkSession.createDataFrame([], "u bigint, v bigint, sim double"), added


def _rank_exactly(graph: DataFrame, v: Vectors, top: int, least: float | None) -> DataFrame:
    """``u, v, sim`` with cosine of at least ``least``; where 16-bit copies leave a doubt, from the stored vectors."""
    doubt, least = slack(16), -2.0 if least is None else least
    w = Window.partitionBy("u").orderBy(F.desc("sim"), "v")
    near = graph.where(F.col("sim") >= least - doubt).select("u", "v", "sim").distinct()
    near = near.withColumn("rn", F.row_number().over(w)).withColumn("next", F.lead("sim").over(w))
    tight = (F.col("rn") <= top) & (F.col("sim") - F.col("next") < doubt)
    near = near.withColumn("doubt", F.max((F.abs(F.col("sim") - least) < doubt) | F.coalesce(tight, F.lit(False))).over(Window.partitionBy("u")))
    near = materialize(near.select("u", "v", "sim", "doubt"), "neighbour-ranks")
    again = exact_cosines(near.where("doubt").select(F.col("u").alias("a"), F.col("v").alias("b")), v.source)
    sure = near.where("not doubt").select("u", "v", "sim")
    return sure.union(again.where(F.col("cosine") >= least).select("a", "b", F.col("cosine")))


def nearest_neighbours(embeddings: DataFrame, top: int = 3, least: float | None = None, v: Vectors | None = None, graph: DataFrame | None = None, **kw) -> DataFrame:
    """``q, other, sim, rank``: the ``top`` most similar other embeddings of every selected one, with cosine of at least ``least``.

    Of equal cosines the smaller embedding_id is the more similar one; cosines count as equal
    when they agree to nine decimals. Copies of a direction have cosine 1 to each other, so a
    group of m copies gives at most ``top`` rows a member, not all pairs. Recall is that of the
    graph and is measured in the tests. An empty table gives no rows.
    """
    v = v or select_vectors(embeddings)
    if graph is None:
        wide = {"floor": None, "plan": WIDE_PLAN} if least is None else {"floor": min(FLOOR, least)}
        graph, _ = neighbour_graph(v, **({"k": max(GRAPH_K, top + 1)} | wide | kw))
    ranked = _rank_exactly(graph, v, top, least)
    # The first top + 1 members of each group of copies are all that can be anyone's neighbours.
    by_id = Window.partitionBy("rep").orderBy("embedding_id")
    heads = v.copies.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= top + 1)
    heads = materialize(heads.select("rep", "embedding_id", "at", "n"), "neighbour-copies")
    few = maybe_broadcast(heads)
    spread = ranked.join(few.select(F.col("rep").alias("v"), F.col("embedding_id").alias("other"), F.col("at").alias("other_at")), "v", "left")
    spread = spread.select("u", F.coalesce("other", "v").alias("other"), "sim")
    sources = maybe_broadcast(v.copies.select(F.col("rep").alias("u"), "embedding_id", "n").where(F.col("n") <= top))
    outward = spread.join(sources, "u", "left").join(maybe_broadcast(v.copies.where(F.col("n") > top).select(F.col("rep").alias("u")).distinct()), "u", "left_anti")
    outward = outward.select(F.coalesce("embedding_id", "u").alias("q"), "other", "sim")
    inward = v.copies.join(few.select("rep", F.col("embedding_id").alias("other")), "rep")
    inward = inward.where("embedding_id <> other").select(F.col("embedding_id").alias("q"), "other", F.lit(1.0).alias("sim"))
    w = Window.partitionBy("q").orderBy(F.desc(F.round("sim", 9)), "other")
    return outward.union(inward).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def nearest_pairs(embeddings: DataFrame, top: int = 3, least: float = 0.90, **kw) -> DataFrame:
    """``left_id, right_id``: pairs with cosine of at least ``least``, one among the other's ``top`` most similar."""
    picked = nearest_neighbours(embeddings, top, least, **kw)
    return picked.select(F.least("q", "other").alias("left_id"), F.greatest("q", "other").alias("right_id")).distinct()


# ---- search ----

#: Nodes that a search keeps at hand for each query, and rounds after which it ends in any case.
BEAM = 24
MAX_STEPS = 8


def _packed_queries(queries: DataFrame) -> DataFrame:
    """Usable query vectors under their query_id."""
    vector = F.col("vector").cast("array<float>")
    shaped = queries.where("query_id is not null").select(
        F.col("query_id").alias("embedding_id"), F.lit(None).cast("string").alias("article_id"), F.lit("complete").alias("status"),
        F.size("vector").alias("embedding_dim"), F.lit(None).cast("timestamp").alias("embedded_at"), vector.alias("embedding_vector"),
    )
    slim = usable_rows(shaped).select(F.lit("").alias("owner"), "embedded_at", "embedding_id", F.col("embedding_vector").alias("vec"))
    return slim.mapInArrow(_pack, "owner string, embedded_at timestamp, embedding_id bigint, dim int, k1 bigint, k2 bigint, q binary, scale float").select("embedding_id", "dim", "q", "scale")


def _entries(dim: int, beam: int):
    """The nodes of a query's cells that are nearest to it."""

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("embedding_id").to_numpy()
        other = table.column("other").to_numpy(zero_copy_only=False).astype(bool)
        ask, nodes = np.flatnonzero(other), np.flatnonzero(~other)
        out_q, out_n, out_s = [], [], []
        if len(ask) and len(nodes):
            x = unpack_rows(table.column("q").to_pylist(), dim)
            for at in range(0, len(ask), 512):
                s = x[ask[at : at + 512]] @ x[nodes].T
                b = min(beam, s.shape[1])
                top = np.argpartition(-s, b - 1, axis=1)[:, :b]
                out_q.append(np.repeat(ids[ask[at : at + 512]], b))
                out_n.append(ids[nodes[top]].ravel())
                out_s.append(np.take_along_axis(s, top, axis=1).ravel())
        return pa.table({"a": _joined(out_q, np.int64), "node": _joined(out_n, np.int64), "sim": _joined(out_s, np.float64)})

    return run


def search_graph(v: Vectors, graph: DataFrame, queries: DataFrame, k: int = 3, beam: int = BEAM, plan: Plan = WIDE_PLAN) -> DataFrame:
    """``query_id, embedding_id, cosine, rank``: the ``k`` embeddings most similar to each query, its own id left out.

    ``queries`` have query_id (distinct) and vector; unusable vectors and null ids find nothing.
    A query enters the graph at the nearest nodes of its cells and follows edges greedily: the
    nodes at hand are its ``beam`` best so far, and it ends when their neighbours bring none that
    is better. Each of a group of copies is a result of its own. Cosines have four decimals;
    equal ones come by id.
    """
    asked = materialize(_packed_queries(queries), "search-queries")
    reps = representatives(v)
    nearest = Window.partitionBy("a").orderBy(F.desc("sim"), "node")
    best = None
    for r in v.classes.groupBy("dim").agg(F.count("*").alias("n")).collect():
        mine = reps.where(F.col("dim") == r["dim"])
        part = route(mine, r["dim"], r["n"], plan, asked.where(F.col("dim") == r["dim"])).groupBy("cell").applyInArrow(_entries(r["dim"], beam), "a bigint, node bigint, sim double")
        best = part if best is None else best.union(part)
    if best is None:
        best = v.rows.sparkSession.createDataFrame([], "a bigint, node bigint, sim double")

    def keep(df: DataFrame) -> DataFrame:
        once = df.groupBy("a", "node").agg(F.max("sim").alias("sim"))
        return materialize(once.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= beam).drop("rn"), "search-beam")

    best = keep(best)
    edges = graph.select(F.col("u").alias("node"), F.col("v").alias("next")).union(graph.select(F.col("v").alias("node"), F.col("u").alias("next"))).distinct()
    edges = materialize(edges, "search-edges")
    left = asked.select(F.col("embedding_id").alias("a"), F.col("q").alias("qa"), F.col("scale").alias("sa"))
    right = v.rows.select(F.col("embedding_id").alias("node"), F.col("q").alias("qb"), F.col("scale").alias("sb"))
    frontier, seen = best.select("a", "node"), best.select("a", "node")
    for _ in range(MAX_STEPS):
        fresh = edges.join(maybe_broadcast(frontier), "node").select("a", F.col("next").alias("node")).distinct().join(seen, ["a", "node"], "left_anti")
        fresh = materialize(fresh, "search-frontier")
        if fresh.isEmpty():
            break
        scored = fresh.join(left, "a").join(right, "node").select("a", "node", "qa", "sa", "qb", "sb").mapInArrow(_score, "a bigint, node bigint, sim double")
        after = keep(best.union(scored.where("sim is not null")))
        frontier = after.select("a", "node").join(best.select("a", "node"), ["a", "node"], "left_anti")
        seen, best = seen.union(fresh), after
    by_id = Window.partitionBy("rep").orderBy("embedding_id")
    heads = v.copies.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).select(F.col("rep").alias("node"), "embedding_id")
    spread = best.join(maybe_broadcast(heads), "node", "left").select("a", F.coalesce("embedding_id", "node").alias("node"), "sim").where("a <> node")
    ranked = Window.partitionBy("a").orderBy(F.desc(F.round("sim", 6)), "node")
    found = spread.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return found.select(F.col("a").alias("query_id"), F.col("node").alias("embedding_id"), F.round("sim", 4).alias("cosine"), "rank")
