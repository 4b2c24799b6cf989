"""Cluster centroids, coherence, exemplars, agreement of runs, and matching to tracks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions.vector import cosine
from mediagauge.operators.graph import connected_components
from mediagauge.session import materialize

KEY = ["run_id", "cluster_id"]
#: Tracks that are compared with all clusters at once; more are compared in blocks.
TRACK_BLOCK = 20_000


def members(memberships: DataFrame) -> DataFrame:
    """Members of clusters, copies of rows once, noise left out; a strength outside 0..1 is null."""
    s = F.col("membership_strength")
    rows = memberships.select("run_id", "cluster_id", "article_id", "embedding_id", "is_noise", F.when((s >= 0) & (s <= 1), s).alias("strength"))
    return rows.where("run_id is not null and cluster_id is not null and coalesce(is_noise, 0) = 0").distinct()


def usable(embeddings: DataFrame) -> DataFrame:
    """Complete rows whose vector has embedding_dim finite elements, not all zero."""
    v = F.col("embedding_vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return embeddings.where((F.col("status") == "complete") & (F.size(v) == F.col("embedding_dim")) & finite)


def with_vectors(rows: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Members joined with the usable complete vector of their embedding."""
    one = usable(embeddings).groupBy("embedding_id").agg(F.max("embedding_vector").alias("vector"))
    return rows.join(one, "embedding_id")


def centroids(vectors: DataFrame) -> DataFrame:
    """Unit mean vector and size of each cluster, summed by position so that no cluster is gathered."""
    long = vectors.select(*KEY, F.posexplode("vector").alias("pos", "x"))
    means = long.groupBy(*KEY, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    arrays = means.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    norm = F.sqrt(F.aggregate("mean", F.lit(0.0), lambda s, x: s + x * x))
    sizes = vectors.groupBy(*KEY).agg(F.count("*").alias("size"))
    unit = F.when(norm > 0, F.transform("mean", lambda x: x / norm)).otherwise(F.col("mean"))
    return arrays.select(*KEY, unit.alias("centroid")).join(sizes, KEY)


def member_cosines(vectors: DataFrame, centres: DataFrame) -> DataFrame:
    """Each member's cosine to its centroid."""
    return vectors.join(centres.select(*KEY, "centroid"), KEY).select(*KEY, "article_id", "embedding_id", "strength", cosine(F.col("vector"), F.col("centroid"), -1.0).alias("cosine"))


def coherence(cosines: DataFrame) -> DataFrame:
    """Mean cosine of the members, each within 0..1, four decimals."""
    return cosines.groupBy(*KEY).agg(F.round(F.avg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "cosine"))), 4).alias("coherence"), F.count("*").alias("size"))


def exemplars(cosines: DataFrame, count: int) -> DataFrame:
    """The ``count`` members nearest to the centroid, then the strongest, then by id."""
    w = Window.partitionBy(*KEY).orderBy(F.desc(F.round("cosine", 9)), F.col("strength").desc_nulls_last(), "article_id", "embedding_id")
    return cosines.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= count)


def fingerprints(rows: DataFrame) -> DataFrame:
    """Hash of each cluster's sorted members, the same for the same members in any order."""
    one = F.concat_ws(":", "article_id", F.col("embedding_id").cast("string"))
    return rows.groupBy(*KEY).agg(F.sha2(F.array_join(F.sort_array(F.collect_set(one)), ";"), 256).alias("fingerprint"))


def run_agreement(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: articles labelled in both runs, adjusted Rand index and normalised mutual information.

    Inputs have article_id, label; noise is a label like any other. Closed forms over the
    contingency table; null where they are undefined.
    """
    both = left.select("article_id", F.col("label").alias("x")).join(right.select("article_id", F.col("label").alias("y")), "article_id")
    table = both.groupBy("x", "y").agg(F.count("*").cast("double").alias("n"))
    rows, cols = table.groupBy("x").agg(F.sum("n").alias("a")), table.groupBy("y").agg(F.sum("n").alias("b"))
    pairs = lambda c: F.col(c) * (F.col(c) - 1) / 2
    total = table.agg(F.sum("n").alias("n"), F.sum(pairs("n")).alias("sij"))
    sa = rows.agg(F.sum(pairs("a")).alias("sa"), F.sum(F.col("a") * F.log("a")).alias("la"))
    sb = cols.agg(F.sum(pairs("b")).alias("sb"), F.sum(F.col("b") * F.log("b")).alias("lb"))
    joint = table.agg(F.sum(F.col("n") * F.log("n")).alias("lij"))
    row = total.crossJoin(sa).crossJoin(sb).crossJoin(joint)
    n, expected = F.col("n"), F.try_divide(F.col("sa") * F.col("sb"), pairs("n"))
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.try_divide(F.col("sij") - expected, top - expected)
    hx, hy = F.log(n) - F.col("la") / n, F.log(n) - F.col("lb") / n
    mutual = F.log(n) + (F.col("lij") - F.col("la") - F.col("lb")) / n
    nmi = F.try_divide(mutual, (hx + hy) / 2)
    return row.select(F.coalesce(n, F.lit(0.0)).cast("bigint").alias("articles"), F.round(ari, 4).alias("ari"), F.round(nmi, 4).alias("nmi"))


def survival(base: DataFrame, sample: DataFrame) -> DataFrame:
    """Per base cluster: the largest share of its members that stay together in the sample; at least two must be there."""
    both = base.select("article_id", "label").join(sample.select("article_id", F.col("label").alias("then")), "article_id")
    counts = both.groupBy("label", "then").agg(F.count("*").alias("n"))
    return counts.groupBy("label").agg(F.sum("n").alias("overlap"), F.max("n").alias("most")).where("overlap >= 2").select("label", "overlap", F.round(F.col("most") / F.col("overlap"), 4).alias("survival"))


def match_candidates(clusters: DataFrame, tracks: DataFrame, gate: float = C.MATCH_GATE) -> DataFrame:
    """``cluster_id, track_id, distance`` of cluster and track centroids within the gate, four decimals.

    Tracks are sent to the clusters in blocks of TRACK_BLOCK, so neither side needs to fit in memory.
    """
    count = tracks.count()
    blocks, found = max(1, -(-count // TRACK_BLOCK)), None
    for b in range(blocks):
        part = tracks.where(F.pmod(F.xxhash64("track_id"), F.lit(blocks)) == b) if blocks > 1 else tracks
        block = part.select("track_id", "centroid").toPandas()
        ids = block["track_id"].to_numpy()
        matrix = np.array(block["centroid"].tolist(), dtype=np.float64).reshape(len(ids), -1)

        def compare(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                x = np.array(pdf["centroid"].tolist(), dtype=np.float64)
                d = np.round(1.0 - np.clip(x @ matrix.T, -1.0, 1.0), 4)
                i, j = np.nonzero(d <= gate)
                yield pd.DataFrame({"cluster_id": pdf["cluster_id"].to_numpy()[i], "track_id": ids[j], "distance": d[i, j]})

        near = clusters.select("cluster_id", "centroid").mapInPandas(compare, "cluster_id bigint, track_id bigint, distance double")
        found = near if found is None else found.union(near)
    return found


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Optimal assignment of rows to columns by shortest augmenting paths; every row of the smaller side is assigned."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for row in range(1, n + 1):
        owner[0], j = row, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j] = True
            free = ~used[1:]
            reduced = c[owner[j] - 1] - u[owner[j]] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better] = reduced[better]
            way[1:][better] = j
            nxt = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[nxt]
            u[owner[used]] += delta
            v[used] -= delta
            least[1:][free] -= delta
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return [(b, a) for a, b in pairs] if flipped else pairs


def best_assignment(candidates: DataFrame) -> DataFrame:
    """One-to-one matches of the candidates (cluster_id, track_id, distance, cost): as many as possible, then of least total cost.

    A match of UNMATCHED_COST or more, and one without a cost, is none. Only candidates that share
    a cluster or a track compete, so each component is solved on its own; a pair without any
    rival is taken as it is.
    """
    candidates = materialize(candidates.where(F.col("cost") < C.UNMATCHED_COST).select("cluster_id", "track_id", "distance", "cost"), "match-candidates")
    rivals = [candidates.groupBy(k).agg(F.count("*").alias(f"of_{k}")) for k in ("cluster_id", "track_id")]
    counted = candidates.join(rivals[0], "cluster_id").join(rivals[1], "track_id").withColumn("alone", (F.col("of_cluster_id") == 1) & (F.col("of_track_id") == 1))
    counted = materialize(counted.select("cluster_id", "track_id", "distance", "cost", "alone"), "match-rivals")
    rest = counted.where("not alone")
    # Nodes of both sides have numbers of their own.
    node = lambda side, k: F.xxhash64(F.lit(side), F.col(k))
    roots = connected_components(rest.select(node("cluster", "cluster_id").alias("a"), node("track", "track_id").alias("b"))).select(F.col("id").alias("node"), "root")
    placed = rest.withColumn("node", node("cluster", "cluster_id")).join(roots, "node")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, r = np.unique(pdf["cluster_id"], return_inverse=True)
        cols, k = np.unique(pdf["track_id"], return_inverse=True)
        cost, distance = np.full((len(rows), len(cols)), 1e6), np.zeros((len(rows), len(cols)))
        cost[r, k], distance[r, k] = pdf["cost"], pdf["distance"]
        kept = [(rows[i], cols[j], distance[i, j], cost[i, j]) for i, j in assign(cost) if cost[i, j] < 1e6]
        return pd.DataFrame(kept, columns=["cluster_id", "track_id", "distance", "cost"])

    solved = placed.select("root", "cluster_id", "track_id", "distance", "cost").groupBy("root").applyInPandas(solve, "cluster_id bigint, track_id bigint, distance double, cost double")
    return counted.where("alone").select("cluster_id", "track_id", "distance", "cost").union(solved)


#: Values of a track beside its centroid that a matched cluster blends into.
TRACK_VALUES = [*C.SIGNALS, *[f"seg_{s}" for s in C.SEGMENTS]]


def lifecycle(tracks: DataFrame, matches: DataFrame, clusters: DataFrame, run_id: str = "") -> DataFrame:
    """Tracks after a run: matched ones blended, missing ones counted, new ones begun.

    ``tracks`` have track_id, centroid, sample_count, missed_runs and, if at hand, the signals and
    segment shares, frame and label; ``clusters`` the same under cluster_id, with size. A match
    blends centroid, signals and shares (four decimals), takes over the cluster's frame and label,
    adds its size and resets missed_runs; a track that misses MAX_MISSED_RUNS runs becomes
    inactive; an unmatched cluster starts a track that is not learned, numbered by a hash of the
    run and the cluster.
    """
    values = [c for c in TRACK_VALUES if c in tracks.columns and c in clusters.columns]
    words = [c for c in ("frame", "label") if c in tracks.columns and c in clusters.columns]
    now = clusters.select("cluster_id", F.col("centroid").alias("now"), "size", *[F.col(c).alias(f"now_{c}") for c in [*values, *words]])
    joined = tracks.join(matches.select("cluster_id", "track_id").join(now, "cluster_id"), "track_id", "left")
    blended = F.zip_with("centroid", "now", lambda a, b: C.EMA_OLD * a + C.EMA_NEW * b)
    norm = F.sqrt(F.aggregate(blended, F.lit(0.0), lambda s, x: s + x * x))
    hit = F.col("cluster_id").isNotNull()
    kept = joined.select(
        "track_id",
        F.when(hit, F.transform(blended, lambda x: F.try_divide(x, norm))).otherwise(F.col("centroid")).alias("centroid"),
        (F.col("sample_count") + F.coalesce("size", F.lit(0))).alias("sample_count"),
        F.when(hit, 0).otherwise(F.col("missed_runs") + 1).alias("missed_runs"),
        F.when(hit, "matched").otherwise("missing").alias("match_type"),
        *[F.when(hit, F.round(C.EMA_OLD * F.coalesce(c, F.lit(0.0)) + C.EMA_NEW * F.coalesce(f"now_{c}", F.lit(0.0)), 4)).otherwise(F.col(c)).alias(c) for c in values],
        *[F.when(hit, F.coalesce(f"now_{c}", c)).otherwise(F.col(c)).alias(c) for c in words],
    )
    fresh = clusters.join(matches.select("cluster_id"), "cluster_id", "left_anti")
    new = fresh.select(F.xxhash64(F.lit(run_id), "cluster_id").alias("track_id"), "centroid", F.col("size").alias("sample_count"), F.lit(0).alias("missed_runs"), F.lit("new").alias("match_type"), *values, *words)
    return kept.unionByName(new).withColumn("active", F.col("missed_runs") < C.MAX_MISSED_RUNS).withColumn("is_learned", (F.col("match_type") != "new") & (F.col("sample_count") >= C.MIN_BASELINE_ARTICLES))


def previous_observations(history: DataFrame, current_run: str) -> DataFrame:
    """``track_id, run_id, cluster_id, member_count``: of every track its latest observation of another run.

    ``history`` has track_id, run_id, cluster_id, member_count, computed_at and id; observations
    without a cluster do not count, a null member_count is 0, of equal times the larger id counts.
    """
    rows = history.where((F.col("run_id") != current_run) & F.col("cluster_id").isNotNull() & F.col("track_id").isNotNull())
    newest = rows.groupBy("track_id").agg(F.max_by(F.struct("run_id", "cluster_id", "member_count"), F.struct("computed_at", "id")).alias("r"))
    return newest.select("track_id", "r.run_id", "r.cluster_id", F.coalesce("r.member_count", F.lit(0)).alias("member_count"))
