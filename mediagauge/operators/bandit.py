"""Source selection by LinUCB: rewards, state as sums, scores, choice."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediagauge import config as C

AFFINITIES = sorted(C.AFFINITY_PRIORS)
DOMAINS = sorted(C.DOMAIN_WEIGHTS)
BUCKETS = 24 // C.BUCKET_HOURS
#: Added before rounding, so that exact halves go up whatever their last bit is.
TIE = 1e-9
DIM = 1 + len(AFFINITIES) + len(DOMAINS) + BUCKETS


def yield_reward(accepted: Column, duplicates: Column, relevance: Column, fetched: Column) -> Column:
    """Reward of a fetch: 0.7 of the yield, 0.3 of the relevance, less up to 0.35 for duplicates; 0 if it failed."""
    a, d = F.greatest(F.lit(0), F.coalesce(accepted, F.lit(0))), F.greatest(F.lit(0), F.coalesce(duplicates, F.lit(0)))
    rel = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(relevance, F.lit(0.0)), F.lit(0.0))))
    penalty = F.least(F.lit(0.35), d / F.greatest(F.lit(1), a + d) * 0.35)
    score = 0.70 * F.least(F.lit(1.0), a / F.lit(float(C.YIELD_TARGET))) + 0.30 * rel - penalty
    return F.when(fetched, F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)) + TIE, 4)).otherwise(0.0)


def signal_reward(domain: str) -> Column:
    """Reward of a signal: its values weighted as in the domain's drift."""
    total = F.lit(0.0)
    for k in C.SIGNALS:
        total = total + F.lit(C.DOMAIN_WEIGHTS[domain][k]) * F.coalesce(F.nanvl(F.col(k), F.lit(0.0)), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 4)


def context(affinity: Column, domain: Column, hour: Column) -> Column:
    """The active places of the one-hot context: constant, affinity, domain, time of day; unknown ones are left out."""
    at = lambda c, names, offset: F.when(F.array_position(F.array(*[F.lit(n) for n in names]), c) > 0, F.array_position(F.array(*[F.lit(n) for n in names]), c).cast("int") - 1 + offset)
    slot = F.least(F.lit(BUCKETS - 1), F.floor(hour / C.BUCKET_HOURS).cast("int")) + 1 + len(AFFINITIES) + len(DOMAINS)
    places = F.array(F.lit(0), at(affinity, AFFINITIES, 1), at(domain, DOMAINS, 1 + len(AFFINITIES)), slot)
    return F.filter(places, lambda x: x.isNotNull())


def accumulate(pulls: DataFrame) -> DataFrame:
    """State as ``outlet, i, j, a, b``: sums of x xT beyond the identity, and of reward x on the diagonal rows.

    ``pulls`` have outlet, places (see context), reward. Sums do not depend on the order of pulls.
    """
    long = pulls.select("outlet", "reward", "places", F.explode("places").alias("i")).select("outlet", "reward", "i", F.explode("places").alias("j"))
    return long.groupBy("outlet", "i", "j").agg(F.count("*").alias("a"), F.round(F.sum(F.when(F.col("i") == F.col("j"), F.col("reward"))), 4).alias("b"))


def scores(state: DataFrame, arms: DataFrame) -> DataFrame:
    """``outlet, score, pulls`` of every arm (outlet, places): expected reward plus exploration, six decimals.

    The state of an outlet has at most DIM x DIM rows; an arm without state has the prior.
    """
    cells = state.groupBy("outlet").agg(F.collect_list(F.struct("i", "j", "a", "b")).alias("cells"))
    joined = arms.join(cells, "outlet", "left").select("outlet", "places", "cells")

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for outlet, places, cells in zip(pdf["outlet"], pdf["places"], pdf["cells"], strict=True):
                a, b, pulls = np.eye(DIM), np.zeros(DIM), 0
                for c in cells if cells is not None else ():
                    a[c["i"], c["j"]] += c["a"]
                    if c["i"] == c["j"]:
                        b[c["i"]] += c["b"] or 0.0
                        pulls = max(pulls, int(c["a"]))
                x = np.zeros(DIM)
                x[list(places)] = 1.0
                both = np.linalg.solve(a, np.stack([b, x], axis=1))
                rows.append((outlet, round(float(both[:, 0] @ x + C.BANDIT_ALPHA * np.sqrt(max(0.0, x @ both[:, 1]))), 6), pulls))
            yield pd.DataFrame(rows, columns=["outlet", "score", "pulls"])

    return joined.mapInPandas(solve, "outlet string, score double, pulls bigint")


def select_outlets(scored: DataFrame, k: int) -> DataFrame:
    """The ``k`` outlets to fetch: unexplored ones first, then by score, fewer pulls, name."""
    w = Window.partitionBy().orderBy((F.col("pulls") > 0).cast("int"), F.desc("score"), "pulls", "outlet")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
