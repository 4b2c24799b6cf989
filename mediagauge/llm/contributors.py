"""Capping of records per contributor with an incremental state table.

The state is a table in the shared folder: each contributor's kept records, in buckets by a hash
of the contributor, and a log of events to which every batch appends. A contributor's cutoff is
the worst of its kept records once the list is full. A new batch is filtered against the cutoffs,
merged into the lists of the buckets it touches, and whatever has to go is logged as displaced;
the other buckets are neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediagauge.llm.vectors import maybe_broadcast
from mediagauge.operators.outlets import with_standard_outlet
from mediagauge.session import materialize, shared_dir

#: Buckets of the state; a batch reads and rewrites those that its contributors fall into.
BUCKETS = 8
#: Batches into which ``cap_signals`` divides a backlog, by time.
BATCHES = 3
DISPLACED, RESTORED = "displaced", "restored"


@dataclass
class CapState:
    """State of capped records in ``folder``.

    ``parts`` names the table of kept records of each bucket, ``log`` the tables of events and
    ``free`` those of records without a contributor, in the order of the batches.
    """

    spark: SparkSession
    folder: str
    keys: list[str]
    limit: int
    schema: T.StructType
    batches: int = 0
    parts: dict[int, str] = field(default_factory=dict)
    log: list[str] = field(default_factory=list)
    free: list[str] = field(default_factory=list)

    @property
    def columns(self) -> list[str]:
        return [*self.keys, "id", "score"]

    def _read(self, paths: list[str], extra: str = "") -> DataFrame:
        schema = T.StructType([*self.schema.fields, *(T.StructType.fromDDL(extra).fields if extra else [])])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def kept_in(self, buckets: list[int]) -> DataFrame:
        """Kept records of contributors in ``buckets``."""
        return self._read([self.parts[b] for b in buckets if b in self.parts])

    @property
    def kept(self) -> DataFrame:
        """Records that stay, those without a contributor included."""
        free = self._read(self.free, "batch int")
        newest = free.groupBy("id").agg(F.max_by(F.struct(*self.keys, "score"), "batch").alias("r"), F.max("batch").alias("batch"))
        newest = newest.select(*[F.col(f"r.{k}").alias(k) for k in self.keys], "id", "r.score", "batch")
        if self.batches > 1 and self.free:
            moved = self._read(self.log, "event string, batch int").where(F.col("event") == "moved").select("id", F.col("batch").alias("moved"))
            moved = moved.groupBy("id").agg(F.max("moved").alias("moved"))
            newest = newest.join(moved, "id", "left").where("moved is null or moved < batch")
        return self.kept_in(sorted(self.parts)).select(*self.columns).union(newest.select(*self.columns))

    def displaced_where(self, wanted: DataFrame | None, on: list[str]) -> DataFrame:
        """Displaced records (null-safe ``on`` among ``wanted``, if given) as the log's last events tell."""
        events = self._read(self.log, "event string, batch int").where(F.col("event").isin(DISPLACED, RESTORED))
        if wanted is not None:
            events = events.join(maybe_broadcast(wanted), on, "left_semi")
        # Within a batch a record is put back first and displaced anew afterwards.
        last = events.groupBy(*self.keys, "id").agg(F.max_by(F.struct("score", "event"), F.struct("batch", F.col("event") == DISPLACED)).alias("e"))
        return last.where(F.col("e.event") == DISPLACED).select(*self.keys, "id", F.col("e.score").alias("score"))

    @property
    def displaced(self) -> DataFrame:
        """Records that may not stay."""
        return self.displaced_where(None, [])

    def save(self) -> None:
        """Write the manifest; a reader sees a batch only as a whole."""
        told = json.dumps({"keys": self.keys, "limit": self.limit, "schema": self.schema.json(), "batches": self.batches, "parts": self.parts, "log": self.log, "free": self.free})
        self.spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{self.folder}/manifest-{self.batches:06d}")


def new_state(like: DataFrame, keys: list[str], limit: int, folder: str | None = None) -> CapState:
    """An empty state for records of the form of ``like`` (``keys``, id, score)."""
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in like.select(*keys, "id", "score").schema.fields])
    return CapState(like.sparkSession, folder or f"{shared_dir(like.sparkSession)}/cap-state-{uuid.uuid4().hex}", keys, limit, schema)


def open_state(spark: SparkSession, folder: str, batches: int) -> CapState:
    """The state as it was after ``batches`` batches."""
    told = json.loads(spark.read.text(f"{folder}/manifest-{batches:06d}").first()[0])
    schema = T.StructType.fromJson(json.loads(told["schema"]))
    return CapState(spark, folder, told["keys"], told["limit"], schema, told["batches"], {int(b): p for b, p in told["parts"].items()}, told["log"], told["free"])


def _order() -> list:
    """Best first: the highest score, null and NaN last, ties by smaller id."""
    usable = F.col("score").isNotNull() & ~F.isnan("score")
    return [F.when(usable, 0).otherwise(1), F.when(usable, F.col("score")).desc(), F.col("id")]


def _best(records: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The ``limit`` best records of each contributor; lists are cut within each task before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*_order())
    return records.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= limit).drop("rn")


def _beats(score: str, id_: str, cut_score: str, cut_id: str):
    good = F.col(score).isNotNull() & ~F.isnan(score)
    cut_good = F.col(cut_score).isNotNull() & ~F.isnan(cut_score)
    same = F.when(good, F.col(score) == F.col(cut_score)).otherwise(F.lit(True)) & (good == cut_good)
    higher = (good & ~cut_good) | (good & cut_good & (F.col(score) > F.col(cut_score)))
    return higher | (same & (F.col(id_) < F.col(cut_id)))


def _bucket(keys: list[str]) -> F.Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def cutoffs(best: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Of every contributor with a full list: the record that a new one has to beat."""
    good = F.col("score").isNotNull() & ~F.isnan("score")
    worst = F.struct((~good).alias("bad"), F.when(good, -F.col("score")).alias("low"), F.col("id").alias("cut_id"), F.col("score").alias("cut_score"))
    full = best.groupBy(*keys).agg(F.count("*").alias("n"), F.max(worst).alias("w")).where(F.col("n") >= limit)
    return full.select(*keys, "w.cut_score", "w.cut_id")


def cap_batch(state: CapState, batch: DataFrame, updates: bool = True) -> CapState:
    """The state after a batch of records (the state's keys, id, score; ids distinct within the batch).

    A record whose id the state already holds replaces the earlier version; a contributor that
    lost a kept record to this gets its best displaced ones back. With ``updates`` false the
    caller promises new ids only, and earlier batches are not searched for them. Records with a
    null key are kept outside any cap, those with a null id are ignored.
    """
    keys, limit, columns, spark = state.keys, state.limit, state.columns, state.spark
    number, at = state.batches + 1, f"{state.folder}/batch-{state.batches + 1:06d}"
    owned = F.lit(True)
    for k in keys:
        owned = owned & F.col(k).isNotNull()
    rows = batch.select(*columns).where("id is not null").withColumn("bucket", F.when(owned, _bucket(keys)))
    if updates:  # without updates the batch is read twice only
        rows = materialize(rows, "cap-batch")
    touched = {r[0] for r in rows.select("bucket").distinct().collect()}
    free, buckets = None in touched, touched - {None}
    mine = rows.where("bucket is not null")
    known = updates and state.batches > 0
    gone = None
    if known:
        ids = rows.select("id")
        kept_before = state.kept_in(sorted(state.parts)).select(*columns).join(maybe_broadcast(ids), "id", "left_semi").select(*columns, F.lit(True).alias("was_kept"))
        out_before = state.displaced_where(ids, ["id"]).select(*columns, F.lit(False).alias("was_kept"))
        gone = materialize(kept_before.union(out_before), "cap-replaced")
        short = gone.where("was_kept").select(*keys).distinct()
        buckets |= {r[0] for r in short.select(_bucket(keys)).distinct().collect()}
    order = sorted(buckets)
    kept = state.kept_in(order).select(*columns)
    if known:
        kept = kept.join(maybe_broadcast(ids), "id", "left_anti").select(*columns)
    cuts = maybe_broadcast(cutoffs(kept, keys, limit))
    judged = mine.join(cuts, keys, "left").withColumn("wins", F.col("cut_id").isNull() | _beats("score", "id", "cut_score", "cut_id"))
    judged = materialize(judged.select(*columns, "wins"), "cap-judged") if state.parts else mine.select(*columns, F.lit(True).alias("wins"))
    pool = kept.withColumn("old", F.lit(1)).union(judged.where("wins").select(*columns, F.lit(0).alias("old")))
    if known:
        back = state.displaced_where(short, keys).join(ids, "id", "left_anti")
        pool = pool.union(back.select(*columns, F.lit(2).alias("old")))
    best = _best(pool, keys, limit).withColumn("bucket", _bucket(keys))
    best.write.partitionBy("bucket").parquet(f"{at}/kept")
    parts = dict(state.parts)
    written = {b for b in order if _exists(spark, f"{at}/kept/bucket={b}")}
    for b in order:
        parts.pop(b, None)
        if b in written:
            parts[b] = f"{at}/kept/bucket={b}"
    best = spark.read.schema(T.StructType([*state.schema.fields, T.StructField("old", T.IntegerType())])).parquet(*[parts[b] for b in sorted(written)]) if written else pool.limit(0)
    # Whatever is worse than the new cutoff of its contributor leaves the list.
    after = maybe_broadcast(cutoffs(best, keys, limit))
    worse = _beats("cut_score", "cut_id", "score", "id")
    lost = judged.where("not wins").select(*columns).union(pool.where("old < 2").join(after, keys).where(worse).select(*columns))
    events = lost.withColumn("event", F.lit(DISPLACED))
    if known:
        restored = best.where("old = 2").select(*columns).union(gone.where("not was_kept").select(*columns))
        # A record without a contributor that now has one leaves the free ones.
        events = events.union(restored.withColumn("event", F.lit(RESTORED))).union(mine.select(*columns, F.lit("moved").alias("event")) if state.free else events.limit(0))
    events.withColumn("batch", F.lit(number)).write.parquet(f"{at}/log")
    if free:
        rows.where("bucket is null").select(*columns, F.lit(number).alias("batch")).write.parquet(f"{at}/free")
    result = CapState(spark, state.folder, keys, limit, state.schema, number, parts, [*state.log, f"{at}/log"], [*state.free, *([f"{at}/free"] if free else [])])
    result.save()
    return result


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def cap_share(records: DataFrame, group: list[str], contributor: str, share: float) -> DataFrame:
    """``records`` with ``stays``: a contributor may keep ``share`` of the records of its group, one at least.

    The share is taken of all records of the group (rounded down), the best stay. Records with
    a null key always stay; those with a null id are left out. Ranks are taken per contributor,
    so of a contributor that holds most rows of all groups one task sorts no more than one group's.
    """
    if not 0 < share <= 1:
        raise ValueError("a share lies between 0 and 1")
    keys = [*group, contributor]
    rows = records.select(*keys, "id", "score").where("id is not null")
    sizes = rows.groupBy(*group).agg(F.greatest(F.floor(F.count("*") * F.lit(share) + F.lit(1e-9)), F.lit(1)).alias("most"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*_order())))
    free = F.lit(False)
    for k in keys:
        free = free | F.col(k).isNull()
    return ranked.join(maybe_broadcast(sizes), group, "left").select(*keys, "id", "score", (free | (F.col("rn") <= F.col("most"))).alias("stays"))


def latest_signals(signals: DataFrame, articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """``run_id, std_outlet, id, score, extracted_at``: one row per signal_id, its latest version.

    Of versions with equal extracted_at the larger run, outlet and score count, a null time is
    the earliest. A null outlet is replaced by the article's; a spelling that no feed accepts
    stands for itself, so it is capped as a contributor of its own.
    """
    version = F.struct("extracted_at", "run_id", "outlet", F.col("topic_relevance_score").alias("score"), "article_id")
    rows = signals.where("signal_id is not null").groupBy("signal_id").agg(F.max(version).alias("r"))
    rows = rows.select(F.col("signal_id").alias("id"), "r.run_id", "r.outlet", "r.score", "r.article_id", "r.extracted_at")
    spelled = F.when(F.trim("outlet") != "", F.lower(F.trim("outlet")))
    named = with_standard_outlet(rows, feeds.select("outlet", "outlet_name", "host"))
    named = materialize(named.withColumn("std_outlet", F.coalesce("std_outlet", spelled)), "signals")
    bare = named.where("outlet is null").drop("std_outlet")
    wanted = articles.select("article_id", F.col("outlet").alias("article_outlet")).where("article_outlet is not null")
    wanted = wanted.join(maybe_broadcast(bare.select("article_id").distinct()), "article_id", "left_semi")
    owner = with_standard_outlet(wanted, feeds.select("outlet", "outlet_name", "host"), "article_outlet")
    owner = owner.groupBy("article_id").agg(F.min("std_outlet").alias("std_outlet"))
    filled = bare.join(owner, "article_id", "left")
    fields = ["run_id", "std_outlet", "id", "score", "extracted_at"]
    return named.where("outlet is not null").select(*fields).union(filled.select(*fields))


def time_slices(rows: DataFrame, slices: int, column: str = "extracted_at") -> list[DataFrame]:
    """``rows`` in ``slices`` parts of about equal size by time; rows without a time come first."""
    seconds = F.unix_micros(F.col(column).cast("timestamp"))
    shares = [k / slices for k in range(1, slices)]
    bounds = sorted(set(rows.agg(F.percentile_approx(seconds, shares)).first()[0] or [])) if shares else []
    out, low = [], None
    for high in [*bounds, None]:
        part = rows
        if high is not None:
            part = part.where((seconds <= high) | F.col(column).isNull() if low is None else (seconds > low) & (seconds <= high))
        elif low is not None:
            part = part.where(seconds > low)
        out.append(part)
        low = high
    return out


def cap_signals(signals: DataFrame, articles: DataFrame, feeds: DataFrame, limit: int = 8, batches: int = BATCHES) -> CapState:
    """The state after all signals, ``limit`` per run and standard outlet, came in ``batches`` by time."""
    rows = materialize(latest_signals(signals, articles, feeds), "cap-input")
    state = new_state(rows, ["run_id", "std_outlet"], limit)
    for part in time_slices(rows, batches):
        state = cap_batch(state, part, updates=False)
    return state
