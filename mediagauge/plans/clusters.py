"""Queries on duplicates, clusters, tracks and their stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.operators import clusters as K
from mediagauge.operators import dedupe, density
from mediagauge.operators import observations as O
from mediagauge.operators.latest import latest_embedding
from mediagauge.operators.views import article_view, signal_view
from mediagauge.plans import sqltext as S
from mediagauge.plans.texts import _collapse, _one, _words
from mediagauge.session import materialize
from mediagauge.tables import table

WINDOW = ["canonical_topic_id", "period"]


def _articles(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    articles = article_view(table(spark, root, "articles"), ("title", "summary", "body", "canonical_url"))
    usable = K.usable(table(spark, root, "article_embeddings"))
    return articles, latest_embedding(usable, True).select("article_id", F.col("embedding_vector").alias("vector"))


def _prepared(spark: SparkSession, root: str, unit: str = "year") -> DataFrame:
    articles, vectors = _articles(spark, root)
    scoped = articles.where("canonical_topic_id is not null and fetched_at is not null").withColumn("period", F.trunc(F.to_date("fetched_at"), unit))
    return materialize(dedupe.prepared(scoped, vectors, WINDOW), "articles")


def _prepared_all(spark: SparkSession, root: str) -> DataFrame:
    articles, vectors = _articles(spark, root)
    return materialize(dedupe.prepared(articles.withColumn("scope", F.lit(0)), vectors, ["scope"]), "articles")


def dup_edges(spark: SparkSession, root: str) -> DataFrame:
    """Duplicate links of articles of one topic and year, with the rule that applies."""
    return dedupe.duplicate_edges(_prepared(spark, root), WINDOW)


def dup_representatives(spark: SparkSession, root: str) -> DataFrame:
    """Groups of duplicates with representative, size and reasons."""
    return dedupe.duplicate_summary(_prepared(spark, root), WINDOW)[0]


def dedupe_stats(spark: SparkSession, root: str) -> DataFrame:
    """Totals of duplicate removal."""
    return dedupe.duplicate_summary(_prepared(spark, root), WINDOW)[1]


def dup_edges_all(spark: SparkSession, root: str) -> DataFrame:
    """Duplicate links of all articles, whatever their topic and time, with the rule that applies."""
    return dedupe.duplicate_edges(_prepared_all(spark, root), ["scope"])


def dup_representatives_all(spark: SparkSession, root: str) -> DataFrame:
    """Groups of duplicates among all articles with representative, size and reasons."""
    return dedupe.duplicate_summary(_prepared_all(spark, root), ["scope"])[0]


def dedupe_stats_all(spark: SparkSession, root: str) -> DataFrame:
    """Totals of duplicate removal from all articles."""
    return dedupe.duplicate_summary(_prepared_all(spark, root), ["scope"])[1]


def _members(spark: SparkSession, root: str) -> DataFrame:
    return K.members(table(spark, root, "cluster_memberships"))


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    return materialize(K.with_vectors(_members(spark, root), table(spark, root, "article_embeddings")), "member-vectors")


def cluster_sizes(spark: SparkSession, root: str) -> DataFrame:
    """Articles of every cluster, ratings of their strength and the sum of these."""
    rows = _members(spark, root)
    return rows.groupBy(*K.KEY).agg(F.countDistinct("article_id").alias("articles"), F.count("strength").alias("rated"), F.round(F.sum("strength"), 4).alias("strength_sum"))


def cluster_centroid(spark: SparkSession, root: str) -> DataFrame:
    """Size and centroid of every cluster, three of its elements and their sum."""
    centres = K.centroids(_vectors(spark, root))
    total = F.aggregate("centroid", F.lit(0.0), lambda s, x: s + x)
    return centres.select(*K.KEY, "size", F.size("centroid").alias("dim"), *[F.round(F.col("centroid")[i], 6).alias(f"c{i}") for i in range(3)], F.round(total, 6).alias("total"))


def _cosines(spark: SparkSession, root: str) -> DataFrame:
    vectors = _vectors(spark, root)
    return K.member_cosines(vectors, materialize(K.centroids(vectors), "centroids"))


def cluster_coherence(spark: SparkSession, root: str) -> DataFrame:
    """Coherence of every cluster."""
    return K.coherence(_cosines(spark, root))


def cluster_exemplars(spark: SparkSession, root: str) -> DataFrame:
    """The three members nearest to each centroid."""
    return K.exemplars(_cosines(spark, root), 3).select(*K.KEY, "article_id", "embedding_id", "rank")


def cluster_fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """Hash of every cluster's members."""
    return K.fingerprints(_members(spark, root))


def noise_rates(spark: SparkSession, root: str) -> DataFrame:
    """Share of noise of every run, copies of rows once."""
    rows = table(spark, root, "cluster_memberships").distinct()
    return rows.groupBy("run_id").agg(F.count("*").alias("members"), F.round(F.avg(F.col("is_noise").cast("double")), 6).alias("noise_rate"))


def _labels(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    rows = table(spark, root, "cluster_memberships").where(F.col("run_id").endswith(suffix) & F.col("article_id").isNotNull())
    return rows.groupBy("article_id").agg(F.max(F.coalesce("cluster_id", F.lit(-1))).alias("label"))


def cluster_agreement(spark: SparkSession, root: str) -> DataFrame:
    """Agreement of the two runs."""
    return K.run_agreement(_labels(spark, root, "-0"), _labels(spark, root, "-1"))


def cluster_survival(spark: SparkSession, root: str) -> DataFrame:
    """How far the clusters of the first run stay together in the second."""
    return K.survival(_labels(spark, root, "-0").where("label >= 0"), _labels(spark, root, "-1"))


def survival_summary(spark: SparkSession, root: str) -> DataFrame:
    """Median, p10 and p90 of survival."""
    s = cluster_survival(spark, root)
    return s.agg(*[F.round(F.percentile("survival", F.lit(q)), 4).alias(n) for n, q in (("median", 0.5), ("p10", 0.1), ("p90", 0.9))], F.count("*").alias("clusters"))


def _runs(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    centres = materialize(K.centroids(_vectors(spark, root)), "centroids")
    now = centres.where(F.col("run_id").endswith("-1")).select("cluster_id", "centroid", "size")
    tracks = centres.where(F.col("run_id").endswith("-0")).select(F.col("cluster_id").alias("track_id"), "centroid", F.col("size").alias("sample_count"), F.lit(0).alias("missed_runs"))
    return now, tracks


def track_match_candidates(spark: SparkSession, root: str) -> DataFrame:
    """Clusters of the second run near to those of the first."""
    return K.match_candidates(*_runs(spark, root))


def _signals(spark: SparkSession, root: str) -> DataFrame:
    articles = article_view(table(spark, root, "articles"), ("title",))
    return O.cluster_signals(K.members(table(spark, root, "cluster_memberships")), signal_view(table(spark, root, "signals")), articles)


def _told(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Signals of the clusters of the second run, and of the first one's as tracks."""
    rows = materialize(_signals(spark, root), "cluster-signals")
    before = rows.where(F.col("run_id").endswith("-0")).drop("run_id").withColumnRenamed("cluster_id", "track_id")
    return rows.where(F.col("run_id").endswith("-1")).drop("run_id"), before


def _costs(candidates: DataFrame, told: tuple[DataFrame, DataFrame]) -> DataFrame:
    columns = [*C.SIGNALS, "label"]
    before = told[1].select("track_id", *[F.col(c).alias(f"base_{c}") for c in columns])
    pairs = candidates.join(told[0].select("cluster_id", *columns), "cluster_id").join(before, "track_id")
    return O.pair_metrics(pairs, S.DOMAIN).select("cluster_id", "track_id", "distance", "signal_distance", "label_penalty", "cost")


def _matches(spark: SparkSession, root: str, told: tuple[DataFrame, DataFrame]) -> DataFrame:
    return materialize(K.best_assignment(_costs(K.match_candidates(*_runs(spark, root)), told)), "matches")


def pair_costs(spark: SparkSession, root: str) -> DataFrame:
    """Costs of the candidate matches."""
    return _costs(K.match_candidates(*_runs(spark, root)), _told(spark, root))


def track_assignment(spark: SparkSession, root: str) -> DataFrame:
    """One-to-one matches of least total cost."""
    return K.best_assignment(pair_costs(spark, root))


def certain_matches(spark: SparkSession, root: str) -> DataFrame:
    """Matches of clusters and tracks that have one candidate only."""
    pairs = materialize(pair_costs(spark, root), "pair-costs")
    alone = [pairs.groupBy(k).agg(F.count("*").alias("n")).where("n = 1").select(k) for k in ("cluster_id", "track_id")]
    found = K.best_assignment(pairs).join(alone[0], "cluster_id", "left_semi").join(alone[1], "track_id", "left_semi")
    return found.select("cluster_id", "track_id", "distance", "cost")


def track_lifecycle(spark: SparkSession, root: str) -> DataFrame:
    """Tracks after the second run, by kind."""
    now, tracks = _runs(spark, root)
    told = _told(spark, root)
    values = [*K.TRACK_VALUES, "frame", "label"]
    known = tracks.join(told[1].select("track_id", *values), "track_id", "left")
    fresh = now.join(told[0].select("cluster_id", *values), "cluster_id", "left")
    after = K.lifecycle(known, _matches(spark, root, told), fresh, "-1")
    return after.groupBy("match_type", "active", "is_learned").agg(F.count("*").alias("tracks"), F.sum("sample_count").alias("samples"))


def previous_observations(spark: SparkSession, root: str) -> DataFrame:
    """Of every cluster number the latest run before the newest one of its mode that had it, with its members."""
    sizes = K.members(table(spark, root, "cluster_memberships")).groupBy(*K.KEY).agg(F.countDistinct("article_id").alias("member_count"))
    times = table(spark, root, "cluster_memberships").where("run_id is not null").groupBy("run_id").agg(F.max("created_at").alias("computed_at"))
    mode = F.regexp_extract("run_id", "^(.*)-[^-]*$", 1)
    history = sizes.join(times, "run_id").select(F.concat_ws(":", mode, "cluster_id").alias("track_id"), "run_id", "cluster_id", "member_count", "computed_at", F.col("run_id").alias("id"))
    newest = times.agg(F.max_by("run_id", F.struct("computed_at", "run_id"))).first()[0]
    return K.previous_observations(history, newest or "")


def _scoped_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Articles with a vector by topic and quarter, one of every group of duplicates."""
    rows = materialize(_prepared(spark, root, "quarter").where("vector is not null"), "scoped-vectors")
    groups = dedupe.duplicate_groups(rows, materialize(dedupe.duplicate_edges(rows, WINDOW), "duplicate-edges"))
    return rows.join(groups.where("article_id = representative").select("article_id"), "article_id", "left_semi")


def density_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Density clusters of every topic and quarter, duplicates removed."""
    return density.cluster_windows(_scoped_vectors(spark, root), WINDOW)


def stability_report(spark: SparkSession, root: str) -> DataFrame:
    """Stability of the density clusters of every topic and quarter under 25 rounds of resampling, duplicates removed."""
    return density.stability(_scoped_vectors(spark, root), WINDOW)


_MEM = """mem as (select distinct run_id, cluster_id, article_id, embedding_id, is_noise,
  case when membership_strength >= 0 and membership_strength <= 1 then membership_strength end as strength
  from cluster_memberships where run_id is not null and cluster_id is not null and coalesce(is_noise, 0) = 0)"""
_USABLE = """status = 'complete' and len(embedding_vector) = embedding_dim
  and len(list_filter(embedding_vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(embedding_vector, lambda x: x <> 0)) > 0"""
_VEC = f"""emb as (select embedding_id, max(embedding_vector) as vector from article_embeddings where {_USABLE} group by 1),
mv as (select mem.*, vector from mem join emb using (embedding_id))"""
_CEN = """lng as (select run_id, cluster_id, unnest(vector)::double as x, generate_subscripts(vector, 1) as pos from mv),
avgs as (select run_id, cluster_id, pos, avg(x) as m from lng group by all),
cen0 as (select run_id, cluster_id, list(m order by pos) as mean from avgs group by all),
sz as (select run_id, cluster_id, count(*) as size from mv group by all),
cen as (select run_id, cluster_id, size, list_transform(mean, lambda x: x / sqrt(list_sum(list_transform(mean, lambda y: y * y)))) as centroid from cen0 join sz using (run_id, cluster_id))"""
_COS = """cosines as (select mv.run_id, mv.cluster_id, article_id, embedding_id, strength,
  list_cosine_similarity(list_transform(vector, lambda x: x::double), centroid) as cosine from mv join cen using (run_id, cluster_id))"""
CLUSTER_SIGNALS = f"""{S.SIG}, {_one("title")}, {_MEM},
  lat as (select * from sig where article_id is not null qualify row_number() over (partition by article_id order by extracted_at desc nulls last, signal_id desc) = 1),
  mm as (select run_id, cluster_id, article_id, max(strength) as strength from mem group by all),
  jj as (select mm.*, {", ".join(f"case when isnan({k}) then null else {k} end as {k}" for k in C.SIGNALS)}, frame, title from mm left join lat using (article_id) left join one using (article_id)),
  vv as (select run_id, cluster_id, frame, count(*) as n from jj where frame is not null group by all),
  ff as (select run_id, cluster_id, arg_min(frame, row(-n, frame)) as frame from vv group by all),
  bb as (select run_id, cluster_id, count(*) as member_count, {", ".join(f"round(avg({k}) + 1e-9, 4) as {k}" for k in C.SIGNALS)}, arg_max(title, row(coalesce(strength, -1.0), article_id)) as title from jj group by all),
  told as (select run_id, cluster_id, member_count, {", ".join(C.SIGNALS)}, coalesce(frame, 'neutral') as frame,
    nullif(trim(array_to_string(list_filter(string_split(trim(regexp_replace(title, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')[1:8], ' ')[1:80]), '') as label
    from bb left join ff using (run_id, cluster_id))"""
_LAB = "select article_id, max(coalesce(cluster_id, -1)) as label from cluster_memberships where run_id like '%{s}' and article_id is not null group by 1"
_SURV = f"""b as ({_LAB.format(s="-0")}), t as ({_LAB.format(s="-1")}),
  n as (select b.label, t.label as then_label, count(*) as n from b join t using (article_id) where b.label >= 0 group by all),
  s as (select label, sum(n)::bigint as overlap, round(max(n) / sum(n), 4) as survival from n group by 1 having sum(n) >= 2)"""
_stop = ", ".join(f"'{w}'" for w in C.TITLE_STOPWORDS)
_PREP = f"""{_one("title", "summary", "body", "canonical_url")},
vec as (select article_id, embedding_vector as vector from article_embeddings where {_USABLE} and article_id is not null
  qualify row_number() over (partition by article_id order by embedded_at desc nulls last, embedding_id desc) = 1),
tk as (select article_id, canonical_topic_id as topic, date_trunc('year', fetched_at at time zone 'UTC') as period, nullif(lower(trim(canonical_url)), '') as url_key,
  {_words("title")} as tw, {_words("concat_ws(' ', coalesce(title, ''), coalesce(summary, ''), coalesce(body, '')[1:500])")} as ww,
  coalesce(length({_collapse("body")}), 0) as body_len, coalesce(length({_collapse("summary")}), 0) as summary_len, fetched_at, vector
  from one left join vec using (article_id) where canonical_topic_id is not null and fetched_at is not null),
p as (select *, case when length(array_to_string(tw, ' ')) >= 12 and len(tw) >= 2 then array_to_string(tw, ' ') end as title_key,
  list_filter(list_distinct(ww), lambda x: length(x) > 1 and not regexp_full_match(x, '[0-9]+') and x not in ({_stop})) as words from tk),
u as (select min(article_id) over (partition by topic, period, url_key) as a, article_id as b, 'canonical_url' as reason from p where url_key is not null),
tc as (select topic, period, title_key, coalesce(url_key, '#' || article_id) as k, min(article_id) as article_id from p where title_key is not null group by all),
t as (select min(article_id) over (partition by topic, period, title_key) as a, article_id as b, 'title' as reason from tc),
q as (select x.article_id as a, y.article_id as b, list_cosine_similarity(list_transform(x.vector, lambda v: v::double), list_transform(y.vector, lambda v: v::double)) as c,
    len(list_intersect(x.words, y.words)) / len(list_distinct(x.words || y.words)) as o,
    coalesce(x.url_key = y.url_key, false) or coalesce(x.title_key = y.title_key, false) as same
  from p x join p y on x.topic = y.topic and x.period = y.period and x.article_id < y.article_id where x.vector is not null and y.vector is not null),
e as (select a, b, reason from u where a <> b union all select a, b, reason from t where a <> b
  union all select a, b, case when c >= 0.97 and o >= 0.2 then 'semantic' else 'semantic_lexical' end from q
    where not same and ((c >= 0.97 and o >= 0.2) or (c >= 0.93 and o >= 0.6)))"""
_GROUPS = f"""with recursive {_PREP}, und as (select a, b from e union select b, a from e),
reach as (select article_id as id, article_id as other from p union select r.id, und.b from reach r join und on r.other = und.a),
roots as (select id as article_id, min(other) as root from reach group by 1),
g as (select root, count(*) as size, arg_max(article_id, row(body_len, summary_len, fetched_at, article_id)) as representative from roots join p using (article_id) group by 1)"""
SQL = {
    "dup_edges": f"with {_PREP} select * from e",
    "dup_representatives": f"""{_GROUPS}, r as (select root, string_agg(distinct reason, ',' order by reason) as reasons from e join roots on e.a = roots.article_id group by 1)
        select root, representative, size, reasons from g join r using (root) where size > 1""",
    "dedupe_stats": f"""{_GROUPS} select sum(size)::bigint as input_rows, count(*) as kept_rows, (sum(size) - count(*))::bigint as removed_rows,
        count(*) filter (size > 1) as duplicate_groups from g""",
    "cluster_sizes": f"with {_MEM} select run_id, cluster_id, count(distinct article_id) as articles, count(strength) as rated, round(sum(strength), 4) as strength_sum from mem group by all",
    "cluster_centroid": f"""with {_MEM}, {_VEC}, {_CEN} select run_id, cluster_id, size, len(centroid)::int as dim, round(centroid[1], 6) as c0, round(centroid[2], 6) as c1,
        round(centroid[3], 6) as c2, round(list_sum(centroid), 6) as total from cen""",
    "cluster_coherence": f"with {_MEM}, {_VEC}, {_CEN}, {_COS} select run_id, cluster_id, round(avg(greatest(0.0, least(1.0, cosine))), 4) as coherence, count(*) as size from cosines group by all",
    "cluster_exemplars": f"""with {_MEM}, {_VEC}, {_CEN}, {_COS}, r as (select run_id, cluster_id, article_id, embedding_id,
        row_number() over (partition by run_id, cluster_id order by round(cosine, 9) desc, strength desc nulls last, article_id, embedding_id)::int as rank from cosines)
        select * from r where rank <= 3""",
    "cluster_fingerprints": f"""with {_MEM} select run_id, cluster_id, sha256(string_agg(distinct article_id || ':' || embedding_id, ';' order by article_id || ':' || embedding_id)) as fingerprint
        from mem group by all""",
    "noise_rates": "with d as (select distinct * from cluster_memberships) select run_id, count(*) as members, round(avg(is_noise::double), 6) as noise_rate from d group by 1",
    "cluster_agreement": f"""with x as ({_LAB.format(s="-0")}), y as ({_LAB.format(s="-1")}), n as (select x.label as x, y.label as y, count(*)::double as n from x join y using (article_id) group by all),
        a as (select sum(n) as a from n group by x), b as (select sum(n) as b from n group by y),
        s as (select (select sum(n) from n) as n, (select sum(n * (n - 1) / 2) from n) as sij, (select sum(a * (a - 1) / 2) from a) as sa, (select sum(b * (b - 1) / 2) from b) as sb,
          (select sum(a * ln(a)) from a) as la, (select sum(b * ln(b)) from b) as lb, (select sum(n * ln(n)) from n) as lij),
        v as (select *, sa * sb / (n * (n - 1) / 2) as ex from s)
        select n::bigint as articles, round((sij - ex) / ((sa + sb) / 2 - ex), 4) as ari,
          round((ln(n) + (lij - la - lb) / n) / ((ln(n) - la / n + ln(n) - lb / n) / 2), 4) as nmi from v""",
    "cluster_survival": f"with {_SURV} select * from s",
    "survival_summary": f"""with {_SURV} select round(quantile_cont(survival, 0.5), 4) as median, round(quantile_cont(survival, 0.1), 4) as p10, round(quantile_cont(survival, 0.9), 4) as p90,
        count(*) as clusters from s""",
    "track_match_candidates": f"""with {_MEM}, {_VEC}, {_CEN} select x.cluster_id, y.cluster_id as track_id, round(greatest(0.0, 1 - list_dot_product(x.centroid, y.centroid)), 4) as distance
        from cen x join cen y on x.run_id like '%-1' and y.run_id like '%-0' where round(1 - list_dot_product(x.centroid, y.centroid), 4) <= 0.25""",
}
_NORM = lambda c: rf"trim(regexp_replace(lower(regexp_replace(coalesce({c}, ''), '[^\p{{L}}\p{{N}}]', ' ', 'g')), '\s+', ' ', 'g'))"
_W = C.DOMAIN_WEIGHTS[S.DOMAIN]
_vector = lambda a: "[" + ", ".join(f"coalesce({a}.{k}, 0.0) * {_W[k]}" for k in C.SIGNALS) + "]"
_COSTS = rf"""with {CLUSTER_SIGNALS}, {_VEC}, {_CEN},
  near as (select x.cluster_id, y.cluster_id as track_id, round(greatest(0.0, 1 - list_dot_product(x.centroid, y.centroid)), 4) as distance
    from cen x join cen y on x.run_id like '%-1' and y.run_id like '%-0' where round(1 - list_dot_product(x.centroid, y.centroid), 4) <= 0.25),
  met as (select cluster_id, track_id, distance, {_vector("x")} as v, {_vector("y")} as w, {_NORM("x.label")} as l, {_NORM("y.label")} as m
    from near join told x using (cluster_id) join told y on y.cluster_id = track_id where x.run_id like '%-1' and y.run_id like '%-0'),
  pen as (select *, case when list_dot_product(v, v) = 0 or list_dot_product(w, w) = 0 then 1.0
      else round(greatest(0.0, least(1.0, 1 - list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)))), 4) end as signal_distance,
    case when l = '' or m = '' then 1.0 when l = m then 0.0 when contains(l, m) or contains(m, l) then 0.25
      else round(1.0 - len(list_intersect(string_split(l, ' '), string_split(m, ' '))) / len(list_distinct(string_split(l, ' ') || string_split(m, ' ')))::double, 4) end as label_penalty from met),
  costs as (select cluster_id, track_id, distance, signal_distance, label_penalty,
    round({C.MATCH_WEIGHTS[0]} * distance + {C.MATCH_WEIGHTS[1]} * signal_distance + {C.MATCH_WEIGHTS[2]} * label_penalty, 4) as cost from pen)"""
SQL["pair_costs"] = _COSTS + " select * from costs"
SQL["certain_matches"] = _COSTS + """ select cluster_id, track_id, distance, cost from costs
  where cluster_id in (select cluster_id from costs group by 1 having count(*) = 1) and track_id in (select track_id from costs group by 1 having count(*) = 1)"""
SQL["cluster_signals"] = f"with {CLUSTER_SIGNALS} select run_id, cluster_id, member_count, {', '.join(C.SIGNALS)}, frame, label from told"
SQL["previous_observations"] = f"""with {_MEM}, sizes as (select run_id, cluster_id, count(distinct article_id) as member_count from mem group by all),
  times as (select run_id, max(created_at) as computed_at from cluster_memberships where run_id is not null group by 1),
  newest as (select run_id from times order by computed_at desc, run_id desc limit 1)
  select regexp_extract(run_id, '^(.*)-[^-]*$', 1) || ':' || cluster_id as track_id, run_id, cluster_id, member_count from sizes join times using (run_id)
  where run_id <> (select run_id from newest) qualify row_number() over (partition by track_id order by computed_at desc, run_id desc) = 1"""
_SCOPED = {
    "canonical_topic_id as topic, date_trunc('year', fetched_at at time zone 'UTC') as period": "0 as topic, 0 as period",
    " where canonical_topic_id is not null and fetched_at is not null": "",
    "summary_len, fetched_at, article_id)": "summary_len, coalesce(epoch_us(fetched_at), -9223372036854775807), article_id)",
}
for _name in ("dup_edges", "dup_representatives", "dedupe_stats"):
    SQL[f"{_name}_all"] = SQL[_name]
    for _old, _new in _SCOPED.items():
        SQL[f"{_name}_all"] = SQL[f"{_name}_all"].replace(_old, _new)
QUERIES = {
    f.__name__: f
    for f in (
        dup_edges, dup_representatives, dedupe_stats, dup_edges_all, dup_representatives_all, dedupe_stats_all, cluster_sizes, cluster_centroid, cluster_coherence, cluster_exemplars, cluster_fingerprints, noise_rates,
        cluster_agreement, cluster_survival, survival_summary, track_match_candidates, pair_costs, track_assignment, certain_matches, track_lifecycle, previous_observations, density_clusters, stability_report,
    )
}
