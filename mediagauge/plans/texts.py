"""Queries on text functions, latest-row joins and topic resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediagauge import config as C
from mediagauge.functions import text as T
from mediagauge.operators import latest
from mediagauge.operators.views import article_view, in_topic, latest_per_key, signal_view, topic_links
from mediagauge.plans import sqltext as S
from mediagauge.tables import table


def _articles(spark: SparkSession, root: str, *columns: str) -> DataFrame:
    return article_view(table(spark, root, "articles"), columns)


def title_keys(spark: SparkSession, root: str) -> DataFrame:
    """Collapsed title, title key, number of telling words and hash of every article."""
    words = T.token_set(F.col("title"), C.TITLE_STOPWORDS)
    return _articles(spark, root, "title").select(
        "article_id", T.collapse_space(F.col("title")).alias("title"), T.title_key(F.col("title")).alias("title_key"), F.size(words).alias("n_words"), F.sha2("title", 256).alias("title_sha")
    )


def embedding_texts(spark: SparkSession, root: str) -> DataFrame:
    """The text that would be embedded for every article, as its hash and length."""
    text = T.embedding_text(F.col("title"), F.col("body"), F.col("summary"), C.BOILERPLATE)
    return _articles(spark, root, "title", "body", "summary").select("article_id", text.alias("embedding_text"))


def summary_excerpts(spark: SparkSession, root: str) -> DataFrame:
    """Summaries clipped to 120 characters at a word."""
    return _articles(spark, root, "summary").select("article_id", T.clip_words(F.col("summary"), 120).alias("excerpt"))


def canonical_urls(spark: SparkSession, root: str) -> DataFrame:
    """Normalised URL of every article."""
    return _articles(spark, root, "url").select("article_id", T.normalize_url(F.col("url")).alias("url_key"))


def frames(spark: SparkSession, root: str) -> DataFrame:
    """Signals per canonical frame and finer frame."""
    rows = signal_view(table(spark, root, "signals"))
    details = C.FRAME_DETAIL_ALIASES
    detail = T.canonical_frame(F.col("dominant_frame"), details)
    known = F.when(detail.isin(*C.FRAME_DETAILS), detail).otherwise("neutral")
    return rows.groupBy("frame", known.alias("frame_detail")).agg(F.count("*").alias("n"))


def topic_resolution(spark: SparkSession, root: str) -> DataFrame:
    """Canonical topic of every raw topic and language of the articles."""
    return latest.resolve_topics(_articles(spark, root).select("topic", "language"), latest.alias_table(spark))


def latest_complete_embedding(spark: SparkSession, root: str) -> DataFrame:
    """Newest complete embedding of every article."""
    return latest.latest_embedding(table(spark, root, "article_embeddings"), True).select("article_id", "embedding_id", "model_version")


def latest_any_embedding(spark: SparkSession, root: str) -> DataFrame:
    """Newest embedding of every article, whatever its status, null where there is none."""
    newest = latest.latest_embedding(table(spark, root, "article_embeddings"), False).select("article_id", "embedding_id", "status")
    return _articles(spark, root).select("article_id").join(newest, "article_id", "left")


def same_model_embeddings(spark: SparkSession, root: str) -> DataFrame:
    """Distinct embedding ids per article in the model of its newest row."""
    rows = latest.same_model_rows(table(spark, root, "article_embeddings"))
    return rows.groupBy("article_id").agg(F.countDistinct("embedding_id").alias("n"))


def embedding_work(spark: SparkSession, root: str) -> DataFrame:
    """Articles by what the embedding stage has to do."""
    work = latest.embedding_work(_articles(spark, root).select("article_id"), table(spark, root, "article_embeddings"))
    return work.groupBy("work").agg(F.count("*").alias("articles"))


def pending_articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles without a signal."""
    return latest.pending_articles(table(spark, root, "articles"), table(spark, root, "signals"))


def latest_topic_link(spark: SparkSession, root: str) -> DataFrame:
    """Newest topic link of every article, with the strongest relevance."""
    links = topic_links(table(spark, root, "signals"))
    best = links.groupBy("article_id").agg(F.max("relevance").alias("best_relevance"))
    newest = latest_per_key(links, "article_id", F.col("matched_at").desc_nulls_last(), F.col("topic").asc_nulls_last(), F.col("canonical_topic_id").asc_nulls_last())
    return newest.select("article_id", "topic").join(best, "article_id")


def topic_articles(spark: SparkSession, root: str) -> DataFrame:
    """Articles of a topic by their links."""
    return in_topic(_articles(spark, root).select("article_id", "outlet_lc"), topic_links(table(spark, root, "signals")), S.TOPIC)


def relevant_links(spark: SparkSession, root: str) -> DataFrame:
    """Best relevance of every article over its topic terms, above the threshold."""
    links = topic_links(table(spark, root, "signals"))
    best = links.groupBy("article_id").agg(F.max("relevance").alias("relevance"), F.count("*").alias("links"))
    return best.where(F.col("relevance") >= C.RELEVANCE_THRESHOLD)


def language_scopes(spark: SparkSession, root: str) -> DataFrame:
    """Articles whose scope equals that of a membership run's most frequent scopes, nulls matching nulls."""
    articles = _articles(spark, root).select("article_id", "country", F.lower("language").alias("language"))
    scopes = articles.groupBy("country", "language").agg(F.count("*").alias("articles")).where("articles >= 4")
    joined = latest.null_safe_scope(articles, scopes, ["country", "language"])
    return joined.groupBy("a.country", "a.language").agg(F.count("*").alias("matched"), F.max("b.articles").alias("articles"))


_DEDUP = """one as (select * from (select *, row_number() over (partition by article_id order by fetched_at nulls last, outlet nulls first, country nulls first,
    language nulls first, topic nulls first, canonical_topic_id nulls first, {extra}) as rn from articles where article_id is not null) where rn = 1)"""
_one = lambda *cols: _DEDUP.format(extra=", ".join(c + " nulls first" for c in cols))
_WS = r"[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_collapse = lambda c: f"trim(regexp_replace({c}, '{_WS}', ' ', 'g'))"
_words = lambda c: rf"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}\p{{M}}_]+')"
_PLAIN = "lower(strip_accents(trim(topic)))"
_KEYED = r"trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(trim(topic))), '[_-]+', ' ', 'g'), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
_SEEDS, _pos = [], 0
for _seed in C.TOPIC_SEEDS:
    _t = _seed["topic"]
    _SEEDS.append(f"('{_t}', '{_t}', null, {_pos})")
    for _l in C.SEED_LANGUAGES:
        for _name in _seed[_l]:
            _pos += 1
            _SEEDS.append(f"(lower(strip_accents('{_name}')), '{_t}', '{_l}', {_pos})")
_DOMAIN = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(trim(topic)), '{w}')" for w in words) + f" then '{d}'" for d, words in C.DOMAIN_KEYWORDS.items()
) + f" else '{C.DEFAULT_DOMAIN}' end"
_DETAIL = S.case(S._KEY, C.FRAME_DETAIL_ALIASES, "'neutral'")
SQL = {
    "title_keys": f"""with {_one("title")}, w as (select article_id, title, {_words("title")} as words from one)
        select article_id, {_collapse("title")} as title, case when length(array_to_string(words, ' ')) >= 12 and len(words) >= 2 then array_to_string(words, ' ') end as title_key,
          len(list_filter(list_distinct(coalesce(words, [])), lambda x: length(x) > 1 and not regexp_full_match(x, '[0-9]+') and x not in ({", ".join(f"'{w}'" for w in C.TITLE_STOPWORDS)}))) as n_words,
          sha256(title) as title_sha from w""",
    "canonical_urls": rf"""with {_one("url")}, p as (select article_id, regexp_extract(url, '^https?://([^/?#]+)([^?#]*)(\?[^#]*)?', ['h', 'p', 'q']) as u from one)
        select article_id, case when u.h <> '' then lower(u.h) || regexp_replace(u.p, '/+$', '') || u.q end as url_key from p""",
    "frames": f"""with {S.SIG} select frame, case when dominant_frame is null or dominant_frame = '' then 'neutral' else {_DETAIL} end as frame_detail, count(*) as n from sig group by 1, 2""",
    "topic_resolution": rf"""with {S.ARTICLE}, seeds(alias_key, canonical_topic_id, alias_language, pos) as (values {", ".join(_SEEDS)}),
        r as (select distinct topic, language, {_KEYED} as alias_key from art where topic is not null),
        b as (select * from r left join seeds using (alias_key) qualify row_number() over (partition by topic, language
          order by case when alias_language = lower(language) then 0 when alias_language is null then 1 else 2 end, pos) = 1),
        s as (select *, regexp_replace(regexp_replace(alias_key, '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') as slug, {_collapse("replace(trim(topic), '-', ' ')")} as shown from b)
        select topic, language, coalesce(canonical_topic_id, case when slug = '' then 'topic' else slug end) as canonical,
          case when shown = '' then 'Topic' else upper(shown[1:1]) || shown[2:] end as display, {_DOMAIN} as domain, canonical_topic_id is not null as known from s""",
    "latest_complete_embedding": """select article_id, embedding_id, model_version from article_embeddings where status = 'complete' and article_id is not null
        qualify row_number() over (partition by article_id order by embedded_at desc nulls last, embedding_id desc) = 1""",
    "latest_any_embedding": """with e as (select article_id, embedding_id, status from article_embeddings where article_id is not null
        qualify row_number() over (partition by article_id order by embedded_at desc nulls last, embedding_id desc) = 1)
        select article_id, embedding_id, status from (select distinct article_id from articles where article_id is not null) left join e using (article_id)""",
    "same_model_embeddings": """with e as (select *, first_value(model_version) over (partition by article_id order by embedded_at desc nulls last, embedding_id desc) as newest
        from article_embeddings where article_id is not null)
        select article_id, count(distinct embedding_id) as n from e where model_version = newest group by 1""",
    "embedding_work": """with e as (select article_id, status, model_version from article_embeddings where article_id is not null
        qualify row_number() over (partition by article_id order by embedded_at desc nulls last, embedding_id desc) = 1)
        select case when status is null then 'missing' when status = 'complete' and model_version = 'v2.1' then 'current' when model_version = 'v2.1' then 'retry_failed' else 'stale' end as work,
          count(*) as articles from (select distinct article_id from articles where article_id is not null) left join e using (article_id) group by 1""",
    "pending_articles": "select distinct article_id from articles where article_id is not null and article_id not in (select article_id from signals where article_id is not null)",
    "latest_topic_link": f"""with {S.LINKS} select article_id, topic, max(relevance) over (partition by article_id) as best_relevance from links
        qualify row_number() over (partition by article_id order by matched_at desc nulls last, topic nulls last, canonical_topic_id nulls last) = 1""",
    "topic_articles": f"""with {S.ARTICLE}, {S.LINKS} select article_id, outlet_lc from art
        where article_id in (select article_id from links where canonical_topic_id = '{S.TOPIC}' or topic = '{S.TOPIC}')""",
    "relevant_links": f"with {S.LINKS} select article_id, max(relevance) as relevance, count(*) as links from links group by 1 having max(relevance) >= {C.RELEVANCE_THRESHOLD}",
    "language_scopes": f"with {S.ARTICLE} select country, lower(language) as language, count(*) as matched, count(*) as articles from art group by 1, 2 having count(*) >= 4",
    "summary_excerpts": f"""with {_one("summary")}, c as (select article_id, {_collapse("summary")} as t from one)
        select article_id, case when length(t) <= 120 then t else rtrim(regexp_replace(t[1:120], ' [^ ]*$', '')) || '...' end as excerpt from c""",
    "embedding_texts": rf"""with {_one("title", "body", "summary")}, c as (select article_id, {_collapse("coalesce(title, '')")} as head,
          case when {_collapse("coalesce(body, '')")} <> '' then {_collapse("coalesce(body, '')")} else {_collapse("coalesce(summary, '')")} end as lead from one),
        s as (select article_id, head, list_filter(string_split(regexp_replace(lead, '([.!?]) ', '\1' || chr(1), 'g'), chr(1)), lambda x: length(x) >= 20
          and not regexp_matches(lower(x), '{"|".join(C.BOILERPLATE)}'))[1:2] as told from c),
        t as (select article_id, trim(concat_ws(' - ', nullif(head, ''), case when len(told) > 0 then array_to_string(told, ' ') end)) as x from s)
        select article_id, case when length(x) >= 10 then x end as embedding_text from t""",
}
QUERIES = {
    f.__name__: f
    for f in (
        title_keys, embedding_texts, summary_excerpts, canonical_urls, frames, topic_resolution, latest_complete_embedding, latest_any_embedding,
        same_model_embeddings, embedding_work, pending_articles, latest_topic_link, topic_articles, relevant_links, language_scopes,
    )
}
