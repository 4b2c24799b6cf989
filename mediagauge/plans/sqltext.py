"""Pieces of SQL that several equivalents share."""

from __future__ import annotations

from mediagauge import config as C

TOPIC = "t_prices"
AS_OF = "2025-07-01 00:00:00"
DAYS = 30
DOMAIN = "commerce"


def case(column: str, table: dict[str, str], default: str) -> str:
    """A CASE that maps values of a column."""
    return f"case {column} " + " ".join(f"when '{a}' then '{b}'" for a, b in sorted(table.items())) + f" else {default} end"


_FIELDS = ["extracted_at", "run_id", "article_id", "outlet", "topic", "canonical_topic_id", "topic_relevance_score", *C.SIGNALS, "dominant_frame", *[f"seg_{s}" for s in C.SEGMENTS]]
_KEY = "replace(replace(lower(trim(dominant_frame)), '-', '_'), ' ', '_')"
SIG = f"""sig as (
  select *, case when dominant_frame is null or dominant_frame = '' then 'neutral' else {case(_KEY, C.FRAME_ALIASES, _KEY)} end as frame,
    lower(trim(outlet)) as outlet_lc
  from (select *, row_number() over (partition by signal_id order by {", ".join(f + " desc nulls last" for f in _FIELDS)}) as version
        from signals where signal_id is not null) where version = 1)"""
ARTICLE = """art as (
  select *, lower(trim(outlet)) as outlet_lc from (
    select article_id, outlet, country, language, topic, canonical_topic_id, fetched_at,
      row_number() over (partition by article_id order by fetched_at nulls last, outlet nulls first, country nulls first, language nulls first,
        topic nulls first, canonical_topic_id nulls first) as rn
    from articles where article_id is not null) where rn = 1)"""
LINKS = """links as (
  select article_id, topic, canonical_topic_id, max(case when isnan(topic_relevance_score) then null else topic_relevance_score end) as relevance,
    max(extracted_at) as matched_at
  from signals where article_id is not null group by 1, 2, 3)"""
TOPICAL = f"""topical as (
  select s.* from sig s where s.article_id in (select article_id from links where canonical_topic_id = '{TOPIC}' or topic = '{TOPIC}'))"""
NOW = f"cur as (select * from topical where extracted_at >= timestamptz '{AS_OF}+00' - interval {DAYS} day)"
_VALUE = "case when {k} is null or isnan({k}) then 0.0 else {k} end"


def segments(source: str, keys: str = "", name: str = "seg") -> str:
    """A CTE with one row per signal and positively weighted segment."""
    lead = keys + ", " if keys else ""
    values = ", ".join(_VALUE.format(k=k) + f" as {k}" for k in C.SIGNALS)
    parts = [f"select {lead}article_id, {values}, frame, '{s}' as segment, seg_{s} as weight from {source} where seg_{s} > 0 and not isnan(seg_{s})" for s in C.SEGMENTS]
    return f"{name} as ({' union all '.join(parts)})"


def profile(keys: str = "", seg: str = "seg", name: str = "prof") -> str:
    """CTEs with the weighted profile per keys and segment."""
    k = (keys + ", " if keys else "") + "segment"
    means = ", ".join(f"round(sum({s} * weight) / sum(weight), 4) as {s}" for s in C.SIGNALS)
    on = " and ".join(f"v.{x.strip()} = f.{x.strip()}" for x in k.split(","))
    return f"""{name}_v as (select {k}, {means}, count(*) as article_count from {seg} group by all),
{name}_w as (select {k}, frame, round(sum(weight), 9) as w from {seg} group by all),
{name}_f as (select {k}, arg_min(frame, row(-w, frame)) as dominant_frame from {name}_w group by all),
{name} as (select v.*, f.dominant_frame from {name}_v v join {name}_f f on {on})"""


DIM = "dim as (select * from (values " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(C.SEGMENTS)) + ") t(pos, segment))"
FULL = "full_prof as (select d.segment, " + ", ".join(f"coalesce(p.{k}, 0.0) as {k}" for k in C.SIGNALS) + ", coalesce(p.article_count, 0) as article_count, coalesce(p.dominant_frame, 'neutral') as dominant_frame from dim d left join prof p using (segment))"
PRIORS = "base as (select * from (values " + ", ".join(f"('{s}', {a}::double, {b}::double, {c}::double, '{f}')" for s, (a, b, c, f) in C.SEED_PRIORS.items()) + ") t(segment, b_concern_level, b_purchase_intent, b_avoidance_signals, baseline_frame))"


def magnitude(prefix: str = "") -> str:
    """Weighted sum of absolute deltas of the domain."""
    return "round(" + " + ".join(f"{C.DOMAIN_WEIGHTS[DOMAIN][k]} * abs(round({prefix}{k} - b_{k}, 4))" for k in C.SIGNALS) + ", 4)"
