"""Lines repeated across the documents of one source.

Lines are parsed into templates with token trees of fixed depth: below a source come the number
of tokens and an edge token (the first one, in a second tree the last one), and below such a node
a table of the tokens at each position. Trees of different tasks are merged by adding up their
counts, level by level, so a node that covers too few documents is dropped before anything below
it is counted; nothing under it can cover more. A token that is frequent at its position is part
of the template, any other one falls into a wildcard slot; a run of digits always does. A leaf is
the exact comparison form of a line.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediagauge.llm.vectors import maybe_broadcast
from mediagauge.operators.outlets import with_standard_outlet
from mediagauge.session import materialize

#: The mark that stands for a run of digits.
SLOT = "\x00"
#: The mark of a wildcard slot in a template.
ANY = "*"
#: Lines whose numbers a task remembers before it starts anew.
MEMO_LIMIT = 200_000
LEAST_DOCUMENTS = 4
LEAST_SHARE_PERCENT = 5

_DIGITS = re.compile(r"[0-9]+")


def line_keys(body: str) -> list[str]:
    """The comparison form of every line of a body; a blank line gives an empty string.

    Lines end at LF. NFC, trimmed, white space runs to one space, lower case, runs of 0-9 to one mark.
    """
    text = body if body.isascii() else unicodedata.normalize("NFC", body)
    return [_DIGITS.sub(SLOT, " ".join(line.split()).lower()) for line in text.split("\n")]


def _number(text: str) -> int:
    return (xxhash.xxh3_64_intdigest(text) - (1 << 63)) or 1


def line_numbers(key: str) -> tuple[int, int, int]:
    """Numbers of a line's leaf and of its nodes in the two trees; all 0 for a blank line."""
    if not key:
        return 0, 0, 0
    count = key.count(" ") + 1
    return _number(key), _number(f"{count}<{key.split(' ', 1)[0]}"), _number(f"{count}>{key.rsplit(' ', 1)[-1]}")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    memo: dict[str, tuple[int, int, int]] = {}
    for pdf in batches:
        if len(memo) > MEMO_LIMIT:
            memo.clear()
        out: list[np.ndarray] = []
        for body in pdf["body"]:
            rows = []
            for key in line_keys(body) if isinstance(body, str) else ():
                found = memo.get(key)
                if found is None:
                    found = memo[key] = line_numbers(key)
                rows.append(found)
            out.append(np.array(rows, dtype=np.int64).reshape(-1, 3))
        columns = {name: [np.ascontiguousarray(a[:, k]) for a in out] for k, name in enumerate(("leaves", "heads", "tails"))}
        yield pd.DataFrame({"article_id": pdf["article_id"], "std_outlet": pdf["std_outlet"], **columns})


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for article, outlet, body in zip(pdf["article_id"], pdf["std_outlet"], pdf["body"], strict=True):
            for at, key in enumerate(line_keys(body) if isinstance(body, str) else (), 1):
                if key:
                    _, head, tail = line_numbers(key)
                    rows += [(article, outlet, at, head, key), (article, outlet, at, tail, key)]
        yield pd.DataFrame(rows, columns=["article_id", "std_outlet", "line_no", "node", "key"])


def _named_bodies(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    slim = articles.select("article_id", "outlet", F.nullif("body", F.lit("")).alias("body")).where("article_id is not null")
    return with_standard_outlet(slim, feeds.select("outlet", "outlet_name", "host")).select("article_id", "std_outlet", "body")


def parsed_bodies(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """``article_id, std_outlet, leaves, heads, tails``: one row per article, the numbers of its lines in order.

    Repeated deliveries count once; if they differ the larger outlet and then the larger list
    counts. A null or empty body has no lines. Rows without article_id or whose outlet no feed
    accepts are left out.
    """
    named = _named_bodies(articles, feeds).where("std_outlet is not null")
    parsed = named.mapInPandas(_parse, "article_id string, std_outlet string, leaves array<bigint>, heads array<bigint>, tails array<bigint>")
    one = parsed.groupBy("article_id").agg(F.max(F.struct("std_outlet", "leaves", "heads", "tails")).alias("r"))
    return materialize(one.select("article_id", "r.*"), "parsed-bodies")


def _totals(bodies: DataFrame) -> DataFrame:
    return bodies.groupBy("std_outlet").agg(F.count("*").alias("total"))


def _covering(counts: DataFrame, totals: DataFrame, least: int, percent: int, n: str = "documents") -> DataFrame:
    """Rows of ``counts`` whose ``n`` reaches ``least`` and ``percent`` % of the outlet's articles."""
    many = counts.where(F.col(n) >= least).join(totals, "std_outlet")
    return many.where(F.col(n) * 100 >= F.col("total") * percent)


def covering_nodes(bodies: DataFrame, trees: list[str], least: int = LEAST_DOCUMENTS, percent: int = LEAST_SHARE_PERCENT) -> DataFrame:
    """``std_outlet, node`` of the merged trees that enough articles of the outlet reach."""
    reached = F.array_distinct(F.concat(*trees)) if len(trees) > 1 else F.array_distinct(trees[0])
    seen = bodies.select("std_outlet", F.explode(reached).alias("node")).where("node <> 0")
    counts = seen.groupBy("std_outlet", "node").agg(F.count("*").alias("documents"))
    return materialize(_covering(counts, _totals(bodies), least, percent).select("std_outlet", "node"), "line-nodes")


def _lines_under(bodies: DataFrame, nodes: DataFrame) -> DataFrame:
    """``article_id, std_outlet, leaf, pos``: the lines whose node in the first tree is among ``nodes``."""
    zipped = F.posexplode(F.arrays_zip("leaves", "heads")).alias("pos", "line")
    lines = bodies.select("article_id", "std_outlet", zipped).select("article_id", "std_outlet", "pos", F.col("line.leaves").alias("leaf"), F.col("line.heads").alias("node"))
    return lines.where("leaf <> 0").join(maybe_broadcast(nodes), ["std_outlet", "node"], "left_semi")


def repeated_lines(articles: DataFrame, feeds: DataFrame, least: int = LEAST_DOCUMENTS, percent: int = LEAST_SHARE_PERCENT) -> DataFrame:
    """``article_id, line_no``: non-blank lines whose leaf covers many articles of the same standard outlet."""
    bodies = parsed_bodies(articles, feeds)
    lines = materialize(_lines_under(bodies, covering_nodes(bodies, ["heads"], least, percent)), "lines-under-nodes")
    leaves = lines.groupBy("std_outlet", "leaf").agg(F.count_distinct("article_id").alias("documents"))
    frequent = materialize(_covering(leaves, _totals(bodies), least, percent).select("std_outlet", "leaf"), "frequent-leaves")
    hit = lines.join(maybe_broadcast(frequent), ["std_outlet", "leaf"], "left_semi")
    return hit.select("article_id", (F.col("pos") + 1).cast("bigint").alias("line_no"))


def _constants(tokens: Column, fixed: str) -> Column:
    """Tokens of a line, those that are not frequent at their position replaced by the wildcard."""
    return F.transform(tokens, lambda t, i: F.when(F.array_contains(F.col(fixed), F.struct(i.alias("pos"), t.alias("token"))), t).otherwise(F.lit(ANY)))


def templated_lines(articles: DataFrame, feeds: DataFrame, least: int = LEAST_DOCUMENTS, percent: int = LEAST_SHARE_PERCENT) -> tuple[DataFrame, DataFrame]:
    """Frequent templates (``std_outlet, template, slots, documents, total, example``) and their lines (``article_id, line_no``).

    A template is frequent if its lines occur in ``least`` articles and ``percent`` % of the
    outlet's; at least half of its tokens, and one that is no number, must be fixed, or all of them. A
    line whose form alone is frequent is a template without a slot (digits apart). Of repeated deliveries that
    differ the one counts that ``parsed_bodies`` takes.
    """
    bodies = parsed_bodies(articles, feeds)
    totals = _totals(bodies)
    nodes = covering_nodes(bodies, ["heads", "tails"], least, percent)
    texts = _named_bodies(articles, feeds).where("std_outlet is not null").mapInPandas(_texts, "article_id string, std_outlet string, line_no bigint, node bigint, key string")
    near = texts.join(maybe_broadcast(nodes), ["std_outlet", "node"], "left_semi")
    leaf_of = F.posexplode(F.arrays_zip("leaves", "heads", "tails")).alias("pos", "line")
    chosen = bodies.select("article_id", "std_outlet", leaf_of).where("line.leaves <> 0")
    chosen = chosen.select("article_id", "std_outlet", (F.col("pos") + 1).cast("bigint").alias("line_no"), F.explode(F.array("line.heads", "line.tails")).alias("node"))
    chosen = chosen.join(maybe_broadcast(nodes), ["std_outlet", "node"], "left_semi")
    lines = near.distinct().join(chosen, ["article_id", "std_outlet", "line_no", "node"], "left_semi")
    # Deliveries that differ in a line may leave two forms of it; one is enough.
    lines = lines.groupBy("article_id", "std_outlet", "line_no", "node").agg(F.max("key").alias("key"))
    lines = materialize(lines.withColumn("tokens", F.split("key", " ")), "lines-under-nodes")
    tokens = lines.select("std_outlet", "node", F.posexplode("tokens").alias("pos", "token"))
    counts = tokens.groupBy("std_outlet", "node", "pos", "token").agg(F.count("*").alias("documents"))
    fixed = _covering(counts, totals, least, percent).groupBy("std_outlet", "node").agg(F.collect_set(F.struct("pos", "token")).alias("fixed"))
    fixed = materialize(fixed, "fixed-tokens")
    shaped = lines.join(maybe_broadcast(fixed), ["std_outlet", "node"]).withColumn("parts", _constants(F.col("tokens"), "fixed"))
    slots = F.size(F.filter("parts", lambda t: t == ANY))
    shaped = shaped.select("article_id", "std_outlet", "line_no", "key", F.array_join("parts", " ").alias("template"), slots.alias("slots"), F.size("parts").alias("size"))
    worded = F.regexp_replace("template", "[\\x00* ]", "") != ""
    shaped = materialize(shaped.where((F.col("slots") == 0) | ((F.col("slots") * 2 <= F.col("size")) & worded)), "shaped-lines")
    seen = shaped.groupBy("std_outlet", "template", "slots").agg(F.count_distinct("article_id").alias("documents"), F.min("key").alias("example"))
    templates = materialize(_covering(seen, totals, least, percent), "line-templates")
    hit = shaped.join(maybe_broadcast(templates.select("std_outlet", "template")), ["std_outlet", "template"], "left_semi")
    return templates, hit.select("article_id", "line_no").distinct()


def cleaned_bodies(articles: DataFrame, feeds: DataFrame, least: int = LEAST_DOCUMENTS, percent: int = LEAST_SHARE_PERCENT) -> DataFrame:
    """``article_id, body, removed``: every article's body without the lines of frequent templates; a null body stays null.

    Of repeated deliveries that differ the same one counts as for the templates.
    """
    _, lines = templated_lines(articles, feeds, least, percent)
    gone = lines.groupBy("article_id").agg(F.collect_list("line_no").alias("nos"))
    slim = articles.select("article_id", "outlet", "body").where("article_id is not null")
    named = with_standard_outlet(slim, feeds.select("outlet", "outlet_name", "host"))
    keyed = named.select("article_id", "std_outlet", "body", F.nullif("body", F.lit("")).alias("text"))
    keyed = keyed.mapInPandas(_numbered, "article_id string, std_outlet string, leaves array<bigint>, body string")
    one = keyed.groupBy("article_id").agg(F.max(F.struct("std_outlet", "leaves", "body")).alias("r")).select("article_id", "r.body")
    joined = one.join(gone, "article_id", "left").withColumn("nos", F.coalesce("nos", F.array().cast("array<bigint>")))
    kept = F.filter(F.split("body", "\n", -1), lambda x, i: ~F.array_contains(F.col("nos"), (i + 1).cast("bigint")))
    return joined.select("article_id", F.array_join(kept, "\n").alias("body"), F.size("nos").cast("bigint").alias("removed"))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        leaves = next(_parse(iter([pdf[["article_id", "std_outlet"]].assign(body=pdf["text"])])))["leaves"]
        yield pd.DataFrame({"article_id": pdf["article_id"], "std_outlet": pdf["std_outlet"], "leaves": leaves, "body": pdf["body"]})


def line_templates(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """``std_outlet, template, slots, example, documents, total``: the frequent templates of each outlet; # stands for digits."""
    templates, _ = templated_lines(articles, feeds)
    shown = [F.translate(c, SLOT, "#").alias(c) for c in ("template", "example")]
    return templates.select("std_outlet", shown[0], F.col("slots").cast("bigint").alias("slots"), shown[1], "documents", "total")
