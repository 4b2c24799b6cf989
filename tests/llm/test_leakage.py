"""FM-index and leaked passages against plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from mediagauge.llm import leakage
from mediagauge.llm.leakage import FmIndex, leaked_pairs, leaked_spans, words_of


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    for sigma, n in ((1, 50), (3, 400), (40, 900)):
        text = rng.integers(0, sigma + 1, n)
        index = FmIndex(text, sigma)
        for length in (1, 2, 4):
            rows = np.array([text[i : i + length] for i in rng.integers(0, n - length, 60) if (text[i : i + length] > 0).all()] + [[sigma] * length])
            lo, hi = index.search(rows)
            for k, row in enumerate(rows):
                places = [i for i in range(n - length + 1) if (text[i : i + length] == row).all()]
                assert sorted(index.locate(np.arange(lo[k], hi[k]))) == places


def test_words():
    assert words_of("Žluť-oučký kůň_2 ﬁ ① А") == ["zlut", "oucky", "kun", "2", "fi", "1", "а"]
    assert words_of(None) == words_of(" ?! ") == []


@pytest.mark.parametrize("block", [20_000, 7])
def test_pairs_and_spans(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_ITEMS", block)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, "set", "en", " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 40)))) for i in range(30)]
    items += [(98, "set", "en", items[0][3]), (99, "set", "en", None), (97, "set", "en", ""), (None, "set", "en", items[0][3])]
    docs = []
    for d in range(120):
        words = [rng.choice(vocabulary + ["other", "thing"]) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            source = rng.choice(items[:30])[3].split()
            begin, size = rng.randrange(max(1, len(source) - 11)), rng.choice([11, 12, 20])
            words[5:5] = [w.upper() + rng.choice(["", ",", " - "]) for w in source[begin : begin + size]]
        docs.append((d, " ".join(words)))
    docs += [(d + 1000, t) for d, t in docs[:20]] + [(500, None), (501, ""), (None, docs[0][1]), (502, "x " * 100_000)]

    def grams(text):
        w = words_of(text)
        return {tuple(w[i : i + 12]): None for i in range(len(w) - 11)}

    owners = {}
    for i, _, _, t in items:
        if i is not None:
            for g in grams(t):
                owners.setdefault(g, set()).add(i)
    expected = {(d, i) for d, t in docs if d is not None for g in grams(t) for i in owners.get(g, ())}
    assert expected
    d = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(*r, 1) for r in items], "item_id long, item_set string, lang string, text string, doc_id int")
    for shard in (1_000_000, 40):
        assert {(r[0], r[1]) for r in leaked_pairs(d, e, shard_words=shard).collect()} == expected
    spans = leaked_spans(d, e).collect()
    by_document = {}
    for s in sorted(spans, key=lambda s: (s["doc_id"], s["first_word"])):
        assert by_document.get(s["doc_id"], -1) < s["first_word"]
        by_document[s["doc_id"]] = s["end_word"]
    assert {(s["doc_id"], i) for s in spans for i in s["items"]} == expected
    texts = dict(docs)
    for s in spans:
        assert s["end_word"] - s["first_word"] >= 12
        assert tuple(words_of(texts[s["doc_id"]])[s["first_word"] : s["first_word"] + 12]) in owners
    assert leaked_pairs(d.limit(0), e).count() == 0 and leaked_pairs(d, e.limit(0)).count() == 0
