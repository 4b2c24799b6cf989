"""Encoding against the public tokenizer, round trips, streaming decoding."""

from __future__ import annotations

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mediagauge.llm.tokens import VOCABULARY, Utf8Stream, decode_stream, encoded, encoder, round_trips, token_counts

pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary file")


@pytest.fixture(scope="module")
def public():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet=" \n\t'sdtrevlm0123aeěšč漢🙂<|endoftext|>.,", max_size=80)))
def test_equals_public_tokenizer(public, text):
    ids = encoder()(text)
    assert ids == public(text)
    assert "".join(decode_stream(ids)) == text


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 2000, " " * 999, "<|endoftext|>" * 3, "\u0000�", "🙂" * 200, "supercalifragilisticexpialidocious" * 20])
def test_long_pieces(public, text):
    assert encoder()(text) == public(text)


def test_table(spark):
    rows = [(1, None, "s", None), (2, "", "s", 0), (3, "Ahoj světe", None, 10), (3, "Ahoj světe", "t", 10), (4, "x" * 50_000, "t", 50_000)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, source string, n_chars long, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encoded(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got) == 5
    assert all(r["same"] for r in round_trips(df).collect())
    counts = {r["source"]: r for r in token_counts(df).collect()}
    assert counts["s"]["tokens"] == 0 and counts["s"]["chars_per_token"] is None and counts[None]["tokens"] == len(got[2][1])
    assert encoded(df.limit(0)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=24), st.integers(1, 5))
def test_utf8_machine(raw, step):
    machine = Utf8Stream()
    out = "".join(machine.feed(raw[i : i + step]) for i in range(0, len(raw), step)) + machine.close()
    assert out == raw.decode("utf-8", "replace")
