"""Evaluation texts that leak into training text.

Every task indexes its documents shard by shard: an FM-index over word numbers, with ranks from
a wavelet matrix. A shard is indexed once; the phrases of the evaluation items, broadcast in
blocks, are searched backwards in it block by block, their places found through sampled suffix
positions, and overlapping places of all blocks merged into spans. Words that no item contains
are one separator in the index, since no phrase reaches across them.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Consecutive words that make a leak.
PHRASE_WORDS = 12
#: Words of a shard after which it is indexed and searched.
SHARD_WORDS = 1_000_000
#: One suffix position in so many is stored.
SAMPLE_STEP = 8
#: Items whose phrases are one broadcast; more are searched in several blocks.
BLOCK_ITEMS = 20_000

_MARKS = regex.compile(r"\p{M}+")
_WORDS = regex.compile(r"[\p{L}\p{N}]+")


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits after NFKD, removal of combining marks and lower-casing."""
    if not text:
        return []
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORDS.findall(text.lower())


class FmIndex:
    """Full-text index of a sequence of symbols 1..sigma (0 separates), searched backwards."""

    def __init__(self, text: np.ndarray, sigma: int, step: int = SAMPLE_STEP):
        text = np.concatenate([text.astype(np.int64) + 1, [0]])  # 0 is now the end, 1 the separator
        n = len(text)
        suffix = _suffix_array(text)
        bwt = text[suffix - 1]
        counts = np.bincount(text, minlength=sigma + 2)
        self.less = np.concatenate([[0], np.cumsum(counts)])
        self.levels = max(1, int(sigma + 1).bit_length())
        self.ones, self.zeros = [], []
        seq = bwt
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]))
            self.zeros.append(n - int(bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])
        symbols = np.arange(sigma + 2)
        self.first = self._descend(symbols, np.zeros(len(symbols), dtype=np.int64))
        self.bwt = bwt
        self.sampled = suffix % step == 0
        self.places = np.where(self.sampled, suffix, -1)
        self.size = n

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            one = ((symbols >> level) & 1).astype(bool)
            ones = self.ones[k][at]
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before each place."""
        return self._descend(symbols, at) - self.first[symbols]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [lo, hi) of each phrase (rows of symbols 1..sigma)."""
        count, length = phrases.shape
        lo, hi = np.zeros(count, dtype=np.int64), np.full(count, self.size, dtype=np.int64)
        live = np.arange(count)
        for k in range(length - 1, -1, -1):
            c = phrases[live, k].astype(np.int64) + 1
            lo[live] = self.less[c] + self.rank(c, lo[live])
            hi[live] = self.less[c] + self.rank(c, hi[live])
            live = live[lo[live] < hi[live]]
            if not len(live):
                break
        hi = np.maximum(hi, lo)
        dead = np.ones(count, dtype=bool)
        dead[live] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Place in the text of each suffix row, by stepping back to the nearest stored one."""
        at, place = rows.copy(), np.full(len(rows), -1, dtype=np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            here = at[todo]
            done = self.sampled[here]
            place[todo[done]] = self.places[here[done]] + steps
            todo, here = todo[~done], here[~done]
            c = self.bwt[here]
            at[todo] = self.less[c] + self.rank(c, here)
            steps += 1
        return place


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; the text ends with a unique smallest symbol."""
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    n, k = len(text), 1
    while True:
        follow = np.zeros(n, dtype=np.int64)
        if k < n:
            follow[:-k] = rank[k:] + 1
        key = rank * (n + 2) + follow
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if fresh[-1] == n - 1 or k >= n:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        k *= 2


@dataclass
class Phrases:
    """rows: distinct phrases as symbols (places of their words in the vocabulary, from 1); items: item_ids of phrase k are ids[starts[k]:starts[k + 1]]."""

    rows: np.ndarray
    ids: np.ndarray
    starts: np.ndarray


def word_numbers(text: str | None) -> list[int]:
    """64-bit numbers of a text's words."""
    return [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in words_of(text)]


def compile_phrases(items: list[tuple[int, str | None]], vocabulary: np.ndarray, length: int = PHRASE_WORDS) -> Phrases:
    """All runs of ``length`` words of the items; shorter items, null and empty ones have none."""
    where: dict[tuple[int, ...], set[int]] = defaultdict(set)
    for item, text in items:
        symbols = (np.searchsorted(vocabulary, np.array(word_numbers(text), dtype=np.int64)) + 1).tolist()
        for k in range(len(symbols) - length + 1):
            where[tuple(symbols[k : k + length])].add(item)
    rows = np.array(list(where), dtype=np.int32).reshape(-1, length)
    lists = [sorted(s) for s in where.values()]
    return Phrases(rows, np.array([i for x in lists for i in x], dtype=np.int64), np.cumsum([0] + [len(x) for x in lists]))


class Shard:
    """Documents whose runs of known words, at least one phrase long, are searched together."""

    def __init__(self, vocabulary: np.ndarray, length: int):
        self.vocabulary, self.length = vocabulary, length
        self.memo: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.parts: list[np.ndarray] = []
        self.starts: list[int] = []  # place of each run in the shard's text
        self.owners: list[tuple[int, int]] = []  # document number and first word of each run
        self.size = 0

    def _symbol(self, word: str) -> int:
        if len(self.memo) > 500_000:
            self.memo.clear()
        number = xxhash.xxh3_64_intdigest(word) - (1 << 63)
        at = int(np.searchsorted(self.vocabulary, number))
        known = at < len(self.vocabulary) and self.vocabulary[at] == number
        found = self.memo[word] = at + 1 if known else 0
        return found

    def add(self, document: int, text: str | None) -> None:
        get = self.memo.get
        known = []
        for w in words_of(text):
            symbol = get(w)
            known.append(self._symbol(w) if symbol is None else symbol)
        if len(known) < self.length:
            return
        known = np.array(known, dtype=np.int64)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (known > 0).astype(np.int8), [0]])))
        for begin, end in zip(edge[0::2], edge[1::2], strict=True):
            if end - begin >= self.length:
                self.parts += [known[begin:end], np.zeros(1, dtype=np.int64)]
                self.starts.append(self.size)
                self.owners.append((document, int(begin)))
                self.size += int(end - begin) + 1

    def hits(self, blocks: list[Broadcast]) -> Iterator[tuple[Phrases, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of phrases: document number, first word and phrase number of each occurrence."""
        if not self.parts:
            return
        text = np.concatenate(self.parts)
        # Symbols of the index are those that the shard has, renumbered.
        present = np.unique(text[text > 0])
        index = FmIndex(np.where(text > 0, np.searchsorted(present, text) + 1, 0), len(present))
        owners, starts = np.array(self.owners, dtype=np.int64), np.array(self.starts)
        for block in blocks:
            phrases: Phrases = block.value
            if not len(phrases.rows):
                continue
            at = np.minimum(np.searchsorted(present, phrases.rows), len(present) - 1)
            whole = np.flatnonzero((present[at] == phrases.rows).all(axis=1))
            lo, hi = index.search(at[whole] + 1)
            counts = hi - lo
            phrase = np.repeat(whole, counts)
            rows = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(lo, counts)
            place = index.locate(rows)
            run = np.searchsorted(starts, place, side="right") - 1
            yield phrases, owners[run, 0], owners[run, 1] + place - starts[run], phrase


def _search(documents: DataFrame, vocabulary: Broadcast, blocks: list[Broadcast], length: int, shard_words: int, spans: bool) -> DataFrame:
    def flush(shard: Shard, ids: list[int]) -> pa.RecordBatch:
        pairs: set[tuple[int, int]] = set()
        places: dict[tuple[int, int], set[int]] = defaultdict(set)
        for phrases, document, word, phrase in shard.hits(blocks):
            for d, w, p in set(zip(document.tolist(), word.tolist() if spans else [0] * len(word), phrase.tolist(), strict=True)):
                items = phrases.ids[phrases.starts[p] : phrases.starts[p + 1]].tolist()
                if spans:
                    places[d, w].update(items)
                else:
                    pairs.update((ids[d], i) for i in items)
        shard.clear()
        if not spans:
            found = sorted(pairs)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["doc_id", "item_id"])
        out: list[list] = []
        for d, w in sorted(places):
            if out and out[-1][0] == d and w <= out[-1][2]:
                out[-1][2] = max(out[-1][2], w + length)
                out[-1][3].update(places[d, w])
            else:
                out.append([d, w, w + length, set(places[d, w])])
        columns = [pa.array([ids[o[0]] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array([sorted(o[3]) for o in out], pa.list_(pa.int64()))], names=["doc_id", "first_word", "end_word", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, ids = Shard(vocabulary.value, length), []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                shard.add(len(ids), text)
                ids.append(doc_id)
                if shard.size >= shard_words:
                    yield flush(shard, ids)
                    ids = []
        if ids:
            yield flush(shard, ids)

    schema = "doc_id bigint, first_word bigint, end_word bigint, items array<bigint>" if spans else "doc_id bigint, item_id bigint"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


def _prepared(items: DataFrame, length: int) -> tuple[Broadcast, list[Broadcast]]:
    """The numbers of all words of items, sorted, and the phrases in blocks of about BLOCK_ITEMS items; each block is gone from the driver once it is broadcast."""
    spark = items.sparkSession
    usable = items.select("item_id", "text").where("item_id is not null and text is not null")

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = {n for text in batch.column("text").to_pylist() for n in word_numbers(text)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], names=["n"])

    words = usable.select("text").mapInArrow(numbers, "n bigint").distinct().toArrow().column("n").to_numpy()
    vocabulary = np.sort(words)
    blocks = max(1, -(-usable.count() // BLOCK_ITEMS))
    out = []
    for b in range(blocks):
        part = usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else usable
        out.append(spark.sparkContext.broadcast(compile_phrases([(r["item_id"], r["text"]) for r in part.collect()], vocabulary, length)))
    return spark.sparkContext.broadcast(vocabulary), out


def leaked_pairs(documents: DataFrame, items: DataFrame, length: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, item_id``: the document contains ``length`` consecutive words of the item.

    Each pair comes once, whatever the number of places. Null and empty texts match nothing,
    rows without doc_id or item_id are left out. Equal documents are all reported.
    """
    return _search(documents.where("doc_id is not null"), *_prepared(items, length), length, shard_words, spans=False).distinct()


def leaked_spans(documents: DataFrame, items: DataFrame, length: int = PHRASE_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """``doc_id, first_word, end_word, items``: merged word spans to remove (end exclusive), with the items they come from.

    Spans of a document's text that overlap or touch are one, however many items there are.
    """
    return _search(documents.where("doc_id is not null"), *_prepared(items, length), length, shard_words, spans=True)
