"""Encoding of texts with a public byte-level BPE vocabulary, and streaming decoding.

The merges are compiled into a finite-state transducer over bytes that is determinised as far
as texts require. A sequence of tokens is the BPE encoding of its bytes exactly if every two
neighbours are the encoding of theirs; so each prefix of a piece has one last token, and a
state only needs the places where a token may still be growing. Tokens are emitted as soon as
all of these agree, at the latest after the length of the longest token.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies on every machine; a parameter of all functions below.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Fixed value: the pattern that cuts a text into pieces, which are encoded one by one.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries at which a worker empties its memo of transitions or pieces.
MEMO_LIMIT = 1_000_000
#: Characters up to which a piece is remembered.
MEMO_PIECE = 48


def _byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: itself where it is visible, else from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Transducer:
    """Bytes in, token ids out; ``start`` is the state before a piece."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbols = _byte_symbols()
        as_bytes = lambda token: bytes(symbols[c] for c in token)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        ids = model["vocab"]
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.merges[ids[a], ids[b]] = (rank, ids[a + b])
        self.bytes_of: dict[int, bytes] = {}
        self.single = [0] * 256
        self.children: dict[int, int] = {}
        self.token_at: dict[int, int] = {}
        self.grows: set[int] = set()
        nodes = 1
        made = {m[1] for m in self.merges.values()}
        for token, number in ids.items():
            if len(token) > 1 and number not in made:
                continue  # a special token, which is ordinary text here
            raw = as_bytes(token)
            self.bytes_of[number] = raw
            if len(raw) == 1:
                self.single[raw[0]] = number
            node = 0
            for byte in raw:
                self.grows.add(node)
                key = node << 8 | byte
                if key not in self.children:
                    self.children[key] = nodes
                    nodes += 1
                node = self.children[key]
            self.token_at[node] = number
        self.fits: dict[tuple[int, int], bool] = {}
        self.start = 0
        self._reset()

    def _reset(self) -> None:
        # A state: for each place where a token may grow, the trie node, the tokens since the last
        # emitted one and the token before it; the last entry is the place after the last byte.
        first = ((0, (), -1),)
        self.states = [first]
        self.numbers = {first: 0}
        self.moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _merged(self, raw: bytes) -> list[int]:
        """BPE by its definition: the merge of lowest rank first, leftmost first."""
        seq = [self.single[b] for b in raw]
        while len(seq) > 1:
            best = min(((self.merges[p][0], i) for i, p in enumerate(zip(seq, seq[1:], strict=False)) if p in self.merges), default=None)
            if best is None:
                break
            pair = seq[best[1]], seq[best[1] + 1]
            out, i = [], 0
            while i < len(seq):
                if i + 1 < len(seq) and (seq[i], seq[i + 1]) == pair:
                    out.append(self.merges[pair][1])
                    i += 2
                else:
                    out.append(seq[i])
                    i += 1
            seq = out
        return seq

    def _fit(self, before: int, token: int) -> bool:
        key = (before, token)
        if (known := self.fits.get(key)) is None:
            raw = self.bytes_of[token] if before < 0 else self.bytes_of[before] + self.bytes_of[token]
            known = self._merged(raw) == ([token] if before < 0 else [before, token])
            if len(self.fits) >= MEMO_LIMIT:
                self.fits = {}
            self.fits[key] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        alive, path, last = [], None, -1
        for node, pending, before in self.states[state]:
            node = self.children.get(node << 8 | byte)
            if node is None:
                continue
            token = self.token_at.get(node)
            if path is None and token is not None and self._fit(before, token):
                path, last = (*pending, token), token
            if node in self.grows:
                alive.append((node, pending, before))
        alive.append((0, path, last))
        agreed = 0
        shortest = min(len(p) for _, p, _ in alive)
        while agreed < shortest and len({p[agreed] for _, p, _ in alive}) == 1:
            agreed += 1
        emitted = path[:agreed]
        after = tuple((n, p[agreed:], b) for n, p, b in alive)
        number = self.numbers.get(after)
        if number is None:
            number = self.numbers[after] = len(self.states)
            self.states.append(after)
        self.moves[state << 8 | byte] = move = (number, emitted)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        if len(self.moves) >= MEMO_LIMIT:
            self._reset()
        out: list[int] = []
        state, moves = self.start, self.moves
        for byte in piece:
            found = moves.get(state << 8 | byte)
            if found is None:
                found = self._move(state, byte)
            state = found[0]
            if found[1]:
                out += found[1]
        out += self.states[state][-1][1]
        return out


class Encoder:
    """Texts to ids: cut into pieces, each run through the transducer."""

    def __init__(self, path: str = VOCABULARY):
        self.transducer = Transducer(path)
        self.cut = regex.compile(PIECES).findall
        self.memo: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        """Ids of a text; a null or empty one has none."""
        out: list[int] = []
        if not text:
            return out
        memo = self.memo
        for piece in self.cut(text):
            ids = memo.get(piece)
            if ids is None:
                ids = self.transducer.encode(piece.encode("utf-8"))
                if len(piece) <= MEMO_PIECE:
                    if len(memo) >= MEMO_LIMIT:
                        memo.clear()
                    memo[piece] = ids
            out += ids
        return out


@lru_cache(4)
def encoder(path: str = VOCABULARY) -> Encoder:
    """One encoder per worker and vocabulary."""
    return Encoder(path)


class Utf8Stream:
    """Incremental UTF-8 decoding: bytes in pieces of any size, text out; ill-formed bytes become U+FFFD."""

    def __init__(self) -> None:
        self.need = 0  # continuation bytes that are missing
        self.value = 0
        self.low, self.high = 0x80, 0xBF  # range of the next continuation byte

    def feed(self, raw: bytes) -> str:
        """The text that is complete after these bytes."""
        out = []
        for b in raw:
            if self.need:
                if self.low <= b <= self.high:
                    self.value = self.value << 6 | b & 0x3F
                    self.need -= 1
                    self.low, self.high = 0x80, 0xBF
                    if not self.need:
                        out.append(chr(self.value))
                    continue
                out.append("�")
                self.need, self.low, self.high = 0, 0x80, 0xBF
            if b < 0x80:
                out.append(chr(b))
            elif 0xC2 <= b <= 0xDF:
                self.need, self.value = 1, b & 0x1F
            elif 0xE0 <= b <= 0xEF:
                self.need, self.value = 2, b & 0x0F
                # no overlong forms, no surrogates
                self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
            elif 0xF0 <= b <= 0xF4:
                self.need, self.value = 3, b & 0x07
                self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
            else:
                out.append("�")
        return "".join(out)

    def close(self) -> str:
        """The end of the text: U+FFFD if a character is incomplete."""
        open_, self.need = self.need, 0
        return "�" if open_ else ""


def decode_stream(ids: Iterable[int], path: str = VOCABULARY) -> Iterator[str]:
    """Text of ids as they come; joined, it is the decoded text."""
    table, stream = encoder(path).transducer.bytes_of, Utf8Stream()
    for i in ids:
        if text := stream.feed(table[i]):
            yield text
    if text := stream.close():
        yield text


def encoded(documents: DataFrame, path: str = VOCABULARY, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and ``ids`` (array<int>) of every document.

    Null and empty texts have an empty list. Rows are neither dropped nor merged; strings that
    look like special tokens are ordinary text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            ids = pa.array([encode(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, "ids"])

    types = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    schema = ", ".join(f"`{c}` {types[c]}" for c in keep) + ", ids array<int>"
    return documents.select(*keep, "text").mapInArrow(run, schema)


def token_counts(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per source: documents, tokens, and code points per token; a null source has its own row."""
    sized = encoded(documents, path, ("source", "n_chars")).select("source", "n_chars", F.size("ids").alias("n"))
    per = sized.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("n").cast("bigint")).alias("tokens"), F.sum("n_chars").alias("chars"))
    return per.select("source", "documents", "tokens", F.round(F.try_divide("chars", "tokens"), 4).alias("chars_per_token"))


def round_trips(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, same``: whether the decoded ids of each document are its text again (a null text counts as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            same = ["".join(decode_stream(encode(t), path)) == (t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(same, pa.bool_())], names=["doc_id", "same"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, same boolean")
