"""Byte-level BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a pre-token the encoding has one last token. It is found among the vocabulary's matches that end
there (an automaton with suffix links lists them, longest first): the token whose pair with the last token of the
prefix before it is compatible, which means that merging would not cross their border. Compatibility of two tokens is
decided by undoing merges on both sides of the border, latest first. Following the stored tokens back gives the ids.

Pre-tokens repeat, so a bounded cache keeps the ids of words between spaces; nothing else is kept of a text. Special
tokens written out in a text take their own ids, as in the library's default.

Defined results: a null text is empty; an empty text has no ids; very long texts and words cost time in proportion to
their length; repeated rows are encoded each; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quarry.llm.common import small_batches

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHED = 150_000


def byte_reader():
    """A function from a vocabulary's spelling of a token to its bytes."""
    letters = byte_letters()
    return lambda s: bytes(letters[c] for c in s)


class _Spaces(Exception):
    """A word that the pattern has to see with its neighbours."""


class _Cache(dict):
    """Ids of words, made when they are missing; emptied when full."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        found = self.make(word)
        if len(word) < 64:
            if len(self) >= CACHED:
                self.clear()
            self[word] = found
        return found


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable Latin-1 as itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class PrefixEncoder:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw = byte_reader()
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for b, i in vocab.items():
            self.bytes[i] = b
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.pretokens = regex.compile(PATTERN).findall
        self._learn(spec, vocab)
        self.pieces = _Cache(lambda piece: _packed(self.encode_bytes(piece.encode())))
        self.words, self.spaced = _Cache(self._whole), _Cache(self._after_space)
        self.line_end = self._whole("\n")

    def _learn(self, spec: dict, vocab: dict[bytes, int]) -> None:
        """Merges, the parts and rank of merged tokens, and the automaton of all tokens."""
        import ahocorasick

        raw = byte_reader()
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * len(self.bytes)
        self.rank = [-1] * len(self.bytes)  # of the merge that makes a token; single bytes have none
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = (raw(s) for s in (pair if isinstance(pair, list) else pair.split(" ")))
            made = vocab[a + b]
            self.merged[vocab[a], vocab[b]] = made
            self.parts[made], self.rank[made] = (vocab[a], vocab[b]), k
        self.matches = ahocorasick.Automaton()
        for b, i in vocab.items():
            if self.parts[i] is not None or len(b) == 1:
                self.matches.add_word(b.decode("latin-1"), (i, len(b)))
        self.matches.make_automaton()
        self.known: dict[tuple[int, int], bool] = {}

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pair stays two tokens. Of the two sides the later merge is undone, and no merge across the border
        may come before the merge that was undone last."""
        key = (left, right)
        found = self.known.get(key)
        if found is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            found = self.known[key] = self._compatible(left, right)
        return found

    def _compatible(self, left: int, right: int) -> bool:
        rank, parts, merged = self.rank, self.parts, self.merged
        limit = len(rank)  # merges of this rank and later come after the border's neighbours were complete
        while True:
            across = merged.get((left, right))
            if across is not None and rank[across] < limit:
                return False
            if rank[left] < 0 and rank[right] < 0:
                return True
            if rank[left] > rank[right]:
                limit = rank[left]  # ties in rank go to the pair further left: the left token was made first
                left = parts[left][1]
            else:
                limit = rank[right] + 1  # an equal merge across the border lies further left and would go first
                right = parts[right][0]

    def encode_bytes(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        last: list[tuple[int, int]] = [(-1, 0)] * (len(word) + 1)
        compatible, at = self.compatible, 0
        for end, (token, n) in self.matches.iter(word.decode("latin-1")):
            end += 1
            if end > at:  # the first match that fits is the only one
                before = last[end - n][0]
                if before < 0 and end == n or before >= 0 and compatible(before, token):
                    last[end] = (token, n)
                    at = end
        ids, at = [], len(word)
        while at:
            token, n = last[at]
            ids.append(token)
            at -= n
        return ids[::-1]

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pretokens(text)))

    def _after_space(self, word: str) -> bytes:
        if not word or word[0].isspace():
            raise _Spaces
        return self._whole(" " + word)

    def _plain(self, text: str) -> bytes:
        """Line by line and word by word: a space before anything but white space always begins a pre-token, and so does
        a line feed between two characters that are no white space."""
        out = []
        lines = text.split("\n")
        try:
            for line in lines:
                if len(lines) > 1 and (not line or line[0].isspace() or line[-1].isspace()):
                    raise _Spaces
                first, *rest = line.split(" ")
                out.append(self.words[first] + b"".join(map(self.spaced.__getitem__, rest)))
        except _Spaces:
            return self._whole(text)
        return self.line_end.join(out)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._plain(text) if text else b""
        return b"".join(_packed([self.special[p]]) if p in self.special else self._plain(p) for p in self.cut(text) if p)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


class LibraryEncoder(PrefixEncoder):
    """The same ids with a library's merges instead of the prefix method, for operators that need ids and not the method.
    The vocabulary's ids must be in the order of its merges."""

    def _learn(self, spec: dict, vocab: dict[bytes, int]) -> None:
        import tiktoken

        raw = byte_reader()
        made = [vocab[raw("".join(pair if isinstance(pair, list) else pair.split(" ")))] for pair in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids are not in the order of merges")
        self.merge = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={}).encode_ordinary

    def _whole(self, text: str) -> bytes:
        return _packed(self.merge(text))


@lru_cache(maxsize=2)
def encoder(path: str, library: bool = False) -> PrefixEncoder:
    """One encoder a worker process."""
    return LibraryEncoder(path) if library else PrefixEncoder(path)


def in_parts(batch: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes of a text column (one row at least)."""
    texts = batch.column(column)
    sizes = np.array(pc.fill_null(pc.binary_length(texts), 0)) if len(texts) else np.zeros(0, int)
    part = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode_texts(docs: DataFrame, vocabulary: str, decode: bool = True) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and, if asked for, decoded text. vocabulary: the path of a
    byte-level BPE file, readable on every executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in in_parts(batch, 1):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"][: len(columns)])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary" + ", decoded string" * decode)
