"""Suffix-array dedup: removes every byte covered by a string of `length` bytes that also starts earlier in the corpus
(smaller doc_id, or the same document and an earlier start). Judged on the input, and exact on bytes but for one step:
whole contexts (below) are taken as copies when two independent 64-bit hashes of them agree, without a look at the bytes.

1. Anchors. In every window of `length` bytes the k-gram of least hash (leftmost first) is the window's anchor, so equal
   windows have equal anchors at equal offsets. Consecutive windows of one anchor and the bytes under them form its
   context. One row per anchor meets its equals by k-gram hash; contexts of equal 128-bit hash are copies, and all but
   the first are removed whole. Each task first settles the copies that it sees itself, so an anchor sends at most
   `local` rows a task, however often it occurs.
2. Suffix sort. Anchors with differing contexts (edges of copies, edits) send their context bytes to the task of the
   anchor, which sorts the suffixes that start in them: a mergesort whose comparisons find the common extension of two
   suffixes by binary search over prefix polynomial hashes. Neighbours that agree on `length` bytes, verified byte by
   byte, are one string; all but its first start are removed. An anchor with more contexts than `hot` sends its windows
   one by one under the window's hash instead, so that no task gets an unbounded group.
3. Removed windows meet the texts by document.

The written table of step 1 cuts the lineage. Texts are shuffled once, by document.

Defined results: a null text is empty; texts shorter than `length` lose nothing; repeated doc_ids (and null ones, which
come first) are documents of their own, ordered by text hash; repeated rows lose all bytes but those of the first; an
empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.bpe import in_parts
from quarry.llm.common import identified, partitions, small_batches, written

K = 32
BITS = 20
PIECE = (1 << BITS) - 256
FLUSH = 400_000
LOCAL, HOT = 64, 4096
BLOCK = 5_000
COPY, MARK, LONE, GONE, MANY = 0, 1, 2, 3, 4  # kinds of rows: anchor, mark of a hot anchor, window by window, removed, by context
U = np.uint64


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """Random values of the bytes for two hashes."""
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * U(2) + U(1)


@lru_cache(maxsize=4)
def _powers(bits: int, base: int) -> np.ndarray:
    power = np.full(1 << bits, base, np.uint64)
    power[0] = 1
    return np.cumprod(power, dtype=np.uint64)


#: Odd bases of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _power(n: int, which: int = 0) -> np.ndarray:
    """At least n powers of an odd base modulo 2^64."""
    return _powers(max(BITS + 1, n.bit_length()), BASES[which])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
    return h ^ (h >> U(32))


def _prefixes(data: np.ndarray, values: np.ndarray, which: int = 0) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * _power(len(data), which)[: len(data)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, at: np.ndarray, length, which: int = 0) -> np.ndarray:
    """Equal strings have equal values wherever they lie: the difference is scaled to one common power."""
    return (prefix[at + length] - prefix[at]) * _power(len(prefix) + 1, which)[len(prefix) - at]


def _anchors(data: np.ndarray, starts_ok: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """For the window starts in starts_ok (ascending): first start, number of windows, anchor, k-gram hash and context
    hash of each run of windows with one anchor."""
    (values, others), power = _values(), _power(len(data) + 1)
    prefix = _prefixes(data, values)
    w = length - K + 1
    grams = _mix((prefix[K:] - prefix[:-K]) * power[len(data) - np.arange(len(data) - K + 1)])
    least = (grams >> U(BITS) << U(BITS)) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < w:
        least = np.minimum(least[: len(grams) - w + 1], least[w - span :])
    anchor = (least[starts_ok] & U((1 << BITS) - 1)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts_ok[1:] != starts_ok[:-1] + 1)]))
    low, high = starts_ok[first], starts_ok[np.append(first[1:], len(starts_ok)) - 1]
    anchor = anchor[first]
    second = _prefixes(data, others, 1)
    size = high - low + length
    context = _mix(_hash(second, low, size, 1) + _mix((size * 256 + anchor - low).astype(np.uint64)))
    return low, high - low + 1, anchor - low, grams[anchor], context


def _pieces(ids: np.ndarray, texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Packs texts into buffers (long ones in pieces that overlap by length - 1) and yields document, first start, number
    of windows, offset of the anchor, k-gram hash and context hash."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def emit():
        data = np.frombuffer(b"".join(b for _, _, b in held), np.uint8)
        data = np.concatenate([data, np.zeros(1 + (1 << BITS) - len(data), np.uint8)])  # one length for all: one scale
        lens = np.array([len(b) for _, _, b in held])
        off = np.cumsum(lens) - lens
        counts = lens - length + 1
        owner = np.repeat(np.arange(len(held)), counts)
        ok = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + off[owner]
        low, n, rel, gram, context = _anchors(data, ok, length)
        own = np.searchsorted(off, low, "right") - 1
        at = np.array([a for _, a, _ in held])
        return np.array([i for i, _, _ in held], np.int64)[own], low - off[own] + at[own], n, rel, gram, context

    for i, text in zip(ids, texts, strict=True):
        for a in range(0, max(0, len(text) - length) + 1, PIECE - length + 1):
            part = text[a : a + PIECE]
            if len(part) < length:
                continue
            if size + len(part) > PIECE:
                yield emit()
                held, size = [], 0
            held.append((i, a, part))
            size += len(part)
    if held:
        yield emit()


def _rows(key, kind, context, uid, pos, n, rel) -> pa.RecordBatch:
    long = lambda x: pa.array(np.asarray(x).view(np.int64) if np.asarray(x).dtype == np.uint64 else np.asarray(x, np.int64), pa.int64())
    short = lambda x: pa.array(np.asarray(x, np.int32), pa.int32())
    return pa.RecordBatch.from_arrays([long(key), short(kind), long(context), long(uid), long(pos), short(n), short(rel)], ["key", "kind", "context", "uid", "pos", "n", "rel"])


ROWS = "key long, kind int, context long, uid long, pos long, n int, rel int"


def _settle(local, gram, context, uid, pos, n, rel) -> Iterator[pa.RecordBatch]:
    """What a task sends of its own anchors: copies are removed here, the first of each context goes on."""
    order = np.lexsort((pos, uid, context, gram))
    gram, context, uid, pos, n, rel = (x[order] for x in (gram, context, uid, pos, n, rel))
    new_gram = np.append(True, gram[1:] != gram[:-1])
    first = new_gram | np.append(True, context[1:] != context[:-1])
    group = np.cumsum(new_gram) - 1
    crowded = np.bincount(group[first], minlength=group[-1] + 1)[group] > local
    if (~first).any():
        yield _removed(uid[~first], pos[~first], n[~first])
    for these, kind in ((first & ~crowded, COPY), (first & crowded, LONE), (new_gram & crowded, MARK)):
        if these.any():
            yield _rows(_mix(uid[these].view(np.uint64)) if kind == LONE else gram[these], np.full(these.sum(), kind), context[these], uid[these], pos[these], n[these], rel[these])


def _removed(uid, pos, n) -> pa.RecordBatch:
    """Removed windows, with those that follow one another in one row."""
    order = np.lexsort((pos, uid))
    uid, pos, n = uid[order], pos[order], n[order]
    first = np.flatnonzero(np.append(True, (uid[1:] != uid[:-1]) | (pos[1:] != pos[:-1] + n[:-1])))
    total = np.add.reduceat(n, first)
    uid, pos, zero = uid[first], pos[first], np.zeros(len(first))
    return _rows(_mix(uid.view(np.uint64)), zero + GONE, zero, uid, pos, total, zero)


def _find_anchors(length: int, local: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in (p for batch in batches for p in in_parts(batch, 1, 4 << 20)):
            texts = part.column(1).cast(pa.binary()).to_pylist()
            for uid, pos, n, rel, gram, context in _pieces(part.column(0).to_numpy(), texts, length):
                held.append((gram, context, uid, pos, n, rel))
                size += len(uid)
                if size >= FLUSH:
                    yield from _settle(local, *map(np.concatenate, zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield from _settle(local, *map(np.concatenate, zip(*held, strict=True)))

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Rows sorted by key, in tables of at least `least` rows that do not cut a key."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size >= least:
            whole = pa.Table.from_batches(held)
            keys = whole.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1], "left"))
            if cut:
                yield whole.slice(0, cut)
                held, size = whole.slice(cut).combine_chunks().to_batches(), len(keys) - cut
    if held:
        yield pa.Table.from_batches(held)


def _decide(hot: int):
    """Per anchor: copies of a context are removed; several contexts are to be sorted; the rest is unique."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, 50_000):
            key, kind, context, uid, pos, n, rel = (whole.column(c).to_numpy() for c in ("key", "kind", "context", "uid", "pos", "n", "rel"))
            through = (kind == LONE) | (kind == GONE)
            if through.any():
                yield _rows(*(x[through] for x in (key, kind, context, uid, pos, n, rel)))
            if through.all():
                continue
            key, kind, context, uid, pos, n, rel = (x[~through] for x in (key, kind, context, uid, pos, n, rel))
            new_key = np.append(True, key[1:] != key[:-1])
            group = np.cumsum(new_key) - 1
            anchor = kind == COPY
            first = anchor & (new_key | np.append(True, (context[1:] != context[:-1]) | ~anchor[:-1]))
            marked = np.bincount(group, weights=~anchor)[group] > 0
            contexts = np.bincount(group, weights=first)[group]
            if (copy := anchor & ~first).any():
                yield _removed(uid[copy], pos[copy], n[copy])
            crowded = marked | (contexts > hot)
            for these, as_kind in ((first & crowded, LONE), (first & ~crowded & (contexts > 1), MANY)):
                if these.any():
                    yield _rows(key[these], np.full(these.sum(), as_kind), context[these], uid[these], pos[these], n[these], rel[these])

    return run


CONTEXTS = "key long, uid long, pos long, n int, rel int, bytes binary"
CONTEXT_TYPES = pa.schema([("key", pa.int64()), ("uid", pa.int64()), ("pos", pa.int64()), ("n", pa.int32()), ("rel", pa.int32()), ("bytes", pa.binary())])


def _windows(rows: list[tuple], length: int) -> Iterator[tuple]:
    """Windows of hot anchors, each string once: later ones in these rows are removed at once (no bytes)."""
    values, power = _values()[0], _power(256)
    seen: set[bytes] = set()
    for uid, pos, n, part in sorted(rows):
        prefix = _prefixes(np.frombuffer(part, np.uint8), values)
        at = np.arange(n)
        keys = _mix((prefix[at + length] - prefix[at]) * power[256 - at]).view(np.int64).tolist()
        for i, key in enumerate(keys):
            window = part[i : i + length]
            yield (key, uid, pos + i, 1, 0, None if window in seen else window)
            seen.add(window)


def _cut_contexts(length: int):
    """Reads the bytes of contexts out of the texts; those of hot anchors window by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field("text").cast(pa.binary()).to_pylist()
            out: list[tuple] = []
            lone: list[tuple] = []
            for uid, text, items in zip(batch.column("uid").to_pylist(), texts, batch.column("items").to_pylist(), strict=True):
                for x in items:
                    part = text[x["pos"] : x["pos"] + x["n"] - 1 + length]
                    if x["kind"] == MANY:
                        out.append((x["key"], uid, x["pos"], x["n"], x["rel"], part))
                    else:
                        lone.append((uid, x["pos"], x["n"], part))
            out.extend(_windows(lone, length))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), CONTEXT_TYPES, strict=True)], schema=CONTEXT_TYPES)

    return run


class _Suffixes:
    """Suffixes of a buffer, compared over their first `length` bytes by prefix hashes."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        self.prefix, self.power = _prefixes(data, _values()[0]), _power(len(data) + 1)

    def same(self, p, q, n) -> np.ndarray:
        """Whether n bytes at p and q have equal hashes; the shift between p and q evens out the powers."""
        left, right = self.prefix[p + n] - self.prefix[p], self.prefix[q + n] - self.prefix[q]
        low = np.minimum(p, q)
        return left * self.power[q - low] == right * self.power[p - low]

    def common(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension, by binary search."""
        low, high = np.zeros(len(p), np.int64), np.full(len(p), self.length, np.int64)
        for _ in range(self.length.bit_length()):
            middle = (low + high + 1) >> 1
            equal = self.same(p, q, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def precedes(self, p: np.ndarray, q: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        n = self.common(p, q)
        end = n >= self.length
        step = np.minimum(n, self.length - 1)
        return np.where(end, or_equal, self.data[p + step] < self.data[q + step])

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """A stable order of the suffixes within each group (groups lie together): bottom-up mergesort, all groups and
        runs of a level at once. An element's place is its place in its run and the number of elements of the other run
        that go before it, found by binary search."""
        n = len(at)
        order = np.arange(n)
        first = np.append(True, group[1:] != group[:-1])
        begin = np.flatnonzero(first)
        size = np.diff(np.append(begin, n))
        start, stop = np.repeat(begin, size), np.repeat(begin + size, size)
        run, largest = 1, size.max()
        while run < largest:
            slot = np.flatnonzero(stop - start > run)
            s, e = start[slot], stop[slot]
            pair = s + (slot - s) // (2 * run) * (2 * run)
            middle, end = np.minimum(pair + run, e), np.minimum(pair + 2 * run, e)
            left = slot < middle
            low, high = np.where(left, middle, pair), np.where(left, end, middle)
            base = low.copy()
            mine = at[order[slot]]
            while (open_ := np.flatnonzero(low < high)).size:
                m = (low[open_] + high[open_]) >> 1
                before = self.precedes(at[order[m]], mine[open_], ~left[open_])
                low[open_] = np.where(before, m + 1, low[open_])
                high[open_] = np.where(before, high[open_], m)
            place = np.where(left, slot, pair + slot - middle) + low - base
            moved = order[slot]
            order[place] = moved
            run *= 2
        return order

    def repeats(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Of sorted suffixes, those equal to the one before; equal hashes are verified on the bytes."""
        if len(at) < 2:
            return np.zeros(len(at), bool)
        near = np.flatnonzero((group[1:] == group[:-1]) & self.same(at[1:], at[:-1], self.length)) + 1
        out = np.zeros(len(at), bool)
        for part in np.array_split(near, max(1, len(near) // 50_000)):
            steps = np.arange(self.length)
            equal = (self.data[at[part][:, None] + steps] == self.data[at[part - 1][:, None] + steps]).all(axis=1)
            out[part[equal]] = True
            for i in part[~equal]:  # a collision of hashes: look through the group itself
                mine = self.data[at[i] : at[i] + self.length].tobytes()
                j = i - 1
                while j >= 0 and group[j] == group[i] and not out[i]:
                    out[i] = self.data[at[j] : at[j] + self.length].tobytes() == mine
                    j -= 1
        return out


def _sort_contexts(length: int):
    """Removes the repeated windows of whole groups of contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in _whole_groups(batches, BLOCK):
            whole = whole.combine_chunks()
            known = whole.column("bytes").is_valid().to_numpy()
            if not known.all():
                rows = whole.filter(pa.array(~known))
                yield _removed(*(rows.column(c).to_numpy() for c in ("uid", "pos", "n"))).select(["uid", "pos", "n"])
            whole = whole.filter(pa.array(known))
            if not whole.num_rows:
                continue
            key, uid, pos, n, rel = (whole.column(c).to_numpy() for c in ("key", "uid", "pos", "n", "rel"))
            parts = whole.column("bytes").to_pylist()
            data = np.frombuffer(b"".join(parts), np.uint8)
            lens = np.array([len(x) for x in parts])
            off = np.cumsum(lens) - lens
            owner = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
            group = np.cumsum(np.append(False, key[1:] != key[:-1]))[owner] * 256 + rel[owner] - step
            start = pos[owner] + step
            order = np.lexsort((start, uid[owner], group))
            owner, step, group, start = owner[order], step[order], group[order], start[order]
            at = off[owner] + step
            suffixes = _Suffixes(data, length)
            order = suffixes.sort(at, group)
            gone = order[suffixes.repeats(at[order], group[order])]
            if len(gone):
                yield _removed(uid[owner[gone]], start[gone], np.ones(len(gone), np.int64)).select(["uid", "pos", "n"])

    return run


def _cut_out(length: int, as_text: bool):
    @F.pandas_udf(f"struct<n_bytes: long, spans: array<struct<start: long, length: long>>, kept: {'string' if as_text else 'binary'}>")
    def cut(texts, gone):  # noqa: ANN001, ANN202
        import pandas as pd

        sizes, spans, kept = [], [], []
        for text, runs in zip(texts, gone, strict=True):
            data = (text or "").encode()
            found: list[list[int]] = []
            if runs is not None and len(runs):
                for a, n in sorted(zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True)):
                    b = a + n - 1 + length
                    if found and a <= found[-1][1]:
                        found[-1][1] = max(found[-1][1], b)
                    else:
                        found.append([a, b])
            sizes.append(len(data))
            spans.append([{"start": a, "length": b - a} for a, b in found])
            ends = [0, *(x for ab in found for x in ab), len(data)]
            kept.append(b"".join(data[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)))
        if as_text:  # a cut can fall inside a character, whose other bytes then go as well
            kept = [k.decode("utf-8", "ignore") for k in kept]
        return pd.DataFrame({"n_bytes": sizes, "spans": spans, "kept": kept})

    return cut


def remove_repeats(docs: DataFrame, length: int = 100, local: int = LOCAL, hot: int = HOT, as_text: bool = False) -> DataFrame:
    """row (all columns of docs as a struct) and cut: n_bytes, spans (maximal removed runs), kept (the remaining bytes, or
    as text those that are whole characters)."""
    if not K + 8 <= length <= 100 + K:
        raise ValueError("length is between 40 and 132 bytes")
    n = partitions(docs.sparkSession)
    small_batches(docs.sparkSession)
    rows = identified(docs)
    found = rows.filter("row.text IS NOT NULL").select("uid", "row.text").mapInArrow(_find_anchors(length, local), ROWS)
    found = found.repartition(n, "key").sortWithinPartitions("key", "kind", "context", "uid", "pos").mapInArrow(_decide(hot), ROWS)
    found = written(found, "suffix-anchors")
    asked = found.filter(F.col("kind").isin(LONE, MANY)).groupBy("uid").agg(F.collect_list(F.struct("kind", "key", "pos", "n", "rel")).alias("items"))
    contexts = rows.join(asked, "uid").mapInArrow(_cut_contexts(length), CONTEXTS)
    late = contexts.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_sort_contexts(length), "uid long, pos long, n int")
    gone = found.filter(F.col("kind") == GONE).select("uid", "pos", "n").unionByName(late)
    gone = gone.groupBy("uid").agg(F.flatten(F.collect_list(F.array("pos", F.col("n").cast("long")))).alias("gone"))
    return rows.join(gone, "uid", "left").select("row", _cut_out(length, as_text)("row.text", "gone").alias("cut"))
