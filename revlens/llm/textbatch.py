"""Words of whole texts as numpy arrays, straight from Arrow buffers.

A *word* here is a maximal run of ASCII digits, ASCII letters (lower-cased) and
all code points from U+0080 on, i.e. ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the
lower-cased text.  Every byte of a multi-byte UTF-8 sequence is >= 0x80, so the
byte view finds exactly the words of the character view.  Nulls count as empty.

Texts are handled in chunks of about ``CHUNK_BYTES``; one longer text is a
chunk of its own, so memory follows the longest text, not the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
MASK64 = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


def _byte_tables():
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    word = np.zeros(256, bool)
    word[48:58] = True
    word[97:123] = True
    word[128:] = True
    return low, word


LOWER, WORD = _byte_tables()


def mix64(x):
    """Bijective finaliser on uint64 arrays (xor-shift and multiply)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers: dict = {}


def powers(n: int):
    """Powers 0..n-1 of an odd base modulo 2**64, and their inverses."""
    if len(_powers.get("p", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        p = np.full(size, _BASE, np.uint64)
        q = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        p[0] = q[0] = 1
        _powers["p"], _powers["q"] = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _powers["p"][:n], _powers["q"][:n]


def buffers(column: pa.Array):
    """(bytes, offsets) of a string column; nulls are empty, offsets start at 0."""
    column = column.fill_null("").cast(pa.large_string()) if column.type != pa.null() else pa.array([""] * len(column), pa.large_string())
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(batches, column: str, limit: int = CHUNK_BYTES):
    """Slices of the record batches holding about ``limit`` bytes of ``column`` each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
        pa.default_memory_pool().release_unused()


def per_text(function, kind: pa.DataType, *also):
    """Iterator function over (text, ...) columns: ``function`` maps chunks of them, as Arrow
    arrays, to an array or list of one result per text.  Only these columns and the results
    pass between Spark and the task."""
    def run(batches):
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            batch = pa.RecordBatch.from_arrays(list(columns), ["text", *also])
            out = [pa.array(function(*part.columns), kind) for part in chunks([batch], "text")]
            yield pa.concat_arrays(out) if out else pa.array([], kind)
    return run


class Words:
    """Words of the texts of one chunk: ``hash`` (uint64), ``start``/``end`` (bytes), ``doc``
    (row of the chunk) and ``first`` (index of each row's first word, length rows + 1)."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        n = len(data)
        low = LOWER[data]
        inside = WORD[low]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        p, q = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODE[low] * p[:n], out=total[1:])
        raw = (total[self.end] - total[self.start]) * q[self.start]
        self.hash = mix64(raw + (self.end - self.start).astype(np.uint64))
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.count)
        self.data, self.offsets = low, offsets

    def __len__(self):
        return len(self.hash)

    def shingles(self, width: int):
        """(hash, first): the hashes of each row's runs of ``width`` words, in order; a row
        with fewer words, but not none, has the one run of all its words."""
        n, h = len(self.hash), self.hash
        runs = np.where(self.count >= width, self.count - width + 1, (self.count > 0).astype(self.count.dtype))
        first = np.concatenate(([0], np.cumsum(runs)))
        at = np.arange(first[-1]) - np.repeat(first[:-1], runs) + np.repeat(self.first[:-1], runs)
        size = np.repeat(np.minimum(self.count, width), runs)
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            there = size > k
            word = h[np.minimum(at + k, n - 1)] if n else h
            out = np.where(there, mix64(out * np.uint64(_BASE) + word + np.uint64(k + 1)), out)
        return out, first

    def digests(self):
        """Two uint64 per row that agree for the same sequence of words."""
        place = (np.arange(len(self.hash)) - self.first[:-1][self.doc]).astype(np.uint64) if len(self.hash) else self.hash
        out = []
        for seed in (0x243F6A8885A308D3, 0x13198A2E03707344):
            term = mix64(self.hash + mix64(place + np.uint64(seed)))
            total = np.zeros(len(term) + 1, np.uint64)
            np.cumsum(term, out=total[1:])
            out.append(mix64(total[self.first[1:]] - total[self.first[:-1]] + self.count.astype(np.uint64)))
        return out
