"""Benchmark decontamination with suffix arrays over the training texts.

Training texts are cut into shards of about textbatch.CHUNK_BYTES (one task handles many
shards, one after the other).  Each shard gets a suffix array over its words: positions
sorted by the words that follow them, as far as the longest benchmark item reaches.  Every
benchmark suffix is binary-searched in it, which gives the interval of all places where
its window stands; at each place the match is then followed word by word to its full
length.  Benchmark items are handed to the tasks in blocks of at most ITEM_BYTES of text,
so what is broadcast is bounded; further blocks are further passes over the same rows.

A window is ``WINDOW`` consecutive words of an item, or the whole of a shorter item that
has words.  A document is contaminated if at least one of its words lies in an occurrence
of a window and these words are at least 1/20 of its words.

Defined results: null and empty texts have no words and are clean.  Items without id or
without words have no windows; repeated items count once (by id).  Rows are handled one by
one, so repeated rows give repeated results and no row is lost; a null doc_id is kept.  An
empty benchmark leaves everything clean.  Extra columns, whatever their names, travel in a
struct and come back unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm import textbatch
from revlens.llm.store import stored

WINDOW = 13
SHARE = 20               # contaminated: SHARE * n_hit >= n_words
ITEM_BYTES = 8 << 20     # benchmark text per block
BLOCKS_AT_ONCE = 4       # blocks chained before the rows are written


class SuffixArray:
    """Sorted word suffixes of the rows of one chunk; order is exact for ``reach`` words."""

    def __init__(self, words: textbatch.Words, reach: int):
        docs = len(words.count)
        self.names, ids = np.unique(words.hash, return_inverse=True)
        self.base = docs + 1  # ids below it end the rows, so that no match crosses them
        n = len(ids) + docs
        self.text = np.empty(n, np.int64)
        at = np.arange(len(ids)) + words.doc
        self.text[at] = ids + self.base
        ends = words.first[1:] + np.arange(docs)
        self.text[ends] = np.arange(docs) + 1
        self.doc = np.empty(n, np.int64)
        self.doc[at], self.doc[ends] = words.doc, np.arange(docs)
        self.bits = max(1, int(self.base + len(self.names)).bit_length())
        self.step = max(1, 62 // self.bits)
        self.packed = self._pack()
        self.order = np.argsort(self.packed, kind="stable")
        self._refine(reach)
        self.first_keys = self.packed[self.order]

    def _pack(self):
        """``step`` words from each place on as one integer that sorts like them."""
        padded = np.concatenate((self.text, np.zeros(self.step, np.int64)))
        key = np.zeros(len(self.text), np.int64)
        for k in range(self.step):
            key = (key << self.bits) | padded[k:k + len(self.text)]
        return key

    def _refine(self, reach: int):
        """Prefix doubling over the places that are still tied."""
        n = len(self.text)
        key = self.packed[self.order]
        fresh = np.ones(n, bool)
        fresh[1:] = key[1:] != key[:-1]
        rank = np.empty(n, np.int64)
        rank[self.order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        known = self.step
        while known < reach:
            last = np.append(fresh[1:], True)
            slots = np.flatnonzero(~(fresh & last))
            if not len(slots):
                break
            places = self.order[slots]
            after = places + known
            follow = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            head = rank[places]
            again = np.lexsort((follow, head))
            places, head, follow = places[again], head[again], follow[again]
            self.order[slots] = places
            new = np.ones(len(slots), bool)
            new[1:] = (head[1:] != head[:-1]) | (follow[1:] != follow[:-1])
            rank[places] = np.maximum.accumulate(np.where(new, slots, 0))
            fresh[slots] = new
            known *= 2

    def _bound(self, lo, hi, depth, value, right: bool):
        """Vectorised binary search in order[lo:hi] for ``value`` among the packed words that
        start ``depth`` words into the suffixes."""
        lo, hi, top = lo.copy(), hi.copy(), len(self.text) - 1
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) >> 1
            key = self.packed[np.minimum(self.order[mid] + depth, top)]
            below = key <= value[open_] if right else key < value[open_]
            lo[open_] = np.where(below, mid + 1, lo[open_])
            hi[open_] = np.where(below, hi[open_], mid)

    def find(self, ids, start, length):
        """(lo, hi): the interval of suffixes that begin with ids[start:start + length], for
        each of the queries; ids are those of ``lookup``."""
        lo, hi = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        depth = 0
        while True:
            live = np.flatnonzero((lo < hi) & (length > depth))
            if not len(live):
                return lo, hi
            low, high = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            bad = np.zeros(len(live), bool)
            for k in range(self.step):
                inside = length[live] > depth + k
                word = ids[np.minimum(start[live] + depth + k, len(ids) - 1)]
                bad |= inside & (word < 0)
                low = (low << self.bits) | np.where(inside, word, 0)
                high = (high << self.bits) | np.where(inside, word, (1 << self.bits) - 1)
            if depth == 0:
                a, b = np.searchsorted(self.first_keys, low, "left"), np.searchsorted(self.first_keys, high, "right")
            else:
                a = self._bound(lo[live], hi[live], depth, low, False)
                b = self._bound(a, hi[live], depth, high, True)
            lo[live], hi[live] = np.where(bad, 0, a), np.where(bad, 0, b)
            depth += self.step

    def lookup(self, hashes):
        """Ids of the shard's words with these hashes, -1 where it has none."""
        if not len(self.names):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, at + self.base, -1)


class Items:
    """Windows of one block of benchmark items."""

    def __init__(self, rows):
        self.ids = [r[0] for r in rows]
        words = textbatch.Words(pa.array([r[1] for r in rows], pa.string()))
        self.words = words.hash
        size = np.minimum(words.count, WINDOW)
        windows = np.where(words.count > 0, words.count - size + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), windows)
        self.start = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(words.first[:-1], windows)
        self.length = np.repeat(size, windows)
        self.end = np.repeat(words.first[1:], windows)
        self.reach = int(words.count.max(initial=0))

    def occurrences(self, words: textbatch.Words):
        """Arrays (doc, word, window, length): every place where a window stands, with the
        length of the longest verbatim match that starts there."""
        none = np.zeros(0, np.int64)
        if not len(words) or not len(self.start):
            return none, none, none, none
        array = SuffixArray(words, self.reach)
        ids = array.lookup(self.words)
        lo, hi = array.find(ids, self.start, self.length)
        many = np.maximum(hi - lo, 0)
        window = np.repeat(np.arange(len(many)), many)
        place = array.order[np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)]
        length = self.length[window]
        live = np.arange(len(window))
        while len(live):
            a, b = self.start[window[live]] + length[live], place[live] + length[live]
            ok = (a < self.end[window[live]]) & (b < len(array.text))
            live = live[ok]
            same = ids[a[ok]] == array.text[b[ok]]
            live = live[same]
            length[live] += 1
        return array.doc[place], place - array.doc[place], window, length


_FOUND = "struct<n_words:bigint,n_hit:bigint,hit:binary,items:array<string>,longest:bigint,longest_at:bigint,longest_item:string>"
_FOUND_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit", pa.binary()), ("items", pa.list_(pa.string())),
                          ("longest", pa.int64()), ("longest_at", pa.int64()), ("longest_item", pa.string())])
_NOTHING = {"hit": None, "items": [], "longest": 0, "longest_at": None, "longest_item": None}


def searcher(items: Items):
    """Function of (texts, what blocks before have found) to what is found now, as rows."""
    def run(texts, before=None):
        words = textbatch.Words(texts)
        doc, word, window, length = items.occurrences(words)
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, word, 1)
        np.add.at(marks, word + items.length[window], -1)
        hit = np.cumsum(marks)[:-1] > 0
        found, best = {}, {}
        for d, i in set(zip(doc.tolist(), items.item[window].tolist())):
            found.setdefault(d, set()).add(items.ids[i])
        for at in np.lexsort((word, -length, doc)):
            best.setdefault(int(doc[at]), (int(length[at]), int(word[at] - words.first[doc[at]]), items.ids[items.item[window[at]]]))
        rows = []
        for i, old in enumerate(before.to_pylist() if before is not None else [_NOTHING] * len(texts)):
            bits = hit[words.first[i]:words.first[i + 1]]
            if old["hit"] is not None:
                bits = bits | np.unpackbits(np.frombuffer(old["hit"], np.uint8), count=len(bits)).astype(bool)
            top = max((best.get(i, (0, None, None)), (old["longest"], old["longest_at"], old["longest_item"])), key=lambda x: x[0])
            some = bool(bits.any())
            rows.append({"n_words": len(bits), "n_hit": int(bits.sum()), "hit": np.packbits(bits).tobytes() if some else None,
                         "items": sorted(found.get(i, set()) | set(old["items"])), "longest": top[0], "longest_at": top[1], "longest_item": top[2]})
        return rows
    return run


def _first_block(items: Items):
    run = textbatch.per_text(searcher(items), _FOUND_ARROW)

    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)
    return F.arrow_udf(search, _FOUND).asNondeterministic()  # evaluated once per row


def _next_block(items: Items):
    run = textbatch.per_text(searcher(items), _FOUND_ARROW, "found")

    def search(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return run(batches)
    return F.arrow_udf(search, _FOUND).asNondeterministic()


def find_benchmark(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(row, found): every row of ``docs`` as a struct, with what was found in its text:
    n_words, n_hit, items (ids of items with occurring windows), longest (words of the
    longest verbatim match), longest_at (its first word) and longest_item."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item is not null and length(text) > 0")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // ITEM_BYTES))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    out = docs.select(F.struct("*").alias("row"))
    text = F.col("row.text").cast("string")
    for b in range(blocks):
        some = Items(sorted((r.item, r.text) for r in dealt.where(F.col("block") == b).collect()))
        out = out.withColumn("found", _next_block(some)(text, F.col("found")) if b else _first_block(some)(text))
        if b % BLOCKS_AT_ONCE == BLOCKS_AT_ONCE - 1 and b + 1 < blocks:
            out = stored(out, "searched")
    return out


def contaminated(found: str = "found"):
    """The contract's rule on a ``found`` column."""
    return (F.col(f"{found}.n_hit") > 0) & (F.lit(SHARE) * F.col(f"{found}.n_hit") >= F.col(f"{found}.n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without its contaminated rows; all columns as they were."""
    return find_benchmark(docs, benchmark).where(~contaminated()).select("row.*")


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, digest of the item ids, verdict, longest match."""
    found = find_benchmark(docs.select("doc_id", "text"), benchmark)
    items = F.array_sort(F.array_distinct("found.items"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "found.n_words", "found.n_hit", F.size(items).cast("long").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
                        F.col("found.longest").alias("longest_match"), F.col("found.longest_at").alias("longest_at"),
                        F.col("found.longest_item").alias("longest_item"))
