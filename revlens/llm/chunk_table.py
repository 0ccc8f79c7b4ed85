"""Texts cut into chunks that a tokenizer segments independently, each distinct chunk once.

A chunk is a run of spaces with the word behind it, or a line feed with what follows it up
to the next space or line feed.  The distinct chunks of a corpus are counted in Spark
(pre-aggregated per batch); the frequent ones are segmented once and broadcast (TABLE_BYTES at
most, proven by summed sizes per count); the ids are joined back by position.  Chunks beyond
that bound are segmented once per batch that holds them, so no result depends on the bound.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, functions as F

from revlens.llm import textbatch
from revlens.llm.store import stored

SPACE, FEED = 32, 10
TABLE_BYTES = 16 << 20   # of the broadcast table: chunk bytes, ids and ENTRY_BYTES an entry
ENTRY_BYTES = 32
PART_BYTES = 2 << 20     # of text whose distinct chunks are handled at once


def every_break(data):
    """True where a chunk may start: a space after anything else, or a line feed."""
    before = np.concatenate(([0], data[:-1]))
    return ((data == SPACE) & (before != SPACE)) | (data == FEED)


def break_after_word(data):
    """True for a space or line feed right behind a character that is surely not white space:
    visible ASCII or a character of two bytes led by C3 to DF."""
    one = np.concatenate(([0], data[:-1]))
    two = np.concatenate(([0, 0], data[:-2]))[:len(data)]
    word = ((one > 32) & (one < 127)) | ((one >= 128) & (one < 192) & (two >= 0xC3) & (two < 0xE0))
    return ((data == SPACE) | (data == FEED)) & word


def no_break(data):
    """Whole texts are the chunks."""
    return np.zeros(len(data), bool)


def chunk_column(texts: pa.Array, breaks):
    """(chunks, first): the chunks of all texts as one string column that shares their bytes,
    and the index of each text's first chunk (length texts + 1).  Empty texts have none."""
    data, offsets = textbatch.buffers(texts)
    start = breaks(data)
    start[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at = np.flatnonzero(start).astype(np.int64)
    ends = np.append(at, len(data)).astype(np.int64)
    column = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
    return column, np.searchsorted(at, offsets)


def gather(flat, starts, counts):
    """The runs flat[starts[i]:starts[i] + counts[i]] one after the other."""
    total = np.cumsum(counts)
    if not len(total) or not total[-1]:
        return flat[:0]
    return flat[np.repeat(starts - (total - counts), counts) + np.arange(total[-1])]


class Segmenter:
    """Ids of texts by one or more tokenizers: each of ``segments`` maps distinct chunks
    (strings) to their lists of ids; ``known`` (chunks, [(offsets, ids) per tokenizer]) holds
    chunks segmented beforehand."""

    def __init__(self, segments, breaks, known=None):
        self.segments, self.breaks, self.known = segments, breaks, known

    def __call__(self, texts: pa.Array):
        """[(ids, offsets) per tokenizer]: the ids of all texts, and where each text's begin
        (length texts + 1)."""
        chunks, first = chunk_column(texts, self.breaks)
        coded = chunks.dictionary_encode()
        distinct, each = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        place, tables = np.full(len(distinct), -1), [(np.zeros(1, np.int64), np.zeros(0, np.int32))] * len(self.segments)
        if self.known is not None:
            place, tables = pc.index_in(distinct, value_set=self.known[0]).fill_null(-1).to_numpy(), self.known[1]
        new = np.flatnonzero(place < 0)
        words = distinct.take(pa.array(new)).to_pylist()
        out = []
        for segment, (offsets, ids) in zip(self.segments, tables):
            offsets = np.append(offsets, offsets[-1])  # an empty run for what is not known
            starts, counts = offsets[:-1][place], np.diff(offsets)[place]
            if words:
                lists = segment(words)
                sizes = np.fromiter(map(len, lists), np.int64, len(lists))
                starts[new], counts[new] = len(ids) + np.cumsum(sizes) - sizes, sizes
                ids = np.concatenate((ids, np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))))
            out.append((gather(ids, starts[each], counts[each]), np.concatenate(([0], np.cumsum(counts[each])))[first]))
        return out


def chunk_counts(texts: DataFrame, breaks) -> DataFrame:
    """(chunk, n): the distinct chunks of the one column of all rows."""
    name = texts.columns[0]

    def counted(batches):
        for part in textbatch.chunks(batches, name, PART_BYTES):
            found = pc.value_counts(chunk_column(part.column(0), breaks)[0])
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["chunk", "n"])
            pa.default_memory_pool().release_unused()
    return texts.mapInArrow(counted, "chunk string, n long").groupBy("chunk").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, tokenizers: int, limit: int) -> DataFrame:
    """Chunks met at least 2**k times, for the smallest k at which they, their ids (one per byte
    at most, 4 bytes each) and ENTRY_BYTES an entry are within ``limit`` bytes."""
    cost = F.octet_length("chunk") * (1 + 4 * tokenizers) + ENTRY_BYTES
    counts = counts.withColumn("power", F.floor(F.log2("n")).cast("int")).withColumn("cost", cost)
    sizes = {r["power"]: r["cost"] for r in counts.groupBy("power").agg(F.sum("cost").alias("cost")).collect()}  # at most 63 rows
    total, least = 0, 64
    for power in sorted(sizes, reverse=True):
        total += sizes[power]
        if total > limit:
            break
        least = power
    return counts.where(F.col("power") >= least).select("chunk")


def known_table(texts: DataFrame, breaks, opened, tokenizers: int, limit: int = TABLE_BYTES):
    """The frequent chunks of the one column of ``texts``, each segmented once by a Spark task:
    (chunks, [(offsets, ids) per tokenizer]), at most ``limit`` bytes.  ``opened()`` gives the
    segment functions inside a task."""
    def segmented(batches):
        segments = opened()
        for batch in batches:
            words = batch.column(0).to_pylist()
            lists = [pa.array(segment(words), pa.list_(pa.int32())) for segment in segments]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names)
    names = ["chunk", *(f"ids{i}" for i in range(tokenizers))]
    counts = stored(chunk_counts(texts, breaks), "chunk-counts")
    rows = frequent(counts, tokenizers, limit).mapInArrow(segmented, ", ".join(["chunk string", *(f"{x} array<int>" for x in names[1:])])).toArrow()
    lists = [rows.column(x).combine_chunks() for x in names[1:]]
    if not rows.num_rows:
        return None
    return rows.column("chunk").combine_chunks().cast(pa.large_string()), [(x.offsets.to_numpy().astype(np.int64), x.flatten().to_numpy()) for x in lists]
