"""Alignment of two tokenizers' ids over the bytes of the same texts.

A text with a blank before it is encoded by tokenizer A (byte-level BPE) and by tokenizer B
(SentencePiece, which adds that blank itself).  The rest is Arrow, one part of the texts
at a time:

* the ids are list columns, flattened beside their parent indices; the running sum of the
  token widths less the sum before the text's first token (a segmented cumulative sum) is
  where a token ends, and with the text's place in the part it is a *document-end key*;
* a full outer Acero hash join of both tokenizers on that key, in key order, has one row per
  stretch of bytes between two neighbouring ends: ids missing on one side are filled
  backwards, so every row is one link, and a row with both sides closes a group;
* ``Table.group_by`` counts the links of each text per id pair, and the texts per id pair of
  a part; Spark adds the partial counts up.

Counts of a pair are looked up in a broadcast table of the most frequent pairs (TABLE_PAIRS
at most, by summed numbers per count); links of other pairs meet their counts in a Spark join.
The largest count per A id is a broadcast of at most one row per id of the vocabulary.

Defined results: texts that are null, empty, or whose A or B tokens do not give back their
bytes (such as those holding U+2581) have no tokens: all counts 0 and '' for the groups.
Rows are separate documents, also when a doc_id repeats or is null; other columns are
dropped; an empty table stays empty.
"""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from revlens.llm import piece_codec, textbatch
from revlens.llm.chunk_table import Segmenter, break_after_word, known_table, no_break
from revlens.llm.store import stored

MODEL_A = "/opt/tokenizers/byte_bpe_50k.json"
MODEL_B = piece_codec.MODEL
TABLE_PAIRS = 1 << 20    # of the broadcast counts, 17 bytes each
PART_BYTES = 1 << 19     # of text aligned at once
PART_PAIRS = 1 << 19     # of the stored pairs read at once
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


# ---------------------------------------------------------------- tokenizers
def byte_level(model: bytes):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.encode_special_tokens = True  # their strings inside texts are plain text
    return tokenizer


def splits_words(model: bytes) -> bool:
    """Whether tokenizer A never joins a word with white space behind it: byte-level BPE with
    the usual word pattern, nothing normalised and nothing added."""
    rules = json.loads(model)
    pre = rules.get("pre_tokenizer") or {}
    return (rules.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
            and not rules["model"].get("ignore_merges"))


def byte_alphabet() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: visible Latin-1 characters stand
    for themselves, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_bytes(model_a: bytes, model_b: bytes) -> tuple[pa.Array, pa.Array]:
    """The bytes of every id of A and of B."""
    letters, a, sp = byte_alphabet(), byte_level(model_a), piece_codec.processor(model_b)
    names = [a.id_to_token(i) or "" for i in range(a.get_vocab_size())]
    of_a = [bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t in names]
    of_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(piece_codec.MARK, " ").encode()
            for i in range(sp.vocab_size())]
    return pa.array(of_a, pa.large_binary()), pa.array(of_b, pa.large_binary())


def opened(model_a: bytes, model_b: bytes, breaks):
    """The segment functions of both tokenizers, inside a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    a = byte_level(model_a)
    return [lambda chunks: [e.ids for e in a.encode_batch_fast(chunks, add_special_tokens=False)], piece_codec.opened(model_b, breaks)]


# ---------------------------------------------------------------- one part
class Side:
    """One tokenizer's ids of the texts of a part: ``doc`` and ``end`` per id, ``fits`` per text."""

    def __init__(self, ids, offsets, values: pa.Array, texts: list[bytes]):
        lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(ids, pa.int32()))
        self.ids, self.doc = pc.list_flatten(lists), pc.list_parent_indices(lists)
        running = np.concatenate(([0], pc.cumulative_sum(pc.cast(pc.take(pc.binary_length(values), self.ids), pa.int64())).to_numpy()))
        before = running[offsets[:-1]]
        self.end = pc.subtract(pa.array(running[1:]), pc.take(pa.array(before), self.doc))
        joined = pc.take(values, self.ids)
        data = joined.buffers()[2]
        data = memoryview(data).cast("B") if data is not None else b""
        self.fits = np.fromiter((data[x:y] == t for x, y, t in zip(before, running[offsets[1:]], texts)), bool, len(texts))

    def table(self, name: str, fits, starts) -> pa.Table:
        """(key, id) of the texts that fit; the key is the text's place in the part and the end."""
        rows = pa.table({"key": pc.add(self.end, pc.take(pa.array(starts), self.doc)), name: self.ids})
        return rows if fits.all() else rows.filter(pc.take(pa.array(fits), self.doc))


def numerals(size: int) -> pa.Array:
    """The ids 0..size-1 in decimal, followed by ',', then all again by '|' and by ';'."""
    plain = pc.cast(pa.array(np.arange(size)), pa.large_string())
    return pa.concat_arrays([pc.binary_join_element_wise(plain, pa.scalar(sign, pa.large_string()), pa.scalar("", pa.large_string())) for sign in ",|;"])


def aligned(texts: list[bytes], a: Side, b: Side, words: pa.Array):
    """Links of the texts of a part: (counts per text by name, groups per text as bytes, and a table
    (doc, pair, times) in order; a pair is its A id * 2**32 + its B id)."""
    fits = a.fits & b.fits & np.fromiter(map(bool, texts), bool, len(texts))
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    stops = np.cumsum(sizes)
    both = a.table("a", fits, stops - sizes).join(b.table("b", fits, stops - sizes), keys="key", join_type="full outer", use_threads=False)
    both = both.combine_chunks().sort_by("key")
    doc = np.searchsorted(stops, both["key"].to_numpy())  # keys of a text are above the bytes before it
    has_a, has_b = (both[x].is_valid().to_numpy() for x in ("a", "b"))
    close = has_a & has_b
    ids_a, ids_b = both["a"].combine_chunks(), both["b"].combine_chunks()
    n = len(texts)
    counts = {"n_a": np.bincount(doc[has_a], minlength=n), "n_b": np.bincount(doc[has_b], minlength=n),
              "n_groups": np.bincount(doc[close], minlength=n), "n_links": np.bincount(doc, minlength=n)}
    pair = pc.add(pc.shift_left(pc.cast(pc.fill_null_backward(ids_a), pa.int64()), 32), pc.cast(pc.fill_null_backward(ids_b), pa.int64()))
    pairs = pa.table({"doc": doc, "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")])
    pairs = pairs.rename_columns(["doc", "pair", "times"]).combine_chunks().sort_by([("doc", "ascending"), ("pair", "ascending")])

    # Groups in decimal: every id takes its place behind the ids of its group that come before.
    group = np.cumsum(close) - close
    group_a, group_b = group[has_a], group[has_b]
    many = int(close.sum())
    before_a = np.concatenate(([0], np.cumsum(np.bincount(group_a, minlength=many))))
    before_b = np.concatenate(([0], np.cumsum(np.bincount(group_b, minlength=many))))
    place_a = np.arange(len(group_a)) + before_b[group_a]
    place_b = np.arange(len(group_b)) + before_a[group_b + 1]
    size = len(words) // 3
    code = np.empty(len(group_a) + len(group_b), np.int64)
    code[place_a] = ids_a.drop_null().to_numpy() + size * close[has_a]
    code[place_b] = ids_b.drop_null().to_numpy() + 2 * size * close[has_b]
    written = pc.take(words, pa.array(code))
    data = memoryview(written.buffers()[2] or b"")
    starts = np.concatenate(([0], np.cumsum(pc.binary_length(written).to_numpy())))[np.concatenate(([0], np.cumsum(counts["n_a"] + counts["n_b"])))]
    groups = [data[x:max(x, y - 1)] for x, y in zip(starts[:-1], starts[1:])]  # without the last ';'
    return counts, groups, pairs


# ---------------------------------------------------------------- stored pairs
def pack(pair, times) -> bytes:
    """Sorted pairs and their times, compressed: differences of A ids, B ids, times."""
    a, b = pair >> 32, pair & 0xFFFFFFFF
    return pa.compress(b"".join(x.astype("<u4").tobytes() for x in (np.diff(a, prepend=0), b, times)), "zstd", asbytes=True)


def unpack(blob: bytes, n: int):
    step, b, times = np.frombuffer(pa.decompress(blob, 12 * n, "zstd"), "<u4").reshape(3, n).astype(np.int64)
    return (np.cumsum(step) << 32) + b, times


def opened_pairs(batches):
    """(slice of a batch, pair, times, offsets) of about PART_PAIRS pairs each."""
    for batch in batches:
        sizes = batch.column("n_pairs").to_numpy()
        total, at = np.concatenate(([0], np.cumsum(sizes))), 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, total[at] + PART_PAIRS, "right")) - 1)
            part = batch.slice(at, to - at)
            each = [unpack(blob, n) for blob, n in zip(part.column("pairs").to_pylist(), sizes[at:to])]
            yield part, np.concatenate([x for x, _ in each]), np.concatenate([x for _, x in each]), total[at:to + 1] - total[at]
            at = to


# ---------------------------------------------------------------- operators
def tokens_aligned(docs: DataFrame, text: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B, groups: bool = False) -> DataFrame:
    """(_row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_pairs, pairs) of every text, and with
    ``groups`` the groups themselves (`a1,a2|b1;a3|b2,b3`); ``pairs`` are the packed id pairs."""
    with open(model_a, "rb") as f, open(model_b, "rb") as g:
        models = f.read(), g.read()
    breaks = break_after_word if splits_words(models[0]) and piece_codec.splits(piece_codec.processor(models[1])) else no_break
    plain = F.coalesce(F.col(text).cast("string"), F.lit(""))
    usable = (plain != "") & ~F.contains(plain, F.lit(piece_codec.MARK))  # B gives the mark back as a blank
    texts = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.when(usable, F.concat(F.lit(" "), plain)).otherwise("").alias("spaced"))
    known = known_table(texts.select("spaced"), breaks, lambda: opened(*models, breaks), 2) if breaks is not no_break else None
    shared = docs.sparkSession.sparkContext.broadcast((models, known, token_bytes(*models)))

    def run(batches):
        models, known, values = shared.value
        ids_of = Segmenter(opened(*models, breaks), breaks, known)
        words = numerals(max(map(len, values)))
        for part in textbatch.chunks(batches, "spaced", PART_BYTES):
            each = [t.encode() for t in part.column("spaced").to_pylist()]
            sides = [Side(*coded, v, each) for coded, v in zip(ids_of(part.column("spaced")), values)]
            counts, written, pairs = aligned(each, *sides, words)
            pair, times = pairs["pair"].to_numpy(), pairs["times"].to_numpy()
            edges = np.searchsorted(pairs["doc"].to_numpy(), np.arange(len(each) + 1))
            out = [part.column("_row"), part.column("doc_id"), *(pa.array(counts[c]) for c in COUNTS),
                   pa.array([hashlib.sha256(g).hexdigest() if len(g) else "" for g in written], pa.string()), pa.array(np.diff(edges)),
                   pa.array([pack(pair[x:y], times[x:y]) for x, y in zip(edges[:-1], edges[1:])], pa.binary())]
            yield pa.RecordBatch.from_arrays(out + [pa.array([bytes(g).decode() for g in written], pa.string())] * groups, names)
            pa.default_memory_pool().release_unused()
    names = ["_row", "doc_id", *COUNTS, "groups_sha256", "n_pairs", "pairs"] + ["groups"] * groups
    kinds = ["long", texts.schema["doc_id"].dataType.simpleString(), *["long"] * 4, "string", "long", "binary"] + ["string"] * groups
    return texts.mapInArrow(run, ", ".join(map(" ".join, zip(names, kinds))))


def pair_counts(links: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents each id pair is linked, and whether that is the
    highest count of its A id."""
    def partial(batches):
        for _, pair, _, _ in opened_pairs(batches):
            found = pa.table({"pair": pair}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            yield from found.rename_columns(["pair", "n"]).to_batches()
    counts = links.select("n_pairs", "pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stored(counts, "pair-counts").withColumn("_a", F.shiftright("pair", 32))
    highest = counts.groupBy("_a").agg(F.max("n").alias("_most"))  # a row per id of A's vocabulary
    return counts.join(F.broadcast(highest), "_a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))


def least_known(counts: DataFrame, limit: int) -> int:
    """The smallest power of two such that at most ``limit`` pairs have that count or more."""
    power = F.floor(F.log2("n")).cast("int").alias("power")
    sizes = {r["power"]: r["n"] for r in counts.groupBy(power).agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 63 rows
    total, least = 0, 1 << 62
    for p in sorted(sizes, reverse=True):
        total += sizes[p]
        if total > limit:
            break
        least = 1 << p
    return least


def align(docs: DataFrame, text: str = "text", model_a: str = MODEL_A, model_b: str = MODEL_B, limit: int = TABLE_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    links = stored(tokens_aligned(docs, text, model_a, model_b), "links")
    counts = stored(pair_counts(links), "pair-best")
    least = least_known(counts, limit)
    head = counts.where(F.col("n") >= least).orderBy("pair").toArrow()  # at most ``limit`` rows
    shared = docs.sparkSession.sparkContext.broadcast(tuple(head.column(c).to_numpy() for c in ("pair", "n", "best")))

    def summed(batches):
        known, number, best = shared.value
        for part, pair, times, offsets in opened_pairs(batches):
            place = np.searchsorted(known, pair)
            place[place == len(known)] = 0
            met = known[place] == pair if len(known) else np.zeros(len(pair), bool)
            n = np.where(met, number[place], 0) if len(known) else np.zeros(len(pair), np.int64)
            total = np.concatenate(([0], np.cumsum(n * times)))
            top = np.concatenate(([0], np.cumsum(np.where(met, best[place], False) * times if len(known) else n)))
            rest = np.concatenate(([0], np.cumsum(~met)))[offsets]
            lists = [pa.ListArray.from_arrays(pa.array(rest, pa.int32()), pa.array(x[~met], pa.int64())) for x in (pair, times)]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(np.diff(top[offsets])), pa.array(np.diff(total[offsets])), *lists],
                                             [*kept, "n_best", "count_sum", "rest", "times"])
    kept = ["_row", "doc_id", *COUNTS, "groups_sha256"]
    kinds = [links.schema[c].dataType.simpleString() for c in kept]
    scored = stored(links.mapInArrow(summed, ", ".join(map(" ".join, zip([*kept, "n_best", "count_sum", "rest", "times"],
                                                                         [*kinds, "long", "long", "array<long>", "array<long>"])))), "links-scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("rest", "times")).alias("r")).select("_row", F.col("r.rest").alias("pair"), F.col("r.times").alias("times"))
    more = (rare.join(counts.where(F.col("n") < least), "pair").groupBy("_row")
            .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("n") * F.col("times")).alias("_sum")))
    add = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return scored.join(more, "_row", "left").select("doc_id", *COUNTS, add("n_best", "_best"), add("count_sum", "_sum"), "groups_sha256")
