"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

Each text is the set of its runs of five words (textbatch.Words; a text of one to four
words is one run).  Texts with the same words are collapsed first, so copies cost one
aggregate row.  A signature of TREES x depth min-hashes places every remaining text in
TREES prefix tries, which are built by sorting the rows of a trie node by their
remaining prefix.  Two texts meet when they share a prefix of the present length in any
trie; the meeting is verified exactly on the whole sets of runs.

*Prefix length.*  The search starts with full-length prefixes.  A pair of Jaccard value J
is met with probability ``1 - (1 - J**k)**TREES``, which grows with J.  While a pair at
the threshold itself would be met less often than the target recall, prefixes get one
hash shorter and only meetings that are new at this length are verified.  The length does
not depend on the table, so neither its size nor a hot group ends the search early.  A recall
that prefixes of one hash would still miss is an error.

*Hot nodes.*  A node with more than BLOCK texts is dealt over pairs of blocks, so no task
holds more than two blocks.  Pairs are counted inside the tasks, never emitted: a task
returns, for each of its texts, the number of links and one root, so the rows that leave
it follow the texts and not their square.

Defined results: null, empty and wordless texts have no runs, hence no links, and each is
its own class.  A repeated doc_id gives one row; if its rows hold unlike texts, all of them
count: text_id is that of its first text, n_links adds up the links of its texts, and they
are one class.  (Texts beyond the first go by a hash of doc_id and digest from 2**62 on in
place of the doc_id; doc_ids are taken to be smaller.)  A null doc_id takes no part.
Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from revlens.llm import textbatch
from revlens.llm.graph import components
from revlens.llm.membership import among, outside
from revlens.llm.store import stored

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
DEPTH = 5          # hashes of a full prefix
RECALL = 0.9999
BLOCK = 512
BEYOND = 1 << 62   # ids of further texts of a document
SALTS = 32         # keys over which the copies of one text are joined

_MULT = textbatch.mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_XOR = textbatch.mix64(_MULT)


def met(jaccard, depth: int):
    """Probability that a pair of this Jaccard value shares a prefix of ``depth`` in any trie."""
    return 1.0 - (1.0 - np.asarray(jaccard, float) ** depth) ** TREES


def _signatures(batches):
    for part in textbatch.chunks(batches, "text"):
        words = textbatch.Words(part.column("text"))
        runs, first = words.shingles(SHINGLE)
        there = np.flatnonzero(np.diff(first))
        sig = np.zeros((len(there), TREES * DEPTH), np.uint32)
        for j in range(TREES * DEPTH if len(there) else 0):
            sig[:, j] = np.minimum.reduceat((runs ^ _XOR[j]) * _MULT[j], first[:-1][there]) >> np.uint64(32)
        h1, h2 = (d[there].astype(np.int64) for d in words.digests())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id").take(pa.array(there)), pa.array(h1), pa.array(h2), pa.array([s.tobytes() for s in sig], pa.binary())],
            ["doc_id", "h1", "h2", "sig"])


def _with_digests(batches):
    for part in textbatch.chunks(batches, "text"):
        h1, h2 = (pa.array(d.astype(np.int64)) for d in textbatch.Words(part.column("text")).digests())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), h1, h2], ["doc_id", "text", "h1", "h2"])


def _keys(sig, depth: int):
    """(rows, TREES) uint64: the prefix of ``depth`` hashes in every trie."""
    out = np.zeros((len(sig), TREES), np.uint64)
    for k in range(depth):
        out = textbatch.mix64(out * np.uint64(31) + sig[:, k::DEPTH].astype(np.uint64) + np.uint64(k + 1))
    return out + np.arange(TREES, dtype=np.uint64)


def _signature_rows(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), TREES * DEPTH)


def _prefixes(depth: int):
    def run(batches):
        for batch in batches:
            keys = _keys(_signature_rows(batch.column("sig")), depth)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column("text_id").to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(keys))),
                 pa.array(keys.ravel().astype(np.int64))], ["text_id", "tree", "node"])
    return run


def _runs_of(batches, keys=("tree", "node", "bi", "bj")):
    """Tables with all rows of one (tree, node, bi, bj), from batches sorted by it."""
    held = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        if held and any(held[-1].column(k)[-1].as_py() != c[0] for k, c in zip(keys, cols)):
            change = np.concatenate(([0], change))
        at = 0
        for to in change:
            if to > at:
                held.append(batch.slice(at, to - at))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, at = [], to
        held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _owned(table, depth: int, before: int):
    """Pairs of this node, (row, row), that meet here first: the pair shares no prefix of
    ``depth`` in an earlier trie, and none of ``before`` (verified already) in any."""
    tree = table.column("tree")[0].as_py()
    bi, bj = table.column("bi")[0].as_py(), table.column("bj")[0].as_py()
    sig = _signature_rows(table.column("sig"))
    keys = _keys(sig, depth)
    n = len(keys)
    block = table.column("block").to_numpy()
    if bi == bj:
        own = np.triu(np.ones((n, n), bool), 1)
    else:
        own = (block[:, None] == bi) & (block[None, :] == bj)
    for t in range(tree):
        own &= keys[:, t][:, None] != keys[:, t][None, :]
    if before:
        old = _keys(sig, before)
        for t in range(TREES):
            own &= old[:, t][:, None] != old[:, t][None, :]
    return own


def _meeting(depth: int, before: int):
    """Texts that have a pair to verify in this node."""
    def run(batches):
        for table in _runs_of(batches):
            own = _owned(table, depth, before)
            rows = np.flatnonzero(own.any(0) | own.any(1))
            if len(rows):
                yield from table.select(["tree", "node", "bi", "bj", "block", "text_id"]).take(pa.array(rows)).to_batches()
    return run


def _verified(depth: int, before: int, threshold: float):
    """For each text of a node with links: their number and one root."""
    def run(batches):
        for table in _runs_of(batches):
            own = _owned(table, depth, before)
            ids = table.column("text_id").to_numpy()
            sets, sizes = [], []
            for part in textbatch.chunks(table.select(["text"]).to_batches(), "text"):
                runs, first = textbatch.Words(part.column("text")).shingles(SHINGLE)
                for a, b in zip(first[:-1], first[1:]):
                    sets.append(np.unique(runs[a:b]))
                    sizes.append(len(sets[-1]))
            sizes = np.array(sizes)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            names, dense = np.unique(np.concatenate(sets), return_inverse=True)
            flag = np.zeros(len(names), np.int32)
            linked = np.zeros(own.shape, bool)
            for i in np.flatnonzero(own.any(1)):
                mine = dense[edges[i]:edges[i + 1]]
                flag[mine] = 1
                js = np.flatnonzero(own[i])
                if len(js) * 4 < len(ids):
                    common = np.array([flag[dense[edges[j]:edges[j + 1]]].sum() for j in js])
                else:
                    common = np.add.reduceat(flag[dense], edges[:-1])[js]
                flag[mine] = 0
                jac = common / (sizes[i] + sizes[js] - common)
                linked[i, js[jac >= threshold]] = True
            both = linked | linked.T
            count = both.sum(1)
            root = ids.copy()
            seen = np.zeros(len(ids), bool)
            for i in np.argsort(ids, kind="stable"):
                if count[i] and not seen[i]:
                    group = front = np.zeros(len(ids), bool)
                    group[i] = True
                    front = group.copy()
                    while front.any():
                        front = both[front].any(0) & ~group
                        group = group | front
                    root[group] = ids[i]
                    seen |= group
            rows = np.flatnonzero(count)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(root[rows]), pa.array(count[rows].astype(np.int64))], ["a", "b", "n"])
    return run


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per doc_id: (doc_id, text_id, class_id, n_links).

    text_id: smallest doc_id with the same words; class_id: smallest doc_id of the linked
    group; n_links: number of other texts (different words) with Jaccard >= threshold.
    """
    if met(threshold, 1) < recall:
        raise ValueError(f"{TREES} tries meet a pair of Jaccard {threshold} with probability {float(met(threshold, 1))} at most")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = stored(docs.mapInArrow(_signatures, "doc_id long, h1 long, h2 long, sig binary"), "signed")
    # doc_ids whose rows hold unlike texts, and the first of these
    edge = lambda f: F.struct(f("h1"), f("h2"))
    unlike = signed.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("first"), edge(F.min).alias("lo"), edge(F.max).alias("hi")).where("lo <> hi").select("doc_id", "first")
    unlike = stored(unlike, "unlike")
    several = not unlike.isEmpty()  # without any, each node is a doc_id
    hashed = F.xxhash64("doc_id", "h1", "h2").bitwiseAND(F.lit(BEYOND - 1)).bitwiseOR(F.lit(BEYOND))
    ident = F.when(F.struct("h1", "h2") == F.col("first"), F.col("doc_id")).otherwise(hashed)
    whole, plain = docs, signed.withColumn("node", F.col("doc_id"))
    if several:
        ids = unlike.select("doc_id")
        more = among(signed, "doc_id", ids).join(unlike, "doc_id").withColumn("node", ident).drop("first")
        plain = stored(outside(signed, "doc_id", ids).withColumn("node", F.col("doc_id")).unionByName(more), "nodes")
        texts = among(docs, "doc_id", ids).mapInArrow(_with_digests, "doc_id long, text string, h1 long, h2 long")
        texts = texts.join(unlike, "doc_id").select(ident.alias("doc_id"), "text")
        whole = outside(docs, "doc_id", ids).unionByName(stored(texts, "unlike-texts"))
    signed = plain
    # only digests that repeat are joined back, over SALTS keys each, so copies spread out
    same = (signed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "node")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
            .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
    mine = signed.select("doc_id", "node", "h1", "h2", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    owner = (mine.join(same, ["h1", "h2", "salt"], "left")
             .groupBy("doc_id", "node").agg(F.min(F.coalesce("owner.doc_id", "doc_id")).alias("text_id"), F.min(F.coalesce("owner.node", "node")).alias("rep")))
    owner = stored(owner, "owner")
    texts = signed.join(owner.where("node = rep").select("node"), "node").groupBy("node").agg(F.min("sig").alias("sig"))
    texts = stored(texts.withColumnRenamed("node", "text_id"), "texts")
    links, depth, before = None, DEPTH, 0
    while True:
        found = _links_at(whole, texts, depth, before, threshold)
        links = found if links is None else links.union(found)
        # the worst case, a pair at the threshold, has to meet the target
        if met(threshold, depth) >= recall:
            break
        before, depth = depth, depth - 1
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    edges = links.select("a", "b")
    if several:  # the texts of one document are one class
        bound = among(owner, "doc_id", ids).select("doc_id", F.col("rep").alias("a"))
        edges = edges.union(bound.join(owner.where("node = doc_id").select("doc_id", F.col("rep").alias("b")), "doc_id").select("a", "b"))
    # the root of a class is its smallest node, the first text of its smallest document
    known = counts.join(components(edges.distinct()).withColumnRenamed("node", "rep"), "rep", "full")
    first = F.struct(F.col("node") != F.col("doc_id"), "text_id")
    found = (owner.join(known, "rep", "left").groupBy("doc_id")
             .agg(F.min(first)["text_id"].alias("text_id"), F.min(F.coalesce("root", "text_id")).alias("class_id"), F.sum("n_links").alias("n_links")))
    out = docs.select("doc_id").distinct().join(found, "doc_id", "left").withColumn("text_id", F.coalesce("text_id", "doc_id"))
    return out.select("doc_id", "text_id", F.coalesce("class_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def _links_at(docs: DataFrame, texts: DataFrame, depth: int, before: int, threshold: float) -> DataFrame:
    nodes = texts.mapInArrow(_prefixes(depth), "text_id long, tree int, node long")
    full = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    dealt = (nodes.join(full, ["tree", "node"])
             .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
             .withColumn("block", F.pmod(F.xxhash64("text_id"), F.col("blocks")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("text_id", "tree", "node", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")))
    by = ["tree", "node", "bi", "bj"]
    schema = "tree int, node long, bi int, bj int, block int, text_id long"
    rows = dealt.join(texts, "text_id").repartition(*by).sortWithinPartitions(*by)
    meeting = stored(rows.select(*by, "block", "text_id", "sig").mapInArrow(_meeting(depth, before), schema), "meeting")
    whole = among(docs, "doc_id", meeting.select("text_id")).groupBy("doc_id").agg(F.max("text").alias("text"))
    rows = (meeting.join(texts, "text_id").join(whole.withColumnRenamed("doc_id", "text_id"), "text_id")
            .repartition(*by).sortWithinPartitions(*by))
    return stored(rows.mapInArrow(_verified(depth, before, threshold), "a long, b long, n long"), "links")
