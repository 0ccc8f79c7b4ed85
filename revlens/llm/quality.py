"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of PASSAGE words (blank-separated).  Every passage of the
whole text is encoded from its format: how often bytes of one class (lower case, upper
case, digit, blank, sentence mark, bracket or quote, other symbol, beyond ASCII) follow
another, and statistics of its words.  A learned layer encodes these features, gated
attention ``w . (tanh(V h) * sigmoid(U h))`` weighs the passages, and the weighted sum
gives the probability of label 1.  Only document labels are used, so training finds out
by itself which passages speak for a document.

Training uses a bounded sample of labelled documents: for each label the SAMPLE with the smallest
hash, as far as their passages together are at most SAMPLE_PASSAGES (the first always
counts).  Every passage of a chosen document is learned from; class weights put the label
shares back.  Scoring covers every passage of every document.

Defined results: a null or empty text is one empty passage and gets a score like any
other.  Labels are joined by doc_id; null or contradicting labels are not learned from.
Without labels every score is 0.5.  A null doc_id counts as the text ``null`` in the fold
rule.  Repeated rows give repeated results; extra columns travel unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from revlens.llm import textbatch
from revlens.llm.store import stored

PASSAGE = 64
SAMPLE = 2000               # labelled documents of each label
SAMPLE_PASSAGES = 100_000   # of all chosen documents of one label: 29 MB
ENCODED, GATES = 24, 16
EPOCHS, BATCH, RATE, DECAY = 12, 128, 0.01, 1e-4
ACCEPT = 0.7
FOLDS, HELD_OUT = 4, 2
CLASSES = 8


def _classes():
    kind = np.full(256, 6, np.int64)            # other symbols
    kind[97:123], kind[65:91], kind[48:58], kind[128:] = 0, 1, 2, 7
    kind[[9, 10, 11, 12, 13, 32]] = 3
    kind[[ord(c) for c in ".,;:?"]] = 4
    kind[[ord(c) for c in "'\"()[]-"]] = 5
    return kind


KIND = _classes()
WORD_STATS = 9
FEATURES = CLASSES * CLASSES + WORD_STATS


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == HELD_OUT


def passages(column: pa.Array):
    """(features, first): one row per passage, and each text's first passage (length rows + 1)."""
    data, offsets = textbatch.buffers(column)
    n, texts = len(data), len(column)
    kind = KIND[data]
    inside = kind != 3
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (np.concatenate(([True], ~inside[:-1])) | edge[:-1])) if n else np.zeros(0, np.int64)
    end = np.flatnonzero(inside & (np.concatenate((~inside[1:], [True])) | edge[1:])) + 1 if n else start
    first_word = np.searchsorted(start, offsets)
    count = np.diff(first_word)
    many = np.maximum(1, -(-count // PASSAGE))
    first = np.concatenate(([0], np.cumsum(many)))
    total = first[-1]
    doc = np.repeat(np.arange(texts), count)
    passage = first[:-1][doc] + (np.arange(len(start)) - first_word[:-1][doc]) // PASSAGE
    words = np.bincount(passage, minlength=total).astype(float)
    some = np.maximum(words, 1.0)
    out = np.zeros((total, FEATURES), np.float32)
    if n:
        # every byte belongs to the passage of the last word that began in its text
        opening = np.zeros(n, np.int64)
        opening[offsets[:-1][offsets[:-1] < n]] = first[:-1][offsets[:-1] < n]
        opening[start] = np.maximum(opening[start], passage)
        of_byte = np.maximum.accumulate(opening)
        pair = kind[:-1] * CLASSES + kind[1:]
        same = of_byte[:-1] == of_byte[1:]
        cells = np.bincount(of_byte[:-1][same] * CLASSES ** 2 + pair[same], minlength=total * CLASSES ** 2).reshape(total, -1)
        out[:, :CLASSES ** 2] = cells / np.maximum(cells.sum(1, keepdims=True), 1)
    if len(start):
        size = (end - start).astype(float)
        p, q = textbatch.powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(textbatch.BYTE_CODE[textbatch.LOWER[data]] * p[:n], out=sums[1:])
        word = textbatch.mix64((sums[end] - sums[start]) * q[start])
        near = np.zeros(len(start), bool)
        near[1:] = (word[1:] == word[:-1]) & (passage[1:] == passage[:-1])
        order = np.lexsort((word, passage))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (word[order][1:] != word[order][:-1]) | (passage[order][1:] != passage[order][:-1])

        def mean(values):
            return np.bincount(passage, values, minlength=total) / some
        average = mean(size)
        last = kind[end - 1]
        stats = (average / 10, np.sqrt(np.maximum(mean(size ** 2) - average ** 2, 0)) / 10, mean(near), np.bincount(passage[order], fresh, minlength=total) / some,
                 mean(kind[start] == 1), mean(last == 6), mean(last == 4), mean((kind[start] > 1) & (kind[start] < 7)), np.log1p(words) / 5)
        out[:, CLASSES ** 2:] = np.stack(stats, 1)
    return out, first


class Model:
    """Weights of encoder, gated attention and output; score() works on bags of passages."""

    def __init__(self, mean, scale, seed: int = 7):
        r = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.w = {"E": r.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, ENCODED)), "e": np.zeros(ENCODED),
                  "V": r.normal(0, 1 / np.sqrt(ENCODED), (ENCODED, GATES)), "U": r.normal(0, 1 / np.sqrt(ENCODED), (ENCODED, GATES)),
                  "w": r.normal(0, 1 / np.sqrt(GATES), GATES), "c": r.normal(0, 1 / np.sqrt(ENCODED), ENCODED), "b": np.zeros(1)}

    def forward(self, x, first):
        w, at = self.w, first[:-1]
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["E"] + w["e"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        a = (t * g) @ w["w"]
        bag = np.repeat(np.arange(len(at)), np.diff(first))
        a = np.exp(a - np.maximum.reduceat(a, at)[bag])
        a /= np.add.reduceat(a, at)[bag]
        z = np.add.reduceat(a[:, None] * h, at)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["b"], -30, 30)))
        return p, (x, h, t, g, a, bag, z)

    def score(self, x, first):
        return self.forward(x, first)[0]

    def gradient(self, x, first, y, weight):
        w, at = self.w, first[:-1]
        p, (x, h, t, g, a, bag, z) = self.forward(x, first)
        d = weight * (p - y) / weight.sum()
        dz = d[:, None] * w["c"]
        da = (dz[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, at)[bag])
        dt, dg = ds[:, None] * w["w"] * g * (1 - t * t), ds[:, None] * w["w"] * t * g * (1 - g)
        dh = (a[:, None] * dz[bag] + dt @ w["V"].T + dg @ w["U"].T) * (1 - h * h)
        return {"E": x.T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ ds, "c": z.T @ d, "b": np.array([d.sum()])}


def fit(bags, labels, shares) -> Model:
    """bags: list of (passages, FEATURES) arrays; shares: label -> number of labelled
    documents it stands for.  Adam on the weighted log loss, in a seeded order."""
    every = np.concatenate(bags)
    model = Model(every.mean(0), every.std(0) + 1e-3)
    labels = np.asarray(labels, float)
    weight = np.zeros(len(labels))
    for label, share in shares.items():
        weight[labels == label] = share / max(1, (labels == label).sum())
    weight /= max(weight.mean(), 1e-12)
    r = np.random.default_rng(11)
    m, v = ({k: np.zeros_like(x) for k, x in model.w.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        for some in np.array_split(r.permutation(len(bags)), max(1, len(bags) // BATCH)):
            step += 1
            first = np.concatenate(([0], np.cumsum([len(bags[i]) for i in some])))
            grad = model.gradient(np.concatenate([bags[i] for i in some]), first, labels[some], weight[some])
            for k, g in grad.items():
                g = g + DECAY * model.w[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                model.w[k] = model.w[k] - RATE * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _sampled(batches):
    for part in textbatch.chunks(batches, "text"):
        x, first = passages(part.column("text"))
        rows = [x[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(rows, pa.binary())], ["doc_id", "quality", "bag"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Model from the labelled documents that are not held out; None without any."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
             .where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id")))
             .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other").drop("other"))
    shares = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not shares:
        return None
    order = F.xxhash64("doc_id")
    picks = [known.where(F.col("quality") == q).orderBy(order, "doc_id").limit(SAMPLE) for q in sorted(shares)]
    chosen = picks[0] if len(picks) == 1 else picks[0].union(picks[1])
    texts = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
             .join(F.broadcast(chosen), "doc_id"))  # at most 2 x SAMPLE rows
    bags = stored(texts.mapInArrow(_sampled, "doc_id long, quality int, bag binary").groupBy("doc_id", "quality").agg(F.min("bag").alias("bag")), "bags")
    # SAMPLE rows of a label at most, so these windows are small
    ahead = Window.partitionBy("quality").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passages_so_far = F.sum(F.octet_length("bag") / (4 * FEATURES)).over(ahead)
    kept = bags.select("doc_id", "quality", passages_so_far.alias("n"), F.row_number().over(Window.partitionBy("quality").orderBy(order, "doc_id")).alias("place"))
    kept = kept.where((F.col("n") <= SAMPLE_PASSAGES) | (F.col("place") == 1)).select("doc_id")
    rows = sorted(bags.join(F.broadcast(kept), "doc_id").collect(), key=lambda r: r["doc_id"])
    if not rows:
        return None
    return fit([np.frombuffer(r["bag"], np.float32).reshape(-1, FEATURES).astype(float) for r in rows], [r["quality"] for r in rows], shares)


def score(text: Column, model: Model | None) -> Column:
    """Probability of label 1 of whole texts."""
    run = textbatch.per_text(lambda t: np.full(len(t), 0.5) if model is None else model.score(*passages(t)), pa.float64())

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)
    return F.arrow_udf(scores, "double").asNondeterministic()(text.cast("string"))  # evaluated once per row


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    out = docs.select("doc_id", score(F.col("text"), train(docs, labels)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows the classifier rejects; all columns as they were."""
    return docs.where(score(F.col("text"), train(docs, labels)) >= ACCEPT)
