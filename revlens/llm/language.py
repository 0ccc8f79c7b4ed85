"""Language identification: multinomial naive Bayes over hashed character n-grams.

Whole texts, lower-cased and with runs of blanks as one blank, are read as code points; all
n-grams of 1 to 4 code points are hashed into BUCKETS buckets.  Training counts all
n-grams of all labelled training texts: every task adds up its own (language, bucket)
counts, Spark sums them, and the matrix of log probabilities (languages x BUCKETS) is
broadcast in blocks of LANGUAGES rows.  Scoring is numpy on the sparse (text, bucket) counts
of a chunk, one block after the other: the best score and the normaliser of a text are
carried over, so any number of languages gives what one matrix would give.  The score is
the posterior probability of the predicted language, computed on the mean log likelihood
per n-gram times EVIDENCE, so that it does not saturate with the length of a text.

Defined results: a text that is null or has no letter is ``und`` with score 0.  Without
any labelled training text everything is ``und``.  Ties go to the smaller language name.
Repeated rows give repeated results, a null doc_id counts as the text ``null`` in the fold
rule, null lang rows are never learned from, extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm import textbatch
from revlens.llm.store import shipped, stored, unpacked

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 14
SMOOTHING = 0.5
EVIDENCE = 60.0          # n-grams' worth of evidence in the score
LANGUAGES = 256          # languages of one block of the matrix: 256 x 2**14 x 8 bytes
UNKNOWN = "und"
FOLDS, HELD_OUT = 3, 1
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text or ""))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % FOLDS == HELD_OUT


def _grams(texts):
    """(bucket, owner): the hashed n-grams of all texts, and the text each belongs to."""
    plain = [" " + " ".join(t.lower().split()) + " " for t in texts]
    points = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, plain), np.int64, len(plain))
    owner = np.repeat(np.arange(len(plain)), lengths)
    buckets, owners = [], []
    h = np.zeros(len(points), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[:len(points) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1:] + np.uint64(1)
        if n in GRAMS:
            whole = owner[:len(h)] == owner[n - 1:]
            mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            buckets.append((mixed[whole] >> np.uint64(50)).astype(np.int64))
            owners.append(owner[:len(h)][whole])
    return np.concatenate(buckets), np.concatenate(owners)


def _counts(batches):
    total: dict = {}

    def flush():
        for name, (table, rows) in sorted(total.items()):
            there = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * (len(there) + 1)), pa.array(np.append(there, -1).astype(np.int32)),
                                              pa.array(np.append(table[there], rows))], ["lang", "bucket", "n"])
        total.clear()

    for part in textbatch.chunks(batches, "text"):
        bucket, owner = _grams(part.column("text").to_pylist())
        names, lang = np.unique(part.column("lang").to_pylist(), return_inverse=True)
        rows, of = np.bincount(lang, minlength=len(names)), lang[owner]
        for at in range(0, len(names), LANGUAGES):
            some = names[at:at + LANGUAGES].tolist()
            mine = (of >= at) & (of < at + LANGUAGES)
            table = np.bincount((of[mine] - at) * BUCKETS + bucket[mine], minlength=len(some) * BUCKETS).reshape(-1, BUCKETS)
            for i, name in enumerate(some):
                old = total.setdefault(name, [np.zeros(BUCKETS, np.int64), 0])
                old[0] += table[i]
                old[1] += int(rows[at + i])
            if len(total) > LANGUAGES:
                yield from flush()
    yield from flush()


class Model:
    """A block of languages: names in order; logs: (names, BUCKETS) log probabilities; prior."""

    def __init__(self, names, logs, prior):
        self.names, self.logs, self.prior = names, logs, prior


def scores(blocks, texts):
    """(best language, posterior) lists for texts with letters; ``blocks`` yields Models in
    the order of their names."""
    bucket, owner = _grams(texts)
    cell, count = np.unique(owner * BUCKETS + bucket, return_counts=True)
    rows, cols = cell // BUCKETS, cell % BUCKETS
    first = np.searchsorted(rows, np.arange(len(texts)))
    scale = np.minimum(1.0, EVIDENCE / np.add.reduceat(count, first).astype(float))
    each = np.arange(len(texts))
    names, top, own = [None] * len(texts), np.full(len(texts), -np.inf), np.zeros(len(texts))
    most, total = np.full(len(texts), -np.inf), np.zeros(len(texts))  # of the scaled scores: largest, sum of exp(score - largest)
    for model in blocks:
        like = np.stack([np.add.reduceat(line[cols] * count, first) for line in model.logs], 1)
        best = np.argmax(like + model.prior, 1)
        here = like[each, best] + model.prior[best]
        scaled = like * scale[:, None] + model.prior
        for i in np.flatnonzero(here > top):  # ties stay with the smaller name
            names[i], top[i], own[i] = model.names[best[i]], here[i], scaled[i, best[i]]
        larger = np.maximum(most, scaled.max(1))
        total = total * np.exp(most - larger) + np.exp(scaled - larger[:, None]).sum(1)
        most = larger
    return names, np.exp(own - most) / total


def train(labelled: DataFrame):
    """Models of all rows (text, lang) with a lang, LANGUAGES at a time; none without any."""
    sums = (labelled.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("lang").cast("string").alias("lang"))
            .where("lang is not null").mapInArrow(_counts, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    sums = stored(sums, "language-counts")
    docs = dict(sorted(sums.where("bucket < 0").select("lang", "n").collect()))
    names, all_docs = list(docs), sum(docs.values())
    for at in range(0, len(names), LANGUAGES):
        some = names[at:at + LANGUAGES]
        cells = sums.where(F.col("lang").between(some[0], some[-1]) & (F.col("bucket") >= 0)).toArrow()  # at most LANGUAGES x BUCKETS
        table = np.full((len(some), BUCKETS), SMOOTHING)
        place = pc.index_in(cells.column("lang"), pa.array(some, cells.column("lang").type)).to_numpy()
        table[place, cells.column("bucket").to_numpy()] += cells.column("n").to_numpy()
        yield Model(some, np.log(table / table.sum(1, keepdims=True)), np.log(np.array([docs[x] for x in some], float) / all_docs))


def _opened(shared: list):
    """The broadcast blocks; of several one at a time is held."""
    for block in shared:
        yield unpacked(block)
        if len(shared) > 1 and getattr(block, "_path", None):
            del block._value  # read again from the worker's own copy for the next chunk


_PREDICTION = pa.struct([("lang_pred", pa.string()), ("score", pa.float64())])


def predict(text: Column, models, spark) -> Column:
    """struct(lang_pred, score) of whole texts; the models are broadcast one by one."""
    shared = [shipped(spark, m) for m in models]

    def one(column):
        texts = column.to_pylist()
        rows = [{"lang_pred": UNKNOWN, "score": 0.0} for _ in texts]
        known = [i for i, t in enumerate(texts) if has_letter(t)] if shared else []
        if known:
            for i, name, posterior in zip(known, *scores(_opened(shared), [texts[i] for i in known])):
                rows[i] = {"lang_pred": name, "score": float(posterior)}
        return rows
    run = textbatch.per_text(one, _PREDICTION)

    def predictions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        return run(batches)
    return F.arrow_udf(predictions, "struct<lang_pred:string,score:double>").asNondeterministic()(text.cast("string"))


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows that are not held out."""
    models = train(docs.where(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = docs.select("doc_id", predict(F.col("text"), models, docs.sparkSession).alias("p"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")
