"""Line dedup: lines whose key stands in several documents stay only in the first of them.

A text is split at newlines (null or empty: one empty line).  A line's key is the line
without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z lower-cased.  Keys of at least
``MIN_CHARS`` code points found in at least two documents are dropped everywhere except in
the smallest doc_id that holds them (there every occurrence stays).

Lines travel as two 64-bit hashes; whether a hash is in two documents follows from the
smallest and the largest doc_id, so a line that a third of all rows hold is one
pre-aggregated row per task, and the lines of a hot key are joined over salted keys.  The
texts move once, when each row meets the positions to
drop.

Defined results: a row is identified by (doc_id, text); repeated rows get the same result
each, and rows with one doc_id and different texts are one document.  A null doc_id is a
document of its own that comes after all others.  Extra columns are carried by
``drop_repeated_lines`` and ignored by ``report``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from revlens.llm.membership import flagged
from revlens.llm.store import stored

MIN_CHARS = 10
HOT = 1000      # lines from which a key counts as hot
SALTS = 32
BLANKS = b" \t\n\x0b\x0c\r"
_ROWS_OUT = 200_000


def _line_hashes(batches):
    """(doc, version, pos, h1, h2) of the lines with keys that are long enough."""
    for batch in batches:
        docs, versions, texts = (batch.column(c) for c in ("doc", "version", "text"))
        rows, pos, keys = [], [], []
        for i, text in enumerate(texts):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            for p, line in enumerate(raw.split(b"\n")):
                key = line.strip(BLANKS)
                if len(key) >= MIN_CHARS and (key.isascii() or len(key.decode()) >= MIN_CHARS):
                    rows.append(i)
                    pos.append(p)
                    keys.append(xxhash.xxh3_128_digest(key.lower()))
            if len(rows) >= _ROWS_OUT or (i == batch.num_rows - 1 and rows):
                at = pa.array(rows)
                h = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([docs.take(at), versions.take(at), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                                                 ["doc", "version", "pos", "h1", "h2"])
                rows, pos, keys = [], [], []


def _marked(docs: DataFrame) -> DataFrame:
    """(row, doc, lines, gone): whole rows with their lines and the positions to drop."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("version", F.xxhash64("text", F.length("text")))
    lines = rows.select("doc", "version", "text").mapInArrow(_line_hashes, "doc long, version long, pos int, h1 long, h2 long")
    null_doc = F.max(F.col("doc").isNull())
    shared = (lines.groupBy("h1", "h2").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), null_doc.alias("none"), F.count(F.lit(1)).alias("n"))
              .where("first <> last or (none and first is not null)").select("h1", "h2", "first", "n"))
    shared = stored(shared, "shared-lines")
    # keys on very many lines (and a few that share their bit) are joined over SALTS keys each
    hot = shared.where(F.col("n") > HOT).select("h1")
    left = flagged(lines, "h1", hot).withColumn("salt", F.when(F.col("_maybe"), F.pmod(F.xxhash64("doc", "version"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    right = flagged(shared, "h1", hot).withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("_maybe"), F.lit(SALTS - 1)).otherwise(F.lit(0)))))
    gone = (left.drop("_maybe").join(right.drop("_maybe", "n"), ["h1", "h2", "salt"]).where("doc is null or doc <> first")
            .groupBy("doc", "version").agg(F.collect_set("pos").alias("gone")))
    gone = gone.toDF("d", "v", "gone")
    return (rows.join(gone, F.col("doc").eqNullSafe(F.col("d")) & (F.col("version") == F.col("v")), "left")
            .select("row", "doc", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"), F.coalesce("gone", F.expr("cast(array() as array<int>)")).alias("gone")))


def _kept():
    """The kept lines, joined again."""
    where = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return F.array_join(F.transform(where, lambda i: F.get("lines", i)), "\n")


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept lines as ``text``; texts that lose nothing stay as they are
    (null stays null) and so do all other columns."""
    marked = _marked(docs)
    text = F.when(F.size("gone") > 0, _kept()).otherwise(F.col("row.text"))
    return marked.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256), one row per row of ``docs``."""
    return _marked(docs.select("doc_id", "text")).select(
        F.col("row.doc_id").alias("doc_id"), F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_dropped"),
        F.sha2(_kept(), 256).alias("kept_sha256"))
