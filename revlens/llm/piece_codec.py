"""SentencePiece encoding and decoding through a table of distinct chunks.

If no piece of the model holds the white space mark behind another character and none holds
a line feed, nothing can be merged across the start of a marked word or a line feed, so a
text's ids are the ids of its chunks one after the other, which ``chunk_table`` segments and
joins back by position.  A model that does not meet the condition, or that normalises
characters, gets whole texts as chunks.

Defined results: null is the empty text, which has the begin and end ids only and decodes to
''.  U+2581 in a text is a space, as in the library.  Rows repeat as they are; a null doc_id
stays null; other columns, whatever their names, are dropped; an empty table stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from revlens.llm import textbatch
from revlens.llm.chunk_table import PART_BYTES, TABLE_BYTES, Segmenter, every_break, known_table, no_break

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits(sp) -> bool:
    """Whether chunks may be segmented on their own: a mark before the text, every space a mark,
    all other characters as they are, and no piece across a mark or a line feed."""
    text = "".join(map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]))
    if sp.normalize(text) != MARK + text.replace(" ", MARK) or sp.normalize("  ") != MARK * 3:
        return False
    pieces = map(sp.id_to_piece, range(sp.vocab_size()))
    return not any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)


def marked(text: Column) -> Column:
    """The text with a blank for the mark that the library puts before it."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), MARK, " ")
    return F.when(plain != "", F.concat(F.lit(" "), plain)).otherwise(plain)


def segment(sp, chunks: list[str]) -> list[list[int]]:
    """Ids of chunks: one blank of a marked chunk is the library's own; before a line feed the
    library adds a mark, which is the first id and not part of the chunk.  That first id is also
    what a lone mark becomes, since the library puts none before an empty text."""
    lists = sp.encode(["\n" if c == " " else c[1:] if c[0] == " " else c for c in chunks], num_threads=1)
    return [ids[:1] if c == " " else ids if c[0] == " " else ids[1:] for c, ids in zip(chunks, lists)]


def opened(model: bytes, breaks):
    """The segment function of chunks of ``marked`` texts, inside a task."""
    sp = processor(model)
    if breaks is no_break:
        return lambda texts: sp.encode([t[1:] for t in texts], num_threads=1)
    return lambda chunks: segment(sp, chunks)


def encode(docs: DataFrame, text: str = "text", model_path: str = MODEL, limit: int = TABLE_BYTES) -> DataFrame:
    """(doc_id, ids, decoded): ``ids`` are the begin id, the ids of the whole text and the end
    id as little-endian unsigned 32-bit integers; ``decoded`` is what the library makes of them."""
    with open(model_path, "rb") as f:
        model = f.read()
    breaks = every_break if splits(processor(model)) else no_break
    texts = docs.select("doc_id", marked(F.col(text)).alias("marked"))
    known = known_table(texts.select("marked"), breaks, lambda: [opened(model, breaks)], 1, limit) if breaks is every_break else None
    shared = docs.sparkSession.sparkContext.broadcast((model, known))

    def coded(batches):
        model, known = shared.value
        ids_of, sp = Segmenter([opened(model, breaks)], breaks, known), processor(model)
        begin, end = np.array([sp.bos_id()], "<u4"), np.array([sp.eos_id()], "<u4")
        for part in textbatch.chunks(batches, "marked", PART_BYTES):
            [(ids, offsets)] = ids_of(part.column("marked"))
            each = [np.concatenate((begin, ids[a:b].astype("<u4"), end)) for a, b in zip(offsets[:-1], offsets[1:])]
            decoded = sp.decode([x.tolist() for x in each], num_threads=1)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x.tobytes() for x in each], pa.binary()), pa.array(decoded, pa.string())],
                                             ["doc_id", "ids", "decoded"])
    kind = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(coded, f"doc_id {kind}, ids binary, decoded string")


def report(docs: DataFrame, text: str = "text", model_path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return encode(docs, text, model_path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
