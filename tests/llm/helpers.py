"""Plain restatements of the rules that several tests share, and awkward inputs."""

import re

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWERED = str.maketrans(UPPER, UPPER.lower())
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWERED))


def shingles(text, width=5):
    w = words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, **more):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""
    rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", len(r[1] or "")) for r in texts]
    return spark.createDataFrame(rows, DOCS)


def prose(n, seed, vocabulary=400):
    """n words that depend on the seed."""
    import random

    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


AWKWARD = [(1, None), (2, ""), (3, " \n\t "), (4, "***"), (5, "one"), (6, "😀 é x"), (7, "x" * 300_000), (8, "a b " * 40_000), (None, "null id"), (5, "one"), (9, "Línea\n\nLínea\r\n")]
