"""Substring index over many phrases.

All distinct phrases and phrase tokens are the patterns of one Aho-Corasick automaton; a task builds
it once and every text is read once, however many phrases there are.  The patterns met by a text
lead to their phrases through posting lists, so the work per text follows its own hits
and not the number of phrases.  The texts stay where they are: no join and no shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

_SCORES = pa.struct([("phrase", pa.int32()), ("score", pa.int32())])


def pattern_count(specs) -> int:
    """Distinct phrases and tokens, each a scan of every text without the index."""
    return len({s["np"] for s in specs} | {t for s in specs for t in s["tokens"]})


def postings(specs):
    """(patterns, wholes, tokens): per pattern the phrases it is, and the phrases it is a token
    of (once for every time it occurs there)."""
    wholes, tokens = defaultdict(list), defaultdict(list)
    for i, s in enumerate(specs):
        wholes[s["np"]].append(i)
        for t in s["tokens"]:
            tokens[t].append(i)
    patterns = sorted(wholes.keys() | tokens.keys())
    as_arrays = lambda lists: [np.array(lists.get(p, ()), np.int64) for p in patterns]
    return patterns, as_arrays(wholes), as_arrays(tokens)


def phrase_scores(text: Column, specs) -> Column:
    """array<struct<phrase:int,score:int>>: the places in ``specs`` of the phrases that score in a
    text, in order, with their scores."""
    patterns, wholes, tokens = postings(specs)
    whole_score = np.array([s["wc"] + 8 for s in specs], np.int64)
    need = np.array([s["need"] for s in specs], np.int64)
    nothing = np.zeros(0, np.int64)

    def scored(automaton, value):
        met = {i for _, i in automaton.iter(value)} if value else ()
        if not met:
            return nothing, nothing
        hit, hits = np.unique(np.concatenate([tokens[i] for i in met]), return_counts=True)
        enough = hits >= need[hit]
        whole = np.unique(np.concatenate([wholes[i] for i in met]))
        part = ~np.isin(hit, whole) & enough
        found, score = np.concatenate((whole, hit[part])), np.concatenate((whole_score[whole], hits[part]))
        order = np.argsort(found)
        return found[order], score[order]

    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, pattern in enumerate(patterns):
            automaton.add_word(pattern, i)
        automaton.make_automaton()
        for column in columns:
            each = [scored(automaton, value.as_py()) for value in column]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f, _ in each], dtype=np.int64))).astype(np.int32)
            parts = [pa.array(np.concatenate([nothing, *x]).astype(np.int32)) for x in zip(*each)] if each else [pa.array([], pa.int32())] * 2
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(parts, fields=list(_SCORES)))
    return F.arrow_udf(run, "array<struct<phrase:int,score:int>>")(text)

