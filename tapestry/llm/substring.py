"""Substring dedup with difference-cover anchors.

Every run of ``window`` consecutive words that also starts earlier (in a
smaller document, or further up in the same one) is removed; runs are judged
on the input, not on what is left of it.

Hashing every run of the corpus and shuffling the hashes would move several
times the text.  Instead only short anchors are compared first, and only at
word positions whose index modulo ``PERIOD`` is in ``COVER``.  COVER is a
difference cover: every offset modulo PERIOD is a difference of two of its
members.  So wherever two equal runs of ``window`` words stand, some anchor of
``window - PERIOD + 1`` words lies inside both at the same distance from their
starts and at a cover position of both.  An anchor that occurs once in the
corpus proves that no run around it at that alignment repeats.  Anchors that
occur again are extended: the runs that hold one are compared in full, by
96 bits of two hashes, and the first place of each run is found.

Both questions (does this anchor occur again? where is this run's first
place?) are asked through ``exchange``: a block of texts asks once for each
distinct key, so a passage that a third of all documents share costs each
block one key.  Nothing is collected, and no pair of documents is formed.

Edge cases: a NULL text has no words; texts shorter than a run keep all their
words; rows with a NULL id count as before all others; places are compared by
(id, position), so of equal rows each keeps what none has earlier; overlapping
runs remove each word once; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import longs_in, mix64, text_blocks, texts_in, words_of
from tapestry.llm.exchange import ANSWERS, PACKETS, answer_table, answers_in, key_arrays, packet_rows, packet_table

WINDOW = 20
PERIOD, COVER = 13, (0, 1, 3, 9)
BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).min
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so they have inverses modulo 2**64


def rolling(words: np.ndarray, n: int, base: int) -> np.ndarray:
    """A hash of the ``n`` words from each position on (modulo 2**64)."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    powers = np.cumprod(np.full(len(words), base, np.uint64))
    back = np.cumprod(np.full(len(words), pow(base, -1, 1 << 64), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers)])
    return mix64((sums[n:] - sums[:-n]) * back[: len(words) - n + 1])


class Words:
    """The words of a block's texts, in (id, position) order."""

    def __init__(self, table: pa.Table):
        ids = longs_in(table, "key")
        self.rows = np.argsort(ids, kind="stable")
        self.ids = ids[self.rows]
        texts = texts_in(table)
        of = [words_of(texts[i]) for i in self.rows]
        self.lengths = np.array([len(w) for w in of], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.words = list(chain.from_iterable(of))
        seen: defaultdict[bytes, int] = defaultdict()
        seen.default_factory = seen.__len__
        number = np.fromiter(map(seen.__getitem__, self.words), np.int64, len(self.words))
        wide = b"".join(map(xxhash.xxh3_128_digest, seen))
        self.keys = np.frombuffer(wide, "<u8").reshape(-1, 2)[number] if self.words else np.empty((0, 2), np.uint64)
        self.left = np.repeat(self.ends, self.lengths) - np.arange(len(self.words))  # words up to the text's end
        self.at = np.arange(len(self.words)) - np.repeat(self.starts, self.lengths)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors, their distinct keys, and each one's key."""
        n = window - PERIOD + 1
        places = np.flatnonzero(np.isin(self.at % PERIOD, COVER) & (self.left >= n))
        keys = rolling(self.keys[:, 0], n, BASES[0])[places] if len(places) else np.empty(0, np.uint64)
        distinct, key = np.unique(keys, return_inverse=True)
        return places, distinct, key

    def runs(self, window: int, again: np.ndarray) -> np.ndarray:
        """Places of the runs that hold an anchor which occurs again."""
        marks = np.concatenate([[0], np.cumsum(again)])
        last = len(marks) - 1
        i = np.flatnonzero(self.left >= window)
        return i[marks[np.minimum(i + PERIOD, last)] > marks[i]]

    def run_keys(self, window: int, places: np.ndarray) -> tuple[np.ndarray, ...]:
        """The runs sorted by key, then place: order, the two keys, and whether
        a run is its key's first in this block."""
        empty = np.empty(0, np.uint64)
        high = rolling(self.keys[:, 0], window, BASES[0])[places] if len(places) else empty
        low = (rolling(self.keys[:, 1], window, BASES[1])[places] if len(places) else empty).astype("<u4")
        doc = np.repeat(self.ids, self.lengths)[places]
        at = self.at[places]
        order = np.lexsort((at, doc, low, high))
        high, low, doc, at = high[order], low[order], doc[order], at[order]
        first = np.ones(len(order), bool)
        first[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        return order, high, low, doc, at, first


def shared_anchors(words: Words, answers: pa.Table, window: int) -> np.ndarray:
    places, _, key = words.anchors(window)
    again = np.zeros(len(words.words), np.int8)
    if len(places):
        again[places] = answers_in(answers, 1, "u1")[key]
    return again


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row: doc_id, n_words, n_removed, removed (word spans, ends
    exclusive) and kept_text (the words left, joined by one space)."""
    if window < PERIOD + 1:
        raise ValueError(f"window must be over {PERIOD}")
    blocked, blocks = text_blocks(docs, id_col, text_col, block_bytes)

    def ask_anchors(table: pa.Table) -> pa.Table:
        _, distinct, key = Words(table).anchors(window)
        twice = np.minimum(np.bincount(key, minlength=len(distinct)), 2).astype("u1")
        return packet_table(packet_rows(table.column("block")[0].as_py(), 1, blocks, distinct, twice))

    def count_anchors(table: pa.Table) -> pa.Table:
        keys, ends = key_arrays(table)
        seen = np.frombuffer(b"".join(table.column("vals").to_pylist()), "u1")
        distinct, key = np.unique(keys, return_inverse=True)
        again = np.bincount(key, weights=seen, minlength=len(distinct)) >= 2
        return answer_table(table, ends, again[key].astype("u1"))

    def ask_runs(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(table):
            return packet_table([])
        words = Words(table)
        places = words.runs(window, shared_anchors(words, answers, window))
        _, high, low, doc, at, first = words.run_keys(window, places)
        columns = (low[first], doc[first].astype("<i8"), at[first].astype("<i4"))
        return packet_table(packet_rows(table.column("block")[0].as_py(), 2, blocks, high[first], *columns))

    def first_runs(table: pa.Table) -> pa.Table:
        keys, ends = key_arrays(table)
        parts = []
        for raw, n in zip(table.column("vals").to_pylist(), np.diff(ends, prepend=0), strict=True):
            parts.append((np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<i8", n, 4 * n), np.frombuffer(raw, "<i4", n, 12 * n)))
        low, doc, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((at, doc, low, keys))
        k, w, d, a = keys[order], low[order], doc[order], at[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (w[1:] != w[:-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))
        is_first = np.empty(len(k), "u1")
        is_first[order] = (d == d[lead]) & (a == a[lead])
        return answer_table(table, ends, is_first)

    def remove(table: pa.Table, answers: pa.Table) -> pa.Table:
        words = Words(table)
        places = words.runs(window, shared_anchors(words, answers, window))
        order, _, _, doc, at, first = words.run_keys(window, places)
        group = np.cumsum(first) - 1
        lead = np.flatnonzero(first)[group]
        earliest = answers_in(answers, 2, "u1")[group].astype(bool) if len(places) else np.empty(0, bool)
        gone = places[order][~(earliest & (doc == doc[lead]) & (at == at[lead]))]
        edge = np.zeros(len(words.words) + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        n = len(words.ids)
        texts, spans, removed = [None] * n, [None] * n, np.zeros(n, np.int64)
        for i, (a, b) in enumerate(zip(words.starts, words.ends, strict=True)):
            part = keep[a:b]
            texts[i] = b" ".join(compress(words.words[a:b], part.tolist())).decode()
            removed[i] = b - a - part.sum()
            turn = np.flatnonzero(np.diff(np.concatenate([[1], part, [1]]))) if removed[i] else np.empty(0, int)
            spans[i] = [{"start": int(x), "end": int(y)} for x, y in zip(turn[::2], turn[1::2], strict=True)]
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({
            "doc_id": pa.array(words.ids, mask=words.ids == NO_ID), "n_words": words.lengths, "n_removed": removed,
            "removed": pa.array(spans, span), "kept_text": texts,
        })

    by_block = blocked.groupBy("block")
    anchors = by_block.applyInArrow(ask_anchors, PACKETS).groupBy("bucket").applyInArrow(count_anchors, ANSWERS)
    runs = by_block.cogroup(anchors.groupBy("block")).applyInArrow(ask_runs, PACKETS)
    firsts = runs.groupBy("bucket").applyInArrow(first_runs, ANSWERS)
    out = "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string"
    return by_block.cogroup(anchors.unionByName(firsts).groupBy("block")).applyInArrow(remove, out)


def substring_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    kept = F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", kept, F.size("removed").alias("n_spans"))
