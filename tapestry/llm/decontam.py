"""Benchmark decontamination by SimHash over item-sized windows.

For each benchmark item of n words, every window of n consecutive words of a
document that holds at least one of the benchmark's shingles (a window without
any is not similar to anything) gets a 64-bit SimHash of its 5-word shingles,
each weighted by how often it stands in the window.  The items' fingerprints
are cut into RADIUS + 1 blocks; fingerprints within RADIUS bits agree in one
block at least, so looking every block up finds all items within the radius.
Candidates are then verified by the weighted shingle similarity (the sum of
the smaller counts over the sum of the larger ones) on the words themselves.

A similarity of 0.8 puts the angle of two count vectors at about 27 degrees or
less and the expected distance at 9.7 of 64 bits, with a deviation of 2.9;
RADIUS = 24 is five deviations above.  Blocks are short at such a radius: the
window gate and the item's size, not the blocks, keep the candidates few.

Words are runs between ASCII white space, with A-Z in lower case; an item of
fewer than five words is one shingle.  The items of a pass are bounded by
``pass_bytes`` of text and travel to the tasks; a larger benchmark takes more
passes over the documents.

Edge cases: NULL and empty texts match nothing, neither do items without
words; rows that share an id are matched each and the best window counts;
equal items each match; ties go to the first window; rows or items with a NULL
id take no part; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import mix64, release, words_of
from tapestry.llm.substring import BASES, rolling

SHINGLE, SIMILARITY = 5, 0.8
BITS, RADIUS = 64, 24
PASS_BYTES = 8 << 20
SLICE = 256


def word_keys(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(keys: np.ndarray, width: int) -> np.ndarray:
    return rolling(keys, width, BASES[0]) + np.uint64(width)


def signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each bit of each hash."""
    bits = np.unpackbits(mix64(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1).view(np.uint64).reshape(-1)


def block_masks() -> list[np.uint64]:
    """RADIUS + 1 disjoint runs of bits that cover the fingerprint."""
    cuts = np.linspace(0, BITS, RADIUS + 2).astype(int)
    return [np.uint64(((1 << int(b - a)) - 1) << int(a)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Items:
    """The items of one size: fingerprints, block tables and shingle counts."""

    def __init__(self, size: int, items: list[tuple[int, np.ndarray]]):
        self.size, self.width = size, min(SHINGLE, size)
        self.ids = [i for i, _ in items]
        self.hashes = [shingles(k, self.width) for _, k in items]
        self.counts = [Counter(h.tolist()) for h in self.hashes]
        self.prints = np.concatenate([fingerprints(signs(h).sum(axis=0, keepdims=True)) for h in self.hashes])
        self.tables = []
        for mask in block_masks():
            values = self.prints & mask
            order = np.argsort(values, kind="stable")
            self.tables.append((mask, values[order], order))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within RADIUS, by the block tables."""
        windows, found = [], []
        for mask, values, order in self.tables:
            part = prints & mask
            a, b = np.searchsorted(values, part, "left"), np.searchsorted(values, part, "right")
            n = b - a
            w = np.repeat(np.arange(len(prints)), n)
            windows.append(w)
            found.append(order[np.arange(len(w)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(a, n)])
        w, i = np.concatenate(windows), np.concatenate(found)
        pair = np.unique(w * len(self.ids) + i)
        w, i = pair // len(self.ids), pair % len(self.ids)
        close = np.bitwise_count(prints[w] ^ self.prints[i]) <= RADIUS
        return w[close], i[close]

    def similarity(self, item: int, window: np.ndarray) -> float:
        have, want = Counter(window.tolist()), self.counts[item]
        low = sum(min(n, want[h]) for h, n in have.items() if h in want)
        return low / (len(window) + sum(want.values()) - low)


class Benchmark:
    """Items by size, and all their shingles by width."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        sizes: dict[int, list] = {}
        for item, text in rows:
            keys = word_keys(words_of(text, lower=True))
            if len(keys):
                sizes.setdefault(len(keys), []).append((item, keys))
        self.sizes = [Items(n, items) for n, items in sorted(sizes.items())]
        self.known = {w: np.unique(np.concatenate([h for s in self.sizes if s.width == w for h in s.hashes])) for w in {s.width for s in self.sizes}}

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int, float]]:
        """(text number, item, first word, words, similarity) of every item's
        best window of at least SIMILARITY."""
        of = [words_of(t, lower=True) for t in texts]
        vocab = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(of)))}
        keys = word_keys(list(vocab))
        flat = keys[np.fromiter(map(vocab.__getitem__, chain.from_iterable(of)), np.int64, sum(map(len, of)))]
        lengths = np.array([len(w) for w in of], np.int64)
        left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(flat))
        text = np.repeat(np.arange(len(of)), lengths)
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for width, known in self.known.items():
            hashes = shingles(flat, width)
            within = left[: len(hashes)] >= width
            hit = within & (known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
            if not hit.any():
                continue
            # only texts with a known shingle go on
            chosen = np.isin(text[: len(hashes)], np.unique(text[: len(hashes)][hit]))
            hits = np.concatenate([[0], np.cumsum(hit)])
            rows = np.flatnonzero(chosen)
            place = np.zeros(len(hashes) + 1, np.int64)  # chosen shingles before a position
            place[1:] = np.cumsum(chosen)
            sums = np.concatenate([np.zeros((1, BITS), np.int32), np.cumsum(signs(hashes[rows]), axis=0, dtype=np.int32)])
            for items in (s for s in self.sizes if s.width == width):
                span = items.size - width + 1
                p = rows[(left[rows] >= items.size)]
                p = p[hits[p + span] > hits[p]]
                if not len(p):
                    continue
                prints = fingerprints(sums[place[p + span - 1] + 1] - sums[place[p]])
                for w, i in zip(*(x.tolist() for x in items.near(prints)), strict=True):
                    at = int(p[w])
                    if hits[at + span] - hits[at] < SIMILARITY * span:  # too few known shingles to be that similar
                        continue
                    like = items.similarity(i, hashes[at : at + span])
                    key = (int(text[at]), items.ids[i])
                    if like >= SIMILARITY and like > best.get(key, (0.0,))[0]:
                        best[key] = (like, at, items.size)
        starts = np.cumsum(lengths) - lengths
        for (t, item), (like, at, size) in best.items():
            yield t, item, at - int(starts[t]), size, like


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, start
    (first word, from 0), n_words and similarity of the best window."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")).where("item IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = size // pass_bytes + 1
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id IS NOT NULL")

    def one(chunk: list[tuple[int, str | None]]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bench = Benchmark(chunk)
            for batch in batches:
                for i in range(0, batch.num_rows, SLICE):
                    part = batch.slice(i, SLICE)
                    ids = part.column("doc_id").to_pylist()
                    found = [(ids[t], *rest) for t, *rest in bench.scan(part.column("text").to_pylist())]
                    if found:
                        names = ["doc_id", "item_id", "start", "n_words", "similarity"]
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=names)
            release()

        return rows.mapInArrow(run, "doc_id long, item_id long, start long, n_words long, similarity double")

    chunks = [[tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == c).collect()] for c in range(passes)]
    found = reduce(DataFrame.unionByName, [one(sorted(c, key=lambda r: r[0])) for c in chunks])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("back"), "n_words")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", (-F.col("best.back")).alias("start"), "best.n_words", "best.similarity")
