"""Language-model scoring by a weighted backoff automaton.

A model of order n gives a word w after the history h the probability

    p(w | h) = (count(h w) + K * p(w | h')) / (count(h) + K)

where h' drops the oldest word of h, and p(w) = (count(w) + 1) / (N + V + 1).
As an automaton: every n-gram of the training text shorter than n is a state; a
seen n-gram (h, w) is an arc of weight log p(w | h) out of state h; every state
has a failure arc to h' of weight log(K / (count(h) + K)), taken when w is no
arc of h.  The probabilities of a state's continuations sum to one.

One left-to-right traversal of a text adds the weights of the arcs taken.  The
state before a word is the longest seen suffix of the words before it; a whole
block of texts walks at once, position by position in numpy.

The corpus never meets in one place: texts are dealt to blocks, counts come
from ``exchange`` (a block's distinct n-grams go to buckets of the key space,
the corpus counts come back), and a block's automaton holds only the n-grams
that occur in it, which is all its own texts can reach.  n-grams are told
apart by 64-bit hashes.

A text's tokens are its words (ASCII white space between, lower-case A-Z) and
one end token.  The end token also is the history of a text's first word.

Edge cases: a NULL or empty text is one end token; without training texts all
counts are 0 and the base is uniform; rows with a NULL id are scored and count
as training unless the split says otherwise; equal rows are scored and counted
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapestry.llm.common import longs_in, mix64, text_blocks, texts_in, words_of
from tapestry.llm.exchange import ANSWERS, PACKETS, answer_table, answers_in, counts_in, key_arrays, packet_rows, packet_table

END = b" "  # no word holds a space
ORDER = 2
#: Weight of the shorter history, in words.
PRIOR = 200.0
BLOCK_BYTES = 8 << 20
NO_ID = np.iinfo(np.int64).min


class Tokens:
    """The tokens of some texts: word numbers, word keys, and text ends."""

    def __init__(self, texts: list[str | None]):
        vocab: defaultdict[bytes, int] = defaultdict()
        vocab.default_factory = vocab.__len__
        vocab[END]
        words = [[*words_of(t, lower=True), END] for t in texts]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        self.ids = np.fromiter(map(vocab.__getitem__, chain.from_iterable(words)), np.int64, int(self.lengths.sum()))
        self.word_keys = np.fromiter(map(xxhash.xxh3_64_intdigest, vocab), np.uint64, len(vocab))

    def history_ids(self) -> np.ndarray:
        """The word before each position; the end token before a text's first."""
        before = np.empty_like(self.ids)
        before[1:] = self.ids[:-1]
        before[self.starts] = 0
        return before

    def gram_keys(self, order: int) -> list[np.ndarray]:
        """Keys of the n-grams that end at each position, for n = 2..order (0
        where a text is too short to hold one)."""
        out, depth = [], np.arange(len(self.ids)) - np.repeat(self.starts, self.lengths)
        words, keys = self.word_keys[self.ids], self.word_keys[self.ids]
        before = self.word_keys[self.history_ids()]
        for n in range(2, order + 1):
            older = before if n == 2 else np.concatenate([np.zeros(n - 1, np.uint64), words[: -(n - 1)]])[: len(words)]
            if n > 2:  # the end token stands right before a text's first word
                older = np.where(depth == n - 2, self.word_keys[0], older)
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + mix64(older + np.uint64(n)))
            keys = np.where(depth >= n - 2, np.maximum(keys, np.uint64(1)), np.uint64(0))
            out.append(keys)
        return out


def train_mask(table: pa.Table, tokens: Tokens) -> np.ndarray:
    return np.repeat(table.column("train").to_numpy(zero_copy_only=False).astype(bool), tokens.lengths)


def count_in(ids: np.ndarray, mask: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(ids[mask], minlength=size).astype("<u8")


def sum_bucket(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a bucket, their corpus counts, each key's place among
    them, and the packets' ends."""
    keys, ends = key_arrays(table)
    counts = counts_in(table, ends)
    uniq, place = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(place, weights=counts, minlength=len(uniq)).astype("<u8"), place, ends


def corpus_size(docs: DataFrame, key: str, text: str, train: Column, buckets: int, flush: int = 500_000) -> tuple[int, int]:
    """(N, V): tokens and distinct tokens of the training texts.  Two numbers
    reach the driver; the words are counted by buckets of the key space."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = defaultdict(int)

        def packets() -> pa.Table:
            keys = np.fromiter(map(xxhash.xxh3_64_intdigest, counts), np.uint64, len(counts))
            order = np.argsort(keys)
            return packet_table(packet_rows(0, 1, buckets, keys[order], np.fromiter(counts.values(), "<u8", len(counts))[order], counts=True))

        for batch in batches:
            for t in batch.column("text").to_pylist():
                for w in words_of(t, lower=True):
                    counts[w] += 1
                counts[END] += 1
                if len(counts) > flush:
                    yield from packets().to_batches()
                    counts.clear()
        if counts:
            yield from packets().to_batches()

    def reduce(table: pa.Table) -> pa.Table:
        _, counts, _, _ = sum_bucket(table)
        return pa.table({"n": [int(counts.sum())], "v": [len(counts)]})

    packets = docs.filter(train).select(F.col(text).alias("text")).mapInArrow(emit, PACKETS)
    got = packets.groupBy("bucket").applyInArrow(reduce, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return got[0] or 0, got[1] or 0


def score_texts(
    docs: DataFrame,
    train: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    order: int = ORDER,
    prior: float = PRIOR,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Score every row's text by the model of the rows where ``train`` holds.

    Returns doc_id, train, n_tokens, n_known, train_tokens, base_score (the
    add-one unigram log10 probability) and score (the automaton's).
    """
    blocked, blocks = text_blocks(docs, id_col, text_col, block_bytes, F.coalesce(train, F.lit(True)).alias("train"))
    total, distinct = corpus_size(docs, id_col, text_col, F.coalesce(train, F.lit(True)), blocks)
    size = total + distinct + 1

    def emit(table: pa.Table) -> pa.Table:
        tokens, block = Tokens(texts_in(table)), table.column("block")[0].as_py()
        mask = train_mask(table, tokens)
        by_key = np.argsort(tokens.word_keys)
        rows = packet_rows(block, 1, blocks, tokens.word_keys[by_key], count_in(tokens.ids, mask, len(by_key))[by_key], counts=True)
        for n, keys in enumerate(tokens.gram_keys(order), 2):
            uniq, place = np.unique(keys, return_inverse=True)
            rows += packet_rows(block, n, blocks, uniq, count_in(place, mask, len(uniq)), counts=True)
        return packet_table(rows)

    def count(table: pa.Table) -> pa.Table:
        _, counts, place, ends = sum_bucket(table)
        return answer_table(table, ends, counts[place], counts=True)

    def walk(table: pa.Table, answers: pa.Table) -> pa.Table:
        tokens = Tokens(texts_in(table))
        words = np.empty(len(tokens.word_keys), np.float64)
        words[np.argsort(tokens.word_keys)] = answers_in(answers, 1)
        seen = words[tokens.ids]  # corpus count of each token
        history = words[tokens.history_ids()]
        prob = (seen + 1) / size
        base = np.log10(prob)
        weight = base.copy()  # of the arcs taken so far, from the shortest history up
        for n, keys in enumerate(tokens.gram_keys(order), 2):
            _, place = np.unique(keys, return_inverse=True)
            arcs = answers_in(answers, n)[place].astype(np.float64)
            arcs[keys == 0] = 0
            history = np.where(keys == 0, 0, history)
            prob = (arcs + prior * prob) / (history + prior)
            fail = np.log10(prior / (history + prior))
            weight = np.where(arcs > 0, np.log10(prob), fail + weight)
            history = np.concatenate([[0.0], arcs[:-1]])  # the state one word longer
        ids = longs_in(table, "key")
        add = lambda x: np.add.reduceat(x, tokens.starts)  # noqa: E731  every text has a token
        return pa.table({
            "doc_id": pa.array(ids, mask=ids == NO_ID),
            "train": table.column("train"),
            "n_tokens": tokens.lengths,
            "n_known": add((seen > 0).astype(np.int64)),
            "train_tokens": np.full(len(ids), total, np.int64),
            "base_score": add(base),
            "score": add(weight),
        })

    answers = blocked.groupBy("block").applyInArrow(emit, PACKETS).groupBy("kind", "bucket").applyInArrow(count, ANSWERS)
    out = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(walk, out)


def lm_scores(docs: DataFrame, **options) -> DataFrame:
    """Scores with every seventh document (by a hash of its id) held out."""
    held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    scored = score_texts(docs, ~held, **options)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
