"""Token ids in fixed-width bit-packed files.

``write_token_files`` encodes whole texts, appends an end id to each document
and writes the ids in ascending document order; ``read_token_files`` reads the
files back.  Each id takes the minimum number of bits of the vocabulary.

File layout (little-endian): a file is a run of segments, each

    magic            8 bytes  b"TAPTOK01"
    bits             u32      bits of an id
    block_ids        u32      ids of a block (a multiple of 64)
    n_docs           u64
    n_ids            u64
    payload_bytes    u64
    doc_ids          i64[n_docs]      smallest long for a NULL doc_id
    doc_ends         u64[n_docs]      ids of this segment up to the document's end
    block_offsets    u64[n_blocks+1]  byte offset of each block in the payload
    payload          packed blocks, each starting on a whole 64-bit word
    newline          1 byte

``unpack`` decodes any id range by touching only the blocks that hold it.
Files are written by Spark's own committer (no half-written file of a lost
executor is ever seen) and read with Spark's binary reader, so any storage
that Spark reaches will do.  A segment holds at most ``segment_ids`` ids
besides the last slice of text, and a file ``file_segments`` segments, which
bounds the memory of the tasks that write and read them.

Edge cases: a NULL or empty text is only the end id; rows with a NULL doc_id
come first; rows that share a doc_id follow one another, ordered by a hash of
their text, equal rows each kept; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapestry.llm.common import longs_in, release, scratch_path, stage

MAGIC = b"TAPTOK01"
HEAD = 40
BLOCK_IDS = 65_536
NO_ID = np.iinfo(np.int64).min


def id_bits(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive ``bits``-wide fields of 64-bit words; 64 ids fill
    exactly ``bits`` words, so the loop is over 64 lanes, not over ids."""
    lanes = np.zeros((-(-len(ids) // 64), 64), np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= lanes[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= lanes[:, k] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack_words(raw: bytes | memoryview, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of what ``pack`` returned."""
    words = np.frombuffer(raw, "<u8").reshape(-1, bits)
    mask = np.uint64((1 << bits) - 1)
    out = np.empty((len(words), 64), np.uint32)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        lane = words[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            lane = lane | (words[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = lane & mask
    return out.reshape(-1)[:n]


def segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """One self-contained segment (without the newline)."""
    blocks = [pack(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    payload = b"".join(blocks)
    head = MAGIC + np.array([bits, block_ids], "<u4").tobytes() + np.array([len(doc_ids), len(ids), len(payload)], "<u8").tobytes()
    return b"".join([head, doc_ids.astype("<i8").tobytes(), np.cumsum(lengths).astype("<u8").tobytes(), offsets.tobytes(), payload])


class Segment:
    """A view on one segment of a file's bytes."""

    def __init__(self, raw: memoryview):
        if bytes(raw[:8]) != MAGIC:
            raise ValueError("not a token segment")
        self.bits, self.block_ids = (int(x) for x in np.frombuffer(raw[8:16], "<u4"))
        n_docs, self.n_ids, size = (int(x) for x in np.frombuffer(raw[16:HEAD], "<u8"))
        n_blocks = -(-self.n_ids // self.block_ids)
        at = HEAD
        self.doc_ids = np.frombuffer(raw[at : at + 8 * n_docs], "<i8")
        at += 8 * n_docs
        self.doc_ends = np.frombuffer(raw[at : at + 8 * n_docs], "<u8").astype(np.int64)
        at += 8 * n_docs
        self.offsets = np.frombuffer(raw[at : at + 8 * (n_blocks + 1)], "<u8").astype(np.int64)
        at += 8 * (n_blocks + 1)
        self.payload = raw[at : at + size]
        self.end = at + size

    def unpack(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the segment, from their blocks alone."""
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        parts = [
            unpack_words(self.payload[self.offsets[b] : self.offsets[b + 1]], self.bits, min(self.block_ids, self.n_ids - b * self.block_ids))
            for b in range(first, last)
        ]
        ids = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        return ids[start - first * self.block_ids : stop - first * self.block_ids]


def segments(raw: bytes) -> Iterator[Segment]:
    """The segments of a file."""
    view, at = memoryview(raw), 0
    while at < len(view):
        s = Segment(view[at:])
        yield s
        at += s.end + 1


class Encoder:
    """The tokenizers library, asked once for each distinct word of a task (a
    table of at most ``MOST`` words is kept, and begun anew when full).

    Byte-level BPE first parts a text into letters, digits, other signs and
    white space, a single space going with what follows it.  So where every
    white space is a lone space or newline, a text can be parted at those and
    each distinct word encoded once.  A word that is letters and then signs is
    encoded as those two parts by a second tokenizer that skips the library's
    own parting; any other word, any text with other white space and any text
    that holds an added token's content ("<|endoftext|>" has an id of its own)
    goes through the library as it is.
    """

    MOST = 1 << 19
    SIGNS = ".,;:!?%&$*#-()|/"
    TAIL = "^.*?([.,;:!?%&$*#\\-()|/]*)$"
    #: White space that is not a lone space or newline.
    ODD = "  |\n\n| \n|\n |[\t\r\x0b\x0c\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    #: Letters of long-settled alphabets (the others take the library's own way).
    LETTERS = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03a3-\u03c9\u0410-\u044f]+$"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        added = [t.content for t in self.whole.get_added_tokens_decoder().values() if t.content]
        self.odd = "|".join([self.ODD, *("".join(f"\\x{{{ord(c):x}}}" for c in t) for t in added)])
        parting = json.loads(self.whole.to_str())["pre_tokenizer"] or {}
        self.by_word = parting.get("type") == "ByteLevel" and parting.get("use_regex") and not parting.get("add_prefix_space")
        # byte-level BPE's letters: printable bytes stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in plain]
        self.letters = {x: x for x in plain} | {x: 256 + i for i, x in enumerate(rest)}
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True  # asked for words of letters alone
        self.bare.pre_tokenizer = pre_tokenizers.Split(chr(self.letters[10]), "isolated")
        self.newline = self._ids(["\n"])[0]
        self._forget()

    def _forget(self) -> None:
        """An empty table: words' numbers, their two pieces, and the pieces
        (their sizes, and their ids one after the other; piece 0 is empty)."""
        self.words = pa.array([], pa.string())
        self.two = np.empty((0, 2), np.int32)
        self.sizes, self.flat = np.zeros(1, np.int32), np.empty(0, "<u4")

    def _numbers(self, words: pa.Array) -> np.ndarray:
        """The table's numbers of distinct words; new words are encoded."""
        if len(self.words) >= self.MOST:
            self._forget()
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = np.flatnonzero(at < 0)
        if len(new):
            added = words.take(pa.array(new))
            pieces, two = self._word_pieces(added)
            self.two = np.concatenate([self.two, np.where(two > 0, two + len(self.sizes) - 1, 0).astype(np.int32)])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, pieces[1:]), np.int32, len(pieces) - 1) // 4])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(pieces), "<u4")])
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, added])
        return at

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, each with a space in front: one call, the
        words parted by newlines, whose id then marks their ends."""
        if not words:
            return []
        text = (" " + "\n ".join(words)).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(ids == np.frombuffer(self.newline, "<u4")[0]) * 4).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]

    def _word_pieces(self, words: pa.Array) -> tuple[list[bytes], np.ndarray]:
        """Pieces of ids (piece 0 is empty), and the two pieces of each distinct
        word as it follows a space, or a newline that is its first character."""
        cores = pc.utf8_rtrim(words, self.SIGNS)
        alpha = pc.match_substring_regex(cores, self.LETTERS)
        core = cores.filter(alpha).dictionary_encode()
        tail = pc.replace_substring_regex(words.filter(alpha), self.TAIL, "\\1").dictionary_encode()
        other = words.filter(pc.invert(alpha)).to_pylist()
        got = self._ids([w[1:] if w[:1] == "\n" else " " + w for w in other])
        rest = [self.newline + g if w[:1] == "\n" else g for w, g in zip(other, got, strict=True)]
        pieces = [b"", *self._letters_ids(core.dictionary.to_pylist()), *self._ids(tail.dictionary.to_pylist()), *rest]
        n_core, n_tail = len(core.dictionary), len(tail.dictionary)
        turn = alpha.to_numpy(zero_copy_only=False)
        two = np.zeros((len(words), 2), np.int64)
        two[turn, 0] = 1 + core.indices.to_numpy(zero_copy_only=False)
        two[turn, 1] = 1 + n_core + tail.indices.to_numpy(zero_copy_only=False)
        two[~turn, 0] = 1 + n_core + n_tail + np.arange(len(other))
        return pieces, two

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's number of ids
        (a NULL has none)."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, self.odd).to_numpy(zero_copy_only=False) if self.by_word else np.ones(len(texts), bool)
        parts = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
        lists, words = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
        first = np.cumsum(lists) - lists
        later = np.ones(len(words), bool)
        later[first] = False
        found = words.filter(pa.array(later)).dictionary_encode()
        starts = iter(self._ids(words.take(pa.array(first)).to_pylist()))
        numbers = self._numbers(found.dictionary)
        whole = iter(self._ids(texts.filter(pa.array(odd)).to_pylist()))
        # a text's pieces: its first word (or all of it), then two for each later word
        heads = [next(whole) if o else next(starts) for o in odd.tolist()]
        size = np.concatenate([self.sizes, np.fromiter(map(len, heads), np.int32, len(heads)) // 4])
        at = np.cumsum(size, dtype=np.int64) - size
        flat = np.concatenate([self.flat, np.frombuffer(b"".join(heads), "<u4")])
        n_words = np.ones(len(texts), np.int64)
        n_words[~odd] = lists
        ends = np.cumsum(n_words)
        order = np.zeros((int(ends[-1]) if len(ends) else 0, 2), np.int32)
        head = np.zeros(len(order), bool)
        head[ends - n_words] = True
        order[head, 0] = len(self.sizes) + np.arange(len(texts))
        order[~head] = self.two[numbers[found.indices.to_numpy(zero_copy_only=False)]]
        order = order.reshape(-1)
        width = size[order]
        run = np.cumsum(width, dtype=np.int64)
        ids = flat[np.arange(int(run[-1]) if len(run) else 0) + np.repeat(at[order] - (run - width), width)]
        return ids, np.add.reduceat(width, 2 * (ends - n_words)).astype(np.int64) if len(texts) else np.empty(0, np.int64)


def text_slices(texts: pa.Array, most: int = 3 << 20) -> Iterator[tuple[int, int]]:
    """(start, rows) of slices of about ``most`` bytes of text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most)))
        yield at, min(end, len(texts)) - at
        at = end


def tokenizer_path(file: str) -> str:
    """Where an installed public tokenizer's file is on this machine."""
    import public_tokenizers

    return public_tokenizers.path(file)


def write_token_files(
    docs: DataFrame,
    path: str,
    tokenizer_file: str = "byte_bpe_50k.json",
    vocabulary: int = 50_257,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment_ids: int = 500_000,
    file_bytes: int = 64 << 20,
    file_segments: int = 4,
) -> None:
    """Encode ``text_col`` of every row and write bit-packed files under ``path``.

    Rows are dealt to tasks of about ``file_bytes`` of text by ranges of
    ``id_col`` (then of a text hash, so an id that many rows share is split); a
    task starts a new file after ``file_segments`` segments, since a reader
    holds whole files.  The numbers of ranges, and of files in a range, ascend
    with the ids.
    """
    bits = id_bits(vocabulary)
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    ranges = int(size // file_bytes) + 1

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from encoded(batches)
        release()  # once nothing of the task is held any more

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path(tokenizer_file))
        keys: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            raw = segment(np.concatenate(keys), np.concatenate(lengths), np.concatenate(parts), bits)
            keys.clear(), parts.clear(), lengths.clear()
            return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], names=["segment"])

        for batch in batches:
            for i, n in text_slices(batch.column("text")):
                ids, sizes = encoder.encode(batch.column("text").slice(i, n))
                ends = np.cumsum(sizes)
                keys.append(longs_in(batch.slice(i, n), "key"))
                parts.append(np.insert(ids, ends, end_id))
                lengths.append(sizes + 1)
                held += len(ids) + n
                if held >= segment_ids:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    ordered = (
        docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(ranges, "key", "tie")
        .sortWithinPartitions("key", "tie")
        .select("key", "text")
    )
    lines = ordered.mapInArrow(encode, "segment binary").select(F.col("segment").cast("string").alias("value"))
    lines.write.option("maxRecordsPerFile", file_segments).text(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of the files: doc_id, n_tokens, ids_crc32 and where
    it lies (file, segment, and ``at``, its first id's place in the file)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from decoded(batches)
        release()

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                before = 0
                for k, s in enumerate(segments(content.as_buffer())):
                    ids = s.unpack(0, s.n_ids).astype("<u4")
                    starts = np.concatenate([[0], s.doc_ends[:-1]]).astype(np.int64)
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts, s.doc_ends, strict=True)]
                    n = len(starts)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * n), pa.array([k] * n, pa.int32()), pa.array(before + starts),
                            pa.array(s.doc_ids, mask=s.doc_ids == NO_ID), pa.array(s.doc_ends - starts), pa.array(crc, pa.int64()),
                        ],
                        names=["file", "segment", "at", "doc_id", "n_tokens", "ids_crc32"],
                    )
                    before += s.n_ids

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(decode, "file string, segment int, at long, doc_id long, n_tokens long, ids_crc32 long")


def file_starts(rows: DataFrame) -> DataFrame:
    """(file, before): ids in all files that come earlier, of the rows that
    ``read_token_files`` gave.  Files stand in the order of their range's number,
    then of their own number in it (names do not sort so from a hundred thousand
    ranges, or a thousand files, on); the running total is over one row a file."""
    name = r"part-(\d+)-[^/]*-c(\d+)\.[^/]*$"
    numbers = [F.regexp_extract("file", name, k).cast("long").alias(n) for k, n in ((1, "range"), (2, "number"))]
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", *numbers)
    order = Window.orderBy("range", "number").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))


def token_table(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the files (to a new scratch folder unless ``path`` is given) and
    return what they hold: doc_id, start, n_tokens, ids_crc32, file, segment."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "tokens")
    write_token_files(docs, path, **options)
    rows = stage(read_token_files(spark, path), "token-rows")
    rows = rows.join(file_starts(rows), "file")
    return rows.select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "file", "segment")
