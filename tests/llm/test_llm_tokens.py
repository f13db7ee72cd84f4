"""Token files: packing, encoder, and a round trip."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tapestry.llm.tokens import BLOCK_IDS, Encoder, Segment, file_starts, id_bits, pack, segment, segments, token_table, tokenizer_path, unpack_words


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32).flatmap(lambda b: st.tuples(st.just(b), st.lists(st.integers(0, (1 << b) - 1), max_size=300))))
def test_pack_round_trip(case):
    bits, ids = case
    assert unpack_words(pack(np.array(ids, np.uint32), bits), bits, len(ids)).tolist() == ids


def test_segment_random_access():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50_257, 3 * BLOCK_IDS + 17).astype(np.uint32)
    raw = segment(np.array([4, 9]), np.array([5, len(ids) - 5]), ids, id_bits(50_257))
    both = list(segments(raw + b"\n" + raw + b"\n"))
    assert len(both) == 2 and both[1].doc_ids.tolist() == [4, 9] and id_bits(50_257) == 16
    for a, b in ((0, 0), (0, 7), (BLOCK_IDS - 1, BLOCK_IDS + 1), (5, len(ids))):
        assert (Segment(memoryview(raw)).unpack(a, b) == ids[a:b]).all()


@pytest.fixture(scope="module")
def encoder():
    return Encoder(tokenizer_path("byte_bpe_50k.json"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sté1 ,.\n\t \r–!😀|<>"), max_size=40), min_size=1, max_size=5))
def test_encoder_equals_library(encoder, texts):
    want = encoder.whole.encode_batch(texts, add_special_tokens=False)
    ids, sizes = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for w in want for i in w.ids] and sizes.tolist() == [len(w.ids) for w in want]


def test_round_trip(spark, odd_docs, encoder):
    rows = token_table(odd_docs, segment_ids=50).collect()
    docs = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    want = sorted((-1 if d is None else d, len(e.ids) + 1, zlib.crc32(np.array([*e.ids, 0], "<u4")))
                  for (d, _), e in zip(docs, encoder.whole.encode_batch([t or "" for _, t in docs], add_special_tokens=False)))
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows) == want
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [-1 if r["doc_id"] is None else r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert in_order == sorted(in_order)


@pytest.fixture(scope="module")
def fresh():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))


def test_added_tokens_have_their_own_id(spark, fresh):
    end = "<|endoftext|>"
    texts = [f"a b{end} c", end, f"{end}{end}", f"one two\n{end}\nthree, four", f"x {end}", f"{end} x", "a <|endof text|> c", "a <|endoftext| > b", "plain text"]
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 275, 50256, 269]
    ids, sizes = Encoder(tokenizer_path("byte_bpe_50k.json")).encode(pa.array(texts))
    assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    rows = token_table(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in rows} == {k: (len(w) + 1, zlib.crc32(np.array([*w, 0], "<u4"))) for k, w in enumerate(want)}


_ALPHABET = st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "ab", "'s", "t\u00e9", "1", " ", ",", ".", "\n", "\t", "\U0001f600"])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(_ALPHABET, max_size=12).map("".join), min_size=1, max_size=5))
def test_encoder_equals_a_fresh_library(encoder, fresh, texts):
    want = fresh.encode_batch(texts, add_special_tokens=False)
    ids, sizes = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for w in want for i in w.ids] and sizes.tolist() == [len(w.ids) for w in want]


def test_empty_table(spark, no_docs):
    assert token_table(no_docs).collect() == []


def test_files_hold_few_segments(spark):
    """A reader holds whole files, so a task's segments go to several."""
    docs = spark.range(55_000).selectExpr("id AS doc_id", "concat('word ', id) AS text")
    rows = token_table(docs, segment_ids=1).toPandas().sort_values("start")
    assert rows.doc_id.tolist() == list(range(55_000))
    assert rows.start.tolist() == [0, *rows.n_tokens.cumsum()[:-1]]
    assert rows.file.nunique() > 1 and rows.segment.max() < 4


def test_files_stand_by_number(spark):
    names = [f"file:/d/part-{task}-1a-c{n}.txt" for task, n in (("00000", "000"), ("00000", "999"), ("00000", "1000"), ("00002", "000"), ("100000", "000"))]
    rows = spark.createDataFrame([(f, k + 1) for k, f in enumerate(names)], "file string, n_tokens long")
    assert {r["file"]: r["before"] for r in file_starts(rows).collect()} == dict(zip(names, [0, 1, 3, 6, 10], strict=True))
