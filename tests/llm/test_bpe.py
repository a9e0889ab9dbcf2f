"""Encoding against the tiktoken library, decoding by round trips."""

import hashlib
import random

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from riskweave.llm import bpe
from riskweave.llm.common import bounded_batches

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "\n\n  \t x", "it's we'll", "a" * 5000, "Grüße, señor! ñandú ça va?", "漢字かな交じり文 кириллица", "😀🎉 emoji", "\x00\x1f\x7f\x85\xa0",
       "abcdefgh" * 3000, "1234567890" * 50, "word " * 20000, " ́e combining", "<|endoftext|>"]


@pytest.fixture(scope="module")
def merges():
    return bpe.load_merges(PATH)


@pytest.fixture(scope="module")
def library(merges):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(merges):
    return bpe.Encoder(merges)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_library(text):
    merges = bpe.load_merges(PATH)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=merges.ranks, special_tokens={})
    encoder = _encoder()
    assert [i for p in bpe.Splitter(P.PATTERN)(text) for i in encoder.encode(p.encode())] == library.encode_ordinary(text)


def _encoder(held=[]):  # noqa: B006
    if not held:
        held.append(bpe.Encoder(bpe.load_merges(PATH)))
    return held[0]


@pytest.mark.parametrize("letters", ["ab", "aaab", "abcdefghij", "éèüß", "0123456789", "etaoinshr"])
def test_merges_of_dense_pieces(encoder, library, letters):
    random.seed(letters)
    for _ in range(300):
        text = "".join(random.choices(letters, k=random.randint(1, 40)))
        assert [i for p in bpe.Splitter(P.PATTERN)(text) for i in encoder.encode(p.encode())] == library.encode_ordinary(text)


def test_long_piece_is_linear_and_round_trips(encoder, merges):
    random.seed(3)
    piece = "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=300_000)).encode()
    assert b"".join(merges.tokens[i] for i in encoder.encode(piece)) == piece


def test_columns(docs, library):
    rows = docs(ODD).withColumn("ids", bpe.encode("text", PATH, P.PATTERN)).withColumn("back", bpe.decode("ids", PATH)).withColumn(
        "digest", bpe.ids_digest("ids")).withColumn("t", bpe.encode_and_decode("text", PATH, P.PATTERN)).collect()
    for r, text in zip(sorted(rows, key=lambda r: r.doc_id), ODD):
        if text is None:
            assert r.ids is None and r.back is None and r.digest is None and tuple(r.t) == (None, None, None)
        else:
            want = library.encode_ordinary(text)
            assert r.t.ids == want and bytes(r.t.decoded) == text.encode() and r.t.digest == r.digest
            assert r.ids == want and bytes(r.back) == text.encode()
            assert r.digest == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_empty_table_and_bad_ids(docs, spark):
    assert docs([]).select(bpe.encode("text", PATH, P.PATTERN)).count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        spark.createDataFrame([([5, 10**6],)], "ids array<int>").select(bpe.decode("ids", PATH)).collect()


def test_vocabulary_must_hold_every_byte():
    with pytest.raises(ValueError, match="without a token"):
        bpe.Merges({b"a": 0})


def test_unknown_class_falls_back():
    assert bpe.narrow(r"\p{Lu}+") is None


def test_batches_are_bounded_by_bytes(spark, docs):
    """A few huge texts must not travel as one batch, however few rows they are."""
    bounded_batches(spark)
    df = docs(["ab " * 7_000_000] * 8).coalesce(1).select("text")
    sizes = df.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n long").collect()
    assert sum(r.n for r in sizes) == 8 and max(r.n for r in sizes) <= 4
