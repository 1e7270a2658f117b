"""The word-cached encoder against the library on whole texts."""

import random

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from almanac.llm import packing
from almanac.llm.tokens import WordEncoder, gathered

PARTS = [*"ab Zé. ,'s1\t\n\r\x0b\x1c\x1f\x85\xa0   　漢字яЩ́!@ Å̸<", "'ve", "'s", "'ll", " "]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_library(name):
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += [None, "", " ", "　 x", "<|endoftext|> a<|startoftext|>", "word " * 3000, "x" * 5000]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    own = WordEncoder(public_tokenizers.path(name))
    assert list(own.encode(texts)) == want
    assert list(own.encode(texts[::-1])) == want[::-1]
    assert list(own.encode([])) == [] and list(own.encode([None, ""])) == [b"", b""]


def test_bounds_of_words_and_texts():
    words = iter(range(10**9))
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(50)), "text": [" ".join(f"w{next(words)}" for _ in range(40)) for _ in range(50)]}) for _ in range(30)]
    own, sizes = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), cached=10_000), []
    for _, texts in gathered(iter(batches), together=50_000):
        sizes.append(sum(map(len, texts)))
        assert len(list(own.encode(texts))) == len(texts)
    assert len(sizes) > 5 and max(sizes) < 100_000
    assert next(words) == 60_000 and len(own.cache) + len(own.older) < 2 * (10_000 + max(sizes) // 6)  # all of them with the plain bound


def test_pipeline_sets_its_own_bounds(monkeypatch):
    monkeypatch.setattr(packing, "pack_documents", lambda docs, vocab, **bounds: bounds)
    bounds = corpus_pipeline.packed(None, None, "")
    assert bounds["together"] <= packing.TOGETHER // 8 and bounds["cached"] <= packing.CACHE_WORDS // 3


def test_pieces_do_not_depend_on_the_bounds(spark):
    texts = [(k, " ".join(f"Word{k * j % 97} ,é{j}" for j in range(30 * (k % 9)))) for k in range(200)] + [(None, None), (3, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    made = [sorted(map(repr, packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), window=100, **bounds).collect())) for bounds in ({}, {"together": 1, "cached": 5})]
    assert made[0] == made[1] and len(made[0]) > len(texts)
