"""Encoding by speculation and decoding, held against the tokenizers library."""

import hashlib
import random

import fixtures
import numpy as np
import public_tokenizers
import pytest
from placeloom.llm import bpe_codec, bpe_pairs, queries_codec
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>  c", "<|end of text|>", "İΣ ΑΣ\x1c x\ty　z q",
    "é" * 300 + "́a ́b", "a\x00b " * 40, "'s't 're isn't we'll", "퟿\U0001F600 ok", "A" * 3 + "\n\n\n B",
    " lead", "0123456789", "٣ Ⅷ ½", "x" * 5000, "ab" * 3000, "tail \n", "#*$ %&| <> " * 30,
]


@pytest.fixture(scope="module")
def library():
    loaded = Tokenizer.from_file(PATH)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def random_words(seed, letters, n, longest=14):
    random.seed(seed)
    return ["".join(random.choice(letters) for _ in range(random.randint(1, longest))) for _ in range(n)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_equal_the_library(name):
    """Proposed, verified and merged words give what the model alone gives."""
    path = public_tokenizers.path(name)
    pairs = bpe_pairs.Pairs(path)
    letters = [chr(c) for c in [*range(97, 123), 0xC3, 0xA9, 0xB1, 33, 48]]
    words = sorted({*random_words(1, letters, 4000), *random_words(2, "abthein", 4000), "a" * 7, "e" * 300, "th" * 200})
    want = [e.ids for e in Tokenizer(Tokenizer.from_file(path).model).encode_batch(words, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in pairs.encode(words)]
    assert pairs.proper and got == want
    forms = [pairs.word(w) for w in words]
    assert [np.frombuffer(x, "<u4").tolist() for x in pairs.merge(forms)] == want
    tokens, _, good = pairs.propose(forms)
    assert good.all() and 0 < len(tokens)


def test_pairs_equal_merging():
    """The test of a pair is that merging the letters of both gives the pair back."""
    pairs = bpe_pairs.Pairs(PATH)
    names = {number: pairs.symbol(token) for token, number in Tokenizer.from_file(PATH).get_vocab().items()}
    rng = np.random.default_rng(3)
    a = rng.integers(0, 49406, 3000)
    a = a[[ord(names[t][-1]) < 0x1000 for t in a.tolist()]]  # one that ends a word has no neighbour
    b = rng.integers(0, 49406, len(a))
    merged = pairs.merge([names[x] + names[y] for x, y in zip(a.tolist(), b.tolist())])
    want = [np.frombuffer(m, "<u4").tolist() == [x, y] for m, x, y in zip(merged, a.tolist(), b.tolist())]
    assert pairs.compatible(a, b).tolist() == want and any(want) and not all(want)


def test_texts_equal_the_library(spark, library):
    rows = fixtures.odd_documents() + [(100 + k, t, None, None, None) for k, t in enumerate(ODD)]
    docs = fixtures.frame(spark, rows)
    found = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH).collect()
    assert len(found) == len(rows)
    for r in found:
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert np.frombuffer(r.ids, "<u4").tolist() == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_remembered_chunks_are_forgotten(library, monkeypatch):
    monkeypatch.setattr(bpe_codec, "_REMEMBERED", 50)
    own = bpe_codec.Codec(PATH)
    texts = [" ".join(random_words(k, "abcdefgh ", 30)) for k in range(20)] * 2
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(own.encode([t])[0], "<u4").tolist() for t in texts] == want
    assert len(own.known) <= 400


def test_clashes_and_empty_tables(spark):
    docs = fixtures.frame(spark, fixtures.odd_documents()).selectExpr("*", "'x' AS ids", "'y' AS decoded", "'z' AS _value")
    both = bpe_codec.decode(bpe_codec.encode(docs, PATH), PATH)
    assert dict(both.dtypes)["ids"] == "binary" and both.count() == docs.count()
    assert {r["_value"] for r in both.select("`_value`").collect()} == {"z"}
    assert bpe_codec.decode(bpe_codec.encode(docs.limit(0), PATH), PATH).collect() == []
    nothing = spark.createDataFrame([(None,), (bytearray(),)], "ids binary")
    assert [r.decoded for r in bpe_codec.decode(nothing, PATH).collect()] == ["", ""]


def test_query_digests(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries_codec.op13_bpe_codec(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        r = got[d.doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
