"""Token counts, token files and packing against the libraries and brute force."""

import itertools
import zlib

import fixtures
import numpy as np
import public_tokenizers
import pytest
from placeloom.llm import packing, token_counts, token_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = [
    "a  b", " lead", "trail ", "a \n b", "tab\t x", "it's we'll I'd", "<|endoftext|> in", "x<|endoftext|>y", "  nbsp",
    "Á é ́", "İstanbul ΣΑΣ ß", "日本語 テキスト", "🙂 🙂", "12345 6.7", "a\x1cb \x1c c", "   ", "\r\n \r\n",
    "<|startoftext|>start", "  ", "\n\n \n", "!!??  ...",
]


def documents():
    rows = [(i, t) for i, t, *_ in fixtures.odd_documents()]
    return rows + [(1000 + k, t) for k, t in enumerate(ODD)]


def encoded(name, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_counts_equal_the_library(spark, monkeypatch):
    rows = documents()
    docs = fixtures.with_clashes(fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).repartition(3)
    got = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = [(str(i), len((t or "").encode()), len(ids)) for (i, t), ids in zip(rows, encoded("word_bpe_49k.json", [t for _, t in rows]))]
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == sorted(want)


def test_counts_over_several_blocks(spark, monkeypatch):
    rows = [(k, fixtures.prose(k, 200, 3000)) for k in range(40)]
    docs = fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows]).coalesce(1)
    schema = token_counts._arrow(docs.select("doc_id").schema)
    assert schema.names == ["doc_id"]
    got = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    want = {i: len(ids) for (i, _), ids in zip(rows, encoded("word_bpe_49k.json", [t for _, t in rows]))}
    assert {r.doc_id: r.n_tokens for r in got} == want


def test_counts_on_empty_table(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert token_counts.count_tokens(fixtures.frame(spark, []), path).collect() == []


def test_files_round_trip(spark):
    rows = documents()
    docs = fixtures.with_clashes(fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).repartition(4)
    files = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want, start = [], 0
    ids = [x + [0] for x in encoded("byte_bpe_50k.json", [t for _, t in ordered])]
    for (i, _), x in zip(ordered, ids):
        want.append((str(i), start, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        start += len(x)
    got = [(str(r.doc_id), r.start, r.n_tokens, r.ids_crc32) for r in files.documents().collect()]
    assert sorted(got) == sorted(want)
    first = {}
    for (i, _), x in zip(ordered, ids):
        first.setdefault(i, x)
    asked = [11, 1003, 17, 18, 5, -4, 999_999, None, 11]
    found = files.lookup(spark.createDataFrame([(k,) for k in asked], "doc_id long")).collect()
    assert {r.key: r.ids for r in found} == {k: first.get(k) for k in asked if k is not None}


def test_files_of_empty_table(spark):
    files = token_files.write(fixtures.frame(spark, []), public_tokenizers.path("byte_bpe_50k.json"))
    assert files.documents().collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 100, 3000])
def test_index_is_minimal_and_perfect(n):
    keys = np.unique(np.random.default_rng(n).integers(-(1 << 62), 1 << 62, n))
    index = token_files.build_index(keys)
    assert len(index[1]) == len(index[2]) == len(keys)
    assert token_files.find_places(keys, *index).tolist() == list(range(len(keys)))
    strange = np.setdiff1d(np.arange(2000, dtype=np.int64), keys)
    assert (token_files.find_places(strange, *index) >= 0).sum() <= 1


def test_boundaries_are_optimal():
    rng = np.random.default_rng(3)
    rules = packing.Packing(max_tokens=160, step=16, buckets=3)
    for _ in range(30):
        counts = {int(b): int(rng.integers(1, 20)) for b in rng.choice(np.arange(1, 11), rng.integers(1, 9), replace=False)}
        bins = sorted(counts)
        ends = packing.boundaries(counts, rules)

        def padded(ends):
            return sum(n * 16 * min(e for e in ends if e >= b) for b, n in counts.items())

        choices = [
            (*c, bins[-1]) for c in itertools.combinations(bins[:-1], min(3, len(bins)) - 1)
        ]
        assert padded(ends) == min(map(padded, choices)) and len(ends) == min(3, len(bins))


def test_packing_holds_every_token_once(spark):
    rules = packing.Packing(max_tokens=64, step=8, buckets=4, budget=256)
    rows = fixtures.odd_documents()
    docs = fixtures.with_clashes(fixtures.frame(spark, rows))
    packed = packing.pack(docs, rules).collect()
    total = sum(len(fixtures.words_of(t)) for _, t, *_ in rows)
    assert sum(r.n_tokens for r in packed) == total
    placed = [r for r in packed if r.n_tokens]
    assert all(r.n_tokens <= r.padded <= 64 for r in placed)
    assert len({(r.batch, r.slot) for r in placed}) == len(placed)
    for batch in {r.batch for r in placed}:
        own = [r for r in placed if r.batch == batch]
        assert len({r.padded for r in own}) == 1 and sum(r.padded for r in own) <= 256
    assert all(r.batch is None and r.padded is None for r in packed if not r.n_tokens)
    assert sorted({r.batch for r in placed}) == list(range(len({r.batch for r in placed})))


def test_packing_of_empty_table_and_given_lengths(spark):
    assert packing.pack(fixtures.frame(spark, [])).collect() == []
    docs = fixtures.frame(spark, [(1, "x", "en", "s", 5), (2, None, None, None, None)])
    got = {r.doc_id: r.n_tokens for r in packing.pack(docs, length=F.col("n_chars")).collect()}
    assert got == {1: 5, 2: 0}


def test_encoder_and_pre_tokens_on_random_texts(monkeypatch):
    monkeypatch.setattr(token_files, "_REMEMBERED", 500)
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    path = public_tokenizers.path("word_bpe_49k.json")
    rng = np.random.default_rng(5)
    letters = list(" \n\t.,;!?'abÉé1２ ́<|#")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)] + ODD
    for text, ids in zip(texts, encoded("byte_bpe_50k.json", texts)):
        assert encoder.encode(text) == np.array(ids, "<u2").tobytes()
    for text, ids in zip(texts, encoded("word_bpe_49k.json", texts)):
        parts = [p for p in token_counts.pre_tokens(text) if p]
        assert sum(token_counts.piece_counts(parts, path)) == len(ids)


def test_token_packing_by_brute_force(spark):
    """Pieces, paddings and places of sequences, in tokens of the library; long words are cut."""
    rules = packing.Packing(max_tokens=64, step=8, buckets=4, budget=256)
    rows = documents() + [(2000, "abc123" * 2000), (2001, "日本語のテキスト" * 500)]
    docs = fixtures.with_clashes(fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).repartition(3)
    path = public_tokenizers.path("word_bpe_49k.json")
    got = [tuple(r) for r in packing.pack_tokens(docs, path, rules).collect()]
    cut = []
    for (i, _), ids in zip(rows, encoded("word_bpe_49k.json", [t for _, t in rows])):
        cut += [(i, k, min(64, len(ids) - 64 * k)) for k in range(max(1, -(-len(ids) // 64)))]
    cut.sort(key=lambda s: (-(-s[2] // 8), s[0] is not None, s[0] or 0, s[1], s[2]))
    bins = sorted({-(-n // 8) for *_, n in cut if n})
    choices = [(*c, bins[-1]) for c in itertools.combinations(bins[:-1], min(4, len(bins)) - 1)]
    ends = min(choices, key=lambda c: (sum(min(e for e in c if 8 * e >= n) for *_, n in cut if n), c))
    want, batch, slot, last = [(*s, None, None, None) for s in cut if not s[2]], -1, 0, 0
    for i, k, n in (s for s in cut if s[2]):
        width = 8 * min(e for e in ends if 8 * e >= n)
        batch, slot = (batch, slot + 1) if width == last and slot + 1 < 256 // width else (batch + 1, 0)
        want.append((i, k, n, width, batch, slot))
        last = width
    assert sorted(got, key=str) == sorted(want, key=str)
    assert max(k for i, k, *_ in got if i == 2000) > 10 and max(k for i, k, *_ in got if i == 2001) > 5
    assert packing.pack_tokens(docs.limit(0), path, rules).collect() == []
