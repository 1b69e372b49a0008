"""Near-duplicates and passages against brute force."""

import hashlib
import random

import fixtures
import numpy as np
import pytest
from placeloom.llm import near_dedup, quality_rules, suffix_arrays, suffix_dedup
from placeloom.llm.components import components


def plain_components(rows, size, threshold):
    """Per row (id, shingles, component, kept); ids are distinct where not null."""
    sets = [(i, fixtures.shingles_of(t, size)) for i, t in rows]
    label = {i: i for i, _ in sets if i is not None}
    changed = True
    pairs = [
        (a, b)
        for k, (a, one) in enumerate(sets)
        for b, two in sets[k + 1 :]
        if a is not None and b is not None and one and two and 100 * len(one & two) >= threshold * len(one | two)
    ]
    while changed:
        changed = False
        for a, b in pairs:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return sorted(((i, len(s), label.get(i), i is None or label[i] == i) for i, s in sets), key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def edited(text, seed, share):
    random.seed(seed)
    return " ".join(w if random.random() > share else f"e{random.randrange(10**6)}" for w in text.split())


@pytest.mark.parametrize("size,threshold", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, size, threshold):
    base = fixtures.prose(11, 140, 3000)
    # Copies of a text that is not the smallest id: they are like it, hardly like each other.
    rows = [(k, edited(base, k, 0.018)) for k in range(60)] + [(60, base)]
    rows += [(100 + k, edited(fixtures.prose(k // 4, 90, 3000), k, 0.01 * (k % 4))) for k in range(60)]
    line = fixtures.prose(12, 30)
    rows += [(200 + k, line + " " + fixtures.prose(500 + k, 3 + k % 12, 5000)) for k in range(60)]
    rows += [(i, t) for i, t, *_ in fixtures.odd_documents() if i not in (17, 18)]
    rows = [(i if i is None or i >= 60 or i > 25 else i + 1000, t) for i, t in rows]
    rows = list({(i, t): None for i, t in rows})
    seen, distinct = set(), []
    for i, t in rows:
        if i is None or i not in seen:
            seen.add(i)
            distinct.append((i, t))
    docs = fixtures.with_clashes(fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in distinct]).drop("n_chars")).repartition(5)
    got = result(near_dedup.near_duplicates(docs, near_dedup.MinHash(shingle=size, threshold=threshold)))
    assert got == plain_components(distinct, size, threshold)


def test_blocks_of_a_bucket(spark, monkeypatch):
    """Tiles of small blocks find the same links as one."""
    monkeypatch.setattr(near_dedup, "_BLOCK_NODES", 4)
    base = fixtures.prose(21, 60, 3000)
    rows = [(k, edited(base, 300 + k, 0.03)) for k in range(50)]
    docs = fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = result(near_dedup.near_duplicates(docs, near_dedup.MinHash(shingle=3, threshold=85)))
    assert got == plain_components(rows, 3, 85)


def test_repeated_rows_and_ids(spark):
    text, other = fixtures.prose(31, 80), fixtures.prose(32, 80)
    rows = [(5, text), (5, text), (6, text), (7, other), (7, fixtures.prose(33, 80)), (8, other)]
    docs = fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 5), (6, 5), (7, 7), (8, 7)}
    left = near_dedup.deduplicate(docs)
    # One row of each group: of rows that repeat id and text one stays.
    assert sorted(r.doc_id for r in left.collect()) == [5, 7, 7] and left.columns == docs.columns
    named = docs.selectExpr("*", "1 AS _row_id", "2 AS _row_text", "3 AS text_key")
    assert sorted(r.doc_id for r in near_dedup.deduplicate(named).collect()) == [5, 7, 7]
    blank = fixtures.frame(spark, [(None, text, "en", "s", 1)] * 2 + [(9, None, "en", "s", 1), (9, "", "en", "s", 1)])
    assert near_dedup.deduplicate(blank).where("doc_id is null").count() == 2
    assert near_dedup.deduplicate(blank.limit(0)).collect() == []


def test_other_text_of_a_dropped_id_stays(spark):
    one, two = fixtures.prose(34, 80), fixtures.prose(35, 80)
    docs = fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in [(3, two), (7, one), (7, two)]])
    left = near_dedup.deduplicate(fixtures.with_clashes(docs))
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([(3, two), (7, one)])


def test_no_name_is_reserved(spark):
    docs = fixtures.frame(spark, [(1, "a", "en", "s", 1)]).selectExpr("*", "1 AS _sx_id", "2 AS _sx_block", "3 AS c0", "4 AS _q_text")
    left = suffix_dedup.remove_repeats(docs).first()
    judged = quality_rules.judge(docs).first()
    for row in (left, judged):
        assert (row["_sx_id"], row["_sx_block"], row.c0, row["_q_text"], row.doc_id) == (1, 2, 3, 4, 1)


def test_near_duplicates_on_empty_table(spark):
    assert near_dedup.near_duplicates(fixtures.frame(spark, [])).collect() == []


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(1000, 2000 + k) for k in range(300)] + [(5, 5), (41, 40), (1000, 2000)]
    found = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert len(found) == len({r.node for r in found}) == 42 + 301 - 0
    assert {r.component for r in found if r.node <= 41} == {0}
    assert {r.component for r in found if r.node >= 1000} == {1000}


@pytest.mark.parametrize("size,letters", [(1, 2), (60, 1), (3000, 2), (4000, 4)])
def test_suffix_arrays(size, letters):
    data = np.random.default_rng(size).integers(97, 97 + letters, size).astype(np.uint8)
    raw = data.tobytes()
    order = suffix_arrays.suffix_order(data)
    assert order.tolist() == sorted(range(size), key=lambda i: raw[i:])
    prefix = suffix_arrays.common_prefixes(data, order, 50)
    for k in range(1, size):
        one, two = raw[order[k] : order[k] + 50], raw[order[k - 1] : order[k - 1] + 50]
        same = next((i for i, (a, b) in enumerate(zip(one, two)) if a != b), min(len(one), len(two)))
        assert prefix[k] == same


def plain_repeats(rows, length=50):
    last = 1 << 62
    least = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            least[w] = min(least.get(w, last), last if i is None else i)
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if least[raw[p : p + length]] < (last if i is None else i):
                gone[p : p + length] = [True] * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (p == 0 or not gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_passages_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1500)
    random.seed(9)
    words = ["é" + str(k) for k in range(300)] + ["the", "of"] * 30
    phrases = [" ".join(random.choices(words, k=random.randint(8, 60))) for _ in range(20)]
    rows = []
    for i in range(30, 130):
        parts = [
            random.choice(phrases) if random.random() < 0.3 else " ".join(random.choices(words, k=random.randint(1, 30)))
            for _ in range(random.randint(0, 8))
        ]
        rows.append((i, " ".join(parts)))
    rows += [(i, t if t is None else t[:4000]) for i, t, *_ in fixtures.odd_documents()]
    rows += [(201, "a" * 500), (202, "a" * 300), (203, "b" * 49), (204, "b" * 49), (205, "ab" * 400), (206, "x" + "ba" * 99)]
    docs = fixtures.with_clashes(fixtures.frame(spark, [(i, t, "en", "s", 1) for i, t in rows])).repartition(3)
    cut = suffix_dedup.remove_repeats(docs)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in cut.collect()), key=str)
    assert got == plain_repeats(rows)
    assert cut.columns[: len(docs.columns)] == docs.columns


def test_text_keeps_whole_characters(spark):
    shared = "é" * 40
    docs = fixtures.frame(spark, [(1, "x" + shared, "en", "s", 1), (2, "yy" + shared + "zz", "en", "s", 1)])
    rows = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    assert rows[1].text == "x" + shared and rows[2].text == "yyzz" and rows[2].n_removed == 80


def test_passages_on_empty_table(spark):
    assert suffix_dedup.remove_repeats(fixtures.frame(spark, [])).collect() == []


def test_words_hash_alike_wherever_they_stand(monkeypatch):
    texts = [b"one two one", b"", b" \t", b"TWO one", b"x" * 5000 + b" one"]
    whole, ends = near_dedup.word_hashes(texts)
    monkeypatch.setattr(near_dedup, "_WORDS", 2)
    parts, _ = near_dedup.word_hashes(texts)
    assert whole.tolist() == parts.tolist() and ends.tolist() == [3, 3, 3, 5, 7]
    assert whole[0] == whole[2] == whole[4] == whole[6] and whole[1] == whole[3] and len(set(whole.tolist())) == 3
