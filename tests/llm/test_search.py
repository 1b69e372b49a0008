"""Ranked search through pairs of trees, held against scoring every pair."""

import math
import random
import re
from collections import Counter

import fixtures
import numpy as np
import pytest
from placeloom.llm import dual_tree, ranked_search
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, settings):
    """Every item against every document."""
    counted = [(i, Counter(terms_of(t))) for i, t in docs]
    counted = [(i, c) for i, c in counted if c]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in items:
        scored = []
        for doc, c in counted:
            m = 100 - settings.slope + (settings.slope * sum(c.values()) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * c[t]) // (1000 * c[t] + settings.saturation * m))
                for t in set(terms_of(text))
                if c[t]
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (score, null, doc) in enumerate(sorted(scored)[: settings.top], 1):
            out.append((str(item), rank, None if null else doc, -score))
    return sorted(out, key=str)


def found(spark, docs, items, settings, parts=4):
    d = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(parts)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.rank(d, q, settings).collect()
    return sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in got), key=str)


def texts(seed, n, longest, vocabulary=300):
    random.seed(seed)
    words = [f"w{int(vocabulary * random.random() ** 3)}" for _ in range(5000)]
    return [(k, " ".join(random.choices(words, k=random.randint(0, longest)))) for k in range(n)]


@pytest.mark.parametrize("seed,top", [(1, 5), (2, 50)])
def test_equals_scoring_every_pair(spark, seed, top):
    docs, items = texts(seed, 700, 60), texts(seed + 10, 30, 25)
    settings = ranked_search.RankSettings(top=top)
    assert found(spark, docs, items, settings) == plain(docs, items, settings)


def test_first_blocks_set_the_bars(spark, monkeypatch):
    """Many small blocks: most are searched against the bars of the first ones."""
    monkeypatch.setattr(ranked_search, "FIRST", 4)
    docs, items = texts(5, 400, 40), texts(6, 12, 20)
    settings = ranked_search.RankSettings(top=7)
    assert found(spark, docs, items, settings, parts=32) == plain(docs, items, settings)


def test_odd_texts_ties_and_repeats(spark):
    docs = [(i, t) for i, t, *_ in fixtures.odd_documents()]
    docs += [(100 + k, "same words here") for k in range(60)] + [(None, "same words here")] * 3 + [(5, "same words here")]
    items = [
        (1, "same here"), (1, "same here"), (2, None), (3, ""), (4, "!!! ..."), (None, "one TWO w3x"), (5, "é"),
        (6, "absent"), (7, fixtures.prose(1, 120)), (8, "a\x00b"), (9, " ".join(["same"] * 50)),
    ]
    settings = ranked_search.RankSettings(top=62)
    assert found(spark, docs, items, settings) == plain(docs, items, settings)


def test_empty_tables_and_other_columns(spark):
    docs, items = texts(3, 50, 20), texts(4, 5, 10)
    settings = ranked_search.RankSettings(top=3)
    assert found(spark, [], items, settings) == []
    assert found(spark, docs, [], settings) == []
    assert found(spark, [(1, None), (2, " ")], items, settings) == []
    d = fixtures.with_clashes(spark.createDataFrame(docs, "doc_id long, text string")).withColumn("score", F.lit("x"))
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(1))
    got = sorted(((str(r.item_id), r["rank"], r.doc_id, r.score) for r in ranked_search.rank(d, q, settings).collect()), key=str)
    assert got == plain(docs, items, settings)


def test_batches_of_items_and_pieces_of_texts(spark, monkeypatch):
    docs, items = texts(7, 80, 30), texts(8, 20, 10)
    settings = ranked_search.RankSettings(top=4)
    monkeypatch.setattr(ranked_search, "BATCH_BYTES", 200)
    assert found(spark, docs, items, settings) == plain(docs, items, settings)
    monkeypatch.setattr(ranked_search, "_CHUNK", 16)
    long = ("Wörter und-Zeichen 12a " * 9).encode()
    assert [t for part in ranked_search.term_lists(long) for t in part] == [t.encode() for t in terms_of(long.decode())]


def test_pairs_of_nodes_are_pruned():
    """Documents of many subjects: an item's search scores few of them, and loses none."""
    rng = np.random.default_rng(4)
    of = np.repeat(np.arange(4000), 12)
    terms = (of % 40) * 25 + rng.integers(0, 25, len(of)) + 1
    keys, often = np.unique(of * 1001 + terms, return_counts=True)
    entries = dual_tree.rows_of(keys // 1001, keys % 1001, often * 100 + rng.integers(0, 50, len(often)), 4000)
    placed = dual_tree.order(keys // 1001, keys % 1001, 4000, 1001)
    place = np.argsort(placed)
    moved = np.argsort(place[keys // 1001], kind="stable")
    rows = dual_tree.rows_of(place[keys // 1001][moved], (keys % 1001)[moved], entries.values[moved], 4000)
    items = [np.sort(rng.choice(25, 8, replace=False)) + 25 * (k % 40) + 1 for k in range(100)]
    tree = dual_tree.ItemTree(items, np.full(1001, 7, np.int64))
    best = dual_tree.Best(100, 10, {})
    docs = np.column_stack([np.zeros(4000, np.int64), placed])
    scored = dual_tree.search(dual_tree.DocumentTree(rows, 1001), docs, tree, best)
    assert scored < 0.1 * 4000 * 100
    for at, number in enumerate(tree.order):
        weights = np.zeros(1001, np.int64)
        weights[items[number]] = 7
        scores = rows.sums(np.arange(4000), weights)
        want = np.lexsort((placed, -scores))[:10]
        assert [(s, d) for s, _, d in best.rows[at].tolist()] == [(scores[i], placed[i]) for i in want if scores[i] > 0]
