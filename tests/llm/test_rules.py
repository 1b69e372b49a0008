"""Quality rules and leaks against plain rules."""

import re

import fixtures
from placeloom.llm import decontaminate, quality_rules


def plain_base(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(words) < 2000 else _twice(windows)
    covered = {k for i, w in enumerate(windows) if w in twice for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered),
    )


def _twice(windows):
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    return twice


def test_base_statistics_of_odd_documents(spark):
    rows = fixtures.odd_documents()
    judged = quality_rules.judge(fixtures.with_clashes(fixtures.frame(spark, rows))).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted((str(r.doc_id), *[r[n] for n in names], r.base_failed) for r in judged)
    want = []
    for doc_id, text, *_ in rows:
        base = plain_base(text)
        want.append((str(doc_id), *base, base[0] < 50 or 100 * base[4] > 50 * base[0]))
    assert got == sorted(want)
    assert not any(r.kept for r in judged if r.base_failed)


def test_divergent_documents_go(spark):
    plain = [(k, " ".join(["the of and to"] * 0 + [fixtures.prose(k, 100), "the of and " * 3]), "en", "s", 1) for k in range(40)]
    odd = [(99, " ".join(f"{w}***$$" for w in fixtures.prose(99, 120).split()), "en", "s", 1)]
    judged = {r.doc_id: r for r in quality_rules.judge(fixtures.frame(spark, plain + odd)).collect()}
    assert not judged[99].kept and not judged[99].base_failed
    assert all(judged[k].kept or judged[k].base_failed for k in range(40))


def test_rules_on_empty_table(spark):
    assert quality_rules.judge(fixtures.frame(spark, [])).collect() == []


def test_leaks_equal_plain_containment(spark):
    items = [
        (1, fixtures.prose(50, 30)), (2, fixtures.prose(51, 12)), (3, "Short item"), (4, None), (5, " "), (6, "alone"),
        (None, fixtures.prose(52, 20)), (7, fixtures.prose(53, 60)), (7, fixtures.prose(53, 60)), (8, "x y " * 20),
    ]
    texts = {
        30: fixtures.prose(1, 500, 9000) + " " + items[0][1].upper() + " " + fixtures.prose(2, 3000, 9000),
        31: items[1][1] + " end", 32: "a short item here", 33: "that was alone", 34: " ".join(items[7][1].split()[:57]),
        35: " ".join(items[7][1].split()[:40]), 36: "x y x y x y x", 37: items[6][1], 38: fixtures.prose(9, 200),
    }
    rows = fixtures.odd_documents() + [(k, t, "en", "s", 1) for k, t in texts.items()]
    rows += [(None, "so " + items[1][1], "en", "s", 1)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = fixtures.with_clashes(fixtures.frame(spark, rows))
    found = {(r.doc_id, r.item_id, r.item_shingles, r.matched) for r in decontaminate.find(docs, benchmark).collect()}
    want, clean = set(), []
    for doc_id, text, *_ in rows:
        leak = False
        for item_id, item in items:
            size = min(5, len(fixtures.words_of(item)))
            own = fixtures.shingles_of(item, 5)
            words = fixtures.words_of(text)
            runs = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()
            if own and 100 * len(own & runs) >= 80 * len(own):
                want.add((doc_id, item_id, len(own), len(own & runs)))
                leak = True
        if not leak:
            clean.append((str(doc_id), str(text)))
    assert found == want and {d for d, *_ in want} >= {30, 31, 32, 33, 34, 36, 37, None}
    left = decontaminate.remove(docs, benchmark)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted(clean)


def test_leaks_on_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = fixtures.frame(spark, fixtures.odd_documents())
    assert decontaminate.find(some, none).collect() == []
    assert decontaminate.remove(some, none).count() == some.count()
    one = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.find(fixtures.frame(spark, []), one).collect() == []
