"""Small documents with every oddity, and plain rules to hold the operators against."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
# Columns whose names operators add or use themselves.
CLASHES = "n_words kept component_id batch bucket block node key host verdict n_tokens _text text_2 docs".split()


def prose(seed, words, vocabulary=400):
    random.seed(seed)
    return " ".join(f"w{random.randrange(vocabulary)}x" for _ in range(words))


def odd_documents():
    """Nulls, blanks, ties, repeats, other scripts, a very long text."""
    base = prose(1, 120)
    long = " ".join(prose(k, 3000, 5000) for k in range(4))
    rows = [
        (1, base), (2, base), (3, base + " tail"), (4, base.upper()), (5, None), (6, ""), (7, " \t\n "),
        (8, "one"), (9, "One"), (10, "one two"), (11, long), (12, long + " more"), (13, "é " * 80),
        (14, "　".join(prose(2, 60).split())), (15, "a\x00b " * 40), (16, "line\n" * 70), (None, base),
        (None, None), (17, prose(3, 90)), (17, prose(3, 90)), (18, prose(4, 90)), (18, prose(5, 90)),
        (19, "#*$ %&| <> " * 30), (20, "x" * 3000), (21, prose(6, 200) + "\n\n  " + prose(7, 200)),
    ]
    return [(i, t, [None, "en", "de"][k % 3], None if k % 5 == 0 else "src", len(t) if t else None) for k, (i, t) in enumerate(rows)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit("x").alias(c) for c in CLASHES])


def words_of(text):
    return [w.decode() for w in (text or "").encode().lower().split()]


def shingles_of(text, size):
    words = words_of(text)
    if not words:
        return set()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}
