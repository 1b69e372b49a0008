"""Quality rules by distribution divergence.

Each document is described by two histograms: the classes of its characters and
its common words (a fixed list of function words of four languages, all else in
one bin). The references are the mean histograms of the documents of each
language, over the whole corpus. A document passes when the Jensen-Shannon
distance (base 2, so 0 to 1) of each histogram to the reference of its language
is within a limit. Two guards of minimum length apply: the word histogram is
judged only for documents with enough words, and a language gets a reference of
its own only when enough documents stand behind it; the others are held against
the reference of all documents.

Everything runs as DataFrame expressions. The texts are read once into a table of
counts per document, from which the references and the distances are derived.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.words import words
from placeloom.session import materialize

# Function words of English, German, French and Spanish.
COMMON_WORDS = sorted(
    set(
        "the of and to in a is that for it with as "
        "der die und in den von zu das mit sich des auf "
        "de la le et les des en un du une que dans "
        "de la que el en y a los del se las por".split()
    )
)

# Character classes found by pattern. Blanks, bytes beyond one per character and
# the rest (mostly small letters) are three more.
CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "sign": r"[#*$%&|<>]+",
    "mark": r"""[!"'()+,\-./:;=?@\[\\\]^_`{}~]+""",
}
_CLASS_BINS = len(CLASSES) + 3
# All characters that are in none of these classes.
_PLAIN = r"""[^A-Z0-9#*$%&|<>!"'()+,\-./:;=?@\[\\\]^_`{}~]+"""

_ALL = ""  # the reference of all documents


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules.

    ``min_words`` and ``max_repeat_share`` (per cent of the words) are the base
    rules. ``class_limit`` and ``word_limit`` bound the two distances.
    ``min_reference_docs`` is the guard for a language's own reference and
    ``min_judged_words`` that for the word histogram.
    """

    min_words: int = 50
    max_repeat_share: int = 50
    class_limit: float = 0.30
    word_limit: float = 0.26
    min_reference_docs: int = 20
    min_judged_words: int = 100


def _missing(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))


def _repeated_at(hashes: Column, count: Column) -> Column:
    """Sorted positions of the windows that occur twice or more.

    Most documents repeat nothing and are done after one pass; the others sort
    their windows, so that equal ones are neighbours.
    """
    windows = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < count, windows).otherwise(
        F.array().cast("array<struct<h:bigint,p:int>>")
    )


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts per document: the base statistics and both histograms.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes
    (array) and common (array) to the columns of ``docs`` other than the text,
    whose names must not start with ``_q_``.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns if c != text]
    # One projection per step, so that each array is computed once.
    t, w, h, hits = (F.col(f"_q_{name}") for name in ("text", "words", "hashes", "hits"))
    staged = docs.select(*keep, F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("_q_text"))
    staged = staged.withColumn("_q_words", words(t))
    staged = staged.withColumns(
        {
            "_q_single": F.transform(w, lambda x: F.xxhash64(x)),
            "_q_hits": F.filter(w, lambda x: x.isin(COMMON_WORDS)),
            "_q_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
            "_q_signs": F.regexp_replace(t, _PLAIN, ""),
        }
    )
    single = F.col("_q_single")
    staged = staged.withColumn(
        "_q_hashes",
        F.transform(
            F.slice(single, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))),
            lambda x, i: F.xxhash64(x, F.get(single, i + 1), F.get(single, i + 2)),
        ),
    )
    # One letter per common word: counting letters of a short string is cheap.
    letters = F.create_map(*[F.lit(x) for k, word in enumerate(COMMON_WORDS) for x in (word, chr(0x100 + k))])
    staged = staged.withColumns(
        {
            "_q_sorted": _repeated_at(h, F.size(h)),
            "_q_code": F.array_join(F.transform(hits, lambda x: F.element_at(letters, x)), ""),
        }
    )
    s, code = F.col("_q_sorted"), F.col("_q_code")
    # get() is null outside the array: an edge decides by its one neighbour.
    staged = staged.withColumn(
        "_q_at",
        F.sort_array(
            F.transform(
                F.filter(
                    s,
                    lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
                    | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
                ),
                lambda x: x["p"],
            )
        ),
    )
    at = F.col("_q_at")
    # Windows at a and b > a cover min(3, b - a) words up to b; the last covers three.
    covered = F.aggregate(
        F.transform(at, lambda x, i: F.least(F.get(at, i + 1) - x, F.lit(3))),
        F.lit(0),
        lambda total, x: total + x,
    )
    signs = F.col("_q_signs")
    staged = staged.select(
        *keep,
        F.size(w).cast("long").alias("n_words"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.char_length(t).cast("long").alias("_q_chars"),
        (F.octet_length(t) - F.char_length(t)).cast("long").alias("_q_wide"),
        *[_missing(signs, pattern).cast("long").alias(f"_q_{name}") for name, pattern in CLASSES.items()],
        F.size(hits).cast("long").alias("_q_n_hits"),
        F.array(
            *[
                (F.char_length(code) - F.char_length(F.replace(code, F.lit(chr(0x100 + k)), F.lit("")))).cast("long")
                for k in range(len(COMMON_WORDS))
            ]
        ).alias("_q_common"),
    )
    found = [F.col(f"_q_{name}") for name in CLASSES]
    small = F.col("word_chars") - sum(found, F.lit(0))
    return staged.select(
        *keep,
        "n_words",
        "word_chars",
        F.col("_q_sign").alias("n_symbols"),
        "n_dup_lines",
        "n_repeat_words",
        F.array(*found, F.col("_q_chars") - F.col("word_chars"), F.col("_q_wide"), small).alias("classes"),
        F.concat("_q_common", F.array(F.col("n_words") - F.col("_q_n_hits"))).alias("common"),
    )


def _shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(counts, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))


def _mean(column: str, size: int) -> Column:
    return F.array(*[F.avg(F.get(F.col(column), F.lit(k))) for k in range(size)])


def references(shares: DataFrame, rules: QualityRules) -> DataFrame:
    """One row per language with enough documents, and one (``''``) for all."""
    sizes = {"class_share": _CLASS_BINS, "word_share": len(COMMON_WORDS) + 1}
    long_enough = shares.where(F.col("n_words") >= rules.min_judged_words)
    means = [_mean(c, k).alias(f"{c}_ref") for c, k in sizes.items()]
    sized = (
        long_enough.groupBy(F.coalesce(F.col("language"), F.lit(_ALL)).alias("language"))
        .agg(F.count("*").alias("docs"), *means)
        .where((F.col("docs") >= rules.min_reference_docs) & (F.col("language") != _ALL))
    )
    whole = long_enough.agg(F.lit(_ALL).alias("language"), F.count("*").alias("docs"), *means)
    return sized.unionByName(whole)


def distance(left: Column, right: Column) -> Column:
    """Jensen-Shannon distance of two histograms of shares, base 2."""

    def part(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))

    terms = F.zip_with(left, right, lambda a, b: part(a, b) + part(b, a))
    total = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.greatest(total / 2, F.lit(0.0)))


def judge(
    docs: DataFrame, rules: QualityRules = QualityRules(), text: str = "text", lang: str | None = "lang"
) -> DataFrame:
    """The columns of ``docs`` without the text, with statistics and verdicts.

    Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    class_distance, word_distance, base_failed and kept. A null or empty text has
    no words and fails the base rules. A null language, or one with fewer than
    ``min_reference_docs`` documents, is held against all documents. Copies of a
    row are judged alike, each on its own. In an empty table there is nothing to
    judge. Columns of ``docs`` that bear one of the names added are left out.
    """
    made = {
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "classes", "common",
        "class_share", "word_share", "language", "class_distance", "word_distance", "base_failed", "kept",
        "docs", "class_share_ref", "word_share_ref", "_class_all", "_word_all", "_class_ref", "_word_ref",
    }
    # The language is kept aside, so that a clash of names cannot hide it.
    language = F.col(f"`{lang}`") if lang else F.lit(None)
    # Under names of their own, so that none can clash.
    rest = {c: f"c{k}" for k, c in enumerate(docs.columns) if c.lower() not in made and c != text}
    carried = [F.col(f"`{c}`").alias(own) for c, own in rest.items()]
    staged = docs.select(*carried, language.cast("string").alias("language"), F.col(f"`{text}`").alias("body"))
    # A fixed copy: the references and the verdicts read the same counts, and texts are read once.
    counted = materialize(profile(staged, "body"), "quality-profile").withColumns(
        {"class_share": _shares(F.col("classes")), "word_share": _shares(F.col("common"))}
    )
    refs = references(counted, rules)
    whole = refs.where(F.col("language") == _ALL).select(
        F.col("class_share_ref").alias("_class_all"), F.col("word_share_ref").alias("_word_all")
    )
    # The reference of all documents is one row; that of a language is joined by its key.
    joined = (
        counted.join(
            refs.where(F.col("language") != _ALL).select(
                F.col("language"), "class_share_ref", "word_share_ref"
            ),
            "language",
            "left",
        )
        .join(F.broadcast(whole), F.lit(True), "left")
        .withColumn("_class_ref", F.coalesce("class_share_ref", "_class_all"))
        .withColumn("_word_ref", F.coalesce("word_share_ref", "_word_all"))
    )
    base_failed = (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words")
    )
    judged = joined.withColumns(
        {
            "class_distance": F.coalesce(distance(F.col("class_share"), F.col("_class_ref")), F.lit(0.0)),
            "word_distance": F.when(
                F.col("n_words") >= rules.min_judged_words,
                F.coalesce(distance(F.col("word_share"), F.col("_word_ref")), F.lit(0.0)),
            ).otherwise(F.lit(0.0)),
            "base_failed": base_failed,
        }
    )
    kept = (
        ~F.col("base_failed")
        & (F.col("class_distance") <= rules.class_limit)
        & (F.col("word_distance") <= rules.word_limit)
    )
    return judged.select(
        *[F.col(own).alias(c) for c, own in rest.items()],
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "class_distance", "word_distance", "base_failed", kept.alias("kept"),
    )
