"""Linkage keys and name similarity.

Everything is a JVM expression except two small Arrow UDFs: Unicode folding of
non-ASCII text (the JVM has no column function for it) and the sequence ratio.
"""

from __future__ import annotations

import difflib
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom import fixed


@F.pandas_udf(T.StringType())
def _fold_unicode(text: pd.Series) -> pd.Series:
    def fold(value):
        if value is None:
            return None
        parts = unicodedata.normalize("NFKD", value.lower())
        return "".join(c for c in parts if not unicodedata.combining(c))

    return text.map(fold)


def strip(text: Column) -> Column:
    """Remove surrounding white space of any kind, not only blanks."""
    space = r"[\s\x1c-\x1f]+"
    return F.regexp_replace(text, f"(?U)^{space}|{space}$", "")


def fold(text: Column) -> Column:
    """Lower case without accents; only non-ASCII values are sent to Python."""
    plain = F.coalesce(text, F.lit(""))
    foreign = F.when(plain.rlike(r"[^\x00-\x7F]"), plain)
    return F.coalesce(_fold_unicode(foreign), F.lower(plain))


def name_norm(name: Column) -> Column:
    spelled = fold(name)
    for symbol, words in fixed.NAME_SUBSTITUTIONS.items():
        spelled = F.replace(spelled, F.lit(symbol), F.lit(words))
    return F.trim(F.regexp_replace(spelled, "[^a-z0-9]+", " "))


def name_tokens(norm: Column) -> Column:
    """Distinct words of a normalised name, generic ones dropped unless all are."""
    words = F.array_distinct(F.filter(F.split(norm, " "), lambda w: w != ""))
    generic = F.split(F.lit(" ".join(fixed.GENERIC_WORDS)), " ")
    kept = F.array_except(words, generic)
    return F.when(F.size(kept) > 0, kept).otherwise(words)


def phone_key(phone: Column, country_codes: list[str] | None = None) -> Column:
    """Local digits of a phone number, NULL when too few to identify a line."""
    codes = fixed.COUNTRY_CODES if country_codes is None else country_codes
    shortest = fixed.MIN_PHONE_DIGITS
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"(?U)\D", "")
    digits = F.regexp_replace(digits, "^0+", "")
    local = None
    for code in codes:
        has_code = digits.startswith(code) & (F.length(digits) - len(code) >= shortest)
        rest = F.substring(digits, len(code) + 1, 2**31 - 1)
        local = F.when(has_code, rest) if local is None else local.when(has_code, rest)
    local = digits if local is None else local.otherwise(digits)
    return F.when(F.length(local) >= shortest, local)


def address_key(address: Column) -> Column:
    """Street words plus the first number-like word; NULL unless both exist."""
    markers = "|".join(fixed.STREET_MARKERS)
    head = F.split_part(fold(address), F.lit(","), F.lit(1))
    head = F.regexp_replace(head, rf"(?U)\b({markers})\b", " ")
    head = F.regexp_replace(head, r"[^a-z0-9\- ]+", " ")
    words = F.filter(F.split(head, " "), lambda w: w != "")
    numbered = lambda w: w.rlike("^[0-9]")
    street = F.array_join(F.filter(words, lambda w: ~numbered(w)), " ")
    number = F.get(F.filter(words, numbered), F.lit(0))
    return F.when((street != "") & number.isNotNull(), F.concat_ws(" ", street, number))


def token_score(target: Column, candidate: Column) -> Column:
    """Word part of the name score; 0 when either name has no words.

    Asymmetric: full coverage is measured on the target's words.
    """
    shared = F.array_intersect(target, candidate)
    union = F.size(F.array_union(target, candidate))
    jaccard = F.try_divide(F.size(shared), union)
    long_shared = F.exists(shared, lambda w: F.length(w) >= fixed.SHARED_WORD_LENGTH)
    covered = (F.size(shared) == F.size(target)) & (F.size(target) >= 2)
    best = F.greatest(
        jaccard,
        F.when(long_shared, F.lit(fixed.SHARED_WORD_SCORE)).otherwise(0.0),
        F.when(covered, F.lit(fixed.COVERED_SCORE)).otherwise(0.0),
    )
    both = (F.size(target) > 0) & (F.size(candidate) > 0)
    return F.when(both, best).otherwise(F.lit(0.0))


def _masks(text: str) -> dict[str, int]:
    """Of each letter the places it has in a text, as bits."""
    found: dict[str, int] = {}
    for place, letter in enumerate(text):
        found[letter] = found.get(letter, 0) | 1 << place
    return found


def common_letters(masks: dict[str, int], size: int, other: str) -> int:
    """Length of the longest common subsequence of a text, given by its masks, and another."""
    row = (1 << size) - 1
    for letter in other:
        met = row & masks.get(letter, 0)
        row = (row + met) | (row - met)
    return size - (row & ((1 << size) - 1)).bit_count()


def ratio_reaching(a: str, b: str, need: float, masks: dict[str, int] | None = None) -> float:
    """The sequence ratio if it can reach ``need``, else 0.

    What the ratio counts are common letters in order, so it is never above twice the
    longest common subsequence over both lengths, which takes one step per letter.
    """
    most = 2.0 * common_letters(_masks(a) if masks is None else masks, len(a), b) / max(len(a) + len(b), 1)
    return difflib.SequenceMatcher(None, a, b).ratio() if most >= need else 0.0


@F.pandas_udf(T.DoubleType())
def _sequence_ratio(a: pd.Series, b: pd.Series, need: pd.Series) -> pd.Series:
    known: dict[tuple[str, str, float], float] = {}
    masks: dict[str, dict[str, int]] = {}

    def ratio(x, y, least):
        if x is None or y is None:
            return None
        key = (x, y, least)
        if key not in known:
            if x not in masks:
                masks[x] = _masks(x)
            known[key] = ratio_reaching(x, y, least, masks[x])
        return known[key]

    return pd.Series([ratio(x, y, n) for x, y, n in zip(a, b, need)], dtype="float64")


def name_score(
    target_norm: Column,
    target_tokens: Column,
    candidate_norm: Column,
    candidate_tokens: Column,
    floor: float = 0.0,
) -> Column:
    """The full name score of two normalised names.

    The sequence ratio can never exceed twice the shorter length over the total
    length, so pairs where that bound cannot beat the word score, or cannot
    reach ``floor``, skip the UDF: their ratio would not change the outcome.  Of the
    others the ratio itself is only worked out where the common letters allow it.
    """
    words = token_score(target_tokens, candidate_tokens)
    la, lb = F.length(target_norm), F.length(candidate_norm)
    bound = F.try_divide(F.lit(2.0) * F.least(la, lb), la + lb)
    both = (F.size(target_tokens) > 0) & (F.size(candidate_tokens) > 0)
    matters = both & (target_norm != candidate_norm) & (bound > words) & (bound >= floor)
    ratio = _sequence_ratio(
        F.when(matters, target_norm), F.when(matters, candidate_norm), F.greatest(words, F.lit(float(floor)))
    )
    same = F.when(both & (target_norm == candidate_norm), F.lit(1.0))
    return F.greatest(words, F.coalesce(same, ratio, F.lit(0.0)))


def phones_disagree(a: Column, b: Column) -> Column:
    """Both keys present and different."""
    return F.coalesce(a != b, F.lit(False))
