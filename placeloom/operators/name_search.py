"""The record with the most similar name within reach of each target.

Targets and records meet in tiles of the grid; a crowded tile is cut into blocks on both
sides, sparse tiles share a block.  A block's pairs are never rows: its task lists them as
numbers, a few hundred thousand at a time, and gives one row per target.  The score is
``name_score``.  Its sequence ratio is worked out from the highest bound downwards, first
by the letters both names have, then by their longest common subsequence, and only while
the bound can still beat what the target has found.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placeloom import fixed
from placeloom.functions.text import name_tokens, ratio_reaching
from placeloom.operators.grid import GRID_KEY, bucket_circles, bucket_points, class_of
from placeloom.operators.skew import BROADCAST_ROWS, SIDE_ROWS
from placeloom.session import materialize, materialize_with, shuffle_width

_BLOCK = ["block", "l_block", "r_block"]
# Pairs looked at in one step, and pairs whose ratio is worked out in one step.
_PAIRS, _RATIOS = 1 << 18, 1 << 14
# Of each target the ratios worked out first; each further round takes twice as many.
_FIRST_RATIOS = 8
# Longer names do not fit the bits of a word and go one by one.
_LETTERS = 64
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789 "
_NO_LETTER = len(_ALPHABET)
_CODES = np.full(256, _NO_LETTER, np.uint8)
_CODES[np.frombuffer(_ALPHABET.encode(), np.uint8)] = np.arange(_NO_LETTER)
_ONE = np.uint64(1)
_LAST_RANK = np.iinfo(np.int64).max


def best_names(
    spots: DataFrame,
    records: DataFrame,
    limit_m: float,
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
) -> DataFrame:
    """Per block and spot its best record: (spot_no, t_lat, t_lng, r_lat, r_lng, record_pos, score).

    ``spots`` are (spot_no, t_lat, t_lng, t_norm, calling), ``records`` (r_lat, r_lng,
    r_norm, first_any, first_silent), the first record of a place and name and the first
    without a phone, as structs.  A spot that is calling has a phone, and takes the first
    record where the names vouch, else the first without one.  A spot may come from
    several blocks; the highest score, then the first record, is its answer.
    """
    # Twice as wide as the circles, so that a spot comes to fewer tiles.
    tile = class_of(limit_m) + 1
    left = materialize(
        bucket_circles(spots.where("t_norm != ''"), "t_lat", "t_lng", F.lit(float(limit_m)), tile), "spots"
    )
    right = materialize(bucket_points(records.where("r_norm != ''"), "r_lat", "r_lng", [tile]), "record-spots")
    tiles = left.groupBy(*GRID_KEY).agg(F.count("*").alias("n_l")).join(
        right.groupBy(*GRID_KEY).agg(F.count("*").alias("n_r")), GRID_KEY
    )
    # Records are the larger side, and a target is better off with more of them at once.
    cuts = tiles.select(
        *GRID_KEY,
        (F.col("n_l") + F.col("n_r")).alias("n"),
        F.ceil(F.col("n_l") / max(1, side_rows // 2)).alias("l_blocks"),
        F.ceil(F.col("n_r") / (side_rows * 2)).alias("r_blocks"),
    )
    crowded = F.col("n") > side_rows // 10
    alone = F.when(crowded, F.col("l_blocks") * F.col("r_blocks"))
    cuts, seen = materialize_with(
        cuts, "tiles", tiles=F.count(F.lit(1)), alone=F.sum(alone), shared=F.sum(F.when(~crowded, F.col("n")))
    )
    bundles = 1 + (seen["shared"] or 0) // side_rows
    number = F.xxhash64(*GRID_KEY)
    block = F.when(crowded, number).otherwise(F.pmod(number, F.lit(bundles))).alias("block")
    if seen["tiles"] <= broadcast_rows:
        cuts = F.broadcast(cuts)
    tasks = min(4 * shuffle_width(spots.sparkSession), bundles + (seen["alone"] or 0))

    def blocks(df: DataFrame, identity: list[str], mine: str, other: str) -> DataFrame:
        own = F.pmod(F.xxhash64(*identity), F.col(f"{mine}_blocks")).alias(f"{mine}_block")
        copies = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(f"{other}_blocks") - 1))
        cut = df.join(cuts, GRID_KEY).select(*df.columns, block, own, copies.alias(f"{other}_block"))
        return cut.drop(*GRID_KEY).repartition(tasks, *_BLOCK)

    silent = F.col("first_silent")
    asked = blocks(left, ["spot_no"], "l", "r").withColumn("t_words", name_tokens(F.col("t_norm")))
    offered = blocks(right, ["r_lat", "r_lng", "r_norm"], "r", "l").select(
        *_BLOCK, "r_lat", "r_lng", "r_norm", name_tokens(F.col("r_norm")).alias("r_words"),
        F.col("first_any.record_pos").alias("any_pos"),
        silent["record_pos"].alias("silent_pos"), silent.isNotNull().alias("has_silent"),
    )
    out = T.StructType(
        [asked.schema[c] for c in ("spot_no", "t_lat", "t_lng")]
        + [offered.schema[c] for c in ("r_lat", "r_lng")]
        + [T.StructField("record_pos", offered.schema["any_pos"].dataType), T.StructField("score", T.DoubleType())]
    )
    return asked.groupBy(*_BLOCK).cogroup(offered.groupBy(*_BLOCK)).applyInArrow(
        _pick(limit_m, to_arrow_schema(out)), out
    )


def _pick(limit_m: float, schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def pick(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        # A spot of several tiles that share a block comes once for each.
        left = left.take(_firsts(left["spot_no"])[1])
        block = _Block(left, right, limit_m)
        spot, record, silent, score = block.search()
        at = right.take(record)
        position = pa.chunked_array([*right["any_pos"].chunks, *right["silent_pos"].chunks], right["any_pos"].type)
        found = {
            **{c: left[c].take(pa.array(spot)) for c in ("spot_no", "t_lat", "t_lng")},
            "r_lat": at["r_lat"], "r_lng": at["r_lng"],
            "record_pos": position.take(pa.array(record + silent * right.num_rows)),
            "score": pa.array(score, pa.float64()),
        }
        return pa.table([found[c] for c in schema.names], schema=schema)

    return pick


def _firsts(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of its value, and of each value the first row that has it."""
    numbers = column.combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    return numbers, np.unique(numbers, return_index=True)[1]


def _words(*columns: pa.ChunkedArray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per column the numbers of all its words and where each row ends; and whether a word is long."""
    lists = [c.combine_chunks() for c in columns]
    known = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    numbers = known.indices.to_numpy(zero_copy_only=False)
    long = pc.greater_equal(pc.utf8_length(known.dictionary), fixed.SHARED_WORD_LENGTH)
    ends = [np.cumsum(pc.list_value_length(x).to_numpy(zero_copy_only=False)) for x in lists]
    parts = np.split(numbers, np.cumsum([e[-1] for e in ends])[:-1])
    return list(zip(parts, ends)), long.to_numpy(zero_copy_only=False)


class _Names:
    """Distinct names: letters as numbers, the places of each letter as bits, words as numbers."""

    def __init__(self, texts: list[str], words: np.ndarray, ends: np.ndarray):
        self.texts = texts
        self.size = np.array([len(t) for t in texts])
        self.short = self.size <= _LETTERS
        width = min(int(self.size.max()), _LETTERS)
        letters = np.frombuffer("".join(texts).encode(), np.uint8)
        at = (np.cumsum(self.size) - self.size)[:, None] + np.arange(width)
        codes = _CODES[letters[np.minimum(at, len(letters) - 1)]]
        codes[np.arange(width) >= self.size[:, None]] = _NO_LETTER
        self.codes = np.ascontiguousarray(codes.T)
        rows = np.arange(len(texts))
        places = np.zeros((len(texts), _NO_LETTER + 1), np.uint64)
        for k in range(width):
            places[rows, codes[:, k]] |= _ONE << np.uint64(k)
        places[:, _NO_LETTER] = 0
        self.places = places.ravel()
        # How often a letter comes as that many bits, three for the first letters and four for the others.
        counts = np.bitwise_count(places[:, :_NO_LETTER]).astype(np.uint64)
        most = np.where(np.arange(_NO_LETTER) < 21, 3, 4).astype(np.uint64)
        bits = (_ONE << np.minimum(counts, most)) - _ONE
        shift = np.concatenate([np.arange(21) * 3, np.arange(_NO_LETTER - 21) * 4]).astype(np.uint64)
        bits <<= shift
        self.low = np.bitwise_or.reduce(bits[:, :21], axis=1)
        self.high = np.bitwise_or.reduce(bits[:, 21:], axis=1)
        self.spare = np.maximum(counts.astype(np.int64) - most.astype(np.int64), 0).sum(axis=1)
        # Words; a short name has at most 32.
        starts = np.concatenate([[0], ends[:-1]])
        self.n_words = ends - starts
        self.word_sets = lambda k: words[starts[k] : ends[k]]
        self.word_marks = np.bitwise_or.reduceat(_ONE << (words.astype(np.uint64) & np.uint64(63)), starts)
        most_words = int(self.n_words[self.short].max(initial=0))
        column = np.arange(most_words)
        self.words = words[np.minimum(starts[:, None] + column, len(words) - 1)]
        self.words[column >= self.n_words[:, None]] = -1


def _names(norm: pa.ChunkedArray, words: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, _Names]:
    """Of each row the number of its name, and the names."""
    numbers, first = _firsts(norm)
    flat, ends = words
    starts = np.concatenate([[0], ends[:-1]])
    sizes = (ends - starts)[first]
    new_ends = np.cumsum(sizes)
    picked = np.repeat(starts[first] - (new_ends - sizes), sizes) + np.arange(new_ends[-1])
    return numbers, _Names(norm.take(pa.array(first)).to_pylist(), flat[picked], new_ends)


class _Block:
    """The targets and records of one block."""

    def __init__(self, left: pa.Table, right: pa.Table, limit_m: float):
        number = lambda table, c: table[c].to_numpy().astype(np.float64)
        (t_words, r_words), self.long = _words(left["t_words"], right["r_words"])
        self.t_name, self.t = _names(left["t_norm"], t_words)
        self.r_name, self.r = _names(right["r_norm"], r_words)
        self.calling = left["calling"].to_numpy()
        self.has_silent = right["has_silent"].to_numpy()
        positions = pa.concat_arrays([right[c].combine_chunks() for c in ("any_pos", "silent_pos")])
        ranks = pc.rank(positions, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        self.any_rank, self.silent_rank = np.split(ranks, 2)
        self.limit_m = limit_m
        self.t_lat, self.t_lng = number(left, "t_lat"), number(left, "t_lng")
        self.r_lat, self.r_lng = number(right, "r_lat"), number(right, "r_lng")
        self.t_phi, self.r_phi = np.radians(self.t_lat), np.radians(self.r_lat)
        self.t_cos, self.r_cos = np.cos(self.t_phi), np.cos(self.r_phi)
        self.win_score = np.zeros(len(self.t_lat))
        self.win_rank = np.full(len(self.t_lat), _LAST_RANK)
        self.win_chord = np.full(len(self.t_lat), np.inf)
        self.win_record = np.full(len(self.t_lat), -1)
        self.win_silent = np.zeros(len(self.t_lat), bool)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Spot, record, whether it is the place's first without a phone, and score."""
        for spot, record, chord in self._near():
            self._judge(spot, record, chord)
        spot = np.flatnonzero(self.win_record >= 0)
        return spot, self.win_record[spot], self.win_silent[spot], self.win_score[spot]

    # --- pairs within reach ------------------------------------------------------

    def _near(self):
        """Pairs within reach, by spot, a few hundred thousand at a time."""
        reach = self.limit_m / 111_000.0
        height = reach / 8
        key = lambda strip, lng: strip * 1024.0 + (lng + 180.0)
        r_key = key(np.floor(self.r_lat / height), self.r_lng)
        order = np.argsort(r_key)
        r_key = r_key[order]
        spots = np.argsort(key(np.floor(self.t_lat / height), self.t_lng))
        lat, lng = self.t_lat[spots, None], self.t_lng[spots, None]
        strip = np.floor((lat - reach) / height) + np.arange(18)
        south, north = strip * height, (strip + 1) * height
        apart = np.maximum(0.0, np.maximum(south - lat, lat - north) - 1e-9)
        poleward = np.maximum(np.abs(lat), np.maximum(np.abs(south), np.abs(north)))
        narrow = np.cos(np.radians(np.minimum(poleward, 90.0)))
        wide = np.sqrt(np.maximum(reach * reach - apart * apart, 0.0))
        # Round the pole a strip is taken whole.
        half = np.where(narrow > 2.0 * wide, 1.001 * wide / np.maximum(narrow, 1e-9), 180.0) + 1e-6
        inside = lambda x: np.clip(x, -180.0 - 1e-6, 180.0 + 1e-6)
        ranges = [(inside(lng - half), inside(lng + half))]
        if np.any(lng - half < -180.0) or np.any(lng + half > 180.0):
            low, high = np.full_like(half, -180.0 - 1e-6), np.full_like(half, 180.0 + 1e-6)
            nothing = lambda some, x, y: (np.where(some, x, 1.0), np.where(some, y, 0.0))
            ranges.append(nothing(lng - half < -180.0, lng - half + 360.0, high))
            ranges.append(nothing(lng + half > 180.0, low, lng + half - 360.0))
        starts = np.hstack([np.searchsorted(r_key, key(strip, a), "left") for a, _ in ranges])
        ends = np.hstack([np.searchsorted(r_key, key(strip, b), "right") for _, b in ranges])
        counts = np.maximum(ends - starts, 0)
        per_spot = counts.sum(axis=1)
        done = np.concatenate([[0], np.cumsum(per_spot)])
        a = 0
        while a < len(spots):
            b = max(a + 1, int(np.searchsorted(done, done[a] + _PAIRS, "right")) - 1)
            n = counts[a:b].ravel()
            at = np.repeat(starts[a:b].ravel() - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            spot, record = np.repeat(spots[a:b], per_spot[a:b]), order[at]
            chord = self._within(spot, record)
            keep = chord >= 0
            yield spot[keep], record[keep], chord[keep]
            a = b

    def _within(self, spot: np.ndarray, record: np.ndarray) -> np.ndarray:
        """About the squared half chord of each pair, -1 where the distance is beyond the limit."""
        limit = math.sin(self.limit_m / (2 * fixed.EARTH_RADIUS_M)) ** 2
        d_phi = (self.r_phi[record] - self.t_phi[spot]) / 2
        d_lng = self.r_lng[record] - self.t_lng[spot]
        around = d_lng - 360.0 * np.round(d_lng / 360.0)
        d_lambda = np.radians(around) / 2
        cosines = self.t_cos[spot] * self.r_cos[record]
        # An angle is above its sine, below 0.01 by no more than a 50,000th part.
        chord = d_phi * d_phi + cosines * d_lambda * d_lambda
        sure = (chord < limit * (1 - 1e-9)) | ((chord > limit * (1 + 1e-4)) & (np.abs(d_lambda) < 0.01))
        chord = np.where(sure & (chord > limit), -1.0, chord)
        if not sure.all():
            k = np.flatnonzero(~sure)
            s_phi, s_lambda = np.sin(d_phi[k]), np.sin(np.radians(d_lng[k]) / 2)
            exact = s_phi * s_phi + cosines[k] * s_lambda * s_lambda
            metres = 2 * fixed.EARTH_RADIUS_M * np.arcsin(np.minimum(np.sqrt(exact), 1.0))
            chord[k] = np.where(metres <= self.limit_m, exact, -1.0)
        return chord

    # --- scores --------------------------------------------------------------------

    def _judge(self, spot: np.ndarray, record: np.ndarray, chord: np.ndarray) -> None:
        """Hold all pairs within reach of some spots, which come in order, against each other."""
        t, r = self.t_name[spot], self.r_name[record]
        need = np.where(self.calling[spot] & ~self.has_silent[record], fixed.NAME_VOUCH_SCORE, fixed.NAME_MIN_SCORE)
        bound = self._letters_bound(t, r)
        shared = (self.t.word_marks[t] & self.r.word_marks[r]) != 0
        keep = np.flatnonzero(shared | (bound >= need))
        spot, record, chord, t, r, need, bound, shared = (
            x[keep] for x in (spot, record, chord, t, r, need, bound, shared)
        )
        words = np.zeros(len(spot))
        words[shared] = self._word_scores(t[shared], r[shared])
        self._take(spot, record, chord, need, words)
        count, fine = _FIRST_RATIOS, False
        while True:
            best = self.win_score[spot]
            hopeful = (bound > words) & (bound >= need) & (
                (bound > best) | ((bound == best) & (self.any_rank[record] <= self.win_rank[spot]))
            )
            keep = np.flatnonzero(hopeful)
            spot, record, chord, t, r, need, bound, words = (
                x[keep] for x in (spot, record, chord, t, r, need, bound, words)
            )
            if not len(spot):
                return
            if not fine and count > _FIRST_RATIOS:
                bound, fine = self._sequence_bound(t, r, bound), True
                continue
            highest = _spread(np.maximum, bound, spot)
            first = np.flatnonzero(bound == highest)
            starts = _starts(spot[first])
            sizes = np.diff(np.append(starts, len(first)))
            tried = first[np.arange(len(first)) - np.repeat(starts, sizes) < count]
            score = np.maximum(words[tried], self._ratios(t[tried], r[tried], need[tried]))
            self._take(spot[tried], record[tried], chord[tried], need[tried], score)
            # Settled, so no longer hopeful.
            bound[tried] = 0.0
            count *= 2

    def _take(self, spot, record, chord, need, score) -> None:
        """Keep of each spot the highest score, then the first record, then the nearest."""
        fit = np.flatnonzero((score >= need) & (score >= self.win_score[spot]))
        if not len(fit):
            return
        spot, record, chord, score = (x[fit] for x in (spot, record, chord, score))
        silent = self.calling[spot] & (score < fixed.NAME_VOUCH_SCORE)
        rank = np.where(silent, self.silent_rank[record], self.any_rank[record])
        for better, key in ((np.maximum, 0), (np.minimum, 1), (np.minimum, 2)):
            value = (score, rank, chord)[key]
            keep = np.flatnonzero(value == _spread(better, value, spot))
            spot, record, chord, score, silent, rank = (x[keep] for x in (spot, record, chord, score, silent, rank))
        old_score, old_rank = self.win_score[spot], self.win_rank[spot]
        wins = (score > old_score) | (
            (score == old_score)
            & ((rank < old_rank) | ((rank == old_rank) & (chord < self.win_chord[spot])))
        )
        spot = spot[wins]
        self.win_score[spot], self.win_rank[spot], self.win_chord[spot] = score[wins], rank[wins], chord[wins]
        self.win_record[spot], self.win_silent[spot] = record[wins], silent[wins]

    def _letters_bound(self, t: np.ndarray, r: np.ndarray) -> np.ndarray:
        """No ratio is above twice the letters both names have over both lengths."""
        a, b = self.t, self.r
        common = np.bitwise_count(a.low[t] & b.low[r]).astype(np.int64)
        common += np.bitwise_count(a.high[t] & b.high[r])
        common += np.minimum(a.spare[t], b.spare[r])
        la, lb = a.size[t], b.size[r]
        if not (a.short.all() and b.short.all()):
            common = np.where(a.short[t] & b.short[r], common, np.minimum(la, lb))
        return 2.0 * common / (la + lb)

    def _sequence_bound(self, t: np.ndarray, r: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Nor above twice the longest common subsequence, found as in ``common_letters``."""
        bound = bound.copy()
        short = np.flatnonzero(self.t.short[t] & self.r.short[r])
        for k in np.split(short, range(_PAIRS, len(short), _PAIRS)):
            if not len(k):
                continue
            a, b = t[k], r[k]
            base = a * (_NO_LETTER + 1)
            full = ~np.uint64(0) >> (np.uint64(64) - self.t.size[a].astype(np.uint64))
            row = full.copy()
            for letters in self.r.codes[: self.r.size[b].max()]:
                met = row & self.t.places[base + letters[b]]
                row = (row + met) | (row - met)
            bound[k] = 2.0 * np.bitwise_count(~row & full) / (self.t.size[a] + self.r.size[b])
        return bound

    def _ratios(self, t: np.ndarray, r: np.ndarray, need: np.ndarray) -> np.ndarray:
        """The sequence ratios."""
        ratios = np.zeros(len(t))
        short = self.t.short[t] & self.r.short[r]
        for k in np.flatnonzero(~short):
            ratios[k] = ratio_reaching(self.t.texts[t[k]], self.r.texts[r[k]], need[k])
        short = np.flatnonzero(short)
        for k in np.split(short, range(_RATIOS, len(short), _RATIOS)):
            if len(k):
                matched = _matched(self.t, self.r, t[k], r[k])
                ratios[k] = 2.0 * matched / (self.t.size[t[k]] + self.r.size[r[k]])
        return ratios

    def _word_scores(self, t: np.ndarray, r: np.ndarray) -> np.ndarray:
        """The word part of the name score, as ``token_score``."""
        shared, long = np.zeros(len(t), np.int64), np.zeros(len(t), bool)
        short = self.t.short[t] & self.r.short[r]
        for k in np.flatnonzero(~short):
            both = np.intersect1d(self.t.word_sets(t[k]), self.r.word_sets(r[k]))
            shared[k], long[k] = len(both), self.long[both].any()
        short = np.flatnonzero(short)
        if len(short):
            a, b = t[short], r[short]
            n_shared, n_long = np.zeros(len(a), np.int64), np.zeros(len(a), bool)
            for i in range(self.t.n_words[a].max()):
                word, hit = self.t.words[a, i], np.zeros(len(a), bool)
                for j in range(self.r.n_words[b].max()):
                    hit |= word == self.r.words[b, j]
                hit &= word >= 0
                n_shared += hit
                n_long |= hit & self.long[word]
            shared[short], long[short] = n_shared, n_long
        na, nb = self.t.n_words[t], self.r.n_words[r]
        score = shared / (na + nb - shared)
        score = np.maximum(score, np.where(long, fixed.SHARED_WORD_SCORE, 0.0))
        return np.maximum(score, np.where((shared == na) & (na >= 2), fixed.COVERED_SCORE, 0.0))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))


def _spread(better: np.ufunc, value: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """In each row the best value of its run."""
    starts = _starts(ordered)
    return np.repeat(better.reduceat(value, starts), np.diff(np.append(starts, len(ordered))))


def _matched(a: _Names, b: _Names, t: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Letters that ``difflib.SequenceMatcher`` matches: the longest block, the first in ``a``
    and then in ``b``, and the same to its left and to its right."""
    width = int(a.size[t].max())
    # Of each letter of a the places in b that have it, as bits.
    same = b.places[r * (_NO_LETTER + 1) + a.codes[:width, t]]
    total = np.zeros(len(t), np.int64)
    pair = np.arange(len(t))
    a_low, a_high, b_low, b_high = np.zeros(len(t), np.int64), a.size[t], np.zeros(len(t), np.int64), b.size[r]
    column = np.arange(width)[:, None]
    while len(pair):
        some = (~np.uint64(0) >> (64 - (b_high - b_low)).astype(np.uint64)) << b_low.astype(np.uint64)
        runs = np.where((column >= a_low) & (column < a_high), same[:, pair] & some, np.uint64(0))
        size, i, j = _longest(runs)
        total += np.bincount(pair, size, len(t)).astype(np.int64)
        left = (size > 0) & (a_low < i) & (b_low < j)
        right = (size > 0) & (i + size < a_high) & (j + size < b_high)
        pair, a_low, a_high, b_low, b_high = (
            np.concatenate([x[left], y[right]])
            for x, y in ((pair, pair), (a_low, i + size), (i, a_high), (b_low, j + size), (j, b_high))
        )
    return total


def _longest(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column the length of the longest block, 0 if none, and where it begins.

    Bit j of row i says that a block of the length so far begins at letter i and letter j.
    """
    n = runs.shape[1]
    size, i, j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    at = np.flatnonzero(np.bitwise_or.reduce(runs, axis=0))
    runs = runs[:, at]
    length = 1
    while len(at):
        longer = runs[:-1] & (runs[1:] >> _ONE)
        more = np.bitwise_or.reduce(longer, axis=0) != 0 if len(longer) else np.zeros(len(at), bool)
        last = np.flatnonzero(~more)
        if len(last):
            begins = (runs[:, last] != 0).argmax(axis=0)
            bits = runs[begins, last]
            size[at[last]], i[at[last]] = length, begins
            j[at[last]] = np.bitwise_count((bits & (~bits + _ONE)) - _ONE)
        at, runs = at[more], longer[:, more]
        length += 1
    return size, i, j
