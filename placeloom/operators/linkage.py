"""Linking curated targets to collected records, strongest evidence first.

Stages: same phone key (near or position unknown), same address key (nearer),
similar name close by.  A later stage only sees targets no earlier stage
linked.  A record may serve many targets.

Copies are collapsed on both sides before anything is paired: records that
agree on everything a stage looks at keep their first position, targets that
agree are linked once and their answer is handed to all of them.  Pairs meet on
the stage's key plus a grid bucket, through the balanced join, and are reduced
to one row per target inside each task.  The name stage has no key but the place:
its pairs are searched inside blocks (``name_search``) and never become rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.functions.geo import haversine_m, position
from placeloom.functions.text import (
    address_key,
    name_norm,
    name_score,
    name_tokens,
    phone_key,
    phones_disagree,
)
from placeloom.operators.filters import is_closed
from placeloom.operators.grid import GRID_KEY, bucket_circles, bucket_points, class_of
from placeloom.operators.name_search import best_names
from placeloom.operators.skew import BROADCAST_ROWS, SIDE_ROWS, balanced_join, is_small
from placeloom.session import materialize, shuffle_width

LINKS = "target_id", "evidence", "record_pos", "distance_m"
# The line that every record is on; no phone key, which is digits alone.
_ALL_LINES = "*"


def linkage_columns(
    df: DataFrame, prefix: str, identity: str, country_codes: list[str] | None = None
) -> DataFrame:
    """Identity, position, keys and normalised name of linkage records.

    ``lat`` and ``lng`` may be text; unusable ones count as unknown.
    """
    lat, lng = position(F.col("lat"), F.col("lng"))
    return df.select(
        identity,
        lat.alias(f"{prefix}_lat"),
        lng.alias(f"{prefix}_lng"),
        phone_key(F.col("phone"), country_codes).alias(f"{prefix}_phone"),
        address_key(F.col("address")).alias(f"{prefix}_address"),
        name_norm(F.col("name")).alias(f"{prefix}_norm"),
    )


def _with_score(pairs: DataFrame, floor: float, out: str) -> DataFrame:
    """Name score column; exact wherever it reaches ``floor``."""
    words = pairs.withColumns(
        {"_tw": name_tokens(F.col("t_norm")), "_rw": name_tokens(F.col("r_norm"))}
    )
    score = name_score(F.col("t_norm"), F.col("_tw"), F.col("r_norm"), F.col("_rw"), floor)
    return words.withColumn(out, score).drop("_tw", "_rw")


def _reduce(records: DataFrame, targets: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """Only records that share a key with a target, when those are few."""
    if not small:
        return records
    return records.join(F.broadcast(targets.select(*keys).distinct()), keys, "left_semi")


def _meet(
    targets: DataFrame,
    records: DataFrame,
    limit_m: float,
    extra_keys: list[str],
    judged: list[str],
    broadcast_rows: int,
    side_rows: int,
) -> DataFrame:
    """Pairs with known distance within ``limit_m`` and equal ``extra_keys``.

    Records that agree on position, keys and the ``judged`` columns are copies:
    the first in record order stands for all.
    """
    radius = F.lit(float(limit_m))
    keys = [*GRID_KEY, *extra_keys]
    traits = ["r_lat", "r_lng", *judged]
    left = bucket_circles(targets, "t_lat", "t_lng", radius)
    right = bucket_points(records, "r_lat", "r_lng", [class_of(limit_m)])
    small = is_small(left, broadcast_rows)
    right = _reduce(right, left, keys, small)
    right = right.groupBy(*keys, *traits).agg(F.min("record_pos").alias("record_pos"))
    if small:
        # What is left is short, but each row meets many targets, whose names are compared.
        right = right.repartition(shuffle_width(records.sparkSession), *keys, *traits)
    pairs = balanced_join(
        left,
        right,
        keys,
        ["target_no"],
        traits,
        broadcast_rows,
        side_rows,
        left_rows=0 if small else broadcast_rows + 1,
    )
    distance = haversine_m(F.col("t_lat"), F.col("t_lng"), F.col("r_lat"), F.col("r_lng"))
    return pairs.withColumn("distance_m", distance).where(F.col("distance_m") <= radius)


def _key_pairs(
    targets: DataFrame,
    records: DataFrame,
    keys: list[str],
    limit_m: float,
    judged: list[str],
    broadcast_rows: int,
    side_rows: int,
) -> DataFrame:
    """Records that may win for a target among those sharing the exact keys.

    Unknown distances need no pairs per place: per key (and what is judged) only
    the first record overall can win for a target without a position, and only
    the first without one for the others.
    """
    placed = targets.withColumn("placed", F.col("t_lat").isNotNull())
    small = is_small(targets, broadcast_rows)
    unplaced = F.when(F.col("r_lat").isNull(), F.col("record_pos"))
    groups = _reduce(records, targets, keys, small).groupBy(*keys, *judged).agg(
        F.min("record_pos").alias("first_any"), F.min(unplaced).alias("first_unplaced")
    )
    firsts = F.array(
        F.struct(F.lit(False).alias("placed"), F.col("first_any").alias("record_pos")),
        F.struct(F.lit(True).alias("placed"), F.col("first_unplaced").alias("record_pos")),
    )
    groups = groups.select(*keys, *judged, F.inline(firsts)).where("record_pos is not null")
    met = balanced_join(
        placed,
        groups,
        [*keys, "placed"],
        ["target_no"],
        ["record_pos"],
        broadcast_rows,
        side_rows,
        left_rows=0 if small else broadcast_rows + 1,
    )
    near = _meet(targets, records, limit_m, keys, judged, broadcast_rows, side_rows)
    columns = ["target_no", "t_norm", *judged, "record_pos", "distance_m"]
    return met.withColumn("distance_m", F.lit(None).cast("double")).select(
        *columns
    ).unionByName(near.select(*columns))


def _key_stage(
    targets: DataFrame,
    records: DataFrame,
    key: str,
    limit_m: float,
    veto: bool,
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
) -> DataFrame:
    """Best record per target among those sharing the exact key.

    An unknown distance beats any known one and takes the first record;
    otherwise the nearest within the limit wins, ties to the earlier record.
    Phones on both sides that differ veto a pair unless the names vouch.  So a
    target with a phone takes any record with the same one or none, whatever the
    names, and else one whose name vouches, whatever its phone: records are
    copies without regard to the phone.
    """
    sizes = broadcast_rows, side_rows
    targets = targets.withColumn("key", F.col(f"t_{key}")).where("key is not null")
    records = records.withColumn("key", F.col(f"r_{key}")).where("key is not null")
    columns = ["target_no", "record_pos", "distance_m"]
    if veto:
        # A record is on the line of its phone, which is empty without one, and on that of all.
        own = lambda c: F.coalesce(F.col(c), F.lit(""))
        lines = F.when(F.col("t_phone").isNull(), F.array(F.lit(_ALL_LINES))).otherwise(
            F.array(F.lit(""), F.col("t_phone"))
        )
        clear = _key_pairs(
            targets.withColumn("line", F.explode(lines)),
            records.withColumn("line", F.explode(F.array(F.lit(_ALL_LINES), own("r_phone")))),
            ["key", "line"], limit_m, [], *sizes,
        )
        calling = targets.where("t_phone is not null")
        doubtful = _key_pairs(calling, records, ["key"], limit_m, ["r_norm"], *sizes)
        scored = _with_score(doubtful, fixed.NAME_VOUCH_SCORE, "_score")
        vouched = scored.where(F.col("_score") >= fixed.NAME_VOUCH_SCORE)
        candidates = clear.select(*columns).unionByName(vouched.select(*columns))
    else:
        candidates = _key_pairs(targets, records, ["key"], limit_m, [], *sizes)
    # NULL distance sorts first in a struct minimum, as the rule wants.
    best = F.min(F.struct("distance_m", "record_pos")).alias("best")
    return candidates.groupBy("target_no").agg(best).select(
        "target_no", "best.record_pos", "best.distance_m"
    )


def _name_stage(
    targets: DataFrame,
    records: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    side_rows: int = SIDE_ROWS,
) -> DataFrame:
    """Best-scoring name within reach; distance does not break ties, order does.

    Position and name decide score and distance, so they meet once per spot:
    targets, and records, that agree on both.  The veto needs no pairs per phone:
    where the names vouch the first record of a spot wins; where they only match,
    a target without a phone takes the first too, and one with a phone the first
    without one, or one with the same phone, which is met by the phone.
    """
    sizes = broadcast_rows, side_rows
    traits = ["t_lat", "t_lng", "t_norm", "calling"]
    # One minimum per phone first, as copies are told by the phone too.
    records = records.groupBy("r_lat", "r_lng", "r_norm", "r_phone").agg(
        F.min("record_pos").alias("record_pos")
    )
    placed = targets.where("t_lat is not null").withColumn("calling", F.col("t_phone").isNotNull())
    placed = placed.withColumn("spot_no", F.md5(F.to_json(F.struct(*traits))))
    spots = placed.groupBy("spot_no").agg(*[F.first(c).alias(c) for c in traits])
    first = F.struct("record_pos")
    places = records.groupBy("r_lat", "r_lng", "r_norm").agg(
        F.min(first).alias("first_any"),
        F.min(F.when(F.col("r_phone").isNull(), first)).alias("first_silent"),
    )
    distance = haversine_m(F.col("t_lat"), F.col("t_lng"), F.col("r_lat"), F.col("r_lng"))
    ranked = F.struct((-F.col("score")).alias("s"), "record_pos", distance.alias("distance_m"))
    of_spot = best_names(spots, places, fixed.NAME_MAX_M, *sizes).groupBy("spot_no").agg(
        F.min(ranked).alias("best")
    )
    by_spot = placed.select("target_no", "spot_no").join(of_spot, "spot_no").select("target_no", "best")
    same_phone = _meet(
        targets.withColumn("key", F.col("t_phone")).where("key is not null"),
        records.withColumn("key", F.col("r_phone")).where("key is not null"),
        fixed.NAME_MAX_M, ["key"], ["r_norm"], *sizes,
    )
    ranked = F.struct((-F.col("score")).alias("s"), "record_pos", "distance_m")
    by_phone = _with_score(same_phone, fixed.NAME_MIN_SCORE, "score").where(
        F.col("score") >= fixed.NAME_MIN_SCORE
    )
    passing = by_spot.unionByName(by_phone.select("target_no", ranked.alias("best")))
    return passing.groupBy("target_no").agg(F.min("best").alias("best")).select(
        "target_no",
        F.col("best.record_pos").alias("record_pos"),
        F.col("best.distance_m").alias("distance_m"),
        (-F.col("best.s")).alias("score"),
    )


def prepare(
    targets: DataFrame, records: DataFrame, country_codes: list[str] | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct targets, their members, and records, all with linkage columns.

    Written once: the keys feed three stages.
    """
    keyed = linkage_columns(targets, "t", "target_id", country_codes)
    traits = [c for c in keyed.columns if c != "target_id"]
    members = materialize(
        keyed.withColumn("target_no", F.md5(F.to_json(F.struct(*traits)))), "members"
    )
    distinct = members.groupBy("target_no").agg(*[F.first(c).alias(c) for c in traits])
    collected = linkage_columns(records, "r", "record_pos", country_codes)
    return (
        materialize(distinct, "targets"),
        members.select("target_id", "target_no"),
        materialize(collected, "records"),
    )


def _expand(picked: DataFrame, members: DataFrame) -> DataFrame:
    return members.join(picked, "target_no").drop("target_no")


def link_by_phone(targets: DataFrame, records: DataFrame, **options) -> DataFrame:
    distinct, members, collected = prepare(targets, records)
    picked = _key_stage(distinct, collected, "phone", fixed.PHONE_MAX_M, veto=False, **options)
    return _expand(picked, members)


def link_by_address(targets: DataFrame, records: DataFrame, **options) -> DataFrame:
    distinct, members, collected = prepare(targets, records)
    picked = _key_stage(distinct, collected, "address", fixed.ADDRESS_MAX_M, veto=True, **options)
    return _expand(picked, members)


def link_by_name(targets: DataFrame, records: DataFrame, **options) -> DataFrame:
    distinct, members, collected = prepare(targets, records)
    return _expand(_name_stage(distinct, collected, **options), members)


def link(targets: DataFrame, records: DataFrame, **options) -> DataFrame:
    """The waterfall: (target_id, evidence, record_pos, distance_m), linked only.

    ``targets`` should hold open targets only (see ``split_closed``).
    """
    distinct, members, collected = prepare(targets, records)
    stages = [
        (fixed.EVIDENCE_PHONE, lambda t: _key_stage(
            t, collected, "phone", fixed.PHONE_MAX_M, veto=False, **options)),
        (fixed.EVIDENCE_ADDRESS, lambda t: _key_stage(
            t, collected, "address", fixed.ADDRESS_MAX_M, veto=True, **options)),
        (fixed.EVIDENCE_NAME, lambda t: _name_stage(t, collected, **options).drop("score")),
    ]
    remaining, linked = distinct, None
    for evidence, stage in stages:
        picked = materialize(
            stage(remaining).withColumn("evidence", F.lit(evidence)), "picked"
        )
        linked = picked if linked is None else linked.unionByName(picked)
        remaining = remaining.join(picked.select("target_no"), "target_no", "left_anti")
    return _expand(linked, members).select(*LINKS)


def split_closed(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(open, closed): closed targets are excluded, not missed."""
    if "closed" not in targets.columns:
        return targets, targets.limit(0)
    closed = is_closed(F.col("closed"))
    return targets.where(~closed), targets.where(closed)


def compare(targets: DataFrame, records: DataFrame, **options) -> DataFrame:
    """Every target with its outcome: matched, missing or closed."""
    open_targets, _ = split_closed(targets)
    links = link(open_targets, records, **options)
    closed = is_closed(F.col("closed")) if "closed" in targets.columns else F.lit(False)
    return (
        targets.join(links, "target_id", "left")
        .withColumn(
            "outcome",
            F.when(closed, "closed").when(F.col("evidence").isNotNull(), "matched").otherwise(
                "missing"
            ),
        )
    )


def link_summary(compared: DataFrame) -> DataFrame:
    """Curated, closed, comparable, matched, percentage, missing in one row."""
    outcome = F.col("outcome")
    counts = compared.agg(
        F.count("*").alias("curated"),
        F.count_if(outcome == "closed").alias("closed"),
        F.count_if(outcome == "matched").alias("matched"),
        F.count_if(outcome == "missing").alias("missing"),
    )
    comparable = F.col("curated") - F.col("closed")
    return counts.withColumn("comparable", comparable).withColumn(
        "match_pct",
        F.when(comparable > 0, F.lit(100.0) * F.col("matched") / comparable).otherwise(0.0),
    )


def evidence_counts(links: DataFrame) -> DataFrame:
    """Matches by evidence, most common first."""
    return links.groupBy("evidence").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.asc("evidence")
    )


def weak_names(links: DataFrame, targets: DataFrame, records: DataFrame) -> DataFrame:
    """Links whose names alone would not have matched."""
    named = (
        links.join(targets.select("target_id", F.col("name").alias("target_name")), "target_id")
        .join(records.select("record_pos", F.col("name").alias("record_name")), "record_pos")
        .withColumn("t_norm", name_norm(F.col("target_name")))
        .withColumn("r_norm", name_norm(F.col("record_name")))
    )
    scored = _with_score(named, 0.0, "name_score")
    return scored.where(F.col("name_score") < fixed.NAME_MIN_SCORE).select(
        "target_id", "target_name", "record_pos", "record_name", "evidence", "name_score"
    )
