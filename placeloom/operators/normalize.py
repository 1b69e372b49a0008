"""Nested place payloads to flat place rows, tiers, stored-shape view."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom import fixed
from placeloom.schemas import place_type

# The payload fields in use.  Labels are VARIANT: an object with a text, or a string.
PAYLOAD = """
  id string, displayName variant, formattedAddress string, shortFormattedAddress string,
  addressComponents array<struct<longText: string, shortText: string, types: array<string>>>,
  location struct<latitude: double, longitude: double>, googleMapsUri string,
  websiteUri string, nationalPhoneNumber string, internationalPhoneNumber string,
  rating double, userRatingCount bigint, priceLevel string, businessStatus string,
  primaryType string, primaryTypeDisplayName variant, types array<string>,
  regularOpeningHours struct<openNow: boolean, weekdayDescriptions: array<string>>,
  editorialSummary variant, takeout boolean, delivery boolean, dineIn boolean,
  reservable boolean, servesBreakfast boolean, servesLunch boolean, servesDinner boolean,
  servesBeer boolean, servesWine boolean, servesVegetarianFood boolean,
  outdoorSeating boolean, goodForChildren boolean,
  accessibilityOptions struct<wheelchairAccessibleEntrance: boolean>,
  utcOffsetMinutes int, plusCode struct<globalCode: string>
"""


def _text(label: Column) -> Column:
    """A ``{"text": ...}`` object's text, or the string itself."""
    plain = F.when(F.schema_of_variant(label) == "STRING", F.try_variant_get(label, "$", "string"))
    return F.coalesce(F.try_variant_get(label, "$.text", "string"), plain)


def _component(components: Column, kinds: list[str], field: str) -> Column:
    """First non-empty text of a component kind; the last one when all are empty."""

    def of_kind(c: Column) -> Column:
        matches = F.array_contains(c["types"], kinds[0])
        for kind in kinds[1:]:
            matches = matches | F.array_contains(c["types"], kind)
        return matches

    filled = F.filter(components, lambda c: (c[field] != "") & of_kind(c))
    # Only looked at when nothing is filled in.
    any_text = F.filter(components, of_kind)
    return F.coalesce(F.get(filled, F.lit(0))[field], F.try_element_at(any_text, F.lit(-1))[field])


def _lookup(values: dict, key: Column) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def normalize_payload(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Replace a JSON payload column by the place columns plus ``raw_json``.

    The text is parsed once, straight into typed fields.  Missing or unusable
    fields become NULL; a false flag stays distinct from a missing one.  Other
    columns are kept.
    """
    doc = F.col("_doc")
    components, hours = doc["addressComponents"], doc["regularOpeningHours"]
    lines = hours["weekdayDescriptions"]
    price = doc["priceLevel"]
    expressions = {
        "place_id": doc["id"],
        "name": _text(doc["displayName"]),
        "formatted_address": doc["formattedAddress"],
        "short_address": doc["shortFormattedAddress"],
        "country_code": _component(components, ["country"], "shortText"),
        "latitude": doc["location"]["latitude"],
        "longitude": doc["location"]["longitude"],
        "google_maps_url": doc["googleMapsUri"],
        "website": doc["websiteUri"],
        "phone": doc["nationalPhoneNumber"],
        "phone_international": doc["internationalPhoneNumber"],
        "rating": doc["rating"],
        "user_rating_count": doc["userRatingCount"],
        "price_level": _lookup(fixed.PRICE_LEVELS, price),
        "price_label": _lookup(fixed.PRICE_LABELS, price),
        "business_status": doc["businessStatus"],
        "primary_type": doc["primaryType"],
        "primary_type_label": _text(doc["primaryTypeDisplayName"]),
        "types": F.nullif(F.array_join(doc["types"], ","), F.lit("")),
        "opening_hours": F.when(F.size(lines) > 0, F.array_join(lines, "\n")),
        "open_now": hours["openNow"],
        "editorial_summary": _text(doc["editorialSummary"]),
        "wheelchair_accessible_entrance": doc["accessibilityOptions"][
            "wheelchairAccessibleEntrance"
        ],
        "utc_offset_minutes": doc["utcOffsetMinutes"],
        "plus_code": doc["plusCode"]["globalCode"],
    }
    for column, kinds in fixed.ADDRESS_KINDS.items():
        expressions[column] = _component(components, kinds, "longText")
    for column, field in fixed.SERVICE_FLAG_FIELDS.items():
        expressions[column] = doc[field]

    kept = [c for c in payloads.columns if c != payload]
    parsed = payloads.withColumn("_doc", F.from_json(F.col(payload), PAYLOAD))
    return parsed.select(
        *kept,
        *[expressions[c].alias(c) for c in fixed.PLACE_COLUMNS],
        F.col(payload).alias("raw_json"),
    )


def tier_columns(tier: str) -> list[str]:
    """Place columns a field tier carries; tiers are cumulative."""
    if tier not in fixed.TIERS:
        raise ValueError(f"unknown field tier {tier!r}; pick one of {fixed.TIERS}")
    reached = fixed.TIERS[: fixed.TIERS.index(tier) + 1]
    carried = {c for t in reached for c in fixed.TIER_COLUMNS[t]}
    return [c for c in fixed.PLACE_COLUMNS if c in carried]


def project_tier(places: DataFrame, tier: str) -> DataFrame:
    """All place columns, those beyond the tier NULL; the scan reads only the rest."""
    carried = set(tier_columns(tier))
    return places.select(
        *[
            F.col(c) if c in carried else F.lit(None).cast(place_type(c)).alias(c)
            for c in fixed.PLACE_COLUMNS
        ]
    )


def check_review_bar(tier: str, min_reviews: int) -> None:
    """A positive review bar needs a tier that carries review counts."""
    if min_reviews and tier in fixed.TIERS_WITHOUT_REVIEWS:
        raise ValueError(
            f"a review bar needs review counts, which tier {tier!r} does not carry"
        )


def flat_view(places: DataFrame) -> DataFrame:
    """The stored shape user predicates are written against: flags as 0/1."""
    return places.select(
        *[
            F.col(c).cast("int").alias(c) if c in fixed.FLAG_COLUMNS else F.col(c)
            for c in places.columns
        ]
    )


def row_json(columns: list[str]) -> Column:
    """One row as JSON text, keys sorted, NULLs kept."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def payload_profile(places: DataFrame) -> DataFrame:
    """How many results carry the review counts a review bar relies on."""
    n, counted = F.count("*"), F.count("user_rating_count")
    return places.agg(
        n.alias("n_results"),
        counted.alias("n_with_review_count"),
        (counted > 0).alias("bar_usable"),
    )


def probe_sample(places: DataFrame, n: int = 5) -> DataFrame:
    """The first few results of a probe, by key."""
    return places.orderBy("place_id").select(
        "place_id", "name", "rating", "user_rating_count"
    ).limit(n)
