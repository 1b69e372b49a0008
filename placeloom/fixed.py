"""Fixed values.

Everything here must equal the published data contract for results to agree:
physical constants, column lists, word lists, lookup tables, patterns and
default settings.  They are data, stated once; no logic lives in this module.
"""

# --- geometry ---------------------------------------------------------------
EARTH_RADIUS_M = 6_371_008.8
METRES_PER_DEGREE_LAT = 111_320.0
COVERAGE_MARGIN = 0.98
MIN_BUDGET_RADIUS_M = 25.0
BUDGET_GRID_SHARE = 0.7
FIT_PASSES = 12
FIT_GROWTH = 1.05

# --- searching --------------------------------------------------------------
MAX_RESULTS_PER_SEARCH = 20
MAX_SEARCH_RADIUS_M = 50_000.0
DEFAULT_TYPES = ["restaurant"]
DEFAULT_CELL_RADIUS_M = 1000.0
DEFAULT_MIN_REVIEWS = 25
DEFAULT_MIN_RADIUS_M = 40.0
DEFAULT_MAX_DEPTH = 6
ESTIMATE_HIGH_WITH_BAR = 2.5
ESTIMATE_HIGH_CENSUS = 12
PRICE_PER_CALL = {
    "ids": 0.0,
    "standard": 0.032,
    "ratings": 0.035,
    "full": 0.040,
}
DEFAULT_PRICE_PER_CALL = 0.035

# --- place rows -------------------------------------------------------------
PLACE_COLUMNS = [
    "place_id", "name", "formatted_address", "short_address", "street_number",
    "street", "district", "city", "region", "postal_code", "country",
    "country_code", "latitude", "longitude", "google_maps_url", "website",
    "phone", "phone_international", "rating", "user_rating_count",
    "price_level", "price_label", "business_status", "primary_type",
    "primary_type_label", "types", "opening_hours", "open_now",
    "editorial_summary", "takeout", "delivery", "dine_in", "reservable",
    "serves_breakfast", "serves_lunch", "serves_dinner", "serves_beer",
    "serves_wine", "serves_vegetarian_food", "outdoor_seating",
    "good_for_children", "wheelchair_accessible_entrance",
    "utc_offset_minutes", "plus_code",
]
DOUBLE_COLUMNS = ["latitude", "longitude", "rating"]
BIGINT_COLUMNS = ["user_rating_count"]
INT_COLUMNS = ["price_level", "utc_offset_minutes"]
FLAG_COLUMNS = [
    "open_now", "takeout", "delivery", "dine_in", "reservable",
    "serves_breakfast", "serves_lunch", "serves_dinner", "serves_beer",
    "serves_wine", "serves_vegetarian_food", "outdoor_seating",
    "good_for_children", "wheelchair_accessible_entrance",
]
SERVICE_FLAG_FIELDS = {
    "takeout": "takeout",
    "delivery": "delivery",
    "dine_in": "dineIn",
    "reservable": "reservable",
    "serves_breakfast": "servesBreakfast",
    "serves_lunch": "servesLunch",
    "serves_dinner": "servesDinner",
    "serves_beer": "servesBeer",
    "serves_wine": "servesWine",
    "serves_vegetarian_food": "servesVegetarianFood",
    "outdoor_seating": "outdoorSeating",
    "good_for_children": "goodForChildren",
}
PRICE_LEVELS = {
    "PRICE_LEVEL_FREE": 0,
    "PRICE_LEVEL_INEXPENSIVE": 1,
    "PRICE_LEVEL_MODERATE": 2,
    "PRICE_LEVEL_EXPENSIVE": 3,
    "PRICE_LEVEL_VERY_EXPENSIVE": 4,
}
PRICE_LABELS = {
    "PRICE_LEVEL_FREE": "Free",
    "PRICE_LEVEL_INEXPENSIVE": "$",
    "PRICE_LEVEL_MODERATE": "$$",
    "PRICE_LEVEL_EXPENSIVE": "$$$",
    "PRICE_LEVEL_VERY_EXPENSIVE": "$$$$",
}
ADDRESS_KINDS = {
    "street_number": ["street_number"],
    "street": ["route"],
    "city": ["locality", "postal_town"],
    "region": ["administrative_area_level_1"],
    "district": ["administrative_area_level_2"],
    "country": ["country"],
    "postal_code": ["postal_code"],
}
NON_RESTAURANT_TYPES = [
    "airport", "amusement_park", "bank", "bowling_alley", "bus_station",
    "casino", "convenience_store", "cultural_center", "department_store",
    "discount_store", "drugstore", "event_venue", "extended_stay_hotel",
    "ferry_terminal", "gas_station", "grocery_store", "gym",
    "home_goods_store", "hospital", "hostel", "hotel", "hypermarket", "inn",
    "liquor_store", "lodging", "market", "motel", "movie_theater", "museum",
    "night_club", "park", "parking", "pharmacy", "resort_hotel", "sauna",
    "school", "shopping_mall", "spa", "sporting_goods_store", "stadium",
    "store", "supermarket", "tourist_attraction", "train_station",
    "transit_station", "university", "warehouse_store", "wholesaler", "zoo",
]
TIERS = ["ids", "standard", "ratings", "full"]
# Place-row columns each tier adds to the ones before it.
TIER_COLUMNS = {
    "ids": ["place_id"],
    "standard": [
        "name", "formatted_address", "short_address", "street_number",
        "street", "district", "city", "region", "postal_code", "country",
        "country_code", "latitude", "longitude", "google_maps_url",
        "business_status", "primary_type", "primary_type_label", "types",
        "utc_offset_minutes", "plus_code",
    ],
    "ratings": [
        "website", "phone", "phone_international", "rating",
        "user_rating_count", "price_level", "price_label", "opening_hours",
        "open_now",
    ],
    "full": [
        "editorial_summary", "takeout", "delivery", "dine_in", "reservable",
        "serves_breakfast", "serves_lunch", "serves_dinner", "serves_beer",
        "serves_wine", "serves_vegetarian_food", "outdoor_seating",
        "good_for_children", "wheelchair_accessible_entrance",
    ],
}
TIERS_WITHOUT_REVIEWS = ["ids", "standard"]
UNKNOWN_CITY = "(unknown)"
LEGACY_SCOPE = "restaurant"
DEFAULT_PRUNE_DAYS = 30

# --- linkage ----------------------------------------------------------------
COUNTRY_CODES = ["372"]
MIN_PHONE_DIGITS = 6
GENERIC_WORDS = [
    "restaurant", "restoran", "resto", "ravintola", "cafe", "kohvik", "kohv",
    "bar", "baar", "pub", "bistro", "bistroo", "kitchen", "koogikoda", "tn",
    "the", "by", "and", "ja", "tallinn", "eesti", "estonia", "ou", "as",
]
NAME_SUBSTITUTIONS = {"°": " degrees ", "&": " and ", "+": " and "}
STREET_MARKERS = ["tn", "tee", "pst", "mnt", "tanav", "street", "road"]
PHONE_MAX_M = 2000.0
ADDRESS_MAX_M = 400.0
NAME_MAX_M = 120.0
NAME_MIN_SCORE = 0.55
NAME_VOUCH_SCORE = 0.8
SHARED_WORD_SCORE = 0.9
SHARED_WORD_LENGTH = 5
COVERED_SCORE = 0.95
CLOSED_WORDS = ["true", "yes", "1"]
EVIDENCE_PHONE = "phone"
EVIDENCE_ADDRESS = "address"
EVIDENCE_NAME = "name+position"
REASON_NEVER_SEARCHED = "never searched"
REASON_SATURATED = "searched, but every covering circle was full"
REASON_NOT_RETURNED = (
    "searched and not returned (wrong type, or below the review bar)"
)
REASON_NO_POSITION = "no coordinates in the curated record"

# --- outbound records -------------------------------------------------------
RESTAURANT_FIELDS = {
    "place_id": "Google_Place_Id__c",
    "name": "Name",
    "google_maps_url": "Google_Maps_URL__c",
    "website": "Website__c",
    "phone": "Phone__c",
    "phone_international": "Phone_International__c",
    "formatted_address": "Formatted_Address__c",
    "street": "Street__c",
    "city": "City__c",
    "region": "Region__c",
    "postal_code": "Postal_Code__c",
    "country": "Country__c",
    "latitude": "Latitude__c",
    "longitude": "Longitude__c",
    "rating": "Rating__c",
    "user_rating_count": "User_Rating_Count__c",
    "price_level": "Price_Level__c",
    "price_label": "Price_Label__c",
    "business_status": "Business_Status__c",
    "primary_type": "Primary_Type__c",
    "primary_type_label": "Cuisine_Type__c",
    "types": "Google_Types__c",
    "opening_hours": "Opening_Hours__c",
    "editorial_summary": "Description__c",
    "takeout": "Takeout__c",
    "delivery": "Delivery__c",
    "dine_in": "Dine_In__c",
    "reservable": "Reservable__c",
    "serves_beer": "Serves_Beer__c",
    "serves_wine": "Serves_Wine__c",
    "serves_vegetarian_food": "Serves_Vegetarian__c",
    "outdoor_seating": "Outdoor_Seating__c",
    "good_for_children": "Good_For_Children__c",
    "wheelchair_accessible_entrance": "Wheelchair_Accessible__c",
}
ACCOUNT_FIELDS = {
    "place_id": "Google_Place_Id__c",
    "name": "Name",
    "website": "Website",
    "phone": "Phone",
    "street": "BillingStreet",
    "city": "BillingCity",
    "region": "BillingState",
    "postal_code": "BillingPostalCode",
    "country": "BillingCountry",
    "editorial_summary": "Description",
}
FIELD_MAPS = {
    "Restaurant__c": RESTAURANT_FIELDS,
    "Account": ACCOUNT_FIELDS,
}
FIELD_MAX_LENGTH = {
    "Name": 80,
    "Formatted_Address__c": 255,
    "Street__c": 255,
    "BillingStreet": 255,
    "Google_Types__c": 1000,
    "Opening_Hours__c": 2000,
    "Description__c": 4000,
    "Description": 32000,
}
# Target columns with a declared decimal type: (precision, scale).
FIELD_DECIMALS = {
    "Latitude__c": (10, 7),
    "Longitude__c": (11, 7),
    "Rating__c": (2, 1),
    "User_Rating_Count__c": (18, 0),
    "Price_Level__c": (1, 0),
}
EXTERNAL_ID_FIELD = "Google_Place_Id__c"
SYNC_STAMP_FIELD = "Last_Synced__c"
SYNC_STAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CUSTOM_OBJECT_SUFFIX = "__c"
DEFAULT_BATCH_SIZE = 5000
