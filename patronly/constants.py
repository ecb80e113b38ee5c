"""Fixed values of the shop's analytics: words, labels, edges and day counts.

Everything here is a business constant that results depend on; operators take
each of them as a keyword default, so a different shop passes its own.
"""

# Product family -> (word the name must contain, word it must not).
PRODUCT_WORDS = {
    "IsSticker": ("icker", "ample"),
    "IsLabel": ("abel", "ample"),
    "IsPouch": ("ouch", "ample"),
}
SAMPLE_WORD = "ample"

# Shop, money and shipping constants.
AFFILIATE = 2
FREE_SHIPPING_AT = 75.0
TWO_DAY_PRICE = 4.0

# Category labels.
SHIP_LABELS = ["NormalShipping", "TwoDayShipping", "ExpeditedShipping"]
HOUR_LABELS = ["Morning", "Afternoon", "Evening", "EarlyMorning"]

# Hours of the day (first and last) by category; all other hours are early.
HOUR_RANGES = {"Morning": (5, 11), "Afternoon": (12, 16), "Evening": (17, 23)}

# Working hours (first and last), the number of working days from Monday on,
# and the days at either end of a month that are its edge.
WORK_HOURS = (8, 17)
WORKDAYS = 5
EDGE_DAYS = 7

# Months of the seasons, and every how many years they come.
SEASONS = {
    "Holiday": ((11, 12), 1),
    "Summer": ((5, 6, 7, 8), 1),
    "ElectionSeason": ((9, 10), 2),
    "PresidentialElection": ((8, 9, 10), 4),
}

# Columns of the first shipped order that go into a customer's summary.
FIRST_SHIPPED_COLUMNS = [
    "HourOfDay", "DayOfWeek", "Month", "DayOfMonth", "PromoCodeDiscount", "ShippingType",
    "AvgItemQuantity", "HourCategory", "WorkHours", "Workday", "FirstWeek", "LastWeek", "Holiday",
    "Summer", "ElectionSeason", "PresidentialElection", "RushFeeAndShipPrice",
    "OrderContainsSticker", "OrderContainsLabel",
]

# Attribution vocabulary.
TOP_MEDIUMS = ["cpc", "(none)", "organic", "referral", "email", "Display_Ad", "social"]
TOP_SOURCES = ["google", "(direct)", "bing", "facebook"]
AD_INDICATORS = [
    "AdSticker", "AdLabel", "AdPouch", "AdCompetitor",
    "AdMaterial", "AdUseOrShape", "AdVideo", "AdDSA",
]
SESSION_ATTRIBUTES = [
    "traffic_source_medium", "traffic_source_source", "traffic_source_name",
    "param_medium", "param_source", "device_category",
    "device_operating_system", "geo_metro",
]

# Bucket edges (right-closed) and their labels.
INF = float("inf")
SPENDING_EDGES = [0, 100, 500, 1000, 2500, 5000, 10000, 25000, 50000, 250000, INF]
SPENDING_LABELS = [
    "$0–100", "$100–500", "$500–1000", "$1000–2500", "$2500–5000", "$5000–10000",
    "$10000–25000", "$25000–50000", "$50000–250000", "$250000–∞",
]
ORDER_EDGES = [1, 2, 3, 4, 5, 6, 10, 20, INF]
ORDER_LABELS = ["1", "2", "3", "4", "5", "6–10", "10–20", "20–∞"]
ORDER_VALUE_EDGES = [0, 100, 500, 1000, 5000, INF]
ORDER_VALUE_LABELS = ["$0-$100", "$100-$500", "$500-$1,000", "$1,000-$5,000", "5,000+"]
ITEM_EDGES = [0, 0.5, 1, 2, 3, 5, 10, INF]
ITEM_LABELS = ["0–0.5", "0.5–1", "1–2", "2–3", "3–5", "5–10", "10+"]

# Churn rule day counts.
ACTIVE_DAYS = 35
QUIET_DAYS = 100
NEW_CUSTOMER_DAYS = 90
CADENCE_FACTOR = 1.5
PATTERN_GRACE = {
    "AnnualPattern": 290,
    "HolidayPattern": 290,
    "SummerPattern": 220,
    "ElectionPattern": 700,
    "PresidentialPattern": 1300,
}
ANNUAL_GAP = (315, 415)
