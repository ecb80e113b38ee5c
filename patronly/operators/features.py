"""Feature preparation: clipping, scaling, encoding, splits and model tables.

Scalers and encoders are fitted to a handful of statistics (one row per column or
level), which then become literals in the row expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from ..functions.columns import as_int, true_or_false, uniform
from ..functions.numbering import number_rows
from ..functions.quantiles import exact_quantiles
from ..functions.skew import salted_join


# ---------------------------------------------------------------- column transforms
def clip(df: DataFrame, bounds: dict) -> DataFrame:
    """Cap columns below and/or above; ``bounds`` is column -> (low, high); null stays."""
    def capped(c, low, high):
        value = F.col(c)
        if low is not None:
            value = F.when(value < low, F.lit(low)).otherwise(value)
        if high is not None:
            value = F.when(value > high, F.lit(high)).otherwise(value)
        return value
    return df.withColumns({c: capped(c, *b) for c, b in bounds.items()})


def abs_discount(df: DataFrame, column: str = "AvgPromoDiscount") -> DataFrame:
    return df.withColumn(column, F.abs(column))


def has_promo(df: DataFrame) -> DataFrame:
    """HasPromoDiscount from the signed mean discount (use before ``abs_discount``)."""
    return df.withColumn("HasPromoDiscount", true_or_false(F.col("AvgPromoDiscount") < 0))


def log1p_features(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.log1p(c) for c in columns})


def drop_incomplete(df: DataFrame, features, some_positive: bool = False) -> DataFrame:
    """Rows with every feature known and, if asked, at least one above zero."""
    full = df.dropna(subset=list(features))
    return full.filter(F.greatest(*[F.col(c).cast("double") for c in features], F.lit(0.0)) > 0) \
        if some_positive else full


def fill_zero(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.coalesce(c, F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in exclude]


def numeric_features(df: DataFrame, exclude=(), key: str = "CustomerId") -> DataFrame:
    """The key and all numeric columns but the excluded ones; incomplete rows drop out."""
    return df.select(key, *numeric_columns(df, {key, *exclude})).dropna()


# ---------------------------------------------------------------- scaling
def _scaled(df: DataFrame, params: dict) -> DataFrame:
    return df.withColumns({
        c: (F.col(c) - F.lit(float(center))) / F.lit(float(scale) or 1.0)
        for c, (center, scale) in params.items()})


def _stats(df: DataFrame, columns, low, high) -> dict:
    row = df.agg(*[low(c).alias(f"a_{c}") for c in columns], *[high(c).alias(f"b_{c}") for c in columns]).first()
    return {c: (float(row[f"a_{c}"] or 0.0), float(row[f"b_{c}"] or 0.0)) for c in columns}


def fit_standard(df: DataFrame, columns) -> dict:
    """column -> (mean, population deviation)."""
    return _stats(df, columns, F.avg, F.stddev_pop)


def fit_minmax(df: DataFrame, columns) -> dict:
    """column -> (minimum, range)."""
    return {c: (a, b - a) for c, (a, b) in _stats(df, columns, F.min, F.max).items()}


def fit_robust(df: DataFrame, columns) -> dict:
    """column -> (median, interquartile range), exact."""
    rows = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns}).collect()
    at = {(r["feature"], r["p"]): r["quantile"] for r in rows}
    return {c: (at.get((c, 0.5), 0.0), at.get((c, 0.75), 0.0) - at.get((c, 0.25), 0.0)) for c in columns}


def standard_scale(df: DataFrame, columns, params: dict | None = None) -> DataFrame:
    return _scaled(df, params or fit_standard(df, columns))


def minmax_scale(df: DataFrame, columns, params: dict | None = None) -> DataFrame:
    return _scaled(df, params or fit_minmax(df, columns))


def robust_scale(df: DataFrame, columns, fit_df: DataFrame | None = None) -> DataFrame:
    """Scale ``df`` by median and IQR of ``fit_df`` (default: of itself)."""
    return _scaled(df, fit_robust(df if fit_df is None else fit_df, columns))


def log_robust(df: DataFrame, features, low: float = 0.0, some_positive: bool = True) -> DataFrame:
    """Clip below, log1p and robust-scale: the shape clustering and linear models use."""
    rows = drop_incomplete(df, features)
    rows = rows.withColumns({c: F.col(c).cast("double") for c in features})
    rows = drop_incomplete(clip(rows, {c: (low, None) for c in features}), features, some_positive)
    return robust_scale(log1p_features(rows, features), features)


# ---------------------------------------------------------------- encoding
def _levels(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("string").alias("level")).filter(
        F.col("level").isNotNull()).distinct()


MOST_COLUMNS = 2_000  # levels per column that may become columns


def one_hot_drop_first(df: DataFrame, columns, most: int = MOST_COLUMNS) -> DataFrame:
    """One 0/1 column per level but the alphabetically first. The levels are the columns of
    the result, so the driver has to know them; more than ``most`` levels of a column raise
    an error (after reading ``most`` + 1 of them): ``label_encode`` suits very many levels."""
    for c in columns:
        levels = [r["level"] for r in _levels(df, c).limit(most + 1).collect()]
        if len(levels) > most:
            raise ValueError(f"column {c!r} has more than {most} levels: encode it with label_encode")
        text = F.col(c).cast("string")
        df = df.withColumns({
            f"{c}_{level}": true_or_false(text == level).cast("int") for level in sorted(levels)[1:]
        }).drop(c)
    return df


def _codes(df: DataFrame, column: str) -> DataFrame:
    """(level, code) in alphabetical order from 0, numbered inside sorted partitions."""
    return number_rows(_levels(df, column), ["level"], "code").select("level", F.col("code").cast("int").alias("code"))


def _with_code(df: DataFrame, column: str, missing: int | None) -> DataFrame:
    columns = df.columns
    coded = salted_join(df.withColumn("_text", F.col(column).cast("string")), _codes(df, column),
                        "_text", "level", "left")
    code = F.col("code") if missing is None else F.coalesce("code", F.lit(missing))
    return coded.withColumn(column, code).select(*columns)


def label_encode(df: DataFrame, columns) -> DataFrame:
    """Replace text (or true/false) by its alphabetical code."""
    for c in columns:
        df = _with_code(df, c, missing=None)
    return df


def coerce_types(df: DataFrame, columns=None, null_bool: str = "true") -> DataFrame:
    """Booleans to 0/1 and text to sorted codes with null as -1.

    ``null_bool`` says what a missing flag counts as: ``"true"`` or ``"false"``.
    """
    for f in df.schema:
        if columns is not None and f.name not in columns:
            continue
        if isinstance(f.dataType, BooleanType):
            df = df.withColumn(f.name, F.coalesce(f.name, F.lit(null_bool == "true")).cast("int"))
        elif isinstance(f.dataType, StringType):
            df = _with_code(df, f.name, missing=-1)
    return df


def fixed_category_codes(df: DataFrame, column: str, categories, default: str) -> DataFrame:
    """Codes by the given order; anything else gets the default's code. Text true and
    false become 1 and 0 when ``categories`` is empty."""
    text = F.col(column).cast("string")
    if not categories:
        code = F.when(F.lower(text) == "true", 1).when(F.lower(text) == "false", 0)
    else:
        code = None
        for i, c in enumerate(categories):
            code = F.when(text == c, F.lit(i)) if code is None else code.when(text == c, F.lit(i))
        code = code.otherwise(F.lit(list(categories).index(default)))
    return df.withColumn(column, code)


# ---------------------------------------------------------------- splits and weights
def stratified_split(df: DataFrame, label: str, fraction: float = 0.2, seed: int = 42,
                     key: str = "CustomerId") -> DataFrame:
    """Adds IsTest: the ``fraction`` of each class with the smallest key hashes."""
    return _by_class_share(df, label, [fraction], "_part", seed, key).withColumn("IsTest", F.col("_part") == 0).drop("_part")


def _by_class_share(df: DataFrame, label: str, shares: list[float], name: str, seed: int, key: str) -> DataFrame:
    """Adds ``name``: how many of the quantiles ``shares`` of its class's key hashes a row
    has passed. The quantiles are exact; there are classes x shares of them."""
    hashed = df.withColumn("_u", uniform(key, seed=seed)).withColumn("_class", F.col(label).cast("string"))
    passed = F.lit(0)
    for row in exact_quantiles(hashed, {"_u": shares}, by=["_class"]).collect():
        mine = F.col("_class").eqNullSafe(F.lit(row["_class"])) & (F.col("_u") >= row["quantile"])
        passed = passed + mine.cast("int")
    return hashed.withColumn(name, passed).drop("_u", "_class")


def random_split(df: DataFrame, fraction: float = 0.2, seed: int = 42,
                 key: str = "CustomerId") -> DataFrame:
    return df.withColumn("IsTest", uniform(key, seed=seed) < fraction)


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "CustomerId") -> DataFrame:
    """Adds Fold 0..k-1: each class, ordered by key hash, is cut into k parts whose sizes
    differ by at most one row. The cuts are the class's k-quantiles of the hash, so no
    class has to meet in one task."""
    return _by_class_share(df, label, [i / k for i in range(1, k)], "Fold", seed, key)


def class_weights(df: DataFrame, label: str, mode: str = "positive") -> DataFrame:
    """Adds Weight: ``positive`` weighs positives by negatives/positives, ``balanced``
    weighs each class by n / (2 n_class)."""
    value = as_int(label)
    n, pos = df.agg(F.count(value), F.sum(value)).first()
    pos = pos or 0
    neg = n - pos
    if mode == "balanced":
        weights = (n / (2 * neg) if neg else 0.0, n / (2 * pos) if pos else 0.0)
    else:
        weights = (1.0, neg / pos if pos else 0.0)
    return df.withColumn("Weight", F.when(value == 1, F.lit(weights[1])).when(value == 0, F.lit(weights[0])))


def percentile_inliers(df: DataFrame, column: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Rows between two percentiles of a column."""
    at = {r["p"]: r["quantile"] for r in exact_quantiles(df, {column: [low, high]}).collect()}
    return df.filter(F.col(column).between(at[low], at[high])) if at else df.limit(0)


# ---------------------------------------------------------------- model tables
# Target -> (summary it is read from, features, least orders).
PREDICT_TARGETS = {
    "LikelyChurned": ("customer_summary", [
        "TotalOrders", "AvgOrderItemTotal", "AvgPromoDiscount", "PctNormalShipping",
        "FirstOrderSampleOnly"], 2),
    "TwoAndChurned": ("customer_summary_first_2_orders", [
        "AvgOrderItemTotal", "AvgPromoDiscount", "PctHoliday", "PctNormalShipping",
        "FirstOrderSampleOnly"], None),
    "OneAndDone": ("customer_summary_last_order", [
        "PctHoliday", "OrderItemPriceTotal", "TotalDiscount", "PctWorkHours", "PctSummer",
        "PctPresidentialElection", "PctNormalShipping"], None),
}


def first_order_sample_only(first_orders: DataFrame, sample_only: DataFrame) -> DataFrame:
    """Per customer: whether the first order held nothing but samples."""
    return first_orders.select("CustomerId", "OrderNumber").join(sample_only, "OrderNumber", "left") \
        .select("CustomerId", true_or_false(F.col("OrderSampleOnly")).alias("FirstOrderSampleOnly"))


def predict_dataset(target: str, summary: DataFrame, sample_only: DataFrame | None = None) -> DataFrame:
    """Key, 0/1 target and features of one prediction task; incomplete rows drop out.

    ``summary`` is the table named in ``PREDICT_TARGETS``.
    """
    _, features, least = PREDICT_TARGETS[target]
    df = summary
    if "FirstOrderSampleOnly" in features:
        df = df.join(sample_only, "CustomerId", "left")
    if least is not None:
        df = df.filter(F.col("TotalOrders") >= least)
    # A last-order summary averages one order: these are that order's own values.
    named = {"OrderItemPriceTotal": "AvgOrderItemTotal", "TotalDiscount": "AvgPromoDiscount"}
    picked = df.select("CustomerId", target, *[F.col(named.get(c, c)).alias(c) for c in features])
    flags = [f.name for f in picked.schema if isinstance(f.dataType, BooleanType)]
    return coerce_types(picked, columns=flags, null_bool="true").dropna()
