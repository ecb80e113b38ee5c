"""Seasonal patterns, churn rules and the customer summaries built on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..constants import (
    ACTIVE_DAYS, ANNUAL_GAP, CADENCE_FACTOR, NEW_CUSTOMER_DAYS, PATTERN_GRACE, QUIET_DAYS,
)
from ..functions.columns import true_or_false, whole_days
from .customers import (
    SHARE_GROUPS, as_of_now, by_time, customer_hours, customer_profile, first_n_orders,
    flag_share_columns, gap_columns, label_shares, last_n_orders,
)
from .orders import season_flags_of


@dataclass(frozen=True)
class SeasonRule:
    """A customer repeats in a season: at least two orders in it, over at least
    ``min_years`` calendar years, the longest pause within the given days.

    ``season`` narrows the orders to a season flag first; a customer without any
    such order then has no answer (null) instead of false.
    """

    name: str
    months: tuple[int, ...]
    min_years: int = 2
    min_gap: int = 290
    max_gap: int = 2000
    season: str | None = None

    def hour_columns(self, seasons: dict[str, Column]) -> dict[str, Column]:
        """Per hour: is it in the rule's season at all, and in its months."""
        inside = true_or_false(F.month("Hour").isin(*self.months))
        asked = seasons[self.season] if self.season else F.lit(True)
        return {f"{self.name}_asked": asked, f"{self.name}_in": asked & inside}


# The shop's seasons.
HOLIDAY = SeasonRule("HolidayPattern", (11, 12))
SUMMER = SeasonRule("SummerPattern", (5, 6, 7, 8), min_gap=220)
ELECTION = SeasonRule("ElectionPattern", (9, 10), max_gap=800, season="ElectionSeason")
PRESIDENTIAL = SeasonRule("PresidentialPattern", (8, 9, 10), min_years=8, max_gap=1600,
                          season="PresidentialElection")
RULES = (HOLIDAY, SUMMER, ELECTION, PRESIDENTIAL)


def _with_previous(hours: DataFrame, rules) -> DataFrame:
    """Adds each rule's season marks and the last in-season time before each hour (one
    sort for all rules)."""
    seasons = season_flags_of("Hour")
    hours = hours.withColumns({n: c for r in rules for n, c in r.hour_columns(seasons).items()})
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    return hours.withColumns({
        f"{r.name}_prev": F.last(F.when(F.col(f"{r.name}_in"), F.col("LastTime")), ignorenulls=True).over(before)
        for r in rules
    })


def _rule_columns(rule: SeasonRule) -> dict[str, Column]:
    inside, previous = F.col(f"{rule.name}_in"), F.col(f"{rule.name}_prev")
    new_year = previous.isNull() | (F.year(previous) != F.year("Hour"))
    return {
        f"{rule.name}_any": F.bool_or(f"{rule.name}_asked"),
        f"{rule.name}_rows": F.sum(F.when(inside, F.col("Rows"))),
        f"{rule.name}_years": F.sum(F.when(inside & new_year, 1)),
        f"{rule.name}_gap": F.max(F.when(inside, whole_days(previous, F.col("FirstTime")))),
    }


def _rule_result(rule: SeasonRule, repeat: Column) -> Column:
    # Orders within one hour of the season pause for 0 days.
    longest = F.coalesce(f"{rule.name}_gap", F.lit(0))
    met = (
        (F.coalesce(f"{rule.name}_rows", F.lit(0)) >= 2)
        & (F.coalesce(f"{rule.name}_years", F.lit(0)) >= rule.min_years)
        & longest.between(rule.min_gap, rule.max_gap)
    )
    asked = repeat & F.col(f"{rule.name}_any") if rule.season else repeat
    return F.when(asked, met)


def _annual_columns(low: int, high: int) -> dict[str, Column]:
    rows = F.sum(F.when(F.col("Hour").isNotNull(), F.col("Rows")))
    yearly = F.count(F.when(F.col("Gap").between(low, high), 1))
    if low <= 0 <= high:
        yearly = yearly + rows - F.count("Hour")
    return {"Annual_share": F.try_divide(yearly.cast("double"), (rows - 1).cast("double")),
            "Annual_rows": F.sum("Rows")}


def _annual_result(repeat: Column, min_pct: float, min_orders: int) -> Column:
    met = (F.col("Annual_rows") >= min_orders) & true_or_false(F.col("Annual_share") >= min_pct)
    return F.when(repeat, met)


def repeating_pattern(orders: DataFrame, rule: SeasonRule) -> DataFrame:
    """One rule's answer per customer of ``orders`` (pass repeat customers' orders)."""
    hours = _with_previous(customer_hours(orders), [rule])
    grouped = hours.groupBy("CustomerId").agg(
        *[c.alias(n) for n, c in _rule_columns(rule).items()])
    result = _rule_result(rule, F.lit(True)).alias(rule.name)
    answered = grouped.filter(F.col(f"{rule.name}_any")) if rule.season else grouped
    return answered.select("CustomerId", result)


def holiday_pattern(orders: DataFrame, rule: SeasonRule = HOLIDAY) -> DataFrame:
    return repeating_pattern(orders, rule)


def summer_pattern(orders: DataFrame, rule: SeasonRule = SUMMER) -> DataFrame:
    return repeating_pattern(orders, rule)


def election_pattern(orders: DataFrame, rule: SeasonRule = ELECTION) -> DataFrame:
    return repeating_pattern(orders, rule)


def presidential_pattern(orders: DataFrame, rule: SeasonRule = PRESIDENTIAL) -> DataFrame:
    return repeating_pattern(orders, rule)


def annual_pattern(orders: DataFrame, min_pct: float = 0.5, min_orders: int = 2,
                   gap=ANNUAL_GAP) -> DataFrame:
    """Whether at least ``min_pct`` of a customer's pauses are about one year."""
    grouped = gap_columns(customer_hours(orders)).groupBy("CustomerId").agg(
        *[c.alias(n) for n, c in _annual_columns(*gap).items()])
    return grouped.select(
        "CustomerId", _annual_result(F.lit(True), min_pct, min_orders).alias("AnnualPattern"))


# ---------------------------------------------------------------- rules
def clock(orders: DataFrame, now=None) -> Column:
    """The as-of time: given, or the latest order time as a scalar subquery."""
    if now is not None:
        return F.lit(now).cast("timestamp")
    return as_of_now(orders).scalar()


def recency(profile: DataFrame, now: Column) -> DataFrame:
    return profile.withColumn("DaysSinceLastOrder", whole_days(F.col("LastOrderDate"), now))


def new_customer_90d(profile: DataFrame, now: Column, days: int = NEW_CUSTOMER_DAYS) -> DataFrame:
    since = F.timestamp_add("DAY", F.lit(-days), now)
    return profile.withColumn(
        "NewCustomerLast90Days", true_or_false(F.col("FirstOrderDate") >= since))


def exceeded_cadence(profile: DataFrame, factor: float = CADENCE_FACTOR) -> DataFrame:
    """Past ``factor`` times the customer's own mean pause (needs two orders)."""
    return profile.withColumn("ExceededCadence", true_or_false(
        F.col("DaysSinceLastOrder") > F.lit(factor) * F.col("MeanDaysBetweenOrders")))


def likely_churned(profile: DataFrame, active: int = ACTIVE_DAYS, quiet: int = QUIET_DAYS,
                   grace: dict = PATTERN_GRACE) -> DataFrame:
    """Silent for over ``active`` days and either past the own cadence, or silent for
    over ``quiet`` days with no seasonal pattern still inside its grace period."""
    days = F.col("DaysSinceLastOrder")
    excused = F.lit(False)
    for pattern, limit in grace.items():
        excused = excused | (true_or_false(F.col(pattern)) & (days <= limit))
    quiet_too_long = (days > quiet) & ~excused
    return profile.withColumn("LikelyChurned", true_or_false(
        (days > active) & (F.col("ExceededCadence") | quiet_too_long)))


# Label -> (fewest, most) orders of a churned customer with that label.
CHURNED_AFTER = {"OneAndDone": (1, 1), "ThreeOrFewerAndChurned": (0, 3), "TwoAndChurned": (2, 2)}


def n_and_churned(profile: DataFrame, labels: dict[str, tuple[int, int]] = CHURNED_AFTER) -> DataFrame:
    """One flag per label: churned after a number of orders in its range. Any other n is
    ``{"FiveAndChurned": (5, 5)}``."""
    total, churned = F.col("TotalOrders"), F.col("LikelyChurned")
    return profile.withColumns({name: total.between(*ends) & churned for name, ends in labels.items()})


PATTERNS = ["AnnualPattern", "HolidayPattern", "SummerPattern", "ElectionPattern",
            "PresidentialPattern"]
CHURN_COLUMNS = ["CustomerId", "DaysSinceLastOrder", "NewCustomerLast90Days", "ExceededCadence",
                 *PATTERNS, "LikelyChurned", "OneAndDone", "ThreeOrFewerAndChurned", "TwoAndChurned"]


def churn_profile(orders: DataFrame, now=None, rules=RULES, min_pct: float = 0.5,
                  min_orders: int = 2, annual_gap=ANNUAL_GAP, grace: dict = PATTERN_GRACE,
                  extra: dict | None = None) -> DataFrame:
    """Customer profile with patterns and churn labels: one shuffle of order rows
    (already summed per hour), one sort per customer, no join."""
    helpers = {n: c for r in rules for n, c in _rule_columns(r).items()}
    helpers.update(_annual_columns(*annual_gap))
    profile = customer_profile(orders, {**helpers, **(extra or {})},
                               lambda hours: _with_previous(hours, rules))
    repeat = F.col("TotalOrders") > 1
    profile = profile.withColumns({
        **{r.name: _rule_result(r, repeat) for r in rules},
        "AnnualPattern": _annual_result(repeat, min_pct, min_orders),
    }).drop(*helpers)
    at = clock(orders, now)
    labelled = exceeded_cadence(new_customer_90d(recency(profile, at), at))
    return n_and_churned(likely_churned(labelled, grace=grace))


def churn_table(orders: DataFrame, **options) -> DataFrame:
    """The customer label table."""
    return churn_profile(orders, **options).select(*CHURN_COLUMNS)


# The labels that a change report compares.
REPORTED_LABELS = ["LikelyChurned", "ExceededCadence", "NewCustomerLast90Days", "OneAndDone", "TwoAndChurned"]


def label_changes(before: DataFrame, after: DataFrame, labels=tuple(REPORTED_LABELS)) -> DataFrame:
    """What became of customers between two churn tables: one row per customer who is not as
    before. ``Change`` is ``entered`` (only in ``after``), ``left`` (only in ``before``) or
    ``changed``; each label comes twice, with ``Old`` and ``New`` in front, null where the
    customer was not there. Labels are compared null-safely."""
    old = before.select(F.col("CustomerId").alias("_old"), *[F.col(c).alias(f"Old{c}") for c in labels])
    new = after.select(F.col("CustomerId").alias("_new"), *[F.col(c).alias(f"New{c}") for c in labels])
    both = old.join(new, F.col("_old") == F.col("_new"), "full_outer")
    same = F.lit(True)
    for c in labels:
        same = same & F.col(f"Old{c}").eqNullSafe(F.col(f"New{c}"))
    change = F.when(F.col("_old").isNull(), "entered").when(F.col("_new").isNull(), "left").when(~same, "changed")
    return both.withColumn("Change", change).filter(F.col("Change").isNotNull()).select(
        F.coalesce("_old", "_new").alias("CustomerId"), "Change", *[f"{side}{c}" for c in labels for side in ("Old", "New")])


def label_transitions(before: DataFrame, after: DataFrame, label: str = "LikelyChurned") -> DataFrame:
    """Customers by old and new value of one label (null: not there), all of them."""
    old = before.select(F.col("CustomerId").alias("_old"), F.col(label).alias("Old"))
    new = after.select(F.col("CustomerId").alias("_new"), F.col(label).alias("New"))
    return old.join(new, F.col("_old") == F.col("_new"), "full_outer").groupBy("Old", "New").agg(F.count("*").alias("Customers"))


def changed_rows(before: DataFrame, after: DataFrame, labels=tuple(REPORTED_LABELS)) -> DataFrame:
    """Rows of the second table that the first does not have, repeated rows one by one."""
    columns = ["CustomerId", *labels]
    return after.select(columns).exceptAll(before.select(columns))


def customer_summary(orders: DataFrame, **options) -> DataFrame:
    """Aggregates, patterns, labels and shares: one row per customer.

    Flag shares come out of the same pass as the profile; only label shares, which
    count distinct orders, need a (narrow) second one.
    """
    profile = churn_profile(orders, extra=flag_share_columns(), **options)
    return profile.join(label_shares(orders, SHARE_GROUPS), "CustomerId", "left")


def customer_summary_n(orders: DataFrame, side: str, n: int, summary: DataFrame | None = None,
                       **options) -> DataFrame:
    """Aggregates over the first or last ``n`` orders; labels and shares over all.

    ``summary`` is the stored all-orders summary, if there is one.
    """
    chosen = {"first": first_n_orders, "last": last_n_orders}[side](orders, n)
    summary = customer_summary(orders, **options) if summary is None else summary
    whole = summary.select(*CHURN_COLUMNS, *[c for c in summary.columns if c.startswith("Pct")])
    return customer_profile(chosen).join(whole, "CustomerId", "left")
