"""Queries: customer aggregates, churn rules, early warnings."""

from ..operators import churn as ch, customers as cu, warning as wa
from . import oracle_views as v
from .entries import add

MEANS = " ".join(cu.MEANS)
GAPS = "MeanDaysBetweenOrders StdDaysBetweenOrders"
DATES = "FirstOrderDate LastOrderDate"
PCTS = " ".join(v.PCT_COLUMNS)
TIMES = "PlacedDateTime ShippedDateTime"
MONEY = "OrderItemPriceTotal ShippingTotal PriceTotal RushFee ShipPrice PromoCodeDiscount Tax"

# ---------------------------------------------------------------- ranking and aggregates
BRIEF = ["CustomerId", "OrderNumber", "PlacedDateTime", "PriceTotal"]


def ranked(direction: str) -> str:
    order = f"PlacedDateTime {direction}, OrderNumber {direction}"
    return (f"select {', '.join(BRIEF)} from (select *, row_number() over (partition by CustomerId order by {order}) as r "
            "from clean) where r <= 2")


add("first_n_orders", lambda s: cu.first_n_orders(s.clean, 2).select(*BRIEF), ranked("asc"), "PriceTotal", "PlacedDateTime")
add("last_n_orders", lambda s: cu.last_n_orders(s.clean, 2).select(*BRIEF), ranked("desc"), "PriceTotal", "PlacedDateTime")
add("first_order_values", lambda s: s.first_values, "select * from first_values", MONEY, TIMES)
add("first_shipped_order", lambda s: cu.first_shipped_order(s.features),
    f"select CustomerId, {', '.join(cu.FIRST_SHIPPED_COLUMNS)} from (select *, row_number() over "
    "(partition by CustomerId order by ShippedDateTime, OrderNumber) as r from feat) where r = 1",
    "PromoCodeDiscount AvgItemQuantity RushFeeAndShipPrice")
add("customer_aggregates", lambda s: cu.customer_aggregates(s.features), v.aggregates("feat"), MEANS, DATES)
add("order_gaps", lambda s: cu.order_gaps(s.clean), v.gaps("clean"), GAPS)
add("customer_modes", lambda s: cu.customer_modes(s.clean), v.modes("feat"))
add("label_share", lambda s: cu.label_share(s.timed, "ShippingType", cu.SHIP_LABELS),
    f"select CustomerId, {v.SHIP_SHARES} from feat group by CustomerId", " ".join(v.PCT_COLUMNS[:3]))
add("flag_share", lambda s: cu.flag_share(s.features),
    f"select CustomerId, {v.FLAG_SHARES} from feat group by CustomerId", " ".join(v.PCT_COLUMNS[7:]))
add("customer_pct", lambda s: cu.customer_pct(s.features), "select * from pct", PCTS)
add("repeat_orders", lambda s: s.repeat.select(*BRIEF), f"select {', '.join(BRIEF)} from repeaters",
    "PriceTotal", "PlacedDateTime")
add("as_of_now", lambda s: cu.as_of_now(s.clean), 'select max(PlacedDateTime) as "Now" from clean', t='"Now"')
SUMMARY_FLOATS = f"{MEANS} {GAPS} {PCTS}"
add("customer_summary", lambda s: ch.customer_summary(s.stored),
    "select * exclude (LifetimeValue) from summary", SUMMARY_FLOATS, DATES)
add("customer_summary_n", lambda s: s.first_summary, "select * from first_summary", SUMMARY_FLOATS, DATES)
add("customer_summary_last_2", lambda s: ch.customer_summary_n(s.stored, "last", 2).select(
        "CustomerId", "TotalOrders", *cu.MEANS, "FirstOrderDate", "LastOrderDate", *GAPS.split(),
        "ModeHour", "ModeDayOfWeek", "ModeMonth", "LikelyChurned", "PctHoliday"),
    "select p.*, LikelyChurned, PctHoliday from (" + v.profile("last_two") + ") p "
    "join (select CustomerId, LikelyChurned from churned) using (CustomerId) join pct using (CustomerId)",
    f"{MEANS} {GAPS} PctHoliday", DATES)
add("lifetime_value", lambda s: cu.lifetime_value(cu.customer_aggregates(s.features)).select("CustomerId", "LifetimeValue"),
    "select CustomerId, AvgPriceTotal * TotalOrders as LifetimeValue from prof", "LifetimeValue")
add("first_order_flags",
    lambda s: cu.first_order_flags(cu.customer_aggregates(s.features).select("CustomerId", "TotalOrders"),
                                   s.first_values, s.rollup),
    """select CustomerId, TotalOrders,
      case when OrderItemPriceTotal < 75 and ShippingTotal = 0 then 'NormalShipping' else 'OtherShipping' end as ShippingType,
      OrderContainsLabel as FirstOrderContainsLabel, OrderContainsSticker as FirstOrderContainsSticker,
      OrderContainsPouch as FirstOrderContainsPouch
    from prof left join first_values using (CustomerId) left join rollup using (OrderNumber)""")

# ---------------------------------------------------------------- patterns and churn
SPRING = ch.SeasonRule("SpringPattern", (3, 4, 5), min_years=3, min_gap=200, max_gap=900)
add("repeating_pattern", lambda s: ch.repeating_pattern(s.repeat, SPRING),
    v.pattern("SpringPattern", "3,4,5", 200, 900, 3))
add("holiday_pattern", lambda s: ch.holiday_pattern(s.repeat), "select * from p_holiday")
add("summer_pattern", lambda s: ch.summer_pattern(s.repeat), "select * from p_summer")
add("election_pattern", lambda s: ch.election_pattern(s.repeat), "select * from p_election")
add("presidential_pattern", lambda s: ch.presidential_pattern(s.repeat), "select * from p_president")
TWO_TERMS = ch.SeasonRule("PresidentialPattern", (8, 9, 10), min_years=2, max_gap=1600, season="PresidentialElection")
add("presidential_pattern_two_years", lambda s: ch.presidential_pattern(s.repeat, TWO_TERMS),
    v.pattern("PresidentialPattern", "8,9,10", 290, 1600, 2, "PresidentialElection"))
add("annual_pattern", lambda s: ch.annual_pattern(s.repeat), "select * from p_annual")


def _recent(s):
    return ch.recency(cu.customer_profile(s.stored), ch.clock(s.stored))


add("recency", lambda s: _recent(s).select("CustomerId", "DaysSinceLastOrder"),
    "select CustomerId, DaysSinceLastOrder from churned")
add("new_customer_90d",
    lambda s: ch.new_customer_90d(cu.customer_aggregates(s.stored), ch.clock(s.stored)).select("CustomerId", "NewCustomerLast90Days"),
    "select CustomerId, NewCustomerLast90Days from churned")
add("exceeded_cadence", lambda s: ch.exceeded_cadence(_recent(s)).select("CustomerId", "DaysSinceLastOrder", "ExceededCadence"),
    "select CustomerId, DaysSinceLastOrder, ExceededCadence from churned")
add("likely_churned", lambda s: ch.churn_profile(s.stored).select("CustomerId", "LikelyChurned"),
    "select CustomerId, LikelyChurned from churned")
add("n_and_churned",
    lambda s: ch.churn_profile(s.stored).select("CustomerId", "OneAndDone", "TwoAndChurned", "ThreeOrFewerAndChurned"),
    "select CustomerId, OneAndDone, TwoAndChurned, ThreeOrFewerAndChurned from churned")
add("churn_table", lambda s: ch.churn_table(s.stored), f"select {v.CHURN_COLUMNS} from churned")

# ---------------------------------------------------------------- early warning
W = "(partition by CustomerId order by PlacedDateTime, OrderNumber {})"
LAST2, LAST3 = W.format("rows between 1 preceding and current row"), W.format("rows between 2 preceding and current row")
BY = W.format("")
v.BLOCKS["gapped"] = f"""select *, date_sub('day', lag(PlacedDateTime) over {BY}, PlacedDateTime) as DaysSincePrevOrder from repeaters"""
v.BLOCKS["gapped_all"] = f"""select *, date_sub('day', lag(PlacedDateTime) over {BY}, PlacedDateTime) as DaysSincePrevOrder from feat"""
ROLLED = f"""select *, avg(OrderItemPriceTotal) over {LAST2} as Rolling2_AvgPrice,
  avg(RushFeeAndShipPrice) over {LAST2} as Rolling2_AvgShipping,
  avg(PromoCodeDiscount) over {LAST2} as Rolling2_AvgDiscount,
  avg(DaysSincePrevOrder) over {LAST2} as Rolling2_Gap,
  stddev_samp(OrderItemPriceTotal) over {LAST3} as RollingStd_Price,
  stddev_samp(RushFeeAndShipPrice) over {LAST3} as RollingStd_Shipping from """
v.BLOCKS["rolled"] = ROLLED + "gapped"
v.BLOCKS["rolled_all"] = ROLLED + "gapped_all"


def _z(x, m):
    return f"({x} - {m}) / case when {m} = 0 then 1 else {m} end"


DEVIATED = f"""select *, {_z('OrderItemPriceTotal', 'Rolling2_AvgPrice')} as Z_Price,
  {_z('RushFeeAndShipPrice', 'Rolling2_AvgShipping')} as Z_Shipping,
  {_z('PromoCodeDiscount', 'Rolling2_AvgDiscount')} as Z_Discount,
  {_z('DaysSincePrevOrder', 'Rolling2_Gap')} as Z_Gap from """
v.BLOCKS["deviated"] = DEVIATED + "rolled"
v.BLOCKS["deviated_all"] = DEVIATED + "rolled_all"
FLAGS = """coalesce(Z_Price < -1, false) as Flag_LowPrice, coalesce(Z_Price < 1, false) as Flag_HighPrice,
  coalesce(Z_Shipping > -1, false) as Flag_LowShipping, coalesce(Z_Shipping > 1, false) as Flag_HighShipping,
  coalesce(Z_Discount > -1, false) as Flag_LowDiscount, coalesce(Z_Discount > 1, false) as Flag_HighDiscount,
  coalesce(Z_Gap > 1, false) as Flag_SlowingCadence, coalesce(Z_Gap > -1, false) as Flag_IncreasingCadence"""
ID = ["CustomerId", "OrderNumber"]
ROLL = ["Rolling2_AvgPrice", "Rolling2_AvgShipping", "Rolling2_AvgDiscount"]
Z = list(wa.DEVIATIONS)


def pick(*columns):
    return ", ".join(columns)


add("rolling_mean", lambda s: wa.rolling_mean(s.repeat).select(*ID, *ROLL),
    f"select {pick(*ID, *ROLL)} from rolled", " ".join(ROLL))
add("prev_order_gap", lambda s: wa.prev_order_gap(s.repeat).select(*ID, "DaysSincePrevOrder", "Rolling2_Gap"),
    f"select {pick(*ID)}, DaysSincePrevOrder, Rolling2_Gap from rolled", "Rolling2_Gap")
add("rolling_std", lambda s: wa.rolling_std(s.repeat).select(*ID, *wa.ROLLING_STDS),
    f"select {pick(*ID, *wa.ROLLING_STDS)} from rolled", " ".join(wa.ROLLING_STDS))
add("relative_deviation", lambda s: wa.relative_deviation(wa.rolling_features(s.repeat)).select(*ID, *Z),
    f"select {pick(*ID, *Z)} from deviated", " ".join(Z))
add("warning_flags", lambda s: wa.order_warnings(s.repeat).select(*ID, *wa.FLAG_RULES),
    f"select {pick(*ID)}, {FLAGS} from deviated")
add("latest_warning", lambda s: wa.latest_warning(s.stored, ch.churn_profile(s.stored)),
    f"""select {pick(*ID)}, PlacedDateTime as OrderDate, {pick(*Z)}, {FLAGS}, LikelyChurned from (
      select *, row_number() over (partition by CustomerId order by PlacedDateTime desc, OrderNumber desc) as r from deviated)
    join (select CustomerId, LikelyChurned from churned) using (CustomerId) where r = 1""", " ".join(Z), "OrderDate")
