"""Queries: joins along time, windows, sketches, changes between dates."""

from pyspark.sql import functions as F

from ..operators import churn as ch, reports as rp, sketches as sk, timelines as tl
from ..session import materialize
from ..streaming import windows as sw
from . import oracle_views as v
from .entries import add
from .model_queries import streamed

ATTRIBUTES = ["traffic_source_medium", "device_operating_system"]


def _placed(s):
    return s.clean.select("CustomerId", "OrderNumber", "PlacedDateTime", "OrderItemPriceTotal")


def _last_visits(s, within=None):
    return tl.last_before(_placed(s), s.raw("web_visits"), "CustomerId", "PlacedDateTime", "VisitedAt", [*ATTRIBUTES, "VisitId"],
                          "VisitId", within)


_ASOF = """select c.CustomerId, c.OrderNumber, c.PlacedDateTime, c.OrderItemPriceTotal, w.VisitedAt, w.traffic_source_medium,
  w.device_operating_system, w.VisitId
from clean c asof left join web_visits w on c.CustomerId = w.CustomerId and c.PlacedDateTime >= w.VisitedAt"""
_RECENT = "VisitedAt >= PlacedDateTime - interval 30 day"
add("order_last_visit", _last_visits, _ASOF, "OrderItemPriceTotal", "PlacedDateTime VisitedAt")
add("order_last_visit_recent", lambda s: _last_visits(s, "30 days"),
    "select * replace (" + ", ".join(f"case when {_RECENT} then {c} end as {c}" for c in ["VisitedAt", *ATTRIBUTES, "VisitId"])
    + f") from ({_ASOF})", "OrderItemPriceTotal", "PlacedDateTime VisitedAt")


def _attributed(s):
    from ..operators import attribution as at

    sessions = at.collapse_sessions(s.raw("bigquery_events"), attributes=ATTRIBUTES)
    return tl.attributed_orders(_placed(s), sessions, s.raw("web_visits"), ATTRIBUTES)


add("attributed_orders", _attributed, f"""
select CustomerId, OrderNumber, PlacedDateTime, OrderItemPriceTotal,
  case when t.param_transaction_id is not null then 'transaction' when {_RECENT} then 'visit' else 'none' end as AttributedBy,
  {', '.join(f"case when t.param_transaction_id is not null then t.{a} when {_RECENT} then o.{a} end as {a}" for a in ATTRIBUTES)}
from ({_ASOF}) o left join sess t on cast(OrderNumber as varchar) = t.param_transaction_id""", "OrderItemPriceTotal", "PlacedDateTime")

# ---------------------------------------------------------------- windows
_INSIDE = "join promotions on PlacedDateTime between StartsAt and EndsAt"
add("orders_in_promotions", lambda s: tl.in_windows(
        _placed(s).select("OrderNumber", "PlacedDateTime"), s.raw("promotions"), "PlacedDateTime", "StartsAt", "EndsAt"),
    f"select OrderNumber, PlacedDateTime, PromotionId, StartsAt, EndsAt from clean {_INSIDE}", "", "PlacedDateTime StartsAt EndsAt")
add("promotion_totals", lambda s: tl.window_totals(
        _placed(s), s.raw("promotions"), "PlacedDateTime", "StartsAt", "EndsAt", "PromotionId", "OrderItemPriceTotal"),
    """select p.*, count(OrderNumber) as Rows, coalesce(sum(OrderItemPriceTotal), 0) as Amount from promotions p
    left join clean on PlacedDateTime between StartsAt and EndsAt group by all""", "Amount", "StartsAt EndsAt")

# ---------------------------------------------------------------- visits
PAUSE_HOURS = 6
_MARKED = f"""select *, last_value(case when begins then ts end ignore nulls) over (partition by user_id order by ts, event_id
    rows between unbounded preceding and current row) as VisitStart
  from (select *, coalesce(ts > lag(ts) over (partition by user_id order by ts, event_id) + interval {PAUSE_HOURS} hour, true) as begins from events)"""


def _events(s):
    return s.star("events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "value")


add("event_visits", lambda s: tl.with_visit_start(_events(s), "user_id", "ts", "event_id", f"{PAUSE_HOURS} hours"),
    f"select event_id, user_id, ts, value, VisitStart from ({_MARKED})", "value", "ts VisitStart")
add("visits_by_pause", lambda s: tl.visits_by_pause(_events(s), "user_id", "ts", "event_id", "value", f"{PAUSE_HOURS} hours"),
    f"""select user_id, VisitStart, max(ts) as VisitEnd, count(*) as Events,
      (epoch_us(max(ts)) - epoch_us(VisitStart)) / 1000000.0 as Seconds, sum(value) as Total
    from ({_MARKED}) group by user_id, VisitStart""", "Seconds Total", "VisitStart VisitEnd")

# ---------------------------------------------------------------- windowed streams
def _window_sql(size: int, slide: int) -> str:
    return f"""select w as WindowStart, w + to_days({size}) as WindowEnd, count(*) as Orders, sum(OrderItemPriceTotal) as Revenue, min(OrderNumber) as LowestOrder
    from (select *, unnest(list_transform(range({size // slide}), lambda i:
        make_timestamp(((epoch_us(PlacedDateTime) // 86400000000 // {slide} - i) * {slide} * 86400000000)::bigint))) as w from feat)
    group by w"""


add("stream_tumbling_orders", lambda s: streamed(s, lambda o: sw.windowed_orders(o, "30 days"), keep_clock="90 days"), _window_sql(30, 30), "Revenue",
    "WindowStart WindowEnd")
add("stream_sliding_orders", lambda s: streamed(s, lambda o: sw.windowed_orders(o, "30 days", "10 days"), keep_clock="90 days"),
    _window_sql(30, 10), "Revenue", "WindowStart WindowEnd")

# ---------------------------------------------------------------- one pass over all bucket reports
_SETS = """select LeastValue, ProductType, SpendingBucket, OrderBucket, grouping_id(LeastValue, ProductType, SpendingBucket, OrderBucket)::int as Grouping,
  count(*) as Customers, sum(LifetimeValue) as Revenue, count(*) filter (LikelyChurned) as Churned, avg(LikelyChurned::int) as ShareChurned
from (select *, unnest([x for x in [0.0::double, 1000.0::double] if LifetimeValue >= x]) as LeastValue from by_product)
group by grouping sets ((LeastValue, ProductType, SpendingBucket), (LeastValue, ProductType, OrderBucket), (LeastValue, ProductType),
  (LeastValue, SpendingBucket), (LeastValue, OrderBucket), (LeastValue))"""
add("bucket_grouping_sets", lambda s: rp.bucket_grouping_sets(s.product_rows), _SETS, "LeastValue Revenue ShareChurned")

# ---------------------------------------------------------------- sketches
SPAN = ("1996-01-01", "1999-01-01")


def _sketched(s):
    stored = materialize(sk.monthly_sketches(s.stored, ["ShippingType"]))
    return sk.span_report(stored, ["ShippingType"], *SPAN)


def _check_sketches(s):
    """Estimates against exact counts and ranks: five standard errors of the customer count,
    and for a quantile the share of rows at or below it."""
    found = _sketched(s)
    rows = s.stored.filter((F.col("PlacedDateTime") >= SPAN[0]) & (F.col("PlacedDateTime") < SPAN[1]))
    exact = rows.groupBy(F.col("ShippingType").alias("_type")).agg(F.countDistinct("CustomerId").alias("exact"), F.count("*").alias("_orders"))
    near = F.abs(F.col("Customers") - F.col("exact")) <= F.greatest(F.lit(2.0), 5 * 1.04 / 2 ** (sk.LG_K / 2) * F.col("exact"))
    joined = found.join(exact, F.col("ShippingType").eqNullSafe(F.col("_type")))
    ranked = rows.alias("r").join(found.alias("f"), F.col("r.ShippingType").eqNullSafe(F.col("f.ShippingType"))).groupBy(
        F.col("f.ShippingType").alias("_of")).agg(
        *[F.avg((F.col("OrderItemPriceTotal") < F.col(f"Value_{p}")).cast("int")).alias(f"low_{p}") for p in (25, 50, 90)],
        *[F.avg((F.col("OrderItemPriceTotal") <= F.col(f"Value_{p}")).cast("int")).alias(f"high_{p}") for p in (25, 50, 90)])
    good = F.lit(True)
    for p in (25, 50, 90):
        good = good & (F.col(f"low_{p}") <= p / 100 + 0.02) & (F.col(f"high_{p}") >= p / 100 - 0.02)
    return joined.join(ranked, F.col("ShippingType").eqNullSafe(F.col("_of"))).select(
        "ShippingType", "Orders", F.col("exact").alias("ExactCustomers"), near.alias("customers_near"), good.alias("quantiles_near"))


add("sketched_customers", _sketched)
add("check_sketched_customers", _check_sketches, f"""
select ShippingType, count(*) as Orders, count(distinct CustomerId) as ExactCustomers, true as customers_near, true as quantiles_near
from feat where PlacedDateTime >= timestamp '{SPAN[0]}' and PlacedDateTime < timestamp '{SPAN[1]}' group by ShippingType""")

# ---------------------------------------------------------------- changes between two dates
EARLY = "2000-01-01"


def _two_tables(s):
    early = s.stored.filter(F.col("PlacedDateTime") < EARLY)
    return materialize(ch.churn_table(early)), materialize(ch.churn_table(s.stored))


_OLD = v.as_of("churned", EARLY, "early")
_PAIRS = ", ".join(f"o.{c} as Old{c}, n.{c} as New{c}" for c in ch.REPORTED_LABELS)
_DIFFERENT = " or ".join(f"Old{c} is distinct from New{c}" for c in ch.REPORTED_LABELS)
add("label_changes", lambda s: ch.label_changes(*_two_tables(s)), f"""
select * exclude (a, b), case when a is null then 'entered' when b is null then 'left' else 'changed' end as Change from (
  select coalesce(o.CustomerId, n.CustomerId) as CustomerId, o.CustomerId as a, n.CustomerId as b, {_PAIRS}
  from {_OLD} o full outer join churned n on o.CustomerId = n.CustomerId)
where a is null or b is null or {_DIFFERENT}""")
add("label_transitions", lambda s: ch.label_transitions(*_two_tables(s)), f"""
select o.LikelyChurned as Old, n.LikelyChurned as New, count(*) as Customers
from {_OLD} o full outer join churned n on o.CustomerId = n.CustomerId group by 1, 2""")
add("changed_label_rows", lambda s: ch.changed_rows(*_two_tables(s)),
    "select * from (select CustomerId, {0} from churned except all select CustomerId, {0} from {1})".format(", ".join(ch.REPORTED_LABELS), _OLD))

# ---------------------------------------------------------------- money
_CENTS = "round({0}::decimal(24,8), 2)::decimal(18,2)"
add("exact_revenue", lambda s: rp.exact_revenue(s.stored, ["ShippingType"]).select(  # shown as text, to the cent
        "ShippingType", "Orders", *[F.col(c).cast("string").alias(c) for c in ("Revenue", "Fees", "Total", "Average")]), f"""
select ShippingType, Orders, Revenue::varchar as Revenue, Fees::varchar as Fees, (Revenue + Fees)::decimal(28,2)::varchar as Total,
  round(case when known > 0 then Revenue::decimal(38,10) / known end::decimal(38,10), 2)::decimal(28,2)::varchar as Average
from (select ShippingType, count(*) as Orders, count(OrderItemPriceTotal) as known,
    coalesce(sum({_CENTS.format('OrderItemPriceTotal')}), 0)::decimal(28,2) as Revenue,
    coalesce(sum({_CENTS.format('RushFeeAndShipPrice')}), 0)::decimal(28,2) as Fees from feat group by ShippingType)""")
