"""Queries: cleaning, order features, attribution."""

from ..operators import attribution as at, cleaning as cl, customers as cu, orders as od
from ..plans import flows
from ..sources import shop_views as views
from ..sources.tables import write_report_csv, write_tables
from . import oracle_views as v
from .entries import add

MONEY = ("OrderItemPriceTotal ShippingTotal PriceTotal RushFee ShipPrice PromoCodeDiscount Tax")
TIMES = "PlacedDateTime ShippedDateTime"

# ---------------------------------------------------------------- cleaning
add("read_tables", lambda s: s.orders, "select * from raw_order", MONEY, TIMES)
add("clean_orders", lambda s: s.clean, "select * from clean", MONEY, TIMES)
add("clean_items", lambda s: cl.clean_items(s.items), "select * from live_items", "Quantity")
add("shipped_before", lambda s: cl.shipped_before(s.orders, views.EXPORT_CUTOFF),
    "select * from raw_order where IsDeleted is distinct from 1 and AffiliateId = 2 "
    "and ShippedDateTime < timestamp '2001-03-01'", MONEY, TIMES)
RANGES = [("1997-11-01", "1998-01-01"), ("1998-11-01", "1999-01-01"), ("2000-05-01", "2000-11-01")]
add("date_windows", lambda s: cl.date_windows(s.clean, RANGES),
    "select * from clean where " + " or ".join(
        f"(ShippedDateTime >= timestamp '{a}' and ShippedDateTime < timestamp '{b}')" for a, b in RANGES),
    MONEY, TIMES)
add("coerce_ids",
    lambda s: cl.coerce_ids(s.raw("raw_order_and_analytics"), to_number=["OrderNumber"]),
    "select try_cast(OrderNumber as bigint) as OrderNumber, medium, source, AdwordsCampaignId from raw_analytics")


def _written(s):
    folder = s.scratch()
    paths = write_tables({"order_feature_table": s.features}, folder)
    return s.spark.read.parquet(paths["order_feature_table"])


FEATURE_FLOATS = MONEY + " AvgItemQuantity ShipDelayHours RushFeeAndShipPrice"
add("write_tables", _written, "select * from feat", FEATURE_FLOATS, TIMES)


def _report_csv(s):
    path = write_report_csv(od_frequency(s), f"{s.scratch()}/order_frequency.csv")
    return s.spark.read.option("header", True).schema("OrdersPlaced bigint, Customers bigint").csv(path)


def od_frequency(s):
    from ..operators.reports import order_frequency

    return order_frequency(s.clean)


FREQUENCY = ("select n as OrdersPlaced, count(*) as Customers from "
             "(select CustomerId, count(*) as n from clean group by CustomerId) group by n")
add("write_report_csv", _report_csv, FREQUENCY)
add("order_frequency", od_frequency, FREQUENCY)
add("mask_filter",
    lambda s: cl.mask_filter(cu.customer_pct(s.features), {"PctOrdersWithLabel": 1.0}).select(
        "CustomerId", "PctOrdersWithLabel", "PctOrdersWithSticker"),
    "select CustomerId, PctOrdersWithLabel, PctOrdersWithSticker from pct where PctOrdersWithLabel = 1",
    "PctOrdersWithLabel PctOrdersWithSticker")
add("since_cutoff",
    lambda s: cl.since_cutoff(cu.customer_aggregates(s.features), views.FIRST_ORDER_CUTOFF).select(
        "CustomerId", "TotalOrders", "FirstOrderDate"),
    "select CustomerId, TotalOrders, FirstOrderDate from prof where FirstOrderDate >= timestamp '1999-01-01'",
    t="FirstOrderDate")
add("sample_n", lambda s: cl.sample_n(s.clean, 500, "OrderNumber", 42).select("OrderNumber", "CustomerId"),
    "select OrderNumber, CustomerId from clean order by md5(cast(OrderNumber as varchar) || ':42'), OrderNumber limit 500")

# ---------------------------------------------------------------- order features
add("product_flags", lambda s: od.product_flags(s.products, views.PRODUCT_WORDS), "select * from prod_flags")
add("items_with_product",
    lambda s: od.items_with_product(cl.clean_items(s.items), od.product_flags(s.products, views.PRODUCT_WORDS)),
    "select * from items_flagged", "Quantity")
add("order_item_rollup", lambda s: s.rollup, "select * from rollup", "AvgItemQuantity")
add("orders_with_rollup", lambda s: od.orders_with_rollup(s.clean, s.rollup), "select * from with_rollup",
    MONEY + " AvgItemQuantity", TIMES)
add("calendar_parts",
    lambda s: od.calendar_parts(s.clean).select("OrderNumber", "HourOfDay", "DayOfWeek", "Month", "DayOfMonth"),
    f"select OrderNumber, {v.CALENDAR} from clean")
add("ship_delay_hours", lambda s: od.ship_delay_hours(s.clean).select("OrderNumber", "ShipDelayHours"),
    f"select OrderNumber, {v.DELAY} as ShipDelayHours from clean", "ShipDelayHours")
add("promo_fill", lambda s: od.promo_fill(s.clean).select("OrderNumber", "PromoCodeDiscount"),
    "select OrderNumber, coalesce(PromoCodeDiscount, 0) as PromoCodeDiscount from clean", "PromoCodeDiscount")
add("shipping_type", lambda s: od.shipping_type(s.clean).select("OrderNumber", "ShippingType"),
    f"select OrderNumber, {v.SHIP} as ShippingType from clean")
add("shipping_type_uncategorized",
    lambda s: od.shipping_type_uncategorized(s.first_values).select("CustomerId", "OrderNumber", "ShippingType"),
    f"select CustomerId, OrderNumber, {v.SHIP_UNCATEGORIZED} as ShippingType from first_values")
add("shipping_binary",
    lambda s: od.shipping_simple(od.shipping_type(s.clean)).select("OrderNumber", "ShippingSimple").join(
        od.shipping_binary(s.clean).select("OrderNumber", "ShippingType"), "OrderNumber"),
    f"""select OrderNumber, case when {v.SHIP} = 'NormalShipping' then 'Normal' else 'Other' end as ShippingSimple,
    case when OrderItemPriceTotal < 75 and ShippingTotal = 0 then 'NormalShipping' else 'OtherShipping' end as ShippingType from clean""")
add("hour_category", lambda s: od.hour_category(s.clean).select("OrderNumber", "HourCategory"),
    f"select OrderNumber, {v.HOURCAT} as HourCategory from clean")
add("work_flags", lambda s: od.work_flags(s.clean).select("OrderNumber", "WorkHours", "Workday"),
    f"select OrderNumber, {v.WORK} from clean")
add("month_edge_flags", lambda s: od.month_edge_flags(s.clean).select("OrderNumber", "FirstWeek", "LastWeek"),
    f"select OrderNumber, {v.EDGE} from clean")
add("season_flags",
    lambda s: od.season_flags(s.clean).select(
        "OrderNumber", "Holiday", "Summer", "ElectionSeason", "PresidentialElection"),
    f"select OrderNumber, {v.SEASON} from clean")
add("fee_total", lambda s: od.fee_total(s.clean).select("OrderNumber", "RushFeeAndShipPrice"),
    "select OrderNumber, RushFee + ShipPrice as RushFeeAndShipPrice from clean", "RushFeeAndShipPrice")
add("order_features", lambda s: s.features, "select * from feat", FEATURE_FLOATS, TIMES)

# ---------------------------------------------------------------- attribution
add("one_hot_medium_source", lambda s: at.one_hot_medium_source(s.raw("raw_order_and_analytics")),
    "select * from one_hot")
add("join_campaigns",
    lambda s: at.join_campaigns(at.one_hot_medium_source(s.raw("raw_order_and_analytics")), s.raw("raw_ad_campaigns")),
    "select * from with_campaign")
add("order_attribution", lambda s: s.attribution, "select * from attr")
ATTACHED = ", ".join(v.INDICATORS + v.ADS)
add("attach_attribution",
    lambda s: at.attach_attribution(s.clean, s.attribution).select(
        "OrderNumber", "CustomerId", *v.INDICATORS, *v.ADS),
    f"select c.OrderNumber, CustomerId, {ATTACHED} from clean c left join attr a on a.OrderNumber = c.OrderNumber")
add("attach_attribution_max",
    lambda s: at.attach_attribution(s.clean, s.attribution, "max").select(
        "OrderNumber", "CustomerId", *v.INDICATORS, *v.ADS),
    f"select OrderNumber, CustomerId, {ATTACHED} from clean left join (select OrderNumber, "
    + ", ".join(f"max({c}) as {c}" for c in v.INDICATORS + v.ADS)
    + " from attr where OrderNumber is not null group by OrderNumber) using (OrderNumber)")
PCT_FLAGS = ["WorkHours", "Workday", "OrderContainsSticker", "OrderContainsLabel", "OrderContainsPouch"]
add("customer_attribution_pct",
    lambda s: at.customer_attribution_pct(at.attach_attribution(s.features, s.attribution)),
    "select CustomerId, " + ", ".join(f"avg({c}::int) as Pct{c}" for c in PCT_FLAGS + v.ADS + v.INDICATORS)
    + " from feat left join attr using (OrderNumber) group by CustomerId",
    " ".join(f"Pct{c}" for c in PCT_FLAGS + v.ADS + v.INDICATORS))
_SHARES = [f"Pct{c}" for c in v.ADS + v.INDICATORS]


def _summary_attribution(mode):
    return lambda s: flows.customer_summary_attribution(s.stored_summary, s.stored, s.attribution, mode).select(
        "CustomerId", "TotalOrders", "LifetimeValue", "LikelyChurned", *_SHARES)


def _summary_attribution_sql(attributed):
    return ("select CustomerId, TotalOrders, LifetimeValue, LikelyChurned, " + ", ".join(_SHARES) + " from summary left join (select CustomerId, "
            + ", ".join(f"avg({c}::int) as Pct{c}" for c in v.ADS + v.INDICATORS)
            + f" from feat left join ({attributed}) a using (OrderNumber) group by CustomerId) using (CustomerId)")


add("customer_summary_attribution", _summary_attribution("fanout"), _summary_attribution_sql("select * from attr"),
    " ".join(["LifetimeValue", *_SHARES]))
add("customer_summary_attribution_max", _summary_attribution("max"), _summary_attribution_sql(
    "select OrderNumber, " + ", ".join(f"max({c}) as {c}" for c in v.INDICATORS + v.ADS)
    + " from attr where OrderNumber is not null group by OrderNumber"), " ".join(["LifetimeValue", *_SHARES]))
add("collapse_sessions", lambda s: at.collapse_sessions(s.raw("bigquery_events")), "select * from sess")
add("collapse_sessions_strict", lambda s: at.collapse_sessions_strict(s.raw("bigquery_events")),
    "select * from sess_strict")


def _order_sessions(s):
    return at.first_order_sessions(s.first_values, at.collapse_sessions(s.raw("bigquery_events"))).select(
        "CustomerId", "OrderNumber", *v.ATTRS)


def _labelled_sessions(s):
    masked = cl.mask_filter(s.first_summary, {"PctOrdersWithSticker": 1.0})
    return at.sessions_with_label(_order_sessions(s), masked)


JOINED = f"""select CustomerId, OrderNumber, {', '.join(v.ATTRS)} from first_values
  left join sess on cast(OrderNumber as varchar) = param_transaction_id"""
LABELLED = f"""select m.CustomerId, OrderNumber, {', '.join(v.ATTRS)}, m.OneAndDone::int as OneAndDone
  from first_summary m left join ({JOINED}) j on j.CustomerId = m.CustomerId where m.PctOrdersWithSticker = 1"""
add("first_order_sessions", _order_sessions, JOINED)
add("sessions_with_label", _labelled_sessions, LABELLED)
add("semi_filter_events", lambda s: at.semi_filter_events(s.raw("bigquery_events"), s.first_values),
    "select * from web_events where param_transaction_id in (select cast(OrderNumber as varchar) from first_values)")
add("churn_crosstab",
    lambda s: at.churn_crosstab(_labelled_sessions(s), min_n=views.CROSSTAB_MIN),
    "select *, Value || chr(10) || '(n=' || N || ')' as Label from (" + " union all ".join(
        f"select '{a}' as Attribute, {a} as Value, count(*) as N, 1 - avg(OneAndDone) as ShareRetained, "
        f"avg(OneAndDone) as ShareChurned from ({LABELLED}) where {a} is not null group by {a} having count(*) >= 20"
        for a in v.ATTRS) + ")", "ShareRetained ShareChurned")
