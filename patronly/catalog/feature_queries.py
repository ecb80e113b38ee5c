"""Queries: feature preparation, metrics and the anonymised export."""

from pyspark.sql import functions as F

from ..operators import features as fe, metrics as me, privacy as pv
from ..plans.flows import PCA_EXCLUDE
from ..sources import shop_views as views
from . import oracle_views as v
from .entries import add

NUM = ["TotalOrders", "AvgOrderValue", "AvgPromoDiscount"]
ALL = [*NUM, "PctNormalShipping"]


def u(key: str, seed) -> str:
    """The key-hash uniform number in SQL."""
    return f"(cast('0x' || substr(md5(cast({key} as varchar) || ':{seed}'), 1, 8) as bigint) / 4294967296.0)"


# ---------------------------------------------------------------- transforms
add("clip",
    lambda s: fe.clip(s.summary, {"DaysSinceLastOrder": (None, 90), "StdDaysBetweenOrders": (10.0, 90.0)}).select(
        "CustomerId", "DaysSinceLastOrder", "StdDaysBetweenOrders"),
    """select CustomerId, case when DaysSinceLastOrder > 90 then 90 else DaysSinceLastOrder end as DaysSinceLastOrder,
      case when StdDaysBetweenOrders > 90 then 90 when StdDaysBetweenOrders < 10 then 10 else StdDaysBetweenOrders end as StdDaysBetweenOrders
    from summary""", "StdDaysBetweenOrders")
add("abs_discount", lambda s: fe.abs_discount(s.summary).select("CustomerId", "AvgPromoDiscount"),
    "select CustomerId, abs(AvgPromoDiscount) as AvgPromoDiscount from summary", "AvgPromoDiscount")
add("has_promo", lambda s: fe.has_promo(s.summary).select("CustomerId", "HasPromoDiscount"),
    "select CustomerId, coalesce(AvgPromoDiscount < 0, false) as HasPromoDiscount from summary")
add("log1p_features", lambda s: fe.log1p_features(s.cluster_table, NUM[1:]).select("CustomerId", *NUM[1:]),
    "select CustomerId, ln(1 + AvgOrderValue) as AvgOrderValue, ln(1 + AvgPromoDiscount) as AvgPromoDiscount from cluster_data",
    "AvgOrderValue AvgPromoDiscount")
FULL = " and ".join(f"{c} is not null" for c in ALL)
add("drop_incomplete", lambda s: fe.drop_incomplete(s.cluster_table, ["PctNormalShipping", "AvgPromoDiscount"], True),
    "select * from cluster_data where PctNormalShipping is not null and AvgPromoDiscount is not null "
    "and (PctNormalShipping > 0 or AvgPromoDiscount > 0)", "AvgOrderValue AvgPromoDiscount PctNormalShipping")
add("standard_scale", lambda s: fe.standard_scale(s.cluster_table, NUM).select("CustomerId", *NUM),
    "select CustomerId, " + ", ".join(f"({c} - avg({c}) over ()) / stddev_pop({c}) over () as {c}" for c in NUM)
    + " from cluster_data", " ".join(NUM))


def iqr(c):
    q = lambda p: f"(select quantile_cont({c}, {p}) from cluster_data)"
    return (f"({c} - {q(0.5)}) / case when {q(0.75)} - {q(0.25)} = 0 then 1 else {q(0.75)} - {q(0.25)} end as {c}")


add("robust_scale", lambda s: fe.robust_scale(s.cluster_table, ALL).select("CustomerId", *ALL),
    "select CustomerId, " + ", ".join(map(iqr, ALL)) + " from cluster_data", " ".join(ALL))
add("minmax_scale", lambda s: fe.minmax_scale(s.cluster_table, NUM).select("CustomerId", *NUM),
    "select CustomerId, " + ", ".join(
        f"({c} - min({c}) over ()) / case when max({c}) over () = min({c}) over () then 1.0 else (max({c}) over () - min({c}) over ())::double end as {c}"
        for c in NUM) + " from cluster_data", " ".join(NUM))
add("one_hot_drop_first", lambda s: fe.one_hot_drop_first(s.features, ["ShippingType"]).select(
        "OrderNumber", "ShippingType_NormalShipping", "ShippingType_TwoDayShipping", "ShippingType_UnknownShipping"),
    "select OrderNumber, " + ", ".join(f"cast(ShippingType = '{c}' as int) as ShippingType_{c}" for c in [
        "NormalShipping", "TwoDayShipping", "UnknownShipping"]) + " from feat")
add("label_encode",
    lambda s: fe.label_encode(s.features.select("OrderNumber", "ShippingType", "WorkHours"), ["ShippingType", "WorkHours"]),
    "select OrderNumber, cast(dense_rank() over (order by ShippingType) - 1 as int) as ShippingType, "
    "cast(WorkHours as int) as WorkHours from feat")
add("coerce_types",
    lambda s: fe.coerce_types(s.clean.select("OrderNumber", "PaymentMethod", "NoPromotionalDesignUse")),
    """select OrderNumber, cast(case PaymentMethod when 'card' then 0 when 'invoice' then 1 when 'paypal' then 2 else -1 end as int) as PaymentMethod,
      cast(coalesce(NoPromotionalDesignUse, true) as int) as NoPromotionalDesignUse from clean""")
KINDS = ["NormalShipping", "TwoDayShipping", "ExpeditedShipping", "UncategorizedShipping"]
add("fixed_category_codes",
    lambda s: fe.fixed_category_codes(fe.fixed_category_codes(
        s.timed.select("OrderNumber", "ShippingType", F.initcap(F.col("WorkHours").cast("string")).alias("WorkHours")),
        "ShippingType", KINDS, KINDS[3]), "WorkHours", [], ""),
    """select OrderNumber, cast(case ShippingType when 'NormalShipping' then 0 when 'TwoDayShipping' then 1
      when 'ExpeditedShipping' then 2 else 3 end as int) as ShippingType, cast(WorkHours as int) as WorkHours from feat""")
add("stratified_split",
    lambda s: fe.stratified_split(s.cluster_table, "LikelyChurned").select("CustomerId", "LikelyChurned", "IsTest"),
    f"""select CustomerId, LikelyChurned, u < cut as IsTest from (select *, {u('CustomerId', 42)} as u from cluster_data)
    join (select LikelyChurned, quantile_cont({u('CustomerId', 42)}, 0.2) as cut from cluster_data group by 1) using (LikelyChurned)""")
add("random_split", lambda s: fe.random_split(s.cluster_table).select("CustomerId", "IsTest"),
    f"select CustomerId, {u('CustomerId', 42)} < 0.2 as IsTest from cluster_data")
# From the meaning: each class has n rows, its folds differ by at most one row.
add("stratified_folds", lambda s: fe.stratified_folds(s.cluster_table, "LikelyChurned").groupBy("LikelyChurned", "Fold").agg(
        F.count("*").alias("n")).groupBy("LikelyChurned").agg(
            F.sum("n").alias("rows"), F.count("*").cast("long").alias("folds"), (F.max("n") - F.min("n") <= 1).alias("even")),
    """select LikelyChurned, count(*)::bigint as rows, least(5, count(*))::bigint as folds, true as even
    from cluster_data group by LikelyChurned""")
add("class_weights",
    lambda s: fe.class_weights(s.cluster_table, "LikelyChurned").select("CustomerId", F.col("Weight").alias("PositiveWeight")).join(
        fe.class_weights(s.cluster_table, "LikelyChurned", "balanced").select("CustomerId", F.col("Weight").alias("BalancedWeight")), "CustomerId"),
    """select CustomerId, case when LikelyChurned then neg / pos::double else 1.0 end::double as PositiveWeight,
      case when LikelyChurned then n / (2.0 * pos) else n / (2.0 * neg) end::double as BalancedWeight
    from cluster_data cross join (select count(*) as n, count(*) filter (LikelyChurned) as pos, count(*) filter (not LikelyChurned) as neg from cluster_data)""",
    "PositiveWeight BalancedWeight")
add("percentile_inliers", lambda s: fe.percentile_inliers(s.cluster_table, "AvgPromoDiscount").select("CustomerId", "AvgPromoDiscount"),
    "select CustomerId, AvgPromoDiscount from cluster_data where AvgPromoDiscount between "
    "(select quantile_cont(AvgPromoDiscount, 0.01) from cluster_data) and (select quantile_cont(AvgPromoDiscount, 0.99) from cluster_data)",
    "AvgPromoDiscount")
PCA_NAMES = ["TotalOrders", "AvgOrderItemTotal", "AvgPriceTotal", "AvgItemsPerOrder", "AvgPromoDiscount",
             "AvgQuantity", "AvgRushFee", "AvgShipPrice", "StdDaysBetweenOrders", "ModeHour", "ModeDayOfWeek",
             "ModeMonth", "DaysSinceLastOrder", "AvgOrderValue", "AvgDiscount", "LifetimeValue",
             "PctTwoDayShipping", "PctExpeditedShipping", *v.PCT_COLUMNS[3:]]
NAMED = "select *, AvgPriceTotal as AvgOrderValue, AvgPromoDiscount as AvgDiscount from summary"
add("numeric_features", lambda s: fe.numeric_features(s.summary, PCA_EXCLUDE),
    f"select CustomerId, {', '.join(PCA_NAMES)} from ({NAMED}) where "
    + " and ".join(f"{c} is not null" for c in PCA_NAMES),
    " ".join(c for c in PCA_NAMES if c not in {"TotalOrders", "ModeHour", "ModeDayOfWeek", "ModeMonth", "DaysSinceLastOrder"}))
add("fill_zero",
    lambda s: fe.fill_zero(s.summary.select("CustomerId", "MeanDaysBetweenOrders", "PctOrdersWithPouch"),
                           ["MeanDaysBetweenOrders", "PctOrdersWithPouch"]),
    "select CustomerId, coalesce(MeanDaysBetweenOrders, 0) as MeanDaysBetweenOrders, coalesce(PctOrdersWithPouch, 0) as PctOrdersWithPouch from summary",
    "MeanDaysBetweenOrders PctOrdersWithPouch")


def _sample_only(s):
    from ..operators.orders import sample_only_orders
    from ..operators.cleaning import clean_items

    orders = sample_only_orders(clean_items(s.items), s.products, views.SAMPLE_WORD)
    return fe.first_order_sample_only(s.first_values, orders)


v.BLOCKS["sample_only"] = """select CustomerId, coalesce(SampleOnly, false)::int as FirstOrderSampleOnly from first_values
  left join (select OrderNumber, bool_and(coalesce(Name ilike '%old%', false)) as SampleOnly
    from live_items left join raw_product on Id = ProductProductOptionId group by OrderNumber) using (OrderNumber)"""
add("first_order_sample_only", _sample_only,
    "select CustomerId, FirstOrderSampleOnly::boolean as FirstOrderSampleOnly from sample_only")
add("predict_dataset", lambda s: fe.predict_dataset("LikelyChurned", s.stored_summary, _sample_only(s)),
    """select CustomerId, LikelyChurned::int as LikelyChurned, TotalOrders, AvgOrderItemTotal, AvgPromoDiscount, PctNormalShipping,
      FirstOrderSampleOnly from summary join sample_only using (CustomerId)
    where TotalOrders >= 2 and AvgOrderItemTotal is not null and AvgPromoDiscount is not null and PctNormalShipping is not null""",
    "AvgOrderItemTotal AvgPromoDiscount PctNormalShipping")


def _last_one(s):
    from ..operators.churn import customer_summary_n

    return customer_summary_n(s.stored, "last", 1)


add("predict_dataset_one_and_done", lambda s: fe.predict_dataset("OneAndDone", _last_one(s)),
    """select CustomerId, OneAndDone::int as OneAndDone, PctHoliday, OrderItemPriceTotal, PromoCodeDiscount as TotalDiscount,
      PctWorkHours, PctSummer, PctPresidentialElection, PctNormalShipping
    from last_two join (select CustomerId, OneAndDone from churned) using (CustomerId) join pct using (CustomerId)
    where OrderNumber in (select arg_max(OrderNumber, (PlacedDateTime, OrderNumber)) from feat group by CustomerId)
      and OrderItemPriceTotal is not null and PctNormalShipping is not null""",
    "PctHoliday OrderItemPriceTotal TotalDiscount PctWorkHours PctSummer PctPresidentialElection PctNormalShipping")


def _first_two(s):
    from ..operators.churn import customer_summary_n

    return customer_summary_n(s.stored, "first", 2)


v.BLOCKS["first_two"] = """select CustomerId, avg(OrderItemPriceTotal) as AvgOrderItemTotal, avg(PromoCodeDiscount) as AvgPromoDiscount
  from (select *, row_number() over (partition by CustomerId order by PlacedDateTime, OrderNumber) as r from feat) where r <= 2 group by CustomerId"""
add("predict_dataset_two_and_churned",
    lambda s: fe.predict_dataset("TwoAndChurned", _first_two(s), _sample_only(s)),
    """select CustomerId, TwoAndChurned::int as TwoAndChurned, AvgOrderItemTotal, AvgPromoDiscount, PctHoliday, PctNormalShipping, FirstOrderSampleOnly
    from first_two join (select CustomerId, TwoAndChurned from churned) using (CustomerId) join pct using (CustomerId)
      join sample_only using (CustomerId)
    where AvgOrderItemTotal is not null and PctNormalShipping is not null""",
    "AvgOrderItemTotal AvgPromoDiscount PctHoliday PctNormalShipping")

# ---------------------------------------------------------------- metrics
v.BLOCKS["scored"] = f"select cast(quality as int) as label, floor({u('doc_id', 7)} * 100) / 100 as score from labels"
v.BLOCKS["predicted"] = "select *, cast(score > 0.45 as int) as prediction from scored"


def _predicted(s):
    return me.threshold_predict(s.scored)


add("threshold_predict", _predicted, "select * from predicted", "score")
add("confusion_matrix", lambda s: me.confusion_matrix(_predicted(s)),
    """select cast(a as int) as actual, cast(p as int) as predicted, (select count(*) from predicted where label = a and prediction = p) as n
    from (values (0, 0), (0, 1), (1, 0), (1, 1)) c(a, p)""")
v.BLOCKS["per_class"] = """select k, hit / nullif(said, 0)::double as p, hit / nullif(truth, 0)::double as r, truth from (
  select k, (select count(*) from predicted where label = k and prediction = k) as hit,
    (select count(*) from predicted where prediction = k) as said, (select count(*) from predicted where label = k) as truth
  from (values (0), (1)) c(k))"""
v.BLOCKS["per_class_f"] = """select k, coalesce(p, 0) as p, coalesce(r, 0) as r,
  coalesce(2 * p * r / nullif(p + r, 0), 0) as f, truth from per_class"""
add("classification_report", lambda s: me.classification_report(_predicted(s)),
    """select cast(k as varchar) as class, p as precision, r as recall, f as f1, truth as support from per_class_f
    union all select 'accuracy', a, a, a, n from (select avg((label = prediction)::int) as a, count(*) as n from predicted)
    union all select 'macro avg', avg(p), avg(r), avg(f), sum(truth)::bigint from per_class_f
    union all select 'weighted avg', sum(p * truth) / sum(truth), sum(r * truth) / sum(truth), sum(f * truth) / sum(truth), sum(truth)::bigint from per_class_f""",
    "precision recall f1")
add("roc_auc", lambda s: me.roc_auc(s.scored),
    """select (sum(rk) filter (label = 1) - pos * (pos + 1) / 2.0) / (pos * neg) as auc from (
      select label, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rk,
        count(*) filter (label = 1) over () as pos, count(*) filter (label = 0) over () as neg from scored) group by pos, neg""", "auc")
add("pr_curve", lambda s: me.pr_curve(s.scored),
    """select t as threshold, count(*) filter (label = 1)::double / count(*) as precision,
      count(*) filter (label = 1)::double / (select count(*) from scored where label = 1) as recall
    from (select distinct score as t from scored) join scored on score >= t group by t""", "threshold precision recall")

# ---------------------------------------------------------------- export
SALT = "test-salt"


def draw(name, key="OrderNumber"):
    return (f"(cast('0x' || substr(md5(cast({key} as varchar) || ':42/{name}:42'), 1, 8) as bigint) / 4294967296.0)")


def days(column="PlacedDateTime"):
    return f"{column} - to_days(cast(floor({draw(column)} * 15) as int)) as {column}"


def amount(c):
    return f"{c} * (0.9::double + 0.2::double * {draw(c)}) as {c}"


def obfuscated(c, values):
    listed = "[" + ", ".join(values) + "]"
    return (f"case when {draw(c)} < 0.15 then {listed}[cast(floor({draw(c + '/value')} * {len(values)}) as int) + 1] else {c} end as {c}")


METHODS, USES = ["'card'", "'invoice'", "'paypal'"], ["false", "true"]
hashed = lambda c: f"sha256('{SALT}_' || cast({c} as varchar)) as {c}Hash"
add("salted_hash", lambda s: pv.salted_hash(s.clean, "PaymentMethod", SALT).select("OrderNumber", "PaymentMethodHash"),
    f"select OrderNumber, {hashed('PaymentMethod')} from clean")
add("jitter_days", lambda s: pv.jitter_days(s.clean).select("OrderNumber", "PlacedDateTime"),
    f"select OrderNumber, {days()} from clean", t="PlacedDateTime")
add("jitter_amount", lambda s: pv.jitter_amount(s.clean).select("OrderNumber", *pv.AMOUNTS),
    f"select OrderNumber, {', '.join(amount(c) for c in pv.AMOUNTS)} from clean", " ".join(pv.AMOUNTS))
add("obfuscate_category",
    lambda s: pv.obfuscate_category(pv.obfuscate_category(s.clean, "PaymentMethod"), "NoPromotionalDesignUse").select(
        "OrderNumber", *pv.CATEGORIES),
    f"select OrderNumber, {obfuscated('PaymentMethod', METHODS)}, {obfuscated('NoPromotionalDesignUse', USES)} from clean")
add("id_reference",
    lambda s: pv.id_reference(pv.salted_hash(pv.salted_hash(s.clean, "OrderNumber", SALT), "CustomerId", SALT)),
    f"select OrderNumber, CustomerId, {hashed('OrderNumber')}, {hashed('CustomerId')} from clean")
SAMPLED = """select * from {0} where CustomerId in (select CustomerId from (select distinct CustomerId from {0})
  order by md5(cast(CustomerId as varchar) || ':42'), CustomerId limit 200)"""
add("sample_customers", lambda s: pv.sample_customers(s.clean, views.EXPORT_CUSTOMERS).select("OrderNumber", "CustomerId"),
    f"select OrderNumber, CustomerId from ({SAMPLED.format('clean')})")
add("drop_top_customer", lambda s: pv.drop_top_customer(s.clean).select("OrderNumber", "CustomerId"),
    """select OrderNumber, CustomerId from clean where CustomerId <> (
      select CustomerId from clean group by CustomerId order by count(*) desc, CustomerId limit 1)""")
v.BLOCKS["exportable"] = """select * from raw_order where IsDeleted is distinct from 1 and AffiliateId = 2
  and ShippedDateTime < timestamp '2001-03-01'"""
v.BLOCKS["export_sample"] = SAMPLED.format("exportable")
add("export_orders",
    lambda s: pv.export_orders(s.orders, s.items, views.EXPORT_CUTOFF, SALT, views.EXPORT_CUSTOMERS),
    f"""select {days()}, {', '.join(amount(c) for c in pv.AMOUNTS)}, {obfuscated('PaymentMethod', METHODS)},
      {obfuscated('NoPromotionalDesignUse', USES)}, {hashed('OrderNumber')}, {hashed('CustomerId')}, TotalOrderItems
    from export_sample left join (select OrderNumber, count(*) as TotalOrderItems from live_items group by OrderNumber) using (OrderNumber)""",
    " ".join(pv.AMOUNTS), "PlacedDateTime")
