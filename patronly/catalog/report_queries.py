"""Queries: bucket reports, product splits, segments, cluster tables."""

from pyspark.sql import functions as F

from .. import constants as k
from ..operators import features as fe, reports as rp
from ..sources import shop_views as views
from . import oracle_views as v
from .entries import add

SHARES = "Pct_Customers Pct_Revenue Pct_ChurnedWithinBucket CumulativePct_Customers CumulativePct_Revenue"
VALUES = f"TotalRevenue {SHARES}"


def buckets(source: str, frame: str, keys: str, bucket: str, labels, scale: int, extra: str = "") -> str:
    """The bucket report in SQL: every (frame row, label) with totals, shares, running shares."""
    listed = ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels))
    return f"""select *, sum(Pct_Customers) over run as CumulativePct_Customers, sum(Pct_Revenue) over run as CumulativePct_Revenue
from (select *, {scale}.0 * CustomerCount / nullif(sum(CustomerCount) over (partition by {keys}), 0) as Pct_Customers,
        {scale}.0 * TotalRevenue / nullif(sum(TotalRevenue) over (partition by {keys}), 0) as Pct_Revenue,
        {scale}.0 * ChurnedCount / nullif(CustomerCount, 0) as Pct_ChurnedWithinBucket
  from (select f.*, {bucket}, cast(BucketOrder as int) as BucketOrder, coalesce(CustomerCount, 0) as CustomerCount,
          coalesce(TotalRevenue, 0) as TotalRevenue, cast(coalesce(ChurnedCount, 0) as bigint) as ChurnedCount {extra}
    from ({frame}) f cross join (select * from (values {listed}) x(BucketOrder, {bucket})) b
      left join (select {keys}, {bucket}, count(distinct CustomerId) as CustomerCount, sum(LifetimeValue) as TotalRevenue,
          sum(LikelyChurned::int) as ChurnedCount from ({source}) group by {keys}, {bucket}) using ({keys}, {bucket})))
window run as (partition by {keys} order by BucketOrder)"""


SPENT = f"select *, {v.spend_case()} as SpendingBucket from summary"
WANTED = " union all ".join(
    [f"select *, '{n}' as Orders from ({SPENT}) where TotalOrders = {n}" for n in range(1, 7)]
    + [f"select *, 'all' as Orders from ({SPENT})"])
ORDERS_FRAME = "select * from (values ('1'), ('2'), ('3'), ('4'), ('5'), ('6'), ('all')) y(Orders)"

add("cut",
    lambda s: s.summary.select(
        "CustomerId", rp.cut("LifetimeValue", k.SPENDING_EDGES, k.SPENDING_LABELS).alias("SpendingBucket"),
        rp.cut("TotalOrders", k.ORDER_EDGES, k.ORDER_LABELS).alias("OrderBucket"),
        rp.cut("AvgOrderValue", k.ORDER_VALUE_EDGES, k.ORDER_VALUE_LABELS, False).alias("ValueBin"),
        rp.cut("AvgItemsPerOrder", k.ITEM_EDGES, k.ITEM_LABELS, False).alias("ItemsBin")),
    f"""select CustomerId, {v.spend_case()} as SpendingBucket, {v.ORDER_CASE} as OrderBucket,
      case when AvgPriceTotal <= 0 then null when AvgPriceTotal <= 100 then '$0-$100' when AvgPriceTotal <= 500 then '$100-$500'
        when AvgPriceTotal <= 1000 then '$500-$1,000' when AvgPriceTotal <= 5000 then '$1,000-$5,000' when AvgPriceTotal > 5000 then '5,000+' end as ValueBin,
      case when AvgItemsPerOrder <= 0 then null when AvgItemsPerOrder <= 0.5 then '0–0.5' when AvgItemsPerOrder <= 1 then '0.5–1'
        when AvgItemsPerOrder <= 2 then '1–2' when AvgItemsPerOrder <= 3 then '2–3' when AvgItemsPerOrder <= 5 then '3–5'
        when AvgItemsPerOrder <= 10 then '5–10' when AvgItemsPerOrder > 10 then '10+' end as ItemsBin from summary""")
add("revenue_bucket_summary", lambda s: rp.revenue_bucket_summaries(s.summary),
    buckets(WANTED, ORDERS_FRAME, "Orders", "SpendingBucket", v.SPEND_LABELS, 100), VALUES)
RICH = f"select *, 1 as one, {v.ORDER_CASE} as OrderBucket from summary where LifetimeValue >= 1000"
add("order_bucket_summary", lambda s: rp.order_bucket_summary(s.summary),
    "select * exclude (one) from (" + buckets(RICH, "select 1 as one", "one", "OrderBucket", v.ORDER_LABELS, 100) + ")",
    VALUES)
add("product_type_rows",
    lambda s: rp.product_type_rows(s.summary).select("CustomerId", "ProductType", "TotalOrders", "LifetimeValue"),
    "select CustomerId, ProductType, TotalOrders, LifetimeValue from by_product", "LifetimeValue")

ACTIVE = """select distinct CustomerId, month(ShippedDateTime) as m from feat
  where year(ShippedDateTime) = 2001 and month(ShippedDateTime) <= 6"""


def activity(members: str, bucket: str, own_months: bool) -> str:
    months = ("(select count(distinct m) from pairs p where p.ProductType = pairs.ProductType)" if own_months
              else "(select count(distinct m) from pairs)")
    return f"""with pairs as (select distinct ProductType, {bucket}, m, CustomerId
      from ({members}) join ({ACTIVE}) using (CustomerId))
    select ProductType, {bucket}, count(*)::double / {months} as AvgMonthlyOrderingCusts
    from pairs group by ProductType, {bucket}"""


def product_report(members: str, frame: str, bucket: str, labels, own_months: bool) -> str:
    base = buckets(members, frame, "ProductType", bucket, labels, 1)
    act = activity(members, bucket, own_months)
    return f"""select b.*, case when exists (select 1 from ({act}) a where a.ProductType = b.ProductType)
        then coalesce(a.AvgMonthlyOrderingCusts, 0) end as AvgMonthlyOrderingCusts
      from ({base}) b left join ({act}) a using (ProductType, {bucket})"""


ACT = f"AvgMonthlyOrderingCusts {VALUES}"
add("avg_monthly_customers",
    lambda s: rp.avg_monthly_customers(s.stored, rp.order_bucket(s.product_rows), "OrderBucket", views.ACTIVITY_YEAR),
    activity("by_product", "OrderBucket", False), "AvgMonthlyOrderingCusts")
for _name, _floor in [("order_bucket_by_product", None), ("order_bucket_by_product_500", 500),
                      ("order_bucket_by_product_1000", 1000)]:
    _members = "select * from by_product" + (f" where LifetimeValue >= {_floor}" if _floor else "")
    add(_name,
        lambda s, floor=_floor: rp.order_bucket_by_product(s.product_rows, s.stored, floor, views.ACTIVITY_YEAR),
        product_report(_members, f"select distinct ProductType from ({_members})", "OrderBucket", v.ORDER_LABELS, False),
        ACT)
add("revenue_bucket_by_product",
    lambda s: rp.revenue_bucket_by_product(s.product_rows, s.stored, views.ACTIVITY_YEAR),
    product_report("select * from by_product", "select * from (values ('Sticker'), ('Label')) y(ProductType)",
                   "SpendingBucket", v.SPEND_LABELS, True), ACT)
add("cohort_promo_share",
    lambda s: rp.cohort_promo_share(s.product_rows, s.stored, bucket=views.PROMO_BUCKET),
    """select count(*) as TotalOrders, count(*) filter (abs(PromoCodeDiscount) > 0) as OrdersWithPromo,
      100.0 * count(*) filter (abs(PromoCodeDiscount) > 0) / nullif(count(*), 0) as PctWithPromo
    from feat where CustomerId in (select CustomerId from by_product
      where ProductType = 'Label' and LifetimeValue >= 1000 and OrderBucket = '6–10')""", "PctWithPromo")

# ---------------------------------------------------------------- segments
v.BLOCKS["buyers"] = """select CustomerId, OneAndDone, AvgItemsPerOrder, AvgOrderItemTotal, AvgRushFeeAndShipPrice,
  coalesce(AvgPromoDiscount < 0, false) as HasPromoDiscount from first_summary"""
STICKER_RULES = """case when (AvgItemsPerOrder > 3 and AvgOrderItemTotal > 175) or AvgOrderItemTotal > 250 or AvgItemsPerOrder > 6 then 'Bulk Buyer'
  when AvgItemsPerOrder < 3 and AvgOrderItemTotal < 75 then 'One-and-Done Zone'
  when AvgItemsPerOrder < 3 and AvgOrderItemTotal < 250 and HasPromoDiscount then 'Bargain Shopper'
  when AvgItemsPerOrder >= 2 and AvgItemsPerOrder <= 6 and AvgOrderItemTotal >= 100 and AvgOrderItemTotal <= 450 then 'Value Seeker'
  when AvgItemsPerOrder >= 2 and AvgItemsPerOrder <= 6 then 'Normal Shopper' else 'Uncategorized' end"""
LABEL_RULES = """case when AvgOrderItemTotal > 300 then 'Bulk Buyer'
  when AvgItemsPerOrder < 3 and AvgOrderItemTotal < 100 then 'One-and-Done Zone'
  when AvgItemsPerOrder > 2 and AvgOrderItemTotal > 100 then 'Steady Shipper'
  when AvgItemsPerOrder > 2 and AvgOrderItemTotal < 100 then 'Low value high items'
  when not HasPromoDiscount then 'Non-Promo Explorer' else 'Selective Spender' end"""


def _buyers(s):
    return fe.has_promo(s.stored_first_summary).select(
        "CustomerId", "OneAndDone", "AvgItemsPerOrder", "AvgOrderItemTotal", "AvgRushFeeAndShipPrice", "HasPromoDiscount")


for _family, _rules in [("sticker", STICKER_RULES), ("label", LABEL_RULES)]:
    add(f"segment_{_family}",
        lambda s, family=_family: rp.apply_segment(_buyers(s), family).select("CustomerId", "SegmentName"),
        f"select CustomerId, {_rules} as SegmentName from buyers")
add("apply_segment",
    lambda s: rp.apply_segment(_buyers(s), "sticker").withColumn("Family", F.lit("sticker")).unionByName(
        rp.apply_segment(_buyers(s), None).withColumn("Family", F.lit("none"))).groupBy("Family", "SegmentName").agg(
            F.count("CustomerId").alias("Customers")),
    f"""select 'sticker' as Family, {STICKER_RULES} as SegmentName, count(*) as Customers from buyers group by 2
    union all select 'none', 'Uncategorized', count(*) from buyers""")
add("segment_summary", lambda s: rp.segment_summary(rp.apply_segment(_buyers(s), "label")),
    f"""select SegmentName, count(CustomerId) as TotalCustomers, sum(AvgOrderItemTotal) as TotalValue,
      avg(AvgItemsPerOrder) as AvgItemsPerOrder, avg(AvgOrderItemTotal) as AvgOrderItemTotal,
      median(AvgOrderItemTotal) as MedianOrderItemTotal, avg(AvgRushFeeAndShipPrice) as AvgRushFeeAndShipPrice,
      avg(HasPromoDiscount::int) as AvgPctUsedPromo, avg(OneAndDone::int) as AvgPctOneAndDone
    from (select *, {LABEL_RULES} as SegmentName from buyers) group by SegmentName""",
    "TotalValue AvgItemsPerOrder AvgOrderItemTotal MedianOrderItemTotal AvgRushFeeAndShipPrice AvgPctUsedPromo AvgPctOneAndDone")

# ---------------------------------------------------------------- cluster tables
v.BLOCKS["clustered"] = "select *, cast(CustomerId % 4 as int) as Cluster from summary"
v.BLOCKS["tree_clustered"] = "select *, cast(CustomerId % 4 as int) as Cluster from tree_data"
FEATURES = ["TotalOrders", "AvgOrderValue", "AvgPromoDiscount"]
v.BLOCKS["cluster_means"] = " union all ".join(
    f"select cast(CustomerId % 4 as int) as Cluster, '{f}' as Feature, avg({f})::double as Mean from cluster_data group by 1"
    for f in FEATURES)
add("churn_by_cluster", lambda s: rp.churn_by_cluster(s.by_id(s.summary)),
    "select Cluster, 1 - avg(OneAndDone::int) as ShareFalse, avg(OneAndDone::int) as ShareTrue from clustered group by Cluster",
    "ShareFalse ShareTrue")
add("cluster_sizes", lambda s: rp.cluster_sizes(s.by_id(s.summary)),
    "select Cluster, count(*) as Size, count(*)::double / (select count(*) from summary) as Share from clustered group by Cluster",
    "Share")
add("crosstab_share",
    lambda s: rp.crosstab_share(s.by_id(rp.spending_bucket(s.summary)), "Cluster", "SpendingBucket"),
    f"""select Cluster, SpendingBucket, count(*) as N, count(*)::double / sum(count(*)) over (partition by Cluster) as Share
    from (select Cluster, {v.spend_case()} as SpendingBucket from clustered) where SpendingBucket is not null
    group by Cluster, SpendingBucket""", "Share")
add("cluster_profile_between", lambda s: rp.cluster_profile_between(s.by_id(s.cluster_table), FEATURES),
    "select *, (Mean - avg(Mean) over (partition by Feature)) / stddev_samp(Mean) over (partition by Feature) as Z from cluster_means",
    "Mean Z")
add("cluster_profile_population",
    lambda s: rp.cluster_profile_population(
        s.by_id(s.cluster_table).filter(~F.col("LikelyChurned")), s.cluster_table, FEATURES),
    " union all ".join(
        f"""select cast(CustomerId % 4 as int) as Cluster, '{f}' as Feature, avg({f})::double as Mean,
        (avg({f}) - (select avg({f}) from cluster_data)) / (select stddev_samp({f}) from cluster_data) as Z
        from cluster_data where not LikelyChurned group by 1""" for f in FEATURES), "Mean Z")
SIX = """avg(AvgItemsPerOrder) as AvgItemsPerOrder, avg(AvgOrderItemTotal) as AvgOrderItemTotal,
  avg(AvgRushFeeAndShipPrice) as AvgRushFeeAndShipPrice, avg(HasPromoDiscount::int) as PctUsedPromo,
  avg(OneAndDone::int) as PctOneAndDone"""
SIX_NAMES = "AvgItemsPerOrder AvgOrderItemTotal AvgRushFeeAndShipPrice PctUsedPromo PctOneAndDone"
add("cluster_value_summary", lambda s: rp.cluster_value_summary(s.by_id(s.tree_table)),
    f"""select Cluster, {SIX}, avg((ShippingType = 'NormalShipping')::int) as PctNormalShipping, count(*) as ClusterSize,
    avg(AvgOrderItemTotal) * count(*) as ClusterValue from tree_clustered group by Cluster""",
    SIX_NAMES + " PctNormalShipping ClusterValue")
add("leaf_summary", lambda s: rp.leaf_summary(s.by_id(s.tree_table).withColumnRenamed("Cluster", "LeafID")),
    f"""select Cluster as LeafID, count(CustomerId) as LeafSize, {SIX}, avg(AvgOrderItemTotal) * count(*) as LeafValue
    from tree_clustered group by Cluster""", SIX_NAMES + " LeafValue")
