"""The raw shop tables and shared building blocks as DuckDB SQL.

Written from the meaning of each table, independently of the Spark operators; the
oracle statements in ``oracles`` put the blocks they need in front.
"""

# Each block may use the ones before it.
BLOCKS: dict[str, str] = {}

BLOCKS["raw_order"] = """
select o_orderkey as OrderNumber,
  case when o_orderkey%3=0 then 1000000+o_orderkey else o_custkey end as CustomerId,
  cast(case when o_orderkey%50=0 then 1 when o_orderkey%50=1 then null else 0 end as int) as IsDeleted,
  cast(case when o_orderkey%20=7 then 1 else 2 end as int) as AffiliateId,
  o_orderdate + to_hours(cast(o_orderkey%24 as int)) as PlacedDateTime,
  sh + to_hours(20) as ShippedDateTime,
  floor(o_totalprice/10)/100 as OrderItemPriceTotal,
  cast(case o_orderkey%7 when 0 then 4.0 when 1 then 12.5 when 2 then 2.0 when 3 then null when 4 then 4.0 else 0.0 end as double) as ShippingTotal,
  floor(o_totalprice/10)/100 + cast(case when o_orderpriority='1-URGENT' then 15.0 else 0.0 end as double) as PriceTotal,
  cast(case when o_orderpriority='1-URGENT' then 15.0 else 0.0 end as double) as RushFee,
  cast(case o_orderkey%7 when 0 then 4.0 when 1 then 12.5 when 2 then 2.0 when 3 then null when 4 then 4.0 else 0.0 end as double) as ShipPrice,
  cast(case o_orderkey%4 when 0 then -floor(o_totalprice/100)/100 when 1 then null else 0.0 end as double) as PromoCodeDiscount,
  floor(o_totalprice/125)/100 as Tax,
  case o_orderkey%5 when 0 then 'card' when 1 then 'paypal' when 2 then 'invoice' when 3 then 'card' else null end as PaymentMethod,
  case o_orderkey%3 when 0 then true when 1 then false else null end as NoPromotionalDesignUse
from orders left join (select l_orderkey as k, max(l_shipdate) as sh from lineitem group by l_orderkey) s on k=o_orderkey
"""
BLOCKS["raw_order_item"] = """
select l_orderkey as OrderNumber,
  case when l_linenumber=7 then null else l_partkey end as ProductProductOptionId,
  l_quantity as Quantity,
  cast(case l_suppkey%25 when 0 then 1 when 1 then null else 0 end as int) as IsDeleted
from lineitem
"""
BLOCKS["raw_product"] = """
select p_partkey as Id, case when p_partkey%40=0 then null else p_name end as Name from part
"""
BLOCKS["raw_ad_campaigns"] = """
select cast(n_nationkey as varchar) as AdCampaignId,
  cast(n_nationkey%2 as int) as AdSticker, cast(n_regionkey%2 as int) as AdLabel,
  cast((n_nationkey%3)%2 as int) as AdPouch,
  cast(n_nationkey%5=0 as int) as AdCompetitor, cast(n_nationkey%4=0 as int) as AdMaterial,
  cast(n_nationkey%6=0 as int) as AdUseOrShape, cast(n_nationkey%7=0 as int) as AdVideo,
  cast(n_nationkey%8=0 as int) as AdDSA
from nation
"""
BLOCKS["raw_analytics"] = """
select case when event_id%97=0 then 'n/a' else cast(event_id%4000 as varchar) end as OrderNumber,
  case event_type when 'click' then 'cpc' when 'view' then 'organic' when 'signup' then 'email' when 'purchase' then '(none)' else null end as medium,
  case user_id%5 when 0 then 'google' when 1 then '(direct)' when 2 then 'bing' when 3 then null else 'facebook' end as source,
  case when user_id%4=0 then null else cast(user_id%30 as varchar) end as AdwordsCampaignId
from events
"""
BLOCKS["web_events"] = """
select cast(event_id%4000 as varchar) as param_transaction_id,
  case event_type when 'click' then 'cpc' when 'view' then 'organic' when 'signup' then 'None' when 'purchase' then '' else null end as traffic_source_medium,
  case user_id%5 when 0 then 'google' when 1 then '(direct)' when 2 then 'bing' when 3 then null else 'facebook' end as traffic_source_source,
  'n' || cast(user_id%7 as varchar) as traffic_source_name,
  event_type as param_medium,
  case when user_id%2=0 then 'google' else null end as param_source,
  case cast(json_extract_string(props,'$.k') as int)%3 when 0 then 'mobile' when 1 then 'desktop' else 'tablet' end as device_category,
  case user_id%4 when 0 then 'iOS' when 1 then 'Android' when 2 then 'Windows' else null end as device_operating_system,
  'metro_' || cast(user_id%20 as varchar) as geo_metro
from events
"""
BLOCKS["web_visits"] = """
select event_id as VisitId, user_id * 10 + event_id % 10 as CustomerId,
  make_timestamp(epoch_us(timestamp '1995-01-01') + (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) * 60) as VisitedAt,
  case event_type when 'click' then 'cpc' when 'view' then 'organic' when 'signup' then 'email' end as traffic_source_medium,
  case user_id % 4 when 0 then 'iOS' when 1 then 'Android' when 2 then 'Windows' end as device_operating_system
from events
"""
BLOCKS["promotions"] = """
select s_suppkey as PromotionId, timestamp '1994-01-01' + to_days((s_suppkey * 37 % 2500)::int) as StartsAt,
  timestamp '1994-01-01' + to_days((s_suppkey * 37 % 2500 + 1 + s_suppkey % 45)::int) as EndsAt
from supplier
"""
BLOCKS["clean"] = """
select * from raw_order
where (IsDeleted is null or IsDeleted <> 1) and AffiliateId = 2 and ShippedDateTime is not null
"""
BLOCKS["live_items"] = "select * from raw_order_item where IsDeleted is distinct from 1"
BLOCKS["prod_flags"] = """
select Id,
  coalesce(Name ilike '%widget%' and Name not ilike '%old%', false) as IsSticker,
  coalesce(Name ilike '%bolt%' and Name not ilike '%old%', false) as IsLabel,
  coalesce(Name ilike '%gear%' and Name not ilike '%old%', false) as IsPouch
from raw_product
"""
BLOCKS["items_flagged"] = """
select i.*, p.* from live_items i left join prod_flags p on i.ProductProductOptionId = p.Id
"""
BLOCKS["rollup"] = """
select OrderNumber, count(*) as ItemCount, avg(Quantity) as AvgItemQuantity,
  coalesce(bool_or(IsSticker), false) as OrderContainsSticker,
  coalesce(bool_or(IsLabel), false) as OrderContainsLabel,
  coalesce(bool_or(IsPouch), false) as OrderContainsPouch
from items_flagged group by OrderNumber
"""
BLOCKS["with_rollup"] = """
select c.*, r.ItemCount, r.AvgItemQuantity,
  coalesce(r.OrderContainsSticker, false) as OrderContainsSticker,
  coalesce(r.OrderContainsLabel, false) as OrderContainsLabel, r.OrderContainsPouch
from clean c left join rollup r using (OrderNumber)
"""
_SHIP = """case when OrderItemPriceTotal < 75 and ShippingTotal = 0 then 'NormalShipping'
    when OrderItemPriceTotal < 75 and ShippingTotal = 4 then 'TwoDayShipping'
    when OrderItemPriceTotal >= 75 and ShippingTotal = 0 then 'TwoDayShipping'
    when ShippingTotal > 4 then 'ExpeditedShipping' else '{}' end"""
SHIP = _SHIP.format("UnknownShipping")
SHIP_UNCATEGORIZED = _SHIP.format("UncategorizedShipping")
CALENDAR = """cast(hour(PlacedDateTime) as int) as HourOfDay,
  cast(isodow(PlacedDateTime)-1 as int) as DayOfWeek,
  cast(month(PlacedDateTime) as int) as Month, cast(day(PlacedDateTime) as int) as DayOfMonth"""
DELAY = "(epoch_us(ShippedDateTime)-epoch_us(PlacedDateTime))/3600000000.0"
HOURCAT = """case when hour(PlacedDateTime) in (5,6,7,8,9,10,11) then 'Morning'
    when hour(PlacedDateTime) in (12,13,14,15,16) then 'Afternoon'
    when hour(PlacedDateTime) >= 17 then 'Evening' else 'EarlyMorning' end"""
WORK = """(hour(PlacedDateTime) >= 8 and hour(PlacedDateTime) <= 17 and isodow(PlacedDateTime) <= 5) as WorkHours,
  (isodow(PlacedDateTime) <= 5) as Workday"""
EDGE = """(day(PlacedDateTime) <= 7) as FirstWeek,
  (day(last_day(PlacedDateTime)) - day(PlacedDateTime) < 7) as LastWeek"""
SEASON = """(month(PlacedDateTime) in (11,12)) as Holiday,
  (month(PlacedDateTime) between 5 and 8) as Summer,
  (month(PlacedDateTime) in (9,10) and year(PlacedDateTime)%2=0) as ElectionSeason,
  (month(PlacedDateTime) in (8,9,10) and year(PlacedDateTime)%4=0) as PresidentialElection"""
BLOCKS["feat"] = f"""
select * replace (coalesce(PromoCodeDiscount, 0.0) as PromoCodeDiscount),
  {CALENDAR}, {DELAY} as ShipDelayHours, {SHIP} as ShippingType, {HOURCAT} as HourCategory,
  {WORK}, {EDGE}, {SEASON}, RushFee + ShipPrice as RushFeeAndShipPrice
from with_rollup
"""
_AGGS = """count(OrderNumber) as TotalOrders, avg(OrderItemPriceTotal) as AvgOrderItemTotal,
  avg(PriceTotal) as AvgPriceTotal, avg(ItemCount) as AvgItemsPerOrder,
  avg(PromoCodeDiscount) as AvgPromoDiscount, avg(AvgItemQuantity) as AvgQuantity,
  avg(RushFee) as AvgRushFee, avg(ShipPrice) as AvgShipPrice,
  avg(RushFeeAndShipPrice) as AvgRushFeeAndShipPrice,
  min(PlacedDateTime) as FirstOrderDate, max(PlacedDateTime) as LastOrderDate"""


def aggregates(source: str) -> str:
    return f"select CustomerId, {_AGGS} from {source} group by CustomerId"


def gaps(source: str) -> str:
    return f"""select CustomerId, avg(gap) as MeanDaysBetweenOrders, stddev_samp(gap) as StdDaysBetweenOrders
from (select CustomerId, date_sub('day', lag(PlacedDateTime) over
        (partition by CustomerId order by PlacedDateTime, OrderNumber), PlacedDateTime) as gap from {source})
group by CustomerId"""


def modes(source: str) -> str:
    def one(part, name):
        return f"""(select CustomerId, {part} as {name} from (
  select CustomerId, {part}, row_number() over (partition by CustomerId order by count(*) desc, {part}) as r
  from {source} where {part} is not null group by CustomerId, {part}) where r = 1)"""
    return f"""select CustomerId, ModeHour, ModeDayOfWeek, ModeMonth
from {one('HourOfDay', 'ModeHour')} join {one('DayOfWeek', 'ModeDayOfWeek')} using (CustomerId)
  join {one('Month', 'ModeMonth')} using (CustomerId)"""


def profile(source: str) -> str:
    return f"""select * from ({aggregates(source)}) join ({gaps(source)}) using (CustomerId)
  join ({modes(source)}) using (CustomerId)"""


def _share(labels, column):
    listed = ", ".join(f"'{x}'" for x in labels)
    return ",\n  ".join(
        f"case when bool_or({column} in ({listed})) then count(distinct OrderNumber) filter ({column} = '{x}')"
        f"::double / count(distinct OrderNumber) end as Pct{x}" for x in labels)


SHIP_SHARES = _share(["NormalShipping", "TwoDayShipping", "ExpeditedShipping"], "ShippingType")
HOUR_SHARES = _share(["Morning", "Afternoon", "Evening", "EarlyMorning"], "HourCategory")
FLAG_SHARES = ",\n  ".join(f"avg({f}::int) as Pct{f}" for f in [
    "FirstWeek", "LastWeek", "Holiday", "Summer", "ElectionSeason", "PresidentialElection",
    "WorkHours", "Workday"]) + """,
  avg(OrderContainsSticker::int) as PctOrdersWithSticker,
  avg(OrderContainsLabel::int) as PctOrdersWithLabel,
  avg(OrderContainsPouch::int) as PctOrdersWithPouch"""
PCT_COLUMNS = [
    "PctNormalShipping", "PctTwoDayShipping", "PctExpeditedShipping", "PctMorning", "PctAfternoon",
    "PctEvening", "PctEarlyMorning", "PctFirstWeek", "PctLastWeek", "PctHoliday", "PctSummer",
    "PctElectionSeason", "PctPresidentialElection", "PctWorkHours", "PctWorkday",
    "PctOrdersWithSticker", "PctOrdersWithLabel", "PctOrdersWithPouch"]
BLOCKS["pct"] = f"select CustomerId, {SHIP_SHARES}, {HOUR_SHARES}, {FLAG_SHARES} from feat group by CustomerId"
BLOCKS["prof"] = profile("feat")
BLOCKS["repeaters"] = """
select * from feat where CustomerId in (select CustomerId from feat group by CustomerId having count(OrderNumber) > 1)
"""


def pattern(name, months, low, high, years, where="true"):
    """Customers of the repeat orders in ``where``: does the season repeat?"""
    return f"""select CustomerId, coalesce(n >= 2 and years >= {years} and longest between {low} and {high}, false) as {name}
from (select distinct CustomerId from repeaters where {where}) left join (
  select CustomerId, count(*) as n, count(distinct year(PlacedDateTime)) as years, max(gap) as longest
  from (select *, date_sub('day', lag(PlacedDateTime) over (partition by CustomerId order by PlacedDateTime, OrderNumber), PlacedDateTime) as gap
        from repeaters where {where} and month(PlacedDateTime) in ({months}))
  group by CustomerId) using (CustomerId)"""


BLOCKS["p_holiday"] = pattern("HolidayPattern", "11,12", 290, 2000, 2)
BLOCKS["p_summer"] = pattern("SummerPattern", "5,6,7,8", 220, 2000, 2)
BLOCKS["p_election"] = pattern("ElectionPattern", "9,10", 290, 800, 2, "ElectionSeason")
BLOCKS["p_president"] = pattern("PresidentialPattern", "8,9,10", 290, 1600, 8, "PresidentialElection")
BLOCKS["p_annual"] = """
select CustomerId, coalesce(avg((gap between 315 and 415)::int) >= 0.5, false) as AnnualPattern
from (select CustomerId, date_sub('day', lag(PlacedDateTime) over
  (partition by CustomerId order by PlacedDateTime, OrderNumber), PlacedDateTime) as gap from repeaters)
group by CustomerId
"""
BLOCKS["churned"] = """
select *, TotalOrders = 1 and LikelyChurned as OneAndDone,
  TotalOrders <= 3 and LikelyChurned as ThreeOrFewerAndChurned,
  TotalOrders = 2 and LikelyChurned as TwoAndChurned
from (select *, d > 35 and (ExceededCadence or (d > 100 and not (
      (coalesce(AnnualPattern, false) and d <= 290) or (coalesce(HolidayPattern, false) and d <= 290)
      or (coalesce(SummerPattern, false) and d <= 220) or (coalesce(ElectionPattern, false) and d <= 700)
      or (coalesce(PresidentialPattern, false) and d <= 1300)))) as LikelyChurned
  from (select *, d as DaysSinceLastOrder,
      FirstOrderDate >= today - interval 90 day as NewCustomerLast90Days,
      coalesce(MeanDaysBetweenOrders is not null and d > 1.5 * MeanDaysBetweenOrders, false) as ExceededCadence
    from (select *, date_sub('day', LastOrderDate, today) as d
      from prof left join p_holiday using (CustomerId) left join p_summer using (CustomerId)
        left join p_election using (CustomerId) left join p_president using (CustomerId)
        left join p_annual using (CustomerId)
        cross join (select max(PlacedDateTime) as today from feat))))
"""
CHURN_COLUMNS = ("CustomerId, DaysSinceLastOrder, NewCustomerLast90Days, ExceededCadence, AnnualPattern, "
                 "HolidayPattern, SummerPattern, ElectionPattern, PresidentialPattern, LikelyChurned, "
                 "OneAndDone, ThreeOrFewerAndChurned, TwoAndChurned")
BLOCKS["summary"] = """
select * exclude (d, today), AvgPriceTotal * TotalOrders as LifetimeValue
from churned left join pct using (CustomerId)
"""
_FIRST = ", ".join(
    f"arg_min({c}, (PlacedDateTime, OrderNumber)) filter ({c} is not null) as {c}" for c in [
        "OrderNumber", "IsDeleted", "AffiliateId", "PlacedDateTime", "ShippedDateTime",
        "OrderItemPriceTotal", "ShippingTotal", "PriceTotal", "RushFee", "ShipPrice",
        "PromoCodeDiscount", "Tax", "PaymentMethod", "NoPromotionalDesignUse"])
BLOCKS["first_values"] = f"select CustomerId, {_FIRST} from clean group by CustomerId"
BLOCKS["first_one"] = """
select * exclude (r) from (select *, row_number() over
  (partition by CustomerId order by PlacedDateTime, OrderNumber) as r from feat) where r = 1
"""
BLOCKS["last_two"] = """
select * exclude (r) from (select *, row_number() over
  (partition by CustomerId order by PlacedDateTime desc, OrderNumber desc) as r from feat) where r <= 2
"""
BLOCKS["first_prof"] = profile("first_one")
BLOCKS["first_summary"] = f"""
select * from first_prof left join (select {CHURN_COLUMNS} from churned) using (CustomerId)
  left join pct using (CustomerId)
"""
ATTRS = ["traffic_source_medium", "traffic_source_source", "traffic_source_name", "param_medium",
         "param_source", "device_category", "device_operating_system", "geo_metro"]


def sessions(where: str) -> str:
    parts = []
    for a in ATTRS:
        keep = where.format(a)
        parts.append(f"""left join (select param_transaction_id, {a} from (
    select param_transaction_id, {a}, row_number() over (partition by param_transaction_id order by count(*) desc, {a}) as r
    from web_events where {keep} group by param_transaction_id, {a}) where r = 1) using (param_transaction_id)""")
    return ("select param_transaction_id, " + ", ".join(ATTRS)
            + " from (select distinct param_transaction_id from web_events) " + "\n".join(parts))


BLOCKS["sess"] = sessions("{} is not null")
BLOCKS["sess_strict"] = sessions("{0} is not null and lower({0}) not in ('none', '')")
MEDIUMS = {"cpc": "cpc", "(none)": "none", "organic": "organic", "referral": "referral",
           "email": "email", "Display_Ad": "Display_Ad", "social": "social"}
SOURCES = {"google": "google", "(direct)": "direct", "bing": "bing", "facebook": "facebook"}
INDICATORS = [f"medium_{n}" for n in MEDIUMS.values()] + [f"source_{n}" for n in SOURCES.values()]
ADS = ["AdSticker", "AdLabel", "AdPouch", "AdCompetitor", "AdMaterial", "AdUseOrShape", "AdVideo", "AdDSA"]
BLOCKS["one_hot"] = ("select OrderNumber, coalesce(medium,'') as medium, coalesce(source,'') as source, AdwordsCampaignId, "
    + ", ".join(f"cast(coalesce(medium,'') = '{m}' as int) as medium_{n}" for m, n in MEDIUMS.items()) + ", "
    + ", ".join(f"cast(coalesce(source,'') = '{s}' as int) as source_{n}" for s, n in SOURCES.items())
    + " from raw_analytics")
BLOCKS["with_campaign"] = "select * from one_hot left join raw_ad_campaigns on AdwordsCampaignId = AdCampaignId"
BLOCKS["attr"] = ("select distinct try_cast(OrderNumber as bigint) as OrderNumber, " + ", ".join(INDICATORS)
    + ", AdCampaignId, " + ", ".join(ADS) + " from with_campaign")
SPEND = [0, 100, 500, 1000, 2500, 5000, 10000, 25000, 50000, 250000]
SPEND_LABELS = [f"${a}–{b}" for a, b in zip(SPEND, SPEND[1:])] + ["$250000–∞"]
ORDER_LABELS = ["1", "2", "3", "4", "5", "6–10", "10–20", "20–∞"]


def spend_case(column="LifetimeValue"):
    whens = [f"when {column} > {lo} and {column} <= {hi} then '{label}'"
             for lo, hi, label in zip(SPEND, SPEND[1:], SPEND_LABELS)]
    return f"case when {column} = 0 then '{SPEND_LABELS[0]}' {' '.join(whens)} when {column} > 250000 then '$250000–∞' end"


ORDER_CASE = """case when TotalOrders in (1, 2) then '1' when TotalOrders = 3 then '2' when TotalOrders = 4 then '3'
  when TotalOrders = 5 then '4' when TotalOrders = 6 then '5' when TotalOrders between 7 and 10 then '6–10'
  when TotalOrders between 11 and 20 then '10–20' when TotalOrders > 20 then '20–∞' end"""
BLOCKS["by_product"] = f"""
select *, {spend_case()} as SpendingBucket, {ORDER_CASE} as OrderBucket from (
  select *, 'Sticker' as ProductType from summary where PctOrdersWithSticker > 0
  union all select *, 'Label' as ProductType from summary where PctOrdersWithLabel > 0)
"""
BLOCKS["tree_data"] = """
select * from (select CustomerId, OneAndDone, AvgOrderItemTotal, AvgItemsPerOrder, AvgRushFeeAndShipPrice,
    coalesce(AvgPromoDiscount < 0, false) as HasPromoDiscount,
    case when f.OrderItemPriceTotal < 75 and f.ShippingTotal = 0 then 'NormalShipping' else 'OtherShipping' end as ShippingType
  from first_summary s left join first_values f using (CustomerId)
  where FirstOrderDate >= timestamp '1999-01-01' and PctOrdersWithLabel = 1)
where OneAndDone is not null and AvgOrderItemTotal is not null and AvgItemsPerOrder is not null
  and AvgRushFeeAndShipPrice is not null
"""
BLOCKS["cluster_data"] = """
select CustomerId, LikelyChurned, TotalOrders, AvgPriceTotal as AvgOrderValue,
  abs(AvgPromoDiscount) as AvgPromoDiscount, PctNormalShipping from summary
"""


def as_of(name: str, cutoff: str, suffix: str) -> str:
    """Adds copies of a block and of all it is made of, over the order features before
    ``cutoff``; returns the copy's name."""
    import re

    BLOCKS[f"feat_{suffix}"] = f"select * from feat where PlacedDateTime < timestamp '{cutoff}'"
    names = list(BLOCKS)
    moved = {"feat"}
    for block in names[names.index("feat") + 1:names.index(name) + 1]:
        if set(re.findall(r"[a-z_]+", BLOCKS[block])) & moved:
            text = BLOCKS[block]
            for old in moved:
                text = re.sub(rf"\b{old}\b", f"{old}_{suffix}", text)
            BLOCKS[f"{block}_{suffix}"] = text
            moved.add(block)
    return f"{name}_{suffix}"
