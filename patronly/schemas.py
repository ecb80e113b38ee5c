"""Declared schemas of the raw shop tables."""

from pyspark.sql.types import (
    BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType,
    TimestampType,
)

from .constants import AD_INDICATORS, SESSION_ATTRIBUTES


def _schema(**columns) -> StructType:
    return StructType([StructField(name, kind) for name, kind in columns.items()])


RAW_ORDER = _schema(
    OrderNumber=LongType(), CustomerId=LongType(), IsDeleted=IntegerType(),
    AffiliateId=IntegerType(), PlacedDateTime=TimestampType(), ShippedDateTime=TimestampType(),
    OrderItemPriceTotal=DoubleType(), ShippingTotal=DoubleType(), PriceTotal=DoubleType(),
    RushFee=DoubleType(), ShipPrice=DoubleType(), PromoCodeDiscount=DoubleType(),
    Tax=DoubleType(), PaymentMethod=StringType(), NoPromotionalDesignUse=BooleanType(),
)
RAW_ORDER_ITEM = _schema(
    OrderNumber=LongType(), ProductProductOptionId=LongType(), Quantity=DoubleType(),
    IsDeleted=IntegerType(),
)
RAW_PRODUCT = _schema(Id=LongType(), Name=StringType())
RAW_AD_CAMPAIGNS = _schema(
    AdCampaignId=StringType(), **{name: IntegerType() for name in AD_INDICATORS}
)
RAW_ORDER_AND_ANALYTICS = _schema(
    OrderNumber=StringType(), medium=StringType(), source=StringType(),
    AdwordsCampaignId=StringType(),
)
BIGQUERY_EVENTS = _schema(
    param_transaction_id=StringType(), **{name: StringType() for name in SESSION_ATTRIBUTES}
)
WEB_VISITS = _schema(
    VisitId=LongType(), CustomerId=LongType(), VisitedAt=TimestampType(), traffic_source_medium=StringType(),
    device_operating_system=StringType(),
)
PROMOTIONS = _schema(PromotionId=LongType(), StartsAt=TimestampType(), EndsAt=TimestampType())

SCHEMAS = {
    "raw_order": RAW_ORDER,
    "raw_order_item": RAW_ORDER_ITEM,
    "raw_product_product_option": RAW_PRODUCT,
    "raw_ad_campaigns": RAW_AD_CAMPAIGNS,
    "raw_order_and_analytics": RAW_ORDER_AND_ANALYTICS,
    "bigquery_events": BIGQUERY_EVENTS,
    "web_visits": WEB_VISITS,
    "promotions": PROMOTIONS,
}
