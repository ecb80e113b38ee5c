import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from patronly.schemas import SCHEMAS  # noqa: E402
from patronly.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(4, "tests", "4g")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


def at(text):
    return None if text is None else datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def order_rows(spark):
    """Raw orders from partial rows; anything not given gets an ordinary value."""
    defaults = dict(
        IsDeleted=0, AffiliateId=2, PlacedDateTime="2020-01-01 10:00:00",
        ShippedDateTime="2020-01-03 10:00:00", OrderItemPriceTotal=50.0, ShippingTotal=0.0,
        PriceTotal=60.0, RushFee=0.0, ShipPrice=0.0, PromoCodeDiscount=0.0, Tax=1.0,
        PaymentMethod="card", NoPromotionalDesignUse=True)

    def build(*rows):
        full = []
        for number, row in enumerate(rows, 1):
            r = {"OrderNumber": number, "CustomerId": 1, **defaults, **row}
            r["PlacedDateTime"], r["ShippedDateTime"] = at(r["PlacedDateTime"]), at(r["ShippedDateTime"])
            full.append(tuple(r[f.name] for f in SCHEMAS["raw_order"]))
        return spark.createDataFrame(full, SCHEMAS["raw_order"])

    return build


def rows(df, *columns):
    """Sorted tuples of the named columns."""
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
