"""Attribution must not depend on the session's time zone."""

import datetime as dt

import pytest
from leaklens.functions.scalar import parse_thousands
from leaklens.operators.attribution import attribute_changes


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Europe/Berlin"])
def test_attribution_over_a_clock_change(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    rows = [("p", dt.datetime(2024, 3, 10, 1, 50), 1, "set", "A"), ("p", dt.datetime(2024, 3, 10, 2, 30), 2, "set", "B"),
            ("p", dt.datetime(2024, 3, 10, 3, 0), 3, "change", None), ("p", dt.datetime(2024, 3, 10, 3, 0, 0, 5), 4, "change", None)]
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        events = spark.createDataFrame(rows, "plugin_slug string, ts timestamp_ntz, event_id long, kind string, test string")
        got = sorted((r.event_id, r.test, r.zip_counter) for r in attribute_changes(events).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == [(3, "B", 1), (4, "B", 2)]


def test_counts_beyond_32_bits(spark):
    df = spark.createDataFrame([("3,000,000,000",), ("x",), (None,)], "n string")
    assert [r[0] for r in df.select(parse_thousands("n")).collect()] == [3_000_000_000, None, None]
