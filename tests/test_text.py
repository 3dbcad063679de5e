import datetime as dt
import hashlib

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from muster.functions import naming as N
from muster.functions import requests as R
from muster.functions.text import WHITESPACE, as_text, charset, is_blank, one_line, strip


def values(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]


def test_whitespace_is_what_python_strips(spark):
    assert len(WHITESPACE) == 29
    others = ["​", "﻿", "᠎", "a", "\u0000"]
    cases = [c + "x y" + c for c in [*WHITESPACE, *others]] + [WHITESPACE, "", WHITESPACE + "é" + WHITESPACE]
    df = spark.createDataFrame([(c,) for c in cases], "v string").repartition(3)
    for raw, stripped, blank in values(df, "v", strip(F.col("v")), is_blank(F.col("v"))):
        assert stripped == raw.strip()
        assert blank == (not raw.strip())


def test_identifiers_are_text_or_integers(spark):
    df = spark.createDataFrame([(7, "a", 1.5, True)], "i bigint, s string, d double, b boolean")
    assert values(df, as_text(df, "i"), as_text(df, "s")) == [("7", "a")]
    for name in "db":
        with pytest.raises(TypeError):
            as_text(df, name)


def test_line_breaks_inside_a_value_raise(spark):
    df = spark.createDataFrame([("a b",)], "v string")
    assert values(df, one_line(F.col("v"))) == [("a b",)]
    for bad in ("a\nb", "a\rb"):
        with pytest.raises(PySparkException, match="line break"):
            values(spark.createDataFrame([(bad,)], "v string"), one_line(F.col("v")))


def test_charset_names():
    assert charset("UTF8") == "utf-8" and charset("latin_1") == "iso-8859-1"
    with pytest.raises(ValueError):
        charset("klingon")


def test_snapshot_name(spark):
    query, stamp = "ALPHA[All Fields] AND Beta[Organism]", "2026-03-21T18:42:03Z"
    expected = "2026-03-21T18-42-03Z__q_" + hashlib.sha256(query.encode()).hexdigest()[:12]
    df = spark.createDataFrame([(stamp, query), (stamp, query + " "), (stamp, "é")], "s string, q string")
    names = [row[0] for row in values(df, N.snapshot_name(F.col("s"), F.col("q")))]
    assert names[0] == expected and len(set(names)) == 3
    assert names[2].endswith(hashlib.sha256("é".encode()).hexdigest()[:12])
    assert len(values(df, N.query_hash(F.col("q"), 80))[0][0]) == 64
    with pytest.raises(ValueError):
        N.query_hash(F.col("q"), 0)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_stamps_do_not_depend_on_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York that night.
        df = spark.sql(
            "SELECT timestamp_ntz'2024-03-10 02:30:59.999' AS n, timestamp_seconds(1710037859.9) AS i, "
            "timestamp_seconds(0) AS zero"
        )
        assert values(df, N.stamp_ntz(F.col("n")), N.stamp_instant(F.col("i")), N.stamp_instant(F.col("zero"))) == [
            ("2024-03-10T02:30:59Z", "2024-03-10T02:30:59Z", "1970-01-01T00:00:00Z")
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_request_rules_in_order(spark):
    cases = [
        (None, None, 0, 0, "email_required"),
        ("", "q", 1, 1, "email_required"),
        ("e", None, 0, 0, "blank_query"),
        ("e", " 　\t", 0, 0, "blank_query"),
        ("e", "q", 0, 0, "page_size_not_positive"),
        ("e", "q", 1, 0, "max_attempts_not_positive"),
        ("e", "q", 1, 1, None),
    ]
    df = spark.createDataFrame(cases, "e string, q string, p int, m int, x string").withColumn("d", F.lit(-1.0))
    plain = R.request_violation(*map(F.col, "eqpm"))
    for found, expected in values(df, plain, "x"):
        assert found == expected
    assert values(df.where("x IS NULL"), R.request_violation(*map(F.col, "eqpmd"))) == [("negative_delay",)]


def test_default_delay(spark):
    df = spark.createDataFrame([(None, None), (None, ""), (None, "k"), (2.0, "k"), (-1.0, None)], "d double, k string")
    delays = [row[0] for row in values(df, R.resolved_delay(F.col("d"), F.col("k")))]
    assert delays == [0.34, 0.34, 0.1, 2.0, -1.0]


def test_header_check(spark):
    df = spark.createDataFrame([(0, None, None), (1, "", "1"), (1, "w", None), (1, "w", "1")], "n bigint, w string, k string")
    broken = [row[0] for row in values(df, R.header_is_broken(*map(F.col, "nwk")))]
    assert broken == [False, True, True, False]


def test_stamp_searches_cuts_to_the_second(spark):
    from muster.plans.commit import stamp_searches

    now = dt.datetime(2024, 5, 6, 7, 8, 9, 999999, tzinfo=dt.timezone.utc)
    df = stamp_searches(spark.createDataFrame([("a",)], "dataset_id string"), now)
    assert df.first().retrieved_at_utc == "2024-05-06T07:08:09Z"
