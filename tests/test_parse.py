from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cinderlog.operators import parse

BASE = "2024-01-01 00:00:00"


def events(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no bigint, raw string")
    found = parse.synthetic_clock(parse.parse_lines(df), BASE)
    return found.orderBy("line_no").collect()


def one(spark, line):
    return events(spark, [line])[0]


def test_text_line(spark):
    e = one(spark, "2026-06-30T13:45:12.031Z ERROR payments-api connection pool exhausted after 5031ms")
    assert (e.level, e.service) == ("ERROR", "payments-api")
    assert e.message == "connection pool exhausted after 5031ms"
    assert e.ts == datetime(2026, 6, 30, 13, 45, 12, 31000)


def test_alias_keys(spark):
    e = one(spark, '{"time": "2026-06-30T10:00:00Z", "severity": "warn", "svc": "auth", "msg": "slow"}')
    assert (e.level, e.service, e.message) == ("WARN", "auth", "slow")
    assert e.ts == datetime(2026, 6, 30, 10)


def test_bracketed_level_and_fallback(spark):
    assert one(spark, "2026-06-30 10:00:00 [WARN] worker something happened").level == "WARN"
    e = one(spark, "totally freeform text with no level")
    assert (e.level, e.message, e.service) == ("UNKNOWN", "totally freeform text with no level", None)


def test_synthetic_clock_counts_only_lines_without_time(spark):
    found = events(spark, ["one", "2024-05-05T00:00:00Z INFO svc-a x", "", "two", '{"msg":"three"}'])
    start = datetime(2024, 1, 1)
    bare = [e.ts for e in found if e.level == "UNKNOWN"]
    assert bare == [start, start + timedelta(seconds=1), start + timedelta(seconds=2)]


def test_blank_lines_use_up_numbers(spark):
    assert [e.line_no for e in events(spark, ["line one", "", " \t　", "line two"])] == [1, 4]


@pytest.mark.parametrize(
    "line, level, service, message",
    [
        ("2024-01-01T00:00:00Z ERROR connection refused", "ERROR", "connection", "refused"),
        ("2024-13-01 10:00:00 ERROR svc.a down", "ERROR", "svc.a", "down"),
        ("INFO Svc Hello", "INFO", None, "Svc Hello"),
        ("(err) a/b: - x", "ERR", "a/b", "- x"),
        ("warning only", "WARNING", None, "only"),
        ("NOTE ERROR x", "UNKNOWN", None, "NOTE ERROR x"),
        ("ERROR", "UNKNOWN", None, "ERROR"),
        ("ERROR   ", "ERROR", None, "ERROR"),
        ('{"a":1} tail', "UNKNOWN", None, '{"a":1} tail'),
        ("{'a':1}", "UNKNOWN", None, "{'a':1}"),
        ('{"msg":"a","msg":"b"}', "UNKNOWN", None, "b"),
        ('{"level":3,"msg":"x"}', "UNKNOWN", None, "x"),
        ('{"app":5,"msg":" x "}', "UNKNOWN", "5", "x"),
        ('{"msg":"","log":0}', "UNKNOWN", None, "0"),
        ('{"b":2.50,"a":100.0,"c":null,"d":true,"e":7,"level":"info"}', "INFO", None,
         "b=2.5 a=100.0 c=None d=True e=7"),
        ('{"level":"info"}', "INFO", None, '{"level":"info"}'),
        ("[1]", "UNKNOWN", None, "[1]"),
    ],
)
def test_fields(spark, line, level, service, message):
    e = one(spark, line)
    assert (e.level, e.service, e.message) == (level, service, message)


@pytest.mark.parametrize(
    "value, expected",
    [
        ("1700000000", datetime(2023, 11, 14, 22, 13, 20)),
        ("1700000000123", datetime(2023, 11, 14, 22, 13, 20, 123000)),
        ("1700000000.25", datetime(2023, 11, 14, 22, 13, 20, 250000)),
        ("true", datetime(1970, 1, 1, 0, 0, 1)),
        ("0", datetime(1970, 1, 1)),
        ('"2024-01-01"', datetime(2024, 1, 1)),
        ('"20240102"', datetime(2024, 1, 2)),
        ('"2024-01-01 10:05"', datetime(2024, 1, 1, 10, 5)),
        ('"2024-01-01T10"', datetime(2024, 1, 1, 10)),
        ('"2024-01-01T10:00:01,5+02:00"', datetime(2024, 1, 1, 8, 0, 1, 500000)),
        ('"2024-01-01T10:00:00-0130"', datetime(2024, 1, 1, 11, 30)),
        ('"2024-01-01T10:00:00.123456789Z"', datetime(2024, 1, 1, 10, 0, 0, 123456)),
        ('"2024-02-30"', datetime(2024, 1, 1)),
        ('"1700000000"', datetime(2024, 1, 1)),
        ('"noon"', datetime(2024, 1, 1)),
        ("1e18", datetime(2024, 1, 1)),
        ("[1]", datetime(2024, 1, 1)),
    ],
)
def test_timestamps(spark, value, expected):
    assert one(spark, f'{{"ts":{value},"msg":"m"}}').ts == expected


def test_counts(spark):
    df = spark.createDataFrame([(1, "INFO a-b x"), (2, "y"), (3, " ")], "line_no bigint, raw string")
    row = parse.parse_counts(parse.parse_lines(df)).first()
    assert tuple(row) == (2, 1, 1)


def test_filter_on_a_parsed_column_stays_small(spark):
    df = spark.createDataFrame([(1, "INFO a-b x")], "line_no bigint, raw string")
    found = parse.parse_lines(df).filter((F.col("message") != "") & (F.col("level") == "INFO"))
    assert found.count() == 1
