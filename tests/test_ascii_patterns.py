"""Text that is ASCII throughout takes patterns of its own; results are those of the others."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from cinderlog import fixed
from cinderlog.functions import masks
from cinderlog.functions.regex import LINE_BREAKS, digit_class, has_digit, java
from cinderlog.sources.lines import split_lines

LINES = (
    "payments-api error user=12 cents=-34.5 after 78ms",
    "id 123e4567-e89b-12d3-a456-426614174000 at 2024-01-02T03:04:05.678Z by a.x+y@mail1.example.com",
    "ip 10.1.0.7:8080, v1.2 and 1.2.3, host https://h.example/p?q=1 took 1.5 s, 25 GiB",
    "ptr 0xdeadBEEF run 0123456789abcdef no 0123456789a /var/log/u1/e.log \"a 1\" 'b 2' 5% 6.5%",
    "n=+1 <7> x8 9_ -10.25  two\tblanks\x1c+3 \x1f 4",
    "a-1 ,-2 (3) 4. .5 1e6 5.6.7 <*>8 8<NUM>",
    "no figures at all", "", " ", "+", "-", "<",
)
WIDE = ("é", "Ⅷ", "٣", "²", "\u00a0", "\ufffd", "ß9", "9ß", "٣.٣.٣.٣", "\u3000")


def _python(line: str) -> str:
    for _, pattern, sign in fixed.MASKS:
        line = re.sub(pattern, sign, line)
    return " ".join(line.split())


def test_masks_of_both_alphabets_as_python_has_them(spark):
    lines = [*LINES, *WIDE, *[a + b for a in LINES for b in WIDE], *[b + a for a in LINES for b in WIDE]]
    df = spark.createDataFrame([(x,) for x in lines], "raw string")
    found = df.select("raw", masks.normalize(F.col("raw")).alias("masked")).collect()
    assert {r.raw: r.masked for r in found} == {line: _python(line) for line in lines}


@pytest.mark.parametrize("name", [name for name, _, _ in fixed.MASKS])
def test_ascii_patterns_hold_no_unicode_class(spark, name):
    pattern = dict((n, p) for n, p, _ in fixed.MASKS)[name]
    short = java(pattern, ascii_only=True)
    assert r"\p{" not in short and r"\x{" not in short
    df = spark.createDataFrame([(x,) for x in LINES], "raw string")
    both = df.filter(masks.mask(F.col("raw"), name, True) != masks.mask(F.col("raw"), name))
    assert both.count() == 0


def test_digits_of_both_alphabets(spark):
    df = spark.createDataFrame([(x,) for x in [*LINES, *WIDE, None]], "token string")
    wrong = df.filter(~F.col("token").rlike(digit_class()).eqNullSafe(has_digit(F.col("token"))))
    assert wrong.count() == 0


def test_line_breaks_with_and_without_rare_ones(spark):
    breaks = ("\n", "\r\n", "\r", "\n\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029")
    texts = ["", "a", *breaks, *[f"a{b}{b}b\n{b}c\nä{b}" for b in breaks], "a\nb\n\n", None]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    wrong = df.filter(~F.split("text", LINE_BREAKS, -1).eqNullSafe(split_lines(F.col("text"))))
    assert wrong.count() == 0


def test_bytes_that_are_no_utf8(spark):
    raw = [b"a\xff1", b"\x80\x81 12", b"\xc3a 3", b"\xe2\x82 0x1f"]
    df = spark.createDataFrame([(x,) for x in raw], "b binary").select(F.col("b").cast("string").alias("raw"))
    found = df.select(masks.normalize(F.col("raw")).alias("masked"), F.make_valid_utf8("raw").alias("valid"))
    assert found.filter(F.col("masked") != masks.normalize(F.col("valid"))).count() == 0
