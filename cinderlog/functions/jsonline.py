"""Reading JSON log lines with flexible field names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from . import timestamps
from .regex import let

OBJECT = "map<string,variant>"


def strict_object(line: Column) -> Column:
    """The line's JSON object as a map of variants; null unless the whole line is exactly
    one object. ``try_parse_json`` ignores what follows a value, so the line is parsed
    inside a list and inside an object: trailing text breaks one of the two."""
    alone = F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))).isNotNull()
    held = F.try_variant_get(
        F.try_parse_json(F.concat(F.lit('{"w":'), line, F.lit("}"))), "$.w", OBJECT
    )
    return F.when(alone, held)


def kind(value: Column) -> Column:
    """JSON type of a variant: STRING, BOOLEAN, VOID, BIGINT, DECIMAL(..), DOUBLE, ..."""
    return F.schema_of_variant(value)


def text_of(value: Column) -> Column:
    """A JSON value as text the way Python prints it; nested values stay JSON text."""

    def shown(both: Column) -> Column:
        kind_, plain = both["kind"], both["plain"]
        number = F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")
        # whole numbers are BIGINT, or a longer DECIMAL where 64 bits do not hold them
        is_float = kind_.rlike(r"^(DECIMAL\((\d+,[1-9]|(\d|1[0-8]),0)|DOUBLE)")
        return (
            F.when(kind_ == "BOOLEAN", F.initcap(plain))
            .when(kind_ == "VOID", F.lit("None"))
            .when(is_float & number.rlike(r"[.E]"), number)
            .when(is_float, F.concat(number, F.lit(".0")))
            .otherwise(plain)
        )

    both = F.struct(kind(value).alias("kind"), value.cast("string").alias("plain"))
    return let(both, shown)


def is_filled(value: Column) -> Column:
    """Neither absent, null nor the empty string; zero and false count as filled."""
    return value.isNotNull() & ~F.schema_of_variant(value).isin("VOID") & (
        F.coalesce(value.cast("string"), F.lit("")) != ""
    )


def first_filled(obj: Column, keys: Sequence[str]) -> Column:
    """The first filled value among the keys, in the order of the keys."""
    names = F.array(*[F.lit(key) for key in keys])
    values = F.transform(names, lambda key: F.try_element_at(obj, key))
    # most lines are no object, and need no look at the keys
    return F.when(obj.isNotNull(), F.get(F.filter(values, is_filled), 0))


def timestamp_of(value: Column) -> Column:
    """A JSON value as a timestamp; only text, numbers and booleans can be one."""
    numeric = kind(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return (
        F.when(kind(value) == "STRING", timestamps.from_text(value.cast("string")))
        .when(numeric, timestamps.from_number(value.cast("double")))
        .when(
            kind(value) == "BOOLEAN",
            timestamps.from_number(value.cast("boolean").cast("int").cast("double")),
        )
    )


def level_of(value: Column) -> Column:
    """A known level name in upper case, else UNKNOWN; only text can name a level."""
    name = F.when(kind(value) == "STRING", F.upper(value.cast("string")))
    return known_level(name)


def known_level(name: Column) -> Column:
    return F.when(name.isin(*fixed.LEVEL_RANK), name).otherwise(fixed.UNKNOWN_LEVEL)


def folded_message(line: Column, obj: Column) -> Column:
    """``key=value`` for every key, in the order of the document, that is not a time,
    level or service field; the line itself if none is left."""
    skip = fixed.JSON_TS_KEYS + fixed.JSON_LEVEL_KEYS + fixed.JSON_SERVICE_KEYS
    keys = F.filter(F.array_distinct(F.json_object_keys(line)), lambda k: ~k.isin(*skip))
    pairs = F.transform(
        keys, lambda k: F.concat(k, F.lit("="), text_of(F.try_element_at(obj, k)))
    )
    return F.when(F.size(keys) > 0, F.array_join(pairs, " ")).otherwise(line)
