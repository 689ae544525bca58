"""Masking of variable text, and tokens."""

from __future__ import annotations

from functools import reduce
from string import hexdigits

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from .regex import by_alphabet, collapse_spaces, java, let

_BY_NAME = {name: (pattern, sign) for name, pattern, sign in fixed.MASKS}

# A mask can only match where this cheap byte search finds something; lines without it
# skip the regular expression.
_NEEDS_ONE_OF = {
    "uuid": ("-",),
    "ts": (":",),
    "email": ("@",),
    "url": ("://",),
    "ip": (".",),
    "size": ("b", "B"),
    "hex_prefixed": ("0x",),
    "path": ("/",),
    "quoted": ('"', "'"),
    "percent": ("%",),
}
# Likewise, for masks whose first sign is in nearly every line: a quick pattern.
_NEEDS_MATCH = {
    "ip": r"[0-9\p{Nd}]\.[0-9\p{Nd}]",
    "hex_run": f"[{hexdigits}]{{12}}",
}
# These also need a digit.
_NEEDS_DIGIT = ("ts", "ip", "duration", "size", "hex_prefixed", "percent", "number")


def mask(col: Column, name: str, ascii_only: bool = False) -> Column:
    """Apply one mask to a text column."""
    pattern, sign = _BY_NAME[name]
    return F.regexp_replace(col, java(pattern, ascii_only), sign)


def _where_possible(col: Column, name: str, ascii_only: bool = False) -> Column:
    """One mask behind its cheap tests."""
    parts, needed = _NEEDS_ONE_OF.get(name, ()), _NEEDS_MATCH.get(name)
    if not parts and not needed:
        return mask(col, name, ascii_only)

    def tested(text: Column) -> Column:
        found = [reduce(Column.__or__, [F.contains(text, F.lit(part)) for part in parts])] if parts else []
        if needed:
            found.append(text.rlike(needed.replace(r"\p{Nd}", "") if ascii_only else needed))
        return F.when(reduce(Column.__and__, found), mask(text, name, ascii_only)).otherwise(text)

    return let(col, tested)


def normalize(col: Column) -> Column:
    """All masks in order, then white space collapsed. A line without digits, and masking
    never adds one, skips the masks that need them. A line of ASCII stays one, and is masked
    by patterns for ASCII."""
    names = [name for name, _, _ in fixed.MASKS]

    def masked(text: Column) -> Column:
        def chain(ascii_only: bool) -> Column:
            def masks(chosen: list[str]) -> Column:
                return reduce(lambda masked, name: _where_possible(masked, name, ascii_only), chosen, text)

            few = masks([n for n in names if n not in _NEEDS_DIGIT])
            digit = text.rlike("[0-9]" if ascii_only else r"[0-9\p{Nd}]")
            return F.when(digit, masks(names)).otherwise(few)

        return by_alphabet(text, chain)

    return collapse_spaces(let(col, masked))


def tokens(masked: Column) -> Column:
    """Tokens of a normalised text; an empty text gives the one token ``<empty>``."""
    parts = F.split(masked, " ", -1)
    return let(
        parts,
        lambda found: F.when(
            found == F.array(F.lit("")), F.array(F.lit(fixed.EMPTY_TOKEN))
        ).otherwise(found),
    )
