"""Python-flavoured patterns on the JVM.

Log patterns are written the way Python's ``re`` reads them on text: ``\\w``, ``\\d``,
``\\s`` and ``\\b`` cover Unicode. Java's own classes differ in small ways (combining
marks, the separators ``\\x1c-\\x1f``), so each class is spelled out.
"""

from __future__ import annotations

import re
import string
import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII ranges come first: they are one bitmap look-up in the matcher.
_WORD = r"a-zA-Z0-9_\p{L}\p{N}"
_SPACE = r"\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_DIGIT = r"0-9\p{Nd}"
# What is left of the classes on text that is ASCII throughout. Spelled out one by one, the
# characters are one bitmap look-up in the matcher; classes of Unicode are a chain of tests.
_ASCII_WORD = string.ascii_letters + string.digits + "_"
_ASCII_SPACE = "".join(rf"\x{i:02x}" for i in (*range(0x09, 0x0E), *range(0x1C, 0x21)))


def _classes(word: str, space: str, digit: str) -> tuple[dict[str, str], dict[str, str]]:
    """The classes inside brackets, and by themselves."""
    inside = {"w": word, "s": space, "d": digit}
    boundary = f"(?:(?<=[{word}])(?![{word}])|(?<![{word}])(?=[{word}]))"
    return inside, {**{name: f"[{held}]" for name, held in inside.items()}, "b": boundary}


_UNICODE = _classes(_WORD, _SPACE, _DIGIT)
_ASCII = _classes(_ASCII_WORD, _ASCII_SPACE, string.digits)
# A boundary before something that starts with a word character, and one after something
# that ends with one, need to look one way only. Looking at the next character first
# rejects most positions at once.
_WORD_START = re.compile(r"^\\b(\[0-9a-fA-F\]|\\d|[A-Za-z0-9])")
_MIXED_START = re.compile(r"^\\b(\[[^\]]+\])\+@")
_MIXED_END = re.compile(r"[.\-]\]\+\\b$")
# Likewise for a look behind at the start, which would run at every position.
_SIGNED_START = re.compile(r"^\(\?<!\[\\w<\]\)\[\+-\]\?\\d")

# What str.strip() removes and str.split() splits on.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
WHITESPACE_RUN = f"[{_SPACE}]+"
# Words with one blank between them: nothing to collapse. A quick test for most lines.
_PLAIN = r"[!-~\x{a1}-\x{167f}]"
_COLLAPSED = f"^{_PLAIN}++(?: {_PLAIN}++)*+$"
_ASCII_COLLAPSED = "^[!-~]++(?: [!-~]++)*+$"

# Where str.splitlines() breaks.
LINE_BREAKS = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
RARE_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"


@lru_cache(maxsize=None)
def java(pattern: str, ascii_only: bool = False) -> str:
    """Spell out the classes of a Python-flavoured pattern. With `ascii_only` it holds for text
    without other characters (see `is_ascii`) and is much faster there."""
    inside, outside = _ASCII if ascii_only else _UNICODE

    def spell(match: re.Match) -> str:
        text = match.group(0)
        if text.startswith("["):
            return re.sub(r"\\([wsd])", lambda m: inside[m.group(1)], text)
        return outside.get(text[1], text)

    before = after = ""
    if start := _WORD_START.match(pattern):
        before = f"(?={start.group(1)})(?<![\\w])"
        pattern = pattern[2:]
    elif start := _MIXED_START.match(pattern):
        # the run cannot contain the sign after it, so giving characters back never helps
        before = f"(?={start.group(1)})"
        pattern = pattern.replace("+@", "++@", 1)
    elif _SIGNED_START.match(pattern):
        before = r"(?=[+\-\d])"
    if pattern.endswith(r"\b") and not _MIXED_END.search(pattern):
        after = r"(?![\w])"
        pattern = pattern[:-2]
    return re.sub(r"\[(?:\\.|[^\]\\])*\]|\\.", spell, before + pattern + after)


@lru_cache(maxsize=None)
def digit_class() -> str:
    """Class of the characters for which ``str.isdigit`` holds: the decimal digits
    plus the superscripts, subscripts and circled digits."""
    extra = (
        chr(i)
        for i in range(0x110000)
        if chr(i).isdigit() and unicodedata.category(chr(i)) != "Nd"
    )
    return "[" + _DIGIT + "".join(f"\\x{{{ord(c):x}}}" for c in extra) + "]"


def is_ascii(text: Column) -> Column:
    """No character takes more than a byte. (Bytes that are no UTF-8 may count as one each; they
    are read as U+FFFD, which is in no class.)"""
    return F.length(text) == F.octet_length(text)


def by_alphabet(text: Column, of) -> Column:
    """``of(True)`` for text that is ASCII throughout, else ``of(False)``."""
    return F.when(is_ascii(text), of(True)).otherwise(of(False))


def has_digit(text: Column) -> Column:
    """A character for which ``str.isdigit`` holds."""
    return by_alphabet(text, lambda ascii_only: text.rlike("[0-9]" if ascii_only else digit_class()))


def split_breaks(text: Column) -> Column:
    """Parts between line breaks. Text with no break but ``\\n`` needs no pattern."""
    rare = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in RARE_BREAKS])
    return F.when(rare, F.split(text, LINE_BREAKS, -1)).otherwise(F.split(text, "\n", -1))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``. Keeps an expression
    small wherever Spark copies it, for instance to push a filter down."""
    return F.transform(F.array(value), body).getItem(0)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def strip_left(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def strip_right(col: Column) -> Column:
    return F.rtrim(col, F.lit(WHITESPACE))


def collapse_spaces(col: Column) -> Column:
    def collapsed(text: Column) -> Column:
        plain = by_alphabet(text, lambda ascii_only: text.rlike(_ASCII_COLLAPSED if ascii_only else _COLLAPSED))
        return F.when(plain, text).otherwise(
            strip(F.regexp_replace(text, WHITESPACE_RUN, " "))
        )

    return let(col, collapsed)
