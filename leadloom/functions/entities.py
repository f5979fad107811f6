"""HTML character references decoded by Catalyst expressions.

The name table is a parameter taken from the Python standard library, shipped to the plan
as one JSON literal (folded to a single map literal), not written out here.
"""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.arrays import let

# Map lookup scans from the front, so the names that pages really use come first.
_FREQUENT = ("amp;", "nbsp;", "lt;", "gt;", "quot;", "copy;", "middot;", "mdash;", "ndash;", "rsquo;")


@lru_cache(maxsize=1)
def _name_table_json() -> str:
    names = [*_FREQUENT, *(n for n in html5 if n not in _FREQUENT)]
    return json.dumps({n: html5[n] for n in names})


@lru_cache(maxsize=1)
def _bare_names() -> str:
    """Alternation of the names that need no semicolon, longest first."""
    bare = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return "|".join(bare)


def _code_point(number: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")


def _numeric(number: Column) -> Column:
    """Character of a numeric reference, with the HTML5 replacement rules."""
    windows = {}
    for n in range(0x80, 0xA0):
        char = bytes([n]).decode("cp1252", errors="ignore")
        windows[n] = char or chr(n)
    table = F.from_json(F.lit(json.dumps({str(k): v for k, v in windows.items()})), "map<string,string>")
    low = number.bitwiseAND(F.lit(0xFFFF))
    return (
        F.when((number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF), F.lit("�"))
        .when(number == 0x0D, F.lit("\r"))
        .when(number.between(0x80, 0x9F), F.try_element_at(table, number.cast("string")))
        .when(
            number.between(0x1, 0x8)
            | (number == 0xB)
            | number.between(0xE, 0x1F)
            | (number == 0x7F)
            | number.between(0xFDD0, 0xFDEF)
            | (low >= 0xFFFE),
            F.lit(""),
        )
        .otherwise(_code_point(number))
    )


def _number(digits: Column, base: int) -> Column:
    """Parse digits; more digits than a code point can have count as out of range."""
    significant = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(significant) > 8, F.lit(0x110000)).otherwise(F.conv(significant, base, 10)).cast("long")


def _from(text: Column, start: Column | int) -> Column:
    return text.substr(F.lit(start) if isinstance(start, int) else start, F.length(text))


def name_table() -> Column:
    """The reference names as one map literal; expressions that decode often should bind it once."""
    return F.from_json(F.lit(_name_table_json()), "map<string,string>")


def _decode_piece(piece: Column, names: Column) -> Column:
    """Decode one piece of text that starts with an ampersand (or holds none)."""
    named = let(
        F.regexp_extract(piece, r"^&([A-Za-z][A-Za-z0-9]{1,30}(?:;|(?![^\t\n\f <&#;])))", 1),
        lambda name: F.when(
            name != "", F.concat(F.try_element_at(names, name), _from(piece, F.length(name) + 2))
        ),
    )
    prefix = let(
        F.regexp_extract(piece, rf"^&({_bare_names()})", 1),
        lambda name: F.when(
            name != "", F.concat(F.try_element_at(names, name), _from(piece, F.length(name) + 2))
        ),
    )
    hexadecimal = F.lower(F.substring(piece, 3, 1)) == "x"
    numeric = let(
        F.regexp_extract(piece, r"^&#(?:[0-9]++|[xX][0-9a-fA-F]++);?", 0),
        lambda ref: F.when(
            ref != "",
            F.concat(
                let(
                    F.regexp_replace(ref, "^&#[xX]?|;", ""),
                    lambda digits: let(
                        F.when(hexadecimal, _number(digits, 16)).otherwise(_number(digits, 10)), _numeric
                    ),
                ),
                _from(piece, F.length(ref) + 1),
            ),
        ),
    )
    return (
        F.when(~piece.startswith("&"), piece)
        .when(piece.startswith("&#"), F.coalesce(numeric, piece))
        # A miss in the name table is a full scan, so only pieces that can be a name get there.
        .when(piece.rlike("^&[A-Za-z]"), F.coalesce(named, prefix, piece))
        .otherwise(piece)
    )


def unescape(value: Column, names: Column | None = None) -> Column:
    """Decode named and numeric character references once."""
    if names is None:
        return let(name_table(), lambda bound: unescape(value, bound))
    return let(
        value,
        lambda v: F.when(~F.contains(v, F.lit("&")), v).otherwise(
            F.array_join(F.transform(F.split(v, "(?=&)"), lambda piece: _decode_piece(piece, names)), "")
        ),
    )
