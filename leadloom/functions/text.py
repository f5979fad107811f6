"""String functions on text, emails, names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.arrays import let

# Every code point Unicode calls white space, plus the four ASCII separators
# 1C-1F, which engine shorthands such as a plain \s or trim() do not all know.
WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a pattern, for use under the flag (?U): several times faster than spelled out.
WS = r"[\s\x1c-\x1f]"
# A run that one space must replace; a single plain space is left alone, which spares most matches.
_LOOSE_SPACE = rf"(?U)[\s\x1c-\x1f&&[^ ]]{WS}*+| {WS}++"
# What counts as part of a word at a word border.
WORD = r"\p{L}\p{N}_"
BORDER_BEFORE = rf"(?<![{WORD}])"
BORDER_AFTER = rf"(?![{WORD}])"
BORDER = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# A case-insensitive a-z also takes these four non-ASCII letters.
LETTER = r"A-Za-z\x{130}\x{131}\x{17f}\x{212a}"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WS_CHARS))


def squash(value: Column) -> Column:
    """Collapse every run of white space to one space and strip."""
    return F.trim(F.regexp_replace(value, _LOOSE_SPACE, " "))


def clean_text(value: Column) -> Column:
    return squash(F.coalesce(value, F.lit("")))


def clean_email(value: Column) -> Column:
    return F.lower(F.btrim(F.regexp_replace(value, "^mailto:", ""), F.lit(" .,:;")))


def clean_company_name(value: Column) -> Column:
    """Keep what stands before a title separator, tried in a fixed order."""
    name = squash(value)
    for separator in (" | ", " - ", " :: "):
        name = strip(F.substring_index(name, separator, 1))
    return name


def deobfuscate(value: Column, squashed: bool = False) -> Column:
    """Turn written-out email signs such as ``[at]`` or `` dot `` back into characters.

    Text that is known to be squashed meets a pattern only if a plain search finds the word.
    """

    def guarded(text: Column, test, pattern: str, sign: str) -> Column:
        return let(text, lambda t: F.when(test(t), F.regexp_replace(t, pattern, sign)).otherwise(t))

    space = " " if squashed else rf"{WS}++"
    out = value
    # Both cases are spelled out: under a case-insensitive flag the space class gets slow.
    for word, either_case, sign in (("at", "[aA][tT]", "@"), ("dot", "[dD][oO][tT]", ".")):
        for left, right in ("[]", "()"):
            pattern = rf"(?U){WS}*+\{left}{WS}*+{either_case}{WS}*+\{right}{WS}*+"
            out = guarded(out, lambda t, sign_=left: F.contains(t, F.lit(sign_)), pattern, sign)
        pattern = f"(?U){space}{either_case}{space}"
        if squashed:
            out = guarded(out, lambda t, w=word: F.contains(F.lower(t), F.lit(f" {w} ")), pattern, sign)
        else:
            out = F.regexp_replace(out, pattern, sign)
    return out


def normalize_label(value: Column) -> Column:
    edge = F.lit(" -:|")
    label = F.btrim(F.regexp_replace(value, _LOOSE_SPACE, " "), edge)
    label = F.regexp_replace(
        label,
        rf"(?i){BORDER_BEFORE}(?:Learn More|Read More|View More|More){BORDER_AFTER}",
        "",
    )
    return F.btrim(F.regexp_replace(label, _LOOSE_SPACE, " "), edge)


def title_case(value: Column) -> Column:
    """Capital at the start of every run of cased letters, lower case elsewhere."""
    cased = r"\p{Lu}\p{Ll}\p{Lt}"
    runs = F.regexp_extract_all(value, F.lit(rf"[{cased}]+|[^{cased}]+"), F.lit(0))
    return F.array_join(
        F.transform(
            runs,
            lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(r.substr(F.lit(2), F.length(r)))),
        ),
        "",
    )


def name_key(value: Column) -> Column:
    """Dedup key of a business name; blank gives NULL so that it matches nothing."""
    return F.nullif(F.lower(strip(value)), F.lit(""))


def blank_to_empty(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def elapsed(seconds: Column) -> Column:
    """Display text of a duration."""
    minutes = F.floor(seconds / 60).cast("int")
    rest = (F.floor(seconds).cast("long") % 60).cast("int")
    return F.when(minutes > 0, F.format_string("%d min %d sec", minutes, rest)).otherwise(
        F.format_string("%d seconds", rest)
    )


def stamp(value: Column, minutes_only: bool = False) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm" if minutes_only else "yyyy-MM-dd HH:mm:ss")
