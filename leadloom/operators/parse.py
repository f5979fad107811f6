"""HTML pages to parsed columns, without a shuffle.

A page is one row, so all its state lives in one task anyway. The tokens of a page are an
array, and every structure is read from positions in that array:

* a link is a pair (open, close) that is adjacent in the sub-sequence of link tokens;
* a heading or list item is the part of the page between its start and the first matching
  end tag before the next such start;
* hidden and navigation regions come from a clamped depth that is folded over the region
  tags only.

Slices are disjoint, so the work grows with the page, and the parse stays a narrow stage that
runs where the page was read.
"""

from __future__ import annotations

from collections.abc import Callable
from encodings.aliases import aliases

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadloom.functions.arrays import last, let, run_ends, run_starts, running
from leadloom.functions.entities import name_table, unescape
from leadloom.functions.once import once_per_application
from leadloom.functions.text import squash, strip

# Possessive groups only: java.util.regex recurses per iteration of a plain group, which
# would overflow the stack on long tags.
_ATTRS = r"""(?:[^=>/]++|/(?!>)|=+\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+))*+"""
_RAW_TEXT = "|".join(
    rf"<{tag}(?=[\s/>]){_ATTRS}>(?s:.*?)(?:</\s*+{tag}\s*+>|\z)" for tag in ("script", "style")
)
_MARKUP = "|".join(
    [
        _RAW_TEXT,
        rf"<[a-z]{_ATTRS}/?>",
        r"</[^>]*+>",
        r"<!--(?s:.*?)--\s*+>",
        r"<!\[\s*+(?:temp|cdata|ignore|include|rcdata)(?s:.*?)\]\s*+\]\s*+>",
        r"<!\[\s*+(?:if|else|endif)(?s:.*?)\]\s*+>",
        r"<!(?!--|\[)[^>]*+>",
        r"<\?[^>]*+>",
    ]
)
# Markup that never closes is text: up to the next >, else up to the next <, else one <.
TOKEN = rf"(?i){_MARKUP}|<[a-z/!?][^>]*+>|<[a-z/!?][^<]*+(?=<)|[^<]++|<"
_IS_MARKUP = rf"(?i)^(?:{_MARKUP})\z"
_SELF_CLOSED = rf"(?i)^<[a-z]{_ATTRS}/>\z"
_ATTR = r"""(?<=['"\s/])[^\s/>][^\s/=>]*+(?:\s*+=+\s*+(?:'[^']*+'|"[^"]*+"|(?!['"])[^>\s]*+))?"""
_ATTR_NAME = r"^([^\s/>][^\s/=>]*+)"
_ATTR_VALUE = r"(?s)^[^\s/>][^\s/=>]*+\s*+=+\s*+(.*)\z"

# The tags that carry meaning.
HIDDEN_TAGS = ("script", "style", "noscript", "template", "svg")
NAV_TAGS = ("nav", "header")
HEADINGS = ("h1", "h2", "h3", "h4")
PARSED = ("text", "plain_text", "title", "text_parts", "links", "hrefs", "meta", "elements")
ELEMENT_TAGS = (*HEADINGS, "li")
_UNSEEN_TAGS = ("template", "rt", "rp")  # text that a plain text dump of the page leaves out
_START_TAGS = ("a", "meta", "title", *ELEMENT_TAGS, *NAV_TAGS, "noscript", "template", "svg", "rt", "rp")
_END_TAGS = (*_START_TAGS, "script", "style")
_RELEVANT = (
    rf"(?i)^<(?:(?:{'|'.join(_START_TAGS)})(?=[\s/>])|/\s*+(?:{'|'.join(_END_TAGS)})(?=[\s/>])|(?![a-z/!?]))"
)

_TEXT = "#"
_NAV_LINK = "a+"


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def _raw_attribute(tag: Column, name: str) -> Column:
    """Undecoded value of an attribute in a start tag; empty if absent, last one wins."""
    found = last(
        F.filter(
            F.regexp_extract_all(tag, F.lit(_ATTR), F.lit(0)),
            lambda a: F.lower(F.regexp_extract(a, _ATTR_NAME, 1)) == name,
        )
    )
    return let(
        F.coalesce(F.regexp_extract(found, _ATTR_VALUE, 1), F.lit("")),
        lambda raw: F.when(
            (F.length(raw) > 1)
            & F.substring(raw, 1, 1).isin("'", '"')
            & (F.substring(raw, 1, 1) == F.substring(raw, -1, 1)),
            raw.substr(F.lit(2), F.length(raw) - 2),
        ).otherwise(raw),
    )


def attributes(tag: Column, *attrs: str, names: Column | None = None) -> Column:
    """ARRAY of the decoded values of the given attributes."""
    if names is None:
        return let(name_table(), lambda bound: attributes(tag, *attrs, names=bound))
    return F.transform(F.array(*[_raw_attribute(tag, a) for a in attrs]), lambda v: unescape(v, names))


def _event(kind: Column, value: Column, dump: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), dump.alias("dump"))


def _is_markup(token: Column) -> Column:
    """Markup as against text; only tokens that could be malformed meet the full pattern."""
    plain_tag = token.endswith(">") & ~F.contains(token, F.lit("=")) & ~token.startswith("<!")
    return token.startswith("<") & (token != "<") & (plain_tag | token.rlike(_IS_MARKUP))


def _token_events(token: Column) -> Column:
    none = F.lit(None).cast("string")

    def tag_events(tag: Column) -> Column:
        value = F.when(tag == "a", _raw_attribute(token, "href")).when(tag == "meta", token)
        end = _event(F.concat(F.lit("/"), tag), none, none)
        return F.when(token.startswith("</"), F.array(end)).otherwise(
            let(
                _event(tag, value, none),
                lambda start: F.when(
                    token.endswith("/>") & token.rlike(_SELF_CLOSED), F.array(start, end)
                ).otherwise(F.array(start)),
            )
        )

    return F.when(~_is_markup(token), F.array(_event(F.lit(_TEXT), token, none))).otherwise(
        let(F.lower(F.regexp_extract(token, r"^</?\s*+([a-zA-Z][a-zA-Z0-9]*+)", 1)), tag_events)
    )


def _decoded(events: Column, names: Column) -> Column:
    """Decode references: hrefs and the plain dump once, the page text twice."""

    def decode(event: Column) -> Column:
        passes = F.when(event["kind"] == _TEXT, 2).when(event["kind"] == "a", 1).otherwise(0)
        stages = F.aggregate(
            F.when(passes > 0, F.sequence(F.lit(1), passes)).otherwise(F.array().cast("array<int>")),
            F.struct(event["value"].alias("value"), event["value"].alias("dump")),
            lambda acc, i: let(
                unescape(acc["value"], names),
                lambda v: F.struct(v.alias("value"), F.when(i == 1, v).otherwise(acc["dump"]).alias("dump")),
            ),
        )
        return let(
            stages,
            lambda s: _event(
                event["kind"], F.when(event["kind"] == _TEXT, strip(s["value"])).otherwise(s["value"]), s["dump"]
            ),
        )

    return F.transform(events, decode)


def _events(html: Column, names: Column) -> Column:
    """Page as an array of text, link, meta, heading and region events in page order."""
    relevant = F.filter(
        tokens(html), lambda t: ~t.startswith("<") | t.rlike(_RELEVANT) | ~_is_markup(t)
    )
    return F.filter(
        _decoded(F.flatten(F.transform(relevant, _token_events)), names),
        lambda e: ~e["kind"].isin(_TEXT, "a") | (e["value"] != ""),
    )


def _positions(events: Column, kinds: tuple[str, ...]) -> Column:
    return F.filter(
        F.transform(events, lambda e, i: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), i.alias("at"))),
        lambda p: p["kind"].isin(*kinds),
    )


def _in_regions(events: Column, tags: tuple[str, ...], change: Callable[[Column], Column]) -> Column:
    """Apply ``change`` to the parts of the page that lie inside any of ``tags``.

    The depth never falls below zero: a stray end tag is ignored.
    """

    def split_at(marks: Column) -> Column:
        depths = running(
            marks, F.lit(0), lambda depth, m: F.greatest(depth + F.when(m["kind"].startswith("/"), -1).otherwise(1), F.lit(0))
        )

        def part(j: Column, depth: Column) -> Column:
            begin = F.coalesce(F.get(marks, j - 1)["at"], F.lit(0))
            end = F.coalesce(F.get(marks, j)["at"], F.size(events))
            return let(
                F.slice(events, begin + 1, end - begin),
                lambda seg: F.when(F.coalesce(F.get(depth, j - 1), F.lit(0)) > 0, change(seg)).otherwise(seg),
            )

        return let(
            depths,
            lambda depth: F.flatten(F.transform(F.sequence(F.lit(0), F.size(marks)), lambda j: part(j, depth))),
        )

    kinds = tuple(k for t in tags for k in (t, "/" + t))
    return let(
        _positions(events, kinds),
        lambda marks: F.when(F.size(marks) == 0, events).otherwise(split_at(marks)),
    )


def _drop_text(events: Column) -> Column:
    return F.filter(events, lambda e: e["kind"] != _TEXT)


def _mark_nav_links(events: Column) -> Column:
    return F.transform(
        events,
        lambda e: _event(F.when(e["kind"] == "a", F.lit(_NAV_LINK)).otherwise(e["kind"]), e["value"], e["dump"]),
    )


def _texts(events: Column) -> Column:
    return F.transform(F.filter(events, lambda e: e["kind"] == _TEXT), lambda e: e["value"])


def _joined_text(events: Column) -> Column:
    return squash(F.array_join(_texts(events), " "))


def _with_next(positions: Column) -> Column:
    return F.transform(positions, lambda p, i: F.struct(p.alias("here"), F.get(positions, i + 1).alias("next")))


def _between(events: Column, pair: Column) -> Column:
    end = F.coalesce(pair["next"]["at"], F.size(events))
    return F.slice(events, pair["here"]["at"] + 2, F.greatest(end - pair["here"]["at"] - 1, F.lit(0)))


def _links(events: Column) -> Column:
    pairs = let(_positions(events, ("a", _NAV_LINK, "/a")), _with_next)
    closed = F.filter(pairs, lambda p: (p["here"]["kind"] != "/a") & (p["next"]["kind"] == "/a"))
    return F.transform(
        closed,
        lambda p: F.struct(
            p["here"]["value"].alias("href"),
            _joined_text(_between(events, p)).alias("text"),
            (p["here"]["kind"] == _NAV_LINK).alias("in_nav"),
        ),
    )


def _title(events: Column) -> Column:
    pairs = F.filter(
        let(_positions(events, ("title", "/title")), _with_next), lambda p: p["here"]["kind"] == "title"
    )
    parts = F.flatten(F.transform(pairs, lambda p: _texts(_between(events, p))))
    return F.nullif(squash(F.array_join(parts, " ")), F.lit(""))


def _elements(events: Column) -> Column:
    """Texts of headings and list items; a new start replaces the one that is open."""
    pairs = let(_positions(events, ("title", *ELEMENT_TAGS)), _with_next)

    def element(pair: Column) -> Column:
        tag = pair["here"]["kind"]
        return let(
            _between(events, pair),
            lambda seg: let(
                F.array_position(F.transform(seg, lambda e: e["kind"]), F.concat(F.lit("/"), tag)).cast("int"),
                lambda end: F.struct(
                    tag.alias("tag"),
                    F.when(end > 0, _joined_text(F.slice(seg, F.lit(1), F.greatest(end - 1, F.lit(0))))).alias("text"),
                ),
            ),
        )

    return F.filter(
        F.transform(F.filter(pairs, lambda p: p["here"]["kind"] != "title"), element),
        lambda e: F.coalesce(e["text"], F.lit("")) != "",
    )


def _meta(events: Column, names: Column) -> Column:
    """Meta entries by first appearance of the key, each with its last content."""

    def entry(tag: Column) -> Column:
        return let(
            attributes(tag, "property", "name", "content", names=names),
            lambda v: F.struct(
                F.lower(F.when(F.get(v, F.lit(0)) != "", F.get(v, F.lit(0))).otherwise(F.get(v, F.lit(1)))).alias("key"),
                F.get(v, F.lit(2)).alias("content"),
            ),
        )

    def by_key(sorted_entries: Column) -> Column:
        # Both lists have one entry per key, in the same order.
        return let(
            run_ends(sorted_entries, "key"),
            lambda ends: F.transform(
                run_starts(sorted_entries, "key"),
                lambda e, j: F.struct(e["at"].alias("at"), e["key"].alias("key"), F.get(ends, j)["content"].alias("content")),
            ),
        )

    tags = F.filter(events, lambda e: e["kind"] == "meta")
    entries = F.filter(
        F.transform(tags, lambda e: entry(e["value"])), lambda m: (m["key"] != "") & (m["content"] != "")
    )
    placed = F.transform(
        entries, lambda m, i: F.struct(m["key"].alias("key"), i.alias("at"), m["content"].alias("content"))
    )
    return F.transform(
        F.array_sort(let(F.array_sort(placed), by_key)),
        lambda m: F.struct(m["key"].alias("key"), squash(m["content"]).alias("content")),
    )


def parsed_page(html: Column, columns: tuple[str, ...] = PARSED) -> Column:
    """STRUCT with the wanted parsed columns."""

    def build(events: Column, names: Column) -> Column:
        def dump() -> Column:
            shown = F.filter(_in_regions(events, _UNSEEN_TAGS, _drop_text), lambda e: e["kind"] == _TEXT)
            # White space never matters for what is read from the dump.
            return squash(F.array_join(F.transform(shown, lambda e: e["dump"]), " "))

        def from_seen(seen: Column) -> Column:
            build_column = {
                "text": lambda: _joined_text(seen),
                "plain_text": dump,
                "title": lambda: _title(seen),
                "text_parts": lambda: _texts(seen),
                "links": lambda: _links(seen),
                "hrefs": lambda: F.transform(F.filter(events, lambda e: e["kind"] == "a"), lambda e: e["value"]),
                "meta": lambda: _meta(events, names),
                "elements": lambda: _elements(seen),
            }
            return F.struct(*[build_column[c]().alias(c) for c in columns])

        return let(
            _in_regions(events, HIDDEN_TAGS, _drop_text),
            lambda visible: let(_in_regions(visible, NAV_TAGS, _mark_nav_links), from_seen),
        )

    return let(name_table(), lambda names: let(_events(html, names), lambda events: build(events, names)))


def charset_key(name: Column) -> Column:
    """A charset's name in the form that codecs are listed by."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_")


def declared_charset(content_type: Column) -> Column:
    """The charset that a Content-Type header names, else null."""
    return F.nullif(F.regexp_extract(content_type, r"(?i);\s*charset\s*=\s*[\"']?([^\s;\"']+)", 1), F.lit(""))


def sniffed_charset(raw: Column) -> Column:
    """The charset that a byte-order mark or a meta tag near the start names, else null."""
    head = F.decode(F.substring(raw, 1, 1024), "ISO-8859-1")
    meta = F.nullif(F.regexp_extract(head, r"(?i)<meta[^>]+charset\s*=\s*[\"']?([^\s\"'/>;]+)", 1), F.lit(""))
    return F.when(head.startswith("\xef\xbb\xbf"), "utf-8").when(head.startswith("\xff\xfe") | head.startswith("\xfe\xff"), "utf-16").otherwise(meta)


def _codecs() -> tuple[dict[str, str], dict[str, str]]:
    """Names of charsets: those of one byte per character beyond ASCII with their characters 128 to 255, others with their codec."""
    one_byte, others = {}, {}
    for module in sorted(set(aliases.values())):
        names = [module, *(a for a, m in aliases.items() if m == module)]
        try:
            text = bytes(range(256)).decode(module, "replace")
        except (LookupError, UnicodeError):  # not a charset
            continue
        high = text[128:]
        if len(text) == 256 and text[:128] == bytes(range(128)).decode() and (module == "ascii" or set(high) != {"\ufffd"}):
            one_byte |= {name.lower(): high for name in names}
        elif module.startswith(("utf_16", "utf_32", "shift_jis", "euc_", "gb", "big5", "cp9", "iso2022")):
            others |= {name.lower(): module for name in names}
    return one_byte, others


@once_per_application
def _one_byte_tables() -> Column:
    return F.create_map(*[F.lit(x) for item in _codecs()[0].items() for x in item])


def _by_codec(raw: Column, charset: Column) -> Column:
    """Text of the rows whose charset has several bytes per character, null for others; runs in Python."""
    codecs = _codecs()[1]

    @F.pandas_udf("string")
    def decoded(raw: pd.Series, name: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(codecs[n], "replace") for b, n in zip(raw, name, strict=True)], dtype=object)

    key = charset_key(charset)
    return decoded(F.when(key.isin(sorted(codecs)), raw), key)


def decode_html(raw: Column, charset: Column | None = None, multibyte: bool = False) -> Column:
    """Binary pages as text; bytes that are wrong in their charset become replacement characters.

    Without a charset, or with an unknown one, a page is UTF-8. Charsets of one byte per character
    stay in column functions. ``multibyte`` also takes UTF-16, UTF-32 and the East Asian ones,
    which run in Python; without it pages in these are read as UTF-8.
    """
    utf8 = F.make_valid_utf8(raw.cast("string"))
    if charset is None:
        return utf8
    table = F.try_element_at(_one_byte_tables(), F.coalesce(charset_key(charset), F.lit("")))
    high = "".join(map(chr, range(128, 256)))
    one_byte = F.call_function("translate", F.decode(raw, "ISO-8859-1"), F.lit(high), table)
    text = F.when(table.isNotNull(), one_byte).otherwise(utf8)
    return F.coalesce(_by_codec(raw, charset), text) if multibyte else text


def page_tokens(pages: DataFrame) -> DataFrame:
    """One row per token: (page_id, pos, token)."""
    return pages.select("page_id", F.posexplode(tokens(F.col("html"))).alias("pos", "token"))


@once_per_application
def _parsed_columns() -> Column:
    return F.inline(F.array(parsed_page(F.col("html"))))


def parse_pages(pages: DataFrame, *columns: str) -> DataFrame:
    """Pages with the html replaced by its parsed columns, all of them or the named ones.

    The struct passes through a generator, which keeps the optimizer from copying the parse
    expression into several consumers or into a pushed-down filter.
    """
    kept = [c for c in pages.columns if c != "html"]
    parsed = F.inline(F.array(parsed_page(F.col("html"), columns))) if columns else _parsed_columns()
    return pages.select(*kept, parsed)
