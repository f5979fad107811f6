"""URL functions: parsing by one RFC 3986 pattern, resolving, comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions.arrays import let, running
from leadloom.functions.text import strip, title_case

_SCHEME = r"^[\x00-\x20]*+([A-Za-z][A-Za-z0-9+.-]*):"
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?\z"
# Schemes whose references are resolved against a base of the same scheme.
_RELATIVE = (
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)


def has_scheme(url: Column) -> Column:
    return url.rlike(_SCHEME)


def normalize_url(url: Column) -> Column:
    return F.when(has_scheme(url), url).otherwise(F.concat(F.lit("https://"), url))


def url_parts(url: Column) -> Column:
    """STRUCT(scheme, netloc, path, query, fragment); absent parts are empty strings."""
    part = lambda i: F.regexp_extract(url, _PARTS, i)
    return F.struct(
        F.lower(part(1)).alias("scheme"),
        part(2).alias("netloc"),
        part(3).alias("path"),
        part(4).alias("query"),
        part(5).alias("fragment"),
    )


def build_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    """Inverse of ``url_parts``; empty query and fragment leave no mark."""

    def with_authority(p: Column) -> Column:
        rootless = (p != "") & ~p.startswith("/")
        return F.when(
            netloc != "", F.concat(F.lit("//"), netloc, F.when(rootless, F.lit("/")).otherwise(F.lit("")), p)
        ).when(p.startswith("//") | ~rootless & scheme.isin(*_RELATIVE), F.concat(F.lit("//"), p)).otherwise(p)

    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        let(path, with_authority),
        let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def candidate_urls(url: Column) -> Column:
    """Addresses to try for a website, in order: https first, then plain http."""
    return let(
        normalize_url(url),
        lambda u: let(
            url_parts(u),
            lambda p: F.when(
                p["scheme"] == "https",
                F.array(u, build_url(F.lit("http"), p["netloc"], p["path"], p["query"], p["fragment"])),
            ).otherwise(F.array(u)),
        ),
    )


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def _site(url: Column) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")


def same_site(left: Column, right: Column) -> Column:
    return _site(left) == _site(right)


def _without_last(items: Column) -> Column:
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - 1, F.lit(0)))


def _resolve_path(base_path: Column, path: Column) -> Column:
    """Merge a reference path with the base path and drop dot segments."""
    # Without its file name a base path keeps an end slash that the merge may drop.
    kept_base = let(
        F.split(base_path, "/"), lambda b: F.when(base_path.endswith("/") | (base_path == ""), b).otherwise(_without_last(b))
    )
    merged = let(
        F.concat(kept_base, F.split(path, "/")),
        lambda s: F.filter(s, lambda x, i: (i == 0) | (i == F.size(s) - 1) | (x != "")),
    )

    def resolved(segments: Column) -> Column:
        # From the end: a name goes for each ".." that is still open.
        def climbed(from_last: Column) -> Column:
            opened = running(
                from_last,
                F.lit(0),
                lambda n, x: F.when(x == "..", n + 1).when(x == ".", n).otherwise(F.greatest(n - 1, F.lit(0))),
            )
            return let(
                opened,
                lambda o: F.filter(from_last, lambda x, i: ~x.isin(".", "..") & (F.coalesce(F.get(o, i - 1), F.lit(0)) == 0)),
            )

        kept = F.when(
            F.array_contains(segments, ".."), F.reverse(let(F.reverse(segments), climbed))
        ).otherwise(F.filter(segments, lambda x: x != "."))
        ends_on_folder = F.get(segments, F.size(segments) - 1).isin(".", "..")
        folder = F.when(ends_on_folder, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
        return let(
            F.array_join(F.concat(kept, folder), "/"),
            lambda p: F.when(p == "", F.lit("/")).otherwise(p),
        )

    return let(F.when(path.startswith("/"), F.split(path, "/")).otherwise(merged), resolved)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on the page ``base`` (RFC 3986 with kept spaces)."""

    def against(b: Column, h: Column, bp: Column, hp: Column) -> Column:
        own_host = hp["netloc"] != ""
        same_document = hp["path"] == ""
        path = (
            F.when(own_host, hp["path"]).when(same_document, bp["path"]).otherwise(_resolve_path(bp["path"], hp["path"]))
        )
        query = F.when(own_host | ~same_document | (hp["query"] != ""), hp["query"]).otherwise(bp["query"])
        foreign = (hp["scheme"] != "") & (hp["scheme"] != bp["scheme"])
        return (
            F.when(h == "", b)
            .when((b == "") | foreign | ((bp["scheme"] != "") & ~bp["scheme"].isin(*_RELATIVE)), h)
            .otherwise(
                build_url(
                    bp["scheme"], F.when(own_host, hp["netloc"]).otherwise(bp["netloc"]), path, query, hp["fragment"]
                )
            )
        )

    return let(
        base,
        lambda b: let(
            F.regexp_replace(href, r"^[\x00-\x20]+|[\t\r\n]", ""),
            lambda h: let(url_parts(b), lambda bp: let(url_parts(h), lambda hp: against(b, h, bp, hp))),
        ),
    )


def website_key(url: Column) -> Column:
    """Comparison form of a website: no scheme, one leading www., query, fragment or end slash.

    The path stays, so two pages of one host are two keys.
    """
    key = F.lower(strip(url))
    key = F.regexp_replace(key, r"^https?://", "")
    key = F.regexp_replace(key, r"^www\.", "")
    key = F.regexp_replace(key, r"(?s)[?#].*\z", "")
    return F.regexp_replace(key, r"/++\z", "")


def site_key(url: Column) -> Column:
    """Dedup key of a website; blank gives NULL so that it matches nothing."""
    return F.nullif(website_key(url), F.lit(""))


def host_name_label(url: Column) -> Column:
    """Company name guessed from the host; NULL without a host."""
    host = F.regexp_replace(netloc(url), r"www\.", "")
    label = F.regexp_replace(F.substring_index(host, ".", 1), "-", " ")
    return F.when(host != "", title_case(label))


def facebook_about_url(url: Column) -> Column:
    """The about page of a Facebook address; NULL for blank input."""
    about = let(
        url_parts(F.regexp_replace(strip(url), r"/++\z", "")),
        lambda p: F.concat(
            F.regexp_replace(F.concat(p["scheme"], F.lit("://"), p["netloc"], p["path"]), r"/++\z", ""),
            F.lit("/about"),
        ),
    )
    return F.when(url != "", about)


def linkedin_candidates(url: Column) -> Column:
    return F.when(
        url != "",
        let(
            F.regexp_replace(strip(url), r"/++\z", ""),
            lambda u: F.array(u, F.concat(u, F.lit("/about"))),
        ),
    ).otherwise(F.array().cast("array<string>"))


def contact_guess(url: Column) -> Column:
    return resolve_url(url, F.lit("/contact"))


def search_key(query: Column, location: Column) -> Column:
    """Form-encoded search text of a query in a location."""
    encoded = F.url_encode(strip(F.concat_ws(" ", query, location)))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def unquote(value: Column) -> Column:
    """Decode percent escapes; ``+`` stays, broken escapes leave the text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
