"""DuckDB SQL that checks the Spark queries.

Written independently of the Spark expressions: pages are a token table with window
functions, the dedup rule is a loop over the ordered rows as a recursive query.
"""

from __future__ import annotations

from checks.spark_queries import HREFS
from checks.views import VIEWS, with_views
from leadloom.functions import patterns as P
from leadloom.operators.routing import BATCH_FIELDS, SCRAPED_FIELDS, SIMPLE_FIELDS

WS = r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LETTER = r"A-Za-z\x{130}\x{131}\x{17f}\x{212a}"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- scalar expressions -------------------------------------------------------------------


def replace_all(x: str, pattern: str, by: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, {q(flags)})"


def strip(x: str) -> str:
    return replace_all(x, rf"^{WS}+|{WS}+$", "")


def squash(x: str) -> str:
    return f"trim({replace_all(x, WS + '+', ' ')}, ' ')"


def clean_email(x: str) -> str:
    return f"lower(trim(regexp_replace({x}, '^mailto:', ''), ' .,:;'))"


def clean_name(x: str) -> str:
    out = squash(x)
    for sep in (" | ", " - ", " :: "):
        out = strip(f"split_part({out}, {q(sep)}, 1)")
    return out


def deobfuscate(x: str) -> str:
    for word, sign in (("at", "@"), ("dot", ".")):
        for pattern in (
            rf"(?i){WS}*\[{WS}*{word}{WS}*\]{WS}*",
            rf"(?i){WS}*\({WS}*{word}{WS}*\){WS}*",
            rf"(?i){WS}+{word}{WS}+",
        ):
            x = replace_all(x, pattern, sign)
    return x


def normalize_label(x: str) -> str:
    x = f"trim({replace_all(x, WS + '+', ' ')}, ' -:|')"
    for _ in range(2):  # a border character is consumed, so neighbours need a second pass
        x = replace_all(x, r"(?i)(^|[^\p{L}\p{N}_])(?:learn more|read more|view more|more)($|[^\p{L}\p{N}_])", r"\1\2")
    return f"trim({replace_all(x, WS + '+', ' ')}, ' -:|')"


def website_key(x: str) -> str:
    x = f"lower({strip(x)})"
    x = f"regexp_replace({x}, '^https?://', '')"
    x = f"regexp_replace({x}, '^www\\.', '')"
    x = f"regexp_replace({x}, '(?s)[?#].*$', '')"
    return f"regexp_replace({x}, '/+$', '')"


def name_key(x: str) -> str:
    return f"nullif(lower({strip(x)}), '')"


def site_key(x: str) -> str:
    return f"nullif({website_key(x)}, '')"


def unescape(x: str) -> str:
    """The references that occur in the inputs; the ampersand goes last."""
    for ref, char in (
        ("&middot;", "·"), ("&copy;", "©"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&eacute;", "é"),
        ("&#8212;", "—"), ("&#x20AC;", "€"), ("&hellip;", "…"), ("&copy", "©"), ("&not", "¬"),
        ("&amp;", "&"), ("&AMP;", "&"),
    ):
        x = f"replace({x}, {q(ref)}, {q(char)})"
    # Without a semicolon only where no semicolon follows.
    return replace_all(x, r"&amp", "&")


def has_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def isin(x: str, words) -> str:
    return f"{x} IN ({', '.join(q(w) for w in words)})"


def unique_ci(x: str) -> str:
    return (
        f"list_filter({x}, lambda uv, ui: list_position(list_transform({x}, lambda ul: lower(ul)), lower(uv)) = ui)"
    )


def text_of(x: str) -> str:
    return f"coalesce(array_to_string({x}, '|'), '')"


EMAIL = rf"\b[{LETTER}0-9._%+-]+@[{LETTER}0-9.-]+\.[{LETTER}]{{2,}}\b"
LOOSE = rf"[{LETTER}0-9_.-]+@[{LETTER}0-9_.-]+[.][{LETTER}0-9_]+"
GAP = WS[:-1] + r".-]?"
PHONE = rf"\+?\b(?:\p{{Nd}}{{1,3}}{GAP})?\(?\p{{Nd}}{{2,5}}\)?{GAP}\p{{Nd}}{{3,4}}{GAP}\p{{Nd}}{{3,9}}\b"
HINT = r"(?i)(^|[^\p{L}\p{N}_])(?:" + "|".join(P.SERVICE_HINTS) + r")($|[^\p{L}\p{N}_])"


def is_hint(x: str) -> str:
    return f"(NOT {isin(f'lower({x})', P.SKIP_LABELS)} AND regexp_matches({x}, {q(HINT)}))"


def service_noun(x: str) -> str:
    calls = "|".join(P.CALLS_TO_ACTION)
    return f"(NOT contains({x}, '?') AND NOT regexp_matches({strip(x)}, {q('(?i)^(?:' + calls + ')')}))"


def likely(x: str) -> str:
    low = f"lower({x})"
    return (
        f"(NOT {isin(low, P.SKIP_LABELS)} AND NOT {has_any(low, P.SERVICE_NOISE)} AND NOT {has_any(low, P.COPYRIGHT_MARKS)}"
        f" AND length({x}) BETWEEN 3 AND 80 AND NOT regexp_matches({x}, {q(EMAIL)}) AND regexp_matches({x}, '[A-Za-z]{{3,}}'))"
    )


def categories(x: str) -> str:
    rules = ", ".join(
        f"CASE WHEN list_contains(list_transform({x}, lambda g{i}: {has_any(f'lower(g{i})', words)}), true) THEN {q(name)} END"
        for i, (name, words) in enumerate(P.SERVICE_CATEGORIES.items())
    )
    words = [w for ws in P.SERVICE_CATEGORIES.values() for w in ws]
    return (
        f"list_concat(list_filter([{rules}], lambda gc: gc IS NOT NULL), list_filter({x}, lambda gu: NOT {has_any('lower(gu)', words)}))"
    )


def attr(tag: str, name: str) -> str:
    pattern = q(rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\"'>\s][^>\s]*))".replace('\\"', '"'))
    return unescape("concat(" + ", ".join(f"regexp_extract({tag}, {pattern}, {i})" for i in (1, 2, 3)) + ")")


def missing(x: str) -> str:
    return f"(lower({strip(x)}) = '' OR {isin(f'lower({strip(x)})', P.PLACEHOLDERS)})"


# --- resolving addresses ------------------------------------------------------------------

RFC = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#((?s:.*)))?$"


def resolve(source: str, base: str, href: str, out: str) -> str:
    """Subquery: all columns of ``source`` plus the resolved address as ``out``."""
    part = lambda x, i: f"regexp_extract({x}, {q(RFC)}, {i})"
    split = ", ".join(
        [f"{part('rb', i)} AS b{n}" for i, n in ((1, "s"), (2, "n"), (3, "p"), (4, "q"))]
        + [f"{part('rh', i)} AS h{n}" for i, n in ((1, "s"), (2, "n"), (3, "p"), (4, "q"), (5, "f"))]
    )
    segs = (
        "CASE WHEN hp LIKE '/%' THEN string_split(hp, '/') ELSE list_filter(list_concat("
        "CASE WHEN string_split(bp, '/')[-1] <> '' THEN list_slice(string_split(bp, '/'), 1, len(string_split(bp, '/')) - 1) ELSE string_split(bp, '/') END,"
        " string_split(hp, '/')), lambda sv, si: sv <> '' OR si = 1 OR si = len(string_split(hp, '/')) + CASE WHEN string_split(bp, '/')[-1] <> '' THEN len(string_split(bp, '/')) - 1 ELSE len(string_split(bp, '/')) END) END"
    )
    fold = (
        "list_reduce(list_transform(segs, lambda fs: [fs]), lambda fa, fx: CASE WHEN fx[1] = '..' THEN list_slice(fa, 1, len(fa) - 1)"
        " WHEN fx[1] = '.' THEN fa ELSE list_concat(fa, fx) END, []::VARCHAR[])"
    )
    path = f"array_to_string(CASE WHEN segs[-1] IN ('.', '..') THEN list_concat({fold}, ['']) ELSE {fold} END, '/')"
    rooted = "CASE WHEN {p} <> '' AND {p} NOT LIKE '/%' THEN '/' || {p} ELSE {p} END"
    tail = lambda query, frag: f"CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END || CASE WHEN {frag} <> '' THEN '#' || {frag} ELSE '' END"
    return f"""(
SELECT * EXCLUDE (rb, rh, bs, bn, bp, bq, hs, hn, hp, hq, hf, segs), CASE
  WHEN rh = '' THEN rb
  WHEN hs <> '' AND lower(hs) <> lower(bs) THEN rh
  WHEN hn <> '' THEN lower(bs) || '://' || hn || {rooted.format(p='hp')} || {tail('hq', 'hf')}
  WHEN hp = '' THEN lower(bs) || '://' || bn || {rooted.format(p='bp')} || {tail("(CASE WHEN hq <> '' THEN hq ELSE bq END)", 'hf')}
  ELSE lower(bs) || '://' || bn || {rooted.format(p="(CASE WHEN " + path + " = '' THEN '/' ELSE " + path + " END)")} || {tail('hq', 'hf')} END AS {out}
FROM (SELECT *, {segs} AS segs FROM (SELECT *, {split} FROM (SELECT *, {base} AS rb, {href} AS rh FROM {source}) r0) r1) r2)"""


def netloc_site(x: str) -> str:
    return f"regexp_replace(lower(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www\\.', '')"


def host_label(x: str) -> str:
    host = f"replace(regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1), 'www.', '')"
    label = f"replace(split_part({host}, '.', 1), '-', ' ')"
    runs = f"regexp_extract_all({label}, '[A-Za-z]+|[^A-Za-z]+')"
    return f"CASE WHEN {host} <> '' THEN array_to_string(list_transform({runs}, lambda hr: upper(hr[1]) || lower(hr[2:])), '') END"


# --- page parse ---------------------------------------------------------------------------

TOKEN = (
    r"(?is)(<!--.*?--\s*>|<script(?:[\s/][^>]*)?>.*?(?:</\s*script\s*>|\z)|<style(?:[\s/][^>]*)?>.*?(?:</\s*style\s*>|\z)"
    r"|</[^>]*>|<[a-z](?:\"[^\"]*\"|'[^']*'|[^'\">])*>|<![^>]*>|[^<]+|<)"
).replace('\\"', '"')
SKIP = ("noscript", "template", "svg")
ELEMENTS = ("h1", "h2", "h3", "h4", "li")


def parse_ctes(source: str = "lead_pages", base: str = "url") -> dict[str, str]:
    """CTEs from pages to parts, links, meta, title, elements and page columns."""
    w = "OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    before = "OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    starts = ("title", *ELEMENTS)
    step = lambda tags, ends=(): (
        f"CASE WHEN is_tag AND NOT is_end AND NOT closed AND {isin('tag', tags)} THEN 1"
        f" WHEN is_tag AND is_end AND {isin('tag', (*tags, *ends))} THEN -1 ELSE 0 END"
    )
    return {
        "src": f"SELECT page_id, {base} AS url, html FROM {source}",
        "tok": f"SELECT page_id, unnest(l) AS t, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, regexp_extract_all(html, {q(TOKEN)}) AS l FROM src)",
        "tag0": r"SELECT *, starts_with(t, '<') AND t <> '<' AND NOT regexp_matches(t, '^<!--[^>]*[^-]>$') AS is_tag, starts_with(t, '</') AS is_end,"
        r" lower(regexp_extract(t, '^</?\s*([a-zA-Z][^\s/>]*)', 1)) AS tag, ends_with(t, '/>') AS closed FROM tok",
        "tag1": f"SELECT *, {step(SKIP, ('script', 'style'))} AS ss, {step(('nav', 'header'))} AS ns, {step(('template', 'rt', 'rp'))} AS ts,"
        f" CASE WHEN is_tag AND tag = 'a' AND NOT is_end THEN {attr('t', 'href')} END AS href,"
        f" CASE WHEN NOT is_tag THEN {unescape('t')} END AS dump FROM tag0",
        "tag2": f"SELECT *, sum(ss) {w} AS sp, sum(ns) {w} AS np, sum(ts) {w} AS tp, CASE WHEN dump IS NOT NULL THEN {strip(unescape('dump'))} END AS txt FROM tag1",
        "tag3": f"SELECT *, sp - least(0, min(sp) {w}) AS sd, np - least(0, min(np) {w}) AS nd, tp - least(0, min(tp) {w}) AS td FROM tag2",
        "ev": f"""SELECT *, txt <> '' AND sd = 0 AS seen, coalesce(href, '') <> '' AS is_link,
  last_value(CASE WHEN coalesce(href, '') <> '' THEN pos END IGNORE NULLS) {w} AS link_at,
  last_value(CASE WHEN is_tag AND NOT is_end AND {isin('tag', starts)} THEN pos END IGNORE NULLS) {w} AS el_at,
  last_value(CASE WHEN is_tag AND NOT is_end AND {isin('tag', starts)} THEN tag END IGNORE NULLS) {w} AS el_tag,
  last_value(CASE WHEN is_tag AND NOT is_end AND tag = 'title' THEN pos END IGNORE NULLS) {w} AS title_at,
  last_value(CASE WHEN is_tag AND is_end AND tag = 'title' THEN pos END IGNORE NULLS) {before} AS title_end FROM tag3""",
        "parts": "SELECT page_id, pos, txt FROM ev WHERE seen",
        "link_ends": "SELECT page_id, link_at, min(pos) AS end_at FROM ev WHERE is_tag AND is_end AND tag = 'a' AND link_at IS NOT NULL GROUP BY ALL",
        "links": f"""SELECT o.page_id, o.pos, o.href, o.nd > 0 AS in_nav, coalesce({squash("string_agg(x.txt, ' ' ORDER BY x.pos)")}, '') AS text
FROM ev o JOIN link_ends e ON e.page_id = o.page_id AND e.link_at = o.pos
LEFT JOIN ev x ON x.page_id = o.page_id AND x.link_at = o.pos AND x.seen AND x.pos < e.end_at WHERE o.is_link GROUP BY o.page_id, o.pos, o.href, o.nd""",
        "el_ends": f"SELECT page_id, el_at, min(pos) AS end_at FROM ev WHERE is_tag AND is_end AND tag = el_tag AND {isin('tag', ELEMENTS)} GROUP BY ALL",
        "elements": f"""SELECT * FROM (SELECT e.page_id, e.el_at AS pos, x.el_tag AS tag, {squash("string_agg(x.txt, ' ' ORDER BY x.pos)")} AS text
FROM el_ends e JOIN ev x ON x.page_id = e.page_id AND x.el_at = e.el_at AND x.seen AND x.pos < e.end_at GROUP BY e.page_id, e.el_at, x.el_tag) WHERE text <> ''""",
        "meta_all": f"""SELECT page_id, pos, lower(CASE WHEN {attr('t', 'property')} <> '' THEN {attr('t', 'property')} ELSE {attr('t', 'name')} END) AS key, {attr('t', 'content')} AS content
FROM ev WHERE is_tag AND NOT is_end AND tag = 'meta'""",
        "meta": f"SELECT page_id, key, min(pos) AS pos, {squash('max_by(content, pos)')} AS content FROM meta_all WHERE key <> '' AND content <> '' GROUP BY page_id, key",
        "titles": f"""SELECT page_id, {squash("string_agg(txt, ' ' ORDER BY pos)")} AS title FROM ev WHERE seen AND title_at > coalesce(title_end, -1) GROUP BY page_id""",
        "texts": f"""SELECT page_id, {squash("coalesce(string_agg(txt, ' ' ORDER BY pos) FILTER (WHERE seen), '')")} AS text,
  coalesce(string_agg(dump, ' ' ORDER BY pos) FILTER (WHERE txt <> '' AND td = 0), '') AS plain,
  coalesce(list(href ORDER BY pos) FILTER (WHERE is_link), []) AS hrefs FROM ev GROUP BY page_id""",
        "page": "SELECT s.page_id, s.url, coalesce(x.text, '') AS text, coalesce(x.plain, '') AS plain, coalesce(x.hrefs, []) AS hrefs, y.title"
        " FROM src s LEFT JOIN texts x USING (page_id) LEFT JOIN titles y USING (page_id)",
    }


def field_ctes() -> dict[str, str]:
    """CTEs with one row per page and extracted field."""
    link_text = "lower(text || ' ' || href)"
    social = ", ".join(
        f"coalesce(regexp_replace(min_by(regexp_extract(u, {q(pattern)}), pos) FILTER (WHERE regexp_matches(u, {q(pattern)})), '/+$', ''), '') AS {name},"
        f" coalesce(min(pos) FILTER (WHERE regexp_matches(u, {q(pattern)})), -1) AS {name}_at"
        for name, pattern in P.SOCIAL_URLS.items()
    )
    order = ", ".join(f"{{'at': {n}_at, 'k': {i}, 'network': {q(n)}, 'url': {n}}}" for i, n in enumerate(P.NETWORKS))
    found = f"regexp_extract_all({deobfuscate('text')} || ' ' || coalesce(hs, ''), {q('(?i)' + EMAIL)})"
    loose = f"regexp_extract_all({deobfuscate('plain')}, {q('(?i)' + LOOSE)})"
    tidy = lambda x: f"regexp_replace({strip(f'lower({x})')}, '[.,;]+$', '')"
    mailto = (
        "list_filter(list_transform(list_filter(hrefs, lambda mh: regexp_matches(mh, '(?i)^mailto:')),"
        f" lambda mt: lower({strip('regexp_replace(mt, $$^mailto:$$, $$$$)')})), lambda mc: contains(mc, '@'))"
    ).replace("$$", "'")
    digits = "regexp_replace({x}, '[^\\p{{Nd}}]', '', 'g')"
    d = digits.format(x="pn")
    phone_edge = q(P.PHONE_EDGE)
    starts = "tag IN ('h1','h2','h3','h4')"
    service = has_any("lower(text)", P.SERVICE_WORDS)
    return {
        "f_emails": f"""SELECT page_id, list_sort(list_filter(list_transform(list_distinct({found}), lambda em: {clean_email('em')}), lambda en: en <> '')) AS emails
FROM page LEFT JOIN (SELECT page_id, string_agg(href, ' ' ORDER BY pos) AS hs FROM links GROUP BY page_id) USING (page_id)""",
        "f_loose": f"SELECT page_id, list_sort(list_distinct(list_transform(list_concat({mailto}, {loose}), lambda lo: {tidy('lo')}))) AS loose, {tidy('(' + loose + ')[1]')} AS first_email FROM page",
        "f_tel": f"""SELECT page_id, list({squash("url_decode(regexp_replace(href, '^tel:', ''))")}) AS tel FROM links WHERE starts_with(lower(href), 'tel:') GROUP BY page_id""",
        "f_phones": f"""SELECT page_id, list_sort(list_distinct(list_concat(list_filter(coalesce(tel, []), lambda pe: pe <> ''),
  list_filter(list_transform(regexp_extract_all(text, {q(PHONE)}), lambda pm: trim(pm, {phone_edge})),
  lambda pn: length({d}) BETWEEN 7 AND 15 AND NOT (length({d}) = 8 AND starts_with({d}, '202')) AND NOT starts_with({d}, '0000'))))) AS phones
FROM page LEFT JOIN f_tel USING (page_id)""",
        "f_meta_loc": f"SELECT page_id, min_by({strip('content')}, pos) AS loc FROM meta WHERE {has_any('key', P.ADDRESS_META_KEYS)} AND {strip('content')} <> '' GROUP BY page_id",
        "f_text_loc": f"SELECT page_id, min_by(txt, pos) AS loc FROM parts WHERE {has_any('lower(txt)', P.ADDRESS_WORDS)} AND regexp_matches(txt, '\\p{{Nd}}') AND length(txt) > 10 AND length(txt) < 150 GROUP BY page_id",
        "f_location": "SELECT page_id, coalesce(a.loc, b.loc) AS location FROM page LEFT JOIN f_meta_loc a USING (page_id) LEFT JOIN f_text_loc b USING (page_id)",
        "rlinks": "SELECT * FROM " + resolve("(SELECT l.*, s.url FROM links l JOIN src s USING (page_id)) lr", "url", strip("href"), "u"),
        "f_soc0": f"SELECT page_id, {social} FROM rlinks GROUP BY page_id",
        "f_socials": f"""SELECT page_id, {', '.join(f"coalesce({n}, '') AS {n}" for n in P.NETWORKS)},
  CASE WHEN linkedin IS NULL THEN [] ELSE list_transform(list_sort(list_filter([{order}], lambda so: so.at >= 0)), lambda st: {{'network': st.network, 'url': st.url}}) END AS socials
FROM page LEFT JOIN f_soc0 USING (page_id)""",
        "f_name": f"""SELECT page_id, CASE WHEN coalesce(a.content, '') <> '' THEN {clean_name('a.content')} WHEN coalesce(b.content, '') <> '' THEN {clean_name('b.content')}
  WHEN coalesce(title, '') <> '' THEN {clean_name('title')} WHEN h.text IS NOT NULL THEN {clean_name('h.text')} ELSE {host_label('url')} END AS name
FROM page LEFT JOIN (SELECT page_id, content FROM meta WHERE key = 'og:site_name') a USING (page_id)
LEFT JOIN (SELECT page_id, content FROM meta WHERE key = 'application-name') b USING (page_id)
LEFT JOIN (SELECT page_id, min_by(text, pos) AS text FROM elements WHERE tag = 'h1' GROUP BY page_id) h USING (page_id)""",
        "f_contacts": f"""SELECT page_id, list(u ORDER BY pos) AS contacts FROM (
  SELECT page_id, u, pos, row_number() OVER (PARTITION BY page_id, lower(u) ORDER BY pos) AS rn FROM rlinks
  WHERE {has_any(link_text, P.CONTACT_WORDS)} AND {netloc_site('u')} = {netloc_site('url')}) WHERE rn = 1 GROUP BY page_id""",
        "f_nav": f"SELECT page_id, list(text ORDER BY pos) AS nav FROM links WHERE in_nav AND ({has_any(link_text, P.SERVICE_WORDS)} OR {is_hint('text')}) GROUP BY page_id",
        "el_state": f"""SELECT *, last_value(CASE WHEN {starts} AND {service} THEN 1 WHEN tag IN ('h1','h2') THEN 0 END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS open,
  {starts} AND {service} AS opens FROM elements""",
        "f_section": "SELECT page_id, list(text ORDER BY pos) AS section FROM el_state WHERE open = 1 AND NOT opens AND tag IN ('h3','h4','li') GROUP BY page_id",
        "f_heading": f"SELECT page_id, list(text ORDER BY pos) AS heading FROM elements WHERE tag IN ('h2','h3','h4') AND {is_hint('text')} AND {service_noun('text')} GROUP BY page_id",
        "f_labels": f"""SELECT page_id, list_filter(list_transform(list_concat(coalesce(nav, []), coalesce(section, []), coalesce(heading, [])), lambda nl: {normalize_label('nl')}),
  lambda fl: fl <> '' AND {likely('fl')}) AS labels FROM page LEFT JOIN f_nav USING (page_id) LEFT JOIN f_section USING (page_id) LEFT JOIN f_heading USING (page_id)""",
        "f_labels1": f"SELECT page_id, {unique_ci('labels')} AS labels FROM f_labels",
        "f_labels2": f"SELECT page_id, {categories('labels')} AS labels FROM f_labels1",
        "f_services": f"SELECT page_id, {unique_ci('labels')} AS services FROM f_labels2",
    }


def facts_ctes() -> dict[str, str]:
    """Facts of web pages by address, then home pages, contacts and records of all listed sites."""
    all_requests = "SELECT website, unnest(l) AS url, generate_subscripts(l, 1) - 1 AS attempt"
    social_url = lambda x: f"regexp_replace({strip(x)}, '/+$', '')"
    return {
        **parse_ctes("web_pages", "final_url"),
        **field_ctes(),
        "facts": """SELECT w.url, w.final_url, name, emails, services, phones, location, socials, coalesce(contacts, []) AS contacts, loose, first_email, crawled_at
FROM (SELECT url, final_url, crawled_at, page_id, row_number() OVER (PARTITION BY url ORDER BY page_id) AS copy FROM web_pages) w
JOIN f_name USING (page_id) JOIN f_emails USING (page_id) JOIN f_services USING (page_id) JOIN f_phones USING (page_id) JOIN f_location USING (page_id)
JOIN f_socials USING (page_id) JOIN f_loose USING (page_id) LEFT JOIN f_contacts USING (page_id) WHERE copy = 1""",
        "site": "SELECT DISTINCT website FROM listings WHERE website <> ''",
        "tries": f"{all_requests} FROM (SELECT website, CASE WHEN website LIKE 'https:%' THEN [website, 'http' || website[6:]] ELSE [website] END AS l FROM site)",
        "home": """SELECT s.website, f.* FROM site s LEFT JOIN (
  SELECT t.website AS w, f.*, row_number() OVER (PARTITION BY t.website ORDER BY t.attempt) AS rn FROM tries t JOIN facts f ON f.url = t.url) f ON f.w = s.website AND f.rn = 1""",
        "contact": "SELECT c.website, c.place, f.* FROM (SELECT website, unnest(contacts[1:3]) AS u, generate_subscripts(contacts[1:3], 1) - 1 AS place FROM home WHERE contacts IS NOT NULL) c JOIN facts f ON f.url = c.u",
        "more": """SELECT website, flatten(list(emails ORDER BY place)) AS m_emails, flatten(list(services ORDER BY place)) AS m_services, flatten(list(phones ORDER BY place)) AS m_phones,
  flatten(list(socials ORDER BY place)) AS m_socials, min_by(location, place) FILTER (WHERE coalesce(location, '') <> '') AS m_location FROM contact GROUP BY website""",
        "fold0": """SELECT website, name, url, crawled_at, list_concat(coalesce(emails, []), coalesce(m_emails, [])) AS emails, list_concat(coalesce(services, []), coalesce(m_services, [])) AS services,
  list_concat(coalesce(phones, []), coalesce(m_phones, [])) AS phones, coalesce(nullif(location, ''), m_location, '') AS location,
  list_concat(coalesce(socials, []), coalesce(m_socials, [])) AS socials FROM home LEFT JOIN more USING (website)""",
        "fold": f"""SELECT website, name, url, crawled_at, {unique_ci('emails')} AS emails, {unique_ci('services')} AS services, {unique_ci('phones')} AS phones, location,
  list_filter(socials, lambda xs, xi: list_position(list_transform(socials, lambda xt: xt.network), xs.network) = xi) AS socials FROM fold0""",
        "fb": f"""SELECT r.website, f.first_email AS e FROM (SELECT website, regexp_replace(regexp_replace({social_url('u')}, '[?#].*$', ''), '/+$', '') || '/about' AS about
  FROM (SELECT website, list_filter(socials, lambda f1: f1.network = 'facebook')[1].url AS u FROM fold WHERE len(emails) = 0 AND url IS NOT NULL) WHERE u IS NOT NULL) r
  JOIN facts f ON f.url = r.about WHERE NOT contains(lower(f.final_url), 'login') AND f.first_email IS NOT NULL""",
        "li": f"""SELECT r.website, min_by(f.first_email, r.step) AS e FROM (SELECT website, {social_url('u')} || s.suffix AS u, s.step
  FROM (SELECT website, list_filter(socials, lambda f2: f2.network = 'linkedin')[1].url AS u FROM fold WHERE len(emails) = 0 AND url IS NOT NULL), (VALUES ('', 0), ('/about', 1)) s(suffix, step) WHERE u IS NOT NULL) r
  JOIN facts f ON f.url = r.u WHERE NOT contains(lower(f.final_url), 'login') AND NOT contains(lower(f.final_url), 'authwall') AND f.first_email IS NOT NULL GROUP BY r.website""",
        "rec": "SELECT website, name, url, CASE WHEN fb.e IS NOT NULL THEN [fb.e] WHEN li.e IS NOT NULL THEN [li.e] ELSE emails END AS email, services, phones, location, socials,"
        " CASE WHEN url IS NULL THEN 'no page for ' || website ELSE NULL END AS error, CASE WHEN url IS NOT NULL THEN coalesce(strftime(crawled_at, '%Y-%m-%d %H:%M:%S'), '2024-05-06 07:08:09') END AS ts, "
        + ", ".join(
            f"coalesce(list_filter(socials, lambda k{i}: k{i}.network = {q(n)})[1].url, '') AS {n}" for i, n in enumerate(P.NETWORKS)
        )
        + " FROM fold LEFT JOIN fb USING (website) LEFT JOIN li USING (website)",
    }


# --- listings, ledger, leads --------------------------------------------------------------

NUMBER = r"((?:\p{Nd})+(?:\.\p{Nd}+)?)"
CARD_NAME = f"coalesce(list_filter(list_transform(string_split(card_text, chr(10)), lambda cl: {strip('cl')}), lambda cn: cn <> '')[1], '')"


def first_rating(labels: list[str], star: str) -> str:
    numbers = "[" + ", ".join(f"regexp_extract(replace({t}, ',', ''), {q(NUMBER)}, 1)" for t in labels) + "]"
    return (
        f"coalesce(list_filter({numbers}, lambda rn: try_cast(rn AS DOUBLE) > 0 AND try_cast(rn AS DOUBLE) <= 5)[1],"
        f" regexp_extract({star}, {q(NUMBER)}, 1), '')"
    )


def cards_cte(limit: int | None = None) -> str:
    return f"""SELECT *, {CARD_NAME} AS card_name FROM (SELECT *, row_number() OVER (PARTITION BY location_ord ORDER BY card_ord) AS rk FROM
  (SELECT *, row_number() OVER (PARTITION BY location_ord, maps_url ORDER BY card_ord) AS cp FROM listings) WHERE cp = 1) WHERE {f"rk <= {limit}" if limit else "true"}"""


def dedup_ctes(source: str) -> dict[str, str]:
    """Row by row in order, with the keys seen on kept rows in two lists."""
    return {
        "ordered": f"SELECT *, row_number() OVER (ORDER BY location_ord, card_ord) AS rn, {name_key('business_name')} AS nk, {site_key('website')} AS sk FROM {source}",
        "walk(rn, keep, names, sites)": """SELECT 0::BIGINT, false, []::VARCHAR[], []::VARCHAR[] UNION ALL
SELECT o.rn, NOT dup, CASE WHEN dup OR nk IS NULL THEN names ELSE list_append(names, nk) END, CASE WHEN dup OR sk IS NULL THEN sites ELSE list_append(sites, sk) END
FROM (SELECT o.rn, w.names, w.sites, o.nk, o.sk, coalesce(list_contains(w.names, o.nk), false) OR coalesce(list_contains(w.sites, o.sk), false) AS dup FROM walk w JOIN ordered o ON o.rn = w.rn + 1) o""",
        "kept": "SELECT o.* FROM ordered o JOIN walk w ON w.rn = o.rn WHERE w.keep",
    }


def lead_ctes() -> dict[str, str]:
    return {
        "cards": cards_cte(),
        "collected": f"""SELECT listing_id, location_ord, card_ord, {squash('business_name')} AS business_name, maps_url, website, {first_rating(['rating_label'], 'NULL')} AS rating,
  coalesce(nullif(regexp_replace(review_label, '[^\\p{{Nd}}]', '', 'g'), ''), '') AS review_count, search_location, card_name FROM cards WHERE website LIKE 'http%'""",
        "known": f"SELECT DISTINCT kind, CASE WHEN kind = 'site' THEN {website_key('key')} ELSE key END AS key FROM ledger",
        "fresh": f"""SELECT * FROM collected c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = 'name' AND k.key = {name_key('c.business_name')})
  AND NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = 'site' AND k.key = {site_key('c.website')})""",
    }


def enriched_ctes(source: str = "fresh") -> dict[str, str]:
    values = {
        "company_name": "coalesce(r.name, '')",
        "email": "coalesce(array_to_string(r.email, ', '), '')",
        "phone": "coalesce(array_to_string(r.phones, ', '), '')",
        "location": "coalesce(r.location, '')",
        "services": "coalesce(array_to_string(r.services, ', '), '')",
        **{n: f"coalesce(r.{n}, '')" for n in ("instagram", "facebook", "linkedin", "twitter", "youtube", "tiktok")},
        "error": "coalesce(r.error, '')",
        "scraped_at": "coalesce(r.ts, '')",
    }
    return {
        **facts_ctes(),
        **lead_ctes(),
        "leads": f"SELECT c.*, {', '.join(f'{v} AS {k}' for k, v in values.items())} FROM {source} c LEFT JOIN rec r ON r.website = c.website",
    }


_SOCIAL_JOIN = "array_to_string(list_filter([" + ", ".join(P.NETWORKS) + "], lambda js: js <> ''), ', ')"
BATCH_VALUES = {
    "maps_business_name": "business_name",
    "source_url": "website",
    "rating": "coalesce(nullif(rating, ''), 'N/A')",
    "review_count": "coalesce(nullif(review_count, ''), 'N/A')",
    **{f: f for f in SCRAPED_FIELDS},
    "location": "search_location",
    "all_socials": _SOCIAL_JOIN,
    "timestamp": "''",
    "maps_url": "maps_url",
    "error": "error",
}
SIMPLE_VALUES = {
    **BATCH_VALUES,
    "company_name": "coalesce(nullif(company_name, ''), business_name)",
    "email": "coalesce(nullif(email, ''), 'Contact form only')",
    "location": "coalesce(nullif(search_location, ''), location)",
    "timestamp": "scraped_at",
}
SHEET = {
    "company_name": "business_name", "website": "website", "company_email": "email", "services": "services",
    "town": "search_location", "nothing": "''",
}
REASON = "CASE WHEN len(miss) > 0 THEN 'Missing Required Field(s): ' || array_to_string(miss, ', ') END"


def miss_list(*checks: tuple[str, str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {q(name)} END" for name, test in checks) + "], lambda ml: ml IS NOT NULL)"


EMAIL_AND_SERVICES = (("email", missing("email")), ("services", missing("services")))


def batch_ctes() -> dict[str, str]:
    """The one-pass batch: start ledger, dedup, routing, per-lead marks."""
    base = enriched_ctes("kept_cards")
    base.pop("leads")
    ledger_cards = f"""SELECT * FROM fresh c WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = 'name' AND k.key = {name_key('c.card_name')})"""
    return {
        **base,
        "found": ledger_cards,
        **dedup_ctes("found"),
        "kept_cards": "SELECT * FROM kept",
        "leads": enriched_ctes("kept_cards")["leads"],
        "routed": f"SELECT *, {REASON} AS reject_reason FROM (SELECT *, {miss_list(*EMAIL_AND_SERVICES)} AS miss FROM leads)",
        "drops": """SELECT o.listing_id, o.location_ord, coalesce(a.location_ord < o.location_ord, false) OR coalesce(b.location_ord < o.location_ord, false) AS known
FROM ordered o LEFT JOIN kept a ON a.nk = o.nk LEFT JOIN kept b ON b.sk = o.sk""",
        "before": "SELECT location_ord, count(*) AS collected, count(*) FILTER (WHERE known) AS already_processed FROM drops GROUP BY location_ord",
        "after": f"""SELECT location_ord, count(*) AS after_dedup, count(*) FILTER (WHERE reject_reason IS NULL) AS qualified, count(*) FILTER (WHERE NOT {missing('email')}) AS emails,
  count(*) FILTER (WHERE linkedin <> '') AS linkedin, count(*) FILTER (WHERE instagram <> '') AS instagram FROM routed GROUP BY location_ord""",
        "counters": """SELECT location_ord, collected - already_processed AS collected, already_processed, collected - already_processed AS scraped, coalesce(after_dedup, 0) AS after_dedup, coalesce(qualified, 0) AS qualified,
  coalesce(qualified, 0) AS exported, collected - already_processed - coalesce(after_dedup, 0) AS duplicates, coalesce(emails, 0) AS emails, coalesce(linkedin, 0) AS linkedin,
  coalesce(instagram, 0) AS instagram FROM before LEFT JOIN after USING (location_ord)""",
    }


CHAINED = """SELECT * REPLACE (CAST(location_ord % 7 AS INTEGER) AS location_ord,
  CASE WHEN listing_id % 5 = 0 THEN 'Biz ' || CAST(listing_id * 11 % 400 AS VARCHAR) ELSE card_text END AS card_text,
  CASE WHEN listing_id % 3 = 0 THEN 'Chain ' || CAST(location_ord % 7 AS VARCHAR) || '-' || CAST(listing_id % 4 AS VARCHAR) ELSE business_name END AS business_name) FROM listings"""


def by_location_ctes(cards: str | None = None, start_ledger: bool = True, excluded: str = "false") -> dict[str, str]:
    """The batch location by location: known keys go, sites scraped before come first, then row by row.

    ``cards`` replaces the listings; locations with ``excluded`` rows of them do not run.
    """
    base = batch_ctes()
    if cards is not None:
        base["cards"] = base["cards"].replace("FROM listings)", f"FROM ({cards}))")
    base["bad"] = f"SELECT DISTINCT location_ord FROM ({cards or 'SELECT * FROM listings'}) WHERE {excluded}"
    base["found"] = (base["found"] if start_ledger else "SELECT * FROM collected c WHERE true") + " AND c.location_ord NOT IN (SELECT location_ord FROM bad)"
    items = f"""SELECT row_number() OVER (ORDER BY location_ord) - 1 AS place, location_ord, list({{'card': card_ord, 'id': listing_id, 'nk': {name_key('business_name')}, 'ck': {name_key('card_name')}, 'sk': {site_key('website')}}}) AS items
FROM found GROUP BY location_ord"""
    texts = "[]::VARCHAR[]"
    keeps = "coalesce(list_contains(ac.names, el.nk), false) OR coalesce(list_contains(ac.sites, el.sk), false)"
    add = lambda many, one: f"CASE WHEN el.{one} IS NULL THEN ac.{many} ELSE list_append(ac.{many}, el.{one}) END"
    element = lambda fresh, card, row: f"{{'fresh': {fresh}, 'card': {card}, 'id': {row}.id, 'nk': {row}.nk, 'sk': {row}.sk, 'ids': []::BIGINT[], 'names': {texts}, 'sites': {texts}}}"
    start = "{'fresh': -1, 'card': 0::BIGINT, 'id': 0::BIGINT, 'nk': NULL::VARCHAR, 'sk': NULL::VARCHAR, 'ids': []::BIGINT[], 'names': w.names, 'sites': w.sites}"
    after = "{'fresh': ac.fresh, 'card': ac.card, 'id': ac.id, 'nk': ac.nk, 'sk': ac.sk, 'ids': list_append(ac.ids, el.id), 'names': " + add("names", "nk") + ", 'sites': " + add("sites", "sk") + "}"
    new = """list_filter(i.items, lambda it: NOT (coalesce(list_contains(w.names, it.nk), false)
  OR coalesce(list_contains(w.names, it.ck), false) OR coalesce(list_contains(w.sites, it.sk), false)))"""
    fresh = "CASE WHEN coalesce(list_contains(scraped, it.sk), false) THEN 0 ELSE 1 END"
    walk = f"""SELECT -1, {texts}, {texts}, {texts}, []::BIGINT[] UNION ALL
SELECT place, r.names, r.sites, list_distinct(list_concat(scraped, list_filter(list_transform(here, lambda it: it.sk), lambda sk: sk IS NOT NULL))), list_concat(ids, r.ids) FROM (
  SELECT *, list_reduce(list_concat([first], list_sort(list_transform(here, lambda it: {element(fresh, 'it.card', 'it')}))), lambda ac, el: CASE WHEN {keeps} THEN ac ELSE {after} END) AS r FROM (
    SELECT i.place, w.scraped, w.ids, {start} AS first, {new} AS here FROM walk w JOIN items i ON i.place = w.place + 1))"""
    kept = f"SELECT f.*, {name_key('business_name')} AS nk, {site_key('website')} AS sk FROM found f WHERE f.listing_id IN (SELECT unnest(ids) FROM walk)"
    earlier = lambda alias: f"coalesce({alias}.location_ord < f.location_ord, false)"
    drops = f"""SELECT f.listing_id, f.location_ord, {earlier('a')} OR {earlier('b')} OR {earlier('d')} AS known FROM found f
LEFT JOIN kept a ON a.nk = {name_key('f.business_name')} LEFT JOIN kept b ON b.sk = {site_key('f.website')} LEFT JOIN kept d ON d.nk = {name_key('f.card_name')}"""
    out = {}
    for name, sql in base.items():
        if name == "found":
            out["bad"], out["found"] = base["bad"], sql
        elif name == "ordered":
            out["items"], out["walk(place, names, sites, scraped, ids)"], out["kept"] = items, walk, kept
        elif name == "drops":
            out["drops"] = drops
        elif not name.startswith("walk") and name not in ("kept", "bad"):
            out[name] = sql
    return out


# --- statements ---------------------------------------------------------------------------


def statement(views: tuple[str, ...], ctes: dict[str, str], select: str) -> str:
    parts = {**{v: VIEWS[v] for v in with_views(*views)}, **ctes}
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in parts.items())
    return f"WITH RECURSIVE {body}\n{select}" if parts else select


def _raw_url() -> str:
    rest = "regexp_replace(url, '^https?://', '')"
    host = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
    return (
        f"CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN {rest} WHEN 2 THEN {host} || ':8080/x' WHEN 3 THEN '//' || {rest}"
        f" WHEN 4 THEN 'HTTPS://WWW.' || upper({host}) || '/a b//?' ELSE 'localhost:80/' || {rest} END"
    )


NORMALIZED = f"CASE WHEN regexp_matches({_raw_url()}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_raw_url()} ELSE 'https://' || {_raw_url()} END"


def _label_ctes() -> dict[str, str]:
    return {
        "pieces": r"SELECT doc_id, unnest(l) AS label, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, '. ') AS l FROM documents)",
        "labels": "SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN label WHEN 1 THEN 'SEO ' || label ELSE 'Discover ' || label || ' social?' END AS label FROM pieces",
    }


def build() -> dict[str, str]:
    out: dict[str, str] = {}
    page = {**parse_ctes(), **field_ctes()}
    pages = ("lead_pages",)
    web = ("web_pages", "listings")

    def on_page(name: str, select: str) -> None:
        out[name] = statement(pages, page, select)

    def on_facts(name: str, select: str) -> None:
        out[name] = statement(web, facts_ctes(), select)

    def on_leads(name: str, select: str, source: str = "fresh") -> None:
        out[name] = statement((*web, "ledger"), enriched_ctes(source), select)

    def on_batch(name: str, select: str) -> None:
        out[name] = statement((*web, "ledger"), by_location_ctes(), select)

    def on_cards(name: str, select: str, extra: dict[str, str] | None = None) -> None:
        out[name] = statement(("listings", "ledger"), {**lead_ctes(), **(extra or {})}, select)

    # sources
    out["a1_pages"] = "SELECT page_id, url, html FROM pages"
    latin = "regexp_replace(html, '[^\\x00-\\x7F\\x{A0}-\\x{FF}]', '?', 'g')"
    out["a1_charsets"] = f"SELECT page_id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN {latin} WHEN 2 THEN {latin} || chr(8364) || chr(65533) ELSE html || chr(65533) END AS html FROM pages"
    out["a2_normalize_url"] = f"SELECT page_id, {NORMALIZED} AS url FROM pages"
    https = "regexp_matches(u, '^(?i)https:')"
    out["a3_candidate_urls"] = (
        f"SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS attempt, unnest(l) AS url FROM (SELECT page_id, CASE WHEN {https} THEN [u, 'http' || regexp_replace(regexp_replace(u, '^(?i)https', ''), '\\?$', '')] ELSE [u] END AS l"
        f" FROM (SELECT page_id, {NORMALIZED} AS u FROM pages))"
    )
    on_facts("a4_homepage", "SELECT website, url, name AS company_name, error FROM rec")
    out["a5_result_cards"] = statement(("listings",), {"cards": cards_cte(20)}, "SELECT location_ord, card_ord, maps_url, card_name FROM cards")
    out["a6_searches"] = "SELECT n_nationkey AS location_ord, 'web+design+%26+more+' || n_name || '+~%2A%C3%A9' AS search FROM nation"
    sheets = {
        "acc": "SELECT business_name AS n, website AS s FROM listings WHERE location_ord < 12",
        "rej": "SELECT business_name AS n, website AS s FROM listings WHERE location_ord >= 12",
    }
    keys = lambda a, n, s: f"SELECT 'name' AS kind, lower({strip(n)}) AS key FROM {a} UNION SELECT 'site', lower({strip(s)}) FROM {a}"
    out["a8_ledger_load"] = statement(("listings",), sheets, f"SELECT * FROM ({keys('acc', 'n', 's')} UNION {keys('rej', 'n', 's')}) WHERE key <> ''")
    out["a8_ledger_load_by_position"] = statement(("listings",), sheets, f"SELECT * FROM ({keys('acc', 'n', 's')} UNION {keys('rej', 's', 'n')}) WHERE key <> ''")
    out["a9_ledger_sites"] = statement(("listings", "ledger"), {}, f"SELECT DISTINCT kind, CASE WHEN kind = 'site' THEN {website_key('key')} ELSE key END AS key FROM ledger")
    out["a11_cells"] = statement(
        ("listings",), {},
        "SELECT CASE WHEN listing_id = 0 THEN '' ELSE CAST(listing_id AS VARCHAR) END AS listing_id, CASE WHEN location_ord = 0 THEN '' ELSE CAST(location_ord AS VARCHAR) END AS location_ord,"
        " replace(trim(business_name, ' '), ' ', ', ') AS words, CASE WHEN listing_id % 2 = 0 THEN 'True' ELSE '' END AS even, website FROM listings",
    )
    out["a12_header_growth"] = statement(
        ("listings",), {},
        "SELECT CASE WHEN location_ord < 12 THEN business_name ELSE '' END AS company_name, website, CASE WHEN location_ord >= 12 THEN maps_url ELSE '' END AS map FROM listings",
    )
    out["a12_replayed_append"] = out["a12_header_growth"]
    on_leads("a13_legacy_rows", "SELECT company_name, website, coalesce(nullif(email, ''), 'Contact Form Only') AS company_email, search_location AS location, services FROM leads")
    on_batch("a14_rejected", f"SELECT listing_id, {', '.join(f'{v} AS {k}' for k, v in SHEET.items())}, reject_reason FROM routed WHERE reject_reason IS NOT NULL")
    on_batch("a15_rejected_minimal", "SELECT business_name, website, search_location, reject_reason FROM routed WHERE reject_reason IS NOT NULL")
    fields = ", ".join(
        f"'{k}', {v}" for k, v in {
            "company_name": "name", "email": "email", "services": "services", "phone": "phones", "location": "location",
            **{n: n for n in P.NETWORKS}, "all_socials": "array_to_string(list_transform(socials, lambda aj: aj.url), ', ')", "timestamp": "ts",
        }.items()
    )
    on_facts("a17_record_json", f"SELECT website, CAST(CASE WHEN error IS NULL THEN json_object({fields}) ELSE json_object('company_name', NULL, 'email', [], 'services', [], 'error', error) END AS VARCHAR) AS json FROM rec")

    # parse
    on_page("b1_tokens", "SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, t AS token FROM tok")
    on_page("b2_visible_text", "SELECT page_id, CAST((SELECT count(*) FROM parts p WHERE p.page_id = page.page_id) AS INTEGER) AS parts, text FROM page")
    on_page("b3_text_parts", "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos, txt AS part FROM parts")
    out["b4_unescape"] = f"SELECT page_id, {unescape(unescape('html'))} AS html FROM pages"
    on_page("b5_nav_links", "SELECT s.page_id, CAST(count(*) FILTER (WHERE in_nav) AS INTEGER) AS in_nav, CAST(count(l.page_id) AS INTEGER) AS links FROM src s LEFT JOIN links l USING (page_id) GROUP BY s.page_id")
    numbered = "CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos"
    on_page("b6_links", f"SELECT page_id, {numbered}, href, text, in_nav FROM links")
    on_page("b7_meta", f"SELECT page_id, {numbered}, key, content FROM meta")
    on_page("b8_title", "SELECT page_id, nullif(title, '') AS title FROM page")
    on_page("b9_elements", f"SELECT page_id, {numbered}, tag, text FROM elements")
    on_page(
        "b10_attributes",
        f"SELECT page_id, CAST(pos - 1 AS INTEGER) AS pos, concat_ws('|', {attr('t', 'href')}, {attr('t', 'name')}, {attr('t', 'content')}) AS attributes FROM tok WHERE regexp_matches(t, '(?i)^<[a-z]')",
    )

    # scalars
    out["c1_squash"] = f"""SELECT doc_id, {squash("' ' || replace(text, ', ', ', ' || chr(10))")} AS text FROM documents"""
    out["c2_cells"] = "SELECT doc_id, CASE WHEN doc_id % 7 <> 0 THEN replace(text, ' ', ', ') ELSE '' END AS cell FROM documents"
    out["c3_clean_text"] = statement(("listings",), {}, f"SELECT listing_id, CASE WHEN location_ord <> 3 THEN {squash('business_name')} ELSE '' END AS name FROM listings")
    out["c4_website_key"] = f"SELECT page_id, {website_key(_raw_url())} AS site FROM pages"
    out["c5_clean_email"] = f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, {clean_email("'mailto: .,' || w || ';:'")} AS email FROM (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS pos FROM (
  SELECT doc_id, string_split(text, ' ') AS l FROM documents))"""
    name_in = "text || '  :: ' || lang || ' | ' || source || ' - x'"
    out["c6_clean_company_name"] = f"SELECT doc_id, {clean_name(name_in)} AS name FROM documents"
    deob_in = "text || ' a [ AT ] b (dot) c At d'"
    out["c7_deobfuscate"] = f"SELECT doc_id, {deobfuscate(deob_in)} AS text FROM documents"
    label_in = "' -: Learn More ' || text || ' more |'"
    out["c8_normalize_label"] = f"SELECT doc_id, {normalize_label(label_in)} AS label FROM documents"
    host = "regexp_extract(url, '^https?://([^/?#]+)', 1)"
    other = f"CASE page_id % 4 WHEN 0 THEN '//WWW.' || upper({host}) || '/a b?x' WHEN 1 THEN 'https://' || {host} || ':443/' WHEN 2 THEN '/only/path' ELSE 'ftp://' || {host} || '#f' END"
    out["c9_same_site"] = f"SELECT page_id, {netloc_site('url')} = {netloc_site(other)} AS same FROM pages"
    hrefs = "[" + ", ".join(q(h) for h in HREFS) + "]"
    out["c10_resolve_url"] = "SELECT page_id, href, resolved FROM " + resolve(f"(SELECT page_id, url, unnest({hrefs}) AS href FROM pages) ph", "url", "href", "resolved")
    label_url = "CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN replace(url, '://', '://www.o''neil-3COM-') ELSE '/no/host' END"
    out["c11_host_label"] = f"SELECT page_id, {host_label(label_url)} AS name FROM pages"
    fb_in = "' ' || url || '/?x#y/ '"
    out["c12_facebook_about"] = f"SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN regexp_replace(regexp_replace({strip(fb_in)}, '[?#].*$', ''), '/+$', '') || '/about' END AS about FROM pages"
    out["c13_linkedin_candidates"] = "SELECT page_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos, unnest(l) AS url FROM (SELECT page_id, [regexp_replace(url, '/+$', ''), regexp_replace(url, '/+$', '') || '/about'] AS l FROM pages)"
    out["c14_contact_guess"] = "SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/contact' AS url FROM pages"
    out["c15_name_key"] = statement(("listings",), {}, f"SELECT listing_id, {name_key('business_name')} AS key FROM listings")
    out["c16_elapsed"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 4000 >= 60 THEN CAST(o_orderkey % 4000 // 60 AS VARCHAR) || ' min ' || CAST(o_orderkey % 4000 % 60 AS VARCHAR) || ' sec' ELSE CAST(o_orderkey % 4000 AS VARCHAR) || ' seconds' END AS elapsed FROM orders"
    out["c17_stamp"] = "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at_second, strftime(ts, '%Y-%m-%d %H:%M') AS at_minute FROM events"

    # extractors
    on_page("e1_emails", f"SELECT page_id, url, {text_of('emails')} AS emails FROM f_emails JOIN page USING (page_id)")
    on_page("e2_loose_emails", f"SELECT page_id, {text_of('loose')} AS emails FROM f_loose")
    on_page("e3_first_email", "SELECT page_id, first_email AS email FROM f_loose")
    on_page("e4_phones", f"SELECT page_id, {text_of('phones')} AS phones FROM f_phones")
    on_page("e5_location", "SELECT page_id, location FROM f_location")
    chunk_in = "text || '; No. ' || CAST(doc_id AS VARCHAR) || ' Floor 3|x'"
    chunks = f"list_transform(string_split_regex({chunk_in}, {q(r'[;•|]|\. |' + WS + '{3,}')}), lambda kc: {strip('kc')})"
    out["e6_location_chunks"] = f"SELECT doc_id, list_filter({chunks}, lambda kd: {has_any('lower(kd)', P.ADDRESS_WORDS)} AND regexp_matches(kd, '\\p{{Nd}}') AND length(kd) > 10 AND length(kd) < 150)[1] AS location FROM documents"
    on_page("e7_socials", f"SELECT page_id, {', '.join(P.NETWORKS)} FROM f_socials")
    on_page("e8_company_name", "SELECT page_id, name FROM f_name")
    on_page("e9_contact_links", f"SELECT page_id, {text_of('contacts')} AS contacts FROM page LEFT JOIN f_contacts USING (page_id)")
    on_page("e10_nav_labels", f"SELECT page_id, {text_of('nav')} AS labels FROM page LEFT JOIN f_nav USING (page_id)")
    on_page("e11_section_labels", f"SELECT page_id, {text_of('section')} AS labels FROM page LEFT JOIN f_section USING (page_id)")
    on_page("e12_heading_labels", f"SELECT page_id, {text_of('heading')} AS labels FROM page LEFT JOIN f_heading USING (page_id)")
    on_page("e13_services", f"SELECT page_id, {text_of('services')} AS services FROM f_services")
    out["e14_unique_ignoring_case"] = """SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS words FROM (SELECT doc_id, lower(w) AS k, min(pos) AS pos, min_by(w, pos) AS w FROM (
  SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS pos FROM documents) GROUP BY doc_id, lower(w)) GROUP BY doc_id"""
    discovered = "array_to_string(list_transform(socials, lambda ds: ds.url), ', ')"
    on_page("e15_all_socials", f"SELECT page_id, {discovered} AS discovered, {_SOCIAL_JOIN} AS exported FROM f_socials")
    rating_sql = first_rating(["'1,2' || review_label", "rating_label"], "'Rated ' || rating_label")
    out["e16_rating"] = statement(("listings",), {}, f"SELECT listing_id, {rating_sql} AS rating FROM listings")
    out["e17_review_count"] = statement(
        ("listings",), {},
        "SELECT listing_id, CASE WHEN location_ord % 2 = 0 THEN regexp_replace(review_label, '[^0-9]', '', 'g') ELSE regexp_replace(rating_label || review_label, '[^0-9]', '', 'g') END AS reviews FROM listings",
    )
    out["e18_website_link"] = statement(("listings",), {}, "SELECT listing_id, CASE WHEN website LIKE 'http%' THEN website ELSE maps_url END AS website FROM listings")

    # predicates
    for name, test in (("f1_service_hint", is_hint("label")), ("f2_reads_like_service", service_noun("label")), ("f3_likely_service", likely("label"))):
        out[name] = statement((), _label_ctes(), f"SELECT doc_id, CAST(pos AS INTEGER) AS pos FROM labels WHERE {test}")
    out["f4_has_website"] = statement(("listings",), {}, "SELECT listing_id, website FROM listings WHERE website <> ''")
    on_leads("f5_required_scraped", f"SELECT listing_id, {text_of(miss_list(*EMAIL_AND_SERVICES, ('maps_url', 'true')))} AS missing FROM leads")
    exported = miss_list(*EMAIL_AND_SERVICES, ("maps_url", missing("maps_url")), ("rating", missing("coalesce(nullif(rating, ''), 'N/A')")))
    on_leads("f5_required_exported", f"SELECT listing_id, {text_of(exported)} AS missing FROM leads")
    simple = miss_list(("company_name", missing(SIMPLE_VALUES["company_name"])), ("email", missing(SIMPLE_VALUES["email"])))
    on_leads("f6_required_simple", f"SELECT listing_id, {REASON} AS reject_reason FROM (SELECT *, {simple} AS miss FROM leads)")
    on_leads("f7_counts_as_email", f"SELECT location_ord, count(*) FILTER (WHERE NOT {missing('email')}) AS emails FROM leads GROUP BY location_ord")
    out["f8_login_wall"] = statement(
        ("web_pages",), {},
        "SELECT page_id, contains(lower(final_url), 'login') OR contains(lower(final_url), 'authwall') AS walled, contains(lower(final_url), 'sorry') OR contains(lower(html), 'captcha') AS verification FROM web_pages",
    )

    # joins
    on_page("j1_kept_facts", f"SELECT page_id, {text_of('emails')} AS emails, page_id % 100 = 0 AS parsed FROM f_emails")
    on_facts("j1_homepages", f"SELECT website, {text_of('emails')} AS emails, {text_of('contacts')} AS contacts FROM home")
    on_facts("j2_contact_pages", f"SELECT website, CAST(place AS INTEGER) AS place, url, {text_of('emails')} AS emails FROM contact")
    on_facts("j3_social_fallback", f"SELECT website, {text_of('email')} AS email FROM rec")
    on_leads("j4_enrich", f"SELECT listing_id, rating, review_count, {', '.join(SCRAPED_FIELDS)}, error FROM leads", source="collected")
    anti = lambda key, kind: f"NOT EXISTS (SELECT 1 FROM known k WHERE k.kind = '{kind}' AND k.key = {key})"
    on_cards(
        "j5_new_cards",
        f"SELECT listing_id, card_name FROM cards c WHERE {anti(name_key('c.card_name'), 'name')} AND {anti(name_key('c.business_name'), 'name')} AND {anti(site_key('c.website'), 'site')}",
    )
    on_cards("j6_new_leads", "SELECT listing_id, business_name, website FROM fresh")
    reuse = {
        "cache": f"SELECT {site_key('website')} AS site, max_by(website, card_ord) AS record_website FROM collected WHERE location_ord < 12 GROUP BY 1",
        "marked": f"SELECT c.*, CASE WHEN k.site IS NULL THEN 1 ELSE 0 END AS is_fresh, coalesce(k.record_website, c.website) AS record_website FROM collected c LEFT JOIN cache k ON k.site = {site_key('c.website')} WHERE location_ord >= 12",
    }
    on_cards("j7_reused_scrapes", "SELECT listing_id, is_fresh, record_website FROM marked", reuse)
    on_cards("p2_reused_then_fresh", "SELECT listing_id, location_ord, format('{}-{:012d}', is_fresh, card_ord) AS position FROM marked", reuse)
    fb_url = "regexp_replace(regexp_replace(facebook_url, '[?#].*$', ''), '/+$', '') || '/about'"
    li_url = "regexp_replace(linkedin_url, '/+$', '')"
    cascade = {
        **facts_ctes(),
        "biz": f"SELECT business_id, business_name, rating, {strip('website')} AS website, facebook_url, linkedin_url FROM businesses",
        "ask": f"""SELECT business_id, 0 AS step, website AS u FROM biz WHERE website <> '' UNION ALL SELECT business_id, 1, regexp_extract(website, '^(https?://[^/?#]+)', 1) || '/contact' FROM biz WHERE website <> ''
UNION ALL SELECT business_id, 2, {fb_url} FROM biz WHERE website <> '' AND facebook_url <> '' UNION ALL SELECT business_id, 3, {li_url} FROM biz WHERE website <> '' AND linkedin_url <> ''
UNION ALL SELECT business_id, 4, {li_url} || '/about' FROM biz WHERE website <> '' AND linkedin_url <> ''""",
        "hit": """SELECT business_id, min(step) AS step, min_by(e, step) AS e FROM (SELECT business_id, step, CASE WHEN step < 2 THEN loose[1]
  WHEN contains(lower(final_url), 'login') OR (step > 2 AND contains(lower(final_url), 'authwall')) THEN NULL ELSE first_email END AS e FROM ask JOIN facts ON facts.url = ask.u) WHERE e IS NOT NULL GROUP BY business_id""",
    }
    out["j8_email_cascade"] = statement(
        (*web, "businesses"), cascade,
        """SELECT business_id, business_name, rating, website, coalesce(e, 'N/A') AS email, CASE WHEN website = '' THEN 'no website' WHEN step IS NULL THEN 'not found' WHEN step < 2 THEN 'website'
  WHEN step = 2 THEN 'facebook' ELSE 'linkedin' END AS email_source FROM biz LEFT JOIN hit USING (business_id)""",
    )

    # aggregations
    grouped = {**_label_ctes(), "docs": "SELECT doc_id, list(label ORDER BY pos) AS labels FROM labels GROUP BY doc_id", "cats": f"SELECT doc_id, {categories('labels')} AS labels FROM docs"}
    out["g1_categories"] = statement((), grouped, f"SELECT doc_id, {text_of(unique_ci('labels'))} AS categories FROM cats")
    on_facts(
        "g2_contact_fold",
        f"SELECT website, {text_of('emails')} AS email, {text_of('services')} AS services, {text_of('phones')} AS phone, location, {discovered} AS socials FROM fold",
    )
    on_batch("g3_location_counters", "SELECT * FROM counters")
    totals = (
        ("Companies Found", "scraped"), ("Qualified Leads", "qualified"), ("Emails Found", "emails"),
        ("LinkedIn Profiles", "linkedin"), ("Instagram Profiles", "instagram"), ("Duplicates Removed", "duplicates"),
    )
    summary = " UNION ALL ".join(f"SELECT {q(label)} AS label, CAST(sum({col}) AS VARCHAR) AS value FROM counters HAVING sum(qualified) > 0" for label, col in totals)
    on_batch("g4_summary", summary)
    on_cards("g5_skip_counts", "SELECT location_ord, count(*) AS skipped FROM collected WHERE listing_id NOT IN (SELECT listing_id FROM fresh) GROUP BY location_ord")
    out["g6_sorted_set"] = "SELECT doc_id, array_to_string(list_sort(list_distinct(string_split(text, ' '))), ' ') AS words FROM documents"

    # order and top-k
    on_cards("w1_dedup", "SELECT listing_id, business_name, website FROM kept", dedup_ctes("collected"))
    out["w1_dedup_by_components"] = out["w1_dedup"]
    out["w2_first_cards"] = statement(("listings",), {"cards": cards_cte(5)}, "SELECT location_ord, listing_id FROM cards")
    on_page("w3_first_contacts", f"SELECT page_id, {text_of('contacts[1:3]')} AS contacts FROM page LEFT JOIN f_contacts USING (page_id)")
    on_page("w4_first_match", "SELECT page_id, twitter, first_email AS email FROM f_socials JOIN f_loose USING (page_id)")
    on_page("w5_sorted_fields", f"SELECT page_id, {text_of('emails')} AS emails, {text_of('phones')} AS phones FROM f_emails JOIN f_phones USING (page_id)")
    on_page("w6_running_state", "SELECT page_id, CAST(coalesce(len(section), 0) AS INTEGER) AS in_section, CAST((SELECT count(*) FROM parts p WHERE p.page_id = page.page_id) AS INTEGER) AS visible FROM page LEFT JOIN f_section USING (page_id)")
    on_cards("w7_lead_order", "SELECT location_ord, card_ord, listing_id FROM kept", dedup_ctes("fresh"))
    headers = "listing_id,Company Name,Website,Company Email,Services,Town,Nothing"
    on_leads("w8_column_order", f"SELECT listing_id, {q(headers)} AS headers, concat_ws('|', {', '.join(SHEET.values())}) AS row FROM leads")

    # projections and routing
    all_keys = f"SELECT * FROM ({keys('acc', 'n', 's')} UNION {keys('rej', 'n', 's')}) WHERE key <> ''"
    out["p1_ledger_union"] = statement(
        ("listings",), {**sheets, "ks": all_keys},
        f"SELECT kind, count(DISTINCT CASE WHEN kind = 'site' THEN {website_key('key')} ELSE key END) AS keys FROM ks GROUP BY kind",
    )
    mail = "list_distinct(list_transform(list_filter(hrefs, lambda ph: regexp_matches(ph, '(?i)^mailto:') AND contains(ph, '@')), lambda pi: lower(pi)))"
    on_page("p3_mailto_union", f"SELECT page_id, CAST(len(loose) AS INTEGER) AS both, CAST(len({mail}) AS INTEGER) AS mailto FROM f_loose JOIN page USING (page_id)")
    on_cards("p4_ledger_growth", "SELECT 'name' AS kind, nk AS key FROM kept WHERE nk IS NOT NULL UNION SELECT 'site', sk FROM kept WHERE sk IS NOT NULL", dedup_ctes("fresh"))
    on_leads("p5_batch_values", f"SELECT listing_id, {', '.join(f'{BATCH_VALUES[f]} AS {f}' for f in BATCH_FIELDS)} FROM leads")
    on_leads("p6_simple_values", f"SELECT listing_id, {', '.join(f'{SIMPLE_VALUES[f]} AS {f}' for f in SIMPLE_FIELDS)} FROM leads")
    on_leads("p7_sheet_rows", f"SELECT listing_id, {', '.join(f'{v} AS {k}' for k, v in SHEET.items())} FROM leads")
    on_batch("p8_routing", "SELECT listing_id, reject_reason FROM routed")
    on_leads("p9_error_rows", f"SELECT listing_id, {', '.join(SCRAPED_FIELDS)}, error FROM leads WHERE error <> ''")
    on_cards(
        "p10_collect_only",
        f"SELECT listing_id, location_ord, card_ord, business_name, maps_url, website, rating, review_count, search_location FROM fresh c WHERE {anti(name_key('c.card_name'), 'name')}",
    )
    homepage = facts_ctes()
    homepage["contact"] = homepage["contact"] + " WHERE false"
    out["p10_homepage_only"] = statement(web, homepage, f"SELECT website, name AS company_name, {text_of('email')} AS email, {text_of('phones')} AS phone FROM rec")
    on_leads(
        "p10_single_location",
        f"SELECT listing_id, {SIMPLE_VALUES['company_name']} AS company_name, {SIMPLE_VALUES['email']} AS email, {SIMPLE_VALUES['location']} AS location FROM leads WHERE len({simple}) = 0",
        source="collected",
    )
    edited = {
        **{f: BATCH_VALUES[f] for f in BATCH_FIELDS if f in SCRAPED_FIELDS or f in ("source_url", "all_socials")},
        "company_name": "CASE WHEN location_ord % 4 = 0 THEN 'edited ' || CAST(listing_id AS VARCHAR) ELSE company_name END",
        "email": "CASE WHEN location_ord % 2 = 0 THEN '' ELSE email END",
    }
    on_leads("p11_overrides", f"SELECT listing_id, {', '.join(f'{v} AS {k}' for k, v in edited.items())} FROM leads")

    # memory
    chained = lambda select, **options: statement((*web, "ledger"), by_location_ctes(CHAINED, **options), select)
    out["t1_batch_by_location"] = chained("SELECT listing_id, location_ord, email, reject_reason FROM routed")
    out["t1_batch_by_components"] = out["t1_batch_by_location"]
    out["t1_micro_batches_by_location"] = chained("SELECT listing_id, location_ord, location_ord // 3 AS batch_id, email, reject_reason FROM routed")
    out["g4_micro_batch_summary"] = chained(summary)
    out["t3_failed_locations"] = chained(
        "SELECT location_ord, listing_id, 'handled' AS outcome FROM routed UNION ALL SELECT location_ord, NULL, 'failed' FROM bad",
        excluded="(location_ord = 2 AND listing_id % 7 = 0) OR (location_ord = 5 AND listing_id % 5 = 0)",
    )
    out["a7_leads_csv"] = statement(("listings",), {}, "SELECT CASE WHEN listing_id = 0 THEN '' ELSE CAST(listing_id AS VARCHAR) END AS listing_id, business_name, card_text, website FROM listings")
    cell = lambda n: f"CASE WHEN {n} = 0 THEN '' ELSE CAST({n} AS VARCHAR) END AS {n}"
    out["a10_results_table"] = statement(("listings",), {}, f"SELECT {cell('listing_id')}, {cell('location_ord')}, maps_url FROM listings")
    out["a16_summary_table"] = out["g4_summary"]
    out["t1_two_batches"] = statement((*web, "ledger"), by_location_ctes(start_ledger=False), "SELECT listing_id, location_ord, CASE WHEN location_ord < 12 THEN 0 ELSE 1 END AS batch_id FROM kept")
    on_cards("t2_second_run", "SELECT listing_id, location_ord FROM kept WHERE location_ord >= 12", dedup_ctes("collected"))
    return out
