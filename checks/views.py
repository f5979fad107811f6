"""Input views, one SQL text for both engines. They only add rows and text to driver tables."""

_PAGES_WITH_HOST = (
    "SELECT page_id, url, html, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM pages"
)

LEAD_PAGES = f"""
SELECT p.page_id, p.url, p.host,
  coalesce(p.html, '') || CASE WHEN p.page_id % 2 = 0 THEN
      '<a href="/contact/missing">Contact us</a><a href="' || regexp_extract(p.url, '^(https?://[^/?#]+)', 1)
      || '/contact">Get in touch</a><a href="' || p.url || '">Enquiries</a><a href="https://other.test/contact">Contact</a>'
    ELSE '' END ||
  CASE p.page_id % 16
  WHEN 0 THEN '<a href="mailto:Info@' || p.host || '">Mail</a><p>sales [at] ' || p.host || '</p><p>INFO@' || p.host || '</p>'
  WHEN 8 THEN '<p>desk at ' || p.host || ' or help (AT) mail dot example [dot] org</p><a href="MAILTO:Box@' || p.host || '?subject=hi">open'
  WHEN 1 THEN '<a href="tel:+1%20555%20' || CAST(1000000 + p.page_id AS STRING) || '">Call</a><p>Call (555) 123-4567 or 20240131.</p>'
  WHEN 9 THEN '<a href="TEL:+49 30 ' || CAST(1000000 + p.page_id AS STRING) || '">Call</a><p>+1 (555) 010-' || CAST(1000 + p.page_id % 9000 AS STRING) || ', 0000 123 4567</p>'
  WHEN 2 THEN '<meta property="og:site_name" content="Shop ' || CAST(p.page_id AS STRING) || ' | Home"><meta name="business:locality" content="Austin">'
  WHEN 10 THEN '<META NAME="Application-Name" content="App  ' || CAST(p.page_id AS STRING) || ' - x :: y"><meta name="geo.region" content="  "><meta name=description content="first"><meta name=description content="last">'
  WHEN 3 THEN '<a href="https://www.linkedin.com/company/c' || CAST(p.page_id AS STRING) || '/">in</a><a href="//facebook.com/f' || CAST(p.page_id AS STRING) || '">fb</a><a href="https://x.com/t1">x</a><a href="https://x.com/t2">x</a>'
  WHEN 11 THEN '<a href=" https://Instagram.com/i.' || CAST(p.page_id AS STRING) || '/?x=1">ig</a><a href="https://www.linkedin.com/company/c' || CAST(p.page_id AS STRING) || '">in</a><a href="//facebook.com/f' || CAST(p.page_id AS STRING) || '">fb</a><a href="https://youtu.be/@y1">yt</a><a href="https://tiktok.com/@tk_1">tk</a>'
  WHEN 4 THEN '<header><nav><a href="/services/seo">SEO Services</a><a href="/services/cloud">Cloud Migration</a></nav></header><h2>Our Services</h2><h3>Web Design</h3><ul><li>Hosting<ul><li>Logo Design</li></ul></li></ul><h2>News</h2><h3>Strategy</h3>'
  WHEN 12 THEN '<h2>What we do</h2><h3>Web Development - Learn More</h3><li>Read more</li><h4>Brand Awareness</h4><li>Data <b>Security</b></li><li>&copy; Us</li><li>Garden Care:</li><h1>Other</h1><li>Cooking</li>'
  WHEN 5 THEN '<p>' || CAST(p.page_id AS STRING) || ' Main Street, Suite 4</p><h3>Paid Media?</h3><h3>Discover analytics</h3><h4>Email Marketing</h4>'
  WHEN 13 THEN '<p>We always have ' || CAST(p.page_id AS STRING) || ' offers</p><h3>Creative</h3><h2>social media plans</h2>'
  WHEN 6 THEN '<noscript>hid@' || p.host || '</noscript><svg><title>t</title>no@' || p.host || '</svg></svg><p>see&amp;lt;b&gt; at night</p>'
  WHEN 14 THEN '<template>tpl@' || p.host || '</template><svg/><p>seen@' || p.host || '.</p><nav><header><a href="../up/./x">Growth</a></header><a href="?q=1">Home</a></nav></nav><a href="#top">Blog</a>'
  WHEN 7 THEN '<p>Please solve the CAPTCHA, 1234 12345 1234 123456789 or +44 20 7946 0958</p>'
  WHEN 15 THEN '<p>Caf&eacute; &#8212; &#x20AC;5 &hellip; &copy2024 &notit; &AMP; end</p>'
  ELSE '' END AS html
FROM ({_PAGES_WITH_HOST}) p
"""

# Lead pages plus the pages that fallbacks look up. page_id stays unique: extra rows are negative.
WEB_PAGES = """
SELECT page_id, url, url AS final_url, html, CASE WHEN page_id % 3 > 0 THEN TIMESTAMP '2024-02-28 23:00:00' + INTERVAL '1' MINUTE * page_id END AS crawled_at FROM lead_pages
UNION ALL
SELECT -(page_id * 4 + 1), CASE WHEN url LIKE 'https:%' THEN 'https' ELSE 'http' END || '://facebook.com/f' || CAST(page_id AS STRING) || '/about',
  CASE WHEN page_id % 16 = 3 THEN 'https://facebook.com/Login?next=f' ELSE 'https://facebook.com/f' || CAST(page_id AS STRING) || '/about' END,
  '<title>f</title><p>Write to FB' || CAST(page_id AS STRING) || ' [at] mail.example dot org or b@example.org</p>', NULL
FROM pages WHERE page_id % 8 = 3
UNION ALL
SELECT -(page_id * 4 + 2), 'https://www.linkedin.com/company/c' || CAST(page_id AS STRING),
  CASE WHEN page_id % 24 = 3 THEN 'https://www.linkedin.com/authwall' ELSE 'https://www.linkedin.com/company/c' || CAST(page_id AS STRING) END,
  CASE WHEN page_id % 24 = 3 THEN '<p>wall@example.org</p>' WHEN page_id % 32 = 3 THEN '<p>main@c' || CAST(page_id AS STRING) || '.example.net</p>' ELSE '<p>no mail</p>' END, NULL
FROM pages WHERE page_id % 8 = 3
UNION ALL
SELECT -(page_id * 4 + 3), 'https://www.linkedin.com/company/c' || CAST(page_id AS STRING) || '/about',
  'https://www.linkedin.com/company/c' || CAST(page_id AS STRING) || '/about',
  '<p>jobs@c' || CAST(page_id AS STRING) || '.example.net, or a@b.example.net</p>', NULL
FROM pages WHERE page_id % 8 = 3
UNION ALL
SELECT -(min(page_id) * 4 + 4), url, url, min('<p>Z desk@' || host || ' and Archive@' || host || '</p>'), NULL
FROM (SELECT page_id, host, regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/contact' AS url FROM lead_pages) c
WHERE page_id % 3 = 0 GROUP BY url
"""

_CUSTOMER_PAGE = """
SELECT c.*, (SELECT count(*) FROM pages) AS n_pages,
  (SELECT min(page_id) FROM pages) + c.c_custkey * 13 % (SELECT count(*) FROM pages) AS picked_page
FROM customer c
"""

LISTINGS = f"""
SELECT c.c_custkey AS listing_id, CAST(c.c_nationkey AS INT) AS location_ord, n.n_name AS search_location,
  c.c_custkey AS card_ord,
  'https://maps.example/maps/place/' || CAST(c.c_custkey - c.c_custkey % 9 % 2 AS STRING) AS maps_url,
  CASE WHEN c.c_custkey % 17 = 0 THEN '' ELSE chr(10) || '  Biz ' || CAST(c.c_custkey * 7 % (c.n_pages * 2 + 1) AS STRING) || ' ' END || chr(10) || '4.5 stars' AS card_text,
  CASE WHEN c.c_custkey % 17 = 0 THEN '' ELSE ' BIZ  ' || CAST(c.c_custkey * 7 % (c.n_pages * 2 + 1) AS STRING) || ' ' END AS business_name,
  CASE WHEN c.c_custkey % 11 = 0 THEN '' WHEN c.c_custkey % 101 = 0 THEN 'https://nowhere.example/' || CAST(c.c_custkey AS STRING) ELSE coalesce(p.url, '') END AS website,
  CAST(c.c_custkey % 7 AS STRING) || '.' || CAST(c.c_custkey % 10 AS STRING) || ' star rating' AS rating_label,
  CAST(c.c_custkey % 3 AS STRING) || ',' || CAST(100 + c.c_custkey AS STRING) || ' reviews' AS review_label
FROM ({_CUSTOMER_PAGE}) c
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN pages p ON p.page_id = c.picked_page
"""

LEDGER = """
SELECT DISTINCT 'name' AS kind, lower(trim(business_name)) AS key FROM listings WHERE listing_id % 37 = 0 AND trim(business_name) <> ''
UNION ALL
SELECT DISTINCT 'site' AS kind, lower(trim(website)) AS key FROM listings WHERE listing_id % 41 = 0 AND website <> ''
"""

BUSINESSES = f"""
SELECT c.c_custkey AS business_id, 'Firm ' || CAST(c.c_custkey AS STRING) AS business_name,
  CAST(c.c_custkey % 5 AS STRING) AS rating,
  CASE WHEN c.c_custkey % 13 = 0 THEN '  ' WHEN c.c_custkey % 3 = 0 THEN 'https://gone.example/' || CAST(c.c_custkey AS STRING) ELSE ' ' || coalesce(p.url, '') END AS website,
  CASE WHEN c.c_custkey % 2 = 0 THEN 'https://facebook.com/f' || CAST(c.picked_page - c.picked_page % 8 + 3 AS STRING) || '/?ref=1' ELSE '' END AS facebook_url,
  CASE WHEN c.c_custkey % 5 < 3 THEN 'https://www.linkedin.com/company/c' || CAST(c.picked_page - c.picked_page % 8 + 3 AS STRING) || '/' ELSE '' END AS linkedin_url
FROM ({_CUSTOMER_PAGE}) c LEFT JOIN pages p ON p.page_id = c.picked_page
"""

# In order of use: later views read earlier ones.
VIEWS = {
    "lead_pages": LEAD_PAGES,
    "web_pages": WEB_PAGES,
    "listings": LISTINGS,
    "ledger": LEDGER,
    "businesses": BUSINESSES,
}
NEEDS = {"lead_pages": (), "web_pages": ("lead_pages",), "listings": (), "ledger": ("listings",), "businesses": ()}
TABLES = ("pages", "customer", "nation", "documents")


def with_views(*names: str) -> list[str]:
    """Names of the views that the given ones need, in order."""
    wanted: set[str] = set()

    def add(name: str) -> None:
        for need in NEEDS[name]:
            add(need)
        wanted.add(name)

    for name in names:
        add(name)
    return [v for v in VIEWS if v in wanted]
