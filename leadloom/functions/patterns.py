"""Patterns, word lists and rules that decide what counts as a lead field.

They define the results and are therefore plain values in their natural order.
"""

from __future__ import annotations

import re

from leadloom.functions.text import BORDER, BORDER_AFTER, BORDER_BEFORE, LETTER

# --- emails -------------------------------------------------------------------------------
EMAIL = rf"(?=[{LETTER}0-9._%+-]){BORDER}[{LETTER}0-9._%+-]++@[{LETTER}0-9.-]+\.[{LETTER}]{{2,}}{BORDER}"
# Starts only at the edge of a run or after the last match: a long run without "@" is read once.
LOOSE_EMAIL = rf"(?:\G|(?<![{LETTER}0-9_.-]))[{LETTER}0-9_.-]++@[{LETTER}0-9_.-]+[.][{LETTER}0-9_]+"

# --- phones -------------------------------------------------------------------------------
_D = r"\p{Nd}"
_GAP = r"[\s\x1c-\x1f.-]?"
PHONE = (
    rf"(?U)(?=[+({_D}])\+?{BORDER}(?:{_D}{{1,3}}{_GAP})?\(?{_D}{{2,5}}\)?{_GAP}{_D}{{3,4}}{_GAP}{_D}{{3,9}}{BORDER}"
)
NOT_DIGIT = r"[^\p{Nd}]"
PHONE_EDGE = " .,:;-()[]"

# --- address ------------------------------------------------------------------------------
ADDRESS_META_KEYS = ("address", "locality", "region", "postal-code", "country")
ADDRESS_WORDS = (
    "street", "st.", "road", "rd.", "avenue", "ave.", "boulevard", "blvd.", "drive", "dr.",
    "way", "lane", "ln.", "suite", "ste.", "floor", "fl.", "zip code", "postal code",
)

# --- social networks, in export order -----------------------------------------------------
SOCIAL_URLS = {
    "linkedin": rf"(?i)https?://(?:www\.)?linkedin\.com/(?:company|in|school|org)/[{LETTER}0-9_.-]+/?",
    "facebook": rf"(?i)https?://(?:www\.)?(?:facebook|fb)\.com/[{LETTER}0-9.-]+/?",
    "instagram": rf"(?i)https?://(?:www\.)?instagram\.com/[{LETTER}0-9_.-]+/?",
    "twitter": rf"(?i)https?://(?:www\.)?(?:twitter\.com|x\.com)/[{LETTER}0-9_]+/?",
    "youtube": rf"(?i)https?://(?:www\.)?(?:youtube\.com|youtu\.be)/(?:c/|channel/|user/|@)?[{LETTER}0-9_.-]+/?",
    "tiktok": rf"(?i)https?://(?:www\.)?tiktok\.com/@[{LETTER}0-9_.-]+/?",
}
NETWORKS = tuple(SOCIAL_URLS)
SOCIAL_HOSTS = r"(?i)(?:linkedin|facebook|fb|instagram|twitter|x|youtube|tiktok)\.com|youtu\.be"

# --- contact links ------------------------------------------------------------------------
CONTACT_WORDS = ("contact", "get in touch", "reach us", "support", "enquiry", "enquiries")
CONTACT_PAGES = 3  # what a batch reads of each site

# --- services -----------------------------------------------------------------------------
SERVICE_WORDS = (
    "service", "services", "solutions", "what we do", "expertise", "offerings", "capabilities",
)
SERVICE_HINTS = (
    "ads", "advertising", "analytics", "branding", "content", "creative", "design", "development",
    "email marketing", "growth", "marketing", "media", "paid media", "ppc", "reporting", "seo",
    "social", "strategy",
)
SKIP_LABELS = (
    "home", "about", "about us", "contact", "contact us", "blog", "news", "careers",
    "privacy policy", "terms", "login", "services",
)
CALLS_TO_ACTION = (
    "Ready", "Get started", "Let's", "Discover", "Explore", "Start your", "Learn more", "Find out",
)
SERVICE_NOISE = (
    "case studies", "case study", "kind words", "from our clients", "not your traditional",
    "marketing agency", "promo", "brand awareness", "can be increased", "faster on average",
    "bounce rate", "page load time", "audit", "healthcare", "dental marketing", "enterprise seo",
    "e-commerce seo", "local seo", "rodeo austin",
)
COPYRIGHT_MARKS = ("copyright", "(c)", "©")
SERVICE_CATEGORIES = {
    "PPC": ("ppc", "paid ads", "paid media", "advertising", "google ads", "adwords", "remarketing", "retargeting"),
    "SEO": ("seo", "search engine optimization"),
    "Content Marketing": ("content marketing", "content", "copywriting", "website copywriting"),
    "Social Media": ("social", "social media", "facebook", "instagram", "linkedin", "tiktok", "reddit ads"),
    "Websites": ("web design", "webdesign", "website", "web development", "responsive design", "accessibility services"),
    "Digital Marketing": ("digital marketing",),
    "Hosting": ("hosting",),
    "Maintenance": ("maintenance", "site health", "performance optimization", "page speed", "page load"),
    "Security": ("security",),
    "Compliance": ("compliance",),
    "Mobile Design": ("mobile design", "mobile app", "app design", "app development"),
    "Branding": ("branding", "brand identity", "brand awareness", "logo design", "typography", "brand guidelines"),
    "Graphic Design": ("graphic design", "signage", "packaging"),
    "Analytics": ("analytics", "google analytics", "reporting", "data"),
    "Creative": ("creative", "art direction"),
    "Strategy": ("strategy",),
    "Email Marketing": ("email marketing",),
}

# --- leads --------------------------------------------------------------------------------
PLACEHOLDERS = ("n/a", "contact form only")


def any_of(words: tuple[str, ...]) -> str:
    """Pattern that finds any of the words as a substring."""
    return "|".join(re.escape(w) for w in words)


HINT_WORD = rf"(?i){BORDER_BEFORE}(?:{any_of(SERVICE_HINTS)}){BORDER_AFTER}"
CALL_TO_ACTION = rf"(?i)^(?:{any_of(CALLS_TO_ACTION)})"
