"""Row and label predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadloom.functions import patterns as P
from leadloom.functions.text import strip


def is_service_hint(label: Column) -> Column:
    """Label names a service by one of the hint words and is not a plain menu label."""
    return ~F.lower(label).isin(*P.SKIP_LABELS) & label.rlike(P.HINT_WORD)


def reads_like_service(label: Column) -> Column:
    """Neither a question nor a call to action."""
    return ~F.contains(label, F.lit("?")) & ~strip(label).rlike(P.CALL_TO_ACTION)


def is_likely_service(label: Column) -> Column:
    lowered = F.lower(label)
    return (
        ~lowered.isin(*P.SKIP_LABELS)
        & ~lowered.rlike(P.any_of(P.SERVICE_NOISE))
        & ~lowered.rlike(P.any_of(P.COPYRIGHT_MARKS))
        & F.length(label).between(3, 80)
        & label.rlike("[A-Za-z]{3}")
        & ~(F.contains(label, F.lit("@")) & label.rlike(P.EMAIL))
    )


def has_website(website: Column) -> Column:
    return F.coalesce(website, F.lit("")) != ""


def is_missing(value: Column) -> Column:
    """Blank, or one of the placeholder texts."""
    text = F.lower(strip(F.coalesce(value, F.lit(""))))
    return (text == "") | text.isin(*P.PLACEHOLDERS)


def counts_as_email(value: Column) -> Column:
    return ~is_missing(value)


def is_login_wall(final_url: Column, *marks: str) -> Column:
    """The request ended on a page whose address shows a login or a verification wall."""
    return F.lower(final_url).rlike(P.any_of(marks or ("login",)))


def is_verification_page(final_url: Column, html: Column) -> Column:
    return F.contains(F.lower(final_url), F.lit("sorry")) | F.contains(F.lower(html), F.lit("captcha"))
