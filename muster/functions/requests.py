"""Checks on search requests and search headers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.functions.text import is_blank, is_missing

# The modes a request may name, and the delays it gets by default.
CREATE_NEW = "create_new"
REUSE_LATEST = "reuse_latest"
REUSE_LATEST_OR_CREATE = "reuse_latest_or_create"
MODES = (CREATE_NEW, REUSE_LATEST, REUSE_LATEST_OR_CREATE)
DELAY_WITH_KEY = 0.10
DELAY_WITHOUT_KEY = 0.34
DEFAULT_PAGE_SIZE = 1000
DEFAULT_MAX_ATTEMPTS = 5


def mode_is_valid(mode: Column) -> Column:
    """Exact, case-sensitive membership; null is invalid."""
    return F.coalesce(mode.isin(*MODES), F.lit(False))


def request_violation(
    email: Column,
    query: Column,
    page_size: Column,
    max_attempts: Column,
    delay: Column | None = None,
) -> Column:
    """The first rule a request breaks, or null. A negative delay is legal unless ``delay`` is given."""
    found = (
        F.when(is_missing(email), "email_required")
        .when(is_blank(query), "blank_query")
        .when(F.coalesce(page_size, F.lit(0)) <= 0, "page_size_not_positive")
        .when(F.coalesce(max_attempts, F.lit(0)) <= 0, "max_attempts_not_positive")
    )
    if delay is not None:
        found = found.when(delay < 0, "negative_delay")
    return found


def resolved_delay(delay: Column, api_key: Column) -> Column:
    """The delay asked for, or the default for callers with and without a key."""
    default = F.when(is_missing(api_key), DELAY_WITHOUT_KEY).otherwise(DELAY_WITH_KEY)
    return F.coalesce(delay.cast("double"), default)


def header_is_broken(reported_count: Column, web_env: Column, query_key: Column) -> Column:
    """True when results are reported but the session they belong to is not named."""
    return (reported_count > 0) & (is_missing(web_env) | is_missing(query_key))
