"""Failures of fetching as columns: whether to try soon again, what they are to a user, and how they are told.

A failure is its kind (`KINDS`), and by kind an HTTP status, what the server asks to wait in seconds, a size in bytes, or a detail.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds of failures.
KINDS = ("policy", "dns", "timeout", "http", "too_large", "redirects", "network")


def is_temporary(kind: Column, status: Column) -> Column:
    """Whether it may pass by itself. An unknown kind or status is taken for lasting."""
    busy = F.coalesce((status == 429) | (status >= 500), F.lit(False))
    return F.coalesce(kind.isin("timeout", "dns", "network") | ((kind == "http") & busy), F.lit(False))


def category(kind: Column, status: Column) -> Column:
    """authentication, authorization, or network for all else."""
    http = kind == "http"
    return F.when(http & (status == 401), "authentication").when((http & (status == 403)) | (kind == "policy"), "authorization").otherwise("network")


def described(kind: Column, status: Column, retry_after: Column, size: Column, detail: Column) -> Column:
    """In plain words; null for an unknown kind. What is not known of a failure is left out as an empty text."""
    told = lambda before, c, after="": F.concat(F.lit(before), F.coalesce(c.cast("string"), F.lit("")), F.lit(after))
    http = (
        F.when(status.isin(404, 410), told("Source unavailable (HTTP ", status, ")"))
        .when(status == 429, F.concat(F.lit("Rate limited (HTTP 429)"), F.when(retry_after.isNull(), "").otherwise(told("; asked to wait ", retry_after, "s"))))
        .when(status >= 500, told("Server error (HTTP ", status, ")"))
        .otherwise(told("HTTP ", status))
    )
    return (
        F.when(kind == "http", http).when(kind == "dns", told("Could not resolve the host (", detail, ")")).when(kind == "timeout", "Timed out").when(kind == "policy", told("Not fetched: ", detail))
        .when(kind == "too_large", told("Document larger than ", F.floor(size / (1024 * 1024)), " MB")).when(kind == "redirects", "Too many redirects").when(kind == "network", told("Network error (", detail, ")"))
    )


def asked_to_wait(kind: Column, retry_after: Column) -> Column:
    """The seconds that a server asked to wait, where one answered."""
    return F.when(kind == "http", retry_after)
