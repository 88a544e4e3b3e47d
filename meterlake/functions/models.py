"""Model names and billing classes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space around a model name: all of Unicode's and the byte-order mark.
BLANK = r"[\s\p{Z}\x{FEFF}]"
TRANSCRIPTS = "claude-code"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def normalize_model(raw: Column) -> Column:
    """The canonical name used for prices and groups; null for null and the empty text.

    A JSON object gives its ``id``; then lower case, the last path segment, and no ``-eu`` and no date at the end.
    """
    name = trimmed(raw)
    inner = F.when(name.startswith("{"), F.nullif(F.get_json_object(name, "$.id"), F.lit("")))
    last = F.element_at(F.split(F.lower(F.coalesce(inner, name)), "/"), -1)
    bare = F.regexp_replace(F.regexp_replace(last, r"-eu\z", ""), r"-(?:[0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2})\z", "")
    return F.when(raw != "", bare)


def is_bridge_routed(raw: Column) -> Column:
    """Whether another source already counts the request: no plain Claude name, or one that ends in ``-eu``."""
    name = F.lower(F.coalesce(raw, F.lit("")))
    return ~name.startswith("claude") | name.endswith("-eu")


def classify_billing(source: Column, raw: Column, base_url: Column) -> Column:
    """Who pays: ``max`` only for transcripts of plain Claude models whose session had no base url."""
    subscribed = (source == TRANSCRIPTS) & ~is_bridge_routed(raw) & (F.coalesce(base_url, F.lit("")) == "")
    return F.when(subscribed, "max").otherwise("iu")


def live_label(present: Column, base_url: Column) -> Column:
    """What the session log says now: absent, with a base url, or without."""
    known = F.coalesce(present, F.lit(False))
    return F.when(~known, "expired/missing").when(F.coalesce(base_url, F.lit("")) != "", "iu (ca)").otherwise("max (c)")
