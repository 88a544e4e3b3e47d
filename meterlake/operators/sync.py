"""Export of new and changed records in pages, through a transport that is handed in."""

from __future__ import annotations

import json
import logging
import os
import urllib.request
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions.times import stamp
from meterlake.operators.ledger import Store
from meterlake.schema import LEDGER

PAGE, PAGES = 500, 200
#: Columns that are not sent.
HELD_BACK = ("id", "synced_at", "cache_write_1h_tokens")
Transport = Callable[[str], None]
log = logging.getLogger(__name__)


def eligible(records: DataFrame) -> DataFrame:
    """Records never sent, or written again since."""
    return records.where(F.col("synced_at").isNull() | (F.col("ingested_at") > F.col("synced_at")))


def pages(records: DataFrame, size: int = PAGE, most: int = PAGES) -> DataFrame:
    """The first ``size * most`` eligible records by id, as the export is limited to."""
    return eligible(records).orderBy("id").limit(size * most)


def payload(records: DataFrame, with_hour_tokens: bool = False) -> DataFrame:
    """One JSON object per record, nulls included; ``raw`` is an object in it, or null if it is no JSON."""
    kept = [c for c in LEDGER.names if c not in HELD_BACK or with_hour_tokens and c == "cache_write_1h_tokens"]
    fields = [F.try_parse_json("raw").alias("raw") if c == "raw" else F.col(c) for c in kept]
    return records.select("id", "source", "source_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("body"))


def http_transport(url: str, token: str) -> Transport:
    """Posts to ``{url}/usage/records``; raises on anything but success."""

    def post(body: str) -> None:
        request = urllib.request.Request(f"{url}/usage/records", body.encode(), {"Authorization": f"Bearer {token}", "Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=60) as answer:
            answer.read()

    return post


def from_environment() -> Transport | None:
    """The transport that the environment sets, or None where it sets no address or token."""
    url, token = os.environ.get("ARGO_URL"), os.environ.get("ARGO_TOKEN")
    return http_transport(url, token) if url and token else None


def sync(store: Store, transport: Transport | None, size: int = PAGE, most: int = PAGES) -> tuple[int, int]:
    """Send eligible records page by page until one fails; returns records and pages sent.

    Every page is acknowledged as soon as it was sent, in a small file of its own, so a run that is
    cut off sends no page again; the ledger takes these in at the end, or at the start of the next
    run. Pages go to the driver one after the other, and there are ``size * most`` records in a run.
    """
    if transport is None:
        log.info("sync disabled (no address or token)")
        return 0, 0
    store.settle()
    sent, n = 0, 0
    rows = payload(pages(store.records.read(), size, most)).orderBy("id").toLocalIterator()
    while page := [r for _, r in zip(range(size), rows, strict=False)]:
        try:
            transport('{"records":[' + ",".join(r["body"] for r in page) + "]}")
        except Exception as error:  # any transport failure ends the run and leaves the rest for the next
            log.error("sync failed: %s", error)
            break
        store.acknowledge([(r["source"], r["source_id"]) for r in page], stamp(datetime.now(UTC)))
        sent, n = sent + len(page), n + 1
    store.settle()
    return sent, n


def parsed(body: str) -> list[dict]:
    return json.loads(body)["records"]
