"""Reports as text in fixed columns."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Row


def fixed(value: float, digits: int) -> str:
    """``value`` to so many digits, rounded half up from its exact binary value."""
    return str(Decimal(value).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def dollars(value: float) -> str:
    return "$" + fixed(value, 4 if value < 10 else 2)


def error_share(errors: int, total: int) -> str:
    if not total:
        return "-"
    return fixed(errors / total * 100, 1) + "%" if errors else "0%"


def table(heads: Sequence[tuple[str, int]], rows: Sequence[Sequence[str]]) -> list[str]:
    """Cells padded to their widths, to the right where the width is negative, and never cut."""
    return ["  ".join(c.rjust(-w) if w < 0 else c.ljust(w) for c, (_, w) in zip(row, heads, strict=True)) for row in [[h for h, _ in heads], *rows]]


def stats(rows: Sequence[Row], by: str) -> str:
    if not rows:
        return "(no data — run `ingest` first)"
    heads = [(by, 22), ("records", -9), ("input", -13), ("output", -12), ("cacheW", -12), ("cost $", -11)]
    count = lambda n: f"{n or 0:,}"
    cells = [
        [r["key"] or "", count(r["records"]), count(r["input_tokens"]), count(r["output_tokens"]), count(r["cache_write_tokens"]), "n/a" if r["cost_usd"] is None else dollars(r["cost_usd"])]
        for r in rows
    ]
    total = ["TOTAL", "", "", "", "", dollars(sum(r["cost_usd"] or 0.0 for r in rows))]
    head, *body = table(heads, [*cells, total])
    rule = "-" * len(head)
    return "\n".join([head, rule, *body[:-1], rule, body[-1]])


def source_status(rows: Sequence[Row]) -> str:
    if not rows:
        return "(no collector state yet — run `ingest`)"
    heads = [("source", 14), ("records", -9), ("status", 9), ("err%", -7), ("last run (UTC)", 22), ("note", 0)]
    return "\n".join(table(heads, [[r["source"], f"{r['records']:,}", r["last_status"] or "-", error_share(r["errors"], r["total"]), r["last_run_at"] or "-", r["last_note"] or ""] for r in rows]))


def billing_audit(rows: Sequence[Row]) -> str:
    if not rows:
        return "(no claude-code sessions in range)"
    heads = [("session", 36), ("rows", -5), ("models", 24), ("billing", 14), ("live", 15), ("last (UTC)", 20), ("flags", 0)]
    flags = [" ".join(["MULTI-BILLING"] * r["multi_billing"] + ["MISMATCH"] * r["mismatch"]) for r in rows]
    head, *body = table(heads, [[r["session_id"], f"{r['records']:,}", r["models"], r["billings"], r["live_label"], r["last_ts"], f] for r, f in zip(rows, flags, strict=True)])
    rule = "-" * len(head)
    return "\n".join([head, rule, *body, rule, f"{len(rows)} session{'s' * (len(rows) != 1)}, {sum(map(bool, flags))} flagged"])
