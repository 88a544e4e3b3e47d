"""The command line: ``python -m meterlake.cli``."""

from __future__ import annotations

import logging
import os
import sys
import traceback
from datetime import UTC, datetime

from pyspark.sql import functions as F

from meterlake import ingest, report_text
from meterlake.functions.times import cutoff
from meterlake.operators import reports, sync
from meterlake.operators.ledger import Store
from meterlake.session import session
from meterlake.sources import lines, records, registry

HELP = """meterlake - token and cost telemetry on Spark

USAGE
  python -m meterlake.cli <command> [options]

COMMANDS
  ingest                 Read all sources from where they were left (the default)
    --full               From the start
    --remember-sessions  Keep what the session log tells, also after its lines have gone
    --source <name>      One source: claude-code, hermes, feuer, opencode, litellm or sideclaw-iu
  sync                   Export new and changed records
  stats                  Tokens and cost of successful requests
    --by <key>           source (default), model, billing, day, machine or sub_tool
    --since <N>          The last N days
  sources                State of each source
  billing-audit          Billing by session against the session log
    --since <N>          The last N days (default 3)
    --session <id>       One session
  help                   This text

ENVIRONMENT
  USAGE_DB               Folder of the ledger
  USAGE_MACHINE          Name of this machine
  ARGO_URL, ARGO_TOKEN   Address and token of the export; without both it is off
  HERMES_DB, FEUER_DB, LITELLM_USAGE_LOG, SIDECLAW_SESSIONS_LOG, SIDECLAW_IU_USAGE_LOG
                         Where the sources are
"""


def folder() -> str:
    return os.environ.get("USAGE_DB") or os.path.join(os.path.expanduser("~"), ".local", "share", "meterlake")


def option(args: list[str], name: str) -> str | None:
    at = args.index(name) if name in args else len(args)
    return args[at + 1] if at + 1 < len(args) else None


def days(args: list[str], default: float | None) -> float | None:
    text = option(args, "--since")
    return float(text) if text else default


def run(args: list[str]) -> int:
    command, rest = (args[0], args[1:]) if args else ("ingest", [])
    if command in ("help", "--help", "-h"):
        print(HELP, end="")
        return 0
    if command not in ("ingest", "sync", "stats", "sources", "billing-audit"):
        print(f'unknown command "{command}"\n\n{HELP}', end="", file=sys.stderr)
        return 2
    spark = session()
    store, paths, now = Store(spark, folder(), cut="month"), registry.Paths.from_environment(), datetime.now(UTC)
    if command == "ingest":
        results = ingest.run(spark, store, paths, "--full" in rest, option(rest, "--source"), sync.from_environment(), remember="--remember-sessions" in rest)
        for r in results:
            print(f"{r.source:<14} {r.status:<8} +{r.new_rows} new / {r.processed} seen" + (f" ({r.note})" if r.note else ""))
        print(f"\ndb: {folder()}")
        return int(any(r.status == "error" for r in results))
    if command == "sync":
        sent, n = sync.sync(store, sync.from_environment())
        print(f"sync: {sent} records pushed in {n} batch{'es' * (n != 1)}")
    elif command == "stats":
        by = option(rest, "--by") or "source"
        print(report_text.stats(reports.ordered_stats(reports.stats(store.records.read(since=cutoff(now, days(rest, None))), by, days(rest, None), now)).collect(), by))
    elif command == "sources":
        print(report_text.source_status(reports.status_of(store.state.read(), store.totals().withColumnRenamed("records_total", "total")).orderBy("source").collect()))
    else:
        env = records.session_env(lines.scan(spark, paths.session_env))
        found = reports.billing_audit(store.records.read(since=cutoff(now, days(rest, 3))), env, days(rest, 3), option(rest, "--session"), now)
        print(report_text.billing_audit(found.orderBy(F.desc("last_ts"), "session_id").collect()))
    return 0


def main() -> int:
    logging.basicConfig(stream=sys.stderr, format="%(asctime)s %(levelname)s %(message)s", level=logging.INFO)
    try:
        return run(sys.argv[1:])
    except Exception:
        print(f"fatal: {traceback.format_exc()}", end="", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
