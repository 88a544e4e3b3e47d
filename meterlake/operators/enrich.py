"""What every record gets, whatever its source: names, billing, cost, machine and defaults."""

from __future__ import annotations

import os
import socket
import subprocess
import sys
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlake.functions import models, pricing
from meterlake.schema import TOKENS


@lru_cache(maxsize=1)
def hardware() -> str:
    """The model of this machine where the system tells it, else its host name."""
    if sys.platform == "darwin":
        try:
            told = subprocess.run(["system_profiler", "SPHardwareDataType"], capture_output=True, text=True, timeout=20, check=True).stdout
            fields = dict(x.strip().split(": ", 1) for x in told.splitlines() if ": " in x)
            if name := fields.get("Model Name"):
                chip = fields.get("Chip", "").removeprefix("Apple ")
                return f"{name} ({chip})" if chip else name
        except (OSError, subprocess.SubprocessError):
            pass
    return socket.gethostname()


def machine() -> str:
    return os.environ.get("USAGE_MACHINE", "").strip() or hardware()


def with_session_env(records: DataFrame, env: DataFrame) -> DataFrame:
    """``records`` with base_url and env_present of their session; ``env`` has one row for each session.

    Spark chooses the join by size; the log keeps a few days only.
    """
    known = env.select(F.col("session").alias("session_id"), "base_url", F.lit(True).alias("env_present"))
    return records.join(known, "session_id", "left")


def enriched(records: DataFrame, env: DataFrame, workspace: str | None, label: str) -> DataFrame:
    """Records with model_norm, billing, cost, machine, workspace and outcome filled in."""
    filled = records.withColumns({t: F.coalesce(t, F.lit(0)).cast("long") for t in TOKENS})
    named = filled.withColumn("model_norm", models.normalize_model(F.col("model")))
    billed = with_session_env(named, env).withColumn("billing", models.classify_billing(F.col("source"), F.col("model"), F.col("base_url")))
    return pricing.priced(billed).withColumns(
        {"machine": F.lit(label), "workspace": F.coalesce("workspace", F.lit(workspace)), "outcome": F.coalesce("outcome", F.lit("ok"))}
    )
