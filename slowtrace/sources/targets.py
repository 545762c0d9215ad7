"""Choosing the processes to look at."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from slowtrace.functions.scalars import KTHREAD_FLAG


def select_targets(
    procs: DataFrame,
    pids: Sequence[int] | DataFrame | None = None,
    name: str | None = None,
    kthread: bool = False,
) -> DataFrame:
    """Processes by explicit pid **or** by a regex on the command, never both.

    ``procs(pid, comm, flags)``; parentheses around the command are stripped. The regex
    only looks at user processes, or only at kernel threads with ``kthread``.
    """
    if (pids is None) == (name is None):
        raise ValueError("give either pids or name")
    cleaned = procs.withColumn("comm", F.regexp_replace("comm", r"[()]", ""))
    if pids is not None:
        if isinstance(pids, DataFrame):
            return cleaned.join(pids.select("pid").distinct(), ["pid"], "left_semi")
        return cleaned.filter(F.col("pid").isin(*pids))
    is_kthread = F.col("flags").bitwiseAND(F.lit(KTHREAD_FLAG)) != 0
    return cleaned.filter(is_kthread == F.lit(kthread)).filter(F.col("comm").rlike(name))
