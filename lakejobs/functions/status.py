"""Pod phase, pod health and service status rules as column expressions
(OBS-8, OBS-11, OBS-12, OBS-13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEALTHY, PENDING, OFFLINE, UNKNOWN = "Healthy", "Pending", "Offline", "Unknown"
# Rank for "best status wins": Healthy > Pending > Offline.
STATUS_RANK = {OFFLINE: 0, PENDING: 1, HEALTHY: 2}


def pod_phase(deletion_ts: str = "deletion_ts", statuses: str = "statuses",
              phase: str = "phase") -> Column:
    """Terminating when a deletion stamp is set; else the first waiting reason
    other than ContainerCreating; else the phase; else Unknown. Empty reasons
    and an empty phase count as missing."""
    waiting = F.filter(F.col(statuses), lambda s: s["waiting_reason"].isNotNull()
                       & ~s["waiting_reason"].isin("", "ContainerCreating"))
    return F.coalesce(F.when(F.col(deletion_ts).isNotNull(), F.lit("Terminating")),
                      F.get(waiting, 0)["waiting_reason"],
                      F.nullif(F.col(phase), F.lit("")), F.lit(UNKNOWN))


def pod_health(phase: str = "phase", statuses: str = "statuses") -> Column:
    """Running and every container ready (at least one) -> Healthy; Running
    otherwise, or Pending -> Pending; anything else -> Offline."""
    st = F.coalesce(F.col(statuses), F.array())
    all_ready = (F.size(st) > 0) & F.forall(st, lambda s: F.coalesce(s["ready"], F.lit(False)))
    return (F.when(F.col(phase) == "Running", F.when(all_ready, F.lit(HEALTHY)).otherwise(F.lit(PENDING)))
            .when(F.col(phase) == "Pending", F.lit(PENDING))
            .otherwise(F.lit(OFFLINE)))


def status_rank(status: Column) -> Column:
    return (F.when(status == HEALTHY, 2).when(status == PENDING, 1).otherwise(0))


def rank_status(rank: Column) -> Column:
    """Inverse of :func:`status_rank`; a missing rank (no pods) is Offline."""
    return (F.when(rank == 2, F.lit(HEALTHY)).when(rank == 1, F.lit(PENDING))
            .otherwise(F.lit(OFFLINE)))
