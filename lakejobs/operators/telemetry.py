"""Platform telemetry as table jobs (OBS-1 ... OBS-22).

Inputs are exported records: pods (nested container spec and status arrays),
per-container metric samples, cluster events and log lines. Every operator
works on all pods / services / objects at once. Per-pod work uses array
functions on the row (containers per pod are few), so it needs no shuffle;
the shuffles left are the aggregations by pod and by service.
"""

from __future__ import annotations

import os
import re
import shutil
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakejobs.functions.quantity import cpu_millicores, mem_bytes, tail_size
from lakejobs.functions.status import (HEALTHY, PENDING, pod_health, pod_phase,
                                       rank_status, status_rank)
from lakejobs.operators.ordering import HOT_GROUP_ROWS, TOP_N_FAN_IN, split_hot, top_n
from lakejobs.plans.joins import bounded_broadcast

# Service display name -> pod label selector (label, value).
SERVICE_SELECTORS = [
    ("MinIO Storage", "v1.min.io/tenant", "minio"),
    ("Trino Analytics", "app.kubernetes.io/name", "trino"),
    ("Apache Airflow", "tier", "airflow"),
    ("Apache Superset", "app", "superset"),
    ("Milvus Vector Search", "app.kubernetes.io/name", "milvus"),
    ("Apache Polaris", "app", "polaris"),
    ("Keycloak", "app.kubernetes.io/name", "keycloak"),
]
# A service whose status is composed of the services it needs.
COMPOSITES = [("Unified SQL IDE", "Trino Analytics"), ("Unified SQL IDE", "Apache Polaris")]


def services_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SERVICE_SELECTORS, "service string, label string, value string")


def composites_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COMPOSITES, "service string, depends_on string")


# ---------------------------------------------------------------- services

def with_service(pods: DataFrame, services: DataFrame) -> DataFrame:
    """(service, pod columns) for every pod a selector matches (OBS-1). A pod
    matching two selectors appears under both. The selector table is small
    and checked before it is broadcast."""
    svc, _ = bounded_broadcast(services, 10_000)
    labels = pods.select("*", F.explode_outer("labels").alias("label", "value"))
    return (labels.join(svc, ["label", "value"], "inner")
            .drop("label", "value"))


def pick(pods: DataFrame, services: DataFrame, service: str | None = None,
         fragment: str | None = None) -> DataFrame:
    """Pods of one service (an unknown service name filters nothing) and/or
    whose name contains a fragment (all matches)."""
    out = pods
    if service is not None:
        sel = services.filter(F.col("service") == service)
        known = not sel.limit(1).isEmpty()
        if known:
            out = with_service(out, sel).drop("service")
    if fragment:
        out = out.filter(F.col("name").contains(fragment))
    return out


def service_status(pods: DataFrame, services: DataFrame) -> DataFrame:
    """Best pod health per service; a service with no pods is Offline (OBS-12).
    The per-service max is a partial aggregate, so a service holding most
    pods costs one row per task before the shuffle."""
    per_pod = with_service(pods, services).select(
        "service", status_rank(pod_health()).alias("rank"))
    best = per_pod.groupBy("service").agg(F.max("rank").alias("rank"))
    return (services.select("service").join(best, "service", "left")
            .select("service", rank_status(F.col("rank")).alias("status")))


def composite_status(status: DataFrame, composites: DataFrame) -> DataFrame:
    """Status of services made of others (OBS-13): all parts Healthy ->
    Healthy; any part Pending -> Pending; else Offline. A missing part counts
    as not Healthy and not Pending."""
    return _combine(status, composites)


def _combine(status: DataFrame, parts: DataFrame) -> DataFrame:
    j = parts.join(status.withColumnRenamed("service", "depends_on"), "depends_on", "left")
    return (j.groupBy("service")
            .agg(F.bool_and(F.coalesce(F.col("status") == HEALTHY, F.lit(False))).alias("all_h"),
                 F.bool_or(F.coalesce(F.col("status") == PENDING, F.lit(False))).alias("any_p"))
            .select("service", F.when(F.col("all_h"), F.lit(HEALTHY))
                    .when(F.col("any_p"), F.lit(PENDING)).otherwise(F.lit("Offline")).alias("status")))


def all_statuses(pods: DataFrame, services: DataFrame, composites: DataFrame) -> DataFrame:
    """Plain and composite services. A plain service is made of itself alone,
    so one aggregate over the small status table serves both kinds and the
    pods are read once."""
    own = services.select("service", F.col("service").alias("depends_on")).distinct()
    return _combine(service_status(pods, services), own.unionByName(composites.select("service", "depends_on")))


def health_summary(status: DataFrame, usage: DataFrame | None = None) -> DataFrame:
    """Healthy count and total (OBS-14); metrics availability (OBS-6), a
    scalar subquery that stops at the first usage row."""
    spark = status.sparkSession
    if usage is None:
        return spark.sql("SELECT count_if(status = 'Healthy') AS n_healthy, count(*) AS n_services "
                         "FROM {status}", status=status)
    return spark.sql(
        "SELECT count_if(status = 'Healthy') AS n_healthy, count(*) AS n_services, "
        "(SELECT count(*) > 0 FROM (SELECT 1 FROM {usage} LIMIT 1)) AS metrics_available "
        "FROM {status}", status=status, usage=usage)


# ---------------------------------------------------------------- pods

def pod_usage(metrics: DataFrame) -> DataFrame:
    """Per-pod CPU (millicores) and memory (bytes): the newest sample of each
    container, summed over the containers (OBS-2 ... OBS-4). Samples without a
    stamp are the oldest; of equally new ones the largest text wins."""
    newest = (metrics.groupBy("pod", "container")
              .agg(F.max(F.struct("ts", "cpu", "memory")).alias("s")))
    return (newest.select("pod", cpu_millicores("s.cpu").alias("cpu"), mem_bytes("s.memory").alias("mem"))
            .groupBy("pod").agg(F.sum("cpu").alias("cpu_millicores"), F.sum("mem").alias("mem_bytes")))


def with_usage(pods: DataFrame, usage: DataFrame) -> DataFrame:
    """Attach usage; pods without metrics keep nulls (OBS-5)."""
    return pods.join(usage.withColumnRenamed("pod", "name"), "name", "left")


def pod_readiness(pods: DataFrame) -> DataFrame:
    """Ready containers, total (statuses, else spec), restart sum with a
    missing count as 0, and the healthy flag used for ordering (OBS-7, 10)."""
    return (pods.select("name", *[c.alias(n) for n, c in _readiness().items()])
            .withColumn("all_ready", (F.col("ready") == F.col("total")) & (F.col("total") > 0)))


def _readiness() -> dict:
    st = F.coalesce(F.col("statuses"), F.array())
    spec = F.coalesce(F.col("spec"), F.array())
    ready = F.size(F.filter(st, lambda s: F.coalesce(s["ready"], F.lit(False))))
    total = F.coalesce(F.nullif(F.size(st), F.lit(0)), F.size(spec))
    restarts = F.aggregate(st, F.lit(0), lambda acc, s: acc + F.coalesce(s["restart_count"], F.lit(0)))
    return {"ready": ready, "total": total, "restarts": restarts}


def problems_first(readiness: DataFrame) -> DataFrame:
    """Not-all-ready pods first, then by name (binary order). A distributed
    range sort, not one task."""
    return readiness.orderBy(F.col("all_ready").asc(), F.col("name").asc_nulls_first())


def with_phase(pods: DataFrame) -> DataFrame:
    return pods.withColumn("display_phase", pod_phase())


def containers(pods: DataFrame) -> DataFrame:
    """One row per spec container with its status found by name in the same
    record (OBS-9): ready false and restarts 0 when there is no status; state
    Running > Waiting > Terminated > Unknown by the state that is set, with or
    without a reason or start time. An empty reason counts as missing."""
    return (pods.select(F.col("name").alias("pod"), F.explode(_container_details()).alias("c"))
            .select("pod", "c.*"))


def _container_details():
    def detail(s):
        stat = F.get(F.filter(F.coalesce(F.col("statuses"), F.array()),
                              lambda t: t["name"] == s["name"]), 0)
        waiting, ended = F.nullif(stat["waiting_reason"], F.lit("")), F.nullif(stat["terminated_reason"], F.lit(""))
        state = (F.when((stat["state"] == "running") | stat["running_started"].isNotNull(), F.lit("Running"))
                 .when((stat["state"] == "waiting") | waiting.isNotNull(), F.lit("Waiting"))
                 .when((stat["state"] == "terminated") | ended.isNotNull(), F.lit("Terminated"))
                 .otherwise(F.lit("Unknown")))
        return F.struct(s["name"].alias("container"), s["image"].alias("image"),
                        F.coalesce(stat["ready"], F.lit(False)).alias("ready"),
                        F.coalesce(stat["restart_count"], F.lit(0)).alias("restart_count"),
                        state.alias("state"), F.coalesce(waiting, ended).alias("reason"),
                        stat["running_started"].alias("started_at"))
    return F.transform(F.coalesce(F.col("spec"), F.array()), detail)


def pod_records(pods: DataFrame, usage: DataFrame) -> DataFrame:
    """The full record of every pod: display phase, readiness, node, address,
    start time (creation time when not started), labels, usage (null without
    metrics) and its containers, all on the row but for the usage join."""
    full = pods.select(
        "*", pod_phase().alias("__phase"), *[c.alias(n) for n, c in _readiness().items()],
        _container_details().alias("containers"))
    return with_usage(full, usage).select(
        "name", F.col("__phase").alias("phase"), "ready", "total", "restarts",
        F.nullif(F.col("node"), F.lit("")).alias("node"), F.nullif(F.col("pod_ip"), F.lit("")).alias("pod_ip"),
        F.coalesce("start_ts", "created_ts").alias("start_time"), F.col("created_ts").alias("created_at"),
        F.coalesce("labels", F.create_map().cast("map<string,string>")).alias("labels"),
        "cpu_millicores", "mem_bytes", "containers")


# ---------------------------------------------------------------- events

def normalise_events(events: DataFrame) -> DataFrame:
    """Defaults and fall-backs of a cluster event (OBS-15): last seen =
    last -> event time -> deprecated last -> created; first seen = first ->
    created -> last seen; type Normal and reason '' when missing; message ->
    note -> ''; count -> deprecated count -> 1, where 0 counts as missing;
    object ``kind/name``. ``warning`` marks Warnings (OBS-17)."""
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("Normal"))
    last = F.coalesce("last_ts", "event_ts", "deprecated_last_ts", "created_ts")
    return events.select(
        kind.alias("type"),
        F.coalesce(F.col("reason"), F.lit("")).alias("reason"),
        F.coalesce(F.nullif(F.col("message"), F.lit("")), F.col("note"), F.lit("")).alias("message"),
        F.concat(F.coalesce(F.col("kind"), F.lit("")), F.lit("/"),
                 F.coalesce(F.col("name"), F.lit(""))).alias("object"),
        F.coalesce(F.nullif(F.col("count"), F.lit(0)), F.nullif(F.col("deprecated_count"), F.lit(0)),
                   F.lit(1)).alias("count"),
        F.coalesce(F.col("first_ts"), F.col("created_ts"), last).alias("first_seen"),
        last.alias("last_seen"),
        (kind == "Warning").alias("warning"),
        F.col("name").alias("object_name"),
    )


def newest_first(events: DataFrame) -> DataFrame:
    """Newest first; an event without time sorts as the oldest (OBS-16)."""
    return events.orderBy(F.col("last_seen").desc_nulls_last())


def events_for(events: DataFrame, name: str) -> DataFrame:
    return events.filter(F.col("object_name") == name)


# ---------------------------------------------------------------- logs

def tail(logs: DataFrame, n=None, by=("pod", "container"), fan_in: int = TOP_N_FAN_IN) -> DataFrame:
    """Last ``n`` lines of every (pod, container) at once (OBS-18), newest
    first by (ts, line_no). Each task cuts a group to n rows before the
    shuffle; on wide inputs a first round over buckets of input tasks bounds
    what the task of a pod holding a third of all lines receives
    (:func:`ordering.top_n`)."""
    return _last_lines(logs, tail_size(n), by, fan_in)


def _last_lines(logs: DataFrame, n: int, by, fan_in: int = TOP_N_FAN_IN) -> DataFrame:
    return top_n(logs, list(by), [F.col("ts").desc(), F.col("line_no").desc()], n, fan_in)


# Fixed value: lines an agent asks for by default.
AGENT_TAIL_DEFAULT = 100


def platform_status(pods: DataFrame) -> DataFrame:
    """Name, raw phase and start time of every pod (agent status tool)."""
    return pods.select("name", "phase", F.col("start_ts").alias("start_time"))


def service_logs(logs: DataFrame, fragment: str, lines=AGENT_TAIL_DEFAULT) -> DataFrame:
    """Last ``lines`` lines of every pod whose name contains ``fragment``
    (agent log tool; there the first matching pod only, here all of them).
    The number is taken as asked; 0 gives no line."""
    return _last_lines(logs.filter(F.col("pod").contains(fragment)), int(lines), by=("pod",))


def grep(logs: DataFrame, text: str | None, col: str = "line") -> DataFrame:
    """Case-insensitive substring search; empty text keeps every line (OBS-19)."""
    if not text:
        return logs
    return logs.filter(F.lower(F.col(col)).contains(text.lower()))


# Fixed value: time stamp layout at the head of an exported line.
LOG_TS_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# Lines of one exported file at most.
EXPORT_FILE_ROWS = 1_000_000
# Characters that a folder ``column=value`` holds as %XX, and the value of a missing one, as Spark writes them.
FOLDER_ESCAPES = re.compile(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""")
MISSING_FOLDER = "__HIVE_DEFAULT_PARTITION__"


def _folder_files(top: str, by: str, file_rows: int):
    """Writes sorted rows (folder value, line) as text files ``by=value/part-*``
    under ``top``. A file gets its name, the same in every attempt of a task,
    when it is complete; until then it lies in ``_temporary``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{top}/_temporary/{uuid.uuid4().hex}"
        os.makedirs(own)
        task = TaskContext.get().partitionId()
        out, value, rows, part = None, None, 0, 0

        def finish():
            out.close()
            name = MISSING_FOLDER if value is None else FOLDER_ESCAPES.sub(lambda m: f"%{ord(m[0]):02X}", value)
            os.makedirs(f"{top}/{by}={name}", exist_ok=True)
            os.replace(f"{own}/open", f"{top}/{by}={name}/part-{task:05d}.c{part:03d}.txt")

        for b in batches:
            lines, at = b.column(1).to_pylist(), 0
            for v, same in groupby(b.column(0).to_pylist()):
                end = at + sum(1 for _ in same)
                while at < end:
                    if out is None or v != value or rows >= file_rows:
                        if out is not None:
                            finish()
                        part = part + 1 if out is not None and v == value else 0
                        out, value, rows = open(f"{own}/open", "wb"), v, 0
                    upto = min(end, at + file_rows - rows)
                    out.write(b"\n".join(lines[at:upto]) + b"\n")
                    rows, at = rows + upto - at, upto
        if out is not None:
            finish()
        yield from ()
    return run


def _drop_folders(top: str, shares: int):
    """Deletes the given shares of the folders under ``top``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = set(b.column(0).to_pylist())
            for name in os.listdir(top):
                if zlib.crc32(os.fsencode(name)) % shares in own:
                    shutil.rmtree(f"{top}/{name}", ignore_errors=True)
        yield from ()
    return run


def export(logs: DataFrame, path: str, by: str = "pod", hot_rows: int = HOT_GROUP_ROWS,
           file_rows: int = EXPORT_FILE_ROWS) -> None:
    """Write log lines as plain text files, one folder per pod (OBS-22). Lines
    are in order of time and line number inside each file. A new export replaces
    the last one whole, pods that are gone included.

    Opening a file per pod is the work, however few bytes the lines have, so
    pods are dealt out over all shuffle partitions, which are not merged by
    size. A pod of more than about ``hot_rows`` lines is too large for one task:
    such pods are rebalanced, and split over several files, by size.

    On a mounted folder (``file:``) Hadoop starts a process for the permissions
    of every file and folder that it makes, which takes nearly all the time of
    small files. There the tasks make the files themselves, in a folder beside
    ``path`` that takes its place when all are done; other file systems are
    written by Spark's text writer."""
    spark = logs.sparkSession
    line = F.concat_ws(" ", F.date_format("ts", LOG_TS_FORMAT), F.col("line"))
    folder = F.nullif(F.col(by).cast("string"), F.lit(""))
    usual, hot = split_hot(logs.select(folder.alias(by), "ts", "line_no", line.alias("value")), [by], hot_rows)
    dealt = usual.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), by)
    if hot is not None:
        dealt = dealt.unionByName(hot.hint("rebalance", F.col(by)))
    files = dealt.sortWithinPartitions(by, "ts", "line_no").select(by, "value")
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    to = fs.makeQualified(to)
    if to.toUri().getScheme() != "file":
        (files.write.mode("overwrite").option("partitionOverwriteMode", "static")
         .option("maxRecordsPerFile", file_rows).partitionBy(by).text(path))
        return
    new = to.suffix(f".{uuid.uuid4().hex}")
    try:
        fs.mkdirs(new)
        (files.select(by, F.col("value").cast("binary"))
         .mapInArrow(_folder_files(new.toUri().getPath(), by, file_rows), "none int")
         .write.format("noop").mode("overwrite").save())
        fs.delete(new.suffix("/_temporary"), True)
        fs.create(new.suffix("/_SUCCESS")).close()
        old = to.suffix(f".{uuid.uuid4().hex}") if fs.exists(to) else None
        if old is not None and not fs.rename(to, old):
            raise OSError(f"cannot replace the export {to}")
        if not fs.rename(new, to):
            if old is not None:
                fs.rename(old, to)
            raise OSError(f"cannot move the export to {to}")
    except BaseException:
        fs.delete(new, True)
        raise
    if old is not None:
        n = spark.sparkContext.defaultParallelism
        try:
            (spark.range(n, numPartitions=n).mapInArrow(_drop_folders(old.toUri().getPath(), n), "none int")
             .write.format("noop").mode("overwrite").save())
        finally:
            fs.delete(old, True)


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The exported lines. The pod is text, so ``007`` stays ``007``. It is read
    off each file's folder: Spark's partition discovery takes time that grows as
    the square of the number of folders."""
    pod = F.regexp_extract(F.col("_metadata.file_path"), "/pod=([^/]*)/[^/]*$", 1)
    for _ in range(2):  # of the path as a URL, then of the folder's name; there a plus is no blank
        pod = F.url_decode(F.replace(pod, F.lit("+"), F.lit("%2B")))
    return (spark.read.schema("value string").option("recursiveFileLookup", "true").text(path)
            .select(F.nullif(pod, F.lit(MISSING_FOLDER)).alias("pod"), F.col("value").alias("line")))
