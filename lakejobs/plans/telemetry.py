"""Registered telemetry queries: pods from ``customer``, metric samples, cluster
events and log lines from ``events``; oracles over the same derivations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakejobs.operators import telemetry as O
from lakejobs.plans.derived import duck_text, spark_input
from lakejobs.schemas import CONTAINER_SPEC, CONTAINER_STATUS
from lakejobs.session import work_dir

CONTAINER_NAMES = ("app", "sidecar", "proxy")

def _svc(col):
    vals = [s[1] if col == "label" else s[2] for s in O.SERVICE_SELECTORS]
    return "CASE c_nationkey % 8 " + " ".join(
        f"WHEN {i} THEN '{v}'" for i, v in enumerate(vals)) + " END"


def _container_cols():
    out = []
    for i, cname in enumerate(CONTAINER_NAMES, 1):
        present = "TRUE" if i == 1 else f"k % 3 >= {i - 1}"
        out += [
            f"CASE WHEN {present} THEN '{cname}' END AS c{i}_name",
            f"concat('registry/{cname}:', CAST(k % 4 AS STRING)) AS c{i}_image",
            f"({present}) AND phase IS NOT NULL AND NOT (phase = 'Pending' AND x % 3 = 0)"
            f"{' AND x % 2 = 1' if i == 3 else ''} AS c{i}_has_status",
            f"(x + {i}) % 4 <> 0 AS c{i}_ready",
            f"CASE WHEN (x + {i}) % 5 = 0 THEN NULL ELSE CAST((x + {i}) % 3 AS INT) END AS c{i}_restarts",
            f"CASE WHEN (x + {i}) % 4 <> 0 AND x % 7 <> 0 THEN '2024-01-02 03:04:05' END AS c{i}_running",
            f"CASE WHEN (x + {i}) % 4 = 0 AND (x + k) % 2 = 0 THEN "
            f"(CASE (x + {i}) % 5 WHEN 0 THEN 'ContainerCreating' WHEN 1 THEN '' WHEN 2 THEN NULL "
            f"ELSE 'CrashLoopBackOff' END) END AS c{i}_waiting",
            f"CASE WHEN (x + {i}) % 4 = 0 AND (x + k) % 2 = 1 THEN "
            f"(CASE x % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'Error' END) END AS c{i}_terminated",
            f"CASE WHEN (x + {i}) % 4 <> 0 THEN 'running' WHEN k % 13 = 0 THEN NULL "
            f"WHEN (x + k) % 2 = 0 THEN 'waiting' ELSE 'terminated' END AS c{i}_state",
        ]
    return ",\n       ".join(out)


# One wide row per pod; container i in columns c{i}_*. Text timestamps.
PODS_FLAT = f"""
SELECT p.*,
       {_container_cols()}
FROM (
  SELECT concat('pod-', lpad(CAST(c_custkey AS STRING), 6, '0')) AS name,
         c_custkey AS k,
         CAST(floor(abs(c_acctbal)) AS BIGINT) AS x,
         CASE WHEN c_acctbal < -500 THEN '2024-01-31 00:00:00' END AS deletion_ts,
         CASE c_mktsegment WHEN 'BUILDING' THEN 'Running' WHEN 'AUTOMOBILE' THEN 'Running'
              WHEN 'MACHINERY' THEN 'Pending'
              WHEN 'HOUSEHOLD' THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'Failed' END END AS phase,
         {_svc('label')} AS svc_label,
         {_svc('value')} AS svc_value,
         lower(c_mktsegment) AS segment,
         CASE WHEN c_mktsegment = 'MACHINERY' THEN NULL
              WHEN c_nationkey % 6 = 0 THEN ''
              ELSE concat('node-', CAST(c_nationkey % 5 AS STRING)) END AS node,
         concat('10.', CAST(c_nationkey AS STRING), '.', CAST(c_custkey % 250 AS STRING)) AS pod_ip,
         CASE WHEN c_acctbal > 0 THEN '2024-01-02 03:04:05' END AS start_ts,
         '2024-01-01 00:00:00' AS created_ts
  FROM {{customer}}) p
"""

_POD_NAME = "concat('pod-', lpad(CAST(user_id AS STRING), 6, '0'))"
_N = "CAST(floor(value) AS BIGINT)"

# One metric sample per event: pod of the user, container by event id.
METRICS = f"""
SELECT {_POD_NAME} AS pod,
       CASE event_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'sidecar' ELSE 'proxy' END AS container,
       CASE event_id % 4
         WHEN 0 THEN concat(CAST(CAST(floor(value * 1000) AS BIGINT) * 1000 AS STRING), 'n')
         WHEN 1 THEN concat(CAST({_N} AS STRING), 'u')
         WHEN 2 THEN concat(CAST({_N} AS STRING), 'm')
         ELSE CASE WHEN value < 1 THEN '' ELSE CAST(CAST(floor(value / 100) AS BIGINT) AS STRING) END
       END AS cpu,
       CASE {_N} % 6
         WHEN 0 THEN concat(CAST({_N} AS STRING), 'Ki')
         WHEN 1 THEN concat(CAST({_N} AS STRING), 'Mi')
         WHEN 2 THEN concat(CAST({_N} AS STRING), '.5Ki')
         WHEN 3 THEN concat(CAST({_N} AS STRING), 'M')
         WHEN 4 THEN concat(CAST({_N} AS STRING), 'Xi')
         ELSE CASE WHEN {_N} % 4 = 1 THEN 'x' ELSE CAST({_N} AS STRING) END
       END AS memory,
       CASE WHEN event_id % 50 = 0 THEN NULL ELSE date_trunc('hour', ts) END AS ts
FROM {{events}}
"""

CLUSTER_EVENTS = f"""
SELECT event_id,
       CASE event_type WHEN 'error' THEN 'Warning' WHEN 'signup' THEN NULL
                       WHEN 'view' THEN '' ELSE 'Normal' END AS type,
       CASE WHEN value < 2 THEN NULL
            ELSE concat(upper(substr(event_type, 1, 1)), substr(event_type, 2)) END AS reason,
       CASE WHEN value < 3 THEN NULL WHEN event_id % 10 = 3 THEN ''
            ELSE concat(event_type, ' ', props) END AS message,
       CASE WHEN event_id % 4 = 1 THEN NULL ELSE concat('note ', event_type) END AS note,
       CASE WHEN value < 1 THEN NULL ELSE 'Pod' END AS kind,
       CASE WHEN value > 200 THEN NULL ELSE {_POD_NAME} END AS name,
       CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 7 = 0 THEN NULL
            ELSE CAST(event_id % 9 AS INT) END AS count,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id % 4 AS INT) END AS deprecated_count,
       CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts - INTERVAL '1' HOUR END AS first_ts,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE ts END AS last_ts,
       CASE WHEN event_id % 8 = 0 THEN ts + INTERVAL '1' MINUTE END AS event_ts,
       CASE WHEN event_id % 16 = 0 THEN ts + INTERVAL '2' MINUTE END AS deprecated_last_ts,
       CASE WHEN event_id % 32 = 0 THEN NULL ELSE ts - INTERVAL '2' HOUR END AS created_ts
FROM {{events}}
"""

LOG_LINES = f"""
SELECT {_POD_NAME} AS pod,
       CASE event_id % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'sidecar' ELSE 'proxy' END AS container,
       ts, event_id AS line_no,
       concat(upper(event_type), ' ', props, ' cents=', CAST(CAST(floor(value * 100) AS BIGINT) AS STRING)) AS line
FROM {{events}}
"""


def pods(spark, sf_dir):
    """Nested pod records from the wide derivation, built per row (no shuffle)."""
    flat = spark_input(spark, sf_dir, PODS_FLAT)
    ts = lambda c: F.col(c).cast("timestamp_ntz")
    spec = F.filter(F.array(*[
        F.struct(F.col(f"c{i}_name").alias("name"), F.col(f"c{i}_image").alias("image"))
        for i in range(1, 4)]), lambda s: s["name"].isNotNull()).cast(f"array<{CONTAINER_SPEC.simpleString()}>")
    statuses = F.filter(F.array(*[
        F.when(F.col(f"c{i}_has_status"), F.struct(
            F.col(f"c{i}_name").alias("name"), F.col(f"c{i}_ready").alias("ready"),
            F.col(f"c{i}_restarts").alias("restart_count"), ts(f"c{i}_running").alias("running_started"),
            F.col(f"c{i}_waiting").alias("waiting_reason"),
            F.col(f"c{i}_terminated").alias("terminated_reason"), F.col(f"c{i}_state").alias("state")))
        for i in range(1, 4)]), lambda s: s.isNotNull()).cast(f"array<{CONTAINER_STATUS.simpleString()}>")
    labels = F.when(F.col("svc_label").isNull(), F.create_map(F.lit("segment"), F.col("segment"))) \
        .otherwise(F.create_map(F.col("svc_label"), F.col("svc_value"), F.lit("segment"), F.col("segment")))
    return flat.select("name", ts("deletion_ts").alias("deletion_ts"), "phase", labels.alias("labels"),
                       "node", "pod_ip", ts("start_ts").alias("start_ts"), ts("created_ts").alias("created_ts"),
                       spec.alias("spec"), statuses.alias("statuses"))


def metrics(spark, sf_dir):
    return spark_input(spark, sf_dir, METRICS).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def cluster_events(spark, sf_dir):
    return spark_input(spark, sf_dir, CLUSTER_EVENTS)


def log_lines(spark, sf_dir):
    return spark_input(spark, sf_dir, LOG_LINES)


# ---------------------------------------------------------------- queries

def q_obs_usage(spark, sf_dir):
    usage = O.pod_usage(metrics(spark, sf_dir))
    out = O.with_usage(pods(spark, sf_dir).select("name"), usage)
    return out.select("name", F.round("cpu_millicores", 3).alias("cpu_millicores"), "mem_bytes")


def q_obs_pods(spark, sf_dir):
    full = O.pod_records(pods(spark, sf_dir), O.pod_usage(metrics(spark, sf_dir)))
    labels = F.array_join(F.array_sort(F.transform(F.map_entries("labels"),
                                                   lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")
    return full.select("name", "phase", "ready", "total", "restarts", "node", "pod_ip", "start_time", "created_at",
                       labels.alias("labels"), F.round("cpu_millicores", 3).alias("cpu_millicores"), "mem_bytes",
                       F.size("containers").alias("n_containers"),
                       F.size(F.filter("containers", lambda c: c["state"] == "Running")).alias("n_running"))


def q_obs_readiness(spark, sf_dir):
    return O.problems_first(O.pod_readiness(pods(spark, sf_dir)))


def q_obs_containers(spark, sf_dir):
    return O.containers(pods(spark, sf_dir))


def q_obs_phase(spark, sf_dir):
    return O.with_phase(pods(spark, sf_dir)).select("name", F.col("display_phase").alias("phase"))


def q_obs_service_status(spark, sf_dir):
    return O.service_status(pods(spark, sf_dir), O.services_df(spark))


def q_obs_composite(spark, sf_dir):
    return O.all_statuses(pods(spark, sf_dir), O.services_df(spark), O.composites_df(spark))


def q_obs_summary(spark, sf_dir):
    st = O.all_statuses(pods(spark, sf_dir), O.services_df(spark), O.composites_df(spark))
    return O.health_summary(st, O.pod_usage(metrics(spark, sf_dir)))


PICK_SERVICE, PICK_FRAGMENT = "Trino Analytics", "1"


def q_obs_pick(spark, sf_dir):
    return O.pick(pods(spark, sf_dir), O.services_df(spark), PICK_SERVICE, PICK_FRAGMENT).select("name")


def q_obs_events(spark, sf_dir):
    return O.newest_first(O.normalise_events(cluster_events(spark, sf_dir))).drop("object_name")


EVENTS_OBJECT = "pod-000007"


def q_obs_events_for(spark, sf_dir):
    return O.events_for(O.normalise_events(cluster_events(spark, sf_dir)), EVENTS_OBJECT) \
        .select("type", "reason", "object", "count", "last_seen", "warning")


TAIL_N = "7"


def q_obs_tail(spark, sf_dir):
    return O.tail(log_lines(spark, sf_dir), TAIL_N)


GREP_TEXT = "ErRoR"


def q_obs_grep(spark, sf_dir):
    return O.grep(log_lines(spark, sf_dir), GREP_TEXT)


def q_obs_export(spark, sf_dir):
    """Exported twice; the second time without the pods of the first that are gone."""
    path, lines = work_dir(spark, "logs-export"), log_lines(spark, sf_dir)
    O.export(lines.withColumn("pod", F.concat(F.lit("gone-"), F.col("pod"))).unionByName(lines), path)
    O.export(lines, path)
    return O.read_export(spark, path)


def q_obs_platform_status(spark, sf_dir):
    return O.platform_status(pods(spark, sf_dir))


AGENT_FRAGMENT = "0001"


def q_obs_service_logs(spark, sf_dir):
    return O.service_logs(log_lines(spark, sf_dir), AGENT_FRAGMENT)


# ---------------------------------------------------------------- oracles

_PODS = duck_text(PODS_FLAT)
_CONT = " UNION ALL ".join(
    f"SELECT name AS pod, {i} AS idx, c{i}_name AS cname, c{i}_image AS image, c{i}_has_status AS has_status, "
    f"c{i}_ready AS ready, c{i}_restarts AS restarts, c{i}_running AS running, c{i}_waiting AS waiting, "
    f"c{i}_terminated AS terminated, c{i}_state AS state FROM pf WHERE c{i}_name IS NOT NULL" for i in range(1, 4))
_WITH_PODS = f"WITH pf AS ({_PODS}), cont AS ({_CONT})"

_CPU = """CASE WHEN cpu IS NULL OR cpu = '' THEN 0.0
     WHEN suffix(cpu, 'n') THEN TRY_CAST(left(cpu, length(cpu) - 1) AS DOUBLE) / 1e6
     WHEN suffix(cpu, 'u') THEN TRY_CAST(left(cpu, length(cpu) - 1) AS DOUBLE) / 1e3
     WHEN suffix(cpu, 'm') THEN TRY_CAST(left(cpu, length(cpu) - 1) AS DOUBLE)
     ELSE TRY_CAST(cpu AS DOUBLE) * 1000 END"""
_RX = r"'^(\d+(?:\.\d+)?)([A-Za-z]+)?$'"
_MEM = f"""CASE WHEN memory IS NULL OR NOT regexp_matches(memory, {_RX}) THEN 0.0
     ELSE CAST(regexp_extract(memory, {_RX}, 1) AS DOUBLE) *
          CASE regexp_extract(memory, {_RX}, 2)
            WHEN 'Ki' THEN 1024.0 WHEN 'Mi' THEN 1048576.0 WHEN 'Gi' THEN 1073741824.0
            WHEN 'Ti' THEN 1099511627776.0 WHEN 'K' THEN 1e3 WHEN 'M' THEN 1e6
            WHEN 'G' THEN 1e9 WHEN 'T' THEN 1e12 ELSE 1.0 END END"""
_USAGE = f"""usage AS (
  SELECT pod, sum({_CPU}) AS cpu, sum({_MEM}) AS mem FROM (
    SELECT * FROM ({duck_text(METRICS)}) m QUALIFY row_number() OVER (
      PARTITION BY pod, container ORDER BY ts DESC NULLS LAST, cpu DESC, memory DESC) = 1) n GROUP BY pod)"""

_HEALTH = """CASE WHEN pf.phase = 'Running' THEN
       CASE WHEN (SELECT count(*) FROM cont c WHERE c.pod = pf.name AND c.has_status) > 0
             AND NOT EXISTS (SELECT 1 FROM cont c WHERE c.pod = pf.name AND c.has_status AND NOT c.ready)
            THEN 2 ELSE 1 END
     WHEN pf.phase = 'Pending' THEN 1 ELSE 0 END"""
_SVC_VALUES = ", ".join(f"('{s}', '{l}', '{v}')" for s, l, v in O.SERVICE_SELECTORS)
_STATUS = f"""svc(service, label, value) AS (VALUES {_SVC_VALUES}),
best AS (SELECT s.service, max({_HEALTH}) AS r FROM svc s JOIN pf ON pf.svc_label = s.label AND pf.svc_value = s.value
         GROUP BY s.service),
status AS (SELECT s.service, CASE b.r WHEN 2 THEN 'Healthy' WHEN 1 THEN 'Pending' ELSE 'Offline' END AS status
           FROM svc s LEFT JOIN best b ON b.service = s.service),
comp AS (SELECT 'Unified SQL IDE' AS service,
           CASE WHEN count(*) FILTER (WHERE status = 'Healthy') = 2 THEN 'Healthy'
                WHEN count(*) FILTER (WHERE status = 'Pending') > 0 THEN 'Pending' ELSE 'Offline' END AS status
         FROM status WHERE service IN ('Trino Analytics', 'Apache Polaris')),
allst AS (SELECT * FROM status UNION ALL SELECT * FROM comp)"""

_EV = f"""WITH ev AS ({duck_text(CLUSTER_EVENTS)}),
norm AS (
SELECT coalesce(nullif(type, ''), 'Normal') AS type, coalesce(reason, '') AS reason,
       coalesce(nullif(message, ''), note, '') AS message, concat(coalesce(kind, ''), '/', coalesce(name, '')) AS object,
       coalesce(nullif(count, 0), nullif(deprecated_count, 0), 1) AS count,
       coalesce(first_ts, created_ts, last_ts, event_ts, deprecated_last_ts, created_ts) AS first_seen,
       coalesce(last_ts, event_ts, deprecated_last_ts, created_ts) AS last_seen,
       coalesce(type = 'Warning', false) AS warning, name AS object_name
FROM ev)"""

_LOGS = duck_text(LOG_LINES)

_STATE = """CASE WHEN coalesce(state = 'running', false) OR running IS NOT NULL THEN 'Running'
            WHEN coalesce(state = 'waiting', false) OR nullif(waiting, '') IS NOT NULL THEN 'Waiting'
            WHEN coalesce(state = 'terminated', false) OR nullif(terminated, '') IS NOT NULL THEN 'Terminated'
            ELSE 'Unknown' END"""
_READY = """r AS (SELECT pf.name,
        CAST((SELECT count(*) FROM cont c WHERE c.pod = pf.name AND c.has_status AND c.ready) AS INT) AS ready,
        CAST(CASE WHEN (SELECT count(*) FROM cont c WHERE c.pod = pf.name AND c.has_status) > 0
             THEN (SELECT count(*) FROM cont c WHERE c.pod = pf.name AND c.has_status)
             ELSE (SELECT count(*) FROM cont c WHERE c.pod = pf.name) END AS INT) AS total,
        CAST(coalesce((SELECT sum(coalesce(c.restarts, 0)) FROM cont c WHERE c.pod = pf.name AND c.has_status), 0) AS INT) AS restarts
      FROM pf)"""
_PHASE = """ph AS (SELECT pf.name, coalesce(
   CASE WHEN pf.deletion_ts IS NOT NULL THEN 'Terminating' END,
   (SELECT c.waiting FROM cont c WHERE c.pod = pf.name AND c.has_status AND c.waiting IS NOT NULL
      AND c.waiting NOT IN ('', 'ContainerCreating') ORDER BY c.idx LIMIT 1),
   nullif(pf.phase, ''), 'Unknown') AS phase
FROM pf)"""

ORACLE = {
    "obs_usage": f"""{_WITH_PODS}, {_USAGE}
SELECT pf.name, round(u.cpu, 3) AS cpu_millicores, u.mem AS mem_bytes FROM pf LEFT JOIN usage u ON u.pod = pf.name""",
    "obs_readiness": f"""{_WITH_PODS}, {_READY}
SELECT *, ready = total AND total > 0 AS all_ready FROM r""",
    "obs_pods": f"""{_WITH_PODS}, {_READY}, {_PHASE}, {_USAGE}
SELECT pf.name, ph.phase, r.ready, r.total, r.restarts, nullif(pf.node, '') AS node, nullif(pf.pod_ip, '') AS pod_ip,
       CAST(coalesce(pf.start_ts, pf.created_ts) AS TIMESTAMP) AS start_time, CAST(pf.created_ts AS TIMESTAMP) AS created_at,
       CASE WHEN pf.svc_label IS NULL THEN 'segment=' || pf.segment
            ELSE concat_ws(',', least(pf.svc_label || '=' || pf.svc_value, 'segment=' || pf.segment),
                           greatest(pf.svc_label || '=' || pf.svc_value, 'segment=' || pf.segment)) END AS labels,
       round(u.cpu, 3) AS cpu_millicores, u.mem AS mem_bytes,
       CAST((SELECT count(*) FROM cont c WHERE c.pod = pf.name) AS INT) AS n_containers,
       CAST((SELECT count(*) FROM cont c WHERE c.pod = pf.name AND c.has_status AND {_STATE} = 'Running') AS INT) AS n_running
FROM pf JOIN r ON r.name = pf.name JOIN ph ON ph.name = pf.name LEFT JOIN usage u ON u.pod = pf.name""",
    "obs_containers": f"""{_WITH_PODS}
SELECT pod, cname AS container, image,
       CASE WHEN has_status THEN ready ELSE false END AS ready,
       CASE WHEN has_status THEN coalesce(restarts, 0) ELSE 0 END AS restart_count,
       CASE WHEN NOT has_status THEN 'Unknown' ELSE {_STATE} END AS state,
       CASE WHEN has_status THEN coalesce(nullif(waiting, ''), nullif(terminated, '')) END AS reason,
       CASE WHEN has_status THEN CAST(running AS TIMESTAMP) END AS started_at
FROM cont""",
    "obs_phase": f"""{_WITH_PODS}, {_PHASE}
SELECT name, phase FROM ph""",
    "obs_service_status": f"""{_WITH_PODS}, {_STATUS}
SELECT * FROM status""",
    "obs_composite": f"""{_WITH_PODS}, {_STATUS}
SELECT * FROM allst""",
    "obs_summary": f"""{_WITH_PODS}, {_STATUS}, {_USAGE}
SELECT count(*) FILTER (WHERE status = 'Healthy') AS n_healthy, count(*) AS n_services,
       (SELECT count(*) FROM usage) > 0 AS metrics_available
FROM allst""",
    "obs_pick": f"""{_WITH_PODS}
SELECT name FROM pf WHERE svc_label = 'app.kubernetes.io/name' AND svc_value = 'trino' AND contains(name, '{PICK_FRAGMENT}')""",
    "obs_events": f"""{_EV}
SELECT type, reason, message, object, count, first_seen, last_seen, warning FROM norm""",
    "obs_events_for": f"""{_EV}
SELECT type, reason, object, count, last_seen, warning FROM norm WHERE object_name = '{EVENTS_OBJECT}'""",
    "obs_tail": f"""
SELECT pod, container, ts, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY pod, container ORDER BY ts DESC, line_no DESC) AS rn
  FROM ({_LOGS}) l) t
WHERE rn <= {int(TAIL_N)}""",
    "obs_platform_status": f"""{_WITH_PODS}
SELECT name, phase, CAST(start_ts AS TIMESTAMP) AS start_time FROM pf""",
    "obs_service_logs": f"""
SELECT pod, container, ts, line_no, line FROM (
  SELECT *, row_number() OVER (PARTITION BY pod ORDER BY ts DESC, line_no DESC) AS rn
  FROM ({_LOGS}) l WHERE contains(pod, '{AGENT_FRAGMENT}')) t
WHERE rn <= {O.AGENT_TAIL_DEFAULT}""",
    "obs_grep": f"""
SELECT * FROM ({_LOGS}) l WHERE contains(lower(line), lower('{GREP_TEXT}'))""",
    "obs_export": f"""
SELECT pod, concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), ' ', line) AS line
FROM ({_LOGS}) l""",
}

QUERIES = {
    "obs_usage": q_obs_usage,
    "obs_pods": q_obs_pods,
    "obs_readiness": q_obs_readiness,
    "obs_containers": q_obs_containers,
    "obs_phase": q_obs_phase,
    "obs_service_status": q_obs_service_status,
    "obs_composite": q_obs_composite,
    "obs_summary": q_obs_summary,
    "obs_pick": q_obs_pick,
    "obs_events": q_obs_events,
    "obs_events_for": q_obs_events_for,
    "obs_tail": q_obs_tail,
    "obs_grep": q_obs_grep,
    "obs_platform_status": q_obs_platform_status,
    "obs_service_logs": q_obs_service_logs,
    "obs_export": q_obs_export,
}
