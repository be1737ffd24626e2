"""Literal input -> output cases (FIXTURES.md sections 3-6)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakejobs.functions.quantity import cpu_millicores, mem_bytes, tail_size
from lakejobs.functions.status import pod_health, pod_phase
from lakejobs.functions.typetext import render_type
from lakejobs.operators import config as C
from lakejobs.operators import silver as S
from lakejobs.operators import telemetry as O
from lakejobs.schemas import CLUSTER_EVENT, CONTAINER_STATUS


def test_cpu_millicores(spark):
    cases = [("12m", 12.0), ("1500000000n", 1500.0), ("250u", 0.25), ("2", 2000.0), ("", 0.0), (None, 0.0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "cpu string")
    got = [r[0] for r in df.select(cpu_millicores("cpu")).collect()]
    assert got == [v for _, v in cases]


def test_mem_bytes(spark):
    cases = [("128Mi", 134217728.0), ("1Gi", 1073741824.0), ("1048576", 1048576.0), ("1.5Ki", 1536.0),
             ("2M", 2000000.0), ("5Xi", 5.0), ("x", 0.0), (None, 0.0)]
    df = spark.createDataFrame([(c,) for c, _ in cases], "m string")
    got = [r[0] for r in df.select(mem_bytes("m")).collect()]
    assert got == [v for _, v in cases]


def test_tail_size():
    assert [tail_size(x) for x in (None, "0", "abc", "20000", "7")] == [500, 500, 500, 20000, 7]


def _statuses(spark, rows):
    return spark.createDataFrame(rows, f"deletion_ts timestamp_ntz, phase string, statuses array<{CONTAINER_STATUS.simpleString()}>")


def _st(ready=None, waiting=None):
    return ("c", ready, 0, None, waiting, None, None)


def test_pod_phase(spark):
    t = dt.datetime(2024, 1, 1)
    df = _statuses(spark, [
        (t, "Running", []),
        (None, "Running", [_st(waiting="ContainerCreating"), _st(waiting="CrashLoopBackOff")]),
        (None, "Pending", [_st(waiting="ContainerCreating")]),
        (None, None, []),
        (None, "Running", [_st(waiting=""), _st(waiting="ImagePullBackOff")]),
        (None, "", [_st(waiting="")]),
    ])
    got = [r[0] for r in df.select(pod_phase()).collect()]
    assert got == ["Terminating", "CrashLoopBackOff", "Pending", "Unknown", "ImagePullBackOff", "Unknown"]


def test_pod_health(spark):
    df = _statuses(spark, [
        (None, "Running", [_st(True), _st(True)]),
        (None, "Running", [_st(True), _st(False)]),
        (None, "Running", []),
        (None, "Pending", [_st(True)]),
        (None, "Failed", [_st(True)]),
    ])
    got = [r[0] for r in df.select(pod_health()).collect()]
    assert got == ["Healthy", "Pending", "Pending", "Pending", "Offline"]


def _pods_for(spark, services):
    """One service per entry; pods given by their health via phase/ready."""
    rows = []
    for i, (svc, healths) in enumerate(services):
        label, value = [(l, v) for s, l, v in O.SERVICE_SELECTORS if s == svc][0]
        for j, h in enumerate(healths):
            phase, st = {"Healthy": ("Running", [_st(True)]), "Pending": ("Pending", []),
                         "Offline": ("Failed", [])}[h]
            rows.append((f"p{i}-{j}", phase, {label: value}, st))
    return spark.createDataFrame(
        rows, f"name string, phase string, labels map<string,string>, statuses array<{CONTAINER_STATUS.simpleString()}>")


def test_service_status(spark):
    pods = _pods_for(spark, [("MinIO Storage", ["Offline", "Healthy"]), ("Apache Airflow", ["Offline", "Pending"]),
                             ("Keycloak", ["Offline"])])
    got = {r.service: r.status for r in O.service_status(pods, O.services_df(spark)).collect()}
    assert got["MinIO Storage"] == "Healthy"
    assert got["Apache Airflow"] == "Pending"
    assert got["Keycloak"] == "Offline"
    assert got["Apache Superset"] == "Offline"          # no pods


@pytest.mark.parametrize("a,b,want", [("Healthy", "Healthy", "Healthy"), ("Healthy", "Pending", "Pending"),
                                      ("Pending", "Offline", "Pending"), ("Healthy", "Offline", "Offline"),
                                      ("Offline", "Offline", "Offline")])
def test_composite(spark, a, b, want):
    st = spark.createDataFrame([("Trino Analytics", a), ("Apache Polaris", b)], "service string, status string")
    got = O.composite_status(st, O.composites_df(spark)).collect()
    assert [(r.service, r.status) for r in got] == [("Unified SQL IDE", want)]


def test_normalise_events(spark):
    c, l = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [
        (None, None, None, "Pod", "x", None, None, None, None, None, c, "n", 4),
        ("Warning", "R", "m", None, None, 0, None, l, None, None, None, "n", 0),
        ("", None, "", None, None, 3, None, l, None, None, None, None, 9),
    ]
    df = O.normalise_events(spark.createDataFrame(rows, CLUSTER_EVENT)).collect()
    assert (df[0].first_seen, df[0].last_seen, df[0].type, df[0]["count"], df[0].object) == (c, c, "Normal", 4, "Pod/x")
    assert (df[0].message, df[0].warning, df[2].message, df[2].warning, df[2]["count"]) == ("n", False, "", False, 3)
    assert (df[1].first_seen, df[1]["count"], df[1].object, df[1].warning) == (l, 1, "/", True)


def test_grep(spark):
    df = spark.createDataFrame([("ERROR x",), ("ok",)], "line string")
    assert [r[0] for r in O.grep(df, "eRr").collect()] == ["ERROR x"]
    assert O.grep(df, "").count() == 2


def test_type_text():
    assert render_type("long") == "long"
    assert render_type({"type": "list", "element": "int"}) == "list<int>"
    assert render_type({"type": "map", "key": "string", "value": "long"}) == "map<string, long>"
    assert render_type({"type": "struct", "fields": [{"name": "a", "type": "int"},
                                                     {"name": "b", "type": {"type": "list", "element": "string"}}]}) \
        == "struct<a:int, b:list<string>>"
    assert render_type({"type": "other"}) == "other"
    assert render_type({}) == "?"


def test_properties_parse_redact_connectors(spark):
    files = spark.createDataFrame([
        ("iceberg", "connector.name=iceberg\n# note\n\n s3.endpoint = http://x:9000 \ns3.aws-secret-key=abc"),
        ("pg", "connector.name=postgresql\nconnection-url=jdbc:postgresql://h/d?a=b\nconnection-password=p\n=bad\nnovalue"),
        ("none", "k=1\nk=2"),
    ], "name string, content string")
    props = C.parse_props(files)
    red = {(r.name, r.key): r.value for r in C.redact(props).collect()}
    assert len([k for k in red if k[0] == "iceberg"]) == 3
    assert red[("iceberg", "s3.endpoint")] == "http://x:9000"
    assert red[("iceberg", "s3.aws-secret-key")] == C.MASK
    assert red[("pg", "connection-url")] == "jdbc:postgresql://h/d?a=b"
    assert red[("pg", "connection-password")] == C.MASK
    assert len([k for k in red if k[0] == "pg"]) == 3
    assert red[("none", "k")] == "2" and len([k for k in red if k[0] == "none"]) == 1
    conn = {r.name: r.connector for r in C.catalog_connectors(props, files).collect()}
    assert conn == {"iceberg": "iceberg", "pg": "postgresql", "none": "unknown"}


def test_silver_cases(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [("7", "  Click ", "a"), ("7", "VIEW", ""), (None, "view", "a"), ("7", "view", None),
            ("7", None, "a"), ("abc", "view", "a")]
    bronze = spark.createDataFrame([(u, e, c, t) for u, e, c in rows],
                                   "user_id string, event string, content string, ingested_at timestamp_ntz")
    silver, rej = S.split_rejects(bronze, as_of="2024-02-01 00:00:00")
    got = sorted(((r.user_id, r.event_type, r.search_text) for r in silver.collect()), key=str)
    assert got == sorted([(7, "click", "a"), (7, "view", ""), (7, None, "a")], key=str)
    reasons = sorted(r.reason for r in rej.collect())
    assert reasons == ["content null", "user_id null", "user_id unreadable"]
    assert silver.count() + rej.count() == bronze.count()
    with pytest.raises(Exception):
        S.to_silver(bronze, strict=True).collect()


def test_tail_gives_what_is_asked(spark):
    logs = spark.range(13_000).selectExpr("'p' AS pod", "'c' AS container", "TIMESTAMP_NTZ'2024-01-01 00:00:00' AS ts",
                                          "id AS line_no", "'x' AS line")
    assert O.tail(logs, 12_000).count() == 12_000
    assert O.service_logs(logs, "p", 12_000).count() == 12_000
    assert O.service_logs(logs, "p", 0).count() == 0
    assert O.tail(logs, 0).count() == 500


def test_usage_takes_the_newest_sample(spark):
    t1, t2 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    rows = [("p", "a", "5m", "1Ki", t1), ("p", "a", "7m", "2Ki", t2), ("p", "b", "1m", "3", None), ("q", "a", "2", "x", t1)]
    df = spark.createDataFrame(rows, "pod string, container string, cpu string, memory string, ts timestamp_ntz")
    got = {r.pod: (r.cpu_millicores, r.mem_bytes) for r in O.pod_usage(df).collect()}
    assert got == {"p": (8.0, 2051.0), "q": (2000.0, 0.0)}


def test_container_state_needs_no_reason(spark):
    spec = [("a", "i"), ("b", "i"), ("c", "i"), ("d", "i"), ("e", "i")]
    st = [("a", True, 1, None, None, None, "running"), ("b", False, None, None, None, None, "waiting"),
          ("c", False, 0, None, "", "", "terminated"), ("d", False, 0, None, "", None, None)]
    pods = spark.createDataFrame([("p", spec, st)], f"name string, spec array<struct<name:string,image:string>>, "
                                 f"statuses array<{CONTAINER_STATUS.simpleString()}>")
    got = {r.container: (r.state, r.reason) for r in O.containers(pods).collect()}
    assert got == {"a": ("Running", None), "b": ("Waiting", None), "c": ("Terminated", None), "d": ("Unknown", None),
                   "e": ("Unknown", None)}


def test_export_replaces_and_keeps_names_and_order(spark, tmp_path):
    schema = "pod string, ts timestamp_ntz, line_no long, line string"
    t = dt.datetime(2024, 1, 1)
    lines = [(p, t, i, f"l{i}") for p in ("007", "08", "gone") for i in range(300)]
    O.export(spark.createDataFrame(lines, schema).repartition(7), str(tmp_path))
    O.export(spark.createDataFrame([x for x in lines if x[0] != "gone"], schema).repartition(7), str(tmp_path))
    assert {r.pod for r in O.read_export(spark, str(tmp_path)).collect()} == {"007", "08"}
    files = list(tmp_path.glob("pod=007/*.txt"))
    assert len(files) == 1 and [x.split()[-1] for x in files[0].read_text().splitlines()] == [f"l{i}" for i in range(300)]


@pytest.mark.parametrize("hot_rows", [10, 1_000_000])
def test_export_of_a_hot_pod_is_whole_and_in_order(spark, tmp_path, hot_rows):
    """A pod above the threshold, null pods and usual ones; both ways of dealing."""
    rows = spark.range(600).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 50 = 1 THEN NULL ELSE concat('p', id % 7) END AS pod",
        "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, 600 - id) AS ts", "id AS line_no",
        "concat('line ', id) AS line").repartition(9)
    O.export(rows, str(tmp_path), hot_rows=hot_rows)
    got = sorted((r.pod or "", r.line.split(" ", 2)[2]) for r in O.read_export(spark, str(tmp_path)).collect())
    assert got == sorted((r.pod or "", r.line) for r in rows.collect())
    for f in tmp_path.glob("pod=*/part-*"):
        lines = f.read_text().splitlines()
        assert lines == sorted(lines)


def test_export_is_what_sparks_text_writer_makes(spark, tmp_path):
    """The same folders and lines, for odd pod names too, but no file of Hadoop's
    local file system, which starts processes for each; long files are cut."""
    pods = ["a", "p=1/x:y", "ü é", "50%", "[b]^{c}", 'q"\'#*?\\', "t\tn\n", " ", "a+b %41", "", None, "007"]
    rows = [(p, dt.datetime(2024, 1, 1), i, f"l{i:04d}" if i % 9 else None) for p in pods for i in range(60)]
    logs = spark.createDataFrame(rows, "pod string, ts timestamp_ntz, line_no long, line string").repartition(5)
    ours, sparks = str(tmp_path / "ours"), str(tmp_path / "sparks")
    for _ in range(2):
        O.export(logs, ours, file_rows=25)
    value = F.concat_ws(" ", F.date_format("ts", O.LOG_TS_FORMAT), "line").alias("value")
    logs.select("pod", value).write.partitionBy("pod").text(sparks)
    assert {x.name for x in (tmp_path / "ours").iterdir()} == {x.name for x in (tmp_path / "sparks").iterdir()}
    got, want = (sorted((r.pod or "", r.line) for r in O.read_export(spark, x).collect()) for x in (ours, sparks))
    assert got == want and len(got) == len(rows)
    assert {r.pod for r in O.read_export(spark, ours).collect()} == {p or None for p in pods}
    files = sorted((tmp_path / "ours" / "pod=007").iterdir())
    assert [len(f.read_text().splitlines()) for f in files] == [25, 25, 10]
    assert not list((tmp_path / "ours").glob("pod=*/.*.crc"))


def test_failing_export_leaves_the_last_one_whole(spark, tmp_path):
    logs = spark.range(50).selectExpr("concat('p', id % 5) AS pod", "timestamp_ntz'2024-01-01 00:00:00' AS ts",
                                      "id AS line_no", "concat('l', id) AS line")
    top = tmp_path / "logs"
    O.export(logs, str(top))
    with pytest.raises(Exception, match="lost line"):
        O.export(logs.withColumn("line", F.when(F.col("line_no") == 40, F.raise_error(F.lit("lost line")).cast("string"))
                                 .otherwise(F.col("line"))), str(top))
    assert O.read_export(spark, str(top)).count() == 50
    assert [x.name for x in tmp_path.iterdir()] == ["logs"]
    O.export(logs.limit(0), str(top))
    assert O.read_export(spark, str(top)).count() == 0
