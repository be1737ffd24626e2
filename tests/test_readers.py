"""File readers: raw JSON (corrupt lines, missing path), property files and
metadata documents laid out in folders."""

import json
import os
import tempfile

import pytest
from pyspark.errors import AnalysisException

from lakejobs.operators import config as C
from lakejobs.operators import metadata as M
from lakejobs.schemas import RAW_USER_EVENT
from lakejobs.sources.raw import read_raw, stamp_ingest


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_read_raw_keeps_corrupt_and_refuses_missing(spark):
    d = tempfile.mkdtemp(prefix="lj-raw-")
    _write(f"{d}/a.json", '{"user_id": "1", "event": "click", "content": "x"}\nnot json\n')
    df = read_raw(spark, f"{d}/*.json", RAW_USER_EVENT)
    rows = df.collect()
    assert len(rows) == 2 and sum(r._corrupt_record is not None for r in rows) == 1
    with pytest.raises(AnalysisException):
        read_raw(spark, f"{d}/missing/*.json", RAW_USER_EVENT).collect()
    empty = read_raw(spark, f"{d}/missing/*.json", RAW_USER_EVENT, allow_empty=True)
    assert empty.count() == 0 and empty.schema == RAW_USER_EVENT
    assert "ingested_at" in stamp_ingest(df.drop("ingested_at"), "2024-01-01 00:00:00").columns


def test_read_property_files(spark):
    d = tempfile.mkdtemp(prefix="lj-props-")
    _write(f"{d}/iceberg.properties", "connector.name=iceberg\ns3.secret-key=x\n")
    _write(f"{d}/notes.txt", "connector.name=nope\n")
    files = C.read_property_files(spark, d)
    conn = {r.name: r.connector for r in C.catalog_connectors(C.parse_props(files), files).collect()}
    assert conn == {"iceberg": "iceberg"}
    red = {r.key: r.value for r in C.redact(C.parse_props(files)).collect()}
    assert red["s3.secret-key"] == C.MASK


def test_read_metadata_files(spark):
    d = tempfile.mkdtemp(prefix="lj-md-")
    doc = {"metadata": {"format-version": 2, "current-schema-id": 1,
                        "schemas": [{"schema-id": 0, "fields": [{"id": 1, "name": "id", "type": "long"}]},
                                    {"schema-id": 1, "fields": [
                                        {"id": 1, "name": "id", "type": "long", "required": True},
                                        {"id": 2, "name": "event_type", "type": "string"},
                                        {"id": 3, "name": "tags", "type": {"type": "list", "element": {
                                            "type": "struct", "fields": [{"name": "k", "type": "string"},
                                                                         {"name": "v", "type": "int"}]}}}]}],
                        "default-spec-id": 0,
                        "partition-specs": [{"spec-id": 0, "fields": [{"name": "event_type", "transform": "identity",
                                                                       "source-id": 2}]}],
                        "current-snapshot-id": 9007199254740993,
                        "snapshots": [{"snapshot-id": 11, "timestamp-ms": 1, "summary": {"operation": "append"}},
                                      {"snapshot-id": 9007199254740993, "timestamp-ms": 2,
                                       "summary": {"operation": "append", "added-records": "4",
                                                   "total-records": "4", "total-data-files": "3",
                                                   "total-files-size": "4096"}}],
                        "properties": {"owner": "ada"}}}
    _write(f"{d}/demo/events.metadata.json", json.dumps(doc))
    legacy = {"metadata": {"schema": {"schema-id": 0, "fields": [{"id": 1, "name": "name", "type": "string"}]},
                           "partition-specs": [{"spec-id": 0, "fields": [{"name": "p", "transform": "identity",
                                                                          "source-id": 99}]}]}}
    _write(f"{d}/demo/users.metadata.json", json.dumps(legacy))
    _write(f"{d}/lake/bronze/m.metadata.json", json.dumps({"metadata": {"current-schema-id": 7, "schemas": [
        {"schema-id": 0, "fields": [{"id": 1, "name": "m", "type": {"type": "map", "key": "string", "value": "long"}}]}],
        "snapshots": [{"snapshot-id": 5, "timestamp-ms": 3, "summary": {}}]}}))
    p = M.parse(M.read_metadata_files(spark, d))
    assert {r.namespace for r in M.namespaces(p).collect()} == {"demo", "lake.bronze"}
    assert [r.table for r in M.tables(p, "demo").collect()] == ["events", "users"]
    ident = {r.table: (r.format_version, r.current_snapshot_id) for r in M.identity(p).collect()}
    assert ident["events"] == (2, "9007199254740993") and ident["users"] == (None, None)
    assert {(r.key, r.value) for r in M.properties(p).collect()} == {("owner", "ada")}
    f = {(r.table, r.name): (r.type, r.required) for r in M.current_fields(p).collect()}
    assert f[("events", "tags")] == ("list<struct<k:string, v:int>>", False)
    assert f[("events", "id")] == ("long", True)
    assert f[("users", "name")] == ("string", False)
    assert f[("m", "m")] == ("map<string, long>", False)
    parts = {(r.table, r.source_column) for r in M.partition_fields(p).collect()}
    assert parts == {("events", "event_type"), ("users", "#99")}
    snaps = [(r.table, r.snapshot_id, r.operation, r.is_current) for r in M.snapshots(p).collect()]
    assert ("events", "9007199254740993", "append", True) in snaps and ("m", "5", "—", False) in snaps
    met = {r.table: (r.total_records, r.total_data_files, r.total_files_size) for r in M.table_metrics(p).collect()}
    assert met["events"] == (4, 3, 4096) and met["users"] == (None, None, None)
