"""Declared schemas of the records the jobs read (nothing is inferred)."""

from pyspark.sql import types as T

# Raw user event as dropped into the raw zone (JSON). user_id arrives as text
# so that an unreadable id reaches the silver step instead of failing the read.
RAW_USER_EVENT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("event", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

# The same record in bronze: stamped by the ingest, with its batch.
BRONZE_USER_EVENT = T.StructType([
    *RAW_USER_EVENT.fields,
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("batch_id", T.LongType()),
])

SILVER_USER_EVENT = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("search_text", T.StringType()),
    T.StructField("ingested_at", T.TimestampNTZType()),
    T.StructField("processed_at", T.TimestampType()),
    T.StructField("batch_id", T.LongType()),
    T.StructField("ingested_day", T.DateType()),
])

CONTAINER_SPEC = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("image", T.StringType()),
])

CONTAINER_STATUS = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("ready", T.BooleanType()),
    T.StructField("restart_count", T.IntegerType()),
    T.StructField("running_started", T.TimestampNTZType()),
    T.StructField("waiting_reason", T.StringType()),
    T.StructField("terminated_reason", T.StringType()),
    T.StructField("state", T.StringType()),  # running, waiting or terminated: the state that is set
])

POD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("deletion_ts", T.TimestampNTZType()),
    T.StructField("phase", T.StringType()),
    T.StructField("labels", T.MapType(T.StringType(), T.StringType())),
    T.StructField("node", T.StringType()),
    T.StructField("pod_ip", T.StringType()),
    T.StructField("start_ts", T.TimestampNTZType()),
    T.StructField("created_ts", T.TimestampNTZType()),
    T.StructField("spec", T.ArrayType(CONTAINER_SPEC)),
    T.StructField("statuses", T.ArrayType(CONTAINER_STATUS)),
])

METRIC = T.StructType([
    T.StructField("pod", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("cpu", T.StringType()),
    T.StructField("memory", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
])

CLUSTER_EVENT = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("reason", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("count", T.IntegerType()),
    T.StructField("first_ts", T.TimestampNTZType()),
    T.StructField("last_ts", T.TimestampNTZType()),
    T.StructField("event_ts", T.TimestampNTZType()),
    T.StructField("deprecated_last_ts", T.TimestampNTZType()),
    T.StructField("created_ts", T.TimestampNTZType()),
    T.StructField("note", T.StringType()),
    T.StructField("deprecated_count", T.IntegerType()),
])

LOG_LINE = T.StructType([
    T.StructField("pod", T.StringType()),
    T.StructField("container", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("line_no", T.LongType()),
    T.StructField("line", T.StringType()),
])

# Table-metadata document (the parts the inventory reads). Field and element
# types stay raw JSON text: they nest to any depth.
_FIELD = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("required", T.BooleanType()),
    T.StructField("doc", T.StringType()),
])
_SCHEMA = T.StructType([
    T.StructField("schema-id", T.LongType()),
    T.StructField("fields", T.ArrayType(_FIELD)),
])
_PART_FIELD = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("transform", T.StringType()),
    T.StructField("source-id", T.LongType()),
])
_SPEC = T.StructType([
    T.StructField("spec-id", T.LongType()),
    T.StructField("fields", T.ArrayType(_PART_FIELD)),
])
_SNAPSHOT = T.StructType([
    T.StructField("snapshot-id", T.LongType()),
    T.StructField("parent-snapshot-id", T.LongType()),
    T.StructField("timestamp-ms", T.LongType()),
    T.StructField("summary", T.MapType(T.StringType(), T.StringType())),
])
METADATA_FIELDS = T.StructType([
    T.StructField("format-version", T.IntegerType()),
    T.StructField("table-uuid", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("current-schema-id", T.LongType()),
    T.StructField("schemas", T.ArrayType(_SCHEMA)),
    T.StructField("schema", _SCHEMA),
    T.StructField("default-spec-id", T.LongType()),
    T.StructField("partition-specs", T.ArrayType(_SPEC)),
    T.StructField("current-snapshot-id", T.LongType()),
    T.StructField("snapshots", T.ArrayType(_SNAPSHOT)),
    T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
])
