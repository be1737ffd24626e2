"""Inventory of table-metadata documents (TBL-1 ... TBL-11).

Input: ``(namespace array<string>, table string, doc string)``, one row per
table of the lake; ``doc`` is the table's metadata JSON. Parsed once with a
declared schema; every output is computed on the row with array functions
(schema lookup by id, field-name lookup for partition sources), so only the
listings that sort or deduplicate shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakejobs.functions.typetext import type_text
from lakejobs.schemas import METADATA_FIELDS
from lakejobs.sources.tables import spread

NO_OPERATION = "—"  # fixed value: shown when a snapshot names no operation


def read_metadata_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents laid out as ``<root>/<ns part>/.../<table>.metadata.json``:
    namespace from the folder path under ``root``, table from the file name."""
    df = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path)
    rel = F.substring_index(F.col("_metadata.file_path"), path.rstrip("/") + "/", -1)
    parts = F.split(rel, "/")
    return df.select(F.slice(parts, 1, F.size(parts) - 1).alias("namespace"),
                     F.regexp_replace(F.element_at(parts, -1), r"\.metadata\.json$", "").alias("table"),
                     F.col("value").alias("doc"))


def _read(docs: DataFrame) -> DataFrame:
    """Documents in either form: the metadata itself, as it lies in a file, or
    wrapped as ``{"metadata": ...}``, as a catalogue service answers. Each is
    parsed once, with both forms declared; what does not parse has no ``md``."""
    both = T.StructType([*METADATA_FIELDS.fields, T.StructField("metadata", METADATA_FIELDS)])
    got = F.from_json("doc", both)
    d = F.col("__d")
    known = F.greatest(*[d[k].isNotNull() for k in ("location", "table-uuid", "format-version", "schemas", "schema")])
    bare = F.struct(*[d[f.name].alias(f.name) for f in METADATA_FIELDS.fields])
    md = F.coalesce(d["metadata"], F.when(known, bare))
    read = (spread(docs).withColumn("__d", got)
            .select(F.array_join("namespace", ".").alias("ns"), "table", "doc", md.alias("md")))
    # a filter on md may not sink below this generator; it would parse every
    # document a second time, once per field that it tests, on the scan's tasks
    return read.select("ns", "table", "doc", F.explode_outer(F.array("md")).alias("md"))


def parse(docs: DataFrame) -> DataFrame:
    """``ns`` (dot-joined namespace), ``table`` and ``md`` (parsed metadata) of
    every readable document; :func:`rejects` gives the others."""
    return _read(docs).where(F.col("md").isNotNull()).select("ns", "table", "md")


def rejects(docs: DataFrame) -> DataFrame:
    """Documents that are no table metadata: unreadable JSON, or none of the
    fields that every metadata document has."""
    return _read(docs).where(F.col("md").isNull()).select(F.col("ns").alias("namespace"), "table", "doc")


def namespaces(parsed: DataFrame) -> DataFrame:
    """Distinct namespaces, parts joined by dots (TBL-1)."""
    return parsed.select(F.col("ns").alias("namespace")).distinct()


def tables(parsed: DataFrame, ns: str | None = None) -> DataFrame:
    """Tables of one namespace (or all), sorted by name (TBL-2)."""
    out = parsed.select(F.col("ns").alias("namespace"), "table")
    if ns is not None:
        out = out.filter(F.col("namespace") == ns)
    return out.orderBy("namespace", "table")


def _current_schema() -> F.Column:
    md = F.col("md")
    return F.coalesce(
        F.get(F.filter(md["schemas"], lambda s: s["schema-id"] == md["current-schema-id"]), 0),
        F.get(md["schemas"], 0),
        md["schema"])


def with_current_fields(parsed: DataFrame) -> DataFrame:
    return parsed.withColumn("fields", F.coalesce(_current_schema()["fields"], F.array()))


def _explode(df: DataFrame, keep, arr, names, pos: bool = False) -> DataFrame:
    """Inner explode written as outer explode + null filter. An inner
    generator makes the optimiser add ``size(arr) > 0`` and push it below any
    exchange, which would parse every document twice (once in the scan task);
    the outer form keeps one parse."""
    gen = F.posexplode_outer(arr) if pos else F.explode_outer(arr)
    out = df.select(*keep, gen.alias(*names))
    return out.filter(F.col(names[-1]).isNotNull())


def current_fields(parsed: DataFrame) -> DataFrame:
    """Fields of the current schema: by id, else the first schema, else the
    legacy single schema (TBL-3); type as text (TBL-4); required defaults to
    false and a missing doc to null (TBL-5)."""
    f = _explode(with_current_fields(parsed), [F.col("ns").alias("namespace"), "table"],
                 F.col("fields"), ("pos", "f"), pos=True)
    return f.select("namespace", "table", "pos", F.col("f.id").alias("id"), F.col("f.name").alias("name"),
                    type_text(F.col("f.type")).alias("type"),
                    F.coalesce(F.col("f.required"), F.lit(False)).alias("required"),
                    F.nullif(F.col("f.doc"), F.lit("")).alias("doc"))


def partition_fields(parsed: DataFrame) -> DataFrame:
    """Fields of the default partition spec (else the first); the source id
    resolved to a column name of the current schema, ``#<id>`` when it is
    not there (TBL-6). The lookup is on the row: no join."""
    md = F.col("md")
    spec = F.coalesce(
        F.get(F.filter(md["partition-specs"], lambda s: s["spec-id"] == md["default-spec-id"]), 0),
        F.get(md["partition-specs"], 0))
    fields = F.col("fields")

    def resolve(pf):
        hit = F.get(F.filter(fields, lambda f: f["id"] == pf["source-id"]), 0)["name"]
        return F.struct(pf["name"].alias("name"), pf["transform"].alias("transform"),
                        F.coalesce(F.nullif(hit, F.lit("")),
                                   F.concat(F.lit("#"), pf["source-id"].cast("string"))).alias("source_column"))
    rows = _explode(with_current_fields(parsed), [F.col("ns").alias("namespace"), "table"],
                    F.transform(F.coalesce(spec["fields"], F.array()), resolve), ("p",))
    return rows.select("namespace", "table", "p.*")


def snapshots(parsed: DataFrame) -> DataFrame:
    """Snapshot history newest first (TBL-7): ids as text, operation ``—``
    when missing, the whole summary; current one flagged and rows added per
    snapshot (TBL-8)."""
    md = F.col("md")
    rows = _explode(parsed, [F.col("ns").alias("namespace"), "table", md["current-snapshot-id"].alias("cur")],
                    md["snapshots"], ("s",))
    s = F.col("s")
    out = rows.select(
        "namespace", "table",
        s["snapshot-id"].cast("string").alias("snapshot_id"),
        s["parent-snapshot-id"].cast("string").alias("parent_id"),
        s["timestamp-ms"].alias("timestamp_ms"),
        F.coalesce(F.nullif(F.try_element_at(s["summary"], F.lit("operation")), F.lit("")),
                   F.lit(NO_OPERATION)).alias("operation"),
        F.coalesce(s["snapshot-id"] == F.col("cur"), F.lit(False)).alias("is_current"),
        F.try_element_at(s["summary"], F.lit("added-records")).try_cast("bigint").alias("added_records"),
        F.coalesce(s["summary"], F.create_map().cast("map<string,string>")).alias("summary"))
    return out.orderBy("namespace", "table", F.col("timestamp_ms").desc_nulls_last())


def table_metrics(parsed: DataFrame) -> DataFrame:
    """Rows, data files and bytes of the current snapshot; null when there is
    no current snapshot or the summary lacks the number (TBL-9)."""
    md = F.col("md")
    cur = F.get(F.filter(md["snapshots"], lambda s: s["snapshot-id"] == md["current-snapshot-id"]), 0)
    summ = cur["summary"]

    def num(k):
        return F.try_element_at(summ, F.lit(k)).try_cast("bigint")
    return parsed.select(F.col("ns").alias("namespace"), "table",
                         num("total-records").alias("total_records"),
                         num("total-data-files").alias("total_data_files"),
                         num("total-files-size").alias("total_files_size"))


def properties(parsed: DataFrame) -> DataFrame:
    """Table properties as key/value rows (TBL-10)."""
    return _explode(parsed, [F.col("ns").alias("namespace"), "table"],
                    F.col("md")["properties"], ("key", "value"))


def identity(parsed: DataFrame) -> DataFrame:
    """Location, format version, uuid and current snapshot id (TBL-11)."""
    md = F.col("md")
    return parsed.select(F.col("ns").alias("namespace"), "table",
                         md["location"].alias("location"),
                         F.nullif(md["format-version"], F.lit(0)).alias("format_version"),
                         md["table-uuid"].alias("uuid"),
                         md["current-snapshot-id"].cast("string").alias("current_snapshot_id"))
