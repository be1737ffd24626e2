"""Registered queries of the catalogue-configuration audit (property files
derived from ``supplier``) and the table-metadata inventory (one metadata
document per ``part`` row); oracles compute the expected rows from the same
source columns by the stated rules, without parsing the documents."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from lakejobs.operators import config as C
from lakejobs.operators import metadata as M
from lakejobs.plans.derived import duck_text, spark_input
from lakejobs.sources.tables import spread

# ------------------------------------------------------------------ config

PROPERTY_FILES = """
SELECT concat('cat_', CAST(s_suppkey AS STRING)) AS name,
       concat_ws(chr(10),
         CASE s_nationkey % 5 WHEN 0 THEN 'connector.name=iceberg' WHEN 1 THEN 'connector.name=hive'
              WHEN 2 THEN 'connector.name=postgresql' WHEN 3 THEN 'connector.name = mysql'
              ELSE CASE WHEN s_suppkey % 2 = 0 THEN 'connector.name= ' END END,
         concat('# owner ', s_name),
         '',
         concat('  s3.endpoint = http://store-', CAST(s_nationkey AS STRING), ':9000  '),
         concat(CASE s_suppkey % 4 WHEN 0 THEN 's3.aws-secret-key' WHEN 1 THEN 'connection-password'
                     WHEN 2 THEN 'oauth2.Token' ELSE 'hive.metastore.API-KEY' END,
                '=v', CAST(s_suppkey AS STRING)),
         concat('connection-url=jdbc:postgresql://h', CAST(s_nationkey AS STRING), '/d?a=b'),
         '=bad',
         'novalue',
         concat('retries=', CAST(s_suppkey % 3 AS STRING)),
         CASE WHEN s_acctbal > 0 THEN concat('retries=', CAST(s_nationkey AS STRING)) END,
         concat('Access-Key=', CAST(s_suppkey AS STRING))) AS content
FROM {supplier}
"""


def property_files(spark, sf_dir):
    return spark_input(spark, sf_dir, PROPERTY_FILES)


def q_cfg_props(spark, sf_dir):
    return C.parse_props(property_files(spark, sf_dir))


def q_cfg_redact(spark, sf_dir):
    return C.redact(C.parse_props(property_files(spark, sf_dir)))


def q_cfg_catalogs(spark, sf_dir):
    files = property_files(spark, sf_dir)
    return C.catalog_connectors(C.parse_props(files), files)


def q_cfg_connectors(spark, sf_dir):
    files = property_files(spark, sf_dir)
    return C.connector_counts(C.catalog_connectors(C.parse_props(files), files))


_KV = f"""WITH f AS ({duck_text(PROPERTY_FILES)}),
l AS (SELECT name, unnest(string_split(content, chr(10))) AS raw,
             generate_subscripts(string_split(content, chr(10)), 1) AS pos FROM f),
t AS (SELECT name, pos, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM l),
kv AS (SELECT name, pos,
              regexp_replace(left(line, strpos(line, '=') - 1), '^\\s+|\\s+$', '', 'g') AS key,
              regexp_replace(substr(line, strpos(line, '=') + 1), '^\\s+|\\s+$', '', 'g') AS value
       FROM t WHERE line <> '' AND NOT starts_with(line, '#') AND strpos(line, '=') > 1),
props AS (SELECT name, key, arg_max(value, pos) AS value FROM kv GROUP BY name, key),
cats AS (SELECT f.name, coalesce(nullif(max(CASE WHEN p.key = 'connector.name' THEN p.value END), ''), 'unknown') AS connector
         FROM f LEFT JOIN props p ON p.name = f.name GROUP BY f.name)"""

CFG_ORACLE = {
    "cfg_props": f"{_KV}\nSELECT name, key, value FROM props",
    "cfg_redact": f"""{_KV}
SELECT name, key, CASE WHEN regexp_matches(key, '(password|secret|credential|access-key|apikey|api-key|token)', 'i')
                       THEN '{C.MASK}' ELSE value END AS value FROM props""",
    "cfg_catalogs": f"{_KV}\nSELECT name, connector FROM cats",
    "cfg_connectors": f"{_KV}\nSELECT connector, count(*) AS n_catalogs FROM cats GROUP BY connector",
}

# ------------------------------------------------------------------ table metadata

# Per-table attributes; the rules below turn them into a metadata document.
TABLE_ROWS = """
SELECT p_partkey AS k, p_size AS s, lower(p_type) AS ptype, p_brand AS brand, p_name AS pname,
       concat(replace(p_name, ' ', '_'), '_', CAST(p_partkey AS STRING)) AS tbl
FROM {part}
"""
BIG_ID = 9007199254740992   # 2^53: ids above it must keep every digit
TS0 = 1700000000000
NESTED = ('{"type":"list","element":"string"}',
          '{"type":"map","key":"string","value":"long"}',
          '{"type":"struct","fields":[{"name":"k","type":"string"},'
          '{"name":"v","type":{"type":"list","element":"int"}}]}')
NESTED_TEXT = ("list<string>", "map<string, long>", "struct<k:string, v:list<int>>")


def metadata_docs(spark, sf_dir):
    """``(namespace, table, doc)``: one metadata JSON document per table.
    Absent keys are left out of the JSON (null fields are not written)."""
    r = spread(spark_input(spark, sf_dir, TABLE_ROWS))
    k, s = F.col("k"), F.col("s")
    field = lambda i, n, typ, req=None, doc=None: F.struct(
        F.lit(i).cast("long").alias("id"), F.lit(n).alias("name"),
        F.parse_json(F.lit(json.dumps(typ))).alias("type"),
        (req if req is not None else F.lit(None).cast("boolean")).alias("required"),
        (doc if doc is not None else F.lit(None).cast("string")).alias("doc"))
    nested = F.parse_json(F.when(s % 3 == 0, NESTED[0]).when(s % 3 == 1, NESTED[1]).otherwise(NESTED[2]))
    nested_field = F.struct(F.lit(3).cast("long").alias("id"), F.lit("tags").alias("name"),
                            nested.alias("type"), F.lit(None).cast("boolean").alias("required"),
                            F.lit(None).cast("string").alias("doc"))
    schema0 = F.struct(F.lit(0).cast("long").alias("schema-id"),
                       F.array(field(1, "id", "long", F.lit(True))).alias("fields"))
    schema1 = F.struct(F.lit(1).cast("long").alias("schema-id"), F.array(
        field(1, "id", "long", F.lit(True)),
        field(2, "name", "string", None, F.when(s % 2 == 0, F.concat(F.lit("name of "), F.col("pname")))),
        nested_field,
        field(4, "price", "double", s % 2 == 1)).alias("fields"))
    legacy = k % 5 == 0
    schemas = F.when(~legacy, F.when(s % 4 != 0, F.array(schema0, schema1)).otherwise(F.array(schema0)))
    legacy_schema = F.when(legacy, F.struct(F.lit(0).cast("long").alias("schema-id"), F.array(
        field(1, "legacy", "string")).alias("fields")))
    pf = lambda n, t, src: F.struct(F.lit(n).alias("name"), F.lit(t).alias("transform"),
                                    F.lit(src).cast("long").alias("source-id"))
    specs = F.when(s % 5 != 0, F.array(
        F.struct(F.lit(0).cast("long").alias("spec-id"), F.array(pf("by_name", "identity", 2)).alias("fields")),
        F.struct(F.lit(1).cast("long").alias("spec-id"),
                 F.array(pf("id_bucket", "bucket[16]", 1), pf("ghost", "identity", 99)).alias("fields"))))
    n = s % 3
    sid = lambda i: k * 1000 + i + F.when(k % 11 == 0, F.lit(BIG_ID)).otherwise(F.lit(0))

    def snap(i):
        summ = F.map_concat(
            F.when((F.lit(i) == 2) & (s % 2 == 0), F.create_map().cast("map<string,string>"))
            .otherwise(F.create_map(F.lit("operation"), F.lit("append"))),
            F.create_map(F.lit("added-records"), (s * i).cast("string"),
                         F.lit("total-records"), (s * i).cast("string"),
                         F.lit("total-data-files"), F.lit(str(i))),
            F.when(k % 13 == 0, F.create_map().cast("map<string,string>"))
            .otherwise(F.create_map(F.lit("total-files-size"), F.lit(str(i * 4096)))))
        return F.struct(sid(i).alias("snapshot-id"),
                        (sid(i - 1) if i > 1 else F.lit(None).cast("long")).alias("parent-snapshot-id"),
                        (F.lit(TS0) + k * 10 + i).alias("timestamp-ms"), summ.alias("summary"))
    snaps = F.slice(F.array(snap(1), snap(2)), 1, n)
    props = F.map_concat(F.create_map(F.lit("owner"), F.col("brand"), F.lit("format"), F.lit("parquet")),
                         F.when(s % 2 == 0, F.create_map(F.lit("comment"), F.col("pname")))
                         .otherwise(F.create_map().cast("map<string,string>")))
    md = F.struct(
        (F.lit(1) + k % 2).cast("int").alias("format-version"),
        F.concat(F.lit("uuid-"), k.cast("string")).alias("table-uuid"),
        F.concat(F.lit("s3://lake/"), F.col("ptype"), F.lit("/"), F.col("tbl")).alias("location"),
        F.when(~legacy, F.when(s % 4 == 0, F.lit(7)).otherwise(F.lit(1))).cast("long").alias("current-schema-id"),
        schemas.alias("schemas"), legacy_schema.alias("schema"),
        F.when(s % 5 != 0, F.when(s % 7 == 0, F.lit(5)).otherwise(s % 2)).cast("long").alias("default-spec-id"),
        specs.alias("partition-specs"),
        F.when(n > 0, F.when(n == 1, sid(1)).otherwise(sid(2))).alias("current-snapshot-id"),
        snaps.alias("snapshots"), props.alias("properties"))
    ns = F.when(k % 3 == 0, F.array(F.lit("lake"), F.col("ptype"))).otherwise(F.array(F.col("ptype")))
    # every second document lies bare in its file, the others come wrapped
    doc = F.when(k % 2 == 0, F.to_json(md)).otherwise(F.to_json(F.struct(md.alias("metadata"))))
    return r.select(ns.alias("namespace"), F.col("tbl").alias("table"), doc.alias("doc"))


def broken_docs(spark, sf_dir):
    """The documents with every seventh cut off and every eleventh of another kind."""
    k = F.regexp_extract("doc", r'uuid-(\d+)', 1).cast("long")
    return metadata_docs(spark, sf_dir).withColumn(
        "doc", F.when(k % 7 == 0, F.concat(F.lit('{"metadata": {"location": "x'), k.cast("string")))
        .when(k % 11 == 0, F.concat(F.lit('{"kind": "'), k.cast("string"), F.lit('"}'))).otherwise(F.col("doc")))


def _parsed(spark, sf_dir):
    return M.parse(metadata_docs(spark, sf_dir))


def q_tbl_snapshots(spark, sf_dir):
    """Snapshots, the summary as sorted ``key=value`` text."""
    pairs = F.transform(F.map_entries("summary"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return M.snapshots(_parsed(spark, sf_dir)).withColumn("summary", F.array_join(F.array_sort(pairs), ","))


QUERIES = {
    "cfg_props": q_cfg_props,
    "cfg_redact": q_cfg_redact,
    "cfg_catalogs": q_cfg_catalogs,
    "cfg_connectors": q_cfg_connectors,
    "tbl_namespaces": lambda spark, d: M.namespaces(_parsed(spark, d)),
    "tbl_listing": lambda spark, d: M.tables(_parsed(spark, d)),
    "tbl_fields": lambda spark, d: M.current_fields(_parsed(spark, d)),
    "tbl_partitions": lambda spark, d: M.partition_fields(_parsed(spark, d)),
    "tbl_snapshots": q_tbl_snapshots,
    "tbl_rejects": lambda spark, d: M.rejects(broken_docs(spark, d)),
    "tbl_metrics": lambda spark, d: M.table_metrics(_parsed(spark, d)),
    "tbl_properties": lambda spark, d: M.properties(_parsed(spark, d)),
    "tbl_identity": lambda spark, d: M.identity(_parsed(spark, d)),
}

_T = f"""WITH t AS (
  SELECT *, CASE WHEN k % 3 = 0 THEN concat('lake.', ptype) ELSE ptype END AS namespace,
         k % 5 = 0 AS legacy, s % 3 AS n,
         CASE WHEN k % 11 = 0 THEN {BIG_ID} ELSE 0 END AS big
  FROM ({duck_text(TABLE_ROWS)}) r)"""
_NESTED_CASE = (f"CASE s % 3 WHEN 0 THEN '{NESTED_TEXT[0]}' WHEN 1 THEN '{NESTED_TEXT[1]}' "
                f"ELSE '{NESTED_TEXT[2]}' END")
_SNAP = f"""{_T},
i AS (SELECT * FROM (VALUES (1), (2)) v(i)),
sn AS (SELECT t.*, i.i FROM t JOIN i ON i.i <= t.n)"""

TBL_ORACLE = {
    "tbl_namespaces": f"{_T}\nSELECT DISTINCT namespace FROM t",
    "tbl_listing": f"{_T}\nSELECT namespace, tbl AS \"table\" FROM t",
    "tbl_fields": f"""{_T}
SELECT namespace, tbl AS "table", 0 AS pos, CAST(1 AS BIGINT) AS id, 'legacy' AS name, 'string' AS type,
       false AS required, CAST(NULL AS VARCHAR) AS doc FROM t WHERE legacy
UNION ALL
SELECT namespace, tbl, 0, 1, 'id', 'long', true, NULL FROM t WHERE NOT legacy
UNION ALL
SELECT namespace, tbl, 1, 2, 'name', 'string', false, CASE WHEN s % 2 = 0 THEN concat('name of ', pname) END
FROM t WHERE NOT legacy AND s % 4 <> 0
UNION ALL
SELECT namespace, tbl, 2, 3, 'tags', {_NESTED_CASE}, false, NULL FROM t WHERE NOT legacy AND s % 4 <> 0
UNION ALL
SELECT namespace, tbl, 3, 4, 'price', 'double', s % 2 = 1, NULL FROM t WHERE NOT legacy AND s % 4 <> 0""",
    "tbl_partitions": f"""{_T},
c AS (SELECT *, CASE WHEN s % 7 = 0 THEN 0 ELSE s % 2 END AS spec FROM t WHERE s % 5 <> 0)
SELECT namespace, tbl AS "table", 'by_name' AS name, 'identity' AS transform,
       CASE WHEN NOT legacy AND s % 4 <> 0 THEN 'name' ELSE '#2' END AS source_column FROM c WHERE spec = 0
UNION ALL
SELECT namespace, tbl, 'id_bucket', 'bucket[16]', CASE WHEN legacy THEN 'legacy' ELSE 'id' END FROM c WHERE spec = 1
UNION ALL
SELECT namespace, tbl, 'ghost', 'identity', '#99' FROM c WHERE spec = 1""",
    "tbl_snapshots": f"""{_SNAP}
SELECT namespace, tbl AS "table", CAST(k * 1000 + i + big AS VARCHAR) AS snapshot_id,
       CASE WHEN i > 1 THEN CAST(k * 1000 + i - 1 + big AS VARCHAR) END AS parent_id,
       {TS0} + k * 10 + i AS timestamp_ms,
       CASE WHEN i = 2 AND s % 2 = 0 THEN '—' ELSE 'append' END AS operation,
       i = n AS is_current, CAST(s * i AS BIGINT) AS added_records,
       concat_ws(',', 'added-records=' || s * i, CASE WHEN NOT (i = 2 AND s % 2 = 0) THEN 'operation=append' END,
                 'total-data-files=' || i, CASE WHEN k % 13 <> 0 THEN 'total-files-size=' || i * 4096 END,
                 'total-records=' || s * i) AS summary
FROM sn""",
    "tbl_rejects": f"""{_T}
SELECT namespace, tbl AS "table", CASE WHEN k % 7 = 0 THEN '{{"metadata": {{"location": "x' || k
                                       ELSE '{{"kind": "' || k || '"}}' END AS doc
FROM t WHERE k % 7 = 0 OR k % 11 = 0""",
    "tbl_metrics": f"""{_T}
SELECT namespace, tbl AS "table",
       CASE WHEN n > 0 THEN CAST(s * n AS BIGINT) END AS total_records,
       CASE WHEN n > 0 THEN CAST(n AS BIGINT) END AS total_data_files,
       CASE WHEN n > 0 AND k % 13 <> 0 THEN CAST(n * 4096 AS BIGINT) END AS total_files_size
FROM t""",
    "tbl_properties": f"""{_T}
SELECT namespace, tbl AS "table", 'owner' AS key, brand AS value FROM t
UNION ALL SELECT namespace, tbl, 'format', 'parquet' FROM t
UNION ALL SELECT namespace, tbl, 'comment', pname FROM t WHERE s % 2 = 0""",
    "tbl_identity": f"""{_T}
SELECT namespace, tbl AS "table", concat('s3://lake/', ptype, '/', tbl) AS location,
       CAST(1 + k % 2 AS INT) AS format_version, concat('uuid-', CAST(k AS VARCHAR)) AS uuid,
       CASE WHEN n > 0 THEN CAST(k * 1000 + n + big AS VARCHAR) END AS current_snapshot_id
FROM t""",
}

ORACLE = {**CFG_ORACLE, **TBL_ORACLE}
