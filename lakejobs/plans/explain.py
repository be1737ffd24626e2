"""Print a compact physical-plan outline of registered queries: exchanges,
joins, aggregates, window limits, Python steps and scans (pushed filters and
read schema). Usage: ``python -m lakejobs.plans.explain SF_DIR [query ...]``."""

from __future__ import annotations

import re
import sys

KEEP = re.compile(r"(Exchange|Join|HashAggregate|ObjectHashAggregate|SortAggregate|WindowGroupLimit|"
                  r"Window |ArrowEvalPython|MapInPandas|Generate|FileScan|Subquery|Expand|Union|TakeOrdered)")


def _field(line: str, name: str) -> str:
    m = re.search(name + r": (\[.*?\](?=, [A-Z][A-Za-z]+:)|struct<[^>]*>?|\S+)", line)
    return m.group(1) if m else ""


def _scan(line: str) -> str:
    """FileScan line -> columns, file, partition filters, pushed filters."""
    head = line[:line.index("FileScan")]
    cols = re.search(r"FileScan \w+ (\[[^\]]*\])", line)
    loc = re.search(r"\[file:[^\]]*?([^/\]]+)\]", line)
    parts = [f"FileScan {cols.group(1) if cols else ''}", loc.group(1) if loc else ""]
    for f in ("PartitionFilters", "PushedFilters"):
        v = _field(line, f)
        if v and v != "[]":
            parts.append(f"{f}: {v}")
    return head + "  ".join(p for p in parts if p)


def outline(df, width: int = 170) -> list[str]:
    """Executed plan after AQE (the query is run once through a noop sink)."""
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        if not KEEP.search(line):
            continue
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r", \[plan_id=\d+\]", "", line)
        if "FileScan" in line:
            line = _scan(line)
        out.append(line[:width] if "FileScan" not in line else line)
    return out


def main(argv):
    from lakejobs.plans import registry
    from lakejobs.session import build_session
    sf_dir = argv[0]
    names = argv[1:] or list(registry.QUERIES)
    spark = build_session()
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for n in names:
        print(f"### {n}\n```")
        print("\n".join(outline(registry.QUERIES[n](spark, sf_dir))))
        print("```\n")


if __name__ == "__main__":
    main(sys.argv[1:])
