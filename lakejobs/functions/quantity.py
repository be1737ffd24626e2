"""Resource quantity text -> numbers, as column expressions (OBS-2, OBS-3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Memory unit multipliers (binary and decimal suffixes).
MEMORY_UNITS = {
    "Ki": 1024, "Mi": 1024 ** 2, "Gi": 1024 ** 3, "Ti": 1024 ** 4,
    "K": 1e3, "M": 1e6, "G": 1e9, "T": 1e12,
}
# Units Kubernetes also accepts; off unless asked for (lower-case k, Pi, Ei, P, E).
EXTRA_MEMORY_UNITS = {"k": 1e3, "Pi": 1024 ** 5, "Ei": 1024 ** 6, "P": 1e15, "E": 1e18}

QUANTITY_PATTERN = r"^(\d+(?:\.\d+)?)([A-Za-z]+)?$"


def _num(c: Column) -> Column:
    return c.try_cast("double")


def cpu_millicores(cpu: Column | str) -> Column:
    """CPU quantity text -> millicores: ``n`` / 1e6, ``u`` / 1e3, ``m`` as is,
    bare number x 1000; empty or missing -> 0; unreadable number -> null."""
    c = F.col(cpu) if isinstance(cpu, str) else cpu
    body = F.substring(c, F.lit(1), F.length(c) - 1)
    return (F.when(c.isNull() | (c == ""), F.lit(0.0))
            .when(c.endswith("n"), _num(body) / 1e6)
            .when(c.endswith("u"), _num(body) / 1e3)
            .when(c.endswith("m"), _num(body))
            .otherwise(_num(c) * 1000))


def mem_bytes(mem: Column | str, extra_units: bool = False) -> Column:
    """Memory quantity text -> bytes. Binary (Ki..Ti) and decimal (K..T)
    suffixes scale; an unknown suffix leaves the number alone; text that is
    not ``<number><letters?>`` gives 0, as does a missing value."""
    c = F.col(mem) if isinstance(mem, str) else mem
    units = dict(MEMORY_UNITS)
    if extra_units:
        units.update(EXTRA_MEMORY_UNITS)
    unit_map = F.create_map(*[x for k, v in units.items() for x in (F.lit(k), F.lit(float(v)))])
    num = F.regexp_extract(c, QUANTITY_PATTERN, 1).try_cast("double")
    unit = F.regexp_extract(c, QUANTITY_PATTERN, 2)
    factor = F.coalesce(F.try_element_at(unit_map, unit), F.lit(1.0))
    return F.when(c.isNull() | ~c.rlike(QUANTITY_PATTERN), F.lit(0.0)).otherwise(num * factor)


# Fixed value: log tail size when none is asked for.
TAIL_DEFAULT = 500


def tail_size(text) -> int:
    """Requested number of log lines: leading integer of the text; missing,
    zero or unreadable -> 500. Any other number is taken as asked."""
    import re
    m = re.match(r"^\s*([+-]?\d+)", "" if text is None else str(text))
    n = int(m.group(1)) if m else 0
    return n or TAIL_DEFAULT
