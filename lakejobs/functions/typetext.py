"""Nested field type -> compact text (TBL-4), e.g. ``struct<a:int, b:list<string>>``.

The type of a table field is either a primitive name or a JSON object that
nests to any depth; built-in expressions cannot recurse, so this one column
goes through a vectorised pandas UDF. Work per value is the size of the type.
"""

from __future__ import annotations

import json
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship this module's code with the UDF, so executors need only pandas (not
# this package on their path).
cloudpickle.register_pickle_by_value(sys.modules[__name__])

UNKNOWN = "?"  # fixed value: shown where a type or a name is missing


def render_type(t) -> str:
    """Text of a type; anything that is no type is ``?``."""
    if isinstance(t, str) and t:
        return t
    kind = t.get("type") if isinstance(t, dict) else None
    if kind == "struct":
        fields = [f for f in t.get("fields") or [] if isinstance(f, dict)]
        return f"struct<{', '.join(f'{f.get('name') or UNKNOWN}:{render_type(f.get('type'))}' for f in fields)}>"
    if kind in ("list", "map"):
        parts = ("element",) if kind == "list" else ("key", "value")
        return f"{kind}<{', '.join(render_type(t.get(p)) for p in parts)}>"
    return kind if isinstance(kind, str) and kind else UNKNOWN


def _text(raw):
    if raw is None:
        return None
    s = raw.strip()
    if s.startswith("{") or s.startswith("["):
        try:
            return render_type(json.loads(s))
        except ValueError:
            return raw
    return raw


@F.pandas_udf(T.StringType())
def type_text(raw: pd.Series) -> pd.Series:
    """Raw type (primitive name or JSON object text) -> compact text. Field
    types repeat across tables, so each distinct text is rendered once per
    Arrow batch."""
    codes, uniques = pd.factorize(raw, use_na_sentinel=True)
    rendered = pd.array([_text(u) for u in uniques] + [None], dtype=object)
    return pd.Series(rendered[codes], index=raw.index, dtype=object)
