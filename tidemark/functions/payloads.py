"""Fields of JSON payloads whose shape differs from row to row."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fields(df: DataFrame, payload: str, wanted: dict[str, tuple[str, str, Any]], parsed: str = "payload_variant") -> DataFrame:
    """``df`` with the payload parsed once, as ``parsed``, and a column for each of ``wanted``: name to (path, type, default).

    Text that is not JSON is null, and so is every field of it. A path that is not there, a null there, and a value that the type cannot take give the default,
    which may be None. Paths reach into objects and arrays ($.a.b[0]).
    """
    out = df.withColumn(parsed, F.try_parse_json(payload))
    return out.withColumns({name: _field(F.col(parsed), path, kind, default) for name, (path, kind, default) in wanted.items()})


def _field(payload: Column, path: str, kind: str, default: Any) -> Column:
    value = F.try_variant_get(payload, path, kind)
    return value if default is None else F.when(payload.isNotNull(), F.coalesce(value, F.lit(default).cast(kind)))
