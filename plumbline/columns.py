"""Column names, classes of columns, missing values, casts."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Type names of plans and what they are here (unsigned kinds widen).
DTYPES = {
    "int8": "tinyint", "Int8": "tinyint", "int16": "smallint", "Int16": "smallint", "int32": "int", "Int32": "int", "int64": "bigint", "Int64": "bigint",
    "uint8": "smallint", "uint16": "int", "uint32": "bigint", "uint64": "decimal(20,0)", "float16": "float", "float32": "float", "float64": "double",
    "bool": "boolean", "boolean": "boolean", "object": "string", "string": "string", "category": "string", "datetime64[ns]": "timestamp", "timedelta64[ns]": "interval day to second",
}


def col(name: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def categorical(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def canonical(df: DataFrame) -> DataFrame:
    """Floating NaN becomes null, which every operator takes for missing."""
    return df.select(*(F.nanvl(col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else col(f.name) for f in df.schema))


def resolve(name: str, names: list[str], cutoff: float = 0.6) -> str | None:
    """``name`` itself or its closest match."""
    return name if name in names else next(iter(difflib.get_close_matches(name, names, 1, cutoff)), None)


def cast_columns(df: DataFrame, types: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    """Casts by column; a column with values that fail stays as it is. Also gives the failures of each.

    Names are matched as ``resolve`` does; names without a match and unknown types are left out.
    """
    wanted = {c: DTYPES[t] for n, t in types.items() if (c := resolve(n, df.columns)) and t in DTYPES}
    if not wanted:
        return df, {}
    failed = df.agg(*(F.count_if(col(c).isNotNull() & col(c).try_cast(t).isNull()).alias(c) for c, t in wanted.items())).head().asDict()
    return df.select(*(col(c).try_cast(wanted[c]).alias(c) if failed.get(c) == 0 else col(c) for c in df.columns)), failed
