"""Rewriting leaves of nested columns, by a path of field names."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

Rewrite = Callable[[Column], Column]


def _rewritten(value: Column, kind: DataType, path: Sequence[str], change: Rewrite) -> Column:
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: _rewritten(x, kind.elementType, path, change))
    if not path:
        return change(value).cast(kind)
    if not isinstance(kind, StructType) or path[0] not in kind.names:
        raise ValueError(f"no field {path[0]} in {kind.simpleString()}")
    field = kind[path[0]].dataType
    inner = _rewritten(value.getField(path[0]), field, path[1:], change)
    return F.when(value.isNotNull(), value.withField(f"`{path[0]}`", inner))


def rewrite_leaves(df: DataFrame, changes: dict[str, Rewrite]) -> DataFrame:
    """``df`` with leaves of nested columns changed; its schema stays.

    A path names fields from the column on, with dots ('releases.media.tracks.title'); arrays on the way are
    entered. Null structs and arrays stay null, empty arrays empty. ValueError for a path that the schema does not have.
    """
    columns: dict[str, Column] = {}
    for path, change in changes.items():
        name, *rest = path.split(".")
        if name not in df.columns:
            raise ValueError(f"no column {name}")
        columns[name] = _rewritten(columns.get(name, F.col(f"`{name}`")), df.schema[name].dataType, rest, change)
    return df.withColumns(columns)
