"""User work functions over batches of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .. import errors

ROLES = ("in", "out", "inout")


def sentinel_of(value, kind) -> object | None:
    """The number that stands for null in an Arrow type, or None if it does not fit there."""
    import pyarrow as pa

    if value is None or isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        return pa.scalar(value, kind).as_py() if isinstance(value, float) == pa.types.is_floating(kind) else None
    except (pa.ArrowInvalid, OverflowError):
        return None


def run(df: DataFrame, function: Callable, schema: str, group: int = 0, roles: dict[str, str] | None = None, sentinels: dict[str, object] | None = None) -> DataFrame:
    """function on each Arrow batch of df; what it returns, columns by name, are the rows of the result.

    Columns that it only reads are inputs, those that it returns are outputs.  roles may say so: it
    is then given only the columns of ``in`` and ``inout`` and must return those of ``out`` and ``inout``.
    sentinels stand for null, both ways, in the columns that they fit; others keep Arrow's nulls.
    group is the most rows of a batch; 0 leaves the size to Spark.  An error that it raises ends the
    query as it is.
    """
    kinds = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, known, sentinels, wanted = kinds.fieldNames(), set(df.columns), dict(sentinels or {}), to_arrow_schema(kinds)
    if roles is not None:
        if bad := [r for r in roles.values() if r not in ROLES]:
            raise ValueError(f"no role {bad[0]}")
        read = [n for n, r in roles.items() if r != "out"]
        if missing := [n for n in read if n not in known] + [n for n, r in roles.items() if r != "in" and n not in names]:
            raise errors.NoSuchColumn(missing[0])
        df = df.select(*[f"`{n}`" for n in read])
    if unknown := set(sentinels) - known - set(names):
        raise errors.NoSuchColumn(min(unknown))

    def batches(frames):
        import pyarrow as pa
        import pyarrow.compute as pc

        def told(batch):
            columns = []
            for n, x in zip(batch.schema.names, batch.columns, strict=True):
                own = sentinel_of(sentinels.get(n), x.type)
                columns.append(x if own is None else x.fill_null(own))
            return pa.RecordBatch.from_arrays(columns, batch.schema.names)

        def back(n, x):
            x = x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x)
            own = sentinel_of(sentinels.get(n), x.type)
            x = x if own is None else pc.if_else(pc.equal(x, own), pa.scalar(None, x.type), x)
            return x if x.type == wanted.field(n).type else x.cast(wanted.field(n).type)

        for batch in frames:
            for a in range(0, batch.num_rows, group or max(1, batch.num_rows)):
                out = function(told(batch.slice(a, group) if group else batch))
                if lost := [n for n in names if n not in out]:
                    raise errors.NoSuchColumn(lost[0])
                yield pa.RecordBatch.from_arrays([back(n, out[n]) for n in names], names)

    return df.mapInArrow(batches, schema)
