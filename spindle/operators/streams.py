"""Rows of one key after another: whole groups of sorted partitions, many in a batch.

A pandas table and an Arrow batch for each key cost more than most keys' work;
here they are made once for some thousand rows, whatever the number of keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

FIRST = "__first"


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole groups with the rows at which these begin, and the number of rows; a group may go over many batches."""
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[tuple[pa.Table, list[int]]]:
        if rows := sum(b.num_rows for b in held):
            table = pa.Table.from_batches(held).combine_chunks()
            yield table, [*np.flatnonzero(table[FIRST].to_numpy()).tolist(), rows]

    for b in batches:
        begins = np.flatnonzero(b[FIRST].to_numpy(zero_copy_only=False))
        if not len(begins):
            held.append(b)
            continue
        last = int(begins[-1])
        held.append(b.slice(0, last))
        yield from told()
        held = [b.slice(last)]
    if held:
        yield from told()


def values(column: pa.ChunkedArray) -> np.ndarray | list:
    """Numbers with nan for null, other values with None; whole numbers stay whole beside nulls. Lists of one length are rows of an array."""
    if pa.types.is_floating(column.type) or (pa.types.is_integer(column.type) and not column.null_count):
        return column.to_numpy()
    if pa.types.is_string(column.type):
        return column.to_numpy().tolist()
    if pa.types.is_list(column.type) and pa.types.is_floating(column.type.value_type) and len(column) and not column.null_count:
        sizes = pc.unique(pc.list_value_length(column))
        if len(sizes) == 1 and sizes[0].as_py():
            return pc.list_flatten(column).to_numpy().reshape(len(column), -1)
    rows = column.to_pylist()
    return [float("nan") if x is None else x for x in rows] if pa.types.is_integer(column.type) else rows


def dealt(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows dealt out by key. Rows that are dealt so before their windows by the key are moved once only, by ``marked`` too.

    The work is the processor's, not of bytes: partitions aren't put together by their size.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def marked(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows dealt out by key and sorted within it, each key's first one marked."""
    return dealt(rows, keys).withColumn(FIRST, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str], one: Callable[[dict], dict[str, list] | None], schema: str) -> DataFrame:
    """``one`` on the columns of each key in order; its columns, of a row or more, with the keys before them. ``schema`` is of its columns."""
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    names = [c for c in rows.columns if c not in keys]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches):
            columns = {c: values(table[c]) for c in names}
            out: dict[str, list] = {}
            at: list[int] = []
            for i, j in zip(edges, edges[1:], strict=False):
                found = one({c: v[i:j] for c, v in columns.items()})
                if found:
                    at += [i] * len(next(iter(found.values())))
                    for c, v in found.items():
                        out.setdefault(c, []).extend(v)
            if at:
                own = table.select(list(keys)).take(pa.array(at, pa.int64()))
                arrays = [pa.array(v, wanted.field(c).type, from_pandas=True) for c, v in out.items()]
                yield from pa.Table.from_arrays([*own.columns, *arrays], names=[*keys, *out]).combine_chunks().to_batches()

    wanted = to_arrow_schema(StructType.fromDDL(schema))
    return marked(rows, keys, order).mapInArrow(stream, ", ".join([*(f"`{k}` {types[k]}" for k in keys), schema]))
