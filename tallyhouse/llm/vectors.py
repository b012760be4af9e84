"""Parts that the operators on vectors share: usable rows, matrices, query blocks, best rows of each query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Queries that travel to the tasks at once: 32,768 of 64 numbers are 16 MB.
QUERY_BLOCK = 32_768

#: Stands for a null id inside the tasks; it comes after all others.
NO_ID = np.iinfo(np.int64).max


def finite(vector: Column) -> Column:
    """True for a vector without null, NaN or infinite components (an empty one has none)."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as doubles; shorter rows are filled with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def as_wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64)


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Tables of at most ``rows`` rows; small batches are put together."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            if n + part.num_rows > rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def column(table: pa.Table, name: str) -> pa.Array:
    """A column of one of :func:`slices` as a single array."""
    chunks = table.column(name).combine_chunks()
    return chunks.chunk(0) if isinstance(chunks, pa.ChunkedArray) else chunks


def query_blocks(queries: DataFrame, rows: int = QUERY_BLOCK) -> Iterator[pa.Table]:
    """The query rows in tables of at most ``rows``, one at a time on the driver.

    The rows are first written as packed blocks. The driver then fetches them one partition after the
    other, and a partition holds about one block.
    """
    schema = queries.schema
    count = queries.count()

    def pack(batches):
        for t in slices(batches, rows):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, t.schema) as out:
                out.write_table(t)
            yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    names = [f.name for f in schema.fields]
    spread = queries.repartition(max(1, -(-count // rows)), *[F.col(f"`{n}`") for n in names])
    packed = written(spread.mapInArrow(pack, "block binary"), "query-blocks")
    held, n = [], 0
    for (block,) in packed.toLocalIterator():
        part = pa.ipc.open_stream(pa.py_buffer(bytes(block))).read_all()
        if n + part.num_rows > rows:
            yield pa.concat_tables(held).combine_chunks()
            held, n = [], 0
        held.append(part)
        n += part.num_rows
    if held:
        yield pa.concat_tables(held).combine_chunks()


def in_blocks(queries: DataFrame, search: Callable[[pa.Table], DataFrame], name: str, rows: int = QUERY_BLOCK) -> DataFrame | None:
    """Results of ``search`` for each block of queries, each written before the next begins."""
    out = None
    for block in query_blocks(queries, rows):
        part = written(search(block), name)
        out = part if out is None else out.unionByName(part)
    return out


def best(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group with their rank from 1; tasks send ``n`` rows a group at most."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)
