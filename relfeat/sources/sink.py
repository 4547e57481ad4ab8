"""Where feature matrices go: to the driver, whole or in blocks of columns, or to Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from relfeat.errors import RelfeatError
from relfeat.functions import named

#: What a matrix can be collected as. None: a list of rows, Spark's own form.
BACKENDS = ("pandas", "pyarrow", "numpy")


def convert_table(table: DataFrame, to: str | None = None) -> Any:
    """Collect a DataFrame as pandas, pyarrow, numpy (a two-dimensional array) or a list of rows."""
    if to is None:
        return table.collect()
    if to == "pandas":
        return table.toPandas()
    if to == "pyarrow":
        return table.toArrow()
    if to == "numpy":
        return table.toPandas().to_numpy()
    raise RelfeatError(f"backend={to!r} is not known; choose from {', '.join(BACKENDS)}")


def collect_feature_matrix(matrix: DataFrame, backend: str | None = "pandas", batch_size: int | None = None) -> Any:
    """Collect a matrix whose first column is its primary key.

    batch_size: so many feature columns a query, to bound what one query aggregates; each query is sorted by the primary key and
    the blocks are put side by side on the driver. To keep a matrix on the cluster, use write_feature_matrix.
    """
    if batch_size is None:
        return convert_table(matrix, backend)
    if not isinstance(batch_size, int) or isinstance(batch_size, bool):
        raise TypeError(f"batch_size={batch_size!r} is not an integer.")
    if batch_size < 1:
        raise ValueError(f"batch_size={batch_size} is below 1.")
    if backend not in (None, *BACKENDS):
        raise RelfeatError(f"backend={backend!r} is not known; choose from {', '.join(BACKENDS)}")
    key, *columns = matrix.columns
    whole = _block(matrix, key, ()).toArrow()
    for i in range(0, len(columns), batch_size):
        some = columns[i : i + batch_size]
        block = _block(matrix, key, some).toArrow()
        if block.column(0) != whole.column(0):
            raise RelfeatError("the matrix's keys changed between queries; its sources must not change while it is collected")
        for name in some:
            whole = whole.append_column(block.schema.field(name), block.column(name))
    if backend == "pyarrow":
        return whole
    if backend is None:
        return whole.to_pylist()
    return whole.to_pandas() if backend == "pandas" else whole.to_pandas().to_numpy()


def _block(matrix: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    return matrix.select(named(key), *map(named, columns)).orderBy(named(key))


def write_feature_matrix(matrix: DataFrame, path: str, batch_size: int | None = None, mode: str = "errorifexists") -> list[str]:
    """Write a matrix as Parquet; with batch_size, in groups of so many feature columns, each with the key. Returns the paths."""
    key, *columns = matrix.columns
    if batch_size is None:
        matrix.write.mode(mode).parquet(path)
        return [path]
    paths = []
    for n, i in enumerate(range(0, len(columns), batch_size)):
        paths.append(f"{path}/columns-{n:05d}")
        matrix.select(named(key), *map(named, columns[i : i + batch_size])).write.mode(mode).parquet(paths[-1])
    return paths
