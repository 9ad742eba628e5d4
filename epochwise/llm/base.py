"""What the operators of this package share: inputs, registration, Arrow batches, numpy forests."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of text that one group of rows should hold; groups are as many as the input needs.
GROUP_BYTES = 8 << 20
#: Rows of an Arrow batch of texts, where a plan is run at once.
TEXT_ROWS = 1000


def query(name: str, oracle: str | None = None):
    """Register a query of this package, with its DuckDB form where SQL can express it."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only (doc_id, text), so extra columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def arrow_map(fn: Callable[[Iterator[tuple[list, list]]], Iterator[dict]], schema: pa.Schema, rows: int = 2000):
    """A mapInArrow function over (ids, texts) lists of at most ``rows`` rows; ``fn`` yields dicts of columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces():
            for b in batches:
                for at in range(0, b.num_rows, rows):
                    part = b.slice(at, rows)
                    yield part.column(0).to_pylist(), part.column(1).to_pylist()

        for columns in fn(pieces()):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)

    return run


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow form of a flat "name type, ..." schema; tasks have no session to ask."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split() for field in ddl.split(","))])


class Batches:
    """Rows gathered into record batches of bounded bytes."""

    def __init__(self, ddl: str, batch_bytes: int = 4 << 20):
        self.schema, self.batch_bytes = arrow_schema(ddl), batch_bytes
        self.rows, self.bytes = [], 0

    def add(self, *row) -> bool:
        """True when the rows should be taken."""
        self.rows.append(row)
        self.bytes += 64 + sum(len(v) for v in row if isinstance(v, (bytes, str)))
        return self.bytes >= self.batch_bytes

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * len(self.schema)
        self.rows, self.bytes = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts; one pass that reads the text column only."""
    return docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0


def hash_group(key: Column, groups: int) -> Column:
    """Number of the group of a row; a function of the key alone, so a recomputed task sees the same groups."""
    return F.pmod(F.xxhash64(key, F.lit("group")), F.lit(groups)).cast("int")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the links a-b, without the roots themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    ia, ib = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[ia], parent[ib])
        new = parent.copy()
        np.minimum.at(new, parent[ia], low)
        np.minimum.at(new, parent[ib], low)
        np.minimum.at(new, ia, low)
        np.minimum.at(new, ib, low)
        while (up := new[new]).tolist() != new.tolist():
            new = up
        if (new == parent).all():
            keep = parent != np.arange(len(nodes))
            return nodes[keep], nodes[parent[keep]]
        parent = new
