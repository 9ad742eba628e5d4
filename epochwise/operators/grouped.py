"""Grouped and batched pandas maps with a declared schema and failure capture."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

FAILURE = "failure"


def _checked(out: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    missing = [n for n in names if n not in out.columns]
    if missing:
        raise ValueError(f"columns missing from the result: {missing}")
    return out[names]


def _guarded(fn: Callable[[pd.DataFrame], pd.DataFrame], names: list[str], key: str | None, fail_fast: bool):
    """Run ``fn``; an error becomes one row with its text unless failing fast."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = _checked(fn(pdf), names).assign(**{FAILURE: ""})
        except Exception as exc:  # noqa: BLE001
            if fail_fast:
                raise
            row = {n: None for n in names}
            if key in names and len(pdf):
                row[key] = pdf[key].iloc[0]
            out = pd.DataFrame([row | {FAILURE: f"{type(exc).__name__}: {exc}"}])
        return out

    return run


def with_failure(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add(FAILURE, StringType())


def grouped_map(
    df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType, fail_fast: bool = False, part: str | None = None, parts: int = 1
) -> DataFrame:
    """``fn`` on each key's rows, one pandas frame at a time.

    A group is handed to one task whole.  Where a key may be large and ``fn``
    works on any subset of it, give a ``part`` column to split each key by hash
    into ``parts`` pieces.
    """
    run = _guarded(fn, schema.names, key, fail_fast)
    if part is None:
        return df.groupBy(key).applyInPandas(run, schema=with_failure(schema))
    split = df.withColumn("_part", F.pmod(F.xxhash64(part), F.lit(parts)).cast("int"))

    def inner(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.drop(columns="_part"))

    return split.groupBy(key, "_part").applyInPandas(inner, schema=with_failure(schema))


def combined_map(df: DataFrame, key: str, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType, merge: dict[str, Callable[[str], Column]]) -> DataFrame:
    """``fn`` on pieces of each key, partial results put together per key by ``merge``, for keys of any size.

    A piece is a key's rows of one Arrow batch, so raw rows are not shuffled and no task holds a key whole; ``fn`` must give
    results of any subset that the aggregates in ``merge`` (one for each other column) can join.  A piece that fails
    is halved down to the rows that fail by themselves.  Returns key, merged columns, ``failed_rows`` and ``failure``, the
    least of the key's error texts; a key whose rows all fail has nulls.  Null keys are a key of their own; pandas holds whole-number
    keys beside nulls as floats, so cast those beyond 2^53 to text first.
    """
    names = schema.names
    if set(merge) != set(names) - {key}:
        raise ValueError(f"merge must name every column but {key}: {sorted(merge)}")

    def pieces(pdf: pd.DataFrame, value: object) -> Iterator[pd.DataFrame]:
        try:
            yield _checked(fn(pdf), names).assign(**{FAILURE: ""})
        except Exception as exc:  # noqa: BLE001
            if len(pdf) == 1:
                yield pd.DataFrame([dict.fromkeys(names) | {key: value, FAILURE: f"{type(exc).__name__}: {exc}"}])
            else:
                half = len(pdf) // 2
                yield from pieces(pdf.iloc[:half].reset_index(drop=True), value)
                yield from pieces(pdf.iloc[half:].reset_index(drop=True), value)

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for value, part in pdf.groupby(key, dropna=False, sort=False):
                yield from pieces(part.reset_index(drop=True), None if pd.isna(value) else value)

    mapped = df.mapInPandas(batches, schema=with_failure(schema))
    failed = F.col(FAILURE) != ""
    return mapped.groupBy(key).agg(
        *[how(n).alias(n) for n, how in merge.items()], F.count_if(failed).alias("failed_rows"), F.coalesce(F.min(F.when(failed, F.col(FAILURE))), F.lit("")).alias(FAILURE)
    )


def batch_map(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType, key: str | None = None, partitions: int | None = None, fail_fast: bool = False) -> DataFrame:
    """``fn`` on Arrow batches; repartitioned by key only when asked to.

    A batch that fails is run again in halves, so only the rows that fail by themselves become failure rows.
    """
    run = _guarded(fn, schema.names, key, fail_fast)

    def pieces(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = run(pdf)
        if len(pdf) > 1 and len(out) == 1 and out[FAILURE].iloc[0]:
            half = len(pdf) // 2
            yield from pieces(pdf.iloc[:half].reset_index(drop=True))
            yield from pieces(pdf.iloc[half:].reset_index(drop=True))
        else:
            yield out

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield from pieces(pdf)

    if key is not None:
        df = df.repartition(partitions, key) if partitions else df.repartition(key)
    return df.mapInPandas(batches, schema=with_failure(schema))


def results(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col(FAILURE) == "").drop(FAILURE)


def failures(mapped: DataFrame) -> DataFrame:
    return mapped.where(F.col(FAILURE) != "")
