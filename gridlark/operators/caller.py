"""Scoring with a caller's function: a schema gate before, checks of what it returns after."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

#: Inputs of some rows, in the order asked for, to one number per row.
PredictionFunction = Callable[[pa.RecordBatch], Sequence[float]]


class PredictionError(ValueError):
    """The function's answer does not fit the rows it was given."""


def gate(df: DataFrame, columns: Sequence[str]) -> None:
    """The inputs must be there, once each, and numbers, truth values or texts."""
    lost = [c for c in columns if df.columns.count(c) != 1]
    if lost or len(set(columns)) != len(columns):
        raise PredictionError(f"inputs are missing or repeated: {lost or list(columns)}")
    wrong = [c for c in columns if not isinstance(df.schema[c].dataType, (T.NumericType, T.BooleanType, T.StringType))]
    if wrong:
        raise PredictionError(f"inputs have no type a model takes: {wrong}")


def score_with(df: DataFrame, columns: Sequence[str], predict: PredictionFunction, name: str = "forecast", rows_at_once: int = 10_000) -> DataFrame:
    """``df`` with `name`, what the function gives for each row, and `name`_valid, whether it is a finite number.

    The function sees only the inputs, in the order asked for, some rows at a
    time; it must answer with one number per row in the order of the rows and
    must not depend on how rows are cut into batches. A wrong number of answers,
    or one that is no number, fails the job. Columns of `df` called like the two
    new ones are replaced; rows keep all others.
    """
    gate(df, columns)
    kept = [c for c in df.columns if c not in (name, f"{name}_valid")]
    inputs = [f"_in_{i}" for i in range(len(columns))]
    rows = df.select(F.struct(*kept).alias("_row"), *(F.col(c).alias(i) for c, i in zip(columns, inputs)))
    schema = T.StructType([rows.schema["_row"], T.StructField(name, T.DoubleType()), T.StructField(f"{name}_valid", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(low, rows_at_once)
                given = pa.RecordBatch.from_arrays([part[i] for i in inputs], names=list(columns))
                try:
                    made = np.asarray(predict(given), dtype=np.float64)
                except (TypeError, ValueError) as problem:
                    raise PredictionError(f"an answer is no number: {problem}") from problem
                if made.shape != (part.num_rows,):
                    raise PredictionError(f"{part.num_rows} rows gave answers of shape {made.shape}")
                fine = np.isfinite(made)
                yield pa.RecordBatch.from_arrays([part["_row"], pa.array(made, mask=~fine), pa.array(fine)], names=schema.names)

    return rows.mapInArrow(run, schema).select("_row.*", name, f"{name}_valid")
