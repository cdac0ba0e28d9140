"""User functions: whole tables, Arrow batches, and batched model calls."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, types as T

from prepflow.operators.columns import prompt_text
from prepflow.schema import require_columns

MODEL_ROW_GUARD = 500
PROMPT = "__prompt"

TableFunction = Callable[[DataFrame | None], DataFrame | None]
TextModel = Callable[[list[str]], Sequence[str]]


def python_transform(df: DataFrame | None, fn: TableFunction | None = None) -> DataFrame | None:
    """Apply a function from table to table.

    No function leaves the table unchanged, and a function that returns nothing
    counts as returning its input.  A function may also make a table from none.
    """
    if fn is None:
        return df
    result = fn(df)
    if result is None:
        result = df
    if not isinstance(result, DataFrame):
        raise TypeError(f"python_transform: expected a DataFrame, got {type(result).__name__}")
    return result


def map_batches(
    df: DataFrame,
    fn: Callable[[Iterator[pd.DataFrame]], Iterable[pd.DataFrame]],
    schema: T.StructType | str,
) -> DataFrame:
    """Run Python on Arrow batches of rows, without a shuffle."""
    return df.mapInPandas(fn, schema)


def answers(model: TextModel, prompts: list[str]) -> list[str]:
    """Model answers for a batch; when a batch fails, rows are asked one by one."""
    try:
        out = [str(a).strip() for a in model(prompts)]
        if len(out) == len(prompts):
            return out
        failure: Exception = ValueError(f"{len(out)} answers for {len(prompts)} prompts")
    except Exception as bad:  # user code may raise anything
        failure = bad
    if len(prompts) == 1:
        return [f"Error: {failure}"]
    return [answers(model, [p])[0] for p in prompts]


def map_model(
    df: DataFrame,
    model: TextModel,
    input_column: str = "",
    output_column: str = "AI_Response",
    prompt_template: str = "Extract the sentiment from: {Input}",
    bypass_warning: bool = False,
) -> DataFrame:
    """Ask ``model`` about every row and write its answer to a text column.

    ``model`` takes a list of prompts and returns as many answers; a failing row
    gets ``Error: ...``.  More than 500 rows are refused unless ``bypass_warning``
    is set, because models are slow and metered.  A missing input column leaves
    the table unchanged.
    """
    if not input_column or input_column not in df.columns:
        return df
    if not bypass_warning and not df.isStreaming:
        if df.limit(MODEL_ROW_GUARD + 1).count() > MODEL_ROW_GUARD:
            raise RuntimeError(
                f"map_model: more than {MODEL_ROW_GUARD} rows; set bypass_warning to go on"
            )
    prompted = prompt_text(df, input_column, prompt_template, PROMPT)
    kept = [f for f in df.schema.fields if f.name != output_column]
    schema = T.StructType([*kept, T.StructField(output_column, T.StringType())])
    names = schema.fieldNames()

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[output_column] = answers(model, batch[PROMPT].tolist()) if len(batch) else []
            yield batch[names]

    return prompted.mapInPandas(ask, schema)


def describe_with(
    df: DataFrame, fn: Callable[[list], Sequence[str]], column: str, output_column: str
) -> DataFrame:
    """Replace ``column`` by a text that ``fn`` gives for each batch of its values."""
    require_columns(df, [column], "describe")
    kept = [f for f in df.schema.fields if f.name not in (column, output_column)]
    schema = T.StructType([*kept, T.StructField(output_column, T.StringType())])
    names = schema.fieldNames()

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [str(t) for t in fn(batch[column].tolist())] if len(batch) else []
            yield batch.assign(**{output_column: pd.Series(texts, dtype=object, index=batch.index)})[names]

    return df.mapInPandas(describe, schema)
