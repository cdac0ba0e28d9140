"""Running the stateless operators on streams.

Filters, select, formula, regular expressions, cleansing, dates, union and joins
with a static table are plain column work and run unchanged on a streaming
DataFrame.  Operators that depend on row order or on the whole table refuse
streams (``schema.require_batch``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from prepflow.session import scratch_path


def write_available(
    stream: DataFrame,
    transform: Callable[[DataFrame], DataFrame],
    path: str,
    output_format: str = "parquet",
    checkpoint: str | None = None,
    timeout: float | None = None,
) -> bool:
    """Apply ``transform`` to everything the stream has now and write it to ``path``.

    Progress is kept in ``checkpoint`` (a fresh scratch folder if none is named),
    so a later call with the same folder goes on where this one stopped.
    """
    if not stream.isStreaming:
        raise ValueError("write_available needs a streaming DataFrame")
    where = checkpoint or scratch_path(stream.sparkSession, "stream")
    query = (
        transform(stream)
        .writeStream.format(output_format)
        .option("checkpointLocation", where)
        .outputMode("append")
        .trigger(availableNow=True)
        .start(path)
    )
    finished = query.awaitTermination(timeout) if timeout else (query.awaitTermination() or True)
    if not finished:
        query.stop()
    return bool(finished)
