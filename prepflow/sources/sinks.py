"""Writing tables; a sink hands its input on."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame

from prepflow.sources.files import remote_uri

# Output words and the Spark format each stands for.
WRITERS = {"csv": "csv", "parquet": "parquet", "jsonl": "json", "json": "json", "avro": "avro"}


# Texts keep their spaces and moments their microseconds; quotes are doubled.
FAITHFUL = {
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def write_table(
    df: DataFrame,
    path: str,
    output_format: str = "csv",
    mode: str = "errorifexists",
    enabled: bool = True,
    **options,
) -> DataFrame:
    """Write ``df`` and return it; with ``enabled=False`` nothing is written.

    Every format is written as a folder with one file per task.
    """
    if not enabled:
        return df
    if output_format not in WRITERS:
        raise ValueError(f"unsupported format {output_format!r}; use one of {sorted(WRITERS)}")
    if WRITERS[output_format] in ("csv", "json"):
        options = FAITHFUL | options
    if output_format == "csv":
        options = {"header": True} | options
    writer = df.write.format(WRITERS[output_format]).mode(mode).options(**options)
    try:
        writer.save(path)
    except AnalysisException as bad:
        if output_format == "avro" and "avro" in str(bad).lower():
            raise RuntimeError("writing avro needs the spark-avro package on the class path") from bad
        raise
    return df


def write_remote(
    df: DataFrame,
    bucket: str,
    path: str,
    file_format: str = "csv",
    mode: str = "errorifexists",
    scheme: str = "gs",
) -> DataFrame:
    """Write csv, parquet or json (lines) to object storage."""
    if file_format not in ("csv", "parquet", "json"):
        raise ValueError(f"unsupported format {file_format!r}")
    return write_table(df, remote_uri(bucket, path, scheme), file_format, mode)
