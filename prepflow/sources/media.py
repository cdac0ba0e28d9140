"""Text lines, ragged tables, media, images, and files read by a caller's parser."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from prepflow.functions.cleanse import trim_space
from prepflow.operators.batches import describe_with
from prepflow.operators.ordering import OrderBy, order_columns, required_order
from prepflow.schema import col, cols, data_type, require_columns

LINE_BREAK = r"\r\n|\n|\r"
TEXT_LINE = "Text_Line"

Parser = Callable[[str, bytes], Iterable[dict]]


def text_lines(
    df: DataFrame, column: str, keep: Sequence[str] = (), line_number: str | None = None
) -> DataFrame:
    """One row per non-blank line of a text column, trimmed, beside the kept columns."""
    require_columns(df, [column, *keep], "text_lines")
    lines = F.split(col(column), LINE_BREAK)
    rows = df.select(*cols(keep), F.posexplode(lines).alias("__no", "__line"))
    text = trim_space(F.col("__line"))
    number = [(F.col("__no") + 1).alias(line_number)] if line_number else []
    return rows.select(*cols(keep), *number, text.alias(TEXT_LINE)).filter(F.col(TEXT_LINE) != "")


def promote_header(
    df: DataFrame,
    cells: str,
    order_by: OrderBy | None = None,
    header: Sequence[str] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Turn rows of an array of texts into a table named by the first row.

    Blank header cells become ``Column_<index>``; longer rows are cut, shorter
    ones filled with empty text.  The header is fetched as one row, or passed in,
    in which case all rows are data.
    """
    require_columns(df, [cells, *keep], "promote_header")
    rows = df
    if header is None:
        order = required_order(df, order_by, "promote_header")
        first = df.orderBy(*order_columns(order)).select(cells, F.struct(*(col(n) for n in order_field_names(order))).alias("at")).first()
        if first is None:
            return df.select(*cols(keep))
        header = first[cells]
        same = all_same(df, first["at"].asDict())
        if df.filter(same).limit(2).count() > 1:
            raise ValueError("promote_header: several rows share the first place in order_by; order by more columns")
        rows = df.filter(~same)
    names = [str(h).strip() if h and str(h).strip() else f"Column_{i}" for i, h in enumerate(header)]
    cell = [
        F.coalesce(F.try_element_at(col(cells), F.lit(i + 1)), F.lit("")).alias(n)
        for i, n in enumerate(names)
    ]
    return rows.select(*cols(keep), *cell)


def order_field_names(order: list) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order]


def all_same(df: DataFrame, values: dict):
    condition = F.lit(True)
    for name, value in values.items():
        condition = condition & col(name).eqNullSafe(F.lit(value).cast(data_type(df, name)))
    return condition


def list_media_paths(spark: SparkSession, path: str) -> DataFrame:
    """Paths of the matching files; their contents are not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("FilePath"))


def parse_files(
    spark: SparkSession, path: str, parser: Parser, schema: T.StructType | str
) -> DataFrame:
    """Rows that ``parser(path, content)`` gives for each file, with ``Source_File``.

    Files are spread over tasks.  A parser failure fails the job and names the file.
    """
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    full = T.StructType([*schema.fields, T.StructField("Source_File", T.StringType())])
    names = schema.fieldNames()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"]):
                try:
                    rows = list(parser(file, bytes(content)))
                except Exception as bad:
                    raise RuntimeError(f"failed to read {file}: {bad}") from bad
                table = pd.DataFrame(rows, columns=names)
                table["Source_File"] = file.rsplit("/", 1)[-1]
                yield table

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, full)


def image_table(
    spark: SparkSession,
    path: str,
    captioner: Callable[[list[str]], Sequence[str]] | None = None,
) -> DataFrame:
    """Path, size and format of every image; ``captioner`` describes batches of paths.

    A file that is no image fails the job and is named.
    """
    images = spark.read.format("image").load(path).select("image.*")
    broken = F.raise_error(F.concat(F.lit("no readable image: "), F.col("origin"))).cast("int")
    images = images.withColumn("width", F.when(F.col("width") > 0, F.col("width")).otherwise(broken))
    extension = F.upper(F.element_at(F.split("origin", r"\."), -1))
    table = images.select(
        F.element_at(F.split("origin", "/"), -1).alias("ImagePath"),
        F.col("origin").alias("ResolvedPath"),
        F.concat_ws("x", "width", "height").alias("Dimensions"),
        F.when(extension == "JPG", "JPEG").when(extension == "TIF", "TIFF").otherwise(extension).alias("Format"),
    )
    if captioner is None:
        described = table.withColumn("Description", F.lit(None).cast("string"))
    else:
        described = describe_with(
            table.withColumn("__path", F.col("ResolvedPath")), captioner, "__path", "Description"
        )
    return described.select("ImagePath", "ResolvedPath", "Description", "Dimensions", "Format")
