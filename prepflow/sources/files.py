"""Reading delimited, Parquet and JSON-lines files, locally or by any Hadoop URI."""

from __future__ import annotations

import posixpath
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from prepflow.operators.stack import union_tables
from prepflow.schema import col, cols
from prepflow.sources.infer import infer_types, null_tokens, semantic_profile_cast

SOURCE_FILE = "Source_File"

# What a file extension is read as.
FORMAT_OF = {
    ".csv": "csv",
    ".parquet": "parquet",
    ".json": "json",
    ".jsonl": "json",
    ".xls": "excel",
    ".xlsx": "excel",
    ".xlsm": "excel",
    ".xlsb": "excel",
    ".ods": "excel",
    ".pdf": "pdf",
    ".png": "image",
    ".jpg": "image",
    ".jpeg": "image",
    ".tiff": "image",
    ".bmp": "image",
    ".gif": "image",
    ".webp": "image",
    ".mp3": "multimodal",
    ".wav": "multimodal",
    ".m4a": "multimodal",
    ".mp4": "multimodal",
    ".mov": "multimodal",
    ".avi": "multimodal",
    ".mkv": "multimodal",
    ".webm": "multimodal",
}
HEADER_READERS = 16


def format_of(path: str) -> str:
    """Format by extension; unknown extensions are read as delimited text."""
    return FORMAT_OF.get(posixpath.splitext(path)[1].lower(), "csv")


def is_wildcard(path: str) -> bool:
    return "*" in path or "?" in path


def remote_uri(bucket: str, path: str, scheme: str = "gs") -> str:
    """URI of an object; a scheme written into the bucket by mistake is dropped."""
    bucket = bucket.strip().removeprefix(f"{scheme}://").strip("/")
    path = path.strip().lstrip("/")
    if not bucket or not path:
        raise ValueError("bucket and path are both needed")
    return f"{scheme}://{bucket}/{path}"


def matching_files(spark: SparkSession, pattern: str) -> list[str]:
    """Files a path or wildcard stands for, from the file system's own listing."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(pattern)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = system.globStatus(path) or []
    names = sorted(status.getPath().toString() for status in found)
    if not names:
        raise FileNotFoundError(f"no file matches {pattern}")
    return names


def read_parquet(spark: SparkSession, path: str, source_file: bool = False) -> DataFrame:
    return with_source_file(spark.read.parquet(path)) if source_file else spark.read.parquet(path)


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """One JSON object per line; a schema saves the pass that infers it.  A line that is no object fails the read."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.option("mode", "FAILFAST").json(path)


def with_source_file(df: DataFrame) -> DataFrame:
    return df.select(
        *cols(c for c in df.columns if c != SOURCE_FILE),
        F.col("_metadata.file_name").alias(SOURCE_FILE),
    )


def csv_text(
    spark: SparkSession,
    paths: str | Sequence[str],
    delimiter: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    reader = spark.read.options(
        sep=delimiter,
        header=header,
        encoding=encoding,
        inferSchema=False,
        multiLine=multi_line,
        mode="FAILFAST",
        enforceSchema=schema is not None,
        quote='"',
        escape='"',
    )
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(list(paths) if not isinstance(paths, str) else paths)


def quote_parity_lines(spark: SparkSession, paths: str | Sequence[str], quote: str = '"') -> DataFrame:
    """Lines of text files with their place and the parity of quotes before them in their split.

    Columns: file, block (start of the split), at (order within the split), line, odd (1 if the line holds an odd
    number of quotes), pre (parity of quotes in the split's earlier lines), c0 and c1 (lines up to this one whose
    ``pre`` is 0 or 1), last (no later line in the split). One window per split, so splits are worked on in parallel.
    """
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("at"),
        F.col("value").alias("line"),
    )
    odd = ((F.length("line") - F.length(F.regexp_replace("line", quote, ""))) % 2).cast("int")
    split = Window.partitionBy("file", "block").orderBy("at")
    before = split.rowsBetween(Window.unboundedPreceding, -1)
    upto = split.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pre = (F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2).cast("int")
    return (
        lines.withColumn("odd", odd)
        .withColumn("pre", pre)
        .withColumn("c0", F.sum((F.col("pre") == 0).cast("long")).over(upto))
        .withColumn("c1", F.sum((F.col("pre") == 1).cast("long")).over(upto))
        .withColumn("next_pre", F.lead("pre").over(split))
    )


def csv_records(spark: SparkSession, paths: str | Sequence[str], quote: str = '"') -> DataFrame:
    """One row per delimited record (file, number, record), quoted line breaks included, read in parallel.

    A line starts a record when the quotes before it in its file are even in number. That parity is known per split
    from one window over the split; the splits' own parities and counts of record starts (one row per split) are
    summed over the earlier splits of the file by a window over that small table. Lines that are whole records pass
    as they are; only the lines of records that span lines are grouped and joined again. A quoted break comes back as
    a line feed, also where the file had a carriage return before it.
    """
    lines = quote_parity_lines(spark, paths, quote)
    blocks = lines.groupBy("file", "block").agg(
        (F.sum("odd") % 2).cast("int").alias("parity"),
        F.count(F.when(F.col("pre") == 0, 1)).alias("s0"),
        F.count(F.lit(1)).alias("n"),
    )
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    entry = (F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2).cast("int")
    blocks = blocks.withColumn("entry", entry).withColumn(
        "starts", F.when(F.col("entry") == 0, F.col("s0")).otherwise(F.col("n") - F.col("s0"))
    ).select(
        "file",
        "block",
        "entry",
        "parity",
        F.coalesce(F.sum("starts").over(earlier), F.lit(0)).alias("offset"),
        F.lead("block").over(order).isNull().alias("final"),
    )
    placed = lines.join(blocks, ["file", "block"])
    start = F.col("pre") == F.col("entry")
    next_start = F.when(
        F.col("next_pre").isNotNull(), F.col("next_pre") == F.col("entry")
    ).otherwise(F.col("final") | ((F.col("entry") + F.col("parity")) % 2 == 0))
    number = F.col("offset") + F.when(F.col("entry") == 0, F.col("c0")).otherwise(F.col("c1")) - 1
    placed = placed.select("file", "at", "line", start.alias("start"), next_start.alias("next_start"), number.alias("number"))
    whole = placed.filter("start AND next_start").select("file", "number", F.col("line").alias("record"))
    pieces = (
        placed.filter("NOT (start AND next_start)")
        .groupBy("file", "number")
        .agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("parts"))
        .select("file", "number", F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias("record"))
    )
    return whole.unionByName(pieces)


def has_quoted_breaks(spark: SparkSession, paths: str | Sequence[str], quote: str = '"') -> bool:
    """Does any line hold an odd number of quotes? One aggregation over the text."""
    lines = spark.read.text(list(paths) if not isinstance(paths, str) else paths)
    odd = (F.length("value") - F.length(F.regexp_replace("value", quote, ""))) % 2
    return lines.filter(odd == 1).limit(1).count() > 0


def csv_by_records(
    spark: SparkSession, paths: str | Sequence[str], delimiter: str, header: bool, names: list[str]
) -> DataFrame:
    """Cells of every record as text, by ``from_csv``; a record with the wrong number of cells fails the read."""
    records = csv_records(spark, paths)
    if header:
        records = records.filter(F.col("number") > 0)
    schema = ", ".join(f"`_c{i}` string" for i in range(len(names)))
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "FAILFAST"}
    cells = F.from_csv(F.col("record"), schema, options)
    table = records.select(F.col("file"), cells.alias("cells"))
    return table.select(
        *[F.col(f"cells._c{i}").alias(name) for i, name in enumerate(names)],
        F.regexp_extract("file", r"([^/]*)$", 1).alias("__file_name"),
    )


def read_csv(
    spark: SparkSession,
    path: str,
    delimiter: str = ",",
    header: bool = True,
    encoding: str = "utf-8",
    schema: T.StructType | str | None = None,
    infer: bool = True,
    profile: bool = True,
    source_file: bool = True,
    same_columns: bool = False,
    multi_line: bool | None = None,
) -> DataFrame:
    """Read delimited text.

    Without a ``schema`` all columns are read as text, null tokens become null,
    and types are found by one aggregation over the whole input, so a late odd
    value widens a column instead of failing the read.  ``profile`` then turns
    currency and percentage columns into numbers.

    A wildcard may match files with different columns: files are grouped by their
    header line and stacked by name.  ``same_columns`` states that all files
    share one header and skips looking at each; another header then fails the
    read, and so does a line with too many or too few cells.  With a ``schema``,
    cells are cast as Spark casts them, so that a bad one fails under ANSI mode.

    Quoted line breaks are found by the parity of quotes (``multi_line=None``, the default: one look for a line with
    an odd number of quotes). Where there are some, records are put together from lines in parallel
    (``csv_records``: a window per file split, one row per split summed over earlier splits), never a file in one
    task; without any, Spark reads lines. ``multi_line=False`` skips the look (a quoted break then fails the read),
    ``True`` skips it the other way. Encodings other than UTF-8 leave quoted breaks to Spark's reader, one task a file.
    """
    utf8 = encoding.lower().replace("-", "").replace("_", "") == "utf8"
    paths = matching_files(spark, path)
    if multi_line is None:
        multi_line = utf8 and has_quoted_breaks(spark, paths)

    def delimited(group: list[str], text: T.StructType | None = None) -> DataFrame:
        if multi_line and utf8:
            names = [f.name for f in text.fields] if text else csv_text(spark, group[0], delimiter, header, encoding).columns
            df = csv_by_records(spark, group, delimiter, header, names)
            return df.withColumnRenamed("__file_name", SOURCE_FILE) if source_file else df.drop("__file_name")
        df = csv_text(spark, group, delimiter, header, encoding, text, bool(multi_line))
        return with_source_file(df) if source_file else df

    if schema is not None:
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in fields])
        df = null_tokens(delimited(paths, text))
        return df.withColumns({f.name: col(f.name).cast(f.dataType) for f in fields})
    if header and not same_columns and len(paths) > 1:
        groups = files_by_header(spark, paths, delimiter, encoding)
    else:
        groups = [paths]
    df = null_tokens(union_tables([delimited(group) for group in groups]))
    read = [c for c in df.columns if c != SOURCE_FILE]
    if infer:
        df = infer_types(df, read)
    if profile:
        df = semantic_profile_cast(df, read)
    return df


def files_by_header(
    spark: SparkSession, paths: list[str], delimiter: str, encoding: str
) -> list[list[str]]:
    """Group files by their columns; Spark only reads the first line of each for that."""

    def header_of(path: str) -> tuple[str, ...]:
        return tuple(csv_text(spark, path, delimiter, True, encoding).columns)

    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(header_of, paths))
    groups: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path, columns in zip(paths, headers):
        groups[columns].append(path)
    return list(groups.values())


def read_any(
    spark: SparkSession,
    path: str,
    file_type: str = "auto",
    process_local: bool = True,
    **options,
) -> DataFrame:
    """Read a path by its extension or by a named type.

    Media files give a table of their paths; so do images and PDFs when
    ``process_local`` is off.  Spreadsheets and PDFs need a caller's parser, see
    ``media.parse_files``.
    """
    from prepflow.sources.media import image_table, list_media_paths

    kind = format_of(path) if file_type == "auto" else file_type.lower()
    if not process_local and kind in ("image", "pdf"):
        kind = "multimodal"
    if kind == "csv":
        return read_csv(spark, path, **options)
    if kind == "parquet":
        return read_parquet(spark, path, source_file=True)
    if kind == "json":
        return read_jsonl(spark, path, **options)
    if kind == "multimodal":
        return list_media_paths(spark, path)
    if kind == "image":
        return image_table(spark, path)
    if kind in ("excel", "pdf"):
        raise ValueError(f"{kind} files need a parser; use parse_files(spark, path, parser, schema)")
    raise ValueError(f"unsupported file type {kind!r}")


def read_remote(
    spark: SparkSession,
    bucket: str,
    path: str,
    file_format: str = "csv",
    scheme: str = "gs",
    **options,
) -> DataFrame:
    """Read csv, parquet or json (lines) from object storage."""
    uri = remote_uri(bucket, path, scheme)
    readers = {"csv": read_csv, "parquet": read_parquet, "json": read_jsonl}
    if file_format not in readers:
        raise ValueError(f"unsupported format {file_format!r}; use one of {sorted(readers)}")
    if file_format == "csv":
        options = {"source_file": False, "profile": False} | options
    return readers[file_format](spark, uri, **options)
