import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from prepflow.schema import GuardError, semantic_types
from prepflow.sources import jdbc
from prepflow.sources.files import (
    format_of,
    has_quoted_breaks,
    quote_parity_lines,
    read_any,
    read_csv,
    read_jsonl,
    read_parquet,
    remote_uri,
)
from prepflow.sources.infer import find_semantic_types, find_types, infer_types, semantic_profile_cast
from prepflow.sources.media import image_table, list_media_paths, parse_files, promote_header, text_lines
from prepflow.sources.sinks import write_remote, write_table

ORCHARDS = """Plot,Trees,Fruit,Harvest,Planted
Mill Bank,120,apple,5400,2011-04-02
Low Field,45,pear,1900,2015-11-20
Hill Top,300,cherry,2800,2009-03-14
River End,80,apple,4100,2018-10-05
Old Wall,15,quince,350,1998-05-30
North Row,210,plum,6000,2013-09-09
"""
PICKS = """Pick,Plot,Day,Weight,Sunny
7,Mill Bank,2024-09-01,12.5,true
8,Old Wall,2024-09-03,3.75,false
"""


def test_csv_types(spark, write_csv):
    df = read_csv(spark, write_csv("orchards.csv", ORCHARDS))
    assert df.dtypes == [
        ("Plot", "string"), ("Trees", "bigint"), ("Fruit", "string"), ("Harvest", "bigint"),
        ("Planted", "date"), ("Source_File", "string"),
    ]
    assert df.count() == 6 and df.first()["Source_File"] == "orchards.csv"
    picks = read_csv(spark, write_csv("picks.csv", PICKS), source_file=False)
    assert [t for _, t in picks.dtypes] == ["bigint", "string", "date", "double", "boolean"]


def test_broken_files_fail(spark, write_csv, tmp_path):
    """Ragged lines, other column orders and broken JSON lines are errors, not nulls."""
    ragged = write_csv("ragged.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_csv(spark, ragged, source_file=False, schema="a string, b string").collect()
    (tmp_path / "many").mkdir()
    write_csv("many/a.csv", "x,y\n1,2\n")
    write_csv("many/b.csv", "y,x\n3,4\n")
    with pytest.raises(Exception, match="header|HEADER"):
        read_csv(spark, str(tmp_path / "many/*.csv"), same_columns=True, infer=False, profile=False).collect()
    broken = write_csv("broken.jsonl", '{"a": 1}\n{"a": \n')
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_jsonl(spark, broken, "a bigint").collect()


def test_sampled_profile_loses_nothing(spark):
    """A first part that looks like money does not settle the type of the rest."""
    df = spark.createDataFrame([(1, "$5.00"), (2, "$6.00"), (3, "call us")], "i int, t string")
    out = semantic_profile_cast(df, sample_size=2, order_by=["i"])
    assert [r[1] for r in rows(out, "i")] == ["$5.00", "$6.00", "call us"]


def test_header_place_must_be_its_own(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["x", "y"]), (2, ["z", "w"])], "i int, c array<string>")
    with pytest.raises(ValueError, match="order by more"):
        promote_header(df, "c", ["i"])


def test_broken_image_fails(spark, tmp_path):
    (tmp_path / "bad.png").write_bytes(b"no image")
    with pytest.raises(Exception, match="no readable image|readable"):
        image_table(spark, str(tmp_path / "bad.png")).collect()


def test_csv_null_tokens_and_options(spark, write_csv):
    path = write_csv("tokens.csv", "a;b;c;d\n1;NA;x;null\n;2.5;NaN;\nnull;1;y;NA\n")
    df = read_csv(spark, path, delimiter=";", source_file=False)
    assert df.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string")]
    assert sorted(map(str, rows(df))) == sorted(
        ["(1, None, 'x', None)", "(None, 2.5, None, None)", "(None, 1.0, 'y', None)"]
    )
    bare = write_csv("bare.csv", "1,x\n2,y\n")
    assert read_csv(spark, bare, header=False, source_file=False).dtypes == [("_c0", "bigint"), ("_c1", "string")]
    latin = write_csv("latin.csv", "")
    with open(latin, "w", encoding="latin-1") as file:
        file.write("n\né\n")
    assert rows(read_csv(spark, latin, encoding="iso-8859-1", source_file=False)) == [("é",)]


def test_wildcard_stacks_different_files(spark, write_csv, tmp_path):
    write_csv("part_a.csv", "id,a\n1,x\n2,y\n")
    write_csv("part_b.csv", "b,id\n2.5,3\n")
    df = read_csv(spark, str(tmp_path / "part_?.csv"))
    assert set(df.columns) == {"id", "a", "b", "Source_File"}
    assert rows(df.select("id", "a", "b", "Source_File"), "id") == [
        (1, "x", None, "part_a.csv"), (2, "y", None, "part_a.csv"), (3, None, 2.5, "part_b.csv")
    ]
    with pytest.raises(FileNotFoundError):
        read_csv(spark, str(tmp_path / "none_*.csv"))


def test_infer_types(spark):
    df = spark.createDataFrame(
        [("1", "1", "true", "2024-01-02", "2024-01-02 03:04:05", "10D", "2020-01", None, "99999999999999999999", "1.5e3"),
         ("-2", "2.5", "False", "2024-1-3", "2024-01-02", "2", "2020-02", None, "1", ".5"),
         (None, "3.", None, None, "2024-01-02T03:04", "3", "x", None, None, "-7")],
        "i string, d string, b string, day string, at string, code string, month string, none string, big string, e string",
    )
    assert find_types(df) == {
        "i": "bigint", "d": "double", "b": "boolean", "day": "date", "at": "timestamp_ntz",
        "big": "double", "e": "double",
    }
    assert dict(infer_types(df, ["i"]).dtypes)["d"] == "string"
    zoned = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-13-45",)], "t string")
    assert find_types(zoned) == {}


def test_other_date_forms(spark):
    df = spark.createDataFrame(
        [("05/03/2024", "2024/03/05", "05-03-2024", "05/03/2024"), ("25/12/2024", "2024/12/25", "25-12-2024", "2024/12/25")],
        "dmy string, ymd string, dashed string, mixed string",
    )
    out = infer_types(df)
    assert [t for _, t in out.dtypes] == ["date", "date", "date", "string"]
    assert [str(v) for v in rows(out, "dmy")[1][:3]] == ["2024-12-25"] * 3


def test_quotes_spaces_breaks_and_microseconds(spark, write_csv, tmp_path):
    path = write_csv("q.csv", 'a,b\n"say ""hi"", now",1\n" x ",2\n')
    assert rows(read_csv(spark, path, source_file=False), "b") == [('say "hi", now', 1), (" x ", 2)]
    broken = write_csv("m.csv", 'a,b\n"one\ntwo",1\n')
    assert rows(read_csv(spark, broken, source_file=False, multi_line=True)) == [("one\ntwo", 1)]
    df = spark.createDataFrame(
        [(1, ' a "b", \\ c ', datetime(2024, 1, 2, 3, 4, 5, 678901)), (2, "", None), (3, None, None)],
        "i int, s string, t timestamp_ntz",
    )
    for kind in ("csv", "jsonl"):
        where = str(tmp_path / kind)
        write_table(df, where, kind)
        read = read_jsonl if kind == "jsonl" else read_csv
        options = {} if kind == "jsonl" else {"source_file": False}
        want = rows(df, "i")
        if kind == "csv":
            want[1] = (2, None, None)  # empty text is a null token
        assert rows(read(spark, where, schema=df.schema, **options), "i") == want
    tokens = write_csv("t.csv", "a,b\nNA,NA\n1,x\n")
    typed = read_csv(spark, tokens, schema="a bigint, b string", source_file=False)
    assert rows(typed, "a") == [(None, None), (1, "x")]


def test_semantic_profile(spark):
    df = spark.createDataFrame(
        [("$1,234.50", "7.5%", "150", "1500", " ", "-5", None),
         ("($12.00)", "-10 %", "7", "3", "", "-6", None),
         (None, "", "", "2", " ", "-7%", None)],
        "usd string, pct string, plain string, big string, blank string, minus string, none string",
    )
    assert find_semantic_types(df) == {"usd": "currency_usd", "pct": "percentage", "plain": "currency_usd"}
    out = semantic_profile_cast(df)
    assert semantic_types(out) == find_semantic_types(df)
    assert [r[:3] for r in rows(out)] == [(1234.5, 0.075, 150.0), (-12.0, -0.1, 7.0), (None, None, None)]
    first = find_semantic_types(df.withColumn("n", F.monotonically_increasing_id()), ["big"], 0)
    assert first == {}
    forced = semantic_profile_cast(df, kinds={"big": "currency_usd"})
    assert rows(forced.select("big")) == [(1500.0,), (3.0,), (2.0,)]
    assert semantic_profile_cast(spark.range(3)).columns == ["id"]


def test_semantic_sample(spark):
    df = spark.createDataFrame([(1, "$1"), (2, "$2"), (3, "n/a")], "i int, v string")
    assert find_semantic_types(df) == {}
    assert find_semantic_types(df, sample_size=2, order_by=["i"]) == {"v": "currency_usd"}


def test_formats(spark, write_csv):
    assert [format_of(p) for p in ("a.CSV", "b.xlsx", "c.pdf", "d.webp", "e.mov", "f.dat", "g.parquet", "h.jsonl")] == [
        "csv", "excel", "pdf", "image", "multimodal", "csv", "parquet", "json"
    ]
    path = write_csv("note.pdf", "x")
    assert rows(read_any(spark, path, process_local=False))[0][0].endswith("note.pdf")
    with pytest.raises(ValueError, match="parser"):
        read_any(spark, path)
    with pytest.raises(ValueError, match="unsupported"):
        read_any(spark, path, "tape")


def test_uris():
    assert remote_uri("gs://bucket/", "/a/b.csv") == "gs://bucket/a/b.csv"
    assert remote_uri("bucket", "x", scheme="s3a") == "s3a://bucket/x"
    for bucket, path in (("", "x"), ("b", " ")):
        with pytest.raises(ValueError):
            remote_uri(bucket, path)


@pytest.mark.parametrize("kind", ["csv", "parquet", "jsonl"])
def test_round_trips(spark, nulls, tmp_path, kind):
    path = str(tmp_path / "out")
    assert write_table(nulls, path, kind) is nulls
    back = {
        "csv": lambda: read_csv(spark, f"{path}/*.csv", schema=nulls.schema, source_file=False),
        "parquet": lambda: read_parquet(spark, path),
        "jsonl": lambda: read_jsonl(spark, path, nulls.schema),
    }[kind]()
    assert rows(back, "id") == rows(nulls, "id")
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_table(nulls, path, kind)


def test_sink_switch_and_errors(nulls, tmp_path):
    path = tmp_path / "off"
    assert write_table(nulls, str(path), enabled=False) is nulls and not path.exists()
    with pytest.raises(ValueError):
        write_table(nulls, str(path), "xlsx")
    with pytest.raises(RuntimeError, match="spark-avro"):
        write_table(nulls, str(path), "avro")
    with pytest.raises(ValueError):
        write_remote(nulls, "bucket", "x", "avro")


def test_tags_survive_parquet(spark, tmp_path):
    df = semantic_profile_cast(spark.createDataFrame([("$1.00",)], "v string"))
    write_table(df, str(tmp_path / "t"), "parquet")
    assert semantic_types(read_parquet(spark, str(tmp_path / "t"))) == {"v": "currency_usd"}


def test_query_guard():
    assert jdbc.check_query("SELECT 'drop; delete' AS updated_at FROM t WHERE \"insert\" = 1")
    for bad in ("SELECT 1; SELECT 2", "drop table t", "WITH x AS (DELETE FROM t) SELECT 1", "Update t SET a = 1"):
        with pytest.raises(GuardError):
            jdbc.check_query(bad)


def test_table_guard():
    assert jdbc.check_table("Sales_2024") == "Sales_2024"
    for bad in ("a.b", "x;y", "pg_stat_user", "SYS_x", "mysql", "information_schema", "sqlite_master"):
        with pytest.raises(GuardError):
            jdbc.check_table(bad)
    with pytest.raises(ValueError):
        jdbc.check_table("")
    with pytest.raises(GuardError):
        jdbc.check_table("internal_x", reserved=("internal",))


def test_jdbc_options_without_a_database():
    assert jdbc.read_options("jdbc:x", "SELECT 1") == {"url": "jdbc:x", "query": "SELECT 1"}
    split = jdbc.read_options("jdbc:x", "SELECT * FROM t", "id", (0, 100), 8, fetchsize="1000")
    assert split["dbtable"] == "(SELECT * FROM t) q" and split["numPartitions"] == "8"
    assert "query" not in split and split["fetchsize"] == "1000"
    with pytest.raises(ValueError):
        jdbc.read_options("jdbc:x", "SELECT 1", "id")
    with pytest.raises(ValueError):
        jdbc.read_options("", "SELECT 1")
    assert [jdbc.save_mode(m) for m in ("append", "FAIL", "replace_warning")] == ["append", "errorifexists", "overwrite"]
    with pytest.raises(ValueError):
        jdbc.save_mode("merge")


def test_text_lines(spark):
    df = spark.createDataFrame([(1, " a\r\n\n\tb \rc"), (2, None), (3, " ")], "id int, t string")
    assert rows(text_lines(df, "t", ["id"], "no"), "no") == [(1, 1, "a"), (1, 3, "b"), (1, 4, "c")]


def test_promote_header(spark):
    df = spark.createDataFrame(
        [(2, ["1", "x"]), (1, ["id", "", None, "last"]), (3, ["2", None, "y", "z", "more"]), (4, [])],
        "row_no int, cells array<string>",
    )
    out = promote_header(df, "cells", ["row_no"], keep=["row_no"])
    assert out.columns == ["row_no", "id", "Column_1", "Column_2", "last"]
    assert rows(out, "row_no") == [(2, "1", "x", "", ""), (3, "2", "", "y", "z"), (4, "", "", "", "")]
    named = promote_header(df, "cells", header=["a"])
    assert named.columns == ["a"] and named.count() == 4


def png(path, width: int, height: int) -> None:
    def chunk(kind: bytes, data: bytes) -> bytes:
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    lines = b"".join(b"\0" + b"\x80\x20\x10" * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")
    )


def test_images_and_media(spark, tmp_path):
    png(tmp_path / "one.png", 5, 3)
    png(tmp_path / "two.png", 2, 7)
    (tmp_path / "clip.mp4").write_bytes(b"not read")
    pattern = str(tmp_path / "*.png")
    table = image_table(spark, pattern)
    assert table.columns == ["ImagePath", "ResolvedPath", "Description", "Dimensions", "Format"]
    assert [(r[0], r[2], r[3], r[4]) for r in rows(table, "ImagePath")] == [
        ("one.png", None, "5x3", "PNG"), ("two.png", None, "2x7", "PNG")
    ]
    told = image_table(spark, pattern, lambda paths: [p[-7:-4].upper() for p in paths])
    assert [r["Description"] for r in told.orderBy("ImagePath").collect()] == ["ONE", "TWO"]
    media = list_media_paths(spark, str(tmp_path / "*"))
    assert sorted(r[0].rsplit("/", 1)[1] for r in media.collect()) == ["clip.mp4", "one.png", "two.png"]
    plan = media._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string>" in plan


def test_parse_files(spark, tmp_path):
    for name in ("a.txt", "b.txt"):
        (tmp_path / name).write_text(f"{name} 1\n{name} 2")

    def words(path: str, content: bytes) -> list[dict]:
        if path.endswith("b.txt") and b"bad" in content:
            raise ValueError("bad content")
        return [{"line": i, "text": t} for i, t in enumerate(content.decode().split("\n"))]

    out = parse_files(spark, str(tmp_path / "*.txt"), words, "line int, text string")
    assert rows(out, "Source_File", "line")[1] == (1, "a.txt 2", "a.txt")
    (tmp_path / "b.txt").write_text("bad")
    with pytest.raises(Exception, match="failed to read .*b.txt"):
        parse_files(spark, str(tmp_path / "*.txt"), words, "line int, text string").collect()


def test_quoted_breaks_across_many_splits(spark, tmp_path):
    """Records spanning lines and split edges are put together in parallel, as Python's csv module reads them."""
    import csv
    import io
    import random

    rng = random.Random(3)
    pieces = ["a", "b c", '"', "\n", ",", "x\ny", '""', "\r\n", "z"]
    records = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    buffer = io.StringIO()
    writer = csv.writer(buffer, lineterminator="\n")
    writer.writerow(["i", "s"])
    writer.writerows(records)
    path = tmp_path / "many.csv"
    path.write_text(buffer.getvalue(), encoding="utf-8")
    expected = sorted((int(i), s.replace("\r\n", "\n") or None) for i, s in list(csv.reader(io.StringIO(buffer.getvalue())))[1:])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        df = read_csv(spark, str(path), source_file=False)
        got = sorted((r.i, r.s) for r in df.collect())
        splits = quote_parity_lines(spark, str(path)).select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 5
    assert got == expected


def test_quoted_break_auto_and_plain(spark, write_csv):
    broken = write_csv("auto.csv", 'a,b\n"one\ntwo",1\n"three",2\n')
    assert rows(read_csv(spark, broken, source_file=True), "b") == [("one\ntwo", 1, "auto.csv"), ("three", 2, "auto.csv")]
    plain = write_csv("plain.csv", 'a,b\n"one",1\n')
    assert not has_quoted_breaks(spark, plain)
    wrong = write_csv("wrong.csv", 'a,b\n"one\ntwo",1,3\n')
    with pytest.raises(Exception):
        read_csv(spark, wrong, source_file=False).collect()
