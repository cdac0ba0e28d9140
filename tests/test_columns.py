import pytest

from prepflow.functions.cleanse import cleanse
from prepflow.functions.datetimes import CUSTOM, FORMAT, convert_datetime, java_format
from prepflow.functions.expressions import formula_sql
from prepflow.operators.columns import formula, prompt_text, regex_extract, select_columns
from prepflow.schema import GuardError, SchemaError


def one(df, column):
    return [r[column] for r in df.collect()]


def test_select_orders_renames_casts_and_skips(nulls):
    df = select_columns(
        nulls,
        [
            {"name": "s", "order_index": 2},
            {"name": "x", "rename": "number", "type": "Float64", "order_index": 1},
            {"name": "gone"},
            {"name": "d", "keep": False},
            {"name": "id"},
        ],
    )
    assert df.dtypes == [("number", "double"), ("s", "string"), ("id", "bigint")]


def test_select_nothing(nulls):
    assert select_columns(nulls, []) is nulls
    empty = select_columns(nulls, [{"name": "id", "keep": False}])
    assert empty.columns == [] and empty.count() == 8


def test_text_casts_give_null(spark):
    df = spark.createDataFrame(
        [("12",), ("12.7",), ("12abc",), ("1e3",), ("yes",), (None,), ("99999999999999999999",)], "t string"
    )
    out = select_columns(df, [{"name": "t", "type": "int", "rename": "i"}])
    assert one(out, "i") == [12, None, None, None, None, None, None]
    out = select_columns(df, [{"name": "t", "type": "numerical", "rename": "f"}])
    assert one(out, "f") == [12.0, 12.7, None, 1000.0, None, None, 1e20]
    out = select_columns(df, [{"name": "t", "type": "bool", "rename": "b"}])
    assert one(out, "b") == [None, None, None, None, True, None, None]
    out = select_columns(df, [{"name": "t", "type": "whatever", "rename": "b"}])
    assert out.dtypes == [("b", "string")]


def test_formula(spark):
    df = spark.createDataFrame([("Ann", "Lee", 7, None), ("Bo", None, 2, 1)], "Name string, Sur string, N int, M int")
    assert one(formula(df, "F", "[N] * 1.5 + 1"), "F") == [11.5, 4.0]
    assert one(formula(df, "F", '[Name] + " " + [Sur]'), "F") == ["Ann Lee", None]
    assert one(formula(df, "F", "[Name] + [Name]"), "F") == ["AnnAnn", "BoBo"]
    assert one(formula(df, "F", "upper([Name]) + ToString([N] + 1)"), "F") == ["ANN8", "BO3"]
    assert one(formula(df, "F", "length([Name]) + [N]"), "F") == [10, 4]
    assert one(formula(df, "F", "IIF([M] > 0 OR [N] > 100, 'y', 'n')"), "F") == ["n", "y"]
    assert one(formula(df, "F", "IF([N] > 5, [N] + 1, [N] - 1)"), "F") == [8, 1]
    assert one(formula(df, "N", "[N] % 2 == 1"), "N") == [True, False]
    assert one(formula(df, "F", "ToNumber('12.5')"), "F") == [12.5, 12.5]
    assert one(formula(df, "F", "'[N] AND ' + [Name]"), "F") == ["[N] AND Ann", "[N] AND Bo"]
    assert sorted(one(formula(df, "F", "sum([N]) OVER (ORDER BY [N])"), "F")) == [2, 9]
    assert formula(df, "F", "") is df and formula(df, "", "1") is df


def test_formula_errors(spark):
    df = spark.createDataFrame([("x", 1)], "s string, n int")
    with pytest.raises(GuardError):
        formula(df, "F", "reflect('java.lang.System', 'exit', 0)")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        formula(df, "F", "ToNumber([s])").collect()
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        formula(df, "F", "[n] +")


def test_formula_text_rules(spark):
    schema = spark.createDataFrame([("x", 1)], "s string, n int").schema
    assert "||" in formula_sql("[n] + 'a'", schema)
    assert "||" not in formula_sql("[n] + [n]", schema)
    assert "||" not in formula_sql("[n] + length([s])", schema)
    assert formula_sql("([s] + 'a') + [s]", schema).count("||") == 2


def test_regex_extract(spark):
    df = spark.createDataFrame([("ab-12",), ("no",), (None,), ("cd-x",)], "t string")
    out = regex_extract(
        df, "t", r"(?P<left_side>[a-z]+)-(\w+)", [{"name": ""}, {"name": "n", "type": "Int64"}, ]
    )
    assert out.columns == ["t", "n"] and one(out, "n") == [12, None, None, None]
    out = regex_extract(df, "t", r"([a-z]+)-(\d+)?", [{"name": "a"}, {"name": "b"}], empty_is_null=True)
    assert one(out, "a") == ["ab", None, None, "cd"]
    assert one(out, "b") == ["12", None, None, None]
    assert regex_extract(df, "t", "", [{"name": "a"}]) is df
    with pytest.raises(SchemaError):
        regex_extract(df, "gone", "x", [{"name": "a"}])


def test_patterns_in_other_notations(spark):
    df = spark.createDataFrame([("é1 (x)",), ("Ab 2",)], "t string")

    def got(pattern):
        return one(regex_extract(df, "t", pattern, [{"name": "o"}]), "o")

    assert got(r"^(\w+)") == ["é1", "Ab"]
    assert got(r"([[:alpha:]]+)") == ["x", "Ab"]
    assert got(r"(?<!A)(?P<q>[a-z])") == ["x", None]
    assert got(r"\((?<in_side>.)\)") == ["x", None]


def test_cleanse_text_steps(spark):
    df = spark.createDataFrame([(1, "\t Olá_mundo, 12!\n "), (2, None), (3, "e.g. you're ß")], "id int, s string")

    def clean(**options):
        return one(cleanse(df, ["s", "gone"], **options), "s")

    assert clean(replace_nulls_string=True)[1] == ""
    assert clean(trim_whitespace=True) == ["Olá_mundo, 12!", None, "e.g. you're ß"]
    assert clean(trim_whitespace=True, remove_punctuation=True)[0] == "Olá_mundo 12"
    assert clean(remove_numbers=True)[0] == "\t Olá_mundo, !\n "
    assert clean(remove_letters=True)[0] == "\t á_, 12!\n "
    assert clean(string_case="Uppercase")[2] == "E.G. YOU'RE SS"
    assert clean(string_case="Lowercase")[0] == "\t olá_mundo, 12!\n "
    assert clean(string_case="Titlecase")[2] == "E.G. You'Re SS"
    assert cleanse(df, []) is df


def test_cleanse_numbers(nulls):
    out = cleanse(nulls, ["x", "d", "s"], replace_nulls_numeric=True)
    assert out.dtypes == nulls.dtypes
    assert one(out, "x") == [5, 0, 7, 0, 0, 9, 1, 5]
    assert one(out, "d")[3] == 0.0 and one(out, "s")[1] is None


PRESET_TEXTS = {
    "yyyy-MM-dd": ("2024-03-05", "2024-03-05 00:00:00"),
    "yyyy/MM/dd": ("2024/03/05", "2024-03-05 00:00:00"),
    "dd-MM-yyyy": ("05-03-2024", "2024-03-05 00:00:00"),
    "dd/MM/yyyy": ("05/03/2024", "2024-03-05 00:00:00"),
    "HH:mm:ss": ("06:07:08", "1970-01-01 06:07:08"),
    "yyyy-MM-dd HH:mm:ss": ("2024-03-05 06:07:08", "2024-03-05 06:07:08"),
    "dd/MM/yyyy HH:mm:ss": ("05/03/2024 06:07:08", "2024-03-05 06:07:08"),
}


@pytest.mark.parametrize("preset", PRESET_TEXTS)
def test_date_presets(spark, preset):
    text, stamp = PRESET_TEXTS[preset]
    df = spark.createDataFrame([(text,), ("bad",), (None,), ("2024-13-45",)], "t string")
    out = convert_datetime(df, "t", format=preset, output_column="at")
    assert out.dtypes[1] == ("at", "timestamp_ntz")
    assert [str(v) if v else None for v in one(out, "at")] == [stamp, None, None, None]
    back = convert_datetime(out, "at", FORMAT, preset)
    assert one(back, "at")[0] == text


def test_custom_and_automatic_dates(spark):
    df = spark.createDataFrame(
        [("Mar 05, 2024 06 PM",), ("2024-03-05T01:02:03.5",), ("05/03/2024",), ("2024/03/05 01:02",), ("x",)], "t string"
    )
    custom = convert_datetime(df, "t", format=CUSTOM, custom_format="%b %d, %Y %I %p")
    assert str(one(custom, "t")[0]) == "2024-03-05 18:00:00" and one(custom, "t")[1] is None
    auto = [str(v) for v in one(convert_datetime(df, "t"), "t")]
    assert auto == ["None", "2024-03-05 01:02:03.500000", "2024-03-05 00:00:00", "2024-03-05 01:02:00", "None"]
    days = spark.createDataFrame([("05/03/2024",), ("25/12/2024",), (None,)], "t string")
    whole = convert_datetime(days, "t", whole_column=True)
    assert [str(v) for v in one(whole, "t")] == ["2024-03-05 00:00:00", "2024-12-25 00:00:00", "None"]
    assert one(convert_datetime(df, "t", whole_column=True), "t") == [None] * 5


def test_date_edges(spark, nulls):
    assert java_format("%d.%m.%Y at %H") == "dd.MM.yyyy 'at' HH"
    with pytest.raises(ValueError, match="not supported"):
        java_format("%Q")
    assert convert_datetime(nulls) is nulls
    assert one(convert_datetime(nulls, "x", FORMAT), "x")[0] == "5"
    with pytest.raises(SchemaError):
        convert_datetime(nulls, "gone")


def test_prompt(nulls):
    out = prompt_text(nulls, "s", "<{Input}|{s}|{other}>")
    assert one(out, "Prompt")[:2] == ["<x|x|{other}>", "<None|None|{other}>"]
    assert prompt_text(nulls, "gone") is nulls
