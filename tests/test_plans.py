"""Graphs, user functions, caching, streams and the registered queries."""

import importlib.util
import os
import re

import pytest

import __spark_entry__ as entry
from conftest import rows
from prepflow import catalog
from prepflow.catalog.inspection import stateless_steps
from prepflow.operators.batches import map_batches, map_model, python_transform
from prepflow.plans.graph import cache_table, pick_port, run_graph
from prepflow.plans.registry import OPERATORS, Operator, find_operator, register
from prepflow.schema import semantic_types, tag
from prepflow.session import drop_scratch, scratch_path, scratch_root
from prepflow.streaming.stateless import write_available
from test_sources import ORCHARDS
from tools.check_oracle import duck, rows_of


def orchard_graph(path: str) -> dict:
    """The larger plots by harvest, best first, under other names; the last node lacks its order."""
    return {
        "nodes": [
            {"id": "plots", "type": "fileInput", "parameters": {"filePath": path, "fileType": "csv"}},
            {"id": "large", "type": "filter", "parameters": {"column": "Trees", "operator": ">=", "value": "80"}},
            {"id": "each", "type": "formula",
             "parameters": {"output_column": "PerTree", "expression": "[Harvest] / [Trees]"}},
            {"id": "best", "type": "sort", "parameters": {"rules": [{"column": "Harvest", "order": "desc"}]}},
            {"id": "short", "type": "select", "parameters": {"columns": [
                {"name": "Harvest", "rename": "Kilos"}, {"name": "Plot", "rename": "Where"},
                {"name": "PerTree", "rename": "Ratio"}]}},
            {"id": "top", "type": "sampling", "parameters": {"n_records": 2, "sample_type": "first"}},
            {"id": "numbered", "type": "record_id", "parameters": {"start_value": 10, "unique_order": True,
                                                                  "order_by": ["Where"]}},
            {"id": "unordered", "type": "record_id"},
        ],
        "edges": [
            {"source": "plots", "target": "large"}, {"source": "large", "target": "each"},
            {"source": "each", "target": "best"}, {"source": "best", "target": "short"},
            {"source": "short", "target": "top"}, {"source": "top", "target": "numbered"},
            {"source": "top", "target": "unordered"},
        ],
    }


def test_orchard_graph(spark, write_csv):
    done = run_graph(spark, orchard_graph(write_csv("orchards.csv", ORCHARDS)))
    assert [r[1] for r in rows(done.table("short"))] == ["North Row", "Mill Bank", "River End", "Hill Top"]
    assert done.table("short").columns == ["Kilos", "Where", "Ratio"]
    assert {r["Plot"] for r in done.table("large", "false").collect()} == {"Low Field", "Old Wall"}
    # The order of the sort is inherited through select, also under its new name.
    assert [r[1] for r in rows(done.table("top"))] == ["North Row", "Mill Bank"]
    assert [(r[0], r[2]) for r in rows(done.table("numbered"), "RecordID")] == [(10, "Mill Bank"), (11, "North Row")]
    assert "order_by" in done.errors["unordered"]


def test_graph_refuses_unknown_parameters(spark, write_csv):
    path = write_csv("orchards.csv", ORCHARDS)
    spec = {"nodes": [{"id": "in", "type": "fileInput", "parameters": {"filePath": path, "speed": 3}}], "edges": []}
    assert "speed" in run_graph(spark, spec).errors["in"]


def test_graph_errors_stay_local(spark, write_csv):
    path = write_csv("orchards.csv", ORCHARDS)
    spec = {
        "nodes": [
            {"id": "in", "type": "fileInput", "parameters": {"filePath": path}},
            {"id": "bad", "type": "filter", "parameters": {"column": "Nope", "value": "1"}},
            {"id": "after", "type": "browse"},
            {"id": "odd", "type": "teleport"},
            {"id": "good", "type": "browse"},
            {"id": "alone", "type": "sort"},
        ],
        "edges": [{"source": "in", "target": "bad"}, {"source": "bad", "target": "after"},
                  {"source": "in", "target": "odd"}, {"source": "in", "target": "good"}],
    }
    done = run_graph(spark, spec)
    assert set(done.errors) == {"bad", "after", "odd", "alone"}
    assert "upstream node bad" in done.errors["after"] and "unknown node type" in done.errors["odd"]
    assert done.table("good").count() == 6
    with pytest.raises(RuntimeError, match="node bad"):
        done.table("bad")
    assert run_graph(spark, {}).tables == {}
    with pytest.raises(ValueError, match="cycle"):
        run_graph(spark, {"nodes": [{"id": "a", "type": "browse"}, {"id": "b", "type": "browse"}],
                          "edges": [{"source": "a", "target": "b"}, {"source": "b", "target": "a"}]})


def test_graph_containers_unions_and_joins(spark, write_csv):
    path = write_csv("orchards.csv", ORCHARDS)
    spec = {
        "nodes": [
            {"id": "off", "type": "container", "data": {"enabled": False}},
            {"id": "inner", "type": "container", "parentId": "off", "data": {"enabled": True}},
            {"id": "in", "type": "fileInput", "parameters": {"filePath": path}},
            {"id": "hidden", "type": "browse", "parentId": "inner"},
            {"id": "f", "type": "filter", "parameters": {"filterType": "custom", "customExpression": '[Fruit] = "apple"'}},
            {"id": "u", "type": "union"},
            {"id": "j", "type": "join", "parameters": {"left_on": ["Plot"], "right_on": ["Plot"], "how": "semi"}},
            {"id": "s", "type": "summarize", "parameters": {"group_by": "Fruit", "agg_column": "Harvest"}},
            {"id": "c", "type": "visualization", "parameters": {"chartType": "bar", "xAxis": "Fruit", "yAxis": "Harvest"}},
        ],
        "edges": [
            {"source": "in", "target": "hidden"}, {"source": "in", "target": "f"},
            {"source": "f", "target": "u"}, {"source": "in", "target": "u"},
            {"source": "in", "target": "j", "targetPort": "left"},
            {"source": "f", "target": "j", "targetPort": "right", "sourcePort": "false"},
            {"source": "u", "target": "s"}, {"source": "in", "target": "c"},
        ],
    }
    done = run_graph(spark, spec)
    assert not done.errors and "hidden" not in done.tables
    assert done.table("u").count() == 8 and done.table("j").count() == 4
    assert dict(rows(done.table("s")))["apple"] == 2 * (5400 + 4100)
    assert dict(rows(done.table("c")))["plum"] == 6000


def test_graph_passes_tags_on(spark, nulls):
    register("tagged_input", lambda s, i, p: tag(nulls, {"x": "currency_usd"}), needs_input=False)
    spec = {
        "nodes": [
            {"id": "t", "type": "tagged_input"},
            {"id": "sum", "type": "summarize", "parameters": {"actions": [
                {"column": "g", "action": "group_by"}, {"column": "x", "action": "max", "output": "x"}]}, },
            {"id": "pic", "type": "visualization",
             "parameters": {"chartType": "scatter", "xAxis": "id", "yAxis": "x"}},
        ],
        "edges": [{"source": "t", "target": "sum"}, {"source": "t", "target": "pic"}],
    }
    done = run_graph(spark, spec)
    assert semantic_types(done.table("sum")) == {"x": "currency_usd"}
    assert done.table("pic").schema["x"].metadata["format"] == "$,.2f"
    del OPERATORS["tagged_input"]


def test_registry(nulls):
    assert all(isinstance(o, Operator) for o in OPERATORS.values()) and len(OPERATORS) == 27
    assert find_operator("gemini_ai") is OPERATORS["map_model"]
    mock = nulls.selectExpr("g AS test_col_1", "x AS test_col_2")
    quiet = ["filter", "sort", "select", "formula", "regex", "data_cleansing", "datetime", "browse", "summarize",
             "pivot", "unpivot", "union", "chunk_rows", "map_model", "python_code", "fileOutput"]
    for name in quiet:
        operator = OPERATORS[name]
        params = operator.defaults | ({"model": len} if name == "map_model" else {})
        made = operator.run(mock.sparkSession, {"input": mock}, params)
        ports = made if isinstance(made, dict) else {"output": made}
        assert pick_port(ports, "output").count() > 0, name


def test_python_functions(spark, nulls):
    assert python_transform(nulls) is nulls
    assert python_transform(nulls, lambda df: None) is nulls
    assert python_transform(None, lambda df: spark.range(3)).count() == 3
    with pytest.raises(TypeError):
        python_transform(nulls, lambda df: 5)
    out = map_batches(nulls, lambda it: (b[["id"]] for b in it), "id bigint")
    assert out.count() == 8


def test_map_model(spark, nulls):
    def model(prompts):
        if any("z" in p for p in prompts):
            raise ValueError("no z")
        return [p.upper() + " " for p in prompts]

    out = map_model(nulls.select("id", "s"), model, "s", prompt_template="say {s}")
    assert rows(out, "id")[5] == (6, "z", "Error: no z")
    assert rows(out, "id")[1] == (2, None, "SAY NONE")
    assert map_model(nulls, model, "gone") is nulls
    with pytest.raises(RuntimeError, match="500"):
        map_model(spark.range(501).selectExpr("cast(id AS string) AS s"), model, "s")
    many = map_model(spark.range(501).selectExpr("cast(id AS string) AS s"), model, "s", bypass_warning=True)
    assert many.count() == 501


def test_cache(spark, nulls):
    kept = cache_table(nulls.where("x > 5"))
    assert kept.storageLevel.useMemory and kept.count() == 2
    kept.unpersist()
    cut = cache_table(nulls.where("x > 5"), reliable=True)
    assert cut.count() == 2 and "Filter" not in cut._jdf.queryExecution().executedPlan().toString()


def test_scratch(spark):
    path = scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert path.startswith(scratch_root(spark)) and os.path.exists(path)
    drop_scratch(spark)
    assert not os.path.exists(path)


def test_stateless_operators_on_a_stream(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    landing = str(tmp_path / "landing")
    events.repartition(5).write.parquet(landing)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landing)
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    steps = lambda df: stateless_steps(df, customer)
    assert write_available(stream, steps, out, checkpoint=progress)
    assert rows(spark.read.parquet(out), "event_id") == rows(steps(events), "event_id")
    # A second run with the same progress folder has nothing left to do.
    assert write_available(stream, steps, out, checkpoint=progress, timeout=60)
    assert spark.read.parquet(out).count() == steps(events).count()
    with pytest.raises(ValueError):
        write_available(events, steps, out)


def test_entry(spark):
    assert entry.entry(spark).columns == ["segment", "revenue"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # The text queries come and go with their subpackage.
    text = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n)]
    assert bool(text) == (importlib.util.find_spec("prepflow.llm") is not None)
    assert not set(text) & set(catalog.QUERIES)


catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    result = duck(sf_dir).execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, result.fetchall())
