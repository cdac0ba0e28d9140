"""Graphs in JSON: nodes and edges composed into one lazy plan per output."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from prepflow.operators.ordering import sort_rules
from prepflow.plans.registry import ALIASES, NODE_SETTINGS, PARAMETER_ALIASES, Inputs, find_operator
from prepflow.schema import carry_tags
from prepflow.session import shared_folder

Ports = dict[str, DataFrame]

# Node types whose result keeps the row order of their input.
KEEPS_ORDER = {"filter", "select", "formula", "regex", "data_cleansing", "datetime", "browse",
               "fileOutput", "databaseOutput", "remote_out", "map_model"}
USES_ORDER = {"record_id", "sampling", "chunk_rows", "unique", "summarize", "pivot"}


@dataclass
class GraphResult:
    """Tables by node and port, and an error text for every node that failed."""

    tables: dict[str, Ports] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)

    def table(self, node: str, port: str = "output") -> DataFrame:
        if node in self.errors:
            raise RuntimeError(f"node {node}: {self.errors[node]}")
        return pick_port(self.tables[node], port)


def pick_port(ports: Ports, port: str) -> DataFrame:
    """The named port; ``output`` of a node with several ports is ``true`` or the first."""
    if port in ports:
        return ports[port]
    if port and port != "output":
        raise KeyError(f"no port {port!r}; ports are {sorted(ports)}")
    return ports["true"] if "true" in ports else next(iter(ports.values()))


def cache_table(df: DataFrame, reliable: bool = False) -> DataFrame:
    """Keep a result for reuse.

    ``persist`` keeps the lineage, so lost blocks are computed again; ``reliable``
    writes a checkpoint to the folder the session names and cuts the lineage.
    """
    if not reliable:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def switched_off(nodes: list[dict[str, Any]]) -> set[str]:
    """Ids of all switched-off containers and of everything inside them."""
    inside: dict[str, list[str]] = defaultdict(list)
    for node in nodes:
        inside[node.get("parentId")].append(node["id"])
    off: set[str] = set()
    todo = [
        n["id"] for n in nodes if n.get("type") == "container" and n.get("data", {}).get("enabled") is False
    ]
    while todo:
        found = todo.pop()
        if found not in off:
            off.add(found)
            todo += inside[found]
    return off


def run_graph(spark: SparkSession, spec: dict[str, Any]) -> GraphResult:
    """Build the tables of every node of ``{"nodes": [...], "edges": [...]}``.

    Nothing is computed until a table is written, counted or shown, except where
    an operator says so.  Several edges into one port make a list of tables.  A
    node that fails takes the nodes after it with it, and no others; a cycle is
    an error for the whole graph.
    """
    every = {n["id"]: n for n in spec.get("nodes", [])}
    off = switched_off(list(every.values()))
    nodes = {i: n for i, n in every.items() if i not in off and n.get("type") != "container"}
    edges = [
        e for e in spec.get("edges", []) if e.get("source") in nodes and e.get("target") in nodes
    ]
    before: dict[str, set[str]] = {i: set() for i in nodes}
    for edge in edges:
        before[edge["target"]].add(edge["source"])
    try:
        order = list(TopologicalSorter(before).static_order())
    except CycleError as bad:
        raise ValueError(f"the graph has a cycle: {bad.args[1]}") from bad

    result = GraphResult()
    row_order: dict[str, list] = {}
    for node_id in order:
        node = nodes[node_id]
        failed = sorted(s for s in before[node_id] if s in result.errors)
        if failed:
            result.errors[node_id] = f"upstream node {failed[0]} failed"
            continue
        incoming = [e for e in edges if e["target"] == node_id]
        try:
            ports, ordering = run_node(spark, node, incoming, result, row_order)
        except Exception as bad:  # every failure belongs to its node
            result.errors[node_id] = str(bad)
            continue
        result.tables[node_id] = ports
        row_order[node_id] = ordering
    return result


def given_parameters(kind: str, known: dict[str, Any], given: dict[str, Any]) -> dict[str, Any]:
    """A node's own parameters under their usual names; a name the node type does not know is an error."""
    spelled = PARAMETER_ALIASES.get(kind, {})
    out = {}
    for name, value in given.items():
        name = spelled.get(name, name)
        if name in known:
            out[name] = value
        elif name not in NODE_SETTINGS:
            raise ValueError(f"{kind}: unknown parameter {name!r}; parameters are {sorted(known)}")
    return out


def run_node(
    spark: SparkSession,
    node: dict[str, Any],
    incoming: list[dict[str, Any]],
    done: GraphResult,
    row_order: dict[str, list],
) -> tuple[Ports, list]:
    kind = ALIASES.get(node.get("type"), node.get("type"))
    operator = find_operator(kind)
    inputs: Inputs = {}
    for edge in incoming:
        table = done.table(edge["source"], edge.get("sourcePort") or "output")
        port = edge.get("targetPort") or "input"
        held = inputs.get(port)
        if held is None:
            inputs[port] = table
        else:
            inputs[port] = [*held, table] if isinstance(held, list) else [held, table]
    if operator.needs_input and not inputs:
        raise ValueError("no input table is connected")

    params = operator.defaults | given_parameters(kind, operator.defaults, node.get("parameters") or {})
    inherited = row_order.get(incoming[0]["source"], []) if len(incoming) == 1 else []
    if kind in USES_ORDER and not params.get("order_by") and inherited:
        params["order_by"] = inherited
    made = operator.run(spark, inputs, params)
    ports: Ports = made if isinstance(made, dict) else {"output": made}

    sources = [t for v in inputs.values() for t in (v if isinstance(v, list) else [v])]
    ports = {p: carry_tags(t, *sources) for p, t in ports.items()}
    if (node.get("parameters") or {}).get("isCached"):
        ports = {p: cache_table(t) for p, t in ports.items()}
    return ports, order_after(kind, params, inherited, ports)


def order_after(kind: str, params: dict[str, Any], inherited: list, ports: Ports) -> list:
    """Row order of a node's result, as far as it is known."""
    columns = next(iter(ports.values())).columns
    if kind == "sort":
        own = sort_rules(params["rules"], params["column"], params["descending"])
        ordering = own or inherited
    elif kind == "record_id":
        ordering = [(params["column_name"] or "RecordID", "asc")]
    elif kind in KEEPS_ORDER:
        ordering = inherited
    else:
        ordering = []
    if kind == "select":
        renamed = {c["name"]: c["rename"] for c in params["columns"] if c.get("rename")}
        ordering = [(renamed.get(n, n), way) for n, way in ordering]
    return ordering if all(n in columns for n, _ in ordering) else []
