"""Dataflow documents: ``{"nodes": [...], "edges": [...], "partitions": n}``."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from weftline.functions.dsl import NotationError, parse_flat, parse_map, parse_predicate, parse_reducer


class DagError(ValueError):
    """A document that is not a valid dataflow graph."""


JOIN_TYPES = {"Inner": "inner", "Left": "left", "Right": "right", "Full": "full"}
SCOPES = ("global", "task")

#: Operator name: required parameters, optional parameters (extensions among them).
OPERATORS: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "Read": (("uri", "format"), ()),
    "Map": (("script",), ()),
    "Filter": (("predicate",), ("coerce",)),
    "FlatMap": (("func",), ()),
    "Reduce": (("reducer",), ()),
    "Aggregate": (("aggregation",), ()),
    "ReduceByKey": (("key", "op"), ()),
    "Join": (("join_type",), ("key", "left_key", "right_key")),
    "ShuffleByKey": (("key", "total_partitions"), ()),
    "Identity": ((), ()),
    "Write": (("uri", "format"), ()),
}

#: Other names of Read, with the format that they imply.
READ_ALIASES = {"read_csv": "csv", "read_jsonl": "jsonl"}


@dataclass(frozen=True)
class Node:
    id: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class DagSpec:
    nodes: tuple[Node, ...]
    edges: tuple[tuple[str, str], ...]
    partitions: int = 1

    def parents(self, node_id: str) -> list[str]:
        """Parents in the order of the edge list: a join's first one is its left side."""
        return [a for a, b in self.edges if b == node_id]

    def children(self, node_id: str) -> list[str]:
        return [b for a, b in self.edges if a == node_id]

    def sinks(self) -> list[str]:
        fed = {a for a, _ in self.edges}
        return [n.id for n in self.nodes if n.id not in fed]

    def ordered(self) -> list[Node]:
        """Kahn's order; nodes that are ready together keep the order of the document."""
        waits = {n.id: len(self.parents(n.id)) for n in self.nodes}
        left, out = list(self.nodes), []
        while left:
            ready = next((n for n in left if waits[n.id] == 0), None)
            if ready is None:
                raise DagError(f"cycle among nodes {sorted(n.id for n in left)}")
            left.remove(ready)
            out.append(ready)
            for child in self.children(ready.id):
                waits[child] -= 1
        return out

    def validate(self) -> DagSpec:
        ids = [n.id for n in self.nodes]
        if len(set(ids)) < len(ids):
            raise DagError("duplicate node ids")
        if self.partitions < 1:
            raise DagError("partitions must be at least 1")
        if bad := sorted({x for e in self.edges for x in e} - set(ids)):
            raise DagError(f"edges name unknown nodes {bad}")
        if not any(n.kind == "Read" for n in self.nodes):
            raise DagError("a graph needs a Read node")
        for node in self.nodes:
            n_in = len(self.parents(node.id))
            if node.kind == "Join" and n_in != 2:
                raise DagError(f"join node '{node.id}' must have exactly 2 inputs, has {n_in}")
            if node.kind == "Read" and n_in:
                raise DagError(f"read node '{node.id}' takes no input")
            if node.kind != "Read" and not n_in:
                raise DagError(f"node '{node.id}' has no input")
            _check_params(node)
        self.ordered()
        return self

    def to_dict(self) -> dict[str, Any]:
        """The document again; ``parse_dag`` of it gives an equal graph."""
        return {
            "nodes": [{"id": n.id, "operator": {n.kind: dict(n.params)} if n.params else n.kind} for n in self.nodes],
            "edges": [{"from": a, "to": b} for a, b in self.edges],
            "partitions": self.partitions,
        }


def _check_params(node: Node) -> None:
    p = node.params
    try:
        match node.kind:
            case "Map":
                parse_map(p["script"])
            case "Filter":
                parse_predicate(p["predicate"])
            case "FlatMap":
                parse_flat(p["func"])
            case "Reduce":
                parse_reducer(p["reducer"])
            case "Aggregate":
                parse_reducer(p["aggregation"])
            case "ReduceByKey":
                parse_reducer(p["op"])
            case "Join":
                if p["join_type"] not in JOIN_TYPES:
                    raise DagError(f"unknown join type '{p['join_type']}'")
                if "key" not in p and not ("left_key" in p and "right_key" in p):
                    raise DagError(f"join node '{node.id}' needs a key")
            case "ShuffleByKey":
                if int(p["total_partitions"]) < 0:
                    raise DagError("total_partitions must not be negative")
    except NotationError as e:
        raise DagError(f"node '{node.id}': {e}") from e


def _parse_node(raw: dict[str, Any]) -> Node:
    try:
        node_id, op = raw["id"], raw["operator"]
    except (KeyError, TypeError):
        raise DagError(f"a node needs id and operator: {raw!r}") from None
    if isinstance(op, str):
        op = {op: {}}
    if not isinstance(op, dict) or len(op) != 1:
        raise DagError(f"node '{node_id}': an operator is one name with its parameters")
    kind, params = next(iter(op.items()))
    if kind in READ_ALIASES:
        kind, params = "Read", {"format": READ_ALIASES[kind], **(params or {})}
    if kind not in OPERATORS:
        raise DagError(f"node '{node_id}': unknown operator '{kind}'")
    params = dict(params or {})
    if kind == "ReduceByKey" and "reducer" in params:
        params.setdefault("op", params.pop("reducer"))
    need, may = OPERATORS[kind]
    if missing := [k for k in need if k not in params]:
        raise DagError(f"node '{node_id}': {kind} misses {missing}")
    if extra := sorted(set(params) - {*need, *may}):
        raise DagError(f"node '{node_id}': {kind} does not know {extra}")
    return Node(str(node_id), kind, params)


def parse_dag(document: str | bytes | dict[str, Any]) -> DagSpec:
    """Parse and validate a document given as JSON text or as a dict."""
    if isinstance(document, (str, bytes)):
        try:
            document = json.loads(document)
        except json.JSONDecodeError as e:
            raise DagError(f"not JSON: {e}") from e
    if not isinstance(document, dict) or "nodes" not in document:
        raise DagError("a graph needs nodes")
    try:
        edges = tuple((str(e["from"]), str(e["to"])) for e in document.get("edges", []))
    except (KeyError, TypeError):
        raise DagError("an edge needs from and to") from None
    nodes = tuple(_parse_node(n) for n in document["nodes"])
    return DagSpec(nodes, edges, int(document.get("partitions", 1))).validate()
