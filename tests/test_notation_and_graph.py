import json

import pytest

from weftline.functions.dsl import NotationError, parse_flat, parse_map, parse_predicate, parse_reducer
from weftline.plans.spec import DagError, parse_dag

READ = {"Read": {"uri": "x", "format": "csv"}}


def doc(nodes, edges, **more):
    return {"nodes": [{"id": k, "operator": v} for k, v in nodes], "edges": [{"from": a, "to": b} for a, b in edges], **({"partitions": 2} | more)}


@pytest.mark.parametrize("bad", ["", "equals", "equals:a", "equals:=5", "gt:a", "gt:a=", "gt:a=x", "gt:a=1_0", "gt:a= 1", "lt:=3", "nope", "always_true:", "ne:a=1"])
def test_bad_predicates(bad):
    with pytest.raises(NotationError):
        parse_predicate(bad)


def test_good_predicates():
    p = parse_predicate("equals:a=b=c")
    assert (p.field, p.text) == ("a", "b=c") and parse_predicate("equals:a=").text == ""
    assert parse_predicate("gt:a=-1.5e3").number == -1500.0


@pytest.mark.parametrize("bad", ["avg:x", "count:x", "collect:x", "median", ""])
def test_bad_reducers(bad):
    with pytest.raises(NotationError):
        parse_reducer(bad)


def test_names_of_results():
    assert [parse_reducer(r).output for r in ("count", "sum", "sum:a", "max:b", "collect")] == ["count", "sum", "sum_a", "max_b", "collect"]


@pytest.mark.parametrize("bad", ["split", "explode:x", "nope", ""])
def test_bad_flat_functions(bad):
    with pytest.raises(NotationError):
        parse_flat(bad)


def test_bad_map():
    with pytest.raises(NotationError):
        parse_map("unknown_function")


@pytest.mark.parametrize(
    ("nodes", "edges", "more"),
    [
        ([("r", READ), ("r", READ)], [], {}),
        ([("r", READ)], [("r", "z")], {}),
        ([("r", READ)], [], {"partitions": 0}),
        ([("m", {"Map": {"script": "identity"}})], [], {}),
        ([("r", READ), ("m", {"Map": {"script": "identity"}})], [], {}),
        ([("r", READ), ("a", "Identity"), ("b", "Identity")], [("r", "a"), ("a", "b"), ("b", "a")], {}),
        ([("r", READ), ("j", {"Join": {"key": "k", "join_type": "Inner"}})], [("r", "j")], {}),
        ([("r", READ), ("s", READ), ("j", {"Join": {"key": "k", "join_type": "Cross"}})], [("r", "j"), ("s", "j")], {}),
        ([("r", READ), ("f", {"Filter": {"predicate": "invalid_predicate"}})], [("r", "f")], {}),
        ([("r", READ), ("f", {"Nope": {}})], [("r", "f")], {}),
        ([("r", READ), ("f", {"Map": {}})], [("r", "f")], {}),
        ([("r", READ), ("f", {"Map": {"script": "identity", "x": 1}})], [("r", "f")], {}),
        ([("r", READ), ("s", READ)], [("r", "s")], {}),
    ],
)
def test_rejected_graphs(nodes, edges, more):
    with pytest.raises(DagError):
        parse_dag(doc(nodes, edges, **more))


def test_order_parents_and_round_trip():
    dag = parse_dag(json.dumps(doc([("j", {"Join": {"key": "k", "join_type": "Left"}}), ("b", READ), ("a", READ), ("k", {"ReduceByKey": {"key": "x", "reducer": "count"}})], [("a", "j"), ("b", "j"), ("j", "k")])))
    assert [n.id for n in dag.ordered()] == ["b", "a", "j", "k"] and dag.parents("j") == ["a", "b"]
    assert dag.sinks() == ["k"] and dag.nodes[3].params == {"key": "x", "op": "count"}
    assert parse_dag(dag.to_dict()) == dag
    with pytest.raises(DagError):
        parse_dag("{")
