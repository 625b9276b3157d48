"""Nothing that does not fit becomes a null unseen."""

import pytest

from commentflow.operators import payload
from commentflow.operators.payload import Field

ROWS = [
    (1, '{"k": 1, "s": "a", "deep": {"x": [1, {"y": true}]}}'), (2, '{"k": "1"}'), (3, '{"k": 1'), (4, None), (5, '{"k": null}'),
    (6, '{"k": 1.5, "s": [1]}'), (7, "[1]"), (8, '"x"'), (9, '{"k": 12345678901234567890}'), (10, '{"k": 1e3}'), (11, ""), (12, '{"k": 2, "k2": 3}'),
]
FIELDS = (Field("k", "$.k", "bigint", True), Field("s", "$.s"), Field("y", "$.deep.x[1].y", "boolean"))


def test_problems(spark):
    df = spark.createDataFrame(ROWS, "id int, p string")
    got = {r.id: [tuple(x) for x in r.problems] for r in payload.checked(df, "p", FIELDS).collect()}
    assert got == {
        1: [], 2: [("k", "retyped", "string")], 3: [("p", "malformed", None)], 4: [("p", "absent", None)], 5: [("k", "missing", "null")],
        6: [("k", "retyped", "number"), ("s", "retyped", "array")], 7: [("k", "missing", None)], 8: [("k", "missing", None)],
        9: [("k", "range", "whole")], 10: [("k", "retyped", "number")], 11: [("p", "malformed", None)], 12: [],
    }


def test_both_outputs(spark):
    df = spark.createDataFrame([(*r, "old") for r in ROWS], "id int, p string, k string")
    good, rejected = payload.split_payloads(df, "p", FIELDS)
    assert sorted((r.id, r.k, r.s, r.y) for r in good.collect()) == [(1, 1, "a", True), (12, 2, None, None)]
    assert dict(good.dtypes) == {"id": "int", "k": "bigint", "s": "string", "y": "boolean"}
    assert rejected.columns == ["id", "p", "problems"] and rejected.count() + good.count() == len(ROWS)
    assert {r.p for r in rejected.collect()} == {p for i, p in ROWS if i not in (1, 12)}


def test_shapes_and_schema(spark):
    df = spark.createDataFrame(ROWS, "id int, p string")
    got = {(r.path, r.kind): r.n for r in payload.shapes(df, "p", ["$.k"]).collect()}
    assert got == {("$.k", "whole"): 3, ("$.k", "string"): 1, ("$.k", "malformed"): 2, ("$.k", "null"): 1, ("$.k", "number"): 2, ("$.k", None): 2}
    same = spark.createDataFrame([('{"a": 1}',), ('{"a": 2.5, "b": "x"}',)], "p string")
    assert payload.common_schema(same, "p").first()[0].startswith("OBJECT<a: DECIMAL")


def test_edges(spark):
    empty = spark.createDataFrame([], "id int, p string")
    good, rejected = payload.split_payloads(empty, "p", FIELDS)
    assert good.count() == rejected.count() == 0
    for bad in ([Field("a", "$.a"), Field("a", "$.b")], [Field("p", "$.a")], [Field("problems", "$.a")]):
        with pytest.raises(ValueError):
            payload.checked(empty, "p", bad)
    with pytest.raises(ValueError):
        Field("a", "$.a", "date")
