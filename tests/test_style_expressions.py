"""The rows' verdicts on expressions are those of the compiler."""

import json
import random

from tilewright.functions.expressions import Scope, validate
from tilewright.operators import style_expressions

GOOD = [
    ["==", ["get", "a"], 1], ["get", "a"], ["get", "a", ["literal", {"a": 1}]], ["case", ["has", "a"], 1, 2], ["match", ["get", "a"], ["x", "y"], 1, "z", 2, 3],
    ["interpolate", ["linear"], ["zoom"], 0, 1, 5, 2], ["interpolate", ["exponential", 2], ["zoom"], 0, 1, 5, 2], ["interpolate", ["cubic-bezier", 0, 0, 1, 1], ["zoom"], 0, 1, 5, 2],
    ["step", ["zoom"], 0, 1, 2, 5, 3], ["+", 1, ["get", "b"], ["*"]], ["literal", [1, 2]], ["in", ["get", "a"], "x", ["unknown"]], ["rand", 1, 2], ["concat"], ["sqrt", ["literal", 4]],
    ["all"], ["coalesce", ["get", "x"], "y"], ["min", 1], ["unknown", 1], ["-", 3], ["to-rgba", "red"], ["at", 0, ["literal", [1]]],
]
BAD = [
    ["==", 1], ["get"], ["get", 5], ["get", "a", "b"], ["case", ["has", "a"], 1], ["match", ["get", "a"], "x", 1], ["match", ["get", "a"], [["x"]], 1, 2], ["interpolate", ["linear"], ["zoom"], 0, 1, 0, 2],
    ["interpolate", ["what"], ["zoom"], 0, 1, 5, 2], ["interpolate", ["exponential", -1], ["zoom"], 0, 1, 5, 2], ["interpolate", ["linear"], ["zoom"], "0", 1], ["step", ["zoom"], 0, 5, 1, 2, 2],
    ["+", 1, "x"], ["literal"], ["rand", 1], ["sqrt", True], ["sqrt", ["literal", "4"]], ["!", 1, 2], ["coalesce"], ["^", 1, 2, 3], ["+", ["resolved-locale"]], ["has", None], ["upcase"],
]


def nested(rng, depth):
    inner = (lambda: nested(rng, depth - 1)) if depth else (lambda: rng.choice([*GOOD, 1, "x", 2.5]))
    return rng.choice([
        lambda: ["case", inner(), inner(), inner()], lambda: ["match", inner(), "l", inner(), inner()], lambda: ["all", inner(), inner()], lambda: ["coalesce", inner(), inner()],
        lambda: ["to-string", inner()], lambda: ["step", inner(), inner(), 1, inner(), 2, inner()], lambda: rng.choice(GOOD), lambda: rng.choice(BAD), lambda: ["==", inner(), inner()],
    ])()


def test_verdicts_equal_the_compilers(spark):
    rng = random.Random(3)
    scope = Scope.of(spark.createDataFrame([(1.0, "x")], "a double, b string"), ["a", "b"])
    cases = [*GOOD, *BAD, *[nested(rng, rng.randint(0, 4)) for _ in range(80)]]
    layer = lambda e, k: {"id": "l", "type": "line", ["paint", "layout"][k % 2]: {"p": e}} if k % 3 else {"id": "l", "filter": e}
    docs = spark.createDataFrame([(k, json.dumps({"layers": [layer(e, k)]})) for k, e in enumerate(cases)], "k int, style string")
    found = {}
    for r in style_expressions.expression_issues(docs, "k", "style").collect():
        found.setdefault(r.k, []).append((r.path, r.message))
    for k, e in enumerate(cases):
        assert bool(validate(e, scope)) == (k in found), (e, validate(e, scope), found.get(k))


def test_paths_lead_to_the_fault(spark):
    deep = ["case", ["has", "a"], ["+", 1, ["get", 5]], 0]
    for _ in range(12):
        deep = ["all", deep]
    style = {"layers": [{"id": "a"}, {"id": "b", "paint": {"w": deep, "c": "red", "o": ["x", 1]}, "filter": ["==", 1]}]}
    docs = spark.createDataFrame([(7, json.dumps(style)), (8, "no json"), (9, None)], "doc int, text string")
    got = {(r.doc, r.path, r.message) for r in style_expressions.expression_issues(docs, "doc", "text").collect()}
    assert got == {(7, "layers.1.filter", "a wrong number of arguments to =="), (7, "layers.1.paint.w" + ".1" * 12 + ".2.2", "get takes a key")}
    assert style_expressions.expression_issues(docs.where("false"), "doc", "text").collect() == []
