"""Queries that evaluate expressions and filters over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.expressions import Scope, evaluate, where
from tilewright.sources.views import EV, event_points

PROPERTIES = ["event_type", "value", "user_id", "k"]
NUMBER_SQL = "CASE WHEN value <= 0 THEN {a} WHEN value >= 100 THEN {b} ELSE {a} + ({b} - {a}) * {t} END"

#: name -> (expression, SQL for its value, decimals to round to or None)
VALUES: dict[str, tuple[object, str, int | None]] = {
    "expr_get": (["get", "event_type"], "event_type", None),
    "expr_has": (["all", ["has", "value"], ["!has", "nothing"], ["!", ["has", "nothing"]]], "value IS NOT NULL", None),
    "expr_at": (["at", ["%", ["get", "user_id"], 5], ["literal", [10, 20, 30]]], "CASE user_id % 5 WHEN 0 THEN 10e0 WHEN 1 THEN 20e0 WHEN 2 THEN 30e0 END", 6),
    "expr_length": (["length", ["get", "event_type"]], "CAST(length(event_type) AS DOUBLE)", 6),
    "expr_geometry_type": (["geometry-type"], "'Point'", None),
    "expr_id": (["id"], "CAST(event_id AS DOUBLE)", 6),
    "expr_zoom": (["zoom"], "7.5e0", 6),
    "expr_line_progress": (["line-progress"], "0e0", 6),
    "expr_feature_state": (["feature-state", "k"], "k", 6),
    "expr_equal": (["==", ["get", "event_type"], "click"], "coalesce(event_type = 'click', false)", None),
    "expr_equal_is_strict": (["any", ["==", ["get", "user_id"], "1"], ["!=", ["get", "k"], 7]], "coalesce(k <> 7, true)", None),
    "expr_compare": (["all", [">", ["get", "value"], 10], ["<=", ["get", "k"], 50]], "coalesce(value > 10 AND k <= 50, false)", None),
    "expr_compare_strings": (["<", ["get", "event_type"], "error"], "event_type < 'error'", None),
    "expr_any_none": (["any", ["none", ["get", "k"]], [">=", ["get", "value"], 200]], "coalesce(k, 0) = 0 OR value >= 200", None),
    "expr_case": (["case", ["<", ["get", "value"], 10], "low", ["<", ["get", "value"], 60], "mid", "high"], "CASE WHEN value < 10 THEN 'low' WHEN value < 60 THEN 'mid' ELSE 'high' END", None),
    "expr_case_mixed": (["case", ["==", ["get", "event_type"], "view"], ["get", "user_id"], ["get", "event_type"]], "CASE WHEN event_type = 'view' THEN CAST(user_id AS VARCHAR) ELSE event_type END", None),
    "expr_match": (["match", ["get", "event_type"], ["click", "view"], 1, "error", 2, 0], "CASE WHEN event_type IN ('click','view') THEN 1e0 WHEN event_type = 'error' THEN 2e0 ELSE 0e0 END", 6),
    "expr_coalesce": (["coalesce", ["get", "nothing"], ["get", "k"], -1], "coalesce(k, -1e0)", 6),
    "expr_in": (["in", ["get", "event_type"], "click", "error"], "event_type IN ('click','error')", None),
    "expr_not_in": (["!in", ["get", "k"], 1, 2, 3], "coalesce(k NOT IN (1,2,3), true)", None),
    "expr_math": (["+", ["*", ["get", "value"], 2], ["-", ["get", "k"], 3], ["-", 1], ["abs", ["-", 5]]], "value * 2 + (k - 3) - 1 + 5", 6),
    "expr_divide": (["/", ["sqrt", ["get", "value"]], ["-", ["get", "k"], 50]], "CASE WHEN k <> 50 THEN sqrt(value) / (k - 50) END", 6),
    "expr_modulo": (["%", ["-", ["get", "k"], 50], 7], "(k - 50) - 7 * trunc((k - 50) / 7)", 6),
    "expr_power": (["^", ["get", "k"], 0.5], "pow(k, 0.5)", 6),
    "expr_min_max": (["-", ["max", ["get", "value"], ["get", "k"]], ["min", ["get", "value"], ["get", "k"], 30]], "greatest(value, k) - least(value, k, 30)", 6),
    "expr_round": (["round", ["-", ["get", "k"], 50.5]], "floor(k - 50.5 + 0.5)", 6),
    "expr_floor_ceil": (["-", ["ceil", ["get", "value"]], ["floor", ["get", "value"]]], "ceil(value) - floor(value)", 6),
    "expr_sqrt_fails": (["sqrt", ["-", ["get", "k"], 50]], "CASE WHEN k >= 50 THEN sqrt(k - 50) END", 6),
    "expr_logs": (["+", ["ln", ["get", "value"]], ["log10", ["get", "value"]], ["log2", ["get", "value"]]], "CASE WHEN value > 0 THEN ln(value) + log10(value) + log2(value) END", 6),
    "expr_constants": (["*", ["e"], ["pi"]], "exp(1e0) * pi()", 6),
    "expr_rand_seeded": (
        ["rand", 0, 100, ["get", "user_id"]],
        "100 * (((((CASE WHEN user_id = 0 THEN 1 ELSE user_id END) * 1664525 + 1013904223) % 4294967296) * 1664525 + 1013904223) % 4294967296) / 4294967296e0",
        6,
    ),
    "expr_to_number": (["to-number", ["get", "nothing"], ["concat", "0x", ["downcase", "1F"]], 5], "31e0", 6),
    "expr_to_number_fails": (["to-number", ["get", "event_type"]], "CAST(NULL AS DOUBLE)", 6),
    "expr_to_string": (["to-string", ["get", "user_id"]], "CAST(user_id AS VARCHAR)", None),
    "expr_to_boolean": (["to-boolean", ["get", "k"]], "coalesce(k, 0) <> 0", None),
    "expr_to_color": (["to-color", ["match", ["get", "event_type"], "click", "red", "view", "#0f08", "rgb(10% 20% 30% / 0.5)"]], "CASE event_type WHEN 'click' THEN 'rgba(255,0,0,1)' WHEN 'view' THEN 'rgba(0,255,0,0.5333)' ELSE 'rgba(26,51,77,0.5)' END", None),
    "expr_to_rgba": (["at", 1, ["to-rgba", ["literal", [0, 128, 255]]]], "128e0", 6),
    "expr_concat": (["concat", ["upcase", ["get", "event_type"]], ":", ["get", "user_id"], ":", True], "upper(event_type) || ':' || CAST(user_id AS VARCHAR) || ':true'", None),
    "expr_locale": (["resolved-locale"], "'en'", None),
    "expr_interp_linear": (["interpolate", ["linear"], ["get", "value"], 0, 1, 100, 10], NUMBER_SQL.format(a="1e0", b="10e0", t="value / 100"), 6),
    "expr_interp_exponential": (["interpolate", ["exponential", 1.02], ["get", "value"], 0, 1, 100, 10], NUMBER_SQL.format(a="1e0", b="10e0", t="(pow(1.02e0, value) - 1) / (pow(1.02e0, 100) - 1)"), 6),
    "expr_interp_color": (
        ["interpolate", ["linear"], ["get", "value"], 0, "black", 100, "white"],
        "CASE WHEN value <= 0 THEN 'black' WHEN value >= 100 THEN 'white' ELSE 'rgba(' || repeat(CAST(CAST(floor(value / 100 * 255 + 0.5) AS INT) AS VARCHAR) || ',', 3) || '1)' END",
        None,
    ),
    "expr_interp_array": (["at", 1, ["interpolate", ["linear"], ["get", "value"], 0, ["literal", [0, 10]], 100, ["literal", [1, 30]]]], NUMBER_SQL.format(a="10e0", b="30e0", t="value / 100"), 6),
    "expr_step": (["step", ["get", "value"], "small", 10, "medium", 60, "large"], "CASE WHEN value < 10 THEN 'small' WHEN value < 60 THEN 'medium' ELSE 'large' END", None),
}

#: name -> (filter, SQL predicate)
FILTERS: dict[str, tuple[object, str]] = {
    "filter_legacy": (["all", ["==", ["get", "event_type"], "click"], [">", ["get", "value"], 10], ["in", ["get", "k"], 1, 2, 3, 5, 8, 13]], "event_type = 'click' AND value > 10 AND k IN (1,2,3,5,8,13)"),
    "filter_legacy_none": (["none", ["==", ["get", "event_type"], "view"], ["!has", "value"], ["<", ["get", "k"], 40]], "event_type <> 'view' AND value IS NOT NULL AND NOT coalesce(k < 40, false)"),
    "filter_expression": ([">", ["*", ["get", "value"], 2], ["+", ["get", "k"], 40]], "value * 2 > k + 40"),
    "filter_keeps_failures": ([">", ["/", 100, ["get", "k"]], 50], "coalesce(k, 0) = 0 OR 100 / k > 50"),
    "filter_short_circuit": (["all", [">", ["get", "k"], 90], [">", ["/", 1, ["-", ["get", "k"], 10]], 0]], "k > 90"),
    "filter_unknown_operator": (["no-such-operator", 1], "true"),
}


def value_query(expression: object, decimals: int | None) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = event_points(spark, sf_dir)
        scope = Scope.of(events, PROPERTIES, state=["k"], geometry_type=F.lit(1), id="event_id", zoom=7.5)
        v = evaluate(expression, scope)
        return events.select("event_id", (v if decimals is None else F.round(v, decimals)).alias("v"))

    return query


def filter_query(expression: object) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        events = event_points(spark, sf_dir)
        return events.where(where(expression, Scope.of(events, PROPERTIES, geometry_type=F.lit(1), id="event_id"))).select("event_id", "event_type")

    return query


QUERIES = {k: value_query(x, n) for k, (x, _, n) in VALUES.items()} | {k: filter_query(x) for k, (x, _) in FILTERS.items()}
ORACLES = {k: f"SELECT event_id, {sql if n is None else f'round({sql}, {n})'} AS v FROM ({EV})" for k, (_, sql, n) in VALUES.items()}
ORACLES |= {k: f"SELECT event_id, event_type FROM ({EV}) WHERE {sql}" for k, (_, sql) in FILTERS.items()}
