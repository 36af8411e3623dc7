"""Expressions inside style documents, checked as rows: their syntax trees are flattened and joined with what operators take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.functions.expressions import OPERATORS, UNARY
from tilewright.operators.styles import _get, _is, _issues

# How many arguments operators take, at least and at most, and whether their number is odd or even.
ARGUMENTS = [
    ("literal ! length to-string to-boolean to-rgba downcase upcase", 1, 1, None),
    ("at == != < <= > >= / % ^", 2, 2, None),
    ("get has !has feature-state -", 1, 2, None),
    ("rand", 2, 3, None),
    ("coalesce in !in min max to-number to-color", 1, None, None),
    ("case", 3, None, 1),
    ("match interpolate step", 4, None, 0),
]
KEYED = ("get", "has", "!has", "feature-state")
ARITHMETIC = ("+", "*", "-", "/", "%", "^", "min", "max", "rand", *UNARY)


def argument_rules(spark: SparkSession) -> DataFrame:
    """operator, least, most, odd (1 for an odd number of arguments, 0 for an even one): a row for each known operator."""
    told = {name: limits for names, *limits in ARGUMENTS for name in [*names.split()]} | {name: [1, 1, None] for name in UNARY}
    return spark.createDataFrame([(name, *told.get(name, [0, None, None])) for name in sorted(OPERATORS)], "operator string, least int, most int, odd int")


def _operator(node: Column) -> Column:
    """The operator of an expression; null for data."""
    head = F.try_variant_get(node, "$[0]", "string")
    return F.when((_is(node) == "array") & (_is(F.try_variant_get(node, "$[0]", "variant")) == "string") & head.isin(*sorted(OPERATORS)), head)


def style_roots(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, path and node (JSON) of each filter and property of the layers that is an expression."""
    parsed = docs.select(key, F.try_parse_json(column).alias("s"))
    layers = parsed.select(key, F.posexplode(_get(F.col("s"), "layers", kind="array<variant>")).alias("__k", "__v"))
    whole = F.array(F.struct(F.lit("filter").alias("part"), _get(F.col("__v"), "filter").alias("value")))

    def values(part: str) -> Column:
        entries = F.map_entries(_get(F.col("__v"), part, kind="map<string,variant>"))
        return F.transform(entries, lambda e: F.struct(F.concat(F.lit(f"{part}."), e["key"]).alias("part"), e["value"].alias("value")))

    parts = [values("paint"), values("layout")]
    empty = F.filter(whole, lambda e: F.lit(False))
    each = layers.select(key, "__k", F.explode(F.concat(whole, *[F.coalesce(p, empty) for p in parts])).alias("__e"))
    return each.where(_operator(F.col("__e.value")).isNotNull()).select(key, F.concat_ws(".", F.lit("layers"), F.col("__k"), F.col("__e.part")).alias("path"), F.to_json("__e.value").alias("node"))


def syntax_nodes(roots: DataFrame, key: str) -> DataFrame:
    """roots (key, path, node) -> key, root, path, parent, operator, arguments (array of JSON): each operator of the trees,
    at any depth. A recursive query that takes all trees apart together, level by level."""
    spark = roots.sparkSession
    start = roots.select(F.col(key).alias("k"), F.col("path").alias("root"), "path", F.lit(None).cast("string").alias("parent"), "node")
    known = ", ".join("'" + name.replace("'", "''") + "'" for name in sorted(OPERATORS))
    inner = "try_variant_get(parse_json(n.node), '$', 'array<variant>')"
    head = "try_variant_get(parse_json(n.node), '$[0]', 'string')"
    # what is an expression of its own: labels, curves and data aren't
    seen = f"CASE {head} WHEN 'literal' THEN false WHEN 'match' THEN c.at = 1 OR c.at = size({inner}) - 1 OR c.at % 2 = 1 WHEN 'in' THEN c.at = 1 WHEN '!in' THEN c.at = 1 WHEN 'interpolate' THEN c.at > 1 ELSE true END"
    walked = spark.sql(
        "WITH RECURSIVE nodes(k, root, path, parent, node) AS (SELECT k, root, path, parent, node FROM {start} UNION ALL "
        f"SELECT n.k, n.root, concat(n.path, '.', c.at), n.path, to_json(c.value) FROM nodes n LATERAL VIEW posexplode({inner}) c AS at, value "
        f"WHERE c.at > 0 AND {seen} AND schema_of_variant(c.value) LIKE 'ARRAY%' AND schema_of_variant(try_variant_get(c.value, '$[0]', 'variant')) = 'STRING' AND try_variant_get(c.value, '$[0]', 'string') IN ({known})) "
        "SELECT * FROM nodes LIMIT ALL",
        start=start,
    )
    items = F.try_variant_get(F.parse_json("node"), "$", "array<variant>")
    given = F.transform(F.slice(items, F.lit(2), F.size(items)), lambda v: F.to_json(v))
    return walked.select(F.col("k").alias(key), "root", "path", "parent", F.try_variant_get(F.parse_json("node"), "$[0]", "string").alias("operator"), given.alias("arguments"))


def expression_issues(docs: DataFrame, key: str, column: str) -> DataFrame:
    """key, path, message: what is wrong in the expressions of each style (JSON), a row for each operator and kind of
    fault; the path leads to the operator, by places of arguments from 1."""
    nodes = syntax_nodes(style_roots(docs, key, column), key)
    told = nodes.join(F.broadcast(argument_rules(docs.sparkSession)), "operator")  # about 70 operators
    n, op = F.size("arguments"), F.col("operator")
    arg = lambda k: F.parse_json(F.get("arguments", F.lit(k)))
    count = (n < F.col("least")) | (n > F.col("most")) | (n % 2 != F.col("odd"))
    no_key = op.isin(*KEYED) & (n > 0) & (_is(arg(0)) != "string")
    second = F.coalesce(F.try_variant_get(arg(1), "$[1]", "variant"), arg(1))
    no_object = op.isin("get", "has") & (n == 2) & (_is(F.when(F.try_variant_get(arg(1), "$[0]", "string") == "literal", second).otherwise(arg(1))) != "object")

    def no_number(text: Column) -> Column:
        v = F.parse_json(text)
        own = _operator(v)
        return F.when(own == "literal", _is(F.try_variant_get(v, "$[1]", "variant")) != "number").when(own == "resolved-locale", True).when(own.isNotNull(), False).otherwise(_is(v) != "number")

    label = lambda text: F.exists(F.coalesce(F.try_variant_get(F.parse_json(text), "$", "array<variant>"), F.array(F.parse_json(text))), lambda v: _is(v).isin("array", "object"))
    labels = F.filter("arguments", lambda v, k: (k % 2 == 1) & (k < n - 1))
    stops = F.transform(F.filter("arguments", lambda v, k: (k > 1) & (k % 2 == 0)), lambda v: F.when(_is(F.parse_json(v)) == "number", F.try_variant_get(F.parse_json(v), "$", "double")))
    grow = F.forall(stops, lambda v: v.isNotNull()) & F.forall(F.sequence(F.lit(0), F.greatest(F.size(stops) - 2, F.lit(0))), lambda k: (F.size(stops) < 2) | (F.get(stops, k + 1) > F.get(stops, k)))
    curve, base = F.try_variant_get(arg(0), "$[0]", "string"), F.try_variant_get(arg(0), "$[1]", "double")
    curve_ok = (curve == "linear") | ((curve == "exponential") & (base > 0)) | ((curve == "cubic-bezier") & (F.size(F.try_variant_get(arg(0), "$", "array<variant>")) == 5))
    fault = F.coalesce(count, F.lit(False))
    sound = ~fault
    found = _issues(
        (fault, F.col("path"), F.concat(F.lit("a wrong number of arguments to "), op)),
        (sound & no_key, F.col("path"), F.concat(op, F.lit(" takes a key"))),
        (sound & no_object, F.col("path"), F.concat(op, F.lit(" takes an object"))),
        (sound & op.isin(*ARITHMETIC) & F.exists("arguments", no_number), F.col("path"), F.concat(op, F.lit(" takes numbers"))),
        (sound & (op == "match") & F.exists(labels, label), F.col("path"), "labels of match are scalars"),
        (sound & op.isin("interpolate", "step") & ~F.coalesce(grow, F.lit(False)), F.col("path"), F.concat(F.lit("stops of "), op, F.lit(" don't grow"))),
        (sound & (op == "interpolate") & (n > 4) & ~F.coalesce(curve_ok, F.lit(False)), F.col("path"), "no such curve"),
    )
    return told.select(key, F.inline(found))
