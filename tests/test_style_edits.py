"""Applying the changes between two styles gives the second one."""

import json
import random

from tilewright.operators import style_edits, styles

KINDS = ["line", "fill", "circle"]


def random_style(rng):
    names = rng.sample("abcdefg", rng.randint(0, 5))
    layers = []
    for name in sorted(names) if rng.random() < 0.8 else names:
        layer = {"id": name, "type": KINDS[ord(name) % 3 if rng.random() < 0.8 else 0]}
        if rng.random() < 0.5:
            layer["source"] = rng.choice(["s", "t"])
        for part, choices in (("paint", ["line-width", "line-color", "fill-opacity"]), ("layout", ["line-cap", "visibility"])):
            own = {p: rng.choice([1, 2.5, "red", ["get", "a"], {"x": [1, None]}, True, 'q"\\é']) for p in choices if rng.random() < 0.4}
            if own:
                layer[part] = own
        for k in ("minzoom", "maxzoom"):
            if rng.random() < 0.3:
                layer[k] = rng.randint(0, 20)
        if rng.random() < 0.4:
            layer["filter"] = rng.choice([["has", "a"], ["==", "k", 1], ["all"]])
        layers.append(layer)
    sources = {k: {"type": "geojson", "data": rng.choice(["u1", "u2", {"type": "Point"}])} if k == "g" else {"type": "vector", "url": rng.choice("uvw")} for k in "stg" if rng.random() < 0.7}
    style = {"version": 8 if rng.random() < 0.95 else 9, "sources": sources, "layers": layers}
    style |= {"light": {"anchor": rng.choice(["map", "viewport"])}, "transition": {"duration": rng.randint(0, 3)}, "name": "n"}
    return style


def test_changes_applied_give_the_other_style(spark):
    rng = random.Random(21)
    pairs = []
    for k in range(120):
        a = random_style(rng)
        b = random_style(rng) if k % 2 else json.loads(json.dumps(a))
        if k % 2 == 0 and b["layers"]:
            layer = rng.choice(b["layers"])
            layer.setdefault("paint", {})["line-width"] = rng.randint(5, 9)
            layer.pop("filter", None)
        pairs.append((k, json.dumps(a), json.dumps(b)))
    df = spark.createDataFrame(pairs, "k int, a string, b string")
    changes = styles.style_changes(df, "k", "a", "b")
    made = {r.k: json.loads(r.a) for r in style_edits.style_applied(df.select("k", "a"), changes, "k", "a").collect()}
    wrong = {k: (made[k], json.loads(b)) for k, _, b in pairs if made[k] != json.loads(b)}
    assert not wrong, next(iter(wrong.values()))


def test_commands_one_after_the_other(spark):
    before = {"version": 8, "sources": {"s": {"type": "geojson", "data": "u"}}, "layers": [{"id": "a", "type": "line", "paint": {"w": 1}}, {"id": "b", "type": "fill"}, {"type": "nameless"}]}
    steps = [
        ("addLayer", None, None, '{"id":"c","type":"line"}', "b"), ("setPaintProperty", "a", "w", None, None), ("setPaintProperty", "c", "w", '[1,"x"]', None), ("addLayer", None, None, '{"id":"d"}', None),
        ("removeLayer", "b", None, None, None), ("setSourceData", "s", None, '{"type":"Point"}', None), ("setSourceData", "nowhere", None, '"u"', None), ("setFilter", "gone", None, "1", None),
        ("setLayerZoomRange", "a", None, '{"minzoom":2}', None), ("fly", "a", None, None, None), ("addLayer", None, None, '{"id":"a","type":"moved"}', "c"), ("setLight", None, None, '{"x":1}', None),
    ]
    docs = spark.createDataFrame([(1, json.dumps(before)), (2, json.dumps(before)), (3, None), (4, "no json")], "k int, style string")
    commands = spark.createDataFrame([(1, n, *c) for n, c in enumerate(steps)] + [(3, 1, *steps[3]), (9, 1, *steps[0])], "k int, step int, command string, target string, name string, value string, anchor string").repartition(4)
    got = {r.k: json.loads(r.style) for r in style_edits.style_applied(docs, commands, "k", "style").collect()}
    assert got[2] == before and set(got) == {1, 2, 3, 4}
    assert got[3] == {"sources": {}, "layers": [{"id": "d"}]} and got[4] == {"sources": {}, "layers": []}
    assert got[1] == {
        "version": 8, "light": {"x": 1}, "sources": {"s": {"type": "geojson", "data": {"type": "Point"}}},
        "layers": [{"id": "a", "type": "moved"}, {"id": "c", "type": "line", "paint": {"w": [1, "x"]}}, {"type": "nameless"}, {"id": "d"}],
    }


def test_documents_are_read_once_where_they_are_dealt_out(spark):
    """Small documents of one file are no single task's, and their parts don't shuffle again; odd ones keep their commands."""
    style = '{"version":8,"sources":{"s":{"type":"vector"}},"layers":[{"type":"line"},{"id":"a","type":"line","paint":{"w":1}},{"id":"a","type":"fill"}]}'
    rows = [(1, style, style.replace('"fill"', '"line"')), (2, style, None), (3, None, style), (4, style, style.replace('"w":1', '"w":2')), (5, "no json", "[]")]
    changes = styles.style_changes(spark.createDataFrame(rows, "k int, a string, b string").coalesce(1), "k", "a", "b")
    assert changes._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    nameless = [("removeLayer", None), ("addLayer", None)]
    want = {1: [*nameless, ("removeLayer", "a"), ("addLayer", "a")], 2: [("setStyle", None)], 3: [("setStyle", None)], 4: nameless}
    got = {k: [(r.command, r.target) for r in sorted(changes.where(f"k = {k}").collect(), key=lambda r: r.step)] for k in range(1, 6)}
    assert got == want | {5: []}


def test_documents_are_dealt_out_before_commands_are_applied(spark):
    docs = spark.createDataFrame([(1, '{"version":8}')], "k int, style string").coalesce(1)
    commands = spark.createDataFrame([(1, 1, "setLight", None, None, '{"x":1}', None)], "k int, step int, command string, target string, name string, value string, anchor string")
    made = style_edits.style_applied(docs, commands, "k", "style")
    assert "REPARTITION_BY_NUM" in made._jdf.queryExecution().executedPlan().toString()
    assert [json.loads(r.style) for r in made.collect()] == [{"version": 8, "light": {"x": 1}, "sources": {}, "layers": []}]
