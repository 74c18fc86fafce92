"""Sources, sinks, reports and raster operators on small files and tables."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import shapes
from tidemark.operators import facts, raster, reports
from tidemark.sources import catalog, outputs


def test_hubs_in_three_forms(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [85.1, 27.9]}, "properties": {"name": "A"}}, {"type": "Feature", "geometry": None, "properties": {}}]}))
    (tmp_path / "b.json").write_text(json.dumps([{"name": "B", "lon": 85.2, "lat": 27.8}, {"amenity": "clinic", "x": 1, "y": 2}, {"name": "lost"}]))
    (tmp_path / "c.json").write_text(json.dumps([[85.3, 27.7, "C"], [85.4, 27.6]]))
    got = sorted((r["name"], r["lon"], r["lat"]) for r in catalog.hubs(spark, str(tmp_path)).collect())
    assert got == [("A", 85.1, 27.9), ("B", 85.2, 27.8), ("C", 85.3, 27.7), ("Hub", 85.4, 27.6), ("clinic", 1.0, 2.0)]


def test_clip_snapshot_and_cache(spark):
    layer = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 1.0)], "2026-07-27 10:00:00"), (2, [(5.0, 5.0), (6.0, 6.0)], "2026-07-28 00:00:00")], "id int, points array<struct<x:double,y:double>>, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [r["id"] for r in catalog.clipped(layer, 4, 4, 9, 9).collect()] == [2]
    assert catalog.clipped(layer, 40, 40, 90, 90).count() == 2
    assert [r["id"] for r in catalog.allowed(layer).collect()] == [1]
    made = []
    make = lambda: made.append(1) or {"a": layer, "b": layer.limit(1)}
    for _ in range(2):
        got = catalog.cached(spark, ["bbox", "2026"], make, ["a", "b"])
    assert len(made) == 1 and got["a"].count() == 2 and got["b"].count() == 1


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([('{"b":1}',), ('{"a":1}',)], "value string")
    outputs.written_features(rows, str(tmp_path / "f"))
    assert spark.read.text(str(tmp_path / "f")).count() == 2
    assert json.loads(outputs.collection(rows).first()["json"])["features"] == [{"a": 1}, {"b": 1}]
    pt = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y"))
    none, no_ring = pt(None, None), F.lit(None).cast("array<struct<x:double,y:double>>")
    ring = F.array(*[shapes.point(F.lit(a), F.lit(b)) for a, b in ((0, 0), (1, 0), (0, 1))])
    r = spark.range(1).select(outputs.place(ring, none, none, none).alias("a"), outputs.place(no_ring, none, pt(2, 3), pt(4, 5)).alias("b"), outputs.place(no_ring, none, none, none).alias("c")).first()
    assert json.loads(r["a"])["type"] == "Polygon" and json.loads(r["a"])["coordinates"][0][0] == json.loads(r["a"])["coordinates"][0][-1]
    assert json.loads(r["b"])["coordinates"] == [2.0, 3.0] and json.loads(r["c"])["coordinates"] == [0.0, 0.0]
    (tmp_path / "g").mkdir()
    for n, t in (("b.txt", b"two"), ("a.txt", b"one")):
        (tmp_path / "g" / n).write_bytes(t)
    want = hashlib.sha256("".join(n + hashlib.sha256(t).hexdigest() for n, t in (("a.txt", b"one"), ("b.txt", b"two"))).encode()).hexdigest()
    assert outputs.directory_hash(spark, str(tmp_path / "g")).first()["digest"] == want
    table = outputs.console_table(spark.createDataFrame([("x", 10), ("longer", 2)], "name string, n int"), ["name", "n"]).first()["table"]
    assert table == "name   | n \nlonger | 2 \nx      | 10"


def test_manifest_csv_round_trip(spark, tmp_path):
    from tidemark.plans import registry

    rows = registry.QUERIES["rescue_manifest"](spark, "/root/testdata/sf0.001")
    rows.coalesce(1).write.csv(str(tmp_path / "m"), header=True)
    back = catalog.manifest(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


def test_parameters_of_masks():
    ok = dict(pre=(60, 60), post=(60, 60), is_db=True, drop=2.5, speckle=3, least=50)
    raster.checked(**ok)
    for bad, kind in (({"pre": None}, ValueError), ({"post": (60, 61)}, ValueError), ({"pre": (60,), "post": (60,)}, ValueError), ({"pre": (0, 0), "post": (0, 0)}, ValueError), ({"is_db": "yes"}, TypeError), ({"drop": 0.0}, ValueError), ({"drop": float("nan")}, ValueError), ({"speckle": 2}, ValueError), ({"speckle": 0}, ValueError), ({"speckle": 3.5}, TypeError), ({"least": -1}, ValueError)):
        with pytest.raises(kind):
            raster.checked(**(ok | bad))


def test_bands_and_predictions(spark):
    b = spark.createDataFrame([("r", 1, "VH"), ("r", 2, "Sigma VV"), ("r", 3, "vv"), ("s", 1, None), ("s", 2, "x")], "raster_id string, band int, description string")
    assert {r["raster_id"]: r["band"] for r in raster.band(b).collect()} == {"r": 2, "s": 1}
    px = spark.createDataFrame([(r, c, None if (r, c) == (2, 3) else float(r * c % 7)) for r in range(11) for c in range(9)], "row int, col int, a double")
    got = {(r["row"], r["col"]): r for r in raster.predicted(px, ["a"], 11, 9, 4, 3, lambda t: np.nan_to_num(t[0]) / 7).collect()}
    assert len(got) == 99 and all(abs(r["p"] - (0 if k == (2, 3) else k[0] * k[1] % 7 / 7)) < 1e-9 and r["mask"] == (r["p"] >= 0.5) for k, r in got.items())


def test_context_and_answers(spark):
    text = "First 9999 here. Second one has 5000 in it! " + "x" * 200 + " 777777"
    f = spark.createDataFrame([(1, "A", 5000.0), (2, "B", 5001.0), (3, "Z", 0.0)], "ord int, fact_id string, value_num double")
    got = reports.verdicts(spark.createDataFrame([(1, text), (2, None), (3, "0.0 and -5000")], "id long, text string"), f, "id", "text").orderBy("id", "place").collect()
    assert [(r["id"], r["value"], r["verdict"]) for r in got] == [(1, 9999.0, "VIOLATION"), (1, 5000.0, "A"), (1, 777777.0, "VIOLATION"), (3, 0.0, "BASELINE_CONSTANT"), (3, -5000.0, "VIOLATION")]
    assert got[0]["sentence"] == "First 9999 here."
    q = spark.createDataFrame([("Which bridge is damaged?", "road", True), ("How many deaths?", "no", False), ("पुल", "road", True), (None, "brief", True)], "query string, category string, answerable boolean")
    a = {r["query"]: r for r in reports.asked(q, f).collect()}
    assert "2 of 5" in a["Which bridge is damaged?"]["answer"] and a["How many deaths?"]["refused"] == "casualties" and a["पुल"]["language"] == "ne"
    assert all(r["violations"] == 0 and r["score"] == 1.0 for r in a.values())
    h = {r["category"]: r for r in reports.harness(q, f).collect()}
    assert h["all"]["accuracy"] == 1.0 and h["no"]["refusals"] == 1 and h["all"]["hallucination"] == 0.0


def test_map_elements_without_known_nodes(spark):
    items = spark.createDataFrame([("node", 1, 1.0, 2.0, None, {"healthcare": "yes"}), ("way", 5, None, None, [1, 99], {"highway": "primary"}), ("way", 6, None, None, None, None)], catalog.ELEMENT)
    layers = catalog.map_layers(items, project=lambda lon, lat: (lon, lat))
    assert {k: d.count() for k, d in layers.items()} == {"roads": 0, "bridges": 0, "buildings": 0, "facilities": 1}
    assert catalog.elements(spark.createDataFrame([('{"elements":[]}',), ("junk",), (None,)], "json string")).count() == 0


def test_digest_of_facts_keeps_its_value(spark):
    f = spark.createDataFrame([(2, "B", 2.5), (1, "A", 1.0), (3, "C", None)], "ord int, fact_id string, value_num double")
    assert facts.digest(f).first()["digest"] == hashlib.sha256(b'{"A": 1.0, "B": 2.5}').hexdigest()


def test_sentences_keep_digits_at_their_ends(spark):
    text = "".join(f"{i}1 starts, ends with {i}{i}.  \n" for i in range(12)) + "a!\x0bb"
    got = spark.createDataFrame([(text,)], "text string").select(reports.sentences(F.col("text")).alias("s")).first()["s"]
    assert got == [*(f"{i}1 starts, ends with {i}{i}." for i in range(12)), "a!\x0bb"]


def test_verdicts_name_whole_sentences(spark):
    f = spark.createDataFrame([(1, "A", 0.5)], "ord int, fact_id string, value_num double")
    got = reports.verdicts(spark.createDataFrame([(1, "One 777. 1 of the roads has 6543")], "id long, text string"), f, "id", "text").orderBy("place").collect()
    assert [r["sentence"] for r in got] == ["One 777.", None, "1 of the roads has 6543"]


def test_verdicts_trim_unicode_blanks_and_stand_endless_numbers(spark):
    f = spark.createDataFrame([(1, "A", 0.5)], "ord int, fact_id string, value_num double")
    text = "\u00a0One 777. \u3000The road there has 6543\u2003\x01then there were 888 " + "9" * 320 + "\u00a0"
    got = reports.verdicts(spark.createDataFrame([(1, text)], "id long, text string"), f, "id", "text").orderBy("place").collect()
    assert [r["sentence"] for r in got] == ["One 777.", "The road there has 6543", "then there were 888 " + "9" * 320, "then there were 888 " + "9" * 320]
    assert got[-1]["value"] == float("inf")
