"""Readers and writers of map layers."""

import json

from pyspark.sql import functions as F

from tidemark.sources import layers


def test_graphml(spark, tmp_path):
    p = tmp_path / "g.graphml"
    p.write_text('<graphml><graph><node id="1"/><edge source="1" target="2"><data key="d1">12.5</data><data key="d2">LINESTRING (1 2, 3.5 -4)</data></edge><edge source="2" target="3"/></graph></graphml>')
    rows = {r["a"]: r for r in layers.read_graphml(spark, str(p)).withColumn("points", layers.wkt_points(F.col("attributes")["d2"])).collect()}
    assert rows["1"]["attributes"]["d1"] == "12.5" and [(q["x"], q["y"]) for q in rows["1"]["points"]] == [(1.0, 2.0), (3.5, -4.0)]
    assert rows["2"]["attributes"] == {}


def test_geojson_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", float("nan"), [(1.123456789, 2.0), (3.0, 4.0)]), (2, None, 1.5, [(5.0, 6.0)])], "id int, name string, v double, g array<struct<x:double,y:double>>")
    lines = [json.loads(r["value"]) for r in layers.geojson_features(df, "g", ["id", "name", "v"]).collect()]
    assert lines[0]["geometry"] == {"type": "LineString", "coordinates": [[1.1234568, 2.0], [3.0, 4.0]]} and lines[0]["properties"]["v"] == 0.0
    assert lines[1]["geometry"] == {"type": "Point", "coordinates": [5.0, 6.0]}
    p = tmp_path / "x.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": lines}))
    got = layers.read_geojson(spark, str(p)).collect()
    assert [r["kind"] for r in got] == ["LineString", "Point"] and got[1]["properties"]["id"] == "2"
