"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from geoloom.sources import features as S
from geoloom.sources import sinks


def test_osm_xml(spark, tmp_path):
    (tmp_path / "m.osm").write_text('<osm><node id="1" lon="9.0" lat="55.0"><tag k="amenity" v="bench"/></node><node id="2" lon="9.1" lat="55.1"/><way id="7"><nd ref="1"/><nd ref="2"/><tag k="highway" v="residential"/></way><relation id="9"><member type="way" ref="7" role="outer"/></relation></osm>')
    path = str(tmp_path / "m.osm")
    assert {(r.id, r.lon, r.tags.get("amenity")) for r in S.osm_xml(spark, path, "node").collect()} == {(1, 9.0, "bench"), (2, 9.1, None)}
    assert S.osm_xml(spark, path, "way").first().refs == [1, 2]
    assert S.osm_xml(spark, path, "relation").first().members[0].role == "outer"


def test_ids_and_tags(spark):
    assert {tuple(r) for r in S.repeated_ids(spark.createDataFrame([(1,), (1,), (0,), (None,), (3,)], "id long")).collect()} == {(1, "repeated"), (0, "not positive"), (None, "missing")}
    rows = spark.createDataFrame([(1, {"a": "x", "b": "y" * 20}), (2, {"a": "x"}), (3, None)], "id long, tags map<string,string>")
    got = {r.id: r.tags for r in S.reduced_tags(rows, longest=10).collect()}
    assert got == {1: {"a": "x", "_source_error": "tags"}, 2: {"a": "x"}, 3: None}


def test_geojson(spark, tmp_path):
    point = {"type": "Point", "coordinates": [1, 2]}
    nested = {"type": "GeometryCollection", "geometries": [point, {"type": "GeometryCollection", "geometries": [point, point]}]}
    doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": point, "properties": {"a": 1}}, {"type": "Feature", "geometry": nested, "properties": {"a": 2}}]}
    (tmp_path / "f.json").write_text(json.dumps(doc, indent=1))
    found = S.flatten_collections(S.geojson_features(spark, str(tmp_path / "f.json")))
    assert sorted((r.position, tuple(r.path), r.type) for r in found.collect()) == [(0, (), "Point"), (1, (0,), "Point"), (1, (1, 0), "Point"), (1, (1, 1), "Point")]
    values = spark.createDataFrame([('{"a":1}',), ('{"a":1,"a":2}',), ("{",), (None,)], "v string")
    assert [r[0] for r in values.select(S.strict_json(F.col("v"))).collect()] == ['{"a":1}', None, None, None]
    (tmp_path / "d.json").write_text(json.dumps({"roads": [{"id": "r1", "width": 3}, {"id": "r2"}]}))
    assert [tuple(r) for r in S.document_table(spark, str(tmp_path / "d.json"), "roads", "id: string, width: int").collect()] == [(0, "r1", 3), (1, "r2", None)]


def test_envelope_scan_and_manifest(spark, tmp_path):
    rows = [(i, f"n{i}", (float(i), float(i + 1), 0.0, 1.0)) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, name string, bbox struct<xmin: double, xmax: double, ymin: double, ymax: double>")
    df.write.parquet(str(tmp_path / "b"))
    found = S.scan_envelope(spark, str(tmp_path / "b"), (2.5, 0.2, 4.5, 0.8), ["name", "height"], ["bbox"])
    assert found.columns == ["id", "name"] and {r.id for r in found.collect()} == {2, 3, 4}
    assert "PushedFilters: [IsNotNull(bbox.xmin)" in found._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        S.scan_envelope(spark, str(tmp_path / "b"), (0, 0, 1, 1), [], ["geometry"])
    manifest = spark.createDataFrame([("b", 0.0, 0.0, 1.0, 1.0), ("a", 0.5, 0.5, 2.0, 2.0), ("c", 5.0, 5.0, 6.0, 6.0)], "path string, west double, south double, east double, north double")
    assert S.pruned_files(manifest, (0.0, 0.0, 1.0, 1.0)) == ["a", "b"]


def test_facilities_and_places(spark, tmp_path):
    (tmp_path / "f.csv").write_text('name,lat,lon\n"A, ""x""",55.5,9.5\nB,,\nC,91,9\nD,10,10\n', encoding="utf-8")
    fine, rejected, outside = S.facility_csv(spark, str(tmp_path / "f.csv"), "name", "lon", "lat", (9.0, 55.0, 10.0, 56.0))
    assert [r.name for r in fine.collect()] == ['A, "x"'] and [r.name for r in outside.collect()] == ["D"]
    assert {(r.name, r.reason) for r in rejected.collect()} == {("B", "no position"), ("C", "range")}
    places = spark.createDataFrame([('{"name":"X","lon":"9","lat":"55","kind":"city"}',), ('{"name":"","lon":"9","lat":"55"}',), ('{"name":"Y","lon":"500","lat":"55"}',)], "json string")
    assert [r.name for r in S.parsed_places(places).collect()] == ["X"]


def test_identity_publication_and_preflight(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.bin").write_bytes(b"abc")
    (tmp_path / "s" / "x.bin").write_bytes(b"x")
    found = S.source_identity(spark, str(tmp_path / "s"))
    sha = {r.path.rsplit("/", 1)[1]: r.sha256 for r in found.collect()}
    declared = spark.createDataFrame([("a.bin", 3, sha["a.bin"]), ("b.bin", 1, "0")], "name string, bytes long, sha256 string")
    assert {tuple(r) for r in S.verified(declared, found).collect()} == {("a.bin", "ok"), ("b.bin", "missing"), ("x.bin", "unexpected")}
    rows = spark.createDataFrame([("road", 1, 0, 0, 5, 5, "source"), ("road", 2, 1, 1, 9, 9, "class")], "field string, id long, x0 long, y0 long, x1 long, y1 long, basis string")
    assert tuple(sinks.write_layer(rows, str(tmp_path / "out")).first()) == ("road", 2, 0, 0, 9, 9, 1)
    with pytest.raises(Exception):
        sinks.publish(rows, str(tmp_path / "out"))
    need = sinks.tiles_for(spark.createDataFrame([(1, 9.95, 55.2, 10.1, 55.4)], "id long, west double, south double, east double, north double"), 0.1)
    assert {(r.tile_x, r.tile_y) for r in need.collect()} == {(9, 55), (10, 55)}
    there = need.where("tile_x = 9")
    assert {(r.tile_x, r.verdict) for r in sinks.preflight(need, there, need.limit(0)).collect()} == {(9, "present"), (10, "missing")}
    samples = spark.createDataFrame([(1, r, c, 5.0) for r in range(2) for c in range(2)] + [(2, 0, 0, 5.0), (3, 9, 0, 5.0)], "tile int, row int, col int, h double")
    assert {tuple(r) for r in S.raster_faults(samples, 2, 2, 0, 10).collect()} == {(2, "count"), (3, "grid")}
