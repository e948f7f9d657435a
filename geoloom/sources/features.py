"""Scans of map sources into DataFrames, with checks that give reasons instead of dropping rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def repeated_ids(df: DataFrame, key: str = "id") -> DataFrame:
    """(key, fault): ids that are null, not positive or repeated."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    fault = F.when(F.col(key).isNull(), "missing").when(F.col(key) <= 0, "not positive").when(F.col("_n") > 1, "repeated")
    return n.select(key, fault.alias("fault")).where("fault IS NOT NULL")


def reduced_tags(df: DataFrame, most: int = 1024, longest: int = 512, marker: str = "_source_error") -> DataFrame:
    """Entities whose tags are too many or too long keep the fitting ones (in key order) and a marker."""
    fits = lambda k, v: (F.char_length(k) <= longest) & (F.char_length(v) <= longest)
    fitting = F.map_filter("tags", fits)
    entries = F.slice(F.array_sort(F.map_entries(fitting)), 1, most)
    bad = (F.size("tags") > most) | (F.size(fitting) < F.size("tags"))
    marked = F.map_concat(F.map_from_entries(entries), F.create_map(F.lit(marker), F.lit("tags")))
    return df.withColumn("tags", F.when(bad, marked).otherwise(F.col("tags")))


def osm_xml(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Entities of one kind (node, way or relation) of an OSM XML file, tags as a map."""
    tag = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
    shape = {"node": f"_id LONG, _lon DOUBLE, _lat DOUBLE, {tag}", "way": f"_id LONG, nd ARRAY<STRUCT<_ref: LONG>>, {tag}", "relation": f"_id LONG, member ARRAY<STRUCT<_type: STRING, _ref: LONG, _role: STRING>>, {tag}"}[kind]
    rows = spark.read.format("xml").option("rowTag", kind).schema(shape).load(path)
    pairs = F.transform(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda x: F.struct(x["_k"].alias("key"), x["_v"].alias("value")))
    last = F.map_from_entries(F.filter(pairs, lambda x: x["key"].isNotNull()))
    own = {
        "node": [F.col("_lon").alias("lon"), F.col("_lat").alias("lat")],
        "way": [F.transform("nd", lambda x: x["_ref"]).alias("refs")],
        "relation": [F.transform("member", lambda x: F.struct(x["_type"].alias("type"), x["_ref"].alias("ref"), x["_role"].alias("role"))).alias("members")],
    }[kind]
    return rows.select(F.col("_id").alias("id"), *own, last.alias("tags"))


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, position, type, geometry, properties): features of FeatureCollection files; geometry and properties as JSON text."""
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    shape = "type STRING, features ARRAY<STRUCT<type: STRING, geometry: STRING, properties: STRING>>"
    parsed = docs.select("file", F.from_json("value", shape).alias("d")).where("d.type = 'FeatureCollection'")
    each = parsed.select("file", F.posexplode("d.features").alias("position", "f")).where("f.type = 'Feature'")
    return each.select("file", "position", F.get_json_object("f.geometry", "$.type").alias("type"), "f.geometry", "f.properties")


def flatten_collections(features: DataFrame, depth: int = 64) -> DataFrame:
    """Leaves of nested GeometryCollections in order: adds ``path``, the positions from the outermost collection."""
    work = features.withColumn("path", F.array().cast("array<int>"))
    done = None
    for _ in range(depth):
        leaf = work.where("type <> 'GeometryCollection'")
        done = leaf if done is None else done.unionByName(leaf)
        nested = work.where("type = 'GeometryCollection'")
        if nested.isEmpty():
            return done
        parts = F.from_json(F.get_json_object("geometry", "$.geometries"), "array<string>")
        keep = [c for c in work.columns if c not in ("geometry", "type", "path")]
        opened = nested.select(*keep, "path", F.posexplode(parts).alias("_at", "geometry"))
        work = opened.select(*keep, F.get_json_object("geometry", "$.type").alias("type"), "geometry", F.concat("path", F.array("_at")).alias("path"))
    raise ValueError(f"collections nest deeper than {depth}")


def strict_json(value: Column) -> Column:
    """The text if it is one JSON value without repeated keys, else null."""
    return F.when(F.try_parse_json(value).isNotNull(), value)


def scan_envelope(spark: SparkSession, path: str, box: tuple[float, float, float, float], wanted: list[str], required: list[str], key: str = "id") -> DataFrame:
    """Rows whose bbox struct meets the box; the columns of ``wanted`` that exist. Missing required columns raise."""
    rows = spark.read.parquet(path)
    if lost := [c for c in required if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(lost)}")
    west, south, east, north = box
    hit = (F.col("bbox.xmin") < east) & (F.col("bbox.xmax") > west) & (F.col("bbox.ymin") < north) & (F.col("bbox.ymax") > south)
    return rows.where(hit).select(key, *[c for c in wanted if c in rows.columns and c != key])


def pruned_files(manifest: DataFrame, box: tuple[float, float, float, float]) -> list[str]:
    """Paths of a manifest (path, west, south, east, north) that meet the box; a manifest has a row per file."""
    west, south, east, north = box
    hit = (F.col("west") <= east) & (F.col("east") >= west) & (F.col("south") <= north) & (F.col("north") >= south)
    return [r.path for r in manifest.where(hit).select("path").orderBy("path").toLocalIterator()]


def facility_csv(spark: SparkSession, path: str, name: str, lon: str, lat: str, box: tuple[float, float, float, float], encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(accepted, rejected, outside) rows of a facility list: name, lon, lat; rejected rows have a reason."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE")
    rows = raw.select(F.trim(name).alias("name"), F.expr(f"try_cast(trim(`{lon}`) AS DOUBLE)").alias("lon"), F.expr(f"try_cast(trim(`{lat}`) AS DOUBLE)").alias("lat"))
    reason = F.when(F.col("name").isNull() | (F.col("name") == ""), "no name").when(F.col("lon").isNull() | F.col("lat").isNull(), "no position").when(~F.col("lon").between(-180, 180) | ~F.col("lat").between(-90, 90), "range")
    judged = rows.withColumn("reason", reason)
    west, south, east, north = box
    inside = F.col("lon").between(west, east) & F.col("lat").between(south, north)
    fine = judged.where("reason IS NULL").drop("reason")
    return fine.where(inside), judged.where("reason IS NOT NULL"), fine.where(~inside)


def parsed_places(rows: DataFrame, column: str = "json") -> DataFrame:
    """(name, lon, lat, kind) of directory answers; rows without name or a valid position go."""
    d = rows.select(F.from_json(column, "name STRING, lon STRING, lat STRING, kind STRING").alias("d")).select("d.*")
    typed = d.select(F.substring(F.trim("name"), 1, 256).alias("name"), F.expr("try_cast(lon AS DOUBLE)").alias("lon"), F.expr("try_cast(lat AS DOUBLE)").alias("lat"), "kind")
    return typed.where((F.col("name") != "") & F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90))


def source_identity(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file that isn't empty (Spark lists no empty files)."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verified(descriptor: DataFrame, identity: DataFrame) -> DataFrame:
    """(name, verdict): declared files (name, bytes, sha256) against what is there: ok, changed, missing or unexpected."""
    there = identity.select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    both = descriptor.join(there, F.col("name") == F.col("_name"), "full_outer")
    same = (F.col("bytes") == F.col("_bytes")) & (F.col("sha256") == F.col("_sha"))
    verdict = F.when(F.col("_name").isNull(), "missing").when(F.col("name").isNull(), "unexpected").when(same, "ok").otherwise("changed")
    return both.select(F.coalesce("name", "_name").alias("name"), verdict.alias("verdict"))


def raster_faults(samples: DataFrame, rows: int, columns: int, low: float, high: float) -> DataFrame:
    """(tile, fault) of raster samples (tile, row, col, h): wrong count, outside the grid, or a height out of range."""
    out = ~F.col("row").between(0, rows - 1) | ~F.col("col").between(0, columns - 1)
    bad = F.isnan("h") | ~F.col("h").between(low, high)
    n = samples.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("out"), F.count_if(bad | F.col("h").isNull()).alias("bad"))
    fault = F.when(F.col("out") > 0, "grid").when(F.col("n") != rows * columns, "count").when(F.col("bad") > 0, "height")
    return n.select("tile", fault.alias("fault")).where("fault IS NOT NULL")


def document_table(spark: SparkSession, path: str, field: str, schema: T.StructType | str) -> DataFrame:
    """One field's records of map documents (JSON, multi-line), a row each with its position."""
    kind = schema.simpleString() if isinstance(schema, T.StructType) else f"struct<{schema}>"
    docs = spark.read.text(path, wholetext=True)
    each = docs.select(F.posexplode(F.from_json(F.get_json_object("value", f"$.{field}"), f"array<{kind}>")).alias("position", "r"))
    return each.select("position", "r.*")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key: the first in the order, for sources that repeat a record."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
