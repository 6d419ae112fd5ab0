"""Tables on storage that Spark reads: layers, GeoJSON, array catalogs, checksummed artifacts."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrane.functions.contracts import canonical_json
from terrane.operators.grid import finite

_SHAPE = "struct<type: string, coordinates: string, geometries: array<struct<type: string, coordinates: string>>>"
GEOJSON = f"type string, coordinates string, geometries array<struct<type: string, coordinates: string>>, geometry {_SHAPE}, features array<struct<geometry: {_SHAPE}>>"
RINGS = "array<array<struct<x: double, y: double>>>"


def read_layer(spark: SparkSession, path: str, value: str = "value") -> DataFrame:
    """row, col, value of a layer in Parquet; missing values are NULL."""
    return spark.read.parquet(path).select("row", "col", finite(F.col(value)).alias("value"))


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Parquet with zstd; Spark's _SUCCESS file comes last."""
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path (name in the folder), bytes, sha256 of the data files of a folder, each hashed in a task."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/data/", -1)
    return files.select(name.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def publish_with_manifest(df: DataFrame, path: str, contracts: dict[str, dict], grid: dict | None = None, partition: str | None = None) -> None:
    """df under path/data, then path/manifest: a row of JSON for each file, with its bytes and hash, and of the columns' contracts.

    A column's contract, and the grid, also go into the metadata of the files, so a reader has them without the manifest.
    The manifest comes last: a folder without one isn't published. A contract of a column that df lacks raises, and so does a
    path that was published before.
    """
    if missing := sorted(set(contracts) - set(df.columns)):
        raise ValueError(f"contracts of columns that are not there: {', '.join(missing)}")
    for c in df.columns:
        df = df.withMetadata(c, {k: canonical_json(v) for k, v in (("contract", contracts.get(c)), ("grid", grid)) if v is not None})
    publish(df, f"{path}/data", partition)
    told = canonical_json({"contracts": contracts, "grid": grid, "columns": {f.name: f.dataType.simpleString() for f in df.schema}})
    _files(df.sparkSession, f"{path}/data").withColumn("told", F.lit(told)).write.json(f"{path}/manifest")


def unpublished(spark: SparkSession, path: str) -> DataFrame:
    """path, problem of the files of a published folder that are missing, differ from the manifest or aren't in it."""
    manifest = spark.read.schema("path string, bytes long, sha256 string, told string").json(f"{path}/manifest")
    rows = manifest.select("path", "sha256").join(_files(spark, f"{path}/data").select("path", F.col("sha256").alias("found")), "path", "full_outer")
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "differs")
    return rows.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def contract_of(df: DataFrame, column: str) -> dict | None:
    """The contract that publish_with_manifest() gave a column, as read from its files."""
    text = df.schema[column].metadata.get("contract")
    return json.loads(text) if text else None


def selected(cells: DataFrame) -> DataFrame:
    """grid_cell_id, row, col, decision of the selected cells; without any the schema stays."""
    return cells.where("decision = 1").select("grid_cell_id", "row", "col", F.lit(1).cast("short").alias("decision"))


def polygons_in(text: Column) -> Column:
    """Polygons (arrays of rings of x, y) of GeoJSON text: collections, features, bare geometries, multi-part ones and
    geometry collections; other geometries have none. NULL and what is no GeoJSON give an empty array."""
    g = F.from_json(text, GEOJSON)
    none = F.array().cast(f"array<{_SHAPE}>")
    bare = F.struct(g["type"].alias("type"), g["coordinates"].alias("coordinates"), g["geometries"].alias("geometries"))
    shapes = F.concat(F.coalesce(F.transform(g["features"], lambda f: f["geometry"]), none), F.array(g["geometry"], bare))
    flat = F.flatten(F.transform(F.array_compact(shapes), lambda x: F.concat(F.array(F.struct(x["type"].alias("type"), x["coordinates"].alias("coordinates"))), F.coalesce(x["geometries"], F.array().cast("array<struct<type: string, coordinates: string>>")))))
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    rings_of = lambda polygon: F.transform(polygon, lambda ring: F.transform(ring, point))
    one = lambda x: F.array(rings_of(F.from_json(x["coordinates"], "array<array<array<double>>>")))
    many = lambda x: F.transform(F.from_json(x["coordinates"], "array<array<array<array<double>>>>"), rings_of)
    parts = F.transform(flat, lambda x: F.when(x["type"] == "Polygon", one(x)).when(x["type"] == "MultiPolygon", many(x)))
    return F.coalesce(F.array_compact(F.flatten(F.array_compact(parts))), F.array().cast(f"array<{RINGS}>"))


def area_in(text: Column) -> Column:
    """polygons_in(text); text without any polygon raises."""
    found = polygons_in(text)
    return F.when(F.size(found) > 0, found).otherwise(F.raise_error(F.lit("no polygon in the geometry")).cast(f"array<{RINGS}>"))


def rings(geojson: DataFrame, column: str) -> DataFrame:
    """The columns of geojson with polygon_no, ring_no and ring of every polygon in its text."""
    rows = geojson.select(*geojson.columns, F.posexplode(polygons_in(F.col(column))).alias("polygon_no", "polygon"))
    return rows.select(*geojson.columns, "polygon_no", F.posexplode("polygon").alias("ring_no", "ring"))


def tile_records(rows: DataFrame, column: str) -> DataFrame:
    """tile_id, row_start, row_stop, col_start, col_stop, count, positive, layers (map of a layer to its cells) of JSON
    records of tiles; what has no tile_id gives no row."""
    record = F.from_json(column, "tile_id string, row_start long, row_stop long, col_start long, col_stop long, count long, positive double, layers map<string, long>")
    return rows.select(record.alias("r")).select("r.*").where("tile_id IS NOT NULL")


def coordinates_differ(left: DataFrame, right: DataFrame, axis: str, tolerance: float) -> DataFrame:
    """at, and both coordinates, where two arrays of coordinates (at, axis) lie further apart than the tolerance or one has none."""
    rows = left.select("at", F.col(axis).alias("a")).join(right.select("at", F.col(axis).alias("b")), "at", "full_outer")
    return rows.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def catalog(arrays: DataFrame, term: str = "", groups: tuple[str, ...] = ()) -> DataFrame:
    """path, group, name of the arrays whose path or name holds the term (trimmed, without case) and whose group has one of
    the segments, sorted by path."""
    text = term.strip().lower()
    hit = F.lower("path").contains(text) | F.lower("name").contains(text)
    hit = hit & F.arrays_overlap(F.split(F.lower("group"), "/"), F.array(*map(F.lit, groups))) if groups else hit
    return arrays.where(hit).orderBy("path")


def arrays_in(metadata: DataFrame, column: str) -> DataFrame:
    """path, group, name of the data arrays in consolidated array metadata: coordinates and malformed entries are left out, sorted by path."""
    entries = metadata.select(F.explode(F.from_json(F.get_json_object(column, "$.metadata"), "map<string,string>")).alias("key", "value"))
    path = F.regexp_replace("key", r"/\.zarray$", "")
    rows = entries.where(F.col("key").endswith("/.zarray") & F.get_json_object("value", "$.shape").isNotNull()).select(path.alias("path"))
    rows = rows.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.col("name").isin("x", "y", "spatial_ref"))
    return rows.withColumn("group", F.regexp_replace("path", "/?[^/]+$", "")).orderBy("path")


def content_root(files: DataFrame) -> DataFrame:
    """content_sha256 of a set of files (path, content): hash of their sorted paths and hashes."""
    each = F.sort_array(F.collect_list(F.concat_ws(":", "path", F.sha2("content", 256))))
    return files.agg(F.sha2(F.array_join(each, "\n"), 256).alias("content_sha256"))


def corrupt(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, problem: files of a manifest (path, sha256) that are missing or differ, and files it doesn't name."""
    have = files.select("path", F.sha2("content", 256).alias("found"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("found") != F.col("sha256"), "differs")
    return manifest.join(have, "path", "full_outer").select("path", problem.alias("problem")).where("problem IS NOT NULL")


def inside(path: Column) -> Column:
    """Whether a relative path stays in its folder."""
    return ~path.startswith("/") & ~F.arrays_overlap(F.split(path, "/"), F.array(F.lit("..")))
