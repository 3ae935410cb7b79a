"""Polling-station polygons (KML through the built-in XML source, GeoJSON through the JSON source),
their bounds and the station colour table of the forecast map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from votepanel.functions.codes import extract_station_number, station_code_candidates


def _points(text_col) -> F.Column:
    """``lon,lat[,alt]`` tuples separated by blanks -> array<struct<lon,lat>>."""
    tuples = F.filter(F.split(F.trim(text_col), r"\s+"), lambda t: t != "")
    return F.transform(tuples, lambda t: F.struct(F.split(t, ",")[0].cast("double").alias("lon"), F.split(t, ",")[1].cast("double").alias("lat")))


def read_kml_polygons(spark: SparkSession, path: str) -> DataFrame:
    """One row per outer ring: label, ring index, points. Placemarks with one Polygon or a
    MultiGeometry of polygons are both read (rowTag = Placemark)."""
    df = spark.read.format("xml").option("rowTag", "Placemark").load(path)
    rings = []
    if "Polygon" in df.columns:
        rings.append(df.select(F.col("name").cast("string").alias("label"),
                               F.array(F.col("Polygon.outerBoundaryIs.LinearRing.coordinates").cast("string")).alias("_r")))
    if "MultiGeometry" in df.columns:
        rings.append(df.select(F.col("name").cast("string").alias("label"),
                               F.col("MultiGeometry.Polygon.outerBoundaryIs.LinearRing.coordinates").cast("array<string>").alias("_r")))
    out = rings[0]
    for r in rings[1:]:
        out = out.unionByName(r)
    return out.select("label", F.posexplode_outer("_r").alias("ring", "_t")).where(F.col("_t").isNotNull()).select("label", "ring", _points(F.col("_t")).alias("points"))


def read_geojson_polygons(spark: SparkSession, path: str) -> DataFrame:
    """FeatureCollection -> label (``properties.name``), ring index, outer ring points, for Polygon and
    MultiPolygon geometries."""
    # coordinates nest deeper for MultiPolygon than for Polygon: read them as raw JSON text, then parse
    # with the schema of each geometry type
    schema = "features array<struct<properties: struct<name: string>, geometry: struct<type: string, coordinates: string>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    feats = raw.select(F.explode("features").alias("f")).select(
        F.col("f.properties.name").alias("label"), F.col("f.geometry.type").alias("gtype"), F.col("f.geometry.coordinates").alias("c")
    )
    poly = feats.where(F.col("gtype") == "Polygon").select("label", F.from_json("c", "array<array<array<double>>>").getItem(0).alias("ring0"), F.lit(0).alias("ring"))
    multi = feats.where(F.col("gtype") == "MultiPolygon").select(
        "label", F.posexplode(F.from_json("c", "array<array<array<array<double>>>>")).alias("ring", "p")
    ).select("label", F.col("p").getItem(0).alias("ring0"), "ring")
    both = poly.unionByName(multi)
    return both.select("label", "ring", F.transform("ring0", lambda xy: F.struct(xy[0].alias("lon"), xy[1].alias("lat"))).alias("points"))


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON or KML by suffix (the original read GeoJSON only, Q29)."""
    return read_kml_polygons(spark, path) if path.lower().endswith(".kml") else read_geojson_polygons(spark, path)


def geo_bounds(polys: DataFrame) -> DataFrame:
    """Min / max longitude and latitude over all rings, and the centre."""
    pts = polys.select(F.explode("points").alias("p"))
    b = pts.agg(F.min("p.lon").alias("min_lon"), F.min("p.lat").alias("min_lat"), F.max("p.lon").alias("max_lon"), F.max("p.lat").alias("max_lat"))
    return b.select("*", ((F.col("min_lat") + F.col("max_lat")) / 2).alias("center_lat"), ((F.col("min_lon") + F.col("max_lon")) / 2).alias("center_lon"))


def map_colour_table(polys: DataFrame, colours: DataFrame, commune_code: str) -> DataFrame:
    """Polygon label -> station number -> station key (``town-NNNN`` or ``town-NNN``) -> colour key;
    labels without a number or without a forecast get ``no_data``. One row per label: the four-digit key goes first."""
    forms = station_code_candidates(F.lit(commune_code), extract_station_number("label"))
    labels = polys.select("label").distinct()
    keys = labels.select("label", F.posexplode(F.array(*forms)).alias("form", "code_bv"))
    hits = keys.join(colours.select("code_bv", "colour_key"), "code_bv").groupBy("label").agg(F.min(F.struct("form", "code_bv", "colour_key")).alias("hit"))
    return labels.join(hits, "label", "left").select("label", "hit.code_bv", F.coalesce("hit.colour_key", F.lit("no_data")).alias("colour_key"))
