"""GeoJSON feature collections as rows, and rows as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "struct<type: string, coordinates: string>"
COLLECTION = f"type string, crs struct<properties: struct<name: string>>, features array<struct<type: string, properties: map<string, string>, geometry: {_GEOMETRY}>>"


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(file, index, props, geometry_type, coordinates, px, py, crs) of each feature of the collections at a path, one collection a file.

    px, py: the position itself, the middle vertex (index floor(n/2)) of a line, the first of a multi-polygon or polygon; null for other or no geometry.
    A file that is no collection raises an error.
    """
    raw = spark.read.schema(COLLECTION).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.input_file_name())
    kind = F.when((F.col("type") == "FeatureCollection") & F.col("features").isNotNull(), F.col("features")).otherwise(F.raise_error(F.concat(F.lit("no FeatureCollection: "), "file")))
    f = raw.select("file", "crs", F.posexplode(kind).alias("index", "f"))
    f = f.select("file", "index", F.col("f.properties").alias("props"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("crs.properties.name").alias("crs"))
    flat = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}
    at = F.lit(None).cast("array<double>")
    for name, depth in flat.items():
        typed = F.from_json("coordinates", "array<" * (depth + 1) + "double" + ">" * (depth + 1))
        if depth == 1:
            at = F.when(F.col("geometry_type") == name, F.try_element_at(typed, F.floor(F.size(typed) / 2).cast("int") + 1)).otherwise(at)
        else:
            first = typed
            for _ in range(depth):
                first = F.try_element_at(first, F.lit(1))
            at = F.when(F.col("geometry_type") == name, first).otherwise(at)
    f = f.withColumn("at", at)
    return f.withColumn("px", F.try_element_at("at", F.lit(1))).withColumn("py", F.try_element_at("at", F.lit(2))).drop("at")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as lines of JSON; absent values are left out."""
    df.write.mode("overwrite").json(path)
