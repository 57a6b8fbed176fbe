"""File inventory, GeoJSON features, and CSV and Parquet sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.operators.sampling import sample_numbering

from .scratch import cut_lineage, scratch_dir

#: Coordinates stay text until the type says how they nest.
_GEOMETRY = "type:string,coordinates:string,geometries:string"
FEATURE_SCHEMA = f"features array<struct<geometry:struct<{_GEOMETRY}>,properties:map<string,string>>>, _corrupt_record string"

def inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, dir, name, stem, ext, length) of the files under root whose name matches glob; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select(
        "path", F.get(parts, F.size(parts) - 2).alias("dir"), name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"),
        F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("ext"), "length")


def read_features(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, text) of GeoJSON files, one row a file; very large layers should arrive as one feature a line instead."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_feature_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, text) of layers with one feature a line, of any size: tasks read parts of a file. A record separator before a feature goes."""
    lines = spark.read.text(paths).select(F.input_file_name().alias("file"), F.regexp_replace("value", "^\x1e", "").alias("text"))
    return lines.where("trim(text) <> ''")


def parse_feature_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, rejected) of rows with a column text that holds one feature each.

    features has geom_type, coordinates and geometries as text, properties (all of them, as a map of texts) and class_name, as
    parse_features gives them; rejected has text and reason: unreadable, or no_geometry for a null or empty one. Null texts are unreadable.
    """
    schema = f"geometry struct<{_GEOMETRY}>, properties map<string,string>, _corrupt_record string"
    parsed = lines.withColumn("_f", F.from_json("text", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    filled = F.coalesce(F.col("_f.geometry.coordinates"), F.col("_f.geometry.geometries"), F.lit("[]")) != "[]"
    reason = F.when(F.col("_f").isNull() | F.col("_f._corrupt_record").isNotNull(), "unreadable").when(F.col("_f.geometry").isNull() | ~filled, "no_geometry")
    judged = parsed.withColumn("reason", reason)
    own = [c for c in lines.columns if c != "text"]
    features = judged.where("reason IS NULL").select(
        *own, F.col("_f.geometry.type").alias("geom_type"), F.col("_f.geometry.coordinates").alias("coordinates"), F.col("_f.geometry.geometries").alias("geometries"),
        F.col("_f.properties").alias("properties"), F.col("_f.properties")["class_name"].alias("class_name"))
    return features, judged.where("reason IS NOT NULL").select(*own, "text", "reason")


def to_feature_lines(objects: DataFrame) -> DataFrame:
    """(object_id, text): the features of to_feature_text one a row, those cut short as they are."""
    return to_feature_text(objects).select("object_id", F.regexp_replace("text", r'^\{"features":\[|\]\}$', "").alias("text"))


def to_feature_text(objects: DataFrame) -> DataFrame:
    """(object_id, text): each object as a FeatureCollection; every 17th text is cut short and so unreadable.

    By the object's number the geometry is a polygon, every second with a hole, a multi-polygon of two boxes, a point, or a
    collection of a point and a polygon.
    """
    def corner(x: str, y: str) -> Column:
        return F.array(F.col("cx") + F.col("hw") * F.lit(float(x)), F.col("cy") + F.col("hh") * F.lit(float(y)))

    def box(a: str, b: str) -> Column:
        return F.array(F.array(corner(a, a), corner(b, a), corner(b, b), corner(a, b), corner(a, a)))

    def geometry(kind: str, coordinates: Column) -> Column:
        return F.concat(F.lit('{"type":"' + kind + '","coordinates":'), F.to_json(coordinates), F.lit("}"))

    holed = F.when(F.col("object_id") % 8 == 0, F.concat(box("-1", "1"), box("-0.5", "0.25"))).otherwise(box("-1", "1"))
    polygon, point = geometry("Polygon", holed), geometry("Point", F.array("cx", "cy"))
    both = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), point, F.lit(","), polygon, F.lit("]}"))
    kind = F.col("object_id") % 4
    shape = F.when(kind == 0, polygon).when(kind == 1, geometry("MultiPolygon", F.array(box("-1", "0"), box("0", "1")))).when(kind == 2, point).otherwise(both)
    text = F.concat(F.lit('{"features":[{"geometry":'), shape, F.lit(',"properties":'), F.to_json(F.create_map(F.lit("class_name"), F.col("class_name"))), F.lit("}]}"))
    return objects.select("object_id", F.when(F.col("object_id") % 17 == 0, F.substring(text, 1, 40)).otherwise(text).alias("text"))


def parse_features(texts: DataFrame) -> DataFrame:
    """Features of rows with a column text: feature_idx, geom_type, coordinates and geometries as text, properties (a map of texts), class_name.

    Unreadable texts go, and features without a geometry or with an empty one. One file may mix types.
    """
    parsed = texts.withColumn("_j", F.from_json("text", FEATURE_SCHEMA, {"mode": "PERMISSIVE"})).where("_j._corrupt_record IS NULL")
    rows = parsed.select("*", F.posexplode("_j.features").alias("feature_idx", "_f"))
    filled = F.coalesce(F.col("_f.geometry.coordinates"), F.col("_f.geometry.geometries"), F.lit("[]")) != "[]"
    return rows.where(F.col("_f.geometry").isNotNull() & filled).select(
        *[c for c in texts.columns if c != "text"], "feature_idx", F.col("_f.geometry.type").alias("geom_type"), F.col("_f.geometry.coordinates").alias("coordinates"),
        F.col("_f.geometry.geometries").alias("geometries"), F.col("_f.properties").alias("properties"), F.col("_f.properties")["class_name"].alias("class_name"))


_RINGS = "array<array<array<double>>>"


def _parts(kind: Column, coordinates: Column) -> Column:
    """array<struct<part_type, rings>> of a geometry given as text; null for other types."""
    def part(name: str, rings: Column) -> Column:
        return F.struct(F.lit(name).alias("part_type"), rings.alias("rings"))

    found = F.when(kind == "Polygon", F.array(part("Polygon", F.from_json(coordinates, _RINGS))))
    found = found.when(kind == "MultiPolygon", F.transform(F.from_json(coordinates, f"array<{_RINGS}>"), lambda p: part("Polygon", p)))
    return found.when(kind == "Point", F.array(part("Point", F.array(F.array(F.from_json(coordinates, "array<double>"))))))


def _members(collections: DataFrame) -> DataFrame:
    """One row for every geometry of geometry collections that is none itself, however deep, with _feature and its _path.

    Collections are opened one level a round until none is left.
    """
    rows = cut_lineage(collections.withColumn("_feature", F.monotonically_increasing_id()).withColumn("_path", F.array().cast("array<int>")))
    kept = [c for c in rows.columns if c not in ("geom_type", "coordinates", "geometries", "_path")]
    plain = None
    while plain is None or not rows.isEmpty():
        inner = rows.select(*kept, "_path", F.posexplode(F.from_json("geometries", f"array<struct<{_GEOMETRY}>>")).alias("_at", "_g"))
        inner = inner.select(*kept, F.concat("_path", F.array("_at")).alias("_path"), F.col("_g.type").alias("geom_type"), F.col("_g.coordinates").alias("coordinates"), F.col("_g.geometries").alias("geometries"))
        found = inner.where("geom_type <> 'GeometryCollection'")
        plain = found if plain is None else plain.unionByName(found)
        rows = inner.where("geom_type = 'GeometryCollection'")
    return plain


def _ring(points: Column) -> Column:
    """A ring of pairs as points x and y, without the last one if it repeats the first."""
    made = F.transform(points, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    closed = (F.size(points) > 1) & (F.get(points, F.lit(0)) == F.element_at(points, -1))
    return F.slice(made, F.lit(1), F.size(points) - F.when(closed, 1).otherwise(0))


def explode_parts(features: DataFrame, collections: bool = True) -> DataFrame:
    """One row a part of each feature: part_id, part_type (Polygon or Point), rings (the outer one and its holes, of points x and y, not closed), ring (the outer one) and n_holes.

    Multi-polygons fall into polygons, and collections, unless collections is false, into the parts of their members at any depth; other types
    and empty parts give no row.
    """
    if collections:
        features = cut_lineage(features)  # read twice below, parsed once
    own = [c for c in features.columns if c not in ("coordinates", "geometries", "geom_type")]
    parts = _parts(F.col("geom_type"), F.col("coordinates"))
    rows = features.select(*own, "geom_type", F.posexplode(parts).alias("part_id", "_p"))
    if collections:
        held = features.where("geom_type = 'GeometryCollection'")
        inner = _members(held).select(*own, "_feature", "_path", F.posexplode(parts).alias("_at", "_p"))
        order = Window.partitionBy("_feature").orderBy("_path", "_at")
        numbered = inner.select(*own, F.lit("GeometryCollection").alias("geom_type"), (F.row_number().over(order) - 1).alias("part_id"), "_p")
        rows = rows.unionByName(numbered)
    rows = rows.where("size(_p.rings) > 0 AND size(_p.rings[0]) > 0").withColumn("rings", F.transform("_p.rings", _ring))
    return rows.select(*[c for c in rows.columns if c != "_p" and c != "rings"], F.col("_p.part_type").alias("part_type"), "rings", F.col("rings")[0].alias("ring"), (F.size("rings") - 1).alias("n_holes"))


def _folder(df: DataFrame) -> str:
    return f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"


def csv_roundtrip(df: DataFrame) -> DataFrame:
    """Write CSV with a header and read it back with the same schema."""
    path = _folder(df)
    df.write.option("header", True).csv(path)
    return df.sparkSession.read.schema(df.schema).option("header", True).csv(path)


def export_samples(df: DataFrame, path: str, partitions: list[str]) -> None:
    df.write.partitionBy(*partitions).parquet(path)


def export_roundtrip(df: DataFrame, partitions: list[str]) -> DataFrame:
    path = _folder(df)
    export_samples(df, path, partitions)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export_dataset(samples: DataFrame, labels: DataFrame, runs: DataFrame, path: str) -> None:
    """Write a training set: samples with their label text by split and region, mask runs by split, and the map of renamed samples.

    samples: sample_id, split, region, ...; labels: sample_id, line; runs: sample_id, row, c0, c1, class_id. Samples are numbered
    over split and region and named by that; a sample without labels has an empty text. Folders: samples, masks, renamed (CSV).
    """
    named = cut_lineage(sample_numbering(samples, ["split", "region"], ["sample_id"]))
    text = labels.groupBy("sample_id").agg(F.concat_ws("\n", F.array_sort(F.collect_list("line"))).alias("label_text"))
    full = named.join(text, "sample_id", "left").withColumn("label_text", F.coalesce("label_text", F.lit("")))
    export_samples(full, f"{path}/samples", ["split", "region"])
    export_samples(runs.join(named.select("sample_id", "split", "new_stem"), "sample_id"), f"{path}/masks", ["split"])
    named.select("sample_id", "new_stem").write.option("header", True).csv(f"{path}/renamed")


def export_summary(samples: DataFrame, labels: DataFrame, runs: DataFrame) -> DataFrame:
    """(split, n, n_lines, pixels, renamed) of a training set that was written and read again."""
    path = _folder(samples)
    export_dataset(samples, labels, runs, path)
    read = samples.sparkSession.read
    back = read.parquet(f"{path}/samples")
    lines = F.sum(F.when(F.col("label_text") == "", 0).otherwise(F.size(F.split("label_text", "\n"))))
    names = read.option("header", True).csv(f"{path}/renamed").withColumn("split", F.regexp_extract("new_stem", "^([a-z]+)_", 1))
    per = back.groupBy("split").agg(F.count("*").alias("n"), lines.alias("n_lines"))
    pixels = read.parquet(f"{path}/masks").groupBy("split").agg(F.sum(F.col("c1") - F.col("c0")).alias("pixels"))
    return per.join(pixels, "split", "left").join(names.groupBy("split").agg(F.count("*").alias("renamed")), "split")
