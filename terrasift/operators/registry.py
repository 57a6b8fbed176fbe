"""Registries of files, rasters and objects: discovery, picking, summaries and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions import names
from terrasift.functions.geometry import area


def region_crs(regions: DataFrame) -> DataFrame:
    return regions.select("region_id", "region", names.epsg(F.col("crs_urn")).alias("epsg"))


def discover_regions(files: DataFrame, sidecar: str = "UTM") -> DataFrame:
    """(region_folder, markup_dir, modalities, n_rasters): regions with the CRS sidecar, a markup folder and a modality folder.

    files: region_folder, sub_folder (null for files of the region itself), stem and ext. A folder named as markup is never one
    of a modality; of several the greatest name counts. n_rasters: raster files in folders of a modality.
    """
    markup = F.lower("sub_folder").contains("разметка")
    modality = F.when(~markup, F.nullif(names.modality_by_rule(F.col("sub_folder")), F.lit("Unknown")))
    grouped = files.groupBy("region_folder").agg(
        F.bool_or(F.col("sub_folder").isNull() & (F.col("stem") == sidecar) & (F.col("ext") == "json")).alias("has_crs"),
        F.max(F.when(markup, F.col("sub_folder"))).alias("markup_dir"),
        F.array_join(F.array_sort(F.collect_set(modality)), ",").alias("modalities"),
        F.count_if(modality.isNotNull() & F.col("ext").isin("tif", "tiff")).alias("n_rasters"))
    return grouped.where("has_crs AND markup_dir IS NOT NULL AND modalities <> ''").drop("has_crs")


def pick_rasters(registry: DataFrame, all_of: str = "SpOr") -> DataFrame:
    """One raster per region and modality: a lidar file marked _g first, else the first by name; all files of `all_of`."""
    low = F.lower("stem")
    marked = (F.col("modality") == "Li") & (low.endswith("_g") | low.contains("_g_"))
    order = Window.partitionBy("region", "modality").orderBy(marked.desc(), "file_name")
    ranked = registry.withColumn("rn", F.row_number().over(order))
    return ranked.where((F.col("rn") == 1) | (F.col("modality") == all_of))


def file_registry(files: DataFrame) -> DataFrame:
    modality = names.modality_from_path(F.col("stem"), F.col("region_folder"))
    return files.select(
        "file_id", "region_folder", "stem", "ext", names.region_from_folder(F.col("region_folder")).alias("region"),
        modality.alias("modality"), F.concat_ws(".", "stem", "ext").alias("file_name"))


def objects_by_class(files: DataFrame) -> DataFrame:
    """Annotation files whose last word is a target class; border files are skipped."""
    word = names.class_word(F.col("stem"))
    found = names.lookup(word, names.CLASS_OF_WORD)
    rows = files.where((F.col("ext") == "geojson") & ~F.col("stem").contains("границы"))
    return rows.select("file_id", "stem", word.alias("class_raw"), found.alias("class_norm")).where("class_norm IS NOT NULL")


#: Columns that sample metadata must have, if only after the repair.
METADATA = ("sample_id", "region", "modality", "class_name", "height", "width", "n_objects_in_patch")


def normalize_metadata(samples: DataFrame, id_col: str = "sample_id", required: tuple[str, ...] = ()) -> DataFrame:
    """Six-digit sample keys, and what older metadata lack: class_name from kurgan_type, class_id and label from class_name.

    Each is filled in only where the column is absent; class ids are integers, null for unknown classes. required: columns
    without which the metadata are refused (METADATA for those of a whole dataset).
    """
    if "class_name" not in samples.columns and "kurgan_type" in samples.columns:
        renamed = names.lookup(F.col("kurgan_type"), {"whole": "kurgany_tselye", "damaged": "kurgany_povrezhdennye"})
        samples = samples.withColumn("class_name", F.coalesce(renamed, F.col("kurgan_type")))
    if "class_id" not in samples.columns and "class_name" in samples.columns:
        samples = samples.withColumn("class_id", names.lookup(F.col("class_name"), names.CLASS_IDS))
    missing = [c for c in required if c not in samples.columns]
    if missing:
        raise ValueError(f"the metadata lack the columns {missing}")
    samples = samples.withColumn(id_col, names.sample_key(F.col(id_col)))
    if "class_id" in samples.columns:
        samples = samples.withColumn("class_id", F.col("class_id").cast("int"))
    if "label" not in samples.columns and "class_name" in samples.columns:
        samples = samples.withColumn("label", F.coalesce(F.col("class_name"), F.lit("unknown")))
    return samples


def geometry_filter(objects: DataFrame, classes: list[str], kinds: tuple[str, ...] = ("Polygon", "MultiPolygon")) -> DataFrame:
    """Objects of the classes whose geometry is of a kind (where geom_type is given), not null, of 3 points or more, and has an area."""
    ring = F.col("ring")
    ok = ring.isNotNull() & (F.size(ring) >= 3) & (area(ring) > 0) & F.col("class_name").isin(classes)
    return objects.where(ok & F.col("geom_type").isin(*kinds) if "geom_type" in objects.columns else ok)


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)
    return counts if top is None else counts.limit(top)


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1))).na.fill(0, values)


def region_profile(df: DataFrame) -> DataFrame:
    return df.groupBy("region").agg(F.count("*").alias("n"), F.countDistinct("class_name").alias("n_classes")).orderBy(F.desc("n"), "region")


def describe_by_group(df: DataFrame, group: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    stats = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q.alias("q"), F.max(value).alias("max"))
    return stats.select(group, "n", "mean", "std", "min", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


def raster_summary(registry: DataFrame) -> DataFrame:
    """Files, modalities and lidar channels per region."""
    m = F.col("modality")
    suffix = names.map_suffix(F.col("stem"), m)
    flags = [F.bool_or(F.coalesce(m == k, F.lit(False))).alias(f"has_{k.lower()}") for k in names.TARGET_MODALITIES]
    return registry.groupBy("region").agg(
        F.count("*").alias("n_files"), F.countDistinct(m).alias("n_modalities"), F.count_if(m == "Li").alias("n_li"),
        F.array_join(F.array_sort(F.collect_set(m)), ",").alias("modalities"), F.array_join(F.array_sort(F.collect_set(suffix)), ",").alias("li_suffixes"), *flags)


def class_pixel_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    sums = df.agg(*[F.sum(c).alias(c) for c in columns])
    return sums.unpivot([], columns, "name", "pixels").orderBy(F.desc("pixels"), "name")


def flag_counts(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & b).alias("n_both"), F.count_if(~a & ~b).alias("n_none"))


def coverage_audit(registry: DataFrame, few: int = 5) -> DataFrame:
    raster = F.col("ext") != "geojson"
    grouped = registry.groupBy("region").agg(
        F.bool_or(F.col("ext") == "geojson").alias("has_markup"),
        F.bool_or(raster & F.coalesce(F.col("modality") == "Li", F.lit(False))).alias("has_li"),
        F.bool_or(raster & F.coalesce(F.col("modality") == "Ae", F.lit(False))).alias("has_ae"),
        F.count_if(raster).alias("n_rasters"))
    missing = F.concat_ws(",", F.when(~F.col("has_markup"), "markup"), F.when(~F.col("has_li"), "Li"), F.when(~F.col("has_ae"), "Ae"))
    return grouped.select("*", (F.col("n_rasters") < few).alias("few_rasters"), missing.alias("missing"))


def one_row_per(df: DataFrame, key: str, order: list) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_rn = 1").drop("_rn")


def facet_query(df: DataFrame, spec: dict, order: list | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows that match every facet of spec: a value (or None for all), a list of values, or a (low, high) range.

    A range that ends with the word "null" also takes nulls; a true or false facet also matches the text "True" or "False".
    """
    for column, wanted in spec.items():
        c = F.col(column)
        if wanted is None:
            continue
        if isinstance(wanted, bool):
            df = df.where(F.lower(c.cast("string")) == str(wanted).lower())
        elif isinstance(wanted, list):
            df = df.where(c.isin(wanted))
        elif isinstance(wanted, tuple):
            inside = c.between(wanted[0], wanted[1])
            df = df.where(inside | c.isNull() if wanted[2:] == ("null",) else inside)
        else:
            df = df.where(c == wanted)
    if order:
        df = df.orderBy(*order)
    return df.offset(offset).limit(limit) if limit is not None else df


def facet_values(df: DataFrame, facets: list[str], ranges: list[str]) -> DataFrame:
    """One row: the sorted values of each facet joined by commas, and the least and greatest value of each range."""
    made = [F.array_join(F.array_sort(F.collect_set(c)), ",").alias(f"{c}_values") for c in facets]
    for c in ranges:
        made += [F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return df.agg(*made)


def filter_samples(
    df: DataFrame, *, pixel_columns: list[str], modalities: list[str] | None = None, classes: list[str] | None = None,
    max_crop: int | None = None, max_objects: int | None = None, touches_border: bool | None = False,
) -> DataFrame:
    """Samples fit for training; a clause applies only if its column exists and its limit is given."""
    have = set(df.columns)
    own = [c for c in pixel_columns if c in have]
    if own:
        total = F.lit(0)
        for c in own:
            total = total + F.coalesce(F.col(c), F.lit(0))
        df = df.where(total > 0)
    if modalities is not None and "modality" in have:
        df = df.where(F.col("modality").isin(modalities))
    if classes is not None and "class_name" in have:
        df = df.where(F.col("class_name").isin(classes))
    if max_crop is not None and "crop_size" in have:
        df = df.where(F.col("crop_size") <= max_crop)
    if max_objects is not None and "n_objects_in_patch" in have:
        df = df.where(F.col("n_objects_in_patch") <= max_objects)
    if touches_border is not None and "touches_border" in have:
        df = df.where(F.col("touches_border") == touches_border)
    return df
