"""Hand cases with known answers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrasift.functions import geometry as G
from terrasift.functions import names as N
from terrasift.operators import curation, evaluate, labels, ledger, masks, registry, sampling, spatial, validity
from terrasift.sources import files, scratch


def test_unit_square(spark):
    square = G.ring(*[(F.lit(float(x)), F.lit(float(y))) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    cx, cy = G.centroid(square)
    r = spark.range(1).select(G.area(square).alias("a"), G.perimeter(square).alias("p"), cx.alias("x"), cy.alias("y")).first()
    assert (r.a, r.p, r.x, r.y) == (1.0, 4.0, 0.5, 0.5)


def test_utm_of_the_central_meridian(spark):
    e, n = G.to_utm(F.lit(33.0), F.lit(45.0), F.lit(36), F.lit(False))
    r = spark.range(1).select(e.alias("e"), n.alias("n")).first()
    assert abs(r.e - 500000) < 1e-6 and abs(r.n - 4982950.400) < 1e-3


def test_sample_keys(spark):
    df = spark.createDataFrame([("7",), ("7.0",), ("1234567",)], "s string")
    assert [r.k for r in df.select(N.sample_key(F.col("s")).alias("k")).collect()] == ["000007", "000007", "1234567"]


def test_modality_tokens(spark):
    df = spark.createDataFrame([("x_GeoGr_y", "a/Li_b")], "stem string, path string")
    r = df.select(N.modality_from_path(F.col("stem"), F.col("path")).alias("p"), N.region_and_modality(F.col("stem"))[1].alias("m")).first()
    assert (r.p, r.m) == ("Li", "GeoGr")


def test_small_raster_is_one_tile(spark):
    df = spark.createDataFrame([(1, 900, 700, 1024), (2, 2500, 1024, 1024)], "raster_id int, width int, height int, tile int")
    tiles = sorted((r.raster_id, r.x0, r.y0) for r in spatial.tile_grid(df).collect())
    assert tiles == [(1, 0, 0), (2, 0, 0), (2, 768, 0), (2, 1476, 0)]


def test_burning_and_painting(spark):
    def square(k, a, b, area, class_id):
        return (1, k, class_id, float(area), [(float(x), float(y)) for x, y in ((a, a), (b, a), (b, b), (a, b))])

    schema = "sample_id int, ord int, class_id int, area double, ring array<struct<x:double,y:double>>"
    df = spark.createDataFrame([square(1, 2, 3, 1, 1), square(2, 1, 4, 9, 2)], schema)
    for order in (df, df.orderBy(F.desc("ord"))):
        runs = masks.polygon_runs(order, 8)
        assert runs.where("ord = 2").agg(F.sum(F.col("c1") - F.col("c0"))).first()[0] == 9
        painted = masks.paint(runs, "small").groupBy("class_id").agg(F.sum(F.col("c1") - F.col("c0")).alias("n"))
        assert {r.class_id: r.n for r in painted.collect()} == {1: 1, 2: 8}
        assert masks.paint(runs, "last").agg(F.sum(F.col("c1") - F.col("c0"))).first()[0] == 9


def test_components_are_eight_connected(spark):
    pixels = [(1, r, c, 1) for r, c in ((0, 0), (1, 1), (2, 0), (5, 5), (5, 6), (7, 7))]
    runs = masks.mask_runs(spark.createDataFrame(pixels, "sample_id int, row int, col int, v int"), "v")
    assert sorted(r.pixels for r in masks.mask_components(runs).collect()) == [1, 2, 3]


def test_two_predictions_one_truth(spark):
    rows = [("truth", 1, 1, 1, 0, 0, 4), ("pred", 1, 1, 1, 0, 0, 3), ("pred", 1, 1, 2, 0, 1, 4)]
    df = spark.createDataFrame(rows, "side string, sample_id int, class_id int, comp int, row int, c0 int, c1 int")
    df = df.withColumn("pixels", (F.col("c1") - F.col("c0")).cast("long"))
    r = evaluate.match_counts(df, evaluate.soft_match(df)).first()
    assert (r.tp, r.fp, r.fn) == (1, 1, 0)


def test_early_stop(spark):
    df = spark.createDataFrame([(1, e, 0.5 if e == 4 else 0.4 - e / 100) for e in range(1, 21)], "run_id int, epoch int, metric double")
    r = ledger.early_stop(df).first()
    assert (r.best_epoch, r.stop_epoch) == (4, 16)


def test_results_do_not_depend_on_partitions(spark):
    df = spark.range(500).select(F.col("id").alias("sample_id"), (F.col("id") % 7).alias("region"), (F.col("id") % 3 == 0).alias("pos"))

    def run(n):
        part = df.repartition(n)
        kept = sampling.negative_sampling(part, F.col("pos"), "sample_id")
        numbered = sampling.sample_numbering(part, ["region"], ["sample_id"])
        return sorted(kept.collect()), sorted((r.sample_id, r.sample_no) for r in numbered.collect())

    assert run(1) == run(17)


def test_holdout_search_scores_5000_orders(spark):
    rows = [(r, c, m, 1 + (r * r * 37 + r * c * 11 + c + len(m)) % 97) for r in range(40) for c in range(4) for m in ("Li", "Ae") if (r + c) % 3]
    counts = spark.createDataFrame(rows, "region_id long, class_name long, modality string, n long")
    found = sampling.holdout_search(counts).first()
    assert found == sampling.holdout_search(counts, trials=5000).first() and found.score <= sampling.holdout_search(counts, trials=200).first().score
    # the published score of the regions found, term by term
    held, total = {int(x) for x in found.regions.split(",")}, sum(r[3] for r in rows)
    n = sum(r[3] for r in rows if r[0] in held)
    strata = {(c, m) for _, c, m, _ in rows}
    diff = sum(abs(sum(r[3] for r in rows if r[1:3] == s) / total - sum(r[3] for r in rows if r[1:3] == s and r[0] in held) / n) for s in strata)
    under = sum(sum(r[3] for r in rows if r[1] == c and r[0] in held) < 3 for c in range(4))
    largest = max(sum(r[3] for r in rows if r[0] == g) for g in held)
    assert found.val_n == n and abs(found.score - (diff + 2 * abs(n - int(total * 0.2)) / total + 0.5 * under + 0.5 * largest / n)) < 1e-5


def test_weighted_resample_draws_as_many_rows_as_the_table_has(spark):
    for n in (0, 7, 3000):
        table = spark.range(n).select(F.col("id").alias("key"), (F.col("id") % 3).alias("kind"))
        assert sampling.weighted_resample(table, "kind", "key").count() == n


RASTER = "raster_id int, region_id int, modality string, file_ord int, px double, width int, height int, x_left double, y_top double, raster_epsg int"


def test_objects_in_another_zone_are_reprojected(spark):
    # 33 degrees east and 55 north: on the central meridian of zone 36, and in zone 37 six degrees west of its own
    rasters = spark.createDataFrame([(1, 1, "Li", 0, 1.0, 400, 400, 499_800.0, 6_094_991.0, 32636), (2, 1, "Li", 1, 1.0, 9000, 9000, 495_000.0, 6_099_000.0, 32636)], RASTER)
    (x, y), (e, n) = (G.to_utm(F.lit(33.0), F.lit(55.0), F.lit(z), F.lit(False)) for z in (37, 36))
    at = spark.range(1).select(x.alias("x"), y.alias("y"), e.alias("e"), n.alias("n")).first()
    assert abs(at.e - 500_000) < 1e-6 and abs(at.n - 6_094_791) < 1  # published northing of 55 degrees, times 0.9996
    rows = [(1, 1, "Li", at.x, at.y, 5.0, 5.0, 32637), (2, 1, "Li", at.e, at.n, 5.0, 5.0, 32636), (3, 1, "Li", 33.0, 55.0, 0.0001, 0.0001, 4326),
            (4, 1, "Li", at.x, at.y, 5.0, 5.0, 2000), (5, 1, "Li", at.x, at.y, 5.0, 5.0, None)]
    objects = spark.createDataFrame(rows, "object_id int, region_id int, modality string, cx double, cy double, hw double, hh double, epsg int")
    found = {r.object_id: (r.raster_id, r.used_crs_fallback) for r in spatial.match_rasters(objects, rasters).collect()}
    assert found == {1: (1, True), 2: (1, False), 3: (1, True)}
    matched = spatial.match_rasters(objects, rasters).join(objects.drop("region_id", "modality"), "object_id").join(rasters, "raster_id")
    boxes = {r.object_id: (r.c0, r.c1) for r in spatial.pixel_box(matched).collect()}
    assert boxes[2] == (195, 205) and abs(boxes[1][0] - 194) <= 1 and abs(boxes[1][1] - 205) <= 1


def test_rings_are_held_exactly_against_the_bounds(spark):
    rasters = spark.createDataFrame([(1, 1, "Li", 0, 1.0, 10, 10, 0.0, 10.0, 32636)], RASTER)
    corner = [(9.0, 14.0), (14.0, 9.0), (14.0, 14.0)]  # its box meets the raster, the triangle does not
    touching = [(8.0, 12.0), (12.0, 8.0), (14.0, 14.0)]
    around = [(-50.0, -50.0), (50.0, -50.0), (0.0, 90.0)]
    rows = [(k, 1, "Li", (min(x for x, _ in r) + max(x for x, _ in r)) / 2, (min(y for _, y in r) + max(y for _, y in r)) / 2, (max(x for x, _ in r) - min(x for x, _ in r)) / 2,
             (max(y for _, y in r) - min(y for _, y in r)) / 2, 32636, r) for k, r in enumerate((corner, touching, around))]
    objects = spark.createDataFrame(rows, "object_id int, region_id int, modality string, cx double, cy double, hw double, hh double, epsg int, ring array<struct<x:double,y:double>>")
    assert {r.object_id for r in spatial.match_layer(objects, rasters).collect()} == {1, 2}
    assert {r.object_id for r in spatial.match_rasters(objects.drop("ring"), rasters).collect()} == {0, 1, 2}


def test_reprojection_of_a_table(spark):
    rows = [(1, [(33.0, 45.0)], 4326), (2, [(33.0, 45.0)], None), (3, [(1.0, 2.0)], 9999), (4, [(500_000.0, 4_982_950.4)], 32636)]
    found = {r.id: r for r in spatial.reproject(spark.createDataFrame(rows, "id int, ring array<struct<x:double,y:double>>, epsg int"), 32636).collect()}
    assert abs(found[1].ring[0].x - 500_000) < 1e-6 and abs(found[1].ring[0].y - 4_982_950.4) < 1e-3 and found[1].status == "ok"
    assert found[2].ring[0].x == 33.0 and found[4].ring[0].x == 500_000.0 and (found[3].ring, found[3].status) == (None, "failed")


def test_mixed_features_of_one_file(spark, tmp_path):
    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 1]]
    deep = {"type": "GeometryCollection", "geometries": [{"type": "GeometryCollection", "geometries": [{"type": "Polygon", "coordinates": [square]}]}, {"type": "LineString", "coordinates": square}]}
    shapes = [{"type": "Polygon", "coordinates": [square, hole]}, {"type": "MultiPolygon", "coordinates": [[square], [square]]}, {"type": "Point", "coordinates": [7, 8]}, deep, None,
              {"type": "Polygon", "coordinates": []}]
    text = json.dumps({"features": [{"type": "Feature", "geometry": g, "properties": {"class_name": "c", "n": 5}} for g in shapes]})
    (tmp_path / "a.geojson").write_text(text)
    (tmp_path / "b.geojson").write_text(text[:50])
    features = files.parse_features(files.read_features(spark, str(tmp_path)))
    assert sorted(r.geom_type for r in features.collect()) == ["GeometryCollection", "MultiPolygon", "Point", "Polygon"]
    parts = [(r.geom_type, r.part_id, r.part_type, len(r.ring), r.n_holes) for r in files.explode_parts(features).collect()]
    assert sorted(parts) == [("GeometryCollection", 0, "Polygon", 4, 0), ("MultiPolygon", 0, "Polygon", 4, 0), ("MultiPolygon", 1, "Polygon", 4, 0), ("Point", 0, "Point", 1, 0), ("Polygon", 0, "Polygon", 4, 1)]
    assert files.explode_parts(features, collections=False).count() == 4


def test_greatest_confidence_chooses_first(spark):
    def runs(side, comp, row, c0, c1, confidence):
        return (side, 1, 1, comp, row, c0, c1, c1 - c0, confidence)

    rows = [runs("truth", 1, 0, 0, 10, 1.0), runs("pred", 1, 0, 0, 9, 0.2), runs("pred", 2, 0, 0, 8, 0.9)]
    objects = spark.createDataFrame(rows, "side string, sample_id int, class_id int, comp int, row int, c0 int, c1 int, pixels int, confidence double")
    for pool, number in ((False, 2), (True, (1 << 24) + 2)):
        assert [r.p for r in evaluate.soft_match(objects, pool=pool).collect()] == [number]


def test_pooled_and_serial_matching_agree_with_the_loop(spark):
    rng = np.random.default_rng(3)
    rows = []
    for sample in range(12):
        for side in ("truth", "pred"):
            for comp in range(1, 8):
                a = int(rng.integers(0, 20))
                b = a + int(rng.integers(2, 12))
                rows.append((side, sample, 1, comp, comp % 2, a, b, b - a, float(rng.integers(0, 3))))
    objects = spark.createDataFrame(rows, "side string, sample_id int, class_id int, comp int, row int, c0 int, c1 int, pixels int, confidence double")
    pairs = evaluate.object_iou(objects).collect()
    want = set()
    for sample in range(12):
        free = set(range(1, 8))
        order = sorted({(-r.confidence, r.p) for r in pairs if r.sample_id == sample})
        for _, p in order:
            own = [(-r.iou, r.t) for r in pairs if r.sample_id == sample and r.p == p and r.t in free and (r.iou > 0.3 or r.hit)]
            if own:
                want.add((sample, p, min(own)[1]))
                free.discard(min(own)[1])
    assert {(r.sample_id, r.p, r.t) for r in evaluate.soft_match(objects).collect()} == want
    one = objects.where("sample_id = 3")
    assert {(r.p % 2**24, r.t % 2**24) for r in evaluate.soft_match(one, pool=True).collect()} == {x[1:] for x in want if x[0] == 3}


def test_holes_are_filled_and_thin_objects_go(spark):
    ring = [(1, r, c, 1) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)]
    thin = [(1, 8, c, 1) for c in range(20)]
    runs = masks.mask_runs(spark.createDataFrame(ring + thin, "sample_id int, row int, col int, v int"), "v")
    found = masks.mask_objects(runs).collect()
    assert [(r.filled, r.area) for r in found] == [(25, 16.0)]
    assert sorted(r.area for r in masks.mask_objects(runs, 0.0).collect()) == [0.0, 16.0]


def test_draws_reach_nearly_all_rows_and_take_text_keys(spark):
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("key"), F.lit("one").alias("class"))
    drawn = sampling.weighted_resample(rows, "class", "key")
    assert drawn.count() == 60_000 and abs(drawn.select("key").distinct().count() / 60_000 - (1 - np.exp(-1))) < 0.01


def test_numbers_follow_the_order_over_all_ranges(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("k")).repartition(7)
    found = sampling.ranked(rows, ["g", "k"], "n").orderBy("g", "k").collect()
    assert [r.n for r in found] == list(range(1000))


def test_metadata_without_needed_columns_are_refused(spark):
    old = spark.createDataFrame([(7, "whole", 3.0), (8, "other", None)], "sample_id int, kurgan_type string, class_id double")
    fixed = registry.normalize_metadata(old).collect()
    assert [(r.sample_id, r.class_name, r.class_id) for r in fixed] == [("000007", "kurgany_tselye", 3), ("000008", "other", None)]
    with pytest.raises(ValueError):
        registry.normalize_metadata(old, required=registry.METADATA)


def test_tiles_of_which_all_boxes_go_count_as_empty(spark):
    tiles = spark.createDataFrame([(1, 0, 0), (1, 9, 0), (1, 18, 0)], "raster_id int, x0 int, y0 int")
    boxes = spark.createDataFrame([(1, 0, 0, True), (1, 9, 0, False), (1, 9, 0, True)], "raster_id int, x0 int, y0 int, edge boolean")
    found = {(r.x0, r.n_boxes) for r in curation.tile_policy(tiles, boxes, "boxes").collect()}
    assert found == {(0, 0), (9, 1), (18, 0)}
    assert {r.x0 for r in curation.tile_policy(tiles, boxes, "tiles").collect()} == {18}
    assert {r.x0 for r in curation.tile_policy(tiles, boxes, "keep", positives_only=True).collect()} == {0, 9}


def test_a_cluster_without_a_shared_folder_is_an_error():
    class Conf:
        get = staticmethod(lambda key, default=None: default)

    class Session:
        conf, sparkContext = Conf, type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(RuntimeError):
        scratch.scratch_dir(Session)


def _ring_area(r):
    return abs(sum(x * r[k - 1][1] - r[k - 1][0] * y for k, (x, y) in enumerate(r))) / 2


def _even_odd_pixels(rings, size, per=10):
    """Area by the even-odd rule, from the middles of small squares."""
    n = 0
    for a in range(int(size * per)):
        for b in range(int(size * per)):
            x, y = (a + 0.5) / per, (b + 0.5) / per
            n += sum((r[k - 1][1] > y) != (v > y) and x < (r[k - 1][0] - u) * (y - v) / (r[k - 1][1] - v) + u for r in rings for k, (u, v) in enumerate(r)) % 2
    return n / per**2


ODD_RINGS = {
    0: [(np.cos(4 * np.pi * k / 5), np.sin(4 * np.pi * k / 5)) for k in range(5)],
    1: [(0, 0), (1, 0), (2, 0)],
    2: [(0, 0), (2, 0), (2, 0), (2, 2), (0, 0)],
    3: [(0, 0), (4, 4), (4, 0), (0, 4)],
    4: [(0, 0), (4, 0), (4, 4), (8, 4), (4, 4), (0, 4)],  # a spike
    5: [(0, 0), (4, 0), (4, 4), (2, 0), (0, 4)],  # touches its lower edge
    6: [(0, 0), (6, 0), (6, 6), (3, 6), (3, 4), (2, 2), (4, 2), (3, 4), (3, 6), (0, 6)],  # a slit to a hole
    7: [(0, 0), (2, 0), (2, 2), (2, 2), (4, 2), (4, 4), (2, 4), (2, 2), (0, 2)],  # two squares that share a corner
    8: [(0, 0), (4, 0), (4, 4), (0, 4)],
    9: [], 10: None, 11: [(1, 1)],
}


def _point_rows(rings):
    return [(k, None if r is None else [(float(x), float(y)) for x, y in r]) for k, r in rings.items()]


def test_rings_fall_into_parts_by_the_even_odd_rule(spark):
    schema = "object_id long, ring array<struct<x:double,y:double>>"
    rows = spark.createDataFrame(_point_rows(ODD_RINGS), schema)
    flags = {r.object_id: (r.self_crossing, r.self_touching, r.valid) for r in validity.validity(rows).collect()}
    assert flags[0] == flags[3] == (True, False, False) and flags[8] == flags[2] == (False, False, True) and flags[10] == (None, None, None)
    assert all(flags[k] == (False, True, False) for k in (4, 5, 6, 7)) and not flags[1][2] and not flags[9][2] and not flags[11][2]
    parts = {}
    for r in validity.repair(rows).collect():
        parts.setdefault(r.object_id, []).append(_ring_area(r.ring) - sum(map(_ring_area, r.holes)))
    want = {0: [0.1551] * 5, 2: [2], 3: [4, 4], 4: [16], 5: [4, 4], 6: [34], 7: [4, 4], 8: [16]}
    assert {k: sorted(round(float(a), 4) for a in v) for k, v in parts.items()} == want
    assert abs(sum(parts[0]) - 0.7757) < 0.0001  # 1.12 within the outline, less what it winds round twice


def test_no_rings_and_columns_of_the_caller(spark):
    rows = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], "mine", 3)], "object_id long, ring array<struct<x:double,y:double>>, rings string, n int")
    assert validity.validity(rows).select("rings", "n", "valid").first() == ("mine", 3, True)
    assert validity.validity(rows.limit(0)).count() == 0 and validity.repair(rows.limit(0)).count() == 0
    assert [(r.object_id, len(r.ring), r.holes) for r in validity.repair(rows).collect()] == [(1, 3, [])]


def test_long_tangled_rings_equal_pixels_and_short_ones(spark, monkeypatch):
    import random

    rnd = random.Random(7)
    rings = {k: [(rnd.randint(0, 12), rnd.randint(0, 12)) for _ in range(rnd.choice([5, 9, 14]))] for k in range(8)}
    rows = spark.createDataFrame(_point_rows(rings), "object_id long, ring array<struct<x:double,y:double>>")
    short = {r.object_id: r for r in validity.validity(rows).collect()}
    monkeypatch.setattr(validity, "SHORT", 3)
    assert {r.object_id: r for r in validity.validity(rows).collect()} == short
    found = dict.fromkeys(rings, 0.0)
    for r in validity.repair(rows).collect():
        found[r.object_id] += _ring_area(r.ring) - sum(map(_ring_area, r.holes))
        assert len(set(r.ring)) == len(r.ring)
    for k, ring in rings.items():
        assert abs(found[k] - _even_odd_pixels([ring], 12)) < 1.5, k


def test_shapes_cut_by_a_tile_give_a_box_for_each_part(spark):
    u = [(2, 2), (30, 2), (30, 30), (20, 30), (20, 10), (12, 10), (12, 30), (2, 30)]
    ell = [(2, 2), (30, 2), (30, 10), (10, 10), (10, 30), (2, 30)]
    frame, hole = [(2, 2), (30, 2), (30, 30), (2, 30)], [(8, 8), (24, 8), (24, 24), (8, 24)]
    shapes = {1: [u], 2: [ell], 3: [frame, hole], 4: [[(16, 0), (32, 16), (16, 32), (0, 16)]], 5: [[(40, 0), (80, 0), (40, 80)]], 6: None, 7: []}
    tiles = [(k, 0, 16, 16, 16) for k in shapes] + [(1, 0, 0, 64, 64), (3, 0, 16, 0, 8), (4, 0, 16, 0, 8), (5, 0, 64, 64, 8), (2, 0, 12, 12, 16)]
    rows = [(k, x0, y0, tile, None if shapes[k] is None else [[(float(x), float(y)) for x, y in r] for r in shapes[k]]) for k, _, x0, y0, tile in tiles]
    hits = spark.createDataFrame(rows, "object_id long, x0 long, y0 long, tile long, rings array<array<struct<x:double,y:double>>>")
    found = {}
    for r in spatial.clip_parts(hits, ["object_id", "x0", "y0", "tile"]).collect():
        box = min(p.x for p in r.ring), min(p.y for p in r.ring), max(p.x for p in r.ring), max(p.y for p in r.ring)
        found.setdefault((r.object_id, r.x0, r.y0), []).append((*box, _ring_area(r.ring) - sum(map(_ring_area, r.holes))))
    assert {k: sorted(v) for k, v in found.items()} == {
        (1, 16, 16): [(20, 16, 30, 30, 140)], (3, 16, 16): [(16, 16, 30, 30, 132)], (3, 16, 0): [(16, 2, 24, 8, 48)],
        (4, 16, 16): [(16, 16, 32, 32, 128)], (4, 16, 0): [(16, 0, 24, 8, 32)],
    }
    wide = hits.where("object_id IN (1, 2)").select("object_id", F.lit(0).alias("x0"), F.lit(16).alias("y0"), F.lit(64).alias("tile"), "rings").distinct()
    cut = sorted((r.object_id, min(p.x for p in r.ring), max(p.x for p in r.ring)) for r in spatial.clip_parts(wide, ["object_id", "x0", "y0", "tile"]).collect())
    assert cut == [(1, 2, 12), (1, 20, 30), (2, 2, 10)]


def test_boxes_meet_as_by_brute_force_whatever_their_size(spark):
    import random

    from terrasift.operators import grid

    rnd = random.Random(1)

    def boxes(n):
        out = []
        for i in range(n):
            x, y = float(rnd.randint(-3000, 3000)), float(rnd.randint(-3000, 3000))
            out.append((i, rnd.choice("ab"), x, y, x + rnd.choice([0, 1, 33, 256, 5000, 10**7]), y + rnd.choice([0, 1, 40, 600])))
        return out

    left, right = boxes(200), boxes(250)
    a = spark.createDataFrame([*left, (999, "a", None, None, None, None)], "i long, k string, p double, q double, r double, t double")
    b = spark.createDataFrame(right, "j long, k string, p2 double, q2 double, r2 double, t2 double")
    corners = [tuple(F.col(c) for c in names) for names in (("p", "q", "r", "t"), ("p2", "q2", "r2", "t2"))]
    found = sorted((r.i, r.j) for r in grid.box_pairs(a, corners[0], b, corners[1], ["k"]).collect())
    assert found == sorted((x[0], y[0]) for x in left for y in right if x[1] == y[1] and x[2] <= y[4] and y[2] <= x[4] and x[3] <= y[5] and y[3] <= x[5])


def test_no_box_enters_more_than_a_fixed_number_of_cells(spark):
    from terrasift.operators import grid

    rows = spark.createDataFrame([(s, 7.0, 7.0, 7.0 + s, 9.0) for s in (0.0, 31.0, 300.0, 9e4, 6e7)], "s double, _ax0 double, _ay0 double, _ax1 double, _ay1 double")
    most = grid._entries(rows, "a", (0, 1), (0,)).groupBy("s").agg(F.count("*").alias("n")).agg(F.max("n")).collect()[0][0]
    assert most <= 4 * (len(grid.LEVELS) + 1)


def test_window_takes_holes_and_its_own_size(spark):
    square, hole = [(x, y) for x, y in ((0, 0), (400, 0), (400, 400), (0, 400))], [(100, 100), (300, 100), (300, 300), (100, 300)]
    rings = [[dict(x=float(x), y=float(y)) for x, y in r] for r in (square, hole)]
    layer = spark.createDataFrame([(1, 7, 200.0, 200.0, 200.0, 200.0, rings)], "k int, ord long, cx double, cy double, hw double, hh double, rings array<array<struct<x:double,y:double>>>")
    windows = spark.createDataFrame(
        [(1, 1, 16, 0, 0, 1.0, 190.0, 210.0), (2, 1, 64, 0, 0, 1.0, 80.0, 120.0), (3, 1, 8, 4, 2, 0.5, 0.0, 50.0), (4, 1, 8, 0, 0, 1.0, 500.0, 500.0)],
        "sample_id long, k int, crop_size int, c0 int, r0 int, px double, x_left double, y_top double")
    pairs = spatial.window_pairs(windows, layer, ["k"])
    assert sorted(r.sample_id for r in pairs.collect()) == [2, 3]  # window 1 lies in the hole, 4 outside
    runs = masks.polygon_runs(pairs.select("sample_id", "ord", F.lit(1).alias("class_id"), F.lit(1.0).alias("area"), "rings", "crop_size"))
    n = {r.sample_id: r.n for r in runs.groupBy("sample_id").agg(F.sum(F.col("c1") - F.col("c0")).alias("n")).collect()}
    assert n == {2: 64 * 64 - 20 * 44, 3: 64}
    stats = {r.sample_id: r for r in masks.mask_stats(runs, windows.select("sample_id", "crop_size"), [1]).collect()}
    assert stats[2].pixels_bg == 20 * 44 and stats[4].pixels_bg == 64 and stats[4].classes == ""


def test_large_polygons_are_crossed_in_bands_and_slices(spark, monkeypatch):
    import math

    n = 900
    points = [dict(x=100 + (60 + 30 * math.sin(9 * t)) * math.cos(t), y=100 + (60 + 30 * math.sin(9 * t)) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
    shape = spark.createDataFrame([(1, 5, 1, 9.0, [points], 200), (2, 6, 1, 9.0, [points[:3]], 90)], "sample_id long, ord long, class_id int, area double, rings array<array<struct<x:double,y:double>>>, crop_size int")
    whole = sorted(map(tuple, masks.polygon_runs(shape).collect()))
    assert len(whole) > 150
    for spread in (False, True):
        monkeypatch.setattr(masks, "MANY_EDGES", 100)
        monkeypatch.setattr(masks, "BAND", 16)
        assert sorted(map(tuple, masks.polygon_runs(shape, spread=spread).collect())) == whole
    import numpy as np

    x, y = (np.array([p[c] for p in points]) for c in "xy")
    monkeypatch.setattr(masks, "CROSSINGS", 40)
    slices = list(masks._crossed(x, y, np.roll(x, -1), np.roll(y, -1), np.zeros(n, np.int64), np.array([0]), np.array([200]), np.array([200])))
    assert len(slices) > 20 and all(len(s[0]) <= 40 for s in slices)
    assert sorted((1, 5, 1, 9.0, *map(int, r)) for s in slices for r in zip(*s[1:])) == [r for r in whole if r[0] == 1]


@pytest.mark.parametrize("rule", ["small", "last"])
@pytest.mark.parametrize("pieces", [2_000_000, 3])
def test_painting_sweeps_as_a_canvas_would(spark, monkeypatch, rule, pieces):
    import random

    rnd = random.Random(4)
    runs = [(rnd.choice([None, 1, 2, 3]), rnd.randrange(5), c0, c0 + rnd.randint(0, 20), rnd.randint(0, 3), i, float(rnd.randint(1, 5))) for i in range(500) for c0 in [rnd.randint(0, 40)]]
    frame = spark.createDataFrame(runs, "sample_id long, row int, c0 int, c1 int, class_id int, ord long, area double").repartition(3)
    want = {}
    for sample, row, c0, c1, kind, number, area in sorted(runs, key=lambda r: (-r[6], r[5]) if rule == "small" else r[5]):
        want |= {(sample, row, c): kind for c in range(c0, c1)}
    monkeypatch.setattr(masks, "PIECES", pieces)
    painted = masks.paint(frame, rule).collect()
    pixels = [((r.sample_id, r.row, c), r.class_id) for r in painted for c in range(r.c0, r.c1)]
    assert len(pixels) == len(want) and dict(pixels) == want


def test_holes_stay_and_collections_open_to_any_depth(spark):
    import json

    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    deep = {"type": "Polygon", "coordinates": square}
    for _ in range(6):
        deep = {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 2]}, deep]}
    text = json.dumps({"features": [{"geometry": deep, "properties": {}}, {"geometry": {"type": "Polygon", "coordinates": square}, "properties": {}}]})
    parts = files.explode_parts(files.parse_features(spark.createDataFrame([(text,)], "text string")))
    rows = parts.select("*", G.polygon_area(F.col("rings")).alias("area"), G.inside_polygon(F.col("rings"), F.lit(1.5), F.lit(1.5)).alias("in_hole")).orderBy("feature_idx", "part_id").collect()
    assert [r.part_type for r in rows] == ["Point"] * 6 + ["Polygon"] * 2 and [r.part_id for r in rows] == [*range(7), 0]
    assert all(r.area == 15 and r.n_holes == 1 and not r.in_hole for r in rows[6:])


def plain_objects(pixels):
    """(filled pixels, contour area) of the outermost 8-connected components, by walks over the grid."""
    import numpy as np

    h, w = pixels.shape
    left = {(r, c) for r in range(h) for c in range(w) if pixels[r, c]}

    def walk(start, allowed, steps):
        seen, todo = {start}, [start]
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                n = (r + dr, c + dc)
                if n in allowed and n not in seen:
                    seen.add(n)
                    todo.append(n)
        return seen

    four = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    found = []
    grid = {(r, c) for r in range(-1, h + 1) for c in range(-1, w + 1)}
    while left:
        own = walk(next(iter(left)), left, four + [(1, 1), (1, -1), (-1, 1), (-1, -1)])
        left -= own
        found.append((own, grid - walk((-1, -1), grid - own, four)))
    out = []
    for own, full in found:
        if any(other is not own and own <= more - other for other, more in found):
            continue
        squares = np.array([sum((r + a, c + b) in full for a in (0, 1) for b in (0, 1)) for r in range(-1, h) for c in range(-1, w)])
        out.append((len(full), float((squares == 4).sum() + (squares == 3).sum() / 2)))
    return sorted(out)


def test_objects_from_runs_equal_walks_over_the_pixels(spark):
    rng = np.random.default_rng(6)
    grids = {i: rng.random((rng.integers(1, 14), rng.integers(1, 16))) < p for i, p in enumerate(np.linspace(0.3, 0.9, 40))}
    nested = np.zeros((17, 17), bool)
    for k in range(0, 9, 2):
        nested[k:17 - k, k:17 - k] = True
        nested[k + 1:16 - k, k + 1:16 - k] = False
    grids[100] = nested
    rows = [(i, int(r), int(c), 1) for i, g in grids.items() for r, c in zip(*np.nonzero(g))]
    runs = masks.mask_runs(spark.createDataFrame(rows, "sample_id int, row int, col int, v int"), "v").repartition(3)
    found = {}
    for r in masks.mask_objects(runs, 0.0).collect():
        found.setdefault(r.sample_id, []).append((r.filled, r.area))
    assert {i: sorted(v) for i, v in found.items()} == {i: want for i, g in grids.items() if (want := plain_objects(g))}
    assert found[100] == [(17 * 17, 256.0)]


def test_a_long_winding_object_is_linear_work(spark):
    import time

    n = 1201
    runs = [(1, r, 0, n, 1) if r % 2 == 0 else (1, r, 0 if r % 4 == 1 else n - 1, 1 if r % 4 == 1 else n, 1) for r in range(n)]
    frame = spark.createDataFrame(runs, "sample_id int, row int, c0 int, c1 int, class_id int").coalesce(1)
    masks.mask_objects(frame).collect()
    start = time.time()
    [found] = masks.mask_objects(frame).collect()
    assert found.filled == sum(r[3] - r[2] for r in runs) and time.time() - start < 5


def test_layers_of_many_rasters_match_as_by_brute_force(spark):
    import random

    rnd = random.Random(9)
    rasters = [(i, 1, "Li", i, 0.5, 400, 300, rnd.uniform(0, 9000), rnd.uniform(0, 9000)) for i in range(1500)]
    objects = [(i, 1, "Li", rnd.uniform(0, 9000), rnd.uniform(0, 9000), rnd.uniform(1, 40), rnd.uniform(1, 40)) for i in range(800)]
    r = spark.createDataFrame(rasters, "raster_id long, region_id int, modality string, file_ord int, px double, width int, height int, x_left double, y_top double")
    o = spark.createDataFrame(objects, "object_id long, region_id int, modality string, cx double, cy double, hw double, hh double")
    want = {}
    for i, _, _, cx, cy, hw, hh in objects:
        for k, *_, px, w, h, x, y in rasters:
            if cx - hw <= x + w * px and cx + hw >= x and cy - hh <= y and cy + hh >= y - h * px:
                want.setdefault(i, k)
    nowhere = lambda: (F.lit(-1e6), F.lit(-1e6), F.lit(1.0), F.lit(1.0))
    found = spatial.match_rasters(o, r, nowhere).collect()
    assert {x.object_id: x.raster_id for x in found} == want and len(found) == len(want)
    assert spatial.match_layer(o, r, nowhere).count() == sum(
        cx - hw <= x + w * px and cx + hw >= x and cy - hh <= y and cy + hh >= y - h * px for _, _, _, cx, cy, hw, hh in objects for _, *_, px, w, h, x, y in rasters)


def test_layers_of_one_feature_a_line_read_as_whole_files(spark, tmp_path):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [k, 2]}, "properties": {"class_name": f"c{k}", "depth": k, "note": None}} for k in range(5)]
    (tmp_path / "whole.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    broken = ['{"type": "Feature", "geometry"', json.dumps({"type": "Feature", "geometry": None, "properties": {}}), json.dumps({"geometry": {"type": "Polygon", "coordinates": []}})]
    (tmp_path / "lines.geojsonl").write_text("\n".join(["\x1e" + json.dumps(f) for f in features] + ["", *broken]))
    whole = files.parse_features(files.read_features(spark, f"{tmp_path}/whole.geojson"))
    lines, rejected = files.parse_feature_lines(files.read_feature_lines(spark, f"{tmp_path}/lines.geojsonl"))
    columns = ["geom_type", "coordinates", "geometries", "properties", "class_name"]
    assert sorted(map(str, lines.select(columns).collect())) == sorted(map(str, whole.select(columns).collect()))
    assert lines.where("class_name = 'c3'").collect()[0].properties["depth"] == "3"
    assert sorted(r.reason for r in rejected.collect()) == ["no_geometry", "no_geometry", "unreadable"]


def test_a_touching_corner_far_from_the_origin_is_met(spark):
    # the box's corner lies on the hole's edge, which coordinates of millions round to either side of it
    k = 594552
    w, h, dx, dy = 6.0 + k * 31 % 40, 6.0 + k * 17 % 30, k % 97 - 48, k * 7 % 89 - 44
    assert round((abs(dx) + 10) * h + (abs(dy) + 10) * w, 9) == round(0.9 * w * h, 9)
    places = [(20000.0 * r + k * 7919 % 6000 + far, 6000000.0 + k * 104729 % 4000) for r in range(25) for far in (0, 5_000_000)]
    x, y = F.col("x"), F.col("y")
    outer, hole = (G.ring((x + w * s, y), (x, y + h * s), (x - w * s, y), (x, y - h * s)) for s in (1.0, 0.9))
    met = G.polygon_meets_rectangle(F.array(outer, hole), x + dx - 10, y + dy - 10, x + dx + 10, y + dy + 10)
    inner = G.polygon_meets_rectangle(F.array(outer, hole), x - 0.4, y - 0.4, x + 0.4, y + 0.4)
    rows = spark.createDataFrame(places, "x double, y double").select(met.alias("m"), inner.alias("i")).collect()
    assert all(r.m and not r.i for r in rows)


def test_a_policy_that_leaves_no_box_has_no_row(spark):
    boxes = spark.createDataFrame([(1, 0, 0, True), (1, 0, 0, False), (1, 768, 0, True)], "raster_id int, x0 int, y0 int, edge boolean")
    found = {r.policy: (r.n, r.n_tiles) for r in curation.policy_counts(boxes).collect()}
    assert found == {"boxes": (1, 1), "keep": (3, 2)}


def test_clipping_names_its_ring_once(spark):
    rows = spark.createDataFrame([(0.0, 0.0)], "cx double, cy double")
    ring = G.ring((F.col("cx") + 2, F.col("cy")), (F.col("cx"), F.col("cy") + 2), (F.col("cx") - 2, F.col("cy")))
    rows = rows.select(G.clip(ring, F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(9.0)).alias("ring"))
    assert {(p.x, p.y) for p in rows.first().ring} == {(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)}
    assert rows._jdf.queryExecution().analyzed().toString().count("(cx#") <= 6


def test_conditions_on_boxes_do_not_split_lines_again(spark):
    lines = spark.createDataFrame([(1, " 0 0.5  0.5 0.25 0.25 "), (1, "x 0.5 0.5 0.25 0.25"), (2, "0 0.5 0.5 0.25"), (3, "0 a 0.5 0.25 0.25"), (4, None)], "image int, line string")
    parsed = labels.parse_labels(lines)
    assert sorted((r.image, str(r.cls), r.xc) for r in parsed.where("xc IS NOT NULL").collect()) == [(1, "0", 0.5), (1, "None", 0.5)]
    for frame in (labels.decode_boxes(parsed.where(labels.valid_box())), labels.zoom_extent(labels.decode_boxes(parsed.where(labels.valid_box())))):
        assert frame._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_short_rings_are_cut_within_their_row_as_long_ones_on_the_grid(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rings = [[(float(a), float(b)) for a, b in rng.integers(0, 9, (int(rng.integers(0, 12)), 2)) + (5_000_000, 6_000_000)] for _ in range(60)] + [None]
    rows = spark.createDataFrame(list(enumerate(rings)), "object_id long, ring array<struct<x:double,y:double>>")

    def parts(frame):
        one = lambda r: tuple(sorted((round(p.x, 6), round(p.y, 6)) for p in r))
        return sorted((r.object_id, one(r.ring), tuple(sorted(map(one, r.holes)))) for r in frame.collect())

    met = []
    edge_pairs = validity.edge_pairs
    monkeypatch.setattr(validity, "edge_pairs", lambda rows, keys: met.append(rows.count()) or edge_pairs(rows, keys))
    short = parts(validity.repair(rows))
    assert not any(met)  # no short ring goes through a shuffle
    monkeypatch.setattr(validity, "SHORT", -1)
    assert short == parts(validity.repair(rows)) and len(short) > 60
    assert any(met)


def test_conditions_on_clipped_rings_stay_above_the_clipping(spark, monkeypatch):
    plans = []
    cut_lineage = spatial.cut_lineage
    monkeypatch.setattr(spatial, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut_lineage(df))
    ring = [(1.0, 1.0), (5.0, 1.0), (5.0, 5.0), (1.0, 5.0)]
    rows = spark.createDataFrame([(1, [ring], 0, 0, 8), (2, [ring], 2, 0, 8), (3, [ring], 0, 5, 8), (4, [ring], 9, 9, 8)], "k long, rings array<array<struct<x:double,y:double>>>, x0 int, y0 int, tile int")
    found = {r.k: len(r.ring) for r in spatial.clip_parts(rows.repartition(2), ["k"]).collect()}
    assert found == {1: 4, 2: 4}  # the third only touches its tile
    assert max(map(len, plans)) < 12_000  # 14,102 where the condition named every pass again


def test_copies_are_gathered_in_bounded_lists(spark, monkeypatch):
    rows = [(k % 3 if k % 7 else None, None if k == 11 else k) for k in range(60)]
    frame = spark.createDataFrame(rows, "place int, id long")
    whole = spatial.gathered(frame, "id").collect()
    assert len(whole) == 4
    monkeypatch.setattr(spatial, "MEMBERS", 3)
    parts = spatial.gathered(frame, "id").collect()
    assert max(len(r.id) for r in parts) < 20 and len(parts) > 10
    for found in (whole, parts):
        assert sorted(((r.place, i) for r in found for i in r.id), key=str) == sorted(rows, key=str)


def test_window_pairs_joins_copies_once(spark, monkeypatch):
    from terrasift.plans import queries

    met = []

    def counted(windows, objects, on):
        pairs = plain(windows, objects, on)
        met.append(pairs.count())
        return pairs

    plain = spatial.window_pairs
    monkeypatch.setattr(spatial, "window_pairs", counted)
    # twenty objects each in two places 30 metres apart; ids of one residue, so that sizes agree
    objects = spark.createDataFrame([(5 * k, 1, "Li", 100.0 + 30 * (k % 2), 50.0, 6.0, 8.0) for k in range(40)], "object_id long, region_id int, modality string, cx double, cy double, hw double, hh double")
    found = queries.window_pairs(objects).collect()
    assert met == [4]
    assert sorted((r.sample_id, r.object_id) for r in found) == [(5 * a, 5 * b) for a in range(40) for b in range(40)]
    assert {((r.object_id - r.sample_id) % 10, r.x0 - 52 in (0, 60, -60)) for r in found} == {(0, True), (5, True)}


def test_windows_that_span_a_ring_along_one_axis_need_no_exact_test(spark, monkeypatch):
    diamond = [dict(x=x, y=y) for x, y in ((12.0, 0.0), (0.0, 8.0), (-12.0, 0.0), (0.0, -8.0))]
    holed = [dict(x=x * 0.9, y=y * 0.9) for x, y in ((12.0, 0.0), (0.0, 8.0), (-12.0, 0.0), (0.0, -8.0))]
    layer = spark.createDataFrame([(1, 7, 0.0, 0.0, 12.0, 8.0, [diamond, holed]), (1, 8, 0.0, 0.0, 12.0, 8.0, [diamond[:2]])], "k int, ord long, cx double, cy double, hw double, hh double, rings array<array<struct<x:double,y:double>>>")
    # about the ring, over its right and upper side, at its border, over its corner, far from it
    windows = [(1, 40.0, -20.0, 20.0), (2, 40.0, 5.0, 20.0), (3, 30.0, -15.0, 35.0), (4, 30.0, 12.0, 15.0), (5, 20.0, 10.0, 26.0), (6, 20.0, 3.0, 23.0), (7, 9.0, 40.0, 4.0)]
    frame = spark.createDataFrame([(k, 1, int(size), 0, 0, 1.0, x, y) for k, size, x, y in windows], "sample_id long, k int, crop_size int, c0 int, r0 int, px double, x_left double, y_top double")

    def found():
        return sorted((r.sample_id, r.ord) for r in spatial.window_pairs(frame, layer, ["k"]).collect() if r.ord == 7)

    assert found() == [(k, 7) for k in (1, 2, 3, 4, 6)]
    monkeypatch.setattr(spatial.G, "polygon_meets_rectangle", lambda *args: F.lit(False))
    assert found() == [(k, 7) for k in (1, 2, 3, 4)]


def test_windows_are_counted_on_a_canvas_cut_into_squares(spark, monkeypatch):
    import random

    rnd = random.Random(8)
    runs = [(s, row, c, c + rnd.randint(1, 4), rnd.randint(1, 3)) for s in (1, 2) for row in range(20) for c in (0, 5, 11, 17, 24) if rnd.random() < 0.7]
    windows = [(k, 1 + k % 3, rnd.randint(0, 20), rnd.randint(0, 15), rnd.randint(1, 12)) for k in range(30)]
    want = {}
    for k, s, c, r, size in windows:
        for canvas, row, c0, c1, kind in runs:
            if canvas == s and r <= row < r + size and min(c1, c + size) > max(c0, c):
                want[k, kind] = want.get((k, kind), 0) + min(c1, c + size) - max(c0, c)
    monkeypatch.setattr(masks, "CROSSINGS", 7)
    for square in (8, 2048):
        monkeypatch.setattr(masks, "SQUARE", square)
        found = masks.window_pixels(spark.createDataFrame(runs, "sample_id long, row int, c0 int, c1 int, class_id int"), spark.createDataFrame(windows, "sample_id long, canvas long, c0 long, r0 long, crop_size long"))
        assert {(r.sample_id, r.class_id): r.pixels for r in found.collect()} == want


def test_samples_paint_an_object_once_for_all_windows_and_copies(spark, monkeypatch):
    from terrasift.operators import build

    painted = []

    def counted(polygons, *args, **kwargs):
        painted.append(polygons.count())
        return plain(polygons, *args, **kwargs)

    plain = masks.polygon_runs
    monkeypatch.setattr(masks, "polygon_runs", counted)
    ring = [[dict(x=float(x), y=float(y)) for x, y in ((10, 10), (20, 10), (20, 20), (10, 20))]]
    layer = [(1, k, kind, 100.0, ring, 15.0, 15.0, 5.0, 5.0) for k, kind in ((1, 1), (2, None), (4, 2), (3, 1), (5, None))]
    layer = spark.createDataFrame(layer, "k int, ord long, class_id int, area double, rings array<array<struct<x:double,y:double>>>, cx double, cy double, hw double, hh double")
    windows = [(s, k, 8, c0, 6, 1.0, 0.0, 30.0) for s, k, c0 in [(i, 1, i % 8 - 2) for i in range(40)] + [(40, 1, 50), (41, None, 0)]]
    windows = spark.createDataFrame(windows, "sample_id long, k int, crop_size int, c0 int, r0 int, px double, x_left double, y_top double")
    rows = {r.sample_id: r for r in build.segmentation_samples(windows, layer, ["k"], [1, 2]).collect()}
    assert painted == [1] and set(rows) == set(range(42))
    for s in range(40):
        n = 4 * max(0, s % 8 + 6 - 10)
        assert (rows[s].pixels_1, rows[s].pixels_2, rows[s].pixels_bg) == (0, n, 64 - n)
        assert (rows[s].n_objects, rows[s].classes, rows[s].reason) == ((5, "2", None) if n else (5, "", "empty_mask") if s % 8 == 4 else (0, "", "no_polygons"))
    assert (rows[40].reason, rows[41].reason) == ("no_polygons",) * 2


@pytest.mark.parametrize("rule", ["small", "last"])
def test_polygons_are_painted_as_their_runs_are_without_shuffling_runs(spark, monkeypatch, rule):
    import random

    from terrasift.plans import queries

    rnd = random.Random(5)

    def diamond(x, y, w, h):
        return [dict(x=x + w, y=y), dict(x=x, y=y + h), dict(x=x - w, y=y), dict(x=x, y=y - h)]

    rows = []
    for k in range(80):
        x, y, w, h = rnd.uniform(-5, 60), rnd.uniform(-9, 60), rnd.uniform(0.1, 30), rnd.uniform(0.1, 30)
        rows.append((rnd.choice([None, 1, 2]), k, rnd.randint(0, 2), float(rnd.randint(1, 6)), None if k == 3 else [diamond(x, y, w, h), diamond(x, y, w / 2, h / 2)][:1 + k % 2], rnd.choice([16, 50])))
    shapes = spark.createDataFrame(rows, f"sample_id long, ord long, class_id int, area double, rings {masks.POINTS}, crop_size int").repartition(3)
    want = sorted(map(tuple, masks.paint(masks.polygon_runs(shapes), rule).collect()), key=str)
    pixels = {}
    for s, row, c0, c1, kind in want:
        pixels[s, row, kind] = pixels.get((s, row, kind), 0) + c1 - c0
    for band, crossings in ((128, 1_000_000), (16, 1_000_000), (128, 30), (7, 5)):
        monkeypatch.setattr(masks, "BAND", band)
        monkeypatch.setattr(masks, "CROSSINGS", crossings)
        assert sorted(map(tuple, masks.paint_polygons(shapes, rule).collect()), key=str) == want
        assert {(r.sample_id, r.row, r.class_id): r.pixels for r in masks.paint_polygons(shapes, rule, sums=True).collect()} == pixels
    # the registered query sends polygons, not runs or sums of runs, through a shuffle
    objects = spark.createDataFrame([(k, 9.0, 9.0) for k in range(8)], "object_id long, hw double, hh double")
    plan = (queries.paint_last_wins if rule == "last" else queries.paint_small_wins)(objects)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
