import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from venation.functions import columns as C
from venation.operators import kernels as K
from venation.operators import raster as R
from venation.plans import stages
from venation.sources import catalog, png
from venation.streaming import ingest


def test_fit_sizes():
    assert [K.fit_size(*a) for a in ((6016, 4016, 1920), (4016, 6016, 1920), (6016, 4016, 1024), (300, 200, 1920), (49, 7, 1024))] == [(1920, 1281), (1281, 1920), (1024, 683), (1920, 1280), (1023, 146)]


def test_names(spark):
    got = spark.createDataFrame([("weed_1",), ("weed_ampfer_1_b",), ("a__b",), ("",)], "n string").select(C.parse_asset_name(F.col("n")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("weed", "default", "weed_1"), ("weed", "ampfer", "1_b"), ("a", "", "b"), ("", "default", "")]


def test_optics(spark):
    row = spark.range(1).select(*C.pixel_pitch(F.lit(6016), F.lit(4016))).first()
    got = spark.range(1).select(*(C.pixels_per_cm(F.lit(85.0), F.lit(p)) for p in row), C.pixels_per_cm(F.lit(280.0), F.lit(1.0))).first()
    assert got[0] == pytest.approx(1115.8974358974358) and got[1] == pytest.approx(1122.15647600263) and got[2] is None


@pytest.mark.parametrize("mask,theta,halves", [("1111", 90, (2, 2)), ("1/1/1/1", 0, (0, 4)), ("100/010/001", 45, (1, 2)), ("001/010/100", -45, (1, 2)), ("0001/0011/1111", -62.768839, (2, 5))])
def test_orientation(spark, mask, theta, halves):
    pixels = [(1, y, x) for y, row in enumerate(mask.split("/")) for x, c in enumerate(row) if c == "1"]
    labelled = R.label(R.runs_of_pixels(spark.createDataFrame(pixels, "image_id long, y int, x int")))
    assert R.regions(labelled).select(F.round(R.angle(), 6)).first()[0] == pytest.approx(theta)
    assert tuple(R.halves(labelled).select("left_px", "right_px").first()) == halves
    assert K.long_axis(np.array([[int(c) for c in r] for r in mask.split("/")])) == pytest.approx(theta, abs=1e-6)


def test_labels_against_flood_fill(spark):
    rng = np.random.default_rng(3)
    grid = rng.random((16, 16)) < 0.4
    pixels = [(1, int(y), int(x)) for y, x in zip(*np.nonzero(grid))]
    got = R.regions(R.label(R.runs_of_pixels(spark.createDataFrame(pixels, "image_id long, y int, x int")))).orderBy("label").collect()
    left, want = set((y, x) for _, y, x in pixels), []
    for p in sorted(left):
        if p in left:
            stack, n = [p], 0
            left.discard(p)
            while stack:
                y, x = stack.pop()
                n += 1
                for q in ((y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)):
                    if q in left:
                        left.discard(q)
                        stack.append(q)
            want.append(n)
    assert [r["area"] for r in got] == want


def test_turns_keep_area_and_png_round_trip():
    image = np.random.default_rng(1).integers(0, 256, (7, 5, 3), np.uint8)
    assert (K.rotated(K.rotated(image, 90), -90) == image).all()
    assert (png.decode(png.encode(image)) == image).all()
    mask = np.zeros((9, 9), np.uint8)
    mask[2:5, 1:8] = 255
    ring = K.contours(mask)
    assert len(ring) == 1 and K.polygon_area(ring[0]) == 2 * 6 and len(K.simplified(ring[0], 0.1)) == 4
    assert len(K.triangles([(0, 0), (2, 0), (2, 2), (0, 2)])) == 2 and len(K.subdivided((0, 0), (1, 0), (0, 1))) == 16


def plain_regions(grid):
    """8-connected regions as sets of (y, x), in the order of their first pixels."""
    left, out = {(int(y), int(x)) for y, x in zip(*np.nonzero(grid))}, []
    for p in sorted(left):
        if p in left:
            left.discard(p)
            region, stack = {p}, [p]
            while stack:
                y, x = stack.pop()
                near = {(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & left
                left -= near
                region |= near
                stack += near
            out.append(region)
    return out


def outer_border(region, h, w):
    """Pixels of a region with a side on what can be reached from without over sides."""
    stack, outside = [(-1, -1)], {(-1, -1)}
    while stack:
        y, x = stack.pop()
        for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if -1 <= q[0] <= h and -1 <= q[1] <= w and q not in outside and q not in region:
                outside.add(q)
                stack.append(q)
    return {(y, x) for y, x in region if outside & {(y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)}}


@pytest.mark.parametrize("share", [0.15, 0.4, 0.6, 0.85])
def test_contours_against_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for _ in range(20):
        grid = rng.random((12, 15)) < share
        rings, want = K.contours(np.where(grid, 255, 0)), plain_regions(grid)
        assert len(rings) == len(want)
        for ring, region in zip(rings, want):
            walked = set()
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                n = max(abs(bx - ax), abs(by - ay))  # corners are joined by straight or diagonal steps
                assert n == 0 or {abs(bx - ax), abs(by - ay)} <= {0, n}
                walked |= {(ay + (by - ay) * k // max(n, 1), ax + (bx - ax) * k // max(n, 1)) for k in range(n + 1)}
            assert walked == outer_border(region, *grid.shape)


def test_contour_query_finds_every_region(spark):
    from venation.queries import HEIGHT, LEVEL, QUERIES

    folder, pictures = "/root/testdata/sf0.001", {}
    for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect():
        pictures.setdefault(r["vec_id"] // HEIGHT, {})[r["vec_id"] % HEIGHT] = r["embedding"]
    got = {}
    for r in QUERIES["region_contours"](spark, folder).collect():
        got.setdefault(r["image_id"], []).append((r["idx"], r["area"], r["n_points"]))
    assert set(got) == set(pictures)
    for image, rows in pictures.items():
        want = plain_regions(np.array([rows[y] for y in sorted(rows)], float) > LEVEL)
        assert [i for i, _, _ in sorted(got[image])] == list(range(len(want)))
        for (_, area, points), region in zip(sorted(got[image]), want):
            high, wide = (max(p[k] for p in region) - min(p[k] for p in region) for k in (0, 1))
            assert points >= 1 and area <= high * wide


def test_material_graphs(spark):
    from venation.plans.scene import materials

    leaves = spark.createDataFrame([("a", "a_d", "a_n", "a_m"), ("b", "b_d", None, "b_m")], "leaf string, diffuse string, normal string, mask string")
    nodes, links = (x.collect() for x in materials(leaves))
    assert {(r["leaf"], r["id"]): r["texture"] for r in nodes if r["type"] == "texture"} == {("a", "colour"): "a_d", ("a", "normals"): "a_n", ("a", "mask"): "a_m", ("b", "colour"): "b_d", ("b", "normals"): None, ("b", "mask"): "b_m"}
    ids = {r["id"] for r in nodes}
    assert len(nodes) == 2 * len(ids) and {r["src"] for r in links} | {r["dst"] for r in links} == ids


def test_material_links_of_repeated_and_null_parts(spark, tmp_path):
    import duckdb

    from venation import queries

    spark.createDataFrame([(1,), (2,), (2,), (None,)], "p_partkey long").write.parquet(str(tmp_path / "part.parquet"))
    made = queries.QUERIES["material_graph"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((tuple(r) for r in made.collect()), key=key) == sorted(con.execute(queries.SQL["material_graph"]).fetchall(), key=key)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan  # neither the leaves nor their links are broadcast or shuffled


def test_exif_focal_length():
    ifd = struct.pack("<HHHIII", 1, 0x8769, 4, 1, 26, 0)
    exif = struct.pack("<HHHIII", 1, 0x920A, 5, 1, 44, 0)
    data = b"II*\0" + struct.pack("<I", 8) + ifd + exif + struct.pack("<II", 105, 2)
    assert catalog.focal_length(data) == "105/2" and catalog.focal_length(b"xx") is None


def test_folders_lists_empty_ones(spark, tmp_path):
    for n in ("b", "a"):
        (tmp_path / n).mkdir()
    assert [r["object_name"] for r in catalog.folders(spark, str(tmp_path)).orderBy("object_name").collect()] == ["a", "b"]


def test_files_to_measurements(spark, tmp_path):
    folder = tmp_path / "object" / "compressed"
    folder.mkdir(parents=True)
    image = np.full((40, 60, 3), 255, np.uint8)
    image[5:15, 10:40] = 0
    image[25:35, 5:25] = 0
    (folder / "a.png").write_bytes(png.encode(image))
    (folder / "broken.png").write_bytes(b"no picture")
    (folder / "note.txt").write_text("x")
    found = catalog.files(spark, str(tmp_path), catalog.PICTURES, content=True)
    assert {(r["object_name"], r["folder"], r["stem"]) for r in found.collect()} == {("object", "compressed", "a"), ("object", "compressed", "broken")}
    pictures = stages.decoded(found)
    assert {(r["path"].rsplit("/", 1)[-1], r["status"]) for r in pictures.collect()} == {("a.png", "ok"), ("broken.png", "error")}
    good = pictures.where("status = 'ok'").drop("status", "reason")
    fitted = stages.ingest(good, 60).drop("status", "reason")
    masks = stages.foreground(fitted).withColumn("image_id", F.lit(1).cast("long"))
    photos = spark.createDataFrame([(1, 60, 40, "85")], "image_id long, w int, h int, printed string")
    leaves = stages.measure(stages.runs_of_masks(masks.select("image_id", "height", "width", "channels", "data")), photos)
    got = leaves.orderBy("ordinal").collect()
    assert [(r["ordinal"], r["area"], r["status"]) for r in got] == [(1, 300, "ok"), (2, 200, "ok")]
    assert [(r["width_px"], r["height_px"]) for r in got] == [(29, 9), (19, 9)]
    entry = json.loads(stages.summary(leaves).first()["json"])
    assert entry["leaf_count"] == 2 and set(entry["leaves"]) == {"leaf_1", "leaf_2"}
    assert (png.decode(bytes(stages.encoded(fitted).first()["png"])) == image).all()


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for names in (["a.png", "b.txt"], ["c.png"]):
        for n in names:
            (tmp_path / "in" / n).write_bytes(b"12345")
        ingest.to_table(ingest.new_files(spark, str(tmp_path / "in"), "*.png"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["name"], r["stem"], r["length"]) for r in got) == [("a.png", "a", 5), ("c.png", "c", 5)]
