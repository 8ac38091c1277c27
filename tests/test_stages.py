"""From a folder of raw files to leaves, normals, JSON and meshes; kernels against plain values."""

import json
import math
import struct
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from venation.operators import kernels as K
from venation.plans import leaves, meshes, models, outputs, scene, stages
from venation.plans.run import Steps
from venation.sources import catalog, png

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't have this module


def raw_file(image, focal=(85, 1)):
    """A photo with an EXIF block and, behind it, a PNG in place of raw data."""
    ifd = struct.pack("<HHHIII", 1, 0x8769, 4, 1, 26, 0)
    exif = struct.pack("<HHHIII", 1, 0x920A, 5, 1, 44, 0)
    return b"II*\0" + struct.pack("<I", 8) + ifd + exif + struct.pack("<II", *focal) + png.encode(image)


def decode_raw(data, **options):
    return png.decode(data[data.index(png.MAGIC) :])


def photo(seed=0, h=60, w=90):
    image = np.full((h, w, 3), 255, np.uint8)
    image[10:18, 10:50] = (20, 60, 20)
    image[10:14, 40:50] = (30, 80, 30)
    image[30:55, 60:72] = (50 + seed, 40, 20)
    return image


@pytest.fixture
def base(tmp_path):
    for name, focal in (("weed_a_1", (85, 1)), ("weed_b_2", (105, 2))):
        folder = tmp_path / name
        folder.mkdir()
        for i, stem in enumerate(("X_diffuse", "L1", "L2", "L3", "full_photo")):
            (folder / f"{stem}.NEF").write_bytes(raw_file(photo(i), focal))
    (tmp_path / "empty").mkdir()
    return str(tmp_path)


def test_folder_to_files(spark, base):
    steps = Steps(spark, base, decode_raw)
    counts = steps.run(resolution=90, when="2020-01-01")
    assert counts["collect_raw"] == 10 and counts["compress"] == 10
    # two leaves of each object from four pictures, and a mask: the photo of all leaves is left out
    assert counts["extract"] == 2 * 2 * 5 and counts["normals"] == 4 and counts["organise"] == 2 * 2 * 6
    own = steps.files().where("object_name = 'weed_a_1' and leaf = 'leaf_1'").select("folder", "name").collect()
    assert {tuple(r) for r in own} == {("processed", "leaf_1_diffuse.png"), ("processed", "leaf_1_mask.png"), ("processed", "leaf_1_normal.png"), ("leaf_1", "leaf_1_L1.png"), ("leaf_1", "leaf_1_L2.png"), ("leaf_1", "leaf_1_L3.png")}
    with open(f"{base}/dataset_summary.json") as f:
        summary = json.load(f)
    assert summary["dataset_info"] == {"base_folder": base, "processing_date": "2020-01-01", "total_objects": 3, "total_leaves": 2}
    with open(f"{base}/weed_a_1/weed_a_1_leaves_data.json") as f:
        record = json.load(f)
    assert summary["objects"] == {"weed_a_1": record}  # the other's focal length is no number
    assert record["camera_parameters"] == {"focal_length_mm": 85.0, "distance_mm": 280.0, "sensor_width_mm": 23.5, "sensor_height_mm": 15.6, "image_width": 90, "image_height": 60, "orientation": "landscape", "pixel_size_w_mm": round(23.5 / 90, 6), "pixel_size_h_mm": round(15.6 / 60, 6), "pixels_per_cm_horizontal": round(850 / (195 * 23.5 / 90), 2), "pixels_per_cm_vertical": round(850 / (195 * 15.6 / 60), 2)}
    leaf = record["leaves"]["leaf_2"]
    assert record["leaf_count"] == 2 and leaf["pixels"]["area_pixels"] == 25 * 12 and {leaf["pixels"]["width_pixels"], leaf["pixels"]["height_pixels"]} == {24, 11}
    assert steps.compress(90).count() == 0  # as many pictures as raw files
    made = steps.scene(use_sizes=True)
    placed = made["placements"].orderBy("seq").collect()
    assert [r["mesh_name"] for r in placed] == ["weed_a_1_leaf_1", "weed_a_1_leaf_2", "weed_b_2_leaf_1", "weed_b_2_leaf_2"]
    assert [r["factor"] == 1 for r in placed] == [False, False, True, True] and placed[1]["height"] == pytest.approx(leaf["dimensions"]["height_cm"] / 100)
    y = 0.0
    for r in placed:
        assert r["y"] == pytest.approx(y + r["height"] / 2)
        y += r["height"] + 0.5
    assert {(r["name"], r["parent"]) for r in made["collections"].collect()} == {("weed", "LeafMeshes"), ("a", "weed"), ("b", "weed")}
    assert made["links"].where("leaf = 'weed_a_1_leaf_1'").count() == 12
    for r in made["meshes"].collect():
        assert r["status"] == "ok" and all(abs(v["x"]) <= 1 and abs(v["y"]) <= 1 and 0 <= v["u"] <= 1 and 0 <= v["v"] <= 1 for v in r["vertices"])


def pictures(spark, rows):
    return spark.createDataFrame([(o, n, *i.shape, bytearray(i.tobytes())) for o, n, i in rows], "object_name string, name string, height int, width int, channels int, data binary")


def image_of(row):
    return np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["channels"])


def test_leaves_are_cut_upright_and_white_outside(spark):
    image, other = photo(), np.full((30, 45, 3), 90, np.uint8)
    alpha = np.dstack([photo(), np.full((60, 90), 255, np.uint8)])
    rows = pictures(spark, [("o", "X_diffuse.png", image), ("o", "small.png", other), ("o", "with_alpha.png", alpha), ("p", "Y_diffuse.png", np.full((5, 5, 3), 255, np.uint8))])
    found = leaves.regions(leaves.diffuse_of(rows))
    assert {r["object_name"]: (r["status"], len(r["leaves"])) for r in found.collect()} == {"o": ("ok", 2), "p": ("skipped", 0)}
    got = {(r["leaf"], r["name"]): r for r in leaves.extracted(rows, found).collect()}
    assert got[None, None]["reason"] == "no foreground" and len(got) == 1 + 2 * 4
    mask = image_of(got["leaf_2", "leaf_2_mask.png"])[..., 0]
    # a standing box of 25 x 12 is laid level, then stood up: its area stays, its heavier half is on top
    assert mask.shape == (25, 12) and (mask == 255).all()
    diffuse = image_of(got["leaf_1", "leaf_1_diffuse.png"])
    assert diffuse.shape[2] == 4 and (diffuse[..., 3] == 255).sum() == 8 * 40
    cut = image_of(got["leaf_1", "leaf_1_small.png"])
    assert cut.shape[2] == 3 and set(np.unique(cut)) <= {90, 255}
    assert image_of(got["leaf_1", "leaf_1_with_alpha.png"]).shape[2] == 4


def test_normals_by_a_model_of_the_workers(spark):
    mask = np.zeros((40, 30, 1), np.uint8)
    mask[5:35, 5:25] = 255
    light = [np.full((40, 30, 3), 60 * k, np.uint8) for k in (1, 2, 3)]
    rows = [("o", "leaf_1", f"leaf_1_L{k}.png", i) for k, i in enumerate(light)] + [("o", "leaf_1", "leaf_1_mask.png", mask), ("o", "leaf_2", "leaf_2_L.png", light[0]), ("o", "leaf_3", "leaf_3_normal.png", light[0])]
    df = spark.createDataFrame([(o, f, n, *i.shape, bytearray(i.tobytes())) for o, f, n, i in rows], "object_name string, leaf string, name string, height int, width int, channels int, data binary")

    def load():
        def model(images, own):
            assert images.shape == (3, 32, 32, 3) and abs(images[:, own].mean() - 1) < 1e-5  # each divided by its mean
            out = np.zeros((*own.shape, 3))
            out[..., 0] = 5.0
            return out

        return model

    got = {r["leaf"]: r for r in leaves.normal_maps(df, models.Once("tilted", load)).collect()}
    assert set(got) == {"leaf_1", "leaf_2"} and got["leaf_2"]["reason"] == "fewer than three companions"
    colours = image_of(got["leaf_1"])
    assert colours.shape == (40, 30, 3) and (colours[10:30, 10:20] == (255, 127, 127)).all() and (colours[0, 0] == 127).all()


def test_network_segmenter_scales_there_and_back():
    def forward(x):
        assert x.shape == (1, 3, 16, 16)
        return [None, np.where(x[:, :1] > 0, 9.0, -9.0)]

    image = np.zeros((40, 24, 3), np.uint8)
    image[:, :12] = 250
    mask = models.NetworkSegmenter(forward, 16)(image)
    assert mask.shape == (40, 24) and set(np.unique(mask)) == {0, 255} and (mask[:, :10] == 255).all() and (mask[:, 14:] == 0).all()


def test_weights_are_shipped(spark, tmp_path):
    (tmp_path / "w.txt").write_text("7")
    name = models.ship_weights(spark, str(tmp_path / "w.txt"))

    def load(path):
        with open(path) as f:
            level = int(f.read())
        return lambda image: np.where(image[..., 0] < level, 255, 0).astype(np.uint8)

    image = np.arange(12, dtype=np.uint8).reshape(3, 4, 1)
    rows = spark.createDataFrame([("p", 3, 4, 1, bytearray(image.tobytes()))], "path string, height int, width int, channels int, data binary")
    row = stages.foreground(rows, models.Once("weights", load, name)).first()
    assert np.frombuffer(row["data"], np.uint8).tolist() == [255] * 7 + [0] * 5


def test_crops_mattes_and_backgrounds(spark):
    image = np.full((300, 400, 3), 255, np.uint8)
    image[100:150, 200:260] = 10
    rows = pictures(spark, [("o", "a.png", image), ("o", "blank.png", np.full((9, 9, 3), 255, np.uint8))])
    got = {r["name"]: r for r in leaves.foreground_crops(rows, size=160).collect()}
    assert got["blank_resized.png"]["reason"] == "no foreground"
    crop, mask = image_of(got["a_resized.png"]), image_of(got["a_mask.png"])
    assert crop.shape == (160, 160, 3) and mask.shape == (160, 160, 1)
    assert (mask > 128).sum() == pytest.approx(50 * 60 * (160 / 159) ** 2, rel=0.05) and crop[0, 0].tolist() == [255] * 3
    matte = {r["name"]: image_of(r) for r in leaves.mattes(rows, size=64).collect()}
    assert matte["a.png"].shape == (64, 64, 4) and matte["a.png"][32, 32].tolist() == [10, 10, 10, 255] and matte["a.png"][0, 0, 3] == 0
    assert matte["blank.png"].shape == (9, 9, 3)  # no foreground: the picture in colour
    kept = {r["name"]: image_of(r) for r in leaves.mattes(rows, keep_original=True).collect()}
    assert kept["a.png"].shape == (300, 400, 4) and (kept["a.png"][..., 3] == 255).sum() == 3000
    masks = leaves.binary_masks(pictures(spark, [("o", "k.png", kept["a.png"])])).first()
    assert (image_of(masks)[..., 0] == kept["a.png"][..., 3]).all()
    whole = {r["name"]: image_of(r) for r in leaves.without_background(rows.where("name = 'a.png'")).collect()}
    assert (whole["all_leaves_no_bg.png"][..., 3:] == whole["all_leaves_mask.png"]).all()


def test_leaves_on_canvases_of_one_scale(spark):
    rows = pictures(spark, [("o", "X_diffuse.png", photo())])
    normals = spark.createDataFrame([("o", 60, 90, bytearray(np.full((60, 90, 3), 200, np.uint8).tobytes()))], "object_name string, height int, width int, data binary")
    found = leaves.regions(rows)
    got = {r["name"]: image_of(r) for r in leaves.on_canvases(rows, found, normals, 20).collect()}
    assert set(got) == {f"leaf_{n}_{r}.png" for n in (1, 2) for r in ("diffuse", "mask", "normal")} and all(v.shape[:2] == (20, 20) for v in got.values())
    # the longest side of 40 fills the canvas, so the other leaf of 25 x 12 has half its size
    on = np.nonzero(got["leaf_2_mask.png"][..., 0])
    assert (np.ptp(on[0]) + 1, np.ptp(on[1]) + 1) == (12, 6)
    assert (got["leaf_2_normal.png"][10, 10] == 200).all() and got["leaf_2_normal.png"][0, 0].tolist() == [128, 128, 255]
    sizes = leaves.upright_sizes(found).withColumnsRenamed({"height_px": "h", "width_px": "w"}).withColumnsRenamed({"full_height": "height_px", "full_width": "width_px"})
    scales = json.loads(outputs.scales_json(sizes, "object_name").first()["json"])
    assert scales["leaf_2"] == {"height_cm": 25 / 60.14, "width_cm": 12 / 60.14}
    tiny = leaves.on_canvases(rows, found, None, 20, min_area=10**6).collect()
    assert [r["reason"] for r in tiny] == ["no leaf is large enough for a scale"]


def test_turning_keeps_what_is_inside():
    rng = np.random.default_rng(0)
    image = rng.integers(1, 255, (21, 34), np.uint8)
    for angle in (0.0, 12.5, -33.0, 45.0, 90.0, 180.0, 271.0):
        out = K.rotated(image, angle)
        assert abs((out > 0).sum() - image.size) <= 0.06 * image.size
        a = math.radians(angle)
        assert out.shape[0] == pytest.approx(abs(21 * math.cos(a)) + abs(34 * math.sin(a)), abs=2)
    assert (K.rotated(image, 90) == np.rot90(image)).all() and (K.rotated(image, 0.0) == image).all()


def test_upright_bands_round_as_they_should():
    for h in (9, 10, 25, 30):  # one full row at the end: in the lower band, not always in the upper one
        mask = np.zeros((h, 6), np.uint8)
        mask[:, 2:4] = 255
        top, bottom = h // 10, math.ceil(h / 10)
        rows = (mask > 0).sum(axis=1)
        assert (rows[:top].sum() < rows[h - bottom :].sum()) == (top < bottom)


@pytest.mark.parametrize("depth, kind", [(1, 0), (2, 0), (4, 0), (8, 3), (2, 3), (16, 2), (16, 0), (8, 6), (8, 4)])
def test_png_kinds_and_filters(depth, kind):
    import zlib

    rng = np.random.default_rng(depth * 10 + kind)
    h, w, c = 7, 9, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    values = rng.integers(0, min(2**depth, 6) if kind == 3 else 2**depth, (h, w, c))
    if depth == 16:
        plain = np.stack([values >> 8, values & 255], axis=-1).reshape(h, -1).astype(np.uint8)
    elif depth < 8:
        bits = (values.reshape(h, w, 1) >> np.arange(depth - 1, -1, -1)) & 1
        plain = np.packbits(bits.reshape(h, -1).astype(np.uint8), axis=1)
    else:
        plain = values.reshape(h, -1).astype(np.uint8)
    step, packed, above = max(1, c * depth // 8), b"", np.zeros(plain.shape[1], int)
    for y, row in enumerate(plain.astype(int)):
        left, corner = np.concatenate([np.zeros(step, int), row[:-step]]), np.concatenate([np.zeros(step, int), above[:-step]])
        guess = [0 * row, left, above, (left + above) // 2, np.array([png._nearest_of(*map(int, x)) for x in zip(left, above, corner)])][y % 5]
        packed += bytes([y % 5]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        above = row
    palette = rng.integers(0, 256, (6, 3), np.uint8)
    chunks = png._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + (png._chunk(b"PLTE", palette.tobytes()) + png._chunk(b"tRNS", b"\x00\x80") if kind == 3 else b"")
    got = png.decode(png.MAGIC + chunks + png._chunk(b"IDAT", zlib.compress(packed)) + png._chunk(b"IEND", b""))
    if kind == 3:
        assert (got[..., :3] == palette[values[..., 0]]).all() and (got[..., 3] == np.array([0, 128, 255, 255, 255, 255])[values[..., 0]]).all()
    else:
        assert (got == (values >> 8 if depth == 16 else values * (255 // (2**depth - 1)) if depth < 8 else values)).all()
    assert png.grey(got if got.shape[2] != 2 else got[..., :1]).shape == (h, w, 1)


def test_mesh_of_a_square_and_of_nothing(spark):
    mask = np.zeros((40, 80, 1), np.uint8)
    mask[10:31, 20:61] = 255
    rows = spark.createDataFrame([("m", 40, 80, 1, bytearray(mask.tobytes())), ("none", 40, 80, 1, bytearray(40 * 80))], "mesh_name string, height int, width int, channels int, data binary")
    got = {r["mesh_name"]: r for r in meshes.meshes(rows).collect()}
    assert got["none"]["status"] == "skipped" and [tuple(p) for p in got["m"]["outline"]] and len(got["m"]["outline"]) == 4
    v, faces = got["m"]["vertices"], got["m"]["faces"]
    assert len(faces) == 2 * 16 and len(v) == 25
    area = sum(abs((v[b].x - v[a].x) * (v[c].y - v[a].y) - (v[c].x - v[a].x) * (v[b].y - v[a].y)) / 2 for a, b, c in faces)
    assert area == pytest.approx((40 / 80 * 2) * (20 / 40 * 1.0))
    corners = meshes.boxes(meshes.meshes(rows)).first()["corners"]
    assert len(corners) == 8 and {(round(c.x, 9), round(c.y, 9)) for c in corners} == {(x, y) for x in (-0.5, 0.5) for y in (-0.25, 0.25)}
    flat = meshes.projected(meshes.meshes(rows).where("status = 'ok'")).first()["vertices"]
    assert {(max(p.u for p in flat), max(p.v for p in flat))} == {(1.0, 0.5)}


def test_textures_prefer_the_processed_folder(spark, tmp_path):
    image = png.encode(np.zeros((2, 2, 3), np.uint8))
    for path in ("o/leaf_1/processed/leaf_1_mask.png", "o/leaf_1/processed/leaf_1_diffuse.png", "o/leaf_1/processed/leaf_1_normal.png", "o/leaf_1/leaf_1_mask.png", "o/leaf_2/leaf_2_mask.png", "o/leaf_2/leaf_2_diffuse.png", "o/leaf_2/leaf_2_normal.png", "o/leaf_10/leaf_10_mask.png"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(image)
    got = catalog.textures(catalog.files(spark, str(tmp_path), catalog.PICTURES)).orderBy("leaf").collect()
    assert [(r["leaf"], r["mask"].rsplit("/", 2)[1]) for r in got] == [("leaf_1", "processed"), ("leaf_2", "leaf_2")]
    assert [r["leaf"] for r in catalog.leaf_folders(spark, [f"{tmp_path}/o"]).orderBy("leaf").collect()] == ["leaf_1", "leaf_10", "leaf_2"]
    assert [r["object_name"] for r in catalog.folders(spark, f"file://{tmp_path}").collect()] == ["o"]


def test_placement_of_null_groups_and_sizes(spark):
    from venation.operators import relational as L

    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0), (None, 1, 4.0)], "g string, k int, h double")
    got = {(r["g"], r["k"]): (r["offset"], r["seq"]) for r in L.running_offset(rows, "g", "k", "h", 0.5).collect()}
    assert got == {(None, 1): (2.0, 1), ("a", 1): (5.0, 2), ("a", 2): (7.0, 3), ("b", 1): (10.0, 4)}
    assert L.without_first(rows.select("k", "h"), ["k", "h"], 2).collect() == [(1, 4.0), (2, 2.0)] or sorted(map(tuple, L.without_first(rows.select("k", "h"), ["k", "h"], 2).collect())) == [(1, 4.0), (2, 2.0)]
    assert L.without_first(rows.select("k", "h"), ["k", "h"], 9).count() == 0
    sizes = spark.createDataFrame([("m", 50.0)], "mesh_name string, height_cm double")
    flat = scene.scaled_to_size(spark.createDataFrame([("m", 2.0), ("n", 2.0), ("z", 0.0)], "mesh_name string, height double"), sizes, True)
    assert {r["mesh_name"]: r["factor"] for r in flat.collect()} == {"m": 0.25, "n": 1.0, "z": 1.0}


def test_squares_and_fits(spark):
    image = np.full((10, 20, 3), 40, np.uint8)
    rows = spark.createDataFrame([("p", 10, 20, 3, bytearray(image.tobytes()))], "path string, height int, width int, channels int, data binary")
    row = stages.square(rows, 16, (1, 2, 3)).first()
    got = np.frombuffer(row["data"], np.uint8).reshape(16, 16, 3)
    assert got[0, 0].tolist() == [1, 2, 3] and (got[4:12] == 40).all()
    got = np.frombuffer(stages.fitted(rows, 8, 30).first()["data"], np.uint8).reshape(8, 30, 3)
    assert (got[:, 7:23] == 40).all() and (got[:, :7] == 0).all()
    assert stages.square(rows.limit(0)).count() == 0 and leaves.regions(pictures(spark, [("o", "a.png", image)]).limit(0)).withColumn("k", F.lit(1)).count() == 0


def test_images_by_sparks_own_source(spark, tmp_path):
    image = np.random.default_rng(3).integers(0, 256, (5, 7, 3), np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(image))
    (tmp_path / "b.png").write_bytes(b"nothing")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in stages.images(spark, str(tmp_path)).collect()}
    assert (np.frombuffer(got["a.png"]["data"], np.uint8).reshape(5, 7, 3) == image).all() and got["b.png"]["status"] == "error"
    grey = stages.images(spark, str(tmp_path / "a.png"), as_grey=True).first()
    assert (np.frombuffer(grey["data"], np.uint8).reshape(5, 7, 1) == png.grey(image)).all()
