"""The library's operators over the driver's tables, each beside the same in SQL.

The raster bridge: the vector with id v is row v % 50 of picture v div 50, its 64 components are that row's pixels, and
values over 0.1 are foreground.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as C
from .operators import raster as R
from .operators import relational as L

HEIGHT, WIDTH, LEVEL = 50, 64, 0.1

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a query under its function's name, with its SQL."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picture_rows(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.expr(f"vec_id div {HEIGHT}").alias("image_id"), (F.col("vec_id") % HEIGHT).cast("int").alias("y"), "embedding")


def mask_runs(spark, d) -> DataFrame:
    return R.runs_of_rows(picture_rows(spark, d), "embedding", LEVEL)


def labelled(spark, d) -> DataFrame:
    return R.label(mask_runs(spark, d))


def measured(spark, d) -> DataFrame:
    return R.regions(labelled(spark, d))


# The same in SQL, as common table expressions.
PX = f"""px as (select vec_id // {HEIGHT} as image_id, cast(vec_id % {HEIGHT} as int) as y, cast(x - 1 as int) as x, cast(embedding[x] as double) as v
  from (select vec_id, embedding, unnest(range(1, {WIDTH + 1})) as x from embeddings)), m as (select * from px where v > {LEVEL})"""
RUNS = f"""{PX}, runs as (select image_id, y, min(x) as x0, max(x) as x1, y * {WIDTH} + min(x) as id
  from (select *, x - row_number() over (partition by image_id, y order by x) as g from m) group by image_id, y, g)"""
REG = f"""{RUNS}, adj as (select a.image_id, a.id as a, b.id as b from runs a join runs b on a.image_id = b.image_id and abs(a.y - b.y) = 1 and a.x0 <= b.x1 + 1 and b.x0 <= a.x1 + 1),
reach as (select image_id, id, id as root from runs union select r.image_id, adj.b, r.root from reach r join adj on adj.image_id = r.image_id and adj.a = r.id where adj.b > r.root),
comp as (select image_id, id, min(root) as root from (select r.image_id, r.id, r.root from reach r) group by 1, 2),
reach2 as (select image_id, id, root from comp union select c.image_id, adj.b, r.root from reach2 r join comp c on c.image_id = r.image_id and c.id = r.id join adj on adj.image_id = c.image_id and adj.a = c.id),
comp2 as (select image_id, id, min(root) as root from reach2 group by 1, 2),
lab as (select r.*, dense_rank() over (partition by r.image_id order by c.root) as label from runs r join comp2 c using (image_id, id)),
lp as (select l.image_id, l.label, m.y, m.x from lab l join m on m.image_id = l.image_id and m.y = l.y and m.x between l.x0 and l.x1),
reg as (select image_id, label, min(y) as y0, max(y) as y1, min(x) as x0, max(x) as x1, count(*) as area from lp group by 1, 2)"""


# --- rasters


@query(f"with {PX} select image_id, count(*) as area from m group by 1")
def mask_threshold_area(spark, d):
    return mask_runs(spark, d).groupBy("image_id").agg(F.sum(F.col("x1") - F.col("x0") + 1).cast("long").alias("area"))


@query(f"with recursive {REG} select image_id, cast(label as int) as label, y0, y1, x0, x1, area from reg")
def components_bbox(spark, d):
    return measured(spark, d).select("image_id", "label", "y0", "y1", "x0", "x1", "area")


@query(f"with recursive {REG} select image_id, cast(label as int) as label, area, cast(row_number() over (partition by image_id order by label) as int) as ordinal from reg where area >= 3")
def leaf_ordinals_filtered(spark, d):
    return L.ordinals(measured(spark, d), "image_id", "label", F.col("area") >= 3).select("image_id", "label", "area", "ordinal")


@query(f"with recursive {REG} select image_id, cast(label as int) as label, area from reg where area >= 5")
def label_ordinals(spark, d):
    return measured(spark, d).where("area >= 5").select("image_id", "label", "area")


@query(f"""with recursive {REG}, s as (select image_id, label, count(*)::hugeint as n, sum(x)::hugeint as sx, sum(y)::hugeint as sy, sum(x * x)::hugeint as sxx, sum(y * y)::hugeint as syy, sum(x * y)::hugeint as sxy from lp group by 1, 2)
select image_id, cast(label as int) as label, round(degrees(0.5::double * atan2((2 * (n * sxy - sx * sy))::double, ((n * syy - sy * sy) - (n * sxx - sx * sx))::double)), 6) + 0.0::double as theta from s""")
def orientation_angle(spark, d):
    return measured(spark, d).select("image_id", "label", (F.round(R.angle(), 6) + 0.0).alias("theta"))


@query(f"""with recursive {REG}, h as (select lp.image_id, lp.label, count(*) filter (where x < x0 + (x1 - x0 + 1) // 2) as left_px, count(*) filter (where x >= x0 + (x1 - x0 + 1) // 2) as right_px
  from lp join reg using (image_id, label) group by 1, 2)
select image_id, cast(label as int) as label, left_px, right_px, case when right_px > left_px then 'right' when left_px > right_px then 'left' else 'none' end as side from h""")
def stem_side(spark, d):
    return R.halves(labelled(spark, d)).select("image_id", "label", F.col("left_px").cast("long").alias("left_px"), F.col("right_px").cast("long").alias("right_px"), R.side().alias("side"))


@query(f"""with recursive {REG}, b as (select image_id, label, y1 - y0 + 1 as h, count(*) filter (where y - y0 < (y1 - y0 + 1) // 10) as top_px, count(*) filter (where y - y0 >= (y1 - y0 + 1) - (y1 - y0 + 10) // 10) as bottom_px
  from lp join reg using (image_id, label) group by 1, 2, 3) select image_id, cast(label as int) as label, cast(h as int) as h, top_px, bottom_px, top_px < bottom_px as flip from b""")
def end_band_flip(spark, d):
    """Of every region's own box: heights of all kinds, where the top tenth is rounded down and the bottom tenth up."""
    runs = labelled(spark, d)
    boxed = runs.join(R.regions(runs).select("image_id", "label", "y0", (F.col("y1") - F.col("y0") + 1).alias("h")), ["image_id", "label"])
    own = boxed.select("image_id", "label", "h", (F.col("y") - F.col("y0")).alias("y"), "x0", "x1")
    return R.bands(own, F.col("h"), ("image_id", "label", "h")).withColumn("flip", F.col("top_px") < F.col("bottom_px"))


@query(f"with {PX} select image_id, cast({WIDTH} - 1 - ({WIDTH} - 1 - x) as int) as y, y as x from m")
def turn_and_flip_pixels(spark, d):
    pixels = mask_runs(spark, d).select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"))
    return R.flipped(R.turned(pixels, 1, HEIGHT, WIDTH), WIDTH)


PPCM = "(85.0::double * 10 / ((280.0::double - 85.0::double) * (23.5::double / 6016)))"
PPCM_H = "(85.0::double * 10 / ((280.0::double - 85.0::double) * (15.6::double / 4016)))"


@query(f"""with recursive {REG} select image_id, cast(label as int) as label, round_even((x1 - x0) / {PPCM} * 1000, 0) / 1000 as width_cm, round_even((y1 - y0) / {PPCM_H} * 1000, 0) / 1000 as height_cm,
round(area / ({PPCM} * {PPCM_H}), 9) as area_cm2 from reg""")
def leaf_size_cm(spark, d):
    w, h = C.pixel_pitch(F.lit(6016), F.lit(4016))
    a, b = C.pixels_per_cm(F.lit(C.FOCAL_MM), w), C.pixels_per_cm(F.lit(C.FOCAL_MM), h)
    return measured(spark, d).select("image_id", "label", C.rint3((F.col("x1") - F.col("x0")) / a).alias("width_cm"), C.rint3((F.col("y1") - F.col("y0")) / b).alias("height_cm"), F.round(F.col("area") / (a * b), 9).alias("area_cm2"))


@query(f"""with recursive {REG}, c as (select image_id, max(greatest(y1 - y0 + 1, x1 - x0 + 1)) as max_dim from reg where area >= 2 group by 1)
select image_id, cast(max_dim as int) as max_dim, least(8.0::double / max_dim, 1.0::double) as scale, cast(trunc(max_dim * least(8.0::double / max_dim, 1.0::double)) as int) as scaled from c""")
def canvas_scale(spark, d):
    longest = F.greatest(F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1)
    out = measured(spark, d).where("area >= 2").groupBy("image_id").agg(F.max(longest).alias("max_dim"))
    scale = C.capped_scale(F.col("max_dim"), 8)
    return out.select("image_id", "max_dim", scale.alias("scale"), (F.col("max_dim") * scale).cast("int").alias("scaled"))


@query(f"with {PX}, a as (select image_id, avg(v) filter (where v > {LEVEL}) as mean from px group by 1) select image_id, round(mean, 9) as mean_v, round(sum(v / mean), 6) as total from px join a using (image_id) group by 1, 2")
def masked_mean_normalize(spark, d):
    v = picture_rows(spark, d).select("image_id", F.explode("embedding").alias("v")).select("image_id", F.col("v").cast("double"))
    out = v.groupBy("image_id").agg(F.avg(F.when(F.col("v") > LEVEL, F.col("v"))).alias("mean"), F.sum("v").alias("s"))
    return out.select("image_id", F.round("mean", 9).alias("mean_v"), F.round(F.try_divide("s", "mean"), 6).alias("total"))


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), n as (select vec_id, a, sqrt(list_sum(list_transform(a, lambda x: x * x))) as len from e)
select vec_id, round(len, 9) as length, round(list_min(list_transform(a, lambda x: greatest(least(x / greatest(len, 1e-12::double), 1.0::double), -1.0::double))), 9) as lowest, round(list_max(list_transform(a, lambda x: greatest(least(x / greatest(len, 1e-12::double), 1.0::double), -1.0::double))), 9) as highest from n""")
def unit_normalize_clip(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    u = C.clipped(C.unit(F.col("a")))
    return a.select("vec_id", F.round(F.sqrt(F.aggregate("a", F.lit(0.0), lambda s, x: s + x * x)), 9).alias("length"), F.round(F.array_min(u), 9).alias("lowest"), F.round(F.array_max(u), 9).alias("highest"))


@query(f"with recursive {REG} select image_id, cast(label as int) as label, greatest(0, y0 - 5) as py0, least({HEIGHT}, y1 + 5) as py1, greatest(0, x0 - 5) as px0, least({WIDTH}, x1 + 5) as px1 from reg")
def padded_crop_box(spark, d):
    box = C.padded_box(*(F.col(c) for c in ("y0", "y1", "x0", "x1")), F.lit(HEIGHT), F.lit(WIDTH), 5)
    return measured(spark, d).select("image_id", "label", *(b.alias(n) for b, n in zip(box, ("py0", "py1", "px0", "px1"))))


@query(f"""with recursive {REG}, b as (select image_id, label, cast(floor(trunc(greatest(y1 - y0, x1 - x0) * 1.2::double) / 2) as int) as half, cast(floor((y0 + y1) / 2) as int) as cy, cast(floor((x0 + x1) / 2) as int) as cx from reg)
select image_id, cast(label as int) as label, greatest(0, cy - half) as sy0, least({HEIGHT}, cy + half) as sy1, greatest(0, cx - half) as sx0, least({WIDTH}, cx + half) as sx1 from b""")
def square_crop_box(spark, d):
    box = C.square_box(*(F.col(c) for c in ("y0", "y1", "x0", "x1")), F.lit(HEIGHT), F.lit(WIDTH))
    return measured(spark, d).select("image_id", "label", *(b.alias(n) for b, n in zip(box, ("sy0", "sy1", "sx0", "sx1"))))


@query("""with s as (select p_partkey, p_size * 37 + 1 as w, p_partkey % 500 + 1 as h from part), f as (select *, least(1024.0::double / w, 1024.0::double / h) as k from s), n as (select *, cast(trunc(w * k) as int) as nw, cast(trunc(h * k) as int) as nh from f)
select p_partkey, nw, nh, cast(floor((1024 - nw) / 2) as int) as ox, cast(floor((1024 - nh) / 2) as int) as oy from n""")
def fit_and_letterbox(spark, d):
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("w"), (F.col("p_partkey") % 500 + 1).alias("h"))
    nw, nh = C.fit(F.col("w"), F.col("h"), 1024)
    return s.select("p_partkey", nw.alias("nw"), nh.alias("nh"), C.centred(nw, 1024).alias("ox"), C.centred(nh, 1024).alias("oy"))


@query("""with s as (select p_partkey, p_size * 37 + 1 as w, p_partkey % 500 + 1 as h, case when p_partkey % 7 = 0 then '105/2' when p_partkey % 5 = 0 then null else cast(p_partkey % 90 + 10 as varchar) end as printed from part),
f as (select *, case when printed is null then 85.0::double else try_cast(printed as double) end as f from s)
select p_partkey, case when w > h then 'landscape' else 'portrait' end as orientation, printed is null or f is not null as ok,
round(f * 10 / ((280.0::double - f) * case when w > h then 23.5::double / w else 15.6::double / w end), 6) as ppcm_w, round(f * 10 / ((280.0::double - f) * case when w > h then 15.6::double / h else 23.5::double / h end), 6) as ppcm_h from f""")
def camera_optics(spark, d):
    key = F.col("p_partkey")
    printed = F.when(key % 7 == 0, "105/2").when(key % 5 == 0, F.lit(None).cast("string")).otherwise((key % 90 + 10).cast("string"))
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("w"), (key % 500 + 1).alias("h"), C.focal_length(printed).alias("f"))
    a, b = C.pixel_pitch(F.col("w"), F.col("h"))
    return s.select("p_partkey", C.orientation(F.col("w"), F.col("h")).alias("orientation"), F.col("f.ok").alias("ok"), F.round(C.pixels_per_cm(F.col("f.mm"), a), 6).alias("ppcm_w"), F.round(C.pixels_per_cm(F.col("f.mm"), b), 6).alias("ppcm_h"))


@query("""with s as (select p_partkey, p_size * 37 + 1 as w, p_partkey % 500 + 1 as h, p_partkey % 17 as x, p_partkey % 13 as y from part)
select p_partkey, round((x / w - 0.5::double) * case when w > h then 2.0::double else w / h * 2.0::double end, 9) as wx, round((y / h - 0.5::double) * case when w > h then h / w * 2.0::double else 2.0::double end, 9) as wy, round(x / w, 9) as u, round(1.0::double - y / h, 9) as v from s""")
def world_and_uv(spark, d):
    key = F.col("p_partkey")
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("w"), (key % 500 + 1).alias("h"), (key % 17).alias("x"), (key % 13).alias("y"))
    p = [F.col(c) for c in ("x", "y", "w", "h")]
    return s.select("p_partkey", *(F.round(c, 9).alias(n) for c, n in zip((*C.to_world(*p, 2.0), *C.to_uv(*p)), ("wx", "wy", "u", "v"))))


# --- the catalogue


@query("select r_name, n_name, count(*) as n from region join nation on n_regionkey = r_regionkey join customer on c_nationkey = n_nationkey group by rollup (r_name, n_name)")
def object_rollup(spark, d):
    joined = table(spark, d, "region").join(table(spark, d, "nation"), F.col("n_regionkey") == F.col("r_regionkey")).join(table(spark, d, "customer"), F.col("c_nationkey") == F.col("n_nationkey"))
    return L.totals(joined, ["r_name", "n_name"])


@query("""with a as (select c_custkey, '1-URGENT' as stem from customer), o as (select o_custkey, o_orderpriority, min(o_orderkey) as k from orders group by 1, 2), f as (select o_custkey, min(o_orderkey) as k from orders group by 1)
select c_custkey, o.k is not null as matched, coalesce(o.k, f.k) as chosen from a left join o on o.o_custkey = c_custkey and o_orderpriority = stem left join f on f.o_custkey = c_custkey""")
def match_with_fallback(spark, d):
    left = table(spark, d, "customer").select("c_custkey", F.lit("1-URGENT").alias("stem"))
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("stem"), "o_orderkey")
    return L.match_with_fallback(left, right, "c_custkey", "stem", "o_orderkey").select("c_custkey", "matched", "chosen")


@query("select o_orderkey, o_orderstatus from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def skip_if_done_anti(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return L.not_done(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), done, "o_orderkey")


@query("""with a as (select l_orderkey, count(*) as n_in, count(*) filter (where l_linestatus = 'F') as n_out from lineitem group by 1) select l_orderkey, n_in, n_out, n_out >= n_in and n_in > 0 as skipped from a""")
def skip_by_count(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linestatus")
    return L.not_done_by_count(lines, lines.where("l_linestatus = 'F'"), "l_orderkey")


@query("select c_custkey, c_name from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'P')")
def folder_semi(spark, d):
    own = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_name").join(own, "c_custkey", "left_semi")


@query("select a.l_orderkey, a.l_linenumber as leaf, b.l_linenumber as picture from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber <> b.l_linenumber where a.l_returnflag = 'A'")
def companions_cross(spark, d):
    lines = table(spark, d, "lineitem")
    return L.companions(lines.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_linenumber").alias("leaf")), lines.select("l_orderkey", F.col("l_linenumber").alias("picture")), "l_orderkey", "leaf", "picture")


@query("""select l_orderkey, min(case when l_returnflag = 'A' then l_linenumber end) as mask, min(case when l_returnflag = 'N' then l_linenumber end) as diffuse, min(case when l_returnflag = 'R' then l_linenumber end) as normal
from lineitem group by 1 having count(distinct l_returnflag) = 3""")
def roles_all_present(spark, d):
    role = F.when(F.col("l_returnflag") == "A", "mask").when(F.col("l_returnflag") == "N", "diffuse").when(F.col("l_returnflag") == "R", "normal")
    return L.with_all_roles(table(spark, d, "lineitem").select("l_orderkey", role.alias("role"), "l_linenumber"), "l_orderkey", "role", "l_linenumber", ["mask", "diffuse", "normal"])


@query("select c_custkey, coalesce(n, 0) as n_orders, top from customer left join (select o_custkey, count(*) as n, max(o_totalprice) as top from orders group by 1) o on o_custkey = c_custkey")
def optional_size_left_join(spark, d):
    sizes = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return table(spark, d, "customer").select("c_custkey").join(sizes, "c_custkey", "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n_orders"), "top")


@query("select conv_id, count(*) as n_files from conversations group by 1 having count(*) >= 3")
def min_three_images(spark, d):
    return L.at_least(table(spark, d, "conversations"), "conv_id", 3)


ROLE_NAME = "lower(replace(p_name, ' ', '_')) || case p_partkey % 6 when 0 then '_diffuse.png' when 1 then '_mask.png' when 2 then '.jpg' when 3 then '_Normal.TIF' when 4 then '.tif.txt' else '.jpeg' end"


@query(f"""with f as (select p_partkey, {ROLE_NAME} as name from part) select p_partkey, name, (name like '%.png' or name like '%.jpg' or name like '%.jpeg') and not (name like '%\\_diffuse.png' escape '\\' or name like '%\\_mask.png' escape '\\') as counted,
(contains(lower(name), '.png') or contains(lower(name), '.jpg') or contains(lower(name), '.jpeg') or contains(lower(name), '.tif')) and not (contains(name, '_diffuse.png') or contains(name, '_mask.png') or contains(lower(name), 'mask') or contains(lower(name), 'normal')) as loaded from f""")
def role_filters(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.expr(ROLE_NAME).alias("name"))
    return f.select("p_partkey", "name", C.is_counted_companion(F.col("name")).alias("counted"), C.is_loaded_companion(F.col("name")).alias("loaded"))


@query(r"with b as (select page_id, list_last(string_split(url, '/')) as base from pages) select page_id, base, regexp_replace(base, '^(\.*[^.].*)\.[^.]*$', '\1') as stem from b")
def path_basename_stem(spark, d):
    return table(spark, d, "pages").select("page_id", C.basename(F.col("url")).alias("base")).withColumn("stem", C.stem(F.col("base")))


ASSET = "case when p_partkey % 3 = 0 then lower(p_brand) when p_partkey % 3 = 1 then lower(p_brand) || '_' || p_size else lower(p_brand) || '_' || replace(lower(p_type), ' ', '_') || '_' || p_size end"


@query(f"""with n as (select p_partkey, {ASSET} as name from part), s as (select *, string_split(name, '_') as p from n)
select p_partkey, p[1] as category, case when len(p) >= 3 then p[2] else 'default' end as subcategory, case when len(p) >= 3 then array_to_string(p[3:], '_') else name end as instance from s""")
def parse_name_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", C.parse_asset_name(F.expr(ASSET)).alias("n")).select("p_partkey", "n.*")


@query("select substr(n_name, 1, 1) as name, arg_min(r_name, (n_nationkey, r_name)) as parent, count(*) as members from nation join region on n_regionkey = r_regionkey group by 1")
def collection_tree_global(spark, d):
    rows = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return L.global_collections(rows.select(F.substring("n_name", 1, 1).alias("name"), F.col("r_name").alias("parent_name"), "n_nationkey"), "parent_name", "name", "n_nationkey")


@query("""select p_partkey, coalesce(sum(p_size::double + 0.5::double) over (order by p_brand, p_partkey rows between unbounded preceding and 1 preceding), 0) + p_size::double / 2 as "offset", row_number() over (order by p_brand, p_partkey) as seq from part""")
def running_offset(spark, d):
    rows = table(spark, d, "part").select("p_brand", "p_partkey", F.col("p_size").cast("double").alias("height"))
    return L.running_offset(rows, "p_brand", "p_partkey", "height", 0.5).select("p_partkey", "offset", "seq")


@query("select l_orderkey, l_linenumber, l_quantity from (select *, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber) as r from lineitem) where r = 1")
def top_contour_tiebreak(spark, d):
    return L.largest(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", "l_quantity", "l_linenumber")


@query("select p_partkey, 'leaf_' || p_partkey as name from part order by name offset 12")
def lexicographic_order_offset(spark, d):
    return L.without_first(table(spark, d, "part").select("p_partkey", F.concat(F.lit("leaf_"), "p_partkey").alias("name")), ["name", "p_partkey"], 12)


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by md5(doc_id || ':7'), doc_id) as r from documents) where r <= 5")
def seeded_sample(spark, d):
    return L.seeded_sample(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 5, 7)


@query("select o_orderkey from orders where o_orderstatus = 'F' union all select o_orderkey from orders where o_orderpriority = '1-URGENT'")
def union_all_globs(spark, d):
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_orderkey").unionByName(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))


@query("select o_orderkey from orders where o_orderstatus = 'F' except all select o_orderkey from orders where o_orderpriority = '1-URGENT'")
def difference(spark, d):
    orders = table(spark, d, "orders")
    return orders.where("o_orderstatus = 'F'").select("o_orderkey").exceptAll(orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey"))


@query("""with l as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_returnflag) as r from lineitem)
select o_orderkey, '{"leaf_count":' || count(*) || ',"leaves":{' || string_agg('"leaf_' || r || '":{"part":' || l_partkey || ',"flag":"' || l_returnflag || '","size":[' || l_linenumber || ',' || l_suppkey || ']}', ',' order by r) || '},"object_name":"o' || o_orderkey || '"}' as json
from orders join l on l_orderkey = o_orderkey group by o_orderkey""")
def nested_leaf_record(spark, d):
    lines = table(spark, d, "lineitem")
    leaf = F.struct(F.col("l_partkey").alias("part"), F.col("l_returnflag").alias("flag"), F.array(F.col("l_linenumber").cast("long"), "l_suppkey").alias("size"))
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", leaf.alias("value"))
    entry = F.transform(F.array_sort(F.collect_list(row)), lambda x, i: F.struct(F.concat(F.lit("leaf_"), i + 1).alias("key"), x["value"].alias("value")))
    by = lines.groupBy("l_orderkey").agg(F.count("*").alias("leaf_count"), F.map_from_entries(entry).alias("leaves"))
    joined = table(spark, d, "orders").join(by, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("o_orderkey", F.to_json(F.struct("leaf_count", "leaves", F.concat(F.lit("o"), "o_orderkey").alias("object_name")), {"ignoreNullFields": "false"}).alias("json"))


@query("select event_id, try_cast(json_extract_string(props, '$.k') as int) as k from events")
def json_read_fields(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("select event_id, case when value < 0 then 'negative' when try_cast(json_extract_string(props, '$.k') as int) % 10 = 0 then 'no object' end as reason, case when value < 0 or coalesce(try_cast(json_extract_string(props, '$.k') as int) % 10 = 0, false) then 'error' else 'ok' end as status from events")
def status_rows(spark, d):
    events = table(spark, d, "events")
    k = F.from_json("props", "k int")["k"]
    return L.statuses(events.select("event_id", "value", "props"), F.when(F.col("value") < 0, "negative").when(k % 10 == 0, "no object")).select("event_id", "reason", "status")


@query("""with e as (select l_orderkey, l_linenumber, unnest(['mask', 'diffuse', 'normal']) as role, unnest(['A', 'N', 'R']) as flag from lineitem) select count(*) as moved, role from e join (select distinct l_orderkey, l_returnflag from lineitem) x on x.l_orderkey = e.l_orderkey and x.l_returnflag = e.flag group by role""")
def moved_file_count(spark, d):
    lines = table(spark, d, "lineitem")
    roles = F.array(*(F.struct(F.lit(r).alias("role"), F.lit(f).alias("l_returnflag")) for r, f in (("mask", "A"), ("diffuse", "N"), ("normal", "R"))))
    expected = lines.select("l_orderkey", F.explode(roles).alias("e")).select("l_orderkey", "e.*")
    return expected.join(lines.select("l_orderkey", "l_returnflag").distinct(), ["l_orderkey", "l_returnflag"], "left_semi").groupBy("role").agg(F.count("*").alias("moved"))


@query(f"""with recursive {REG}, c as (select image_id, label, [x0, (x0 + x1) / 2.0::double, x1, x0] as xs, [y0::double, y1 + 2.0::double, y0 + 1.0::double, y1 - 0.5::double] as ys from reg),
e as (select image_id, label, unnest(range(1, 5)) as i, xs, ys from c), p as (select image_id, label, sum(sqrt((xs[i] - xs[i % 4 + 1]) * (xs[i] - xs[i % 4 + 1]) + (ys[i] - ys[i % 4 + 1]) * (ys[i] - ys[i % 4 + 1]))) as len from e group by 1, 2)
select image_id, cast(label as int) as label, round(len, 6) as perimeter, round(0.002::double * len, 9) as epsilon from p""")
def ring_perimeter(spark, d):
    """Of a skew ring of four corners of each region's box."""
    corner = lambda x, y: F.struct(F.expr(x).cast("double").alias("x"), F.expr(y).cast("double").alias("y"))
    length = C.arc_length(F.array(corner("x0", "y0"), corner("(x0 + x1) / 2", "y1 + 2"), corner("x1", "y0 + 1"), corner("x0", "y1 - 0.5")))
    return measured(spark, d).select("image_id", "label", F.round(length, 6).alias("perimeter"), F.round(F.lit(0.002) * length, 9).alias("epsilon"))


@query(None)
def region_contours(spark, d):
    from .plans.stages import contours_of

    rows = picture_rows(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("y", "embedding"))).alias("rows"))  # HEIGHT rows
    return contours_of(rows, LEVEL)


@query("""with l(src, src_socket, dst, dst_socket) as (values ('diffuse', 'Color', 'principled', 'Base Color'), ('diffuse', 'Color', 'hue_saturation', 'Color'), ('hue_saturation', 'Color', 'translucent', 'Color'),
('normal', 'Color', 'mix_colour_multiply', '1'), ('mask', 'Color', 'mix_colour_multiply', '2'), ('mix_colour_multiply', 'Color', 'normal_map', 'Color'), ('normal_map', 'Normal', 'principled', 'Normal'), ('normal_map', 'Normal', 'translucent', 'Normal'),
('mask', 'Color', 'principled', 'Alpha'), ('principled', 'BSDF', 'add_shader', '0'), ('translucent', 'BSDF', 'add_shader', '1'), ('add_shader', 'Shader', 'output', 'Surface'))
select p_partkey, case when src in ('diffuse', 'normal', 'mask') then p_partkey || '_' || src else src end as src, src_socket, dst, dst_socket from part, l""")
def material_graph(spark, d):
    """Every link by the types of its ends, textures by their files."""
    from .plans.scene import named_links

    texture = lambda end: F.concat(F.col("p_partkey").cast("string"), F.lit(end)).alias(end[1:])
    return named_links(table(spark, d, "part").select(F.col("p_partkey").alias("leaf"), texture("_diffuse"), texture("_normal"), texture("_mask"))).withColumnRenamed("leaf", "p_partkey")


# --- pixels of pictures

GREY = "cast(floor(least(greatest((v + 0.5::double) * 255, 0), 255)) as int)"  # a component as a brightness


def pixels(spark, d) -> DataFrame:
    """image_id, y, x, v, and g, the value as a brightness."""
    rows = picture_rows(spark, d).select("image_id", "y", F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))
    return rows.withColumn("g", F.expr("cast(floor(least(greatest((v + 0.5D) * 255, 0), 255)) as int)"))


@query(f"""with {PX}, a as (select image_id, {GREY} as g from px) select image_id, count(*) filter (where g > 204) as solid, count(*) filter (where g > 0) as visible, bool_and(g = 255) as opaque, min(g) < 255 and image_id % 3 <> 0 as has_alpha from a group by 1""")
def alpha_tests(spark, d):
    """Brightness as alpha; every third picture has three channels only."""
    by = pixels(spark, d).groupBy("image_id").agg(F.count_if(C.is_solid(F.col("g"))).alias("solid"), F.count_if(C.is_visible(F.col("g"))).alias("visible"), F.bool_and(F.col("g") == 255).alias("opaque"), F.min("g").alias("least"))
    return by.select("image_id", "solid", "visible", "opaque", C.has_alpha(F.when(F.col("image_id") % 3 == 0, 3).otherwise(4), F.col("least")).alias("has_alpha"))


@query(f"""with {PX}, a as (select image_id, y, x, {GREY} as g, v > {LEVEL} as own from px) select image_id, sum(case when own then g else 255 end)::bigint as whitened, sum(case when own then 255 else 0 end)::bigint as alpha, sum(case when own then g else 128 end)::bigint as neutral_red,
sum(case when own then g else 255 end)::bigint as neutral_blue, sum(cast(floor(g * (case when own then 1.0::double else 0.0::double end)) as int))::bigint as premultiplied from a group by 1""")
def composited_pixels(spark, d):
    """Pictures with their masks: white outside, mask as alpha, the colour of flat normals outside, premultiplied."""
    joined = R.under_mask(pixels(spark, d).select("image_id", "y", "x", "g"), mask_runs(spark, d))
    own, g = F.col("inside"), F.col("g")
    alpha = F.when(own, 255).otherwise(0)
    total = lambda c, name: F.sum(c).cast("long").alias(name)
    return joined.groupBy("image_id").agg(total(F.when(own, g).otherwise(255), "whitened"), total(alpha, "alpha"), total(F.when(own, g).otherwise(128), "neutral_red"), total(F.when(own, g).otherwise(255), "neutral_blue"), total(F.floor(g * (alpha / 255.0)).cast("int"), "premultiplied"))


@query(f"""with recursive {REG}, c as (select r.image_id, r.label, m.y - greatest(0, r.y0 - 2) as y, m.x - greatest(0, r.x0 - 2) as x from reg r join m on m.image_id = r.image_id and m.y >= greatest(0, r.y0 - 2) and m.y < least({HEIGHT}, r.y1 + 2) and m.x >= greatest(0, r.x0 - 2) and m.x < least({WIDTH}, r.x1 + 2) where r.area >= 3)
select image_id, cast(label as int) as label, count(*) as px, cast(max(y) as int) as last_y, cast(max(x) as int) as last_x, sum(x)::bigint as sum_x from c group by 1, 2""")
def cropped_runs(spark, d):
    """Whatever foreground lies in each region's box and two pixels around it, moved to the box's origin."""
    box = C.padded_box(*(F.col(c) for c in ("y0", "y1", "x0", "x1")), F.lit(HEIGHT), F.lit(WIDTH), 2)
    boxes = measured(spark, d).where("area >= 3").select("image_id", "label", *(b.alias(n) for b, n in zip(box, ("by0", "by1", "bx0", "bx1"))))
    runs = mask_runs(spark, d).join(boxes, "image_id")
    out = R.cropped(runs, *(F.col(c) for c in ("by0", "by1", "bx0", "bx1")), keys=("image_id", "label"))
    n, middle = F.col("x1") - F.col("x0") + 1, F.col("x0") + F.col("x1")
    return out.groupBy("image_id", "label").agg(F.sum(n).cast("long").alias("px"), F.max("y").alias("last_y"), F.max("x1").alias("last_x"), F.sum((n * middle / 2).cast("long")).alias("sum_x"))


@query(f"""with recursive {REG}, c as (select image_id, label, y1 - y0 + 1 as h, x1 - x0 + 1 as w, max(greatest(y1 - y0 + 1, x1 - x0 + 1)) over (partition by image_id) as max_dim from reg where area >= 2), s as (select *, least(8.0::double / max_dim, 1.0::double) as k from c)
select image_id, cast(label as int) as label, cast(max_dim as int) as max_dim, cast(trunc(w * k) as int) as nw, cast(trunc(h * k) as int) as nh, cast(floor((8 - cast(trunc(w * k) as int)) / 2) as int) as ox, cast(floor((8 - cast(trunc(h * k) as int)) / 2) as int) as oy from s""")
def common_canvas(spark, d):
    """Every region at the scale of its picture's largest, centred on a canvas of eight."""
    own = measured(spark, d).where("area >= 2").select("image_id", "label", (F.col("y1") - F.col("y0") + 1).alias("h"), (F.col("x1") - F.col("x0") + 1).alias("w"))
    sized = L.with_greatest(own, "image_id", F.greatest("h", "w"), "max_dim")
    k = C.capped_scale(F.col("max_dim"), 8)
    nw, nh = (F.col("w") * k).cast("int"), (F.col("h") * k).cast("int")
    return sized.select("image_id", "label", "max_dim", nw.alias("nw"), nh.alias("nh"), C.centred(nw, 8).alias("ox"), C.centred(nh, 8).alias("oy"))


@query(f"""with p as (select distinct vec_id // {HEIGHT} as image_id from embeddings), {PX}, f as (select image_id, count(*) filter (where v > 0.45) as n from px group by 1)
select image_id, n as area, case when n = 0 then 'no foreground' end as reason, case when n = 0 then 'skipped' else 'ok' end as status from p join f using (image_id)""")
def empty_foreground(spark, d):
    """Pictures at a level that some don't reach: those are told, not left out."""
    rows = picture_rows(spark, d)
    return L.with_empty(rows.select("image_id").distinct(), R.runs_of_rows(rows, "embedding", 0.45), "image_id")


@query(f"""with recursive {REG}, t as (select image_id, label, y0, x0, y1 - y0 + 1 as h, x1 - x0 + 1 as w from reg where area >= 8),
o as (select s.image_id, s.label, round(degrees(0.5::double * atan2((2 * (n * sxy - sx * sy))::double, ((n * syy - sy * sy) - (n * sxx - sx * sx))::double)), 9) as theta
  from (select image_id, label, count(*)::hugeint as n, sum(x)::hugeint as sx, sum(y)::hugeint as sy, sum(x * x)::hugeint as sxx, sum(y * y)::hugeint as syy, sum(x * y)::hugeint as sxy from lp group by 1, 2) s),
a as (select *, 90.0::double - theta as turn from t join o using (image_id, label)),
k as (select *, turn = 90.0 * round(turn / 90.0) as quarter, round(cos(-radians(turn - 360.0 * floor(turn / 360.0))), 15) as c, round(sin(-radians(turn - 360.0 * floor(turn / 360.0))), 15) as s from a),
z as (select *, -c * w / 2 - s * h / 2 + w / 2.0::double as tx, s * w / 2 - c * h / 2 + h / 2.0::double as ty from k),
b as (select *, ceil(greatest(tx, c * w + tx, c * w + s * h + tx, s * h + tx)) - floor(least(tx, c * w + tx, c * w + s * h + tx, s * h + tx)) as nw, ceil(greatest(ty, -s * w + ty, -s * w + c * h + ty, c * h + ty)) - floor(least(ty, -s * w + ty, -s * w + c * h + ty, c * h + ty)) as nh from z)
select image_id, cast(label as int) as label, round(turn, 6) as turn, cast(nh as bigint) as height, cast(nw as bigint) as width from b where not quarter""")
def turned_canvases(spark, d):
    """Size of the picture that holds each region's box when its long axis is turned level, where that is no quarter turn."""
    own = measured(spark, d).where("area >= 8")
    turn = F.lit(90.0) - F.round(R.angle(), 9)
    sized = own.select("image_id", "label", turn.alias("turn"), *C.turned_size(F.col("y1") - F.col("y0") + 1, F.col("x1") - F.col("x0") + 1, turn))
    return sized.where(F.col("turn") != 90.0 * F.round(F.col("turn") / 90.0)).select("image_id", "label", F.round("turn", 6).alias("turn"), "height", "width")


@query("""with e as (select vec_id, list_transform(embedding, lambda x: x::double) as a from embeddings), t as (select vec_id, unnest(range(0, 21)) as i, a from e),
n as (select vec_id, i, a[3 * i + 1] as x, a[3 * i + 2] as y, a[3 * i + 3] as z, sqrt(a[3 * i + 1] * a[3 * i + 1] + a[3 * i + 2] * a[3 * i + 2] + a[3 * i + 3] * a[3 * i + 3]) as len from t)
select vec_id, sum(cast(floor(round((greatest(least(z / greatest(len, 1e-12::double), 1), -1) + 1) / 2 * 255, 6)) as int))::bigint as blue, sum(cast(floor(round((greatest(least(x / greatest(len, 1e-12::double), 1), -1) + 1) / 2 * 255, 6)) as int))::bigint as red, (64 * 3)::bigint as channels from n group by 1""")
def normal_colours(spark, d):
    """Triples of components as normals, made unit, clipped, as colours with channels reversed; and a grey row as three channels."""
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    triples = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: C.clipped(C.unit(F.slice("a", 3 * i + 1, 3))))
    colours = F.transform(triples, lambda n: F.reverse(F.transform(n, lambda x: F.floor(F.round((x + 1) / 2 * 255, 6)).cast("int"))))
    total = lambda k: F.aggregate("rgb", F.lit(0).cast("long"), lambda s, n: s + n[k])
    return a.select("vec_id", colours.alias("rgb"), F.size(F.flatten(C.three_channels(F.col("a")))).cast("long").alias("channels")).select("vec_id", total(0).alias("blue"), total(2).alias("red"), "channels")


@query("""select vec_id, 7 + 64 + 5 as size, round(list_sum(list_transform(embedding, lambda x: x::double)), 9) as total, round(list_max(list_transform(embedding, lambda x: greatest(x::double, 0))), 9) as highest, round(embedding[10]::double, 9) as tenth from embeddings""")
def padded_arrays(spark, d):
    """Zeros put before and behind, as rows are put back into a frame."""
    a = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    p = a.select("vec_id", C.zero_padded(F.col("a"), 7, 5).alias("p"))
    return p.select("vec_id", F.size("p").alias("size"), F.round(F.aggregate("p", F.lit(0.0), lambda s, x: s + x), 9).alias("total"), F.round(F.array_max("p"), 9).alias("highest"), F.round(F.col("p")[16], 9).alias("tenth"))


# --- names, sizes and scales


FOLDER = "case when p_partkey % 3 = 0 then 'leaf_' || p_size when p_partkey % 3 = 1 then lower(replace(p_name, ' ', '_')) || '_full_photo.png' else 'processed_leaf_' || p_size end"


@query(f"""with f as (select p_partkey, {FOLDER} as name from part) select p_partkey, name, starts_with(name, 'leaf_') as is_leaf, not ends_with(name, 'full_photo.png') as is_part, replace(name, 'leaf_', '') as number from f""")
def leaf_folder_names(spark, d):
    f = table(spark, d, "part").select("p_partkey", F.expr(FOLDER).alias("name"))
    return f.select("p_partkey", "name", C.is_leaf_folder(F.col("name")).alias("is_leaf"), C.is_part_photo(F.col("name")).alias("is_part"), C.leaf_number(F.col("name")).alias("number"))


@query("""with s as (select p_partkey, p_size * 37 + 1 as w, p_partkey % 500 + 1 as h from part), c as (select *, case when w > 512 or h > 512 then 512 else w end as cw, case when w > 512 or h > 512 then 512 else h end as ch from s)
select p_partkey, cast(cw as int) as cw, cast(ch as int) as ch, cast(case when greatest(cw, ch) <= 32 then 32 when greatest(cw, ch) <= 64 then 64 when greatest(cw, ch) <= 128 then 128 when greatest(cw, ch) <= 256 then 256 else 512 end as int) as side,
case when w / h > 1920::double / 1080 then 1920 else cast(trunc(1080::double * (w / h)) as int) end as fw, case when w / h > 1920::double / 1080 then cast(trunc(1920::double / (w / h)) as int) else 1080 end as fh from c""")
def stage_sizes(spark, d):
    """Pictures capped at 512, the square that a network of stages takes, and the size that fits 1920 x 1080."""
    s = table(spark, d, "part").select("p_partkey", (F.col("p_size") * 37 + 1).alias("w"), (F.col("p_partkey") % 500 + 1).cast("int").alias("h"))
    cw, ch = C.capped_size(F.col("w"), F.col("h"), 512)
    c = s.select("*", cw.alias("cw"), ch.alias("ch"))
    fw, fh = C.aspect_fit(F.col("w"), F.col("h"), 1920, 1080)
    return c.select("p_partkey", "cw", "ch", C.stage_side(F.col("ch"), F.col("cw")).alias("side"), fw.alias("fw"), fh.alias("fh"))


@query(f"""with recursive {REG} select image_id, cast(label as int) as label, round((x1 - x0 + 1) / 60.14::double, 9) as width_cm, round((y1 - y0 + 1) / 60.14::double, 9) as height_cm,
round((x1 - x0) / (85.0::double * 10 / ((280.0::double - 85.0::double) * ((23.5::double / 6016 + 15.6::double / 4016) / 2))), 9) as mean_cm from reg""")
def leaf_scales(spark, d):
    """Sizes at the fixed scale, and by the mean pixel pitch."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    scale = C.pixels_per_cm(F.lit(C.FOCAL_MM), C.mean_pitch(F.lit(6016), F.lit(4016)))
    return measured(spark, d).select("image_id", "label", F.round(C.fixed_cm(w + 1), 9).alias("width_cm"), F.round(C.fixed_cm(h + 1), 9).alias("height_cm"), F.round(w / scale, 9).alias("mean_cm"))


# --- files, records and placements


@query("""with f as (select l_orderkey, l_partkey, l_linenumber, case when l_returnflag = 'R' then 0 else 1 end as rank, 'p' || l_partkey as path from lineitem where l_returnflag <> 'A')
select l_orderkey, arg_min(path, {'rank': rank, 'path': path}) as path from f group by 1""")
def processed_or_folder(spark, d):
    """Of each leaf's textures those in its processed folder, else those beside it; of several the first name."""
    f = table(spark, d, "lineitem").where("l_returnflag <> 'A'").select("l_orderkey", F.concat(F.lit("p"), "l_partkey").alias("path"), F.col("l_returnflag").alias("place"))
    return L.preferred(f, ["l_orderkey"], F.when(F.col("place") == "R", 0).otherwise(1), "path")


@query("""select o_orderkey, c.c_custkey is not null as has_normal, c.c_custkey is not null and c.c_nationkey % 5 <> o.o_custkey % 5 as resized from orders o left join customer c on c.c_custkey = o.o_custkey and c.c_acctbal > 0""")
def normal_map_sizes(spark, d):
    """Pictures beside their normals, which may be missing, or of another size and so are resized."""
    sizes = table(spark, d, "orders").select("o_orderkey", "o_custkey", (F.col("o_custkey") % 5).alias("size"))
    normals = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), (F.col("c_nationkey") % 5).alias("normal_size"))
    return L.with_resize(sizes, normals, "o_custkey", "size", "normal_size").select("o_orderkey", F.col("found").alias("has_normal"), "resized")


@query("""with s as (select p_partkey, p_brand, p_size::double as h, p_size % 7 as tilt, case when p_partkey % 4 = 0 then null else p_retailprice / 10 end as cm from part),
b as (select *, h + tilt as height, -(h / 3) as low, case when cm is not null and h + tilt > 0 then cm / 100 / (h + tilt) else 1.0::double end as factor from s)
select p_partkey, round(height * factor, 9) as height, round(factor, 9) as factor, round(h / 3 * factor, 9) as z, round(coalesce(sum(height * factor + 0.5::double) over (order by p_brand, p_partkey rows between unbounded preceding and 1 preceding), 0) + height * factor / 2, 6) as y from b""")
def placements(spark, d):
    """Boxes turned about the x axis, brought to their measured height, stacked along y and dropped to the ground."""
    from .plans.scene import placed

    parts, h = table(spark, d, "part"), F.col("p_size").cast("double")
    corner = lambda x, y, z: F.struct(F.lit(x).cast("double").alias("x"), y.alias("y"), z.alias("z"))
    corners = F.array(*(corner(x, y, z) for x in (0, 1) for y in (-F.lit(0.0), -(h + F.col("p_size") % 7)) for z in (-F.lit(0.0), h / 3)))
    meshes = parts.select(F.col("p_brand").alias("object_name"), F.col("p_partkey").alias("mesh_name"), corners.alias("corners"))
    sizes = parts.where("p_partkey % 4 <> 0").select(F.col("p_partkey").alias("mesh_name"), (F.col("p_retailprice") / 10).alias("height_cm"))
    out = placed(meshes, sizes, use_sizes=True)
    return out.select(F.col("mesh_name").alias("p_partkey"), F.round("height", 9).alias("height"), F.round("factor", 9).alias("factor"), F.round("z", 9).alias("z"), F.round("y", 6).alias("y"))


CAMERA_SQL = """'{"distance_mm":280.0,"focal_length_mm":85.0,"image_height":4016,"image_width":6016,"orientation":"landscape","pixel_size_h_mm":0.003884,"pixel_size_w_mm":0.003906,"pixels_per_cm_horizontal":1115.9,"pixels_per_cm_vertical":1122.16,"sensor_height_mm":15.6,"sensor_width_mm":23.5}'"""


@query(f"""with recursive {REG}, n as (select *, row_number() over (partition by image_id order by label) as i, round_even((x1 - x0) / {PPCM} * 1000, 0)::bigint as wc, round_even((y1 - y0) / {PPCM_H} * 1000, 0)::bigint as hc, round_even(area / ({PPCM} * {PPCM_H}) * 1000, 0)::bigint as ac from reg where area >= 12)
select image_id, count(*) as leaf_count, '{{"camera_parameters":' || {CAMERA_SQL} || ',"leaf_count":' || count(*) || ',"leaves":{{' || string_agg('"leaf_' || i || '":{{"dimensions":{{"area_cm2":' || (ac / 1000.0::double)::varchar || ',"height_cm":' || (hc / 1000.0::double)::varchar || ',"width_cm":' || (wc / 1000.0::double)::varchar || '}},"leaf_id":"leaf_' || i || '","object_name":"o' || image_id
|| '","pixels":{{"area_pixels":' || area || ',"height_pixels":' || (y1 - y0) || ',"width_pixels":' || (x1 - x0) || '}},"processing_info":{{"measured_at_full_resolution":true,"measurement_method":"focal_length_distance_based","original_image_size":[6016,4016],"source":"full_resolution_raw","transformations_applied":["cropping","orientation_alignment"]}}}}', ',' order by i) || '}},"object_name":"o' || image_id || '"}}' as json from n group by image_id""")
def object_records(spark, d):
    """A picture's JSON as it is written: camera, and every leaf's sizes."""
    from .plans import outputs

    leaves = L.ordinals(measured(spark, d), "image_id", "label", F.col("area") >= 12)
    photos = leaves.select("image_id").distinct().select("image_id", F.concat(F.lit("o"), "image_id").alias("object_name"), F.lit(6016).alias("w"), F.lit(4016).alias("h"), F.lit("85").alias("printed"))
    return outputs.object_json(outputs.sized(leaves, photos), photos).select(F.expr("cast(substr(object_name, 2) as bigint)").alias("image_id"), "leaf_count", "json")


@query("""with o as (select c_custkey, count(o_orderkey) as n from customer left join orders on o_custkey = c_custkey group by 1) select count(*) as total_objects, sum(n)::bigint as total_leaves, count(*) filter (where n > 0) as listed from o""")
def dataset_totals(spark, d):
    """The summary's counts: every folder is an object, but only those with records are listed."""
    from .plans import outputs

    objects = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("object_name"))
    records = table(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("object_name")).agg(F.count("*").alias("leaf_count"), F.lit("{}").alias("json"))
    found = outputs.summary_json(objects, records, "base", "now").select(F.from_json("json", "dataset_info struct<total_objects: long, total_leaves: long>, objects map<string, struct<a: int>>").alias("s"))
    return found.select("s.dataset_info.*", F.size("s.objects").cast("long").alias("listed"))
