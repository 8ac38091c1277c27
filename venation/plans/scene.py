"""The scene as tables: material graphs and placements. Rendering is out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import relational as L


def material_nodes() -> list[tuple[str, str]]:
    """(id, type) of the nodes of a leaf's material."""
    # A translucent leaf from three textures. The mask multiplies the normals, at a factor of 1.
    return [
        ("output", "output"), ("surface", "principled"), ("through", "translucent"), ("sum", "add_shader"), ("colour", "texture"),
        ("normals", "texture"), ("mask", "texture"), ("tint", "hue_saturation"), ("bump", "normal_map"), ("masked", "mix_colour_multiply"),
    ]


def material_links() -> list[tuple[str, str, str, str]]:
    """(source, its socket, target, its socket)."""
    # Fixed values, as above.
    return [
        ("colour", "Color", "surface", "Base Color"), ("colour", "Color", "tint", "Color"), ("tint", "Color", "through", "Color"), ("normals", "Color", "masked", "1"),
        ("mask", "Color", "masked", "2"), ("masked", "Color", "bump", "Color"), ("bump", "Normal", "surface", "Normal"), ("bump", "Normal", "through", "Normal"),
        ("mask", "Color", "surface", "Alpha"), ("surface", "BSDF", "sum", "0"), ("through", "BSDF", "sum", "1"), ("sum", "Shader", "output", "Surface"),
    ]


#: The column of each texture node's file.
TEXTURES = {"colour": "diffuse", "normals": "normal", "mask": "mask"}


def materials(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and links of every leaf (leaf, diffuse, normal, mask): the graph is constant but for the textures."""
    array = lambda rows, names: F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, row))) for row in rows))
    nodes = leaves.select("leaf", "diffuse", "normal", "mask", F.explode(array(material_nodes(), ["id", "type"])).alias("n")).select("leaf", "n.*", F.coalesce(*(F.when(F.col("n.id") == i, F.col(file)) for i, file in TEXTURES.items())).alias("texture"), F.when(F.col("n.id").isin("normals", "mask"), "Non-Color").alias("colour_space"))
    links = leaves.select("leaf", F.explode(array(material_links(), ["src", "src_socket", "dst", "dst_socket"])).alias("l")).select("leaf", "l.*")
    return nodes, links


def named_links(leaves: DataFrame) -> DataFrame:
    """Links of every row of leaves (leaf, diffuse, normal, mask) by what their ends are, textures by their files and other nodes by their types: leaf, src, src_socket, dst, dst_socket.

    The graph is constant, so ends are named row by row: no join, and nothing of the leaves is broadcast.
    """
    what = {i: F.col(TEXTURES[i]) if i in TEXTURES else F.lit(kind) for i, kind in material_nodes()}
    ends = (F.struct(what[src].alias("src"), F.lit(a).alias("src_socket"), what[dst].alias("dst"), F.lit(b).alias("dst_socket")) for src, a, dst, b in material_links())
    return leaves.select("leaf", F.explode(F.array(*ends)).alias("l")).select("leaf", "l.*")


def extent(corners: str, axis: str):
    """Length of an array of corner structs along an axis."""
    values = F.transform(F.col(corners), lambda c: c[axis])
    return F.array_max(values) - F.array_min(values)


def upturned(corners: str):
    """An array of corner structs turned half about the x axis."""
    return F.transform(F.col(corners), lambda c: F.struct(c["x"].alias("x"), (-c["y"]).alias("y"), (-c["z"]).alias("z")))


def scaled_to_size(meshes: DataFrame, sizes: DataFrame | None, use_sizes: bool = False) -> DataFrame:
    """Meshes (mesh_name, height) with a factor that brings them to their measured height in metres; 1 unless asked for."""
    if not use_sizes or sizes is None:
        return meshes.withColumn("factor", F.lit(1.0))
    joined = meshes.join(sizes.select("mesh_name", "height_cm"), "mesh_name", "left")
    return joined.withColumn("factor", F.coalesce(F.when(F.col("height") > 0, F.try_divide(F.col("height_cm") / 100, F.col("height"))), F.lit(1.0))).drop("height_cm")


def placed(meshes: DataFrame, sizes: DataFrame | None = None, spacing: float = 0.5, use_sizes: bool = False) -> DataFrame:
    """Where each mesh (object_name, mesh_name, corners of its box) stands: seq, height, factor, x, y, z.

    Meshes are turned half about the x axis, brought to their measured size if asked for, stacked along y in the order of
    (object_name, mesh_name) with gaps, and dropped so that the lowest corner is at z = 0.
    """
    up = meshes.withColumn("corners", upturned("corners"))
    sized = scaled_to_size(up.withColumn("height", extent("corners", "y")).withColumn("low", F.array_min(F.transform("corners", lambda c: c["z"]))), sizes, use_sizes)
    sized = sized.withColumn("height", F.col("height") * F.col("factor")).withColumn("low", F.col("low") * F.col("factor")).drop("corners")
    stacked = L.running_offset(sized, "object_name", "mesh_name", "height", spacing)
    return stacked.select("object_name", "mesh_name", "seq", "height", "factor", F.lit(0.0).alias("x"), F.col("offset").alias("y"), (-F.col("low")).alias("z"))


def collections(leaves: DataFrame) -> DataFrame:
    """(name, parent, members) of the collections of leaves (object_name, leaf): below one root, a category's, below that the subcategory's.

    A name is one collection wherever it is met, below the parent that it was first met under.
    """
    named = leaves.select("object_name", "leaf", C.parse_asset_name(F.col("object_name")).alias("n")).select("object_name", "leaf", "n.*")
    order = F.struct("object_name", "leaf")
    rows = named.select(F.lit("LeafMeshes").alias("parent_name"), F.col("category").alias("name"), order.alias("met"), F.lit(0).alias("depth"))
    rows = rows.unionByName(named.select(F.col("category").alias("parent_name"), F.col("subcategory").alias("name"), order.alias("met"), F.lit(1).alias("depth")))
    return L.global_collections(rows.withColumn("met", F.struct("met", "depth")), "parent_name", "name", "met")
