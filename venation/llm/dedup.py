"""Near duplicates: universal-hash minima, banding, signature verification, and star-contracted components.

1. One pass over the texts makes each document's set of word shingles (hashed to 64 bits), a 128-bit digest of the set and
   MINIMA minima, each under its own multiply-shift universal hash.
2. Documents of equal sets are one class, held by its smallest id. Only classes go on, so copies cost one row each.
3. Minima are cut into bands of ROWS. In each band's bucket every class is paired with the bucket's first class and with
   its most central one, whose buckets are the fullest: pairs grow with the members of a bucket, not with their square.
4. A pair goes on if its signatures agree in at least `floor` of the minima (the threshold less five standard deviations),
   and is a link if the shingle sets themselves reach the threshold.
5. Components by alternating large-star and small-star.
6. What step 3 left out are links between classes of one bucket that are in different components. Classes of such buckets
   are joined by their rarest shingles: two sets can reach the threshold only if they share one of the first
   n - t + 1 in order of rarity, t being the overlap that their sizes call for. Copies that each changed more than that
   share none, so the join stays small where a bucket is large. Pairs found are verified as in step 4, and components
   are taken once more. So no link of a bucket is lost.

At the threshold of 0.8 a pair misses all 40 bands of 5 with probability (1 - 0.8**5)**40 = 1.2e-7.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import forget, ship, written
from ._text import U, grams, hashes, mix, runs, spans, utf8
from .components import components

BANDS, ROWS = 40, 5
MINIMA = BANDS * ROWS
SCHEMA = "doc_id long, n_shingles long, hi long, lo long, minima binary"


def shingle_sets(column: pa.Array, k: int):
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        part, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        starts, ends, first = spans(part, where)
        words = hashes(part, starts, ends, True)
        found, at = grams(words, first, k)
        for i in range(b - a):
            if at[i + 1] > at[i]:
                yield np.unique(found[at[i] : at[i + 1]])
            else:
                mine = words[first[i] : first[i + 1]]
                yield mix(np.array([np.bitwise_xor.reduce(mix(mine + U(len(mine)) * np.arange(1, len(mine) + 1, dtype=U)))], U)) if len(mine) else mine


def minima(found: np.ndarray, a: np.ndarray, b: np.ndarray, tile: int = 256) -> np.ndarray:
    """Minimum of a * x + b modulo 2**64 over the set, for each of the hash functions."""
    least = np.full(len(a), np.iinfo(U).max, U)
    for lo in range(0, len(found), tile):
        part = np.multiply.outer(a, found[lo : lo + tile])
        part += b[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    return least


def hash_functions(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 63, MINIMA, U) * U(2) + U(1), rng.integers(0, 1 << 63, MINIMA, U)


def digest(found: np.ndarray) -> np.ndarray:
    """128 bits that equal sets share: two sums of hashes, mixed. Of these `lo` names the class."""
    return mix(np.array([found.sum(dtype=U) + U(len(found)), mix(found + U(0x51ED270B9F3A1C77)).sum(dtype=U)], U)).view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, hi and lo (digest of the set) and minima (upper 32 bits of each, as bytes; null if the set is empty)."""
    ship(docs.sparkSession)

    def of(batches):
        a, b = hash_functions()
        for batch in batches:
            rows: list[list] = [[], [], [], []]
            for found in shingle_sets(batch.column(1), k):
                for out, x in zip(rows, (len(found), *(digest(found).tolist() if len(found) else [None, None]), (minima(found, a, b) >> U(32)).astype("<u4").tobytes() if len(found) else None)):
                    out.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(rows, (*[pa.int64()] * 3, pa.binary())))], ["doc_id", "n_shingles", "hi", "lo", "minima"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, SCHEMA)


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, id): a row for each band of each class."""
    ship(classes.sparkSession)

    def of(batches):
        salt = mix(np.arange(1, BANDS + 1, dtype=U))
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, BANDS, ROWS).astype(U)
            key = np.broadcast_to(salt, flat.shape[:2]).copy()
            for i in range(ROWS):
                key = mix(key ^ flat[:, :, i])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), BANDS))], ["key", "id"])

    return classes.select("id", "minima").mapInArrow(of, "key long, id long")


def alike(pairs: DataFrame, classes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose signatures agree in at least `floor` of the minima."""

    def of(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u4").reshape(-1, MINIMA) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= floor * MINIMA))

    own = classes.select("id", "minima")
    both = pairs.join(own.withColumnsRenamed({"id": "a", "minima": "x"}), "a").join(own.withColumnsRenamed({"id": "b", "minima": "y"}), "b")
    return both.select("a", "b", "x", "y").mapInArrow(of, "a long, b long")


def packed_sets(texts: DataFrame, k: int) -> DataFrame:
    """(id, shingles): the class of each text and its sorted shingle hashes as bytes."""

    def of(batches):
        for batch in batches:
            rows: list[list] = [[], []]
            size = 0
            for found in shingle_sets(batch.column(0), k):
                if len(found):
                    rows[0].append(int(digest(found)[1]))
                    rows[1].append(found.tobytes())
                    size += found.nbytes
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["id", "shingles"])
                    rows, size = [[], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary())], ["id", "shingles"])

    return texts.select("text").mapInArrow(of, "id long, shingles binary")


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have 100 * intersection >= percent * union."""

    def of(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                if 100 * len(x) < percent * len(y):
                    keep.append(False)
                    continue
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), classes, docs)
    sets = written(packed_sets(texts, k).dropDuplicates(["id"]), "sets")
    both = pairs.join(sets.withColumnsRenamed({"id": "a", "shingles": "x"}), "a").join(sets.withColumnsRenamed({"id": "b", "shingles": "y"}), "b")
    out = written(both.select("a", "b", "x", "y").mapInArrow(of, "a long, b long"), "links")
    forget(sets)
    return out


def texts_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """One text at least of each class in ids."""
    wanted = classes.join(ids, "id", "left_semi").select("doc_id")
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])


def by_rare_shingles(mixed: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) of classes in different components that can reach the threshold, by their rarest shingles."""

    def of(batches):
        for batch in batches:
            for i, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(x.as_buffer(), U)
                for lo in range(0, len(found), 1 << 16):
                    part = found[lo : lo + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), i, np.int64)), pa.array(part.view(np.int64)), pa.array(np.full(len(part), len(found), np.int64))], ["id", "shingle", "n"])

    sets = packed_sets(texts_of(mixed, classes, docs), k).dropDuplicates(["id"])
    every = written(sets.mapInArrow(of, "id long, shingle long, n long").join(mixed, "id"), "shingles")
    often = every.groupBy("shingle").agg(F.count("*").alias("df"))
    place = F.row_number().over(W.partitionBy("id").orderBy("df", "shingle")) - 1
    ranked = every.join(often, "shingle").withColumn("place", place).where(f"df > 1 and place <= n - n * {percent} / 100")
    ranked = written(ranked.select("id", "shingle", "n", "component", "place"), "ranked")
    x, y = (ranked.select("shingle", *(F.col(c).alias(f"{c}_{s}") for c in ("id", "n", "component", "place"))) for s in "ab")
    # the overlap t is percent / (100 + percent) of both sizes; a shared shingle must stand among the first n - t + 1 of both
    spare = lambda s: (F.col(f"n_{s}") - F.col(f"place_{s}")) * (100 + percent) >= percent * (F.col("n_a") + F.col("n_b"))
    found = x.join(y, (x["shingle"] == y["shingle"]) & (F.col("id_a") < F.col("id_b")) & (F.col("component_a") != F.col("component_b")) & spare("a") & spare("b"))
    out = written(found.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct(), "left")
    forget(every, ranked)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the smallest doc_id it is linked with, over any number of links), kept.

    Words are runs of bytes other than white space, A-Z lower-cased; shingles are k of them in a row. Null, empty and
    blank texts have the empty set and stand alone, and so do rows with a null id. Rows that repeat an id stay rows; with
    other texts each has the component of its own text. Extra columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    signed = written(signatures(docs, k), "signatures")
    whole = signed.where("minima is not null and doc_id is not null")
    # documents of one set, by its digest: smallest id, and the signature
    classes = written(whole.groupBy("hi", "lo").agg(F.min_by(F.struct("doc_id", "minima"), "doc_id").alias("r")).select(F.col("lo").alias("id"), "r.doc_id", "r.minima"), "classes")
    keys = written(band_keys(classes), "bands")
    shared = written(keys.join(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key"), "shared")
    centred = shared.join(shared.groupBy("id").agg(F.sum("n").alias("weight")), "id")
    buckets = centred.groupBy("key").agg(F.min("id").alias("low"), F.max(F.struct("weight", "id"))["id"].alias("centre"))
    stars = shared.join(buckets, "key").select("id", F.explode(F.array("low", "centre")).alias("end")).where("id <> end")
    pairs = stars.select(F.least("id", "end").alias("a"), F.greatest("id", "end").alias("b")).distinct()
    forget(keys)
    floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / MINIMA) ** 0.5
    near = written(alike(pairs, classes, floor), "alike")
    links = confirmed(near, classes, docs, k, percent)
    found = written(components(links), "components")
    # what the stars left out: links within a bucket of classes whose components differ
    placed = shared.join(found, shared["id"] == found["node"], "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    mixed = written(placed.join(mixed, "key", "left_semi").select("id", "component").distinct(), "mixed")
    left = by_rare_shingles(mixed, classes, docs, k, percent)
    more = written(alike(left.join(near, ["a", "b"], "left_anti"), classes, floor), "alike")
    late = confirmed(more, classes, docs, k, percent)
    if late.limit(1).count():
        found = written(components(links.unionByName(late)), "components")
    forget(shared, near, links, mixed, left, more, late)
    classed = classes.join(found, classes["id"] == found["node"], "left").select("id", "doc_id", F.coalesce("component", "id").alias("component"))
    least = classed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = classed.join(least, "component").select(F.col("id").alias("lo"), "component_id")
    placed = whole.join(named, "lo").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("minima is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return placed.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
