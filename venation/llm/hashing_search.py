"""Nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes. On a bounded sample the vectors' directions are centred and rotated onto their principal axes, and rotations are
learnt, from different starts, that bring them close to the corners of a cube (iterative quantisation). A code is the signs
along them, BITS in all. The first INDEXED of them are searched by; all of them tell near rows from far ones.

Index. What is searched by is cut into m substrings of s bits; the index is a table of (substring number, value, row). If two codes differ in
at most r = q * m + e bits then, by the pigeonhole principle, one of the first e + 1 substrings differs in at most q bits or
one of the others in at most q - 1. So a query asks each substring's part of the table for all values within those radii, and
an equi-join brings every row whose code is within r, and others that share a substring nearly. Of these, rows whose whole code
is farther than `reach` bits are dropped, and the rest are ranked by cosine of the original vectors in double precision.
Substrings have `width` bits, a parameter, so that a query asks for about as many values whatever the size of the table; for
tables of billions of rows 16 to 20 bits keep the rows of one value few.

r is the least radius for which the probes bring a share of TARGET of the sample queries' true neighbours, `reach` the distance
that REACH of them lie within. Of a sample that is a share f of all rows, the k * f nearest stand for the k nearest of all.
Queries that find fewer than k rows are asked again with twice the radii, and so on up to all rows.

Equal vectors are one entry of the index, with the k + 1 of its rows that ties prefer; no other row of them can be among the k
nearest of anything. So copies, however many, make neither the table nor a query's answers long. Queries never meet rows but
by the join.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import forget, ship, written

BITS, INDEXED, WIDTH, SAMPLE, SAMPLE_VALUES, TARGET, REACH = 512, 256, 12, 12_000, 8_000_000, 0.95, 0.985
#: Bytes of the queries' vectors up to which they are broadcast to be ranked; beyond, they are joined by a shuffle.
SMALL = 32 << 20
WORDS = BITS // 64
OUT = "query_id long, rank int, vec_id long, score double"


def directions(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def radii(r: int, m: int) -> list[int]:
    """The radius to probe each of m substrings with, -1 for none, so that every code within r is retrieved."""
    q, e = divmod(r, m)
    return [q if j <= e else q - 1 for j in range(m)]


def masks(bits: int, radius: int) -> np.ndarray:
    """All numbers of `bits` bits with at most `radius` of them set."""
    found = [sum(1 << i for i in c) for n in range(min(radius, bits) + 1) for c in combinations(range(bits), n)]
    return np.array(found, np.int64)


class Codes:
    """A learnt map from vectors to codes, their substrings, and the radii of a search."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, width: int = WIDTH, seed: int = 5):
        rng, x = np.random.default_rng(seed), directions(sample)
        self.mean = x.mean(axis=0)
        axes = np.linalg.svd((x - self.mean).T @ (x - self.mean))[0][:, :BITS]
        v, d = (x - self.mean) @ axes, axes.shape[1]
        maps = []
        for _ in range(-(-BITS // d)):
            r = np.linalg.qr(rng.normal(size=(d, d)))[0]
            for _ in range(20):
                left, _, right = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
                r = (left @ right).T
            maps.append(axes @ r)
        self.map = np.concatenate(maps, axis=1)[:, :BITS]
        self.width, self.count = width, INDEXED // width
        self._learn(x, sample, max(1, round(k * len(x) / max(rows, 1))), rng)

    def bits(self, vectors: np.ndarray) -> np.ndarray:
        return (directions(vectors) - self.mean) @ self.map >= 0

    def words(self, bits: np.ndarray) -> np.ndarray:
        """Codes as 64-bit words."""
        return np.packbits(bits, axis=1).view(np.int64)

    def parts(self, bits: np.ndarray) -> np.ndarray:
        """The value of every substring."""
        return bits[:, : self.count * self.width].reshape(len(bits), self.count, self.width).astype(np.int64) @ (1 << np.arange(self.width))

    def _learn(self, x: np.ndarray, sample: np.ndarray, k: int, rng) -> None:
        bits = self.bits(sample)
        parts, far, whole = self.parts(bits), [], []
        for i in rng.permutation(len(x))[:500]:
            near = x @ x[i]
            near[i] = -np.inf
            best = np.argpartition(-near, min(k, len(near) - 1))[:k] if len(near) > 1 else np.zeros(0, int)
            best = best[best != i]
            far.append(np.bitwise_count(parts[best] ^ parts[i]))
            whole.append((bits[best] != bits[i]).sum(axis=1))
        far, whole = np.concatenate(far), np.concatenate(whole)
        self.reach, self.radius = BITS, INDEXED
        if len(whole):
            self.reach = int(np.quantile(whole, REACH, method="higher"))
            self.radius = next((r for r in range(INDEXED) if (far <= radii(r, self.count)).any(axis=1).mean() >= TARGET), INDEXED)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of each row with a query, or with the query of the same place."""
    return (rows * query).sum(axis=-1) / (np.sqrt((rows * rows).sum(axis=-1)) * np.sqrt((query * query).sum(axis=-1)))


def table(entries: DataFrame, codes) -> DataFrame:
    """The index of entries (id, embedding): key (substring number and value), id, and the code. codes: a broadcast one."""

    def of(batches):
        for batch in batches:
            c = codes.value
            bits = c.bits(_matrix(batch.column(1)))
            key = c.parts(bits) + (np.arange(c.count) << 32)
            words = np.repeat(c.words(bits), c.count, axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), c.count)), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["key", "id", *(f"x{i}" for i in range(WORDS))])

    return entries.select("id", "embedding").mapInArrow(of, "key long, id long, " + ", ".join(f"x{i} long" for i in range(WORDS)))


def probes(queries: DataFrame, codes, radius: int) -> DataFrame:
    """A row for each value that each query (id, embedding) asks for: key, q, and the query's code."""

    def of(batches):
        c = codes.value
        by = radii(radius, c.count)
        ask = [(j, masks(c.width, q)) for j, q in enumerate(by) if q >= 0]
        n = sum(len(m) for _, m in ask)
        for batch in batches:
            for lo in range(0, len(batch), max(1, 500_000 // max(n, 1))):
                part = batch.slice(lo, max(1, 500_000 // max(n, 1)))
                bits = c.bits(_matrix(part.column(1)))
                values, words = c.parts(bits), np.repeat(c.words(bits), n, axis=0)
                key = np.concatenate([(values[:, j : j + 1] ^ m) + (j << 32) for j, m in ask], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.repeat(part.column(0).to_numpy(), n)), *(pa.array(np.ascontiguousarray(w)) for w in words.T)], ["key", "q", *(f"y{i}" for i in range(WORDS))])

    return queries.select("id", "embedding").mapInArrow(of, "key long, q long, " + ", ".join(f"y{i} long" for i in range(WORDS)))


def _substring(j: int, width: int) -> np.ndarray:
    """Substring j as a mask of a code's 64-bit words."""
    bits = np.zeros(BITS, bool)
    bits[j * width : (j + 1) * width] = True
    return np.packbits(bits).view(np.int64)


def candidates(index: DataFrame, asked: DataFrame, reach: int, radius: int | None = None, width: int = WIDTH) -> DataFrame:
    """(q, id): pairs that the probes bring and whose codes differ in at most `reach` bits.

    With the radius of the probes and the width of substrings, a pair comes from the first substring alone that brings it, and so
    once, however many substrings near codes share. The probes are never broadcast: a query's thousands of rows compress to
    little, so that Spark takes them for a small table.
    """
    differ = [asked[f"y{i}"].bitwiseXOR(index[f"x{i}"]) for i in range(WORDS)]
    met = (asked["key"] == index["key"]) & (reduce(lambda a, b: a + b, map(F.bit_count, differ)) <= reach)
    if radius is not None:
        for j, most in enumerate(radii(radius, INDEXED // width)):
            if most >= 0:
                own = reduce(lambda a, b: a + b, (F.bit_count(differ[i].bitwiseAND(F.lit(int(mask)))) for i, mask in enumerate(_substring(j, width)) if mask))
                met &= (asked["key"] < ((j + 1) << 32)) | (own > most)
    pairs = asked.join(index.hint("merge"), met).select("q", "id")
    return pairs.distinct() if radius is None else pairs


def scored(pairs: DataFrame, entries: DataFrame, queries: DataFrame, small: bool) -> DataFrame:
    """(q, id, first, score): the cosine of each pair. first: the entry's least vec_id."""

    def of(batches):
        for batch in batches:
            score = cosines(_matrix(batch.column(3)), _matrix(batch.column(4))) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(score)], ["q", "id", "first", "score"])

    asked = queries.select(F.col("id").alias("q"), F.col("embedding").alias("y"))
    both = pairs.join(entries.select("id", F.col("members")[0]["vec_id"].alias("first"), F.col("embedding").alias("x")), "id").join(F.broadcast(asked) if small else asked, "q")
    return both.select("q", "id", "first", "x", "y").mapInArrow(of, "q long, id long, first long, score double")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose vec_id is divisible by `every`, itself left out.

    Ties go to the smaller vec_id; equal vectors tie. Vectors that are null, zero, or hold null or non-finite components
    take no part, nor do rows with a null id. Rows that repeat an id are rows of their own: each is a candidate, and each is a
    query with answers of its own. Vectors of each dimension have an index of their own, as no cosine is defined between
    dimensions. width: bits of a substring. Extra columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null and size(embedding) > 0")
    whole = whole.where("forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(embedding, x -> x <> 0)")
    whole = whole.withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))  # no negative zero
    whole = written(whole.withColumns({"row": F.monotonically_increasing_id(), "h": F.xxhash64("embedding"), "d": F.size("embedding")}), "vectors")
    out = [_of_dimension(whole.where(F.col("d") == r["d"]), r["count"], k, every, width) for r in whole.groupBy("d").count().orderBy("d").collect()]  # a row a dimension
    return reduce(DataFrame.unionByName, out) if out else spark.createDataFrame([], OUT)


def _of_dimension(whole: DataFrame, total: int, k: int, every: int, width: int) -> DataFrame:
    spark, same = whole.sparkSession, ["h", "embedding"]
    first = whole.withColumn("nth", F.row_number().over(W.partitionBy(*same).orderBy("vec_id", "row"))).where(F.col("nth") <= k + 1)
    entries = first.groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("vec_id", "row"))).alias("members"))  # k + 1 at most
    entries = written(entries.withColumn("id", F.col("members")[0]["row"]), "entries")
    asked = whole.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), *same)
    asked = written(asked.join(entries.select("id", *same), same).select("query_id", "query_row", F.col("id").alias("q")), "asked")
    n, values = entries.count(), len(entries.first()["embedding"])
    most = min(SAMPLE, max(500, SAMPLE_VALUES // values))
    drawn = entries if n <= most else entries.where(F.expr("pmod(xxhash64(id, 3), 1000000)") < int(1_000_000 * most / n))
    codes = Codes(_matrix(drawn.select("id", "embedding").toArrow().sort_by("id")["embedding"]), n, k, width)
    shared = spark.sparkContext.broadcast(codes)  # one matrix of BITS columns
    index = written(table(entries, shared), "index")
    todo = written(entries.join(asked.select(F.col("q").alias("id")).distinct(), "id", "left_semi").select("id", "embedding"), "queries")
    radius, reach, found = codes.radius, codes.reach, []
    while count := todo.count():
        pairs = candidates(index, probes(todo, shared, radius), reach, radius, width)
        near = scored(pairs, entries, todo, count * values * 8 <= SMALL)
        # the k + 1 best entries of a query hold its k + 1 best rows; members are looked up only then
        best = near.withColumn("nth", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "first"))).where(F.col("nth") <= k + 1)
        rows = best.join(entries.select("id", "members"), "id").select("q", "score", F.explode("members").alias("m")).groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), F.col("m.vec_id").alias("vec_id"), F.col("m.row").alias("row"), "score"))), 1, k + 1).alias("best"))
        got = written(rows, "found")
        last = radius >= INDEXED
        found.append(got if last else got.where(F.size("best") >= min(k + 1, total)))
        if last:
            break
        left = written(todo.join(found[-1].select(F.col("q").alias("id")), "id", "left_anti"), "queries")
        forget(todo)
        todo, radius, reach = left, min(INDEXED, 2 * radius + 1), min(BITS, 2 * reach)
    if not found:
        return spark.createDataFrame([], OUT)
    answers = asked.join(reduce(DataFrame.unionByName, found), "q")
    own = F.slice(F.filter("best", lambda b: b["row"] != F.col("query_row")), 1, k)
    return answers.select("query_id", F.posexplode(own).alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")
