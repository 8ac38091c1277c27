"""Best-fit packing: length patterns fitted to the histogram by non-negative least squares.

Packing needs only how many pieces there are of each length. Piece lengths are counted by Spark; the histogram, of at
most `capacity` numbers however large the corpus, goes to the driver. There the plan is made:

1. Lengths are put in bins of `capacity // UNITS` tokens. Every pattern of two or three bins that fills a sequence is
   enumerated, and repeat counts of patterns are fitted to the binned histogram by non-negative least squares
   (Lawson and Hanson's active sets), then rounded down.
2. Each pattern takes the longest pieces that are left in its bins, the last bin by best fit; `repeat` equal choices are
   one step.
3. What is left goes, longest first, to the smallest gap that holds it, else to new sequences.

Every step places a run of equally long pieces: (length, first rank, number, first sequence, offset). The plan has at most
a few runs a length and a pattern, independent of the corpus, so it is broadcast. A piece's rank among the equally long is
its rank in one of RANK_BUCKETS hash buckets plus the sizes of the buckets before, so that a frequent length is never in
one task.

Null texts are empty: they are the end token alone. Repeated rows are packed as often as they occur. Empty tables give no
rows. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import ship, written
from ._text import runs, utf8
from ._tokens import encoder

UNITS = 128
RANK_BUCKETS = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which may be shorter."""
    head = (n - 1) % capacity + 1
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    ship(docs.sparkSession)
    with open(tokenizer_file, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: a few MB

    def of(batches):
        encode = encoder(vocabulary.value)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            ids = batch.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for lo, hi in runs(offsets, 16 << 20):
                tokens, first = encode(data, offsets[lo : hi + 1])
                for k in range(hi - lo):
                    mine = np.append(tokens[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, (s, n) in enumerate(cut(len(mine), capacity)):
                        for out, x in zip(rows, (ids[lo + k], p, s, n, zlib.crc32(mine[s : s + n]))):
                            out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int32(), *[pa.int64()] * 3))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, PIECES)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """x >= 0 that minimises |a x - b|, by active sets."""
    n = a.shape[1]
    x, used = np.zeros(n), np.zeros(n, bool)
    for _ in range(rounds):
        slope = a.T @ (b - a @ x)
        slope[used] = -np.inf
        best = int(np.argmax(slope))
        if slope[best] <= 1e-9 * max(1.0, np.abs(b).max()):
            break
        used[best] = True
        while True:
            now = np.flatnonzero(used)
            z = np.linalg.lstsq(a[:, now], b, rcond=None)[0]
            if (z > 1e-12).all():
                x[:] = 0
                x[now] = z
                break
            bad = z <= 1e-12
            step = np.min(x[now][bad] / np.maximum(x[now][bad] - z[bad], 1e-300))
            x[now] += step * (z - x[now])
            gone = now[(x[now] <= 1e-12) & bad]
            if not len(gone):
                gone = now[bad][:1]
            used[gone] = False
            x[gone] = 0
            if not used.any():
                return x
    return x


def patterns(units: int = UNITS) -> list[tuple[int, ...]]:
    """Two or three bins, largest first, that fill a sequence. A bin counts its longest length, so a sum a little over `units` can still fit."""
    two = [(i, t - i) for t in (units, units + 1) for i in range((t + 1) // 2, units) if t > i]
    three = [(i, j, t - i - j) for t in range(units, units + 3) for i in range(1, units) for j in range(1, i + 1) if 1 <= t - i - j <= j]
    return two + three


class Plan:
    """Runs of equally long pieces, laid in sequences."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity, self.left, self.rank = capacity, dict(histogram), defaultdict(int)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.gaps: list[int] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap -> (first sequence, number)

    def lay(self, length: int, number: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], number, sequence, offset))
        self.rank[length] += number
        self.left[length] -= number

    def leave(self, gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in self.open:
                insort(self.gaps, gap)
                self.open[gap] = []
            self.open[gap].append((sequence, number))

    def new(self, lengths: list[int], number: int) -> None:
        offset = 0
        for x in lengths:
            self.lay(x, number, self.sequences, offset)
            offset += x
        self.leave(self.capacity - offset, self.sequences, number)
        self.sequences += number

    def fit_patterns(self) -> None:
        unit = max(1, -(-self.capacity // UNITS))
        bin_of = lambda x: -(-x // unit)
        units = self.capacity // unit
        if units < 4:
            return
        kinds = patterns(units)
        a, b = np.zeros((units + 1, len(kinds))), np.zeros(units + 1)
        for k, kind in enumerate(kinds):
            for i in kind:
                a[i, k] += 1
        for length, n in self.left.items():
            if length < self.capacity:
                b[bin_of(length)] += n
        if not b.any():
            return
        repeats = np.floor(nnls(a, b / b.max()) * b.max() + 1e-6).astype(int)
        stock: dict[int, list[int]] = defaultdict(list)
        for length in sorted(self.left):
            if self.left[length] and length < self.capacity:
                stock[bin_of(length)].append(length)
        for k in sorted(np.flatnonzero(repeats), key=lambda k: (-kinds[k][0], kinds[k])):
            todo = int(repeats[k])
            while todo:
                chosen, room = [], self.capacity
                for i in kinds[k]:  # the longest of the bin that still fits
                    free = lambda x: self.left[x] > chosen.count(x)  # noqa: B023, E731
                    x = next((x for x in reversed(stock[i]) if x <= room and free(x)), None)
                    if x is None:
                        break
                    chosen.append(x)
                    room -= x
                if len(chosen) < len(kinds[k]):
                    break
                number = min(todo, *(self.left[x] // chosen.count(x) for x in chosen))
                self.new(chosen, number)
                todo -= number
                for x in set(chosen):
                    if not self.left[x]:
                        stock[bin_of(x)].remove(x)

    def fit_rest(self) -> None:
        for length in sorted(self.left, reverse=True):
            while n := self.left[length]:
                at = bisect_left(self.gaps, length)
                if at < len(self.gaps):
                    gap = self.gaps[at]
                    sequence, number = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap], self.gaps[at]
                    took = min(n, number)
                    self.lay(length, took, sequence, self.capacity - gap)
                    self.leave(gap - length, sequence, took)
                    self.leave(gap, sequence + took, number - took)
                else:
                    each = self.capacity // length
                    if n >= each:
                        self.new([length] * each, n // each)
                    else:
                        self.new([length] * n, 1)


def plan(histogram: dict[int, int], capacity: int = 2048) -> Plan:
    out = Plan({k: v for k, v in histogram.items() if v}, capacity)
    if out.left.get(capacity):
        out.new([capacity], out.left[capacity])
    out.fit_patterns()
    out.fit_rest()
    return out


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row a piece, with the sequence it is in and its place there."""
    spark = docs.sparkSession
    table = written(pieces(docs, tokenizer_file, capacity, end_id), "pieces").withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {RANK_BUCKETS})"))
    sizes = table.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    # at most `capacity` rows
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    laid = plan(histogram, capacity).runs
    runs_table = spark.createDataFrame(laid, "run_length long, run_rank long, run_number long, run_sequence long, run_offset long")
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    ranked = table.withColumn("rank", F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    placed = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    found = placed.join(F.broadcast(runs_table), (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("run_rank")) & (F.col("rank") < F.col("run_rank") + F.col("run_number")))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("run_sequence") + F.col("rank") - F.col("run_rank")).alias("sequence_id"), F.col("run_offset").alias("offset"))
