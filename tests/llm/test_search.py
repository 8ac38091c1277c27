"""Multi-index hashing against brute force: codes, recall, candidates, copies, repeated ids and dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from venation.llm import hashing_search as H
from venation.llm import registry
from venation.llm._shared import ship, table, written


def plain(rows, k=5, every=50):
    """All answers by brute force over (vec_id, vector) rows."""
    out = []
    for i, (q, x) in enumerate(rows):
        if q % every == 0:
            near = [(-float(H.cosines(np.array(y, float), np.array(x, float))), v, j) for j, (v, y) in enumerate(rows) if j != i and len(y) == len(x)]
            out += [(q, rank, v, -s) for rank, (s, v, _) in enumerate(sorted((round(s, 12), v, j) for s, v, j in near)[:k], 1)]
    return out


@pytest.mark.parametrize("r", [0, 3, 9, 14, 32])
def test_probes_bring_every_code_within_the_radius(r):
    rng = np.random.default_rng(1)
    codes = rng.random((400, 32)) < 0.5
    value = codes.reshape(400, 4, 8).astype(np.int64) @ (1 << np.arange(8))
    met = np.zeros(400, bool)
    for j, q in enumerate(H.radii(r, 4)):
        if q >= 0:
            met |= np.isin(value[:, j], value[0, j] ^ H.masks(8, q))
    assert met[(codes != codes[0]).sum(axis=1) <= r].all()


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_recall_and_scores_of_the_query(spark, folder):
    path = f"/root/testdata/{folder}"
    rows = table(spark, path, "embeddings").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got, hits, by = registry.QUERIES["op5_multi_index_hashing"](spark, path).collect(), 0, {}
    for r in got:
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(ids[ids % 50 == 0].tolist())
    for q, answers in by.items():
        score = H.cosines(x, x[ids == q][0])
        answers.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in answers] == [1, 2, 3, 4, 5]
        assert [r["score"] for r in answers] == pytest.approx([score[ids == r["vec_id"]][0] for r in answers], abs=1e-12)
        assert all((a["score"], -a["vec_id"]) > (b["score"], -b["vec_id"]) for a, b in zip(answers, answers[1:]))
        score[ids == q] = -2
        hits += len({r["vec_id"] for r in answers} & set(ids[np.argsort(-score)[:5]].tolist()))
    assert hits >= 0.9 * len(got)


def test_candidates_are_far_fewer_than_rows(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    x = centres[rng.integers(0, 60, 6000)] + 0.25 * rng.normal(size=(6000, 32))
    ship(spark)
    entries = written(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), "entries")
    codes = H.Codes(x, len(x), 5)
    shared = spark.sparkContext.broadcast(codes)
    queries = entries.where("id % 50 = 0")
    asked, index = H.probes(queries, shared, codes.radius), H.table(entries, shared)
    pairs = H.candidates(index, asked, codes.reach).collect()
    met = asked.join(index, "key").select("q", "id").distinct().count()
    assert met < 0.15 * 120 * 6000 and len(pairs) < 0.05 * 120 * 6000
    found, hits = {}, 0
    for r in pairs:
        found.setdefault(r["q"], set()).add(r["id"])
    for q in range(0, 6000, 50):
        score = H.cosines(x, x[q])
        hits += len(set(np.argsort(-score)[:6].tolist()) & found[q])
    assert hits >= 0.9 * 6 * 120


def test_copies_repeated_ids_and_dimensions_against_brute_force(spark, monkeypatch):
    def widest(self, *_):
        self.reach = self.radius = H.BITS

    monkeypatch.setattr(H.Codes, "_learn", widest)  # every row is met, so that answers are exact
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(1, 40)] + [(i, [1.0, 2.0, 0.0, -1.0]) for i in range(50, 400, 10)]
    rows += [(50, [0.0, 1.0, 1.0, 1.0]), (50, [1.0, 2.0, 0.0, -1.0]), (7, [2.0, 4.0, 0.0, -2.0]), (500, [1.0, -0.0, 0.0, 0.0]), (501, [1.0, 0.0, 0.0, 0.0])]
    rows += [(600 + i, [float(i), 1.0, 1.0]) for i in range(12)] + [(700, [1.0] * 7)]
    good = [(i, v) for i, v in rows if any(v)]
    odd = [(100, None), (150, [0.0] * 4), (200, [float("nan"), 1.0, 1.0, 1.0]), (250, [None, 1.0, 1.0, 1.0]), (300, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4), (350, [])]
    vectors = spark.createDataFrame([(i, v, 0, "q") for i, v in rows + odd], "vec_id long, embedding array<double>, rank int, q string")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in H.nearest(vectors).collect())
    assert got == sorted((q, k, v, round(s, 9)) for q, k, v, s in plain(good))
    assert H.nearest(vectors.limit(0)).count() == 0 and H.nearest(vectors.where("vec_id = 700")).count() == 0
    assert H.nearest(vectors.where(F.col("vec_id") % 50 != 0)).count() == 0


def test_queries_that_find_too_few_rows_are_asked_again(spark, monkeypatch):
    def narrow(self, *_):
        self.reach = self.radius = 1

    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    monkeypatch.setattr(H.Codes, "_learn", narrow)
    got = H.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in (0, 50, 100) for k in range(1, 6)]


def test_near_copies_meet_once_and_probes_are_not_broadcast(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 32))
    x[:300] = x[0] + 0.05 * rng.normal(size=(300, 32))  # a group of near copies
    ship(spark)
    entries = written(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), "entries")
    codes = H.Codes(x, len(x), 5)
    shared = spark.sparkContext.broadcast(codes)
    index, asked = written(H.table(entries, shared), "index"), H.probes(entries.where("id % 50 = 0"), shared, codes.radius)
    made = H.candidates(index, asked, codes.reach, codes.radius)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "Aggregate" not in plan
    rows = sorted(map(tuple, made.collect()))
    every = sorted(map(tuple, H.candidates(index, asked, codes.reach).collect()))
    assert rows == every and asked.join(index, "key").where("q < 300 and id < 300").count() > 5 * sum(q < 300 and i < 300 for q, i in rows)
