"""The perplexity model and its verdicts against a plain version, and what may not change with the corpus."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from venation.llm import _text as T
from venation.llm import registry, rules
from venation.llm._shared import table

SMALL = "/root/testdata/sf0.001"


def folded(text):
    out = []
    for c in text or "":
        o = ord(c)
        out.append(" " if o in (9, 10, 11, 12, 13) else "0" if c in "0123456789" else c if o <= 0xFFFF else chr(0xD800 + (o * 2654435761 % 2**32 >> 21)))
    return "".join(out)


class Plain:
    """Modified Kneser-Ney by dictionaries."""

    def __init__(self, texts, order=4):
        self.order, top = order, Counter()
        for t in texts:
            padded = " " * (order - 1) + t
            top.update(padded[i : i + order] for i in range(len(t)))
        self.levels = {order: top}
        for k in range(order - 1, 0, -1):
            self.levels[k] = Counter(run[1:] for run in self.levels[k + 1])
        self.off, self.mass, self.back = {}, {}, {}
        for k, level in self.levels.items():
            times = Counter(level.values())
            n = [max(1, times[i]) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            d = [0.0, *(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.05), i + 0.95) for i in range(3))]
            self.off[k] = {run: d[min(c, 3)] for run, c in level.items()}
            self.mass[k], self.back[k] = Counter(), Counter()
            for run, c in level.items():
                self.mass[k][run[:-1]] += c
                self.back[k][run[:-1]] += self.off[k][run]

    def p(self, run):
        k = len(run)
        if not k:
            return 1 / (len(self.levels[1]) + 1)
        lower = self.p(run[1:])
        if not self.mass[k][run[:-1]]:
            return lower
        c = self.levels[k][run]
        return ((c - self.off[k][run] if c else 0) + self.back[k][run[:-1]] * lower) / self.mass[k][run[:-1]]

    def cross_entropy(self, text):
        padded = " " * (self.order - 1) + text
        return -sum(math.log10(self.p(padded[i : i + self.order])) for i in range(len(text))) / max(len(text), 1)


def test_query_against_a_plain_model_and_plain_bands(spark):
    docs = table(spark, SMALL, "documents").collect()
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_ngram_perplexity"](spark, SMALL).collect()}
    sizes = {lang: (sum(len(r["text"] or "") for r in docs if r["lang"] == lang), sum(r["lang"] == lang for r in docs)) for lang in {r["lang"] for r in docs}}
    lang = {r["doc_id"]: r["lang"] if r["lang"] and sizes[r["lang"]][0] >= rules.OWN_CHARS and sizes[r["lang"]][1] >= rules.OWN_DOCS else "*" for r in docs}
    texts = {r["doc_id"]: folded(r["text"]) for r in docs}
    for name in set(lang.values()):
        mine = [i for i in texts if lang[i] == name]
        model = Plain([texts[i] for i in mine])
        own = {i: model.cross_entropy(texts[i]) for i in mine}
        for i in mine:
            assert got[i]["lang"] == name and got[i]["cross_entropy"] == pytest.approx(own[i], abs=2e-5)
        passed = [got[i]["cross_entropy"] for i in mine if not got[i]["base_failed"]]
        middle = np.median(passed)
        half = rules.WIDTH * 1.4826 * np.median(np.abs(np.array(passed) - middle))
        for i in mine:
            wide = max(1.0, math.sqrt(rules.SHORT / max(len(texts[i]), 1)))
            assert (got[i]["lowest"], got[i]["highest"]) == pytest.approx((middle - half * wide, middle + half * wide), abs=0.01 * wide)
            assert got[i]["kept"] == (not got[i]["base_failed"] and got[i]["lowest"] <= got[i]["cross_entropy"] <= got[i]["highest"])
    assert any(not r["kept"] and not r["base_failed"] for r in got.values()) and sum(r["kept"] for r in got.values()) > 100


def test_model_sums_to_one():
    text = "".join(np.random.default_rng(2).choice(list("abcdef é漢"), 3000))
    characters, first = rules.units(*T.utf8(pa.array([text])))
    model = rules.Model(*np.unique(rules.codes(characters, first), return_counts=True))
    for context in ("abc", " é漢", "zzz", "cab"):
        head = sum(ord(c) << 16 * (3 - i) for i, c in enumerate(context))
        run = np.array([head + ord(c) for c in [*sorted(set(text)), "Z"]], T.U)
        assert (10 ** model.log10(run)).sum() == pytest.approx(1, abs=1e-3)


def test_long_texts_in_parts_have_the_same_runs(monkeypatch):
    text = "Größe 漢字 12 \U0001f600 " * 400
    data, offsets = T.utf8(pa.array(["ab", text, "", "c"]))
    whole = [r for *_, r, _ in rules.pieces(data, offsets)]
    monkeypatch.setattr(rules, "PIECE", 1000)
    monkeypatch.setattr(rules, "runs", lambda o: T.runs(o, 500))
    assert (np.concatenate([r for *_, r, _ in rules.pieces(data, offsets)]) == np.concatenate(whole)).all()


def test_rare_language_has_its_own_model_whatever_the_rest(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rare = [(i, text("мнопрстуф漢字", 400), "xx") for i in range(20)]
    most = [(100 + i, text("abcdefgh", 25), "en") for i in range(1200)] + [(5000, text("abcdefgh", 25), None)]
    score = lambda rows: {r["doc_id"]: (r["lang"], r["cross_entropy"], r["lowest"], r["highest"]) for r in rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    alone, both = score(rare), score(rare + most)
    assert {i: both[i] for i in alone} == alone and alone[0][0] == "xx" and both[100][0] == "en" and both[5000][0] == "*"
    monkeypatch.setattr(rules, "MODEL_ROWS", 50)
    assert score(rare + most) == both


def test_rare_runs_are_left_out_by_share_alone(spark, monkeypatch):
    monkeypatch.setattr(rules, "RARE", 0.01)
    docs = spark.createDataFrame([(i, "abab" * 50 + "q", "*") for i in range(30)], "doc_id long, text string, lang string")
    for times in (1, 3):  # the same share in a larger corpus
        (_, models), *_ = rules.train(docs if times == 1 else docs.unionByName(docs).unionByName(docs))
        kept = {"".join(chr(int(r) >> 16 * k & 0xFFFF) for k in (3, 2, 1, 0)) for r in rules.merged([(np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(x))], T.U), np.ones(1)) for x in ("abab", "baba")])[0]}
        assert {x for x in ("abab", "baba", "babq") if rules.find(models["*"].hash, rules.key(4, np.array([sum(ord(c) << 16 * (3 - i) for i, c in enumerate(x))], T.U)))[1][0]} == kept


def test_rare_runs_are_scored_by_their_own_probabilities(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(i, "".join(rng.choice(list("abcdefgh éж漢"), 300)) + chr(0x4E00 + i), "en") for i in range(150)] + [(7, "abc", None), (8, None, "en"), (9, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = lambda: sorted((r["doc_id"], r["lang"], r["n_words"], r["kept"], round(r["cross_entropy"], 6)) for r in rules.quality_rules(docs).collect())
    whole = got()
    model = Plain([folded(t) for _, t, lang in rows if lang])
    for i, lang, _, _, h in whole:
        if lang == "en":
            assert any(h == pytest.approx(model.cross_entropy(folded(t)), abs=2e-5) for j, t, _ in rows if j == i)
    for share in (0.0005, 0.5):  # some runs, then all of them, come by the join
        monkeypatch.setattr(rules, "RARE", share)
        assert [r[:4] for r in got()] == [r[:4] for r in whole] and [r[4] for r in got()] == pytest.approx([r[4] for r in whole], abs=2e-6)


def test_table_of_probabilities_against_the_model_in_memory(spark):
    run, n = np.unique(np.random.default_rng(1).integers(0, 4, (3000, 4)) @ (np.array([1, 1 << 16, 1 << 32, 1 << 48])), return_counts=True)
    counted = spark.createDataFrame([("x", int(r), int(c)) for r, c in zip(run, n)], "lang string, run long, n long")
    got = {r["run"]: r["p"] for r in rules.probabilities(counted).collect()}
    assert [got[int(r)] for r in run] == pytest.approx(rules.Model(run.view(T.U), n).log10(run.view(T.U)).tolist(), abs=1e-6)
