import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from public_tokenizers import path
from pyspark.sql import functions as F

from venation.llm import automaton, chat, classifier, components, dedup, html_text, licenses, packing, registry, rules, subword
from venation.llm import _text as T
from venation.llm._shared import table

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, a long, b long, kept string"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in table(spark, SMALL, "documents").collect()]


def odd(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one two three four five six"), (4, "one two three four five six"), (5, "ONE two three four five six"), (None, "x y"), (6, "word " * 40000)]
    return spark.createDataFrame([(i, t, None, None, 0, 0, 0, 0, "k") for i, t in rows], DOCS)


def test_odd_rows_and_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for f in (lambda d: rules.quality_rules(d), lambda d: dedup.near_duplicates(d), lambda d: classifier.classify(d, labels), lambda d: packing.pack(d, path("byte_bpe_50k.json")), lambda d: automaton.lm_scores(d), lambda d: subword.encode(d, path("piece_bpe_32k.model")), lambda d: licenses.scan(d, licenses.known(spark))):
        assert f(odd(spark)).count() >= 8
        assert f(odd(spark).limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark, docs):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[j]]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in registry.QUERIES["op3_minhash_dedup"](spark, SMALL).collect()}
    assert got == {i: (len(sets[i]), least[i]) for i in sets}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 130)] + [(7, 7), (1, 2)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, **{i: 100 for i in range(100, 130)}}


def test_base_counts(spark, docs):
    got = {r["doc_id"]: r for r in registry.QUERIES["op2_ngram_perplexity"](spark, SMALL).collect()}
    for i, t in docs:
        w = words(t)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        cover = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover))
        assert tuple(got[i][c] for c in rules.COUNTS) == want
        assert got[i]["base_failed"] == (len(w) < 20 or 100 * len(cover) > 30 * len(w))


def test_classifier_on_held_out_labels(spark):
    labels = {r["doc_id"]: r["quality"] for r in table(spark, "/root/testdata/sf0.1", "labels").collect()}
    rows = [r for r in registry.QUERIES["op4_positive_unlabelled"](spark, "/root/testdata/sf0.1").collect() if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([r["predicted"] == labels[r["doc_id"]] for r in rows]) > 0.97


def test_merge_dropout():
    import sentencepiece

    model = open(path("piece_bpe_32k.model"), "rb").read()
    texts = ["", "hello  world\n é 漢", "internationalization of things " * 3, "x" * 300]
    data, offsets = T.utf8(pa.array(texts))
    for dropout in (0.0, 0.4):
        e = subword.Encoder(model, dropout, 1)
        ids, first = e.texts(data, offsets, np.arange(4, dtype=np.uint64))
        parts = [ids[a:b] for a, b in zip(first, first[1:])]
        assert [e.v.decode(p)[1:].tobytes().decode() for p in parts] == texts
        if not dropout:
            assert [p.tolist() for p in parts] == sentencepiece.SentencePieceProcessor(model_proto=model).encode(texts)


def test_page_text():
    page = "<html><body><nav><a href=/>Menu</a></nav><div class=ad>Buy</div><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<p>Four<script>x()</script></article><div id=comments><p>Nice</p></div><footer>c</footer>"
    assert html_text.main_text(page) == "A & B\nOne two three\nFour" and html_text.main_text("") == ""


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(4)
    histogram = Counter(rng.integers(1, 2049, 5000).tolist())
    plan, used = packing.plan(histogram), {}
    for length, _, n, sequence, offset in plan.runs:
        for k in range(n):
            used.setdefault(sequence + k, []).append((offset, length))
    assert Counter(x for v in used.values() for _, x in v) == histogram
    for v in used.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0] + [x for _, x in sorted(v)])[:-1].tolist() and sum(x for _, x in v) <= 2048
    assert len(used) <= 1.02 * -(-sum(k * n for k, n in histogram.items()) // 2048) + 1


def test_packing_query_against_the_tokenizer(spark, docs):
    import zlib

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want, total = Counter(), 0
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        bounds = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]  # the first piece may be shorter, the others are full
        for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
            want[i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    rows = registry.QUERIES["op9_pattern_packing"](spark, SMALL).collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    used = {}
    for r in rows:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in used.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0] + [x for _, x in sorted(v)])[:-1].tolist() and sum(x for _, x in v) <= 2048
    assert len(used) <= 1.02 * -(-total // 2048) + 1


def test_automaton_of_odd_texts(spark):
    """Every training text alike; a held-out text, of an id whose crc32 gives remainder 2, and unknown words."""
    import zlib

    held = next(i for i in range(100, 200) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 != 2][:5]
    rows = [(i, "A b c d", 0) for i in train] + [(held, "a b c d", 0), (held, "d c b a", 0), (held, "x y", 0), (held, None, 0), (held, "z " * 40000, 0)]
    got = automaton.lm_scores(spark.createDataFrame(rows, "doc_id long, text string, score int")).collect()
    assert {r["train_tokens"] for r in got} == {25} and len(got) == 10
    own = sorted(((r["n_tokens"], r["n_known"], r["score"]) for r in got if r["held_out"]), key=lambda r: r[:2] + (-r[2],))
    assert [r[:2] for r in own] == [(1, 1), (3, 1), (5, 5), (5, 5), (40001, 1)]
    assert all(np.isfinite(r[2]) and r[2] < 0 for r in own) and own[2][2] > own[3][2] + 1
    copies = [r["score"] for r in got if not r["held_out"]]
    assert copies == [own[2][2]] * 5


def test_order_of_rows_changes_no_score(spark):
    docs = table(spark, SMALL, "documents")
    score = lambda df: {r["doc_id"]: (round(r["score"], 6), r["n_known"], r["triple_share"], r["pair_share"]) for r in automaton.lm_scores(df).collect()}
    assert score(docs) == score(docs.repartition(3).orderBy(F.rand()))


def test_automaton_against_a_plain_walk(spark, docs):
    import zlib
    from math import log10

    got = {r["doc_id"]: r for r in registry.QUERIES["op10_backoff_automaton"](spark, SMALL).collect()}
    tokens = {i: [*words(lower(t)), None] for i, t in docs}
    train = [i for i in tokens if zlib.crc32(str(i).encode()) % 7 != 2]
    one, two = Counter(w for i in train for w in tokens[i]), Counter(p for i in train for p in zip([None, *tokens[i]], tokens[i]))
    three = Counter(p for i in train for p in zip([None, *tokens[i]], tokens[i], tokens[i][1:]))
    n, v, times = sum(one.values()), len(one), Counter(one.values())
    d = times[1] / (times[1] + 2 * times[2])
    for i, own in tokens.items():
        a, b, state, total = got[i]["triple_share"], got[i]["pair_share"], (None,), 0.0
        for w in own:
            p = (one[w] - d) / n if one[w] else d * v / n
            if one[state[-1]]:
                p = b * two[state[-1], w] / one[state[-1]] + (1 - b) * p
            if len(state) > 1 and two[state]:
                p = a * three[(*state, w)] / two[state] + (1 - a) * p
            total += log10(p)
            state = (state[-1], w)
        assert got[i]["score"] == pytest.approx(total)
        assert got[i]["base_score"] == pytest.approx(sum(log10((one[w] + 1) / (n + v + 1)) for w in own))
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(own), sum(one[w] > 0 for w in own), n)


def test_calls_with_needs_and_cycles(spark):
    calls = spark.createDataFrame([("c", 0, "a", "f", {"x": "1"}, []), ("c", 1, "b", "f", {"x": '"no"'}, ["a"]), ("c", 2, "d", "g", {}, ["b"]), ("c", 3, "e", "f", {"x": "1"}, ["h"]), ("c", 4, "h", "f", {"x": "1"}, ["e"])], "conv_id string, turn int, call_id string, name string, arguments map<string,string>, needs array<string>")
    results = spark.createDataFrame([("c", 5, "a", 'say "hi"'), ("c", 6, "zz", "stray")], "conv_id string, turn int, call_id string, content string")
    got = {r["call_id"]: r for r in chat.linked_calls(calls, results, {"f": {"x": ("integer", True)}}).collect()}
    assert {k: (r["level"], r["status"]) for k, r in got.items()} == {"a": (0, "ok"), "b": (1, "invalid"), "d": (2, "invalid"), "e": (None, "cyclic"), "h": (None, "cyclic")}
    assert got["a"]["json"] == '{"arguments":{"x":1},"id":"a","name":"f","result":"say \\"hi\\""}'


def test_levels_against_a_plain_walk(spark):
    rng = np.random.default_rng(8)
    graphs = {0: {i: {i - 1} for i in range(1, 40)}, 1: {0: {2}, 1: {0}, 2: {1}, 3: {2}, 4: {5}}, 2: {i: {i - 1, i - 2} - {-1} for i in range(1, 9)}, 3: {0: {0}, 1: {0, 2}}, 4: {i: {(i - 1) // 2} for i in range(1, 30)}, 5: {i: {0, *range(5)} - {i} for i in range(4)}}
    for g in range(6, 36):  # of calls that need any other, and of calls that need earlier ones
        n = int(rng.integers(2, 14))
        graphs[g] = {i: {int(x) for x in rng.integers(0, n if g % 2 else max(i, 1), rng.integers(0, 4)) if g % 2 or i} for i in range(n)}
    want = {}
    for g, needs in graphs.items():
        own = {*needs, *(x for v in needs.values() for x in v)}
        level: dict = {}
        for _ in own:
            level |= {i: max([0, *(level[x] + 1 for x in needs.get(i, ()))]) for i in own if all(x in level for x in needs.get(i, ()))}
        want |= {(g, str(i)): level.get(i) for i in own}
    calls = spark.createDataFrame(list(want), "conv_id long, call_id string")
    needs = spark.createDataFrame([(g, str(i), str(x)) for g, v in graphs.items() for i, own in v.items() for x in own] + [(0, "3", "absent")], "conv_id long, call_id string, need string")
    assert {(r["conv_id"], r["call_id"]): r["level"] for r in chat.levels(calls, needs).collect()} == want
    assert chat.levels(calls.limit(0), needs).count() == 0


def test_licence_spellings(spark):
    text = "Copyright (c) 2020 Someone\n" + licenses.LICENCES["MIT"][0].upper().replace(",", " ;")
    rows = [(1, text, 0), (2, "Prose.\nThis work is licenced under the MIT Licence!", 0), (3, None, 0)]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string, digest int"), licenses.known(spark)).collect()}
    assert got[1]["licence"] == "MIT" and got[2]["licence"] is None and got[2]["notices"] == "MIT-notice" and got[3]["notices"] == ""


def test_odd_pages(spark):
    rows = [(1, "u", None, 0), (2, None, "", 0), (None, "u", "<p>" * 3000 + "deep", 0), (3, "u", "a &lt; b &#233;", 0), (3, "u", "a &lt; b &#233;", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = [(r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract(pages).collect()]
    assert len(got) == 5 and got.count((3, "a < b é", 7)) == 2 and (1, "", 0) in got and (2, "", 0) in got
    assert html_text.extract(pages.limit(0)).count() == 0


def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline as pipeline

    docs, kept = table(spark, SMALL, "documents"), {}
    now = docs
    for name, stage in pipeline.STAGES[:-1]:
        now = stage(spark, now, SMALL)
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), docs.schema)
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    scores = {r["doc_id"]: r["predicted"] for r in registry.QUERIES["op4_positive_unlabelled"](spark, SMALL).collect()}
    assert set(kept["classifier"]) == {i for i, p in scores.items() if p}
    for text in kept["rules"].values():
        w = words(text)
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        assert len(w) >= 20 and 100 * len({k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}) <= 30 * len(w)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, words(lower(t))) for i, t in kept["rules"].items())}
    least = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            least[i] = least[j] = min(least[i], least[j])
    assert set(kept["dedup"]) == {i for i in sets if least[i] == i}
    packed = pipeline.run(spark, SMALL).collect()
    assert {r["doc_id"] for r in packed} == set(kept["dedup"])
    used = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for v in used.values():
        assert [o for o, _ in sorted(v)] == np.cumsum([0] + [x for _, x in sorted(v)])[:-1].tolist() and sum(x for _, x in v) <= 2048


def test_pipeline_keeps_rows_not_ids(spark):
    import corpus_pipeline as pipeline

    docs = table(spark, SMALL, "documents")
    for stage in (pipeline.classifier, pipeline.rules):  # a text's verdict is the same under a null id
        both = stage(spark, docs.unionByName(docs.withColumns({"doc_id": F.lit(None).cast("long")})), SMALL).collect()
        named = Counter(r["text"] for r in both if r["doc_id"] is not None)
        assert named and named == Counter(r["text"] for r in both if r["doc_id"] is None) and sum(named.values()) < docs.count()
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(60)) for x in "abcd")
    rows = [(None, a), (None, b), (None, a + " more"), (3, c), (5, c + " more"), (5, d), (6, d + " more"), (7, b + " other")]
    small = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], docs.schema)
    kept = [(r["doc_id"], r["text"]) for r in pipeline.dedup(spark, small, SMALL).collect()]
    assert Counter(kept) == Counter([(None, a), (3, c), (5, d), (7, b + " other")])


def test_page_text_beside_a_long_article():
    part = "<p>" + "Some words of a paragraph. " * 8 + "</p>"
    for n in (1, 5, 100):
        page = f"<body><div><ul><li>Home<li>News</ul><div><h1>Title</h1><p>{'The lead of it. ' * 8}</p><div>{part * n}</div></div><ul><li>Impressum<li>Contact</ul></div></body>"
        lines = html_text.main_text(page).split("\n")
        assert lines == ["Title", ("The lead of it. " * 8).strip()] + [part[3:-4].strip()] * n


def test_wrappers_named_like_boilerplate_keep_their_text():
    part = "Some words of a paragraph. " * 8
    inner = f"<div class=sidebar><p>Short aside</p></div><h1>Title</h1><p>{part}</p><p>{part}</p><div id=comments><p>Nice</p></div>"
    menu = "<nav>" + "<a href='/x'>Menu entry</a>" * 90 + "</nav>"
    want = "\n".join(["Title", part.strip(), part.strip()])
    for begin, end in (("<div class='content no-sidebar'>", "</div>"), ("<div class=has-header>", "</div>"), ("<div id=legal>", "</div>"), ("<form action='/x'>", "</form>"), ("<aside>", ""), ("<div>", "</div>")):
        assert html_text.main_text(f"<body>{menu}{begin}{inner}{end}<footer>c</footer></body>") == want
    assert html_text.main_text(f"<body><select>{'<option>Country of the world' * 90}</select><div>{inner}</div></body>") == want
