"""Merge-dropout: draws against a plain agenda, variety, and decoding by the operator."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from public_tokenizers import path

from venation.llm import _text as T
from venation.llm import registry, subword
from venation.llm._shared import table

MODEL = path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def raw():
    with open(MODEL, "rb") as f:
        return f.read()


def ids_of(encoder, texts, salt=None):
    data, offsets = T.utf8(pa.array(texts, pa.string()))
    salt = np.arange(len(texts), dtype=np.uint64) if salt is None else salt
    ids, first = encoder.texts(data, offsets, salt)
    return [ids[a:b].tolist() for a, b in zip(first, first[1:])]


def plain(v, text, salt, seed, dropout):
    """One text by repeated search for the best pair that wasn't skipped."""
    out, words, cut = [], [], " " + text
    for i, c in enumerate(cut):
        if i == 0 or c == " " and cut[i - 1] != " ":
            words.append("")
        words[-1] += c
    for n, word in enumerate(words if text else []):
        key = int(T.mix(np.array([salt], T.U) ^ T.mix(np.array([seed + T.U(n)], T.U)))[0])
        now, gone = [(int(v.of_char[ord(c)]), i) for i, c in enumerate(word)], set()
        while True:
            best = None
            for k in range(len(now) - 1):
                (a, at), (b, right) = now[k], now[k + 1]
                rank, piece = (int(x[0]) for x in v.look(np.array([a], np.int32), np.array([b], np.int32)))
                if rank < subword.NEVER and (a, at, b, right) not in gone and (best is None or rank < best[0]):
                    best = (rank, k, piece)
            if best is None:
                break
            _, k, piece = best
            place = now[k][1]
            if dropout and subword.skipped(np.array([key], T.U), np.array([piece]), np.array([place]), dropout)[0]:
                gone.add((*now[k], *now[k + 1]))
            else:
                now[k : k + 2] = [(piece, place)]
        for s, _ in now:
            out += [s] if 0 <= s < v.size else v.byte[list((chr(-1 - s) if s < 0 else v.char_of[s]).encode())].tolist()
    return out


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 0.9])
def test_walk_and_agenda_against_a_plain_search(raw, dropout):
    texts = ["", "hello  world, internationalization of things\n", "é漢\u2581x 12345 " + "ab" * 90, "  lead and  gaps ", "naïve café coöperate " * 3, "antidisestablishmentarianism " * 12]
    e = subword.Encoder(raw, dropout, 5)
    want = [plain(e.v, t, i, e.seed, dropout) for i, t in enumerate(texts)]
    assert ids_of(e, texts) == want
    assert ids_of(e, texts) == want  # with states that are known
    if not dropout:
        own = sentencepiece.SentencePieceProcessor(model_proto=raw)
        assert [x for i, x in enumerate(ids_of(e, texts)) if i != 2] == [own.encode(t) for i, t in enumerate(texts) if i != 2]


def test_every_occurrence_is_drawn_anew(raw):
    e = subword.Encoder(raw, 0.3, 1)
    kinds = Counter(map(tuple, ids_of(e, ["internationalization"] * 4000)))
    assert len(kinds) > 100 and ids_of(e, ["internationalization"], np.array([7], np.uint64))[0] in map(list, kinds)
    # a word of one candidate is whole in as many occurrences as aren't skipped
    assert abs(sum(len(x) == 1 for x in ids_of(e, ["a"] * 4000)) / 4000 - 0.7) < 0.03


def test_states_made_anew_change_nothing(raw, monkeypatch):
    texts = [f"some words {i} of a corpus that repeats" for i in range(300)]
    e = subword.Encoder(raw, 0.2, 3)
    want = ids_of(e, texts)
    monkeypatch.setattr(subword, "STATES", 0)
    assert [ids_of(e, [t], np.array([i], np.uint64))[0] for i, t in enumerate(texts)] == want


def test_very_long_words_are_whole(raw):
    text = "abcdefghij" * 20000
    e = subword.Encoder(raw, 0.1, 3)
    assert e.v.decode(np.array(ids_of(e, [text])[0]))[1:].tobytes().decode() == text


def test_encode_and_decode_operators(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (4, "a b"), (None, "x y"), (5, "word " * 30000), (6, "\u2581\x00\U0001f600 \ufffd")]
    docs = spark.createDataFrame([(*r, 0, "n") for r in rows], "doc_id long, text string, ids long, lossless string")
    found = subword.encode(docs, MODEL, 0.3)
    back = [(r["doc_id"], r["text"]) for r in subword.decode(found, MODEL).collect()]
    key = lambda r: (str(r[0]), r[1])
    assert sorted(back, key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    got = found.collect()
    assert all(r["lossless"] for r in got) and len({str(r["ids"]) for r in got if r["doc_id"] == 4}) == 1
    assert subword.encode(docs.limit(0), MODEL).count() == 0 and subword.decode(found.limit(0), MODEL).count() == 0


def test_query_against_plain_search(spark, raw):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, SMALL, "documents").collect()}
    e = subword.Encoder(raw, 0.1, 17)
    got = {r["doc_id"]: r for r in registry.QUERIES["op6_merge_dropout"](spark, SMALL).collect()}
    assert set(got) == set(texts) and all(r["lossless"] for r in got.values())
    for i, t in sorted(texts.items(), key=lambda x: len(x[1]))[:60]:
        ids = np.array(plain(e.v, t, int(T.mix(np.array([i], T.U))[0]), e.seed, 0.1), "<u4")
        assert (got[i]["n_ids"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(ids))
