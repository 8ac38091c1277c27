"""Quality rules: counts of words, symbols and repetition, and language-specific bands of character n-gram perplexity.

The language model is modified Kneser-Ney over runs of ORDER characters, whatever the corpus's size. Characters are themselves:
only white space is one character, digits are one, and code points beyond the basic plane are hashed to the 2,048 numbers that
no character has. Spark counts the runs in all texts; each task's counts are summed before they are shuffled. Every run counts,
however rare, and has its smoothed probability in a table that Spark makes by aggregates and joins. Every language of at least
OWN_CHARS characters in OWN_DOCS documents has a model and a band of its own, whatever else the corpus holds; the others, and
texts without a language, share one.

Texts are scored by that table. Of a language's runs those that are at least a share of RARE of all its characters, which are
1 / RARE at most, are broadcast to the workers that read the texts, as sorted arrays; languages are taken in groups of at most
MODEL_ROWS such runs together, one group's before the next's. What a text has of other runs, a few hundredths of its characters,
is joined with the table. So RARE decides by which way a run's probability comes, and not which it is.

A text's cross-entropy is the mean negative log10 probability of its characters. For each language the median and the
median absolute deviation over all documents that pass the base rules give the band: `width` robust standard deviations
below and above the median, wider by sqrt(SHORT / characters) for texts of fewer than SHORT characters, whose mean varies
more. Texts outside are rejected: above are texts unlike the language, below are texts that repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import _text
from ._classes import SYMBOLS
from ._shared import carried, forget, ship, written
from ._text import U, grams, hashes, mix, spans, utf8

ORDER, RARE, MODEL_ROWS = 4, 2e-7, 6_000_000
OWN_CHARS, OWN_DOCS = 40_000, 10  # of a language with a model of its own
STEP, PIECE, HELD = 512 << 10, 1 << 20, 1_000_000  # bytes of texts and of one text at a time, and runs that a task holds before it sums them
UNIT = 10**9  # of a log10 probability, for sums that don't depend on the order of rows
SHORT, WIDTH = 1500, 4.0
BINS = 2000  # a unit of cross-entropy, for exact medians


def runs(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    return _text.runs(offsets, STEP)


# --- counts of the base rules


def per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def base_counts(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and how many words equal the one before."""
    n = len(offsets) - 1
    starts, ends, first = spans(data, offsets)
    words = hashes(data, starts, ends, False)
    solid = np.ones(256, bool)
    solid[[9, 10, 11, 12, 13, 32]] = False
    solid = solid[data]
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    # lines: from each text's begin or the byte after \n to the next \n or the text's end
    cut = data == 10
    line_ends = np.sort(np.concatenate([np.flatnonzero(cut), offsets[1:]]))
    text_of_line = np.repeat(np.arange(n), per_text(cut, offsets) + 1)
    line_starts = np.concatenate([[0], line_ends[:-1] + 1])
    new = np.concatenate([[True], text_of_line[1:] != text_of_line[:-1]])
    line_starts[new] = offsets[:-1]
    any_word = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    used = any_word[line_ends] > any_word[line_starts]
    lines, owner = hashes(data, line_starts[used], line_ends[used], False), text_of_line[used]
    _, at = np.unique(mix(lines ^ mix(owner.astype(U) + U(1))), return_index=True)
    dup_lines = np.bincount(owner, minlength=n) - np.bincount(owner[at], minlength=n)
    # words in windows of 8 that the text has twice or more
    windows, of = grams(words, first, 8)
    owner = np.repeat(np.arange(n), np.diff(of))
    _, which, times = np.unique(mix(windows ^ mix(owner.astype(U) + U(1))), return_inverse=True, return_counts=True)
    begin = (np.arange(len(windows)) + np.repeat(first[:-1] - of[:-1], np.diff(of)))[times[which] > 1]
    change = np.zeros(len(words) + 1, np.int32)
    np.add.at(change, begin, 1)
    np.add.at(change, begin + 8, -1)
    echo = np.zeros(len(words), bool)
    echo[1:] = words[1:] == words[:-1]
    echo[first[:-1][first[:-1] < len(words)]] = False
    return [np.diff(first), per_text(solid & ((data & 0xC0) != 0x80), offsets), per_text(symbol[data], offsets), dup_lines, per_text(np.cumsum(change[:-1]) > 0, first), per_text(echo, first)]


# --- the language model


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters as 16-bit numbers, and the number of each text's first one (n + 1 values)."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    out = np.where(points > 0xFFFF, 0xD800 + (points * np.uint32(2654435761) >> 21), points).astype(np.uint16)
    out[(out >= 9) & (out <= 13)] = 32
    out[(out >= 48) & (out <= 57)] = 48
    return out, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]


def codes(characters: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The run of ORDER characters that ends at each character, as a number; white space stands before each text. first: n + 1 values."""
    at = np.arange(len(characters)) - np.repeat(first[:-1], np.diff(first))
    out = np.zeros(len(characters), U)
    for back in range(ORDER - 1, -1, -1):
        moved = np.full(len(characters), 32, U)
        moved[back:] = characters[: len(characters) - back]
        moved[at < back] = 32
        out = (out << U(16)) | moved
    return out


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts: first text and the one after the last, their bytes and offsets, and the runs at each character's end. A very long text comes in parts."""
    for lo, hi in runs(offsets):
        begin, end = int(offsets[lo]), int(offsets[hi])
        if end - begin <= PIECE:
            part, where = data[begin:end], offsets[lo : hi + 1] - begin
            characters, first = units(part, where)
            yield lo, hi, first, codes(characters, first), np.diff(first)
            continue
        kept, at = np.zeros(0, np.uint16), begin
        while at < end:
            to = min(at + PIECE, end)
            while to < end and data[to] & 0xC0 == 0x80:
                to += 1
            more, _ = units(data[at:to], np.array([0, to - at]))
            whole = np.concatenate([kept, more])
            yield lo, hi, np.array([0, len(more)]), codes(whole, np.array([0, len(whole)]))[len(kept) :], np.array([len(more)])
            kept, at = whole[-(ORDER - 1) :], to


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs with their counts from several such pairs."""
    run, which = np.unique(np.concatenate([r for r, _ in parts]), return_inverse=True)
    return run, np.bincount(which, np.concatenate([n for _, n in parts]), len(run)).astype(np.int64)


def count_runs(docs: DataFrame) -> DataFrame:
    """(lang, run, n) over all texts."""

    def of(batches):
        held: dict[str, list] = {}

        def passed():
            for lang, parts in held.items():
                run, n = merged(parts)
                for at in range(0, len(run), 1 << 16):
                    some = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run[some]), pa.string()), pa.array(run[some].view(np.int64)), pa.array(n[some])], ["lang", "run", "n"])
            held.clear()

        for batch in batches:
            data, offsets = utf8(batch.column(1))
            langs = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, first, run, _ in pieces(data, offsets):
                here = langs[lo:hi]
                for lang in dict.fromkeys(here):
                    own = run if len(here) == 1 or (here == lang).all() else run[np.repeat(here == lang, np.diff(first))]
                    if len(own):
                        held.setdefault(lang, []).append(np.unique(own, return_counts=True))
                if sum(len(r) for parts in held.values() for r, _ in parts) > HELD:
                    held |= {lang: [merged(parts)] for lang, parts in held.items()}
                    if sum(len(r) for ((r, _),) in held.values()) > HELD // 2:
                        yield from passed()
        yield from passed()

    return docs.select("lang", "text").mapInArrow(of, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n"))


def discounts(counts: np.ndarray) -> np.ndarray:
    """Of modified Kneser-Ney, for counts 0, 1, 2 and 3 or more."""
    n = [max(1, int((counts == i).sum())) for i in (1, 2, 3, 4)]
    y = n[0] / (n[0] + 2 * n[1])
    found = [i + 1 - (i + 2) * y * n[i + 1] / n[i] for i in range(3)]
    return np.array([0.0, *(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))])


def key(order: int, run: np.ndarray) -> np.ndarray:
    return mix(run ^ mix(np.array([order], U)))


def last(run: np.ndarray, k: int) -> np.ndarray:
    """The last k characters of runs."""
    return run & U((1 << 16 * k) - 1)


def probabilities(counted: DataFrame) -> DataFrame:
    """(lang, run, p, frequent): of every run of counted (lang, run, n) the log10 probability of its last character after the others, and whether it is a share of RARE of its language's characters.

    The same estimate as Model, of tables of any size. Sums are of whole numbers, so that the order of rows changes nothing.
    """
    tables = {ORDER: counted}
    for k in range(ORDER - 1, 0, -1):  # lower orders count how many different characters stand before
        tables[k] = written(tables[k + 1].groupBy("lang", F.col("run").bitwiseAND((1 << 16 * k) - 1).alias("run")).agg(F.count("*").alias("n")), "order")
    n, lower, out = F.col("n"), F.lit(1.0) / (F.col("size") + 1), None
    for k in range(1, ORDER + 1):
        each = tables[k].groupBy("lang").agg(*(F.greatest(F.lit(1), F.count_if(n == i)).alias(f"t{i}") for i in (1, 2, 3, 4)), F.count("*").alias("size"), F.sum("n").alias("whole"))
        y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))
        found = [i + 1 - (i + 2) * y * F.col(f"t{i + 2}") / F.col(f"t{i + 1}") for i in range(3)]
        each = each.select("lang", "size", "whole", *(F.least(F.greatest(d, F.lit(0.05)), F.lit(i + 0.95)).alias(f"d{i + 1}") for i, d in enumerate(found)))
        of = W.partitionBy("lang", "context")  # as many rows as there are characters at most
        rows = tables[k].withColumn("context", F.shiftrightunsigned("run", 16)).withColumns({"mass": F.sum("n").over(of), "n1": F.count_if(n == 1).over(of), "n2": F.count_if(n == 2).over(of), "n3": F.count_if(n > 2).over(of)})
        rows = rows.join(F.broadcast(each), "lang")  # a row a language
        if out is not None:
            shorter = out.select("lang", F.col("run").alias("shorter"), F.col("p").alias("lower"))
            rows, lower = rows.withColumn("shorter", F.col("run").bitwiseAND((1 << 16 * (k - 1)) - 1)).join(shorter, ["lang", "shorter"]), F.col("lower")
        off = F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))
        back = (F.col("d1") * F.col("n1") + F.col("d2") * F.col("n2") + F.col("d3") * F.col("n3")) / F.col("mass")
        out = rows.select("lang", "run", ((n - off) / F.col("mass") + back * lower).alias("p"), (n >= RARE * F.col("whole")).alias("frequent"))
    return out.withColumn("p", F.log10("p"))


class Known:
    """Sorted hashes of runs with their log10 probabilities."""

    def __init__(self, run: np.ndarray, p: np.ndarray):
        every = key(ORDER, run)
        o = np.argsort(every)
        self.hash, self.p = every[o], p[o].astype(np.float32)

    def log10(self, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each run's log10 probability, 0 where it isn't here, and whether it is."""
        if not len(self.hash):
            return np.zeros(len(run)), np.zeros(len(run), bool)
        at, there = find(self.hash, key(ORDER, run))
        return np.where(there, self.p[at].astype(np.float64), 0.0), there


class Model:
    """Of runs that are held in memory: sorted hashes of every order, with log10 probability and log10 back-off weight, for any text's runs."""

    def __init__(self, run: np.ndarray, n: np.ndarray):
        levels = {ORDER: (run, n)}
        for k in range(ORDER - 1, 0, -1):  # lower orders count how many different characters stand before
            levels[k] = np.unique(last(levels[k + 1][0], k), return_counts=True)
        self.unseen = -float(np.log10(len(levels[1][0]) + 1))  # of a character at the lowest order: one in those seen and one more
        at_shorter, shorter, hashes_, p_, backs = None, None, [], [], {}
        for k in range(1, ORDER + 1):
            run, n = levels[k]
            off = discounts(n)[np.minimum(n, 3)]
            context, which = np.unique(run >> U(16), return_inverse=True)
            mass = np.bincount(which, n)
            back = np.bincount(which, off) / mass
            lower = 10**self.unseen if k == 1 else shorter[np.searchsorted(at_shorter, last(run, k - 1))]
            p = (n - off) / mass[which] + back[which] * lower
            hashes_.append(key(k, run))
            p_.append(np.log10(p))
            backs[k - 1] = (context, np.log10(np.maximum(back, 1e-12)))
            at_shorter, shorter = run, p
        every, context = np.concatenate(hashes_), np.concatenate([key(k, c) for k, (c, _) in backs.items()])
        o, c = np.argsort(every), np.argsort(context)
        self.hash, self.p = every[o], np.concatenate(p_)[o].astype(np.float32)
        self.context, self.weight = context[c], np.concatenate([b for _, b in backs.values()])[c].astype(np.float32)

    def log10(self, run: np.ndarray) -> np.ndarray:
        """Log10 probability of each run's last character after the others."""
        out, open_ = np.zeros(len(run)), np.arange(len(run))
        for k in range(ORDER, 0, -1):
            at, there = find(self.hash, key(k, last(run[open_], k)))
            out[open_[there]] += self.p[at[there]]
            open_ = open_[~there]
            at, there = find(self.context, key(k - 1, last(run[open_], k) >> U(16)))
            out[open_[there]] += self.weight[at[there]]
        out[open_] += self.unseen
        return out


def find(sorted_: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
    return at, sorted_[at] == h


def modelled(docs: DataFrame) -> DataFrame:
    """docs with '*' for each language that has too little text for a model of its own."""
    sizes = docs.groupBy("lang").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"))
    large = sizes.where((F.col("chars") >= OWN_CHARS) & (F.col("n") >= OWN_DOCS))
    own = written(large.select("lang", F.lit(True).alias("own")), "own")
    return docs.join(F.broadcast(own), "lang", "left").withColumn("lang", F.when(F.col("own"), F.col("lang")).otherwise("*")).select(docs.columns)


def groups(sizes: dict[str, int]) -> list[list[str]]:
    """Languages in groups of at most MODEL_ROWS runs, or of one language. '*' is always there."""
    out, room = [], 0
    for lang, n in sorted((sizes | {"*": sizes.get("*", 0)}).items(), key=lambda x: (-x[1], x[0])):
        if not out or n > room:
            out, room = [*out, []], MODEL_ROWS
        out[-1].append(lang)
        room -= n
    return out


def trained(docs: DataFrame) -> DataFrame:
    """probabilities() of all runs in docs, written."""
    counted = written(count_runs(docs), "runs")
    model = written(probabilities(counted), "model")
    forget(counted)
    return model


def train(docs: DataFrame, model: DataFrame | None = None) -> Iterator[tuple[DataFrame, dict[str, Known]]]:
    """The documents of each group of languages, and the probabilities of their frequent runs. model: trained(docs), which has the others' too."""
    model = trained(docs) if model is None else model
    every = groups({r["lang"]: r["n"] for r in model.groupBy("lang").agg(F.count_if("frequent").alias("n")).collect()})  # a row a language
    for group in every:
        got = model.where(F.col("frequent") & F.col("lang").isin(group)).select("lang", "run", "p").toArrow()
        langs = got["lang"].to_numpy(zero_copy_only=False) if len(got) else np.array([], object)
        run, p = got["run"].to_numpy().view(U), got["p"].to_numpy()
        models = {}
        for lang in group:  # one may have no frequent runs, or, '*', none
            mine = np.flatnonzero(langs == lang)
            models[lang] = Known(run[mine], p[mine])
        del got, langs, run, p
        yield docs if len(every) == 1 else docs.where(F.col("lang").isin(group)), models


def score(docs: DataFrame, models: dict[str, Known]) -> DataFrame:
    """key (of the row), doc_id, lang (of the model), the base counts, n_scored, total (the log10 probability of the runs in models) and rest (the others, and how often); text and row too where docs has a row."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)  # bounded by MODEL_ROWS

    def of(batches):
        models, named = shared.value, TaskContext.get().partitionId() << 33
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            langs = [x if x in models else "*" for x in batch.column(1).to_pylist()]
            here, n = np.array(langs, object), len(batch)
            total, size, rest = np.zeros(n), np.zeros(n, np.int64), [(np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64))]
            for lo, hi, first, run, chars in pieces(data, offsets):
                size[lo:hi] += chars
                for lang in dict.fromkeys(here[lo:hi]):
                    if lang in models:
                        mine = np.repeat(here[lo:hi] == lang, np.diff(first))
                        seen, which = np.unique(run[mine], return_inverse=True)
                        owner = np.repeat(np.arange(lo, hi), np.diff(first))[mine]
                        p, known = models[lang].log10(seen)
                        total += np.bincount(owner, p[which], n)
                        if not known.all():
                            rare = ~known[which]
                            pair, times = np.unique(owner[rare] * len(seen) + which[rare], return_counts=True)
                            rest.append((pair // len(seen), seen[pair % len(seen)], times))
            owner, run, times = map(np.concatenate, zip(*rest))
            o = np.argsort(owner, kind="stable")
            others = pa.StructArray.from_arrays([pa.array(run[o].view(np.int64)), pa.array(times[o])], ["run", "times"])
            others = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner[o], np.arange(n + 1)).astype(np.int32)), others)
            for lo, hi in runs(offsets):
                counts = base_counts(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])[: len(COUNTS)]
                columns = [pa.array(named + np.arange(lo, hi)), batch.column(0).slice(lo, hi - lo), pa.array(langs[lo:hi], pa.string()), *(pa.array(c.astype(np.int64)) for c in counts), pa.array(size[lo:hi]), pa.array(total[lo:hi]), others.slice(lo, hi - lo)]
                yield pa.RecordBatch.from_arrays([*columns, *(batch.column(i).slice(lo, hi - lo) for i in kept)], ["key", "doc_id", "lang", *COUNTS, "n_scored", "total", "rest", *extra])
            named += n

    extra, kept = (["text", "row"], (2, 3)) if "row" in docs.columns else ([], ())
    kinds = {"key": S.LongType(), "doc_id": S.LongType(), "lang": S.StringType(), **dict.fromkeys([*COUNTS, "n_scored"], S.LongType()), "total": S.DoubleType(), "rest": S.ArrayType(S.StructType([S.StructField("run", S.LongType()), S.StructField("times", S.LongType())]))}
    return docs.mapInArrow(of, S.StructType([*(S.StructField(c, kind) for c, kind in kinds.items()), *(docs.schema[c] for c in extra)]))


def completed(scored: DataFrame, model: DataFrame) -> DataFrame:
    """Rows of score() with their cross_entropy, for which the probabilities of the rest are looked up in the model."""
    each = scored.select("key", "lang", F.explode("rest").alias("r")).select("key", "lang", "r.run", "r.times")
    found = each.join(model.select("lang", "run", "p"), ["lang", "run"]).groupBy("key").agg(F.sum(F.col("times") * F.round(F.col("p") * UNIT).cast("long")).alias("late"))
    total = F.col("total") + F.coalesce(F.col("late"), F.lit(0)) / UNIT
    whole = scored.drop("rest").join(written(found, "late"), "key", "left")
    return whole.withColumn("cross_entropy", -total / F.greatest(F.col("n_scored"), F.lit(1))).drop("key", "total", "late")


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"


def _median(rows: list[tuple[int, int]]) -> float:
    half, seen = sum(n for _, n in rows) / 2, 0
    for x, n in sorted(rows):
        seen += n
        if seen >= half:
            return x / BINS
    return 0.0


def bands(scored: DataFrame, width: float) -> dict[str, tuple[float, float]]:
    """Middle and half width of the band of cross-entropy by language, from an exact histogram of all documents that pass the base rules."""
    rows = scored.where("not base_failed").groupBy("lang", F.round(F.col("cross_entropy") * BINS).cast("int").alias("bin")).count().collect()  # one group's languages, of 12 * BINS bins each at most
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r["lang"], []).append((r["bin"], r["count"]))
    out = {}
    for lang, found in by.items():
        middle = _median(found)
        spread = 1.4826 * max(_median([(abs(x - round(middle * BINS)), n) for x, n in found]), 1 / BINS)
        out[lang] = (middle, width * spread)
    return out


def quality_rules(docs: DataFrame, width: float = WIDTH, carry: bool = False) -> DataFrame:
    """One row a document: doc_id, the base counts, base_failed, kept, and lang (whose model was used), cross_entropy and its band.

    Null and empty texts have no words and fail the base rules; null languages share the model of rare languages. Very long
    texts are counted and scored whole. Repeated rows stay rows, and count as often as they occur. Extra columns are ignored, but with `carry` each row has its text and a `row` of all else; an
    empty table gives no rows.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("*")).alias("lang"), F.col("text").cast("string"), *([carried(docs)] if carry else []))
    parts, found = [], {}
    docs = modelled(docs)
    model = trained(docs)
    for some, models in train(docs, model):
        parts.append(completed(written(score(some, models).withColumn("base_failed", F.expr(BASE_FAILED)), "scored"), model))
        found |= bands(parts[-1], width)
    forget(model)
    scored = reduce(DataFrame.unionByName, parts)
    wide = F.sqrt(F.greatest(F.lit(1.0), SHORT / F.greatest(F.col("n_scored"), F.lit(1))))
    table = docs.sparkSession.createDataFrame([(lang, float(m), float(h)) for lang, (m, h) in found.items()], "lang string, middle double, half double")
    out = scored.join(F.broadcast(table), "lang", "left").withColumn("lowest", F.col("middle") - F.col("half") * wide).withColumn("highest", F.col("middle") + F.col("half") * wide)
    inside = F.coalesce(F.col("cross_entropy").between(F.col("lowest"), F.col("highest")), F.lit(True))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "cross_entropy", "lowest", "highest", *(["text", "row"] if carry else []))
