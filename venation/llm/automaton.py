"""LM scoring with a weighted back-off automaton of runs of up to three words.

The model. A state holds the last two words (a pair seen in training), the last word (a word seen in training), or none (the
root); a text begins and ends in the state of the end token. From a state of two words, u v, every training run u v w is an
arc by w, and a failure arc leads to the state v; from v every training pair v w is an arc by w, and a failure arc leads to
the root, whose arcs are the training words and one for any unknown word. With the shares a and b the arcs' weights are the
logarithms of

    p(w | u v) = a * c(u v w) / c(u v) + (1 - a) * p(w | v),
    p(w | v) = b * c(v w) / c(v) + (1 - b) * p(w),
    p(w) = (c(w) - D) / N,   p(unknown) = D * V / N,   D = n1 / (n1 + 2 n2),

and those of the failure arcs log10(1 - a) and log10(1 - b): absolute discounting gives the unknown word its mass, and each
state's probabilities sum to 1. A text is read once, left to right; the state is carried and weights are summed. The shares
are chosen from SHARES squared by the leave-one-out likelihood of all training tokens.

The corpus has far more words and runs than a machine can hold, so no task holds the automaton. Texts are read once, in blocks
of about BLOCK bytes, which are written as tokens; both passes below read those, so that the order of the texts, or an executor
that is lost, changes nothing. A block asks for the words, pairs and triples it has, each once, with its own training counts;
requests are sorted hashes, dealt out by their upper bits and packed as differences. A bucket sums the counts of all
blocks and answers each block in the order it asked. The block's part of the automaton (states, arcs and failure arcs that its
texts can reach) is built from the answers. A frequent word is asked for once a block, so it makes no bucket large. The number
of buckets follows the size of the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import fold, forget, ship, written
from ._text import U, hashes, mix, pack, runs, spans, unpack, utf8

BLOCK = 6 << 20
BUCKET_BYTES = 4 << 20  # text whose words and pairs share a bucket, about
STEP = 1 << 15  # tokens whose weights are worked out at a time
SHARES = (0.0, 0.03, 0.15, 0.4, 0.7, 0.92)
MIXES = [(a, b) for a in SHARES for b in SHARES]  # shares of triples and of pairs
WIDTH = 56  # bits of a pair's or triple's hash: among the 2**43 of some 100 TB, one in 8,000 shares its hash with another
END = U(0x5EED0E0D0FFACADE)  # the end token's hash


def pair_hash(h: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(h) * U(3) + w) >> U(64 - WIDTH)


def planes(values: np.ndarray) -> bytes:
    """Unsigned numbers with their bytes of one rank together, compressed."""
    return zstandard.compress(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes(), 1)


def unplanes(data: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


class Block:
    """Some texts as token hashes: each text's words, then the end token."""

    def __init__(self, number: int):
        self.number, self.parts, self.ids, self.held, self.sizes, self.bytes = number, [], [], [], [], 0

    def add(self, ids: list, held: list, words: np.ndarray, first: np.ndarray, size: int) -> None:
        n = np.diff(first)
        at = first[1:] + np.arange(len(n))  # where each end token goes
        tokens = np.empty(len(words) + len(n), U)
        word = np.ones(len(tokens), bool)
        word[at] = False
        tokens[word], tokens[at] = words, END
        self.parts.append(tokens)
        self.ids += ids
        self.held += held
        self.sizes.append(n + 1)
        self.bytes += size

    def close(self) -> None:
        self.tokens = np.concatenate(self.parts)
        self.size = np.concatenate(self.sizes)
        self.train = np.repeat(~np.array(self.held, bool), self.size)


ENCODED = "block long, keys binary, which binary, size binary, ids array<long>, held array<boolean>"


def encoded(batches):
    """The blocks of one partition of (doc_id, held, text), as rows of ENCODED."""
    part = TaskContext.get().partitionId()
    now = Block(part << 32)

    def row(block: Block) -> pa.RecordBatch:
        block.close()
        keys, which = np.unique(block.tokens, return_inverse=True)
        values = [block.number, pack(keys), planes(which.astype("<u4")), planes(block.size.astype("<u4")), block.ids, block.held]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()))
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], ["block", "keys", "which", "size", "ids", "held"])

    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, held = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lo, hi in runs(offsets):
            own, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            starts, ends, first = spans(own, where)
            now.add(ids[lo:hi], held[lo:hi], hashes(own, starts, ends, True), first, len(own))
            if now.bytes >= BLOCK:
                yield row(now)
                now = Block(now.number + 1)
    if now.parts:
        yield row(now)


def restored(row: dict) -> Block:
    """The block of a row of ENCODED."""
    block = Block(row["block"])
    block.ids, block.held = row["ids"], row["held"]
    block.tokens = unpack(row["keys"])[unplanes(row["which"], "<u4")]
    block.size = unplanes(row["size"], "<u4").astype(np.int64)
    block.train = np.repeat(~np.array(block.held, bool), block.size)
    return block


def before(tokens: np.ndarray) -> np.ndarray:
    """The token before each; a text begins after an end token."""
    return np.concatenate([[END], tokens[:-1]])


def tuples(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pair that each token ends; which tokens end a triple (all but a text's first); and those triples."""
    last = before(tokens)
    pairs = pair_hash(last, tokens)
    inner = last != END
    return pairs, inner, pair_hash(before(pairs)[inner], tokens[inner])


def requests(batches, buckets: int):
    """(kind, bucket, block, keys, counts): words (kind 1), pairs (2) and triples (3) of each block with their training counts."""
    bits = buckets.bit_length() - 1
    for block in (restored(batch.slice(i, 1).to_pylist()[0]) for batch in batches for i in range(len(batch))):
        rows: list[list] = [[], [], [], [], []]
        pairs, inner, triples = tuples(block.tokens)
        for kind, every, train in ((1, block.tokens, block.train), (2, pairs, block.train), (3, triples, block.train[inner])):
            keys, which = np.unique(every, return_inverse=True)
            counts = np.bincount(which, train, len(keys)).astype(np.uint32)
            edge = np.searchsorted(keys >> U((64 if kind == 1 else WIDTH) - bits), np.arange(buckets + 1, dtype=U))
            for b in np.flatnonzero(np.diff(edge)):
                lo, hi = edge[b], edge[b + 1]
                for out, x in zip(rows, (kind, int(b), block.number, zstandard.compress(pack(keys[lo:hi]), 1), planes(counts[lo:hi]))):
                    out.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["kind", "bucket", "block", "keys", "counts"])


def answers(table: pa.Table) -> pa.Table:
    """(kind, bucket, block, counts) in the order of the requests; and for words one row with block -1 and sums: V, n1, n2, N."""
    kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
    keys = [unpack(zstandard.decompress(x)) for x in table["keys"].to_pylist()]
    counts = [unplanes(x, "<u4") for x in table["counts"].to_pylist()]
    _, which = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(which, np.concatenate(counts)).astype(np.uint64)
    edge = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
    out = [(kind, bucket, b, planes(total[which[lo:hi]].astype("<u8")), 0, 0, 0, 0) for b, lo, hi in zip(table["block"].to_pylist(), edge, edge[1:])]
    if kind == 1:
        out.append((kind, bucket, -1, b"", *(int(x) for x in ((total > 0).sum(), (total == 1).sum(), (total == 2).sum(), total.sum()))))
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), *[pa.int64()] * 4))], ["kind", "bucket", "block", "counts", "v", "n1", "n2", "n"])


class Automaton:
    """The part that a block can reach: training counts of its distinct words, pairs and triples, in the order of their hashes."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, n: int, v: int, n1: int, n2: int):
        self.words, self.pairs, self.triples, self.n = words, pairs, triples, n
        self.discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        self.unknown = self.discount * max(v, 1) / max(n, 1)

    def root(self, c: np.ndarray) -> np.ndarray:
        """Probability by the root's arcs of words with these counts."""
        return np.where(c > 0, (c - self.discount) / max(self.n, 1), self.unknown)

    def weights(self, counts: np.ndarray) -> np.ndarray:
        """Natural logarithms of the ways taken, a row for each of MIXES, where the word, its state's last word, the pair of both, its state's pair and the triple have these counts."""
        c, h, hw, gh, ghw = counts
        below = self.root(c)
        pair, triple = h > 0, gh > 0  # states that training has; from others reading goes on without them
        gain = np.where(pair, hw / np.maximum(h, 1) - below, 0)
        arc = np.where(triple, ghw / np.maximum(gh, 1), 0)
        out = np.empty((len(MIXES), len(c)))
        for i, (a, b) in enumerate(MIXES):
            out[i] = (below + b * gain) * (1 - a * triple) + a * arc
        return np.log(out, out=out)


def traverse(block: Block, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, scalars: dict):
    """Each text's known tokens, base score and score for each of MIXES; and the training tokens' leave-one-out sums for MIXES."""
    n, v = scalars["n"], scalars["v"]
    automaton = Automaton(words, pairs, triples, n, v, scalars["n1"], scalars["n2"])
    keys, word = np.unique(block.tokens, return_inverse=True)
    end = np.searchsorted(keys, END)
    every, inner, own = tuples(block.tokens)
    arc = np.unique(every, return_inverse=True)[1]
    del every
    long = np.full(len(word), -1)
    long[inner] = np.unique(own, return_inverse=True)[1]
    del own
    edge = np.concatenate([[0], np.cumsum(block.size)])
    known, base, scores, left_out = np.zeros(len(block.size), np.int64), np.zeros(len(block.size)), np.zeros((len(MIXES), len(block.size))), np.zeros(len(MIXES))
    for a, b in runs(edge, STEP):
        for lo in range(edge[a], edge[b], STEP):  # more than once for long texts alone
            hi = min(lo + STEP, edge[b])
            state = np.concatenate([[word[lo - 1] if lo else end], word[lo : hi - 1]])  # a text's first state is the one that the end token before it leads to
            context = np.concatenate([[arc[lo - 1] if lo else 0], arc[lo : hi - 1]])
            deep = long[lo:hi] >= 0
            third = automaton.triples[long[lo:hi][deep]]
            counts = np.zeros((5, hi - lo))
            counts[0], counts[1], counts[2] = automaton.words[word[lo:hi]], automaton.words[state], automaton.pairs[arc[lo:hi]]
            counts[3, deep], counts[4, deep] = automaton.pairs[context[deep]], third
            first = np.maximum(edge[a:b], lo) - lo
            known[a:b] += np.add.reduceat((counts[0] > 0).astype(np.int64), first)
            base[a:b] += np.add.reduceat(np.log10((counts[0] + 1) / (n + v + 1)), first)
            scores[:, a:b] += np.add.reduceat(automaton.weights(counts), first, axis=1)
            train = block.train[lo:hi]
            if train.any():
                left_out += automaton.weights(counts[:, train] - 1).sum(axis=1)
    return known, base, scores.T / np.log(10), (left_out / np.log(10)).tolist()


def lm_scores(docs: DataFrame, folds: int = 7, held_out: int = 2) -> DataFrame:
    """One row a document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the model's two shares.

    Learnt from the documents whose crc32(doc_id as text) modulo `folds` is not `held_out`. Words are runs of bytes other
    than white space, A-Z lower-cased; each text has one end token more. Null and empty texts have only that. If there is
    nothing to learn from, every word is unknown. Very long texts are a block of their own. Repeated rows count and are scored
    as often as they occur. An empty table gives no rows. Extra columns are ignored. The order of the rows has no effect.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long"), (fold("doc_id", folds) == held_out).alias("held"), F.col("text").cast("string"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = 1 << max(4, int(np.ceil(np.log2(max(1, size / BUCKET_BYTES)))))
    texts = written(docs.mapInArrow(encoded, ENCODED), "blocks")
    asked = texts.mapInArrow(lambda batches: requests(batches, buckets), "kind int, bucket int, block long, keys binary, counts binary")
    told = asked.groupBy("kind", "bucket").applyInArrow(answers, "kind int, bucket int, block long, counts binary, v long, n1 long, n2 long, n long")
    told = written(told, "answers")
    sums = told.where("block = -1").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("v", "n1", "n2", "n"))).first().asDict()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        block = restored(left.to_pylist()[0])
        right = right.sort_by("bucket")
        found = [np.concatenate([np.zeros(0, "<u8"), *(unplanes(x, "<u8") for k, x in zip(right["kind"].to_pylist(), right["counts"].to_pylist()) if k == kind)]) for kind in (1, 2, 3)]
        known, base, scores, left_out = traverse(block, *found, sums)
        n = len(block.size)
        return pa.Table.from_arrays(
            [pa.array(block.ids, pa.int64()), pa.array(block.held, pa.bool_()), pa.array(block.size), pa.array(known.astype(np.int64)), pa.array(base), pa.array(list(scores), pa.list_(pa.float64())), pa.array([left_out] + [None] * (n - 1), pa.list_(pa.float64()))],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "scores", "left_out"],
        )

    scored = texts.groupBy("block").cogroup(told.where("block >= 0").select("block", "kind", "bucket", "counts").groupBy("block")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, scores array<double>, left_out array<double>")
    scored = written(scored, "scores")
    forget(texts, told)
    totals = scored.where("left_out is not null").agg(*(F.sum(F.col("left_out")[i]).alias(f"m{i}") for i in range(len(MIXES)))).first()
    best = max(range(len(MIXES)), key=lambda i: (round(totals[i], 3), -i)) if totals[0] is not None else 0
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(sums["n"])).cast("long").alias("train_tokens"), "base_score", F.col("scores")[best].alias("score"), *(F.lit(float(x)).alias(c) for x, c in zip(MIXES[best], ("triple_share", "pair_share"))))
