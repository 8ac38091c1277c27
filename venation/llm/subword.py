"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A BPE vocabulary merges, again and again, the adjacent pair of a word whose merged piece scores best, leftmost first. Here
each candidate taken from that agenda is skipped with probability `dropout`; a skipped candidate returns only if a merge
beside it makes it anew. Whether it is skipped is read off a hash of (seed, document, occurrence, piece, place), so the same
seed gives the same ids on any machine, and every occurrence of a word is cut anew. Without dropout the ids are those of the
vocabulary's own encoder.

No piece reaches over the begin of a run of spaces, so texts are cut there. What is left of a word after some candidates were
taken and others skipped is a state, with one next state if its best candidate is taken and one if it is skipped. States are
made when first reached and kept for later occurrences, so that an occurrence is a walk: all occurrences of a batch step
together, a draw each a step. Where states would need more than STATES bytes they are made anew, which changes no result. Words
of more than LONGEST characters go through a priority queue one by one, in a time that grows as n log n.

Characters that the vocabulary lacks, and U+2581, which it uses for the space, become pieces of single bytes. So decoding
gives every text back.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship
from ._text import U, hashes, mix, runs, utf8

LONGEST = 128  # characters of a word that is done by states
STATES = 128 << 20  # bytes of states that a worker keeps from batch to batch
STEP = 2 << 20  # bytes of text at a time
NEVER = np.int32(2**16 - 1)  # above any rank
SPACE = "▁"
MASK = (1 << 64) - 1


class Vocabulary:
    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.piece_size()
        pieces = [sp.id_to_piece(i) for i in range(self.size)]
        plain = {p: i for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.byte = np.zeros(256, np.int32)
        for i, p in enumerate(pieces):
            if sp.is_byte(i):
                self.byte[int(p[3:-1], 16)] = i
        if self.size >= NEVER:
            raise ValueError("more pieces than ranks of 16 bits")
        if any(SPACE in p.lstrip(SPACE) for p in plain):
            raise ValueError("a piece reaches over a space")
        # symbols: pieces, then characters that are only inside pieces, then (negative) other characters
        symbol = dict(plain)
        for c in sorted({c for p in plain for c in p} - set(plain)):
            symbol[c] = self.size + len(symbol) - len(plain)
        self.of_char = -1 - np.arange(0x110000, dtype=np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.of_char[ord(c)] = i
        self.of_char[ord(" ")] = symbol[SPACE]
        self.of_char[ord(SPACE)] = -1 - ord(SPACE)
        self.char_of = {i: c for c, i in symbol.items() if i >= self.size}
        order = sorted(plain, key=lambda p: (-sp.get_score(plain[p]), plain[p]))
        rank = {p: r for r, p in enumerate(order)}
        found = sorted((symbol[p[:k]] << 24 | symbol[p[k:]], rank[p], plain[p]) for p in plain for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.pair, self.rank, self.merged = (np.array(c) for c in zip(*found))
        self.rank, self.merged = self.rank.astype(np.int32), self.merged.astype(np.int32)
        self._table: dict[int, tuple[int, int]] | None = None
        raw = [p.replace(SPACE, " ").encode() if p in plain and plain[p] == i else b"" for i, p in enumerate(pieces)]
        for b, i in enumerate(self.byte):
            raw[i] = bytes([b])
        self.width = np.array([len(r) for r in raw])
        self.flat, self.base = np.frombuffer(b"".join(raw), np.uint8), np.cumsum(self.width) - self.width

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of merging two symbols; NEVER where there is none."""
        key = left.astype(np.int64) << 24 | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        there = (self.pair[at] == key) & (left >= 0) & (right >= 0)
        return np.where(there, self.rank[at], NEVER), np.where(there, self.merged[at], -1)

    def table(self) -> dict[int, tuple[int, int]]:
        """look() for one pair at a time: key of two symbols -> rank and piece."""
        if self._table is None:
            self._table = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        return self._table

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, the space before the text included."""
        n = self.width[ids]
        end = np.cumsum(n)
        return self.flat[np.repeat(self.base[ids] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]


def skipped(key: np.ndarray, piece: np.ndarray, place: np.ndarray, dropout: float) -> np.ndarray:
    """Whether the candidate is dropped. key: of seed, document and occurrence; place: where in the word it begins."""
    h = mix(key ^ mix(piece.astype(U) * U(0x100000000) + place.astype(U)))
    return (h >> U(11)).astype(np.float64) / 2.0**53 < dropout


def _mix(x: int) -> int:
    """mix() of one number."""
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def _skipped(key: int, piece: int, place: int, dropout: float) -> bool:
    """skipped() of one candidate."""
    return (_mix(key ^ _mix((piece << 32) + place & MASK)) >> 11) / 2.0**53 < dropout


def agenda(v: Vocabulary, symbols: list[int], key: int, dropout: float) -> list[int]:
    """One word's symbols after all merges, by a priority queue."""
    left, right, table = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1)), v.table()
    right[-1], symbols, queue, alive = -1, list(symbols), [], [True] * len(symbols)

    def offer(i: int) -> None:
        j = right[i] if i >= 0 else -1
        if j >= 0 and symbols[i] >= 0 and symbols[j] >= 0:
            found = table.get(symbols[i] << 24 | symbols[j])
            if found:
                heapq.heappush(queue, (found[0], i, found[1], symbols[i], symbols[j]))

    for i in range(len(symbols)):
        offer(i)
    while queue:
        _, i, piece, a, b = heapq.heappop(queue)
        j = right[i]
        if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
            continue
        if dropout and _skipped(key, piece, i, dropout):
            continue
        symbols[i], alive[j], right[i] = piece, False, right[j]
        if right[j] >= 0:
            left[right[j]] = i
        offer(left[i])
        offer(i)
    return [s for s, a in zip(symbols, alive) if a]


class States:
    """States of words of at most `width` symbols, a row each."""

    KINDS = {"ids": np.int32, "start": np.uint8, "rank": np.uint16}

    def __init__(self, v: Vocabulary, width: int):
        self.v, self.width, self.n = v, width, 0
        self.rows = {name: np.zeros((0, width), kind) for name, kind in self.KINDS.items()}  # the last of rank is unused
        self.size, self.best, self.made, self.place = (np.zeros(0, np.int32) for _ in range(4))
        self.done, self.then = np.zeros(0, bool), np.zeros((0, 2), np.int32)  # then: after the best is taken, after it is skipped
        self.base, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)  # of a done state's ids; -1 before they are laid out

    def bytes(self) -> int:
        return self.n * (7 * self.width + 40)

    def _room(self, more: int) -> slice:
        lo, hi = self.n, self.n + more
        if hi > len(self.size):
            most = max(hi, 2 * len(self.size), 1024)
            grown = lambda x, fill: np.concatenate([x, np.full((most - len(x), *x.shape[1:]), fill, x.dtype)])
            self.rows = {k: grown(x, 0) for k, x in self.rows.items()}
            for k, fill in (("size", 0), ("best", 0), ("made", 0), ("place", 0), ("done", False), ("then", -1), ("base", 0), ("count", -1)):
                setattr(self, k, grown(getattr(self, k), fill))
        self.n = hi
        return slice(lo, hi)

    def add(self, ids, start, rank, size) -> np.ndarray:
        """Numbers of new states."""
        at, row = self._room(len(size)), np.arange(len(size))
        for name, x in (("ids", ids), ("start", start), ("rank", rank)):
            self.rows[name][at] = x
        best = rank.argmin(axis=1)
        done = rank[row, best] == NEVER
        self.size[at], self.best[at], self.place[at], self.done[at] = size, best, start[row, best], done
        go = np.flatnonzero(~done)
        self.made[at][go] = self.v.look(ids[go, best[go]], ids[go, best[go] + 1])[1]
        return np.arange(at.start, at.stop, dtype=np.int32)

    def words(self, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """States of whole words: symbols, one word a row."""
        column = np.arange(self.width)
        rank = np.full(ids.shape, NEVER, np.uint16)
        rank[:, :-1] = self.v.look(ids[:, :-1], ids[:, 1:])[0]
        rank[column >= (size - 1)[:, None]] = NEVER
        return self.add(ids, np.broadcast_to(column, ids.shape), rank, size)

    def grow(self, state: np.ndarray, drop: np.ndarray) -> None:
        """The state after each of some, which aren't done, as its best candidate is taken or skipped."""
        ids, start, rank = (self.rows[k][state] for k in ("ids", "start", "rank"))
        size, best = self.size[state], self.best[state]
        off = np.flatnonzero(drop)
        rank[off, best[off]] = NEVER
        act = np.flatnonzero(~drop)
        j, made = best[act], self.made[state[act]]
        ids[act, j] = made
        # the column right of j goes: flat places of what stays, and the last one twice
        column = np.arange(self.width, dtype=np.int32)
        after = np.minimum(column + (column > j[:, None]), self.width - 1) + (act * self.width).astype(np.int32)[:, None]
        ids[act], start[act] = ids.ravel()[after], start.ravel()[after]
        gaps = np.minimum(column + (column >= j[:, None]), self.width - 1) + (act * self.width).astype(np.int32)[:, None]
        rank[act] = rank.ravel()[gaps]
        size[act] -= 1
        rank[act, size[act] - 1] = NEVER
        for k, ok in ((j - 1, j > 0), (j, j < size[act] - 1)):
            a, at = act[ok], k[ok]
            rank[a, at] = self.v.look(ids[a, at], ids[a, at + 1])[0]
        self.then[state, drop.astype(int)] = self.add(ids, start, rank, size)

    def walk(self, state: np.ndarray, key: np.ndarray, dropout: float) -> np.ndarray:
        """The done state that each occurrence ends in."""
        out, live = state.copy(), np.flatnonzero(~self.done[state])
        while len(live):
            now = out[live]
            drop = skipped(key[live], self.made[now], self.place[now], dropout) if dropout else np.zeros(len(now), bool)
            then = self.then[now, drop.astype(int)]
            if (then < 0).any():
                new = np.unique(now[then < 0].astype(np.int64) * 2 + drop[then < 0])
                self.grow(new >> 1, (new & 1).astype(bool))
                then = self.then[now, drop.astype(int)]
            out[live] = then
            live = live[~self.done[then]]
        return out


class Encoder:
    def __init__(self, model: bytes, dropout: float, seed: int):
        self.v, self.dropout, self.seed = Vocabulary(model), dropout, mix(np.array([seed], np.int64).view(U))[0]
        self.forget()

    def forget(self) -> None:
        self.states = {w: States(self.v, w) for w in (4, 6, 8, 10, 12, 16, 24, 32, 64, LONGEST)}
        self.known: dict[int, int] = {}  # a word's hash -> its width << 32 | state
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0  # ids of done states

    def _lay(self, ids: np.ndarray) -> int:
        """Where these ids begin in `flat`."""
        at, end = self.used, self.used + len(ids)
        if end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[at:end], self.used = ids, end
        return at

    def _meet(self, hash_: np.ndarray, chars: np.ndarray, first: np.ndarray) -> None:
        """States of words, given as characters, that were not met before."""
        symbols, size = self.v.of_char[chars], np.diff(first)
        lo = 0
        for hi, states in self.states.items():
            rows = np.flatnonzero((size > lo) & (size <= hi))
            if len(rows):
                inside = np.arange(hi) < size[rows][:, None]
                grid = np.where(inside, symbols[np.minimum(first[rows][:, None] + np.arange(hi), len(symbols) - 1)], -1)
                for h, at in zip(hash_[rows].tolist(), states.words(grid, size[rows]).tolist()):
                    self.known[h] = hi << 32 | at
            lo = hi

    def spelled(self, ids: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces as byte pieces."""
        odd = np.flatnonzero((ids < 0) | (ids >= self.v.size))
        if not len(odd):
            return ids, count
        raw = [(chr(-1 - i) if i < 0 else self.v.char_of[i]).encode() for i in ids[odd].tolist()]
        times = np.ones(len(ids), np.int64)
        times[odd] = [len(r) for r in raw]
        out = np.repeat(ids, times)
        out[np.repeat((ids < 0) | (ids >= self.v.size), times)] = self.v.byte[np.frombuffer(b"".join(raw), np.uint8)]
        edge = np.concatenate([[0], np.cumsum(times)])[np.concatenate([[0], np.cumsum(count)])]
        return out, np.diff(edge)

    def texts(self, data: np.ndarray, offsets: np.ndarray, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of several texts, and the number of each one's first id and one more. salt: a 64-bit number of each text."""
        if sum(s.bytes() for s in self.states.values()) > STATES:
            self.forget()
        size = np.diff(offsets)
        put = size > 0  # a space goes before each text that has any
        where = offsets[:-1] + np.cumsum(put) - put
        n = len(data) + int(put.sum())
        own = np.full(n, 32, np.uint8)
        keep = np.ones(n, bool)
        keep[where[put]] = False
        own[keep] = data
        begin = np.concatenate([where, [n]])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = own == 32
        cut[1:] &= own[:-1] != 32
        cut[where[put]] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [n]])
        owner = np.searchsorted(begin, starts, "right") - 1
        # texts without characters share their begin with the next one; the search gives the last of equal begins
        ordinal = np.arange(len(starts)) - np.searchsorted(starts, begin[owner])
        key = mix(salt[owner] ^ mix(self.seed + ordinal.astype(U)))
        word, first, which = np.unique(hashes(own, starts, ends, False), return_index=True, return_inverse=True)
        of = np.fromiter(map(self.known.get, word.tolist(), repeat(-1)), np.int64, len(word))
        new = of < 0
        long = np.zeros(len(word), bool)
        if new.any():
            a, b = starts[first[new]], ends[first[new]]
            end = np.cumsum(b - a)
            picked = own[np.repeat(a - (end - (b - a)), b - a) + np.arange(end[-1])]
            lead = np.concatenate([[0], np.cumsum((picked & 0xC0) != 0x80)])
            chars = np.frombuffer(picked.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
            edge = np.concatenate([[0], lead[end]])
            self._meet(word[new], chars, edge)
            long[new] = np.diff(edge) > LONGEST
            of[new] = np.fromiter(map(self.known.get, word[new].tolist(), repeat(0)), np.int64, int(new.sum()))
        wide, state = (of >> 32).astype(np.int32)[which], of.astype(np.int32)[which]
        base, mine = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        for width, states in self.states.items():
            rows = np.flatnonzero(wide == width)
            if not len(rows):
                continue
            at = states.walk(state[rows], key[rows], self.dropout)
            late = np.unique(at[states.count[at] < 0])
            if len(late):
                some = states.rows["ids"][late]
                flat, count = self.spelled(some[np.arange(width) < states.size[late][:, None]], states.size[late])
                states.base[late], states.count[late] = self._lay(flat) + np.cumsum(count) - count, count
            base[rows], mine[rows] = states.base[at], states.count[at]
        kept = self.used
        for i in np.flatnonzero(long[which]).tolist():
            symbols = self.v.of_char[np.frombuffer(own[starts[i] : ends[i]].tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)].tolist()
            ids = np.array(agenda(self.v, symbols, int(key[i]), self.dropout), np.int32)
            flat, _ = self.spelled(ids, np.array([len(ids)]))
            base[i], mine[i] = self._lay(flat), len(flat)
        end = np.cumsum(mine)
        ids = self.flat[np.repeat(base - (end - mine), mine) + np.arange(end[-1])]
        self.used = kept  # long words' ids are not looked for again
        return ids, np.concatenate([[0], end])[np.searchsorted(starts, begin)]


_made: dict[tuple, Encoder] = {}


def encoder(model: bytes, dropout: float, seed: int) -> Encoder:
    what = (hash(model), dropout, seed)
    if what not in _made:
        _made[what] = Encoder(model, dropout, seed)
    return _made[what]


def encode(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """One row a document: doc_id, ids (array), lossless (whether decoding gives the text back).

    Null and empty texts have no ids, and are lossless: decoding gives the empty text. Very long texts and words are encoded
    whole. Null ids count as 0 for the draws. Rows that repeat an id and a text have equal ids. An empty table gives no rows.
    Extra columns are ignored.
    """
    return _mapped(docs, model_file, dropout, seed, False)


def encoded_digests(docs: DataFrame, model_file: str, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """The same with n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit numbers) in place of the ids."""
    return _mapped(docs, model_file, dropout, seed, True)


def _mapped(docs: DataFrame, model_file: str, dropout: float, seed: int, digests: bool) -> DataFrame:
    ship(docs.sparkSession)
    with open(model_file, "rb") as f:
        model: Callable = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: a few MB

    def of(batches):
        e = encoder(model.value, dropout, seed)
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            salt = mix(np.array(batch.column(0).fill_null(0).to_numpy(), np.int64).view(U))
            for lo, hi in runs(offsets, STEP):
                own, where = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                ids, first = e.texts(own, where, salt[lo:hi])
                rows: list[list] = [[], [], []]
                for k in range(hi - lo):
                    mine = ids[first[k] : first[k + 1]]
                    back = e.v.decode(mine)[1:]
                    rows[0].append(len(mine) if digests else mine.tolist())
                    rows[1].append(zlib.crc32(mine.astype("<u4")))
                    rows[2].append(back.tobytes() == own[where[k] : where[k + 1]].tobytes())
                ids_column = batch.column(0).slice(lo, hi - lo)
                if digests:
                    yield pa.RecordBatch.from_arrays([ids_column, pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.bool_())], ["doc_id", "n_ids", "ids_crc32", "lossless"])
                else:
                    yield pa.RecordBatch.from_arrays([ids_column, pa.array(rows[0], pa.list_(pa.int32())), pa.array(rows[2], pa.bool_())], ["doc_id", "ids", "lossless"])

    schema = "doc_id long, n_ids long, ids_crc32 long, lossless boolean" if digests else "doc_id long, ids array<int>, lossless boolean"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(of, schema)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """One row a row of (doc_id, ids): doc_id, text. Null and empty ids are the empty text; ids that no text has, as cut bytes of a character, are replaced by U+FFFD."""
    ship(encoded.sparkSession)
    with open(model_file, "rb") as f:
        model = encoded.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary: a few MB

    def of(batches):
        v = encoder(model.value, 0.0, 0).v
        for batch in batches:
            texts = [v.decode(np.array(ids or [], np.int64))[1:].tobytes().decode(errors="replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(of, "doc_id long, text string")
