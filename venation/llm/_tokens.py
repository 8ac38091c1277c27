"""Ids of a byte-level BPE vocabulary, computed once for every distinct stretch of text in a batch.

The vocabulary splits text by a pattern before it merges, and never across the end of a word. So a batch is cut where a
space follows a visible character, equal stretches are encoded once, and ids are laid out by array operations.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np

from ._text import hashes

#: The pattern that splits text for this family of vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_made: dict[int, Callable] = {}


def _alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(vocabulary: bytes) -> Callable:
    """(data, offsets) -> (ids, number of the first id of each text and one more), for UTF-8 bytes of several texts."""
    key = hash(vocabulary)
    if key not in _made:
        _made[key] = _make(vocabulary)
    return _made[key]


def _make(vocabulary: bytes) -> Callable:
    import tiktoken
    from tokenizers import Tokenizer

    spec, letters = json.loads(vocabulary), _alphabet()
    special = [x["content"] for x in spec.get("added_tokens", [])]
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    merged = [x.replace(" ", "") if isinstance(x, str) else "".join(x) for x in spec["model"]["merges"]]
    if [spec["model"]["vocab"][x] for x in merged] != list(range(256, 256 + len(merged))):
        raise ValueError("the vocabulary's ids don't follow its merges")
    fast = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    width = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, i in ranks.items():
        width[i] = len(token)
    slow = Tokenizer.from_str(vocabulary.decode())
    marks = [x.encode() for x in special]
    ends = np.zeros(256, bool)  # bytes after which a space begins a new stretch: visible ASCII and what can't end a wide space
    ends[0x21:0x7F] = True
    ends[0x80:] = True
    ends[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
    gaps = np.zeros(256, bool)
    gaps[[9, 10, 11, 12, 13, 32]] = True

    def encode(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = data[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        raw = data.tobytes()
        if any(m in raw for m in marks):  # texts with special tokens, one by one
            parts = [np.array(slow.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32) if any(m in raw[a:b] for m in marks) else encode(data[a:b], np.array([0, b - a]))[0] for a, b in zip(offsets, offsets[1:])]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = gaps[data[1:]] & ends[data[:-1]]
        cut[offsets] = True
        starts = np.flatnonzero(cut)
        starts, stops = starts[:-1], starts[1:]
        _, first, which = np.unique(hashes(data, starts, stops, False), return_index=True, return_inverse=True)
        # stretches that begin with a space and end visibly keep their ids in a row: all of them are one call
        begin, stop = starts[first], stops[first]
        plain = gaps[data[begin]] & ends[data[stop - 1]]
        order = np.argsort(~plain, kind="stable")  # the plain ones first
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        which, begin, stop, n = rank[which], begin[order], stop[order], int(plain.sum())
        size = (stop - begin)[:n]
        end = np.cumsum(size)
        row = data[np.repeat(begin[:n] - (end - size), size) + np.arange(end[-1])] if n else data[:0]
        together = fast.encode_to_numpy(row.tobytes().decode(), disallowed_special=()).astype(np.uint32)
        edge = np.searchsorted(np.cumsum(width[together]), end) + 1 if n else end
        alone = [fast.encode_ordinary(raw[a:b].decode()) for a, b in zip(begin[n:].tolist(), stop[n:].tolist())]
        sizes = np.concatenate([np.diff(edge, prepend=0), np.fromiter(map(len, alone), np.int64, len(alone))])
        flat = np.concatenate([together, np.fromiter((i for ids in alone for i in ids), np.uint32)])
        base = np.cumsum(sizes) - sizes
        mine = sizes[which]
        end = np.cumsum(mine)
        ids = flat[np.repeat(base[which] - (end - mine), mine) + np.arange(end[-1])]
        return ids, np.concatenate([[0], end])[np.searchsorted(starts, offsets)]

    return encode
