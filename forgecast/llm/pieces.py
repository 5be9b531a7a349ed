"""Unigram piece vocabulary: log scores, double-array trie and chunked texts.

The tokenizer file's pieces are used as they are; nothing is trained. A model
file without unigram probabilities (a merge-ranked one) gives each piece the
log probability of Zipf's law at its rank: -ln(rank + 1) - ln(H), with H the sum
that normalises it. A character without a piece scores ``UNKNOWN_PENALTY`` below
the worst piece and is written as byte pieces.

A space is the whitespace marker; texts get one marker in front, as the model
asks. No piece has a marker after another character (checked on loading), so
the best path of a text is that of its chunks (a run of spaces and what
follows up to the next space), each of which is solved once.
"""

from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

from forgecast.llm import textkit as K

DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
MARKER = "▁"

_CHAR_BYTES = np.ones(256, dtype=np.int64)
_CHAR_BYTES[0xC0:0xE0], _CHAR_BYTES[0xE0:0xF0], _CHAR_BYTES[0xF0:] = 2, 3, 4


class Vocabulary(NamedTuple):
    """Arrays only, so it is cheap to broadcast; its size is that of the model file."""

    base: np.ndarray
    check: np.ndarray
    piece: np.ndarray  # piece id at a trie node, -1: none
    score: np.ndarray  # by piece id
    unknown: float
    byte_ids: np.ndarray  # piece id of each byte value
    text_bytes: np.ndarray  # bytes of all pieces, one after another
    text_offs: np.ndarray


def double_array(keys: list[bytes], values: list[int]) -> tuple[np.ndarray, ...]:
    """(base, check, value): the child of node s by byte c is t = base[s] + c if check[t] == s.

    Node 0 is the root. Children are placed at the first offset where all their
    slots are free.
    """
    order = sorted(range(len(keys)), key=keys.__getitem__)
    keys, values = [keys[i] for i in order], [values[i] for i in order]
    size = 4 * sum(map(len, keys)) + 1024
    base, check, value = (np.full(size, x, dtype=np.int32) for x in (0, -1, -1))
    check[0] = 0
    low, crowded, todo = 1, 1, [(0, 0, len(keys), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        if len(keys[lo]) == depth:
            value[node] = values[lo]
            lo += 1
        runs, at = [], lo
        while at < hi:
            c, end = keys[at][depth], at + 1
            while end < hi and keys[end][depth] == c:
                end += 1
            runs.append((c, at, end))
            at = end
        if not runs:
            continue
        while check[low] >= 0:
            low += 1
        marks = np.array([c for c, _, _ in runs])
        at = max(low, int(marks[0]) + 1)
        if len(runs) > 1 or check[at] >= 0:
            at = _first_fit(check, marks, max(at, crowded)) + int(marks[0])
            crowded = at - 256  # slots well before the last fit are too crowded for branches
        offset = at - int(marks[0])
        base[node] = offset
        check[offset + marks] = node
        todo += [(offset + c, a, b, depth + 1) for c, a, b in runs]
    used = int(np.flatnonzero(check >= 0)[-1]) + 257
    return base[:used], check[:used], value[:used]


def _first_fit(check: np.ndarray, marks: np.ndarray, start: int, window: int = 2048) -> int:
    """Least offset from ``start`` on at which all marks fall on free slots."""
    while True:
        free = start + np.flatnonzero(check[start:start + window] < 0)
        for m in marks[1:]:
            free = free[check[free - marks[0] + m] < 0]
        if len(free):
            return int(free[0] - marks[0])
        start += window


@lru_cache(maxsize=4)
def load_vocabulary(path: str = DEFAULT_MODEL) -> Vocabulary:
    """Read a model file on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i)
                                            or model.is_unknown(i) or model.is_unused(i))]
    stored = np.array([model.get_score(i) for i in range(size)])
    ranked = sorted(plain, key=lambda i: (-stored[i], i))
    score = np.zeros(size)
    rank = np.arange(1, len(ranked) + 1)
    score[ranked] = -np.log(rank) - np.log((1.0 / rank).sum())
    texts = [b""] * size
    for i in plain:
        texts[i] = model.id_to_piece(i).replace(MARKER, " ").encode()
        if b" " in texts[i].lstrip(b" "):
            raise ValueError(f"piece {i} has a marker after another character")
    byte_ids = np.full(256, -1, dtype=np.int32)
    for i in range(size):
        if model.is_byte(i):
            b = int(model.id_to_piece(i)[3:5], 16)
            byte_ids[b], texts[i] = i, bytes([b])
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    keys = [i for i in plain if texts[i]]
    base, check, piece = double_array([texts[i] for i in keys], keys)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    return Vocabulary(base, check, piece, score, float(score[ranked].min()) - UNKNOWN_PENALTY,
                      byte_ids, np.frombuffer(b"".join(texts), np.uint8), offs)


class Chunks(NamedTuple):
    """Distinct chunks of a slice and which of them each row is made of."""

    buf: np.ndarray
    offs: np.ndarray
    inverse: np.ndarray
    first: np.ndarray  # chunks first[i]:first[i+1] belong to row i


def chunked(t: K.Texts) -> Chunks:
    """Cut each text, with a marker in front, before every run of spaces."""
    full = np.flatnonzero(np.diff(t.offs) > 0)
    buf = np.insert(t.buf, t.offs[full], 32)
    offs = t.offs + np.searchsorted(full, np.arange(len(t.offs)))
    space = buf == 32
    begin = space.copy()
    begin[1:] &= ~space[:-1]
    begin[offs[full]] = True
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offs)
    tiles = pa.Array.from_buffers(
        pa.large_binary(), len(starts),
        [None, pa.py_buffer(np.append(starts, len(buf)).astype(np.int64)), pa.py_buffer(buf)])
    coded = tiles.dictionary_encode()
    words = coded.dictionary
    if not len(words):
        return Chunks(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(0, np.int64), first)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[:len(words) + 1]
    return Chunks(np.frombuffer(words.buffers()[2], np.uint8)[:bounds[-1]], bounds,
                  coded.indices.to_numpy().astype(np.int64), first)


def best_path(v: Vocabulary, chunk: bytes) -> tuple[list[int], float]:
    """Viterbi over one chunk: piece ids and score. Ties go to the earlier start."""
    n = len(chunk)
    best, back = [-np.inf] * (n + 1), [(0, -1)] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if best[i] == -np.inf:
            continue
        char, node, single = i + int(_CHAR_BYTES[chunk[i]]), 0, False
        for j in range(i, n):
            child = int(v.base[node]) + chunk[j]
            if v.check[child] != node or child == 0:
                break
            node = child
            p = int(v.piece[node])
            if p >= 0:
                single |= j + 1 == char
                if best[i] + v.score[p] > best[j + 1]:
                    best[j + 1], back[j + 1] = best[i] + v.score[p], (i, p)
        if not single and best[i] + v.unknown > best[char]:
            best[char], back[char] = best[i] + v.unknown, (i, -1)
    ids, at = [], n
    while at:
        start, p = back[at]
        ids += [p] if p >= 0 else [int(v.byte_ids[b]) for b in reversed(chunk[start:at])]
        at = start
    return ids[::-1], float(best[n])


def best_paths(v: Vocabulary, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Viterbi over equally long chunks (rows of bytes) at once: (ids, counts, scores)."""
    rows, n = text.shape
    best = np.full((n + 1, rows), -np.inf)
    start, piece = np.zeros((n + 1, rows), np.int32), np.full((n + 1, rows), -1, np.int32)
    best[0] = 0.0
    wide = text.astype(np.int32).T.copy()
    for i in range(n):
        live = np.flatnonzero(best[i] > -np.inf)
        if not len(live):
            continue
        char = i + _CHAR_BYTES[wide[i][live]]
        single = np.zeros(rows, dtype=bool)
        end_of = np.zeros(rows, dtype=np.int64)
        end_of[live] = char
        at, node = live, np.zeros(len(live), np.int32)
        for j in range(i, n):
            child = v.base[node] + wide[j][at]
            ok = (v.check[child] == node) & (child > 0)
            at, node = at[ok], child[ok]
            if not len(at):
                break
            p = v.piece[node]
            hit = p >= 0
            to, p = at[hit], p[hit]
            single[to[end_of[to] == j + 1]] = True
            total = best[i][to] + v.score[p]
            better = total > best[j + 1][to]
            to = to[better]
            best[j + 1][to], start[j + 1][to], piece[j + 1][to] = total[better], i, p[better]
        lone = live[~single[live]]
        to, total = end_of[lone], best[i][lone] + v.unknown
        better = total > best[to, lone]
        to, lone = to[better], lone[better]
        best[to, lone], start[to, lone], piece[to, lone] = total[better], i, -1
    # walk back; an unknown character gives its bytes one by one
    out, at, who = [], np.full(rows, n), np.arange(rows)
    floor = np.full(rows, -1)
    counts = np.zeros(rows, np.int64)
    while len(who):
        pos = at[who]
        fresh = floor[who] < 0
        s, p = start[pos, who], piece[pos, who]
        enter = fresh & (p < 0)
        floor[who[enter]] = s[enter]
        in_bytes = floor[who] >= 0
        token = np.where(in_bytes, v.byte_ids[text[who, pos - 1]], p)
        at[who] = np.where(in_bytes, pos - 1, s)
        floor[who[in_bytes & (pos - 1 <= floor[who])]] = -1
        column = np.full(rows, -1, np.int32)
        column[who] = token
        out.append(column)
        counts[who] += 1
        who = who[at[who] > 0]
    ids = np.stack(out[::-1], axis=1).reshape(-1) if out else np.zeros(0, np.int32)
    return ids[ids >= 0], counts, best[n]


#: chunks longer than this, which no group shares, are solved one by one
GROUP_BYTES = 48
GROUP_ROWS = 1 << 14


def solve(v: Vocabulary, c: Chunks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best paths of all distinct chunks: flat ids, offsets, scores."""
    lengths = np.diff(c.offs)
    counts, scores = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for n in np.unique(lengths):
        who = np.flatnonzero(lengths == n)
        if n > GROUP_BYTES:
            for k in who:
                ids, scores[k] = best_path(v, c.buf[c.offs[k]:c.offs[k + 1]].tobytes())
                counts[k] = len(ids)
                found.append((np.array([k]), np.array(ids, np.int32)))
            continue
        for lo in range(0, len(who), GROUP_ROWS):
            part = who[lo:lo + GROUP_ROWS]
            ids, counts[part], scores[part] = best_paths(
                v, c.buf[c.offs[part][:, None] + np.arange(n)])
            found.append((part, ids))
    offs = np.concatenate([[0], np.cumsum(counts)])
    flat = np.empty(offs[-1], np.int32)
    for part, ids in found:
        flat[spans(offs[part], counts[part])] = ids
    return flat, offs, scores


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all positions starts[i] .. starts[i] + lengths[i] - 1, in order."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(int(lengths.sum()))
