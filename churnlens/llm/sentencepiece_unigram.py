"""Operator 4, SentencePiece encoding and decoding.

Unigram segmentation: the pieces of a vocabulary file and their log scores sit in a double-array
trie (base and check arrays over UTF-8 bytes), and Viterbi finds the segmentation of the highest
score. Characters that no piece covers become byte pieces. Spaces are the marker U+2581, one of
which is put before every text, and decoding reverses both.

No piece of the vocabulary holds a marker after another sign, so a text falls into parts (markers
and the word after them; each newline) that can be segmented alone. Each batch segments its
distinct parts at once: the trie walk and the Viterbi step run in numpy over all parts of a chunk.
Row-wise on Spark: one scan, no shuffle; the tries' arrays are broadcast, bounded by the vocabulary.

Defined edge cases: null and empty texts have no pieces and decode to the empty text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from churnlens.llm import textkit as tk

MARK = "▁"
#: parts up to so many bytes go through the numpy pass, longer ones one by one
MATRIX_BYTES, MATRIX_ROWS = 48, 8192
CACHE_PARTS = 200_000
#: how far the score of an uncovered character lies below the lowest piece
UNKNOWN_PENALTY = 10.0


def build_trie(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of the keys; value is the key's index or -1. Slot 0 is the root."""
    order = sorted(range(len(keys)), key=keys.__getitem__)
    size = 1 << max(17, (sum(map(len, keys)) * 4).bit_length())
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = 0
    hints: dict[int, int] = {}  # where the search for a node with so many children last ended
    todo = [(0, 0, len(order), 0)]
    while todo:
        state, lo, hi, depth = todo.pop()
        if lo < hi and len(keys[order[lo]]) == depth:
            value[state] = order[lo]
            lo += 1
        groups: list[tuple[int, int, int]] = []
        while lo < hi:
            sign, start = keys[order[lo]][depth], lo
            while lo < hi and keys[order[lo]][depth] == sign:
                lo += 1
            groups.append((sign, start, lo))
        if not groups:
            continue
        signs = [sign for sign, _, _ in groups]
        at = hints.get(len(signs), 1)
        while any(check[at + sign] != -1 for sign in signs):
            at += 1
        hints[len(signs)] = at
        base[state] = at
        for sign, start, stop in groups:
            check[at + sign] = state
            todo.append((at + sign, start, stop, depth + 1))
    last = max(k for k in range(size) if check[k] != -1) + 257
    return tuple(np.array(x[:last] + [y] * max(0, last - size), dtype=np.int32) for x, y in ((base, 0), (check, -1), (value, -1)))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by id, the trie over the ordinary ones, and ids of the byte pieces."""

    pieces: list[str]
    scores: np.ndarray
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  # piece id or -1
    bytes_: np.ndarray
    unknown: int
    longest: int

    @staticmethod
    def load(path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        return Vocabulary.of([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids],
                             {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}, {i for i in ids if sp.is_byte(i)}, sp.unk_id())

    @staticmethod
    def of(pieces: list[str], scores: list[float], special: set[int], byte_ids: set[int], unknown: int) -> Vocabulary:
        plain = [i for i in range(len(pieces)) if i not in special and i not in byte_ids]
        if any(MARK in p.lstrip(MARK) for p in (pieces[i] for i in plain)):
            raise ValueError("a piece holds the marker after another sign; parts can't be segmented alone")
        if any("\n" in pieces[i] for i in plain):
            raise ValueError("a piece holds a newline; parts can't be segmented alone")
        keys = [pieces[i].encode() for i in plain]
        base, check, value = build_trie(keys)
        of_byte = np.full(256, unknown, dtype=np.int32)
        for i in byte_ids:
            of_byte[int(pieces[i][3:5], 16)] = i
        ids = np.array([*plain, -1], dtype=np.int32)
        return Vocabulary(pieces, np.array(scores, dtype=np.float64), base, check, ids[value], of_byte, unknown, max(map(len, keys), default=1))


def _char_sizes(lead: np.ndarray) -> np.ndarray:
    return 1 + (lead >= 0xC0) + (lead >= 0xE0) + (lead >= 0xF0)


class Encoder:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        used = vocabulary.value[vocabulary.value >= 0]
        self.low = float(vocabulary.scores[used].min() if len(used) else 0.0) - UNKNOWN_PENALTY
        self.known: dict[bytes, bytes] = {b"": b""}

    def _ids(self, part: bytes, path: list[tuple[int, int, int]]) -> bytes:
        """Ids of a path of (start, stop, piece or -1) as 4-byte integers."""
        out: list[int] = []
        for a, b, piece in path:
            out += [piece] if piece >= 0 else self.v.bytes_[list(part[a:b])].tolist()
        return np.array(out, "<i4").tobytes()

    def one(self, part: bytes) -> bytes:
        """Viterbi of a single part."""
        v, n = self.v, len(part)
        base, check, value, scores = v.base, v.check, v.value, v.scores
        best, start, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0], i = 0.0, 0
        while i < n:
            size = 1 + (part[i] >= 0xC0) + (part[i] >= 0xE0) + (part[i] >= 0xF0)
            state, alone = 0, False
            for k in range(i, min(n, i + v.longest)):
                step = int(base[state]) + part[k]
                if check[step] != state or step == 0:
                    break
                state = step
                p = int(value[state])
                if p >= 0:
                    alone |= k + 1 - i == size
                    if best[i] + scores[p] > best[k + 1]:
                        best[k + 1], start[k + 1], piece[k + 1] = best[i] + scores[p], i, p
            stop = min(n, i + size)
            if not alone and best[i] + self.low > best[stop]:
                best[stop], start[stop], piece[stop] = best[i] + self.low, i, -1
            i = stop
        path, k = [], n
        while k:
            path.append((start[k], k, piece[k]))
            k = start[k]
        return self._ids(part, path[::-1])

    def many(self, parts: list[bytes]) -> list[bytes]:
        """Viterbi of parts of similar length, one array step for all of them."""
        v, m = self.v, len(parts)
        size = np.array([len(p) for p in parts])
        width = int(size.max())
        text = np.zeros((m, width), dtype=np.uint8)
        text[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(parts), np.uint8)
        best = np.full((m, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((m, width + 1), np.int32), np.full((m, width + 1), -1, np.int32)
        for i in range(width):
            rows = np.flatnonzero((size > i) & (best[:, i] > -np.inf))
            if not len(rows):
                continue
            chars = _char_sizes(text[rows, i])
            alone = np.zeros(len(rows), dtype=bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int32)
            for k in range(i, min(width, i + v.longest)):
                r = rows[live]
                step = v.base[state] + text[r, k]
                ok = (v.check[step] == state) & (size[r] > k) & (step > 0)
                live, state = live[ok], step[ok]
                if not len(live):
                    break
                p = v.value[state]
                hit = p >= 0
                at, p = live[hit], p[hit]
                alone[at[chars[at] == k + 1 - i]] = True
                r = rows[at]
                score = best[r, i] + v.scores[p]
                better = score > best[r, k + 1]
                r = r[better]
                best[r, k + 1], start[r, k + 1], piece[r, k + 1] = score[better], i, p[better]
            lone = ~alone
            r, stop = rows[lone], np.minimum(i + chars[lone], size[rows[lone]])
            better = best[r, i] + self.low > best[r, stop]
            r, stop = r[better], stop[better]
            best[r, stop], start[r, stop], piece[r, stop] = best[r, i] + self.low, i, -1
        # walk back from all ends at once; the last step comes first
        rows, at, steps = np.arange(m), size.copy(), []
        covered = np.ones(m, dtype=bool)
        while len(rows):
            p = piece[rows, at]
            covered[rows[p < 0]] = False
            steps.append((rows, p))
            at = start[rows, at]
            rows, at = rows[at > 0], at[at > 0]
        row, ids = (np.concatenate(x) for x in zip(*steps[::-1], strict=True))
        raw = ids[np.argsort(row, kind="stable")].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(row, minlength=m))).tolist()
        return [raw[a:b] if ok else self.one(part) for part, a, b, ok in zip(parts, [0, *ends], ends, covered.tolist(), strict=False)]

    def learn(self, parts: set[bytes]) -> None:
        new = sorted(parts.difference(self.known), key=len)
        short = [p for p in new if len(p) <= MATRIX_BYTES]
        for k in range(0, len(short), MATRIX_ROWS):
            chunk = short[k:k + MATRIX_ROWS]
            self.known.update(zip(chunk, self.many(chunk), strict=True))
        for p in new[len(short):]:
            self.known[p] = self.one(p)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as 4-byte little-endian integers."""
        split = [self.parts(t) for t in texts]
        if len(self.known) > CACHE_PARTS:
            self.known = {b"": b""}
        out = []
        for parts in split:
            try:
                out.append(b"".join([self.known[p] for p in parts]))
            except KeyError:
                self.learn(set().union(*split))
                out.append(b"".join([self.known[p] for p in parts]))
        return out

    def parts(self, text: str | None) -> list[bytes]:
        """The text with markers, cut before each run of markers and around newlines (no ordinary
        piece holds one). 0xFF, which UTF-8 never has, marks the cuts."""
        if not text:
            return []
        raw = b" " + text.encode()
        if b"  " in raw:
            return [x.replace(b" ", _MARK) for x in _SPACED.findall(raw)]
        return raw.replace(b" ", b"\xff" + _MARK).replace(b"\n", b"\xff\n\xff").split(b"\xff")


_SPACED = re.compile(rb" *[^ \n]+|\n| +")
_MARK = MARK.encode()


def decode(v: Vocabulary, ids: list[int]) -> str:
    """Text of ids: byte pieces become bytes (those that are no UTF-8 turn into U+FFFD), markers
    become spaces, and the first marker is dropped."""
    table = _piece_bytes(v)
    text = b"".join([table[i] for i in ids]).decode("utf-8", "replace").replace(MARK, " ")
    return text[1:] if text.startswith(" ") else text


def _piece_bytes(v: Vocabulary) -> list[bytes]:
    if id(v) not in _tables:
        table = [p.encode() for p in v.pieces]
        for b, i in enumerate(v.bytes_.tolist()):
            if i != v.unknown:
                table[i] = bytes([b])
        _tables.clear()
        _tables[id(v)] = table
    return _tables[id(v)]


_tables: dict[int, list[bytes]] = {}
_encoders: dict[int, Encoder] = {}


def _encode_map(ref):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ref.value
        if id(v) not in _encoders:
            _encoders.clear()
            _encoders[id(v)] = Encoder(v)
        encoder = _encoders[id(v)]
        for batch in batches:
            for part, _, _ in tk.slices(batch, "text"):
                texts = part.column(1).to_pylist()
                raw = encoder.batch(texts)
                ids = np.frombuffer(b"".join(raw), "<i4")
                offsets = np.concatenate(([0], np.cumsum([len(x) // 4 for x in raw]))).astype(np.int32)
                back = [decode(v, x) for x in np.split(ids, offsets[1:-1])] if len(part) else []
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))
                fallback = np.concatenate(([0], np.cumsum(np.isin(ids, v.bytes_))))
                yield tk.record_batch(doc_id=part.column(0), ids=lists, n_tokens=np.diff(offsets).astype(np.int64),
                                      n_byte_pieces=fallback[offsets[1:]] - fallback[offsets[:-1]],
                                      round_trip=[(t or "") == b for t, b in zip(texts, back, strict=True)])
    return run


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_tokens, n_byte_pieces, round_trip) of each document; ``vocabulary`` is a model file's path."""
    ref = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))
    return tk.map_batches(tk.texts(docs, id_col, text_col), _encode_map(ref),
                          "doc_id long, ids array<int>, n_tokens long, n_byte_pieces long, round_trip boolean")


def decode_documents(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows with ids."""
    ref = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield tk.record_batch(doc_id=batch.column(0), text=pa.array([decode(ref.value, x or []) for x in batch.column(1).to_pylist()], pa.string()))

    return tk.map_batches(encoded.select("doc_id", "ids"), run, "doc_id long, text string")
