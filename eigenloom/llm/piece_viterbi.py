"""Encoding and decoding with a given piece vocabulary: the best segmentation, many words at once (operator 5)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .texts import BASE, mix, utf8

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
REMEMBERED = 400_000
BATCH_BYTES = 1 << 20
CELLS = 1 << 21


class Pieces:
    """A vocabulary as sorted hashes with scores, and the best segmentation of words by it.

    A segmentation's worth is the sum of its pieces' scores. Of equal ones the one with the longer
    last piece wins, at every prefix. A character that is no piece costs the lowest score and a
    penalty, and is written as its bytes if the vocabulary has them, else as the unknown piece.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.unknown = model.unk_id()
        self.bytes_of: list[bytes] = []
        self.byte_ids = np.full(256, self.unknown, np.int32)
        keys, scores = {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                keys[i], scores[i] = piece, model.get_score(i)
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        self.longest = max(map(len, keys.values()))
        self.joins_words = any(re.search(f"[^{SPACE}]{SPACE}", p) for p in keys.values())
        self.penalty = min(scores.values()) - UNKNOWN_PENALTY
        ids = np.array(list(keys), np.int32)
        hashes = np.array([self._hash(p) for p in keys.values()], np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], ids[order]
        self.scores = np.array([scores[i] for i in keys])[order]
        self.worth = np.append(self.scores, -np.inf)
        self.worth_alone = np.append(self.scores, self.penalty)
        top = (self.keys >> np.uint64(47)).astype(np.int64)
        self.first = np.searchsorted(top, np.arange((1 << 17) + 1)).astype(np.int32)
        self.most = int(np.diff(self.first).max())
        self.keys = np.append(self.keys, np.zeros(self.most, np.uint64))
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.flat_length = np.array([len(x) for x in self.bytes_of], np.int64)
        self.flat_start = np.cumsum(self.flat_length) - self.flat_length
        self.clear()

    @staticmethod
    def _hash(piece: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in piece:
            h = h * np.uint64(BASE) + np.uint64(ord(c) + 1)
        return int(mix(h)[0])

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Rank of each hash among the sorted keys, or -1."""
        at = self.first[(hashes >> np.uint64(47)).astype(np.int64)]
        found = np.full(hashes.shape, -1, np.int32)
        for k in range(self.most):
            np.copyto(found, at + np.int32(k), where=self.keys[at + k] == hashes)
        return found

    def segment(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word."""
        ids, count = self.segments(words)
        ends = np.cumsum(count)
        return [ids[a:z] for a, z in zip(ends - count, ends)]

    def segments(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. Words of equal length advance together."""
        length = np.array([len(w) for w in words], np.int64)
        count, found = np.zeros(len(words), np.int64), []
        order = np.argsort(length, kind="stable")
        for n in np.unique(length[length > 0]):
            group = order[np.searchsorted(length[order], n) : np.searchsorted(length[order], n, "right")]
            step = max(1, CELLS // (int(n) * min(int(n), self.longest)))
            for lo in range(0, len(group), step):
                part = group[lo : lo + step]
                ids, count[part] = self._together([words[k] for k in part], int(n))
                found.append((part, ids))
        start, out = np.cumsum(count) - count, np.zeros(count.sum(), np.int32)
        for part, ids in found:
            out[_spread(start[part], count[part])] = ids
        return out, count

    def _together(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of n characters, one position a step; arrays have a row for each position."""
        m, most = len(words), min(n, self.longest)
        raw = "".join(words).encode("utf-32-le", "surrogatepass")
        chars = np.ascontiguousarray(np.frombuffer(raw, np.uint32).reshape(m, n).T).astype(np.uint64)
        found, worth, h = [], [], np.zeros((n, m), np.uint64)
        for size in range(1, most + 1):
            h = h[: n - size + 1] * np.uint64(BASE) + chars[size - 1 :] + np.uint64(1)
            found.append(self.probe(mix(h)))
            # Rank -1 is the last score, that of no piece.
            worth.append((self.worth_alone if size == 1 else self.worth)[found[-1]])
        best = np.full((n + 1, m), -np.inf)
        best[0] = 0
        back = np.zeros((n + 1, m), np.int32)
        rank = np.full((n + 1, m), -1, np.int32)
        for end in range(1, n + 1):
            for size in range(min(most, end), 0, -1):
                here = best[end - size] + worth[size - 1][end - size]
                better = here > best[end]
                np.copyto(best[end], here, where=better)
                np.copyto(back[end], size, where=better)
                np.copyto(rank[end], found[size - 1][end - size], where=better)
        at, alive, steps = np.full(m, n), np.arange(m), []
        while len(alive):
            here = at[alive]
            steps.append((alive, here, rank[here, alive]))
            at[alive] = here - back[here, alive]
            alive = alive[at[alive] > 0]
        # Steps go from the last piece to the first one.
        who, where, key = (np.concatenate(x[::-1]) for x in zip(*steps))
        order = np.argsort(who, kind="stable")
        who, where, key = who[order], where[order], key[order]
        ids = np.where(key >= 0, self.ids[key], -1).astype(np.int32)
        if (ids < 0).any():
            who, ids = self._spell(who, ids, chars[where - 1, who])
        return ids, np.bincount(who, minlength=m)

    def _spell(self, who: np.ndarray, ids: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes, or the unknown piece, in place of the ids -1 of single characters."""
        missing = np.flatnonzero(ids < 0)
        some, which = np.unique(chars[missing], return_inverse=True)
        spelled = [self.byte_ids[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in some]
        spelled = [np.array([self.unknown], np.int32) if (x == self.unknown).any() else x for x in spelled]
        length = np.array([len(x) for x in spelled])
        times = np.ones(len(ids), np.int64)
        times[missing] = length[which]
        out = np.repeat(ids, times)
        begin = np.cumsum(times) - times
        first = np.cumsum(length) - length
        out[_spread(begin[missing], length[which])] = np.concatenate(spelled)[_spread(first[which], length[which])]
        return np.repeat(who, times), out

    def clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.word_ids = np.zeros(0, np.int32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def words(self, text: str) -> list[str]:
        """The text with a space before it, cut where a space follows another character."""
        if not text:
            return []
        spaced = SPACE + text.replace(" ", SPACE)
        return [spaced] if self.joins_words else re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", spaced)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each text begins. Words are remembered between calls."""
        if len(self.codes) > REMEMBERED:
            self.clear()
        split = [self.words(t) for t in texts]
        new = list(set().union(*split).difference(self.codes))
        if new:
            found, length = self.segments(new)
            self.codes.update(zip(new, range(len(self.start), len(self.start) + len(new))))
            self.start = np.append(self.start, len(self.word_ids) + np.cumsum(length) - length)
            self.length = np.append(self.length, length)
            self.word_ids = np.concatenate([self.word_ids, found])
        begin = np.cumsum([0, *map(len, split)])
        codes = np.fromiter(map(self.codes.__getitem__, chain.from_iterable(split)), np.int64, begin[-1])
        length = self.length[codes]
        ends = np.concatenate(([0], np.cumsum(length)))
        return self.word_ids[_spread(self.start[codes], length)], ends[begin]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of runs of ids; the space put first by ``encode`` goes. Ids out of range are unknown."""
        ids = np.where((ids < 0) | (ids >= len(self.flat_length)), self.unknown, ids)
        length = self.flat_length[ids]
        ends = np.concatenate(([0], np.cumsum(length)))
        data = self.flat[np.repeat(self.flat_start[ids] - ends[:-1], length) + np.arange(ends[-1])].tobytes()
        cuts = ends[offsets]
        parts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        return [p.removeprefix(b" ").decode("utf-8", "replace") for p in parts]


def _spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Places start, start + 1 and so on, as many as the length, of each run."""
    ends = np.cumsum(length)
    return np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _schemas(df: DataFrame, keep: tuple[str, ...], name: str, kind: str, arrow_kind: pa.DataType):
    fields = [df.schema[c] for c in keep]
    sql = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"{name} {kind}"])
    return sql, pa.schema([*((f.name, to_arrow_type(f.dataType)) for f in fields), (name, arrow_kind)])


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, with ``ids array<int>``: the best segmentation of its whole text.

    Null and empty texts give no ids. Repeated rows repeat, null ids stay, other columns are ignored.
    Memory follows the longest text; texts pass in stretches of a megabyte. Characters outside the
    vocabulary become bytes, so every text has ids; U+2581 stands for a space, and is one when decoded. A
    kept column ``ids`` gives way to the result.
    """
    keep = [c for c in keep if c != "ids"]
    rows = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    sql, schema = _schemas(rows, keep, "ids", "array<int>", pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = utf8(b.column(len(keep)))
            for lo, hi in _stretches(offsets):
                ids, begin = pieces(model).encode(b.column(len(keep)).slice(lo, hi - lo).to_pylist())
                found = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(ids, pa.int32()))
                columns = [b.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, found], schema=schema)

    return rows.mapInArrow(run, sql)


def decode_pieces(rows: DataFrame, model: str, ids_col: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of every row, with ``text`` spelled by its ids. Null ids give the empty text.

    A kept column ``text`` gives way to the result.
    """
    keep = [c for c in keep if c != "text"]
    rows = rows.select(*keep, F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("_ids"))
    sql, schema = _schemas(rows, keep, "text", "string", pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(len(keep))
            offsets = column.offsets.to_numpy()
            for lo, hi in _stretches(4 * (offsets - offsets[0])):
                ids = column.values.slice(offsets[lo], offsets[hi] - offsets[lo]).fill_null(-1).to_numpy()
                texts = pieces(model).decode(ids, offsets[lo : hi + 1] - offsets[lo])
                columns = [b.column(k).slice(lo, hi - lo) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema=schema)

    return rows.mapInArrow(run, sql)


def _stretches(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = min(n, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + BATCH_BYTES, "right")) - 1))
        yield lo, hi
        lo = hi
