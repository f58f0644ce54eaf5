"""Spelling variants: words one edit apart, found through frequency-vector tries (operator 13)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..session import as_table, scratch_path
from .texts import slices, utf8

MIN_POINTS, MIN_COUNT = 7, 2
TYPO_EVERY = 31
FORM_RATIO = 10
# A shard that more words visit is divided, and there are never more than MOST_SHARDS such.
SHARD_WORDS, MOST_SHARDS = 1 << 17, 4096
BIN_WORDS = 1 << 15
LEAF_WORDS = 6
LONG_RUN = 64

# The levels of the trie. Each plain letter is a group, then the accented ones eight by eight.
LETTERS = "etaoinsrhldcumfpgwybvkxjqz"
LEVELS = len(LETTERS) + 8
GROUP = np.full(256, 255, np.uint8)
GROUP[np.frombuffer(LETTERS.encode(), np.uint8)] = np.arange(len(LETTERS))
GROUP[0xC0:] = len(LETTERS) + np.arange(64) // 8
# An order of letters by group, then by code.
RANK = np.empty(256, np.int64)
RANK[np.lexsort((np.arange(256), GROUP))] = np.arange(256)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
IS_LOWER = np.zeros(256, bool)
IS_LOWER[ord("a") : ord("z") + 1] = True


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


CRC = crc_table()


def crc32_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each run of bytes, going on from the crc32 of what comes before it."""
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    n_long = int(np.searchsorted(-size[order], -LONG_RUN, "left"))
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    for j in range(min(LONG_RUN, int(size.max(initial=0)))):
        live = order[n_long : int(np.searchsorted(-size[order], -j, "left"))]
        step = state[live]
        state[live] = CRC[(step ^ data[starts[live] + j]) & np.uint32(0xFF)] ^ (step >> np.uint32(8))
    found = state ^ np.uint32(0xFFFFFFFF)
    for k in order[:n_long]:
        found[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return found


def variants(data: np.ndarray, offsets: np.ndarray, before: np.ndarray) -> pa.Array:
    """The words of texts: runs of letters, lower-cased, of which some lose a code point by their hash.

    ``before`` holds the crc32 of each text's key. Words of fewer than MIN_POINTS code points are left out.
    """
    data = LOWER[data]
    size = len(data)
    lead = data == 0xC3
    inside = IS_LOWER[data] | lead
    inside[1:] |= lead[:-1]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    previous = np.concatenate(([False], inside[:-1]))
    starts = np.flatnonzero(inside & (~previous | edge[:-1]))
    following = np.concatenate((inside[1:], [False]))
    ends = np.flatnonzero(inside & (~following | edge[1:])) + 1
    point = (data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(point)))
    n = points[ends] - points[starts]
    enough = n >= MIN_POINTS
    starts, ends, n = starts[enough], ends[enough], n[enough]
    row = np.searchsorted(offsets, starts, "right") - 1
    h = crc32_runs(data, starts, ends, before[row])
    typo = np.flatnonzero(h % TYPO_EVERY == 0)
    at = np.flatnonzero(point)[points[starts[typo]] + h[typo].astype(np.int64) % n[typo]]
    keep = np.zeros(size, bool)
    depth = np.zeros(size + 1, np.int8)
    depth[starts] += 1
    depth[ends] -= 1
    keep[:] = np.cumsum(depth[:-1], dtype=np.int8) > 0
    keep[at] = False
    two = lead[at]
    keep[at[two] + 1] = False
    length = ends - starts
    length[typo] -= 1 + two
    n[typo] -= 1
    short = np.flatnonzero(n < MIN_POINTS)
    for k in short:
        keep[starts[k] : ends[k]] = False
    length = np.delete(length, short)
    cuts = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
    flat = data[keep].tobytes()
    return pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(cuts.tobytes()), pa.py_buffer(flat)])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        before = np.array([zlib.crc32(f"{i}:".encode()) for i in b.column(0).to_pylist()], np.uint32)
        for lo, hi in slices(offsets, 8 << 20):
            words = variants(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], before[lo:hi])
            found = pc.value_counts(words)
            columns = [found.field(0).cast(pa.string()), found.field(1).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """One byte for each code point of words, end to end, and where each word begins."""
    data, offsets = utf8(column)
    lead = data == 0xC3
    shift = np.concatenate(([0], np.cumsum(lead)))
    after = np.concatenate(([False], lead[:-1]))
    flat = np.where(after, data + 0x40, data).astype(np.uint8)[~lead]
    return flat, offsets - shift[offsets]


def vectors(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How often each letter group occurs in each word."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first))
    return np.bincount(row * LEVELS + GROUP[flat], minlength=n * LEVELS).reshape(n, LEVELS).astype(np.int32)


class TopTrie:
    """The part of the trie that is too large for one task: nodes by the counts of two more levels each.

    A shard is a node below it. ``chunks`` holds the number of parts of nodes too large at the last level.
    """

    def __init__(self):
        self.keys, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.chunks: dict[int, int] = {}
        self.divided = False

    def divide(self, keys: list[int]) -> None:
        self.divided = True
        self.ids = np.append(self.ids, np.arange(len(self.ids) + 1, len(self.ids) + len(keys) + 1))
        self.keys = np.append(self.keys, np.array(keys, np.int64))
        order = np.argsort(self.keys)
        self.keys, self.ids = self.keys[order], self.ids[order]

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key's node, from 1; 0 for a shard."""
        if not len(self.keys) or not len(keys):
            return np.zeros(len(keys), np.int64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ids[at], 0)

    @staticmethod
    def key(node: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (node << 32) | ((x.astype(np.int64) & 0xFFFF) << 16) | (y.astype(np.int64) & 0xFFFF)

    def home(self, v: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The shard in which each word is a member."""
        shard = np.full(len(v), -1, np.int64)
        if not self.divided:
            return shard
        open_, node = np.arange(len(v)), np.zeros(len(v), np.int64)
        for level in range(0, LEVELS, 2):
            key = self.key(node, v[open_, level], v[open_, level + 1])
            found = self.lookup(key)
            shard[open_[found == 0]] = key[found == 0]
            open_, node = open_[found > 0], found[found > 0]
        parts = np.array([self.chunks.get(int(k), 1) for k in node], np.uint64)
        shard[open_] = -((node << 20) + (code[open_] % parts).astype(np.int64) + 2) if len(open_) else 0
        return shard

    def visits(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, shard): every shard that may hold a word near this one that comes after it.

        Such a word has one letter more, or one more of a group and one less of a later one, or the same
        vector. So a walk from the root may spend one surplus, and after it one deficit.
        """
        n = len(v)
        if not self.divided:
            return np.arange(n), np.full(n, -1, np.int64)
        word, node, state = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int8)
        words, shards = [], []
        for level in range(0, LEVELS, 2):
            x, y = v[word, level], v[word, level + 1]
            found = []
            for old, new, dx, dy in (
                (0, 0, 0, 0), (0, 1, 1, 0), (0, 1, 0, 1), (0, 2, 1, -1),
                (1, 1, 0, 0), (1, 2, -1, 0), (1, 2, 0, -1), (2, 2, 0, 0),
            ):
                ok = np.flatnonzero((state == old) & (x + dx >= 0) & (y + dy >= 0))
                key = self.key(node[ok], x[ok] + dx, y[ok] + dy)
                found.append((word[ok], key, np.full(len(ok), new, np.int8)))
            word, key, state = (np.concatenate(c) for c in zip(*found))
            node = self.lookup(key)
            words.append(word[node == 0])
            shards.append(key[node == 0])
            word, node, state = word[node > 0], node[node > 0], state[node > 0]
        for k in np.unique(node):
            who = word[node == k]
            for part in range(self.chunks.get(int(k), 1)):
                words.append(who)
                shards.append(np.full(len(who), -((int(k) << 20) + part + 2), np.int64))
        return np.concatenate(words), np.concatenate(shards)


def codes(column: pa.Array) -> np.ndarray:
    return np.array([zlib.crc32(w.encode()) for w in column.to_pylist()], np.uint64)


def _shard_sizes(top: TopTrie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, n = np.unique(top.visits(vectors(*letters(b.column(0))))[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(n)], names=["shard", "n"])

    return run


def _visit(top: TopTrie):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = vectors(*letters(b.column(0)))
            home = top.home(v, codes(b.column(0)) if top.chunks else np.zeros(len(v), np.uint64))
            word, shard = top.visits(v)
            at = pa.array(word)
            columns = [pa.array(shard), b.column(0).take(at), b.column(1).take(at), pa.array(home[word] == shard)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "word", "n", "home"])

    return run


class Trie:
    """A trie over the vectors of words, as sorted arrays: a level's nodes by (parent, count)."""

    def __init__(self, shard: np.ndarray, v: np.ndarray):
        self.order = np.lexsort((*v.T[::-1], shard))
        shard, v = shard[self.order], v[self.order]
        n = len(shard)
        self.roots, node = np.unique(shard, return_inverse=True)
        self.levels, self.bounds = [], [np.append(np.searchsorted(shard, self.roots), n)]
        for level in range(v.shape[1]):
            key = (node.astype(np.int64) << 32) | v[:, level]
            new = np.ones(n, bool)
            new[1:] = key[1:] != key[:-1]
            self.levels.append(key[new])
            self.bounds.append(np.append(np.flatnonzero(new), n))
            node = np.cumsum(new) - 1

    def walk(self, shard: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) candidates, level by level: leaves, and nodes of few words without going further."""
        at = np.searchsorted(self.roots, shard)
        hit = at < len(self.roots)
        hit[hit] = self.roots[at[hit]] == shard[hit]
        query, node = np.flatnonzero(hit), at[hit]
        state = np.zeros(len(query), np.int8)
        for level in range(v.shape[1] + 1):
            lo, hi = self.bounds[level][node], self.bounds[level][node + 1]
            few = (hi - lo <= LEAF_WORDS) | (level == v.shape[1])
            if few.any():
                yield self._members(query[few], lo[few], hi[few])
                query, node, state = query[~few], node[~few], state[~few]
            if level == v.shape[1] or not len(query):
                return
            count = v[query, level]
            more, less = np.flatnonzero(state == 0), np.flatnonzero((state == 1) & (count > 0))
            parent = np.concatenate((node, node[more], node[less])).astype(np.int64)
            wanted = np.concatenate((count, count[more] + 1, count[less] - 1))
            query = np.concatenate((query, query[more], query[less]))
            state = np.concatenate((state, np.ones(len(more), np.int8), np.full(len(less), 2, np.int8)))
            keys, key = self.levels[level], (parent << 32) | wanted
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            query, node, state = query[hit], at[hit], state[hit]

    def _members(self, query, lo, hi) -> tuple[np.ndarray, np.ndarray]:
        n = hi - lo
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        return np.repeat(query, n), self.order[place]


def one_edit(flat: np.ndarray, first: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether word b is word a with one letter put in, or one replaced by a letter of lower RANK."""
    size = np.diff(first)
    longer = size[b] - size[a]
    ok = (longer == 0) | (longer == 1)
    out = np.zeros(len(a), bool)
    pairs = np.flatnonzero(ok)
    for lo, hi in slices(np.append(0, np.cumsum(size[a[pairs]])), 4 << 20):
        some = pairs[lo:hi]
        n = size[a[some]]
        begin = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(begin, n)
        x = flat[np.repeat(first[a[some]], n) + k]
        left = x != flat[np.repeat(first[b[some]], n) + k]
        right = x != flat[np.repeat(first[b[some]] + longer[some], n) + k]
        head = np.minimum.reduceat(np.where(left, k, np.repeat(n, n)), begin)
        tail = np.maximum.reduceat(np.where(right, k + 1, 0), begin)
        added = (longer[some] == 1) & (tail <= head)
        at = np.minimum(head, n - 1)
        down = RANK[flat[first[b[some]] + at]] < RANK[flat[first[a[some]] + at]]
        out[some] = added | ((longer[some] == 0) & (head < n) & (tail == head + 1) & down)
    return out


def _pairs(table: pa.Table) -> pa.Table:
    """Near pairs of one bin of shards: members make the trie, all rows walk it."""
    shard = table["shard"].to_numpy()
    words = table["word"].combine_chunks()
    flat, first = letters(words)
    v = vectors(flat, first)
    member = np.flatnonzero(table["home"].combine_chunks().to_numpy(zero_copy_only=False))
    one, two = [], []
    if len(member):
        trie = Trie(shard[member], v[member])
        for lo in range(0, len(shard), 1 << 16):
            for query, found in trie.walk(shard[lo : lo + (1 << 16)], v[lo : lo + (1 << 16)]):
                for at in range(0, len(query), 1 << 20):
                    a, b = query[at : at + (1 << 20)] + lo, member[found[at : at + (1 << 20)]]
                    near = one_edit(flat, first, a, b)
                    one.append(a[near])
                    two.append(b[near])
    one = pa.array(np.concatenate(one) if one else np.zeros(0, np.int64))
    two = pa.array(np.concatenate(two) if two else np.zeros(0, np.int64))
    n = table["n"].combine_chunks()
    return pa.table({"word": words.take(one), "n": n.take(one), "other": words.take(two), "m": n.take(two)})


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of all texts with their counts, those of one occurrence left out."""
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).cast("string").alias("text")
    )
    counted = rows.mapInArrow(_count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, m): every pair of words one edit apart, once.

    The trie of all words is cut into shards of bounded size, in rounds of two levels; only the nodes above
    the shards reach the driver. A word is a member of one shard and visits those that its walk can reach.
    """
    spark = words.sparkSession
    total = words.count()
    top = TopTrie()
    if total > SHARD_WORDS:
        top.divide([])
        for level in range(0, LEVELS + 2, 2):
            sizes = words.mapInArrow(_shard_sizes(top), "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n"))
            sizes = as_table(sizes, scratch_path(spark, "sizes"))
            most = max(SHARD_WORDS, -(-(sizes.agg(F.sum("n")).first()[0] or 0) // MOST_SHARDS))
            large = sizes.where(F.col("n") > most).orderBy("shard").collect()
            if not large:
                break
            if level < LEVELS:
                top.divide([r["shard"] for r in large])
            else:
                top.chunks = {(-r["shard"] - 2) >> 20: -(-r["n"] // most) for r in large}
    bins = max(1, -(-total // BIN_WORDS))
    visits = words.mapInArrow(_visit(top), "shard long, word string, n long, home boolean")
    binned = visits.withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(bins)))
    return binned.groupBy("bin").applyInArrow(_pairs, "word string, n long, other string, m long")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words with the words one edit apart: word, n, n_near, form, form_n, root.

    Words are runs of letters A-Z, a-z and U+00C0 to U+00FF of whole texts, lower-cased in A-Z, of at least
    seven code points and two occurrences; one run in 31 loses a code point, by a hash of id and run. The
    form of a word is its most frequent near word, if ten times as frequent; the root is where forms lead.

    Frequency-vector trie: levels are counts of letter groups, a walk may spend one surplus and one deficit,
    and what it reaches is compared letter by letter, so no pair is missed and none is wrong.

    Null text has no words; a null id counts as the empty text. Repeated rows count as often as they come.
    Ties of frequency go to the word smallest in code points. Texts without words and empty tables give no
    rows; other columns are ignored. Memory follows the longest text and the largest shard, which is bounded.
    """
    spark = docs.sparkSession
    words = as_table(count_words(docs, id_col, text_col), scratch_path(spark, "words"))
    none = words.select("word", "n", F.lit(None).cast("string").alias("other"), F.lit(None).cast("long").alias("m"))
    near = as_table(near_words(words), scratch_path(spark, "pairs"))
    turned = near.selectExpr("other AS word", "m AS n", "word AS other", "n AS m")
    best = F.min(F.when(F.col("m").isNotNull(), F.struct((-F.col("m")).alias("m"), "other")))
    found = near.unionByName(turned).unionByName(none).groupBy("word").agg(
        F.max("n").alias("n"), F.count("other").alias("n_near"), best.alias("best")
    )
    is_form = -F.col("best.m") >= F.col("n") * FORM_RATIO
    found = found.select(
        "word",
        "n",
        "n_near",
        F.when(is_form, F.col("best.other")).alias("form"),
        F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    found = as_table(found, scratch_path(spark, "forms"))
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # Counts grow tenfold with each form, so a chain is short and doubling ends soon.
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        moved = roots.join(next_, "root", "left")
        moved = moved.select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        moved = as_table(moved, scratch_path(spark, "roots"))
        roots = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            break
    return found.join(roots, "word", "left").select(
        "word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")
    )
