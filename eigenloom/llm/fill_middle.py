"""Fill-in-the-middle rearrangement, cut by rank through indexable skip lists (operator 11)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .texts import mix, slices, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
PLAIN_FROM, SPM_BELOW = 90, 20
# One node in LANE of a lane is also on the next one up, picked by a hash of its place.
LANE = 8

IS_LETTER = np.zeros(256, bool)
IS_LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every unit, text after text, and where each text's units begin.

    A unit is a maximal run of ASCII letters or any other single code point.
    """
    size = len(data)
    point = (data & 0xC0) != 0x80
    letter = IS_LETTER[data]
    goes_on = np.zeros(size, bool)
    goes_on[1:] = letter[1:] & letter[:-1]
    goes_on[offsets[:-1][offsets[:-1] < size]] = False
    start = np.flatnonzero(point & ~goes_on)
    points = np.concatenate(([0], np.cumsum(point)))
    width = np.diff(points[np.append(start, size)])
    return width, np.searchsorted(start, offsets)


class SkipLists:
    """One indexable skip list for each text, all side by side in the same arrays.

    The lowest lane has a node for every unit. Each lane above keeps a text's first node and about one
    in LANE of the others, and a node carries the units and the code points up to its lane's next one.
    """

    def __init__(self, width: np.ndarray, first: np.ndarray):
        self.n = np.diff(first)
        self.lanes = [(np.ones(len(width), np.int64), width, None, first)]
        while len(self.n) and np.diff(first).max() > LANE:
            heads = first[:-1][np.diff(first) > 0]
            place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
            up = mix(place.astype(np.uint64) * np.uint64(2 * len(self.lanes) + 1)) % np.uint64(LANE) == 0
            up[heads] = True
            down = np.flatnonzero(up)
            first = np.searchsorted(down, first)
            below = self.lanes[-1]
            self.lanes.append((np.add.reduceat(below[0], down), np.add.reduceat(below[1], down), down, first))

    def points_before(self, rank: np.ndarray) -> np.ndarray:
        """Code points ahead of the unit with this rank, for one rank of each text.

        From the top lane down, a text moves on while the units passed do not exceed its rank.
        """
        passed, points = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        at = self.lanes[-1][3][:-1].copy()
        for level in range(len(self.lanes) - 1, -1, -1):
            n_units, n_points, down, first = self.lanes[level]
            moving = np.flatnonzero(at < first[1:])
            while len(moving):
                node = at[moving]
                ahead = passed[moving] + n_units[node]
                go = ahead <= rank[moving]
                moving, node = moving[go], node[go]
                passed[moving] = ahead[go]
                points[moving] += n_points[node]
                at[moving] += 1
                moving = moving[at[moving] < first[1:][moving]]
            if level:
                lower = self.lanes[level - 1][3][1:]
                inside = at < first[1:]
                at = np.where(inside, down[np.where(inside, at, 0)], lower) if len(down) else lower.copy()
        return points


def _rearrange(id_kind: pa.DataType):
    kinds = [id_kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = utf8(b.column(2))
            for lo, hi in slices(offsets):
                lists = SkipLists(*units(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]))
                digest = b.column(1).slice(lo, hi - lo).to_pylist()
                h = np.array([[int(d[k : k + 8], 16) for k in (0, 8, 16, 24)] for d in digest], np.int64)
                cuts = np.sort(h[:, :2] % (lists.n + 1)[:, None], axis=1)
                one, two = lists.points_before(cuts[:, 0]).tolist(), lists.points_before(cuts[:, 1]).tolist()
                rows = []
                for k, text in enumerate(b.column(2).slice(lo, hi - lo).to_pylist()):
                    text = text or ""
                    marked = PREFIX in text or SUFFIX in text or MIDDLE in text
                    if not text or marked or h[k, 2] % 100 >= PLAIN_FROM:
                        rows.append(("plain", None, None, text))
                        continue
                    prefix, middle, suffix = text[: one[k]], text[one[k] : two[k]], text[two[k] :]
                    if h[k, 3] % 100 < SPM_BELOW:
                        form, out = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
                    else:
                        form, out = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
                    rows.append((form, one[k], two[k] - one[k], out))
                columns = [b.column(0).slice(lo, hi - lo), pa.array(lists.n)]
                columns += [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds[2:])]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """Rearrange every text for fill-in-the-middle training: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is cut at two of its n + 1 unit borders, drawn from sha256 of "<seed>:<id>". Nine texts in ten
    are rearranged, a fifth of them with the suffix first (``spm``), the others with the prefix first
    (``psm``). A text that is empty or holds one of the marks stays as it is (``plain``), with null lengths.
    No row is exchanged and each has its draws from its id alone, so a lost task gives the same again.

    Null text counts as empty, a null id as the empty text. Repeated rows, and rows that share an id, each
    come out; equal rows are cut alike. An empty table gives no rows; other columns are ignored. Memory
    follows the longest text.
    """
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.sha2(key.cast("binary"), 256).alias("h"), F.col(text_col).cast("string").alias("text")
    )
    id_type = rows.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_rearrange(to_arrow_type(id_type)), schema)


def restored(form: Column, output: Column) -> Column:
    """The text that a rearranged one was made from. Its three marks occur once each, as plain texts keep theirs."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    prefix = F.when(form == "psm", F.get(part, F.lit(1))).otherwise(F.get(part, F.lit(2)))
    suffix = F.when(form == "psm", F.get(part, F.lit(2))).otherwise(F.get(part, F.lit(1)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, F.get(part, F.lit(3)), suffix))
