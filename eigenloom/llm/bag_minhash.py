"""Near duplicates by weighted min-hashing of shingle bags, verified exactly (operator 2)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import as_table, scratch_path
from .block_naming import columns_of, row_keys, whole_row
from .texts import BASE, Words, mix, prefix_sums, slices, span_hashes, utf8, words

SHINGLE = 5
BANDS, BAND_ROWS = 24, 4
VALUES = BANDS * BAND_ROWS
SMALL_BAG = 64
CENTRE_ROUNDS = 3
# An item that classes have more of than a centre, or less.
PLACE = ["a", "item", "more"]
# Two bags are near if 5 * the sum of minima >= 4 * the sum of maxima.
NEAR = (4, 5)


def bags(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE):
    """(row, shingle hash, count) sorted by row and hash. Fewer words than a shingle make one shingle."""
    found = words(data, offsets)
    sums = prefix_sums(found.word_hashes())
    n_words = np.diff(found.first)
    start = np.arange(len(found.starts))
    left = found.first[found.row + 1] - start
    ok = (left >= shingle) | ((start == found.first[found.row]) & (n_words[found.row] < shingle))
    start, left = start[ok], left[ok]
    hashes = span_hashes(sums, start, start + np.minimum(left, shingle))
    row = found.row[ok]
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(new)
    return row[begin], hashes[begin], np.diff(np.append(begin, len(row)))


def signatures(row: np.ndarray, item: np.ndarray, count: np.ndarray, n_rows: int) -> np.ndarray:
    """VALUES minima for each bag; two agree in one with the probability of the bags' weighted Jaccard likeness.

    The counts of an item are cut into cells 1, 2, 3-4, 5-8 and so on. Each cell of an item has a Poisson
    process with the cell's width as rate; a point falls on one signature value and on one count within
    the cell, and a bag sees the points on counts it reaches. The points are functions of item, cell and
    number alone, so bags share those of their common part. A value is the time of its first point.
    Points are drawn in order of time and only up to when every value of the bag is likely set; bags
    with a value left unset go on.
    """
    total = np.zeros(n_rows)
    np.add.at(total, row, count)
    out = np.full((n_rows, VALUES), np.inf)
    # One entry for each cell an item reaches: cell j > 0 holds the counts 2^(j-1)+1 .. 2^j.
    cells = np.frexp(np.maximum(count - 1, 0).astype(np.float64))[1] + 1
    who = np.repeat(np.arange(len(row)), cells)
    cell = np.arange(len(who)) - np.repeat(np.cumsum(cells) - cells, cells)
    width = np.where(cell > 0, 2.0 ** (cell - 1), 1.0)
    floor = np.where(cell > 0, 2.0 ** (cell - 1), 0.0)
    stream = mix(item[who] + (cell.astype(np.uint64) + np.uint64(1)) * np.uint64(BASE))
    owner, reach = row[who], count[who].astype(np.float64)
    time, number = np.zeros(len(who)), 0
    need = VALUES * (np.log(VALUES) + 4.0)
    limit = np.divide(need, total, out=np.zeros(n_rows), where=total > 0)
    active = np.arange(len(who))
    parked: list[tuple[np.ndarray, np.ndarray, int]] = []
    while True:
        while len(active):
            number += 1
            draw = mix(stream[active] + step_code(number))
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            time[active] += gap / width[active]
            late = time[active] > limit[owner[active]]
            if late.any():
                parked.append((active[late], draw[late], number))
                active, draw = active[~late], draw[~late]
            _mark(out, active, draw, time, owner, floor, width, reach)
        unset = (total > 0) & np.isinf(out).any(axis=1)
        if not unset.any():
            return out
        limit[unset] *= 2
        again, parked = parked, []
        resume: dict[int, list[np.ndarray]] = {}
        for who_, draw_, number_ in again:
            go = unset[owner[who_]]
            resume.setdefault(number_, []).append(who_[go])
        for number_, groups in sorted(resume.items()):
            _go_on(out, np.concatenate(groups), number_, stream, time, limit, owner, floor, width, reach, parked)
        active, number = np.zeros(0, np.int64), 0


def _go_on(out, active, number, stream, time, limit, owner, floor, width, reach, parked) -> None:
    """Points of parked processes from the one that came too late on."""
    first = True
    while len(active):
        if not first:
            number += 1
        draw = mix(stream[active] + step_code(number))
        if not first:
            gap = -np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            time[active] += gap / width[active]
        first = False
        late = time[active] > limit[owner[active]]
        if late.any():
            parked.append((active[late], draw[late], number))
            active, draw = active[~late], draw[~late]
        _mark(out, active, draw, time, owner, floor, width, reach)


def _mark(out, active, draw, time, owner, floor, width, reach) -> None:
    place = mix(draw ^ np.uint64(0xA0761D6478BD642F))
    level = floor[active] + 1 + np.floor((place >> np.uint64(32)).astype(np.float64) * 2.0**-32 * width[active])
    seen = level <= reach[active]
    value = ((place & np.uint64(0xFFFFFFFF)) % np.uint64(VALUES)).astype(np.int64)[seen]
    np.minimum.at(out, (owner[active[seen]], value), time[active[seen]])


def step_code(number: int) -> np.uint64:
    return np.uint64(number * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF)


def band_hashes(found: np.ndarray) -> np.ndarray:
    """One hash for each band of a signature."""
    bits = mix(np.ascontiguousarray(found).view(np.uint64)).reshape(len(found), BANDS, BAND_ROWS)
    weight = np.array([pow(BASE, k, 1 << 64) for k in range(1, BAND_ROWS + 1)], np.uint64)
    return mix((bits * weight).sum(axis=2) + np.arange(1, BANDS + 1, dtype=np.uint64)).view(np.int64)


def word_classes(found: Words) -> np.ndarray:
    """64 bits of the SHA-256 of each row's words in order."""
    flat, begin, end = found.joined()
    begin, end = np.append(begin, 0), np.append(end, 0)
    cuts = [(int(begin[a]), int(end[z - 1])) if z > a else (0, 0) for a, z in zip(found.first[:-1], found.first[1:])]
    return np.frombuffer(b"".join(hashlib.sha256(flat[a:z]).digest()[:8] for a, z in cuts), np.uint64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row keys, class, weight, bands) of every row. Rows with the same words in order have the same class."""
    for b in batches:
        data, offsets = utf8(b.column(2))
        n = b.num_rows
        kind, weight, bands = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros((n, BANDS), np.int64)
        small = []
        for lo, hi in slices(offsets):
            part, within = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            found = words(part, within)
            kind[lo:hi] = word_classes(found)
            row, item, count = bags(part, within)
            weight[lo:hi] = np.bincount(row, weights=count, minlength=hi - lo)
            little = weight[lo:hi][row] < SMALL_BAG
            small.append((row[little] + lo, item[little], count[little]))
            big = np.flatnonzero(weight[lo:hi] >= SMALL_BAG)
            if len(big):
                at = np.searchsorted(big, row[~little])
                bands[lo + big] = band_hashes(signatures(at, item[~little], count[~little], len(big)))
        row, item, count = (np.concatenate(x) for x in zip(*small)) if small else (np.zeros(0, np.int64),) * 3
        rows = np.unique(row)
        if len(rows):
            at = np.searchsorted(rows, row)
            bands[rows] = band_hashes(signatures(at, item.astype(np.uint64), count, len(rows)))
        listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.ravel()))
        columns = [b.column(0), b.column(1), pa.array(kind.view(np.int64)), pa.array(weight), listed]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "class", "weight", "bands"])


def _bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, offsets = utf8(b.column(1))
        for lo, hi in slices(offsets):
            row, item, count = bags(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            cuts = pa.array(np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32))
            columns = [
                b.column(0).slice(lo, hi - lo),
                pa.ListArray.from_arrays(cuts, pa.array(item.view(np.int64) ^ np.int64(-(1 << 63)))),
                pa.ListArray.from_arrays(cuts, pa.array(count.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["class", "items", "counts"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bags overlap enough: sums of minima and maxima over items, in whole numbers."""
    for b in batches:
        items, counts = (b.column(2), b.column(4)), (b.column(3), b.column(5))
        near = np.zeros(b.num_rows, bool)
        for k in range(b.num_rows):
            (x, y), (n, m) = ([c[k].values.to_numpy() for c in side] for side in (items, counts))
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = np.flatnonzero(y[at] == x)
            least = int(np.minimum(n[both], m[at[both]]).sum())
            most = int(n.sum() + m.sum()) - least
            near[k] = NEAR[1] * least >= NEAR[0] * most
        keep = pa.array(near)
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a class has less or more of than its centre, by item; weights and slack say if the two are near.

    Likeness is 0.8 or more if nine times the weight of the difference is no more than both weights. The slack
    is nine times the difference less the class's weight: two classes are near a third way round if their
    slacks add up to no more than eighteen times what their differences share.
    """
    for b in batches:
        (centres, kinds), out = (b.column(0), b.column(1)), []
        for k in range(b.num_rows):
            x, n, y, m = (b.column(c)[k].values.to_numpy() for c in (2, 3, 4, 5))
            every = np.union1d(x, y)
            more = np.zeros(len(every), np.int64)
            more[np.searchsorted(every, y)] += m
            more[np.searchsorted(every, x)] -= n
            at = np.flatnonzero(more)
            difference = int(np.abs(more).sum())
            near = 9 * difference <= int(n.sum()) + int(m.sum())
            out.append((every[at], more[at], 9 * difference - int(m.sum()), near))
        items, amounts, slack, near = zip(*out) if out else ([], [], [], [])
        cuts = pa.array(np.concatenate(([0], np.cumsum([len(i) for i in items]))).astype(np.int32))
        columns = [centres, kinds]
        columns += [pa.ListArray.from_arrays(cuts, pa.array(np.concatenate(c) if c else np.zeros(0, np.int64))) for c in (items, amounts)]
        columns += [pa.array(slack, pa.int64()), pa.array(near, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "class", "items", "amounts", "slack", "near"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each node's component. Labels are tables, one for each round."""
    spark = edges.sparkSession
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = as_table(both.distinct(), scratch_path(spark, "edges"))
    labels = both.groupBy("a").agg(F.min("b").alias("least")).select(
        F.col("a").alias("node"), F.least("a", "least").alias("label")
    )
    labels = as_table(labels, scratch_path(spark, "labels"))
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("least"))
        next_ = labels.join(near, F.col("node") == F.col("a")).select(
            "node", F.least("label", "least").alias("via"), F.col("label").alias("was")
        )
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        next_ = next_.join(jump, "via").select("node", F.least("via", "far").alias("label"), "was")
        next_ = as_table(next_, scratch_path(spark, "labels"))
        changed = next_.where("label <> was").limit(1).count()
        labels = next_.drop("was")
        if not changed:
            return labels


def nearest(one: DataFrame, other: DataFrame) -> DataFrame:
    """Cells of ``one`` within whose cap a cell of another group at the same place is, as (x, y): the one of least slack.

    Needs only the least slack of each place, and the least one of other groups than that cell's.
    """
    least = other.groupBy(*PLACE, "label").agg(F.min(F.struct("slack", "class")).alias("found"))
    first = least.groupBy(*PLACE).agg(F.min(F.struct("found", "label")).alias("first"))
    second = least.join(first, PLACE).where("label <> first.label").groupBy(*PLACE).agg(F.min("found").alias("second"))
    found = F.when(F.col("label") != F.col("first.label"), F.col("first.found")).otherwise(F.col("second"))
    cells = one.join(first, PLACE).join(second, PLACE, "left").withColumn("found", found)
    cells = cells.where("found.slack <= cap")
    return cells.select(*one.columns, F.col("class").alias("x"), F.col("found.class").alias("y"))


def apart_in_groups(telling: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells of x and of y that can meet one of another group, by the least slack at their place."""
    spark, columns = telling.sparkSession, [*PLACE, "class", "slack", "cap", "label"]
    one, other = telling.where("x").select(*columns), telling.where("y").select(*columns)
    one = as_table(nearest(one, other).select(*columns), scratch_path(spark, "one"))
    return one, as_table(nearest(other, one).select(*columns), scratch_path(spark, "other"))


def meeting(one: DataFrame, other: DataFrame) -> DataFrame:
    """(x, y) of different groups that are within each other's cap at a place."""
    other = other.select(*PLACE, F.col("class").alias("y"), *[F.col(c).alias(f"{c}_y") for c in ("slack", "cap", "label")])
    within = "label <> label_y AND slack_y <= cap AND slack <= cap_y"
    return one.withColumnRenamed("class", "x").join(other, PLACE).where(within).select("x", "y")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the group of documents that near likenesses connect.

    Two documents are near if the bags of their five-word shingles have a weighted Jaccard likeness of
    0.8 or more. Texts with the same words are one class, of which one bag takes part. Classes meet in
    buckets, one for each of 24 bands of four signature values: of pairs at 0.8, four in a million meet
    in none. What meets is verified on the whole bags.

    A bucket does not emit its pairs. Classes that share less than 0.8 of their weight with all others
    together are near none and leave first, twice. Then, in each of three rounds, all classes of a bucket
    are held against one centre, the one with the largest share in common with others, and what is near
    is joined; buckets that lie within one group are done, and a centre is not compared again. Pairs of a
    bucket that are still in different groups after that are held as their differences from a centre, the
    same one for all buckets whose classes are mostly in one group. Two that are not both near it must share
    enough of these, so they meet at the rarest items of the differences, within exact bounds. A place of
    such an item does not emit its pairs either: what no other group's least bound lets through leaves, and
    each class is held against the likeliest one of another group. Only what is in different groups even
    then, and still within the bounds, meets in pairs and is verified: no link is lost.

    Returns doc_id, class_id (smallest id of the group), group_size, kept (the row of that id) and the
    row key ``row``.

    Null text counts as empty; texts without words are one group. Texts of fewer than five words are one
    shingle. A null id is never the class_id unless all ids of its group are null. Repeated rows are in
    one group and each has its row. An empty table gives no rows; other columns are ignored. Memory
    follows the longest text.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), row_keys(id_col, text)[0].alias("row"), text.alias("text"))
    id_kind = rows.schema["doc_id"].dataType.simpleString()
    signed = rows.mapInArrow(_sign, f"doc_id {id_kind}, row long, class long, weight long, bands array<long>")
    signed = as_table(signed, scratch_path(spark, "signed"))
    classes = signed.where("weight > 0").groupBy("class").agg(
        F.min("row").alias("row"), F.first("weight").alias("weight"), F.first("bands").alias("bands")
    )
    entries = classes.select("class", "row", "weight", F.explode("bands").alias("bucket"))
    shared = entries.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
    shared = as_table(shared.where("lo <> hi").select("bucket"), scratch_path(spark, "shared"))
    entries = as_table(entries.join(shared, "bucket", "left_semi"), scratch_path(spark, "entries"))
    wanted = entries.select("class", "row").distinct()
    texts = rows.select("row", "text").join(wanted, "row").dropDuplicates(["row"]).select("class", "text")
    every = texts.mapInArrow(_bag, "class long, items array<long>, counts array<int>")
    every = as_table(every, scratch_path(spark, "bags"))

    def verified(pairs: DataFrame) -> DataFrame:
        one = every.select(F.col("class").alias("a"), F.col("items").alias("x"), F.col("counts").alias("n"))
        two = every.select(F.col("class").alias("b"), F.col("items").alias("y"), F.col("counts").alias("m"))
        pairs = pairs.join(one, "a").join(two, "b").select("a", "b", "x", "n", "y", "m")
        return pairs.mapInArrow(_verify, "a long, b long")

    def several(some: DataFrame) -> DataFrame:
        """Entries of buckets that hold more than one class."""
        kinds = some.groupBy("bucket").agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
        kinds = as_table(kinds.where("lo <> hi").select("bucket"), scratch_path(spark, "several"))
        return some.join(kinds, "bucket", "left_semi")

    def peeled(some: DataFrame, own: DataFrame) -> DataFrame:
        """Entries with ``shared``: the weight of the class in shingles that another class here has too.

        Two bags have no more than that in common, so a class of which less than 0.8 is shared is near none.
        """
        cells = own.select("class", F.explode(F.arrays_zip("items", "counts")).alias("x"))
        cells = cells.select("class", F.col("x.items").alias("item"), F.col("x.counts").alias("n"))
        twice = cells.groupBy("item").agg(F.count("*").alias("classes")).where("classes > 1").select("item")
        twice = as_table(twice, scratch_path(spark, "twice"))
        shared = cells.join(twice, "item", "left_semi").groupBy("class").agg(F.sum("n").alias("shared"))
        shared = as_table(shared, scratch_path(spark, "shared"))
        joined = some.join(shared, "class").where(F.col("shared") * NEAR[1] >= F.col("weight") * NEAR[0])
        return as_table(several(joined), scratch_path(spark, "open"))

    def could_be_near() -> Column:
        """What two classes have in common is at most what either shares with any; their weights bound it too."""
        common = F.least("shared", "s")
        lighter, heavier = F.least("weight", "w"), F.greatest("weight", "w")
        fits = common * (NEAR[0] + NEAR[1]) >= (F.col("weight") + F.col("w")) * NEAR[0]
        return fits & (lighter * NEAR[1] >= heavier * NEAR[0])

    def differing(some: DataFrame, centres: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(cells, near): items that classes differ in from the centre ``a`` of their bucket, and (a, b) near centres.

        Of a pair that is not both near the centre one class, x, is not near it; the other one is y. They are near
        if their differences have at least (slack of x + slack of y) / 18 in common. The rarest item in common is
        followed by all the others, so what follows it is that much in both: the other's slack is at most ``cap``.
        Cells whose cap is below the least slack of those that they could meet are left out. Copies with edits
        of their own have their rarest items to themselves, and do not meet.
        """
        pairs = some.join(centres, "bucket").where("class <> a").select("a", "class").distinct()
        one = every.select(F.col("class").alias("a"), F.col("items").alias("x"), F.col("counts").alias("n"))
        two = every.select("class", F.col("items").alias("y"), F.col("counts").alias("m"))
        pairs = pairs.join(one, "a").join(two, "class").select("a", "class", "x", "n", "y", "m")
        schema = "a long, class long, items array<long>, amounts array<long>, slack long, near boolean"
        apart = as_table(pairs.mapInArrow(_differences, schema), scratch_path(spark, "differences"))
        far = F.min(F.when(~F.col("near"), F.col("slack")))
        least = apart.groupBy("a").agg(F.min("slack").alias("least"), far.alias("least_far")).where("least_far IS NOT NULL")
        known = ["a", "class", "near", "slack", "least", "least_far"]
        cells = apart.join(least, "a").select(*known, F.explode(F.arrays_zip("items", "amounts")).alias("c"))
        cells = cells.select(*known, F.col("c.items").alias("item"), F.col("c.amounts").alias("amount"))
        cells = cells.withColumn("more", F.col("amount") > 0)
        often = cells.groupBy(*PLACE).agg(F.count("*").alias("classes"))
        cells = as_table(cells.join(often, PLACE), scratch_path(spark, "cells"))
        order = Window.partitionBy("a", "class").orderBy("classes", "item")
        rest = F.sum(F.abs("amount")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
        cells = cells.withColumn("cap", 18 * rest - F.col("slack")).where("classes > 1")
        x, y = F.expr("NOT near AND cap >= least"), F.expr("cap >= least_far")
        cells = cells.select(*PLACE, "class", "slack", "cap", x.alias("x"), y.alias("y")).where("x OR y")
        near = apart.where("near").select("a", F.col("class").alias("b"))
        return as_table(grouped(cells), scratch_path(spark, "telling")), near

    def common_centres(some: DataFrame, centres: DataFrame, labels: DataFrame | None) -> DataFrame:
        """(bucket, a): the first centre with the most buckets, of the group that most of a bucket's classes are in."""
        if labels is None:
            return centres
        named = centres.join(labels.withColumnRenamed("node", "a"), "a").groupBy("label", "a").agg(F.count("*").alias("n"))
        named = named.groupBy("label").agg(F.max_by("a", F.struct("n", "a")).alias("to"))
        most = some.groupBy("bucket", "label").agg(F.count("*").alias("n"))
        most = most.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("label"))
        chosen = centres.join(most, "bucket").join(named, "label", "left")
        return chosen.select("bucket", F.coalesce("to", "a").alias("a"))

    open_ = peeled(entries.select("bucket", "class", "weight"), every)
    left = every.join(open_.select("class").distinct(), "class", "left_semi")
    open_ = peeled(open_.drop("shared"), left)
    open_ = open_.withColumn("label", F.col("class"))
    edges, labels, first = None, None, None

    def linked(found: DataFrame) -> bool:
        """Take near pairs as links; whether there were any."""
        nonlocal edges, labels
        found = as_table(found, scratch_path(spark, "near"))
        if not found.limit(1).count():
            return False
        edges = found if edges is None else edges.unionByName(found)
        labels = connected(edges)
        return True

    def grouped(some: DataFrame) -> DataFrame:
        """With the group of the class as ``label``."""
        if labels is None:
            return some.withColumn("label", F.col("class"))
        named = some.join(labels.withColumnRenamed("node", "class"), "class", "left")
        return named.withColumn("label", F.coalesce("label", "class"))

    for _ in range(CENTRE_ROUNDS):
        if not open_.limit(1).count():
            break
        order = F.struct((-F.col("shared") / F.col("weight")).alias("rank"), "class", "weight", "shared", "label")
        centre = open_.groupBy("bucket").agg(F.min(order).alias("c")).select("bucket", "c.*")
        centre = centre.select(
            "bucket", F.col("class").alias("a"), F.col("weight").alias("w"), F.col("shared").alias("s"), F.col("label").alias("l")
        )
        centre = as_table(centre, scratch_path(spark, "centre"))
        first = centre.select("bucket", "a") if first is None else first
        pairs = open_.join(centre, "bucket").where((F.col("label") != F.col("l")) & could_be_near())
        linked(verified(pairs.select("a", F.col("class").alias("b")).distinct()))
        rest = grouped(open_.join(centre.select("bucket", "a"), "bucket").where("class <> a").drop("label", "a"))
        mixed = rest.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
        mixed = as_table(mixed.where("lo <> hi").select("bucket"), scratch_path(spark, "mixed"))
        rest = rest.join(mixed, "bucket", "left_semi")
        open_ = as_table(rest.select(*open_.columns), scratch_path(spark, "open"))
    if open_.limit(1).count():
        # What is known of a class: its weight and what it shares with any.
        known = as_table(open_.select("class", "weight", "shared").distinct(), scratch_path(spark, "known"))
        telling, near = differing(open_, common_centres(open_, first, labels))

        def compared(pairs: DataFrame) -> DataFrame:
            pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
            pairs = pairs.join(known.withColumnRenamed("class", "b"), "b").join(known.toDF("a", "w", "s"), "a")
            return verified(pairs.where(could_be_near()).select("a", "b"))

        # A class near a common centre need not have met it in a bucket of its own.
        in_group = grouped(near.withColumnRenamed("b", "class")).withColumnRenamed("class", "b")
        in_group = grouped(in_group.withColumnRenamed("label", "l").withColumnRenamed("a", "class"))
        in_group = in_group.where("label <> l").select(F.col("class").alias("a"), "b")
        one, other = apart_in_groups(telling)
        likeliest = as_table(nearest(one, other), scratch_path(spark, "likeliest"))
        one = likeliest.select(*one.columns)
        if linked(compared(likeliest.select("x", "y")).unionByName(in_group)):
            # Groups only grow, so what had none to meet before has none now.
            one, other = (grouped(cells.drop("label")) for cells in (one, other))
            one = as_table(nearest(one, other).select(*one.columns), scratch_path(spark, "one"))
        linked(compared(meeting(one, other)))
    if labels is None:
        labels = spark.createDataFrame([], "node long, label long")
    member = signed.select("doc_id", "row", "class").join(labels.withColumnRenamed("node", "class"), "class", "left")
    member = member.select("doc_id", "row", F.coalesce("label", "class").alias("label"))
    groups = member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("group_size"))
    kept = F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept")
    return member.join(groups, "label").select("doc_id", "class_id", "group_size", kept, "row")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, all columns: the one with the smallest id. Repeated rows stay once."""
    kept = near_groups(docs, id_col, text_col).where("kept").select(F.col("row").alias("_row")).distinct()
    key = row_keys(id_col, F.coalesce(F.col(text_col).cast("string"), F.lit("")))[0]
    keyed = docs.select(whole_row(docs), key.alias("_row")).join(kept, "_row", "left_semi")
    return keyed.dropDuplicates(["_row"]).select(*columns_of(docs))
