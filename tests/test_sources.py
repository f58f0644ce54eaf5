"""Coordinate text and committed lines as data sources: splits, filters, bad lines, failed writes, gaps in ids."""

import io
import json
import os

import numpy as np
import pytest
from matrix_tools import array_of, entries_of
from pyspark.sql import functions as F

import eigenloom as el
from eigenloom.sources.coo import cells_of
from eigenloom.sources.files import line_blocks

RNG = np.random.default_rng(31)


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        self.seek(at)
        return self.read(n)


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def plan(df, capsys):
    df.explain("formatted")
    return capsys.readouterr().out


@pytest.mark.parametrize("end", ["", "\n"])
def test_every_line_lies_in_one_range(end):
    lines = ["x" * int(n) for n in RNG.integers(0, 9, 60)] + ["y" * 40, "z"]
    data = ("\n".join(lines) + end).encode()
    for step in (1, 2, 7, 64, 1000):
        found = b""
        for lo in range(0, len(data), step):
            for block in line_blocks(Bytes(data), lo, min(lo + step, len(data)), 5):
                assert block.endswith(b"\n") or found + block == data
                found += block
        assert found == data


def coo_folder(tmp_path, triples):
    folder = tmp_path / "coo"
    folder.mkdir()
    for k in range(3):
        text = "".join(f"{i},{j + 1},{v}\n" for i, j, v in triples[k::3])
        (folder / f"part-{k}.txt").write_text(text + ("\n" if k else ""))
    (folder / "_SUCCESS").write_text("")
    return str(folder)


@pytest.mark.parametrize("split", [16, 1 << 20])
def test_coo_source_reads_what_was_written(spark, tmp_path, split):
    triples = [(int(RNG.integers(1 << 40)), int(RNG.integers(50)), float(RNG.normal())) for _ in range(400)]
    path = coo_folder(tmp_path, triples)
    cells = el.scan_coo_text(spark, path, base=1, split_bytes=split)
    assert rows(cells, "row_id", "col_id", "value") == sorted(triples)
    some = cells.where("col_id < 20 AND row_id >= 1000 AND value > 0")
    wanted = sorted(t for t in triples if t[1] < 20 and t[0] >= 1000 and t[2] > 0)
    assert rows(some, "row_id", "col_id", "value") == wanted
    same = el.read_coo_text(spark, path, base=1, on_duplicate="keep")
    assert rows(same, "row_id", "col_id", "value") == sorted(triples)


def test_filters_on_ids_are_left_to_the_source(spark, tmp_path, capsys):
    cells = el.scan_coo_text(spark, coo_folder(tmp_path, [(1, 2, 3.0), (4, 5, 6.0)]), base=1)
    pushed = plan(cells.where("col_id < 4"), capsys)
    assert "LessThan(col_id,4)" in pushed.replace(" ", "")
    assert ") Filter" not in pushed and ") Filter" in plan(cells.where("value > 4"), capsys)


def test_bad_lines_fail_or_go(spark, tmp_path):
    bad = ["1,2", "1,2,3,4", "a,1,2", "1,,2", "1,2,x", '"1",2,3', "1,4294967296,1", "99999999999999999999,1,1", "1_0,1,1"]
    good = ["7,1,2.5", " 8 , 2 , -1e3 ", "+9,3,.5", "10,4,nan"]
    path = tmp_path / "lines.txt"
    for lines in ([b, *good] for b in bad):
        path.write_text("\r\n".join(lines))
        found = el.scan_coo_text(spark, str(path), malformed="drop")
        assert sorted(r.row_id for r in found.collect()) == [7, 8, 9, 10]
    with pytest.raises(Exception, match="not row,col,value"):
        el.scan_coo_text(spark, str(path)).collect()
    path.write_text("1,0,1\n")
    with pytest.raises(Exception, match="below the base"):
        el.scan_coo_text(spark, str(path), base=1).collect()


def test_blank_and_empty_files(spark, tmp_path):
    for text in ("", "\n", " \n\n"):
        (tmp_path / "x").write_text(text)
        assert el.scan_coo_text(spark, str(tmp_path / "x")).count() == 0
    assert cells_of(b"\n", False).num_rows == 0
    (tmp_path / "none").mkdir()
    assert el.scan_coo_text(spark, str(tmp_path / "none")).count() == 0


def committed(spark, pairs, parts=3):
    df = spark.createDataFrame(pairs, "row_id long, line string")
    return df.repartitionByRange(parts, "row_id").sortWithinPartitions("row_id", "line")


@pytest.mark.parametrize("split", [8, 1 << 20])
@pytest.mark.parametrize("kind", ["dense", "gaps", "repeats"])
def test_row_ids_read_back_equal(spark, tmp_path, split, kind):
    ids = {"dense": range(300), "gaps": np.cumsum(RNG.integers(1, 4, 300)), "repeats": np.sort(RNG.integers(0, 90, 300))}[kind]
    pairs = [(int(i), "é" * int(RNG.integers(0, 6)) + str(k)) for k, i in enumerate(ids)]
    path = str(tmp_path / "lines")
    el.write_committed_lines(committed(spark, pairs), path, split_bytes=split)
    back = el.read_committed_lines(spark, path)
    assert rows(back, "row_id", "line") == sorted(pairs)
    wanted = sorted(p for p in pairs if 40 <= p[0] < 60)
    some = back.where("row_id >= 40 AND row_id < 60")
    assert rows(some, "row_id", "line") == wanted
    if split == 8:
        assert some.rdd.getNumPartitions() < back.rdd.getNumPartitions()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "lines")
    old = [(k, f"old {k}") for k in range(20)]
    el.write_committed_lines(committed(spark, old), path)
    listed = [f for f in os.listdir(path) if f.startswith("manifest")]
    broken = committed(spark, [(k, "new") for k in range(500)])
    line = F.when(F.col("row_id") == 499, F.raise_error(F.lit("task lost"))).otherwise(F.col("line"))
    with pytest.raises(Exception, match="task lost"):
        el.write_committed_lines(broken.select("row_id", line.alias("line")), path, "overwrite")
    assert [f for f in os.listdir(path) if f.startswith("manifest")] == listed
    assert rows(el.read_committed_lines(spark, path), "row_id", "line") == old
    (tmp_path / "lines" / ("data-" + "0" * 32)).mkdir()
    el.write_committed_lines(committed(spark, old[:5]), path, "overwrite")
    assert rows(el.read_committed_lines(spark, path), "row_id", "line") == old[:5]
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 2
    with pytest.raises(FileExistsError):
        el.write_committed_lines(committed(spark, old), path)


def test_overwrite_append_and_what_is_forgotten(spark, tmp_path):
    path = str(tmp_path / "lines")
    tables = [[(k, f"{n} {k}") for k in range(5)] for n in range(4)]
    for table in tables:
        el.write_committed_lines(committed(spark, table), path, "overwrite")
        assert rows(el.read_committed_lines(spark, path), "row_id", "line") == table
    assert len([f for f in os.listdir(path) if f.startswith("data-")]) == 2
    el.write_committed_lines(committed(spark, [(9, "more")]), path, "append")
    assert rows(el.read_committed_lines(spark, path), "row_id", "line") == [*tables[-1], (9, "more")]
    with pytest.raises(Exception, match="fall between files"):
        el.write_committed_lines(committed(spark, [(3, "late")]), path, "append")
    assert el.read_committed_lines(spark, path).count() == 6
    latest = max(f for f in os.listdir(path) if f.startswith("manifest"))
    listed = json.loads((tmp_path / "lines" / latest).read_text())["files"]
    assert sum(f["lines"] for f in listed) == 6


@pytest.mark.parametrize(
    "pairs, message",
    [([(1, None)], "null"), ([(None, "x")], "null"), ([(1, "a\nb")], "line break"), ([(2, "x"), (1, "x")], "fall")],
)
def test_rows_that_cannot_be_lines(spark, tmp_path, pairs, message):
    df = spark.createDataFrame(pairs, "row_id long, line string").coalesce(1)
    with pytest.raises(Exception, match=message):
        el.write_committed_lines(df, str(tmp_path / "lines"))
    with pytest.raises(Exception, match="no committed lines"):
        el.read_committed_lines(spark, str(tmp_path / "lines")).count()


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "lines")
    el.write_committed_lines(committed(spark, []), path)
    assert el.read_committed_lines(spark, path).count() == 0


@pytest.mark.parametrize("fmt", ["DENSE", "LIL", "COO"])
def test_matrices_in_committed_folders(spark, tmp_path, fmt):
    array = RNG.normal(size=(40, 6)) * (RNG.random((40, 6)) < 0.4)
    array[[3, 4, 17]] = 0
    array[39, 0] = 1
    path = el.write_matrix(entries_of(spark, array, 4), fmt, str(tmp_path), n_cols=6, committed=True)
    lines = el.read_committed_lines(spark, path)
    assert {r.row_id for r in lines.collect()} == set(np.flatnonzero(array.any(axis=1)).tolist())
    if fmt == "DENSE":
        back = el.to_entries(el.read_dense_text(spark, path, committed=True))
        np.testing.assert_allclose(array_of(back, array.shape), array)
