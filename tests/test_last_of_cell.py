"""The last of repeated cells of coordinate text, over files and blocks of files."""

import eigenloom as el


def written(folder, files, lines):
    """Cells that come again in later lines and files, in an order of paths that is not that of writing."""
    last = {}
    for k in sorted(range(files), key=lambda k: f"c{k}.csv"):
        rows = [(i * 7 % 50, (i + k) % 4, 1000 * k + i) for i in range(lines)]
        (folder / f"c{k}.csv").write_text("".join(f"{r},{c},{v}.5\n" for r, c, v in rows))
        last.update({(r, c): v + 0.5 for r, c, v in rows})
    return last


def test_last_over_files_and_blocks(spark, tmp_path):
    last = written(tmp_path, 12, 120)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in (old, "200b"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            found = el.read_coo_text(spark, str(tmp_path), on_duplicate="last").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert {(r.row_id, r.col_id): r.value for r in found} == last and len(found) == len(last)


def test_no_sort_and_no_file_names_where_cells_are_grouped(spark, tmp_path, capsys):
    written(tmp_path, 2, 20)
    el.read_coo_text(spark, str(tmp_path), on_duplicate="last").explain()
    plan = capsys.readouterr().out.splitlines()
    groups = [line for line in plan if "max_by" in line]
    assert groups and all("HashAggregate" in line and "file" not in line for line in groups)
    assert not any("SortAggregate" in line for line in plan)
