"""CSV files over many splits beside the csv module."""

import csv
import io

import numpy as np
import pytest

from ragtables.functions.names import normal_path
from ragtables.sources.csv_files import read_csv_parts


def written(names, rows):
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerows([names, *rows])
    return out.getvalue()


def wanted(text):
    names, *rows = [r for r in csv.reader(io.StringIO(text)) if r]
    return ["\n".join(f"{n.strip()}: {(r[i] if i < len(r) else '').strip()}" for i, n in enumerate(names)) for r in rows]


@pytest.mark.parametrize("split", ["128m", "1k"])
def test_records_of_files_with_their_own_headers(spark, tmp_path, split):
    rng = np.random.default_rng(4)
    odd = ['say "hi"', "two\nlines", "a, b", "", ' "', "\n\n", "x" * 300 + "\n" + '"' * 4, "é 日本"]
    files = {
        "a": written(["id", " note ", "more"], [[i, odd[rng.integers(len(odd))], odd[rng.integers(len(odd))]] for i in range(400)]),
        "b": written(["Name", "Text, quoted\nname"], [[odd[rng.integers(len(odd))] + "y", i] for i in range(50)]),
        "c": written(["only"], []),
        "d": "p,q,r\n\n1\n1,2,3,4\n,,\n\"x\",\"y\n" + "long\n" * 1500 + "\",z\nlast,one,",
    }
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_csv_parts(spark, str(tmp_path)).orderBy("path", "part_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    for name, text in files.items():
        got = [r for r in rows if r.path.endswith(f"/{name}.csv")]
        assert [r.text for r in got] == wanted(text)
        if split == "1k" and name in "ad":
            assert len({r.part_no.split for r in got}) > 1


def test_paths_are_those_of_pathlib(spark):
    import pathlib

    paths = ["a/b", "a//b/", "./a/./b", "/a", "//a/b", "///a", ".", "a/..", "a/../b", "/", "//", "a/.", ".hidden/x", " a / b", "..//c"]
    got = spark.createDataFrame([(p,) for p in paths], "p string").select("p", normal_path("p").alias("n")).collect()
    assert {r.p: r.n for r in got} == {p: str(pathlib.PurePosixPath(p)) for p in paths}
