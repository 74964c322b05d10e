import csv
import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CPUS', '4')}]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(where / "warehouse"))
        .config("spark.checkpoint.dir", str(where / "checkpoints"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder(tmp_path_factory):
    """CSV files: a garden, two tables without header, and small ones for single rules."""
    where = tmp_path_factory.mktemp("csv")

    def write(name, rows):
        with open(where / name, "w", newline="") as f:
            csv.writer(f).writerows(rows)

    write("herbs.csv", [["herb", "bed", "cm", "sown on", "place", "jars"], ["basil", 1, 30.5, "2021-03-04", "pot", 12], ["mint", 2, 45.0, "2020-07-19", "", 7], ["sage", 1, 60.25, "2019-11-30", "shade", ""], ["dill", 3, 80.5, "2021-03-20", "row", 5], ["thyme", 2, 20.5, "2022-01-01", "pot", 7]])
    write("beds.csv", [["bed", "soil"], [1, "loam"], [2, "clay"], [4, "sand"]])
    write("cities.csv", [[f"city{i}", i, f"k{i % 4}", "x", i * 10] for i in range(12)])
    write("country.csv", [[f"k{i}", f"country{i}"] for i in range(3)])
    write("types.csv", [["zero", "na", "blank", "gap", "span", "day", "long", "mixed", "num"], ["007", "NA", "", "1h30m", "3 weeks", "6/1/2017", "May 18 1955", "1", "1.5"], ["012", "5", "null", "90s", "1 year", "2017-06-02", "June 1 2017", "2.5", "-2"]])
    write("nulls.csv", [["k", "i", "f", "d", "s"], ["1", "1", "1.5", "1/1/2020", "a"], ["2", "", "", "", ""], ["3", "null", "2.5", "1/2/2020", "b"], ["4", "7", "NULL", "", "A"]])
    write("late.csv", [["n"], *[[i] for i in range(10_050)], ["bad"]])
    write("quoted.csv", [["a", "b"], ["x, y", 'say "hi"'], ["two\nlines", "z"]])
    (where / "ragged.csv").write_text("a,b\n1,2\n3\n4,5\n")
    write("left.csv", [["k", "v"], ["1", "a"], ["2", "b"], ["2", "c"], ["9", "d"], ["", "e"]])
    write("right.csv", [["k", "w"], ["1", "p"], ["2", "q"], ["9", "r"], ["9", "s"], ["", "t"]])
    (where / "hollow.csv").write_text("k,w\n")
    write("dupnames.csv", [["a", "a", "c1"], ["1", "2", "3"]])
    return str(where)
