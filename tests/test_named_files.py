"""Files under given names: whole, in order, and nothing after a failure."""

import os

import pytest
from pyspark.sql import functions as F

from worklens.sources import sinks
from worklens.sources.named_files import write_named_files


def test_named_files_and_their_failures(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.range(3000).select(F.concat(F.lit("f"), (F.col("id") % 7).cast("string"), F.lit(".txt")).alias("name"), "id", F.concat(F.lit("é"), F.col("id").cast("string")).alias("line"))
    write_named_files(rows.repartition(6), path, "name", "line", ["id"])
    assert sorted(os.listdir(path)) == [f"f{i}.txt" for i in range(7)]
    with open(f"{path}/f3.txt", newline="") as file:
        assert file.read() == "".join(f"é{i}\r\n" for i in range(3, 3000, 7))
    # The same name again is refused, and replaced only on request.
    with pytest.raises(Exception):
        write_named_files(rows.limit(1).withColumn("line", F.lit("new")), path, "name", "line", ["id"])
    assert len(os.listdir(path)) == 7 and os.path.getsize(f"{path}/f0.txt") > 10
    write_named_files(rows.filter("id = 0"), path, "name", "line", ["id"], overwrite=True)
    assert len(os.listdir(path)) == 7 and os.path.getsize(f"{path}/f0.txt") == len("é0\r\n".encode())

    @F.udf("string")
    def fails(i):
        if i == 2999:
            raise ValueError("no line")
        return "x"

    with pytest.raises(Exception):
        write_named_files(rows.withColumn("name", F.concat(F.lit("g"), F.col("name"))).withColumn("line", fails("id")), path, "name", "line", ["id"])
    with pytest.raises(Exception):
        write_named_files(rows.withColumn("name", F.lit("../up")), path, "name", "line", ["id"])
    assert len(os.listdir(path)) == 7


def test_parameter_files_are_quoted_tables(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = [("a.csv", 2, "Second", 'says "no", twice', "mail"), ("a.csv", 1, "First", "", "board"), ("b.csv", 1, "Only", "x\ny", "board")]
    sinks.write_parameter_files(spark.createDataFrame(rows, "filename string, seq int, parameter string, value string, source string"), path)
    with open(f"{path}/a.csv", newline="") as file:
        assert file.read() == 'Parameter,Value,Source\r\nFirst,,board\r\nSecond,"says ""no"", twice",mail\r\n'
    assert sorted(os.listdir(path)) == ["a.csv", "b.csv"]
