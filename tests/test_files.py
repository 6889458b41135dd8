"""Label files row by row: flags, blanks, odd file names, ragged lines, logs by date."""

from pyspark.sql import functions as F

from verdigris.sources import readers, writers


def test_records_of_odd_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        "call_id,phone_number,product,call_result,main,secondary,third,parse_ok\n"
        "\t7 ,None,TOL,Save ,\"Network, other\",, OTHER,\n"
        "8,0812,,,,,,no\n9,nan,x,y,,,,1\n10,1,x,y,,,,YES\n11,1,x,y,,,,0\n12,1,x,y,,,,false\n13,1,x,y,,,,True\n"
    )
    got = {r["call_id"]: r for r in readers.records(readers.label_csv(spark, str(tmp_path))).collect()}
    assert {k: r["parse_ok"] for k, r in got.items()} == {"7": True, "8": False, "9": True, "10": True, "11": False, "12": False, "13": True}
    assert (got["7"]["phone"], got["7"]["product"], got["7"]["call_result"], got["7"]["reasons"]) == (None, "tol", "save", ["network", "other"])
    assert (got["8"]["phone"], got["8"]["product"], got["8"]["reasons"], got["9"]["phone"]) == ("0812", None, [], None)


def test_columns_that_a_file_lacks_are_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text("call_id,product\n1,tol\n")
    (row,) = readers.records(readers.label_csv(spark, str(tmp_path))).collect()
    assert (row["call_id"], row["phone"], row["reasons"], row["parse_ok"]) == ("1", None, [], True)


def test_file_names(spark):
    names = spark.createDataFrame([("/in/1_2_20240131.wav",), ("1_2_2024-1.wav",), ("1.wav",), ("",), (None,)], "path string")
    got = [tuple(r) for r in names.select(*readers.file_name_fields(F.col("path"), ["a", "b", "day"], dates=["day"])).collect()]
    assert got == [("1", "2", "20240131"), ("1", "2", None), ("1", None, None), ("", None, None), (None, None, None)]


def test_ragged_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("k|v|w\n1|a|b\n2\n3|c|d|e|f\n")
    assert [tuple(r) for r in readers.delimited(spark, str(tmp_path), ["k", "v", "w"]).collect()] == [("1", "a", "b"), ("2", None, None), ("3", "c", "d")]


def test_logs_by_date_append(spark, tmp_path):
    rows = spark.createDataFrame([(1, "2024-01-31 23:00:00"), (2, "2024-02-01 00:00:00"), (3, None)], "id long, at string").withColumn("at", F.to_timestamp("at"))
    for _ in range(2):
        writers.append_by_date(rows, str(tmp_path / "log"), "at")
    assert sorted(p.name for p in (tmp_path / "log").glob("month=*")) == ["month=202401", "month=202402"]
    got = spark.read.parquet(str(tmp_path / "log")).groupBy("id").count().collect()
    assert {r["id"]: r["count"] for r in got} == {1: 2, 2: 2}
