"""Natural order and names of captures."""

from pyspark.sql import functions as F

from motility.functions.names import natural_path_key, natural_sort_key, parse_capture_path
from motility.sources.captures import sanitize_names


def ordered(spark, names, **options):
    df = spark.createDataFrame([(n,) for n in names], "n string")
    return [r.n for r in df.orderBy(natural_sort_key(F.col("n"), **options), "n").collect()]


def test_numbers_compare_as_numbers(spark):
    assert ordered(spark, ["x2", "x10", "x1"]) == ["x1", "x2", "x10"]
    assert ordered(spark, ["a10b2", "a10b10", "a2", "a"]) == ["a", "a2", "a10b2", "a10b10"]


def test_case_and_place_of_numbers(spark):
    assert ordered(spark, ["B1", "a1"]) == ["a1", "B1"]
    assert ordered(spark, ["a1", "B1"], case_sensitive=True) == ["B1", "a1"]
    assert ordered(spark, ["a", "1", "*"], numbers="beforechar")[0] == "1"
    assert ordered(spark, ["a", "1", "*"], numbers="afterchar")[-1] == "1"


def test_paths_by_level_then_name_then_extension(spark):
    names = ["b10/a.txt", "b2/a.txt", "b2/a.csv", "b2/a1.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r.n for r in df.orderBy(natural_path_key(F.col("n"))).collect()] == ["b2/a.csv", "b2/a.txt", "b2/a1.csv", "b10/a.txt"]


def test_capture_names(spark):
    df = spark.createDataFrame([("group1/3_capture2/T00005.mat",), ("group1__3_capture2__T00005__7.mat",), ("x_t005_z003_c001.tif",), (None,)], "path string")
    rows = [tuple(r)[1:] for r in parse_capture_path(df).collect()]
    assert rows == [(1, 3, 2, 5, None, None, None), (1, 3, 2, 5, 7, None, None), (None, None, None, 5, None, 3, 1), (None,) * 7]


def test_clean_names():
    assert sanitize_names(["mean (um/s)", "a b"]) == ["mean__um_s_", "a_b"]
