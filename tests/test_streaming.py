import datetime as dt

from codeloom import functions
from codeloom.streaming.commits import append_to


def test_commits_arrive_once(spark, tmp_path):
    schema = "hash string, author string, date timestamp"
    day = lambda d: dt.datetime(2024, 3, d)
    spark.createDataFrame([("a", "Ann", day(1)), ("b", "Bob", day(2))], schema).coalesce(1).write.parquet(str(tmp_path / "in/1"))
    spark.createDataFrame([("a", "Ann", day(1)), ("c", "Ann", day(3))], schema).coalesce(1).write.parquet(str(tmp_path / "in/2"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.hash for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_functions_are_exported():
    assert all(callable(getattr(functions, n)) for n in functions.__all__)
