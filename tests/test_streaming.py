"""The registry of a stream is that of the table."""

from terrasift.operators.registry import file_registry
from terrasift.sources.views import view
from terrasift.streaming.arrivals import append_registry


def test_registry_stream(spark, tmp_path):
    files = view(spark, "/root/testdata/sf0.001", "fx_files")
    files.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).parquet(str(tmp_path / "in"))
    append_registry(stream, str(tmp_path / "out"), str(tmp_path / "ckpt")).awaitTermination(60)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(str, got.collect())) == sorted(map(str, file_registry(files).collect()))
