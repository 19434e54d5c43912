"""Pages that land."""

from pyspark.sql import functions as F

from tapeline.sources import feeds as landed
from tapeline.streaming import feeds as streams


def test_pages_are_read_once_as_they_land(spark, tmp_path):
    where = tmp_path / "pages"

    def land(chunk, *pages):
        (where / chunk).mkdir(parents=True, exist_ok=True)
        for name, text in pages:
            (where / chunk / name).write_bytes(text.encode("cp1251"))

    def take():
        pages = landed.decoded(streams.read_pages(spark, str(where), 1).withColumn("encoding", F.lit("cp1251")))
        q = pages.select("chunk", "page", "decoded").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination()
        return sorted((tuple(r) for r in spark.read.schema("chunk string, page int, decoded string").parquet(str(tmp_path / "out")).collect()), key=str)

    land("2024-01-01", ("1.html", "раз"), ("2.html", ""), ("note.txt", "?"))
    first = [("2024-01-01", 1, "раз"), ("2024-01-01", None, "?")]
    assert take() == sorted(first, key=str)
    land("2024-02-01", ("1", "два"))
    assert take() == sorted([*first, ("2024-02-01", 1, "два")], key=str)
