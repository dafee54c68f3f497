import glob

import pytest
from pyspark.sql import functions as F

from fairload.llm import warc

ROWS = [
    (5, "http://a/\r\nX: y", "é" * 60),
    (3, "http://b", "é" * 60),
    (9, None, "é" * 60),
    (3, "http://b2", "é" * 60),
    (None, "http://c", "é" * 60),
    (6, "http://d", "short"),
    (7, "http://e", "short"),
    (8, "http://f", None),
    (10, "http://g", "Line\r\nWARC-Type: revisit\r\n\r\nWARC/1.1\r\n" + "z" * 100),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "record_id long, url string, payload string").withColumn("header", F.lit("x"))


def test_round_trip(spark, pages, tmp_path):
    path = warc.write_archive(pages, str(tmp_path / "a"))
    back = warc.read_archive(spark, path).collect()
    assert sorted((r["record_id"] or 0, r["payload"]) for r in back) == sorted((i or 0, p or "") for i, _, p in ROWS)
    kinds = sorted((r["record_id"] or 0, r["record_type"], r["refers_to"]) for r in back)
    assert kinds == [
        (0, "revisit", 3), (3, "response", None), (3, "response", None), (5, "revisit", 3), (6, "response", None),
        (7, "response", None), (8, "response", None), (9, "revisit", 3), (10, "response", None),
    ]
    assert spark.read.parquet(f"{path}/payloads").count() == 4  # each payload once, the empty one too
    urls = {r["record_id"]: r["url"] for r in back}
    assert urls[5] == "http://a/%20%20X:%20y" and urls[9] is None


def test_damaged_payload_is_refused(spark, pages, tmp_path):
    path = warc.write_archive(pages, str(tmp_path / "a"))
    stored = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit("!"))).cache()
    stored.count()
    bad = str(tmp_path / "b")
    stored.write.parquet(f"{bad}/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{bad}/headers")
    with pytest.raises(Exception, match="does not match digest"):
        warc.read_archive(spark, bad).collect()


def test_exported_files_hold_whole_records(spark, pages, tmp_path):
    path = warc.write_archive(pages, str(tmp_path / "a"))
    warc.export_warc(warc.read_archive(spark, path), str(tmp_path / "warc"))
    seen = []
    for name in glob.glob(str(tmp_path / "warc" / "part-*")):
        with open(name, "rb") as file:
            data = file.read()
        while data:  # records follow one another by their content length
            head, _, rest = data.partition(b"\r\n\r\n")
            fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
            size = int(fields[b"Content-Length"])
            seen.append((fields[b"WARC-Type"], rest[:size].decode()))
            assert rest[size : size + 4] == b"\r\n\r\n"
            data = rest[size + 4 :]
    assert len(seen) == len(ROWS)
    assert sorted(p for kind, p in seen if kind == b"response") == sorted(
        [ROWS[1][2], ROWS[3][2], "short", "short", "", ROWS[8][2]]
    )


def test_empty(spark, tmp_path):
    none = spark.createDataFrame([], "record_id long, url string, payload string")
    assert warc.read_archive(spark, warc.write_archive(none, str(tmp_path / "a"))).count() == 0
