import base64
import gzip
import hashlib
import io
import zlib

import pyarrow as pa
import pytest
from barloom.llm import warc
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNull, Not, StringStartsWith

PAGES = "page_id long, url string, html string, payload string, record_type int, first long"


def rows():
    html = ["<p>a</p>", "", None, "é\x00\r\n\r\nWARC/1.1\r\n", "x" * 300_000, "<p>a</p>", "<p>a</p>", "", "once", None]
    out = [(i * 7 % 10, f"http://h{i}.org/a b\r\nX: {i}\x7f", t, "clash", i, None) for i, t in enumerate(html)]
    return out + [(3, None, "<p>a</p>", None, None, None), (3, None, "<p>a</p>", None, None, None), (None, "u", "<p>a</p>", None, None, None), (None, "u", "lone", None, None, None), (None, "u", "lone", None, None, None)]


def brute(pages, least=0):
    data = [(p, (h or "").encode()) for p, _, h, *_ in pages]
    first = {}
    for p, b in data:
        if p is not None and len(b) >= least:
            first[b] = min(p, first.get(b, p))
    out = []
    for p, b in data:
        again = b in first and (p is None or p > first[b])
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[b] if again else None))
    return sorted(out, key=str)


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip_equals_brute_force(spark, tmp_path, least):
    df = spark.createDataFrame(rows(), PAGES).repartition(4)
    warc.archived(df, f"file://{tmp_path}/a", least)
    got = warc.read_pages(spark, f"file://{tmp_path}/a")
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert plain(got) == brute(rows(), least)
    back = spark.read.format("warc").load(f"file://{tmp_path}/a")
    texts = {(r.record_id, bytes(r.payload)) for r in back.where("record_type = 'response'").collect()}
    assert ("<urn:page:8>", b"x" * 300_000) in texts and ("<urn:page:1>", "é\x00\r\n\r\nWARC/1.1\r\n".encode()) in texts
    assert back.where("record_id = '<urn:page:7>'").first().target_uri == "http://h1.org/a%20b%0D%0AX:%201%7F"


def test_archives_are_plain_gzip_with_all_parts(spark, tmp_path):
    warc.archived(spark.createDataFrame(rows()[:4], PAGES).coalesce(1), str(tmp_path / "a"))
    text = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("*.warc.gz"))
    assert text.count(b"WARC/1.1\r\nWARC-Type: ") == 4 and text.count(b"WARC-Type: revisit") == 1
    assert b"WARC-Refers-To: <urn:page:4>" in text or b"WARC-Refers-To: <urn:page:7>" in text


def test_filters_reach_the_reader_and_payloads_stay_packed(spark, tmp_path):
    warc.archived(spark.createDataFrame(rows(), PAGES).coalesce(1), f"{tmp_path}/a")
    warc.registered(spark)
    df = spark.read.format("warc").load(f"{tmp_path}/a")
    some = df.where("record_type = 'revisit' and target_uri like 'http://h%' and length(record_id) > 3")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "length(record_id" in plan.split("BatchScan")[0] and "EqualTo" not in plan.split("BatchScan")[0]
    assert some.count() == df.where(F.col("record_type") == "revisit").where(F.col("target_uri").isNotNull()).where("target_uri <> 'u'").count() > 0
    assert df.where("payload = cast('once' as binary)").count() == 1  # not on headers: left to Spark
    assert df.where("payload_length >= 300000 and refers_to is null").count() == 1
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("warc").schema("record_type string, size int").load(f"{tmp_path}/a").collect()


class Counted(io.BytesIO):
    taken = 0

    def read(self, n=-1):
        got = super().read(n)
        self.taken += len(got)
        return got

    def size(self):
        return len(self.getvalue())


def archive(sized=True):
    """Three records of which the second is large and does not shrink."""
    noise = bytes(zlib.crc32(i.to_bytes(4, "little")) & 255 for i in range(400_000))
    made = [warc.record_bytes({"record_type": "response", "record_id": str(i), "payload": p}) for i, p in enumerate([b"one", noise, b"three"])]
    return (b"".join(warc._member(m, 6) if sized else gzip.compress(m) for m in made), made, noise)


def test_payloads_are_skipped_without_reading_them(monkeypatch):
    data, made, noise = archive()
    monkeypatch.setattr(warc, "READ_BYTES", 4096)
    file = Counted(data)
    got = list(warc.records(file, True, [Not(EqualTo(("record_id",), "1"))], True))
    assert [r["payload"] for r in got] == [b"one", b"three"] and file.taken < 40_000
    file = Counted(data)
    assert [r["payload_length"] for r in warc.records(file, True, [], False)] == [3, len(noise), 5] and file.taken < 40_000
    for packed, other in ((True, archive(sized=False)[0]), (False, b"".join(made))):
        got = list(warc.records(Counted(other), packed, [], True))
        assert [r["payload"] for r in got] == [b"one", noise, b"three"]
        assert [r["record_id"] for r in warc.records(Counted(other), packed, [In(("record_id",), ("0", "2"))], False)] == ["0", "2"]


def test_other_writers_records():
    block = b"fetched by test\r\n"
    text = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Type: application/warc-fields\r\nX-Long: a\r\n b\r\nContent-Length: 17\r\n\r\n" + block + b"\r\n\r\n"
    (one,) = warc.records(Counted(text), False, [IsNull(("refers_to",)), StringStartsWith(("record_type",), "warc")], True)
    assert one["payload"] == block and one["payload_length"] == 17 and one["record_id"] is None
    with pytest.raises(ValueError, match="no gzip member"):
        list(warc.records(Counted(text), True, [], True))
    with pytest.raises(ValueError, match="shorter"):
        list(warc.records(Counted(text[:-12]), False, [], True))


def test_unknown_values_pass_no_filter():
    record = {"record_type": "response", "refers_to": None}
    assert warc.holds(EqualTo(("refers_to",), "x"), record) is None and warc.holds(Not(EqualTo(("refers_to",), "x")), record) is None
    assert not warc._pushed(EqualTo(("payload",), b"")) and not warc._pushed(In(("refers_to",), ("a", None))) and warc._pushed(Not(IsNull(("date",))))


def test_files_are_rolled_dealt_out_and_listed(spark, tmp_path):
    pages = spark.range(200).selectExpr("id AS page_id", "'u' AS url", "sha2(cast(id AS string), 512) AS html").coalesce(2)
    warc.registered(spark)
    records = warc.page_records(pages)
    records.coalesce(2).write.format("warc").option("fileBytes", 5000).mode("append").save(f"{tmp_path}/a")
    files = list((tmp_path / "a").glob("*.warc.gz"))
    assert len(files) > 8
    df = spark.read.format("warc").option("taskBytes", 12_000).load(f"{tmp_path}/a")
    assert df.count() == 200 and 2 < df.select("record_id", F.spark_partition_id().alias("p")).select("p").distinct().count() < len(files)
    (tmp_path / "a" / "part-lost.warc.gz").write_bytes(b"half a rec")  # of a task that was not committed
    assert df.count() == 200
    records.write.format("warc").mode("append").save(f"{tmp_path}/a")
    assert spark.read.format("warc").load(f"{tmp_path}/a").count() == 400
    records.limit(3).write.format("warc").mode("overwrite").save(f"{tmp_path}/a")
    assert spark.read.format("warc").load(f"{tmp_path}/a").count() == 3


def test_empty_table(spark, tmp_path):
    assert warc.archived_pages(spark.createDataFrame([], PAGES)).collect() == []
    reader = warc.WarcReader(str(tmp_path), warc.StructType(), 1)
    assert [p.names for p in reader.partitions()] == [[]] and list(reader.read(reader.partitions()[0])) == []
    assert isinstance(pa.schema([("payload", pa.binary())]), pa.Schema)
