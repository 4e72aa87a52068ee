from pyspark.sql import functions as F

from lorekiln.sources import readers, sinks
from lorekiln.streaming import feedback


def test_files_and_inventories(spark, tmp_path):
    (tmp_path / "docs" / "sub").mkdir(parents=True)
    (tmp_path / "docs" / "a.pdf").write_bytes(b"same")
    (tmp_path / "docs" / "sub" / "b.PDF.pdf").write_bytes(b"same")
    (tmp_path / "docs" / "c.txt").write_bytes(b"page one\fpage two")
    files = readers.file_hashes(spark, str(tmp_path / "docs"))
    assert files.count() == 2 and files.select("file_hash").distinct().count() == 1
    pages = readers.text_pages(readers.scan_files(spark, str(tmp_path / "docs"), ["txt"], content=True))
    assert sorted((r.page_no, r.text) for r in pages.collect()) == [(1, "page one"), (2, "page two")]
    head = readers.INVENTORY.replace(" string", "").replace(" ", "")
    (tmp_path / "inv.csv").write_text(head + "\n" + ",".join(["x"] * 8 + [" good_text ", "m", "1", "/p"]) + "\n" + ",".join(["y"] * 12) + "\n")
    rows = readers.inventory(spark, str(tmp_path / "inv.csv"), "good_text")
    assert [r.path for r in rows.collect()] == ["/p"] and readers.paths_of(rows, files).count() == 3


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, '{"token": "s3"}'), ("b", 2, "{}")], "k string, v int, packet string")
    manifest = sinks.review_packs(df, str(tmp_path / "packs"), ["k"])
    assert {r.k: r.n_candidates for r in manifest.collect()} == {"a": 1, "b": 1}
    sinks.replace_partitions(df, str(tmp_path / "t"), ["k"])
    sinks.replace_partitions(df.where("k = 'a'").withColumn("v", F.lit(9)), str(tmp_path / "t"), ["k"])
    assert {r.k: r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {"a": 9, "b": 2}
    sinks.audit_lines(df, "packet", str(tmp_path / "audit"))
    assert "s3" not in "".join(r.value for r in spark.read.text(str(tmp_path / "audit")).collect())
    sinks.csv_report(df, str(tmp_path / "csv"))
    sinks.json_lines(df, str(tmp_path / "json"))
    assert readers.json_lines(spark, str(tmp_path / "json")).count() == 2
    assert sinks.markdown_table(df.orderBy("k")).splitlines()[2] == '| a | 1 | {"token": "s3"} |'


def test_stream_keeps_each_event_once_over_restarts(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    first = spark.sql("SELECT 'k1' AS event_key, timestamp'2024-01-01' AS ts UNION ALL SELECT 'k1', timestamp'2024-01-02' UNION ALL SELECT 'k2', timestamp'2024-01-02'")
    first.write.parquet(src)
    stream = lambda: feedback.once(feedback.event_stream(spark, src, first.schema))
    feedback.run_to_end(stream(), "append", out, state)
    spark.sql("SELECT 'k2' AS event_key, timestamp'2024-01-03' AS ts UNION ALL SELECT 'k3', timestamp'2024-01-03'").write.mode("append").parquet(src)
    feedback.run_to_end(stream(), "append", out, state)
    assert sorted(r.event_key for r in spark.read.parquet(out).collect()) == ["k1", "k2", "k3"]
