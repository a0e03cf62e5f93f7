import gzip
import io

from sigdiff.llm import common, warc

PAGES = "page_id long, url string, html string, payload string, digest string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)


def round_trip(spark, df, **more):
    path = common.shared_dir(spark, "warc")
    warc.write_archives(df, path, **more)
    return path, warc.read_archives(spark, path).collect()


def test_round_trip_and_revisits(spark):
    big, odd = "x\r\n\r\nWARC/1.1\r\né" * 200, "<p>\x00\x1f </p>" * 100
    rows = [(i, f"http://h/{i} a\r\nb", big) for i in range(30)] + [(40, None, "short"), (41, "u", "short"), (42, "u", None), (43, "u", ""), (44, "u", odd)]
    path, got = round_trip(spark, pages(spark, rows))
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.intact is not False for r in got)
    assert by[29].record_type == "response" and by[29].resolved_page_id is None
    assert all(by[i].record_type == "revisit" and by[i].resolved_page_id == 29 and by[i].payload_bytes == len(big.encode()) for i in range(29))
    assert all(by[i].record_type == "response" for i in range(40, 45))
    assert by[42].payload_bytes == 0 and by[0].url == "http://h/0%20a%20%20b"


def test_archive_is_plain_warc(spark):
    path, _ = round_trip(spark, pages(spark, [(1, "http://a", "hello" * 300), (2, "http://b", "hello" * 300)]), date="2024-01-02T03:04:05Z")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    found = [x for r in raw for x in warc.parse(io.BytesIO(gzip.decompress(r.content)))]
    kinds = {f["page-id"]: (f, b) for f, b in found}
    assert kinds["2"][1].endswith(b"hello") and kinds["1"][1].endswith(b"\r\n\r\n")
    assert kinds["1"][0]["warc-refers-to"] == kinds["2"][0]["warc-record-id"]
    assert kinds["1"][0]["warc-date"] == "2024-01-02T03:04:05Z"


def test_null_ids_ties_and_empty_table(spark):
    t = "t" * 2000
    _, got = round_trip(spark, pages(spark, [(None, "u", t), (7, "u", t), (7, "v", t), (None, None, None), (8, "w", "z" * 1500)]))
    assert sorted((r.page_id or 0, r.record_type, r.resolved_page_id or 0) for r in got) == [(0, "response", 0), (0, "revisit", 7), (7, "response", 0), (7, "response", 0), (8, "response", 0)]
    _, got = round_trip(spark, pages(spark, []))
    assert got == []


def test_rows_that_refer_to_nothing_stay_out_of_the_join(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a", "x" * 5000), (2, "http://b", "x" * 5000)], "page_id long, url string, html string")
    warc.write_archives(pages, f"file://{tmp_path}/w")
    got = warc.read_archives(spark, f"file://{tmp_path}/w")
    assert "Union" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.record_type, r.page_id == r.resolved_page_id, r.resolved_page_id is None) for r in got.collect() if r.record_type in ("response", "revisit")) == [("response", False, True), ("revisit", False, False)]


def test_files_are_cut_by_bytes(spark):
    rows = [(i, "u", f"{i} " + "x" * n) for i, n in enumerate([10] * 300 + [40_000] * 30 + [3_000_000] * 3)]
    path, got = round_trip(spark, pages(spark, rows).coalesce(1), file_bytes=4_000_000)
    assert sorted(r.page_id for r in got) == list(range(len(rows))) and all(r.intact for r in got)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).collect()
    sizes = [sum(len(b) for _, b in warc.parse(io.BytesIO(gzip.decompress(r.content)))) for r in raw]
    assert max(sizes) < 4_000_000 and sum(s > 2_000_000 for s in sizes) == 3


def test_shuffled_where_revisits_are_many(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_HEADS", 0)
    test_round_trip_and_revisits(spark)
