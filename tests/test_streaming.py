import datetime
import hashlib
import time

from pyspark.sql import functions as F

from sigdiff import pipeline, sources
from sigdiff import streaming as st
from tests import test_whole as w

SF = "/root/testdata/sf0.001"


def events(spark):
    return spark.read.parquet(f"{SF}/events.parquet").select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("level"), (F.col("value") >= 50).alias("pulse"))


def as_stream(spark, tmp_path):
    path = str(tmp_path / "in")
    df = events(spark)
    df.repartition(2).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finished(query):
    query.awaitTermination(120)
    time.sleep(0.1)


def test_live_levels_equal_batch(spark, tmp_path):
    out = str(tmp_path / "out")
    q = st.live_levels(as_stream(spark, tmp_path), "1 hour", delay="0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finished(q)
    got = {(r.source, r.w.start): (r.n, r.peak, r.floor) for r in spark.read.parquet(out).collect()}
    want = {(r.source, r.w.start): (r.n, r.peak, r.floor) for r in events(spark).groupBy("source", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.max("level").alias("peak"), F.min("level").alias("floor")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 0.9 * len(want)


def test_incremental_compare(spark, tmp_path):
    q = st.stream_compare(as_stream(spark, tmp_path), lambda b: {"pulses": b.where("pulse").groupBy("source").count()}, str(tmp_path / "out"), str(tmp_path / "c"))
    finished(q)
    assert spark.read.parquet(str(tmp_path / "out/pulses")).agg(F.sum("count")).first()[0] == events(spark).where("pulse").count()


def test_train_machine():
    state, found = (False, 0, 0, None), []
    for t, p in enumerate([0, 1, 1, 0, 0, 1, 0, 1, 0, 0, 0, 0, 1, 0, 1, 0]):
        *state, done = st.advance(*state, t, bool(p), 2, 3)
        if done is not None:
            found.append(done)
    assert found == [1, 12]


def test_a_file_of_known_content_is_not_read_twice(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a", b"one"), ("b", b"two"), ("c", b"one")):
        (tmp_path / "in" / f"{name}.wav").write_bytes(content)
    spark.conf.set("spark.sql.streaming.schemaInference", "true")
    stream = st.archive_stream(spark, f"{tmp_path}/in/*.wav")
    go = lambda: finished(st.stream_compare(stream, lambda b: {"files": b.select("content_hash")}, str(tmp_path / "out"), str(tmp_path / "c")))
    go()
    (tmp_path / "in" / "d.wav").write_bytes(b"two")
    (tmp_path / "in" / "e.wav").write_bytes(b"three")
    go()
    assert sorted(r.content_hash for r in spark.read.parquet(str(tmp_path / "out/files")).collect()) == sorted(hashlib.sha256(b).hexdigest() for b in (b"one", b"three", b"two"))


def test_archive_is_compared_as_it_grows(spark, tmp_path):
    refs, folder = {"ref": ("plain", w.RATE, w.signal("plain"))}, tmp_path / "in"
    folder.mkdir()
    recordings, chunks, modes, types, _, profiles = w.archive(spark, refs, [("ref", "ref")])
    (tmp_path / "ref.wav").write_bytes(w.wav(refs["ref"][2]))
    own, files, _ = sources.recording_files(spark, f"{tmp_path}/*.wav")
    describe = lambda df: df.withColumn("profile_id", F.lit("plain")).withColumn("mode_no", F.lit(0))
    standing = pipeline.standing_references(describe(own), files, modes, types, w.O, profiles)
    out, put = str(tmp_path / "out"), lambda name, x: (folder / f"{name}.wav").write_bytes(w.wav(x))
    go = lambda: finished(st.compare_archive(spark, f"{folder}/*.wav", describe, standing, modes, types, w.O, out, str(tmp_path / "c"), profiles))
    put("one", w.signal("plain", gains=(0.5, 0.5)))
    put("two", w.signal("plain", lead=0.4))
    put("copy", w.signal("plain", lead=0.4))
    go()
    (folder / "bad.wav").write_bytes(b"RIFF")
    put("three", w.signal("plain", lead=0.35))
    go()
    read = lambda name: spark.read.parquet(f"{out}/{name}")
    names = {r.recording_id for r in read("bounds").collect()}
    assert names - {"two", "copy"} == {"one", "three"} and len(names) == 3 and [r.recording_id for r in read("rejects").collect()] == ["bad"]
    got = sorted(map(str, read("matched").drop("batch").collect()))
    assert {r.pair_id.split("-")[1] for r in read("matched").select("pair_id").distinct().collect()} == names
    assert read("matched").where("ref_amplitude > -35").agg(F.max(F.abs("diff_amplitude"))).first()[0] < 0.1
    # the last batch again, as if the driver had been lost before it was noted as done
    commits = sorted((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda f: int(f.name))
    commits[-1].unlink()
    (tmp_path / "c" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    go()
    assert sorted(map(str, read("matched").drop("batch").collect())) == got


def row_by_row(rows, pulses, longest, gap):
    """Trains of one source's (ts, pulse), an observation at a time."""
    on, length, count, start, last, found = False, 0, 0, None, None, []
    for ts, pulse in rows:
        if last is not None and ts - last > gap:
            on, length, count, start = False, 0, 0, None
        last = ts
        if pulse == on:
            length += 1
            if length > longest:
                count, start = 0, None
            continue
        if pulse:
            start = ts if count == 0 else start
        else:
            count += 1 if start is not None and length <= longest else 0
            if count == pulses:
                found.append((start, ts))
                count, start = 0, None
        on, length = pulse, 1
    return found


def test_trains_of_runs_equal_those_of_rows(spark):
    df = events(spark).select("source", "ts", "pulse")
    by = {}
    for r in df.orderBy("source", "ts", "pulse").collect():
        by.setdefault(r.source, []).append((r.ts, r.pulse))
    for pulses, longest, gap, hours in ((3, 4, "20 hours", 20), (2, 1, "3 days", 72), (2, 2, "5 hours", 5)):
        want = sorted((k, *f) for k, rows in by.items() for f in row_by_row(rows, pulses, longest, datetime.timedelta(hours=hours)))
        assert sorted(tuple(r) for r in st.pulse_trains(df, pulses, longest, gap).collect()) == want and want


def test_live_trains_equal_batch_out_of_order(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = str(tmp_path / "in")
    df = events(spark).select("source", "ts", "pulse")
    # files in order of time but for up to a day, by which rows are early or late
    late = (F.unix_timestamp("ts") + F.pmod(F.xxhash64("ts", "source"), F.lit(43200))).alias("_t")
    cuts = df.select(late).selectExpr("percentile_approx(_t, array(0.25, 0.5, 0.75)) AS c").first().c
    for k, (low, high) in enumerate(zip([0, *cuts], [*cuts, 2**40], strict=True)):
        df.where((late > low) & (late <= high)).coalesce(1).write.parquet(f"{path}/{k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{path}/*")
    want = sorted(tuple(r) for r in st.pulse_trains(df, 3, 4, "20 hours").collect())
    last = df.agg(F.max("ts")).first()[0] - datetime.timedelta(days=1)
    out = str(tmp_path / "out")
    q = st.live_pulse_trains(stream, 3, 4, "20 hours", "1 day").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finished(q)
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert want and got == [r for r in want if r[2] <= last]


def test_sessions_as_a_stream(spark, tmp_path):
    out = str(tmp_path / "out")
    q = st.signal_sessions(as_stream(spark, tmp_path), "30 minutes", "0 seconds").writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    finished(q)
    want = {(r.source, r.w.start): r.n for r in st.signal_sessions(events(spark), "30 minutes").collect()}
    got = {(r.source, r.w.start): r.n for r in spark.read.parquet(out).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= 0.9 * len(want)
