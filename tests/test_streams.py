"""Streams over two batches with a restart between them, and the batch forms they agree with."""

from random import Random

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import intake, review, segment
from clauseloom.sources.readers import read_files
from clauseloom.streaming import streams

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield spark
    spark.conf.set(key, before)


def drain(stream, path, mode):
    """All that is there now, appended to a table; returns its rows so far."""
    query = stream.writeStream.outputMode(mode).foreachBatch(lambda df, n: df.withColumn("b", F.lit(n)).write.mode("append").parquet(f"{path}/out")).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return stream.sparkSession.read.parquet(f"{path}/out").collect()


def feed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return spark.readStream.schema(schema).parquet(f"{path}/in")


def split(batch):
    found, dropped = segment.clauses(batch.select(F.col("path").alias("doc_id"), "text"), loose=True)
    return {"clauses": found, "dropped": dropped}


def test_new_files_are_read_once(spark, tmp_path):
    folder, at = tmp_path / "files", f"file://{tmp_path}"
    folder.mkdir()
    (folder / "a.txt").write_text("1. Branches shall count the vault each morning.")
    (folder / ".hidden.txt").write_text("x")
    (folder / "z.bin").write_bytes(b"x")

    def run():
        streams.run_new(streams.new_files(spark, f"file://{folder}"), split, f"{at}/out", f"{at}/state", "path").awaitTermination(120)
        return sorted(r.text for r in streams.completed(spark, f"{at}/out", "clauses").collect())

    first = ["1. Branches shall count the vault each morning."]
    assert run() == first and run() == first
    (folder / "b.TXT").write_text("2. Staff must not lend their keys to anyone.")
    assert run() == [*first, "2. Staff must not lend their keys to anyone."]
    assert {r.name for r in read_files(spark, f"file://{folder}").collect()} == {"a.txt", "b.TXT"}


def test_failed_batch_adds_nothing_twice(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([("p", "1. Branches shall count the vault each morning.")], "path string, text string")
    sink = streams.completed_sink(split, out, "path")

    def broken(batch):
        return split(batch) | {"more": batch.select(F.raise_error(F.lit("lost")).alias("x"))}

    with pytest.raises(Exception, match="lost"):
        streams.completed_sink(broken, out, "path")(rows, 0)
    assert streams.completed(spark, out, "clauses").collect() == []  # written, but not complete
    for _ in range(3):
        sink(rows, 0)
    sink(rows.withColumn("path", F.lit("q")), 1)
    assert sorted(r.doc_id for r in streams.completed(spark, out, "clauses").collect()) == ["p", "q"]
    assert {r.path for r in spark.read.parquet(f"{out}/completed").collect()} == {"p", "q"}


def test_reissues_over_batches(rocks, tmp_path):
    schema = "filename string, doc_id long, parent_id long, status string"
    path = f"file://{tmp_path}"
    one = [("a", 1, None, "ingested"), ("a", 3, None, "ingested"), ("b", 2, None, "ingested"), ("b", 4, 2, "ingested"), ("c", 5, None, "error")]
    two = [("a", 9, None, "ingested"), ("a", 3, None, "ingested"), ("b", 8, None, "ingested"), ("c", 7, None, "ingested"), ("b", 10, None, "ingested")]
    got = {(r.doc_id, r.supersedes) for r in drain(streams.reissues(feed(rocks, path, one, schema)), path, "append")}
    assert got == {(3, 1)}
    got = {(r.doc_id, r.supersedes) for r in drain(streams.reissues(feed(rocks, path, two, schema)), path, "append")}
    batch = intake.reissues(rocks.createDataFrame(one + two, schema).distinct(), eligible=F.expr("parent_id is null and status = 'ingested'"))
    assert got == {(r.doc_id, r.supersedes) for r in batch.collect() if r.supersedes} == {(3, 1), (9, 3), (8, 2), (10, 8)}


def test_review_states_over_batches(spark, tmp_path):
    rng, schema, path = Random(2), "proposal_id long, seq long, level int, decision string", f"file://{tmp_path}"
    events = [(rng.randrange(12), k, rng.randrange(1, 3), rng.choice(["Approved", "Approved", "Rejected", "Sent back"])) for k in range(300)]
    events += [(99, k, 1 + k % 2, "Sent back" if k % 2 else "Approved") for k in range(20_001)]
    drain(streams.review_states(feed(spark, path, events[:200], schema)), path, "update")
    rows = drain(streams.review_states(feed(spark, path, events[200:], schema)), path, "update")
    last = {r.proposal_id: r.status for r in sorted(rows, key=lambda r: r.b)}

    def plain(log):
        status, taken = "Pending review", 0
        for _, level, decision in sorted(log):
            takes = status in ("Pending review", "Changes requested") if level == 1 else status == "Pending approval"
            taken += takes
            if takes:
                status = {"Approved": "Pending approval" if level == 1 else "Approved", "Rejected": "Rejected"}.get(decision, "Changes requested")
        return status, taken, len(log) - taken

    want = {p: plain([e[1:] for e in events if e[0] == p]) for p in {e[0] for e in events}}
    assert last == {p: w[0] for p, w in want.items()}
    got = review.current_status(spark.createDataFrame(events, schema))
    assert {r.proposal_id: (r.status, r.accepted, r.ignored) for r in got.collect()} == want
    assert "collect_list(seq" not in got._jdf.queryExecution().toString()
    assert review.current_status(spark.createDataFrame([], schema)).collect() == []


def test_content_weeks_and_sessions(spark, tmp_path):
    schema = "doc_id long, text string, arrived timestamp, ts timestamp, event_type string, user_id long"
    at = lambda s: F.lit(s).cast("timestamp")
    make = lambda rows: [(i, t, None, None, e, u) for i, t, e, u in rows]
    path, times = f"file://{tmp_path}", {0: "2025-03-03 00:10:00", 1: "2025-03-03 00:20:00", 2: "2025-03-10 09:00:00", 3: "2025-03-20 09:00:00", 4: "2025-04-20 09:00:00"}

    def push(name, rows):
        when = F.lit(None).cast("timestamp")
        for i, t in times.items():
            when = F.when(F.col("doc_id") == i, at(t)).otherwise(when)
        spark.createDataFrame(make(rows), schema).withColumn("arrived", when).withColumn("ts", when).coalesce(1).write.mode("append").parquet(f"{path}/{name}/in")
        return spark.readStream.schema(schema).parquet(f"{path}/{name}/in")

    for name, build, mode in (("c", streams.new_content, "append"), ("w", streams.weekly_counts, "append"), ("s", streams.sessions, "append")):
        drain(build(push(name, [(0, "x", "view", 1), (1, "x", "view", 1), (2, "y", "view", 1)])), f"{path}/{name}", mode)
        rows = drain(build(push(name, [(3, "z", "buy", 2), (4, "x", "view", 1)])), f"{path}/{name}", mode)
        if name == "c":
            assert sorted(r.text for r in rows) == ["x", "y", "z"]  # the state of x is held while the batches before have not passed it
        elif name == "w":
            got = {(str(r.week)[:10], r.event_type, r.n) for r in rows}
            assert {("2025-03-03", "view", 2), ("2025-03-10", "view", 1)} <= got
        else:
            got = {(r.user_id, str(r.start)[:16], r.n) for r in rows}
            assert {(1, "2025-03-03 00:10", 2), (1, "2025-03-10 09:00", 1)} <= got
