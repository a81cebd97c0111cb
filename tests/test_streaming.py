"""Batch and stream give the same."""

from pyspark.sql import functions as F

from embermill.operators import traces
from embermill.operators.parsers import parse_events
from embermill.sources.text import read_lines, stream_lines
from embermill.streaming import jobs


def lines(n=60):
    return [f"ts=2024-03-15T10:{i // 60:02d}:{i % 60:02d}Z level=info msg=\"job {i} done\" trace_id=t{i % 3} n={i}" for i in range(n)]


def run(query, tmp_path, name, mode):
    q = query.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()


def test_windows_sessions_and_parsing(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(lines()) + "\n    at x\n")
    parsed = jobs.parsed_stream(stream_lines(spark, str(folder)), "logfmt")
    run(jobs.group_windows(parsed), tmp_path, "w", "complete")
    assert [tuple(r) for r in spark.sql("SELECT template, sum(count) FROM w GROUP BY 1").collect()] == [("job <*> done", 60)]
    run(jobs.trace_sessions(parsed), tmp_path, "s", "complete")
    got = sorted(map(tuple, spark.sql("SELECT trace_id, event_count FROM s").collect()))
    batch = parse_events(read_lines(spark, str(folder)).where("raw LIKE 'ts=%'"), F.lit("logfmt")).withColumn("seq", F.col("ts_nanos"))
    assert got == sorted(map(tuple, traces.trace_sessions(batch, 30).select("trace_id", "event_count").collect()))


def test_stateful_folds(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.log").write_text("\n".join(lines(10)))
    parsed = jobs.parsed_stream(stream_lines(spark, str(folder)), "logfmt").withColumn("seq", F.col("ts_nanos"))
    run(jobs.drain(parsed, idle_ms=None), tmp_path, "d", "append")
    assert {r[0] for r in spark.sql("SELECT template FROM d").collect()} == {"job <*> done"}
    ticks = parsed.select(F.lit("all").alias("series"), F.col("seq").alias("tick"), F.when(F.col("message") == "job 9 done", 500.0).otherwise(F.length("message") + F.col("ts_nanos") / 1e9 % 2).alias("sample"))
    run(jobs.detect(ticks, warmup=5, idle_ms=None), tmp_path, "z", "append")
    assert [r[0] for r in spark.sql("SELECT kind FROM z").collect()] == ["rate_spike"]
