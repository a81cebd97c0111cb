"""Growing files, cut and rotated ones, piped input, and the command line on them."""

import io
import os

from pyspark.sql import functions as F

from embermill.sources.tail import TailReader, last_line_end, tail_lines
from embermill.sources.text import read_pipe


def taken(spark, name):
    return sorted(r[0] for r in spark.sql(f"SELECT raw FROM {name}").collect())


def test_growth_truncation_rotation(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\r\ntwo\nthr")
    lines = tail_lines(spark, [str(tmp_path / "*.log")], from_start=True)
    q = lines.writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        def now():
            q.processAllAvailable()
            return taken(spark, "tailed")

        want = ["one", "two"]
        assert now() == sorted(want)
        with open(log, "ab") as f:
            f.write(b"ee\n\xff odd\nfo")
        want += ["three", "� odd"]
        assert now() == sorted(want)
        with open(log, "r+b") as f:  # cut in place
            f.truncate(0)
            f.write(b"five\n")
        want += ["five"]
        assert now() == sorted(want)
        with open(log, "ab") as f:
            f.write(b"six\nlast of it")
        os.rename(log, tmp_path / "a.log.1")  # rotated before anyone looked
        log.write_bytes(b"seven\n")
        want += ["six", "last of it", "seven"]
        assert now() == sorted(want)
        (tmp_path / "b.log").write_bytes(b"eight\n")
        want += ["eight"]
        assert now() == sorted(want)
    finally:
        q.stop()
    # the same place again after a restart
    with open(log, "ab") as f:
        f.write(b"nine\n")
    again = []
    lines.writeStream.foreachBatch(lambda d, _: again.extend(r["raw"] for r in d.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert again == ["nine"]


def test_pieces_hold_each_line_once(tmp_path):
    path = tmp_path / "x.log"
    text = [("x" * (i * 7 % 23)) for i in range(200)]
    path.write_text("\n".join(text) + "\nopen")
    for piece in (1, 5, 64, 1 << 20):
        r = TailReader([str(path)], True, piece)
        start = r.initialOffset()
        end = r.latestOffset()
        got = [raw for p in r.partitions(start, end) for _, raw in r.read(p)]
        assert got == text
    assert last_line_end(str(path), 0, path.stat().st_size, block=3) == path.stat().st_size - 4
    assert TailReader([str(path)], False, 9).initialOffset()[str(path)]["end"] == path.stat().st_size
    assert TailReader([str(tmp_path / "none")], False, 9).initialOffset() == {}


def test_piped_lines(spark):
    rows = [b"a\r\n", b"\n", b"b" * 100_000 + b"\n", b"no end"]
    for size in (1, 1 << 20):
        got = read_pipe(spark, iter(rows), batch_bytes=size).orderBy("line").collect()
        assert [r["raw"] for r in got] == ["a", "", "b" * 100_000, "no end"] and {r["source_name"] for r in got} == {"stdin"}
    assert read_pipe(spark, iter([])).count() == 0


def test_command_line_reads_a_pipe(spark, tmp_path):
    from embermill.cli import main

    (tmp_path / "in").write_text("".join(f"2024-03-15T10:00:{i:02d}Z WARN [io] slow write {i}\n" for i in range(9)))
    out = io.StringIO()
    with open(tmp_path / "in") as source:
        assert main(["--json"], out, source) == 0
    lines = out.getvalue().strip().split("\n")
    assert len(lines) == 10 and '"severity":"warn"' in lines[0] and '"events_total": 9' in lines[-1]


def test_command_line_follows(spark, tmp_path):
    from embermill import cli

    log = tmp_path / "a.log"
    log.write_text("2024-03-15T10:00:00Z INFO [io] old line\n")
    args = cli.build_parser().parse_args(["-f", "-s", "--json", str(log)])
    out = io.StringIO()
    f = cli.Follow(spark, [str(log)], cli.predicate(args, "errors"), args, None, out)
    q = f.start()
    try:
        q.processAllAvailable()
        with open(log, "a") as more:
            more.write("2024-03-15T10:00:01Z ERROR [io] new line\n")
        q.processAllAvailable()
    finally:
        q.stop()
    f.report()
    lines = out.getvalue().strip().split("\n")
    assert len(lines) == 2 and "new line" in lines[0] and '"events_total": 2' in lines[1]
