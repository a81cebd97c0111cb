"""Command line: triage of log files, as event rows, patterns, traces or one JSON summary."""

from __future__ import annotations

import argparse
import json
import os
import stat
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from embermill import __version__
from embermill.operators import filters, groups, traces
from embermill.plans import render
from embermill.plans.engine import Intervals, Triage
from embermill.sources.tail import tail_lines
from embermill.sources.text import read_lines, read_pipe, with_seq
from embermill.sources.work import work_dir
from embermill.streaming.jobs import parsed_stream


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="embermill", description="Triage of log files with Spark.")
    p.add_argument("inputs", nargs="*", help="files or globs; anything else is a query in words")
    p.add_argument("--raw", action="store_const", dest="mode", const="raw", default="pattern")
    p.add_argument("--trace", action="store_const", dest="mode", const="trace")
    p.add_argument("--incident", action="store_const", dest="mode", const="incident")
    p.add_argument("--json", action="store_true", help="event rows and a summary as JSON lines")
    p.add_argument("-l", "--level", choices=("trace", "debug", "info", "warn", "error", "fatal"))
    p.add_argument("-g", "--grep", action="append", default=[])
    p.add_argument("--service")
    p.add_argument("--trace-id")
    p.add_argument("--field", action="append", default=[], metavar="KEY=VALUE")
    p.add_argument("--last", metavar="15m")
    p.add_argument("-f", "--follow", action="store_true")
    p.add_argument("-s", "--from-start", action="store_true")
    p.add_argument("-n", "--no-follow", action="store_true")
    p.add_argument("--no-color", action="store_true")
    p.add_argument("--ring-size", type=int, default=65_536)
    p.add_argument("-V", "--version", action="version", version=__version__)
    return p


def predicate(args: argparse.Namespace, words: str = "") -> filters.Predicate:
    out = [filters.clause("message_contains", g) for g in args.grep]
    if args.service:
        out.append(filters.clause("service_eq", args.service))
    if args.trace_id:
        out.append(filters.clause("trace_id_eq", args.trace_id))
    for pair in args.field:
        key, _, value = pair.partition("=")
        out.append(filters.clause("field_eq", key, value))
    both = filters.Predicate(tuple(out))
    return both + filters.parse_intent(words) if words else both


def _is_path(text: str) -> bool:
    return any(c in text for c in "/*?.") and " " not in text


def piped(stream) -> bool:
    """Whether something was piped or redirected into ``stream``."""
    try:
        mode = os.fstat(stream.fileno()).st_mode
    except (AttributeError, OSError, ValueError):
        return False
    return stat.S_ISFIFO(mode) or stat.S_ISREG(mode) or stat.S_ISSOCK(mode)


def main(argv: list[str] | None = None, out=None, source=None) -> int:
    out, source = out or sys.stdout, source or sys.stdin
    args = build_parser().parse_args(argv)
    paths = [x for x in args.inputs if _is_path(x)]
    words = " ".join(x for x in args.inputs if x != "-" and not _is_path(x))
    if not paths and "-" not in args.inputs and not piped(source):
        print("no input files", file=sys.stderr)
        return 2
    seconds = filters.parse_duration(args.last) if args.last else None
    if args.last and seconds is None:
        print(f"not a duration: {args.last}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("embermill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    test = predicate(args, words)
    if paths and args.follow and not args.no_follow:
        following = Follow(spark, paths, test, args, seconds, out)
        try:
            following.start().awaitTermination()
        except KeyboardInterrupt:
            following.query.stop()
        following.report()
        return 0
    if paths:
        lines = read_lines(spark, paths).withColumn("line", F.monotonically_increasing_id())
    else:
        lines = read_pipe(spark, getattr(source, "buffer", source))
    triage = triage_of(lines)
    show_events(triage.events(test, args.level, seconds), args, out)
    report(triage, args, out)
    return 0


def triage_of(lines: DataFrame) -> Triage:
    """Triage of (source_name, line, raw): numbered by source and line."""
    return Triage(with_seq(lines, "source_name", "line").withColumn("source_id", F.xxhash64("source_name")), Intervals())


def show_events(shown: DataFrame, args: argparse.Namespace, out) -> None:
    if args.mode == "incident":
        return
    color = not args.no_color and not args.json and out.isatty()
    rows = render.event_json(shown).orderBy("seq") if args.json else shown.select("severity", "message", "service", "seq").orderBy("seq")
    for r in rows.toLocalIterator():
        print(r["json"] if args.json else render.event_line(r["severity"], r["message"], r["service"], color), file=out)


def report(triage: Triage, args: argparse.Namespace, out) -> None:
    """What the mode shows after the events: a summary as JSON, or alerts, traces and groups."""
    if args.json:
        print(json.dumps(json.loads(triage.summary().select(F.to_json(F.struct("*")).alias("j")).first()["j"])), file=out)
        return
    if args.mode == "raw":
        return
    for a in triage.alerts().orderBy("alert_id").limit(128).collect():
        print(render.alert_banner(a), file=out)
    if args.mode == "trace":
        for t in triage.traces().orderBy(F.desc("event_count"), "trace_id").limit(20).collect():
            own = traces.trace_events(triage.parsed.where(F.col("trace_id") == t["trace_id"])).orderBy("place").collect()
            print(render.trace_tree(t["trace_id"], own), file=out)
    print(render.group_block(triage.top_groups().collect()), file=out)


class Follow:
    """Events of growing files as they come, and the mode's report over all of them when it ends.

    Each batch is written once, under its number, to the work folder: a batch that
    runs again replaces itself.
    """

    def __init__(self, spark: SparkSession, paths: list[str], test: filters.Predicate, args: argparse.Namespace, last_s: int | None, out):
        self.spark, self.test, self.args, self.last_s, self.out = spark, test, args, last_s, out
        self.path = f"{work_dir(spark)}/embermill/follow-{uuid.uuid4().hex}"
        self.lines = tail_lines(spark, paths, from_start=args.from_start)
        self.query = None
        self.batches = 0

    def start(self):
        self.query = self.lines.writeStream.foreachBatch(self._show).start()
        return self.query

    def _show(self, batch: DataFrame, n: int) -> None:
        numbered = batch.withColumn("line", F.monotonically_increasing_id() + F.lit(n) * F.lit(1 << 45))
        numbered.write.mode("overwrite").parquet(f"{self.path}/batch={n}")
        self.batches += 1
        kept = batch.sparkSession.read.schema(numbered.schema).parquet(f"{self.path}/batch={n}")
        events = parsed_stream(kept.withColumn("seq", F.col("line")).withColumn("source_id", F.xxhash64("source_name")))
        since = None
        if self.last_s is not None:
            since = filters.last(F.lit(groups.latest(events).first()["now"]), self.last_s)
        show_events(filters.display(events, self.test, self.args.level, since), self.args, self.out)

    def report(self) -> None:
        if self.batches:
            schema = "source_name string, raw string, line bigint"
            report(triage_of(self.spark.read.schema(schema).parquet(f"{self.path}/batch=*")), self.args, self.out)


if __name__ == "__main__":
    sys.exit(main())
