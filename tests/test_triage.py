"""Templates, filters, groups, detectors, correlation, traces and the engine."""

import datetime
import io
import math

from pyspark.sql import functions as F

from embermill.operators import anomaly, correlate, filters, groups, stats, templates, traces
from embermill.operators.filters import clause
from embermill.plans.engine import Intervals, Triage
from embermill.sources import text as src

UTC = datetime.timezone.utc
EVENT = "source_id bigint, seq bigint, ts timestamp, severity string, sev_num tinyint, message string, trace_id string, service string, template_hash decimal(20,0)"
LEVEL = {"trace": 0, "debug": 1, "info": 2, "warn": 3, "error": 4, "fatal": 5}


def at(s):
    return datetime.datetime.fromtimestamp(1_700_000_000 + s, UTC)


def make(spark, rows):
    """rows: (second, severity, message, trace, service, source)."""
    data = [(r[5], i, at(r[0]), r[1], LEVEL.get(r[1], 0), r[2], r[3], r[4], None) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, EVENT).withColumn("fields", F.array().cast("array<struct<key:string,value:struct<kind:string,s:string,i:bigint,f:double,b:boolean>>>"))


def fold(messages, threshold=0.5):
    """Scalar model of the cluster fold: (template after each message, final template of each)."""
    clusters, out, member = [], [], []
    for m in messages:
        toks = [t for t in m.replace("\t", " ").split(" ") if t][:64]
        toks = ["<*>" if any(c.isdigit() and c.isascii() for c in t) or (len(t) >= 2 and t[0] == t[-1] == '"') else t[:48] for t in toks]
        if not toks:
            out.append(""), member.append(None)
            continue
        best, same = None, -1
        for i, c in enumerate(clusters):
            if len(c) == len(toks):
                s = sum(a == b or "<*>" in (a, b) for a, b in zip(c, toks))
                if s > same and s >= threshold * len(toks):
                    best, same = i, s
        if best is None:
            clusters.append(toks)
            best = len(clusters) - 1
        else:
            clusters[best] = [a if a == b else "<*>" for a, b in zip(clusters[best], toks)]
        out.append(" ".join(clusters[best])), member.append(best)
    return out, ["" if i is None else " ".join(clusters[i]) for i in member]


def test_drain_matches_the_scalar_model(spark):
    import random

    r = random.Random(4)
    words = ["open", "close", "file", "user", "x1", "22", '"q"', "by", "at", "socket"]
    messages = [" ".join(r.choice(words) for _ in range(r.randint(0, 6))) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(messages)), "seq bigint, message string")
    emitted, final = fold(messages)
    for mode, want in (("as_emitted", emitted), ("final", final)):
        got = {x["seq"]: x["template"] for x in templates.drain_templates(rows.repartition(5), hash_mode=mode).collect()}
        assert [got[i] for i in range(len(messages))] == want


def test_template_pairs_and_hash(spark):
    same = ["Connection to 10.0.0.1:5432 timed out after 30s", "Connection to 10.0.0.2:5432 timed out after 45s", "User logged in successfully from dashboard", ""]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(same)], "i int, m string")
    t = [r["t"] for r in rows.withColumn("t", templates.template_hash(templates.template(F.col("m"))).cast("string")).orderBy("i").collect()]
    assert t[0] == t[1] == "15639819009333393357" and t[2] not in (t[0], "0") and t[3] == "0"


def test_filters_are_two_valued(spark):
    rows = make(spark, [(0, "error", "timeout", None, None, 0), (1, "info", "ok", "t", "payments", 0), (2, "debug", "slow", None, "x", 0)])

    def seqs(p):
        return sorted(r["seq"] for r in filters.display(rows, p).collect())

    assert seqs(filters.Predicate()) == [0, 1, 2]
    assert seqs(filters.all_of(clause("severity_gte", "warn"))) == [0]
    assert seqs(filters.all_of(~clause("service_eq", "payments"))) == [0, 2]
    assert seqs(filters.all_of(~clause("severity_eq", "debug"))) == [0, 1]
    assert seqs(filters.any_of(clause("severity_gte", "fatal"), clause("message_contains", "timeout"))) == [0]
    assert seqs(filters.all_of(~clause("field_gt", "n", 1.0))) == [0, 1, 2]
    assert seqs(filters.all_of(clause("message_contains", ""))) == [0, 1, 2]


def test_intent_grammar():
    kinds = lambda q: [(c.kind, *c.args) for c in filters.parse_intent(q).clauses]
    assert kinds("errors related to payments") == [("severity_gte", "error"), ("message_contains", "payment")]
    assert kinds("timeout") == [("message_contains", "timeout")]
    assert kinds("5xx from nginx") == [("severity_gte", "error"), ("service_eq", "nginx")]
    assert kinds("why are payments failing") == [("message_contains", "payment"), ("message_contains", "failing"), ("severity_gte", "error")]
    assert kinds("over 30s service:a") == [("service_eq", "a")] and kinds("from the x") == [("message_contains", "x")]
    assert filters.parse_duration("15m") == 900 and filters.parse_duration("15") is None


def test_groups_trend_and_score(spark):
    rows = make(spark, [(i, "info", f"job {i} done", None, "a", i % 2) for i in range(30)] + [(60, "error", "disk full", None, "b", 0)])
    got = {r["template"]: r for r in groups.scored_groups(rows, 60, 30.0).collect()}
    job, disk = got["job <*> done"], got["disk full"]
    assert (job["count"], job["source_count"], job["severity"], job["exemplar"]) == (30, 2, "info", "job 0 done")
    assert disk["count_short"] == 1 and disk["severity"] == "error" and disk["trend"] == "new"
    assert abs(disk["score"] - math.log2(2) * 5.0 * 1.5 * math.log2(2)) < 1e-9
    table = spark.createDataFrame([(0, 0), (10, 0), (30, 10), (10, 30), (20, 22)], "s int, p int")
    assert [r[0] for r in table.select(groups.trend(F.col("s"), F.col("p"))).collect()] == ["gone", "new", "rising", "falling", "stable"]


def model_cusum(xs, alpha):
    """Scalar model: (index, kind) of firings."""
    hi = lo = 0.0
    mean = None
    rest, seen, out = 0, [], []
    for i, x in enumerate(xs):
        seen.append(x)
        mean = x if mean is None else alpha * x + (1 - alpha) * mean
        if len(seen) < 30:
            continue
        if rest:
            rest -= 1
            continue
        m = sum(seen) / len(seen)
        sd = math.sqrt(sum((v - m) ** 2 for v in seen) / (len(seen) - 1))
        if sd == 0:
            continue
        n = (x - mean) / sd
        hi, lo = max(0, hi + n - 0.5), max(0, lo - n - 0.5)
        if hi > 5:
            out.append((i, "change_point_up"))
            hi, rest = 0, 30
        elif lo > 5:
            out.append((i, "change_point_down"))
            lo, rest = 0, 30
    return out


def test_cusum_matches_the_scalar_model(spark):
    xs = [100.0 + (i * 7 % 5) for i in range(50)] + [100.0 + 2 * i for i in range(100)] + [90.0 - i / 2 for i in range(80)]
    series = spark.createDataFrame(list(enumerate(xs)), "tick bigint, sample double")
    got = sorted((r["tick"], r["kind"]) for r in anomaly.cusum_anomalies(series).collect())
    want = model_cusum(xs, stats.ewma_alpha(300, 1))
    assert got == want and any(k == "change_point_up" for _, k in got)


def test_rate_detector_and_alerts(spark):
    quiet = spark.createDataFrame([(i, 100.0) for i in range(120)], "tick bigint, sample double")
    assert anomaly.rate_anomalies(quiet).count() == 0
    loud = [(i, 100.0 + (i * 37 % 11) - 5) for i in range(60)] + [(60, 500.0), (61, 100.0)]
    fired = anomaly.rate_anomalies(spark.createDataFrame(loud, "tick bigint, sample double"))
    assert [(r["tick"], r["kind"]) for r in fired.collect()] == [(60, "rate_spike")]
    rows = [(1, "a", 0.5, 1.0, 2.0, 3.0), (2, "a", 0.7, 4.0, 5.0, 6.0), (40, "a", 0.1, 1.0, 1.0, 1.0), (5, "b", 0.2, 1.0, 1.0, 1.0)]
    firing = spark.createDataFrame(rows, "tick bigint, kind string, score double, observed double, expected double, deviation double")
    got = sorted((r["kind"], r["first_fired"], r["fire_count"], r["score"], r["observed"], r["expected"], r["state"]) for r in anomaly.alerts(firing, F.lit(40)).collect())
    assert got == [("a", 1, 2, 0.7, 4.0, 2.0, "resolved"), ("a", 40, 1, 0.1, 1.0, 1.0, "active"), ("b", 5, 1, 0.2, 1.0, 1.0, "resolved")]


def test_correlation_ranks_causes(spark):
    signals = spark.createDataFrame(
        [("db", 10, 10, 0.8, "db spike", 1, "x"), ("deploy", 5, 5, 0.5, "deploy", 2, "y"), ("late", 16, 16, 1.0, "late", 3, "z"), ("own", 15, 15, 1.0, "own", 0, "spike")],
        "kind string, onset bigint, peak bigint, magnitude double, label string, source_id bigint, detector string",
    )
    effects = spark.createDataFrame([(1, 15, "spike")], "effect_id bigint, e_onset bigint, e_detector string")
    got = correlate.correlate(effects, signals, 60).orderBy("rank").collect()
    assert [r["cause_label"] for r in got] == ["db spike", "deploy"]
    (h,) = correlate.hypotheses(correlate.correlate(effects, signals, 60)).collect()
    assert h["n_causes"] == 2 and abs(h["confidence"] - (1 - 5 / 60) * 0.8) < 1e-12


def test_range_join_equals_brute_force(spark):
    import random

    r = random.Random(1)
    a, b = [(i, r.randint(-500, 500)) for i in range(80)], [(i, r.randint(-500, 500)) for i in range(80)]
    left, right = spark.createDataFrame(a, "l int, x bigint"), spark.createDataFrame(b, "r int, y bigint")
    got = sorted((q["l"], q["r"]) for q in correlate.range_join(left, right, "x", "y", 30).collect())
    assert got == sorted((i, j) for i, x in a for j, y in b if 0 <= x - y <= 30)


def test_traces(spark):
    rows = make(spark, [(1, "info", "a", "t1", None, 0), (5, "error", "b", "t1", None, 0), (9, "info", "c", "t2", None, 0), (9, "info", "d", None, None, 0), (60, "info", "e", "t2", None, 0)])
    got = {r["trace_id"]: (r["event_count"], r["duration_us"], r["outcome"]) for r in traces.traces(rows).collect()}
    assert got == {"t1": (2, 4_000_000, "failure"), "t2": (2, 51_000_000, "unknown")}
    assert {r["outcome"] for r in traces.traces(rows, extended=True).collect()} == {"failure", "success"}
    assert sorted((r["trace_id"], r["event_count"]) for r in traces.trace_sessions(rows, 30).collect()) == [("t1", 2), ("t2", 1), ("t2", 1)]
    many = make(spark, [(i, "info" if i < 64 else "error", "m", "t", None, 0) for i in range(80)])
    (t,) = traces.traces(many).collect()
    assert (t["event_count"], t["outcome"]) == (64, "unknown")


def test_sources(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(b"one\r\ntwo\nthree")
    assert [r["raw"] for r in src.read_lines(spark, str(tmp_path / "a.log")).collect()] == ["one", "two", "three"]
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, ""), (3, None), (4, "x")], "doc_id int, text string")
    assert sorted((r["doc_id"], r["line_no"], r["raw"]) for r in src.split_lines(docs, "text", ["doc_id"]).collect()) == [(1, 0, "a"), (1, 1, "b"), (4, 0, "x")]
    rows = spark.range(1000).select((999 - F.col("id")).alias("k")).repartition(7)
    assert [r["seq"] for r in src.with_seq(rows, "k").orderBy("k").collect()] == list(range(1, 1001))
    assert src.glob_regex("a*.l?g") == r"^a.*\.l.g$"


def test_sketches(spark):
    rows = spark.range(10_000).withColumn("g", F.col("id") % 2)
    (e,) = stats.hll_estimate(stats.hll_merge(stats.hll_registers(rows, "id", ["g"]), []), []).collect()
    assert abs(e["estimate"] - 10_000) < 300
    items = spark.createDataFrame([("foo",)] * 100 + [("bar",)], "item string")
    cells = stats.cms_cells(items, "item")
    assert {r["item"]: r["estimate"] for r in stats.cms_estimate(cells, items).collect()} == {"foo": 100, "bar": 1}
    a, b, c = ("request to server failed".split(), "request to server has failed".split(), "entirely other words here".split())
    t = spark.createDataFrame([(a, b, c)], "a array<string>, b array<string>, c array<string>")
    s = lambda x: stats.minhash_signature(F.col(x))
    (r,) = t.select(stats.minhash_similarity(s("a"), s("a")).alias("same"), stats.minhash_similarity(s("a"), s("b")).alias("near"), stats.minhash_similarity(s("a"), s("c")).alias("far")).collect()
    assert r["same"] == 1.0 and r["near"] > 0.4 and r["far"] < 0.4


def test_signatures_take_every_word(spark, tmp_path):
    from embermill.plans import queries

    texts = ["", " \n", "a", "a b\nc", " ".join(f"w{i}" for i in range(64)), " ".join(f"w{i % 250}" for i in range(300))]
    rows = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "conv_id bigint, turn int, text string")
    rows.write.parquet(str(tmp_path / "conversations.parquet"))
    each = rows.select("conv_id", F.explode(F.split("text", "[ \n]+")).alias("w")).where("w <> ''")
    each = each.select("conv_id", F.posexplode(F.array(*[F.xxhash64(F.lit(i), "w") for i in range(64)])).alias("slot", "h"))
    want = {(r["conv_id"], r["slot"]): r["h"] for r in each.groupBy("conv_id", "slot").agg(F.min("h").alias("h")).collect()}
    got = {(r["conv_id"], i): h for r in queries.signed(rows).collect() for i, h in enumerate(r["sig"])}
    assert got == want and len(got) == 64 * 4
    out = queries.QUERIES["minhash_signature"](spark, str(tmp_path)).collect()
    assert len(out) == 6 and all(r["whole"] and r["same"] for r in out)


def test_grouped_signatures_are_those_of_each_row(spark):
    """Rows may repeat a key or have none; every pair of six differing slots at most shares one of seven bands."""
    texts = [(1, "a b c a"), (1, "x y"), (None, "a b c"), (2, ""), (3, None), (4, " ".join(f"w{i}" for i in range(400)))]
    rows = spark.createDataFrame(texts, "k bigint, text string").withColumn("t", F.filter(F.split("text", " "), lambda w: w != ""))
    want = rows.select("k", stats.minhash_signature(F.col("t")).alias("sig")).where(F.size("sig") > 0).collect()
    got = stats.minhash_signed(rows, "k", "t").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4
    base = [f"w{i}" for i in range(400)]
    near = spark.createDataFrame([(i, base[: 400 - 6 * i]) for i in range(8)], "k bigint, t array<string>")
    sig = {r["k"]: r["sig"] for r in stats.minhash_signed(near, "k", "t").collect()}
    alike = {(a, b): sum(x == y for x, y in zip(sig[a], sig[b])) / 64 for a in sig for b in sig if a < b and sig[a] != sig[b]}
    found = {(r["left"], r["right"]): r["similarity"] for r in stats.minhash_pairs(near, "k", "t").collect() if not r["copy"]}
    of = {a: min(b for b in sig if sig[b] == sig[a]) for a in sig}
    assert found == {p: x for p, x in alike.items() if x >= 0.9 and all(of[k] == k for k in p)} and found


def test_near_copies_by_brute_force(spark, tmp_path):
    from embermill.plans.queries import QUERIES

    base = [[f"w{k}x{i}" for i in range(300)] for k in range(4)]
    texts = [" ".join(b) for b in base]
    texts += [texts[0]] * 3 + [" ".join(reversed(base[0])), texts[0] + " w0x1 w0x2", " ".join(base[0][:-6] + ["other"]), texts[1] + " more", texts[1] + "\nmore", "", " \n"]
    docs = [(100 - i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["minhash_neardup"](spark, str(tmp_path)).collect()
    sets = {k: frozenset(t.split()) for k, t in docs if t.split()}
    rows = spark.createDataFrame([(k, list(s)) for k, s in sets.items()], "k bigint, tokens array<string>")
    sig = {r["k"]: r["sig"] for r in rows.select("k", stats.minhash_signature(F.col("tokens")).alias("sig")).collect()}
    alike = lambda a, b: sum(x == y for x, y in zip(sig[a], sig[b])) / 64
    want = {(a, b): alike(a, b) for a in sets for b in sets if a < b and alike(a, b) >= 0.9}
    of = {k: k for k in sets} | {r["right"]: r["left"] for r in got if r["copy"]}
    link = {(r["left"], r["right"]): r["similarity"] for r in got if not r["copy"]}
    found = {(a, b): 1.0 if of[a] == of[b] else link.get((min(of[a], of[b]), max(of[a], of[b]))) for a in sets for b in sets if a < b}
    assert {p: x for p, x in found.items() if x is not None} == want and link
    assert all(sig[of[k]] == sig[k] and of[k] == min(j for j in sets if sig[j] == sig[k]) for k in sets)
    exact = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in found}
    assert all((p in want) == (x >= 0.9) for p, x in exact.items()) and sum(x == 1 for x in exact.values()) >= 11


def test_engine_filters_never_reach_the_groups(spark):
    lines = [f"2024-03-15T10:{i // 60:02d}:{i % 60:02d}Z {'ERROR' if i % 10 == 0 else 'INFO'} [svc] job {i} done" for i in range(200)] + ["    at x.y(z)"]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "source_id int, seq bigint, raw string")
    t = Triage(rows, Intervals(tick=10))
    before = sorted(map(tuple, t.top_groups().select("template", "count").collect()))
    assert t.events(filters.all_of(clause("severity_gte", "error"))).count() == 20
    assert sorted(map(tuple, t.top_groups().select("template", "count").collect())) == before == [("job <*> done", 200)]
    (s,) = t.summary().collect()
    assert s["stats"]["events_total"] == 200 and len(s["top_groups"]) == 1


def test_command_line(spark, tmp_path):
    from embermill.cli import main

    (tmp_path / "a.log").write_text("".join(f"2024-03-15T10:00:{i:02d}Z ERROR [db] query {i} failed\n" for i in range(20)))
    out = io.StringIO()
    assert main(["--json", "-s", "-n", str(tmp_path / "a.log"), "errors"], out) == 0
    lines = out.getvalue().strip().split("\n")
    assert len(lines) == 21 and '"severity":"error"' in lines[0] and '"events_total"' in lines[-1]
    out = io.StringIO()
    assert main(["-s", "-n", str(tmp_path / "a.log")], out) == 0 and "query 0 failed" in out.getvalue()
    assert main(["words only"], out) == 2 and main(["--last", "x", str(tmp_path / "a.log")], out) == 2


def test_seq_is_gapless_with_a_payload(spark):
    """Numbers fit the rows whatever columns ride along: 400,000 rows, many ties."""
    from embermill.sources.text import with_seq

    rows = spark.range(400_000).select((F.col("id") % 977).alias("at"), "id", F.concat(F.lit("line "), F.col("id")).alias("raw")).repartition(13)
    got = with_seq(rows, "at", "id")
    n, distinct, low, high = got.agg(F.count("*"), F.count_distinct("seq"), F.min("seq"), F.max("seq")).first()
    assert (n, distinct, low, high) == (400_000, 400_000, 1, 400_000)
    want = got.selectExpr("seq", "row_number() OVER (ORDER BY at, id) AS place")
    assert want.where("seq <> place").count() == 0


def test_damaged_json_keeps_what_stands_in_front(spark):
    from embermill.operators.parsers import parse_events

    lines = [
        '{"level":"warn","msg":"disk \\"a\\" full","n":7,"box":{"x":[1,{"y":2}]},"service":"io"',
        '{"level":"error","msg":"cut of',
        '{"msg":"x","level":oops}',
        "{not json at all}",
        '{"ok":true,"f":1.5,"none":null,"level":"info",}',
    ]
    rows = spark.createDataFrame(list(enumerate(lines)), "seq bigint, raw string")
    got = parse_events(rows, F.lit("json")).orderBy("seq").collect()
    assert [(g["severity"], g["message"], g["service"]) for g in got] == [
        ("warn", 'disk "a" full', "io"), ("error", lines[1], None), ("unknown", "x", None), ("unknown", lines[3], None), ("info", lines[4], None),
    ]
    assert [(f["key"], f["value"]["kind"]) for f in got[0]["fields"]] == [("n", "int"), ("box", "string")]
    assert [(f["key"], f["value"]["kind"]) for f in got[4]["fields"]] == [("ok", "bool"), ("f", "float"), ("none", "null")]
    assert got[0]["fields"][0]["value"]["i"] == 7 and got[0]["fields"][1]["value"]["s"] == '{"x":[1,{"y":2}]}'


def test_parse_is_computed_once(spark):
    """Filters and aggregates above a parse do not evaluate it again."""
    from embermill.operators.parsers import parse_events

    rows = spark.createDataFrame([(1, "level=error msg=x")], "seq bigint, raw string")
    out = parse_events(rows, F.lit("logfmt")).where("severity = 'error' AND message = 'x'").groupBy("severity").agg(F.max("message"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 2


def test_sources_beyond_the_broadcast_are_joined(spark):
    from embermill.sources.text import name_sources

    registry = spark.range(50).select(F.col("id").alias("source_id"), F.concat(F.lit("s"), "id").alias("name"))
    rows = spark.range(60).select(F.col("id").alias("source_id"))
    for bound in (4096, 10):
        got = {r["source_id"]: r["source_name"] for r in name_sources(rows, registry, bound).collect()}
        assert got == {i: f"s{i}" if i < 50 else "<unknown>" for i in range(60)}
