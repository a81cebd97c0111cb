"""Personal data: high-recall span generators, gradient-boosted scoring, calibrated selection.

Generators propose overlapping spans by pattern; trees boosted on format and
context features score each span, and a threshold for each kind, calibrated on
held-out examples, selects what is redacted.  Spans of the base kinds (email,
ip, card, phone, by their fixed definitions) always stay; a selected span of
another kind gives way where it touches a base span or a better one.

Everything on the data runs as SQL expressions: patterns, features, the trees
(as CASE expressions) and the choice.  The trees are fitted on the driver to a
fixed number of generated examples (``EXAMPLES``), whose features come from the
same expressions.

Nulls: a null text is empty, with no spans.  Null doc_ids and repeated rows are
handled like any row.  An empty table gives no rows; extra columns are ignored
by the digest and kept by ``redact``.  Patterns are linear on long texts: none
repeats a group without bound.
"""

from __future__ import annotations

import functools
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .native import positions

# The base kinds in the order in which spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")

#: Kinds that the method adds, and the pattern that proposes them.
GENERATORS = {
    "spoken_email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._-]{0,63}[ ]?(?:\(at\)|\[at\]| at )[ ]?[A-Za-z0-9-]{1,63}[ ]?(?:\(dot\)|\[dot\]| dot )[ ]?[A-Za-z]{2,10}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-][0-9]{2,5}(?:[ .-][0-9]{2,4})?(?![0-9A-Za-z-])",
    "birth_date": r"(?<![0-9A-Za-z])[0-9]{1,4}[./-][0-9]{1,2}[./-][0-9]{2,4}(?![0-9A-Za-z])",
    "account_key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live_|xoxb-|xoxp-)[A-Za-z0-9_-]{12,80}",
    "mac": r"(?<![0-9A-Fa-f:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![0-9A-Fa-f:-])",
}
KINDS = (*BASE_KINDS, *GENERATORS)

#: Generated examples that the trees are fitted and calibrated on.
EXAMPLES = 4000
_SPAN = "array<struct<start:int,end:int,hit:string>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of the base kinds: leftmost matches that do not overlap, then the kind's test."""
    # A dot that no domain label follows cannot be in a domain; in a local part any
    # other character of its class serves, so the domain needs no repeated group.
    mail_text = F.regexp_replace(text, r"\.(?![A-Za-z0-9-])", "_")
    mail = positions(
        mail_text, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
    )
    ip = positions(text, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
    # A separator that is not between two digits ends a card number.
    card_text = F.regexp_replace(text, r"[\x20-](?![0-9])|(?<![0-9])[\x20-]", "x")
    card = positions(card_text, r"[0-9](?=[0-9\x20-]{15})[0-9\x20-]*+")
    phone = positions(text, r"\+[0-9][\x20().0-9-]+[0-9]")

    def octets(s: Column) -> Column:
        return F.forall(
            F.split(s["hit"], r"\."), lambda p: F.coalesce(p.try_cast("bigint"), F.lit(999)) <= 255
        )

    def luhn(s: Column) -> Column:
        digits = F.translate(s["hit"], " -", "")
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)

    def number(s: Column) -> Column:
        return F.length(F.translate(s["hit"], "+ ().-", "")).between(8, 15)

    return {
        "email": F.when(F.contains(text, F.lit("@")), mail).otherwise(_none()),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(ip, octets)).otherwise(_none()),
        "card": F.when(text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), F.filter(card, luhn)).otherwise(_none()),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(phone, number)).otherwise(_none()),
    }


# ---------------------------------------------------------------- candidates

FEATURES = (
    "kind", "length", "digits", "letters", "seps", "distinct_seps", "near_word", "wrong_word",
    "mod97", "year", "same_digit", "month_ok", "open_ended",
)
_NEAR = r"(?i)(?:mail|contact|write|phone|tel|call|mobile|fax|ssn|social|security|iban|account|bank|born|birth|dob|key|token|secret|access|mac|device|address)[^\n]{0,24}$"
_WRONG = r"(?i)(?:version|ver|v|release|build|section|chapter|page|isbn|order|item|ref|fig|table|ratio|score|part|no)[.:#]?[ ]{0,2}$"


def _mod97(hit: Column) -> Column:
    """Remainder by 97 of an account number as the check-digit rule reads it."""
    plain = F.translate(hit, " ", "")
    turned = F.concat(F.substr(plain, F.lit(5)), F.substr(plain, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(turned, ""), lambda c: c != "")

    def step(acc: Column, c: Column) -> Column:
        n = F.ascii(c)
        digit = n.between(48, 57)
        value = F.when(digit, n - 48).otherwise(n - 55)
        return ((acc * F.when(digit, F.lit(10)).otherwise(F.lit(100)) + value) % 97).cast("int")

    return F.aggregate(chars, F.lit(0), step)


def features(text: Column, kind: int, s: Column) -> list[Column]:
    hit = s["hit"]
    before = F.substr(text, F.greatest(F.lit(1), s["start"] - 39), F.least(s["start"], F.lit(40)))
    after = F.substr(text, s["end"] + 1, F.lit(1))
    digits = F.regexp_count(hit, F.lit("[0-9]"))
    seps = F.regexp_replace(hit, "[A-Za-z0-9]", "")
    iban = F.when(F.lit(KINDS[kind] == "iban"), (_mod97(hit) == 1).cast("int")).otherwise(F.lit(0))
    return [
        F.lit(kind),
        F.length(hit),
        digits,
        F.regexp_count(hit, F.lit("[A-Za-z]")),
        F.length(seps),
        F.size(F.array_distinct(F.split(seps, ""))),
        before.rlike(_NEAR).cast("int"),
        before.rlike(_WRONG).cast("int"),
        iban,
        hit.rlike(r"(?<![0-9])(?:19[0-9]{2}|20[01][0-9])(?![0-9])").cast("int"),
        hit.rlike(r"^[^0-9]*([0-9])(?:[^0-9]*\1){6}").cast("int"),
        hit.rlike(r"^(?:0?[1-9]|[12][0-9]|3[01])[./-](?:0?[1-9]|1[0-2])[./-]|^[12][0-9]{3}[./-](?:0?[1-9]|1[0-2])[./-]").cast("int"),
        after.rlike(r"[A-Za-z0-9/=]").cast("int"),
    ]


def candidates(text: Column) -> Column:
    """array<struct<kind,start,end,f>> of what the generators propose."""
    def proposed(kind: int, pattern: str) -> Column:
        def span(s: Column) -> Column:
            own = F.array(*[f.cast("double") for f in features(text, kind, s)])
            return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), own.alias("f"))

        return F.transform(positions(text, pattern), span)

    return F.concat(*[proposed(k, p) for k, p in enumerate(GENERATORS.values(), len(BASE_KINDS))])


# ---------------------------------------------------------------- boosted trees


def _grow(x, g, h, depth, least):
    """A regression tree on gradients; leaves hold Newton steps."""
    value = float(g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(x) < 2 * least:
        return value
    best = (1e-6, None, None)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        cuts = cuts[(cuts + 1 >= least) & (len(x) - cuts - 1 >= least)]
        if not len(cuts):
            continue
        gain = cg[cuts] ** 2 / (ch[cuts] + 1) + (cg[-1] - cg[cuts]) ** 2 / (ch[-1] - ch[cuts] + 1) - base
        i = int(np.argmax(gain))
        if gain[i] > best[0]:
            best = (float(gain[i]), j, float((v[cuts[i]] + v[cuts[i] + 1]) / 2))
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return (
        best[1],
        best[2],
        _grow(x[left], g[left], h[left], depth - 1, least),
        _grow(x[~left], g[~left], h[~left], depth - 1, least),
    )


def _apply(tree, x):
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = _apply(tree[2], x[left]), _apply(tree[3], x[~left])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 24, depth: int = 3, rate: float = 0.3):
    margin, trees = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, 8)
        trees.append(tree)
        margin += rate * _apply(tree, x)
    return trees, rate


def margins(model, x: np.ndarray) -> np.ndarray:
    trees, rate = model
    return rate * sum(_apply(t, x) for t in trees)


def calibrate(margin, y, kinds, precision: float) -> dict[int, float]:
    """The lowest threshold of each kind whose held-out precision is reached; beyond any margin if none is."""
    out = {}
    for k in sorted(set(kinds.tolist())):
        m, t = margin[kinds == k], y[kinds == k]
        order = np.argsort(-m, kind="stable")
        good = np.cumsum(t[order]) / np.arange(1, len(order) + 1)
        ends = np.flatnonzero(np.append(m[order][1:] < m[order][:-1], True))
        fit = [i for i in ends if good[i] >= precision]
        if not fit:
            out[int(k)] = 1e9
            continue
        low = m[order][fit[-1]]
        below = m[m < low]
        out[int(k)] = float((low + below.max()) / 2) if len(below) else float(low) - 1e-6
    return out


def tree_column(model, f) -> Column:
    """The model's margin as one expression; ``f(i)`` is feature i."""

    def node(t) -> Column:
        if not isinstance(t, tuple):
            return F.lit(t)
        return F.when(f(t[0]) <= F.lit(t[1]), node(t[2])).otherwise(node(t[3]))

    trees, rate = model
    return functools.reduce(lambda a, b: a + b, [node(t) for t in trees]) * F.lit(rate)


# ---------------------------------------------------------------- generated examples


def examples(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int]]:
    """Sentences with one span each: (text, 1 if the span is personal data)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 8)))
    up = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def iban() -> str:
        bank = "".join(r.choice("0123456789") for _ in range(r.choice([12, 14, 16, 18, 20])))
        country = r.choice(["DE", "FR", "ES", "GB", "NL"])
        number = int("".join(str(int(c, 36)) for c in bank + country + "00"))
        return f"{country}{98 - number % 97:02d}{bank}"

    def grouped(s: str) -> str:
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.5 else s

    key = lambda: r.choice(["AKIA", "ASIA"]) + "".join(r.choice(up + "234567") for _ in range(16))
    pairs = [
        (lambda: f"{w()}{r.choice([' at ', ' (at) ', '[at]'])}{w()}{r.choice([' dot ', ' (dot) ', '[dot]'])}{r.choice(['com', 'org', 'net', 'de'])}", ["write to", "mail", "contact me"], lambda: f"{w()} at {w()} dot {w()}", ["look", "stood", "arrived"]),
        (lambda: f"{r.randint(100, 799)}-{r.randint(10, 99)}-{d(4)}", ["ssn", "social security", "", "his number"], lambda: f"{d(3)}-{d(2)}-{d(4)}", ["order no.", "part", "ref", "item"]),
        (lambda: grouped(iban()), ["iban", "account", "pay to", ""], lambda: r.choice("KQXZ") + r.choice(up) + d(2) + " " + d(4) + " " + d(4) + " " + d(4), ["ref", "part", "", "item"]),
        (lambda: f"({d(3)}) {d(3)}-{d(4)}" if r.random() < 0.5 else f"0{d(2)} {d(3)} {d(4)}", ["phone", "call", "tel:", "mobile"], lambda: f"{d(r.randint(2, 4))} {d(r.randint(2, 4))} {d(r.randint(2, 5))}", ["score", "table", "", "ratio", "page", w()]),
        (lambda: f"{r.randint(1, 28)}{(s := r.choice('./-'))}{r.randint(1, 12)}{s}{r.randint(1930, 2012)}", ["born", "birth date", "dob"], lambda: f"{r.randint(1, 40)}{(s := r.choice('./-'))}{r.randint(1, 40)}{s}{d(r.choice([2, 3, 4]))}", ["version", "ver", "section", "", w(), "on"]),
        (lambda: key(), ["key", "token =", "", w(), "access"], lambda: "sk-" + w() + w() + w() + "-" + w(), ["a", "the", w()]),
        (lambda: ":".join("".join(r.choice("0123456789abcdef") for _ in range(2)) for _ in range(6)), ["mac", "device", "", w()], lambda: "-".join(d(2) for _ in range(6)), ["score", "lot", "code", w()]),
    ]
    out = []
    for i in range(n):
        yes, lead, no, wrong = pairs[i % len(pairs)]
        label = int(r.random() < 0.5)
        words = " ".join(w() for _ in range(r.randint(0, 5)))
        span, near = (yes(), r.choice(lead)) if label else (no(), r.choice(wrong))
        out.append((f"{words} {near} {span} {w()} {w()}.", label))
    return out


_FEATURES: list[tuple] = []
_MODEL: dict[float, tuple] = {}


def fitted(spark: SparkSession, precision: float = 0.95) -> tuple:
    """(trees, thresholds): fitted once for each precision in a driver process, on features from the same expressions."""
    if not _FEATURES:
        rows = (
            spark.createDataFrame(examples(), "text string, label int")
            .coalesce(4)
            .select("label", F.explode(candidates(F.col("text"))).alias("c"))
            .select("label", "c.f")
            .collect()
        )
        x = np.array([r["f"] for r in rows])
        y = np.array([r["label"] for r in rows], float)
        order = np.lexsort([*x.T, y])
        _FEATURES.append((x[order], y[order]))
    if precision not in _MODEL:
        x, y = _FEATURES[0]
        held = np.arange(len(x)) % 3 == 0
        model = boost(x[~held], y[~held])
        _MODEL[precision] = model, calibrate(margins(model, x[held]), y[held], x[held][:, 0].astype(int), precision)
    return _MODEL[precision]


def find_spans(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """``docs`` with pii_base (array of arrays by base kind) and pii (all spans: kind, start, end; base first)."""
    model, limits = fitted(docs.sparkSession, precision)
    text = F.coalesce("text", F.lit(""))
    base = base_spans(text)
    kind_name = F.array(*[F.lit(k) for k in KINDS])

    def tagged(k: int, spans: Column) -> Column:
        return F.transform(
            spans, lambda s: F.struct(F.lit(k).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))
        )

    # Most texts hold none of these characters together: they pass untouched. Only spoken
    # emails, keys and hardware addresses can do without a digit, '@' or '+'.
    gate = text.rlike("[0-9@+]") | F.contains(text, F.lit("at")) & text.rlike(r"(?:\(at\)|\[at\]| at )[^\n]{0,66}dot")
    gate = gate | text.rlike(r"(?:AKIA|ASIA|gh[po]_|sk-|sk_live_|xox[bp]-)[A-Za-z0-9_-]{12}|[A-Fa-f]{2}[:-][A-Fa-f]{2}[:-]")
    rows = docs.withColumn("pii_gate", gate)
    rows = rows.withColumns(
        {f"pii_{k}": F.when(F.col("pii_gate"), c).otherwise(_none()) for k, c in base.items()}
    )
    rows = rows.withColumn(
        "pii_base", F.concat(*[tagged(i, F.col(f"pii_{k}")) for i, k in enumerate(BASE_KINDS)])
    )
    scored = F.transform(
        candidates(text),
        lambda c: F.struct(
            c["kind"].alias("kind"),
            c["start"].alias("start"),
            c["end"].alias("end"),
            (
                tree_column(model, lambda i: F.get(c["f"], i))
                - F.get(F.array(*[F.lit(float(limits.get(k, 1e9))) for k in range(len(KINDS))]), c["kind"])
            ).alias("over"),
        ),
    )
    empty = F.array().cast("array<struct<kind:int,start:int,end:int,over:double>>")
    rows = rows.withColumn(
        "pii_more", F.when(F.col("pii_gate"), F.filter(scored, lambda c: c["over"] >= 0)).otherwise(empty)
    )

    def touches(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def better(d: Column, c: Column) -> Column:
        key = lambda s: F.struct(s["over"], s["end"] - s["start"], -s["start"], -s["kind"])
        return touches(d, c) & (key(d) > key(c))

    kept = F.filter(
        F.col("pii_more"),
        lambda c: ~F.exists(F.col("pii_base"), lambda b: touches(b, c))
        & ~F.exists(F.col("pii_more"), lambda d: better(d, c)),
    )
    kept = F.array_sort(
        F.transform(kept, lambda c: F.struct(c["kind"], c["start"], c["end"]))
    )
    rows = rows.withColumn("pii", F.concat("pii_base", kept))
    rows = rows.withColumn(
        "pii",
        F.transform("pii", lambda s: F.struct(F.get(kind_name, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))),
    )
    return rows.drop("pii_gate", "pii_more")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def personal_digest(docs: DataFrame) -> DataFrame:
    found = find_spans(docs.select("doc_id", "text"))
    n_base = sum((F.size(f"pii_{k}") for k in BASE_KINDS[1:]), F.size(f"pii_{BASE_KINDS[0]}"))
    return found.select(
        "doc_id",
        *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(_listed(F.slice("pii", 1, n_base)), 256).alias("base_sha256"),
        _listed(F.col("pii")).alias("spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by its kind in brackets; other columns are kept."""
    columns = docs.columns
    found = find_spans(docs)
    # Base kinds may overlap each other: merged from the left, the earliest span names the run.
    empty = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    by_start = F.array_sort(
        F.transform("pii", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    )

    def join(acc: Column, s: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        over = (F.size(acc) > 0) & (s["start"] < last["end"])
        grown = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind")
        )
        return F.when(
            over, F.concat(F.slice(acc, 1, F.greatest(F.lit(0), F.size(acc) - 1)), F.array(grown))
        ).otherwise(F.concat(acc, F.array(s)))

    merged = F.aggregate(by_start, empty, join)
    found = found.withColumn("pii_runs", merged)
    state = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def write(acc: Column, s: Column) -> Column:
        plain = F.substr("text", acc["pos"] + 1, s["start"] - acc["pos"])
        mark = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
        return F.struct(s["end"].alias("pos"), F.concat(acc["out"], F.array(plain, mark)).alias("out"))

    text = F.aggregate(
        "pii_runs", state, write, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr("text", acc["pos"] + 1))
    )
    clean = F.when(F.size("pii_runs") > 0, text).otherwise(F.col("text"))
    return found.withColumn("text", clean).select(columns)
