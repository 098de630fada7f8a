"""Personal data: base patterns, and spans that boosted trees pick from candidates.

All of it is column expressions: regular expressions find candidates, splitting by the
same expression gives their places in code points, trees are CASE expressions.

Base spans (e-mail, IP address, card, phone) follow fixed patterns and stay. Patterns
are written with possessive quantifiers and anchored where a match can start, so that
time grows with the text and not with its square; they match what the plain patterns
match. Generators of high recall then propose further spans, which may overlap: words
assigned to a password or token, keys of a known form, long mixed runs, number groups,
spelled-out addresses. Gradient-boosted trees see the format of a span and what stands
before and after it; a span is redacted if its score reaches its kind's threshold, calibrated
for precision on examples of other forms than those that the trees learnt from. All examples
are synthetic and fixed in number. What several spans cover is redacted once, from the first
to the last place.

Null and empty texts have no spans. Places count code points, ends exclusive. Repeated
rows are treated each. Columns besides doc_id and text are not read by ``find``;
``redact`` keeps every column.
"""

from __future__ import annotations

import random
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of base spans in their order, each with the pattern it is found by.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Generators of candidates: kind, patterns. Several of a kind may propose spans that overlap.
GENERATORS = {
    "secret": [r"(?i)\b(?:password|passwd|pwd|token|secret|api[_-]?key)\b\s{0,3}[=:]\s{0,3}[\x22']?[A-Za-z0-9+/_-]{6,}+[\x22']?|\b[A-Z]{4}[0-9A-Z]{16}\b|(?:\G|(?<![A-Za-z0-9+/_-]))(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{20,}+"],
    "number": [r"(?<![0-9A-Za-z.+-])\(?[0-9](?:[ ().-]*+[0-9]){7,}+", r"(?<![0-9A-Za-z])\(?[0-9]{3}\)?[ .-]?[0-9]{2,3}[ .-][0-9]{4}(?![0-9A-Za-z])"],
    "handle": [r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{2,}+ ?[\[(]at[\])] ?[a-z0-9-]{2,}+(?: ?(?:\.|[\[(]dot[\])]) ?[a-z0-9-]{2,}+)++"],
}
KINDS = [*BASE, *GENERATORS]
#: What may be said before a secret or a number.
CONTEXT = r"(?i)(?:password|passwd|pwd|token|secret|key|call|phone|tel|fax|mobile|contact|ssn|account|card)\W{0,4}\z"
PRECISION = 0.99
EXAMPLES = 1500
FEATURES = ["length", "digits", "uppers", "lowers", "separators", "assigned", "shouted", "context", "distinct", "grouped", "dialled", "glued"]
#: Matches whose places are added up together.
TOGETHER = 64


def _spans(text: Column, pattern: str) -> Column:
    """Every match with its place: array of (value, start).

    Places are sums of what lies before. They are made in runs of TOGETHER matches and then
    shifted by the runs before, as an array that grows by one element at a time is copied each time.
    """
    found, rest = F.regexp_extract_all(text, F.lit(pattern), 0), F.split(text, pattern, -1)
    parts = F.transform(found, lambda x, i: F.struct(x.alias("value"), F.length(F.get(rest, i)).alias("gap")))
    none = F.array().cast("array<struct<value:string,start:int>>")

    def step(acc, x):
        at = acc["at"] + x["gap"]
        return F.struct((at + F.length(x["value"])).alias("at"), F.concat(acc["out"], F.array(F.struct(x["value"].alias("value"), at.alias("start")))).alias("out"))

    def shift(acc, run):
        moved = F.transform(run["out"], lambda s: F.struct(s["value"].alias("value"), (s["start"] + acc["at"]).alias("start")))
        return F.struct((acc["at"] + run["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    firsts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)), F.lit(TOGETHER)), lambda i: i <= F.size(parts))
    runs = F.transform(firsts, lambda i: F.aggregate(F.slice(parts, i, TOGETHER), F.struct(F.lit(0).alias("at"), none.alias("out")), step))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<value:string,start:int>>>").alias("out"))
    return F.flatten(F.aggregate(runs, start, shift, lambda acc: acc["out"]))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits' check sum is right."""
    each = F.transform(F.regexp_extract_all(F.reverse(digits), F.lit("."), 0), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.lpad(F.substring(F.ltrim(p, F.lit("0")), 1, 3), 3, "0") <= "255"))
    if kind == "card":
        d = _digits(value)
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def _check(kind: str):
    return lambda s: _valid(kind, s["value"])


def _is(kind: str):
    return lambda s: s["kind"] == kind


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end")))


def _features(text: Column, s: Column) -> Column:
    """The features of one candidate as a struct of doubles."""
    value = s["value"]
    n = F.length(value).cast("double")
    share = lambda letters: (n - F.length(F.regexp_replace(value, letters, ""))) / n
    before = F.substring(text, F.greatest(s["start"] - 15, F.lit(1)), F.least(s["start"], F.lit(16)))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return F.struct(
        n.alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"), share("[a-z]").alias("lowers"), share("[ ().-]").alias("separators"),
        flag(value.rlike("[=:]")).alias("assigned"), flag(value.rlike(r"\A[A-Z0-9]{20}\z")).alias("shouted"), flag(before.rlike(CONTEXT)).alias("context"),
        (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), 0))) / n).alias("distinct"),
        flag(value.rlike(r"\A[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}\z")).alias("grouped"), flag(value.rlike(r"\A\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}\z")).alias("dialled"),
        flag(F.substring(text, s["start"] + F.length(value) + 1, F.lit(1)).rlike("[0-9A-Za-z]")).alias("glued"),
    )


def candidates(text: Column) -> Column:
    """All generators' spans with their features: array of (kind, start, end, f)."""


    def described(kind: str):
        return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), _features(text, s).alias("f"))

    return F.concat(*[F.transform(_spans(text, pattern), described(kind)) for kind, patterns in GENERATORS.items() for pattern in patterns])


def examples(held: bool, seed: int = 11, n: int = EXAMPLES) -> list[tuple[str, int]]:
    """Synthetic texts with one span each, and whether it is personal or secret.

    held: texts of other forms, words and lengths than those that the trees learn from, to calibrate on.
    """
    rng = random.Random(seed + held)
    syllables = ["ka", "lo", "mi", "su", "ter", "vol", "en", "qua", "rin", "de"] if held else ["th", "er", "on", "an", "re", "he", "in", "ed", "st", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    pick = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    hexa, alnum, upper, digits = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789"
    quoted = lambda x: rng.choice([x, chr(34) + x + chr(34), chr(39) + x + chr(39)])
    learnt = [
        (lambda: f"{rng.choice(['password', 'token', 'secret', 'api_key', 'pwd'])}{rng.choice(['=', ' = ', ': '])}{rng.choice(['', chr(34)])}{pick(hexa, rng.randint(12, 400))}", 1),
        (lambda: f"AKIA{pick(upper, 16)}", 1),
        (lambda: f"{rng.choice(['token', 'secret', 'key'])} {pick(alnum, rng.randint(24, 200))}", 1),
        (lambda: f"{rng.choice(['call', 'phone', 'tel', 'mobile'])} ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", 1),
        (lambda: f"{rng.choice(['call', 'on', 'at'])} {pick(digits, 3)}{rng.choice(['-', '.', ' '])}{pick(digits, 3)}-{pick(digits, 4)}", 1),
        (lambda: f"{rng.choice(['SSN', 'ssn', 'number', 'id', ''])} {pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", 1),
        (lambda: f"{word()}.{pick(digits, 2)} [at] {word()}xx [dot] com", 1),
        (lambda: f"{rng.choice(['password', 'token', 'secret'])}: {word()}{word()}{word()}", 0),
        (lambda: f"{'-'.join(word() for _ in range(6))}-{rng.randint(1, 99)}", 0),
        (lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}", 0),
        (lambda: f"{rng.randint(1, 99)}.{rng.randint(100, 999)}.{rng.randint(100, 999)} {rng.randint(10, 99)}", 0),
        (lambda: f"{'_'.join(word() for _ in range(7))}{rng.randint(1, 9)}", 0),
        (lambda: f"{word()} {rng.randint(1000, 9999)} {rng.randint(1000, 9999)} {rng.randint(10, 99)}", 0),
        (lambda: f"{pick('ABCDEFGHIJKLMNOPQRSTUVWXYZ', 20)}", 0),
        (lambda: f"{pick(digits, rng.randint(9, 20))}", 0),
        (lambda: f"{pick(digits, rng.randint(9, 20))}{pick('abcdefgh', 3)}", 0),
        (lambda: f"{rng.choice(['order', 'number'])} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)} {pick(digits, 4)}", 0),
    ]
    others = [
        (lambda: f"{rng.choice(['passwd', 'api-key', 'SECRET', 'Token'])}{rng.choice([' = ', ':', '= '])}{quoted(pick(alnum, rng.randint(16, 300)))}", 1),
        (lambda: f"export {rng.choice(['KEY', 'TOKEN'])} {pick(hexa, rng.randint(32, 64))}", 1),
        (lambda: f"ASIA{pick(upper, 16)}", 1),
        (lambda: f"{rng.choice(['fax', 'contact', 'Tel'])}: ({pick(digits, 3)}) {pick(digits, 3)}-{pick(digits, 4)}", 1),
        (lambda: f"{rng.choice(['social', 'ssn:', 'tax'])} {pick(digits, 3)}-{pick(digits, 2)}-{pick(digits, 4)}", 1),
        (lambda: f"{word()}_{word()} (at) {word()} (dot) org", 1),
        (lambda: f"{'/'.join(word() for _ in range(7))}{rng.randint(1, 9)}", 0),
        (lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}", 0),
        (lambda: f"{rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(100, 999)} {rng.randint(100, 999)}", 0),
        (lambda: f"{rng.choice(['pwd', 'secret'])}: {word()}{word()}", 0),
        (lambda: f"{rng.choice(['item', 'page', 'lot'])} {pick(digits, rng.randint(9, 16))}", 0),
        (lambda: f"{'-'.join(word() for _ in range(8))}", 0),
    ]
    out = []
    for _ in range(n):
        make, label = rng.choice(others if held else learnt)
        out.append((f"{word()} {word()} {make()} {word()}", label))
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 25, depth: int = 3, rate: float = 0.3) -> list:
    """Gradient-boosted regression trees on the logistic loss. A tree is a number or (feature, cut, left, right)."""

    def grow(rows: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, level: int):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = (1e-6, None)
        if level and len(rows) > 8:
            for f in range(x.shape[1]):
                values = np.unique(x[rows, f])
                for cut in (values[:-1] + values[1:])[:: max(1, len(values) // 24)] / 2:
                    left = x[rows, f] <= cut
                    gl, hl = gradient[rows][left].sum(), hessian[rows][left].sum()
                    gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
                    if gain > best[0]:
                        best = (gain, (f, float(round(cut, 6))))
        if best[1] is None:
            return float(round(rate * g / (h + 1), 6))
        f, cut = best[1]
        left = x[rows, f] <= cut
        return (f, cut, grow(rows[left], gradient, hessian, level - 1), grow(rows[~left], gradient, hessian, level - 1))

    score, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(len(y)), y - p, p * (1 - p), depth)
        trees.append(tree)
        score += np.array([_leaf(tree, row) for row in x])
    return trees


def _leaf(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _case(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(f[FEATURES[tree[0]]] <= tree[1], _case(tree[2], f)).otherwise(_case(tree[3], f))


def fit(spark: SparkSession) -> tuple[list, dict[str, float]]:
    """Trees, and for each kind the least score at which examples of other forms reach the precision asked for."""
    made = [(k, t, label, held) for held in (False, True) for k, (t, label) in enumerate(examples(held))]
    table = spark.createDataFrame(made, "k int, text string, label int, held boolean").coalesce(1)
    rows = table.select("k", "label", "held", F.explode(candidates(F.col("text"))).alias("c")).select("k", "label", "held", "c.kind", "c.f.*").orderBy("held", "k", "kind", *FEATURES).collect()
    x = np.array([[r[c] for c in FEATURES] for r in rows])
    y = np.array([r.label for r in rows], float)
    held = np.array([r.held for r in rows])
    trees = boost(x[~held], y[~held])
    thresholds = {}
    for kind in GENERATORS:
        mine = held & np.array([r.kind == kind for r in rows])
        scores = np.array([sum(_leaf(t, row) for t in trees) for row in x[mine]])
        order = np.argsort(-scores, kind="stable")
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        # between equal scores there is no threshold
        last = np.append(scores[order][1:] < scores[order][:-1], True)[: len(order)]
        good = np.flatnonzero((right >= PRECISION) & last)
        thresholds[kind] = float(scores[order][good[-1]]) if len(good) else float("inf")
    return trees, thresholds


def find_spans(text: Column, model: tuple[list, dict[str, float]]) -> tuple[Column, Column]:
    """Base spans by start and kind, and those that the trees add; both arrays of (kind, start, end)."""
    base = F.concat(*[_named(F.when(_gate(kind, text), F.filter(_spans(text, pattern), _check(kind))).otherwise(F.array()), kind) for kind, pattern in BASE.items()])
    trees, thresholds = model
    picked = lambda c: reduce(lambda a, b: a.when(c["kind"] == b[0], F.lit(b[1])), list(thresholds.items())[1:], F.when(c["kind"] == next(iter(thresholds)), F.lit(next(iter(thresholds.values())))))
    scored = F.filter(candidates(text), lambda c: reduce(lambda a, b: a + b, [_case(t, c["f"]) for t in trees]) >= picked(c))
    return _ordered(base), F.transform(scored, lambda c: F.struct(c["kind"], c["start"], c["end"]))


def _gate(kind: str, text: Column) -> Column:
    return {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}[kind]


def _ordered(spans: Column) -> Column:
    """Sorted by start, then by the kinds' order."""
    rank = F.create_map(*[x for k, kind in enumerate(KINDS) for x in (F.lit(kind), F.lit(k))])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


_EMPTY = "array<struct<kind:string,start:int,end:int>>"


def with_spans(docs: DataFrame, text: str, base: str, every: str) -> DataFrame:
    """docs with two further columns: its base spans, and all spans.

    An added span that lies inside a base span or a longer added one is left out; one that
    only overlaps stays.
    """
    model = fit(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    may = t.rlike(r"[0-9@]|(?i:[\[(]at[\])]|password|passwd|pwd|token|secret|api)")
    found_base, found_more = find_spans(t, model)
    out = docs.withColumn(base, F.when(may, found_base).otherwise(F.array().cast(_EMPTY))).withColumn(every, F.when(may, found_more).otherwise(F.array().cast(_EMPTY)))
    within = lambda s, b: (b["start"] <= s["start"]) & (s["end"] <= b["end"])
    longer = lambda s, b: within(s, b) & (b["end"] - b["start"] > s["end"] - s["start"])
    added = F.array_distinct(F.col(f"`{every}`"))
    left = F.filter(added, lambda s: ~F.exists(F.col(f"`{base}`"), lambda b: within(s, b)) & ~F.exists(added, lambda b: longer(s, b)))
    return out.withColumn(every, _ordered(F.concat(F.col(f"`{base}`"), left)))


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans) of each row; n_spans counts all spans."""
    found = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "base", "every")
    counts = [F.size(F.filter("base", _is(kind))).cast("long").alias(f"n_{kind}") for kind in BASE]
    return found.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), F.size("every").cast("long").alias("n_spans"))


def redact(docs: DataFrame, free: list[str]) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; free: two column names that docs has not."""
    found = with_spans(docs, "text", *free)
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]"))
        return F.when(s["end"] <= acc["at"], acc).when(s["start"] < acc["at"], F.struct(s["end"].alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), piece.alias("out")))

    new = F.aggregate(F.col(f"`{free[1]}`"), start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, 1 << 30)))
    return found.withColumn("text", F.when(F.size(f"`{free[1]}`") > 0, new).otherwise(text)).select(*[F.col(f"`{c}`") for c in docs.columns])
