"""PII by candidate gradient boosting, in DataFrame functions only.

Base rules (e-mail, ip, card, phone) give spans that always stay.  High-recall generators propose further, overlapping
spans (``secret``: long mixed tokens; ``quoted``: long values in quotes; ``number``: groups of digits; ``handle``:
spelled-out addresses).  Boosted trees score them by format and context features; the ensemble is fitted once a run, on
all distinct candidates, whose labels come from the corpus itself (positive if a naming word such as ``token`` or
``contact`` stands before them), and is turned into a column expression.  Features are cut at fixed borders, so candidates
count by their bins: a tree needs no more than the gradients of each two bins' common candidates, whatever their number.
The ensemble is turned into a column expression.  The label's own feature is blank while fitting, so the trees learn the
format and the rest of the context and find spans that nothing names.
A span is redacted if its calibrated score reaches the threshold that keeps precision at ``PRECISION`` on the
other half of the candidates (the halves are dealt by a hash of the candidate's text, so no text is in both).  If none
does, or the candidates have one label only, named and assigned candidates are redacted; the model says so (``source``) and
``train`` warns.  Of overlapping spans the one of the earlier kind stays.

Positions are code points.  ``split`` and ``regexp_extract_all`` with one pattern give the pieces between and the
matches, so running lengths are positions without any Python on the executors.  Every pattern is linear in the text: it
starts only where no character of its first class stands before (or where the last match ended) and never gives back.
Patterns with a repeated group (card digits, domain labels) would recurse in Java's regex on very long inputs; single
separators are first translated to a private character, one for one, which leaves plain character classes.  Running sums
and maxima over m matches are taken in blocks (``scan``), a text is cut for redaction in blocks too.

Defined results: null and empty texts have no span; repeated rows repeat; other columns never matter; an empty table gives
an empty table.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "quoted", "number", "handle")
KINDS = (*BASE, *ADDED)
WEIGHT = 4000  # of all candidates, half of them for each label
GROUPS = 1 << 15  # of equal candidates, that the driver takes
PRECISION = 0.98
TREES = 24
RATE = 0.3
_JOINT = "\u0001"  # stands for one separator between two characters of a kind; its own occurrences become \u0002


def _joined(text: Column, before_after: str, separators: str) -> Column:
    """text with each single separator between two such characters as _JOINT; lengths and positions stay."""
    plain = F.translate(text, _JOINT, "\u0002")
    return F.regexp_replace(plain, f"(?<=[{before_after}])[{separators}](?=[{before_after}])", _JOINT)


_SPANS = "array<struct<start:int,end:int,hit:string>>"


def let(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def scan(values: Column, op, zero: int) -> Column:
    """For each int of an array what op makes of zero and all before it: in blocks of about the root of the array's size."""
    start = lambda: F.struct(F.lit(zero).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    def whole(v: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(v))).cast("int")
        block = lambda i: F.aggregate(F.slice(v, i * width + 1, width), start(), step)
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), block)
        tops = lambda b: F.aggregate(F.transform(b, lambda x: x["at"]), start(), step, lambda acc: acc["out"])
        return let(blocks, lambda b: F.flatten(F.zip_with(b, tops(b), lambda x, t: F.transform(x["out"], lambda y: op(t, y)))))

    return let(values, lambda v: F.when(F.size(v) > 0, whole(v)).otherwise(F.array().cast("array<int>")))


def located(text: Column, pattern: str) -> Column:
    """array<struct<gap, start, end, hit>> of a pattern's leftmost non-overlapping matches; gap is the text before each."""

    def of(hits: Column) -> Column:
        parts = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("gap"), h.alias("hit")))
        return let(parts, placed)

    def placed(m: Column) -> Column:
        ends = scan(F.transform(m, lambda x: (F.length(x["gap"]) + F.length(x["hit"])).cast("int")), lambda a, b: a + b, 0)
        start = lambda x, at: (at + F.length(x["gap"])).cast("int")
        return F.zip_with(m, ends, lambda x, at: F.struct(x["gap"], start(x, at).alias("start"), (start(x, at) + F.length(x["hit"])).cast("int").alias("end"), x["hit"]))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def _run(chars: str) -> str:
    """All of a run of these characters, from its first or from where the last match ended; a run is read once."""
    return f"(?:\\G|(?<![{chars}]))[{chars}]++"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    flipped = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.struct(F.try_to_number(c, F.lit("9")).cast("int").alias("d"), (i % 2).alias("odd")))
    doubled = lambda x: F.when(x["odd"] == 0, x["d"]).otherwise(2 * x["d"] - F.when(x["d"] > 4, 9).otherwise(0))
    total = F.aggregate(flipped, F.lit(0), lambda a, x: a + F.coalesce(doubled(x), F.lit(0)))
    return total % 10 == 0


_LABEL = "A-Za-z0-9-"
_LOCAL = f"A-Za-z0-9._%+\\-{_JOINT}"
#: Kind -> (cheap test of the whole text, translated text, pattern over it, check of a hit).
RULES = {
    "email": (
        lambda t: F.contains(t, F.lit("@")),
        lambda t: _joined(t, _LABEL, "."),
        f"{_run(_LOCAL)}@[{_LABEL}]++{_JOINT}[{_LABEL}{_JOINT}]++",
        lambda h: F.lit(True),
    ),
    "ip": (
        lambda t: t.rlike("[0-9]\\.[0-9]"),
        lambda t: t,
        f"{_run('0-9')}\\.[0-9]++\\.[0-9]++\\.[0-9]++",
        lambda h: F.forall(F.split(h, "\\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=[0-9])", "")) <= 3) & (F.right(F.concat(F.lit("00"), F.regexp_replace(p, "^0+(?=[0-9])", "")), F.lit(3)) <= "255")),
    ),
    "card": (
        lambda t: t.rlike("[0-9](?:[ -]?[0-9]){15}"),
        lambda t: _joined(t, "0-9", " \\-"),
        f"[0-9][0-9{_JOINT}]*[0-9]",
        lambda h: F.length(_digits(h)).between(16, 19) & luhn(_digits(h)),
    ),
    "phone": (
        lambda t: t.rlike("\\+[0-9]"),
        lambda t: t,
        "\\+[0-9][ ().0-9\\-]+[0-9]",
        lambda h: F.length(_digits(h)).between(8, 15),
    ),
}


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end, hit>>; separators in hits of translated texts stay translated."""
    test, seen_as, pattern, check = RULES[kind]
    found = let(seen_as(text), lambda t: F.filter(located(t, pattern), lambda x: check(x["hit"])))
    return F.when(test(text), F.transform(found, lambda x: F.struct(x["start"], x["end"], x["hit"]))).otherwise(F.array().cast(_SPANS))


#: High recall: any text that holds one of these shapes has candidates.
_GENERATORS = {
    "secret": f"{_run('A-Za-z0-9_+/=\\-')}(?<=[A-Za-z0-9_+/=\\-]{{16}})",
    "quoted": "(?<=[\"'])[^\"'\\s]{12,}+(?=[\"'])",
    "number": "(?<![0-9])[0-9][0-9 ().\\-]{6,}[0-9]",
    "handle": f"{_run('A-Za-z0-9._\\-')} ?[\\[(] ?(?:at|AT) ?[\\])] ?[A-Za-z0-9.\\-]++",
}
_TESTS = {"secret": "[A-Za-z][0-9]|[0-9][A-Za-z]", "quoted": "[\"'][^\"'\\s]{12}", "number": "[0-9][0-9 ().\\-]{6}", "handle": "[\\[(] ?(?:at|AT) ?[\\])]"}
CONTEXT = 24
_NAMED = "(?:token|key|secret|passw(?:or)?d|pwd|auth|bearer|credential|e-?mail|contact|write to|phone|call|account)"


def candidates(text: Column, kind: str) -> Column:
    """array<struct<start, end, hit, before>>, with a few characters of context before each, none of the match before it."""
    found = F.transform(located(text, _GENERATORS[kind]), lambda x: F.struct(x["start"], x["end"], x["hit"], F.right(x["gap"], F.lit(CONTEXT)).alias("before")))
    return F.when(text.rlike(_TESTS[kind]), found).otherwise(F.array().cast("array<struct<start:int,end:int,hit:string,before:string>>"))


FEATURES = ("length", "digit_share", "upper_share", "switches", "hex", "keyword", "assigned", "quoted", "dotted", "spaced")


def features(hit: Column, before: Column) -> list[Column]:
    """Format and context of a candidate, as doubles in the order of FEATURES."""
    n = F.greatest(F.length(hit), F.lit(1)).cast("double")
    count = lambda p: F.length(F.regexp_replace(hit, f"[^{p}]", "")).cast("double")
    yes = lambda c: c.cast("double")
    switches = F.regexp_count(hit, F.lit("[A-Za-z][0-9]|[0-9][A-Za-z]")).cast("double")
    return [
        F.length(hit).cast("double"), count("0-9") / n, count("A-Z") / n, switches / n, yes(hit.rlike("^[0-9a-fA-F]++$")),
        yes(F.lower(before).rlike(_NAMED)),
        yes(before.rlike("[=:] *[\"']?$")), yes(before.rlike("[\"']$")), yes(hit.rlike("[A-Za-z0-9]\\.[A-Za-z]{2,}+$")), count(" ().-") / n,
    ]


#: Borders of the bins that the trees may cut at, by feature: fixed, so no statistics are taken for them.
_SHARES, _FEW, _YES = [i / 20 for i in range(20)], [i / 40 for i in range(20)], [0.5]
EDGES = [[*range(7, 25), 28, 31, 32, 36, 39, 40, 44, 48, 56, 63, 64, 80, 96, 128, 256], _SHARES, _SHARES, _FEW, _YES, _YES, _YES, _YES, _YES, _FEW]
UNIT = 2.0**36  # gradients are summed as whole numbers of its reciprocal, so that sums are the same in any order
STEP = 8192  # groups that are summed at once


def binned(x: np.ndarray, edges: list) -> np.ndarray:
    """Of each value how many borders lie below it."""
    return np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(edges)), np.uint8)


def _upper(bins: np.ndarray, edges: list) -> np.ndarray:
    """A value that trees treat as all values of a bin."""
    return np.stack([np.r_[np.array(e, float), np.inf][bins[:, f]] for f, e in enumerate(edges)], axis=1)


def sums(bins: np.ndarray, y: np.ndarray, w: np.ndarray, trees: list, edges: list) -> np.ndarray:
    """Gradients and curvatures (in parts of UNIT) of each two bins' common rows after these trees; of a bin with itself, of its rows."""
    size = [len(e) + 1 for e in edges]
    first, wide = np.cumsum(size) - size, sum(size)
    out = np.zeros((2, wide * wide))
    for lo in range(0, len(bins), STEP):
        b = bins[lo : lo + STEP]
        p = 1 / (1 + np.exp(-predict(_upper(b, edges), trees)))
        at = first + b
        pair = (at[:, :, None] * wide + at[:, None, :]).ravel()
        for i, v in enumerate((y[lo : lo + STEP] - p, p * (1 - p))):
            out[i] += np.bincount(pair, np.repeat(np.rint(v * w[lo : lo + STEP] * UNIT), len(edges) ** 2), wide * wide)
    return out.reshape(2, wide, wide)


def grow(summed, edges: list, trees: int, rate: float) -> list:
    """Boosted trees of depth two for logistic loss: [(f, cut, (left f, cut, lo, hi), (right ...)), ...]. summed(trees): as ``sums``."""
    size = [len(e) + 1 for e in edges]
    own = [slice(n - k, n) for n, k in zip(np.cumsum(size), size)]

    def stump(part: np.ndarray) -> tuple:
        """Of a node's sums by bin: feature, place of the border, border, and the sums on both sides."""
        gs, hs = part[:, own[0]].sum(axis=1)
        best = (0.0, 0, -1)
        for f, at in enumerate(own):
            gl, hl = np.cumsum(part[:, at], axis=1)[:, :-1]
            gain = gl**2 / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs**2 / (hs + 1)
            i = int(np.argmax(gain)) if len(gain) else -1
            if i >= 0 and gain[i] > best[0] + 1e-9:
                best = (gain[i], f, i)
        _, f, i = best
        left = part[:, own[f]][:, : i + 1].sum(axis=1)
        return f, i, float(edges[f][i]) if i >= 0 else float("-inf"), left, np.array([gs, hs]) - left

    leaf = lambda v: float(round(rate * v[0] / (v[1] + 1), 9))
    out: list = []
    for _ in range(trees):
        both = summed(out) / UNIT
        whole = np.stack([both[i].diagonal() for i in (0, 1)])
        f, i, c, *_ = stump(whole)
        left = both[:, own[f]][:, : i + 1].sum(axis=1)
        sides = [(f2, c2, leaf(lo), leaf(hi)) for f2, _, c2, lo, hi in map(stump, (left, whole - left))]
        out.append((f, c, *sides))
    return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE) -> list:
    """``grow`` on rows at hand, with borders at their quantiles."""
    edges = [np.unique(np.quantile(v, np.linspace(0.05, 0.95, 19), method="lower")).tolist() for v in x.T]
    return grow(lambda grown: sums(binned(x, edges), y, np.ones(len(y)), grown, edges), edges, trees, rate)


def predict(x: np.ndarray, trees: list) -> np.ndarray:
    z = np.zeros(len(x))
    for f, c, left, right in trees:
        for side, rows in ((left, x[:, f] <= c), (right, x[:, f] > c)):
            z += np.where(rows, np.where(x[:, side[0]] <= side[1], side[2], side[3]), 0)
    return z


def as_column(xs: list[Column], trees: list) -> Column:
    """predict() as an expression."""
    half = lambda t: F.when(xs[t[0]] <= t[1], F.lit(t[2])).otherwise(F.lit(t[3]))
    out = F.lit(0.0)
    for f, c, left, right in trees:
        out = out + F.when(xs[f] <= c, half(left)).otherwise(half(right))
    return out


def threshold(z: np.ndarray, y: np.ndarray, precision: float = PRECISION, w: np.ndarray | None = None) -> float:
    """The least score from which on at least that share (by weight) is positive; infinite if there is none."""
    o = np.argsort(-z, kind="stable")
    w = np.ones(len(z)) if w is None else w
    good = np.cumsum((y * w)[o]) / np.cumsum(w[o])
    last = np.r_[z[o][1:] != z[o][:-1], True] if len(z) else np.zeros(0, bool)
    ok = np.flatnonzero((good >= precision) & last)
    return float(z[o][ok[-1]]) if len(ok) else float("inf")


#: Without candidates that can be learnt from: candidates with a naming word, an assignment and both digits and letters.
DEFAULT = {"trees": [(5, 0.5, (0, 0.0, -2.0, -2.0), (6, 0.5, -0.5, 2.0))], "threshold": 1.0, "source": "default rule"}
_RANGE = 1 << 31
_WHOLE = 1 << 40  # the weight of one candidate
_FINE = 1024  # scores are told apart in steps of its reciprocal when a threshold is chosen


def _default(why: str) -> dict:
    warnings.warn(f"the trees can't be fitted ({why}); named and assigned candidates are redacted", stacklevel=3)
    return DEFAULT


def train(docs: DataFrame, weight: int = WEIGHT, at_hand: int = GROUPS) -> dict:
    """Trees and threshold from all distinct candidates; those of a kind and label weigh as much as weight / 8 of them, if they are more.

    Candidates of equal bins, label and half are one group with a weight.  At most ``at_hand`` groups are summed up on the
    driver, more of them by a Spark job a tree; sums are of whole numbers, so both give the same model.
    Where the candidates can't be learnt from, or no threshold reaches the precision, the model is DEFAULT, with a warning.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def named(kind: str) -> Column:
        return F.transform(candidates(text, kind), lambda c: F.struct(F.lit(kind).alias("kind"), c["hit"].alias("hit"), c["before"].alias("before")))

    found = docs.filter(text.rlike("|".join(_TESTS.values()))).select(F.explode(F.concat(*map(named, _GENERATORS))).alias("c")).select("c.*")
    # a weak label: assigned to a named secret, or an address that is contacted; never the only evidence of a score
    found = found.withColumn("y", F.lower("before").rlike(_NAMED).cast("int"))
    # copies of a candidate are one, whose context is the least of them
    once = cut(found.groupBy("kind", "hit", "y").agg(F.min("before").alias("before")))
    many = {(r.kind, r.y): r.n for r in once.groupBy("kind", "y").agg(F.count("*").alias("n")).collect()}  # two rows a kind
    if len({y for _, y in many}) < 2:
        return _default("the candidates have not both labels")
    quota, w = weight // (2 * len(_GENERATORS)), F.lit(0)
    for (kind, y), n in sorted(many.items()):
        w = F.when((F.col("kind") == kind) & (F.col("y") == y), F.lit(int(min(1.0, quota / n) * _WHOLE))).otherwise(w)
    learn = F.crc32(F.col("hit").cast("binary")) % 2 == 0  # a text is in one half
    seen = once.select(_bins(features(F.col("hit"), F.col("before"))).alias("bins"), "y", learn.alias("learn"), w.cast("long").alias("w"))
    groups = cut(seen.groupBy("bins", "y", "learn").agg(F.sum("w").alias("w")))
    halves = {(r.learn, r.y) for r in groups.select("learn", "y").distinct().collect()}
    if len(halves) < 4 and not {(True, 0), (True, 1), (False, 1)} <= halves:
        return _default("a half of the candidates has not both labels")
    few = groups.limit(at_hand + 1).toArrow() if at_hand else None  # bounded
    if few is not None and few.num_rows <= at_hand:
        part = lambda half: _arrays(few.filter(pc.equal(few.column("learn"), half)))
        fitted = part(True)
        trees = grow(lambda grown: sums(*fitted, grown, EDGES), EDGES, TREES, RATE)
        z, y, w = _scored(part(False), trees)
    else:
        trees = grow(lambda grown: _summed(groups.filter("learn"), grown), EDGES, TREES, RATE)
        z, y, w = _all_scored(groups.filter("not learn"), trees)
    least = threshold(z, y, PRECISION, w)
    if not np.isfinite(least):
        return _default("no threshold reaches the precision")
    return {"trees": trees, "threshold": least / _FINE, "source": "fitted"}


def _bins(xs: list[Column]) -> Column:
    """``binned`` as a column, the label's own feature blank."""
    below = lambda x, e: F.size(F.filter(F.lit([float(v) for v in e]), lambda v: v < x))
    return F.array(*[F.lit(0) if name == "keyword" else below(x, e) for name, x, e in zip(FEATURES, xs, EDGES)])


def _arrays(groups: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, labels and weights (in candidates) of groups."""
    bins = np.array(groups.column("bins").to_pylist(), np.uint8).reshape(-1, len(FEATURES))
    return bins, groups.column("y").to_numpy().astype(float), groups.column("w").to_numpy().astype(float) / _WHOLE


def _scored(groups: tuple, trees: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores in steps of 1 / _FINE, labels and weights of groups."""
    bins, y, w = groups
    return np.floor(predict(_upper(bins, EDGES), trees) * _FINE), y, w


def _score(trees: list) -> Column:
    """``predict`` of a group's bins as an expression."""
    return as_column([F.get(F.lit([*map(float, e), float("inf")]), F.col("bins")[f]) for f, e in enumerate(EDGES)], trees)


def _summed(groups: DataFrame, trees: list) -> np.ndarray:
    """``sums`` of all groups, by a job."""
    size = [len(e) + 1 for e in EDGES]
    wide, first = sum(size), [int(n) for n in np.cumsum(size) - size]
    p, w = 1 / (1 + F.exp(-F.col("z"))), F.col("w") / F.lit(float(_WHOLE)) * UNIT
    told = groups.withColumn("z", _score(trees)).withColumn("p", p)
    told = told.select(F.zip_with("bins", F.lit(first), lambda b, n: b + n).alias("at"), F.rint((F.col("y") - F.col("p")) * w).cast("long").alias("g"), F.rint(F.col("p") * (1 - F.col("p")) * w).cast("long").alias("h"))
    pairs = told.select("at", "g", "h", F.explode("at").alias("a")).select("a", "g", "h", F.explode("at").alias("b"))
    got = pairs.groupBy((F.col("a") * wide + F.col("b")).alias("at")).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()  # a row for two bins
    out = np.zeros((2, wide * wide))
    for i, c in enumerate(("g", "h")):
        out[i, got.column("at").to_numpy()] = got.column(c).to_numpy()
    return out.reshape(2, wide, wide)


def _all_scored(groups: DataFrame, trees: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_scored`` of all groups, a row for a step of the score and a label."""
    got = groups.groupBy(F.floor(_score(trees) * _FINE).cast("double").alias("z"), "y").agg(F.sum("w").alias("w")).toArrow()
    return got.column("z").to_numpy(), got.column("y").to_numpy().astype(float), got.column("w").to_numpy().astype(float) / _WHOLE


def _apart(spans: Column, taken: Column) -> Column:
    """The spans that overlap none of taken: a running maximum of ends from the left, of starts from the right."""
    tagged = lambda xs, free: F.transform(xs, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), F.lit(free).alias("free")))
    most = lambda a, b: F.greatest(a, b)

    def kept(v: Column) -> Column:
        before = scan(F.transform(v, lambda x: F.when(x["free"], -1).otherwise(x["end"])), most, -1)
        after = F.reverse(scan(F.transform(F.reverse(v), lambda x: F.when(x["free"], -_RANGE + 1).otherwise(-x["start"])), most, -_RANGE + 1))
        near = F.zip_with(before, after, lambda a, b: F.struct(a.alias("a"), (-b).alias("b")))
        fine = F.zip_with(v, near, lambda x, n: F.struct(x["start"], x["end"], x["hit"], (x["free"] & (n["a"] <= x["start"]) & (n["b"] >= x["end"])).alias("fine")))
        return F.transform(F.filter(fine, lambda x: x["fine"]), lambda x: F.struct(x["start"], x["end"], x["hit"]))

    return F.when(F.size(spans) > 0, let(F.array_sort(F.concat(tagged(taken, False), tagged(spans, True))), kept)).otherwise(F.array().cast(_SPANS))


def spans(docs: DataFrame, model: dict) -> DataFrame:
    """docs and, by kind, an array of its spans (start, end, hit): base ones and those that the trees add."""
    out = docs.withColumn("_t", F.coalesce(F.col("text"), F.lit("")))
    for kind in BASE:
        out = out.withColumn(f"_{kind}", base_spans(F.col("_t"), kind))
    taken = F.concat(*[F.col(f"_{k}") for k in BASE])
    score = lambda c: let(F.array(*features(c["hit"], c["before"])), lambda x: as_column([x[i] for i in range(len(FEATURES))], model["trees"]))
    for kind in ADDED:
        added = F.filter(candidates(F.col("_t"), kind), lambda c: score(c) >= model["threshold"])
        out = out.withColumn(f"_{kind}", _apart(added, taken))
        taken = F.concat(taken, F.col(f"_{kind}"))
    return out.drop("_t")


def _listed(kinds: tuple) -> Column:
    def of(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.array_join(F.concat(*map(of, kinds)), ",")


def digests(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, n_ of each kind, base_sha256 and spans."""
    s = spans(docs.select("doc_id", "text"), model)
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return s.select("doc_id", *counts[: len(BASE)], F.sha2(_listed(BASE), 256).alias("base_sha256"), _listed(KINDS).alias("spans"), *counts[len(BASE) :])


BLOCK = 4096


def _between(segments: Column, a: Column, b: Column) -> Column:
    """Characters a to b (exclusive) of a text that lies in segments of BLOCK characters."""
    first = F.floor(a / BLOCK).cast("int")
    some = F.slice(segments, first + 1, F.greatest(F.floor((b - 1) / BLOCK).cast("int") - first + 1, F.lit(0)))
    lo = lambda i: F.greatest(a - (first + i) * BLOCK, F.lit(0))
    part = lambda s, i: F.substring(s, lo(i) + 1, F.least(b - (first + i) * BLOCK, F.lit(BLOCK)) - lo(i))
    return F.array_join(F.transform(some, part), "")


def _redacted(text: Column, marks: Column) -> Column:
    """text with each of marks (start, end, kind; in order) replaced by its kind; one that overlaps an earlier one vanishes in it."""

    def built(v: Column) -> Column:
        ends = scan(F.transform(v, lambda x: x["end"]), lambda a, b: F.greatest(a, b), 0)
        cuts = F.zip_with(v, ends, lambda x, at: F.struct(at.alias("at"), x["start"].alias("start"), x["kind"].alias("kind")))
        cuts = F.filter(cuts, lambda x: x["start"] >= x["at"])
        whole = lambda s: F.concat(
            F.array_join(F.transform(cuts, lambda x: F.concat(_between(s, x["at"], x["start"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))), ""),
            _between(s, F.array_max(F.transform(v, lambda x: x["end"])), F.length(text)),
        )
        return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), whole)

    return let(marks, built)


def redact(docs: DataFrame, model: dict) -> DataFrame:
    """docs with each span's text replaced by its kind in brackets; overlapping spans become one of the first's kind."""
    s = spans(docs.select(F.struct("*").alias("row"), "text"), model)  # so that no column of docs meets one of ours

    def named(kind: str) -> Column:
        return F.transform(F.col(f"_{kind}"), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(kind).alias("kind")))

    every = F.concat(*map(named, KINDS))
    text = F.col("text")
    return s.select(F.col("row").withField("text", F.when(F.size(every) > 0, _redacted(text, F.array_sort(every))).otherwise(text)).alias("row")).select("row.*")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digests(docs, train(docs))
