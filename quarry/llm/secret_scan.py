"""Secret scans: fixed patterns plus a randomness test battery, in native expressions.

Candidates are runs of key characters. Each gets an inferred encoding (decimal, hex, base32,
alphanumeric, base64 or base64url) and, over that alphabet, three tests of the hypothesis that
it is random: chi-squared uniformity, runs about the middle of the alphabet, and lag-one serial
correlation. Against it stands the hypothesis that the run is text: under the symbol shares that the
whole corpus's text has over that alphabet more of its symbols would be equal. That p-value is rounded up to
a tenth of a decade, counted by length class, and the Benjamini-Hochberg bound is read off those
few counts (each class is weighted by how much its lengths can tell). A candidate becomes a `random`
span if the bound rejects text and no test, corrected for their number, rejects randomness.

Spans are code points, end exclusive, of whole matches.

Cases: a null text is empty and has no spans; repeated rows are scanned each; overlapping kinds are all
kept, but a random span inside a span of the fixed patterns is not repeated; an empty table gives an
empty result; other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import scratch, text_of

#: The base patterns. A longer minimum inside the pattern is the same as dropping short
#: matches where the pattern's match is a maximal run; the assignment's is not, so it is filtered.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
KINDS = ("assign", "access", "hex", "random")
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"


@dataclass(frozen=True)
class BatterySettings:
    false_discovery: float = 0.01
    least_random: float = 0.001
    #: Sum of squared symbol shares of text over an alphabet, relative to 1 / alphabet size, where the corpus has no such symbol.
    text_skew: float = 2.0
    steps: int = 10
    classes: tuple[int, ...] = (28, 40, 64, 128)


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the leftmost non-overlapping matches; positions are code points.

    The pieces between the matches give the positions: the k-th match starts after k + 1 pieces and k matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(acc: Column, z: Column) -> Column:
        at = acc.at + F.length(z.piece)
        end = at + F.coalesce(F.length(z.value), F.lit(0))
        more = F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(at.alias("start"), end.alias("end"), z.value.alias("value")))).alias("out"))
        return F.when(z.value.isNull(), acc).otherwise(more)

    # one piece more than matches: the last one has no value
    zipped = F.zip_with(pieces, found, lambda p, v: F.struct(p.alias("piece"), v.alias("value")))
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    return F.when(text.rlike(pattern), F.aggregate(zipped, start, step, lambda acc: acc.out)).otherwise(none)


def _normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal: Abramowitz and Stegun 26.2.17, below 8 its relative error is small enough."""
    x = F.least(F.abs(z), F.lit(8.0))
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * x)
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    p = F.greatest(F.exp(-x * x / 2) * F.lit(0.3989422804014327) * poly, F.lit(1e-15))
    return F.when(z >= 0, p).otherwise(F.lit(1.0) - p)


#: Alphabets by inferred encoding, in the order of their symbols.
ALPHABETS = {
    "decimal": "0123456789",
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "lower36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
    "mixed": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_",
}
#: Text of one case is measured on the letters of both.
FOLDED = {"hex": str.lower, "HEX": str.upper, "base32": str.upper, "lower36": str.lower}


def encoding(body: Column) -> Column:
    """Runs with both pairs of base64's last two symbols are `mixed`: neither kind of base64 writes them."""
    return (
        F.when(body.rlike("^[0-9]+$"), "decimal").when(body.rlike("^[0-9a-f]+$"), "hex").when(body.rlike("^[0-9A-F]+$"), "HEX")
        .when(body.rlike("^[A-Z2-7]+$"), "base32").when(body.rlike("^[0-9a-z]+$"), "lower36").when(body.rlike("^[0-9A-Za-z]+$"), "base62")
        .when(body.rlike("^[0-9A-Za-z+/]+$"), "base64").when(body.rlike("^[0-9A-Za-z_-]+$"), "base64url").otherwise("mixed")
    )


def text_moments(docs: DataFrame, s: BatterySettings, text: str = "text") -> dict[str, tuple[float, float]]:
    """Encoding -> sums of the squared and of the cubed symbol shares of the corpus's text outside the candidates.

    Every document is counted; one row a symbol comes to the driver."""
    symbols = ALPHABETS["mixed"]
    plain = F.array(F.regexp_replace(text_of(text), CANDIDATE, " "))
    # a lambda variable, so that the candidates are cut out once and not once a symbol
    counts = F.transform(plain, lambda t: F.array(*[F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in symbols]))
    got = docs.select(F.posexplode(F.element_at(counts, 1)).alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect()
    seen = {symbols[r["at"]]: r["n"] for r in got}
    out = {}
    for name, alphabet in ALPHABETS.items():
        fold = FOLDED.get(name, str)
        n = dict.fromkeys(alphabet, 0)
        for c, m in seen.items():
            if fold(c) in n:
                n[fold(c)] += m
        total = sum(n.values())
        square = s.text_skew / len(alphabet)
        out[name] = (sum((x / total) ** 2 for x in n.values()), sum((x / total) ** 3 for x in n.values())) if total else (square, 1.25 * square**2)
    return out


def battery(candidates: Column, s: BatterySettings, moments: dict[str, tuple[float, float]]) -> Column:
    """Array of (start, end, value) -> array of (start, end, enc, n, p_text, p_random); `moments` as of `text_moments`.

    Every step is an array of structs, so that each quantity is computed once."""
    letters = F.transform(
        candidates,
        lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), F.rtrim(c.value, F.lit("=")).alias("body")),
    )
    coded = F.transform(letters, lambda c: F.struct(c.start.alias("start"), c.end.alias("end"), c.body.alias("body"), encoding(c.body).alias("enc")))
    alphabet = F.create_map(*[F.lit(x) for kv in ALPHABETS.items() for x in kv])
    square, cube = (F.create_map(*[F.lit(x) for k, v in moments.items() for x in (k, v[i])]) for i in range(2))
    indexed = F.transform(
        coded,
        lambda c: F.struct(
            c.start.alias("start"), c.end.alias("end"), c.enc.alias("enc"), F.length(alphabet[c.enc]).cast("double").alias("k"),
            F.transform(F.filter(F.split(c.body, ""), lambda x: x != ""), lambda x: F.call_function("instr", alphabet[c.enc], x).cast("double")).alias("x"),
        ),
    )
    sums = F.transform(
        indexed,
        lambda c: F.struct(
            c.start.alias("start"), c.end.alias("end"), c.enc.alias("enc"), c.k.alias("k"), F.size(c.x).cast("double").alias("n"),
            # equal pairs: sum of squared symbol counts, from the sorted symbols' runs
            F.aggregate(
                F.array_sort(c.x),
                F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("squares")),
                lambda a, v: F.struct(
                    v.alias("last"),
                    F.when(a.last == v, a.run + 1).otherwise(F.lit(1.0)).alias("run"),
                    # a run grown to r adds 2r - 1 to the sum of squares
                    (a.squares + F.when(a.last == v, F.lit(2.0) * a.run + 1).otherwise(F.lit(1.0))).alias("squares"),
                ),
                lambda a: a.squares,
            ).alias("squares"),
            F.aggregate(
                c.x,
                F.struct(*[F.lit(v).alias(n) for n, v in (("last", -1.0), ("sum", 0.0), ("sq", 0.0), ("lag", 0.0), ("runs", 0.0), ("high", 0.0))]),
                lambda a, v: F.struct(
                    v.alias("last"), (a["sum"] + v).alias("sum"), (a.sq + v * v).alias("sq"),
                    (a.lag + F.when(a.last >= 0, a.last * v).otherwise(F.lit(0.0))).alias("lag"),
                    (a.runs + F.when((a.last < 0) | ((a.last * 2 > c.k) != (v * 2 > c.k)), F.lit(1.0)).otherwise(F.lit(0.0))).alias("runs"),
                    (a.high + F.when(v * 2 > c.k, F.lit(1.0)).otherwise(F.lit(0.0))).alias("high"),
                ),
            ).alias("m"),
            F.element_at(c.x, 1).alias("x1"), F.element_at(c.x, -1).alias("xn"),
        ),
    )

    def scores(c: Column) -> Column:
        n, k = c.n, c.k
        chi = k / n * c.squares - n
        # Wilson-Hilferty: the cube root of chi-squared over its degrees of freedom is nearly normal
        spread = F.lit(2.0) / (F.lit(9.0) * (k - 1))
        z_chi = (F.pow(F.greatest(chi, F.lit(0.0)) / (k - 1), F.lit(1 / 3)) - (F.lit(1.0) - spread)) / F.sqrt(spread)
        # of text: mean and variance of the number of equal pairs under the corpus's shares; its cube root is nearly normal
        p2, p3, pairs = square[c.enc], cube[c.enc], n * (n - 1) / 2
        expected = pairs * p2
        variance_text = pairs * (F.lit(2.0) * (n - 2) * F.greatest(p3 - p2 * p2, F.lit(0.0)) + F.greatest(p2 - p2 * p2, F.lit(1e-9)))
        relative = variance_text / (expected * expected * 9)
        z_text = (F.lit(1.0) - relative - F.pow(((c.squares - n) / 2 + 0.5) / expected, F.lit(1 / 3))) / F.sqrt(relative)
        low = n - c.m.high
        both = F.greatest(c.m.high * low, F.lit(0.5))
        runs_mean = F.lit(2.0) * both / n + 1
        runs_sd = F.sqrt(F.greatest((runs_mean - 1) * (runs_mean - 2) / (n - 1), F.lit(0.25)))
        mu = c.m["sum"] / n
        variance = F.greatest(c.m.sq - n * mu * mu, F.lit(1e-9))
        lag = c.m.lag - mu * (F.lit(2.0) * c.m["sum"] - c.x1 - c.xn) + (n - 1) * mu * mu
        return F.struct(
            c.start.alias("start"), c.end.alias("end"), c.enc.alias("enc"), c.n.cast("int").alias("n"),
            z_chi.alias("z_chi"), ((c.m.runs - runs_mean) / runs_sd).alias("z_runs"),
            ((lag / variance + F.lit(1.0) / n) * F.sqrt(n)).alias("z_serial"), z_text.alias("z_text"),
        )

    def tails(c: Column) -> Column:
        two = lambda z: F.lit(2.0) * _normal_tail(F.abs(z))
        worst = F.least(_normal_tail(c.z_chi), two(c.z_runs), two(c.z_serial))
        return F.struct(
            c.start.alias("start"), c.end.alias("end"), c.enc.alias("enc"), c.n.alias("n"),
            _normal_tail(c.z_text).alias("p_text"), F.least(worst * 3, F.lit(1.0)).alias("p_random"),
        )

    return F.transform(F.transform(sums, scores), tails)


def length_class(n: Column, s: BatterySettings) -> Column:
    out = F.lit(len(s.classes))
    for i, top in reversed(list(enumerate(s.classes))):
        out = F.when(n < top, F.lit(i)).otherwise(out)
    return out


def step_of(p: Column, s: BatterySettings) -> Column:
    """p rounded up to a step: 10 ** (-step / steps), so a decision by steps is never bolder."""
    return F.floor(-F.log10(F.greatest(p, F.lit(1e-15))) * s.steps).cast("int")


def discovery_bounds(steps: DataFrame, s: BatterySettings) -> dict[int, int]:
    """(cls, step) of all candidates -> least step that is a discovery, by length class (none: a step never reached).

    Weighted Benjamini-Hochberg on rounded-up p-values: class c counts its p-values divided by its
    weight; weights are in proportion to the class's rank and average to one over the candidates.
    The counts have at most a few hundred rows, whatever the input's size."""
    counts = {(r.cls, r.step): r.n for r in steps.groupBy("cls", "step").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    never = 10_000
    if not total:
        return dict.fromkeys(range(len(s.classes) + 1), never)
    mean = sum((c + 1) * n for (c, _), n in counts.items()) / total
    weight = {c: (c + 1) / mean for c in range(len(s.classes) + 1)}
    order = sorted(counts, key=lambda x: 10 ** (-x[1] / s.steps) / weight[x[0]])
    found, bound = 0, 0.0
    for i, at in enumerate(order):
        found += counts[at]
        p = 10 ** (-at[1] / s.steps) / weight[at[0]]
        nxt = 10 ** (-order[i + 1][1] / s.steps) / weight[order[i + 1][0]] if i + 1 < len(order) else None
        if nxt != p and p <= s.false_discovery * found / total:
            bound = p
    return {c: min((st for st in range(0, 15 * s.steps + 1) if 10 ** (-st / s.steps) / w <= bound), default=never) for c, w in weight.items()}


def secret_spans(docs: DataFrame, s: BatterySettings = BatterySettings(), text: str = "text") -> DataFrame:
    """`docs` plus one struct column (first free name of `secrets`): counts by kind, base spans and all spans as
    arrays of (start, rank of the kind, end, kind), in order."""
    t = text_of(text)
    col, cand, fixed = scratch(docs, "secrets", "candidates", "fixed")
    key = lambda c: F.struct(length_class(c.n, s).alias("cls"), step_of(c.p_text, s).alias("step"))
    moments = text_moments(docs, s, text)
    seen = docs.select(battery(matches(t, CANDIDATE), s, moments).alias("c")).select(F.explode(F.transform("c", key)).alias("k")).select("k.*")
    bounds = discovery_bounds(seen, s)
    least = F.create_map(*[F.lit(x) for kv in sorted(bounds.items()) for x in kv])

    def spans(kind: str, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(m.start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), m.end.alias("end"), F.lit(kind).alias("kind")))

    value = lambda m: F.length(F.regexp_extract(m.value, "^" + ASSIGN, 2))
    df = docs.withColumn(fixed, F.struct(
        F.filter(matches(t, ASSIGN), lambda m: value(m) >= ASSIGN_LEAST).alias("assign"), matches(t, ACCESS).alias("access"), matches(t, HEX).alias("hex"),
    )).withColumn(cand, battery(matches(t, CANDIDATE), s, moments))
    f = F.col(fixed)
    base = F.array_sort(F.concat(*[spans(k, f[k]) for k in KINDS[:3]]))
    df = df.withColumn(col, F.struct(F.size(f.assign).cast("long").alias("n_assign"), F.size(f.access).cast("long").alias("n_access"), F.size(f.hex).cast("long").alias("n_hex"), base.alias("base")))
    b = F.col(col)
    random = F.filter(
        F.col(cand),
        lambda c: (step_of(c.p_text, s) >= least[length_class(c.n, s)]) & (c.p_random >= s.least_random)
        & ~F.exists(b.base, lambda m: (m.start <= c.start) & (m.end >= c.end)),
    )
    return df.withColumn(col, b.withField("spans", F.array_sort(F.concat(b.base, spans("random", random))))).drop(cand, fixed)


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", m.kind, m.start.cast("string"), m.end.cast("string"))), ",")
