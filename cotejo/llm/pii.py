"""Personal data in texts: candidate spans, boosted trees and calibrated thresholds, DataFrame functions only.

1. Generators, one regular expression each, propose spans with a high recall; spans of
   different generators may overlap.  Four of them are the base patterns, whose matches
   stay if they pass their kind's test (octets, Luhn sum, number of digits).  The others
   propose what these miss: spelt addresses, IPv6, cards and local numbers in other
   spellings, and secrets (keys, tokens, passwords), a kind without a base pattern.
2. Every candidate has a few coarse features of its format and its context.  A candidate is
   taken as a positive example if it is a base match that passes or overlaps one that does,
   or if it passes a test of its own form (SOUND), which the features tell only in part.
   Counts of examples by feature values, over all documents, are one bounded table.
3. Boosted trees are fitted on that table's even half (by a hash of the text), and each
   kind's threshold is the lowest score from which on the odd half's candidates, without
   those that are base spans anyway, are positive in at least ``PRECISION`` of cases.
4. The trees are then an expression of ``CASE WHEN``; candidates at or above their kind's
   threshold that overlap no base span of the kind are added to the base spans.

The share of positives is that of the odd half's candidates together with ``PRIOR`` imagined
ones of which ``PRECISION`` are positive, whatever the table's size.  A kind without any
positive in the odd half has no threshold, and nothing is added to its base spans.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

KINDS = ("email", "ip", "card", "phone")
#: Those and the kind that has no base pattern; spans are listed in this order.
ALL = (*KINDS, "secret")
#: Share of positives that added candidates must have among held-back ones, and how many imagined ones count with these.
PRECISION, PRIOR = 0.95, 10
#: Trees, their depth, step size, and the least examples on either side of a split.
TREES, DEPTH, STEP, LEAF = 16, 3, 0.3, 1

#: Generators: name, kind, pattern.  Matches start where a run starts (or where the last
#: match ended) and take runs whole, which matches the same spans as without that, in
#: time linear in the text.
GENERATORS = (
    ("email", "email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", "card", r"[0-9](?:[ -]?+[0-9])++"),
    ("phone", "phone", r"\+[0-9][ ().0-9-]+[0-9]"),
    ("email_spelt", "email", r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++ ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]++(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z0-9-]++)++"),
    ("ip_v6", "ip", r"(?i)(?:\G|(?<![0-9a-z:]))(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![0-9a-z:])"),
    ("card_spaced", "card", r"(?:\G|(?<![0-9]))[0-9]{4}(?:[ .-][0-9]{3,6}){2,4}(?![0-9])"),
    ("phone_local", "phone", r"(?:\G|(?<![0-9]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"),
    ("secret_named", "secret", r"(?i)(?<=(?:token|secret|password|passwd|key|auth|credential)[\x22\x27]? {0,2}[=:] {0,2}[\x22\x27]?)(?<![A-Za-z0-9_+/.-])[A-Za-z0-9_+/.-]{8,}+"),
    ("secret_run", "secret", r"(?:\G|(?<![A-Za-z0-9_+/-]))(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{20,}+"),
)
#: A text without this has no match of the generator.
NEEDS = {"email": "instr({t}, '@') > 0", "email_spelt": "{t} rlike '(?i)[ (\\\\[]dot[ )\\\\]]'", "ip_v6": "instr({t}, ':') > 0", "phone": "instr({t}, '+') > 0", "secret_named": "{t} rlike '[=:]'", "secret_run": "{t} rlike '[A-Za-z0-9_+/-]{{20}}'"}

#: Words before a candidate that tell its context.
CONTEXT = (("mail|contact|write", 1), ("tel|phone|call|fax|mobile", 2), ("card|visa|credit|pay", 3), ("host|server|addr|client|ip", 4), ("token|key|secret|pass|auth|credential", 5), ("sha|hash|version|order|isbn|commit", 6))

#: Tests that make a candidate of the other generators a positive example: SQL over the match and the text before it.
SOUND = {
    "email_spelt": "{m} rlike '(?i)(com|org|net|edu|gov|info|io|eu|de|fr|es|uk)$'",
    "ip_v6": "true",
    "card_spaced": "length(regexp_replace({m}, '[^0-9]', '')) BETWEEN 13 AND 19 AND " + "{luhn}",
    "secret_named": "length({m}) >= 16 AND {m} rlike '[0-9]' AND {m} rlike '[A-Za-z]' AND {varied}",
    "secret_run": "{varied} AND ({m} rlike '^([0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$' OR {before} rlike '(?i)(token|secret|password|passwd|key|auth|credential)[^A-Za-z0-9]{{1,6}}$')",
    "phone_local": "{before} rlike '(?i)(tel|phone|call|fax|mobile)[^a-z0-9]*$'",
}

FEATURES = ("generator", "length", "digits", "marks", "before", "after", "context", "check")
#: Whether a match has at least eight different characters.
VARIED = "size(array_distinct(split({m}, ''))) >= 8"


def literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


#: The sum that the last digit of a card number completes to a multiple of ten.
LUHN = (
    "aggregate(sequence(1, length({d})), 0, (total, at) -> total + CASE WHEN (length({d}) - at) % 2 = 1 "
    "THEN 2 * (ascii(substring({d}, at, 1)) - 48) - CASE WHEN ascii(substring({d}, at, 1)) > 52 THEN 9 ELSE 0 END "
    "ELSE ascii(substring({d}, at, 1)) - 48 END) % 10 = 0"
)


def passes(kind: str, match: str) -> str:
    """SQL: whether a match of a base pattern passes its kind's test."""
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"forall(split({match}, '[.]'), p -> p rlike '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$')",
        "card": f"CASE WHEN length({digits}) BETWEEN 16 AND 19 THEN {LUHN.format(d=digits)} ELSE false END",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def check(kind: str, match: str) -> str:
    digits = f"regexp_replace({match}, '[^0-9]', '')"
    if kind == "card":
        return f"CASE WHEN length({digits}) BETWEEN 12 AND 19 THEN CAST({LUHN.format(d=digits)} AS INT) ELSE 0 END"
    return "0"


def character(c: str) -> str:
    """SQL: what kind of character one is: none, white space, letter, digit, or another."""
    return f"CASE WHEN {c} = '' THEN 0 WHEN {c} rlike '\\\\s' THEN 1 WHEN {c} rlike '\\\\p{{L}}' THEN 2 WHEN {c} rlike '[0-9]' THEN 3 ELSE 4 END"


def candidates(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, an array column for each generator of its candidates, and half (0 or 1, by a hash of the text)."""
    t = "_text"
    rows = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(t))
    need = lambda name: NEEDS.get(name, "{t} rlike '[0-9]'").format(t=t)
    rows = rows.select("*", *(F.expr(f"CASE WHEN {need(n)} THEN regexp_extract_all({t}, {literal(p)}, 0) ELSE array() END").alias(f"m_{n}") for n, _, p in GENERATORS))
    rows = rows.select("*", *(F.expr(f"CASE WHEN size(m_{n}) > 0 THEN split({t}, {literal(p)}, -1) ELSE array() END").alias(f"g_{n}") for n, _, p in GENERATORS))
    starts = (
        "CASE WHEN size(m_{n}) > 0 THEN aggregate(sequence(0, size(m_{n}) - 1), named_struct('s', CAST(array() AS ARRAY<INT>), 'p', 0), "
        "(a, i) -> named_struct('s', array_append(a.s, a.p + length(g_{n}[i])), 'p', a.p + length(g_{n}[i]) + length(m_{n}[i])), a -> a.s) "
        "ELSE CAST(array() AS ARRAY<INT>) END"
    )
    rows = rows.select("*", *(F.expr(starts.format(n=n)).alias(f"s_{n}") for n, _, _ in GENERATORS))
    context = lambda before: "CASE " + " ".join(f"WHEN {before} rlike '(?i)\\\\b({w})' THEN {k}" for w, k in CONTEXT) + " ELSE 0 END"
    out = []
    for k, (n, kind, _) in enumerate(GENERATORS):
        m = f"m_{n}[i]"
        fields = {
            "start": "s", "end": f"s + length({m})", "valid": passes(kind, m) if n == kind else "false",
            "sound": SOUND.get(n, "false").format(m=m, before=f"right(g_{n}[i], 24)", luhn=LUHN.format(d=f"regexp_replace({m}, '[^0-9]', '')"), varied=VARIED.format(m=m)),
            "generator": str(k), "length": f"least(16, cast(length({m}) / 4 as int))", "digits": f"least(20, length(regexp_replace({m}, '[^0-9]', '')))", "marks": f"least(6, length(regexp_replace({m}, '[A-Za-z0-9]', '')))",
            "before": character(f"right(g_{n}[i], 1)"), "after": character(f"left(g_{n}[i + 1], 1)"), "context": context(f"right(g_{n}[i], 24)"), "check": check(kind, m),
        }
        made = ", ".join(f"'{f}', {e}" for f, e in fields.items())
        out.append(F.expr(f"transform(s_{n}, (s, i) -> named_struct({made}))").alias(n))
    return rows.select(*keep, *out, F.pmod(F.xxhash64(t), F.lit(2)).cast("int").alias("half"))


def base(kind: str) -> Column:
    return F.filter(F.col(kind), lambda c: c["valid"])


def overlaps(c: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]))


def examples(found: DataFrame) -> list[dict]:
    """How many candidates have which features, by label and half: a table whose size the features bound."""

    def labelled(name: str, kind: str) -> Column:
        label = lambda c: c["valid"] if name == kind else c["sound"] if kind not in KINDS else c["sound"] | overlaps(c, base(kind))
        return F.transform(F.col(name), lambda c: F.struct(*(c[f].cast("int").alias(f) for f in FEATURES), label(c).alias("label"), c["valid"].alias("base")))

    every = F.concat(*(labelled(n, kind) for n, kind, _ in GENERATORS))
    rows = found.where(F.greatest(*(F.size(n) for n, _, _ in GENERATORS)) > 0).select("half", F.explode(every).alias("c"))
    return [r.asDict() for r in rows.select("half", "c.*").groupBy("half", "label", "base", *FEATURES).agg(F.count("*").alias("n")).collect()]


def grown(rows: list[tuple], depth: int):
    """A regression tree over (features, gradient, weight) rows: a number, or (feature, split, left, right)."""
    g, w = sum(r[1] for r in rows), sum(r[2] for r in rows)
    leaf = g / (w + 1.0)
    if depth == 0 or len(rows) < 2:
        return leaf
    best, chosen = g * g / (w + 1.0) + 1e-9, None
    for f in range(len(FEATURES)):
        sums: dict[int, list] = {}
        for x, a, b, _ in rows:
            s = sums.setdefault(x[f], [0.0, 0.0])
            s[0] += a
            s[1] += b
        left_g = left_w = 0.0
        for value in sorted(sums)[:-1]:
            left_g += sums[value][0]
            left_w += sums[value][1]
            gain = left_g**2 / (left_w + 1.0) + (g - left_g) ** 2 / (w - left_w + 1.0)
            if gain > best and min(left_w, w - left_w) * 4 >= LEAF:
                best, chosen = gain, (f, value)
    if chosen is None:
        return leaf
    f, value = chosen
    return f, value, grown([r for r in rows if r[0][f] <= value], depth - 1), grown([r for r in rows if r[0][f] > value], depth - 1)


def value_of(tree, x: tuple) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def column_of(tree, c: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, value, left, right = tree
    return F.when(c[FEATURES[f]] <= value, column_of(left, c)).otherwise(column_of(right, c))


def fitted(table: list[dict]) -> dict:
    """Trees and each kind's threshold, from a table of counted examples.

    held_back: of each kind how many positives and negatives of the odd half are chosen beside
    base spans, and how many positives are not.
    """
    merged: dict[tuple, list] = {}
    beside: dict[tuple, list] = {}
    for r in table:
        x, label = tuple(r[f] for f in FEATURES), bool(r["label"])
        merged.setdefault(x, [[0, 0], [0, 0]])[r["half"]][label] += r["n"]
        if r["half"] and not r["base"]:
            beside.setdefault(x, [0, 0])[label] += r["n"]
    order = sorted(merged)
    score, trees = dict.fromkeys(order, 0.0), []
    for _ in range(TREES):
        rows = []
        for x in order:
            no, yes = merged[x][0]
            if no + yes:
                p = 1 / (1 + math.exp(-score[x]))
                rows.append((x, yes - (no + yes) * p, (no + yes) * max(p * (1 - p), 1e-6), no + yes))
        if not rows:
            break
        tree = grown(rows, DEPTH)
        trees.append(tree)
        for x in order:
            score[x] += STEP * value_of(tree, x)
    thresholds, held_back = {}, {}
    for kind in ALL:
        own = sorted(((score[x], *n) for x, n in beside.items() if GENERATORS[x[0]][1] == kind), reverse=True)
        no = yes = 0
        for i, (s, a, b) in enumerate(own):
            no, yes = no + a, yes + b
            last = i + 1 == len(own) or own[i + 1][0] < s
            if last and yes and yes + PRECISION * PRIOR >= PRECISION * (no + yes + PRIOR):
                thresholds[kind], held_back[kind] = s, (yes, no, sum(b for *_, b in own) - yes)
    return {"trees": trees, "thresholds": thresholds, "held_back": held_back}


def added(kind: str, model: dict) -> Column:
    """The kind's candidates that the trees select beside the base spans; of overlapping ones the first."""
    if kind not in model["thresholds"]:
        return F.filter(F.col(next(n for n, k, _ in GENERATORS if k == kind)), lambda c: F.lit(False))
    score = lambda c: sum((column_of(t, c) * STEP for t in model["trees"]), F.lit(0.0))
    free = lambda c: ~overlaps(c, base(kind)) if kind in KINDS else F.lit(True)
    chosen = F.concat(*(F.filter(F.col(n), lambda c: (score(c) >= model["thresholds"][kind] - 1e-9) & free(c)) for n, k, _ in GENERATORS if k == kind))
    return F.filter(chosen, lambda c: ~F.exists(chosen, lambda o: (o["start"] < c["end"]) & (c["start"] < o["end"]) & ((o["start"] < c["start"]) | ((o["start"] == c["start"]) & ((o["end"] > c["end"]) | ((o["end"] == c["end"]) & (o["generator"] < c["generator"])))))))


def spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep's columns and base and spans, arrays of (kind, start, end) in code points, by kind as listed, then start.

    base: matches of the four base patterns that pass; spans: these and what the trees add,
    secrets behind the kinds that have base patterns.
    A null text is empty and has none.  Repeated rows stay; an empty table gives an empty
    result.
    """
    found = saved(candidates(docs, text, keep))
    model = fitted(examples(found))
    short = lambda kind, a: F.transform(F.array_sort(F.transform(a, lambda c: F.struct(c["start"], c["end"]))), lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    rows = found.select(*keep, *(short(k, base(k)).alias(f"base_{k}") for k in KINDS), *(short(k, F.concat(base(k), added(k, model)) if k in KINDS else added(k, model)).alias(f"all_{k}") for k in ALL))
    return rows.select(*keep, F.concat(*(f"base_{k}" for k in KINDS)).alias("base"), F.concat(*(f"all_{k}" for k in ALL)).alias("spans"))


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each span of personal data in text replaced by its kind in brackets; of overlapping spans the first counts."""
    names = docs.columns
    rows = spans(docs, names, text).drop("base")
    ordered = F.array_sort(F.transform("spans", lambda c: F.struct(c["start"], c["end"], c["kind"])))
    put = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda a, c: F.when(c["start"] < a["at"], a).otherwise(
            F.struct(F.concat(a["out"], F.substr(F.col(text), a["at"] + 1, c["start"] - a["at"]), F.lit("["), c["kind"], F.lit("]")).alias("out"), c["end"].alias("at"))
        ),
        lambda a: F.concat(a["out"], F.substr(F.col(text), a["at"] + 1)),
    )
    return rows.withColumn(text, F.when(F.size("spans") > 0, put).otherwise(F.col(text))).select(*names)


def listed(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))), ",")
