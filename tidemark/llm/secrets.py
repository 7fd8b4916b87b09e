"""Secret scans with DataFrame functions only.

Base kinds come from patterns. The method adds spans of high entropy: candidate strings are runs of key-like characters;
each belongs to a character class with its own window and threshold; a window slides over the candidate and its Shannon
entropy is kept by incremental counts (one character enters, one leaves, and the sum of c * log2 c changes by their two
terms). A candidate whose best window reaches the threshold is a span unless the allow-list suppresses it. The
allow-list acts on added spans only; base ones always stay.

Positions are code points, the end exclusive. A regular expression function gives no positions, so they are summed up
from the lengths of what a split leaves and of what matched.

Defined cases: a null text counts as empty and has no spans; rows that repeat a doc_id are rows of their own; spans of
different kinds may overlap, and a span of equal extent is listed once per kind; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns, as (kind, pattern, group whose length counts, its least length).
BASE = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
]
#: The same matches without those that are too short: such a match is a whole run, and no other begins within it.
ENOUGH = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Where a match of at least the least length can begin at all: a cheap test before the real work.
MAYBE = {"assign": r"(?i:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}"}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
#: Character classes of candidates, the first that fits: name, pattern of the whole candidate, window, bits per character.
CLASSES = [
    ("entropy_hex", r"(?:[0-9a-f]+|[0-9A-F]+)", 20, 3.0),
    ("entropy_lower", r"[0-9a-z_-]+", 20, 3.6),
    ("entropy_base64", r"[A-Za-z0-9+/_-]+={0,2}", 20, 3.7),
]
#: Strings that look random and are no secrets. Possessive repetition, so that each is linear on a string of any length.
ALLOW = [
    r"^[0-9+/_=-]++$",  # numbers, dates and rules
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",  # UUIDs
    r"^(?:[A-Za-z]++[-_/])++[A-Za-z0-9]{1,8}$",  # slugs and paths with a number at the end
    r"(?i)example|sample|dummy|changeme|placeholder",
]


def _running(sizes: Column) -> Column:
    """Running sums of an array<int>: each step adds what stands 1, 2, 4, ... places before, so n log n in all."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda step: step < F.size(sizes))
    return F.aggregate(
        steps,
        sizes,
        lambda sums, step: F.zip_with(sums, F.slice(F.concat(F.array_repeat(F.lit(0), step), sums), F.lit(1), F.size(sums)), lambda x, before: x + before),
    )


def _starts(parts: Column, matches: Column) -> Column:
    """Where each match begins: all parts up to it and all matches before it."""
    sizes = F.zip_with(F.slice(parts, F.lit(1), F.size(matches)), matches, lambda p, m: F.length(p) + F.length(m))
    return F.zip_with(_let(sizes, _running), matches, lambda stop, m: stop - F.length(m))


def _found(text: Column, pattern: str, group: int) -> Column:
    """Matches of a pattern as array<struct<start, length, own (the group's text), whole>>."""
    whole, own = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.zip_with(
        F.zip_with(_starts(F.split(text, pattern, -1), whole), whole, lambda s, w: F.struct(s.alias("start"), w.alias("whole"))),
        own,
        lambda x, o: F.struct(x["start"].alias("start"), F.length(x["whole"]).alias("length"), o.alias("own"), x["whole"].alias("whole")),
    )


def _long_enough(found: Column, least: int) -> Column:
    return F.filter(found, lambda m: F.length(m["own"]) >= least)


def _spans(found: Column, rank: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + m["length"]).alias("stop")))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: a lambda's variable, where an expression would be computed at every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def entropy(candidate: Column, window: int) -> Column:
    """The highest Shannon entropy of a window's characters (of the whole candidate, if shorter), by incremental counts."""
    terms = F.array(*[F.lit(k * math.log2(k) if k else 0.0) for k in range(window + 1)])
    term = lambda n: F.element_at(terms, n + 1)
    bits = lambda n, total: F.log2(n.cast("double")) - total / n

    def slide(state, x):
        enters, leaves = x["enters"], x["leaves"]
        had = F.when(leaves > 0, F.element_at(state["counts"], F.greatest(leaves, F.lit(1)))).otherwise(1)
        # what the entering character's count is once the other has left
        has = F.element_at(state["counts"], enters) - F.when(leaves == enters, 1).otherwise(0)
        total = state["sum"] - F.when(leaves > 0, term(had) - term(had - 1)).otherwise(0.0) + term(has + 1) - term(has)
        return F.struct(
            F.transform(state["counts"], lambda n, j: n + F.when(j + 1 == enters, 1).otherwise(0) - F.when(j + 1 == leaves, 1).otherwise(0)).alias("counts"),
            (state["n"] + 1).alias("n"),
            total.alias("sum"),
            F.when(state["n"] + 1 >= window, F.greatest(state["best"], bits(F.lit(window), total))).otherwise(state["best"]).alias("best"),
        )

    def best(x):
        start = F.struct(x["zeros"].alias("counts"), F.lit(0).alias("n"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        moves = F.zip_with(
            x["codes"],
            F.slice(F.concat(F.array_repeat(F.lit(0), window), x["codes"]), F.lit(1), F.size(x["codes"])),
            lambda a, b: F.struct(a.alias("enters"), b.alias("leaves")),
        )
        return F.aggregate(moves, start, slide, lambda s: F.when(s["n"] < window, bits(F.greatest(s["n"], F.lit(1)), s["sum"])).otherwise(s["best"]))

    def coded(x):
        codes = F.transform(x["chars"], lambda c: F.array_position(x["alphabet"], c).cast("int"))
        return _let(F.struct(codes.alias("codes"), F.transform(x["alphabet"], lambda _: F.lit(0)).alias("zeros")), best)

    return _let(F.split(candidate, ""), lambda chars: _let(F.struct(chars.alias("chars"), F.array_distinct(chars).alias("alphabet")), coded))


def _random(candidate: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | candidate.rlike(pattern)
    rank, enough = F.lit(0), F.lit(None).cast("double")
    for k, (_, pattern, _, bits) in reversed(list(enumerate(CLASSES))):
        fits = candidate.rlike(f"^{pattern}$")
        rank, enough = F.when(fits, k).otherwise(rank), F.when(fits, bits).otherwise(enough)
    return F.when(~allowed & (entropy(candidate, CLASSES[0][2]) >= enough), rank + len(BASE)).otherwise(-1)


KINDS = [b[0] for b in BASE] + [c[0] for c in CLASSES]


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col and spans: array<struct<start, rank, stop>> in order; KINDS[rank] is the kind."""
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    text, none = F.col("__text"), F.array().cast("array<struct<start:int,rank:int,stop:int>>")
    for rank, (kind, pattern, group, least) in enumerate(BASE):
        found = _found(text, ENOUGH.get(kind, pattern), group)
        rows = rows.withColumn(f"__{kind}", F.when(text.rlike(MAYBE[kind]), _spans(_long_enough(found, least), rank)).otherwise(none))
    rows = rows.withColumn("__cand", F.when(text.rlike(CANDIDATE), _found(text, CANDIDATE, 0)).otherwise(F.array().cast("array<struct<start:int,length:int,own:string,whole:string>>")))
    rows = rows.withColumn(
        "__judged",
        F.transform("__cand", lambda m: F.struct(m["start"].alias("start"), _random(m["whole"]).alias("rank"), (m["start"] + m["length"]).alias("stop"))),
    )
    added = F.filter("__judged", lambda s: s["rank"] >= 0)
    return rows.select(id_col, F.array_sort(F.concat(*[F.col(f"__{b[0]}") for b in BASE], added)).alias("spans"))


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["stop"])), ",")


def redact(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", mark: str = "[SECRET]") -> DataFrame:
    """id_col and the text with every span replaced by a mark; overlapping spans share one."""
    found = scan(docs.select(F.struct(id_col, text_col).alias("__row"), F.col(text_col).alias("__t")), "__t", "__row")
    merged = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["stop"]).alias("at"),
            F.when(s["start"] >= a["at"], F.concat(a["out"], F.substring(F.col(f"__row.{text_col}"), a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(a["out"], F.substring(F.col(f"__row.{text_col}"), a["at"] + 1, F.length(F.col(f"__row.{text_col}")))),
    )
    return found.select(F.col(f"__row.{id_col}").alias(id_col), F.coalesce(merged, F.lit("")).alias(text_col))
