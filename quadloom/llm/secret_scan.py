"""Secret scan, with DataFrame functions only.

Three fixed kinds by regular expressions (leftmost, without overlap), and one by entropy: candidates are maximal runs of
token characters; over each one slides a window of WINDOW characters, whose Shannon entropy is kept up by counts (one
character leaves, one enters). Each class has its threshold: hex digits of one case, mixed case with digits, lower or upper
case with digits and nothing else, and letters of both cases alone. What spans of the fixed kinds and matches of the allow
list leave of a candidate are its pieces, which are scanned one by one; what all of a piece's windows over the threshold
cover, from the first to the last, is a span of kind entropy.

Spans are positions in code points, end exclusive. Only texts in which a quick test finds a kind pay for its positions;
nothing is shuffled.

Defined cases: null and empty texts have no spans; a long text gives one array of its spans; repeated rows give equal rows;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

# The kinds in their order, and what they match.
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # greedy: as long as AKIA[A-Z0-9]+ gets, and 16 or more
HEX = r"[0-9a-f]{32,}"
ASSIGN_VALUE = 8

#: Candidates of the entropy kind, the window, thresholds in bits of hex digits and of mixed case with digits.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WINDOW, HEX_BITS, MIXED_BITS = 20, 3.05, 3.85
#: Thresholds of lower case with digits, upper case with digits, and letters of both cases, of which each must come so often.
#: Random windows have about 3.8 (36 characters), 3.7 (32) and 3.95 bits (52).
LOWER_BITS, UPPER_BITS, LETTER_BITS, LETTER_CASES = 3.6, 3.5, 3.85, 5
#: What matches one of these is known not to be a secret.
ALLOWED = (
    r"(?i)example|sample|placeholder|changeme|your[_-]?(?:key|token|secret)|dummy",
    r"(?i)0123456789|1234567890|abcdefghij",
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?!.*[-_/]{2})(?=.*[-_/])[A-Za-z][A-Za-z_/-]*[A-Za-z]$",  # words, joined one by one: without a group that repeats, which Java matches by recursion
    r"(.)\1{7,}+",
)
SPAN = "struct<start:int,kind:int,stop:int>"
#: Items after which a walk starts a new array of what it finds.
STRETCH = 256
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"


def _none() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _stretches(items: Column) -> Column:
    """The items, in arrays of STRETCH."""
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / STRETCH).cast("int")), lambda i: F.slice(all_, i * STRETCH + 1, F.lit(STRETCH)))
    return F.element_at(F.transform(F.array(items), cut), 1)  # so that items are made once


def _walk(items: Column, start: Column, step: Callable[[Column, Column], Column], kind: str) -> Column:
    """What step finds over items (one or more). It takes and gives (at, found), an int and an array.

    An array that grows is copied by each item, so found starts anew for each stretch: very many items cost little more each."""

    def stretch(acc: Column, part: Column) -> Column:
        walked = F.aggregate(part, F.struct(acc["at"].alias("at"), F.array().cast(kind).alias("found")), step)
        return F.element_at(F.transform(F.array(walked), lambda w: F.struct(w["at"].alias("at"), F.concat(acc["found"], F.array(w["found"])).alias("found"))), 1)

    return F.aggregate(_stretches(items), F.struct(start.alias("at"), F.array().cast(f"array<{kind}>").alias("found")), stretch, lambda acc: F.flatten(acc["found"]))


def _matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, match, group) of the pattern's matches in text."""
    cut = F.arrays_zip(
        F.split(text, pattern, -1).alias("between"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value")
    )
    kind = "array<struct<start:int,match:string,value:string>>"

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["between"])
        one = F.array(F.struct(start.alias("start"), x["match"].alias("match"), x["value"].alias("value")))
        found = F.when(x["match"].isNull(), acc["found"]).otherwise(F.concat(acc["found"], one))
        return F.struct((start + F.coalesce(F.length(x["match"]), F.lit(0))).alias("at"), found.alias("found"))

    return F.when(text.rlike(pattern), _walk(cut, F.lit(0), step, kind)).otherwise(F.array().cast(kind))


def _spans(matches: Column, kind: int) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), (m["start"] + F.length(m["match"])).alias("stop")))


def _secret_part(value: Column) -> Column:
    """(first, last): starts of the first and the last window over a threshold; nulls if there is none."""
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    leaving = F.concat(F.array_repeat(F.lit(None).cast("int"), WINDOW), codes)
    steps = F.arrays_zip(codes.alias("come"), F.slice(leaving, 1, F.length(value)).alias("go"))
    weight = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WINDOW + 1)])  # of a count in the entropy
    cost = lambda count: F.element_at(weight, count + 1)

    def step(acc: Column, x: Column) -> Column:
        came, went = x["come"], F.coalesce(x["go"], F.lit(0))
        old_in = F.element_at(acc["counts"], came)
        added = cost(old_in + 1) - cost(old_in)
        old_out = F.when(went > 0, F.element_at(acc["counts"], F.greatest(went, F.lit(1))) + F.when(went == came, 1).otherwise(0)).otherwise(0)
        dropped = F.when(went > 0, cost(old_out) - cost(F.greatest(old_out - 1, F.lit(0)))).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda n, i: n + F.when(i + 1 == came, 1).otherwise(0) - F.when(i + 1 == went, 1).otherwise(0))
        within = lambda low, high: F.when(came.between(low, high), 1).otherwise(0) - F.when(went.between(low, high), 1).otherwise(0)
        return F.struct(
            (acc["at"] + 1).alias("at"), counts.alias("counts"), (acc["sum"] + added - dropped).alias("sum"),
            (acc["digits"] + within(1, 10)).alias("digits"), (acc["a_to_f"] + within(11, 16)).alias("a_to_f"),
            (acc["lower"] + within(11, 36)).alias("lower"), (acc["upper"] + within(37, 62)).alias("upper"), (acc["upper_a_to_f"] + within(37, 42)).alias("upper_a_to_f"),
            acc["first"].alias("first"), acc["last"].alias("last"),
        )

    def judged(acc: Column, x: Column) -> Column:
        now = step(acc, x)
        bits = math.log2(WINDOW) - now["sum"] / WINDOW
        some = lambda *names: F.least(*[now[n] for n in names]) > 0
        only = lambda a, b: now[a] + now[b] == WINDOW
        only_hex = (only("digits", "a_to_f") & some("digits", "a_to_f")) | (only("digits", "upper_a_to_f") & some("digits", "upper_a_to_f"))
        classes = (
            (only_hex & (bits >= HEX_BITS))
            | (some("digits", "lower", "upper") & (bits >= MIXED_BITS))
            | (only("digits", "lower") & some("digits", "lower") & (bits >= LOWER_BITS))
            | (only("digits", "upper") & some("digits", "upper") & (bits >= UPPER_BITS))
            | (only("lower", "upper") & (F.least(now["lower"], now["upper"]) >= LETTER_CASES) & (bits >= LETTER_BITS))
        )
        over = (now["at"] >= WINDOW) & classes
        begin = now["at"] - WINDOW
        return now.withField("first", F.when(now["first"].isNull() & over, begin).otherwise(now["first"])).withField("last", F.when(over, begin).otherwise(now["last"]))

    null, zero = F.lit(None).cast("int"), F.lit(0)
    start = F.struct(
        zero.alias("at"), F.array_repeat(zero, len(ALPHABET)).alias("counts"), F.lit(0.0).alias("sum"), zero.alias("digits"), zero.alias("a_to_f"), zero.alias("lower"), zero.alias("upper"), zero.alias("upper_a_to_f"),
        null.alias("first"), null.alias("last"),
    )
    return F.aggregate(steps, start, judged, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def _blocks(spans: Column) -> Column:
    """Spans, in order of start, in arrays with the ends of each: a candidate looks at those that it meets only."""
    block = lambda part: F.struct(part.alias("spans"), F.element_at(part, 1)["start"].alias("start"), F.array_max(F.transform(part, lambda x: x["stop"])).alias("stop"))
    return F.when(F.size(spans) > 0, F.transform(_stretches(spans), block)).otherwise(F.array().cast(f"array<struct<spans:array<{SPAN}>,start:int,stop:int>>"))


def _pieces(m: Column, blocks: Column) -> Column:
    """Array of (start, text): what base spans (in blocks) and matches of the allow list leave of a candidate, WINDOW characters at least."""
    stop = m["start"] + F.length(m["match"])
    meets = lambda b: (b["start"] < stop) & (b["stop"] > m["start"])
    base = F.flatten(F.transform(F.filter(blocks, meets), lambda b: F.filter(b["spans"], meets)))
    known = [F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["stop"].alias("stop")))]
    for pattern in ALLOWED:
        known.append(F.transform(_matches(m["match"], pattern), lambda x: F.struct((m["start"] + x["start"]).alias("start"), (m["start"] + x["start"] + F.length(x["match"])).alias("stop"))))
    ends = F.concat(F.array_sort(F.concat(*known)), F.array(F.struct(stop.alias("start"), stop.alias("stop"))))

    def step(acc: Column, b: Column) -> Column:
        length = b["start"] - acc["at"]
        piece = F.array(F.struct(acc["at"].alias("start"), F.substring(m["match"], acc["at"] - m["start"] + 1, length).alias("text")))
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.when(length >= WINDOW, F.concat(acc["found"], piece)).otherwise(acc["found"]).alias("found"))

    return _walk(ends, m["start"], step, "array<struct<start:int,text:string>>")


def _entropy_spans(candidates: Column, blocks: Column) -> Column:
    several = lambda p: sum((p["text"].rlike(c).cast("int") for c in ("[0-9]", "[a-z]", "[A-Z]")), F.lit(0)) >= 2  # noqa: E731  else no class can have such a window
    pieces = F.filter(F.flatten(F.transform(candidates, lambda m: _pieces(m, blocks))), several)
    parts = F.transform(pieces, lambda p: F.struct(p["start"].alias("start"), _secret_part(p["text"]).alias("part")))
    found = F.filter(parts, lambda p: p["part"]["first"].isNotNull())
    return F.transform(found, lambda p: F.struct((p["start"] + p["part"]["first"]).alias("start"), F.lit(3).alias("kind"), (p["start"] + p["part"]["last"] + WINDOW).alias("stop")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of every row of docs: arrays of (start, kind, stop) in order; kind counts KINDS from 0.

    base has the fixed kinds, spans all of them."""
    text = F.col("__text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("__text"))
    assigned = F.filter(_matches(text, ASSIGN, 2), lambda m: F.length(m["value"]) >= ASSIGN_VALUE)
    base = F.array_sort(F.concat(_spans(assigned, 0), _spans(_matches(text, ACCESS), 1), _spans(_matches(text, HEX), 2)))
    found = rows.select("doc_id", base.alias("base"), _matches(text, CANDIDATE).alias("candidates")).withColumn("blocks", _blocks(F.col("base")))
    found = found.withColumn("entropy", F.when(F.size("candidates") > 0, _entropy_spans(F.col("candidates"), F.col("blocks"))).otherwise(_none()))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", "entropy")).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    found = find_secrets(docs)
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))
