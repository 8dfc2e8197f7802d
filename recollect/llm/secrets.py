"""Secret scans in DataFrame functions alone.

Three base patterns and, beside them, a sliding window of Shannon entropy over candidate strings. For a
window that moves by one character only the counts of the character that enters and of the one that
leaves change, and with them two terms of the entropy's sum. The counts are packed into a few whole numbers, so that a
step costs the same whatever the candidate's length is. The alphabet, the window and the least
entropy go by the candidate's character class. Candidates on the allow-list, or next to words that announce a
checksum, are passed over; base spans are never suppressed.

A null or empty text has no spans. Repeated rows are scanned each for itself, an empty table gives no
rows, and columns of the results' names are replaced. Offsets are code points; the end is exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns by kind, with the group that is measured and its least length.
BASE = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
#: A cheap test that holds wherever a pattern can match at full length.
HINTS = {"assign": r"(?i)(?:passw|secret|token|api_?key)", "access": r"AKIA[A-Z0-9]{12}", "hex": r"[0-9a-f]{32}"}


@dataclass(frozen=True)
class CharacterClass:
    """Candidate strings of one alphabet; a window counts if its entropy in bits is at least `bits`."""

    name: str
    pattern: str
    window: int
    bits: float


#: Letters alone are words, not secrets: a candidate has digits beside letters of one case, or of both.
CLASSES = (
    CharacterClass("entropy_hex", r"(?<![0-9A-Za-z])(?:[0-9a-f]{24,}+|[0-9A-F]{24,}+)(?![0-9A-Za-z])", 24, 3.0),
    CharacterClass("entropy_mixed", r"(?<![0-9A-Za-z+/_=-])(?=[a-z+/_=-]*+[A-Z0-9])(?=[A-Za-z+/_=-]*+[0-9])(?=[A-Z0-9+/_=-]*+[a-z])(?=[a-z0-9+/_=-]*+[A-Z])[A-Za-z0-9+/_=-]{20,}+", 20, 3.8),
    CharacterClass("entropy_lower", r"(?<![0-9A-Za-z+/_=-])(?=[a-z]*+[0-9])(?=[0-9a-f]*+[g-z])[a-z0-9]{24,}+(?![0-9A-Za-z+/_=-])", 24, 3.6),
    CharacterClass("entropy_upper", r"(?<![0-9A-Za-z+/_=-])(?=[A-Z]*+[0-9])(?=[0-9A-F]*+[G-Z])[A-Z0-9]{24,}+(?![0-9A-Za-z+/_=-])", 24, 3.6),
)
#: Whole candidates that are no secrets: UUIDs, dates with times, file paths, one character over and over. Possessive, as Java recurses into groups that may be given back.
ALLOWED = r"^(?:[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}|[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{6,}+Z?|(?:/[A-Za-z_-]++){3,}+/?|(.)\1*+)$"
#: Words right before a candidate that announce a checksum or an id of a commit.
ANNOUNCED = r"(?i)(?:commit|sha[0-9]*|md5|checksum|digest|integrity|etag)\W{0,8}$"


#: Matches whose places are summed up one by one; more are taken in blocks, as Spark copies an array for each element added.
BLOCK = 256
MATCH = "array<struct<start:int,end:int,part:int,found:string,tail:string>>"


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda s, x: s + x)


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """The leftmost matches that do not overlap: start, end, part (the group's length), found (the match) and tail (up to 31 characters before it).

    Split at the same matches, the text's other parts tell where each match starts."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.transform(
        F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("found"), part.alias("part")),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["found"]), F.lit(0)).alias("size"), F.length(x["part"]).alias("part"), x["found"].alias("found"), F.substring(x["gap"], -31, 31).alias("tail")),
    )

    def walked(block: Column, start: Column) -> Column:
        def step(state: Column, x: Column) -> Column:
            at = state["at"] + x["gap"]
            own = F.struct(at.alias("start"), (at + x["size"]).alias("end"), x["part"].alias("part"), x["found"].alias("found"), x["tail"].alias("tail"))
            return F.struct((at + x["size"]).alias("at"), F.when(x["found"].isNotNull(), F.concat(state["seen"], F.array(own))).otherwise(state["seen"]).alias("seen"))

        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(MATCH).alias("seen")), step, lambda state: state["seen"])

    def all_blocks(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, F.lit(BLOCK)))
        starts = lambda bs: F.aggregate(bs, F.array(F.lit(0)), lambda s, b: F.concat(s, F.array(F.element_at(s, -1) + _sum(F.transform(b, lambda x: x["gap"] + x["size"])))))
        return _bound(blocks, lambda bs: F.flatten(F.zip_with(bs, F.slice(starts(bs), F.lit(1), F.size(bs)), walked)))

    return F.when(F.regexp_like(text, F.lit(pattern)), _bound(steps, all_blocks)).otherwise(F.array().cast(MATCH))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Spans (start, end, kind) of the matches whose group is long enough."""
    found = F.filter(matches(text, pattern, group), lambda m: m["part"] >= least)
    return F.when(F.regexp_like(text, F.lit(HINTS[kind])), _spans(found, kind)).otherwise(_spans(F.array().cast(MATCH), kind))


#: Characters of candidates lie between "+" and "z"; a count takes 5 bits, 12 of them a whole number.
FIRST, BITS, PACKED = ord("+"), 5, 12
WORDS = (ord("z") - FIRST) // PACKED + 1


def _term(count: Column) -> Column:
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))


def highest_entropy(candidate: Column, window: int) -> Column:
    """The highest entropy of any window of the candidate, by counts that change with the characters that enter and leave.

    With n characters in the window and c of each, it is log2(n) - sum(c log2 c) / n; a step changes two of the sum's terms."""

    def one(code: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), BITS * (code % PACKED))

    def count(counts: Column, code: Column) -> Column:
        return F.call_function("shiftright", F.get(counts, F.floor(code / PACKED).cast("int")), BITS * (code % PACKED)).bitwiseAND(F.lit((1 << BITS) - 1))

    def over(codes: Column) -> Column:
        def step(state: Column, at: Column) -> Column:
            enter, gone = F.get(codes, at), F.when(at >= window, F.get(codes, at - window)).otherwise(F.lit(-1))
            had, was = count(state["counts"], enter), F.when(gone >= 0, count(state["counts"], gone)).otherwise(F.lit(0))
            total = F.when(enter == gone, state["sum"]).otherwise(state["sum"] + _term(had + 1) - _term(had) + F.when(gone >= 0, _term(was - 1) - _term(was)).otherwise(F.lit(0.0)))
            moved = lambda c, i: c + F.when(F.floor(enter / PACKED) == i, one(enter)).otherwise(F.lit(0)) - F.when((gone >= 0) & (F.floor(gone / PACKED) == i), one(gone)).otherwise(F.lit(0))
            entropy = F.when(at >= window - 1, F.lit(math.log2(window)) - total / window).otherwise(F.lit(0.0))
            return F.struct(F.transform(state["counts"], moved).alias("counts"), total.alias("sum"), F.greatest(state["best"], entropy).alias("best"))

        start = F.struct(F.array_repeat(F.lit(0).cast("long"), WORDS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0.0).alias("best"))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), start, step, lambda state: state["best"])

    codes = F.transform(F.filter(F.split(candidate, ""), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    return _bound(codes, over)


def entropy_spans(text: Column, kind: CharacterClass) -> Column:
    kept = F.filter(matches(text, kind.pattern), lambda m: ~F.regexp_like(m["found"], F.lit(ALLOWED)) & ~F.regexp_like(m["tail"], F.lit(ANNOUNCED)))
    return _spans(F.filter(kept, lambda m: highest_entropy(m["found"], kind.window) >= kind.bits), kind.name)


def found_in(text: Column) -> tuple[Column, Column]:
    """The base spans and those of high entropy of a text, each (start, end, kind)."""
    whole = F.coalesce(text, F.lit(""))
    return F.flatten(F.array(*[base_spans(whole, *kind) for kind in BASE])), F.flatten(F.array(*[entropy_spans(whole, kind) for kind in CLASSES]))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base and entropy, the arrays of spans (start, end, kind) of each text."""
    base, extra = found_in(F.col(text))
    return docs.withColumns({"base": base, "entropy": extra})


def _joined(spans: Column, kinds: list[str]) -> Column:
    order = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*[F.lit(k) for k in kinds]), s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(order), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


KINDS = [kind for kind, *_ in BASE] + [kind.name for kind in CLASSES]


def digests(docs: DataFrame) -> DataFrame:
    """Per document the number of base spans of each kind, SHA-256 of the base spans, and all spans."""
    found = scan(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base"), KINDS), 256).alias("base_sha256"), _joined(F.concat("base", "entropy"), KINDS).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """Puts [SECRET] in the place of every span, those that overlap or touch taken as one. The columns stay, whatever their names are."""
    own = "_secret_spans"
    while own in docs.columns:
        own += "_"
    found = docs.withColumn(own, F.array_sort(F.concat(*found_in(F.col(text)))))
    source = F.coalesce(F.col(text), F.lit(""))
    # Of the spans by their start, the ends of those before tell which ones begin a part of their own.
    step = lambda state, s: F.when(
        s["start"] > state["end"], F.struct(F.concat(state["done"], F.array(F.struct(state["end"].alias("from"), s["start"].alias("to")))).alias("done"), s["end"].alias("end"))
    ).otherwise(F.struct(state["done"].alias("done"), F.greatest(state["end"], s["end"]).alias("end")))
    start = F.struct(F.array().cast("array<struct<from:int,to:int>>").alias("done"), F.lit(-1).alias("end"))
    kept = F.aggregate(own, start, step, lambda state: F.concat(state["done"], F.array(F.struct(state["end"].alias("from"), F.length(source).alias("to")))))
    masked = F.array_join(F.transform(kept, lambda k: _between(source, k["from"], k["to"])), "[SECRET]")
    return found.withColumn(text, F.when(F.size(own) > 0, masked).otherwise(F.col(text))).drop(own)


def _between(text: Column, start: Column, end: Column) -> Column:
    first = F.greatest(start, F.lit(0))
    return F.substring(text, first + 1, end - first)
