"""Secret scans: patterned secrets, and candidates of high sliding-window Shannon entropy.

Only DataFrame expressions. A pattern's positions follow from the pieces between its matches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from authspan.llm.common import let, text_of

# Kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:passw|secret|token|api_?key)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{%d,}+"


@dataclass(frozen=True)
class SecretRules:
    min_value: int = 12
    #: Characters in the sliding window, and the least of a candidate.
    window: int = 20
    #: Bits a character that some window must reach, by character class.
    hex_bits: float = 3.0
    base64_bits: float = 3.7
    #: Candidates that match one of these are suppressed: no digit, no letter, words joined by marks,
    #: identifiers in the 8-4-4-4-12 form, and placeholders.
    allow: tuple[str, ...] = (r"^[^0-9]+$", r"^[^A-Za-z]+$", r"^[A-Za-z]+([-_/=+][A-Za-z]*[0-9]{0,4})+$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"(?i)example|sample|dummy|placeholder|xxxx")


#: Matches whose positions are summed up at once; sums of such blocks are summed up again.
BLOCK = 256


def _before(values: Column, fold) -> Column:
    """For each of values (longs of 0 or more) and once more at the end: fold, a sum or a maximum, over
    those before it, from 0. In blocks, as an array that grows by an element at each step would be copied each time."""
    none = F.array().cast("array<bigint>")
    grow = lambda a, x: F.struct(fold(a["at"], x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out"))
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(values, i, F.lit(BLOCK)), start, grow))
    moved = lambda a, x: F.struct(fold(a["at"], x["at"]).alias("at"), F.concat(a["out"], F.array(F.transform(x["out"], lambda v: fold(v, a["at"])))).alias("out"))
    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    return F.aggregate(blocks, begin, moved, lambda a: F.flatten(a["out"]))


def _located(text: Column, pattern: str, kind: int) -> Column:
    """array<struct<s, k, e, v>>: start, kind, end in code points, and the string, of each match in order."""

    def placed(gaps: Column, hits: Column) -> Column:
        both = F.transform(gaps, lambda g, i: (F.length(g) + F.coalesce(F.length(F.get(hits, i)), F.lit(0))).cast("long"))
        start = lambda at, i: F.get(at, i) + F.length(F.get(gaps, i))
        one = lambda at, v, i: F.struct(start(at, i).alias("s"), F.lit(kind).alias("k"), (start(at, i) + F.length(v)).alias("e"), v.alias("v"))
        return let(_before(both, lambda a, x: a + x), lambda at: F.transform(hits, lambda v, i: one(at, v, i)))

    return let(F.split(text, pattern, -1), lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: placed(gaps, hits)))


def _none() -> Column:
    return F.array().cast("array<struct<s:bigint,k:int,e:bigint,v:string>>")


def _apart(free: Column, known: Column) -> Column:
    """The spans of free that overlap none of known: in order of place, the furthest end of the known
    spans that start before a free one's end must not lie past its start."""
    known_event = lambda y: F.struct(y["s"].alias("p"), F.lit(1).alias("t"), y["e"].alias("m"), y.alias("x"))
    free_event = lambda x: F.struct(x["e"].alias("p"), F.lit(0).alias("t"), F.lit(0).cast("long").alias("m"), x.alias("x"))
    events = F.sort_array(F.concat(F.transform(known, known_event), F.transform(free, free_event)))
    judged = lambda held, ends: F.transform(held, lambda v, i: F.when((v["t"] == 0) & (F.get(ends, i) <= v["x"]["s"]), v["x"]))
    left = let(events, lambda held: let(_before(F.transform(held, lambda v: v["m"]), F.greatest), lambda ends: judged(held, ends)))
    return F.when((F.size(known) == 0) | (F.size(free) == 0), free).otherwise(F.filter(left, lambda x: x.isNotNull()))


#: What a candidate is made of; anything else counts as one more character.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"


def peak_entropy(s: Column, window: int) -> Column:
    """Most bits a character of any window of s, in time linear in its length.

    The counts of the window's characters are kept, packed into a few longs of as many bits a count
    as the window needs. Each step takes one character out and another in, and moves the sum of
    c * log2(c) by what their two counts change.
    """
    bits = (window + 1).bit_length()
    each = 63 // bits
    words = len(ALPHABET) // each + 1
    terms = F.array(*[F.lit(0.0 if c < 2 else c * math.log2(c)) for c in range(window + 2)])
    f = lambda c: F.get(terms, c)
    zero = F.lit(0).cast("long")
    places = F.transform(F.split(s, ""), lambda ch: F.instr(F.lit(ALPHABET), ch))
    pairs = let(places, lambda p: F.transform(p, lambda c, j: F.struct(c.alias("i"), F.get(p, j - window).alias("o"))))

    def count(held: list[Column], place: Column) -> Column:
        word = F.element_at(F.array(*held), (place / each).cast("int") + 1)
        return F.call_function("shiftright", word, place % each * bits).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def moved(held: list[Column], place: Column, by: int) -> list[Column]:
        one = F.call_function("shiftleft", F.lit(by).cast("long"), place % each * bits)
        return [h + F.when((place / each).cast("int") == k, one).otherwise(zero) for k, h in enumerate(held)]

    def step(acc: Column, x: Column) -> Column:
        held = [acc["w"][k] for k in range(words)]
        left = let(
            F.struct(F.array(*moved(held, x["o"], -1)).alias("w"), (acc["t"] - let(count(held, x["o"]), lambda c: f(c) - f(c - 1))).alias("t")), lambda y: F.when(x["o"].isNotNull(), y).otherwise(F.struct(acc["w"].alias("w"), acc["t"].alias("t")))
        )

        def came(y: Column) -> Column:
            now = [y["w"][k] for k in range(words)]
            total = y["t"] + let(count(now, x["i"]), lambda c: f(c + 1) - f(c))
            n = acc["n"] + 1
            best = let(total, lambda t: F.greatest(acc["best"], F.when(n >= window, F.lit(math.log2(window)) - t / window).otherwise(F.lit(0.0))))
            return F.struct(F.array(*moved(now, x["i"], 1)).alias("w"), total.alias("t"), n.alias("n"), best.alias("best"))

        return let(left, came)

    start = F.struct(F.array(*[zero] * words).alias("w"), F.lit(0.0).alias("t"), F.lit(0).alias("n"), F.lit(0.0).alias("best"))
    return F.aggregate(pairs, start, step, lambda a: a["best"])


def scan(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """docs' doc_id with found: array of (s, k, e, v) by start, then kind, then end; k indexes KINDS.

    Null text: no findings. Every row gets a result, repeated rows too. Texts are scanned whole.
    """
    candidate = CANDIDATE % rules.window
    value = F.regexp_extract  # of one match
    t = F.col("_t")
    base = docs.select("doc_id", text_of().alias("_t"))
    when = lambda hint, found: F.when(t.rlike(hint), found).otherwise(_none())
    base = base.select(
        "*",
        when(ASSIGN_HINT, F.filter(_located(t, ASSIGN, 0), lambda x: F.length(value(x["v"], ASSIGN, 2)) >= rules.min_value)).alias("_assign"),
        when(ACCESS, _located(t, ACCESS, 1)).alias("_access"),
        when(HEX, _located(t, HEX, 2)).alias("_hex"),
        when(candidate, _located(t, candidate, 4)).alias("_cand"),
    )
    known = F.concat("_assign", "_access", "_hex")
    free = F.col("_cand")
    allowed = "|".join(f"(?:{p})" for p in rules.allow)
    if allowed:
        free = F.filter(free, lambda x: ~x["v"].rlike(allowed))
    free = let(known, lambda b: let(free, lambda x: _apart(x, b)))
    is_hex = lambda x: x["v"].rlike(r"^([0-9a-f]+|[0-9A-F]+)$")
    classed = F.transform(free, lambda x: F.struct(x["s"].alias("s"), F.when(is_hex(x), F.lit(3)).otherwise(F.lit(4)).alias("k"), x["e"].alias("e"), x["v"].alias("v")))
    high = F.filter(classed, lambda x: peak_entropy(x["v"], rules.window) >= F.when(x["k"] == 3, F.lit(rules.hex_bits)).otherwise(F.lit(rules.base64_bits)))
    return base.select("doc_id", F.sort_array(known).alias("base"), F.sort_array(F.concat(known, high)).alias("found"))


def digest(docs: DataFrame, rules: SecretRules = SecretRules()) -> DataFrame:
    """scan() as counts of the base kinds, a hash of the base spans, and all spans as text."""
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return scan(docs, rules).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.col("base")).cast("binary"), 256).alias("base_sha256"), shown(F.col("found")).alias("spans"),
    )
