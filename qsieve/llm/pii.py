"""Personal data in texts: regular expressions propose spans, checksums confirm
them, nearby words adjust the score.  All of it is DataFrame expressions.

Kinds: email, ip, card (Luhn) and phone as the contract words them; besides,
iban (mod-97) and ssn (only with a context word nearby).  Places are code
points, the end exclusive.  A match's place is the length of what split() and
the matches before it cover, so no text is searched twice for nothing: split()
runs only where something was found.

The patterns are the contract's, written so that a long run of characters is
tried once and not from each of its characters: a match can only start where a
run starts, or where the match before it ended (\\G); possessive quantifiers
are used where giving back characters cannot help.

Defined results: null texts hold nothing; every row gives one row; other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: What a text must hold for the pattern to be tried at all.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}"}
BASE = ["email", "ip", "card", "phone"]
CONTEXT = {"email": "mail|contact|write", "ip": "address|host|server|ip", "card": "card|visa|credit|payment", "phone": "phone|call|tel|mobile", "iban": "iban|account|bank", "ssn": "ssn|social"}
NEAR = 40  # code points before a span that are searched for context
SCORE = {"email": 0.8, "ip": 0.6, "card": 0.9, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
LEAST = 0.5
CHUNK = 256  # matches of a text walked together


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a digit string passes Luhn's check."""
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN passes its mod-97 check."""
    plain = F.regexp_replace(iban, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c < 58, (rest * 10 + c - 48) % 97).otherwise((rest * 100 + c - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
        return text.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return F.when(n.between(13, 19), luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return mod97(text) if kind == "iban" else F.lit(True)


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def _sum(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0), lambda a, b: a + b)


def _chunks(items: Column) -> Column:
    """An array, not empty, cut into arrays of CHUNK entries."""
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, F.lit(CHUNK))))


def _items(found: Column, pieces: Column) -> Column:
    """Chunks of a text's matches, each with the piece before it."""
    return _chunks(F.filter(F.zip_with(found, pieces, lambda m, g: F.struct(m.alias("match"), g.alias("gap"), F.length(g).alias("skip"), F.length(m).alias("size"))), lambda x: x["match"].isNotNull()))


def _spans(text: Column, kind: str, parts: Column) -> Column:
    """Confirmed spans of a kind from the chunks of its matches.  Matches are walked in chunks: what a chunk starts with (its place, and the
    last NEAR code points before it) is found once per chunk, so that the work
    stays near linear in a text's length and number of matches."""
    last = lambda s: F.substring(s, -NEAR, NEAR)

    def step(done: Column, x: Column) -> Column:
        start, before = done["at"] + x["skip"], last(F.concat(done["tail"], last(x["gap"])))
        near = F.when(F.lower(before).rlike(CONTEXT[kind]), 0.1 if kind != "ssn" else 0.4).otherwise(0.0)
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + x["size"]).alias("end"), x["match"].alias("text"), (F.lit(SCORE[kind]) + near).alias("score"))
        out = F.when(_confirmed(kind, x["match"]), F.concat(done["out"], F.array(span).cast(SPAN))).otherwise(done["out"])
        return F.struct((start + x["size"]).alias("at"), last(F.concat(before, x["match"])).alias("tail"), out.alias("out"))

    def chunk(part: Column, at: Column) -> Column:
        tail = F.substring(text, F.greatest(at - NEAR, F.lit(0)) + 1, F.least(at, F.lit(NEAR)))
        begin = F.struct(at.alias("at"), tail.alias("tail"), F.array().cast(SPAN).alias("out"))
        return F.aggregate(part, begin, step, lambda d: d["out"])

    lengths = F.transform(parts, lambda p: _sum(F.transform(p, lambda x: x["skip"] + x["size"])))
    walked = _let(lengths, lambda n: F.flatten(F.transform(parts, lambda p, c: _let(_sum(F.slice(n, F.lit(1), c)), lambda at: chunk(p, at)))))
    return F.filter(walked, lambda s: s["score"] >= LEAST)


SPAN = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def find_pii(docs: DataFrame, column: str = "pii", kinds: list[str] | None = None) -> DataFrame:
    """docs with the confirmed spans of `text` as array `column`, by kind, then place."""
    kinds = kinds or list(PATTERNS)
    text = F.coalesce("text", F.lit(""))
    out, have = docs, docs.columns
    names = {}
    for k in kinds:
        names[k] = (f"__{column}_{k}", f"__{column}_{k}_parts")
        found = F.when(F.col("text").rlike(HINTS[k]), F.regexp_extract_all("text", F.lit(PATTERNS[k]), F.lit(0)))
        out = out.withColumn(names[k][0], found)
    out = out.withColumns({names[k][1]: F.when(F.size(names[k][0]) > 0, _items(F.col(names[k][0]), F.split("text", PATTERNS[k], -1))) for k in kinds})
    each = [F.when(F.col(names[k][1]).isNotNull(), _spans(text, k, F.col(names[k][1]))).otherwise(F.array().cast(SPAN)).cast(SPAN) for k in kinds]
    return out.select(*have, F.concat(*each).alias(column))


def mask(column: str) -> Column:
    """`text` with the spans of `column` replaced by their kind in brackets;
    overlapping spans are covered by the first one's.  Spans are walked in
    chunks, each over its own part of the text."""
    ordered = F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col("text")

    def chunk(part: Column, at: Column, till: Column) -> Column:
        def walk(own: Column) -> Column:
            def step(done: Column, s: Column) -> Column:
                more = F.concat(done["out"], F.substring(own, done["at"] - at + 1, s["start"] - done["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))
                return F.struct(F.greatest(done["at"], s["end"]).alias("at"), F.when(s["start"] >= done["at"], more).otherwise(done["out"]).alias("out"))

            return F.aggregate(part, F.struct(at.alias("at"), F.lit("").alias("out")), step, lambda d: d["out"])

        return _let(F.substring(text, at + 1, till - at), walk)

    def reach(ends: Column, n: Column) -> Column:
        return F.coalesce(F.array_max(F.slice(ends, F.lit(1), n)), F.lit(0))

    def walk(parts: Column) -> Column:
        ends = F.transform(parts, lambda p: F.array_max(F.transform(p, lambda s: s["end"])))
        return _let(ends, lambda e: F.concat(F.array_join(F.transform(parts, lambda p, c: chunk(p, reach(e, c), reach(e, c + 1))), ""),
                                             F.substring(text, F.array_max(e) + 1, F.length(text))))

    return F.when(F.size(column) > 0, _let(_chunks(ordered), walk)).otherwise(text)


def of_kinds(spans: str, kinds: list[str]) -> Column:
    """The spans of the given kinds."""
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def as_digest(spans: Column) -> Column:
    """kind:start:end of spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
