"""Scalar column functions (built-in expressions only; no UDFs)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import catalog as C


def map_lit(d: dict) -> Column:
    """A literal MAP column; `element_at(map, key)` is a codegen'd lookup."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(d.items())])


def lookup(d: dict, key: Column) -> Column:
    return F.element_at(map_lit(d), key)


# F1 — severity → rank 0..4
def severity_rank(sev: Column | str = "severity") -> Column:
    sev = F.col(sev) if isinstance(sev, str) else sev
    return lookup(C.SEVERITY_RANK, sev).cast("int")


# P1 — language from path: extension (last '.' onward, lower-cased), else the
# lower-cased base name or its part before the first '.'.
def file_extension(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(path, r"(\.[^.]*)$", 1))


def language(path: Column | str = "path") -> Column:
    path = F.col(path) if isinstance(path, str) else path
    base = F.lower(F.regexp_extract(path, r"([^/]*)$", 1))
    root = F.substring_index(base, ".", 1)
    return F.coalesce(lookup(C.LANG_MAP, file_extension(path)),
                      lookup(C.FILENAME_MAP, base),
                      lookup(C.FILENAME_MAP, root))


# S5 — binary files are discovered (and counted) but never read.
def is_binary(path: Column | str = "path") -> Column:
    return file_extension(path).isin(C.BINARY_EXTENSIONS)


# P14 — dependency rule id: prefix + name with non-alphanumerics → '_', upper-cased.
def dependency_rule_id(prefix: str, name: Column) -> Column:
    return F.upper(F.concat(F.lit(prefix), F.regexp_replace(name, "[^a-zA-Z0-9]", "_")))


# F2–F7 — report mappings.
def sarif_level(sev: Column) -> Column:
    return lookup(C.SARIF_LEVEL, sev)


def classical_level(sev: Column) -> Column:
    return lookup(C.CLASSICAL_LEVEL, sev).cast("int")


def nist_quantum_level(sev: Column) -> Column:
    return lookup(C.NIST_QUANTUM_LEVEL, sev).cast("int")


def asset_type(cat: Column) -> Column:
    return lookup(C.ASSET_TYPE, cat)


def primitive(cat: Column) -> Column:
    return lookup(C.PRIMITIVE, cat)


def crypto_function(cat: Column) -> Column:
    return lookup(C.CRYPTO_FUNCTION, cat)


def category_label(cat: Column) -> Column:
    return F.coalesce(lookup(C.CATEGORY_LABELS, cat), cat)


# F9 — CycloneDX component reference.
def bom_ref(rule_id: Column, file: Column, line: Column) -> Column:
    return F.concat(F.lit("crypto-"), rule_id, F.lit("-"),
                    F.regexp_replace(file, "[^a-zA-Z0-9]", "-"), F.lit("-"),
                    F.coalesce(line, F.lit(0)).cast("string"))


# F10 — `file:line` or `file`.
def location_label(file: Column, line: Column) -> Column:
    return F.when(line.isNotNull() & (line != 0), F.concat(file, F.lit(":"), line.cast("string"))) \
        .otherwise(file)


# F11 — ` (n occurrences)` when n > 1.
def occurrence_label(n: Column) -> Column:
    return F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(" occurrences)"))) \
        .otherwise(F.lit(""))


# F12 — confidence percent, rounded half up like Math.round for positives.
def confidence_percent(c: Column) -> Column:
    return F.concat(F.floor(c * 100 + 0.5).cast("long").cast("string"), F.lit("%"))


# F16 — policy defaults.
def policy_message(policy_id: Column, message: Column) -> Column:
    return F.coalesce(message, F.concat(F.lit('Violates policy "'), policy_id, F.lit('"')))


# String(x) of a JS number for our values: integral → no fraction digits.
def js_number(c: Column) -> Column:
    return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
