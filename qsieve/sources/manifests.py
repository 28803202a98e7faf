"""Dependency manifests at a repository root → dependency rows.

Manifests are read from the `files` table directly (not through discovery):
only root-level files count (`path` without a directory).  All kinds are read
in one scan: a row's own parser, chosen by its path, yields the array of its
entries in the order in which the source lists them, exploded once.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.regex import JS_SPACE_JAVA

NPM, CARGO, GO, PIP, PYPROJECT, GRADLE, GRADLE_KTS, POM = MANIFESTS = C.MANIFEST_FILES

_NPM_SCHEMA = "struct<dependencies: map<string,string>, devDependencies: map<string,string>>"


def js_escape(name: str) -> str:
    """Escape a literal for a regex the way the manifest parsers do."""
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m.group(0), name)


def _js_trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^{JS_SPACE_JAVA}+|{JS_SPACE_JAVA}+$", "")


def _entry(name: Column, version: Column, artifact: Column | None = None, known_ord: int | None = None) -> Column:
    """One dependency: name (Java: group), version, Java artifact, and the
    known package a Gradle pattern was built from."""
    return F.struct(name.alias("name"), version.alias("version"),
                    (F.lit(None).cast("string") if artifact is None else artifact).alias("artifact"),
                    F.lit(known_ord).cast("int").alias("known_ord"))


def _or_unknown(version: Column) -> Column:
    return F.coalesce(F.nullif(version, F.lit("")), F.lit("unknown"))


def _found(entries: list[Column]) -> Column:
    return F.filter(F.array(*entries), lambda e: e.isNotNull())


def npm_entries(content: Column) -> Column:
    """Dependencies then devDependencies of a package.json; a
    devDependencies entry replaces the same key (X3: map merge, right wins).
    Malformed JSON yields no entries."""
    j = F.from_json(content, _NPM_SCHEMA)
    deps = F.coalesce(j["dependencies"], F.create_map().cast("map<string,string>"))
    dev = F.coalesce(j["devDependencies"], F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(deps, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    return F.transform(F.map_entries(merged), lambda e: _entry(e["key"], e["value"]))


def cargo_entries(content: Column) -> Column:
    """The first line per known crate; version from a leading quoted
    string, else `version = "…"`, else `unknown`."""
    out = []
    for crate, *_ in C.CARGO_CRATES:
        rest = _js_trim(F.regexp_extract(content, C.CARGO_LINE.replace("{}", js_escape(crate)), 1))
        version = (F.when(rest.rlike(C.CARGO_QUOTED), F.regexp_extract(rest, C.CARGO_QUOTED, 1))
                   .when(rest.rlike(C.CARGO_VERSION), F.regexp_extract(rest, C.CARGO_VERSION, 1))
                   .otherwise(F.lit("unknown")))
        out.append(F.when(rest != "", _entry(F.lit(crate), version)))
    return _found(out)


def go_entries(content: Column) -> Column:
    """First line starting with a known module path (optionally a
    sub-path) followed by a `v…` version (J8's prefix rule lives in the
    pattern)."""
    out = []
    for module, *_ in C.GO_MODULES:
        v = F.regexp_extract(content, C.GO_LINE.replace("{}", js_escape(module)), 1)
        out.append(F.when(v != "", _entry(F.lit(module), v)))
    return _found(out)


def requirement_entries(content: Column) -> Column:
    """Every non-blank, non-comment line of requirements.txt; the name
    lower-cased, version after a comparison operator or `unknown`."""
    lines = F.filter(F.transform(F.split(content, "\n", -1), _js_trim),
                     lambda t: ~t.startswith("#") & t.rlike(C.REQUIREMENT))
    return F.transform(lines, lambda t: _entry(F.lower(F.regexp_extract(t, C.REQUIREMENT, 1)),
                                               _or_unknown(F.regexp_extract(t, C.REQUIREMENT, 2))))


def pyproject_entries(content: Column) -> Column:
    """First quoted `name op version` (case-insensitive) per known package."""
    out = []
    for pkg, *_ in C.PIP_PACKAGES:
        rx = C.PYPROJECT_ENTRY.replace("{}", js_escape(pkg))
        out.append(F.when(content.rlike(rx), _entry(F.lit(pkg), _or_unknown(_js_trim(F.regexp_extract(content, rx, 1))))))
    return _found(out)


def _gradle_entry(group: str, known_ord: int):
    return lambda e: _entry(F.lit(group), e["v"], e["a"], known_ord)


def gradle_entries(content: Column) -> Column:
    """`<configuration> (…group:artifact:version…)`, all hits, by known
    package, then position; the artifact must fully match the known pattern."""
    confs = "|".join(C.GRADLE_CONFIGURATIONS)
    out = []
    for i, (group, artifact, *_) in enumerate(C.JAVA_PACKAGES):
        rx = F.lit(r"(?:" + confs + r")\s*[(\"']+" + js_escape(group) + ":(" + artifact + r"):([^\"')]+)[\"')]")
        z = F.arrays_zip(F.regexp_extract_all(content, rx, F.lit(1)).alias("a"),
                         F.regexp_extract_all(content, rx, F.lit(2)).alias("v"))
        out.append(F.transform(z, _gradle_entry(group, i)))
    return F.concat(*out)


def pom_entries(content: Column) -> Column:
    """groupId directly followed by artifactId (and optional version)."""
    rx = F.lit(C.POM_DEPENDENCY)
    z = F.arrays_zip(*[F.regexp_extract_all(content, rx, F.lit(i)).alias(k) for i, k in enumerate("gav", start=1)])
    return F.transform(z, lambda d: _entry(_js_trim(d["g"]), _or_unknown(_js_trim(d["v"])), _js_trim(d["a"])))


PARSERS = {NPM: npm_entries, CARGO: cargo_entries, GO: go_entries, PIP: requirement_entries,
           PYPROJECT: pyproject_entries, GRADLE: gradle_entries, GRADLE_KTS: gradle_entries, POM: pom_entries}


def manifest_entries(files: DataFrame, names: list[str] = MANIFESTS) -> DataFrame:
    """(repo, path, pos, name, version, artifact, known_ord) for the root
    manifests called `names`, in one scan of `files`; `pos` counts a
    manifest's entries."""
    entries = None
    for name in names:
        parsed = PARSERS[name](F.col("content"))
        entries = F.when(F.col("path") == name, parsed) if entries is None else entries.when(F.col("path") == name, parsed)
    return (files.where(F.col("path").isin(names) & F.col("content").isNotNull())
            .select("repo", "path", F.posexplode(entries).alias("pos", "e"))
            .select("repo", "path", "pos", "e.*"))
