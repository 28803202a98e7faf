"""The regex branch (lines ⋈ rules).

Default plan (compiled): every rule becomes one literal expression
`when(applicable & token_gate & rlike(union), rule_ord)`; the 28 results are
exploded and nulls dropped.  Match column, snippet and confidence are computed
after the explode, on hits only.  The whole branch is narrow (no shuffle):
per-file work stays in the task that read the file.  The catalogue's gates are
read by Arrow's linear string search in the task (`gated_lines`): one pass for
all tokens over every line; the lines that hold any are told apart by halves of
the rules.  The rules' patterns are tested on these lines (`match_gated`).

User rule tables (E1) use the same plan when their size is checked to be
small enough to compile.  Beyond that, rules whose patterns are chains of
literals are matched together, in the task that reads a file, without a pattern
being run (`functions/chains.py`); of the rest, an inverted index of the
literals that their patterns require meets the lines' three-character runs, and
patterns are tested on the pairs that remain.  All give the same rows.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions import chains, literals
from ..functions.regex import effective_patterns, java_ci, js_word_boundary_java, to_re2, union
from ..session import dimension, materialize, shared_folder
from ..sources.rules import checked_rules, rule_rows, rules_frame

FINDING_COLS = ["repo", "rule_id", "description", "severity", "category", "algorithm",
                "replacement", "effort", "file", "line", "column", "snippet",
                "detection_method", "confidence", "phase", "rule_ord"]

# Largest user rule table compiled into literal expressions; larger tables
# are indexed.
MAX_COMPILED_RULES = 200
# Most rules without a required literal that are broadcast in one piece, and
# most literals (of up to 32 characters) of the index.
MAX_BROADCAST_RULES, MAX_BROADCAST_KEYS = 5000, 200_000
MAX_BROADCAST_BYTES = 32 << 20  # of such a piece, as JSON
# Most characters of the literals of chained rules that are matched in one pass
# over the lines; most joints (what stands between the literals of a chain).
MAX_CHAIN_CHARS, MAX_JOINTS = 2 << 20, 64

for _module in (literals, chains):
    cloudpickle.register_pickle_by_value(_module)  # executors need not import this package

_KEYWORD = js_word_boundary_java(C.CONF_KEYWORD_RE)
_CALL = C.CONF_CALL_RE
JS_TRIM = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200b))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"  # what JS trims
_COMMENT_MARKS = ["//", "#", "/*", "*", "--", ";"]  # CONF_COMMENT_RE's


def explode_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per LF-separated line (CR stays), 1-based `line_no`.
    `split(..., -1)` keeps trailing empty lines like String.split."""
    return (files.select("repo", "path", "language",
                         F.posexplode(F.split(F.col(content), "\n", -1)).alias("pos", "line"))
            .select("repo", "path", "language", (F.col("pos") + 1).cast("int").alias("line_no"),
                    "line"))


def applicable(languages: list[str], lang: Column) -> Column:
    """A rule with a language list skips files of another known language."""
    if not languages:
        return F.lit(True)
    return lang.isNull() | lang.isin(languages)


def _gate(lc: Column, literals: list[str] | None) -> Column:
    if not literals:
        return F.lit(True)
    cond = None
    for lit in literals:
        c = lc.contains(lit)
        cond = c if cond is None else (cond | c)
    return cond


def _held(patterns: list[str]) -> str | None:
    """An RE2 pattern that finds a match wherever one of the rule patterns does, or
    more: its case folding and `.` take in more characters than Java's, `\\s` gets
    Java's vertical tab.  None where RE2 has no form or a boundary may differ."""
    try:
        forms = [to_re2(p) for p in patterns]
    except ValueError:
        return None
    if any(re.search(r"\\[bBdDwWSpPkQ]|\[[^\]]*\\s|\[\^|\\[1-9]|\$$|\$[^)]", p) for p in patterns):
        return None
    return union([f.replace(r"\s", r"[\s\x0b]") for f in forms])


def _gated(gates: list[tuple], most_bytes: int = 8 << 20):
    """A `mapInArrow` function: (repo, path, language, content) → the lines that
    hold a token of a rule's gate (ASCII case aside), with that rule's ordinal,
    rule by rule; the contents are split in portions of bounded size.  A gate is
    (ordinal, tokens) or (ordinal, tokens, pattern): lines without a match of
    the pattern (RE2, case aside) are left out too.

    Rules are told apart by halves: a line that holds no token of the first
    half's rules must hold one of the second's, so a line of one rule is read as
    often as the rules can be halved, not once a rule."""
    gates = [(n, "|".join(map(re.escape, tokens)), *more) for n, tokens, *more in gates]
    tokens_of = lambda some: "|".join(dict.fromkeys(g[1] for g in some))
    any_token = tokens_of(gates)

    def portion(batch):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def holds(lines, pattern):
            return pc.match_substring_regex(lines, pattern, ignore_case=True).to_numpy(zero_copy_only=False)

        def told(lines, at, some):
            """The rules of `some` with the lines of their own; each line holds a token of one."""
            if not len(at):
                return
            if len(some) == 1:
                (n, _, *more), = some
                if more and more[0] is not None:
                    own = np.flatnonzero(holds(lines, more[0]))
                    lines, at = lines.take(pa.array(own)), at[own]
                if len(at):
                    yield n, lines, at
                return
            one, other = some[:len(some) // 2], some[len(some) // 2:]
            first = holds(lines, tokens_of(one))
            second = ~first
            both = np.flatnonzero(first)
            yield from told(lines.take(pa.array(both)), at[both], one)
            second[both] = holds(lines.take(pa.array(both)), tokens_of(other))
            rest = np.flatnonzero(second)
            yield from told(lines.take(pa.array(rest)), at[rest], other)

        parts = pc.split_pattern(batch["content"], "\n")
        lines, file = pc.list_flatten(parts), pc.list_parent_indices(parts).to_numpy()
        at = np.flatnonzero(holds(lines, any_token))
        line_no = (at - np.searchsorted(file, file[at]) + 1).astype(np.int32)
        of = file[at]
        for n, own, i in told(lines.take(pa.array(at)), np.arange(len(at)), gates):
            files = [batch[c].take(pa.array(of[i])) for c in ("repo", "path", "language")]
            yield pa.RecordBatch.from_arrays([*files, pa.array(line_no[i]), own, pa.array(np.full(len(i), n, np.int32))],
                                             ["repo", "path", "language", "line_no", "line", "rule_ord"])

    def run(batches):
        import numpy as np
        import pyarrow.compute as pc

        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch["content"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(ends // most_bytes)) + 1), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    yield from portion(batch.slice(a, b - a))

    return run


def gated_lines(files: DataFrame) -> DataFrame:
    """The lines of `explode_lines` that pass a catalogue rule's gate and hold a
    match in RE2's reading, a row per line and rule (`rule_ord`).  Contents are read once, in the task; only these
    lines return to the JVM, those of one rule together, so that its pattern is
    compiled once for many."""
    gates = [(r["rule_ord"], C.TOKEN_GATES[r["rule_id"]], _held(effective_patterns(r["patterns"]))) for r in rule_rows()]
    return files.select("repo", "path", "language", "content").mapInArrow(
        _gated(gates), "repo string, path string, language string, line_no int, line string, rule_ord int")


def _fits() -> Column:
    """P3 over a `languages` column."""
    return (F.size("languages") == 0) | F.col("language").isNull() | F.array_contains("languages", F.col("language"))


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """`value` as a column that filters above it read: as a projection, Catalyst
    would copy it into each of them and evaluate it once more."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def _gated_hits(files: DataFrame) -> DataFrame:
    """The (line, rule) hits among the gated lines, with the rule's attributes and
    `upto`, the text up to its match.  The pattern that tells a hit is the match
    column's too, run once a line; `regexp_extract` keeps it compiled while it
    stays the same (`rlike` by a column compiles it for every row)."""
    pairs = gated_lines(files).join(F.broadcast(rule_dimension(files.sparkSession)), "rule_ord").where(_fits())
    return _once(pairs, "upto", F.expr("regexp_extract(line, rx_first, 0)")).where("upto != ''").drop("languages", "rx_first")


def match_gated(files: DataFrame) -> DataFrame:
    """J1 for the catalogue: the (line, rule) hits among the gated lines."""
    return _gated_hits(files).select("rule_ord", "repo", "path", "language", "line_no", "line")


def match_compiled(lines: DataFrame, rules: list[dict] | None = None,
                   use_gates: bool = True) -> DataFrame:
    """J1, compiled: adds `rule_ord` for every (line, rule) hit."""
    rows = rule_rows(rules)
    gates = C.TOKEN_GATES if (rules is None and use_gates) else {}
    lc = F.col("lc")
    lang = F.col("language")
    line = F.col("line")
    hits = [F.when(applicable(r["languages"], lang) & _gate(lc, gates.get(r["rule_id"]))
                   & line.rlike(java_ci(union(effective_patterns(r["patterns"])))),
                   F.lit(r["rule_ord"]))
            for r in rows]
    return (lines.select("*", F.lower("line").alias("lc"))
            .select(*lines.columns, F.explode(F.array(*hits)).alias("rule_ord"))
            .where(F.col("rule_ord").isNotNull()))


def match_column() -> Column:
    """Leftmost match of the first pattern (in list order) that matches.

    Evaluated on hits only, over the hit's own `rx_list` (patterns with the
    case-insensitive flag, carried on the broadcast rule dimension).  One
    small expression instead of a per-rule CASE over every literal pattern,
    which would push the generated method past the JVM's 64 KB limit."""
    return F.expr("try_element_at(filter(transform(rx_list, p -> regexp_instr(line, p)), "
                  "x -> x > 0), 1)").cast("int")


def first_match_column(upto: str = "regexp_extract(line, rx_first, 0)") -> Column:
    """`match_column` by one pattern a rule, `rx_first`, which spans what stands
    before the match and the match's first character: it is compiled once for a
    rule's lines, and patterns after the first that matches are not tried.  For
    patterns without back references and empty matches.  Counted in UTF-16 units,
    as `regexp_instr` does."""
    return F.expr(f"if(octet_length({upto}) = char_length({upto}), char_length({upto}), "
                  f"octet_length(encode(left({upto}, char_length({upto}) - 1), 'UTF-16BE')) div 2 + 1)").cast("int")


def _first(patterns: list[str]) -> str:
    """The text before the leftmost match of the first pattern that matches, and
    the match's first character."""
    return "|".join(f"^(?s:.*?)(?=(?i:{p}))(?s:.)" for p in patterns)


def rule_dimension(spark, rules: list[dict] | None = None) -> DataFrame:
    """Rule attributes plus what the match column needs (broadcast side): `rx_first`
    (and the languages) of the catalogue, else `rx_list`."""
    if rules is None:
        first = [(r["rule_ord"], r["languages"], _first(effective_patterns(r["patterns"]))) for r in rule_rows()]
        rx = dimension(spark, "rule_first", lambda: spark.createDataFrame(first, "rule_ord int, languages array<string>, rx_first string"))
        return rules_frame(spark).drop("patterns", "languages").join(F.broadcast(rx), "rule_ord")
    rows = rule_rows(rules)
    eff = F.create_map(*[x for r in rows for x in (
        F.lit(r["rule_ord"]), F.array(*[F.lit("(?i)" + p) for p in effective_patterns(r["patterns"])]))])
    return (rules_frame(spark, rules)
            .withColumn("rx_list", F.element_at(eff, F.col("rule_ord")))
            .drop("patterns", "languages"))


def snippet(line: Column) -> Column:
    """JS trim(), first 120 characters."""
    return F.substring(F.btrim(line, F.lit(JS_TRIM)), 1, C.SNIPPET_CHARS)


def regex_confidence(line: Column, lang: Column, severity: Column) -> Column:
    """Last writer wins — comment > call shape > import keyword > base.
    A substring that every match holds is looked for before a pattern."""
    begins, holds = F.ltrim(line, F.lit(JS_TRIM)), lambda *words: reduce(Column.__or__, [line.contains(w) for w in words])
    c = (F.when(reduce(Column.__or__, [begins.startswith(m) for m in _COMMENT_MARKS]), F.lit(C.CONF_COMMENT))
         .when(holds("')", '")') & line.rlike(_CALL), F.lit(C.CONF_CALL))
         .when(holds("import", "require", "from", "include", "use") & line.rlike(_KEYWORD), F.lit(C.CONF_KEYWORD))
         .otherwise(F.lit(C.CONF_BASE)))
    c = F.when(lang.isNull(), c * C.CONF_NULL_LANG_FACTOR).otherwise(c)
    c = F.when(severity == "safe", F.greatest(c, F.lit(C.CONF_SAFE_FLOOR))).otherwise(c)
    return F.round(c, 2)


def oversize_files(files: DataFrame, max_chars: int = C.MAX_REGEX_CHARS) -> DataFrame:
    """The files that a limit of `max_chars` keeps from the regex branch."""
    return files.where(F.length("content") > max_chars).select("repo", "path", F.length("content").cast("long").alias("n_chars"))


def _within(files: DataFrame, max_chars: int | None) -> DataFrame:
    return files if max_chars is None else files.where(F.length("content") <= max_chars)


def regex_findings(files: DataFrame, rules: list[dict] | None = None,
                   use_gates: bool = True, max_chars: int | None = None) -> DataFrame:
    """Regex-branch findings (phase 0) for readable files with `language`.

    S7: with `max_chars`, longer files are skipped on this branch only (see
    `oversize_files`); lines are exploded, so no limit is needed by default."""
    text = _within(files, max_chars)
    if rules is None and use_gates:
        hits, column = _gated_hits(text), first_match_column("upto")
    else:
        hits = match_compiled(explode_lines(text), rules, use_gates)
        hits = hits.join(F.broadcast(rule_dimension(files.sparkSession, rules).drop("languages")), "rule_ord")
        column = first_match_column() if rules is None else match_column()
    out = (_once(hits, "confidence", regex_confidence(F.col("line"), F.col("language"), F.col("severity")))
           .select("repo", "rule_id", "description", "severity", "category", "algorithm",
                   "replacement", "effort", F.col("path").alias("file"),
                   F.col("line_no").alias("line"), column.alias("column"),
                   snippet(F.col("line")).alias("snippet"),
                   F.lit("regex").alias("detection_method"), "confidence",
                   F.lit(C.PHASE_REGEX).alias("phase"), "rule_ord"))
    if rules is not None and len({r["id"] for r in rules}) != len(rules):
        out = _same_line_dedupe(out)
    return out


def _same_line_dedupe(findings: DataFrame) -> DataFrame:
    """One finding per (file, rule id, line) — the earliest rule wins.
    Only reachable with duplicated ids in a user rule table."""
    key = ["repo", "file", "rule_id", "line"]
    rest = [c for c in findings.columns if c not in key]
    best = findings.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("rule_ord", "column", "description")).alias("b"))
    return best.select(*(c if c in key else F.col("b").getField(c).alias(c) for c in findings.columns))


def _index_rows():
    """A mapInArrow function: (rule_no, patterns) -> (rule_no, gram, literal),
    one row per required literal; a rule without any has one row of nulls."""
    required, gram_of = literals.required_literals, literals.key_gram

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for no, patterns in zip(batch["rule_no"].to_pylist(), batch["patterns"].to_pylist()):
                rows += [(no, gram_of(x), x) for x in sorted(required(patterns) or ())] or [(no, None, None)]
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string()))], ["rule_no", "gram", "literal"])

    return run


def rule_index(rules: DataFrame) -> DataFrame:
    """(rule_no, gram, literal) of rules(rule_no, patterns): the literals of
    which a match of the rule holds one (null: none is known), each under three
    of its characters.  Read where the rules are; none pass the driver."""
    return rules.select("rule_no", "patterns").mapInArrow(_index_rows(), "rule_no long, gram string, literal string")


def _candidates(lines: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """(line, rule) pairs of which the line holds a required literal: the
    line's three-character runs meet the index, a broadcast hash join; k index
    chunks, so that a broadcast side is bounded."""
    grams = F.array_distinct(F.regexp_extract_all("lc", F.lit(r"(?=([\x20-\x7E]{3}))"), F.lit(1)))
    spread = lines.withColumn("lc", F.lower("line")).withColumn("gram", F.explode(grams))
    part = F.pmod(F.xxhash64("gram", "rule_no"), F.lit(k))
    chunks = [index if k == 1 else index.where(part == i) for i in range(k)]
    found = reduce(DataFrame.unionByName, [spread.join(F.broadcast(c), "gram") for c in chunks])
    return found.where(F.col("lc").contains(F.col("literal"))).drop("lc", "gram", "literal")


def _one_of_equals(rules: DataFrame) -> DataFrame:
    """Of the rules that agree in id, languages and patterns the earliest: they
    match the same lines, of which P8 keeps its finding."""
    key = ["rule_id", "languages", "patterns"]
    rest = [c for c in rules.columns if c not in key]
    first = rules.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct("rule_ord", "description")).alias("b"))
    return first.select(*(c if c in key else F.col("b").getField(c).alias(c) for c in rules.columns))


def _chunks(side: DataFrame, most_rows: int) -> tuple[int, int]:
    """A broadcast side's rows, and the chunks that bound each chunk's rows and bytes."""
    n, size = side.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct(*side.columns)))), F.lit(0))).first()
    return n, max(1, -(-n // most_rows), -(-size // MAX_BROADCAST_BYTES))


_RULE_COLS = ["rule_ord", "rule_id", "description", "severity", "category", "algorithm", "replacement", "effort"]


def _joined_out(hit: DataFrame, column: Column, snip: Column, confidence: Column) -> DataFrame:
    return hit.select("repo", "rule_id", "description", "severity", "category", "algorithm",
                      "replacement", "effort", F.col("path").alias("file"), F.col("line_no").alias("line"), column.alias("column"),
                      snip.alias("snippet"), F.lit("regex").alias("detection_method"), confidence.alias("confidence"),
                      F.lit(C.PHASE_REGEX).alias("phase"), "rule_ord")


def _chain_table(rules: DataFrame) -> tuple[DataFrame, DataFrame, str | None, int]:
    """The rules of ids of which all patterns are chains (`functions/chains.py`)
    and whose ordinals differ, numbered (`rn`) part by part in the order of ids
    and ordinals; the other rules; the folder of the chains' table by part; the
    number of parts.  An id's rules are in one part."""
    rows = materialize(rules.select("rule_no", "patterns").mapInArrow(
        chains.chain_rows(), "rule_no long, place int, joint string, repeated string, heads array<string>, tails array<string>"))
    joints = [x["joint"] for x in rows.where("joint is not null").groupBy("joint").count().orderBy(F.desc("count"), "joint").limit(MAX_JOINTS).collect()]
    held = F.aggregate(F.concat("heads", "tails"), F.lit(0), lambda n, x: n + F.length(x))
    known = rows.groupBy("rule_no").agg(F.min(F.coalesce(F.col("joint").isin(joints), F.lit(False))).alias("known"), F.sum(held).alias("chars"))
    marked = rules.join(known, "rule_no")
    ids = (marked.groupBy("rule_id", "rule_ord").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("known"))
           .groupBy("rule_id").agg((F.min("known") & (F.max("n") == 1)).alias("chained")))
    marked = materialize(marked.drop("known").join(ids, "rule_id"))
    own = marked.where("chained")
    n, chars = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    others = marked.where("not chained").select(*rules.columns)
    if not n:
        return own, others, None, 0
    k = max(1, -(-chars // MAX_CHAIN_CHARS))
    own = own.withColumn("part", F.pmod(F.xxhash64("rule_id"), F.lit(k)).cast("int"))
    own = materialize(own.withColumn("rn", F.row_number().over(Window.partitionBy("part").orderBy("rule_id", "rule_ord"))))
    folder = shared_folder(rules.sparkSession, "chains")
    (own.select("rule_no", "part", "rn", "rule_id", "languages").join(rows, "rule_no").drop("rule_no")
     .repartition(k, "part").write.partitionBy("part").parquet(folder))
    return own.select("part", "rn", *_RULE_COLS), others, folder, k


def _chained(files: DataFrame, rules: DataFrame, folder: str, part: int) -> DataFrame:
    """Findings of the chained rules of one part: a row per line and rule id, the
    earliest rule's.  What a line alone tells is told once a line."""
    lines = files.select("repo", "path", "language", "content").mapInArrow(
        chains.chain_hits(f"{folder}/part={part}"), "repo string, path string, language string, line_no int, line string, hits array<bigint>")
    sure = lambda severity: regex_confidence(F.col("line"), F.col("language"), F.lit(severity))
    told = lines.select("repo", "path", "line_no", snippet(F.col("line")).alias("snippet"), sure("low").alias("confidence"), sure("safe").alias("safe"), "hits")
    hits = told.withColumn("hit", F.explode("hits")).drop("hits").withColumn("rn", F.shiftright("hit", 32).cast("int"))
    hits = hits.join(F.broadcast(rules.where(F.col("part") == part).drop("part")), "rn")
    return _joined_out(hits, F.col("hit").bitwiseAND(F.lit((1 << 32) - 1)).cast("int"), F.col("snippet"),
                       F.when(F.col("severity") == "safe", F.col("safe")).otherwise(F.col("confidence")))


def _same_path(files: DataFrame) -> DataFrame | None:
    """(repo, path) that more than one file has, if any."""
    twice = materialize(files.groupBy("repo", "path").count().where("count > 1").select("repo", "path"))
    return None if twice.isEmpty() else twice


def regex_findings_join(files: DataFrame, rules: DataFrame, max_chars: int | None = None) -> DataFrame:
    """J1, indexed form for a user rule DataFrame (E1) of any size.  Rules whose
    patterns are chains of literals are matched together in the task that read
    the file (`_chained`): a line's earliest rule of each id is known there, so
    nothing is shuffled, save the findings of files that share their path.
    Rules of ids with other patterns go through the inverted index
    (`_indexed`).  The same rows and ordinals as `regex_findings`."""
    numbered = _one_of_equals(checked_rules(rules)).withColumn("rule_no", F.monotonically_increasing_id())
    rules = materialize(numbered)  # numbered once
    text = _within(files, max_chars)
    chained, others, folder, k = _chain_table(rules)
    found = []
    if folder:
        twice = None if text.isStreaming else _same_path(text)
        if text.isStreaming:
            found += [_same_line_dedupe(_chained(text, chained, folder, i)) for i in range(k)]
        elif twice is None:
            found += [_chained(text, chained, folder, i) for i in range(k)]
        else:
            of = twice.select(F.col("repo").alias("r"), F.col("path").alias("p"))
            same = F.col("repo").eqNullSafe(F.col("r")) & F.col("path").eqNullSafe(F.col("p"))
            for i in range(k):
                found += [_chained(text.join(of, same, "left_anti"), chained, folder, i),
                          _same_line_dedupe(_chained(text.join(of, same, "left_semi"), chained, folder, i))]
    if not found or not others.isEmpty():
        found.append(_indexed(text, others))
    return reduce(DataFrame.unionByName, found)


def _indexed(files: DataFrame, rules: DataFrame) -> DataFrame:
    """The literals that a match must hold form an inverted index; lines meet it,
    and a rule's patterns are tested on those lines only.  Rules without a
    required literal are tested on all lines, in a broadcast nested-loop join.
    Either side of the joins that is broadcast carries the rules themselves, so
    lines are matched in the task that read them and findings alone are shuffled."""
    r = rules.select("rule_no", "rule_ord", "rule_id", "description", "severity", "category", "algorithm",
                     "replacement", "effort", "languages",
                     F.transform("patterns", lambda p: F.concat(F.lit("(?i)"), p)).alias("rx_list"),
                     F.concat(F.lit("(?i)"), F.concat_ws(
                         "|", F.transform("patterns", lambda p: F.concat(F.lit("(?:"), p, F.lit(")"))))
                     ).alias("rx"))
    index = materialize(rule_index(rules).join(r, "rule_no"))
    lines = explode_lines(files)
    fits = ((F.coalesce(F.size("languages"), F.lit(0)) <= 0) | F.col("language").isNull()
            | F.array_contains("languages", F.col("language"))) & F.expr("line rlike rx")
    keyed, plain = index.where(F.col("gram").isNotNull()), index.where(F.col("gram").isNull()).drop("gram", "literal")
    (n_keys, k), (n_plain, k_plain) = _chunks(keyed, MAX_BROADCAST_KEYS), _chunks(plain, MAX_BROADCAST_RULES)
    hits = []
    if n_keys:
        hits.append(_candidates(lines, keyed, k).where(fits))
    if n_plain or not n_keys:
        # Each broadcast side holds at most MAX_BROADCAST_RULES rules: more are
        # tested in bounded chunks (one pass over the lines each), never as a
        # shuffled cartesian product.
        part = F.pmod(F.xxhash64("rule_no"), F.lit(k_plain))
        hits += [lines.join(F.broadcast(plain if k_plain == 1 else plain.where(part == i)), fits) for i in range(k_plain)]
    hit = reduce(DataFrame.unionByName, [h.select("repo", "path", "line_no", "line", "language", *(c for c in r.columns if c not in ("languages", "rx"))) for h in hits])
    out = _joined_out(hit, match_column(), snippet(F.col("line")), regex_confidence(F.col("line"), F.col("language"), F.col("severity")))
    return _same_line_dedupe(out)


def regex_findings_for(files: DataFrame, rules: DataFrame | list[dict] | None = None,
                       max_chars: int | None = None) -> DataFrame:
    """Pick the plan: catalogue/list → compiled; DataFrame → compiled when its
    row count is within MAX_COMPILED_RULES (a dimension, checked) and its
    ordinals are unique, else indexed.  The rows and their ordinals, which are
    the table's own, are the same in either form."""
    if rules is None or isinstance(rules, list):
        return regex_findings(files, rules, max_chars=max_chars)
    n = rules.limit(MAX_COMPILED_RULES + 1).count()
    if n <= MAX_COMPILED_RULES:
        rows = [dict(id=x["rule_id"], rule_ord=x["rule_ord"], description=x["description"], severity=x["severity"],
                     category=x["category"], algorithm=x["algorithm"],
                     replacement=x["replacement"], effort=x["effort"],
                     languages=x["languages"] or [], patterns=x["patterns"] or [])
                for x in checked_rules(rules).orderBy("rule_ord").collect()]
        if len({x["rule_ord"] for x in rows}) == len(rows):
            return regex_findings(files, rows, max_chars=max_chars)
    return regex_findings_join(files, rules, max_chars)
