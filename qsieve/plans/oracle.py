"""DuckDB oracle SQL, generated from the same constants as the Spark plans.

Each registered query has an ANSI-ish SQL twin that DuckDB runs on the same
parquet views.  The SQL rebuilds the planted inputs from the same literal
lists (VALUES), evaluates the rule patterns in their RE2 form (look-aheads
rewritten, see functions/regex.py) and expresses the operators with plain SQL
(window row_number for de-duplication, CASE for classification), so it is an
independent formulation of the same semantics.
"""

from __future__ import annotations

from .. import catalog as C
from ..functions.regex import JS_SPACE_RE2, re2_ci, sql_str, to_re2, union
from ..sources import files as SF
from ..sources.rules import rule_rows
from . import corpus as CP

S = sql_str


def values(rows: list[tuple], cols: list[str], alias: str = "t") -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST({v!r} AS DOUBLE)"
        if isinstance(v, int):
            return repr(v)
        if isinstance(v, list):
            return "[" + ", ".join(lit(x) for x in v) + "]::VARCHAR[]" if v else "[]::VARCHAR[]"
        return S(v)
    body = ",\n  ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES\n  {body}) AS {alias}({', '.join(cols)})"


def case_map(expr: str, d: dict, cast: str | None = None) -> str:
    whens = " ".join(f"WHEN {S(k)} THEN {S(v) if isinstance(v, str) else v}" for k, v in d.items())
    out = f"CASE {expr} {whens} END"
    return f"CAST({out} AS {cast})" if cast else out


def sev_rank(expr: str = "severity") -> str:
    return case_map(expr, C.SEVERITY_RANK, "INTEGER")


# --------------------------------------------------------------------- corpus

def files_sql() -> str:
    n, m = len(CP.PLANTS), len(CP.DIRS)
    plants = values([(i, s, b) for i, (s, b) in enumerate(CP.PLANTS)], ["k", "suffix", "body"], "pl")
    dirs = values(list(enumerate(CP.DIRS)), ["d", "dir"], "dd")
    return f"""
SELECT source AS repo, dir || 'doc' || CAST(doc_id AS VARCHAR) || suffix AS path,
       text || chr(10) || body AS content
FROM documents JOIN {plants} ON documents.doc_id % {n} = pl.k
JOIN {dirs} ON documents.doc_id % {m} = dd.d
UNION ALL
SELECT 'site' || CAST(page_id % {CP.N_PAGE_REPOS} AS VARCHAR) AS repo,
       'pages/p' || CAST(page_id AS VARCHAR) || '.xml' AS path, html AS content
FROM pages"""


def inventory_files_sql() -> str:
    paths = values(list(enumerate(CP.INVENTORY_PATHS)), ["k", "form"], "ip")
    return (f"SELECT source AS repo, replace(form, '%', CAST(doc_id AS VARCHAR)) AS path, text AS content "
            f"FROM documents JOIN {paths} ON documents.doc_id % {len(CP.INVENTORY_PATHS)} = ip.k")


def language_sql(path: str = "path") -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^.]*)$', 1))"
    base = f"lower(regexp_extract({path}, '([^/]*)$', 1))"
    root = f"split_part({base}, '.', 1)"
    return (f"coalesce({case_map(ext, C.LANG_MAP)}, {case_map(base, C.FILENAME_MAP)}, "
            f"{case_map(root, C.FILENAME_MAP)})")


def is_binary_sql(path: str = "path") -> str:
    ext = f"lower(regexp_extract({path}, '(\\.[^.]*)$', 1))"
    return f"({ext} IN ({', '.join(S(e) for e in C.BINARY_EXTENSIONS)}))"


def discovered_sql(files: str = "files", include: list[str] | None = None, exclude: list[str] | None = None) -> str:
    inc = (f"((NOT regexp_matches(path, {S(SF._DOT_SEGMENT)}) AND (regexp_matches(path, {S(SF._EXT_RE)})"
           f" OR regexp_matches(path, {S(SF._NAME_RE)}))) OR regexp_matches(path, {S(SF._SSH_CONFIG_RE)}))")
    exc = f"regexp_matches(path, {S(SF._EXCLUDE_RE)})"
    if include is not None:
        inc = "(" + " OR ".join(f"regexp_matches(path, {S(r)})" for r in include) + ")"
    if exclude:
        exc = "(" + " OR ".join([exc] + [f"regexp_matches(path, {S(r)})" for r in exclude]) + ")"
    return (f"SELECT repo, path, content, {language_sql()} AS language, {is_binary_sql()} AS is_binary, "
            f"CAST(length(content) AS BIGINT) AS n_chars FROM {files} WHERE {inc} AND NOT {exc}")


def readable_sql(disc: str = "discovered") -> str:
    return f"SELECT * FROM {disc} WHERE NOT is_binary AND content IS NOT NULL"


# ---------------------------------------------------------------- regex branch

def _applicable(r: dict) -> str:
    if not r["languages"]:
        return "TRUE"
    return f"(language IS NULL OR language IN ({', '.join(S(x) for x in r['languages'])}))"


def rules_values(alias: str = "r") -> str:
    rows = [(r["rule_ord"], r["rule_id"], r["description"], r["severity"], r["category"],
             r["algorithm"], r["replacement"], r["effort"]) for r in rule_rows()]
    return values(rows, ["rule_ord", "rule_id", "description", "severity", "category",
                         "algorithm", "replacement", "effort"], alias)


def _column_sql() -> str:
    parts = []
    for r in rule_rows():
        pos = ", ".join(
            f"CASE WHEN regexp_matches(line, {S(re2_ci(p))}) THEN "
            f"length(regexp_extract(line, {S('(?i)^(.*?)(?:' + to_re2(p) + ')')}, 1)) + 1 END"
            for p in r["patterns"])
        parts.append(f"WHEN {r['rule_ord']} THEN coalesce({pos})")
    return f"CAST(CASE h.rule_ord {' '.join(parts)} END AS INTEGER)"


_COMMENT_RE2 = C.CONF_COMMENT_RE.replace(r"\s", JS_SPACE_RE2)
_TRIM_RE2 = f"^{JS_SPACE_RE2}+|{JS_SPACE_RE2}+$"


def confidence_sql(line: str = "line", lang: str = "language", sev: str = "severity") -> str:
    c0 = (f"(CASE WHEN regexp_matches({line}, {S(_COMMENT_RE2)}) THEN 0.3::DOUBLE "
          f"WHEN regexp_matches({line}, {S(C.CONF_CALL_RE)}) THEN 0.85::DOUBLE "
          f"WHEN regexp_matches({line}, {S(C.CONF_KEYWORD_RE)}) THEN 0.9::DOUBLE "
          f"ELSE 0.7::DOUBLE END)")
    c1 = f"(CASE WHEN {lang} IS NULL THEN {c0} * 0.8::DOUBLE ELSE {c0} END)"
    return f"round(CASE WHEN {sev} = 'safe' THEN greatest({c1}, 0.8::DOUBLE) ELSE {c1} END, 2)"


def snippet_sql(line: str = "line") -> str:
    return f"substr(regexp_replace({line}, {S(_TRIM_RE2)}, '', 'g'), 1, {C.SNIPPET_CHARS})"


def regex_findings_sql(readable: str = "readable") -> str:
    cases = ", ".join(
        f"CASE WHEN {_applicable(r)} AND regexp_matches(line, {S(re2_ci(union(r['patterns'])))}) "
        f"THEN {r['rule_ord']} END" for r in rule_rows())
    return f"""
SELECT h.repo, r.rule_id, r.description, r.severity, r.category, r.algorithm, r.replacement,
       r.effort, h.path AS file, CAST(h.line_no AS INTEGER) AS line, {_column_sql()} AS "column",
       {snippet_sql('h.line')} AS snippet, 'regex' AS detection_method,
       {confidence_sql('h.line', 'h.language', 'r.severity')} AS confidence,
       {C.PHASE_REGEX} AS phase, h.rule_ord
FROM (
  SELECT repo, path, language, line_no, line,
         unnest(list_filter([{cases}], lambda x: x IS NOT NULL)) AS rule_ord
  FROM (
    SELECT repo, path, language, unnest(string_split(content, chr(10))) AS line,
           generate_subscripts(string_split(content, chr(10)), 1) AS line_no
    FROM {readable}
  )
) h JOIN {rules_values("r")} ON h.rule_ord = r.rule_ord"""


# ------------------------------------------------------ filter / dedupe / sum

def filtered_sql(raw: str, min_confidence: float = C.DEFAULT_MIN_CONFIDENCE,
                 min_severity: str = "safe") -> str:
    return (f"SELECT * FROM {raw} WHERE confidence * 100 >= {float(min_confidence)} "
            f"AND {sev_rank()} <= {C.SEVERITY_RANK[min_severity]}")


def dedupe_sql(filtered: str) -> str:
    order = (f"confidence DESC, {sev_rank()} ASC, file ASC, phase ASC NULLS FIRST, "
             f"rule_ord ASC NULLS FIRST, line ASC NULLS FIRST, \"column\" ASC NULLS FIRST")
    first = ("PARTITION BY repo, rule_id, file ORDER BY phase ASC NULLS FIRST, rule_ord ASC NULLS FIRST, "
             "line ASC NULLS FIRST, \"column\" ASC NULLS FIRST")
    fp = ", ".join(f"first_value({c}) OVER ({first}) AS fp_{n}"
                   for c, n in [("phase", "phase"), ("rule_ord", "rule"), ("line", "line"), ('"column"', "col")])
    return f"""
SELECT * EXCLUDE (rn, n), CASE WHEN n > 1 THEN n END AS occurrences FROM (
  SELECT *, row_number() OVER (PARTITION BY repo, rule_id, file ORDER BY {order}) AS rn,
         CAST(count(*) OVER (PARTITION BY repo, rule_id, file) AS BIGINT) AS n, {fp}
  FROM {filtered}) WHERE rn = 1"""


def summary_sql(findings: str, discovered: str) -> str:
    sev = ", ".join(f"CAST(count_if(severity = {S(s)}) AS BIGINT) AS {s}" for s in C.SEVERITIES)
    cat = ", ".join(f"CAST(count_if(category = {S(c)}) AS BIGINT) AS {c}" for c in C.CATEGORIES)
    cols = ["findings_total"] + C.SEVERITIES + C.CATEGORIES
    pick = ", ".join(f"coalesce(c.{x}, 0) AS {x}" for x in cols)
    return f"""
SELECT coalesce(f.repo, c.repo) AS repo, coalesce(f.files_scanned, 0) AS files_scanned, {pick},
       (coalesce(c.critical, 0) = 0 AND coalesce(c.high, 0) = 0) AS pqc_ready,
       CAST(CASE WHEN coalesce(c.findings_total, 0) = 0 THEN 100
            ELSE floor(100.0 * c.safe / c.findings_total + 0.5) END AS BIGINT) AS pqc_score
FROM (SELECT repo, CAST(count(DISTINCT path) AS BIGINT) AS files_scanned FROM {discovered} GROUP BY repo) f
FULL OUTER JOIN (SELECT repo, CAST(count(*) AS BIGINT) AS findings_total, {sev}, {cat}
                 FROM {findings} GROUP BY repo) c ON f.repo = c.repo"""


def with_ctes(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes)
    return f"WITH {body}\n{final}"


# ---------------------------------------------------------------- usage branch

# The usage sites of every planted text, read off by hand (not computed by any
# expression of the engine): (plant, line, column, rule, confidence).
USAGE_SITES = [
    (0, 1, 1, "ED25519_USAGE", 0.98), (0, 5, 24, "MD5_USAGE", 0.95), (0, 7, 14, "RSA_KEY_GEN", 0.96),
    (0, 11, 16, "ECDH_KEY_EXCHANGE", 0.96), (0, 12, 16, "AES_128", 0.95), (0, 13, 15, "AES_256", 0.95),
    (0, 14, 16, "RSA_SIGN", 0.96),
    (2, 1, 1, "ML_KEM", 0.98), (2, 2, 1, "ML_KEM", 0.98), (2, 6, 13, "SHA3_SAFE", 0.95), (2, 7, 16, "CHACHA20", 0.95),
    (3, 4, 13, "ED25519_USAGE", 0.95), (3, 5, 13, "RSA_KEY_GEN", 0.95), (3, 6, 15, "ECDSA_USAGE", 0.96),
    (3, 7, 1, "RSA_SIGN", 0.96), (3, 8, 14, "DH_KEY_EXCHANGE", 0.95), (3, 8, 75, "RSA_ENCRYPT", 0.95),
    (3, 10, 13, "DSA_USAGE", 0.96),
    (11, 1, 67, "SHA1_USAGE", 0.95), (11, 2, 48, "MD5_USAGE", 0.95), (11, 3, 21, "SHA256_SAFE", 0.95),
    (11, 4, 15, "MD5_USAGE", 0.95), (11, 6, 1, "DES_3DES", 0.95),
    (12, 2, 14, "CHACHA20", 0.95), (12, 3, 14, "SHA3_SAFE", 0.95), (12, 6, 14, "DES_3DES", 0.95),
    (15, 1, 1, "ED25519_USAGE", 0.98), (15, 5, 1, "ECDSA_USAGE", 0.98), (15, 6, 1, "ML_KEM", 0.98),
    (15, 8, 12, "SHA1_USAGE", 0.95), (15, 10, 14, "ECDSA_USAGE", 0.95), (15, 10, 54, "ECDSA_USAGE", 0.95),
    (16, 1, 1, "RSA_SIGN", 0.90), (16, 2, 1, "ED25519_USAGE", 0.95), (16, 3, 1, "ED25519_USAGE", 0.90),
    (16, 4, 12, "ED25519_USAGE", 0.96), (16, 5, 13, "RSA_ENCRYPT", 0.95), (16, 6, 12, "AES_128", 0.95),
    (16, 6, 62, "AES_256", 0.95), (16, 7, 13, "RSA_SIGN", 0.96),
    (17, 1, 1, "ECDSA_USAGE", 0.98), (17, 33, 11, "MD5_USAGE", 0.95), (17, 37, 11, "ECDH_KEY_EXCHANGE", 0.96),
    (18, 1, 14, "RSA_SIGN", 0.96), (18, 30, 14, "ECDSA_USAGE", 0.96), (18, 30, 25, "ECDSA_USAGE", 0.96),
    (19, 1, 45, "MD5_USAGE", 0.95), (19, 2, 53, "SHA1_USAGE", 0.95), (19, 4, 35, "SHA256_SAFE", 0.95), (19, 5, 26, "MD5_USAGE", 0.95),
]


def usage_findings_sql(readable: str = "readable") -> str:
    """The planted sites: a plant ends its file, so its lines are counted from
    the file's last one.  The surrounding prose and the pages hold none."""
    rows = [(p, CP.PLANTS[p][1].count("\n") + 1 - line, col, rid, conf) for p, line, col, rid, conf in USAGE_SITES]
    site = values(rows, ["plant", "back", "col", "rule_id", "confidence"], "st")
    return f"""
SELECT f.repo, r.rule_id, r.description, r.severity, r.category, r.algorithm, r.replacement, r.effort,
       f.path AS file, CAST(len(f.ol) - st.back AS INTEGER) AS line, CAST(st.col AS INTEGER) AS "column",
       {snippet_sql('f.ol[len(f.ol) - st.back]')} AS snippet, 'ast' AS detection_method, st.confidence AS confidence,
       {C.PHASE_USAGE} AS phase, 0 AS rule_ord
FROM (SELECT repo, path, string_split(content, chr(10)) AS ol,
             CAST(regexp_extract(path, '/doc([0-9]+)', 1) AS BIGINT) % {len(CP.PLANTS)} AS plant
      FROM {readable} WHERE regexp_matches(path, '/doc[0-9]+')) f
JOIN {site} ON f.plant = st.plant
JOIN {rules_values('r')} ON st.rule_id = r.rule_id"""


# ------------------------------------------------------------ dependencies

def manifests_sql() -> str:
    rows = [(n, i, b) for n, vs in CP.MANIFEST_VARIANTS.items() for i, b in enumerate(vs)]
    var = values(rows, ["path", "k", "body"], "mv")
    picks = " UNION ALL ".join(
        f"SELECT s_suppkey, s_name, {S(n)} AS path, s_suppkey % {len(v)} AS k FROM supplier"
        for n, v in CP.MANIFEST_VARIANTS.items())
    return (f"SELECT 'supp' || CAST(p.s_suppkey AS VARCHAR) AS repo, p.path, "
            f"replace(mv.body, '%NAME%', p.s_name) AS content "
            f"FROM ({picks}) p JOIN {var} ON p.path = mv.path AND p.k = mv.k")


def _known(rows, alias) -> str:
    return values([tuple(r) for r in rows], ["name", "algorithm", "severity", "category",
                                              "description", "replacement"], alias)


def _rid(prefix: str, name: str) -> str:
    return f"upper({S(prefix)} || regexp_replace({name}, '[^a-zA-Z0-9]', '_', 'g'))"


def _dep_row(phase: int, rule_id: str, snippet: str, src: str) -> str:
    return (f"SELECT repo, {rule_id} AS rule_id, k.description, k.severity, k.category, k.algorithm, "
            f"k.replacement, 'complex' AS effort, path AS file, CAST(NULL AS INTEGER) AS line, "
            f"CAST(NULL AS INTEGER) AS \"column\", {snippet} AS snippet, 'dependency' AS detection_method, "
            f"CAST({C.CONF_DEPENDENCY} AS DOUBLE) AS confidence, {phase} AS phase, CAST(pos AS INTEGER) AS rule_ord "
            f"FROM {src}")


def _trim(x: str) -> str:
    return f"regexp_replace({x}, {S(_TRIM_RE2)}, '', 'g')"


def _esc(name: str) -> str:
    from ..sources.manifests import js_escape
    return js_escape(name)


def npm_sql(files: str = "mfiles") -> str:
    m = (f"map_concat(coalesce(TRY_CAST(json_extract(content, '$.dependencies') AS MAP(VARCHAR, VARCHAR)), MAP {{}}), "
         f"coalesce(TRY_CAST(json_extract(content, '$.devDependencies') AS MAP(VARCHAR, VARCHAR)), MAP {{}}))")
    deps = (f"SELECT repo, path, unnest(map_keys(m)) AS name, unnest(map_values(m)) AS version, 0 AS pos FROM "
            f"(SELECT repo, path, {m} AS m FROM {files} WHERE path = 'package.json' AND json_valid(content))")
    src = f"({deps}) d JOIN {_known(C.NPM_PACKAGES, 'k')} ON d.name = k.name"
    return _dep_row(C.PHASE_NPM, _rid("DEP_", "d.name"), "'\"' || d.name || '\": \"' || d.version || '\"'", src)


def cargo_sql(files: str = "mfiles") -> str:
    parts = []
    for i, (crate, *_r) in enumerate(C.CARGO_CRATES):
        rx = S(r"(?m)^\s*" + _esc(crate) + r"\s*=\s*(.+)")
        parts.append(f"SELECT repo, path, {i} AS pos, {S(crate)} AS name, {_trim(f'regexp_extract(content, {rx}, 1)')} AS rest "
                     f"FROM {files} WHERE path = 'Cargo.toml' AND regexp_matches(content, {rx})")
    lead, kv = S(r'^"([^"]*)"'), S(r'version\s*=\s*"([^"]*)"')
    ver = (f"CASE WHEN regexp_matches(rest, {lead}) THEN regexp_extract(rest, {lead}, 1) "
           f"WHEN regexp_matches(rest, {kv}) THEN regexp_extract(rest, {kv}, 1) ELSE 'unknown' END")
    deps = f"SELECT repo, path, pos, name, {ver} AS version FROM ({' UNION ALL '.join(parts)})"
    src = f"({deps}) d JOIN {_known(C.CARGO_CRATES, 'k')} ON d.name = k.name"
    return _dep_row(C.PHASE_CARGO, _rid("DEP_CRATE_", "d.name"), "d.name || ' = \"' || d.version || '\"'", src)


def go_sql(files: str = "mfiles") -> str:
    parts = []
    for i, (mod, *_r) in enumerate(C.GO_MODULES):
        rx = S(r"(?m)^\s*" + _esc(mod) + r"(?:/\S*)?\s+(v\S+)")
        parts.append(f"SELECT repo, path, {i} AS pos, {S(mod)} AS name, regexp_extract(content, {rx}, 1) AS version "
                     f"FROM {files} WHERE path = 'go.mod' AND regexp_matches(content, {rx})")
    src = f"({' UNION ALL '.join(parts)}) d JOIN {_known(C.GO_MODULES, 'k')} ON d.name = k.name"
    return _dep_row(C.PHASE_GO, _rid("DEP_GO_", "d.name"), "d.name || ' ' || d.version", src)


def pip_sql(files: str = "mfiles") -> str:
    m = S(r"^([a-zA-Z0-9_-]+)\s*(?:[><=!~]+\s*(\S+))?")
    req = (f"SELECT repo, path, pos, lower(regexp_extract(t, {m}, 1)) AS name, "
           f"coalesce(nullif(regexp_extract(t, {m}, 2), ''), 'unknown') AS version FROM ("
           f"SELECT repo, path, pos, {_trim('raw')} AS t FROM (SELECT repo, path, "
           f"unnest(string_split(content, chr(10))) AS raw, generate_subscripts(string_split(content, chr(10)), 1) - 1 AS pos "
           f"FROM {files} WHERE path = 'requirements.txt')) "
           f"WHERE t <> '' AND NOT starts_with(t, '#') AND regexp_matches(t, '^[a-zA-Z0-9_-]+')")
    parts = []
    for i, (pkg, *_r) in enumerate(C.PIP_PACKAGES):
        rx = S(r"(?i)[\"']" + _esc(pkg) + r"\s*(?:[><=!~]+\s*([^\"']+))?[\"']")
        parts.append(f"SELECT repo, path, {i} + 1000000 AS pos, {S(pkg)} AS name, "
                     f"coalesce(nullif({_trim(f'regexp_extract(content, {rx}, 1)')}, ''), 'unknown') AS version "
                     f"FROM {files} WHERE path = 'pyproject.toml' AND regexp_matches(content, {rx})")
    k = _known(C.PIP_PACKAGES, "k")
    req_rows = _dep_row(C.PHASE_PIP, _rid("DEP_PIP_", "d.name"), "d.name || '==' || d.version",
                        f"({req}) d JOIN {k} ON d.name = k.name")
    pyp_rows = _dep_row(C.PHASE_PIP, _rid("DEP_PIP_", "d.name"), "d.name || '>=' || d.version",
                        f"({' UNION ALL '.join(parts)}) d JOIN {k} ON d.name = k.name")
    return (f"SELECT * FROM ({req_rows}) UNION ALL SELECT * FROM ({pyp_rows}) p "
            f"WHERE NOT EXISTS (SELECT 1 FROM ({req_rows}) r WHERE r.repo = p.repo AND r.rule_id = p.rule_id)")


def java_sql(files: str = "mfiles") -> str:
    confs = "|".join(C.GRADLE_CONFIGURATIONS)
    parts = []
    for fi, name in enumerate(["build.gradle", "build.gradle.kts"]):
        for ki, (group, art_rx, *_r) in enumerate(C.JAVA_PACKAGES):
            rx = S(r"(?:" + confs + r")\s*[(\"']+" + _esc(group) + ":(" + art_rx + r"):([^\"')]+)[\"')]")
            parts.append(
                f"SELECT repo, path, {fi * 1_000_000 + ki * 10_000} + j - 1 AS pos, {ki} AS known_ord, "
                f"{S(group)} AS group_id, a[j] AS artifact, v[j] AS version FROM ("
                f"SELECT repo, path, a, v, unnest(range(1, len(a) + 1)) AS j FROM ("
                f"SELECT repo, path, regexp_extract_all(content, {rx}, 1) AS a, regexp_extract_all(content, {rx}, 2) AS v "
                f"FROM {files} WHERE path = {S(name)}))")
    dim = values([(i, g, rx, a, sev, cat, d, r) for i, (g, rx, a, sev, cat, d, r) in enumerate(C.JAVA_PACKAGES)],
                 ["known_ord", "group_id", "artifact_rx", "algorithm", "severity", "category", "description",
                  "replacement"], "k")
    prx = S(r"<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>(?:\s*<version>([^<]+)</version>)?")
    pom = (f"SELECT repo, path, j - 1 AS pos0, {_trim('coalesce(g[j], %s)' % S(''))} AS group_id, "
           f"{_trim('coalesce(a[j], %s)' % S(''))} AS artifact, "
           f"coalesce(nullif({_trim('coalesce(v[j], %s)' % S(''))}, ''), 'unknown') AS version FROM ("
           f"SELECT repo, path, g, a, v, unnest(range(1, len(g) + 1)) AS j FROM ("
           f"SELECT repo, path, regexp_extract_all(content, {prx}, 1) AS g, regexp_extract_all(content, {prx}, 2) AS a, "
           f"regexp_extract_all(content, {prx}, 3) AS v FROM {files} WHERE path = 'pom.xml'))")
    hits = (f"SELECT d.repo, d.path, d.pos, d.group_id, d.artifact, d.version, k.algorithm, k.severity, k.category, "
            f"k.description, k.replacement FROM ({' UNION ALL '.join(parts)}) d JOIN {dim} ON d.known_ord = k.known_ord "
            f"UNION ALL "
            f"SELECT p.repo, p.path, 2000000 + p.pos0 * 100 + k.known_ord, p.group_id, p.artifact, p.version, k.algorithm, "
            f"k.severity, k.category, k.description, k.replacement FROM ({pom}) p JOIN {dim} ON p.group_id = k.group_id "
            f"WHERE regexp_matches(p.artifact, k.artifact_rx)")
    rid = ("upper('DEP_MAVEN_' || regexp_replace(group_id, '[^a-zA-Z0-9]', '_', 'g') || '_' || "
           "regexp_replace(artifact, '[^a-zA-Z0-9]', '_', 'g'))")
    first = (f"SELECT * FROM (SELECT *, {rid} AS rid, row_number() OVER (PARTITION BY repo, {rid} ORDER BY pos) AS rn "
             f"FROM ({hits})) WHERE rn = 1")
    return (f"SELECT repo, rid AS rule_id, description, severity, category, algorithm, replacement, 'complex' AS effort, "
            f"path AS file, CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS \"column\", "
            f"group_id || ':' || artifact || ':' || version AS snippet, 'dependency' AS detection_method, "
            f"CAST({C.CONF_DEPENDENCY} AS DOUBLE) AS confidence, {C.PHASE_JAVA} AS phase, CAST(pos AS INTEGER) AS rule_ord "
            f"FROM ({first})")


# --------------------------------------------------------------- endpoints

def observations_sql() -> str:
    var = values([(i,) + v for i, v in enumerate(CP.OBS_VARIANTS)],
                 ["k", "protocol", "tls_version", "cipher", "has_subject", "asn1_curve", "pubkey_len",
                  "banner"], "ov")
    return (f"SELECT 'net' || CAST(user_id % {CP.N_NET_REPOS} AS VARCHAR) AS repo, "
            f"'host' || CAST(user_id AS VARCHAR) AS host, "
            f"CAST(CASE WHEN protocol = 'ssh' THEN 22 WHEN event_id % 2 = 0 THEN 443 ELSE 8443 END AS INTEGER) AS port, "
            f"protocol, tls_version, cipher, has_subject, asn1_curve, CAST(pubkey_len AS INTEGER) AS pubkey_len, banner "
            f"FROM events JOIN {var} ON events.event_id % {len(CP.OBS_VARIANTS)} = ov.k")


def endpoint_findings_sql(obs: str = "obs") -> str:
    proto = "coalesce(tls_version, 'unknown')"
    vuln = f"({proto} <> 'TLSv1.3')"
    snip = f"CASE WHEN cipher IS NOT NULL THEN {proto} || ' ' || cipher ELSE {proto} END"
    ep = "protocol || '://' || host || ':' || CAST(port AS VARCHAR)"
    n1 = (f"SELECT repo, {ep} AS file, 'NET_TLS_PROTOCOL' AS rule_id, "
          f"{proto} || CASE WHEN {vuln} THEN ' negotiated — key exchange is quantum-vulnerable' "
          f"ELSE ' negotiated — uses ephemeral key exchange' END AS description, "
          f"CASE WHEN {vuln} THEN 'critical' ELSE 'safe' END AS severity, 'protocol' AS category, {proto} AS algorithm, "
          f"CASE WHEN {vuln} THEN {S(C.NET_REPLACEMENT_TLS)} END AS replacement, 'moderate' AS effort, {snip} AS snippet, "
          f"CAST({C.CONF_TLS} AS DOUBLE) AS confidence, 0 AS rule_ord FROM {obs} WHERE protocol = 'tls'")
    is_rsa = "(starts_with(cipher, 'TLS_RSA_') OR regexp_matches(cipher, '^AES[0-9]+-SHA'))"
    is_ecdh = "(regexp_matches(cipher, 'ECDHE|X25519') OR regexp_matches(cipher, '^TLS_.*_WITH_'))"
    n2 = (f"SELECT repo, {ep} AS file, 'NET_TLS_KEX' AS rule_id, "
          f"CASE WHEN {is_rsa} THEN {S(C.NET_KEX_RSA[0])} ELSE {S(C.NET_KEX_ECDH[0])} END, 'critical', 'kem', "
          f"CASE WHEN {is_rsa} THEN 'RSA' ELSE 'ECDH' END, "
          f"CASE WHEN {is_rsa} THEN {S(C.NET_KEX_RSA[1])} ELSE {S(C.NET_KEX_ECDH[1])} END, 'moderate', "
          f"{proto} || ' ' || cipher, CAST({C.CONF_TLS} AS DOUBLE), 1 FROM {obs} "
          f"WHERE protocol = 'tls' AND cipher IS NOT NULL AND ({is_rsa} OR {is_ecdh})")
    has_curve = "(asn1_curve IS NOT NULL AND asn1_curve <> '')"
    alg = (f"CASE WHEN {has_curve} THEN 'ECDSA' WHEN pubkey_len >= 128 THEN 'RSA' "
           f"WHEN pubkey_len <= 65 THEN 'ECDSA' ELSE 'RSA' END")
    bits = (f"CASE WHEN {has_curve} THEN (CASE WHEN asn1_curve IN ('prime256v1', 'P-256') THEN 256 "
            f"WHEN asn1_curve IN ('secp384r1', 'P-384') THEN 384 WHEN asn1_curve IN ('secp521r1', 'P-521') THEN 521 END) "
            f"WHEN pubkey_len >= 128 THEN pubkey_len * 8 WHEN pubkey_len <= 65 THEN NULL ELSE pubkey_len * 8 END")
    n4 = (f"SELECT repo, file, 'NET_TLS_CERT_KEY', 'Certificate uses ' || alg || ' ' || "
          f"coalesce(CAST(bits AS VARCHAR) || '-bit ', '') || 'key — vulnerable to Shor''s algorithm', 'critical', "
          f"'signature', alg, {S(C.NET_CERT_REPLACEMENT)}, 'complex', "
          f"alg || coalesce(' ' || CAST(bits AS VARCHAR) || '-bit', '') || ' key, ' || proto, "
          f"CAST({C.CONF_TLS} AS DOUBLE), 2 FROM (SELECT repo, {ep} AS file, {alg} AS alg, {bits} AS bits, "
          f"{proto} AS proto FROM {obs} WHERE protocol = 'tls' AND has_subject AND pubkey_len IS NOT NULL)")
    first = f"{_trim(chr(39) + chr(39) + ' || split_part(coalesce(banner, ' + chr(39) + chr(39) + '), chr(10), 1)')}"
    n5 = (f"SELECT repo, file, 'NET_SSH_SERVER', {S(C.NET_SSH[0])}, 'high', 'protocol', 'SSH', {S(C.NET_SSH[1])}, "
          f"'moderate', b, CAST({C.CONF_SSH} AS DOUBLE), 0 FROM (SELECT repo, {ep} AS file, {first} AS b FROM {obs} "
          f"WHERE protocol <> 'tls') WHERE starts_with(b, 'SSH-')")
    return (f"SELECT repo, rule_id, description, severity, category, algorithm, replacement, effort, file, "
            f"CAST(NULL AS INTEGER) AS line, CAST(NULL AS INTEGER) AS \"column\", snippet, 'network' AS detection_method, "
            f"confidence, {C.PHASE_NETWORK} AS phase, rule_ord FROM ({n1} UNION ALL {n2} UNION ALL {n4} UNION ALL {n5})")


def endpoint_specs_sql() -> str:
    forms = values([(i, f.split("{u}")[0], f.split("{u}")[1]) for i, f in enumerate(CP.SPEC_FORMS)],
                   ["k", "pre", "post"], "sf")
    specs = (f"SELECT event_id, pre || CAST(user_id AS VARCHAR) || post AS spec FROM events "
             f"JOIN {forms} ON events.event_id % {len(CP.SPEC_FORMS)} = sf.k")
    return f"""
SELECT event_id, spec, host, port, CASE WHEN is_ssh OR (port = 22 AND NOT starts_with(spec, 'tls://'))
       THEN 'ssh' ELSE 'tls' END AS protocol FROM (
  SELECT event_id, spec, is_ssh, split_part(addr, ':', 1) AS host,
         CASE WHEN len(string_split(addr, ':')) < 2 OR string_split(addr, ':')[2] = ''
              THEN CASE WHEN is_ssh THEN 22 ELSE 443 END
              ELSE TRY_CAST(nullif(regexp_extract(string_split(addr, ':')[2], '^\\s*([+-]?[0-9]+)', 1), '') AS INTEGER)
         END AS port
  FROM (SELECT event_id, spec, starts_with(spec, 'ssh://') AS is_ssh,
               CASE WHEN starts_with(spec, 'ssh://') OR starts_with(spec, 'tls://') THEN substr(spec, 7) ELSE spec END AS addr
        FROM ({specs})))"""


# ----------------------------------------------------------------- policies

def policies_values(alias: str = "p") -> str:
    from ..sources.policies import policy_rows
    return values(policy_rows(CP.POLICIES), ["policy_ord", "id", "description", "algorithm", "category",
                                             "severity", "min_confidence", "action", "deadline", "message"], alias)


def violations_sql(findings: str) -> str:
    now = f"TIMESTAMP '{CP.POLICY_NOW}'"
    return f"""
SELECT f.repo, p.id AS policy_id, coalesce(p.description, p.id) AS description, p.action,
       coalesce(p.message, 'Violates policy "' || p.id || '"') AS message, p.deadline, f.rule_id, f.severity,
       f.category, f.algorithm, f.file, f.line, f.confidence, p.policy_ord
FROM (SELECT * FROM {findings} WHERE severity <> 'safe') f, {policies_values('p')}
WHERE (p.deadline IS NULL OR p.deadline = '' OR TRY_CAST(p.deadline AS TIMESTAMP) IS NULL
       OR {now} >= TRY_CAST(p.deadline AS TIMESTAMP))
  AND (p.min_confidence IS NULL OR f.confidence >= p.min_confidence)
  AND (p.algorithm IS NULL OR list_bool_or(list_transform(p.algorithm,
        lambda a: contains(lower(f.algorithm), lower(a)))) IS TRUE)
  AND (p.category IS NULL OR list_contains(p.category, f.category))
  AND (p.severity IS NULL OR list_contains(p.severity, f.severity))"""


def gate_sql(summary: str, violations: str) -> str:
    return f"""
SELECT s.repo, s.critical, s.high, coalesce(b.has_block, FALSE) AS has_block,
       CAST(CASE WHEN coalesce(b.has_block, FALSE) THEN 2 WHEN s.critical + s.high > 0 THEN 1 ELSE 0 END AS BIGINT)
       AS exit_code
FROM {summary} s LEFT JOIN (SELECT repo, bool_or(action = 'block') AS has_block FROM {violations} GROUP BY repo) b
ON s.repo = b.repo"""


# --------------------------------------------------------------------- SBOM

def sbom_components_sql() -> str:
    var = values([(i,) + v for i, v in enumerate(CP.COMPONENT_VARIANTS)],
                 ["k", "v_name", "v_version", "v_purl"], "cv")
    return (f"SELECT 'src' || CAST(p_partkey % {CP.N_SBOM_REPOS} AS VARCHAR) AS sbom_id, "
            f"CAST(p_partkey + {CP.DOC_BASE} AS BIGINT) AS comp_ord, "
            f"CASE WHEN p_partkey % 3 = 2 THEN 'spdx' ELSE 'cyclonedx' END AS format, "
            f"coalesce(v_name, p_name) AS name, coalesce(v_version, CAST(p_size AS VARCHAR)) AS version, "
            f"v_purl AS purl, 'library' AS type "
            f"FROM part JOIN {var} ON part.p_partkey % {len(CP.COMPONENT_VARIANTS)} = cv.k")


SBOM_KEY = "comp_ord AS doc_ord, CAST(0 AS BIGINT) AS pos"  # a planted document holds one component


def sbom_component_rows_sql() -> str:
    return f"SELECT * EXCLUDE (comp_ord), {SBOM_KEY} FROM ({sbom_components_sql()})"


def _purl_match(purl: str, alg: str) -> str:
    p, a = f"lower({purl})", f"lower({alg})"
    return (f"(contains({p}, {a}) OR "
            f"(contains({a}, 'ecdsa') AND (contains({p}, 'ecdsa') OR contains({p}, 'secp256'))) OR "
            f"(contains({a}, 'ed25519') AND contains({p}, 'ed25519')))")


def _ordered(findings: str) -> str:
    """Findings with their O1 order as comparable columns."""
    return (f"SELECT *, {sev_rank()} AS o_sev, fp_phase AS o_phase, fp_rule AS o_rule, fp_line AS o_line, "
            f"fp_col AS o_col FROM {findings}")


_ORD = "o_sev, file, o_phase NULLS FIRST, o_rule NULLS FIRST, o_line NULLS FIRST, o_col NULLS FIRST, rule_id"


def _cdx_assign(findings: str, comps: str) -> str:
    """CTEs up to `fa`: every finding with its target component."""
    rel = "(contains(lower(l), lower(x)) OR contains(lower(x), lower(l)))"
    match = (f"((c.purl IS NOT NULL AND c.purl <> '' AND {_purl_match('c.purl', 'a.algorithm')}) OR "
             f"contains(lower(c.name), lower(a.algorithm)) OR contains(lower(a.algorithm), lower(c.name)))")
    return f"""fo AS ({_ordered(findings)}),
fr AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {_ORD}) AS frank FROM fo),
algos AS (SELECT repo AS sbom_id, algorithm, min(frank) AS first_rank FROM fr GROUP BY repo, algorithm),
cdx AS (SELECT * FROM {comps} WHERE format = 'cyclonedx'),
hit AS (SELECT a.sbom_id, a.algorithm, min(c.comp_ord) AS comp_ord FROM algos a JOIN cdx c
        ON a.sbom_id = c.sbom_id WHERE {match} GROUP BY a.sbom_id, a.algorithm),
tg AS (SELECT a.*, h.comp_ord FROM algos a LEFT JOIN hit h ON a.sbom_id = h.sbom_id AND a.algorithm = h.algorithm),
un AS (SELECT sbom_id, algorithm, row_number() OVER (PARTITION BY sbom_id ORDER BY first_rank) AS rn
       FROM tg WHERE comp_ord IS NULL),
lead AS (
  WITH RECURSIVE r(sbom_id, rn, leaders) AS (
    SELECT sbom_id, rn, [algorithm] FROM un WHERE rn = 1
    UNION ALL
    SELECT r.sbom_id, u.rn, CASE WHEN len(list_filter(r.leaders, lambda l: {rel.replace('x', 'u.algorithm')})) > 0
                                 THEN r.leaders ELSE list_append(r.leaders, u.algorithm) END
    FROM r JOIN un u ON u.sbom_id = r.sbom_id AND u.rn = r.rn + 1)
  SELECT sbom_id, leaders FROM (SELECT *, row_number() OVER (PARTITION BY sbom_id ORDER BY rn DESC) AS k FROM r)
  WHERE k = 1),
ta AS (SELECT t.sbom_id, t.algorithm,
              coalesce(t.comp_ord, -list_position(l.leaders,
                 list_filter(l.leaders, lambda l: {rel.replace('x', 't.algorithm')})[1])) AS target
       FROM tg t LEFT JOIN lead l ON t.sbom_id = l.sbom_id),
fa AS (SELECT f.*, ta.target FROM fr f JOIN ta ON f.repo = ta.sbom_id AND f.algorithm = ta.algorithm)"""


def sbom_cyclonedx_sql(findings: str, comps: str) -> str:
    return f"""
WITH {_cdx_assign(findings, comps)},
per AS (SELECT repo AS sbom_id, target AS comp_ord, CAST(count(*) AS BIGINT) AS n_findings,
               arg_max(algorithm, frank) AS last_algorithm, arg_min(algorithm, frank) AS c_alg,
               arg_min(category, frank) AS c_cat FROM fa GROUP BY repo, target)
SELECT c.sbom_id, c.comp_ord AS doc_ord, CAST(0 AS BIGINT) AS pos, 'original' AS origin, c.name, c.type, c.purl,
       CASE WHEN p.n_findings IS NOT NULL THEN 'algorithm' END AS asset_type, p.last_algorithm AS variant,
       CAST(coalesce(p.n_findings, 0) AS BIGINT) AS n_findings,
       CAST(coalesce(p.n_findings, 0) * 4 AS BIGINT) AS n_added_properties
FROM cdx c LEFT JOIN per p ON c.sbom_id = p.sbom_id AND c.comp_ord = p.comp_ord
UNION ALL
SELECT sbom_id, NULL, -comp_ord, 'new', c_alg, 'crypto-asset', NULL,
       CASE WHEN n_findings > 1 THEN 'algorithm' WHEN c_cat = 'protocol' THEN 'protocol' ELSE 'algorithm' END,
       last_algorithm, n_findings, n_findings * 4
FROM per WHERE comp_ord < 0"""


def sbom_spdx_sql(findings: str, comps: str) -> str:
    return f"""
WITH sp AS (SELECT * FROM {comps} WHERE format = 'spdx'),
algos AS (SELECT DISTINCT repo AS sbom_id, algorithm FROM {findings}),
hit AS (SELECT a.sbom_id, a.algorithm, min(c.comp_ord) AS comp_ord FROM algos a JOIN sp c ON a.sbom_id = c.sbom_id
        WHERE c.purl IS NOT NULL AND {_purl_match('c.purl', 'a.algorithm')} GROUP BY a.sbom_id, a.algorithm),
fa AS (SELECT f.*, h.comp_ord FROM {findings} f LEFT JOIN hit h ON f.repo = h.sbom_id AND f.algorithm = h.algorithm),
per AS (SELECT repo AS sbom_id, comp_ord, CAST(count(*) AS BIGINT) AS n FROM fa WHERE comp_ord IS NOT NULL
        GROUP BY repo, comp_ord)
SELECT s.sbom_id, 'original' AS origin, 'SPDXRef-' || CAST(s.comp_ord - {CP.DOC_BASE} AS VARCHAR) AS spdx_id, s.name,
       coalesce(s.version, '') AS version_info, s.purl, CAST(coalesce(p.n, 0) AS BIGINT) AS n_annotations,
       CAST(NULL AS VARCHAR) AS comment
FROM sp s LEFT JOIN per p ON s.sbom_id = p.sbom_id AND s.comp_ord = p.comp_ord
UNION ALL
SELECT repo, 'new', {S(C.SPDX_ID_PREFIX)} || rule_id || '-' || regexp_replace(file, '[^A-Za-z0-9.]', '-', 'g'),
       'crypto:' || algorithm, '', NULL, 0,
       'Severity: ' || severity || '. Confidence: ' || CAST(confidence AS VARCHAR) || '. Replace with: ' ||
       coalesce(replacement, 'N/A')
FROM fa WHERE comp_ord IS NULL"""


# ----------------------------------------------------------- reports/rollups

_LVL = lambda x: case_map(x, C.SARIF_LEVEL)


def sarif_rules_sql(findings: str) -> str:
    return f"""
SELECT repo, rule_id, algorithm AS short_description, description AS full_description, {_LVL('severity')} AS level,
       CASE WHEN replacement IS NOT NULL AND replacement <> '' THEN 'Replace with: ' || replacement
            ELSE 'No migration needed' END AS help_text
FROM (SELECT *, row_number() OVER (PARTITION BY repo, rule_id ORDER BY {_ORD}) AS rn FROM ({_ordered(findings)}))
WHERE rn = 1"""


def sarif_results_sql(findings: str) -> str:
    return f"""
SELECT repo, rule_id, {_LVL('severity')} AS level,
       algorithm || ': ' || description || CASE WHEN replacement IS NOT NULL AND replacement <> ''
            THEN '. Replace with: ' || replacement ELSE '' END AS message,
       file AS uri, CAST(coalesce(line, 1) AS BIGINT) AS start_line, CAST(coalesce("column", 1) AS BIGINT) AS start_column,
       confidence, effort
FROM {findings} WHERE severity <> 'safe'"""


def _jsnum(x: str) -> str:
    return f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"


def cbom_sql(findings: str) -> str:
    p = C.PROPERTY_PREFIX
    has = "(replacement IS NOT NULL AND replacement <> '')"
    props = (f"concat_ws(';', '{p}severity=' || severity, '{p}confidence=' || {_jsnum('confidence')}, "
             f"'{p}effort=' || effort, '{p}detectionMethod=' || detection_method, "
             f"CASE WHEN {has} THEN '{p}replacement=' || replacement END)")
    return f"""
SELECT repo, 'crypto-' || rule_id || '-' || regexp_replace(file, '[^a-zA-Z0-9]', '-', 'g') || '-' ||
       CAST(coalesce(line, 0) AS VARCHAR) AS bom_ref, 'crypto-asset' AS type, algorithm AS name, description,
       {case_map('category', C.ASSET_TYPE)} AS asset_type, {case_map('category', C.PRIMITIVE)} AS primitive,
       algorithm AS variant, {case_map('category', C.CRYPTO_FUNCTION)} AS crypto_function,
       CAST({case_map('severity', C.CLASSICAL_LEVEL)} AS BIGINT) AS classical_security_level,
       CAST({case_map('severity', C.NIST_QUANTUM_LEVEL)} AS BIGINT) AS nist_quantum_security_level,
       file AS location, CAST(line AS BIGINT) AS line, CAST("column" AS BIGINT) AS "offset", snippet AS symbol,
       CASE WHEN {has} THEN 'Recommended replacement: ' || replacement END AS additional_context,
       {props} AS properties
FROM {findings}"""


def report_rows_sql(findings: str) -> str:
    from ..operators.reports import SEVERITY_ICONS
    loc = "CASE WHEN line IS NOT NULL AND line <> 0 THEN file || ':' || CAST(line AS VARCHAR) ELSE file END"
    occ = ("CASE WHEN coalesce(occurrences, 1) > 1 THEN ' (' || CAST(occurrences AS VARCHAR) || ' occurrences)' "
           "ELSE '' END")
    return f"""
SELECT f.repo, f.severity, CAST({sev_rank('f.severity')} AS BIGINT) AS severity_rank,
       '--- ' || upper(f.severity) || ' (' || CAST(g.group_size AS VARCHAR) || ') ---' AS group_header,
       '[' || {case_map('f.severity', SEVERITY_ICONS)} || '] ' || algorithm || ' — ' || description || {occ} AS label,
       {loc} AS location, snippet, replacement AS fix,
       CAST(CAST(floor(confidence * 100 + 0.5) AS BIGINT) AS VARCHAR) || '%' AS confidence_pct, effort,
       detection_method AS via, coalesce({case_map('category', C.CATEGORY_LABELS)}, category) AS category_label,
       rule_id, file
FROM {findings} f JOIN (SELECT repo, severity, CAST(count(*) AS BIGINT) AS group_size FROM {findings}
                        GROUP BY repo, severity) g ON f.repo = g.repo AND f.severity = g.severity"""


def dashboard_sql(summary: str) -> str:
    cols = ", ".join(f'"{c}"' for c in C.SEVERITIES + C.CATEGORIES)
    return f"""
SELECT repo, {cols}, files_scanned, findings_total, pqc_score,
       CASE WHEN pqc_score >= 80 THEN 'good' WHEN pqc_score >= 50 THEN 'fair' ELSE 'poor' END AS score_band,
       CASE WHEN pqc_ready THEN 'PQC READY' ELSE 'NOT PQC READY' END AS status
FROM {summary}"""


def portfolio_sql(findings: str, discovered: str) -> str:
    return f"""
SELECT coalesce(f.repo, c.repo) AS repo, coalesce(f.files_scanned, 0) AS files_scanned,
       coalesce(c.critical, 0) AS critical, coalesce(c.high, 0) AS high, coalesce(c.safe, 0) AS safe,
       (coalesce(c.critical, 0) + coalesce(c.high, 0) = 0) AS pqc_ready,
       coalesce(c.vulnerable_algorithms, '') AS vulnerable_algorithms
FROM (SELECT repo, CAST(count(DISTINCT path) AS BIGINT) AS files_scanned FROM {discovered} GROUP BY repo) f
FULL OUTER JOIN (
  SELECT repo, CAST(count_if(severity = 'critical') AS BIGINT) AS critical,
         CAST(count_if(severity = 'high') AS BIGINT) AS high, CAST(count_if(severity = 'safe') AS BIGINT) AS safe,
         array_to_string(list_sort(list_distinct(list(algorithm) FILTER (WHERE severity IN ('critical', 'high')))), ', ')
           AS vulnerable_algorithms
  FROM {findings} GROUP BY repo) c ON f.repo = c.repo"""


def rollup_sql(portfolio: str) -> str:
    return f"""
SELECT repo, CAST(sum(files_scanned) AS BIGINT) AS files_scanned, CAST(sum(critical) AS BIGINT) AS critical,
       CAST(sum(high) AS BIGINT) AS high, CAST(sum(safe) AS BIGINT) AS safe,
       CAST(count(*) AS BIGINT) AS repositories, CAST(count_if(NOT pqc_ready) AS BIGINT) AS not_ready,
       CAST(grouping(repo) AS BIGINT) AS is_total
FROM {portfolio} GROUP BY ROLLUP (repo)"""


def density_sql(findings: str, discovered: str) -> str:
    return f"""SELECT * FROM (
WITH per AS (SELECT f.repo, f.files_scanned, coalesce(c.n, 0) AS findings,
                    round(coalesce(c.n, 0) / f.files_scanned, 4) AS density
             FROM (SELECT repo, CAST(count(DISTINCT path) AS BIGINT) AS files_scanned FROM {discovered} GROUP BY repo) f
             LEFT JOIN (SELECT repo, CAST(count(*) AS BIGINT) AS n FROM {findings} GROUP BY repo) c ON f.repo = c.repo)
SELECT repo, files_scanned, findings, density,
       repo = (SELECT repo FROM per ORDER BY density DESC, repo DESC LIMIT 1) AS is_densest
FROM per)"""


def path_groups_sql(findings: str) -> str:
    from ..operators.summary import PATH_GROUP_RE
    g = " ".join(f"WHEN regexp_matches(file, {S(rx)}) THEN {S(n)}" for n, rx in PATH_GROUP_RE)
    return f"""
SELECT repo, path_group, CAST(count(*) AS BIGINT) AS findings,
       CAST(count_if(severity IN ('critical', 'high')) AS BIGINT) AS vulnerable
FROM (SELECT *, CASE {g} ELSE 'core' END AS path_group FROM {findings}) GROUP BY repo, path_group"""


def occurrences_sql(findings: str) -> str:
    return f"""
SELECT repo, algorithm, CAST(sum(coalesce(occurrences, 1)) AS BIGINT) AS occurrences,
       CAST(count(*) AS BIGINT) AS findings FROM {findings} GROUP BY repo, algorithm"""


def user_rules_sql(readable: str = "readable") -> str:
    from ..sources.rules import rule_rows as rr
    rows = rr(CP.USER_RULES)
    rv = values([(r["rule_ord"], r["rule_id"], r["description"], r["severity"], r["category"], r["algorithm"],
                  r["replacement"], r["effort"], r["languages"], r["patterns"]) for r in rows],
                ["rule_ord", "rule_id", "description", "severity", "category", "algorithm", "replacement",
                 "effort", "languages", "patterns"], "ur")
    return f"""
SELECT repo, rule_id, severity, category, algorithm, file, CAST(line AS BIGINT) AS line,
       CAST("column" AS BIGINT) AS "column", snippet, detection_method, confidence, CAST(phase AS BIGINT) AS phase
FROM (
  SELECT h.repo, ur.rule_id, ur.severity, ur.category, ur.algorithm, h.path AS file, h.line_no AS line,
         list_filter(list_transform(ur.patterns, lambda p: CASE WHEN regexp_matches(h.line, '(?i)' || p)
              THEN length(regexp_extract(h.line, '(?i)^(.*?)(?:' || p || ')', 1)) + 1 END), lambda x: x IS NOT NULL)[1]
           AS "column",
         {snippet_sql('h.line')} AS snippet, 'regex' AS detection_method,
         {confidence_sql('h.line', 'h.language', 'ur.severity')} AS confidence, 0 AS phase,
         row_number() OVER (PARTITION BY h.repo, h.path, ur.rule_id, h.line_no ORDER BY ur.rule_ord) AS rn
  FROM (SELECT repo, path, language, unnest(string_split(content, chr(10))) AS line,
               generate_subscripts(string_split(content, chr(10)), 1) AS line_no
        FROM {readable}) h, {rv}
  WHERE (len(ur.languages) = 0 OR h.language IS NULL OR list_contains(ur.languages, h.language))
    AND regexp_matches(h.line, '(?i)' || array_to_string(list_transform(ur.patterns, lambda p: '(?:' || p || ')'), '|')))
WHERE rn = 1"""


def full_raw_sql() -> str:
    """X1 over every branch: code (regex + usage), manifests, endpoints."""
    parts = ["SELECT * FROM raw_regex", "SELECT * FROM raw_usage"]
    for fn in (npm_sql, cargo_sql, go_sql, pip_sql, java_sql):
        parts.append(f"SELECT * FROM ({fn()})")
    parts.append(f"SELECT * FROM ({endpoint_findings_sql('obs')})")
    return " UNION ALL ".join(parts)


def cbom_header_sql(summary: str, timestamp: str) -> str:
    h = f"md5(repo || '|' || {S(timestamp)})"
    serial = (f"'urn:uuid:' || substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) "
              f"|| '-' || substr({h}, 17, 4) || '-' || substr({h}, 21, 12)")
    return (f"SELECT repo, 'CycloneDX' AS bom_format, '1.6' AS spec_version, {serial} AS serial_number, "
            f"CAST(1 AS BIGINT) AS version, {S(timestamp)} AS timestamp, {S(C.TOOL_NAME)} AS tool_name, "
            f"{S(C.TOOL_VERSION)} AS tool_version, repo AS target_name, findings_total AS components FROM {summary}")


def sbom_properties_sql(findings: str, comps: str) -> str:
    """A18 rows for CycloneDX: four name/value pairs per finding; the finding
    that creates a new component adds detectionMethod instead of algorithm."""
    p = C.PROPERTY_PREFIX
    conf = _jsnum("confidence")
    cols = ("repo AS sbom_id, target < 0 AS is_new, CASE WHEN target >= 0 THEN target END AS doc_ord, "
            "CAST(greatest(-target, 0) AS BIGINT) AS pos, file, rule_id")
    return f"""
WITH {_cdx_assign(findings, comps)},
mn AS (SELECT repo, target, min(frank) AS min_rank FROM fa GROUP BY repo, target),
pr AS (SELECT fa.*, (fa.target < 0 AND fa.frank = mn.min_rank) AS creator
       FROM fa JOIN mn ON fa.repo = mn.repo AND fa.target = mn.target)
SELECT {cols}, CAST(0 AS BIGINT) AS prop_idx, '{p}severity' AS name, severity AS value FROM pr
UNION ALL
SELECT {cols}, 1, CASE WHEN creator THEN '{p}confidence' ELSE '{p}algorithm' END,
       CASE WHEN creator THEN {conf} ELSE algorithm END FROM pr
UNION ALL
SELECT {cols}, 2, CASE WHEN creator THEN '{p}detectionMethod' ELSE '{p}confidence' END,
       CASE WHEN creator THEN detection_method ELSE {conf} END FROM pr
UNION ALL
SELECT {cols}, 3, '{p}replacement', coalesce(replacement, 'none') FROM pr"""


def spdx_annotations_sql(findings: str, comps: str) -> str:
    """A18 rows for SPDX: one annotation line per finding attached to a package."""
    tag = C.ANNOTATION_TAG
    return f"""
WITH sp AS (SELECT * FROM {comps} WHERE format = 'spdx'),
algos AS (SELECT DISTINCT repo AS sbom_id, algorithm FROM {findings}),
hit AS (SELECT a.sbom_id, a.algorithm, min(c.comp_ord) AS comp_ord FROM algos a JOIN sp c ON a.sbom_id = c.sbom_id
        WHERE c.purl IS NOT NULL AND {_purl_match('c.purl', 'a.algorithm')} GROUP BY a.sbom_id, a.algorithm)
SELECT f.repo AS sbom_id, h.comp_ord AS doc_ord, CAST(0 AS BIGINT) AS pos, f.file, f.rule_id,
       {S(tag)} || f.severity || ': ' || f.algorithm || ' — ' || f.description || '. Replace with: ' ||
       coalesce(f.replacement, 'N/A') AS annotation
FROM {findings} f JOIN hit h ON f.repo = h.sbom_id AND f.algorithm = h.algorithm"""


def _object(fields: list[tuple[str, str]], raw: tuple = ()) -> str:
    """A JSON object's text without its null fields; `raw` values are JSON already."""
    part = lambda k, v: v if k in raw else f"CAST(to_json({v}) AS VARCHAR)"
    items = ", ".join(f"CASE WHEN ({v}) IS NOT NULL THEN {S(chr(34) + k + chr(34) + ':')} || {part(k, v)} END" for k, v in fields)
    return f"('{{' || array_to_string(list_filter([{items}], lambda x: x IS NOT NULL), ',') || '}}')"


def json_findings_sql(findings: str, timestamp: str) -> str:
    loc = _object([("file", "file"), ("line", "line"), ("column", '"column"'), ("snippet", "snippet")])
    obj = _object([("ruleId", "rule_id")] + [(c, c) for c in ("description", "severity", "category", "algorithm", "replacement", "effort")]
                  + [("location", loc), ("detectionMethod", "detection_method"), ("confidence", "confidence"),
                     ("occurrences", "occurrences")], raw=("location",))
    return f"SELECT repo, {S(timestamp)} AS timestamp, {obj} AS json FROM {findings}"


def json_summary_sql(summary: str, timestamp: str) -> str:
    obj = _object([("filesScanned", "files_scanned"), ("findingsTotal", "findings_total"),
                   ("bySeverity", _object([(x, f'"{x}"') for x in C.SEVERITIES])), ("byCategory", _object([(x, f'"{x}"') for x in C.CATEGORIES])),
                   ("pqcReady", "pqc_ready")], raw=("bySeverity", "byCategory"))
    return f"SELECT repo, {S(timestamp)} AS timestamp, {_object([('target', 'repo'), ('summary', obj)], raw=('summary',))} AS json FROM {summary}"


def violation_labels_sql(violations: str) -> str:
    return f"""
SELECT repo, file, rule_id, '[' || upper(action) || '] ' || policy_id || ': ' || message ||
       CASE WHEN deadline <> '' THEN ' (deadline: ' || deadline || ')' ELSE '' END AS label FROM {violations}"""


# ------------------------------------------------ report order and documents

_AT = ["fp_phase", "fp_rule", "fp_line", "fp_col"]


def ordered_sql(findings: str) -> str:
    order = ", ".join([f"{sev_rank()}", "file", *(f"{c} NULLS FIRST" for c in _AT), "rule_id"])
    return f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {order}) AS position FROM {findings}"


def _documents_sql(fmt: str, fixed: list[str], lists: list[str]) -> str:
    """fixed: the text expressions between the lists, over `summary`; lists:
    (repo, place, fragment) of the list after each but the last of them."""
    rows = [f"SELECT repo, {2 * i} AS section, 1 AS place, {t} AS text FROM summary" for i, t in enumerate(fixed)]
    rows += [f"SELECT repo, {2 * i + 1} AS section, place, text FROM ({q})" for i, q in enumerate(lists)]
    return f"""
SELECT repo, {S(fmt)} AS format, section, position, n_bytes,
       CAST(coalesce(sum(n_bytes) OVER (PARTITION BY repo ORDER BY section, position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", fragment
FROM (SELECT repo, section, position, fragment, CAST(strlen(fragment) AS BIGINT) AS n_bytes FROM (
  SELECT repo, section, position, CASE WHEN section % 2 = 1 AND position > 1 THEN ',' || text ELSE text END AS fragment FROM (
    SELECT *, row_number() OVER (PARTITION BY repo, section ORDER BY place) AS position FROM ({' UNION ALL '.join(rows)}))))"""


_HAS_REPL = "(replacement IS NOT NULL AND replacement <> '')"


def _text_object(x: str) -> str:
    return _object([("text", x)])


def sarif_documents_sql() -> str:
    """Over `ordered` and `summary`."""
    from ..operators.documents import RULE_TAGS, SARIF_SCHEMA
    head = (f'{{"$schema":"{SARIF_SCHEMA}","version":"2.1.0","runs":[{{"tool":{{"driver":{{"name":"{C.TOOL_NAME}","version":"{C.TOOL_VERSION}","rules":[')
    tags = '{"tags":[' + ",".join(f'"{t}"' for t in RULE_TAGS) + "]}"
    rule = _object([("id", "rule_id"), ("shortDescription", _text_object("algorithm")), ("fullDescription", _text_object("description")),
                    ("defaultConfiguration", _object([("level", _LVL("severity"))])),
                    ("help", _text_object(f"CASE WHEN {_HAS_REPL} THEN 'Replace with: ' || replacement ELSE 'No migration needed' END")), ("properties", S(tags))],
                   raw=("shortDescription", "fullDescription", "defaultConfiguration", "help", "properties"))
    message = f"algorithm || ': ' || description || CASE WHEN {_HAS_REPL} THEN '. Replace with: ' || replacement ELSE '' END"
    place = _object([("physicalLocation", _object([("artifactLocation", _object([("uri", "file")])), ("region", _object([
        ("startLine", "coalesce(line, 1)"), ("startColumn", 'coalesce("column", 1)')]))], raw=("artifactLocation", "region")))], raw=("physicalLocation",))
    result = _object([("ruleId", "rule_id"), ("level", _LVL("severity")), ("message", _text_object(message)), ("locations", f"'[' || {place} || ']'"),
                      ("properties", _object([("confidence", "confidence"), ("effort", "effort")]))], raw=("message", "locations", "properties"))
    rules = f"SELECT repo, position AS place, {rule} AS text FROM ordered QUALIFY row_number() OVER (PARTITION BY repo, rule_id ORDER BY position) = 1"
    return _documents_sql("sarif", [S(head), S(']}},"results":['), S("]}]}")], [rules, f"SELECT repo, position AS place, {result} AS text FROM ordered WHERE severity <> 'safe'"])


def cbom_documents_sql(timestamp: str) -> str:
    p, serial = C.PROPERTY_PREFIX, f"(SELECT serial_number FROM ({cbom_header_sql('summary', timestamp)}) h WHERE h.repo = summary.repo)"
    tools = f'{{"components":[{{"type":"application","name":"{C.TOOL_NAME}","version":"{C.TOOL_VERSION}"}}]}}'
    meta = _object([("timestamp", S(timestamp)), ("tools", S(tools)), ("component", _object([("type", "'application'"), ("name", "repo"), ("bom-ref", "'target'")]))], raw=("tools", "component"))
    head = _object([("bomFormat", "'CycloneDX'"), ("specVersion", "'1.6'"), ("serialNumber", serial), ("version", "1"), ("metadata", meta)], raw=("metadata",))
    prop = lambda n, v: _object([("name", S(p + n)), ("value", v)])
    props = ("'[' || " + " || ',' || ".join(prop(n, v) for n, v in [("severity", "severity"), ("confidence", _jsnum("confidence")), ("effort", "effort"), ("detectionMethod", "detection_method")])
             + f" || CASE WHEN {_HAS_REPL} THEN ',' || {prop('replacement', 'replacement')} ELSE '' END || ']'")
    algorithm = _object([("primitive", case_map("category", C.PRIMITIVE)), ("variant", "algorithm"), ("cryptoFunctions", f"'[\"' || {case_map('category', C.CRYPTO_FUNCTION)} || '\"]'")], raw=("cryptoFunctions",))
    crypto = _object([("assetType", case_map("category", C.ASSET_TYPE)), ("algorithmProperties", algorithm), ("classicalSecurityLevel", case_map("severity", C.CLASSICAL_LEVEL)),
                      ("nistQuantumSecurityLevel", case_map("severity", C.NIST_QUANTUM_LEVEL))], raw=("algorithmProperties",))
    seen = _object([("location", "file"), ("line", "line"), ("offset", '"column"'), ("symbol", "snippet"),
                    ("additionalContext", f"CASE WHEN {_HAS_REPL} THEN 'Recommended replacement: ' || replacement END")])
    ref = "'crypto-' || rule_id || '-' || regexp_replace(file, '[^a-zA-Z0-9]', '-', 'g') || '-' || CAST(coalesce(line, 0) AS VARCHAR)"
    component = _object([("type", "'crypto-asset'"), ("bom-ref", ref), ("name", "algorithm"), ("description", "description"), ("cryptoProperties", crypto),
                         ("evidence", f"'{{\"occurrences\":[' || {seen} || ']}}'"), ("properties", props)], raw=("cryptoProperties", "evidence", "properties"))
    opened = f"left({head}, length({head}) - 1) || ',\"components\":['"
    return _documents_sql("cbom", [opened, S("]}")], [f"SELECT repo, position AS place, {component} AS text FROM ordered"])


def json_documents_sql(timestamp: str) -> str:
    """Over `ordered`, `summary` and `violations_ordered` (violations with `place`)."""
    counts = _object([("filesScanned", "files_scanned"), ("findingsTotal", "findings_total"), ("bySeverity", _object([(x, f'"{x}"') for x in C.SEVERITIES])),
                      ("byCategory", _object([(x, f'"{x}"') for x in C.CATEGORIES])), ("pqcReady", "pqc_ready")], raw=("bySeverity", "byCategory"))
    head = _object([("timestamp", S(timestamp)), ("target", "repo"), ("summary", counts)], raw=("summary",))
    loc = _object([("file", "file"), ("line", "line"), ("column", '"column"'), ("snippet", "snippet")])
    finding = _object([("ruleId", "rule_id"), *((c, c) for c in ("description", "severity", "category", "algorithm", "replacement", "effort")), ("location", loc),
                       ("detectionMethod", "detection_method"), ("confidence", "confidence"), ("occurrences", "occurrences")], raw=("location",))
    violation = _object([("policyId", "policy_id"), ("description", "policy_description"), ("action", "action"), ("finding", finding), ("message", "message"), ("deadline", "deadline")], raw=("finding",))
    opened = f"left({head}, length({head}) - 1) || ',\"findings\":['"
    found = f"SELECT repo, position AS place, {finding} AS text FROM ordered"
    against = f"SELECT repo, place, {violation} AS text FROM violations_ordered"
    return _documents_sql("json", [opened, S('],"policyViolations":['), S("]}")], [found, against])


def violations_ordered_sql() -> str:
    """Violations of `ordered` findings with the finding's columns, by finding and policy."""
    rows = violations_sql("ordered").replace("SELECT f.repo, p.id AS policy_id, coalesce(p.description, p.id) AS description, p.action",
                                             "SELECT f.* EXCLUDE (description), f.description AS description, p.id AS policy_id, coalesce(p.description, p.id) AS policy_description, p.action", 1)
    rows = rows.replace("f.rule_id, f.severity,\n       f.category, f.algorithm, f.file, f.line, f.confidence, p.policy_ord", "p.policy_ord", 1)
    return f"SELECT *, row_number() OVER (PARTITION BY repo ORDER BY position, policy_ord) AS place FROM ({rows})"


def sbom_component_members_sql(findings: str, comps: str) -> str:
    """The members of the enriched components, from the findings and the planted documents."""
    first = ", ".join(f"arg_min({c}, frank) AS c_{c}" for c in ("algorithm", "category", "description", "file", "line", "snippet"))
    return f"""
WITH {_cdx_assign(findings, comps)},
per AS (SELECT repo AS sbom_id, target AS comp_ord, count(*) AS n, arg_max(algorithm, frank) AS last_algorithm, {first} FROM fa GROUP BY repo, target)
SELECT c.sbom_id, c.comp_ord AS doc_ord, CAST(0 AS BIGINT) AS pos, 'original' AS origin, c.type, c.name, c.version, c.purl, CASE WHEN p.n IS NOT NULL THEN 'algorithm' END AS asset_type,
       p.last_algorithm AS variant, NULL AS description, NULL AS location, NULL AS line, NULL AS context
FROM cdx c LEFT JOIN per p ON c.sbom_id = p.sbom_id AND c.comp_ord = p.comp_ord
UNION ALL
SELECT sbom_id, NULL, -comp_ord, 'new', 'crypto-asset', c_algorithm, NULL, NULL, CASE WHEN n = 1 AND c_category = 'protocol' THEN 'protocol' ELSE 'algorithm' END,
       last_algorithm, c_description, c_file, CAST(c_line AS VARCHAR), c_snippet
FROM per WHERE comp_ord < 0"""
