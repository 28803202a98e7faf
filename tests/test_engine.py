"""End-to-end over the files of tests/fixtures (dependencies off); expected
results read off by hand from the files and the rule patterns."""

from collections import Counter

from pyspark.sql import functions as F

from qsieve.operators import findings as FD
from qsieve.operators.lines import oversize_files, regex_findings
from qsieve.plans.scan import scan
from qsieve.sources.files import readable, with_file_meta


def test_summary_matches_expected(fixture_files):
    s = scan(fixture_files).summary.collect()[0]
    assert s.files_scanned == 4 and s.findings_total == 13
    assert (s.critical, s.high, s.medium, s.low, s.safe) == (6, 2, 1, 0, 4)
    assert s.pqc_ready is False and s.pqc_score == 31


def test_rows_and_occurrences_per_file(fixture_files):
    rows = scan(fixture_files).findings.collect()
    assert Counter(r.file for r in rows) == {"ledger.ts": 5, "capsule.ts": 2, "edge.conf": 5, "sbom.json": 1}
    occ = {(r.file, r.rule_id): r.occurrences or 1 for r in rows}
    assert occ[("capsule.ts", "SHA256_SAFE")] == 4 and occ[("capsule.ts", "ML_KEM")] == 2
    assert occ[("ledger.ts", "MD5_USAGE")] == 2 and occ[("ledger.ts", "RSA_KEY_GEN")] == 1


def test_dedupe_invariants(fixture_files):
    """Σ occurrences = rows without de-duplication; keys unique after it."""
    all_rows = scan(fixture_files, dedupe=False).findings
    deduped = scan(fixture_files).findings
    total = deduped.agg(F.sum(F.coalesce("occurrences", F.lit(1)))).first()[0]
    assert total == all_rows.count()
    assert deduped.count() == deduped.select("repo", "rule_id", "file").distinct().count()


def test_severity_and_confidence_filters(fixture_files):
    crit = scan(fixture_files, min_severity="critical").findings
    assert {r.severity for r in crit.collect()} == {"critical"}
    low = scan(fixture_files, min_confidence=0, dedupe=False).findings
    assert low.where("confidence < 0.5").count() > 0
    std = scan(fixture_files, min_confidence=50, dedupe=False).findings
    assert std.where("confidence < 0.5").count() == 0
    assert std.count() < low.count()


def test_replacement_and_location(fixture_files):
    rows = scan(fixture_files).findings.collect()
    for r in rows:
        assert r.file and r.line and r.line > 0
        if r.severity == "critical":
            assert r.replacement
        if r.severity == "safe":
            assert r.replacement is None


def test_usage_beats_regex(fixture_files):
    rows = {(r.file, r.rule_id): r for r in scan(fixture_files).findings.collect()}
    md5 = rows[("ledger.ts", "MD5_USAGE")]
    assert md5.detection_method == "ast" and md5.confidence == 0.95 and md5.line == 5


def test_config_line_hits(spark, fixture_files):
    """Line, rule, column of the first matching pattern, confidence."""
    text = readable(with_file_meta(fixture_files.where("path = 'edge.conf'")))
    got = {(r.line, r.rule_id, r.column, r.confidence) for r in regex_findings(text).collect()}
    assert got == {(2, "TLS_VULNERABLE_PROTOCOL", 1, .7), (3, "SSH_RSA_KEY_TYPE", 19, .7),
                   (4, "SSH_VULNERABLE_KEX", 1, .7), (4, "SHA256_SAFE", 38, .8), (5, "K8S_TLS_SECRET", 1, .7)}


def test_sample_regex_confidences(fixture_files):
    text = readable(with_file_meta(fixture_files.where("path = 'ledger.ts'")))
    got = {(r.line, r.rule_id, r.confidence) for r in regex_findings(text).collect()}
    assert got == {(1, "ED25519_USAGE", .9), (4, "MD5_USAGE", .3), (5, "MD5_USAGE", .85),
                   (11, "RSA_SIGN", .7), (13, "AES_256", .8)}


def test_oversize_guard_regex_only(spark):
    from tests.conftest import files_df
    big = "x" * 1_000_001 + "\nconst h = createHash('md5');\n"
    files = files_df(spark, [("r", "big.js", big)])
    rows = scan(files, min_confidence=0, dedupe=False).findings.collect()
    assert sorted((r.detection_method, r.line) for r in rows) == [("ast", 2), ("regex", 2)]
    rows = scan(files, min_confidence=0, dedupe=False, max_regex_chars=1_000_000).findings.collect()
    assert {r.detection_method for r in rows} == {"ast"}
    assert [r.path for r in oversize_files(files).collect()] == ["big.js"]


def test_filters_before_dedupe(fixture_files):
    """Occurrences count only rows that survive the filters."""
    raw = scan(fixture_files, min_confidence=0, dedupe=False).findings
    f = FD.dedupe(FD.filter_findings(raw.drop("occurrences", "first_pos"), 50))
    assert f.count() == 13
    assert f.agg(F.sum(F.coalesce("occurrences", F.lit(1)))).first()[0] == 21


def test_null_language_confidence(spark):
    """A user include list replaces the defaults: a .txt file has no language,
    so config-only rules apply and confidence is scaled by 0.8 (P3, P9)."""
    from tests.conftest import files_df
    files = files_df(spark, [("r", "notes/a.txt", "ssh-rsa AAAA\nimport md5 from 'md5';\n# MD5 here\n"),
                             ("r", "src/b.ts", "x")])
    r = scan(files, include=[r"\.txt$"], min_confidence=0, dedupe=False)
    got = {(x.line, x.rule_id, x.confidence) for x in r.findings.collect()}
    assert got == {(1, "SSH_RSA_KEY_TYPE", 0.56), (2, "MD5_USAGE", 0.72), (3, "MD5_USAGE", 0.24)}
    assert r.summary.collect()[0].files_scanned == 1


def test_user_rule_table_drives_usage(spark, fixture_files):
    """Usage hits join the loaded rule set — a user table without MD5
    yields no MD5 usage finding; a table keeping it does."""
    from qsieve.sources.rules import rules_frame
    from qsieve import catalog as Cat
    keep = [r for r in Cat.RULES if r["id"] != "MD5_USAGE"]
    ids = {r.rule_id for r in scan(fixture_files, rules=rules_frame(spark, keep)).findings.collect()}
    assert "MD5_USAGE" not in ids and "ED25519_USAGE" in ids
    ids_all = {r.rule_id for r in scan(fixture_files, rules=rules_frame(spark)).findings.collect()}
    assert "MD5_USAGE" in ids_all
