"""Sources: tree reading (S1), rule and policy validation."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from qsieve.sources.files import list_tree, read_tree, readable
from qsieve.sources.policies import invalid_policies, policy_rows
from qsieve.sources.rules import rule_rows, rules_frame, validate_rules


@pytest.mark.parametrize("form", ["{}", "{}/", "file://{}"])
def test_read_tree(spark, tmp_path, form):
    """Every name, hidden ones too, under a path or a URI root."""
    names = ["repoA/src/a.ts", "repoA/package.json", "repoA/_app.tsx", "repoA/pkg/__init__.py",
             "repoA/__tests__/x/y.js", "repoB/.ssh/config", "_repoC/_document.js", ".repoD/a b%20.ts"]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode() + b"\xff")
    rows = {(r.repo, r.path): r.content for r in read_tree(spark, form.format(tmp_path)).collect()}
    assert rows == {tuple(n.split("/", 1)): n + "\ufffd" for n in names}
    one = {r.path for r in read_tree(spark, form.format(tmp_path), repo="r").collect()}
    assert one == set(names)


def test_list_tree_deals_out_each_level(spark, tmp_path):
    """One top-level folder: its subfolders are listed by several tasks; an
    empty folder has no rows, a deep path is found, and so are odd names."""
    want = {f"one/d{i}/f{j}.c" for i in range(40) for j in range(3)} | {"one/" + "x/" * 9 + "deep.py", "top.c", "one/d0/ü [a] 'b'.c"}
    for name in want:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    (tmp_path / "one" / "empty").mkdir()
    listed = list_tree(spark, str(tmp_path))
    assert sorted(r.rel for r in listed.collect()) == sorted(want)
    by = listed.where("rel LIKE 'one/d%'").groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert len(by) > 4 and max(r["count"] for r in by) < len(want) / 2
    assert {r.path: r.content for r in read_tree(spark, str(tmp_path), repo="r").collect()} == {n: n for n in want}
    (tmp_path / "none").mkdir()
    assert list_tree(spark, str(tmp_path / "none")).count() == 0


def test_read_tree_unreadable(spark, tmp_path):
    """A listed file that cannot be opened has a null content and yields no findings."""
    for name in ("r/a.ts", "r/b.ts"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files = read_tree(spark, str(tmp_path))
    (tmp_path / "r/b.ts").unlink()
    assert {r.path: r.content for r in files.collect()} == {"a.ts": "x", "b.ts": None}
    assert [r.path for r in readable(files).collect()] == ["a.ts"]


def test_write_tree_round_trip(spark, tmp_path):
    from qsieve.sinks.tree import write_tree
    rows = [("a", "x/é.ts", "one\r\n\u2028"), ("a", ".h/_y", ""), ("b", "z", None)]
    files = spark.createDataFrame(rows, "repo string, path string, content string")
    assert write_tree(files, str(tmp_path)) == 2
    assert sorted(tuple(r) for r in read_tree(spark, str(tmp_path)).collect()) == sorted(rows[:2])
    assert write_tree(files.limit(0), str(tmp_path)) == 0
    with pytest.raises(Exception, match="not a path below"):
        write_tree(spark.createDataFrame([("a", "../up", "x")], files.schema), str(tmp_path))


def test_rule_validation(spark):
    with pytest.raises(ValueError):
        rule_rows([dict(id="X", patterns=[])])
    assert validate_rules(rules_frame(spark)).count() == 0


def test_policy_validation(spark):
    with pytest.raises(ValueError):
        policy_rows([dict(id="p", action="deny")])
    df = spark.createDataFrame([(None, "warn"), ("a", "deny"), ("b", "block")], "id string, action string")
    assert invalid_policies(df).count() == 2


def test_sbom_format_detection(spark):
    from qsieve.sources.sbom import components, undetected_documents
    docs = spark.createDataFrame([
        ("a", 0, '{"bomFormat": "CycloneDX", "components": [{"name": "x"}]}'),
        ("b", 1, '{"spdxVersion": "SPDX-2.3", "packages": [{"name": "y", "externalRefs": '
                 '[{"referenceType": "purl", "referenceLocator": "pkg:npm/y@1"}]}]}'),
        ("c", 2, '{"hello": 1}')], "sbom_id string, doc_ord long, content string")
    got = {(r.sbom_id, r.format, r.name, r.purl, r.type) for r in components(docs.where("sbom_id <> 'c'")).collect()}
    assert got == {("a", "cyclonedx", "x", None, "library"), ("b", "spdx", "y", "pkg:npm/y@1", "library")}
    assert [r.sbom_id for r in undetected_documents(docs).collect()] == ["c"]
    with pytest.raises(Exception):
        components(docs).collect()


def test_language_partitioned_layout(spark, fixture_files):
    """Files written partitioned by language: the usage branch's language
    filter becomes a partition filter (only JS/TS partitions are read)."""
    from pyspark.sql import functions as F
    from qsieve.sources.files import write_files_table
    out = tempfile.mkdtemp(prefix="qsieve-layout-")
    write_files_table(fixture_files, out + "/files")
    parts = sorted(d for d in os.listdir(out + "/files") if d.startswith("lang_part="))
    assert parts == ["lang_part=config", "lang_part=typescript"]
    import re
    from qsieve.operators.usage import usage_findings
    from qsieve.sources.files import discover, readable, with_file_meta
    text = readable(with_file_meta(discover(spark.read.parquet(out + "/files"))))
    hits = usage_findings(text)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*lang_part", plan)
    assert hits.count() == usage_findings(readable(with_file_meta(fixture_files))).count() == 8


def test_user_tables_are_checked(spark):
    """Invalid rows of user tables fail the scan on either plan; Java syntax works on both."""
    from qsieve import catalog as C
    from qsieve.operators import lines as LN
    from qsieve.operators.policy import evaluate_policies
    from qsieve.sources.files import with_file_meta
    text = with_file_meta(spark.createDataFrame([("r", "a.conf", "x ΑΒ rsa\n")], "repo string, path string, content string"))
    rule = dict(id="X", description="d", severity="high", category="kem", algorithm="RSA", replacement=None, effort="e", languages=[])
    table = rules_frame(spark, [dict(rule, patterns=["\\p{Lu}\\p{Lu}", "rsa"])])
    assert [r.column for r in LN.regex_findings_for(text, table).collect()] == [3]
    assert [r.column for r in LN.regex_findings_join(text, table).collect()] == [3]
    empty = table.withColumn("patterns", F.array().cast("array<string>"))
    for plan in (LN.regex_findings_for, LN.regex_findings_join):
        with pytest.raises(Exception, match="Invalid rule"):
            plan(text, empty).collect()
    found = spark.createDataFrame([("r", "X", "high", "kem", "RSA", "a", 1, 0.9)], "repo string, rule_id string, severity string, "
                                  "category string, algorithm string, file string, line int, confidence double")
    schema = "policy_ord int, id string, description string, algorithm array<string>, category array<string>, " \
             "severity array<string>, min_confidence double, action string, deadline string, message string"
    bad = spark.createDataFrame([(0, "p", None, None, None, None, None, "deny", None, None)], schema)
    with pytest.raises(Exception, match="Invalid policy"):
        evaluate_policies(found, bad).collect()
    assert policy_rows([dict(id="p", action="warn", category="", severity="")])[0][4:6] == (None, None)
    assert len(C.MANIFEST_FILES) == 8
