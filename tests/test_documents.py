"""O1–O3 running sums, and whole documents written by several tasks."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from qsieve.operators import documents as DOC
from qsieve.operators import order as OR
from qsieve.operators import policy as PL
from qsieve.operators import reports as RP
from qsieve.operators import summary as SM
from qsieve.sinks.documents import write_documents
from qsieve.sources.policies import policies_frame

SCHEMA = ("repo string, rule_id string, description string, severity string, category string, algorithm string, replacement string, effort string, "
          "file string, line int, column int, snippet string, detection_method string, confidence double, phase int, rule_ord int, occurrences long")


def findings(spark, n=3000):
    """Three in four of one repository; ties, nulls, odd characters."""
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a/b c", "é中", ".."]), f"R{r.randrange(9)}", 'a "quoted" \\ text\t', r.choice(["critical", "high", "medium", "low", "safe"]), r.choice(["hash", "kem", "protocol"]),
             r.choice(["MD5", "RSA é"]), r.choice([None, "", "SHA-256"]), "trivial", f"src/f{i % 200}.ts", r.choice([None, i]), i if i > 9 else None, "x = ' 😀\x01'", "regex", r.choice([0.5, 0.85, 1.0]), 2, i % 5, None)
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_sums(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        r = random.Random(1)
        rows = [(r.choice(["hot"] * 8 + ["b", "c", None, "d"]), i, r.randrange(100)) for i in range(5000)]
        out = OR.running(spark.createDataFrame(rows, "g string, i int, n int").repartition(3), "g", ["i"], {"upto": F.col("n"), "rank": F.lit(1)}).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want, seen = {}, {}
    for g, i, n in rows:
        s, k = seen.get(g, (0, 0))
        want[i] = (s, k)
        seen[g] = s + n, k + 1
    assert {x.i: (x.upto, x["rank"]) for x in out} == want
    assert OR.running(spark.createDataFrame([], "g string, i int"), "g", ["i"], {"s": F.lit(1)}).count() == 0


def test_a_hot_group_spreads_over_partitions(spark):
    rows = spark.range(20000).select(F.lit("hot").alias("g"), "id")
    out = OR.running(rows, "g", ["id"], {"rank": F.lit(1)}).withColumn("p", F.spark_partition_id())
    assert out.select("p").distinct().count() > 1 and out.filter("rank <> id").count() == 0


def test_ordered(spark):
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3, "safe": 4}
    low = lambda x: (x is not None, x or 0)
    rows = OR.ordered(findings(spark)).collect()
    for repo in {r.repo for r in rows}:
        mine = sorted((r for r in rows if r.repo == repo), key=lambda r: r.position)
        assert [r.position for r in mine] == list(range(1, len(mine) + 1))
        keys = [(rank[r.severity], r.file.encode(), low(r.phase), low(r.rule_ord), low(r.line), low(r.column), r.rule_id) for r in mine]
        assert keys == sorted(keys)


def read(folder):
    out = {}
    for at, _, files in os.walk(folder):
        for f in files:
            out[f] = json.loads(open(os.path.join(at, f), encoding="utf-8").read())
    return out


def name(repo, ending):
    from urllib.parse import quote
    return f"{quote(repo, safe=' ')}.{ending}"


def test_documents(spark, tmp_path, request):
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    request.addfinalizer(lambda: spark.conf.set("spark.sql.shuffle.partitions", partitions))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    found = findings(spark).cache()
    disc = spark.createDataFrame([("hot", "src/f1.ts"), ("none", "src/x.ts")], "repo string, path string")
    summary = SM.summary(found, disc)
    policies = policies_frame(spark, [{"id": "p1", "action": "block", "severity": ["critical", "high"]}, {"id": "p2", "action": "warn", "description": "all", "message": "m", "deadline": "2020-01-01"}])
    against = PL.evaluate_policies(found, policies, "2026-12-01", keep=[c for c in DOC.FINDING_KEPT if c != "first_pos"])
    parts = [DOC.sarif_fragments(found, summary), DOC.cbom_fragments(found, summary, "2026-12-01"), DOC.json_fragments(found, summary, "2026-12-01", against)]
    told = DOC.document_fragments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    hot = told.filter("repo = 'hot' AND format = 'sarif'").select(F.spark_partition_id()).distinct().count()
    assert hot > 1  # one document's fragments lie in several tasks
    folder = str(tmp_path / "out")
    write_documents(told, folder)
    docs, ordered = read(folder), OR.ordered(found).collect()
    repos = {r.repo for r in ordered} | {"none"}
    assert set(docs) == {name(r, e) for r in repos for e in ("sarif", "cdx.json", "json")} and os.listdir(tmp_path) == ["out"]
    results = {r.repo: [] for r in ordered} | {"none": []}
    for r in RP.sarif_results(found).collect():
        results[r.repo].append((r.rule_id, r.level, r.message, r.uri, r.start_line, r.start_column, r.confidence, r.effort))
    totals = {r.repo: r.findings_total for r in summary.collect()}
    for repo in repos:
        mine = sorted((r for r in ordered if r.repo == repo), key=lambda r: r.position)
        run = docs[name(repo, "sarif")]["runs"][0]
        got = [(x["ruleId"], x["level"], x["message"]["text"], x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], *x["locations"][0]["physicalLocation"]["region"].values(), *x["properties"].values())
               for x in run["results"]]
        assert sorted(got) == sorted(results[repo])
        assert [x["ruleId"] for x in run["results"]] == [r.rule_id for r in mine if r.severity != "safe"]
        assert [x["id"] for x in run["tool"]["driver"]["rules"]] == list(dict.fromkeys(r.rule_id for r in mine))
        cbom = docs[name(repo, "cdx.json")]
        assert cbom["metadata"]["component"] == {"type": "application", "name": repo, "bom-ref": "target"} and cbom["serialNumber"].startswith("urn:uuid:")
        assert [(c["name"], c["cryptoProperties"]["algorithmProperties"]["variant"], c["evidence"]["occurrences"][0]["location"], c["evidence"]["occurrences"][0].get("line"), len(c["properties"])) for c in cbom["components"]] == [
            (r.algorithm, r.algorithm, r.file, r.line, 5 if r.replacement else 4) for r in mine]
        whole = docs[name(repo, "json")]
        assert whole["summary"]["findingsTotal"] == totals[repo] == len(whole["findings"])
        assert [(f["ruleId"], f["location"]["file"], f["location"].get("line"), f["location"]["snippet"]) for f in whole["findings"]] == [(r.rule_id, r.file, r.line, r.snippet) for r in mine]
        want = [(p, r.rule_id, r.file) for r in mine if r.severity != "safe" for p in ("p1", "p2") if p == "p2" or r.severity in ("critical", "high")]
        assert [(v["policyId"], v["finding"]["ruleId"], v["finding"]["location"]["file"]) for v in whole["policyViolations"]] == want
    with pytest.raises(Exception, match="new folder"):
        write_documents(told, folder)


def test_an_aborted_write_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("r", "sarif", 0, "ok"), ("r", "other", 0, "unknown format")], "repo string, format string, offset long, fragment string")
    with pytest.raises(Exception):  # noqa: B017
        write_documents(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path) == []
