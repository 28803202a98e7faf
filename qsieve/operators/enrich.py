"""SBOM enrichment with findings.

The reference folds findings one by one into the component list.  Matching
depends on the finding's algorithm only, so the fold decomposes into joins:

1. distinct (sbom, algorithm) with first appearance in finding order
   (partial aggregate);
2. ⋈ components on the SBOM id and three characters (an inverted index), then
   the exact test (J14: purl test J16, or name contains / is contained in the
   algorithm; J15: purl only) → first component per algorithm =
   min(doc_ord, pos);
3. algorithms without a component become new components.  CycloneDX: a
   new component is a later match target (name = its algorithm), so the
   distinct unmatched algorithms of one SBOM get leaders (J17) by rounds of
   joins; SPDX: one new package per finding.
4. A18: properties / annotations are emitted one row per (finding, item),
   with the finding's order key, instead of being collected into one array
   per component — a component matched by millions of findings stays a
   stream of rows.  The variant of a component is max_by(algorithm, order).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import catalog as C
from ..functions.scalars import js_number, severity_rank
from ..session import materialize
from .order import running

KEY = ["doc_ord", "pos"]  # document order of a component; of a new one (null, leader index)
# Purls that mean an algorithm beyond containing its name: (part of the algorithm, part of the purl).
PURL_RULES = [("ecdsa", "ecdsa"), ("ecdsa", "secp256"), ("ed25519", "ed25519")]


def finding_order(findings: DataFrame) -> DataFrame:
    """O1 order key of de-duplicated findings (ties broken by rule id)."""
    fp = F.col("first_pos") if "first_pos" in findings.columns else \
        F.struct("phase", "rule_ord", "line", "column")
    return findings.withColumn("ord", F.struct(severity_rank("severity").alias("sev_rank"),
                                               F.col("file"), fp.alias("fp"), F.col("rule_id")))


def _grams(text: Column, q: int) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def containing(hay: DataFrame, needles: DataFrame, key: str = "sbom_id") -> DataFrame:
    """hay(key, hay, …) with needles(key, needle, …): the pairs of one key whose
    hay contains the needle, case aside.

    An inverted index: a hay stands under each of its runs of one, two and three
    characters (and the empty one), a needle under its first three (or all it
    has); they meet in an equi-join, and the pairs that meet are compared."""
    h = hay.where("hay IS NOT NULL").withColumn("low_hay", F.lower("hay"))
    grams = F.array_distinct(F.concat(F.array(F.lit("")), *(_grams(F.col("low_hay"), q) for q in (1, 2, 3))))
    n = needles.where("needle IS NOT NULL").withColumn("low_needle", F.lower("needle")).withColumn("gram", F.substring("low_needle", 1, 3))
    return h.withColumn("gram", F.explode(grams)).join(n, [key, "gram"]).where(F.col("low_hay").contains(F.col("low_needle"))).drop("gram", "low_hay", "low_needle")


def _targets(findings: DataFrame, comps: DataFrame, by_name: bool) -> DataFrame:
    """(sbom_id, algorithm, first_ord, comp|null) for each distinct algorithm;
    comp: the first component whose purl holds the algorithm (J16) or, by_name,
    whose name holds it or is held by it (J14).

    Components are first reduced to their distinct names and purls, each with
    its smallest (doc_ord, pos); a rule of PURL_RULES has one such component
    per SBOM.  Substring matches come from an inverted index, and the minimum
    aggregates partially."""
    algos = (findings.groupBy(F.col("repo").alias("sbom_id"), "algorithm")
             .agg(F.min("ord").alias("first_ord")))
    first = F.min(F.struct(*KEY)).alias("comp")
    names = comps.groupBy("sbom_id", F.col("name").alias("text")).agg(first)
    purls = comps.where(F.col("purl") != "").groupBy("sbom_id", F.col("purl").alias("text")).agg(first)
    sought = algos.select("sbom_id", "algorithm")
    needle = sought.withColumn("needle", F.col("algorithm"))
    hits = [containing(purls.withColumnRenamed("text", "hay"), needle)]
    rule = lambda c, part: F.filter(F.array(*(F.when(F.lower(c).contains(r[part]), F.lit(i)) for i, r in enumerate(PURL_RULES))), lambda x: x.isNotNull())
    per_rule = purls.select("sbom_id", F.explode(rule("text", 1)).alias("rule"), "comp").groupBy("sbom_id", "rule").agg(F.min("comp").alias("comp"))
    hits.append(sought.withColumn("rule", F.explode(rule("algorithm", 0))).join(per_rule, ["sbom_id", "rule"]))
    if by_name:
        hits.append(containing(names.withColumnRenamed("text", "hay"), needle))
        hits.append(containing(sought.withColumn("hay", F.col("algorithm")), names.withColumnRenamed("text", "needle")))
    hit = reduce(DataFrame.unionByName, [x.select("sbom_id", "algorithm", "comp") for x in hits])
    return algos.join(hit.groupBy("sbom_id", "algorithm").agg(F.min("comp").alias("comp")), ["sbom_id", "algorithm"], "left")


def _attach(findings: DataFrame, targets: DataFrame) -> DataFrame:
    """Findings with their algorithm's target.  The targets, one row per SBOM
    and algorithm, are small beside the findings; where their size allows,
    adaptive execution broadcasts them, else it splits skewed partitions."""
    t = targets.withColumnRenamed("sbom_id", "repo")
    return findings.join(t, ["repo", "algorithm"]).withColumn("sbom_id", F.col("repo"))


def _leaders(targets: DataFrame) -> DataFrame:
    """J17 for CycloneDX: (sbom_id, algorithm, leader_idx) of every unmatched
    algorithm.  In order of first appearance an algorithm leads unless an
    earlier leader holds it or is held by it; the others follow the first such
    leader.

    That is the lexicographically first maximal independent set of the graph
    of substring pairs.  Each round, algorithms without an earlier open
    neighbour lead and their later neighbours follow; both leave the graph."""
    node = ["sbom_id", "algorithm"]
    open_ = every = materialize(targets.where(F.col("comp").isNull()).select(*node, F.struct("first_ord", "algorithm").alias("o")))
    pairs = containing(every.withColumnsRenamed({"algorithm": "hay", "o": "o_hay"}), every.withColumnsRenamed({"algorithm": "needle", "o": "o_needle"})).where("hay <> needle")
    swap = F.col("o_hay") < F.col("o_needle")
    edges = materialize(pairs.select("sbom_id", F.when(swap, F.col("hay")).otherwise(F.col("needle")).alias("early"), F.when(swap, F.col("needle")).otherwise(F.col("hay")).alias("algorithm")).distinct())
    leaders, left = [], edges
    while not open_.isEmpty():
        lead = materialize(open_.join(left, node, "left_anti"))
        leaders.append(lead)
        follow = left.join(lead.select("sbom_id", F.col("algorithm").alias("early")), ["sbom_id", "early"], "left_semi").select(*node)
        open_ = materialize(open_.join(lead, node, "left_anti").join(follow, node, "left_anti"))
        still = open_.select(*node)
        left = materialize(left.join(still, node, "left_semi").join(still.withColumnRenamed("algorithm", "early"), ["sbom_id", "early"], "left_semi"))
    lead = reduce(DataFrame.unionByName, leaders) if leaders else every
    placed = running(lead, "sbom_id", ["o"], {"n": F.lit(1)}).select("sbom_id", F.col("algorithm").alias("early"), (F.col("n") + 1).alias("idx"))
    own = placed.select("sbom_id", F.col("early").alias("algorithm"), "idx")
    both = own.unionByName(edges.join(placed, ["sbom_id", "early"]).select("sbom_id", "algorithm", "idx"))
    return both.groupBy(*node).agg(F.min("idx").cast("int").alias("leader_idx"))


def assign_cyclonedx(components: DataFrame, findings: DataFrame) -> DataFrame:
    """Each finding with its target component: `is_new` false and (doc_ord,
    pos) of an original component, or `is_new` and (null, leader index)."""
    f = finding_order(findings)
    t = materialize(_targets(f, components.where(F.col("format") == "cyclonedx"), by_name=True))
    t = (t.join(_leaders(t), ["sbom_id", "algorithm"], "left")
         .select("sbom_id", "algorithm", F.col("comp").isNull().alias("is_new"), F.col("comp.doc_ord").alias("doc_ord"),
                 F.coalesce("comp.pos", F.col("leader_idx").cast("long")).alias("pos")))
    return _attach(f, t)


def enrich_cyclonedx(components: DataFrame, findings: DataFrame) -> DataFrame:
    """K6 components: originals (matched or not) and appended crypto assets,
    with the number of attached findings, the crypto variant and `component`,
    the component as JSON: the original kept, cryptoProperties set where it
    has findings; its added properties are rows of `cyclonedx_properties`."""
    a = assign_cyclonedx(components, findings)
    per = a.groupBy("sbom_id", "is_new", *KEY).agg(
        F.count(F.lit(1)).cast("long").alias("n_findings"),
        F.max_by("algorithm", "ord").alias("last_algorithm"),
        F.min_by(F.struct("algorithm", "category", "description", "file", "line", "snippet"),
                 F.col("ord")).alias("creator"))
    orig = (components.where(F.col("format") == "cyclonedx")
            .join(per.where(~F.col("is_new")), ["sbom_id"] + KEY, "left")
            .select("sbom_id", *KEY, F.lit("original").alias("origin"), "name", "type", "purl",
                    F.when(F.col("n_findings").isNotNull(), F.lit("algorithm")).alias("asset_type"),
                    F.col("last_algorithm").alias("variant"),
                    F.coalesce("n_findings", F.lit(0)).cast("long").alias("n_findings"),
                    (F.coalesce("n_findings", F.lit(0)) * 4).cast("long").alias("n_added_properties"),
                    _with_crypto(F.col("original"), F.col("last_algorithm")).alias("component")))
    kind = (F.when((F.col("n_findings") == 1) & (F.col("creator.category") == "protocol"), F.lit("protocol"))
            .otherwise(F.lit("algorithm")))
    new = (per.where("is_new")
           .select("sbom_id", *KEY, F.lit("new").alias("origin"),
                   F.col("creator.algorithm").alias("name"), F.lit("crypto-asset").alias("type"),
                   F.lit(None).cast("string").alias("purl"),
                   kind.alias("asset_type"), F.col("last_algorithm").alias("variant"), "n_findings",
                   (F.col("n_findings") * 4).alias("n_added_properties"),
                   F.to_json(F.struct(
                       F.lit("crypto-asset").alias("type"), F.col("creator.algorithm").alias("name"),
                       F.col("creator.description").alias("description"),
                       _crypto(kind, F.col("last_algorithm")).alias("cryptoProperties"),
                       F.struct(F.array(F.struct(F.col("creator.file").alias("location"), F.col("creator.line").alias("line"),
                                                 F.col("creator.snippet").alias("additionalContext")))
                                .alias("occurrences")).alias("evidence"))).alias("component")))
    return orig.unionByName(new)


def _crypto(kind: Column, algorithm: Column) -> Column:
    return F.struct(kind.alias("assetType"), F.struct(algorithm.alias("variant")).alias("algorithmProperties"))


def _with_crypto(original: Column, algorithm: Column) -> Column:
    """The original JSON object with a top-level cryptoProperties member (in place
    of one it has already), kept as it is where no finding matched."""
    members = F.try_parse_json(original).cast("map<string,variant>")
    others = F.to_json(F.map_filter(members, lambda k, _: k != "cryptoProperties"))
    has = F.array_contains(F.json_object_keys(original), "cryptoProperties")
    original = F.when(algorithm.isNotNull() & has, F.coalesce(others, original)).otherwise(original)
    crypto = F.to_json(_crypto(F.lit("algorithm"), algorithm))
    body = F.regexp_replace(original, r"\}\s*$", "")
    comma = F.when(body.rlike(r"^\s*\{\s*$"), F.lit("")).otherwise(F.lit(","))
    return F.when(algorithm.isNull(), original).otherwise(
        F.concat(body, comma, F.lit('"cryptoProperties":'), crypto, F.lit("}")))


def cyclonedx_properties(components: DataFrame, findings: DataFrame) -> DataFrame:
    """A18 as rows: the name/value pairs each finding adds to its component
    (a creator finding adds severity/confidence/detectionMethod/replacement,
    a matching finding severity/algorithm/confidence/replacement)."""
    a = assign_cyclonedx(components, findings)
    first = a.where("is_new").groupBy("sbom_id", "pos").agg(F.min("ord").alias("min_ord")).withColumn("is_new", F.lit(True))
    a = a.join(first, ["sbom_id", "is_new", "pos"], "left")
    creator = F.coalesce(F.col("ord") == F.col("min_ord"), F.lit(False))
    p = C.PROPERTY_PREFIX
    conf = js_number(F.col("confidence"))
    repl = F.coalesce("replacement", F.lit("none"))
    pairs = F.when(creator, F.array(
        F.struct(F.lit(p + "severity").alias("name"), F.col("severity").alias("value")),
        F.struct(F.lit(p + "confidence").alias("name"), conf.alias("value")),
        F.struct(F.lit(p + "detectionMethod").alias("name"), F.col("detection_method").alias("value")),
        F.struct(F.lit(p + "replacement").alias("name"), repl.alias("value")))).otherwise(F.array(
            F.struct(F.lit(p + "severity").alias("name"), F.col("severity").alias("value")),
            F.struct(F.lit(p + "algorithm").alias("name"), F.col("algorithm").alias("value")),
            F.struct(F.lit(p + "confidence").alias("name"), conf.alias("value")),
            F.struct(F.lit(p + "replacement").alias("name"), repl.alias("value"))))
    return (a.select("sbom_id", "is_new", *KEY, "file", "rule_id", F.posexplode(pairs).alias("prop_idx", "p"))
            .select("sbom_id", "is_new", *KEY, "file", "rule_id", "prop_idx", "p.name", "p.value"))


def enrich_spdx(components: DataFrame, findings: DataFrame) -> DataFrame:
    """K7: SPDX packages — originals with the number of annotations added,
    plus one new package per unmatched finding (id from rule and file)."""
    spdx = components.where(F.col("format") == "spdx")
    f = finding_order(findings)
    a = _attach(f, _targets(f, spdx, by_name=False))
    per = a.where(F.col("comp").isNotNull()).groupBy("sbom_id", "comp.doc_ord", "comp.pos") \
        .agg(F.count(F.lit(1)).cast("long").alias("n_annotations"))
    orig = (spdx.join(per, ["sbom_id"] + KEY, "left")
            .select("sbom_id", F.lit("original").alias("origin"),
                    F.get_json_object("original", "$.SPDXID").alias("spdx_id"),
                    "name", F.coalesce("version", F.lit("")).alias("version_info"), "purl",
                    F.coalesce("n_annotations", F.lit(0)).cast("long").alias("n_annotations"),
                    F.lit(None).cast("string").alias("comment")))
    new = (a.where(F.col("comp").isNull())
           .select("sbom_id", F.lit("new").alias("origin"),
                   F.concat(F.lit(C.SPDX_ID_PREFIX), F.col("rule_id"), F.lit("-"),
                            F.regexp_replace("file", "[^A-Za-z0-9.]", "-")).alias("spdx_id"),
                   F.concat(F.lit("crypto:"), F.col("algorithm")).alias("name"),
                   F.lit("").alias("version_info"), F.lit(None).cast("string").alias("purl"),
                   F.lit(0).cast("long").alias("n_annotations"),
                   F.concat(F.lit("Severity: "), F.col("severity"), F.lit(". Confidence: "),
                            js_number(F.col("confidence")), F.lit(". Replace with: "),
                            F.coalesce("replacement", F.lit("N/A"))).alias("comment")))
    return orig.unionByName(new)


def spdx_annotations(components: DataFrame, findings: DataFrame) -> DataFrame:
    """A18 for SPDX as rows: one annotation line per matched finding."""
    spdx = components.where(F.col("format") == "spdx")
    f = finding_order(findings)
    a = _attach(f, _targets(f, spdx, by_name=False).where(F.col("comp").isNotNull()))
    text = F.concat(F.lit(C.ANNOTATION_TAG), F.col("severity"), F.lit(": "), F.col("algorithm"),
                    F.lit(" — "), F.col("description"), F.lit(". Replace with: "),
                    F.coalesce("replacement", F.lit("N/A")))
    return a.select("sbom_id", "comp.doc_ord", "comp.pos", "file", "rule_id", text.alias("annotation"))
