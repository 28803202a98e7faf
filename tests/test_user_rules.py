"""User rule tables of any size, compiled or indexed, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from qsieve import catalog as C
from qsieve.functions.literals import key_gram, required_literals
from qsieve.operators import lines as LN
from qsieve.plans import corpus as CP
from qsieve.plans.queries import QUERIES
from qsieve.sources.files import with_file_meta
from qsieve.sources.rules import RULE_SCHEMA

from .conftest import files_df

COLS = ["repo", "rule_id", "file", "line", "column", "snippet", "confidence", "rule_ord"]


def rule(ord_, id_, patterns, languages=(), severity="low"):
    return (ord_, id_, "d", severity, "hash", id_, None, "trivial", list(languages), list(patterns))


RULES = [rule(10, "A", ["md5", r"sha-?1\b"]), rule(30, "B", [r"\d+"], ["python"]), rule(30000, "A", [r"MD5\s*\("]), rule(7, "C", ["(?:hmac|cmac)[a-z]*"]), rule(8, "D", ["x?"]), rule(9, "E", [r"^\s*import\b"], ["javascript"]),
         rule(11, "F", ["[[:alpha:]]x", "zz"]), rule(12, "G", ["(abc)+d", "e{2,}f"])]
FILES = [("r", "a.js", "import md5 from 'md5'\nMD5 (x) sha1 HMACabc\n\nabcabcd eef"), ("r", "b.py", "hash = md5(x) # 5\r\nşha1 MD5 (\n"), ("r", "c", "CMAC sha-1 zzz\n" + "q" * 5000 + "md5"), ("s", "d.js", None), ("s", "e.js", "")]


def brute(rules, files):
    out = {}
    for repo, path, content in files:
        lang = {"js": "javascript", "py": "python"}.get(path.rpartition(".")[2] if "." in path else None)
        for no, text in enumerate((content or "").split("\n") if content is not None else [], 1):
            for ord_, id_, *_, languages, patterns in sorted(rules):
                at = [m.start() + 1 for m in (re.search(p, text, re.I | re.A) for p in patterns) if m]
                if at and (not languages or lang is None or lang in languages):
                    out.setdefault((repo, path, id_, no), (ord_, at[0]))
    return {(*k, *v) for k, v in out.items()}


@pytest.mark.parametrize("compiled,keys,plain", [(200, 200_000, 5000), (0, 200_000, 5000), (0, 3, 1)])
def test_both_forms(spark, monkeypatch, compiled, keys, plain):
    """Above and below every threshold: the same rows, the table's own ordinals."""
    for name, v in (("MAX_COMPILED_RULES", compiled), ("MAX_BROADCAST_KEYS", keys), ("MAX_BROADCAST_RULES", plain)):
        monkeypatch.setattr(LN, name, v)
    rules = [r for r in RULES if r[1] != "F"]  # the class in F is read otherwise by Python
    text = with_file_meta(files_df(spark, FILES)).where("content is not null")
    got = LN.regex_findings_for(text, spark.createDataFrame(rules, RULE_SCHEMA).repartition(3)).collect()
    assert {(r.repo, r.file, r.rule_id, r.line, r.rule_ord, r.column) for r in got} == brute(rules, FILES) and len(got) == len(brute(rules, FILES))


def test_many_rules(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 6)))
    forms = ["{}", r"\b{}\s*{}", "(?:{}|{})x", "{}+.?{}", "[{}]{}", "{}|{}", "{}?{}"]
    words = [word() for _ in range(300)]
    rules = [rule(i * 7, f"R{i % 900}", [f.format(r.choice(words), r.choice(words)) for f in r.sample(forms, r.randrange(1, 3))]) for i in range(1200)]
    files = [("r", f"f{i}.js", "\n".join(" ".join(r.choice(words) + r.choice(["", "x", " "]) for _ in range(9)) for _ in range(6))) for i in range(12)]
    text = with_file_meta(files_df(spark, files))
    got = LN.regex_findings_for(text, spark.createDataFrame(rules, RULE_SCHEMA)).collect()
    assert {(x.repo, x.file, x.rule_id, x.line, x.rule_ord, x.column) for x in got} == brute(rules, files) and len(got) == len(brute(rules, files)) > 500


@pytest.mark.parametrize("bad", [rule(None, "A", ["x"]), rule(1, None, ["x"]), rule(1, "A", [])])
def test_invalid_rules_fail(spark, monkeypatch, bad):
    schema = RULE_SCHEMA.__class__([f.__class__(f.name, f.dataType, True) for f in RULE_SCHEMA.fields])
    text = with_file_meta(files_df(spark, FILES))
    for most in (0, 200):
        monkeypatch.setattr(LN, "MAX_COMPILED_RULES", most)
        with pytest.raises(Exception, match="Invalid rule"):
            LN.regex_findings_for(text, spark.createDataFrame([bad], schema)).collect()


@pytest.mark.parametrize("patterns,want", [
    (["md5"], {"md5"}), (["SHA-?256"], {"sha"}), ([r"\bfoo\s*\("], {"foo"}), (["ab"], None), (["(?:abc|defg)x"], {"abc", "defg"}), (["(?:abc|d)x"], None), (["abc", "x"], None),
    (["(?:hello)+ ?worlds"], {"worlds"}), (["(hello)?"], None), (["(hello)*world"], {"world"}), ([r"a\d+bcd"], {"bcd"}), (["[a[b]]cde"], None), ([r"\Qabc\E"], None), ([r"(abc)\1"], None),
    ([r"abcd\vdef"], {"abcd"}), (["(?=xyz)abc"], {"abc"}), (["(?!xyz)abc"], {"abc"}), (["é" * 5], None), (["a" * 50], {"a" * 32}), (["(unclosed"], None), ([r"\p{Lu}abc"], None), (["[]abc]defg"], None)])
def test_required_literals(patterns, want):
    assert required_literals(patterns) == (None if want is None else frozenset(want))


def test_catalogue_literals_are_required():
    """Wherever a catalogue pattern matches a planted line, the line holds one of its literals."""
    texts = [line for _, body in CP.PLANTS for line in body.split("\n")] + [p for r in C.RULES for p in r["patterns"]]
    known = 0
    for r in C.RULES:
        for p in r["patterns"]:
            need = required_literals([p])
            known += need is not None
            for line in texts:
                if need and re.search(p, line, re.I | re.A):
                    assert any(x in line.lower() for x in need), (p, line)
    assert known > 100 and key_gram("the sqz") == "sqz"


def test_rules_of_documents(spark):
    """The registered query on the smallest tables, against plain loops over a share of the files."""
    sf = "/root/testdata/sf0.001"
    rules = [tuple(r) for r in CP.document_rules(spark, sf).collect()]
    assert len(rules) > 100
    got = {(r.repo, r.file, r.rule_id, r.line, r.rule_ord, r.column) for r in QUERIES["user_rules_indexed"](spark, sf).collect()}
    files = [(r.repo, r.path, r.content) for r in with_file_meta(CP.corpus_files(spark, sf)).where(F.col("path").rlike("/doc[0-9]*7[.]")).collect()]
    want = brute(rules, files)
    assert {g for g in got if re.search("/doc[0-9]*7[.]", g[1])} == want and len(want) > 20
