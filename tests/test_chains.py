"""J1 for many user rules: patterns that are chains of literals, against plain regular expressions."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from qsieve.functions.chains import Chains, chain_of
from qsieve.operators import lines as LN
from qsieve.plans import corpus as CP
from qsieve.sources.files import with_file_meta
from qsieve.sources.rules import RULE_SCHEMA

from .conftest import files_df

TABLE = pa.schema([("rn", pa.int32()), ("rule_id", pa.string()), ("languages", pa.list_(pa.string())), ("place", pa.int32()), ("joint", pa.string()),
                   ("repeated", pa.string()), ("heads", pa.list_(pa.string())), ("tails", pa.list_(pa.string()))])


@pytest.mark.parametrize("pattern,want", [
    ("MD5", ("", None, ["md5"], [])), ("sha-?1", ("", None, ["sha-1", "sha1"], [])), ("(?:the|word)[.,;]", ("", None, ["the,", "the.", "the;", "word,", "word.", "word;"], [])),
    ("(?:the)+ .*word", ("g0", "the", ["the "], ["word"])), ("foo.+?bar", ("g1", None, ["foo"], ["bar"])), ("(?:abc)+", ("", None, ["abc"], [])), ("abc[a-z]*", ("", None, ["abc"], [])),
    ("abc[a-z]+", None), ("foo[a-z]*bar", None), ("foo[a-z]*[0-9]*bar", None), ("foo.*bar.*baz", None), ("(?:abc)+.*xyz", None), ("(?:aba)+a", None), ("a+bcd", None), ("ab", None),
    ("^abc", None), ("abc$", None), (r"abc\b", None), ("x{3}", None), ("(?s)abc.*def", None), (r"abc\vdef", None), (r"abc[\v]+def", None), ("(?=abc)abc", None), ("éabc", None), ("abc++def", None), ("(abc", None), ("x?", None), ("", None)])
def test_chain_of(pattern, want):
    assert chain_of(pattern) == want


def found(rules, lines, languages, most_bytes, pieces):
    """(line, rule, column) of `Chains`, block by block."""
    rows = [dict(rn=n, rule_id=i, languages=of, place=k, **dict(zip(("joint", "repeated", "heads", "tails"), chain_of(p)))) for n, (i, of, ps) in enumerate(rules) for k, p in enumerate(ps)]
    finder = Chains(pa.Table.from_pylist(rows, schema=TABLE))
    if finder.gaps:
        finder.pieces = min(pieces, finder.pieces)
    place = {x: i for i, x in enumerate(finder.languages)} | {None: len(finder.languages) + 1}
    codes, text, out, line0 = np.array([place.get(x, len(finder.languages)) for x in languages]), "\n".join(lines).encode(), [], 0
    for a, b in finder.blocks_of(text, most_bytes):
        n = text[a:b].count(b"\n") + 1
        line, rn, column = finder.matches(text[a:b], codes[line0:line0 + n])
        out += zip((line + line0).tolist(), rn.tolist(), column.tolist())
        line0 += n
    assert line0 == len(lines)
    return sorted(out)


def brute(rules, lines, languages):
    out = []
    for i, (text, language) in enumerate(zip(lines, languages)):
        seen = set()
        for n, (id_, of, patterns) in enumerate(rules):
            if id_ in seen or of and language is not None and language not in of:
                continue
            for p in patterns:
                m = re.search(p.replace(".*", "[^\n\r\x85\u2028\u2029]*").replace(".+", "[^\n\r\x85\u2028\u2029]+"), text, re.I | re.A)
                if m:
                    seen.add(id_)
                    out.append((i, n, len(text[:m.start()].encode("utf-16-le")) // 2 + 1))
                    break
    return sorted(out)


def test_chains_against_patterns():
    """Rules that begin alike, repeat, share ids and languages, over lines of few letters; blocks and tables of any size."""
    forms = [r"{}\s+{}", r"(?:{}|{})[.,;]", r"{}[a-z]*\W+{}", r"(?:{})+ .*{}", r"(?:{})+\s+{}", r"{}.+{}", r"{}.*{}", r"{}|{}", r"{}x?{}", r"(?:{})+[.;]\W*{}", r"{}[^a]+{}", r"(?:{})+,.*{}",
             r"{}[\s,]+[x-z]*[0-9]*{}", r"{}x+{}", r"{}[^\s]*\s{}", r"(?:{})+[x-z]*\d*"]
    gaps = [" ", "  ", ".", ", ", ";", "x", "\t", "\r", "\x85", "\u2028", "é", "😀 ", " 1", "", "", " A", "7", "\x0b", "\x0c", "\ufeff", "-\x00"]
    pairs = 0
    for seed in range(400):
        r = random.Random(seed)
        words = ["".join(r.choice("aab") for _ in range(r.randrange(3, 6))) for _ in range(r.choice([4, 30]))]
        word = lambda: r.choice(words).upper() if r.random() < .2 else r.choice(words)
        rules = [(f"R{r.randrange(12)}", r.choice([None, [], ["js"], ["py", "js"], [None]]) if seed % 2 else None, [f.format(word(), word()) for f in r.choices(forms, k=r.randrange(1, 3))]) for _ in range(r.choice([1, 5, 60]))]
        rules = sorted((x for x in rules if all(map(chain_of, x[2]))), key=lambda x: x[0])
        lines = ["".join(word() + r.choice(gaps) for _ in range(r.randrange(9))) for _ in range(r.choice([1, 3, 40]))]
        languages = [r.choice(["js", "py", "go", None]) for _ in lines]
        if rules:
            got = found(rules, lines, languages, r.choice([5, 100, 1 << 18]), r.choice([2, 1 << 20]))
            assert got == brute(rules, lines, languages), seed
            pairs += len(got)
    assert pairs > 5000


def rule(ord_, id_, *patterns, languages=(), severity="low"):
    return (ord_, id_, "d", severity, "hash", id_, None, "trivial", list(languages), list(patterns))


def findings(spark, rules, files, **how):
    text = with_file_meta(files_df(spark, files)).where("content is not null")
    return LN.regex_findings_join(text, spark.createDataFrame(rules, RULE_SCHEMA).repartition(3), **how)


@pytest.mark.parametrize("chars,joints", [(3 << 20, 64), (5, 64), (3 << 20, 1)])
def test_chained_and_other_rules(spark, monkeypatch, chars, joints):
    """One or many parts, rules left to the index, files that share a path, unknown repository and language: the rows of the compiled form."""
    monkeypatch.setattr(LN, "MAX_CHAIN_CHARS", chars)
    monkeypatch.setattr(LN, "MAX_JOINTS", joints)
    rules = [rule(5, "A", r"md5\s+hash"), rule(3, "A", "(?:hash)+ .*md5", "hash"), rule(9, "B", "sha1|sha-1", severity="safe"), rule(2, "C", r"hash\b"), rule(1, "C", "md5"), rule(4, "D", r"md5[a-z]*\W+sha", languages=["python"]),
             rule(7, "D", "md5.*sha"), rule(8, "E", "😀md5"), rule(6, "F", "ſha1")]
    files = [("r", "a.py", "md5 hash\n// 😀hashhash md5 \r\n\nimport md5x (sha1) sha-1"), ("r", "a.py", "hash md5\nmd5 hash hash"), (None, "b.js", "MD5('Sha1')"), (None, "b.js", "x\n\u2028md5 \x85 sha1"), (None, "c", "hashhashhash md5 sha")]
    text = with_file_meta(files_df(spark, files))
    as_dicts = [dict(id=x[1], rule_ord=x[0], description="d", severity=x[3], category="hash", algorithm=x[1], replacement=None, effort="trivial", languages=x[8], patterns=x[9]) for x in rules]
    got = findings(spark, rules, files)
    want = LN.regex_findings(text, as_dicts)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() > 12


def test_equal_ordinals_go_to_the_index(spark):
    """Of rules that agree in id and ordinal the leftmost match counts: not told by the order of rules."""
    got = findings(spark, [rule(1, "A", "bcd"), rule(1, "A", "abc")], [("r", "a", "xabcd")]).collect()
    assert [(x.rule_ord, x.column) for x in got] == [(1, 2)]


def test_chained_rules_test_no_pattern_and_shuffle_nothing(spark):
    """The registered query's rules: their matches are told where the files are read."""
    sf = "/root/testdata/sf0.001"
    text = with_file_meta(files_df(spark, [("r", "a.js", "the word")]))
    plan = LN.regex_findings_join(text, CP.document_rules(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "rx" not in plan and "Generate explode(hits" in plan and not re.search(r"(?<!Broadcast)Exchange", plan)
