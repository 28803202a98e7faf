"""The scan does less work a token and a hit, and finds the same."""

import random
import re

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import functions as F

from qsieve.operators import lines as LN
from qsieve.operators import usage as US
from qsieve.plans import corpus as CP
from qsieve.sources.files import with_file_meta

from .conftest import files_df
from .test_long_texts import LINES, text, tokens_of


def test_words_between_marks_have_few_tokens():
    for junk in ("the&&& anre$$$ 12 %%% ", "Aa, bb; cc. Dd - ee | ", "été où &&& дом ", "A!! B!! IN.!! "):
        assert len(tokens_of(junk * 3_000 + 'createHash("md5")')) < 60, junk


def test_files_without_a_known_name_give_no_row():
    rows = {"repo": ["r"] * 4, "path": list("abcd"), "content": ["x = 1", "design(redesigned)", "// sign", "createHash(a)"]}
    out = [r for b in US._tokens()([pa.RecordBatch.from_pydict(rows)]) for r in b.to_pylist()]
    assert [(r["path"], r["known"], r["lines"]) for r in out] == [("d", [0], ["createHash(a)"])]


def test_marked_stretches_leave_out_tokens_only(spark, monkeypatch):
    r = random.Random(11)
    marks = ["&&&", "|", "w:", "k ?", "a. b", "x ?. y", "n !", "5", "-", "=> z", "new", "function", "{", "}", ",", "от"]
    stretch = lambda n: " ".join(r.choice(marks) if r.random() < .5 else "word" for _ in range(n))
    rows = [("r", f"f{i}.ts", "".join(x for _ in range(3) for x in (stretch(r.choice([0, 2, 6, 20, 90])), r.choice([" ", "\n", " . ", " new "]), text(r) if r.random() < .5 else r.choice(
        ['createHash("md5")', 'import {} from "elliptic"', 'jwt.sign(a, {algorithm: "ES256"})']), "\n"))) for i in range(400)]
    found = lambda: sorted(map(str, US.sites(with_file_meta(files_df(spark, rows))).collect()))
    short = found()
    monkeypatch.setattr(US, "KEPT_TOKENS", 10**9)
    monkeypatch.setattr(US, "KEPT_FIRST", 10**9)
    assert short == found() and len(short) > 800


def test_column_by_one_pattern_a_rule(spark):
    lines = LINES + ["\U0001f600 é md5 \U0001f600 SHA1", "a\r  sha-1x sha1", "ec.sign ECDSA", "P-256 secp256k1 ES256", "tls_version TLSv1.2 TLSv1.1"] + [x for _, b in CP.PLANTS for x in b.split("\n")]
    hits = LN.match_compiled(LN.explode_lines(with_file_meta(files_df(spark, [("r", "a.ts", "\n".join(lines)), ("r", "b", "\n".join(lines))]))), use_gates=False)
    rules = LN.rule_rows()
    lists = spark.createDataFrame([(x["rule_ord"], ["(?i)" + p for p in LN.effective_patterns(x["patterns"])]) for x in rules], "rule_ord int, rx_list array<string>")
    both = hits.join(lists, "rule_ord").join(LN.rule_dimension(spark), "rule_ord").select("line", "rule_ord", LN.match_column().alias("want"), LN.first_match_column().alias("got"))
    rows = both.collect()
    assert len(rows) > 200 and all(x.got == x.want for x in rows)
    plan = LN.regex_findings(with_file_meta(files_df(spark, [("r", "a.ts", "md5")])))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_instr" not in plan.lower() and "regexpinstr" not in plan.lower()  # no pattern compiled a hit
    assert both.where(F.col("got") > 1).count() > 50


def test_hits_and_confidence_are_read_once(spark):
    found = LN.regex_findings(with_file_meta(files_df(spark, [("r", "a.ts", "md5")]))).where("confidence * 100 >= 50")
    plan = found._jdf.queryExecution().optimizedPlan().toString().lower()
    assert len(re.findall(r"regexp_extract\(line#\d+, rx_first", plan)) == 1
    assert len(re.findall(r"rlike\(line#|line#\d+ rlike", plan)) == 8  # confidence alone, in one expression of four cases; no column's pattern, compiled for every row


def test_lines_told_apart_by_halves():
    r, words = random.Random(3), ["RSA", "des", "md5 ", "sha-1", "ecdsa", "x", " ", "ſ", "tls.crt", "AES-256", "\x0b", "createHash(", "'sha1'", "kem", "\r"]
    lines = ["".join(r.choice(words) for _ in range(r.randint(0, 5))) for _ in range(900)] + [x for _, b in CP.PLANTS for x in b.split("\n")]
    content = ["\n".join(lines[i:i + 30]) for i in range(0, len(lines), 30)]
    gates = [(x["rule_ord"], LN.C.TOKEN_GATES[x["rule_id"]]) for x in LN.rule_rows()]
    batch = pa.RecordBatch.from_pydict({"repo": ["r"] * len(content), "path": [str(i) for i in range(len(content))], "language": ["go"] * len(content), "content": content})
    got = [(x["rule_ord"], x["path"], x["line_no"], x["line"]) for b in LN._gated(gates)([batch]) for x in b.to_pylist()]
    fold = lambda s: s.lower().replace("ſ", "s")
    want = [(n, str(i), j + 1, line) for n, tokens in gates for i, c in enumerate(content) for j, line in enumerate(c.split("\n")) if any(t in fold(line) for t in tokens)]
    assert got == want and len(got) > 1500


def test_rule_patterns_match_no_empty_text_and_their_re2_form_misses_none():
    java = lambda p: re.compile(p.replace(r"\s", "[ \\t\\n\\x0b\\f\\r]"), re.I | re.A)
    lines = LINES + ["createHash\x0b(\"md5\")", "type:\x0bkubernetes.io/tls"] + [x for _, b in CP.PLANTS for x in b.split("\n")]
    forms = 0
    for rule in LN.rule_rows():
        patterns = LN.effective_patterns(rule["patterns"])
        held, hit = LN._held(patterns), [any(java(p).search(x) for p in patterns) for x in lines]
        assert not any(java(p).search("") for p in patterns)
        if held:
            forms += 1
            found = pa.compute.match_substring_regex(pa.array(lines), held, ignore_case=True).to_pylist()
            assert not [x for x, h, f in zip(lines, hit, found) if h and not f], rule["rule_id"]
    assert forms > 20
    assert LN._held([r"a\b"]) is None and LN._held(["^a"]) is not None and LN._held(["(?<!x)a"]) is None
