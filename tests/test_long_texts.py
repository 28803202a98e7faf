"""The scan's shared steps on long texts: the same rows with less work."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from qsieve import catalog as C
from qsieve.operators import lines as LN
from qsieve.operators import usage as US
from qsieve.plans import corpus as CP
from qsieve.sources.files import with_file_meta

from .conftest import files_df

FILLERS = ["plain", "words", "end.", "Next", "one,", "two;", "don't", "say \"so\"", "x: y", "a ? b", "not!", "3.5", "$x", "été", "\U0001f600", "\n", "sign", "important", "from", "a.b.c", "w?.v", "=>"]


def prose(r, n):
    return " ".join(r.choice(FILLERS[:6] if r.random() < .97 else FILLERS) for _ in range(n))


def text(r):
    """Prose of any length before, between and inside planted code."""
    inside = ['createHash({}, "md5")', 'jwt.sign(a, k, {{ note: {}, algorithm: "ES256" }})', 'import {{ {} }} from "elliptic"; const q = 1', 'import {} from "elliptic"', 'f(`{} ${{crypto.createHash("sha1")}} {}`)', '/* {} */ new crypto.createHash("md5")',
              '{}.createHash("sha1")', 'createECDH( /* {} */ "prime256v1")', 'jwt.verify(t, k, {{ algorithms: [ {}, "RS512" ] }})', "{{ {} : \"x\" }} / 2 / createHash('md5')"]
    out = []
    for _ in range(r.randrange(1, 6)):
        out.append(prose(r, r.choice([0, 5, 30, 60, 300])))
        n = r.choice([1, 3, 9, 14, 80, 200])
        out.append(r.choice([r.choice(CP.PLANTS)[1], r.choice(inside).format(prose(r, n), prose(r, n))]))
    return r.choice([" ", "\n"]).join(out)


def tokens_of(src):
    out = list(US._tokens()([pa.RecordBatch.from_pydict({"repo": ["r"], "path": ["a.ts"], "content": [src]})]))
    return out[0]["tok"].to_pylist()[0]


def test_plain_stretches_leave_out_tokens_only(spark, monkeypatch):
    r = random.Random(7)
    files = files_df(spark, [("r", f"f{i}.ts", text(r)) for i in range(400)])
    found = lambda: sorted(map(str, US.sites(with_file_meta(files)).collect()))
    short = found()
    monkeypatch.setattr(US, "KEPT_TOKENS", 10**9)
    assert short == found() and len(short) > 800


def test_long_prose_has_few_tokens():
    src = "word and more words, then. " * 20_000 + 'createHash("md5")'
    assert len(tokens_of(src)) < 200 and tokens_of(src)[-4:] == ["createHash", "(", "", ")"]


LINES = ["", "RSA_sign(x)", "  // md5 here", " # sha1", " * aes-128", "use md5\r", "user md5", "from md5_x import sha1", "f(\"md5\")", "f('a') md5 ('b'", "f(\r'sha1')", "createhaSh('sha-1')", "ſha1 Kem kem", "ECDH é x25519", "-- dsa", "; des3", "tls.key: 1",
         "ecdsa.generatekey(", "\tMLKEM ml-kem-768 kyber", " " * 400 + "sha3-256" + " " * 200, "é" * 300 + " md5 " + "x" * 300]


@pytest.mark.parametrize("most_bytes", [1, 200, 8 << 20])
def test_gated_lines_lose_no_hit(spark, monkeypatch, most_bytes):
    whole = LN._gated
    monkeypatch.setattr(LN, "_gated", lambda gates: whole(gates, most_bytes))
    paths = ["a.ts", "b.py", "c.conf", "d", "e/Dockerfile"]
    rows = [("r", p, "\n".join(LINES)) for p in paths] + [("r", "x.ts", ""), (None, "y.ts", "md5"), ("s", "z.ts", "\n\nmd5\n")] + [("p", f"{i}/p{s}", b) for i, (s, b) in enumerate(CP.PLANTS)]
    text = with_file_meta(files_df(spark, rows))
    got = LN.match_gated(text)
    want = LN.match_compiled(LN.explode_lines(text), use_gates=False)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect())) and got.count() > 200
    assert "Contains(" not in got._jdf.queryExecution().optimizedPlan().toString()  # no pass over a line per token


def test_snippet_and_confidence_as_patterns(spark):
    lines = LINES + ["  ", "#", "x # y", "include <openssl>", "includes", "require('md5')", "if (\"a\" + 'b')", "('x\")", "( ')"]
    got = spark.createDataFrame([(x,) for x in lines], "line string").select("line", LN.snippet(F.col("line")).alias("s"), LN.regex_confidence(F.col("line"), F.lit("python"), F.lit("low")).alias("c")).collect()
    for x in got:
        c = C.CONF_COMMENT if re.search(C.CONF_COMMENT_RE.replace(r"\s", f"[{US.JS_TRIM}]"), x.line) else C.CONF_CALL if re.search(C.CONF_CALL_RE.replace(".", "[^\r\n\u0085  ]"), x.line) else C.CONF_KEYWORD if re.search(C.CONF_KEYWORD_RE, x.line, re.A) else C.CONF_BASE
        assert (x.s, x.c) == (x.line.strip(US.JS_TRIM)[:C.SNIPPET_CHARS], c), x
