"""Every operator against a brute-force version, on the smallest tables and on
a table of odd cases."""

import hashlib
import re

import public_tokenizers
import pytest
import regex
import sentencepiece
import tiktoken
from pyspark.sql import functions as F

from qsieve.llm import ann, byte_bpe, components, decontaminate, frames, licenses, pii, quality, queries, simhash, substring_dedup, token_counts, url_filter

from . import brute
from .data import SF, documents, frame, odd_rows, same, table

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(autouse=True)
def shipped(spark):
    frames.ship(spark)


def test_substring_dedup(spark):
    out = "doc_id", "n_words", "n_removed", "kept_sha256"
    same(substring_dedup.substring_dedup(frame(spark, odd_rows())).select(*out).collect(), brute.substring_dedup(odd_rows()))
    same(queries.QUERIES["op1_substring_dedup"](spark, SF).collect(), brute.substring_dedup(documents()))
    assert substring_dedup.substring_dedup(frame(spark, [], empty=True)).count() == 0


def test_substring_collisions_are_verified(spark):
    """A path that its coordinates do not confirm removes nothing it should not."""
    rows = [(i, t) for i, t in odd_rows() if i is not None and i < 10]
    docs = frame(spark, rows).select("doc_id", substring_dedup._row_tag().alias("tag"), "text")
    tags = {r.doc_id: r.tag for r in docs.collect()}
    at = lambda i: tags[i] * substring_dedup.PLACE
    wrong = spark.createDataFrame([(6, at(6), 108, 5, at(5)), (8, at(8) + 9, 20, 5, at(5))], "doc_id long, at long, n int, src_doc long, src_at long")
    told = {r.doc_id: r.same for r in substring_dedup.verify(docs, wrong, 13).collect()}
    assert told == {6: True, 8: False}


def test_substring_runs_that_differ_in_the_middle(spark):
    """Runs of one minimiser with equal ends and another middle are not one."""
    phrase = lambda i, odd: f"p{i} q{i} r{i} " * 8 + odd + f" p{i} q{i} r{i}" * 8
    table = lambda odd: "| 0 | 0 " * 8 + f"| {odd} | 0 " + "| 0 | 0 " * 8
    rows = [(n * 10 + i, phrase(i, odd)) for i in range(8) for n, odd in enumerate(["odd", "even", "even", "even strange"])]
    rows = rows + [(100 + n, table(odd)) for n, odd in enumerate([7, 8, 8, 9])]
    docs = frame(spark, rows).coalesce(1)  # one slice
    got = substring_dedup.substring_dedup(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    same(got, brute.substring_dedup(rows))


RULED = [("https://www.example.com/en/1", "example.com", "allow"), ("https://a.example.com/en/1", "", "block"), ("http://shop.com", "", "allow"), ("x://a.NET/es/", "", "block")]


def test_url_filter(spark):
    urls = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "HTTP://WWW.Example.com/en/a?b#c"), (6, "https://u.net/es/x"), (6, "https://u.net/es/x"), (7, "https://u.org/list/a/"), (8, "http://U.org/list/a?x=1"),
            (9, "http://u.org/list/b"), (10, "a://b://c/d"), (11, "http://net/fr/"), (12, "http://xnet/fr/"), (13, "http://example.com?x/en/"), (None, "http://u.org#f"), (14, "http://\u0130.net/es/" + "y" * 50000)]
    pages = spark.createDataFrame([(i, u, 1, "w") for i, u in urls], "page_id long, url string, block int, key string")
    listed = spark.createDataFrame([("http://u.org/list/a",), ("https://u.org/list/a/",), (None,), ("none",)], "url string")
    got = url_filter.filter_urls(pages, queries.SITE_RULES, listed).collect()

    def judge(i, u):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group().encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).decode()
        path = re.match(r"[^/?#]*([^?#]*)", rest).group(1)
        fit = [(len(s + p), s + p, a) for a, s, p in queries.SITE_RULES if (host == s or host.endswith("." + s)) and path.startswith(p)]
        rule = max(fit)[1:] if fit else (None, "block" if host + path.rstrip("/") == "u.org/list/a" else "allow")
        return i, host, path, *rule

    same([(r.page_id, r.host, r.path, r.rule, r.verdict) for r in got], [judge(*x) for x in urls])
    # a one-block filter passes nearly everything: the exact join still decides
    same([(r.page_id, r.verdict) for r in url_filter.filter_urls(pages, [], listed, blocks=1).collect()], [(i, "block" if i in (7, 8) else "allow") for i, _ in urls])
    assert url_filter.filter_urls(pages.limit(0), queries.SITE_RULES, listed.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.filter_urls(pages, [], listed.limit(0)).collect()} == {"allow"}


@pytest.mark.parametrize("chunk, overlap", [(1 << 16, 1 << 12), (64, 24), (50, 1)])
def test_byte_bpe(spark, chunk, overlap):
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=brute.ranks(), special_tokens={})
    rows = [(d, t) for d, t in odd_rows() if chunk > 1000 or len(t or "") < 5000] + [(20, "don't  stop   \n\n it's " * 40), (21, " " * 500 + "a"), (22, "<|endoftext|> 12345 ''' " * 30)]
    docs = frame(spark, rows).withColumnRenamed("ids", "given")
    coded = byte_bpe.decode(byte_bpe.encode(docs, PATH, PATTERN, "ids", chunk, overlap), PATH, PATTERN)
    same([(r.doc_id, r.ids, bytes(r.decoded)) for r in coded.collect()], [(d, coder.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows])
    both = byte_bpe.encode(docs, PATH, PATTERN, "ids", chunk, overlap, "decoded")
    assert both.schema == coded.schema
    same([(r.doc_id, r.ids, bytes(r.decoded)) for r in both.collect()], [(r.doc_id, r.ids, bytes(r.decoded)) for r in coded.collect()])
    assert byte_bpe.encode(frame(spark, [], empty=True), PATH, PATTERN, "out").count() == 0


def test_byte_bpe_pieces_cover_long_texts(spark):
    text = ("we're " * 40 + "y" * 300 + " 7 ") * 3
    rows = spark.createDataFrame([(5, text), (6, "b c " * 100)], "row long, text string")
    got = sorted(byte_bpe.stitched(rows, PATTERN, 64, 24).collect())
    assert "".join(r.piece for r in got if r.row == 5) == text
    starts = {m.start() for m in regex.finditer(PATTERN, text)}
    assert {r.base for r in got if r.row == 5} <= starts
    assert len([r for r in got if r.row == 6]) > 5


def test_byte_bpe_query(spark):
    coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=brute.ranks(), special_tokens={})
    want = [(d, len(i := coder.encode_ordinary(t or "")), brute.sha(" ".join(map(str, i))), brute.sha(t or "")) for d, t in documents()]
    same(queries.QUERIES["op3_byte_bpe"](spark, SF).collect(), want)


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES["op4_quality"](spark, sf).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in table("labels", sf) if r["doc_id"] in got and got[r["doc_id"]].held_out]
    right = [got[d].predicted == q for d, q in labels]
    low = [got[d].predicted == q for d, q in labels if q == 0]
    assert len(labels) > 300 and sum(right) / len(right) > 0.95 and sum(low) / len(low) > 0.9
    assert all(0 <= r.score <= 1 for r in got.values())


def test_quality_odd_cases(spark):
    docs = frame(spark, odd_rows())
    labels = spark.createDataFrame([(5, 1), (8, 1), (10, 0), (11, 0), (None, 1), (6, None), (1, 0), (12, 1)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model, "s").collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.s <= 1 for r in got)
    assert quality.score(docs, quality.fit(docs, labels.limit(0)), "s").select("s").distinct().collect() == [(0.5,)]
    assert quality.score(docs, quality.fit(docs, labels.filter("quality = 1")), "s").select("s").distinct().collect() == [(1.0,)]
    assert quality.score(frame(spark, [], empty=True), model, "s").count() == 0


def test_simhash(spark):
    out = "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id"
    same(simhash.simhash_components(frame(spark, odd_rows())).select(*out).collect(), brute.simhash(odd_rows()))
    same(queries.QUERIES["op5_simhash"](spark, SF).collect(), brute.simhash(documents()))
    assert simhash.simhash_components(frame(spark, [], empty=True)).count() == 0


@pytest.mark.parametrize("radius, shard", [(3, 4096), (3, 5), (0, 8), (6, 16)])
def test_bk_links_reach_what_all_pairs_reach(spark, radius, shard):
    import random
    r = random.Random(radius)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = sorted({s ^ sum(1 << b for b in r.sample(range(64), r.randrange(0, 5))) for s in seeds for _ in range(12)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), radius, shard)
    root = {x.node: x.root for x in components.components(got).collect()}
    groups = {f: {f} for f in fps}
    for a in fps:
        for b in fps:
            if (a ^ b).bit_count() <= radius and groups[a] is not groups[b]:
                groups[a] |= groups[b]
                for x in groups[b]:
                    groups[x] = groups[a]
    name = {f: s for f, s in zip(fps, signed)}
    for f in fps:
        assert {name[x] for x in groups[f]} == {s for s in signed if root.get(s, s) == root.get(name[f], name[f])}


def test_keep_one(spark):
    rows = odd_rows()
    got = simhash.keep_one(frame(spark, rows))
    # the two texts of doc_id 9 are two components
    first = {}
    for (d, t), (_, fp, comp) in zip(rows, brute.simhash(rows)):
        first.setdefault((comp, fp if comp == 9 else None), set()).add(d)
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept) == sorted(min(x for x in g if x is not None) for g in first.values()) and got.columns == frame(spark, rows).columns


ITEMS = [(1, " ".join(odd_rows()[9][1].split()[40:70])), (2, "two words"), (3, None), (4, ""), (None, "word"), (5, "ÉÉ ß! another-text of"), (5, "ÉÉ ß! another-text of"), (10, "SAME same same, same"), (30, "x")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_decontaminate(spark, block_bytes):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = odd_rows()
    got = decontaminate.matches(frame(spark, rows), items, "hits", 13, block_bytes).select("doc_id", "hits.*").collect()
    same([(r.doc_id, r.n_words, r.n_hit, len(set(r.items)), brute.sha(",".join(sorted(set(r["items"])))), r.n_hit > 0 and 20 * r.n_hit >= r.n_words) for r in got], brute.contamination(rows, ITEMS))
    long = [(m.item_id, m.n_words) for r in got if r.doc_id == 8 for m in r.matches]
    assert ("1", 30) in long
    kept = decontaminate.decontaminate(frame(spark, rows), items)
    assert sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted((d is None, d) for d, *_, bad in brute.contamination(rows, ITEMS) if not bad)
    assert decontaminate.matches(frame(spark, rows), items.limit(0), "hits").filter("hits.n_hit > 0").count() == 0
    assert decontaminate.matches(frame(spark, [], empty=True), items, "hits").count() == 0


def test_decontaminate_repetitive_text():
    """Equal words against equal words: right matches within bounded memory."""
    import tracemalloc

    import numpy as np
    n, m = 20000, 600
    bench, text = decontaminate.Windows([("1", "same " * m), ("2", "same " * 20 + "other " * 20)], 13), np.frombuffer(b"same " * n + b"other " * 50, np.uint8)
    tracemalloc.start()
    total, got = decontaminate._shard(bench, text, np.array([0, 5 * n, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    diagonal = lambda r, i, n, m, at=0: [(r, max(0, d), i, at + max(0, -d), z) for d in range(13 - m, n - 12) if (z := min(n - max(0, d), m - max(0, -d))) >= 13]
    assert total.tolist() == [n, 50] and peak < 300 << 20
    assert sorted(map(tuple, got.tolist())) == sorted(diagonal(0, 0, n, m) + diagonal(0, 1, n, 20) + diagonal(1, 1, 50, 20, 20))


def test_decontaminate_query(spark):
    items = [(r["item_id"], r["text"]) for r in table("benchmark")]
    same(queries.QUERIES["op6_decontaminate"](spark, SF).collect(), brute.contamination(documents(), items))


def check_recall(got, want, k):
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id, r.rank))
    hits = total = 0
    for q, near in want.items():
        mine = sorted(found.get(q, []), key=lambda x: x[2])
        assert [r for *_, r in mine] == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: (x[0], x[1]))
        hits += len({j for _, j in near} & {j for _, j, _ in mine})
        total += len(near)
    return hits / max(1, total)


def test_nearest_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings", sf)]
    got = queries.QUERIES["op7_nearest"](spark, sf).collect()
    want = brute.nearest(rows)
    assert check_recall(got, want, 20) >= 0.9
    exact = {(q, j): -s for q, near in brute.nearest(rows, k=len(rows)).items() for s, j in near} if len(rows) < 3000 else {}
    assert all(abs(exact.get((r.query_id, r.vec_id), r.score) - r.score) < 1e-12 for r in got)


@pytest.mark.parametrize("bucket, used", [(100, 2), (20, 3)])
def test_nearest_recall_of_more_projections(spark, monkeypatch, bucket, used):
    monkeypatch.setattr(ann, "BUCKET", bucket)
    rows = [(r["vec_id"], r["embedding"]) for r in table("embeddings", "/root/testdata/sf0.1")]
    fits, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **b: fits.append(fit(*a, **b)) or fits[-1])
    got = queries.QUERIES["op7_nearest"](spark, "/root/testdata/sf0.1").collect()
    assert fits[0].axes.shape[1] == used and check_recall(got, brute.nearest(rows), 20) >= 0.9


def test_nearest_fit_drops_projections(spark, monkeypatch):
    """Probes that stop short of the recall are not taken: fewer projections are."""
    import numpy as np
    monkeypatch.setattr(ann, "BUCKET", 0.001)  # 9 projections, 10 million cells a table
    rows = [(str(r["vec_id"]), np.array(r["embedding"], "<f8")) for r in table("embeddings", "/root/testdata/sf0.1")]
    classes = spark.createDataFrame([(i, bytearray(v.tobytes()), float(np.linalg.norm(v))) for i, v in rows], "cls string, vec binary, norm double")
    asked = [r for r in rows if int(r[0]) % 20 == 0]
    index = ann.fit(classes, classes.filter("cast(cls as long) % 20 = 0"), len(rows[0][1]), 20)
    x = np.stack([v for _, v in rows])
    q = np.stack([v for _, v in sorted(asked)[:ann.SAMPLE]])
    order, bucket = index.ranked(index.project(q, True), index.probes)[:, :, :index.probes], index.buckets(index.cells(index.project(x, False)))
    hit = total = 0
    for i in range(len(q)):
        near = np.argsort(-(x @ q[i]), kind="stable")[1:21]
        hit += sum(any(bucket[j, t] in order[i, t] for t in range(bucket.shape[1])) for j in near)
        total += len(near)
    assert hit / total >= ann.TARGET - 0.01 and index.axes.shape[1] < 9


def test_nearest_odd_cases(spark):
    import random
    r = random.Random(1)
    hot = [r.gauss(0, 1) for _ in range(8)]
    rows = [(i, hot if i % 3 == 0 else [r.gauss(0, 1) for _ in range(8)]) for i in range(400)]
    rows += [(500, None), (501, [0.0] * 8), (502, [None] + [1.0] * 7), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (505, [1.0, 2.0]), (None, hot), (20, rows[20][1]), (506, []), (520, [x * 50 for x in hot])]
    docs = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<double>, bucket int, cls string")
    got = ann.nearest(docs, F.col("vec_id") % 20 == 0, 20).collect()
    want = brute.nearest([(i, v) for i, v in rows if not v or len(v) == 8])
    assert {r.query_id for r in got} == set(want) and check_recall(got, want, 20) >= 0.9
    assert [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 60][:5] == [j for _, j in want[60]][:5]
    assert ann.nearest(docs.limit(0), F.col("vec_id") % 20 == 0, 20).count() == 0
    assert len(ann.nearest(docs.filter("vec_id < 5"), F.col("vec_id") % 20 == 0, 20).collect()) <= 4


TEXTS = ["mail a.b+c@d-e.org, x@y.z.w. bad@host and b@c.d_e@f.g", "10.0.0.255 1.2.3.4.5.6.7.8 300.1.1.1 0255.000.1.1 1..2.3.4.5 12345678901234567890.1.2.3", "card 4111 1111 1111 1111 or 4111-1111-1111-1112, 5500005555555559 12 34",
         "call +1 (415) 555-0199 or +49 30 1234567, +12 +123456789012345678 +1-", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432 and DE89370400440532013001", "ssn 123-45-6789 or 123-45-6789", "\U0001f600é a@b.co \U0001f600 +4930123456789",
         "9" * 20000, "a" * 20000 + "@", "a@" * 3000, "1." * 5000, "+1 " * 3000, ("x y@z.de " * 200), "4111111111111111 " * 50,
         "call 4111 1111 1111 1111 or x@z.de, 字 " * 1500]


def test_pii(spark):
    # without the longest run of letters, on which the brute-force patterns take minutes
    rows = [x for x in odd_rows() if x[0] != 13] + [(100 + i, t) for i, t in enumerate(TEXTS)]
    assert pii.find_pii(frame(spark, odd_rows()), "p").filter("doc_id = 13").first().p == []
    got = pii.find_pii(frame(spark, rows), "found_pii")
    base = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.found_pii if s.kind in pii.BASE]) for r in got.collect()]
    same(base, [(d, brute.base_pii(t)) for d, t in rows])
    for r in got.collect():
        assert all(s.text == r.text[s.start:s.end] and 0.5 <= s.score <= 1 for s in r.found_pii)
    more = {r.doc_id: [(s.kind, s.text) for s in r.found_pii if s.kind not in pii.BASE] for r in got.filter("doc_id >= 100").collect()}
    assert more[104] == [("iban", "DE89 3704 0044 0532 0130 00"), ("iban", "GB82WEST12345698765432")] and ("ssn", "123-45-6789") in more[105]
    masked = {r.doc_id: r.text for r in got.withColumn("text", pii.mask("found_pii")).filter("doc_id >= 100").collect()}
    for r in got.collect():
        out, at = "", 0
        for a, z, kind in sorted((x.start, x.end, x.kind) for x in r.found_pii):
            if a >= at:
                out += r.text[at:a] + f"[{kind.upper()}]"
            at = max(at, z)
        assert r.doc_id is None or r.doc_id < 100 or masked[r.doc_id] == out + r.text[at:]
    assert masked[106] == "\U0001f600é [EMAIL] \U0001f600 [PHONE]" and masked[107] == TEXTS[7]
    assert pii.find_pii(frame(spark, [], empty=True), "p").count() == 0


def test_pii_query(spark):
    want = {d: brute.base_pii(t) for d, t in documents()}
    for r in queries.QUERIES["op8_pii"](spark, SF).collect():
        base = ",".join(f"{k}:{a}:{z}" for k, a, z in want[r.doc_id])
        assert r.base_sha256 == brute.sha(base) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, *_ in want[r.doc_id]) for x in pii.BASE]
        assert not base or set(base.split(",")) <= set(r.spans.split(","))


def test_licenses(spark):
    apache = licenses.NOTICES["Apache-2.0 header"]
    cut = " ".join(apache.split()[:-3])
    rows = odd_rows() + [(100, "intro " * 70 + apache.upper() + " outro" * 50), (101, "a b c " + cut), (102, " ".join(apache.split()[:14])), (103, "Released under the MIT License. " * 300), (104, "Licensed under CC BY-NC 4.0"), (105, licenses.NOTICES["MIT grant"] + "\n" + licenses.NOTICES["BSD"])]
    got = {(r.doc_id, r.text): sorted(x.license for x in r.found_l) for r in licenses.scan_licenses(frame(spark, rows), column="found_l").collect()}
    sets = {n: brute.shingle_set(t) for n, t in licenses.NOTICES.items()}
    for d, t in rows:
        have = brute.shingle_set(t)
        assert got[d, t] == sorted(n for n, s in sets.items() if len(s & have) >= 0.8 * len(s)), d
    assert licenses.scan_licenses(frame(spark, [], empty=True), column="l").count() == 0
    assert {len(r.l) for r in licenses.scan_licenses(frame(spark, rows), {}, "l").collect()} == {0}
    whole = queries.QUERIES["op9_licenses"](spark, "/root/testdata/sf0.01").filter("n_licenses > 0").collect()
    want = {d for d, t in documents("/root/testdata/sf0.01") if any(len(s & brute.shingle_set(t)) >= 0.8 * len(s) for s in sets.values())}
    assert {r.doc_id for r in whole} == want


def test_licenses_in_common_use(spark):
    """Whole texts with changed words between other text, headers and notices."""
    whole = {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "ISC", "Unlicense", "MIT", "BSD-3-Clause", "BSD-2-Clause", "CC0-1.0", "Zlib"}
    cuts = {n: licenses.NOTICES[f"{n} text"].split() for n in whole}
    rows, want = [], {}
    for i, n in enumerate(sorted(whole)):
        rows.append((i, "intro text " * (37 * i) + " ".join("other" if k % 60 == 59 else w for k, w in enumerate(cuts[n])) + " outro" * 90))
        want[i] = f"{n} text"
    said = {"MIT notice: under the terms of the": "You may use it under the terms of the MIT license, or not.", "MIT notice: licensed under the": "All code here is licensed under the MIT license.",
            "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "CC-BY-SA-4.0 short": "Photos: licensed under CC BY-SA 4.0.",
            "LGPL notice: distributed under the": "It is distributed under the GNU Lesser General Public License, version 2.1.", "MPL-2.0 header": "/* " + licenses.NOTICES["MPL-2.0 header"] + " https://mozilla.org/MPL/2.0/. */",
            "AGPL header": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU Affero General Public License as published\n# by the Free Software Foundation, either version 3"}
    for i, (n, t) in enumerate(said.items(), 100):
        rows.append((i, t))
        want[i] = n
    rows.append((200, " ".join(cuts["BSD-3-Clause"][20:])))  # conditions and disclaimer without the first sentence
    want[200] = "BSD-3-Clause text"
    rows += [(201, " ".join(cuts["GPL-3.0"][:3000])), (202, "the terms and conditions of this License " * 900)]
    sets = {n: brute.shingle_set(t) for n, t in licenses.NOTICES.items()}
    for r in licenses.scan_licenses(frame(spark, rows), column="found_l").collect():
        have, names = brute.shingle_set(r.text), [x.license for x in r.found_l]
        anywhere = {n for n, s in sets.items() if len(s & have) >= 0.8 * len(s)}
        w = r.text.split()
        size = {n: len(licenses.NOTICES[n].split()) for n in anywhere}
        near = {n for n, m in size.items() if any(len(sets[n] & brute.shingle_set(" ".join(w[i:i + m]))) >= 0.8 * len(sets[n]) for i in range(0, max(1, len(w) - m + 1), max(1, m // 100)))}
        assert near <= set(names) <= anywhere, r.doc_id  # found where one stretch holds it, not from words far apart
        assert r.doc_id not in want or want[r.doc_id] in names, r.doc_id


def test_token_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = odd_rows() + [(100 + i, t) for i, t in enumerate(["  a  b ", "▁▁x▁ y", "</s> <s> <unk> <0x0A>", "tab\tline\nnew", " ", "a" * 500 + " " * 40 + "b", "ﬁ ½ é e\u0301 \u3000x"])]
    got = token_counts.count_tokens(frame(spark, rows), public_tokenizers.path("piece_bpe_32k.model"), "n").collect()
    same([(r.doc_id, r.n) for r in got], [(d, len(sp.encode(t or ""))) for d, t in rows])
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096) for d, t in documents()]
    same(queries.QUERIES["op10_token_counts"](spark, SF).collect(), want)
    counter = token_counts.Shortcut(public_tokenizers.path("piece_bpe_32k.model"))
    assert counter.split and len(counter.whole) > 10000
    assert token_counts.count_tokens(frame(spark, [], empty=True), public_tokenizers.path("piece_bpe_32k.model"), "n").count() == 0
    assert hashlib.sha256(b"").hexdigest() == brute.sha("")


def colliding():
    """Two words of 2,048 letters whose polynomial hashes modulo 2**64 agree for any odd base."""
    bits = [bin(i).count("1") & 1 for i in range(2048)]
    return ["".join("ab"[x ^ k] for x in bits) for k in (0, 1)]


def test_decontaminate_words_of_one_hash(spark):
    """Words are compared by their bytes: a word whose hash is that of a benchmark word is no hit."""
    import numpy as np
    a, b = colliding()
    data = np.frombuffer((a + b).encode(), np.uint8)
    h = decontaminate.word_hashes(data, np.array([0, 2048]), np.array([2048, 4096]))
    assert h[0] == h[1] and a != b
    line = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"x {line} {a} y"), (2, f"x {line} {b} y"), (3, f"{b} {line}"), (4, a)]
    for items in ([("i1", f"{line} {a}")], [("i1", f"{line} {a}"), ("i2", f"{b} {line}"), ("i3", b)], [("i1", f"{line} {b}"), ("i2", a)]):
        for block in (1 << 20, 4000):
            bench = spark.createDataFrame(items, "item_id string, text string")
            got = decontaminate.matches(frame(spark, rows), bench, "hits", 13, block).select("doc_id", "hits.n_words", "hits.n_hit", "hits.items").collect()
            same([(r.doc_id, r.n_words, r.n_hit, len(r["items"])) for r in got], [(d, n, hit, k) for d, n, hit, k, *_ in brute.contamination(rows, items)])


def test_substring_texts_of_one_id(spark, monkeypatch):
    """Texts of one doc_id whose tags agree under a salt are told apart under another."""
    rows = [(1, "a b c"), *odd_rows(), (9, "short text"), (9, odd_rows()[9][1] + " tail of nine"), (9, None)]
    monkeypatch.setattr(substring_dedup, "TAGS", 0xF)
    tags = substring_dedup.tagged(frame(spark, rows)).filter("doc_id = 9").select("tag", "text").distinct().collect()
    assert len({r.tag for r in tags}) == len(tags) == 5
    same(substring_dedup.substring_dedup(frame(spark, rows)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect(), brute.substring_dedup(rows))
    monkeypatch.setattr(substring_dedup, "TAGS", 0)
    with pytest.raises(ValueError, match="more different texts"):
        substring_dedup.tagged(frame(spark, rows))
