"""Suffix-array dedup, filter audit and conversation repair against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from qsieve.llm import conversation_repair, filter_audit, frames, queries, suffix_dedup

from . import brute
from .data import SF, documents, frame, odd_rows, same, table


@pytest.fixture(autouse=True)
def shipped(spark):
    frames.ship(spark)


# suffix-array dedup

def removed(docs, length, keep):
    rows = suffix_dedup.suffix_dedup(docs, length, keep).select("doc_id", "spans", "kept").collect()
    return [(r.doc_id, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in rows]


def passages(seed=3):
    """Texts of few passages, cut and joined at any byte, periodic runs among them."""
    r = random.Random(seed)
    made = ["".join(r.choice("abcdé \n") for _ in range(300)) for _ in range(4)] + ["x" * 500, "ab" * 200]
    rows = []
    for i in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            t, a = r.choice(made), r.randrange(200)
            parts += [t[a:a + r.randrange(60, 300)], "".join(r.choice("pqr") for _ in range(r.randrange(30)))]
        rows.append((i // 2, "".join(parts)))
    return rows + rows[:3] + [(None, rows[5][1]), (None, None), (70, "")]


@pytest.mark.parametrize("keep", ["first", "none"])
@pytest.mark.parametrize("many", [1024, 2])
def test_suffix_dedup(spark, keep, many, monkeypatch):
    """many = 2: nearly every group is split, level by level."""
    monkeypatch.setattr(suffix_dedup.repeated_windows, "__defaults__", (many,))
    same(removed(frame(spark, passages()), 64, keep), brute.suffix_dedup(passages(), 64, keep))


@pytest.mark.parametrize("keep", ["first", "none"])
def test_suffix_dedup_odd_rows(spark, keep):
    rows = [(d, t) for d, t in odd_rows() if not t or len(t) < 100_000]
    same(removed(frame(spark, rows), 100, keep), brute.suffix_dedup(rows, 100, keep))
    assert suffix_dedup.suffix_dedup(frame(spark, [], empty=True), 100, keep).count() == 0
    out = suffix_dedup.suffix_dedup(frame(spark, rows).withColumn("spans", F.lit(1)).withColumn("h", F.lit("h")), 100, keep)
    assert out.columns[-2:] == ["spans_", "kept"] and {r.h for r in out.collect()} == {"h"}


def test_suffix_dedup_long_text(spark, monkeypatch):
    """Texts beyond a chunk are read in parts that lose no window."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefgh") for _ in range(n))
    shared = text(3000)
    rows = [(1, text(9000) + shared + text(500)), (2, shared), (3, text(4096) + shared[:100] + text(90)), (4, text(5000))]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1024)
    t = suffix_dedup.pa.array([t for _, t in rows])
    seen = {}
    for data, off, number, base in suffix_dedup.chunks(suffix_dedup.utf8(t), 100):
        for k, n in enumerate(number):
            part = data[off[k]:off[k + 1]]
            for i in range(len(part) - 99):
                key = int(n), int(base[k]) + i
                assert key not in seen
                seen[key] = bytes(part[i:i + 100])
    assert seen == {(n, i): t.encode()[i:i + 100] for n, (_, t) in enumerate(rows) for i in range(len(t) - 99)}


def test_suffix_dedup_query(spark):
    got = queries.QUERIES["op13_suffix_dedup"](spark, SF).collect()
    want = [(d, len(k) + sum(e - s for s, e in spans), sum(e - s for s, e in spans), len(spans), brute.sha(k)) for d, spans, k in brute.suffix_dedup(documents(), 400, "none")]
    same(got, want)


def test_longest_previous_factors():
    """Ranks, nearest smaller places and factors of random bytes against plain loops."""
    r = np.random.default_rng(2)
    for n, letters in ((300, 2), (500, 4), (2000, 200)):
        data = r.integers(0, letters, n).astype(np.uint8)
        rank = suffix_dedup.ranks(data, 70)
        grams = [bytes(data[i:i + 70]) for i in range(n - 69)]
        by = sorted(set(grams))
        assert [by[k] for k in rank] == grams
        place = r.permutation(len(grams))
        v = place[np.argsort(rank, kind="stable")]
        assert suffix_dedup.nearest_smaller(v).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(len(v))]
        first = {}
        for g, p in zip(grams, place, strict=True):
            first[g] = min(p, first.get(g, p))
        assert suffix_dedup.factors(rank, place).tolist() == [first[g] < p for g, p in zip(grams, place, strict=True)]


# filter audit

LABELS = [(1, 1, 0), (5, 1, 1), (5, 0, 0), (6, None, 1), (10, 0, 1), (None, 1, 1), (12, 1, None), (99, 1, 1)]


def test_filter_audit(spark):
    rows = [(d, t, ["a", None, "", "b"][i % 4]) for i, (d, t) in enumerate([*odd_rows(), (30, "A & B " * 300), (31, "Words " * 250), (31, "Words " * 250), (32, "no | line " + "x" * 9)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("quality", "part", "mask", "facts", "digest", "n")})
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    kept, filters = filter_audit.text_filters(docs)
    got = filter_audit.filter_audit(kept, labels, filters).collect()
    same(got, brute.filter_audit(rows, LABELS))
    assert len(got) == 3 * 600
    kept, filters = filter_audit.text_filters(docs.limit(0))
    assert filter_audit.filter_audit(kept, labels, filters).count() == 0


def test_filter_audit_query(spark):
    docs, labels = table("documents"), table("labels")
    got = queries.QUERIES["op12_filter_audit"](spark, SF).collect()
    same(got, brute.filter_audit([(r["doc_id"], r["text"], r["source"]) for r in docs], [(r["doc_id"], r["quality"], r["toxic"]) for r in labels]))


def test_packed_fields_hold_any_count():
    """Sums of 2**62 rows a mask stay in their fields."""
    masks = [[x for o in filter_audit.outcomes(m, "ABCDE") for x in o] for m in (0, 3, 31)]
    total = sum(filter_audit.pack(f) * (1 << 61) for f in masks)
    want = np.sum([np.array(f, np.uint64) for f in masks], axis=0) * np.uint64(1 << 61)
    assert (filter_audit.unpack(total, 1800).view(np.uint64) == want).all()


def test_other_filters(spark):
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"))
    rows = filter_audit.filter_audit(docs, spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), {"X": F.col("doc_id") < 10, "Y": F.col("doc_id") % 2 == 0}).collect()
    assert {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in rows} == {
        ("XY", 1): (90, 10, 0, 5, 15), ("XY", 2): (45, 45, 5, 45, 95), ("YX", 1): (50, 50, 0, 45, 95), ("YX", 2): (45, 5, 5, 5, 15)}


# conversation repair

def turns(seed, n):
    r = random.Random(seed)
    text = lambda: r.choice(["Hello.", "What now?", "no end", "", " \t", None, "Hello.", "Yes! ", "é.", "two. parts", "x" * 3000 + "."])
    return [(r.choice([*range(8), None]) if n < 500 else 7, r.choice([*range(-1, 9), None, 40]) if n < 500 else i, r.choice(["user", "assistant"] * 4 + ["system", "tool", None, "", "u"]), text()) for i in range(n)]


CLASH = "gone boolean, tid string, audit string, part int, place int, cost string"


@pytest.mark.parametrize("seed,n", [(1, 60), (2, 200), (3, 1200), (4, 0)])
def test_repair(spark, seed, n):
    rows = turns(seed, n)
    rows += rows[:5]
    wide = spark.createDataFrame([(*r, True, "t", "a", 1, 2, "c") for r in rows], "conv_id bigint, turn bigint, role string, text string, " + CLASH).repartition(3)
    got = conversation_repair.repair(conversation_repair.damage(wide), F.col("gone"), digest=True)
    same(got.collect(), brute.repair(rows))


def test_repair_query(spark):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in table("conversations")]
    same(queries.QUERIES["op11_conversation_repair"](spark, SF).collect(), brute.repair(rows))


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "user", "Well."), (2, 0, "assistant", "Only me."), (3, None, "user", " ")]
    docs = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = conversation_repair.repair(docs).orderBy("conv_id", "place").collect()
    assert [tuple(r) for r in got] == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Well.")]


def test_auction_prices():
    """The nodes before a block have their exact distance, and no other price exceeds it."""
    r = random.Random(7)
    for _ in range(200):
        codes = tuple((r.choice("suax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randrange(9)))
        last = r.choice([(0, None, None, 0), (3, 0, 5, 4), (0, 9, 9, 9)])
        far = {(len(codes) + 1, 0): 0}
        nodes = [(i, s) for i in range(len(codes), -1, -1) for s in range(4)]
        for _ in range(len(nodes)):
            for n in nodes:
                out = [(c, to) for _, c, to in conversation_repair.arcs(n, codes)]
                if n[0] == len(codes) and last[n[1]] is not None:
                    out.append((last[n[1]], (len(codes) + 1, 0)))
                far[n] = min(c + far.get(to, 10**9) for c, to in out)
        price = conversation_repair.auction(codes, last)
        assert all(price.get((0, s), 0) == far[0, s] for s in range(4)) and all(price.get(n, 0) <= far[n] for n in nodes)
