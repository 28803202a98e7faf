"""Substring matches by index and leaders by rounds, against plain loops."""

import random

import pytest

from qsieve.operators import enrich as EN

RULES = EN.PURL_RULES


def words(r, n):
    return ["".join(r.choice(["a", "b", "ab", "ecdsa", "secp256", "ed25519", "É", "-", "Rsa"]) for _ in range(r.randrange(0, 4))) for _ in range(n)]


def test_containing(spark):
    r = random.Random(1)
    hay, needle = ([(f"s{i % 3}", w) for i, w in enumerate([*words(r, 120), None])] for _ in (0, 1))
    got = EN.containing(spark.createDataFrame(hay, "sbom_id string, hay string"), spark.createDataFrame(needle, "sbom_id string, needle string")).collect()
    want = [(s, h, n) for s, h in hay for t, n in needle if s == t and h is not None and n is not None and n.lower() in h.lower()]
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("by_name", [True, False])
def test_targets(spark, by_name):
    r = random.Random(2)
    comps = [(f"s{r.randrange(3)}", i // 5, i % 5, n, p) for i, (n, p) in enumerate(zip([*words(r, 90), None], [*words(r, 90), None], strict=True))]
    algos = [(f"s{r.randrange(3)}", a, i) for i, a in enumerate(x for x in words(r, 80) if x)]
    got = EN._targets(spark.createDataFrame(algos, "repo string, algorithm string, ord int"), spark.createDataFrame(comps, "sbom_id string, doc_ord int, pos int, name string, purl string"), by_name).collect()

    def match(a, name, purl):
        a = a.lower()
        if purl and (a in purl.lower() or any(i in a and o in purl.lower() for i, o in RULES)):
            return True
        return by_name and name is not None and (a in name.lower() or name.lower() in a)

    want = {(s, a): min(((d, p) for t, d, p, n, u in comps if s == t and match(a, n, u)), default=None) for s, a, _ in algos}
    assert {(x.sbom_id, x.algorithm): x.comp and tuple(x.comp) for x in got} == want and len(got) == len(want)


def fold(seq):
    leaders = []
    related = lambda x, y: x.lower() in y.lower() or y.lower() in x.lower()
    for x in seq:
        if not any(related(x, y) for y in leaders):
            leaders.append(x)
    return {x: next(i for i, y in enumerate(leaders, 1) if related(x, y)) for x in seq}


def leaders(spark, rows):
    frame = spark.createDataFrame([(s, a, o, None) for s, a, o in rows], "sbom_id string, algorithm string, first_ord int, comp int")
    return {(x.sbom_id, x.algorithm): x.leader_idx for x in EN._leaders(frame).collect()}


def test_leaders(spark):
    r = random.Random(3)
    rows = [(f"s{k}", a, r.randrange(40)) for k in range(4) for a in dict.fromkeys(w for w in words(r, 60) if w)]
    rows += [("chain", "x" * n, n % 7) for n in range(1, 25)]
    want = {}
    for s in {s for s, *_ in rows}:
        want |= {(s, a): i for a, i in fold([a for _, _, a in sorted((o, a.encode(), a) for t, a, o in rows if t == s)]).items()}
    assert leaders(spark, rows) == want
    assert leaders(spark, []) == {}


def test_leaders_of_many_free_texts(spark):
    r = random.Random(4)
    algos = list(dict.fromkeys("-".join(r.choice(["aes", "rsa", "sha", "dh", "kem", "x9", "p256", "cbc"]) + str(r.randrange(60)) for _ in range(r.randrange(1, 4))) for _ in range(10000)))
    got = leaders(spark, [("one", a, i) for i, a in enumerate(algos)])
    assert {a: i for (_, a), i in got.items()} == fold(algos) and len(algos) > 5000
