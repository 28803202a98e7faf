"""A small table of documents with every odd case, and helpers."""

import random

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"


def words(n, seed):
    r = random.Random(seed)
    return [r.choice("ka lo mi ne pu ra so ti".split()) + r.choice("ber dan fol gix".split()) + str(r.randrange(60)) for _ in range(n)]


def odd_rows():
    """(doc_id, text): null and empty texts, a null id, one word, very long,
    copies, near copies, repeated rows, one doc_id with two texts, ties."""
    base, shared = words(120, 1), words(30, 2)
    near = base[:60] + ["changed"] + base[61:]
    rows = [(1, None), (2, ""), (3, " \t\n "), (None, " ".join(base)), (4, "word"), (5, " ".join(base)), (6, " ".join(base)), (7, " ".join(near)), (7, " ".join(near)),
            (8, " ".join(words(40, 3) + shared + words(40, 4))), (9, " ".join(words(5, 5) + shared)), (9, "another text of the same id " + " ".join(shared)),
            (10, "Same same " * 400), (11, "same Same " * 300), (12, " ".join(words(30000, 6))), (13, "x" * 300000), (14, "\u00a0é ß 字 \U0001f600 " * 50), (0, " ".join(shared[:13])),
            (15, " ".join(base) + " and a tail"), (16, None), (17, "two words"), (-5, " ".join(shared[3:20]))]
    return rows


def frame(spark, rows, empty=False):
    """The rows with extra columns whose names the operators use themselves."""
    clash = "tag string, fp int, n_words string, cuts int, row int, no int, found string, score string, block int, key string, ids int, mini int, label int, n_chars bigint, lang string"
    filler = ("t", 1, "n", 2, 3, 4, "f", "s", 5, "k", 6, 7, 8, 9, "en")
    return spark.createDataFrame([] if empty else [(d, t, *filler) for d, t in rows], f"doc_id bigint, text string, {clash}").repartition(3)


def table(name, sf=SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def documents(sf=SF):
    return [(r["doc_id"], r["text"]) for r in table("documents", sf)]


def same(got, want):
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
