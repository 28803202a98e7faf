"""Audit of how filters interact, over every order in which they can run.

Each document has a mask of the filters that it fails.  A mask fixes what
happens at every step of every order: the document is kept, removed here, or
fails after its removal.  All these outcomes are laid out as 64-bit fields of
one big integer per mask (120 orders x 5 steps x 3 outcomes for five filters);
the integers are summed per part and the fields read off the sum.  A field
holds less than 2**64 rows, so none runs over into the next.  Documents of one
part and mask are counted before the shuffle; a part brings at most
2**filters x 4 counts to its sum.

Defined results: a null part is the empty string; a null condition counts as
passed; a label row's null flag is 0, and of several label rows of a doc_id any
that is 1 counts; a null doc_id has no label.  Every input row counts, repeated
ones too; no rows give no parts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh

WIDTH = 8  # bytes of a field
LETTERS = "ABCDE"
SCHEMA = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def text_filters(docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """The five filters of whole texts, as failure conditions by letter, and
    the rows with what the conditions read in place of the text.

    A: under 200 words.  B: under half of the words distinct.  C: over 2% of
    the code points in A-Z.  D: one of # $ % & * | occurs.  E: a smaller
    doc_id has the same text (by SHA-256); a null doc_id is neither smaller
    nor larger."""
    text, digest, facts, first = F.coalesce("text", F.lit("")), fresh("digest", docs), fresh("facts", docs), fresh("first", docs)
    w = words(text)
    rows = docs.withColumn(digest, F.sha2(text, 256)).withColumn(facts, F.struct(
        F.size(w).alias("words"), F.size(F.array_distinct(w)).alias("kinds"), F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long").alias("upper"),
        F.length(text).alias("chars"), text.rlike("[#$%&*|]").alias("odd"))).drop("text")
    # the first doc_id of each text that several rows have; rows of other texts need no partner
    several = rows.groupBy(digest).agg(F.min("doc_id").alias(first), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = rows.join(several, digest, "left")
    f = F.col(facts)
    return rows, {"A": f["words"] < 200, "B": f["kinds"] * 100 < f["words"] * 50, "C": f["upper"] * 100 > f["chars"] * 2, "D": f["odd"], "E": F.col(first) < F.col("doc_id")}


def outcomes(mask: int, letters: str) -> list[list[int]]:
    """For every order and step: [kept after it, removed by it, failing it after an earlier removal]."""
    out = []
    for order in permutations(range(len(letters))):
        gone = False
        for k in order:
            fails = bool(mask >> k & 1)
            out.append([int(not (gone or fails)), int(fails and not gone), int(fails and gone)])
            gone |= fails
    return out


def pack(fields: list[int]) -> int:
    return int.from_bytes(np.array(fields, "<u8").tobytes(), "little")


def unpack(total: int, n: int) -> np.ndarray:
    return np.frombuffer(total.to_bytes(n * WIDTH, "little"), "<u8").astype(np.int64)


def summed(letters: str):
    """mapInArrow body: (part, counts of (code, n)) -> SCHEMA.  A code is the
    mask, then two bits: good, toxic."""
    n, orders = len(letters), ["".join(o) for o in permutations(letters)]
    masks = [outcomes(m, letters) for m in range(1 << n)]
    every = [pack([x for o in m for x in o] + [int(i == 1 << k) for k in range(n)]) for i, m in enumerate(masks)]
    removals = [pack([o[1] for o in m]) for m in masks]
    steps = len(orders) * n
    which = np.array([letters.index(c) for o in orders for c in o])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, counts in zip(batch["part"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                total = good = toxic = 0
                for c in counts:
                    mask, k = c["code"] >> 2, c["n"]
                    total += every[mask] * k
                    good += removals[mask] * (k if c["code"] & 2 else 0)
                    toxic += removals[mask] * (k if c["code"] & 1 else 0)
                fields = unpack(total, 3 * steps + n)
                step, unique = fields[:3 * steps].reshape(steps, 3), fields[3 * steps:]
                share = np.zeros(n, np.int64)
                np.add.at(share, which, step[:, 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * steps, pa.string()), pa.array([o for o in orders for _ in range(n)]), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))),
                     *(pa.array(np.ascontiguousarray(x)) for x in (step[:, 0], step[:, 1], step[:, 2], unique[which], unpack(good, steps), unpack(toxic, steps), share[which]))],
                    ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])

    return run


def filter_audit(rows: DataFrame, labels: DataFrame, filters: dict[str, Column], part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step: SCHEMA.

    filters: failure conditions over rows, by a letter each; rows has doc_id
    and the part column; labels has doc_id, quality, toxic."""
    letters = "".join(sorted(filters))
    if not 1 <= len(letters) <= 6:
        raise ValueError("from one to six filters: the rows are all their orders")
    mask = reduce(lambda a, b: a + b, (F.when(F.coalesce(filters[c], F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(letters)))
    slim = rows.select(F.col("doc_id").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.alias("mask"))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c)
    told = labels.groupBy("doc_id").agg(flag("quality"), flag("toxic")).filter("doc_id is not null and quality + toxic > 0")
    code = F.col("mask") * 4 + F.coalesce("quality", F.lit(0)) * 2 + F.coalesce("toxic", F.lit(0))
    counts = slim.join(told, "doc_id", "left").groupBy("part", code.alias("code")).agg(F.count(F.lit(1)).alias("n"))
    per_part = counts.groupBy("part").agg(F.collect_list(F.struct("code", "n")).alias("counts"))
    return per_part.mapInArrow(summed(letters), SCHEMA)
