"""SimHash near-duplicates, linked through BK-trees.

Fingerprints: a bit is 1 if it is set in over half of a document's shingle
hashes.  Linking looks only at distinct fingerprints, so exact copies cost one
row however many there are.

BK-trees: a shard's tree has children keyed by their integer Hamming distance
to the parent; a query follows only edges within the radius of its own
distance.  Shards are the fingerprints that agree in one of radius + 1 bit
blocks (two fingerprints within the radius agree in at least one), so a
fingerprint visits radius + 1 shard trees instead of all of them, and trees
travel by shuffle: broadcasting every shard tree would pass all fingerprints
through the driver.  A shard beyond SHARD members is split into salted trees
and its queries visit each of them; nothing is capped.

Within a task links are united as they are found, so a dense group yields a
spanning set of links, not all its pairs.  Components follow by Spark joins.

Defined results: null and empty texts have no words and fingerprint zero,
linked like any other; repeated rows are rows of one component; a null doc_id
is linked but never names a component (null if it has no other).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, SPACE, U, slices, spread, utf8, words
from .components import components
from .frames import fresh, kept, salted
from .xxh64 import xxh64_ranges

SHARD = 4096        # fingerprints of one tree
FRONTIER = 1 << 20  # (query, node) pairs looked at at once
_LOWER = np.frombuffer(LOWER, np.uint8)
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)


def slice_fingerprints(data: np.ndarray, off: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (n-word shingles) of a slice's rows."""
    rows = len(off) - 1
    s, e, row = words(data, off, SPACE)
    if not len(s):
        return np.zeros(rows, U)
    size = e - s
    place = np.cumsum(size + 1) - (size + 1)
    word, i = spread(size)
    line = np.full(int((size + 1).sum()), 0x20, np.uint8)
    line[place[word] + i] = _LOWER[data[s[word] + i]]
    have = np.bincount(row, minlength=rows)
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    short = first[have[row[first]] < n]
    full = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
    begin = np.concatenate([full, short])
    until = np.concatenate([full + n - 1, short + have[row[short]] - 1])
    owner = row[begin]
    h = xxh64_ranges(line, place[begin], place[until] + size[until], 42)
    each = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)
    total = np.bincount(owner, minlength=rows)
    out = np.zeros(rows, U)
    for b in range(8):
        count = np.bincount(owner * 256 + each[:, b], minlength=rows * 256).reshape(rows, 256) @ _BITS
        out |= ((count * 2 > total[:, None]).astype(U) << np.arange(8, dtype=U)).sum(axis=1, dtype=U) << U(8 * b)
    return out


def _fingerprint_batches(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [slice_fingerprints(data, off, n) for _, _, data, off in slices(utf8(batch["text"]), 1 << 20)]
            fp = np.concatenate(got) if got else np.zeros(0, U)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["tag"], pa.array(fp.view(np.int64))], ["doc_id", "tag", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, tag, fp): tag tells rows of one doc_id apart by their text."""
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text")
            .mapInArrow(_fingerprint_batches(shingle), "doc_id long, tag long, fp long"))


class Forest:
    """BK-trees of several groups in flat arrays."""

    def __init__(self, fps: np.ndarray, group: np.ndarray):
        """group: ascending; the first fingerprint of a group is its root."""
        self.fps, self.groups = fps, group[np.append(True, group[1:] != group[:-1])]
        self.roots = np.searchsorted(group, self.groups)
        node = self.roots[np.searchsorted(self.groups, group)]
        todo = np.setdiff1d(np.arange(len(fps)), self.roots)
        keys, children = [], []
        while len(todo):  # one level of all trees at a time
            d = np.bitwise_count(fps[todo] ^ fps[node[todo]]).astype(np.int64)
            todo, d = todo[d > 0], d[d > 0]
            slot, first, which = np.unique(node[todo] * 65 + d, return_index=True, return_inverse=True)
            keys.append(slot)
            children.append(todo[first])
            node[todo] = todo[first][which]
            rest = np.ones(len(todo), bool)
            rest[first] = False
            todo = todo[rest]
        key, child = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (keys, children))
        order = np.argsort(key)
        self.key, self.child = key[order], child[order]

    def near(self, fps: np.ndarray, group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, member) index pairs within the radius, in portions."""
        if not len(self.groups):
            return
        g = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        have = np.flatnonzero(self.groups[g] == group)
        stack = [(have, self.roots[g[have]])]
        while stack:
            query, node = stack.pop()
            if len(query) > FRONTIER:
                half = len(query) // 2
                stack += [(query[:half], node[:half]), (query[half:], node[half:])]
                continue
            d = np.bitwise_count(fps[query] ^ self.fps[node]).astype(np.int64)
            if (hit := d <= radius).any():
                yield query[hit], node[hit]
            if not len(self.key):
                continue
            more = []
            for edge in range(-radius, radius + 1):
                key = node * 65 + np.clip(d + edge, 0, 64)
                i = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                ok = (self.key[i] == key) & (d + edge > 0) & (d + edge <= 64)
                more.append((query[ok], self.child[i[ok]]))
            query, node = (np.concatenate(x) for x in zip(*more))
            if len(query):
                stack.append((query, node))


def unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Join the sets of x and y; label holds each element's smallest member."""
    while True:
        a, b = label[x], label[y]
        live = a != b
        if not live.any():
            return
        x, y, a, b = x[live], y[live], a[live], b[live]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]


def _link_batches(radius: int):
    """Rows sorted by (bucket, salt, role): members (role 0), then queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, np.int64) for c in ("bucket", "salt", "role", "fp")}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = {c: np.concatenate([held[c], batch[c].to_numpy().astype(np.int64)]) for c in held}
            group = np.cumsum(np.append(True, (x["bucket"][1:] != x["bucket"][:-1]) | (x["salt"][1:] != x["salt"][:-1])))
            m, q = x["role"] == 0, x["role"] == 1
            held = {c: v[m & (group == group[-1])] for c, v in x.items()}
            forest = Forest(x["fp"][m].view(U), group[m])
            names, ident = np.unique(x["fp"], return_inverse=True)
            label, asked, there = np.arange(len(names)), ident[q], ident[m]
            for i, j in forest.near(x["fp"][q].view(U), group[q], radius):
                unite(label, asked[i], there[j])
            linked = np.flatnonzero(label != np.arange(len(names)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(names[linked]), pa.array(names[label[linked]])], ["a", "b"])

    return run


def links(distinct: DataFrame, radius: int = 3, shard: int = SHARD) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose reachability
    equals that of all pairs within the radius."""
    cut = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    key = F.array(*[F.shiftrightunsigned("fp", a).bitwiseAND((1 << (b - a)) - 1 if b - a < 64 else -1) + F.lit(i << 33) for i, (a, b) in enumerate(zip(cut, cut[1:]))])
    rows = salted(distinct.select("fp", F.explode(key).alias("bucket")), ["bucket"], shard, "fp")
    part = F.concat(F.array(F.struct("salt", F.lit(0).alias("role"))),
                    F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda i: F.struct(i.alias("salt"), F.lit(1).alias("role"))))
    rows = rows.select("bucket", "fp", F.explode(part).alias("p")).select("bucket", F.col("p.salt").alias("salt"), F.col("p.role").alias("role"), "fp")
    return (rows.repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "role", "fp")
            .mapInArrow(_link_batches(radius), "a long, b long").distinct())


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, tag, fp, root (one per component)
    and component_id (its smallest doc_id)."""
    fps = kept(fingerprints(docs, shingle))
    distinct = kept(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(classes.select("fp", "root").join(named, "root"), "fp").select("doc_id", "tag", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id (rows
    without doc_id come last)."""
    found = simhash_components(docs, shingle, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "tag")).alias("row")).select("row.doc_id", "row.tag")
    mine, tag = docs.columns, fresh("text_tag", docs)
    one = docs.withColumn(tag, F.xxhash64("text")).alias("d").join(
        kept(first).alias("k"), F.col("d.doc_id").cast("long").eqNullSafe(F.col("k.doc_id")) & (F.col(f"d.{tag}") == F.col("k.tag")), "left_semi")
    return one.dropDuplicates(["doc_id", tag]).select(*mine)
