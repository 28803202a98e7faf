"""Substring de-duplication by De Bruijn compaction.

The graph: nodes are runs of k-1 words, edges are runs of k words (k = 13).
An edge is repeated if it occurs in several documents; its source is its
first occurrence (smallest doc_id, then place).

1. Edges are dealt out by minimiser: every k-word window goes to the smallest
   hash of its 3-word runs, so that windows in a row travel as one row with
   one key (a super-k-mer) and equal windows of all documents meet.  Equal
   super-k-mers of a task's slice travel as one row with a list of places,
   which thins out a passage that a third of all documents share.
2. Rows arrive sorted by minimiser and place; a streaming merge looks up each
   edge's source and emits the places that repeat a smaller document's edge.
   It holds the distinct edges of one minimiser, not its rows.
3. Neighbouring edges whose sources are neighbours too are a nonbranching
   path seen from that place; they compact to one row.
4. Source coordinates verify paths: both ends of each path fetch the words at
   their coordinates, and joins compare digests of them.  A path that fails is
   verified window by window, so a hash collision never removes a word.

Defined results: null texts have no words; a null doc_id takes no part (its
row keeps all words); rows that repeat a doc_id never remove words of each
other; a document of under k words keeps all; every input row gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import BASE_WORD, SPACE, U, binaries, binary_parts, gram_hashes, mix, range_hashes, slices, spread, utf8, word_hashes, words
from .frames import kept

EDGE_BYTES = 5  # of an edge's hash that travel, besides its minimiser's 8
GRAM = 3        # words of a minimiser
LONGEST = 64    # windows of one super-k-mer row
CELLS = 1 << 20  # places worked on at once
PLACE = 1 << 32  # a place: the tag that tells texts of one doc_id apart, then the word number
TAGS = (1 << 31) - 1  # the largest tag
SALTS = 64


def _row_tag(salt: int = 0) -> F.Column:
    return F.xxhash64(F.lit(salt), F.coalesce("text", F.lit(""))).bitwiseAND(TAGS).cast("long")


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text): different texts of one doc_id have different tags.
    Only doc_ids that occur again are looked at; a salt under which two of
    their texts agree is passed over."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    again = kept(docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id"))
    shared = not again.isEmpty()
    for salt in range(SALTS):
        out = docs.select("doc_id", _row_tag(salt).alias("tag"), "text")
        digest = F.sha2(F.coalesce("text", F.lit("")), 256)
        if not shared or out.join(again, "doc_id").groupBy("doc_id", "tag").agg(F.min(digest).alias("a"), F.max(digest).alias("b")).filter("a <> b").isEmpty():
            return out
    raise ValueError(f"some doc_id has more different texts than {SALTS} ways of tagging can tell apart")


def super_kmers(k: int):
    """mapInArrow body: (doc_id, tag, text) -> (mini, places, edges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch["doc_id"].to_numpy(zero_copy_only=False), batch["tag"].to_numpy(zero_copy_only=False)
            for i, j, data, off in slices(utf8(batch["text"])):
                s, e, row = words(data, off, SPACE)
                if len(s) < k:
                    continue
                h = word_hashes(data, s, e)
                edge = gram_hashes(h, k)
                low = gram_hashes(h, GRAM)
                width, have = k - GRAM + 1, 1
                while have * 2 <= width:
                    low = np.minimum(low[:-have], low[have:])
                    have *= 2
                if width > have:
                    low = np.minimum(low[:len(low) - (width - have)], low[width - have:])
                n = len(edge)
                at = np.arange(n) - np.searchsorted(row, row[:n])
                ok = row[:n] == row[k - 1:]
                fresh = np.ones(n, bool)
                fresh[1:] = (low[1:n] != low[:n - 1]) | (row[1:n] != row[:n - 1]) | ~ok[:-1]
                w = np.flatnonzero(ok)
                if not len(w):
                    continue
                head = np.flatnonzero(fresh[w])
                place = np.arange(len(w)) - np.repeat(head, np.diff(np.append(head, len(w))))
                head = np.flatnonzero(place % LONGEST == 0)
                size = np.diff(np.append(head, len(w)))
                first, last = w[head], w[head] + size - 1
                same = mix(low[first] ^ range_hashes(edge, first, last + 1, BASE_WORD))  # every edge: long runs can differ in the middle only
                doc, where = ids[i:j][row[first]], tags[i:j][row[first]] * PLACE + at[first]
                order = np.lexsort((where, doc, same))
                group = np.flatnonzero(np.append(True, same[order][1:] != same[order][:-1]))
                rep = order[group]
                count = np.diff(np.append(group, len(order)))
                places = np.empty((len(order), 2), ">u8")
                places[:, 0] = doc[order].astype(np.int64).view(U) ^ U(1 << 63)
                places[:, 1] = where[order]
                g, p = spread(size[rep])
                sent = edge[first[rep][g] + p].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :EDGE_BYTES]
                yield pa.RecordBatch.from_arrays([
                    pa.array(low[first[rep]].view(np.int64)),
                    binaries(places.view(np.uint8).ravel(), np.append(0, np.cumsum(count * 16))),
                    binaries(sent.ravel(), np.append(0, np.cumsum(size[rep] * EDGE_BYTES)))], ["mini", "places", "edges"])

    return run


def repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mapInArrow body over rows sorted by (mini, places): runs of windows that
    also start in a smaller document, with the source of each."""
    held_mini, held = None, (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for batch in batches:
        if not batch.num_rows:
            continue
        mini = batch["mini"].to_numpy()
        raw, off = binary_parts(batch["places"])
        occ = raw.reshape(-1, 16).copy().view(">u8").astype(U)
        doc_of, at_of = (occ[:, 0] ^ U(1 << 63)).view(np.int64), occ[:, 1].astype(np.int64)
        n_occ, first = np.diff(off) // 16, off[:-1] // 16
        raw, off = binary_parts(batch["edges"])
        edge = np.zeros((len(raw) // EDGE_BYTES, 8), np.uint8)
        edge[:, :EDGE_BYTES] = raw.reshape(-1, EDGE_BYTES)
        n_edge, first_edge = np.diff(off) // EDGE_BYTES, off[:-1] // EDGE_BYTES
        row, place = spread(n_edge)
        key = mix(edge.view("<u8").ravel().astype(U) ^ mix(mini.view(U))[row])
        doc, at = doc_of[first][row], at_of[first][row] + place
        if held_mini == mini[0]:
            key, doc, at = (np.concatenate(x) for x in zip(held, (key, doc, at)))
        before = len(key) - len(row)
        _, source, which = np.unique(key, return_index=True, return_inverse=True)
        source = source[which]
        again = source[before:] != np.arange(before, len(key))
        last = np.concatenate([np.full(before, mini[0] == mini[-1]), (mini[row] == mini[-1]) & ~again])
        held_mini, held = mini[-1], (key[last], doc[last], at[last])
        src_doc, src_at = doc[source][before:], at[source][before:]
        want = n_occ > 1
        want[row[again]] = True
        rows = np.flatnonzero(want)
        cost = np.cumsum(n_occ[rows] * n_edge[rows])
        for part in np.split(rows, np.flatnonzero(np.diff(cost // CELLS)) + 1):
            if not len(part):
                continue
            g, p = spread(n_occ[part])
            r, o = part[g], first[part[g]] + p
            c, q = spread(n_edge[r])
            e = first_edge[r][c] + q
            d, a, sd, sa = doc_of[o][c], at_of[o][c] + q, src_doc[e], src_at[e]
            hit = d > sd
            start = hit.copy()
            start[1:] &= ~hit[:-1] | (c[1:] != c[:-1]) | (sd[1:] != sd[:-1]) | (sa[1:] != sa[:-1] + 1)
            b = np.flatnonzero(start)
            if len(b):
                n = np.bincount(np.cumsum(start)[hit] - 1, minlength=len(b))
                yield pa.RecordBatch.from_arrays([pa.array(d[b]), pa.array(a[b]), pa.array(n.astype(np.int32)), pa.array(sd[b]), pa.array(sa[b])],
                                                 ["doc_id", "at", "n", "src_doc", "src_at"])


def compact(spans: DataFrame) -> DataFrame:
    """Neighbouring windows of one document with neighbouring sources in one
    document: one path.  A group is bounded by a document's length."""
    w = Window.partitionBy("doc_id", "src_doc", "shift").orderBy("at")
    x = spans.repartition("doc_id").withColumn("shift", F.col("at") - F.col("src_at"))
    x = x.withColumn("reach", F.max(F.col("at") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    x = x.withColumn("path", F.sum(F.when(F.col("at") <= F.col("reach"), 0).otherwise(1)).over(w))
    return (x.groupBy("doc_id", "src_doc", "shift", "path").agg(F.min("at").alias("at"), F.max(F.col("at") + F.col("n")).alias("till"))
            .select("doc_id", "at", (F.col("till") - F.col("at")).cast("int").alias("n"), "src_doc", (F.col("at") - F.col("shift")).alias("src_at")))


def _joined(text: str | None) -> tuple[list[bytes], bytes, np.ndarray]:
    w = (text or "").encode().split()
    return w, b" ".join(w), np.append(0, np.cumsum([len(x) + 1 for x in w], dtype=np.int64))


def _digests(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tag, text, asks in zip(*(batch[c] for c in ("doc_id", "tag", "text", "asks"))):
                _, line, off = _joined(text.as_py())
                asks, doc, tag = asks.as_py(), doc.as_py(), tag.as_py()
                got = [xxhash.xxh3_128_digest(line[off[x["start"]]:off[x["start"] + x["n"] + k - 1] - 1]) for x in asks]
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc] * len(asks), pa.int64()), pa.array([tag * PLACE + x["start"] for x in asks], pa.int64()),
                    pa.array([x["n"] for x in asks], pa.int32()), pa.array(got, pa.binary())], ["doc_id", "at", "n", "digest"])

    return run


def _by_document(asks: DataFrame, name: str) -> DataFrame:
    """(doc_id, at, n) as one row per document: bounded by its length."""
    return (asks.select("doc_id", F.shiftright("at", 32).alias("tag"), F.struct(F.pmod("at", F.lit(PLACE)).cast("int").alias("start"), "n").alias("ask"))
            .groupBy("doc_id", "tag").agg(F.collect_list("ask").alias(name)))


def verify(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """paths with `same`: whether the words at both coordinates are equal."""
    own, src = paths.select("doc_id", "at", "n"), paths.select(F.col("src_doc").alias("doc_id"), F.col("src_at").alias("at"), "n")
    asks = _by_document(own.union(src).distinct(), "asks")
    got = kept(docs.join(asks, ["doc_id", "tag"]).select("doc_id", "tag", "text", "asks")
               .mapInArrow(_digests(k), "doc_id long, at long, n int, digest binary").distinct())
    there = got.select(F.col("doc_id").alias("src_doc"), F.col("at").alias("src_at"), "n", F.col("digest").alias("src_digest"))
    return kept(paths.join(got, ["doc_id", "at", "n"]).join(there, ["src_doc", "src_at", "n"])
                .select("doc_id", "at", "n", "src_doc", "src_at", (F.col("digest") == F.col("src_digest")).alias("same")))


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, sha, texts = [], [], [], []
            for text, cuts in zip(batch["text"].to_pylist(), batch["cuts"].to_pylist()):
                w = (text or "").encode().split()
                total.append(len(w))
                if cuts:
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, [x["start"] for x in cuts], 1)
                    np.add.at(edge, [x["start"] + x["n"] + k - 1 for x in cuts], -1)
                    w = list(compress(w, np.cumsum(edge[:-1]) == 0))
                gone.append(total[-1] - len(w))
                line = b" ".join(w)
                sha.append(hashlib.sha256(line).hexdigest())
                texts.append(line)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()),
                                              pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def repeated_paths(docs: DataFrame, k: int = 13) -> DataFrame:
    """Verified repeated paths: (doc_id, at, n windows, src_doc, src_at), where
    at = row tag * 2**32 + word number."""
    return _paths(tagged(docs), k)


def _paths(docs: DataFrame, k: int) -> DataFrame:
    rows = (docs.filter("doc_id IS NOT NULL").mapInArrow(super_kmers(k), "mini long, places binary, edges binary")
            .repartition("mini").sortWithinPartitions("mini", "places"))
    paths = kept(compact(rows.mapInArrow(repeats, "doc_id long, at long, n int, src_doc long, src_at long")))
    told = verify(docs, paths, k)
    good, bad = told.filter("same"), told.filter("NOT same")
    if not bad.isEmpty():
        single = bad.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "at", "src_doc", "src_at")
        good = good.union(verify(docs, single.select("doc_id", (F.col("at") + F.col("i")).alias("at"), F.lit(1).alias("n"), "src_doc", (F.col("src_at") + F.col("i")).alias("src_at")).distinct(), k).filter("same"))
    return good.drop("same")


def substring_dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, n_words, n_removed, kept_sha256
    and kept_text (the words that stay, joined by one space)."""
    docs = tagged(docs)
    cuts = _by_document(_paths(docs, k).select("doc_id", "at", "n"), "cuts")
    return docs.join(cuts, ["doc_id", "tag"], "left").select("doc_id", "text", "cuts").mapInArrow(
        _cut(k), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
