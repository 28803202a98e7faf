"""Benchmark decontamination with suffix arrays over the training texts.

Each slice of documents is a shard: its words that occur in the benchmark are
numbered, its suffixes (to the depth of a window, from places whose first
words occur in a row somewhere in the benchmark) are sorted into a suffix
array, and every benchmark suffix is binary-searched in it.  The interval
found is all its verbatim occurrences; neighbouring ones join to the longest
matches with their places, in portions of PAIRS (occurrence, item place) pairs
whose matches are joined again.  Nothing is shuffled and no text leaves its task.

The benchmark goes to the tasks in blocks of up to BLOCK_BYTES of text, one
job over the documents per block, so that what is broadcast is bounded.  Words
are found by hash and compared by their bytes.

Defined results: null texts have no words and hit nothing; items that are null,
empty or without item_id take no part; repeated items count once; every row
gives one result, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import LOWER, U, slices, spread, utf8, word_hashes, words
from .frames import fresh, kept

BLOCK_BYTES = 8 << 20  # benchmark text broadcast at once
PAIRS = 1 << 20        # occurrences times item places held at once (or one occurrence's)
# Fixed by the contract: words are runs of ASCII letters, digits and bytes over 0x7F.
GAP = np.array([not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F) for c in range(256)])
_LOWER = np.frombuffer(LOWER, np.uint8)
MATCH = "array<struct<item_id:string,start:int,item_start:int,n_words:int>>"
FOUND = f"struct<n_words:bigint,n_hit:bigint,items:array<string>,matches:{MATCH}>"


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Lower-cased bytes; each word's start, end, row and hash."""
    data = _LOWER[data]
    s, e, row = words(data, off, GAP)
    return data, s, e, row, word_hashes(data, s, e)


def _same_bytes(a: np.ndarray, a_start: np.ndarray, b: np.ndarray, b_start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a and b hold the same bytes, for runs of the given sizes."""
    out = np.ones(len(size), bool)
    for part in np.split(np.arange(len(size)), np.flatnonzero(np.diff(np.cumsum(size) >> 18)) + 1):
        g, p = spread(size[part])
        g = part[g]
        out[g[a[a_start[g] + p] != b[b_start[g] + p]]] = False
    return out


class Windows:
    """The windows of a block of items: keys of word numbers, and whose they are."""

    def __init__(self, items: list[tuple[str, str]], k: int):
        items = sorted({(i, t) for i, t in items if i is not None and t})
        number: dict[bytes, int] = {}  # words by their bytes; a hash only finds them
        h, ids, row = [], [], []
        for i, j, data, off in slices(utf8(pa.array([t for _, t in items], pa.string()))):
            data, s, e, r, own = _words(data, off)
            view = memoryview(data)
            for a, z, x in zip(s.tolist(), e.tolist(), own.tolist(), strict=True):
                w = view[a:z].tobytes()
                if w not in number:
                    number[w] = len(number) + 1
                    h.append(x)
                ids.append(number[w])
            row.append(r + i)
        ids, row, h = np.array(ids, np.int64), np.concatenate(row or [np.zeros(0, np.int64)]), np.array(h, U)
        every = list(number)
        order = np.argsort(h, kind="stable")
        first = np.append(True, h[order][1:] != h[order][:-1])[:len(h)]
        self.vocab, self.ids = h[order][first], order[first] + 1
        self.twins: dict[int, list[tuple[bytes, int]]] = {}  # other words with a hash of the vocabulary
        for i in order[~first].tolist():
            self.twins.setdefault(int(h[i]), []).append((every[i], i + 1))
        kept_words = [every[i - 1] for i in self.ids.tolist()]
        self.bytes, self.size = np.frombuffer(b"".join(kept_words), np.uint8), np.array([len(w) for w in kept_words], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        have = np.bincount(row, minlength=len(items))
        self.k, self.names = k, np.array([i for i, _ in items], object)
        first = np.searchsorted(row, np.arange(len(items)))
        size = np.minimum(have, k)
        item, start = spread(np.where(have > 0, have - size + 1, 0))
        begin, size = first[item] + start, size[item]
        self.gram = int(min(3, size.min())) if len(size) else 0
        key = np.zeros((len(begin), k), ">u4")
        for c in range(k):
            live = size > c
            key[live, c] = ids[begin[live] + c]
        names, which = np.unique(key.view(f"S{4 * k}").ravel(), return_inverse=True) if len(key) else (key.view(f"S{4 * k}").ravel(), np.zeros(0, np.int64))
        order = np.argsort(which, kind="stable")
        self.low = names
        self.owner_at = np.searchsorted(which[order], np.arange(len(names) + 1))
        self.owner, self.owner_start = item[order], start[order]
        length = np.zeros(len(names), np.int64)
        length[which] = size
        self.length = length
        raw = np.frombuffer(names.tobytes(), np.uint8).reshape(len(names), -1).copy() if len(names) else np.zeros((0, 4 * k), np.uint8)
        raw[np.arange(4 * k)[None, :] >= 4 * length[:, None]] = 255
        self.high = raw.reshape(-1).view(f"S{4 * k}") if len(names) else names
        self.heads = np.unique(self.heading(key.astype(np.int64))) if len(key) else np.zeros(0, np.int64)

    def numbers(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Numbers of words in the vocabulary, 0 for others: found by hash, compared by bytes."""
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        out = np.zeros(len(h), np.int64)
        found = np.flatnonzero((self.vocab[at] == h) & (self.size[at] == e - s))
        same = found[_same_bytes(data, s[found], self.bytes, self.begin[at[found]], self.size[at[found]])]
        out[same] = self.ids[at[same]]
        if self.twins:
            for i in np.flatnonzero(np.isin(h, np.array(list(self.twins), U)) & (out == 0)).tolist():
                out[i] = dict(self.twins[int(h[i])]).get(data[s[i]:e[i]].tobytes(), 0)
        return out

    def heading(self, ids: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        for c in range(self.gram):
            out = out * (1 << 21) + ids[:, c]
        return out


def _shard(bench: Windows, data: np.ndarray, off: np.ndarray):
    """Words per row, and verbatim matches (row, start, item, item_start, size)."""
    rows, k = len(off) - 1, bench.k
    data, s, e, row, h = _words(data, off)
    total = np.bincount(row, minlength=rows)
    none = np.zeros((0, 5), np.int64)
    if not len(h) or not len(bench.low):
        return total, none
    ids = np.concatenate([bench.numbers(data, s, e, h), np.zeros(k, np.int64)])
    end = np.concatenate([row, np.full(k, -1)])
    place = np.flatnonzero(ids[:-k])
    code = np.zeros(len(place), np.int64)
    for c in range(bench.gram):
        code = code * (1 << 21) + np.where(end[place + c] == row[place], ids[place + c], 0)
    i = np.minimum(np.searchsorted(bench.heads, code), len(bench.heads) - 1)
    place = place[bench.heads[i] == code]
    if not len(place):
        return total, none
    suffix = np.zeros((len(place), k), ">u4")
    alive = np.ones(len(place), bool)
    for c in range(k):
        alive &= (end[place + c] == row[place]) & (ids[place + c] > 0)
        suffix[alive, c] = ids[place[alive] + c]
    suffix = suffix.view(f"S{4 * k}").ravel()
    order = np.argsort(suffix, kind="stable")
    array = suffix[order]
    lo, hi = np.searchsorted(array, bench.low, "left"), np.searchsorted(array, bench.high, "right")
    window, i = spread(hi - lo)
    if not len(window):
        return total, none
    start = place[order[lo[window] + i]]
    order = np.argsort(start, kind="stable")
    start, window = start[order], window[order]
    owners = np.diff(bench.owner_at)[window]
    parts = []
    for part in np.split(np.arange(len(start)), np.flatnonzero(np.diff(np.cumsum(owners) // PAIRS)) + 1):
        pair, j = spread(owners[part])
        pair = part[pair]
        own = bench.owner_at[window[pair]] + j
        parts.append(_joined(row, start[pair], start[pair], start[pair] + bench.length[window[pair]], bench.owner[own], bench.owner_start[own]))
    start, _, till, item, item_start = _joined(row, *(np.concatenate(x) for x in zip(*parts))) if len(parts) > 1 else parts[0]
    r, base = row[start], np.searchsorted(row, np.arange(rows))
    return total, np.stack([r, start - base[r], item, item_start, till - start], axis=1)


def _joined(row: np.ndarray, start: np.ndarray, last: np.ndarray, till: np.ndarray, item: np.ndarray, item_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """Matches (first window, last window, end, item, item_start) with
    neighbouring ones joined, sorted by row, item, shift and start."""
    order = np.lexsort((start, start - item_start, item, row[start]))
    start, last, till, item, item_start = (x[order] for x in (start, last, till, item, item_start))
    r, shift = row[start], start - item_start
    new = np.append(True, (r[1:] != r[:-1]) | (item[1:] != item[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > last[:-1] + 1))
    b = np.flatnonzero(new)
    e = np.append(b[1:], len(start)) - 1
    return start[b], last[e], till[e], item[b], item_start[b]


def _summary(total: int, found: list[dict]) -> dict:
    hit = np.zeros(total + 1, np.int64)
    for x in found:
        hit[x["start"]] += 1
        hit[x["start"] + x["n_words"]] -= 1
    return {"n_words": total, "n_hit": int((np.cumsum(hit) > 0).sum()) if found else 0, "items": sorted({x["item_id"] for x in found}), "matches": found}


def _search(bench: Broadcast, column: str):
    """mapInArrow body: adds the block's matches as `column`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = bench.value
        for batch in batches:
            found = []
            for i, j, data, off in slices(utf8(batch["text"])):
                total, match = _shard(block, data, off)
                cut = np.searchsorted(match[:, 0], np.arange(j - i + 1))
                for r in range(j - i):
                    found.append(_summary(int(total[r]), [{"item_id": str(block.names[x[2]]), "start": int(x[1]), "item_start": int(x[3]), "n_words": int(x[4])} for x in match[cut[r]:cut[r + 1]]]))
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("item_start", pa.int32()), ("n_words", pa.int32())])))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, column])

    return run


def _blocks(spark: SparkSession, items: DataFrame, k: int, blocks: int) -> Iterator[Broadcast]:
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        yield spark.sparkContext.broadcast(Windows([tuple(r) for r in rows.collect()], k))


def _merged(column: str):
    """mapInArrow body: the blocks' findings about a text, `column`, as one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("matches", batch[column].type.value_type.field("matches").type)])
            at = batch.schema.names.index(column)
            found = [_summary(x[0]["n_words"], [m for y in x for m in y["matches"]]) if x else None for x in batch[column].to_pylist()]
            yield batch.set_column(at, column, pa.array(found, kind))

    return run


def matches(docs: DataFrame, benchmark: DataFrame, column: str, k: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct `column`: n_words, n_hit, items (ids with occurring
    windows, sorted as strings) and the longest verbatim matches.

    A benchmark of several blocks: each block's findings on the distinct texts
    that it hits are written before the next block is read; at the end they
    are joined to the rows by 256 bits of the texts' SHA-2."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    found = T.StructField(column, T._parse_datatype_string(FOUND))
    if blocks == 1:
        return docs.mapInArrow(_search(next(_blocks(spark, items, k, 1)), column), T.StructType([*docs.schema.fields, found]))
    key, text = fresh("text_key", docs), F.coalesce("text", F.lit(""))
    keyed = docs.withColumn(key, F.sha2(text, 256))
    slim = keyed.select(key, "text")
    parts = []
    for i, bench in enumerate(_blocks(spark, items, k, blocks)):
        told = slim.mapInArrow(_search(bench, column), T.StructType([*slim.schema.fields, found]))
        told = told.select(key, column) if i == 0 else told.filter(F.size(F.col(column)["items"]) > 0).select(key, column)
        parts.append(kept(told.dropDuplicates([key])))
        bench.destroy()
    per_text = reduce(DataFrame.unionByName, parts).groupBy(key).agg(F.collect_list(column).alias(column))
    whole = T.StructType([T.StructField(key, T.StringType()), found])
    return keyed.join(per_text.mapInArrow(_merged(column), whole), key).select(*docs.columns, column)


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = 13) -> DataFrame:
    """docs without those of which at least a twentieth of the words is hit."""
    found = fresh("found", docs)
    hit, total = F.col(f"{found}.n_hit"), F.col(f"{found}.n_words")
    return matches(docs, benchmark, found, k).filter((hit == 0) | (hit * 20 < total)).drop(found)
