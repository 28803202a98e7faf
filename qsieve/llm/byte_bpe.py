"""Byte-level BPE encoding and decoding.

Texts of up to `chunk` characters are encoded where they are.  A longer text is
cut into overlapping chunks that are pre-tokenised in parallel; where the
pre-token starts of two neighbours agree in their overlap the tokenisations
have resynchronised (from a common start on, both split alike), so the text is
stitched at the first such place; the pieces between stitches are then encoded
in parallel and their ids joined in order.  If an overlap has no common start
(one pre-token longer than the overlap), the rest of that text stays one piece.
Decoding concatenates the tokens' raw bytes.

Defined results: null texts encode like empty ones, to no ids; rows stay rows,
whatever their ids; other columns are kept.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import utf8
from .frames import fresh, kept

CHUNK, OVERLAP = 1 << 16, 1 << 12  # characters
AHEAD = 16   # characters past a pre-token that its pattern may look at; starts this close to a chunk's end are not trusted
BATCH = 256  # rows encoded at once
_CODERS: dict[tuple[str, str], tiktoken.Encoding] = {}


def coder(path: str, pattern: str) -> tiktoken.Encoding:
    """The vocabulary of a rank file, read once per Python worker."""
    if (path, pattern) not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _CODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _CODERS[path, pattern]


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, BATCH):
            yield batch.slice(i, BATCH)


def _encode(path: str, pattern: str, column: str, decoded: str | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, raw = coder(path, pattern).encode_ordinary, coder(path, pattern).decode_bytes
        for batch in _portions(batches):
            ids = [code(t) if t else [] for t in batch["text"].to_pylist()]
            new = {column: pa.array(ids, pa.list_(pa.int32()))}
            if decoded:
                new[decoded] = pa.array([raw(x) if x else b"" for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.values()], [*batch.schema.names, *new])

    return run


def _starts(pattern: str, overlap: int):
    """Per chunk: the pre-token starts in its first and its last `overlap`
    characters (less AHEAD) that follow no white space, as places in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = regex.compile(pattern).finditer
        for batch in _portions(batches):
            head, tail = [], []
            for base, text in zip(batch["base"].to_pylist(), batch["piece"].to_pylist()):
                # not behind white space: what ends a piece must not look ahead past it
                at = [a for m in find(text) if (a := m.start()) and not text[a - 1].isspace()]
                head.append([base + a for a in at if a < overlap])
                tail.append([base + a for a in at if len(text) - overlap <= a < len(text) - AHEAD])
            yield pa.RecordBatch.from_arrays([batch["row"], batch["no"], pa.array(head, pa.list_(pa.int32())), pa.array(tail, pa.list_(pa.int32()))], ["row", "no", "head", "tail"])

    return run


def stitched(rows: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(row, no, base, piece) of rows(row, text): pieces that start and end
    where pre-tokens of the whole text do."""
    step = chunk - overlap
    last = F.ceil((F.length("text") - overlap) / step) - 1
    chunks = (rows.select("row", "text", F.explode(F.sequence(F.lit(0), F.greatest(last, F.lit(0)).cast("int"))).alias("no"))
              .select("row", "no", (F.col("no") * step).alias("base"), F.substring("text", F.col("no") * step + 1, F.lit(chunk)).alias("piece")))
    starts = kept(chunks.repartition("row", "no").mapInArrow(_starts(pattern, overlap), "row long, no int, head array<int>, tail array<int>"))
    left = starts.select("row", (F.col("no") + 1).alias("no"), "tail")
    cuts = starts.select("row", "no", "head").join(left, ["row", "no"], "left").select(
        "row", "no", F.when(F.col("no") == 0, 0).otherwise(F.array_min(F.array_intersect("tail", "head"))).alias("cut"))
    # one row per text, with one number per chunk
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("cut", F.lit(-1)).alias("cut")))), lambda x: x["cut"])
    plan = cuts.groupBy("row").agg(ordered.alias("cuts"))
    lost = F.array_position("cuts", -1)
    plan = plan.withColumn("cuts", F.when(lost > 0, F.slice("cuts", F.lit(1), (lost - 1).cast("int"))).otherwise(F.col("cuts")))
    plan = plan.select("row", "cuts", F.posexplode("cuts").alias("no", "base"))
    plan = plan.withColumn("till", F.get("cuts", F.col("no") + 1))
    return (rows.join(plan.drop("cuts"), "row")
            .select("row", "no", "base", F.expr("substring(text, base + 1, coalesce(till, length(text)) - base)").alias("piece")))


def encode(docs: DataFrame, path: str, pattern: str, column: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: str | None = None) -> DataFrame:
    """docs with the token ids of `text` as array<int> `column`; if named, the
    bytes that these ids decode to follow as binary `decoded`, for texts of up
    to `chunk` characters from the worker that encoded them."""
    fields = [*docs.schema.fields, T.StructField(column, T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, T.StructField(decoded, T.BinaryType())] if decoded else fields)
    long_text = F.coalesce(F.length("text") > chunk, F.lit(False))
    short = docs.filter(~long_text).mapInArrow(_encode(path, pattern, column, decoded), schema)
    row = fresh("row", docs)
    rows = kept(docs.filter(long_text).withColumn(row, F.monotonically_increasing_id()))
    pieces = stitched(rows.select(F.col(row).alias("row"), "text"), pattern, chunk, overlap)
    ids = (pieces.repartition("row", "no").select("row", "no", F.col("piece").alias("text"))
           .mapInArrow(_encode(path, pattern, "ids"), "row long, no int, text string, ids array<int>"))
    whole = ids.groupBy(F.col("row").alias(row)).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", "ids"))), lambda x: x["ids"])).alias(column))
    joined = rows.join(whole, row).select(*docs.columns, column)
    return short.unionByName(decode(joined, path, pattern, column, decoded) if decoded else joined)


def _decode(path: str, pattern: str, ids: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = coder(path, pattern).decode_bytes
        for batch in _portions(batches):
            got = pa.array([raw(x) if x else b"" for x in batch[ids].to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, column])

    return run


def decode(coded: DataFrame, path: str, pattern: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """coded with the bytes of its token ids as binary `column`."""
    schema = T.StructType([*coded.schema.fields, T.StructField(column, T.BinaryType())])
    return coded.mapInArrow(_decode(path, pattern, ids, column), schema)
