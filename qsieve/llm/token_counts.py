"""Token counts of a piece vocabulary, with a whole-token shortcut.

Pre-tokens are runs of the space mark and what follows up to the next mark.
`shortcut` proves offline, against the library, which vocabulary strings encode
alone as one token; and that no vocabulary string has a mark after another
character, so that no merge crosses pre-tokens.  A text's pre-tokens are
counted, those strings add their counts directly, and only the rest is merged
by the library (once per worker for frequent ones).

Defined results: null and empty texts have no tokens and no bytes; every row
gives one row; other columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARK = "▁"
MEMO, MEMO_CHARS = 1 << 17, 40  # pre-tokens whose counts a worker keeps, and their longest
_RUN = re.compile(f"{MARK}+[^{MARK}]*")
_COUNTERS: dict[str, "Shortcut"] = {}


class Shortcut:
    """Counts tokens of texts like len(encode(text)) of the library."""

    def __init__(self, path: str):
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_unused(i) or self.sp.is_byte(i))]
        probe = "  a\tb\n  c　ﬁ "
        # else merges could cross pre-tokens, or the text is changed before: count whole texts
        self.split = (not any(MARK in p.lstrip(MARK) for p in plain) and self.sp.normalize(probe) == MARK + probe.replace(" ", MARK))
        starts = [p for p in plain if p.startswith(MARK) and p.lstrip(MARK)]
        self.whole = {p for p, n in zip(starts, self.merged(starts)) if n == 1} if self.split else set()
        self.one = {p[1:] for p in self.whole if not p.startswith(MARK * 2)}
        # the library drops an empty text's mark, so a mark alone is counted behind a letter
        self.memo: dict[str, int] = {MARK: len(self.sp.encode("a ")) - len(self.sp.encode("a"))}

    def merged(self, runs: list[str]) -> list[int]:
        """Token counts of pre-tokens that start with a mark, by the library
        (which puts one mark before a text itself)."""
        return [len(x) for x in self.sp.encode([r[1:].replace(MARK, " ") for r in runs], num_threads=1)] if runs else []

    def _rest(self, counts: dict[str, int]) -> int:
        new, total = [], 0
        for run, n in counts.items():
            have = self.memo.get(run)
            if have is None:
                new.append(run)
            else:
                total += have * n
        for run, n in zip(new, self.merged(new)):
            total += n * counts[run]
            if len(run) <= MEMO_CHARS and len(self.memo) < MEMO:
                self.memo[run] = n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.split:
            return len(self.sp.encode(text))
        if text[0] == " " or text[-1] == " " or "  " in text or MARK in text:
            counts = Counter(_RUN.findall(MARK + text.replace(" ", MARK)))
            direct = sum(n for r, n in counts.items() if r in self.whole)
            return direct + self._rest({r: n for r, n in counts.items() if r not in self.whole})
        counts = Counter(text.split(" "))
        one = self.one
        rest = {MARK + w: n for w, n in counts.items() if w not in one}
        return sum(counts.values()) - sum(rest.values()) + self._rest(rest)


def counter(path: str) -> Shortcut:
    """The vocabulary's counter, made once per Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Shortcut(path)
    return _COUNTERS[path]


def _count(path: str, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            n = pa.array([count(t.as_py()) for t in batch["text"]], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n], [*batch.schema.names, column])

    return run


def count_tokens(docs: DataFrame, path: str, column: str = "n_tokens") -> DataFrame:
    """docs with the number of tokens of `text` as bigint `column`."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.LongType())])
    return docs.mapInArrow(_count(path, column), schema)


def n_bytes() -> F.Column:
    """UTF-8 bytes of `text`, 0 for null."""
    return F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
