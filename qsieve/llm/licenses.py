"""License scan: MinHash bands over overlapping text windows.

Templates are short notices or whole licences.  A text's words (lower-cased
A-Z, punctuation around words left off) form 5-word shingles.  For each size
class of templates the text is covered by windows of the class's length that
overlap by three quarters; a window's MinHash values are minima over its four
quarter blocks.  A window that agrees with a template in a band retrieves it.
Bands have one row: a window whose similarity to the template is s agrees in at
least one of BANDS bands with probability 1 - (1 - s)**BANDS.  A text that
holds 0.8 of a template's shingles in a stretch of about its length has a
window with s of at least 0.4, so it is retrieved with probability over
1 - 10**-7 at 32 bands.  For a size class, rows with fewer of its templates'
shingles than 0.8 of its smallest template are passed over before (they cannot
hold 0.8 of any).  Retrieved stretches are verified exactly: the share
of the template's shingles that the stretch around the window holds must be
0.8 or more.

Defined results: null and empty texts match nothing; a text or template of
under five words has one shingle, all its words; repeated templates (same name)
keep their best containment; every row gives one row, other columns are kept.

Covered by NOTICES: the whole texts of license_texts.py ("... text"), headers
that licences ask for ("... header"), and sentences that name a licence.  Texts
of one family share most shingles: a BSD-3-Clause text also holds 0.8 of
BSD-2-Clause, an LGPL header of the GPL header; all are listed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrays import BASE_WORD, LOWER, U, mix, range_hashes, slices, utf8, word_hashes, words
from .license_texts import TEXTS

SHINGLE, LEAST, BANDS = 5, 0.8, 32
TEMPLATE_BYTES = 16 << 20  # templates sent to the tasks: their proven bound
FOUND = "array<struct<license:string,containment:double,start:int,n_words:int>>"
_LOWER = np.frombuffer(LOWER, np.uint8)
#: Words are runs of ASCII letters, digits, '.', '-' and bytes over 0x7F; a final '.' is left off.
GAP = np.array([not (0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c > 0x7F or c in (0x2D, 0x2E)) for c in range(256)])
_SEEDS = mix(np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15))

# Short notices; "Apache-2.0", "MIT", "GPL-3.0" and "CC-BY-NC-4.0" are worded as in the test tables.
_SHORT = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
}
# Headers and notices that the licences or their stewards ask for.
_HEADERS = {
    "LGPL header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL program header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "AGPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "GFDL header": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "MPL-2.0 header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0 header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "EUPL-1.2 header": "Licensed under the EUPL, Version 1.2",
    "BSL-1.0 header": "Distributed under the Boost Software License, Version 1.0.",
    "OFL-1.1 header": "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
}
_LEADS = ("licensed under the", "released under the", "distributed under the", "available under the", "under the terms of the")
_NAMED = {
    "MIT": "MIT License", "Apache": "Apache License", "BSD": "BSD License", "ISC": "ISC License", "GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License",
    "AGPL": "GNU Affero General Public License", "MPL": "Mozilla Public License", "EPL": "Eclipse Public License", "GFDL": "GNU Free Documentation License",
}
_COMMONS = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
NOTICES = {f"{n} notice: {lead}": f"{lead} {name}" for n, name in _NAMED.items() for lead in _LEADS}
NOTICES |= {f"CC-{n}-4.0 notice": f"This work is licensed under a Creative Commons {name} 4.0 International License" for n, name in _COMMONS.items()}
NOTICES |= {f"CC-{n}-3.0 notice": f"This work is licensed under a Creative Commons {name.replace('NoDerivatives', 'NoDerivs')} 3.0 Unported License" for n, name in _COMMONS.items()}
NOTICES |= {f"CC-{n}-4.0 short": f"Licensed under CC {n} 4.0" for n in _COMMONS}
NOTICES |= _HEADERS | {f"{n} text": t for n, t in TEXTS.items()} | _SHORT


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes with their rows and first words, and words per row."""
    data = _LOWER[data]
    s, e, row = words(data, off, GAP)
    if len(e):
        e = e - (data[e - 1] == 0x2E)
        solid = e > s
        s, e, row = s[solid], e[solid], row[solid]
    have = np.bincount(row, minlength=len(off) - 1)
    if not len(s):
        return np.zeros(0, U), row, row, have
    h, n = word_hashes(data, s, e), SHINGLE
    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    short = first[have[row[first]] < n]
    full = np.flatnonzero(row[:len(row) - n + 1] == row[n - 1:]) if len(row) >= n else np.zeros(0, np.int64)
    begin = np.sort(np.concatenate([full, short]))
    size = np.minimum(have[row[begin]], n)
    return range_hashes(h, begin, begin + size, BASE_WORD), row[begin], begin - first[np.searchsorted(row[first], row[begin])], have


class Templates:
    """Shingle sets and MinHash values of the templates, by size class."""

    def __init__(self, texts: dict[str, str]):
        if sum(len(t.encode()) for t in texts.values()) > TEMPLATE_BYTES:
            raise ValueError("templates over TEMPLATE_BYTES: scan them in several calls")
        self.names, self.sets, self.classes = [], [], {}
        for name, text in sorted(texts.items()):
            col = utf8(pa.array([text], pa.string()))
            for _, _, data, off in slices(col, 1 << 62):
                h = np.unique(shingles(data, off)[0])
                if len(h):
                    size = 1 << int(np.ceil(np.log2(len(h))))
                    self.classes.setdefault(size, []).append(len(self.names))
                    self.names.append(name)
                    self.sets.append(h)
        self.known = np.unique(np.concatenate(self.sets or [np.zeros(0, U)]))
        self.of_class = {size: (np.unique(np.concatenate([self.sets[m] for m in members])), min(len(self.sets[m]) for m in members)) for size, members in self.classes.items()}
        self.minima = [np.array([mix(h ^ s).min() for s in _SEEDS]) for h in self.sets]
        self.bands = {}
        for size, members in self.classes.items():
            # of a class, the sorted values of each band and whose they are
            values = np.array([self.minima[t] for t in members])
            order = np.argsort(values, axis=0, kind="stable")
            self.bands[size] = [(values[order[:, b], b], np.array(members)[order[:, b]]) for b in range(BANDS)]


def scan_slice(t: Templates, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
    """(row, template, containment, first word, words) verified in a slice."""
    h, row, at, have = shingles(data, off)
    found: dict[tuple[int, int], tuple[float, int, int]] = {}
    if not len(h) or not len(t.known):
        return []
    shared = t.known[np.minimum(np.searchsorted(t.known, h), len(t.known) - 1)] == h
    live = np.bincount(row[shared], minlength=len(off))[row] > 0
    all_h, all_row, all_at, shared = h[live], row[live], at[live], shared[live]
    for size, bands in t.bands.items():
        known, least = t.of_class[size]
        its = all_row[shared][np.isin(all_h[shared], known)]
        live = (np.bincount(its, minlength=len(off)) / least >= LEAST)[all_row]
        h, row, at = all_h[live], all_row[live], all_at[live]
        if not len(h):
            continue
        block = max(1, size // 4)
        new = np.append(True, (row[1:] != row[:-1]) | (at[1:] // block != at[:-1] // block))
        head = np.flatnonzero(new)
        owner, asked = row[head], set()
        per = size // block  # blocks of a window
        for b, seed in enumerate(_SEEDS):
            low = np.minimum.reduceat(mix(h ^ seed), head)
            window = low.copy()
            for k in range(1, per):
                same = owner[k:] == owner[:-k]
                window[:-k] = np.where(same, np.minimum(window[:-k], low[k:]), window[:-k])
            values, members = bands[b]
            i, j = np.searchsorted(values, window, "left"), np.searchsorted(values, window, "right")
            for w in np.flatnonzero(j > i):
                asked.update((int(w), int(m)) for m in members[i[w]:j[w]])
        ends = np.append(head, len(h))
        for w, m in sorted(asked):
            r = owner[w]
            a, z = max(0, w - per), min(len(head), w + 2 * per)
            while owner[a] != r:
                a += 1
            while owner[z - 1] != r:
                z -= 1
            stretch = h[ends[a]:ends[z]]
            hit = np.flatnonzero(np.isin(stretch, t.sets[m]))
            share = len(np.unique(stretch[hit])) / len(t.sets[m]) if len(hit) else 0.0
            if share >= LEAST and share > found.get((int(r), m), (0.0,))[0]:
                first, last = at[ends[a] + hit[0]], at[ends[a] + hit[-1]] + min(SHINGLE, have[r])
                found[int(r), m] = (share, int(first), int(last - first))
    return [(r, m, *v) for (r, m), v in sorted(found.items())]


def _scan(templates: Templates, column: str):
    kind = pa.list_(pa.struct([("license", pa.string()), ("containment", pa.float64()), ("start", pa.int32()), ("n_words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict[str, dict]] = [{} for _ in range(batch.num_rows)]
            for i, _, data, off in slices(utf8(batch["text"])):
                for r, m, share, start, n in scan_slice(templates, data, off):
                    name = templates.names[m]
                    if share > out[i + r].get(name, {"containment": 0.0})["containment"]:
                        out[i + r][name] = {"license": name, "containment": share, "start": start, "n_words": n}
            got = pa.array([[x[n] for n in sorted(x)] for x in out], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, got], [*batch.schema.names, column])

    return run


def scan_licenses(docs: DataFrame, templates: dict[str, str] = NOTICES, column: str = "licenses") -> DataFrame:
    """docs with the verified templates of each text as array `column`, sorted by name."""
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T._parse_datatype_string(FOUND))])
    return docs.mapInArrow(_scan(Templates(templates), column), schema)
