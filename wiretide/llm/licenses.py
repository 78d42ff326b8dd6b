"""Licence scan: known licence sentences by their words, then ordered rules over sentence ids.

A sentence counts where its words stand between two sentence or line bounds, so wrapped lines,
case and punctuation don't matter. A rule is an ordered list of sentence ids; it matches where its
sentences follow each other with at most ``gap`` words between two of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import Words, slices, window_hash

#: Licence sentences as their public texts have them.
SENTENCES = {
    "apache2.statement": "Licensed under the Apache License, Version 2.0",
    "apache2.grant": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache2.use": "you may not use this file except in compliance with the License",
    "apache2.copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache2.disclaim": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit.statement": "Released under the MIT License",
    "mit.licensed": "Licensed under the MIT License",
    "mit.grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions',
    "mit.notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit.disclaim": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "bsd.grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd.source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd.binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd.names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc.grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3.statement": "This work is licensed under the GNU General Public License, version 3",
    "gpl.free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2.free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl.hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "mpl2.statement": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "ccby4.statement": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "ccbync4.statement": "Licensed under CC BY-NC 4.0",
    "ccby4.short": "Licensed under CC BY 4.0",
    "ccbysa4.short": "Licensed under CC BY-SA 4.0",
    "unlicense.grant": "This is free and unencumbered software released into the public domain",
}
#: Rules in order of preference; licence identifiers are SPDX's.
RULES = [
    ("apache2-header", "Apache-2.0", ["apache2.grant", "apache2.use", "apache2.copy", "apache2.disclaim"]),
    ("apache2-statement", "Apache-2.0", ["apache2.statement"]),
    ("mit-text", "MIT", ["mit.grant", "mit.notice", "mit.disclaim"]),
    ("mit-statement", "MIT", ["mit.statement"]),
    ("mit-licensed", "MIT", ["mit.licensed"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.names"]),
    ("bsd2-text", "BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("isc-text", "ISC", ["isc.grant"]),
    ("gpl3-notice", "GPL-3.0-or-later", ["gpl.free", "gpl.hope"]),
    ("gpl2-notice", "GPL-2.0-or-later", ["gpl2.free", "gpl.hope"]),
    ("gpl3-statement", "GPL-3.0-only", ["gpl3.statement"]),
    ("mpl2-statement", "MPL-2.0", ["mpl2.statement"]),
    ("ccby4-statement", "CC-BY-4.0", ["ccby4.statement"]),
    ("ccby4-short", "CC-BY-4.0", ["ccby4.short"]),
    ("ccbync4-statement", "CC-BY-NC-4.0", ["ccbync4.statement"]),
    ("ccbysa4-short", "CC-BY-SA-4.0", ["ccbysa4.short"]),
    ("unlicense-text", "Unlicense", ["unlicense.grant"]),
]
SENTENCE = "array<struct<id:string,first:int,last:int>>"
MATCH = "array<struct<licence:string,rule:string,first:int,last:int>>"


def bounds_before(words: Words) -> np.ndarray:
    """Whether a text, line or sentence begins at each word; one more entry for the end."""
    raw = words.raw
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    next_white = np.ones(len(raw), bool)
    next_white[:-1] = white[1:]
    stop = np.isin(raw, np.frombuffer(b".!?;:", np.uint8))
    total = np.concatenate(([0], np.cumsum((raw == 10) | (stop & next_white))))
    out = np.ones(len(words.starts) + 1, bool)
    if len(words.starts):
        out[1:-1] = total[words.starts[1:]] > total[words.ends[:-1]]
        out[words.first[words.first < len(out)]] = True
    return out


def rule_matches(found: list[tuple[int, int, int]], rules: list[tuple[str, str, list[int]]], gap: int) -> list[tuple[str, str, int, int]]:
    """Matches over (first word, last word, sentence) in order; each sentence serves one match."""
    used, out = set(), []
    for name, licence, ids in rules:
        for i, (first, last, which) in enumerate(found):
            if which != ids[0] or i in used:
                continue
            chain, end = [i], last
            for want in ids[1:]:
                after = next((k for k in range(chain[-1] + 1, len(found)) if k not in used and found[k][2] == want and found[k][0] >= end), None)
                if after is None or found[after][0] - end > gap:
                    break
                chain.append(after)
                end = found[after][1]
            if len(chain) == len(ids):
                used.update(chain)
                out.append((licence, name, first, end))
    return sorted(out, key=lambda m: (m[2], m[1]))


def scan(docs: DataFrame, sentences: dict[str, str] | None = None, rules: list | None = None, gap: int = 40) -> DataFrame:
    """doc_id, the known sentences of each text and its rule matches, by word positions.

    All rows are kept; null or wordless texts have neither. Of sentences that begin at one place
    the longest counts.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    names = sorted(sentences)
    by_size: dict[int, dict[int, int]] = {}
    heads: dict[int, set[int]] = {1: set(), 2: set()}  # how known sentences begin, by one or two words
    for i, name in enumerate(names):
        own = Words(pa.array([sentences[name]])).hash
        if len(own):
            by_size.setdefault(len(own), {})[int(window_hash(own, len(own))[0])] = i
            lead = min(2, len(own))
            heads[lead].add(int(window_hash(own[:lead], lead)[0]))
    one, two = (np.array(sorted(heads[k]), np.uint64) for k in (1, 2))
    coded = [(name, licence, [names.index(s) for s in ids]) for name, licence, ids in rules]
    sentence = pa.list_(pa.struct([("id", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))
    match = pa.list_(pa.struct([("licence", pa.string()), ("rule", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                words = Words(rows.column(1))
                bound = bounds_before(words)
                start = np.flatnonzero(bound[:-1])
                pair = np.append(window_hash(words.hash, 2), np.zeros(min(1, len(words.hash)), np.uint64))[start]
                begins = np.isin(pair, two)
                if len(one):
                    begins |= np.isin(window_hash(words.hash[start], 1), one)
                start = start[begins]
                text = np.searchsorted(words.first, start, "right") - 1
                found: dict[int, dict[int, tuple[int, int]]] = {}
                for size in sorted(by_size):
                    fits = (start + size <= words.first[text + 1]) & bound[np.minimum(start + size, len(bound) - 1)]
                    at = start[fits]
                    keys = np.zeros(len(at), np.uint64)
                    if len(at):
                        keys = window_hash(words.hash[at[None, :] + np.arange(size)[:, None]].ravel(order="F"), size)[::size]
                    for s, t, key in zip(at.tolist(), text[fits].tolist(), keys.tolist(), strict=True):
                        which = by_size[size].get(key)
                        if which is not None:
                            base = int(words.first[t])
                            found.setdefault(t, {})[s - base] = (s - base + size, which)
                lists = {t: [(a, b, w) for a, (b, w) in sorted(x.items())] for t, x in found.items()}
                known = [[{"id": names[w], "first": a, "last": b} for a, b, w in lists.get(t, [])] for t in range(rows.num_rows)]
                hits = [[dict(zip(("licence", "rule", "first", "last"), m, strict=True)) for m in rule_matches(lists[t], coded, gap)] if t in lists else [] for t in range(rows.num_rows)]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(known, sentence), pa.array(hits, match)], names=["doc_id", "sentences", "matches"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, sentences {SENTENCE}, matches {MATCH}")
