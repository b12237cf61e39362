"""Licence scanning with a generalised suffix automaton of licence tokens.

The automaton holds the words of all templates. A text is streamed through it
once; after each word the state and length are its matching statistics: the
longest run of words, ending there, that stands in some template; the suffix
links give the longest one at each place of each template. Matches of
``min_match`` words that cannot be prolonged are chained per template: a chain goes on
with a match that begins later, at most ``gap`` words after the end of the last,
and whose place in the template begins no earlier and ends later. Of the chains
that end in a match the one that covers most words of the template counts, found
by dynamic programming; with ``min_cover`` of the template it is a covered span
and gives its label. Spans of a template do not overlap: the one that covers most
is taken first, then the earliest. The score is the largest share covered by a
span, or 1 with a base phrase. The three base phrases are templates too: a place
of one is a position whose match has the phrase as a suffix, which the suffix
links tell.

Only runs of words that occur in templates can hold a match, so other words are
skipped by a vectorised lookup. Every document is read whole; there is no
shuffle. The templates are a fixed, small constant.

Defined results: a null or empty text has no words, no labels and score 0;
repeated rows each get a row; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .text import WORD_TABLE, buffers, slices

#: Fixed values of the contract: phrase and label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label and template text, without punctuation: the usual one-line notices, and the texts of common licences or their openings.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
            "merchantability fitness for a particular purpose and noninfringement"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any "
             "damages arising from the use of this software"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is "
                   "basis without warranties or conditions of any kind either express or implied"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-2.0", "this program is licensed under the gnu general public license version 2"),
    ("gpl-3.0", "it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license "
                "or at your option any later version"),
    ("gpl-2.0", "it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license "
                "or at your option any later version"),
    ("lgpl", "it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl-3.0", "it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)
SCHEMA = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels array<string>, "
    "labels array<string>, score double, spans array<struct<label:string,start:bigint,end:bigint,cover:double>>"
)


class Automaton:
    """Generalised suffix automaton over word numbers."""

    def __init__(self, templates: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [{}]
        for t, seq in enumerate(templates):
            last = 0
            for i, c in enumerate(seq):
                last = self._add(last, c)
                self.end[last].setdefault(t, set()).add(i)
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            for t, i in self.end[s].items():  # where in each template the state's strings end
                self.end[self.link[s]].setdefault(t, set()).update(i)

    def _add(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._state(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.end.append({})
        return len(self.link) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.length[p] + 1)
        self.next[new] = dict(self.next[q])
        self.link[new], self.link[q] = self.link[q], new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def statistics(self, seq: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest match that ends here) after each symbol."""
        s = n = 0
        out = []
        for c in seq:
            while s and c not in self.next[s]:
                s = self.link[s]
                n = self.length[s]
            if c in self.next[s]:
                s = self.next[s][c]
                n += 1
            else:
                n = 0
            out.append((s, n))
        return out


class Scanner:
    """Built on the driver from the templates, used in tasks."""

    def __init__(self, templates=TEMPLATES, base=BASE, min_match: int = 3, gap: int = 8, min_cover: float = 0.8):
        texts = [(label, tuple(text.split())) for text, label in base] + [(label, tuple(t.split())) for label, t in templates]
        self.number = {w: i for i, w in enumerate(sorted({w for _, t in texts for w in t}))}
        self.number_of = {w.encode(): i for w, i in self.number.items()}
        self.texts, self.n_base = texts, len(base)
        self.min_match, self.gap, self.min_cover = min_match, gap, min_cover
        self.shortest = min([min_match, *(len(t) for _, t in texts[: self.n_base])])
        self.numbers = [tuple(self.number[w] for w in t) for _, t in texts]
        self.automaton = Automaton(self.numbers)
        self.places: dict[int, list[tuple[int, int, int, int]]] = {}
        self.base_state = {}
        for b, (_, t) in enumerate(texts[: self.n_base]):
            s = 0
            for w in t:
                s = self.automaton.next[s][self.number[w]]
            self.base_state.setdefault(s, []).append((b, len(t)))

    def _places(self, s: int) -> list[tuple[int, int, int, int]]:
        """Where in templates matches of at least ``min_match`` words end in a state: template, last word, length (0: that of the
        longest match), and the template's next word. At each place the longest match counts."""
        if s not in self.places:
            a, out, seen, at = self.automaton, [], set(), s
            while at > 0 and a.length[at] >= self.min_match:
                for t, ends in a.end[at].items():
                    seq = self.numbers[t]
                    for end in sorted(ends):
                        if t >= self.n_base and (t, end) not in seen:
                            seen.add((t, end))
                            out.append((t, end, 0 if at == s else a.length[at], seq[end + 1] if end + 1 < len(seq) else -1))
                at = a.link[at]
            self.places[s] = out
        return self.places[s]

    def scan(self, ids: np.ndarray):
        """The result columns of one text, given as template word numbers with -1 for other words."""
        a = self.automaton
        places, hits = [], {}
        known = np.concatenate(([False], ids >= 0, [False]))
        begin, stop = np.flatnonzero(known[1:] & ~known[:-1]), np.flatnonzero(known[:-1] & ~known[1:])
        long = stop - begin >= self.shortest
        for b, e in zip(begin[long].tolist(), stop[long].tolist()):
            stats = a.statistics(ids[b:e].tolist())
            for i, (s, n) in enumerate(stats):
                t = s
                while t > 0:
                    for p, m in self.base_state.get(t, ()):
                        if n >= m:
                            places.append((b + i - m + 1, p))
                    t = a.link[t]
                if n >= self.min_match:
                    follows = int(ids[b + i + 1]) if i + 1 < len(stats) else -1
                    for t, end, m, then in self._places(s):
                        if then != follows or follows < 0:  # else it is prolonged
                            m = m or n
                            hits.setdefault(t, []).append((b + i - m + 1, b + i + 1, end - m + 1))
        spans = []
        for t, found in hits.items():
            spans += self._chain(t, found)
        return places, spans

    def _chain(self, t: int, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """The covered spans of a template from its matches (first word, end, first word in the template)."""
        label, size = self.texts[t][0], len(self.texts[t][1])
        found = sorted(found)
        cover, begin, low = [], [], 0  # of the best chain that ends in each match
        reach = max(e - b for b, e, _ in found)
        for j, (b, e, at) in enumerate(found):
            best = (e - b, -b)
            while found[low][0] + reach + self.gap < b:
                low += 1
            for i in range(low, j):
                pb, pe, pat = found[i]
                if pb < b <= pe + self.gap and pat <= at and pat + pe - pb < at + e - b:
                    best = max(best, (cover[i] + at + e - b - max(at, pat + pe - pb), -begin[i]))
            cover.append(best[0])
            begin.append(-best[1])
        out: list[tuple[str, int, int, float]] = []
        taken: list[tuple[int, int]] = []
        for n, b, e in sorted((-cover[j], begin[j], found[j][1]) for j in range(len(found))):
            if -n / size < self.min_cover:
                break
            k = bisect(taken, (b, e))
            if (k == 0 or taken[k - 1][1] <= b) and (k == len(taken) or e <= taken[k][0]):
                taken.insert(k, (b, e))
                out.append((label, b, e, -n / size))
        return out


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Per document: word counts, base places, labels, score and the covered spans (in words)."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        get, empty = s.number_of.get, ([], [])
        for batch in slices(batches, "text"):
            raw, at = buffers(batch.column("text"))
            low = raw.tobytes().translate(WORD_TABLE)
            rows = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                w = low[a:b].split()
                ids = np.fromiter(map(get, w, repeat(-1)), np.int32, len(w))
                places, spans = s.scan(ids) if (ids >= 0).any() else empty
                base = sorted({s.texts[p][0] for _, p in places})
                score = max([1.0] * bool(places) + [x[3] for x in spans], default=0.0)
                rows.append(
                    (
                        len(w), len(places), min((x for x, _ in places), default=None), max((x for x, _ in places), default=None),
                        base, sorted({*base, *(x[0] for x in spans)}), score,
                        [{"label": x[0], "start": x[1], "end": x[2], "cover": x[3]} for x in sorted(spans)],
                    )
                )
            span = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cover", pa.float64())]))
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string())] * 2 + [pa.float64(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))],
                ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"],
            )

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of ``scan`` over whole ``documents``."""
    out = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")}).drop("spans")
