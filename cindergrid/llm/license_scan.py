"""Licence scans: matching statistics of whole texts against a generalised suffix automaton of licence wordings, chained into spans.

The automaton holds every run of words of every template and is built once on the driver; its size is that of the templates. Tasks
stream their texts through it: at each word it knows the longest run ending there that some template has. Words that no template
has part the texts into stretches, which go through the automaton side by side, one word of each a step; a stretch longer than CHUNK
is cut, and each part starts as many words earlier as the longest template has, which gives the same state. A run of `least` words or
more that can't be prolonged is a match, at every place where templates have it. Matches of one template in the same order in text and
template, with gaps of at most `gap` words, form chains; the heaviest covers a span. A span whose template is covered by `cover` or more
gives that template's label unless a span with more matched words overlaps it.

Base phrases are templates too: a phrase stands where its state is the present one or an ancestor of it. Words are runs of characters
other than ASCII signs, A-Z lower-cased. Null and empty texts have no words, no labels (empty strings) and score 0. Each row stands
alone; columns of other names stay, those named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.llm import bytewords as bw

CHUNK = 4096
#: Phrases that name a licence, and wordings of notices, as label and text.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("gpl-3.0-or-later", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("lgpl-2.1-or-later", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."""),
    ("mit", "Released under the MIT License"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to
        the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of
        the Software."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
        disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in
        the documentation and/or other materials provided with the distribution."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
        this file, You can obtain one at http://mozilla.org/MPL/2.0/."""),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
)


def words_of(text: str) -> list[int]:
    return [int(h) for _, _, words, _ in bw.word_hashes(pa.array([text], pa.large_string()), bw.MARKS) for h in words]


class Automaton:
    """A suffix automaton of several word sequences, its transitions as sorted arrays and its states' places by intervals of a tour."""

    def __init__(self, sequences: list[list[int]]):
        self.vocabulary = np.array(sorted({w for s in sequences for w in s}), np.uint64)
        self.size = len(self.vocabulary)
        number = {int(w): i for i, w in enumerate(self.vocabulary)}
        self.length, self.link, self.next = [0], [-1], [{}]
        ends: list[list[tuple[int, int]]] = [[]]

        def state(length, link, following):
            self.length.append(length)
            self.link.append(link)
            self.next.append(following)
            ends.append([])
            return len(self.length) - 1

        def split(p, q, c):
            """A state for the runs of q that are no longer than p's and c."""
            copy = state(self.length[p] + 1, self.link[q], dict(self.next[q]))
            self.link[q] = copy
            while p >= 0 and self.next[p].get(c) == q:
                self.next[p][c] = copy
                p = self.link[p]
            return copy

        def extend(last, c):
            q = self.next[last].get(c)
            if q is not None:
                return q if self.length[q] == self.length[last] + 1 else split(last, q, c)
            new = state(self.length[last] + 1, 0, {})
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p >= 0:
                q = self.next[p][c]
                self.link[new] = q if self.length[q] == self.length[p] + 1 else split(p, q, c)
            return new

        for t, sequence in enumerate(sequences):
            last = 0
            for i, w in enumerate(sequence):
                last = extend(last, number[w])
                ends[last].append((t, i))
        below: list[list[int]] = [[] for _ in self.link]
        for s, p in enumerate(self.link[1:], 1):
            below[p].append(s)
        n = len(self.link)
        self.enter, self.leave = np.zeros(n, np.int64), np.zeros(n, np.int64)  # in the tour of states
        self.first, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)  # in the list of places
        places, at, todo = [], 0, [(0, False)]
        while todo:
            s, over = todo.pop()
            if over:
                self.leave[s], self.last[s] = at, len(places)
                continue
            self.enter[s], self.first[s] = at, len(places)
            at += 1
            places += ends[s]
            todo.append((s, True))
            todo += [(b, False) for b in below[s]]
        self.places = np.array(places, np.int64).reshape(-1, 2)
        edges = sorted((s * self.size + c, q) for s, following in enumerate(self.next) for c, q in following.items())
        self.edge, self.to = np.array([e for e, _ in edges], np.int64), np.array([q for _, q in edges], np.int64)
        self.length, self.link, self.next = np.array(self.length), np.array(self.link), None
        self.longest = max(map(len, sequences), default=0)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Each word's number in the vocabulary, or -1."""
        if not self.size:
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.vocabulary, words), self.size - 1)
        return np.where(self.vocabulary[at] == words, at, -1)

    def state_of(self, sequence: list[int]) -> int:
        s = 0
        for w in self.numbers(np.array(sequence, np.uint64)):
            s = self.to[np.searchsorted(self.edge, s * self.size + w)]
        return int(s)

    def statistics(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """At each word the automaton's state and the length of the longest run ending there; texts begin at first (texts + 1)."""
        number = self.numbers(words)
        state, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = number >= 0
        cut = np.zeros(len(words) + 1, bool)
        cut[first] = True
        begin = np.flatnonzero(known & (cut[:-1] | ~np.r_[False, known[:-1]]))
        end = np.flatnonzero(known & (cut[1:] | ~np.r_[known[1:], False])) + 1
        parts = -(-(end - begin) // CHUNK)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        begin, end = np.repeat(begin, parts), np.repeat(end, parts)
        own = begin + nth * CHUNK
        at, stop = np.maximum(begin, own - self.longest), np.minimum(end, own + CHUNK)
        order = np.argsort(at - stop, kind="stable")
        at, stop, own = at[order], stop[order], own[order]
        s, run = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = len(at)
        while live:
            s, run, here = s[:live], run[:live], at[:live]
            c = number[here]
            todo = np.arange(live)
            while len(todo):
                key = s[todo] * self.size + c[todo]
                edge = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
                hit = self.edge[edge] == key
                s[todo[hit]] = self.to[edge[hit]]
                todo = todo[~hit]
                s[todo] = self.link[s[todo]]
                run[todo] = self.length[s[todo]]
            run += 1
            out = here >= own[:live]
            state[here[out]], length[here[out]] = s[out], run[out]
            at = here + 1
            live = int(np.searchsorted(at - stop[:live], 0))  # by falling length, so the ended ones are last
        return state, length


def chains(matches: list[tuple[int, int, int]], gap: int) -> list[tuple[int, int, int]]:
    """(first, last, words) of the heaviest chains of a template's matches (start in text, start in template, words)."""
    matches = sorted(set(matches))
    best, root, used, reach = [], [], set(), 0
    for j, (a, b, n) in enumerate(matches):
        top = (n, j, None)
        while reach < j and matches[reach][0] + matches[reach][2] + gap < a:
            reach += 1
        for i in range(reach, j):
            p, q, m = matches[i]
            over = max(0, p + m - a, q + m - b)
            if p < a and q < b and over < n and a - p - m <= gap and b - q - m <= gap and best[i] + n - over > top[0]:
                top = (best[i] + n - over, root[i], i)
        best.append(top[0])
        root.append(top[1])
        if top[2] is not None:
            used.add(top[2])
    return [(matches[root[j]][0], a + n - 1, best[j]) for j, (a, _, n) in enumerate(matches) if j not in used]


SPAN = T.StructType([T.StructField("label", T.StringType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("words", T.IntegerType()), T.StructField("covered", T.DoubleType())])


def scan_licenses(docs: DataFrame, text: str = "text", templates=TEMPLATES, phrases=PHRASES, least: int = 3, gap: int = 8, cover: float = 0.8) -> DataFrame:
    """docs' other columns, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (label, first, last, words, covered)."""
    fields = [T.StructField(c, T.LongType()) for c in ("n_words", "n_base", "first_word", "last_word")] + [T.StructField(c, T.StringType()) for c in ("base_labels", "labels")]
    fields += [T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(SPAN))]
    made = [f.name for f in fields]
    keep = [c for c in docs.columns if c != text and c not in made]
    schema = T.StructType([*(T.StructField(c, docs.schema[c].dataType) for c in keep), *fields])
    sequences = [words_of(t) for _, t in phrases] + [words_of(t) for _, t in templates]
    labels = [x for x, _ in phrases] + [x for x, _ in templates]
    size = np.array([len(s) for s in sequences])
    auto = Automaton(sequences)
    ends = [(auto.state_of(s), len(s)) for s in sequences[: len(phrases)]]
    arrow = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("words", pa.int32()), ("covered", pa.float64())]))

    def spans_of(state, length, start, stop) -> tuple[list[tuple], float]:
        """Kept spans of the words from start to stop, and the greatest share of a template that a chain covers."""
        own = length[start:stop]
        at = np.flatnonzero((own >= least) & (np.r_[own[1:], 0] != own + 1))
        by: dict[int, list] = {}
        for i in at.tolist():
            s, n = int(state[start + i]), int(own[i])
            for t, e in auto.places[auto.first[s] : auto.last[s]].tolist():
                by.setdefault(t, []).append((i - n + 1, e - n + 1, n))
        found = [(words, words / size[t], a, b, labels[t]) for t, matches in by.items() for a, b, words in chains(matches, gap)]
        top = max((f[1] for f in found), default=0.0)
        held = np.zeros(stop - start, np.int64)
        kept = []
        for words, share, a, b, label in sorted(found, key=lambda f: (-f[0], -f[1], f[2:])):
            if held[a : b + 1].max(initial=0) <= words:
                held[a : b + 1] = np.maximum(held[a : b + 1], words)
                if share >= cover:
                    kept.append({"label": label, "first": a, "last": b, "words": int(words), "covered": float(share)})
        return sorted(kept, key=lambda x: (x["first"], x["last"], x["label"])), float(top)

    def run(batches):
        for batch in batches:
            raw, offsets = bw.text_bytes(batch.column("__text"))
            for lo, hi in bw.slices(offsets):
                own, at = raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                starts, stops, first = bw.bounds(own, at, bw.MARKS)
                state, length = auto.statistics(bw.hashes(own, starts, stops), first)
                where, label = [], []
                for p, (s, n) in enumerate(ends):
                    hit = np.flatnonzero((length >= n) & (auto.enter[state] >= auto.enter[s]) & (auto.enter[state] < auto.leave[s]))
                    where.append(hit - n + 1)
                    label.append(np.full(len(hit), p))
                where, label = np.concatenate([np.zeros(0, np.int64), *where]), np.concatenate([np.zeros(0, np.int64), *label])
                doc = np.searchsorted(first, where, "right") - 1
                order = np.lexsort((where, doc))
                where, label, doc = where[order], label[order], doc[order]
                edge = np.searchsorted(doc, np.arange(hi - lo + 1))
                long = np.unique(np.searchsorted(first, np.flatnonzero(length >= least), "right") - 1)
                spans = {int(r): spans_of(state, length, first[r], first[r + 1]) for r in long}
                rows = []
                for r in range(hi - lo):
                    a, b = edge[r], edge[r + 1]
                    base = {labels[p] for p in set(label[a:b].tolist())}
                    kept, top = spans.get(r, ([], 0.0))
                    one, two = (int(where[a] - first[r]), int(where[b - 1] - first[r])) if b > a else (None, None)
                    rows.append((int(first[r + 1] - first[r]), int(b - a), one, two, ",".join(sorted(base)), ",".join(sorted(base | {x["label"] for x in kept})), 1.0 if base else min(1.0, top), kept))
                kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.float64(), arrow]
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(v, k) for v, k in zip(zip(*rows), kinds))], names=schema.names)

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)
