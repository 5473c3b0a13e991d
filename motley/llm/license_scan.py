"""License scan: matching statistics against a generalised suffix automaton of templates.

The automaton holds every run of words of every template. A text is streamed through it once:
at each word it knows the longest run that ends there and stands in some template. Runs that
cannot grow are the long matches; per template they are chained in order into spans, and a
template counts as present where a chain covers enough of it. Phrases are templates too, found
wherever the current run ends with one.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Labels and their phrases.
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]
# Words of public licences and their usual notices, by label.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
            "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
            "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
            "subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
               "in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
               "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
               "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
            "General Public License as published by the Free Software Foundation, either version 3 of the License, "
            "or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
             "Lesser General Public License as published by the Free Software Foundation."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met: Redistributions of source code must retain the above copyright "
            "notice, this list of conditions and the following disclaimer."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
            "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("reserved", "Copyright. All rights reserved."),
]
MIN_MATCH, MIN_COVER, MAX_GAP = 3, 0.8, 12
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {c: c + 32 for c in range(65, 91)}


def words_of(text: str | None) -> list[str]:
    """Runs of digits, letters a-z and all characters beyond ASCII, A-Z lower-cased."""
    return _WORD.findall((text or "").translate(_LOWER))


class Automaton:
    """Generalised suffix automaton over the words of several templates."""

    def __init__(self, templates: list[list[str]]):
        vocabulary = sorted({w for t in templates for w in t})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, number of words read) where the state's runs end
        for number, template in enumerate(templates):
            state = 0
            for at, word in enumerate(template):
                state = self._extend(state, self.ids[word])
                self.ends[state].append((number, at + 1))
        # Longer states first, each hands its ends to the state of its longest proper suffix.
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                self.ends[self.link[state]] = sorted({*self.ends[self.link[state]], *self.ends[state]})

    def _add(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.ends.append([])
        return len(self.next) - 1

    def _split(self, state: int, word: int, target: int) -> int:
        """A copy of ``target`` for the runs that reach it over ``state``."""
        copy = self._add(self.length[state] + 1, self.link[target], dict(self.next[target]))
        self.link[target] = copy
        while state != -1 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            target = self.next[last][word]
            if self.length[target] == self.length[last] + 1:
                return target
            return self._split(last, word, target)
        new = self._add(self.length[last] + 1, 0, {})
        state = last
        while state != -1 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state != -1:
            target = self.next[state][word]
            self.link[new] = target if self.length[target] == self.length[state] + 1 else self._split(state, word, target)
        return new

    def run(self, words: list[int]):
        """(state, matched length) after each word: the matching statistics of a run of known words."""
        state = matched = 0
        edges, link, length = self.next, self.link, self.length
        for word in words:
            while state and word not in edges[state]:
                state = link[state]
                matched = length[state]
            if word in edges[state]:
                state, matched = edges[state][word], matched + 1
            yield state, matched

    def holding(self, words: list[str]) -> set[int]:
        """States all of whose runs of at least that length end with ``words``."""
        state = 0
        for word in words:
            state = self.next[state][self.ids[word]]
        below, found = defaultdict(list), set()
        for child, parent in enumerate(self.link):
            below[parent].append(child)
        todo = [state]
        while todo:
            found.add(x := todo.pop())
            todo.extend(below[x])
        return found


class Scanner:
    """Scans texts for phrases and templates."""

    def __init__(self, phrases, templates, min_match=MIN_MATCH, min_cover=MIN_COVER, max_gap=MAX_GAP):
        self.phrases = [(words_of(p), label) for label, p in phrases]
        self.templates = [(words_of(t), label) for label, t in templates]
        self.auto = Automaton([w for w, _ in self.phrases] + [w for w, _ in self.templates])
        self.min_match, self.min_cover, self.max_gap = min_match, min_cover, max_gap
        self.ending: dict[int, list[int]] = defaultdict(list)
        for number, (words, _) in enumerate(self.phrases):
            for state in self.auto.holding(words):
                self.ending[state].append(number)
        self.shortest = min([min_match, *(len(w) for w, _ in self.phrases)])

    def _stretch(self, ids: list[int], start: int, places: list, matches: list) -> None:
        """Phrase places and long matches of one stretch of known words that begins at ``start``."""
        stats = list(self.auto.run(ids))
        for i, (state, matched) in enumerate(stats):
            for number in self.ending.get(state, ()):
                size = len(self.phrases[number][0])
                if matched >= size:
                    places.append((start + i + 1 - size, number))
            # A match ends where the next one does not extend it.
            if matched >= self.min_match and (i + 1 == len(stats) or stats[i + 1][1] != matched + 1):
                matches.append((start + i + 1 - matched, matched, state))

    def _spans(self, matches: list) -> list[tuple[int, int, int, float]]:
        """(template, first word, last word + 1, share of the template covered) of chained matches."""
        per: dict[int, list] = defaultdict(list)
        skip = len(self.phrases)
        for start, size, state in matches:
            for number, end in self.auto.ends[state]:
                if number >= skip:
                    per[number - skip].append((start, start + size, end - size, end))
        spans = []
        for number, found in per.items():
            total, chains = len(self.templates[number][0]), []
            for a, b, c, d in sorted(found):
                at, new = self._open(chains, a, b, c, d)
                if at is None:
                    chains.append([a, b, d, d - c])
                else:  # chains stay in the order of their ends
                    chain = chains.pop(at)
                    chains.append([chain[0], b, d, chain[3] + new])
            spans += [(number, x[0], x[1], x[3] / total) for x in chains if x[3] >= self.min_cover * total]
        return spans

    def _open(self, chains: list, a: int, b: int, c: int, d: int):
        """The chain that covers most with words a to b of the text, c to d of the template, and the words it gains.

        Words that the chain's end holds already, in the text or the template, do not count again.
        """
        best, new = None, 0
        for at in range(len(chains) - 1, -1, -1):
            _, end, last, covered = chains[at]
            if a - end > self.max_gap:
                break
            shared = max(end - a, last - c, 0)
            if shared < d - c and a + shared - end <= self.max_gap and (best is None or covered + d - c - shared > chains[best][3] + new):
                best, new = at, d - c - shared
        return best, new

    def scan(self, text: str | None) -> dict:
        words = words_of(text)
        ids = np.fromiter(map(self.auto.ids.get, words, [0] * len(words)), dtype=np.int32, count=len(words))
        places, matches = [], []
        known = np.flatnonzero(ids)
        if len(known):
            cuts = np.flatnonzero(np.diff(known) != 1) + 1
            first, last = known[np.r_[0, cuts]], known[np.r_[cuts - 1, len(known) - 1]] + 1
            for a, b in zip(first.tolist(), last.tolist()):
                if b - a >= self.shortest:
                    self._stretch(ids[a:b].tolist(), a, places, matches)
        spans = self._spans(matches)
        base = sorted({self.phrases[n][1] for _, n in places})
        labels = sorted({*base, *(self.templates[n][1] for n, *_ in spans)})
        starts = [p for p, _ in places]
        score = 1.0 if places else max((min(1.0, s[3]) for s in spans), default=0.0)
        return {"n_words": len(words), "n_base": len(places), "first_word": min(starts, default=None),
                "last_word": max(starts, default=None), "base_labels": ",".join(base), "labels": ",".join(labels),
                "score": score, "spans": [{"label": self.templates[n][1], "start": a, "end": b, "covered": min(1.0, c)}
                                          for n, a, b, c in sorted(spans, key=lambda s: s[1:])]}


_FIELDS = [("n_words", pa.int64(), "bigint"), ("n_base", pa.int64(), "bigint"), ("first_word", pa.int64(), "bigint"),
           ("last_word", pa.int64(), "bigint"), ("base_labels", pa.string(), "string"), ("labels", pa.string(), "string"),
           ("score", pa.float64(), "double"),
           ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                         ("covered", pa.float64())])),
            "array<struct<label:string,start:bigint,end:bigint,covered:double>>")]


def scan(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) per input row.

    ``n_base`` counts the places of phrases, ``first_word`` and ``last_word`` are their smallest
    and largest start, null without one. ``labels`` adds those of templates covered to at least
    ``MIN_COVER`` by chained matches of ``MIN_MATCH`` words or more with gaps of at most
    ``MAX_GAP`` words; ``spans`` says where. ``score`` is 1 with a phrase, else the best
    coverage that counts, else 0. Null and empty texts have no words, no labels and score 0.
    The automaton's size is that of the templates. Repeated rows are scanned one by one, an
    empty table gives no rows, other columns are not read.
    """
    def run(batches):
        scanner = Scanner(phrases, templates)
        for batch in batches:
            rows = [scanner.scan(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[name] for r in rows], kind) for name, kind, _ in _FIELDS)],
                names=["id", *(name for name, _, _ in _FIELDS)])

    kind = docs.schema[id_col].dataType.simpleString()
    picked = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return picked.mapInArrow(run, ", ".join([f"id {kind}", *(f"{n} {k}" for n, _, k in _FIELDS)])).withColumnRenamed(
        "id", id_col)
