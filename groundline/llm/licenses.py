"""Licence scans with a generalised suffix automaton of licence words.

The automaton holds every run of words of every template and marker phrase. A text's words are streamed through it,
which gives at each word the longest run that ends there and stands in some template, and by the state's links the
longest one of each other template (matching statistics). Long matches are chained per template: they must advance in
text and template, with few words between, and may stand at any of the template's places that hold their words. A template that is covered well enough gives its
licence's label; a marker phrase gives its own wherever its words stand consecutively.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_texts, table
from .text_hash import ALNUM, slices

#: Marker phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices and texts of licences by label, from their public texts (fixed values).
TEMPLATES = {
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "apache-2": (
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    ),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"),
    "gpl": (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "lgpl": ("licensed under the gnu lesser general public license",),
    "agpl": ("licensed under the gnu affero general public license",),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met 1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by": ("this work is licensed under a creative commons attribution 4 0 international license",),
    "cc-by-sa": ("this work is licensed under a creative commons attribution sharealike 4 0 international license",),
    "cc-by-nc": ("this work is licensed under a creative commons attribution noncommercial 4 0 international license",),
    "unlicense": ("this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    "rights-reserved": ("all rights reserved no part of this publication may be reproduced",),
}

#: A match shorter than this joins no chain; words a chain may leave out between two matches; covered share for a label.
LEAST_MATCH, MOST_GAP, LEAST_COVER = 3, 4, 0.75


class Automaton:
    """Generalised suffix automaton over word ids (Blumer et al., 1985), read-only once built."""

    def __init__(self, texts: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        #: All ends at which the state's runs stand, for each text that has them.
        self.ends: list[dict[int, set[int]]] = [{}]
        for number, text in enumerate(texts):
            last = 0
            for place, word in enumerate(text):
                last = self._extended(last, word)
                self.ends[last].setdefault(number, set()).add(place + 1)
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):  # to the shorter runs
            for number, ends in self.ends[state].items():
                self.ends[self.link[state]].setdefault(number, set()).update(ends)

    def _state(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(dict(moves))
        self.ends.append({})
        return len(self.length) - 1

    def _extended(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        new, at = self._state(self.length[last] + 1, 0, {}), last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            to = self.next[at][word]
            self.link[new] = to if self.length[to] == self.length[at] + 1 else self._split(at, word, to)
        return new

    def _split(self, at: int, word: int, to: int) -> int:
        copy = self._state(self.length[at] + 1, self.link[to], self.next[to])
        self.link[to] = copy
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def walk(self, words: list[int]) -> list[tuple[int, int]]:
        """(state, length of the longest run) after each word."""
        out, state, length, moves, link, longest = [], 0, 0, self.next, self.link, self.length
        for word in words:
            while state and word not in moves[state]:
                state = link[state]
                length = longest[state]
            to = moves[state].get(word)
            if to is None:
                length = 0
            else:
                state, length = to, length + 1
            out.append((state, length))
        return out


class Scanner:
    """Templates and phrases in one automaton, and the words' ids."""

    def __init__(self, templates: dict[str, tuple[str, ...]], phrases: dict[str, str]):
        self.labels = [*(label for label, own in templates.items() for _ in own), *phrases.values()]
        runs = [t.split() for t in [*(t for own in templates.values() for t in own), *phrases]]
        self.ids = {w.encode(): i for i, w in enumerate(dict.fromkeys(w for r in runs for w in r))}
        coded = [[self.ids[w.encode()] for w in r] for r in runs]
        self.sizes, self.first_phrase = [len(r) for r in runs], len(runs) - len(phrases)
        self.automaton = auto = Automaton(coded)
        # Words that are next to each other in some template; no longer run can hold any other pair.
        self.pairs = np.zeros((len(self.ids) + 1, len(self.ids) + 1), dtype=bool)
        for r in coded:
            self.pairs[r[:-1], r[1:]] = True
        self.single = {r[0]: n for n, r in enumerate(coded) if n >= self.first_phrase and len(r) == 1}
        self.least = min([LEAST_MATCH, *(n for n in self.sizes[self.first_phrase :] if n > 1)])
        # The phrases that end a state's longest run: those of the state and of its links. And of each template that holds
        # the state's run or an end of it the first such state on the links, by which its match is as long as can be.
        own: dict[int, list[int]] = {}
        for number in range(self.first_phrase, len(runs)):
            own.setdefault(auto.walk(coded[number])[-1][0], []).append(number)
        self.ending: list[tuple[int, ...]] = []
        self.holding: list[tuple[tuple[int, int], ...]] = []
        for state in range(len(auto.link)):
            found, first, at = [], {}, state
            while at > 0:
                found += own.get(at, [])
                for number in auto.ends[at]:
                    if number < self.first_phrase and auto.length[at] >= LEAST_MATCH:
                        first.setdefault(number, at)
                at = auto.link[at]
            self.ending.append(tuple(found))
            self.holding.append(tuple(first.items()))

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], dict[int, dict[int, tuple[int, int]]]]:
        """Places (first word, phrase) of the phrases; template -> first word -> (words, state) of its maximal matches of LEAST_MATCH words or more."""
        get, none = self.ids.get, len(self.ids)
        ids = np.fromiter((get(w, none) for w in words), dtype=np.int64, count=len(words))
        joined = self.pairs[ids[:-1], ids[1:]] if len(ids) > 1 else np.zeros(0, dtype=bool)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], joined.astype(np.int8), [0]))))
        places = [(at, number) for word, number in self.single.items() for at in np.flatnonzero(ids == word).tolist()]
        long: dict[int, dict[int, tuple[int, int]]] = {}
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):  # words a to b are such a run
            if b - a + 1 < self.least:
                continue
            for i, (state, length) in enumerate(self.automaton.walk(ids[a : b + 1].tolist())):
                for number in self.ending[state]:
                    if 1 < self.sizes[number] <= length:
                        places.append((a + i + 1 - self.sizes[number], number))
                for number, at in self.holding[state] if length >= LEAST_MATCH else ():
                    n = min(length, self.automaton.length[at])
                    if n >= LEAST_MATCH:  # one that begins at the same word is shorter and gives way
                        long.setdefault(number, {})[a + i + 1 - n] = (n, at)
        return sorted(places), long

    def covered(self, long: dict[int, dict[int, tuple[int, int]]]) -> dict[int, float]:
        """Template -> the largest share of its words that a chain of matches covers."""
        return {number: best_chain(self.placed(number, found)) / self.sizes[number] for number, found in long.items()}

    def placed(self, number: int, found: dict[int, tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(first word, place in the template, words) of each match at each of its places in the template."""
        return sorted((first, end - n, n) for first, (n, state) in found.items() for end in self.automaton.ends[state][number])


def best_chain(found: list[tuple[int, int, int]]) -> int:
    """The most template words that a chain of (first, place, words) covers.

    Each match stands after the one before, in text and template, with MOST_GAP words between at most; where two overlap, the second
    counts from where the first ends.
    """
    top, chains = 0, []  # (end in text, end in template, words covered)
    for first, place, n in found:
        chains = [c for c in chains if c[0] >= first - MOST_GAP]
        best = n
        for end, at, covered in chains:
            cut = max(0, end - first, at - place)
            if cut < n and first + cut - end <= MOST_GAP and place + cut - at <= MOST_GAP:
                best = max(best, covered + n - cut)
        chains.append((first + n, place + n, best))
        top = max(top, best)
    return top


def scan_licenses(docs: DataFrame, key: str = "doc_id", templates: dict[str, tuple[str, ...]] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """docs(key, text) -> key, n_words, n_base, first_word, last_word, base_labels, labels, score and spans of words.

    Null and empty texts have no words, no labels (empty strings) and score 0. Repeated rows and null keys are rows; other
    columns are ignored. score is the largest covered share of a template, 1 where a phrase stands. spans lists
    label:first:end of the long matches' templates that are covered and of the phrases, in order.
    """
    scanner = Scanner(templates, phrases)
    kind = docs.schema[key].dataType.simpleString()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]

    def row(text: bytes) -> tuple:
        words = text.translate(ALNUM).split()
        places, long = scanner.matches(words)
        cover = scanner.covered(long) if long else {}
        base = sorted({scanner.labels[n] for _, n in places})
        more = [n for n, share in cover.items() if share >= LEAST_COVER]
        spans = [(first, first + scanner.sizes[n], scanner.labels[n]) for first, n in places]
        spans += [(first, first + length, scanner.labels[n]) for n in more for first, (length, _) in long[n].items()]
        starts = [p[0] for p in places]
        score = 1.0 if places else min(1.0, max(cover.values(), default=0.0))
        listed = ",".join(f"{label}:{a}:{b}" for a, b, label in sorted(set(spans)))
        return len(words), len(places), starts[0] if starts else None, starts[-1] if starts else None, ",".join(base), ",".join(sorted({*base, *(scanner.labels[n] for n in more)})), score, listed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string()]
        for batch in batches:
            rows = [row(t) for _, texts in slices(batch.column(1)) for t in texts]
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["key", *names])

    out = map_texts(docs.select(key, "text"), run, f"key {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, spans string")
    return out.withColumnRenamed("key", key)


def op9_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
