"""Licence scan with a generalised suffix automaton over the words of licence templates.

The automaton accepts every run of words of any template.  A text is streamed through it
word by word, which gives the matching statistic of every place: the longest run ending
there that some template holds.  Runs that cannot be extended are matches; matches that
follow each other in the text and in one template, with small gaps, are chained, and the
chain that covers most of a template gives its span and share.  Short phrases are templates too,
and all their places are reported: a phrase stands where the automaton's state, or one it
links to, is the phrase's.

Every text is read once, where it lies; the automaton is a few hundred states.

Edge cases: null and empty texts have no words and score 0.  Rows with equal doc_id are
scanned each for itself; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases and their labels, then wordings of public licence notices.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
    ],
    "cc-by-4.0": [
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
    ],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General"
        " Public License as published by the Free Software Foundation, either version 3 of the License, or (at your"
        " option) any later version",
    ],
    "mit": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}

LEAST_RUN = 3  # words of a match that may be chained
MOST_GAP = 4  # words between chained matches, in the text and in the template
LEAST_SHARE = 0.7  # of a template, to give its label

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z in lower case: runs of a-z, 0-9 and non-ASCII characters."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrase: bool


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self, templates: list[Template]):
        self.templates = templates
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        sequences = [[self.ids.setdefault(w, len(self.ids)) for w in t.words] for t in templates]
        for sequence in sequences:
            last = 0
            for word in sequence:
                last = self._extended(last, word)
        # Where each state's runs end in the templates: its own, then those linking to it.
        self.ends: list[set[tuple[int, int]]] = [set() for _ in self.next]
        for number, sequence in enumerate(sequences):
            state = 0
            for place, word in enumerate(sequence):
                state = self.next[state][word]
                self.ends[state].add((number, place + 1))
        for state in sorted(range(1, len(self.next)), key=lambda s: -self.length[s]):
            if self.link[state] > 0:
                self.ends[self.link[state]] |= self.ends[state]
        locus: dict[int, list[int]] = {}
        for number, sequence in enumerate(sequences):
            if templates[number].phrase:
                state = 0
                for word in sequence:
                    state = self.next[state][word]
                locus.setdefault(state, []).append(number)
        # Phrases that may end at a state: its own and those of the states it links to.
        self.phrases: list[list[int]] = [[] for _ in self.next]
        for state in sorted(range(1, len(self.next)), key=lambda s: self.length[s]):
            self.phrases[state] = locus.get(state, []) + self.phrases[max(0, self.link[state])]

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, state: int, word: int) -> int:
        """The target of `word` at `state`, made to hold runs of one more word at most."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = copy
            state = self.link[state]
        return copy

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, -1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        self.link[new] = 0 if state < 0 else self._split(state, word)
        return new

    def stream(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places of phrases (start, template), and matches (start, end, state) that cannot be extended."""
        places: list[tuple[int, int]] = []
        matches: list[tuple[int, int, int]] = []
        state, length, before = 0, 0, -2
        ids = list(map(self.ids.get, words))
        for at in [i for i, word in enumerate(ids) if word is not None]:
            if at != before + 1:
                if length >= LEAST_RUN:
                    matches.append((before + 1 - length, before + 1, state))
                state = length = 0
            word = ids[at]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            else:
                if length >= LEAST_RUN:
                    matches.append((at - length, at, state))
                while state > 0 and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                state, length = self.next[state][word], length + 1
            for number in self.phrases[state]:
                size = len(self.templates[number].words)
                if size <= length:
                    places.append((at + 1 - size, number))
            before = at
        if length >= LEAST_RUN:
            matches.append((before + 1 - length, before + 1, state))
        return places, matches

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, float]]:
        """Chains (template, start, end, share of its words), the best ones without overlap."""
        by_template: dict[int, list[tuple[int, int, int]]] = {}
        for start, end, state in matches:
            for number, place in self.ends[state]:
                by_template.setdefault(number, []).append((start, end, place))
        found = []
        for number, parts in by_template.items():
            parts.sort()
            size = len(self.templates[number].words)
            best: list[tuple[int, int]] = []  # covered words, first start
            for k, (start, end, place) in enumerate(parts):
                covered, first = end - start, start
                reach = start - MOST_GAP - size
                for j in range(k - 1, -1, -1):
                    s, e, p = parts[j]
                    if s < reach:
                        break
                    # Overlapping runs count once; both must go on in text and template.
                    over = max(0, e - start, p - (place - (end - start)))
                    if over >= end - start or e > end or p > place:
                        continue
                    if start - e <= MOST_GAP and place - (end - start) - p <= MOST_GAP:
                        if best[j][0] + end - start - over > covered:
                            covered, first = best[j][0] + end - start - over, best[j][1]
                best.append((covered, first))
                found.append((number, first, end, min(1.0, covered / size)))
        found.sort(key=lambda f: (-f[3], -(f[2] - f[1]), f[1], f[0]))
        taken: dict[int, list[tuple[int, int]]] = {}
        kept = []
        for number, start, end, share in found:
            if all(end <= a or b <= start for a, b in taken.get(number, [])):
                taken.setdefault(number, []).append((start, end))
                kept.append((number, start, end, share))
        return kept


def templates() -> list[Template]:
    phrases = [Template(label, tuple(words_of(p)), True) for p, label in PHRASES.items()]
    return phrases + [Template(label, tuple(words_of(t)), False) for label, ts in TEMPLATES.items() for t in ts]


@cache
def automaton() -> Automaton:
    return Automaton(templates())


FOUND = (
    "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string,"
    " labels string, score double, spans array<struct<label: string, start: bigint, end: bigint, share: double>>"
)


def scan_text(text: str | None) -> dict:
    own = automaton()
    words = words_of(text)
    places, matches = own.stream(words)
    spans = own.spans(matches)
    base = {own.templates[number].label for _, number in places}
    more = {own.templates[number].label for number, _, _, share in spans if share >= LEAST_SHARE}
    starts = [start for start, _ in places]
    return {
        "n_words": len(words),
        "n_base": len(places),
        "first_word": min(starts, default=None),
        "last_word": max(starts, default=None),
        "base_labels": ",".join(sorted(base)),
        "labels": ",".join(sorted(base | more)),
        "score": 1.0 if places else max([0.0, *(share for _, _, _, share in spans)]),
        "spans": [
            {"label": own.templates[n].label, "start": a, "end": b, "share": share}
            for n, a, b, share in sorted(spans, key=lambda s: (s[1], s[2], s[0]))
            if share >= LEAST_SHARE
        ],
    }


def scan(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: words, phrases, labels, score, and spans of templates (in words)."""
    span = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("share", pa.float64())])
    kinds = {"base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(span)}
    names = [c.strip().split()[0] for c in FOUND.split(", spans")[0].split(",")] + ["spans"]
    fields = pa.schema([(n, kinds.get(n, pa.int64())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [{"doc_id": i, **scan_text(t.as_py())} for i, t in zip(ids, batch.column("text"))]
            yield pa.RecordBatch.from_pylist(rows, schema=fields)

    rows = documents.select(documents[doc_id].cast("bigint").alias("doc_id"), documents[text].alias("text"))
    return rows.mapInArrow(run, FOUND)
