"""Licence texts in files by a generalised suffix automaton over licence words.

The automaton holds every run of words of every template. A file is streamed through it
once; at each word the length of the longest run that ends there is known (the matching
statistic). Maximal long runs are then chained, in template order, into spans of the file
that a template covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases that mark a label wherever their words stand in a row.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
GNU = ("this {} is free software you can redistribute it and or modify it under the terms of the gnu {} as published by the "
       "free software foundation either version {} of the license or at your option any later version")
BSD_OPENING = ("redistribution and use in source and binary forms with or without modification are permitted provided that "
               "the following conditions are met")
# Standard notices by which files name their licence, and whole paragraphs of the short licences. The whole
# texts of the long licences (Apache, GNU, Mozilla, Creative Commons) are not among them.
TEMPLATES = {
    "mit": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
            "documentation files the software to deal in the software without restriction",
            "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
            "the software is provided as is without warranty of any kind express or implied including but not limited to the "
            "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or "
            "copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
            "otherwise arising from out of or in connection with the software or the use or other dealings in the software"],
    "apache-2": ["licensed under the apache license version 2 0",
                 "you may not use this file except in compliance with the license you may obtain a copy of the license at",
                 "unless required by applicable law or agreed to in writing software distributed under the license is "
                 "distributed on an as is basis without warranties or conditions of any kind either express or implied"],
    "cc-by-nc": ["licensed under cc by nc 4 0", "this work is licensed under a creative commons attribution noncommercial "
                 "4 0 international license"],
    "cc-by": ["licensed under cc by 4 0", "this work is licensed under a creative commons attribution 4 0 international license"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3",
              GNU.format("program", "general public license", "3")],
    "gpl-2": [GNU.format("program", "general public license", "2")],
    "lgpl-2.1": [GNU.format("library", "lesser general public license", "2 1")],
    "lgpl-3": [GNU.format("library", "lesser general public license", "3"), GNU.format("program", "lesser general public license", "3")],
    "agpl-3": [GNU.format("program", "affero general public license", "3")],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0",
              "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
            "provided that the above copyright notice and this permission notice appear in all copies"],
    "unlicense": ["this is free and unencumbered software released into the public domain",
                  "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or "
                  "as a compiled binary for any purpose commercial or non commercial and by any means"],
    "bsd-2": [BSD_OPENING,
              "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
              "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following "
              "disclaimer in the documentation and or other materials provided with the distribution"],
    "bsd-3": ["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
              "products derived from this software without specific prior written permission"],
}
FOUND = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
         "score double, spans array<struct<label:string,template:int,first:long,last:long,covered:double>>")


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences; a state keeps the first place its runs end at, per sequence."""

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                state = last
                while state > 0:
                    self.ends[state].setdefault(number, place)
                    state = self.link[state]

    def _state(self, length: int, link: int, copy: int | None = None) -> int:
        self.next.append({} if copy is None else dict(self.next[copy]))
        self.ends.append({} if copy is None else dict(self.ends[copy]))
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, word: int) -> int:
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], q)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new, p = self._state(self.length[last] + 1, 0), last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, word)
        return new

    def statistics(self, words):
        """(state, length of the longest run of the sequences that ends here) for each word."""
        state = length = 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


def words_of(text: str) -> list[bytes]:
    """Lower-case (A-Z) runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").lower().translate(BREAKS).split()


BREAKS = bytes(c if 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


class LicenceScanner:
    """Phrase places and covered template spans of one text."""

    def __init__(self, templates: dict[str, list[str]], phrases: dict[str, str], least_run: int, least_cover: float, gap: int):
        import numpy as np

        self.templates = [(label, t.encode().lower().split()) for label in sorted(templates) for t in templates[label]]
        self.phrases = [(p.encode().lower().split(), label) for p, label in sorted(phrases.items())]
        self.ids: dict[bytes, int] = {}
        for _, words in [*self.templates, *((None, p) for p, _ in self.phrases)]:
            for word in words:
                self.ids.setdefault(word, len(self.ids))
        self.automaton = SuffixAutomaton([[self.ids[w] for w in words] for _, words in self.templates])
        self.least_run, self.least_cover, self.gap = least_run, least_cover, gap
        self.coded = [([self.ids[w] for w in p], label) for p, label in self.phrases]
        self.pairs = np.zeros((len(self.ids) + 1, len(self.ids) + 1), np.int8)
        for _, words in self.templates:
            for left, right in zip(words, words[1:], strict=False):
                self.pairs[self.ids[left], self.ids[right]] = 1

    def _runs(self, first: int, codes: list[int]):
        """Maximal matches (template, place in it, place in the text, length) of one stretch of known words."""
        seen = list(self.automaton.statistics(codes))
        for at, (state, length) in enumerate(seen):
            grows = at + 1 < len(seen) and seen[at + 1][1] == length + 1
            if length >= self.least_run and not grows:
                for number, end in self.automaton.ends[state].items():
                    yield number, end - length + 1, first + at - length + 1, length

    def _chains(self, runs: list[tuple[int, int, int, int]]):
        """Runs of one template that follow each other in text and template, not too far apart."""
        for number in sorted({r[0] for r in runs}):
            label, words = self.templates[number]
            chain: list[tuple[int, int, int]] = []

            def span(chain=chain, number=number, label=label, words=words):
                covered = sum(length for _, _, length in chain) / len(words)
                if covered >= self.least_cover:
                    return (label, number, chain[0][1], chain[-1][1] + chain[-1][2] - 1, min(1.0, covered))
                return None

            for _, place, at, length in sorted((r for r in runs if r[0] == number), key=lambda r: (r[2], r[1])):
                if chain:
                    p, a, n = chain[-1]
                    if not (place >= p + n and a + n <= at <= a + n + self.gap):
                        if found := span():
                            yield found
                        chain.clear()
                chain.append((place, at, length))
            if chain and (found := span()):
                yield found

    def _settled(self, spans):
        """Spans without those of another label that lie mostly in one of more words; what BSD licences share goes by the third clause."""
        import bisect

        known = [(s, s[4] * len(self.templates[s[1]][1])) for s in spans]
        firsts, longest = [s[2] for s in spans], max((s[3] - s[2] for s in spans), default=0)

        def beaten(s, n):
            near = known[bisect.bisect_left(firsts, s[2] - longest):bisect.bisect_right(firsts, s[3])]
            return any(t[0] != s[0] and m > n and 2 * (min(s[3], t[3]) - max(s[2], t[2]) + 1) > s[3] - s[2] + 1 for t, m in near)

        kept, part, parts = [s for s, n in known if not beaten(s, n)], 0, []
        for s in kept:
            part += s[0] == "bsd-2" and self.templates[s[1]][1] == BSD_OPENING.encode().split()
            parts.append(part)
        third = {p for p, s in zip(parts, kept, strict=True) if s[0] == "bsd-3"}
        return [("bsd-3", *s[1:]) if s[0] == "bsd-2" and p in third else s for p, s in zip(parts, kept, strict=True)]

    def scan(self, text: str) -> tuple:
        import numpy as np

        words = words_of(text)
        code, other = self.ids.get, len(self.ids)
        codes = np.array([code(w, other) for w in words], np.int32)
        places, base, runs = [], set(), []
        for phrase, label in self.coded:
            at = np.flatnonzero(codes == phrase[0])
            for step, word in enumerate(phrase[1:], 1):
                at = at[at < len(codes) - step]
                at = at[codes[at + step] == word]
            if len(at):
                places += at.tolist()
                base.add(label)
        # Only stretches whose every pair of neighbours stands in some template can hold a run.
        paired = np.zeros(len(codes) + 1, np.int8)
        paired[1:-1] = self.pairs[codes[:-1], codes[1:]] if len(codes) > 1 else 0
        edges = np.flatnonzero(np.diff(paired)).reshape(-1, 2)
        for first, end in edges[edges[:, 1] - edges[:, 0] >= self.least_run - 1].tolist():
            runs += self._runs(first, codes[first:end + 1].tolist())
        spans = self._settled(sorted(self._chains(runs), key=lambda s: (s[2], s[3], s[0], s[1])))
        labels = base | {s[0] for s in spans}
        score = max([1.0 if base else 0.0, *(s[4] for s in spans)])
        return (len(words), len(places), min(places, default=None), max(places, default=None),
                ",".join(sorted(base)), ",".join(sorted(labels)), score,
                [dict(zip(("label", "template", "first", "last", "covered"), s, strict=True)) for s in spans])


def scan_licences(docs: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, phrases: dict[str, str] = PHRASES,
                  least_run: int = 4, least_cover: float = 0.7, gap: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text; others ignored): words, phrase places, labels, score and spans.

    A phrase counts wherever its words stand in a row, overlaps included. A span is a chain of
    runs of at least ``least_run`` words with at most ``gap`` other words between them that
    covers ``least_cover`` of a template; of spans of two labels at one place the one of more words
    stays. The BSD licences are told apart by the third clause. ``score`` is 1 with a phrase, else the best cover.
    NULL and empty texts have no words and no labels (empty strings); a NULL doc_id stays;
    repeated rows are scanned each; an empty table gives no rows. Whole texts are read.
    """

    def scan(batches):
        import pyarrow as pa

        scanner = LicenceScanner(templates, phrases, least_run, least_cover, gap)
        spans = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first", pa.int64()),
                                    ("last", pa.int64()), ("covered", pa.float64())]))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), spans]
        names = [c.split()[0] for c in FOUND.split(", ")][1:8] + ["spans"]
        for batch in batches:
            found = list(zip(*(scanner.scan(t.as_py() or "") for t in batch.column(1)), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(f, k) for f, k in zip(found, kinds, strict=True))],
                                             names=["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(scan, FOUND)
