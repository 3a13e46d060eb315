"""License scans: templates with optional and replaceable regions, compiled into token automata.

A template is a text with two kinds of markup: ``<<opt>> ... <<end>>`` may be left out, and
``<<any 1..4>>`` stands for as many words of any wording; ``a|b`` is either word. Words outside both
must match exactly, one after another. Texts are tokenised as bytes: A-Z count as a-z, words are
runs of 0-9, a-z and bytes from 0x80.

Null and empty texts have no words, no places and no labels. Equal texts get equal rows; repeated rows and
rows without doc_id are scanned each, extra columns are ignored, an empty table gives no rows. Where several
templates match, all their labels are given. Long texts are read whole, in parts cut between words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, raw, slices, small_batches
from .shingles import word_hashes

# The phrases whose places are always reported, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
TEMPLATES = {
    "mit": "released under the <<opt>>terms of the<<end>> mit license|licence",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<any 1..4>> to deal in the software without restriction",
    "apache-2.0": "licensed under the apache license|licence version 2 0 <<opt>>the license<<end>>",
    "gpl": "<<opt>>this <<any 1..3>> is<<end>> licensed|released|distributed under the <<opt>>terms of the<<end>> gnu <<opt>>lesser|affero<<end>> general public license|licence <<opt>>version <<any 1..1>><<end>>",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-line": "licensed|released under the <<any 0..2>> bsd license|licence",
    "cc": "licensed|released under <<opt>>a|the<<end>> creative commons <<any 1..6>> license|licence",
    "cc-by-line": "cc by <<opt>>sa|nc|nd<<end>> <<any 1..2>>",
    "mit-full": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<any 1..4>> to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice <<opt>>including the next paragraph<<end>> shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software"
    ),
    "isc": (
        "permission to use copy modify and|or <<opt>>or<<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and <<any 1..4>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall <<any 1..4>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
    ),
    "bsd-2-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<any 0..45>> this software is provided by <<any 1..8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall <<any 1..8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits "
        "or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software "
        "even if advised of the possibility of such damage"
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "<<opt>>1<<end>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "<<opt>>2<<end>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "<<opt>>3<<end>> neither the name|names of <<any 1..12>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
    ),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "<<opt>>1<<end>> the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment|acknowledgement in the product documentation would be appreciated but is not required "
        "<<opt>>2<<end>> altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "<<opt>>3<<end>> this notice may not be removed or altered from any source distribution"
    ),
    "apache-2.0-notice": (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http|https www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license"
    ),
    "gpl-notice": (
        "<<any 1..4>> is free software you can redistribute it and or modify it under the terms of the gnu <<opt>>lesser|affero<<end>> general public license as published by the free software foundation "
        "either version 2|3 <<opt>>1<<end>> of the license or at your option any later version <<any 1..4>> is distributed in the hope that it will be useful but without any warranty "
        "without even the implied warranty of merchantability or fitness for a particular purpose see the gnu <<opt>>lesser|affero<<end>> general public license for more details"
    ),
    "mpl-2.0": "subject to the terms of the mozilla public license v 2 0",
    "copyright": "copyright <<opt>>c<<end>> <<any 1..6>> all rights reserved",
}
_GAP = np.ones(256, bool)
_GAP[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, and the row it is in."""
    return word_hashes(data, offsets, _GAP)


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words_of(data, np.array([0, len(data)]))[0][0])


class Automaton:
    """A template as an automaton over word hashes.

    States 0..n-1 read a word (a set of hashes, or None for any word); ``skip[s]`` are the states that
    can follow without reading. State n accepts. ``anchor`` is the longest mandatory word before any
    region of unknown wording, and ``before`` the numbers of words that can stand in front of it.
    """

    def __init__(self, template: str):
        self.reads: list[frozenset[int] | None] = []
        self.skip: dict[int, set[int]] = {}
        opened: list[int] = []
        mandatory: list[int] = []
        names: list[str] = []
        for part in re.findall(r"<<opt>>|<<end>>|<<any \d+\.\.\d+>>|[^\s<]+", template):
            at = len(self.reads)
            if part == "<<opt>>":
                opened.append(at)
            elif part == "<<end>>":
                self.skip.setdefault(opened.pop(), set()).add(at)
            elif part.startswith("<<any"):
                low, high = map(int, re.findall(r"\d+", part))
                for k in range(high):
                    if k >= low:
                        self.skip.setdefault(at + k, set()).add(at + high)
                    self.reads.append(None)
                    names.append("")
            else:
                self.reads.append(frozenset(map(word_hash, part.split("|"))))
                names.append(part)
                if not opened:
                    mandatory.append(at)
        self.end = len(self.reads)
        fixed = [s for s in mandatory if all(r is not None for r in self.reads[:s])] or mandatory  # before any region of unknown wording
        self.anchor = max(fixed, key=lambda s: (min(map(len, names[s].split("|"))), -s))
        self.mandatory = frozenset(mandatory)
        self.before = self._distances()

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.skip.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def _distances(self) -> list[int]:
        found, states = [], self.closure({0})
        for distance in range(self.end + 1):
            if self.anchor in states:
                found.append(distance)
            states = self.closure({s + 1 for s in states if s < self.anchor})
        return found

    def match(self, words: np.ndarray, start: int) -> tuple[int, float]:
        """The end of the longest match that begins at ``start`` (-1: none), and the share of mandatory words read."""
        states, at, end, most = self.closure({0}), start, -1, 0
        while states:
            if self.end in states:
                end = at
            if at == len(words):
                break
            word = int(words[at])
            moved = {s + 1 for s in states if s < self.end and (self.reads[s] is None or word in self.reads[s])}
            most = max([most, *(sum(m < s for m in self.mandatory) for s in moved)])
            states, at = self.closure(moved), at + 1
        return end, 1.0 if end >= 0 else most / len(self.mandatory)


def compile_templates(templates: dict[str, str] | None = None) -> dict[str, Automaton]:
    return {label: Automaton(text) for label, text in (templates or TEMPLATES).items()}


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan(templates: dict[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compile_templates(templates)
        phrases = {tuple(map(word_hash, p.split())): label for p, label in PHRASES.items()}
        anchors: dict[int, list[str]] = {}
        for label, a in automata.items():
            for h in a.reads[a.anchor]:
                anchors.setdefault(h, []).append(label)
        keys = np.array(sorted(anchors), np.uint64)
        for batch in slices(batches):
            words, of = words_of(*raw(batch.column("text")))
            rows = batch.num_rows
            counts = np.bincount(of, minlength=rows)
            begin = np.concatenate(([0], np.cumsum(counts)))
            places: list[list[int]] = [[] for _ in range(rows)]
            base: list[set[str]] = [set() for _ in range(rows)]
            for phrase, label in phrases.items():
                full = len(words) - len(phrase) + 1
                if full <= 0:
                    continue
                hit = of[:full] == of[len(phrase) - 1 :]
                for k, h in enumerate(phrase):
                    hit = hit & (words[k : k + full] == np.uint64(h))
                for i in np.flatnonzero(hit):
                    places[of[i]].append(int(i - begin[of[i]]))
                    base[of[i]].add(label)
            more: list[set[str]] = [set() for _ in range(rows)]
            score = np.zeros(rows)
            slot = np.searchsorted(keys, words)
            slot[slot == len(keys)] = 0
            for i in np.flatnonzero(keys[slot] == words) if len(words) else ():
                r = int(of[i])
                own = words[begin[r] : begin[r + 1]]
                for label in anchors[int(words[i])]:
                    for distance in automata[label].before:
                        start = int(i - begin[r]) - distance
                        if start >= 0:
                            end, share = automata[label].match(own, start)
                            score[r] = max(score[r], share)
                            if end >= 0:
                                more[r].add(label)
            yield arrow_rows(
                _OUT,
                doc_id=batch.column("doc_id").cast(pa.int64()),
                n_words=counts,
                n_base=[len(p) for p in places],
                first_word=[min(p, default=None) for p in places],
                last_word=[max(p, default=None) for p in places],
                base_labels=[",".join(sorted(b)) for b in base],
                labels=[",".join(sorted(b | m)) for b, m in zip(base, more, strict=True)],
                score=np.where([bool(b) for b in base], 1.0, score),
            )

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """A row for each document: its words, places of the base phrases, labels of phrases and accepted templates.

    score: 1 where a phrase or template matches, else the largest share of a template's mandatory
    words that the text has in order from its start.
    """
    small_batches(docs.sparkSession)
    ddl = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
    return docs.select("doc_id", "text").mapInArrow(_scan(templates or TEMPLATES), ddl)
