"""License scans by template-markup matching.

A template is wording with markup: <<opt>> ... <</opt>> may be left out, <<var:n>> stands
for up to n words of any kind, and <<alt:a|b>> for one of some wordings. It compiles to an
automaton over words; a text matches where the automaton runs through, so its mandatory
words stand there exactly and in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: (label, phrase) of the base: places where the words stand consecutively.
PHRASES = (("gpl", "gnu general public license"), ("apache", "apache license"), ("cc-by", "cc by"), ("mit", "mit license"))
# The wording of whole licenses, and of the headers that refer to one.
MIT_OPENING = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<opt>>the software<</opt>> to deal in the software without restriction"
MIT_REST = (
    "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
    "the above copyright notice and this permission notice <<opt>>including the next paragraph<</opt>> shall be included in all copies or substantial portions of the software "
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
    "in no event shall <<var:6>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
ISC = (
    "permission to use copy modify and <<opt>>or<</opt>> distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
    "the software is provided as is and <<var:6>> <<alt:disclaims|disclaim>> all warranties with regard to this software including all implied warranties of merchantability and fitness "
    "in no event shall <<var:6>> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
BSD_OPENING = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_CONDITIONS = (
    "<<opt>>1<</opt>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<opt>>2<</opt>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_NAMES = "<<opt>>3<</opt>> neither the name of <<var:8>> nor the names of <<alt:its|their>> contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_DISCLAIMER = (
    "this software is provided by <<var:8>> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
    "in no event shall <<var:8>> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
APACHE_HEADER = (
    "licensed under the apache license version 2 0 <<opt>>the license<</opt>> you may not use this file except in compliance with the license you may obtain a copy of the license at <<alt:http|https>> www apache org licenses license 2 0 "
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
    "see the license for the specific language governing permissions and limitations under the license"
)
MPL_HEADER = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at <<alt:http|https>> <<opt>>www<</opt>> mozilla org mpl 2 0"
#: (label, template) of the method. What ends in -opening is the beginning of a license, whose rest
#: may be altered; it scores half.
TEMPLATES = (
    ("mit", f"{MIT_OPENING} {MIT_REST}"),
    ("mit-opening", MIT_OPENING),
    ("isc", ISC),
    ("bsd-2-clause", f"{BSD_OPENING} {BSD_CONDITIONS} {BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{BSD_OPENING} {BSD_CONDITIONS} {BSD_NAMES} {BSD_DISCLAIMER}"),
    ("bsd-opening", BSD_OPENING),
    ("apache-2.0-header", APACHE_HEADER),
    ("mpl-2.0-header", MPL_HEADER),
    ("gpl-3.0", "gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 3 <<opt>>of the license<</opt>> <<opt>>0<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>"),
    ("gpl-2.0", "gnu general public license <<opt>>as published by the free software foundation<</opt>> <<opt>>either<</opt>> version 2 <<opt>>of the license<</opt>> <<opt>>0<</opt>> <<opt>>or <<opt>>at your option<</opt>> any later version<</opt>>"),
    ("lgpl", "gnu <<alt:lesser|library>> general public license <<opt>>version <<var:2>><</opt>>"),
    ("apache-2.0", "licensed under the apache license version 2 0 <<opt>>the license<</opt>>"),
    ("mit", "<<alt:released|licensed|distributed|available>> under the <<opt>>terms of the<</opt>> mit license"),
    ("cc-by-nc-4.0", "<<opt>>licensed under <<opt>>a<</opt>><</opt>> <<alt:cc|creative commons>> <<alt:by|attribution>> <<alt:nc|noncommercial>> <<opt>>sa<</opt>> 4 0 <<opt>>international <<opt>>license<</opt>><</opt>>"),
    ("cc-by-4.0", "<<opt>>licensed under <<opt>>a<</opt>><</opt>> <<alt:cc|creative commons>> <<alt:by|attribution>> 4 0 <<opt>>international <<opt>>license<</opt>><</opt>>"),
    ("mpl-2.0", "subject to the terms of the mozilla public license <<opt>>v<</opt>> <<opt>>version<</opt>> 2 0"),
    ("copyright", "copyright <<opt>>c<</opt>> <<var:6>> all rights reserved"),
)
ANY = b""


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text with A-Z lower-cased; none for null."""
    return WORD.findall((text or "").encode().lower())


@dataclass
class Automaton:
    """steps: for each state the word -> next states; skips: states reached without a word."""

    label: str
    n_words: int
    steps: list[dict[bytes, list[int]]]
    skips: list[list[int]]
    first: set[bytes]

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that starts at word at, or -1."""
        states, end, k = self.closed({0}), -1, at
        final = len(self.steps) - 1
        while states:
            if final in states:
                end = k
            if k == len(words):
                break
            w, new = words[k], set()
            for s in states:
                new.update(self.steps[s].get(w, ()))
                new.update(self.steps[s].get(ANY, ()))
            states, k = self.closed(new), k + 1
        return end

    def closed(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen


def compile_template(label: str, template: str) -> Automaton:
    steps: list[dict[bytes, list[int]]] = [{}]
    skips: list[list[int]] = [[]]
    opened: list[int] = []
    mandatory = 0

    def state() -> int:
        steps.append({})
        skips.append([])
        return len(steps) - 1

    def word(at: int, w: bytes) -> int:
        new = state()
        steps[at].setdefault(w, []).append(new)
        return new

    here = 0
    for part in re.findall(r"<<.*?>>|[^<]+", template):
        if part == "<<opt>>":
            opened.append(here)
            fresh = state()
            skips[here].append(fresh)
            here = fresh
        elif part == "<</opt>>":
            fresh = state()
            skips[here].append(fresh)
            skips[opened.pop()].append(fresh)
            here = fresh
        elif part.startswith("<<var:"):
            start, fresh = here, None
            ends = [start]
            for _ in range(int(part[6:-2])):
                here = word(here, ANY)
                ends.append(here)
            fresh = state()
            for e in ends:
                skips[e].append(fresh)
            here = fresh
        elif part.startswith("<<alt:"):
            ends = []
            for wording in part[6:-2].split("|"):
                at = here
                for w in words_of(wording):
                    at = word(at, w)
                ends.append(at)
            fresh = state()
            for e in ends:
                skips[e].append(fresh)
            here = fresh
            mandatory += not opened
        else:
            for w in words_of(part):
                here = word(here, w)
                mandatory += not opened
    if opened:
        raise ValueError(f"{label}: an optional region is not closed")
    out = Automaton(label, mandatory, steps, skips, set())
    for s in out.closed({0}):
        out.first.update(steps[s])
    if len(steps) - 1 in out.closed({0}) or ANY in out.first:
        raise ValueError(f"{label}: it has to begin with wording")
    return out


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: tuple = PHRASES,
    templates: tuple = TEMPLATES,
) -> DataFrame:
    """What every whole text says of its license; one row for each row of docs.

    n_words; n_base: all places of the phrases, of each phrase the overlapping ones too;
    first_word and last_word: the smallest and largest start of these places, from 0, null
    without any; base_labels; labels: those and the templates', sorted, distinct, joined by
    commas; matches: the templates' places as label:first-end; score: the share of matched
    wording that is mandatory, at its best template (half for the opening of a license), or
    0.5 for a phrase alone, else 0.
    Null and empty texts have no words and empty labels. Rows are independent, so nothing
    is shuffled; other columns are ignored; repeated rows stay; an empty table gives none.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = [compile_template(*t) for t in templates]
        base = [(label, words_of(p)) for label, p in phrases]
        starts: dict[bytes, list] = {}
        for label, wording in base:
            starts.setdefault(wording[0], []).append((label, wording, None))
        for a in automata:
            for w in a.first:
                starts.setdefault(w, []).append((a.label, None, a))
        common = set(starts)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = words_of(text.as_py())
                places, labels, matches, score = [], set(), [], 0.0
                if not common.isdisjoint(words):
                    for at, w in enumerate(words):
                        for label, wording, automaton in starts.get(w, ()):
                            if automaton is None:
                                if words[at : at + len(wording)] == wording:
                                    places.append(at)
                                    labels.add(label)
                            elif (end := automaton.match(words, at)) >= 0:
                                matches.append((label, at, end))
                                score = max(score, automaton.n_words / (end - at) * (0.5 if label.endswith("-opening") else 1.0))
                more = sorted(labels | {m[0] for m in matches})
                rows.append((len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(labels)), ",".join(more), ",".join(f"{a}:{s}-{e}" for a, s, e in matches), min(1.0, score) if matches else 0.5 if places else 0.0))
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.float64()]
            names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "matches", "score"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]], names=["id", *names])

    out = docs.select(docs[id_col].alias("id"), docs[text_col].alias("t")).mapInArrow(scan, f"id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, matches string, score double")
    return out.withColumnRenamed("id", id_col)
