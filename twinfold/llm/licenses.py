"""License scans by template markup.

A template is text with marked regions: `[[...]]` may be missing, `{{n-m}}` stands for n to m words of any kind; all other wording is
mandatory and must match word for word (A-Z in lower case, words as below, punctuation ignored). A template is compiled into an automaton
over tokens; a text carries the license where the automaton accepts a run of its words. Automata start only where the template's
longest mandatory phrase stands in the text, so texts without it cost one substring search.

Base phrases are plain word sequences, counted at all places. score is the share of a text's words inside accepted regions and base
phrases. Null text is empty: no words, no labels, score 0. Rows are scanned one by one, whole, very long ones too; repeated rows give
repeated results. Only the named columns are read, whatever the others are called. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import as_bytes, mapped

#: The contract's phrases and labels: fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Public license wordings as templates: fixed values. Whole licenses have their usual names; -header and -notice stand for texts that refer
#: to a license, -grant for a license's first sentence alone.
_AS_IS = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {{1-8}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
_MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
_ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
_ISC_REST = "the software is provided as is and {{1-8}} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {{1-8}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
_BSD_GRANT = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
_BSD_TWO = "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
_BSD_THIRD = "[[3]] neither the name of {{1-12}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
_BSD_REST = "this software is provided by {{1-12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {{1-12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
TEMPLATES = {
    "0bsd": f"{_ISC_GRANT} {_ISC_REST}",
    "all-rights-reserved": "copyright [[c]] {{1-8}} all rights reserved",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "apache-2.0-notice": "licensed under the apache license version 2 [[0]]",
    "bsd-2-clause": f"{_BSD_GRANT} {_BSD_TWO} {_BSD_REST}",
    "bsd-3-clause": f"{_BSD_GRANT} {_BSD_TWO} {_BSD_THIRD} {_BSD_REST}",
    "bsd-grant": _BSD_GRANT,
    "cc-by-4.0-notice": "[[this work is]] licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-4.0-notice": "[[this work is]] licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nc-notice": "licensed under [[a]] [[the]] cc by nc 4 0 [[license]]",
    "gpl-header": "[[this]] {{0-3}} is free software you can redistribute it and or modify it under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation either version {{1-2}} of the license or at your option any later version {{1-4}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu [[lesser]] [[affero]] general public license for more details",
    "gpl-3.0-notice": "[[this work is]] licensed under the gnu general public license version 3 [[or any later version]]",
    "gpl-notice": "under the terms of the gnu [[lesser]] [[affero]] general public license as published by the free software foundation",
    "isc": f"{_ISC_GRANT} provided that the above copyright notice and this permission notice appear in all copies {_ISC_REST}",
    "isc-grant": _ISC_GRANT,
    "mit": f"[[the]] [[mit]] [[license]] {_MIT_GRANT} including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software {_AS_IS}",
    "mit-grant": _MIT_GRANT,
    "mit-notice": "[[this work is]] [[released]] [[licensed]] under the mit license",
    "mpl-2.0-header": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0",
    "mpl-2.0-notice": "subject to the terms of the mozilla public license v 2 0",
    "unlicense": f"this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law {_AS_IS}",
    "zlib": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
}

#: Bytes that end a word, and A-Z: the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] over lower-cased text.
_CUT = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 48 or 58 <= c <= 96 or 123 <= c <= 127 else c for c in range(256))
_PART = re.compile(r"\[\[(.*?)\]\]|\{\{(\d+)-(\d+)\}\}|([^\[\]{}\s]+)")


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_CUT).split()


@dataclass
class Automaton:
    """States are numbers; steps[state] maps a word to the next state, `any_step` reads any word, `free` needs none."""

    steps: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_step: dict[int, int] = field(default_factory=dict)
    free: dict[int, list[int]] = field(default_factory=dict)
    anchor: tuple[bytes, ...] = ()
    ahead: int = 0  # most words that may stand before the anchor

    def _word(self, w: bytes) -> None:
        self.steps.append({})
        self.steps[-2][w] = len(self.steps) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free.get(todo.pop(), ()):
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run from start; -1 if there is none."""
        states, at, end, last = self.closure({0}), start, -1, len(self.steps) - 1
        while states:
            if last in states:
                end = at
            if at == len(words):
                break
            w = words[at]
            after = {self.steps[s][w] for s in states if w in self.steps[s]} | {self.any_step[s] for s in states if s in self.any_step}
            states, at = self.closure(after), at + 1
        return end


def compile_template(template: str) -> Automaton:
    """The automaton of a template; its anchor is the longest run of mandatory words."""
    a, run, best, ahead, before = Automaton(), [], [], 0, 0
    read = 0  # most words read so far
    for option, low, high, word in _PART.findall(template):
        if word:
            found = words_of(word.encode())
            for w in found:
                if not run:
                    before = read
                a._word(w)
                run.append(w)
                read += 1
            if len(run) > len(best):
                best, ahead = run[:], before
            continue
        run = []
        start = len(a.steps) - 1
        if option:
            for w in words_of(option.encode()):
                a._word(w)
                read += 1
            a.free.setdefault(start, []).append(len(a.steps) - 1)
        else:
            for k in range(int(high)):
                a.steps.append({})
                a.any_step[len(a.steps) - 2] = len(a.steps) - 1
            read += int(high)
            for k in range(int(low), int(high)):
                a.free.setdefault(start + k, []).append(len(a.steps) - 1)
    if not best:
        raise ValueError("a template needs mandatory words")
    a.anchor, a.ahead = tuple(best), ahead
    return a


def places(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which phrase (words between spaces) starts in a line of ` word word `."""
    out, at, word, seen = [], line.find(phrase), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        out.append(word)
        at = line.find(phrase, at + 1)
    return out


class Scanner:
    """Base phrases and compiled templates, for the tasks."""

    def __init__(self, base: dict[str, str], templates: dict[str, str]):
        self.base = [(b" " + b" ".join(words_of(p.encode())) + b" ", len(words_of(p.encode())), label) for p, label in base.items()]
        self.automata = [(label, compile_template(t)) for label, t in templates.items()]

    def scan(self, text: bytes) -> tuple[int, list[int], set[str], set[str], float, list[tuple[int, int, str]]]:
        """(words, starts of base phrases, base labels, all labels, score, accepted spans of words)."""
        words = words_of(text)
        line = b" " + b" ".join(words) + b" "
        starts, base, spans = [], set(), []
        for phrase, n, label in self.base:
            if at := places(line, phrase):
                starts += at
                base.add(label)
                spans += [(s, s + n, label) for s in at]
        for label, a in self.automata:
            done = -1
            for at in places(line, b" " + b" ".join(a.anchor) + b" "):
                if at < done:
                    continue
                found = max(((s, e) for s in range(max(0, at - a.ahead), at + 1) if (e := a.longest(words, s)) > at), key=lambda x: (x[1] - x[0], -x[0]), default=None)
                if found:
                    spans.append((*found, label))
                    done = found[1]
        covered, reach = 0, 0
        for s, e, _ in sorted(spans):
            covered += max(0, e - max(s, reach))
            reach = max(reach, e)
        return len(words), starts, base, base | {x[2] for x in spans}, covered / len(words) if words else 0.0, sorted(spans)


def scan_licenses(documents: DataFrame, base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep columns, n_words, n_base, first_word, last_word, base_labels, labels, score and spans (start, end, label) of each row."""
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("label", T.StringType())])
    fields = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()), ("spans", T.ArrayType(span))]
    schema = T.StructType([*documents.select(*keep).schema.fields, *(T.StructField(n, t) for n, t in fields)])
    arrow_span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates)
        for b in batches:
            found = [scanner.scan(x) for x in as_bytes(b.column(b.num_columns - 1))]
            columns = [
                pa.array([x[0] for x in found], pa.int64()), pa.array([len(x[1]) for x in found], pa.int64()), pa.array([min(x[1], default=None) for x in found], pa.int64()), pa.array([max(x[1], default=None) for x in found], pa.int64()),
                pa.array([",".join(sorted(x[2])) for x in found]), pa.array([",".join(sorted(x[3])) for x in found]), pa.array([x[4] for x in found], pa.float64()),
                pa.array([[{"start": s, "end": e, "label": n} for s, e, n in x[5]] for x in found], arrow_span),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *columns], schema.names)

    return mapped(documents.select(*keep, F.col(text).alias("__text")), run, schema)


def scanned(documents: DataFrame) -> DataFrame:
    """The contract's columns."""
    return scan_licenses(documents).drop("spans")
