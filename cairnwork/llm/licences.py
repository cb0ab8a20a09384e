r"""License scans: base phrases, and templates with optional and replaceable regions.

Words are the runs of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing A-Z. Base: each place where a phrase's words
stand consecutively.

Method: a template is marked-up text: [[ ... ]] may be left out, <name:n> stands for at most n words of any kind.
It is compiled once to an automaton over words (states are positions; optional regions and wildcards become
transitions that may skip or stay). A text is accepted where a run of its words takes the automaton from its
first to its last state, which means that every mandatory word matches exactly, in order. Runs start only where
the template's first mandatory words stand, so that ordinary text costs a substring search; optional regions before these
take no part, as a text is accepted with or without them. Whole licence texts (MIT, BSD with 2 and 3 clauses, ISC, the Apache
and Mozilla headers, the GNU notice) have templates, and so have shorter notices.

score: 1 if a whole template was accepted, else 0.5 if a base phrase stands there, else 0.

Defined cases: null text counts as empty (no words, empty labels, score 0); an empty table gives no rows; repeated
rows give a row each; overlapping templates all give their labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnwork.llm.common import as_bytes, load, ship

# The base phrases and their labels.
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Published licence texts and notices in template markup, words as this module splits them.
MIT_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files [[the software]] to deal in [[the software]] <what:4> without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"
MIT_NOTICE = "the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software"
MIT_WARRANTY = "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
BSD_HEAD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
BSD_SOURCE = "[[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
BSD_BINARY = "[[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
BSD_NAMES = "[[3]] neither the name of <holder:12> nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"
BSD_WARRANTY = "this software is provided by <by:12> as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <holders:12> be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
ISC_GRANT = "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"
ISC_WARRANTY = "the software is provided as is and <author:6> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall <holder:6> be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
APACHE_HEADER = "licensed under the apache license version 2 0 [[the license]] you may not use this file except in compliance with the license you may obtain a copy of the license at [[http]] [[https]] www apache org licenses license 2 0 [[txt]] [[html]] unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"
MPL_NOTICE = "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at [[http]] [[https]] mozilla org mpl 2 0"
GPL_NOTICE = "this program is free software you can redistribute it and or modify it under the terms of the gnu <kind:1> general public license as published by the free software foundation [[either]] version <number:1> of the license [[or at your option any later version]]"
TEMPLATES = (
    (f"{MIT_GRANT} {MIT_NOTICE} {MIT_WARRANTY}", "mit-full"),
    (f"{BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_NAMES} {BSD_WARRANTY}", "bsd-3-full"),
    (f"{BSD_HEAD} {BSD_SOURCE} {BSD_BINARY} {BSD_WARRANTY}", "bsd-2-full"),
    (f"{ISC_GRANT} {ISC_WARRANTY}", "isc-full"),
    (APACHE_HEADER, "apache-2-full-header"),
    (MPL_NOTICE, "mpl-2-full-notice"),
    (GPL_NOTICE, "gpl-full-notice"),
    (MIT_GRANT, "mit-text"),
    (BSD_HEAD, "bsd-text"),
    ("[[<lead:3>]] released under the [[terms of the]] mit license", "mit-notice"),
    ("licensed under the apache license version 2 0 [[the license]]", "apache-2-notice"),
    ("you may not use this file except in compliance with the license", "apache-2-header"),
    ("[[this work is]] licensed under [[a]] [[the]] cc by nc <version:3>", "cc-by-nc-notice"),
    ("licensed under [[a]] [[the]] creative commons attribution noncommercial <version:3> [[international]] license", "cc-by-nc-notice"),
    ("licensed under [[a]] [[the]] creative commons attribution <version:2> [[international]] license", "cc-by-notice"),
    ("[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 3", "gpl-3-notice"),
    ("[[this work is]] licensed under the gnu general public license [[as published by the free software foundation]] [[either]] version 2", "gpl-2-notice"),
    ("under the terms of the gnu <kind:1> general public license", "gnu-notice"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2-notice"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc-text"),
    ("copyright <year:3> <holder:6> all rights reserved", "all-rights-reserved"),
)

#: Upper- to lower-case for A-Z; every other byte that belongs to no word becomes a space.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Automaton:
    """States 0..n; state i has a step: ('word', w), ('any', how many) or skips that lead on without a word."""

    def __init__(self, markup: str, label: str) -> None:
        self.label, self.steps, self.skips = label, [], {}
        opened = []
        for token in re.findall(r"\[\[|\]\]|<\w+:\d+>|[^\s\[\]<>]+", markup):
            if token == "[[":
                opened.append(len(self.steps))
            elif token == "]]":
                self.skips.setdefault(opened.pop(), []).append(len(self.steps))
            elif token[0] == "<":
                for _ in range(int(token[1:-1].split(":")[1])):
                    self.skips.setdefault(len(self.steps), []).append(len(self.steps) + 1)
                    self.steps.append(None)
            else:
                self.steps.append(token.encode())
        self.end = len(self.steps)
        # the first mandatory words, as far as they stand together, anchor the search
        k, self.lead = 0, 0
        while k in self.skips:
            k = max(self.skips[k])
        self.first = k
        stop = next((i for i in range(k, self.end) if i in self.skips or self.steps[i] is None), self.end)
        self.anchor = self.steps[k:stop]

    def closure(self, states: Iterable[int]) -> set[int]:
        out, work = set(), list(states)
        while work:
            s = work.pop()
            if s not in out:
                out.add(s)
                work += self.skips.get(s, ())
        return out

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether a run from the anchor's state, at this word, reaches the end."""
        states = self.closure([self.first])
        while states:
            if self.end in states:
                return True
            if at == len(words):
                return False
            w = words[at]
            states = self.closure(s + 1 for s in states if s < self.end and (self.steps[s] is None or self.steps[s] == w))
            at += 1
        return False


def compile_templates(templates: Iterable[tuple[str, str]]) -> list[Automaton]:
    return [Automaton(*t) for t in templates]


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Where the phrase's words stand consecutively."""
    out, at, n = [], -1, len(phrase)
    try:
        while True:
            at = words.index(phrase[0], at + 1)
            if words[at : at + n] == phrase:
                out.append(at)
    except ValueError:
        return out


def inspect(text: bytes, base: list, automata: list[Automaton]) -> tuple[int, int, int | None, int | None, set, set, float]:
    words = text.translate(WORDS).split()
    line = b" ".join(words)
    starts, labels, more = [], set(), set()
    for phrase, joined, label in base:
        if joined in line and (found := places(words, phrase)):
            starts += found
            labels.add(label)
    for a in automata:
        if b" ".join(a.anchor) in line and any(a.accepts(words, p) for p in places(words, a.anchor)):
            more.add(a.label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels, labels | more, 1.0 if more else 0.5 if labels else 0.0


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES) -> DataFrame:
    """One row per document: words, base places, base labels, all labels and the score."""
    ship(docs.sparkSession)
    phrases = [(p.encode().split(), p.encode(), label) for p, label in base]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = compile_templates(templates)
        for batch in batches:
            rows = [inspect(t or b"", phrases, automata) for t in as_bytes(batch.column(1))]
            column = lambda k, kind: pa.array([r[k] for r in rows], kind)  # noqa: B023, E731
            joined = lambda k: pa.array([",".join(sorted(r[k])) for r in rows], pa.string())  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(column(k, pa.int64()) for k in range(4)), joined(4), joined(5), column(6, pa.float64())],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(load(spark, sf_dir, "documents"))
