"""License scan: fixed phrases, and licence templates compiled to token automata.

A template is a licence notice or text with markup: [[...]] is optional wording, nested
at will, {{n}} stands for one to n free words (a holder's name, say), and (a|b) for one of
several words. It compiles to a nondeterministic automaton over words; a text holds the
licence if some run of its words is accepted, so that all mandatory wording stands there
exactly. The automaton runs from the places of the template's first word only, and only
in texts that hold all of its mandatory words.

Words and places are counted over whole texts, in one pass without a shuffle. Defined
results for odd input: null is an empty text and gives zero words, no places (null first
and last word), no labels and score 0; repeated rows each give their row; further columns
are ignored. The score is 1 if the template of a whole text accepts, 0.9 if that of a notice
does, 0.5 if only a phrase stands there, else 0.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label: templates of notices, and of wording that is a licence's own.
TEMPLATES = {
    "mit": [
        "(released|licensed|distributed|available|published) under the [[terms of the]] [[x11]] mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
        " the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish"
        " distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so"
        " [[subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be"
        " included in all copies or substantial portions of the software]]",
    ],
    "apache-2": [
        "(licensed|released|distributed|available) under [[the terms of]] the apache license version 2 [[0]]",
    ],
    "bsd-3-clause": [
        "neither the name of {{12}} nor the names of its contributors may be used to endorse or promote products derived from this software"
        " without specific prior written permission",
    ],
    "bsd-4-clause": ["all advertising materials mentioning features or use of this software must display the following acknowledgement"],
    "isc": [
        "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that"
        " the above copyright notice and this permission notice appear in all copies",
    ],
    "gpl-3": [
        "gnu general public license version 3 29 june 2007",
        "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 3",
        "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license"
        " [[or at your option any later version]]",
    ],
    "gpl-2": [
        "gnu general public license version 2 june 1991",
        "licensed under [[the terms of]] the gnu general public license [[as published by the free software foundation]] [[either]] version 2",
    ],
    "lgpl-3": ["gnu lesser general public license version 3 29 june 2007", "licensed under [[the terms of]] the gnu lesser general public license [[as published by the free software foundation]] [[either]] version 3"],
    "agpl-3": ["gnu affero general public license version 3 19 november 2007", "licensed under [[the terms of]] the gnu affero general public license [[as published by the free software foundation]] [[either]] version 3"],
    "mpl-2": ["mozilla public license version 2 0 1 definitions", "subject to the terms of the mozilla public license v [[2]] 2 0", "licensed under the mozilla public license [[version]] 2 0"],
    "cc-by-nc": [
        "licensed under [[a]] [[the]] [[creative commons]] cc by nc [[(1|2|3|4)]] [[(0|5)]]",
        "licensed under [[a]] [[the]] creative commons attribution (noncommercial|non) [[commercial]] [[(1|2|3|4)]] [[(0|5)]] [[international]] license",
    ],
    "cc-by": ["licensed under [[a]] [[the]] creative commons attribution [[(1|2|3|4)]] [[(0|5)]] [[international]] license"],
    "cc-by-sa": ["licensed under [[a]] [[the]] creative commons attribution (sharealike|share) [[alike]] [[(1|2|3|4)]] [[(0|5)]] [[international]] license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "zlib": ["this software is provided as is without any express or implied warranty in no event will the authors be held liable"],
}

# Disclaimers that several texts end with; holders' names are replaceable.
MIT_ENDS = (
    " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose"
    " [[title]] and (noninfringement|non) [[infringement]] in no event shall {{12}} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from"
    " out of or in connection with the software or the use or other dealings in the software"
)
BSD_BEGINS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    " [[(1|a)]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"
    " [[(2|b)]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"
)
BSD_ENDS = (
    " this software is provided by {{12}} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    " in no event shall {{12}} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits"
    " or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software"
    " even if advised of the possibility of such damage"
)
ISC_ENDS = (
    " the software is provided as is and {{6}} (disclaims|disclaim) all warranties with regard to this software including all implied warranties of merchantability and fitness"
    " in no event shall {{6}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"
    " whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software"
)
ISC_BEGINS = "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted"

#: Label: templates of whole texts.
TEXTS = {
    "mit": [TEMPLATES["mit"][1].split(" [[subject")[0] + " subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software" + MIT_ENDS],
    "bsd-2-clause": [BSD_BEGINS + BSD_ENDS],
    "bsd-3-clause": [BSD_BEGINS + " [[(3|c)]] " + TEMPLATES["bsd-3-clause"][0].replace("nor the names of its contributors", "nor the names of [[its]] contributors") + BSD_ENDS],
    "isc": [ISC_BEGINS + " provided that the above copyright notice and this permission notice appear in all copies" + ISC_ENDS],
    "0bsd": [ISC_BEGINS + ISC_ENDS],
    "zlib": [
        "this software is provided as is without any express or implied warranty in no event will {{8}} be held liable for any damages arising from the use of this software"
        " permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"
        " [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required"
        " [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
    ],
    "bsd-4-clause": [
        BSD_BEGINS + " [[(3|c)]] all advertising materials mentioning features or use of this software must display the following acknowledgement this product includes software developed by {{20}}"
        " [[(4|d)]] " + TEMPLATES["bsd-3-clause"][0].replace("nor the names of its contributors", "nor the names of [[its]] contributors") + BSD_ENDS
    ],
    "boost-1": [
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute"
        " and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following"
        " the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer must be included in all copies of the software in whole or in part"
        " and all derivative works of the software unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"
        " the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose title and (noninfringement|non) [[infringement]]"
        " in no event shall the copyright holders or anyone distributing the software be liable for any damages or other liability whether in contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ],
    "unlicense": [
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary"
        " for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain"
        " we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law"
        + MIT_ENDS.replace("{{12}}", "the authors"),
    ],
    "wtfpl": [
        "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"
        " do what the fuck you want to public license terms and conditions for copying distribution and modification [[0]] you just do what the fuck you want to",
    ],
}

#: Label: longer notices, which stand for texts that are kept elsewhere.
NOTICES = {
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {{12}}"
        " unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"
        " see the license for the specific language governing permissions and limitations under the license",
    ],
    **{
        f"{kind}-{n}": [
            f"is free software you can redistribute it and or modify it under the terms of the gnu {name} public license as published by the free software foundation either version {n} of the license or at your option any later version"
            f" {{{{8}}}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu {name} public license for more details"
        ]
        for kind, name, versions in (("gpl", "general", "23"), ("lgpl", "lesser general", "3"), ("agpl", "affero general", "3"))
        for n in versions
    },
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"],
}

#: Whole texts that hold another licence's notice: that one counts only if its own text stands there as well.
HOLDS = {"bsd-4-clause": "bsd-3-clause"}

#: Which bytes of lower-cased UTF-8 are of words.
IN_WORD = np.zeros(256, np.bool_)
IN_WORD[0x30:0x3A] = IN_WORD[0x61:0x7B] = IN_WORD[0x80:] = True
GAP = rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BASE = {
    re.compile(rb"(?<![0-9a-z\x80-\xff])" + GAP.join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])"): (p.encode().split(), label)
    for p, label in PHRASES.items()
}


class Automaton:
    """A template's states; arcs[state] lists (words or None for any, next state); empty moves are followed at once."""

    def __init__(self, template: str):
        self.arcs: list[list[tuple[frozenset[bytes] | None, int]]] = [[]]
        self.moves: list[list[int]] = [[]]
        marks = re.findall(r"\[\[|\]\]|\{\{\d+\}\}|\([^)]*\)|[^\s\[\]{}()]+", template)
        at, stack, mandatory = 0, [], []
        for m in marks:
            if m == "[[":
                stack.append(at)
            elif m == "]]":
                self.moves[stack.pop()].append(at)
            elif m.startswith("{{"):
                first = at
                skips = []
                for _ in range(int(m[2:-2])):
                    at = self.arc(at, None)
                    skips.append(at)
                for s in skips[:-1]:
                    self.moves[s].append(at)
                assert first != at
            else:
                options = frozenset(x.encode() for x in m.strip("()").split("|"))
                at = self.arc(at, options)
                if not stack and len(options) == 1:
                    mandatory += options
        self.final, self.mandatory = at, set(mandatory)
        self.begins = {w for s in self.reached({0}) for words, _ in self.arcs[s] for w in words or ()}

    def arc(self, at: int, words: frozenset[bytes] | None) -> int:
        self.arcs.append([])
        self.moves.append([])
        self.arcs[at].append((words, len(self.arcs) - 1))
        return len(self.arcs) - 1

    def reached(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.moves[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def accepts(self, words: list[bytes]) -> bool:
        """Whether some run of the words is accepted: all live starts advance together."""
        live: set[int] = set()
        for w in words:
            if w in self.begins:
                live |= self.reached({0})
            if live:
                live = self.reached({to for s in live for options, to in self.arcs[s] if options is None or w in options})
                if self.final in live:
                    return True
        return False


@lru_cache(maxsize=1)
def automata() -> list[tuple[str, float, Automaton]]:
    """(label, score, automaton) of every template."""
    return [(label, score, Automaton(t)) for table, score in ((TEXTS, 1.0), (NOTICES, 0.9), (TEMPLATES, 0.9)) for label, templates in table.items() for t in templates]


@lru_cache(maxsize=1)
def rarest() -> list[bytes]:
    """For each automaton a long mandatory word, to look for first."""
    return sorted({max(a.mandatory, key=len) for _, _, a in automata()})


def template_labels(low: bytes) -> dict[str, float]:
    """The labels of the templates that accept a lower-cased text, each with its best score."""
    there = {w for w in rarest() if w in low}
    if not there:
        return {}
    words = WORD.findall(low)
    vocabulary = set(words)
    found: dict[str, float] = {}
    for label, score, a in automata():
        if found.get(label, 0.0) < score and a.mandatory <= vocabulary and a.accepts(words):
            found[label] = score
    for whole, inner in HOLDS.items():
        if found.get(whole) == 1.0 and found.get(inner, 1.0) < 1.0:
            del found[inner]
    return found


def scan_text(low: bytes, starts: np.ndarray) -> tuple[list[tuple[int, str]], dict[str, float]]:
    """The phrases' (first word, label) and all templates' labels of a lower-cased text; starts: bytes at which its words begin."""
    places = []
    for pattern, (parts, label) in BASE.items():
        if max(parts, key=len) in low and parts[0] in low:
            places += [(int(np.searchsorted(starts, m.start())), label) for m in pattern.finditer(low)]
    return places, template_labels(low)


def word_starts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Positions in the joined texts at which words begin; a text's end ends a word."""
    inside = IN_WORD[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < len(raw)]
    begins[first] = inside[first]
    return np.flatnonzero(begins)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 2048):
                yield scan_batch(whole.slice(k, 2048))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scan_batch(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in batch.column("text").to_pylist()]
    offsets = np.cumsum([0, *map(len, texts)])
    starts = word_starts(np.frombuffer(b"".join(texts), np.uint8), offsets)
    bounds = np.searchsorted(starts, offsets)
    rows = []
    for i, low in enumerate(texts):
        places, labels = scan_text(low, starts[bounds[i] : bounds[i + 1]] - offsets[i])
        base = {x for _, x in places}
        at = [p for p, _ in places]
        rows.append((len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels.keys())), max(labels.values(), default=0.5 if base else 0.0)))
    n, first, last, base, labels, score = zip(*rows) if rows else [()] * 6
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(np.diff(bounds), pa.int64()), pa.array(n, pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
        names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    )
