"""Licence scan: template markup compiled into token automata.

Templates are written with ``<<beginOptional>>``, ``<<endOptional>>`` and
``<<var;most=N>>`` (any 0 to N words).  A template becomes a small
nondeterministic automaton over words; a place of a text is accepted where every
mandatory word follows exactly, optional regions stand or don't, and replaceable
regions take any words.  Only texts with a template's rarest mandatory word (its
anchor) are looked at, and only as far around its places as the template reaches;
there one pass carries the states of all starts at once, so the work grows in
proportion to the text.

Defined results: a null text has no words and no labels; first_word and
last_word are null without a base phrase; repeated rows give equal results;
extra columns are ignored; an empty table stays empty.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame

from . import runtime

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Labels, anchors and templates; the wording is that of the public licence texts and notices.
TEMPLATES = (
    ("mit-notice", "license", "<<beginOptional>>released<<endOptional>><<beginOptional>>licensed<<endOptional>> under the mit license"),
    ("apache-2.0-notice", "apache", "licensed under the apache license version 2 0"),
    ("gpl-notice", "gnu", "licensed under the <<beginOptional>>terms of the<<endOptional>> gnu <<beginOptional>>lesser<<endOptional>><<beginOptional>>affero<<endOptional>> general public license <<var;most=3>> version <<var;most=1>>"),
    ("cc-notice", "cc", "licensed under <<beginOptional>>a<<endOptional>><<beginOptional>>the<<endOptional>> cc by <<beginOptional>>nc<<endOptional>> <<beginOptional>>sa<<endOptional>><<beginOptional>>nd<<endOptional>>"),
    ("cc-notice", "commons", "licensed under <<var;most=2>> creative commons attribution"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
    (
        "mit-text",
        "sublicense",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software. "
        "The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. "
        "In no event shall <<var;most=8>> be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software "
        "or the use or other dealings in the software",
    ),
    (
        "isc-text",
        "fee",
        "Permission to use, copy, modify, and <<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "The software is provided as is and <<var;most=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "In no event shall <<var;most=8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    ),
    (
        "0bsd-text",
        "fee",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. "
        "The software is provided as is and <<var;most=8>> disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. "
        "In no event shall <<var;most=8>> be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, "
        "whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software",
    ),
    *(
        (
            label,
            "redistribution",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: <<beginOptional>>1<<endOptional>> "
            "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. <<beginOptional>>2<<endOptional>> "
            "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
            + third
            + "This software is provided by <<var;most=10>> as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. "
            "In no event shall <<var;most=10>> be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; "
            "loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
            "arising in any way out of the use of this software, even if advised of the possibility of such damage",
        )
        for label, third in (
            ("bsd-2-text", ""),
            ("bsd-3-text", "<<beginOptional>>3<<endOptional>> Neither the name of <<var;most=10>> nor the names of <<var;most=4>> contributors may be used to endorse or promote products derived from this software without specific prior written permission. "),
        )
    ),
    (
        "apache-2.0-header",
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at <<var;most=8>> "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, either express or implied. "
        "See the License for the specific language governing permissions and limitations under the License",
    ),
    (
        "gpl-header",
        "gnu",
        "<<var;most=6>> is free software <<beginOptional>>you<<endOptional>> can <<beginOptional>>you can<<endOptional>> redistribute it and/or modify it under the terms of the GNU <<beginOptional>>Lesser<<endOptional>><<beginOptional>>Affero<<endOptional>> General Public License "
        "as published by the Free Software Foundation <<var;most=14>> "
        "<<beginOptional>>This program<<endOptional>> is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. "
        "See the GNU <<beginOptional>>Lesser<<endOptional>><<beginOptional>>Affero<<endOptional>> General Public License for more details",
    ),
    (
        "mpl-2.0-header",
        "mozilla",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at <<var;most=6>> mozilla org mpl 2 0",
    ),
    (
        "zlib-text",
        "misrepresented",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<beginOptional>>1<<endOptional>> "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "<<beginOptional>>2<<endOptional>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<beginOptional>>3<<endOptional>> "
        "This notice may not be removed or altered from any source distribution",
    ),
)

_KEEP = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or 48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 else 32 for b in range(256))
_MARKUP = re.compile(r"<<(.*?)>>")


def words_of(text: str) -> list[bytes]:
    """Words of a text with A-Z lower-cased: runs of ASCII letters, digits and other characters beyond ASCII."""
    return text.encode().translate(_KEEP).split()


class Automaton:
    """States are places in the template; ``step[s]`` is (word, next) or (None, next) for any word."""

    def __init__(self, label: str, anchor: str, template: str):
        self.label, self.anchor = label, anchor.encode()
        self.word: list[bytes | None] = []
        self.skip: list[list[int]] = [[]]
        opens: list[int] = []
        self._mandatory: list[bytes] = []
        for i, part in enumerate(_MARKUP.split(template)):
            if i % 2 == 0:
                for w in words_of(part):
                    self._add(w)
                    if not opens:
                        self._mandatory.append(w)
            elif part == "beginOptional":
                opens.append(len(self.word))
            elif part == "endOptional":
                self.skip[opens.pop()].append(len(self.word))
            elif part.startswith("var"):
                most = int(re.search(r"most=(\d+)", part)[1])
                first = len(self.word)
                for _ in range(most):
                    self._add(None)
                for k in range(first, len(self.word)):
                    self.skip[k].append(len(self.word))
            else:
                raise ValueError(f"unknown markup {part!r}")
        if opens:
            raise ValueError("an optional region isn't closed")
        if self.anchor not in self._mandatory:
            raise ValueError(f"the anchor {anchor!r} isn't a mandatory word of {label}")
        #: How many words may stand before and behind an anchor within the template.
        at = [i for i, w in enumerate(self.word) if w == self.anchor]
        self.before, self.behind = max(at), len(self.word) - min(at)
        self._start = frozenset(self._closure({0}))
        self._opening = {self.word[s] for s in self._start if s < len(self.word)}

    def _add(self, word: bytes | None) -> None:
        self.word.append(word)
        self.skip.append([])

    def _closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for t in self.skip[todo.pop()]:
                if t not in states:
                    states.add(t)
                    todo.append(t)
        return states

    def found(self, words: list[bytes], places: list[int]) -> bool:
        """True if the wording stands anywhere around one of the anchor's places (ascending)."""
        begin = stop = 0
        for p in [*places, None]:
            if p is not None and p - self.before <= stop:
                begin, stop = (begin if stop else max(0, p - self.before)), p + self.behind
                continue
            if stop and self._run(words, begin, min(stop, len(words))):
                return True
            if p is not None:
                begin, stop = p - self.before, p + self.behind
        return False

    def _run(self, words: list[bytes], begin: int, stop: int) -> bool:
        """One pass over words[begin:stop] with a new start at each word."""
        word, end, opening, free = self.word, len(self.word), self._opening, None in self._opening
        states: set[int] = set()
        for i in range(begin, stop):
            w = words[i]
            if free or w in opening:
                states |= self._start
            if states:
                states = self._closure({s + 1 for s in states if word[s] is None or word[s] == w})
                if end in states:
                    return True
        return False


def scan(text: str, automata: list[Automaton], base: list[tuple[list[bytes], str]]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score) of one text."""
    words = words_of(text)
    n_base, first, last, labels = 0, None, None, set()
    need = {a.anchor for a in automata} | {p[-1] for p, _ in base}
    hit = need.intersection(words)
    if not hit:
        return len(words), 0, None, None, "", "", 0.0
    places: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in hit:
            places.setdefault(w, []).append(i)
    for phrase, label in base:
        for p in places.get(phrase[-1], ()):
            i = p - len(phrase) + 1
            if i >= 0 and words[i : p + 1] == phrase:
                n_base += 1
                first = i if first is None else min(first, i)
                last = i if last is None else max(last, i)
                labels.add(label)
    own = {a.label for a in automata if a.anchor in places and a.found(words, places[a.anchor])}
    return len(words), n_base, first, last, ",".join(sorted(labels)), ",".join(sorted(labels | own)), 1.0 if own else 0.5 if labels else 0.0


def find(docs: DataFrame, templates=TEMPLATES, base=BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence phrases and accepted templates of every document; no shuffle."""
    automata = [Automaton(*t) for t in templates]
    phrases = [(p.encode().split(), label) for p, label in base]

    def kernel(col: pa.Array) -> list:
        rows = [scan(t.as_py(), automata, phrases) for t in col]
        return [list(x) for x in zip(*rows)]

    fields = [("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")]
    return runtime.map_text(docs, kernel, fields, text_col, (id_col,))
