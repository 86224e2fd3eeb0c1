"""License scan: templates with optional and replaceable regions, run as token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namesift.llm.common import MIX, Powers, documents, mix, row_key, word_hashes

# The phrases of the base count and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Templates by label. Text in <<optional>>..<</optional>> may be left out; <<var n>> takes up to
# n words, <<var n: a | b>> exactly one of the wordings given. Everything else is mandatory.
TEMPLATES = {
    "mit-notice": "<<optional>>this work is<</optional>> <<var 1: released | licensed | distributed>> under the <<optional>>terms of the<</optional>> mit license",
    "apache-2.0-notice": "licensed under the apache license <<optional>>version<</optional>> 2 0",
    "gpl-3.0-notice": "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 3",
    "gpl-2.0-notice": "licensed under the <<optional>>terms of the<</optional>> gnu general public license <<optional>>as published by the free software foundation<</optional>> <<optional>>either<</optional>> version 2",
    "cc-by-nc-4.0-notice": "licensed under <<optional>>a<</optional>> <<var 2: cc | creative commons>> <<var 1: by | attribution>> <<var 1: nc | noncommercial>> <<optional>>international<</optional>> 4 0",
    "cc-by-4.0-notice": "licensed under <<optional>>a<</optional>> <<var 2: cc | creative commons>> <<var 1: by | attribution>> <<optional>>international<</optional>> 4 0",
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and
        associated documentation files <<optional>>the software<</optional>> to deal in the software without restriction
        including without limitation the rights to use copy modify merge publish distribute sublicense and or sell
        copies of the software and to permit persons to whom the software is furnished to do so subject to the following
        conditions the above copyright notice and this permission notice <<optional>>including the next paragraph<</optional>>
        shall be included in all copies or substantial portions of the software the software is provided as is without
        warranty of any kind express or implied including but not limited to the warranties of merchantability fitness
        for a particular purpose and noninfringement in no event shall <<var 12>> be liable for any claim damages or
        other liability whether in an action of contract tort or otherwise arising from out of or in connection with
        the software or the use or other dealings in the software""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby
        granted provided that the above copyright notice and this permission notice appear in all copies the software is
        provided as is and <<var 6>> disclaims all warranties with regard to this software including all implied
        warranties of merchantability and fitness""",
    "bsd": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<optional>>1<</optional>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> redistributions
        in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
        the documentation and or other materials provided with the distribution""",
    "gpl-3.0-or-later": """this <<var 1: program | library | file | software>> is free software you can redistribute it and or modify it under
        the terms of the gnu general public license as published by the free software foundation either version 3 of
        the license or <<optional>>at your option<</optional>> any later version""",
    "gpl-2.0-or-later": """this <<var 1: program | library | file | software>> is free software you can redistribute it and or modify it under
        the terms of the gnu general public license as published by the free software foundation either version 2 of
        the license or <<optional>>at your option<</optional>> any later version""",
    "gpl-2.0-only": """this <<var 1: program | library | file | software>> is free software you can redistribute it and or modify it under
        the terms of the gnu general public license <<optional>>version 2<</optional>> as published by the free software
        foundation <<var 3: version 2 | either version 2>> of the license <<var 2: this program | along with>>""",
    "lgpl-2.1-or-later": """this <<var 1: program | library | file | software>> is free software you can redistribute it and or modify it under
        the terms of the gnu lesser general public license as published by the free software foundation either version
        2 1 of the license or <<optional>>at your option<</optional>> any later version""",
    "lgpl-3.0-or-later": """this <<var 1: program | library | file | software>> is free software you can redistribute it and or modify it under
        the terms of the gnu lesser general public license as published by the free software foundation either version
        3 of the license or <<optional>>at your option<</optional>> any later version""",
    "agpl-3.0-or-later": """this <<var 1: program | library | file | software>> is free software you can redistribute it and or modify it under
        the terms of the gnu affero general public license as published by the free software foundation either version
        3 of the license or <<optional>>at your option<</optional>> any later version""",
    "apache-2.0": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with
        the license you may obtain a copy of the license at <<var 1: http | https>> www apache org licenses license 2 0
        unless required by applicable law or agreed to in writing software distributed under the license is distributed
        on an as is basis without warranties or conditions of any kind either express or implied see the license for the
        specific language governing permissions and limitations under the license""",
    "mpl-2.0": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at <<var 1: http | https>> mozilla org mpl 2 0""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<optional>>1<</optional>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> redistributions
        in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
        the documentation and or other materials provided with the distribution this software is provided by""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that
        the following conditions are met <<optional>>1<</optional>> redistributions of source code must retain the above
        copyright notice this list of conditions and the following disclaimer <<optional>>2<</optional>> redistributions
        in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in
        the documentation and or other materials provided with the distribution <<optional>>3<</optional>> neither the
        name of <<var 12>> nor the names of <<var 6>> contributors may be used to endorse or promote products derived from
        this software without specific prior written permission""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will <<var 6>> be held liable
        for any damages arising from the use of this software permission is granted to anyone to use this software for any
        purpose including commercial applications and to alter it and redistribute it freely subject to the following
        restrictions""",
    "bsl-1.0": """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license the software to use reproduce display distribute execute and
        transmit the software and to prepare derivative works of the software""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose
        commercial or non commercial and by any means""",
    "epl-2.0": """this program and the accompanying materials are made available under the terms of the eclipse public license
        <<optional>>v<</optional>> 2 0 which <<var 1: is | accompanies>>""",
    "cc0-1.0": """the person who associated a work with this deed has dedicated the work to the public domain by waiving all of
        his or her rights to the work worldwide under copyright law""",
    "cc-by-sa-4.0-notice": "licensed under <<optional>>a<</optional>> <<optional>>the<</optional>> <<var 2: cc | creative commons>> <<var 1: by | attribution>> <<var 2: sa | sharealike | share alike>> <<optional>>international<</optional>> 4 0",
}

# Identifiers of the short form of a license line; each is a template of its own.
IDENTIFIERS = (
    "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only"
    " LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause MPL-2.0 ISC Zlib BSL-1.0 CC0-1.0 CC-BY-4.0"
    " CC-BY-SA-4.0 EPL-2.0 Unlicense"
).split()
TEMPLATES |= {f"spdx-{x.lower()}": "spdx license identifier " + x.lower() for x in IDENTIFIERS}
# Words that turn a notice into its opposite when they stand right before it.
NEGATIONS = ("not", "never", "nor", "no")

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MARKUP = re.compile(r"(<<.*?>>)")
_TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: bytes | None, powers: Powers) -> np.ndarray:
    data = _LOWER[np.frombuffer(text or b"", np.uint8)]
    return word_hashes(data, _WORD[data], powers)[0]


def _hashes(text: str) -> list[int]:
    return [int(x) for x in words_of(text.encode(), Powers())]


@dataclass
class Automaton:
    """States with moves on a word, on any word (``None``) and on nothing; state 0 starts."""

    moves: list[dict[int | None, set[int]]] = field(default_factory=lambda: [{}])
    free: list[set[int]] = field(default_factory=lambda: [set()])
    accept: int = 0

    def state(self) -> int:
        self.moves.append({})
        self.free.append(set())
        return len(self.moves) - 1

    def chain(self, start: int, tokens: list[int | None]) -> int:
        for t in tokens:
            after = self.state()
            self.moves[start].setdefault(t, set()).add(after)
            start = after
        return start

    def closure(self, states: set[int]) -> frozenset[int]:
        open_, seen = list(states), set(states)
        while open_:
            for s in self.free[open_.pop()] - seen:
                seen.add(s)
                open_.append(s)
        return frozenset(seen)

    def step(self, states: frozenset[int], word: int) -> frozenset[int]:
        return self.closure({s for x in states for key in (word, None) for s in self.moves[x].get(key, ())})

    def match(self, words: list[int], at: int) -> int | None:
        """End of the longest accepted run from ``at``; mandatory words have to be there exactly."""
        states, end = self.closure({0}), None
        for i in range(at, len(words) + 1):
            if self.accept in states:
                end = i
            if i == len(words) or not (states := self.step(states, words[i])):
                break
        return end

    def openings(self) -> set[tuple[int, int]]:
        """Every pair of words that an accepted run can begin with."""
        out = set()
        for first in {k for s in self.closure({0}) for k in self.moves[s]}:
            for second in {k for s in self.step(self.closure({0}), first) for k in self.moves[s]}:
                if first is None or second is None:
                    raise ValueError("a template has to begin with two words that are not free")
                out.add((first, second))
        return out


def compile_template(text: str) -> Automaton:
    """Automaton of a template: its words in order, optional regions that may be passed over, replaceable ones."""
    auto, here, starts = Automaton(), 0, []
    for part in _MARKUP.split(text):
        if part == "<<optional>>":
            starts.append(here)
        elif part == "<</optional>>":
            end = auto.state()
            auto.free[here].add(end)
            auto.free[starts.pop()].add(end)
            here = end
        elif part.startswith("<<var"):
            head, _, wordings = part[5:-2].partition(":")
            end = auto.state()
            if wordings:
                for wording in wordings.split("|"):
                    auto.free[auto.chain(here, _hashes(wording))].add(end)
            else:
                auto.free[here].add(end)
                for _ in range(int(head)):
                    here = auto.chain(here, [None])
                    auto.free[here].add(end)
            here = end
        else:
            here = auto.chain(here, _hashes(part))
    auto.accept = here
    return auto


def _pairs(words: np.ndarray) -> np.ndarray:
    return mix(words[:-1] * MIX + words[1:])


@lru_cache(maxsize=4)
def _compiled(templates: tuple[tuple[str, str], ...]) -> tuple[dict[int, list[str]], dict[str, Automaton]]:
    autos = {label: compile_template(text) for label, text in templates}
    openings: dict[int, list[str]] = {}
    for label, auto in autos.items():
        for pair in auto.openings():
            openings.setdefault(int(_pairs(np.array(pair, np.uint64))[0]), []).append(label)
    return openings, autos


@lru_cache(maxsize=1)
def _negations() -> frozenset[int]:
    return frozenset(_hashes(" ".join(NEGATIONS)))


@lru_cache(maxsize=1)
def _phrases() -> tuple[tuple[np.ndarray, str], ...]:
    return tuple((np.array(_hashes(p), np.uint64), label) for p, label in PHRASES.items())


def scan(text: bytes | None, powers: Powers, templates: tuple[tuple[str, str], ...]) -> tuple:
    """(n_words, n_base, first_word, last_word, base labels, template matches) of a whole text.

    A template match is (label, first word, end). Automata start only where two words
    open a template, so their work follows the matches and not the text. A run right behind a negation is no match.
    """
    words = words_of(text, powers)
    places, base = [], set()
    for phrase, label in _phrases():
        n = len(words) - len(phrase) + 1
        if n > 0:
            hits = np.flatnonzero(words[:n] == phrase[0])
            for k in range(1, len(phrase)):
                hits = hits[words[hits + k] == phrase[k]]
            if len(hits):
                places.append(hits)
                base.add(label)
    openings, autos = _compiled(templates)
    found = []
    if len(words) > 1:
        pairs = _pairs(words)
        starts = np.flatnonzero(np.isin(pairs, np.array(list(openings), np.uint64)))
        listed = words.tolist() if len(starts) else []
        for at in starts.tolist():
            if at and listed[at - 1] in _negations():
                continue
            for label in openings[int(pairs[at])]:
                end = autos[label].match(listed, at)
                if end is not None:
                    found.append((label, at, end))
    at = np.concatenate(places) if places else np.zeros(0, np.int64)
    first, last = (int(at.min()), int(at.max())) if len(at) else (None, None)
    return len(words), len(at), first, last, sorted(base), found


SCHEMA = (
    "row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string,"
    " labels string, score double, matches array<struct<label: string, first: long, end: long>>"
)


def scanned(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per row of ``docs`` with phrase counts, labels, score and template matches.

    The score is 1 if a template is matched in full, half if only a phrase is found,
    else 0. Null and empty texts have no words. ``row`` is the content key of doc_id
    and text; other columns are not looked at.
    """
    held = tuple((TEMPLATES if templates is None else templates).items())
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")[:9]] + ["matches"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
    match = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                n, count, first, last, base, found = scan(text.as_py(), powers, held)
                labels = sorted({*base, *[f[0] for f in found]})
                score = 1.0 if found else 0.5 if base else 0.0
                rows.append((n, count, first, last, ",".join(base), ",".join(labels), score, found))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            matches = [[dict(zip(("label", "first", "end"), m, strict=True)) for m in row] for row in columns[7]]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays, pa.array(matches, match)], names)

    keyed = docs.select(row_key("doc_id", "text"), F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return keyed.mapInArrow(run, SCHEMA)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates of every document."""
    return scanned(documents(spark, sf_dir)).drop("row", "matches")
