"""License scan: a trained paragraph classifier, confirmed by templates (operator 6).

A paragraph is a line with a word, or a run of words over several lines of a block; blocks lie between lines without a word,
so that hard-wrapped statements are read whole. Such a run is a shortest one that holds at least ``ALIKE`` of the words of a
template and at most twice as many words as it. Of paragraphs that overlap the one most alike counts, and at a tie the line; what else is
on the lines of a run is a paragraph of its own. A paragraph's sparse features are word n-grams (one to three words) that occur in the training
paragraphs and are not made of ``STOP`` words alone. Multinomial logistic regression gives the licence families, ``unknown``
(a licence statement of no known family) and ``none``. It is trained here, on sentences made from ``TEMPLATES`` and
``OTHERS`` by seeded changes of case, words and surroundings. A temperature, fitted on sentences that the training has not
seen, calibrates the probabilities; a family whose probability stays below ``SURE`` becomes ``unknown``. A predicted family is
confirmed if the paragraph holds at least ``ALIKE`` of the words of one of the family's templates, in their order (all of them, if
they are four or fewer); otherwise it too becomes ``unknown``. An unknown statement holds a word that speaks of licences (``SAID``); in
a text with a statement of a known family it must also name a licence, else it is the rest of that family's text. A block in which no
line or run is a statement is judged once more as a whole. A line is also confirmed if its words and those of one of the family's ``HEADINGS`` agree, ``ALIKE`` of
both together; a line that is just a heading has its family, whatever the model says.

Texts without any word of the features are ``none`` without further work, which is what the model gives them. Null and empty
texts hold no paragraph and no licence; very long ones are read whole. Of statements that are equally sure and alike the first
one counts. Repeated rows are scanned each; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import random
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch, in_arrow, texts_of

SEED, PER_TEMPLATE, PASSES, STEP, RIDGE, SURE, ALIKE = 7, 40, 300, 4.0, 1e-4, 0.6, 0.7
#: Key sentences of well-known licences and the ways in which works name them.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", "SPDX-License-Identifier: MIT"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0"],
    "GPL": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version", "Released under the GNU GPL v3", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL": ["licensed under the GNU Lesser General Public License", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "SPDX-License-Identifier: LGPL-2.1"],
    "AGPL": ["licensed under the GNU Affero General Public License", "under the terms of the GNU Affero General Public License version 3", "SPDX-License-Identifier: AGPL-3.0"],
    "BSD": ["Released under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "ISC": ["Released under the ISC License", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC0": ["Released under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "This work is dedicated to the public domain"],
    "Proprietary": ["Copyright. All rights reserved", "No part of this publication may be reproduced without the prior written permission of the publisher", "This software is proprietary and confidential"],
}
#: Headings of licence texts, without "the". They confirm but don't train: alone, they are too short to learn from.
HEADINGS = {
    "MIT": ["MIT License", "MIT License MIT", "Expat License"],
    "Apache-2.0": ["Apache License", "Apache License Version 2.0", "Apache License Version 2.0, January 2004"],
    "GPL": ["GNU General Public License", "GNU General Public License Version 2", "GNU General Public License Version 3", "GNU General Public License v3.0"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License Version 3", "GNU Lesser General Public License v3.0"],
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License Version 3", "GNU Affero General Public License v3.0"],
    "BSD": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License", "BSD 3-Clause New or Revised License", "BSD 2-Clause Simplified License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License Version 2.0"],
    "ISC": ["ISC License", "ISC License ISC"],
    "CC-BY": ["Creative Commons Attribution 4.0 International", "Creative Commons Attribution 4.0 International Public License"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International", "Creative Commons Attribution-ShareAlike 4.0 International Public License"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International", "Creative Commons Attribution-NonCommercial 4.0 International Public License"],
    "CC0": ["CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal"],
}
#: Statements of other licences, and sentences that only share words with licences.
OTHERS = {
    "unknown": ["Licensed under the {x} Public License, version {n}", "Released under the {x} License", "This work is licensed under the {x} license agreement", "Distributed under the terms of the {x} License version {n}", "SPDX-License-Identifier: {x}-{n}", "licensed under {x} {n}",
        "This software is provided as is, without any express or implied warranty. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License {n} which is available at https://www.eclipse.org/legal",
        "The contents of this file are subject to the terms of the Common Development and Distribution License, version {n}, the license, which you accept by using it",
        "Licensed under the European Union Public Licence, version {n}, you may not use this work except in compliance with the licence",
        "This is free software; you can redistribute it and/or modify it under the same terms as {x} itself",
        "This software is governed by the {x} license under {y} law and abiding by the rules of distribution of free software",
        "This license governs use of the accompanying {y}. If you use the {y}, you accept this license",
        "This {y} is made available under the {x} {z} License", "{x} {y} {z} License version {n}", "The license of {x} is copied below, with copyright by its authors", "It comes without any warranty, to the extent permitted by applicable law",
        "In no event will the authors be held liable for any damages arising from the use of this software",
        "Use of this source code is governed by the {x} license that can be found in the file",
    ],
    "none": ["The driver lost a license last year", "Researchers at MIT published a study of {x}", "The general public was invited to the {x}", "Apache is a people and a helicopter", "The version {n} of the report is late", "He may obtain a copy of the {x} at the office", "The foundation gave free concerts in {n} towns", "use the software with care and read the {x}", "the source of the river is under the {x}", "a person may redistribute food to any other person", "the terms of the contract were {x}", "creative people work in common rooms", "permission to enter was granted at {n}", "The work was released in the year {n}", "public transport in {x} is under repair", "all rights of way on the {x} are reserved for walkers", "{x} {y} {x} and {y} of the {z}",
        "His {x} license expired last year", "The {x} sold a fishing license to the {y}", "The license of the {x} driver was renewed in {n} days", "License plates of the {x} are {y}", "A license fee is due in {x}", "{x} lost the license to the {y}",
        "All rights reserved seats were taken", "The {x} tribe told version {n} of the story", "The public domain of the {x} is large", "It is available under the {x} bridge", "The terms of the {x} were made in public",
        "Permission to use the {x} was granted by the mayor", "A software version {n} was distributed to the {x}", "The author has waived the fee for the {x}", "Parts of the {x} were reproduced with the permission of the {y}",
        "She is subject to the terms of the {x} contract", "The foundation published version {n} of the {x} for the public", "No part of the {x} was sold", "They copy and modify the {x} without fee", "The conditions of the {x} are met in the source",
        "The warranty of the {x} ended last year", "The {x} was released under the moon", "Attribution of the {x} to the painter is international work", "Commons and creative people met at the {x}",
    ],
}
#: An unknown licence's statement holds one of these words; a work is put under a licence by a verb and one of two words.
SAID = frozenset(b"license licence licensed licenced licensing sublicense copyright copyrighted warranty redistribute redistribution redistributed spdx unencumbered".split())
VERBS, BELOW, LINKS = frozenset(b"licensed licenced released distributed available governed modify".split()), frozenset((b"under", b"by")), frozenset(b"the a an terms of this same license licence".split())
STOP = frozenset(b"a an and any are as at be by either for from in is it may not of on or other that the this to under use was were with without work you".split())
_TABLE = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 or c == 10 else 32 for c in range(256)).lower()
FOUND = "doc_id long, line int, family string, probability double, similarity double"


def tokens(text: bytes) -> list[bytes]:
    """Lower-case words; letters, digits and bytes above 127 make words."""
    return text.translate(_TABLE).split()


def names_license(words: list[bytes]) -> bool:
    """Whether words put a work under a licence that they name, rather than under "the License"."""
    if b"spdx" in words:
        return True
    for i, w in enumerate(words[:-2]):
        after = words[i + 2 : i + 8]
        if w in VERBS and words[i + 1] in BELOW or w == b"it" and words[i + 1] in BELOW:
            named = next((x for x in after if x not in LINKS), None)
            if named and named not in STOP and not SAID.isdisjoint(after):
                return True
    return False


def in_order(template: list[bytes], words: list[bytes]) -> float:
    """The share of a template's words that a longest common subsequence with some words has: its words in its order."""
    at = {w: 0 for w in template}
    for i, w in enumerate(template):
        at[w] |= 1 << i
    full, row = (1 << len(template)) - 1, (1 << len(template)) - 1
    for w in words:  # a bit for each word of the template, 0 where the subsequence grows
        if m := at.get(w, 0):
            u = row & m
            row = (row + u | row - u) & full
    return (len(template) - row.bit_count()) / max(len(template), 1)


def grams(words: list[bytes]) -> list[bytes]:
    """The n-grams that are not made of stop words alone."""
    return [b" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1) if not STOP.issuperset(words[i : i + n])]


def examples(seed: int, each: int) -> list[tuple[str, bytes]]:
    """(class, paragraph) made from the templates."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    out = []
    for label, texts in {**TEMPLATES, **OTHERS}.items():
        for text in texts:
            for _ in range(each):
                t = text.format(x=word().capitalize(), y=word(), z=word(), n=rng.choice(["1", "2", "1.1", "4.0", "7"])).split()
                if len(t) > 12 and rng.random() < 0.5:
                    t = t[: rng.randint(8, len(t))]
                if label == "none" and rng.random() < 0.5:
                    rng.shuffle(t)
                t = [w for w in t if rng.random() > (0.05 if len(t) > 6 else 0)]
                t = [word() for _ in range(rng.choice([0, 0, 1, 4]))] + t + [word() for _ in range(rng.choice([0, 0, 1, 4]))]
                joined = " ".join(t)
                out.append((label, rng.choice([joined, joined.lower(), joined.upper(), joined + "."]).encode()))
    every = [w for texts in TEMPLATES.values() for t in texts for w in t.split()]
    for _ in range(20 * each):  # stray words of licences in other text
        t = [rng.choice(every) for _ in range(rng.randint(1, 3))] + [word() for _ in range(rng.randint(3, 30))]
        rng.shuffle(t)
        out.append(("none", " ".join(t).encode()))
    return out


class Model:
    """Weights by n-gram and class, the temperature, and the templates' words."""

    def __init__(self, seed: int = SEED, each: int = PER_TEMPLATE):
        rows = examples(seed, each)
        self.classes = [*TEMPLATES, *OTHERS]
        seen: dict[bytes, int] = {}
        for _, text in rows:
            for g in set(grams(tokens(text))):
                seen[g] = seen.get(g, 0) + 1
        self.place = {g: i for i, g in enumerate(sorted(g for g, n in seen.items() if n >= each // 4))}
        self.words = frozenset(w for g in self.place for w in g.split() if w not in STOP)
        self.weights, self.bias, self.temperature = np.zeros((len(self.place), len(self.classes)), dtype=np.float32), np.zeros(len(self.classes), dtype=np.float32), 1.0
        self.bias[-1] = 1.0
        owner, column, labels = self.encode(rows)
        x = np.zeros((len(rows), len(self.place)), dtype=np.float32)  # the training set is small
        x[owner, column] = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=len(rows)), 1)))[owner]
        goal = np.eye(len(self.classes), dtype=np.float32)[labels]
        for _ in range(PASSES):
            error = (self.softmax(x @ self.weights + self.bias) - goal) / len(rows)
            self.weights -= STEP * (4 * (x.T @ error) + RIDGE * self.weights)
            self.bias -= STEP * error.sum(axis=0)
        fresh = examples(seed + 1, max(1, each // 4))
        owner, column, labels = self.encode(fresh)
        margins = self.margins(owner, column, len(fresh))
        loss = {t: -np.log(self.softmax(margins / t)[np.arange(len(fresh)), labels] + 1e-12).mean() for t in np.geomspace(0.1, 4, 30).tolist()}
        self.temperature = min(loss, key=loss.get)
        self.templates = {k: [frozenset(tokens(t.encode())) for t in v] for k, v in TEMPLATES.items()}
        self.headings = {k: [frozenset(tokens(t.encode())) for t in v] for k, v in HEADINGS.items()}
        self.lengths = {k: [len(tokens(t.encode())) for t in v] for k, v in TEMPLATES.items()}
        self.sequences = {k: [tokens(t.encode()) for t in v] for k, v in TEMPLATES.items()}

    def encode(self, rows: list[tuple[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and column of each feature, and the classes."""
        owner, column = [], []
        for i, (_, text) in enumerate(rows):
            found = [self.place[g] for g in set(grams(tokens(text))) if g in self.place]
            owner += [i] * len(found)
            column += found
        return np.array(owner, dtype=np.int64), np.array(column, dtype=np.int64), np.array([self.classes.index(k) if k else 0 for k, _ in rows])

    def margins(self, owner: np.ndarray, column: np.ndarray, n: int) -> np.ndarray:
        """Log odds of the classes; weights count by the root of the number of features."""
        out = np.zeros((n, len(self.classes)))
        np.add.at(out, owner, self.weights[column])
        return out / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))[:, None] + self.bias

    @staticmethod
    def softmax(m: np.ndarray) -> np.ndarray:
        """Probabilities of log odds."""
        e = np.exp(m - m.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def judge(self, asked: list[list[bytes]]) -> np.ndarray:
        """Probabilities of the classes for paragraphs in words."""
        owner, column, _ = self.encode([("", b" ".join(w)) for w in asked])
        return self.softmax(self.margins(owner, column, len(asked)) / self.temperature)

    def runs(self, lines: list[list[bytes]]) -> list[tuple[float, int, int, str]]:
        """(similarity, first and last word, family) of the runs of a block that no line holds alone and a template confirms."""
        words = [w for x in lines for w in x]
        line_of = [i for i, x in enumerate(lines) for _ in x]
        held, out = frozenset(words), []
        for family, sets in self.templates.items():
            for t, length in zip(sets, self.lengths[family], strict=True):
                if len(t & held) < ALIKE * len(t):
                    continue
                hits, count = deque(), {}
                for at, w in enumerate(words):
                    if w not in t:
                        continue
                    hits.append(at)
                    count[w] = count.get(w, 0) + 1
                    while hits[0] <= at - 2 * length or count[words[hits[0]]] > 1:
                        gone = words[hits.popleft()]
                        count[gone] -= 1
                        if not count[gone]:
                            del count[gone]
                    if len(count) >= ALIKE * len(t) and line_of[hits[0]] != line_of[at] and (share := self.alike(family, words[hits[0] : at + 1])) >= ALIKE:
                        out.append((share, hits[0], at, family))
        return out

    def alike(self, family: str, words: list[bytes]) -> float:
        """The greatest share of a template of the family that words hold, in its order; short templates count only as a whole."""
        here, most = frozenset(words), 0.0
        for t, sequence in zip(self.templates.get(family, []), self.sequences.get(family, []), strict=True):
            share = len(t & here) / len(t)
            if share >= ALIKE and share > most:
                share = min(share, in_order(sequence, words))
                most = max(most, share if len(sequence) > 4 or share == 1 else min(share, ALIKE / 2))
            elif share < ALIKE:
                most = max(most, min(share, ALIKE - 0.01))
        return most

    def statement(self, words: list[bytes], q: np.ndarray) -> tuple[str, float, float, bool] | None:
        """(family, probability, similarity, whether a heading alone gave the family) of a paragraph with probabilities ``q``."""
        here = frozenset(words)
        bare = here - {b"the"}
        if len(words) <= 12:
            for family, sets in self.headings.items():
                if bare in sets:
                    return family, float(q[self.classes.index(family)]), 1.0, True
        if q[-1] >= 0.5:
            return None
        best = self.classes[int(q[:-1].argmax())]
        alike = self.alike(best, words)
        heading = alike < ALIKE and len(words) <= 12
        if heading:
            alike = max([alike, *(len(t & bare) / len(t | bare) for t in self.headings.get(best, []))])
        sure = best != "unknown" and q.max() >= SURE and alike >= ALIKE
        if not sure and here.isdisjoint(SAID):
            return None
        return best if sure else "unknown", float(q[:-1].max() if sure else 1 - q[-1]), float(alike), heading

    def over_lines(self, lines: list[list[bytes]], found: dict[tuple[int, int], tuple[str, float, float, bool]], first: int) -> None:
        """Put the statements over several lines of a block, which begins at line ``first``, into ``found``.

        What is left of the lines that such a statement shares with other words is a paragraph of its own.
        """
        words = [w for x in lines for w in x]
        line_of = [first + i for i, x in enumerate(lines) for _ in x]
        sure = {i: x for (i, _), x in found.items() if x[0] != "unknown" and not x[3]}
        taken: list[tuple[int, int]] = []

        def stays(i: int, start: int, stop: int) -> bool:
            """Whether the line's own statement is as sure beside the run from ``start`` to ``stop``."""
            own = [j for j, line in enumerate(line_of) if line == i]
            for part in ([words[j] for j in own if j < start], [words[j] for j in own if j > stop]):
                said = self.statement(part, self.judge([part])[0]) if part else None
                if said and not said[3] and said[0] == sure[i][0] and said[2] >= sure[i][2]:
                    return True
            return False

        for alike, start, stop, family in sorted(self.runs(lines), key=lambda x: (-x[0], x[1], x[2])):
            inside = range(line_of[start], line_of[stop] + 1)
            if any(start <= b and a <= stop for a, b in taken) or any(i in sure and sure[i][2] >= alike and not stays(i, start, stop) for i in inside):
                continue
            q = self.judge([words[start : stop + 1]])[0]
            if q[-1] < 0.5 and self.classes[int(q[:-1].argmax())] == family and q.max() >= SURE:
                taken.append((start, stop))
                found[line_of[start], start + 1] = (family, float(q[:-1].max()), float(alike), False)
        lost = {i for a, b in taken for i in range(line_of[a], line_of[b] + 1) if found.pop((i, 0), None)}
        covered = {i for a, b in taken for i in range(a, b + 1)}
        spare = [i for i, line in enumerate(line_of) if line in lost and i not in covered]
        for _, group in groupby(enumerate(spare), key=lambda x: (x[1] - x[0], line_of[x[1]])):
            left = [i for _, i in group]
            rest = [words[i] for i in left]
            if not self.words.isdisjoint(rest) and (said := self.statement(rest, self.judge([rest])[0])):
                found[line_of[left[0]], left[0] + 1] = said

    def whole(self, lines: list[list[bytes]], found: dict[tuple[int, int], tuple[str, float, float, bool]], first: int) -> None:
        """Judge a block, which begins at line ``first``, as one paragraph where nothing was found in it."""
        words = [w for x in lines for w in x]
        if not SAID.isdisjoint(words) and not any(first <= i < first + len(lines) for i, _ in found) and (said := self.statement(words, self.judge([words])[0])):
            found[first, 0] = said

    def scan(self, text: bytes) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, similarity) of the licence statements of a text, in order."""
        lines = [x.split() for x in text.translate(_TABLE).split(b"\n")]
        asked = [(i, w) for i, w in enumerate(lines) if not self.words.isdisjoint(w)]
        if not asked:
            return []
        found = {(i, 0): said for (i, w), q in zip(asked, self.judge([w for _, w in asked]), strict=True) if (said := self.statement(w, q))}
        stop = -1
        for line, _ in asked:
            if line < stop:
                continue
            first = stop = line
            while first > 0 and lines[first - 1]:
                first -= 1
            while stop < len(lines) and lines[stop]:
                stop += 1
            if stop - first > 1:
                self.over_lines(lines[first:stop], found, first)
                self.whole(lines[first:stop], found, first)
        if any(x[0] != "unknown" for x in found.values()):  # the rest of a known text
            found = {k: x for k, x in found.items() if x[0] != "unknown" or names_license(lines[k[0]] + [w for y in lines[k[0] + 1 : k[0] + 2] for w in y])}
        return [(i, *found[i, at][:3]) for i, at in sorted(found)]


@lru_cache(maxsize=1)
def model() -> Model:
    """The model, trained once on the driver and sent along with the tasks (about 200 KB)."""
    return Model()


def paragraphs(docs: DataFrame) -> DataFrame:
    """A row for each licence statement of each document; see ``FOUND``."""
    scan = model().scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(doc_id, *x) for doc_id, text in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), strict=True) for x in scan(text)]
            yield batch(rows, FOUND)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, FOUND)


VERDICT = "doc_id long, families string, n_statements int, first_line int, probability double, similarity double"


def documents(docs: DataFrame) -> DataFrame:
    """One row for each document: its families, sorted and joined by commas, and its surest statement."""
    scan = model().scan

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts_of(b["text"]), strict=True):
                found = scan(text)
                top = max(found, key=lambda x: (x[1] != "unknown", x[2]), default=None)
                rows.append((doc_id, ",".join(sorted({x[1] for x in found})), len(found), found[0][0] if found else None, *(top[2:] if top else (None, None))))
            yield batch(rows, VERDICT)

    return in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, VERDICT)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of every document."""
    return documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
