"""Licence scan: a trained paragraph classifier, confirmed by templates.

A paragraph is a line.  Its features are the words and word pairs of licence statements, present or
absent.  A multinomial logistic regression, made sparse by soft thresholds, tells licence families,
other licences (``unknown``) and ordinary text (``none``) apart.  It is trained here, on statements
made from ``TEMPLATES`` by dropping, replacing and adding words, on statements of licences that
aren't listed and on ordinary text.  A temperature, fitted on statements held out, calibrates the
probabilities, and a family that isn't reached with ``SURE`` becomes ``unknown``.  So does one that
its own templates don't confirm: a share of ``CONFIRM`` of a template's words must be in the line,
its telling words among them.

All lines of all documents are scored, vectorised.  A line without any feature has the bias as its
score, which is that of ordinary text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftline.llm import textkit as tk
from siftline.llm.line_dedup import line_starts
from siftline.llm.vocab import Vocabulary, word_hashes

SURE = 0.7
CONFIRM = 0.7
SEED = 5

#: Statements of each family.  In capitals: words without which a line isn't of the family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": ["licensed under the APACHE license version 2 0", "apache license version 2 0 APACHE", "this project is released under the APACHE 2 0 license", "spdx license identifier APACHE 2 0", "you may not use this file except in compliance with the APACHE license", "you may obtain a copy of the license at http www APACHE org licenses license 2 0"],
    "mit": ["released under the MIT license", "licensed under the MIT license", "this software is available under the terms of the MIT license", "spdx license identifier MIT", "distributed under MIT license terms", "PERMISSION is hereby GRANTED FREE of CHARGE to any person OBTAINING a copy of this software and associated documentation files the software to DEAL in the software without restriction", "PERMISSION is hereby GRANTED FREE of charge to any person OBTAINING a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute SUBLICENSE and or sell copies of the software and to permit persons to whom the software is furnished to do so", "including without limitation the rights to use copy modify MERGE publish distribute SUBLICENSE and or SELL copies of the software"],
    "gpl-3.0": ["this work is licensed under the GNU GENERAL public license version 3", "released under the GNU GENERAL public license v3", "you can redistribute it under the terms of the GNU GENERAL public license either version 3 of the license or later", "spdx license identifier GPL 3 0", "licensed under GPL v3", "this program is free software you can redistribute it and or modify it under the terms of the GNU GENERAL public license"],
    "lgpl": ["licensed under the gnu LESSER general public license version 3", "released under the terms of the gnu LESSER general public license", "spdx license identifier LGPL 3 0", "licensed under LGPL v3"],
    "agpl-3.0": ["licensed under the gnu AFFERO general public license version 3", "released under the gnu AFFERO general public license", "spdx license identifier AGPL 3 0"],
    "bsd": ["licensed under the BSD license", "released under the BSD 3 clause license", "spdx license identifier BSD 3 clause", "use of this source code is governed by a BSD style license", "distributed under the terms of the BSD 2 clause license", "REDISTRIBUTION and use in SOURCE and BINARY forms with or without modification are permitted", "REDISTRIBUTION and use in SOURCE and BINARY forms with or without modification are permitted provided that the following conditions are met", "REDISTRIBUTIONS of source code must RETAIN the above copyright notice this list of conditions and the following disclaimer", "REDISTRIBUTIONS in BINARY form must REPRODUCE the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"],
    "mpl-2.0": ["this source code form is subject to the terms of the MOZILLA public license v 2 0", "licensed under the MOZILLA public license version 2 0", "spdx license identifier MPL 2 0"],
    "cc-by": ["licensed under CC BY 4 0", "this work is licensed under a creative COMMONS attribution 4 0 international license", "available under CC BY 4 0"],
    "cc-by-sa": ["licensed under CC BY SA 4 0", "this work is licensed under a creative COMMONS attribution SHAREALIKE 4 0 international license", "text is available under CC BY SA 3 0"],
    "cc-by-nc": ["licensed under CC BY NC 4 0", "this work is licensed under a creative COMMONS attribution NONCOMMERCIAL 4 0 international license", "released under CC BY NC 4 0"],
    "cc0-1.0": ["released under CC0 1 0", "dedicated to the public domain under CC0", "creative commons CC0 1 0 universal public domain dedication"],
    "proprietary": ["all RIGHTS RESERVED", "copyright all RIGHTS RESERVED", "no part of this publication may be reproduced all RIGHTS RESERVED"],
}
#: Paragraphs of licences that no family lists, or that several families share.
BODIES = ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "this is free and unencumbered software released into the public domain", "anyone is free to copy modify publish use compile sell or distribute this software", "the software is provided as is without warranty of any kind express or implied", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "this software is provided by the copyright holders and contributors as is and any express or implied warranties are disclaimed", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", "available under several licenses {x} and {x}", "dual licensing under {x} and {x} licenses", "you may sublicense this work under {x} terms", "lizenziert unter der {x} lizenz version {n}", "lizenziert unter {x} {n} 0", "dieses werk ist lizenziert unter einer {x} lizenz", "licencia {x} version {n}", "distribué sous licence {x} version {n}"]
#: Statements of licences that no family lists.
OTHERS = ["licensed under the {x} license", "released under the {x} public license version {n}", "this work is licensed under the {x} license version {n} 0", "distributed under the terms of the {x} license", "spdx license identifier {x} {n} 0", "licensed under {x} {n} 0", "subject to the {x} public license v {n}", "use is governed by the {x} license agreement", *BODIES]
#: Ordinary text with words of licences.
PLAIN = ["his driver license was released by the police", "the general public is free to use the park", "this version is available in the shop", "the software company released a new version", "she has the right to work under the contract", "the terms of the agreement are not public", "an apache helicopter landed at the base", "the creative work of the commons", "mit students work on this project", "all tables are reserved for the public", "the copyright of the song was sold", "a domain name is subject to change", "a license to drive is issued by the state", "the forms are permitted without modification of the notice", "permission to use the hall is granted for any purpose", "this is a copy of the notice in the public library", "anyone is free to sell or publish a copy of the song", "the conditions of the work and the following list are met in writing", "the source of the river is without any doubt in the above map", "without warranty of any kind the car was sold", "the city distributed free copies of the list to all persons"]
#: Words of all licences and texts, which ordinary text is full of.
COMMON = "the of and to in is that it for on was as with be by this are at an or a any all which from not may you have their has were been if no other such de la le les des der die das und ist in den von zu mit el los que en un una para por con et est dans pour sur ist unter sous versión version".split()

CLASSES = [*TEMPLATES, "unknown", "none"]


def _features(w: tk.Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and of word pairs of each row, in the rows' order, and where the rows begin."""
    where, first = tk.gram_rows(w.at, 2, len(w.hashes))
    pair = tk.grams(w.hashes, 2)[where] if len(where) else np.zeros(0, np.uint64)
    rows = np.concatenate([w.rows(), np.repeat(np.arange(len(first) - 1), np.diff(first))])
    order = np.argsort(rows, kind="stable")
    return np.concatenate([w.hashes, pair])[order], w.at + first


@dataclass
class Scanner:
    vocabulary: Vocabulary
    weights: np.ndarray  # (feature, class)
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, w: tk.Words) -> np.ndarray:
        hashes, at = _features(w)
        rows, features = self.vocabulary.present(hashes, at)
        out = np.tile(self.bias, (len(at) - 1, 1))
        np.add.at(out, rows, self.weights[features])
        return out

    def probabilities(self, w: tk.Words) -> np.ndarray:
        return _softmax(self.logits(w) / self.temperature)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def statements(seed: int, each: int) -> tuple[list[str], np.ndarray]:
    """``each`` made statements of every family, more of the classes of much variety, and their classes."""
    rng = np.random.default_rng(seed)
    made, classes = [], []

    def invented() -> str:
        return "".join(rng.choice(list("abcdefghilmnoprstuvz"), rng.integers(3, 10)))

    for c, name in enumerate(CLASSES):
        for _ in range(4 * each if name == "none" else 2 * each if name == "unknown" else each):
            if name == "none":
                source = str(rng.choice(PLAIN)).split() if rng.random() < 0.6 else [invented() for _ in range(rng.integers(1, 30))]
                if rng.random() < 0.4:  # words of licences anywhere in ordinary text
                    loose = str(rng.choice(OTHERS)).split()
                    source = [*source, *(str(x) for x in rng.choice(loose, 2) if "{" not in x)]
                    rng.shuffle(source)
                elif rng.random() < 0.7:  # text of any length with the small words of all
                    source = [str(rng.choice(COMMON)) if rng.random() < 0.5 else invented() for _ in range(int(np.exp(rng.uniform(1, 5))))]
                needed: set[str] = set()
            elif name == "unknown":
                raw = str(rng.choice(OTHERS))
                source = raw.replace("{x}", " ".join(invented() for _ in range(rng.integers(1, 3)))).replace("{n}", str(rng.integers(1, 5))).split()
                needed = set(source) if "{" in raw else set()
            else:
                source = str(rng.choice(TEMPLATES[name])).split()
                needed = {x for x in source if x.isupper() or x in ("by", "BY")}
            words = [x for x in source if x in needed or rng.random() > 0.08]
            words = [invented() if x not in needed and rng.random() < 0.04 else x for x in words]
            if rng.random() < 0.5:
                words = [*(invented() for _ in range(rng.integers(0, 8))), *words, *(invented() for _ in range(rng.integers(0, 8)))]
            made.append(" ".join(words))
            classes.append(c)
    return made, np.array(classes)


def train(seed: int = SEED, each: int = 160, rounds: int = 300, sparse: float = 2e-4) -> Scanner:
    """A scanner, the same for the same seed."""
    texts, y = statements(seed, each)
    w = tk.words(pa.array(texts))
    known = tk.words(pa.array([s.replace("{x}", "").replace("{n}", "") for s in [*sum(TEMPLATES.values(), []), *OTHERS, *PLAIN]]))
    vocabulary = Vocabulary(_features(known)[0])
    rows, features = vocabulary.present(*_features(w))
    x = np.zeros((len(texts), len(vocabulary)), np.float64)
    x[rows, features] = 1
    target = np.eye(len(CLASSES))[y]
    weights, bias = np.zeros((len(vocabulary), len(CLASSES))), np.zeros(len(CLASSES))
    rate = 2.0 / (x.sum(1).max() + 1)
    look, look_b, before, before_b, t = weights, bias, weights, bias, 1.0
    for _ in range(rounds):  # proximal steps with momentum
        g = (_softmax(x @ look + look_b) - target) / len(y)
        now = look - rate * (x.T @ g)
        now = np.sign(now) * np.maximum(np.abs(now) - rate * sparse, 0)
        now_b = look_b - rate * g.sum(0)
        faster = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, look_b = now + (t - 1) / faster * (now - before), now_b + (t - 1) / faster * (now_b - before_b)
        before, before_b, t = now, now_b, faster
    model = Scanner(vocabulary, before, before_b)
    held, held_y = statements(seed + 1, max(each // 4, 1))
    z = model.logits(tk.words(pa.array(held)))
    losses = [(float(-np.log(_softmax(z / k)[np.arange(len(held_y)), held_y] + 1e-12).mean()), k) for k in np.geomspace(0.2, 5, 33).tolist()]
    model.temperature = min(losses)[1]
    return model


@lru_cache(maxsize=1)
def _templates() -> dict[str, list[tuple[set[int], set[int]]]]:
    """Each family's templates as hashes of words, and those that are needed."""
    return {f: [({int(h) for h in word_hashes(s.lower().split())}, {int(h) for h in word_hashes([x.lower() for x in s.split() if x.isupper()])}) for s in all_] for f, all_ in TEMPLATES.items()}


def similarity(words: set[int], family: str) -> float:
    """Largest share of a template's words among ``words``, of templates whose telling words are all there."""
    return max((len(t & words) / len(t) for t, needed in _templates()[family] if needed <= words), default=0.0)


REPORT = "doc_id bigint, line int, family string, probability double, similarity double"


def scan(docs: DataFrame, model: Scanner, sure: float = SURE, confirm: float = CONFIRM) -> DataFrame:
    """``(doc_id, line, family, probability, similarity)`` of every line that states a licence.

    Lines are numbered from 0.  ``family`` is ``unknown`` where the most likely family isn't sure or
    isn't confirmed; ``similarity`` is that family's, 0 where none.  Null and empty texts have
    no lines; repeated rows and lines are each reported; only ``doc_id`` and ``text`` are read.
    """
    none, unknown = CLASSES.index("none"), CLASSES.index("unknown")
    plain = int(model.bias.argmax()) == none

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, piece in tk.chunks(b.column(1)):
                w = tk.words(piece)
                data, row_at = w.data, w.row_at
                starts, row_first = line_starts(data, row_at)
                at = np.searchsorted(w.starts, starts)
                hit = np.flatnonzero(np.diff(at))
                if plain:  # the pairs of the vocabulary are of its words
                    hit = np.unique(np.searchsorted(at, model.vocabulary.find(w.hashes)[0], "right") - 1)
                sizes = at[hit + 1] - at[hit]
                inside = np.repeat(at[hit], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                own = np.concatenate(([0], np.cumsum(sizes)))
                p = model.probabilities(tk.Words(data, own, w.starts[inside], w.ends[inside], own, w.hashes[inside]))
                best = p.argmax(1)
                line_row = np.searchsorted(row_first, hit, "right") - 1
                out: list[tuple[int, int, str, float, float]] = []
                for i in np.flatnonzero(best != none).tolist():
                    c, like = int(best[i]), 0.0
                    if c != unknown:
                        like = similarity({int(h) for h in w.hashes[at[hit[i]] : at[hit[i] + 1]]}, CLASSES[c])
                    family = CLASSES[c] if p[i, c] >= sure and like >= confirm else "unknown"
                    out.append((first + int(line_row[i]), int(hit[i] - row_first[line_row[i]]), family, float(p[i, c]), like))
                rows, *rest = list(zip(*out, strict=True)) if out else [[]] * 5
                ids = b.column(0).cast(pa.int64()).take(pa.array(rows, pa.int64()))
                kinds = [pa.int32(), pa.string(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(v, k) for v, k in zip(rest, kinds, strict=True))], ["doc_id", "line", "family", "probability", "similarity"])

    return docs.select("doc_id", "text").mapInArrow(made, REPORT)
