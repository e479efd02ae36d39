"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Multinomial logistic regression over hashed words and word pairs, on pieces of a paragraph of at most 32 words (longer
paragraphs are read in steps of 16 words). Licence classes are trained on the templates below and noisy copies of them; the
class "unknown" on pieces of a bounded hash sample of the documents, taken anywhere in their lines, and on pieces of made-up
words, so that unseen words speak for no licence. Probabilities are calibrated by a temperature, fitted with weights that saw
neither the templates nor the lines it is fitted on; the weights in use are then fitted on all of them. A predicted piece counts only if its words also resemble one of the family's templates; it can name several.

Defined results: a null or empty text has no licence; identical rows get the same result; of equally probable families the
first by name comes first (ties); very long texts are read whole, piece by piece; an empty table gives no row. Without any line
to learn the unknown class from, only the templates decide. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import identity, tidied
from .words import gram_hashes, mix64, word_hashes

#: Names by which licences are declared, the SPDX identifier first.
NAMES = {
    "AGPL-3.0": ["AGPL-3.0", "GNU Affero General Public License, version 3", "GNU AGPLv3"],
    "Apache-2.0": ["Apache-2.0", "Apache License, Version 2.0", "Apache 2.0 license"],
    "BSD-2-Clause": ["BSD-2-Clause", "BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD-3-Clause", "BSD 3-Clause License", "New BSD License"],
    "CC-BY-4.0": ["CC-BY-4.0", "Creative Commons Attribution 4.0 International License", "CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"],
    "CC-BY-SA-4.0": ["CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"],
    "CC0-1.0": ["CC0-1.0", "Creative Commons Zero v1.0 Universal", "CC0 1.0 Universal Public Domain Dedication"],
    "EPL-2.0": ["EPL-2.0", "Eclipse Public License, version 2.0", "Eclipse Public License 2.0"],
    "GPL-2.0": ["GPL-2.0", "GNU General Public License, version 2", "GNU GPLv2"],
    "GPL-3.0": ["GPL-3.0", "GNU General Public License, version 3", "GNU GPLv3"],
    "ISC": ["ISC", "ISC License"],
    "LGPL-3.0": ["LGPL-3.0", "GNU Lesser General Public License, version 3", "GNU LGPLv3"],
    "MIT": ["MIT", "MIT License", "Expat License"],
    "MPL-2.0": ["MPL-2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"],
    "Unlicense": ["Unlicense", "The Unlicense"],
    "Zlib": ["Zlib", "zlib License", "zlib/libpng License"],
}
#: Ways to declare a licence by its name; the first is for identifiers only.
DECLARATIONS = ("SPDX-License-Identifier: {}", "Licensed under the {}.", "Released under the {}.", "Licensed under {}.", "This work is licensed under the {}.", "Distributed under the terms of the {}; see the file LICENSE.", "This program is made available under the {}")
#: Paragraphs of licences and of the notices that go with them. What two licences share is with the one that has less.
BODIES = {
    "AGPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Notwithstanding any other provision of this License, if you modify the Program, your modified version must prominently offer all users interacting with it remotely through a computer network an opportunity to receive the Corresponding Source of your version",
    ],
    "Apache-2.0": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of,",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "BSD-3-Clause": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "CC-BY-4.0": ["You are free to share and adapt the material for any purpose, even commercially, as long as you give appropriate credit, provide a link to the license, and indicate if changes were made."],
    "CC-BY-NC-4.0": ["NonCommercial: you may not use the material for commercial purposes."],
    "CC-BY-SA-4.0": ["ShareAlike: if you remix, transform, or build upon the material, you must distribute your contributions under the same license as the original."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction,",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright (c) the owner. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "For internal use only. Do not redistribute without permission of the owner.",
    ],
}
#: A document with the family on the left has the whole text of the one on the right, whose paragraphs then count for the left one.
WIDER = {"BSD-3-Clause": "BSD-2-Clause"}


def templates_of(family: str) -> list[str]:
    """The names of more than one word, every way to declare the licence by each of its names, and its paragraphs."""
    names = NAMES.get(family, [])
    declared = [d.format(n) for k, d in enumerate(DECLARATIONS) for n in (names[:1] if k == 0 else names)]
    return [*(n for n in names if " " in n), *dict.fromkeys(declared), *BODIES.get(family, [])]


TEMPLATES = {family: templates_of(family) for family in sorted({*NAMES, *BODIES})}
FAMILIES = sorted(TEMPLATES)
BUCKETS, PIECE, STEP = 1 << 15, 32, 16
#: The bounded sample that the unknown class is fitted on: pieces, and documents looked at for them.
UNKNOWN_PIECES, UNKNOWN_DOCS = 4000, 2000
CERTAIN, RESEMBLE = 0.5, 0.5
#: Training copies of a template, and parts of the pieces that take turns in the steps of the descent.
COPIES, PARTS = 12, 8


def pieces(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Paragraph, first and last word of each piece, from the paragraphs' word offsets."""
    n = np.diff(offsets)
    count = np.where(n == 0, 0, 1 + np.maximum(0, -((PIECE - n) // STEP)))
    paragraph = np.repeat(np.arange(len(n)), count)
    turn = np.arange(len(paragraph)) - np.repeat(np.cumsum(count) - count, count)
    first = offsets[:-1][paragraph] + turn * STEP
    return paragraph, first, np.minimum(first + PIECE, offsets[1:][paragraph])


def _feature_sums(words: np.ndarray, weights: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Class scores of pieces: the mean weight of their words and word pairs, times the root of their number."""
    single = np.zeros((len(words) + 1, weights.shape[1]))
    np.cumsum(weights[(words % np.uint64(BUCKETS)).astype(np.int64)], 0, out=single[1:])
    pair = np.zeros_like(single)
    if len(words) > 1:
        linked = mix64(words[:-1] * np.uint64(3) + words[1:])
        np.cumsum(weights[(linked % np.uint64(BUCKETS)).astype(np.int64)], 0, out=pair[1:-1])
        pair[-1] = pair[-2]
    n = 2 * (last - first) - 1
    return (single[last] - single[first] + pair[last - 1] - pair[first]) / np.sqrt(n)[:, None]


class LicenceModel:
    """Weights, bias and temperature; class 0 is unknown, the others are the families in order."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, temperature: float) -> None:
        self.weights, self.bias, self.temperature = weights, bias, temperature
        templates = [[_grams(t) for t in TEMPLATES[f]] for f in FAMILIES]
        flat = [t for own in templates for t in own]
        self.every = np.unique(np.concatenate(flat))
        # which templates, and which families, have each word or pair
        self.of_template = np.stack([np.isin(self.every, t) for t in flat], 1).astype(np.int16)
        self.sizes = self.of_template.sum(0)
        self.starts = np.r_[0, np.cumsum([len(own) for own in templates])][:-1]
        self.of_family = np.maximum.reduceat(self.of_template, self.starts, 1).astype(bool)

    def probabilities(self, words: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        z = (_feature_sums(words, self.weights, first, last) + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def confirmed(self, words: np.ndarray, p: np.ndarray) -> list[tuple[int, float]]:
        """Families above the unknown class that the piece resembles, the likeliest first: half of the words and pairs of one of their
        templates, or of a varied piece's own, are common to both. As licences share many of their words, a further family must have
        words or pairs of the piece that the templates of none before it have."""
        own = np.unique(np.r_[words, gram_hashes(words, 2)])
        place = np.minimum(np.searchsorted(self.every, own), len(self.every) - 1)
        shared = place[self.every[place] == own]
        if not len(shared):
            return []
        whole = len(own) if len(own) >= STEP else np.inf
        alike = np.maximum.reduceat(self.of_template[shared].sum(0) / np.minimum(self.sizes, whole), self.starts)
        has, found = self.of_family[shared], []
        for family in np.argsort(-p[1:], kind="stable"):
            if p[family + 1] <= p[0]:
                break
            if alike[family] >= RESEMBLE and all((has[:, family] & ~has[:, before]).any() for before, _ in found):
                found.append((int(family), float(alike[family])))
        return found


def _grams(text: str) -> np.ndarray:
    words, _ = word_hashes(pa.array([text]))
    return np.unique(np.r_[words, gram_hashes(words, 2)])


def _copies(random: np.random.Generator, fillers: list[str], template: str) -> list[str]:
    """A template and noisy copies: words lost, words of the corpus put in or around, long ones cut."""
    texts = []
    for turn in range(COPIES):
        words = template.split()
        if len(words) > PIECE or (turn % 3 == 2 and len(words) > 12):
            start = int(random.integers(0, max(1, len(words) - 12)))
            words = words[start : start + PIECE]
        if turn % 2:
            words = [w for w in words if random.random() > 0.08]
        if turn % 4 == 3:
            around = [fillers[int(i)] for i in random.integers(0, len(fillers), int(random.integers(1, 12)))]
            words = around + words if random.random() < 0.5 else words + around
        texts.append(" ".join(words) or template)
    return texts


class _Pieces:
    """Training pieces as sparse rows of hashed words and word pairs."""

    def __init__(self, texts: list[str], classes: np.ndarray) -> None:
        words, offsets = word_hashes(pa.array(texts, pa.string()))
        feature, row, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        for i in np.flatnonzero(np.diff(offsets) > 0):
            own = words[offsets[i] : offsets[i + 1]]
            f = (np.r_[own, mix64(own[:-1] * np.uint64(3) + own[1:])] % np.uint64(BUCKETS)).astype(np.int64)
            feature.append(f)
            row.append(np.full(len(f), i))
            value.append(np.full(len(f), 1 / np.sqrt(len(f))))
        self.feature, self.row, self.value = np.concatenate(feature), np.concatenate(row), np.concatenate(value)
        self.classes, self.edges = classes, np.searchsorted(self.row, np.arange(len(texts) + 1))

    def logits(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(self.feature) + 1, len(bias)))
        np.cumsum(weights[self.feature] * self.value[:, None], 0, out=sums[1:])
        return sums[self.edges[1:]] - sums[self.edges[:-1]] + bias

    def fitted(self, used: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights and bias after so many steps of gradient descent, each over one of ``PARTS`` parts of the pieces in use; classes
        count by the root of their size."""
        k = len(FAMILIES) + 1
        weights, bias = np.zeros((BUCKETS, k)), np.zeros(k)
        share = np.bincount(self.classes[used], minlength=k)
        sample = np.where(used, (used.sum() / (k * np.maximum(share, 1)))[self.classes] ** 0.5, 0.0)
        turns = []
        for part in range(PARTS):
            pieces_ = np.flatnonzero(used & (np.arange(len(used)) % PARTS == part))
            size = np.diff(self.edges)[pieces_]
            edges = np.r_[0, np.cumsum(size)]
            at = np.repeat(self.edges[pieces_] - edges[:-1], size) + np.arange(edges[-1])
            order = np.argsort(self.feature[at], kind="stable")
            feature = self.feature[at][order]
            turns.append((pieces_, edges, at, np.repeat(np.arange(len(pieces_)), size)[order], self.value[at][order], feature, np.flatnonzero(np.r_[True, feature[1:] != feature[:-1]][: len(feature)])))
        for turn in range(rounds):
            pieces_, edges, at, row, value, feature, starts = turns[turn % PARTS]
            if not len(feature):
                continue
            sums = np.zeros((len(at) + 1, k))
            np.cumsum(weights[self.feature[at]] * self.value[at][:, None], 0, out=sums[1:])
            error = _soft(sums[edges[1:]] - sums[edges[:-1]] + bias)
            error[np.arange(len(error)), self.classes[pieces_]] -= 1
            error *= (sample[pieces_] / sample[pieces_].sum())[:, None]
            weights *= 1 - 1e-4
            weights[feature[starts]] -= 40.0 * np.add.reduceat(error[row] * value[:, None], starts)
            bias -= 4.0 * error.sum(0)
        return weights, bias


def _soft(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(unknown: list[str], seed: int = 0, rounds: int = 160) -> LicenceModel:
    """The temperature from a fifth of the templates and lines, under weights fitted on the others; then weights fitted on all."""
    random = np.random.Generator(np.random.Philox(key=seed))
    fillers = [w for t in unknown for w in t.split()][:20_000] or ["the", "of", "and"]
    # what consists of words that no one learned is unknown too: as many pieces, at least a few hundred, of made-up words
    strange = [" ".join(f"{w}\x7f" for w in random.integers(0, 1 << 62, n).tolist()) for n in random.integers(1, PIECE + 1, max(len(unknown), 400)).tolist()]
    texts = [*unknown, *strange]
    classes, apart = [0] * len(texts), [k % 5 == 4 for k in range(len(texts))]
    for k, family in enumerate(FAMILIES):
        for turn, template in enumerate(TEMPLATES[family]):
            copies = _copies(random, fillers, template)
            texts += copies
            classes += [k + 1] * len(copies)
            apart += [turn % 5 == 4] * len(copies)
    pieces_, test = _Pieces(texts, np.array(classes)), np.array(apart)
    z = pieces_.logits(*pieces_.fitted(~test, rounds))[test]
    right = np.array(classes)[test]
    losses = {t: -np.log(np.maximum(_soft(z / t)[np.arange(len(z)), right], 1e-12)).mean() for t in np.geomspace(0.25, 4, 17)}
    return LicenceModel(*pieces_.fitted(np.ones(len(texts), bool), rounds), min(losses, key=losses.get))


def unknown_pieces(docs: DataFrame, text: str, ident) -> list[str]:
    """One piece, wherever in it, of each line of a bounded hash sample of documents; those that resemble a template are left out."""
    n = docs.count()
    share = min(1.0, UNKNOWN_DOCS / max(n, 1))
    lines = docs.select(F.col(text).cast("string").alias("t"), ident.alias("i")).where(F.pmod(F.xxhash64("i"), F.lit(1 << 30)) < int(share * (1 << 30)))
    lines = lines.select(F.explode(F.split("t", "\n")).alias("line")).where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    words = F.split(F.regexp_replace("line", r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")
    count = 1 + F.greatest(F.lit(0), F.ceil((F.size("words") - PIECE) / STEP)).cast("int")
    piece = F.array_join(F.slice("words", F.pmod(F.col("h"), F.col("count")).cast("int") * STEP + 1, PIECE), " ")
    # only the pieces are sorted, not their lines
    cut = lines.select(words.alias("words"), F.xxhash64("line").alias("h")).withColumn("count", count).select("h", piece.alias("piece")).distinct()
    found = cut.orderBy("h", "piece").limit(UNKNOWN_PIECES).select("piece").distinct().orderBy("piece").collect()
    known = [_grams(t) for f in FAMILIES for t in TEMPLATES[f]]
    out = []
    for r in found:
        own = _grams(r["piece"])
        if len(own) and not any(len(np.intersect1d(own, t, assume_unique=True)) >= 0.3 * min(len(own), len(t)) for t in known):
            out.append(r["piece"])
    return out


def _scan(model: LicenceModel):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lines = pc.split_pattern(pc.fill_null(part.column("text"), ""), "\n")
                edges = np.asarray(lines.offsets).astype(np.int64)
                doc_of = np.repeat(np.arange(part.num_rows), np.diff(edges))
                paragraphs = lines.flatten()
                words, offsets = word_hashes(paragraphs)
                paragraph, first, last = pieces(offsets)
                best: list[dict] = [{} for _ in range(part.num_rows)]
                spans: list[list] = [[] for _ in range(part.num_rows)]
                for a in range(0, len(paragraph), 1 << 15):
                    f, l = first[a : a + (1 << 15)], last[a : a + (1 << 15)]
                    base = f[0]
                    p = model.probabilities(words[base : l.max()], f - base, l - base)
                    for k in np.flatnonzero(p[:, 1:].sum(1) >= CERTAIN):
                        line = int(paragraph[a + k])
                        doc = int(doc_of[line])
                        for family, alike in model.confirmed(words[f[k] : l[k]], p[k]):
                            found = best[doc].setdefault((line, family), [float(p[k, family + 1]), alike])
                            found[0], found[1] = max(found[0], float(p[k, family + 1])), max(found[1], alike)
                for doc, found in enumerate(best):
                    here = {FAMILIES[family] for _, family in found}
                    named = {narrow: wide for wide, narrow in WIDER.items() if wide in here}
                    merged: dict[tuple[int, str], tuple[float, float]] = {}
                    for (line, family), (certain, alike) in found.items():
                        key = line - int(edges[doc]), named.get(FAMILIES[family], FAMILIES[family])
                        merged[key] = max(merged.get(key, (0.0, 0.0)), (certain, alike))
                    for (line, family), (certain, alike) in sorted(merged.items()):
                        spans[doc].append({"paragraph": line, "family": family, "probability": certain, "resemblance": alike})
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, _SPANS)], names=["doc_id", "matches"])

    return run


_SPANS = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()), ("resemblance", pa.float64())]))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, matches (paragraph, family, probability, resemblance of each confirmed paragraph)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    model = train(unknown_pieces(docs, text, identity(F.col(doc_id), F.col(text))))
    kind = rows.schema["doc_id"].dataType
    match = T.ArrayType(T.StructType([T.StructField("paragraph", T.LongType()), T.StructField("family", T.StringType()), T.StructField("probability", T.DoubleType()), T.StructField("resemblance", T.DoubleType())]))
    return rows.mapInArrow(tidied(_scan(model)), T.StructType([T.StructField("doc_id", kind), T.StructField("matches", match)]))
