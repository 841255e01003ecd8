"""Training of the licence paragraph classifier, on the driver, from template notices alone."""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np

# Notices and key sentences of each licence family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Released under the GPL version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "BSD": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Licensed under the two clause BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, Version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "You are free to share and adapt the material for any purpose, even commercially, under the terms of the Creative Commons Attribution License.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "You may not use the material for commercial purposes under the Creative Commons Attribution-NonCommercial License.",
    ),
    "Public-Domain": (
        "This work has been dedicated to the public domain under CC0 1.0 Universal.",
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    ),
    "Proprietary": (
        "All rights reserved.",
        "Copyright (c) 2020 Example Corporation. All rights reserved.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
    ),
}

# Sentences about licences, software and rights that grant nothing.
OTHER = (
    "Drivers must renew their license every ten years at the local office.",
    "The restaurant lost its liquor license after the inspection.",
    "Please read the license before you install the software.",
    "The license fee for the database went up again this year.",
    "Copyright law is complex and differs from country to country.",
    "All rights and duties of the members are listed in the rules of the club.",
    "The public hearing on the new version of the plan is open to any person.",
    "The source of the river lies in the hills above the town.",
    "Permission to enter the building is granted by the guard at the door.",
    "She is free to go, subject to the conditions that the court has set.",
    "The general public may visit the gallery free of charge on Sundays.",
    "A copy of the report was distributed to all members of the board.",
    "The software is used in hospitals, schools and other public places.",
    "MIT and other universities published the results of their common work.",
    "The Apache people lived in the south west of the country.",
    "The warranty covers parts and labour for two years after the purchase.",
    "Creative people often share their work with the commons of the village.",
    "The foundation was set up to support free concerts for young people.",
    "He reserved a table for four, and all seats were taken.",
    "The implied meaning of the text is left to the reader.",
)
_FILLER = "and of to in is that it was for on with as at by from this have not are but they we out up so when time some could then more no my over only new other two these may first any now such like our even most made after also did many before must through back years where much way well down should because each just those people how too little state good very make world still own see men work long here get both between life being under never day same another know while last might us great old year off come since against go came right used take three".split()

#: Words that say nothing about licences; every n-gram of the model has another one.
STOP = frozenset([*_FILLER, "the", "a", "an", "be", "can", "do", "all", "been", "you", "it", "or", "its", "if", "has", "see", "c", "v"])

NONE = "none"
#: Share of the paragraphs of unknown licences, taken for a family, that its calibrated limit must turn away; least and largest limit.
TURN_AWAY, LEAST_LIMIT, LARGEST_LIMIT = 0.9, 0.5, 0.9
#: Parts that notices and sentences are dealt into; each is held out whole once, for calibration.
FOLDS = 4
SEED = 11
TOKEN = r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"
_TOKEN = re.compile(r"[^\W_]+(?:[.+-][^\W_]+)*")


def tokens(text: str) -> list[str]:
    """Lower-case words; versions and identifiers stay whole."""
    return _TOKEN.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    """Distinct words and pairs of neighbours."""
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass(frozen=True)
class LicenseModel:
    """classes (NONE last), bias and sparse weights of each n-gram, and the limits of each family."""

    classes: tuple[str, ...]
    bias: tuple[float, ...]
    weights: dict[str, tuple[float, ...]]
    limits: dict[str, float]


def _examples(rng: np.random.Generator, copies: int, texts: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Notices and other sentences: whole, cut, surrounded by unrelated words, and with words replaced; and unrelated words alone."""
    out = []

    def vary(text: str, family: str) -> None:
        words = text.split()
        filler = lambda n: [_FILLER[i] for i in rng.integers(len(_FILLER), size=n)]
        out.append((text, family))
        for _ in range(copies):
            kind, own = int(rng.integers(5)), list(words)
            if kind == 0 and len(own) > 8:
                at = int(rng.integers(len(own) // 3))
                own = own[at : at + max(6, 2 * len(own) // 3)]
            elif kind == 1:
                own = [*filler(int(rng.integers(25))), *own, *filler(int(rng.integers(25)))]
            elif kind == 3 and len(own) > 20:
                at = int(rng.integers(len(own) - 10))
                own = own[at : at + int(rng.integers(10, 16))]
            elif kind == 2 and len(own) > 6:
                own[int(rng.integers(len(own)))] = filler(1)[0]
            out.append((" ".join(own), family))

    for text, family in texts:
        vary(text, family)
    out += [(" ".join(_FILLER[i] for i in rng.integers(len(_FILLER), size=int(rng.integers(4, 60)))), NONE) for _ in range(60 * copies)]
    return out


def known_texts() -> list[tuple[str, str]]:
    """Every notice and sentence with its class."""
    return [(n, family) for family, notices in TEMPLATES.items() for n in notices] + [(s, NONE) for s in OTHER]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass(frozen=True)
class Regression:
    """Sparse multinomial logistic regression over n-grams: their columns, weights and the bias."""

    column: dict[str, int]
    w: np.ndarray
    b: np.ndarray

    def matrix(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(self.column)), dtype=np.float32)
        for row, text in enumerate(texts):
            x[row, [self.column[g] for g in grams(tokens(text)) if g in self.column]] = 1
        return x

    def chances(self, texts: list[str]) -> np.ndarray:
        return _softmax(self.matrix(texts) @ self.w + self.b)


CLASSES = (*TEMPLATES, NONE)


def fit(texts: list[tuple[str, str]], copies: int = 8) -> Regression:
    """Proximal gradient steps over variations of the texts."""
    examples = _examples(np.random.default_rng(SEED), copies, texts)
    counts: dict[str, int] = {}
    for text, family in examples:
        for g in grams(tokens(text)) if family != NONE else ():
            counts[g] = counts.get(g, 0) + 1
    # An n-gram of unrelated words only says nothing about licences.
    vocabulary = sorted(g for g, n in counts.items() if n >= 4 and not set(g.split()) <= STOP)
    model = Regression({g: i for i, g in enumerate(vocabulary)}, np.zeros((len(vocabulary), len(CLASSES)), dtype=np.float32), np.zeros(len(CLASSES), dtype=np.float32))
    x, y = model.matrix([t for t, _ in examples]), np.array([CLASSES.index(f) for _, f in examples])
    target = np.eye(len(CLASSES), dtype=np.float32)[y]
    share = 1 / np.bincount(y, minlength=len(CLASSES))[y][:, None].astype(np.float32) / len(CLASSES)
    w, b = model.w, model.b
    v, step = np.zeros_like(w), 2.0
    for _ in range(300):
        error = (_softmax(x @ w + b) - target) * share
        v = 0.9 * v + x.T @ error + 2e-4 * w
        w = w - step * v * 0.5
        w = np.sign(w) * np.maximum(0, np.abs(w) - step * 2e-5)
        b = b - step * error.sum(0)
    return Regression(model.column, w, b)


def held_out_chances(copies: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Classes of variations of all notices and sentences, and their chances by models that have seen none of the notice or sentence."""
    texts = known_texts()
    return _judged([[i % FOLDS == fold for i in range(len(texts))] for fold in range(FOLDS)], copies)


def unknown_chances(copies: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The same by models that have seen nothing of the whole family, as for a licence that the scan doesn't know."""
    return _judged([[family == f for _, family in known_texts()] for f in TEMPLATES], copies)


def _judged(held: list[list[bool]], copies: int) -> tuple[np.ndarray, np.ndarray]:
    texts, truth, chances = known_texts(), [], []
    for fold, out in enumerate(held):
        model = fit([t for t, h in zip(texts, out, strict=True) if not h], copies)
        own = _examples(np.random.default_rng(SEED + 1 + fold), copies, [t for t, h in zip(texts, out, strict=True) if h])
        truth += [CLASSES.index(f) for _, f in own]
        chances.append(model.chances([t for t, _ in own]))
    return np.array(truth), np.concatenate(chances)


def limits(truth: np.ndarray, chances: np.ndarray) -> dict[str, float]:
    """For each family the chance from which it is taken: what turns away TURN_AWAY of the paragraphs of others that are taken for it."""
    best, out = chances.argmax(1), {}
    for k, family in enumerate(CLASSES[:-1]):
        other = np.sort(chances[(truth != k) & (best == k), k])
        away = other[min(len(other) - 1, int(TURN_AWAY * len(other)))] + 1e-6 if len(other) else LEAST_LIMIT
        out[family] = round(float(min(LARGEST_LIMIT, max(LEAST_LIMIT, away))), 6)
    return out


@functools.lru_cache(maxsize=1)
def train() -> LicenseModel:
    """The classifier over all notices, with limits calibrated on notices, and on families, that were held out whole."""
    model = fit(known_texts())
    kept = {g: tuple(round(float(z), 5) for z in model.w[i]) for g, i in model.column.items() if np.abs(model.w[i]).max() > 1e-3}
    return LicenseModel(CLASSES, tuple(round(float(z), 5) for z in model.b), kept, limits(*map(np.concatenate, zip(held_out_chances(), unknown_chances(), strict=True))))
