"""Licence scan of paragraphs. DataFrame functions only; no Python runs on executors.

Method. A multinomial logistic regression over word unigrams and bigrams is trained in numpy on the driver. Its vocabulary
is that of the licence wordings below (notices, and names in the frames that notices put them in), without common function
words on their own; any other word has weight 0, so text around a notice does not drown it. It is trained on wordings
whole, shortened and amid prose; the class `unknown` is prose without a notice and notices of licences outside the families
(`OTHERS`), whose own words are no features, so that an unheard-of licence looks like them. Every second one of these is left
out of training. On them and on made windows kept aside a temperature is fitted, and the least probability at which
predictions there are right 99 times of 100 is the limit below which a window is `unknown`. A paragraph is scored in windows
of `WINDOW` words, one every `STRIDE`, so that a notice of up to WINDOW - STRIDE words lies whole in one; it gives a row for
each family found, from that family's best window. A prediction is confirmed by comparison with its family's wordings: the
share of a wording's distinct runs of `RUN` words (of the whole wording, if shorter) that the window holds.

Only windows with a gated word are scored. The gate follows from the weights (`gate`): with every other gram of the
vocabulary that lifts a family over `unknown` present at once, no family reaches the limit, so no window without a gated
word can. `STEMS` are gated besides, so that mentions of licences that are no notice show as `unknown`.

Plan. One narrow pass: texts without a gated word cost a search and go at once; scores are array functions over constant
arrays (a bounded number of weights). Nothing is shuffled.

Defined results. Null and empty texts give no rows, nor do paragraphs without a gated word. A paragraph ends at a blank line
or at a line end after `.`, `!`, `?`, `:` or `;`, so that wrapped notices stay whole. A paragraph whose scored windows are
all `unknown` gives one row, of the window that is least surely so. Ties go to the family named first. Rows with equal or
null doc_id are scanned like any other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
BUCKETS = 1 << 13
WINDOW, STRIDE = 60, 20
RUN, CONFIRMED = 3, 0.7
#: Beginnings of words that are gated whatever the weights are; each template holds one.
STEMS = ("licen", "permission", "redistribution", "unencumbered")
#: Wording of the licences' notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "either version 2 of the GNU General Public License, or (at your option) any later version."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "either version 3 of the GNU General Public License, or (at your option) any later version."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License.", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation."],
    "AGPL": ["Licensed under the GNU Affero General Public License.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation."],
    "BSD": ["Licensed under the BSD 3-Clause License.", "This software is released under the BSD license.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0 Universal license.", "This is free and unencumbered software released into the public domain."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
}
#: Further wordings, which need not hold a stem.
WORDINGS: dict[str, list[str]] = {
    "MIT": [
        "The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.",
        "In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an as is basis, without warranties or conditions of any kind, either express or implied."],
    "GPL-2.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "GPL-3.0": ["you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": ["either version 2.1 of the GNU Lesser General Public License, or (at your option) any later version."],
    "AGPL": ["either version 3 of the GNU Affero General Public License, or (at your option) any later version."],
    "BSD": [
        "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed.",
        "In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages.",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "CC-BY": ["https://creativecommons.org/licenses/by/4.0/"],
    "CC-BY-SA": ["https://creativecommons.org/licenses/by-sa/4.0/"],
    "CC-BY-NC": ["https://creativecommons.org/licenses/by-nc/4.0/"],
    "CC0": ["Dedicated to the public domain.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "https://creativecommons.org/publicdomain/zero/1.0/", "No rights reserved, placed in the public domain by its author."],
    "ISC": ["The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.", "provided that the above copyright notice and this permission notice appear in all copies."],
}
#: What notices call a licence, put in FRAMES.
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT License", "Expat license", "MIT/X11 license"],
    "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 license", "Apache Software License 2.0"],
    "GPL-2.0": ["GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GPL v2", "GPLv2 or later", "GNU GPL v2", "GNU GPL version 2", "GNU GPLv2", "GNU General Public License v2.0", "GNU General Public License version 2"],
    "GPL-3.0": ["GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPL v3", "GPLv3 or later", "GNU GPL v3", "GNU GPL version 3", "GNU GPLv3", "GNU General Public License v3.0", "GNU General Public License version 3"],
    "LGPL": ["LGPL-2.1", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPLv3", "LGPL v2.1", "GNU LGPL", "GNU LGPL v3", "GNU Lesser General Public License v3.0", "GNU Lesser General Public License version 2.1"],
    "AGPL": ["AGPL-3.0", "AGPL-3.0-or-later", "AGPL-3.0-only", "AGPLv3", "AGPL v3", "GNU AGPL v3", "GNU AGPL version 3", "GNU Affero General Public License v3.0", "GNU Affero General Public License version 3"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "BSD license", "BSD 3-Clause License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "MPLv2", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License version 2.0"],
    "CC-BY": ["CC-BY-4.0", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0"],
    "CC0": ["CC0-1.0", "CC0", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal"],
    "ISC": ["ISC", "ISC License", "ISC-style license"],
}
FRAMES = [
    "Licensed under {}.", "Licensed under the {}.", "Distributed under the terms of the {}.", "Released under the {}.", "SPDX-License-Identifier: {}", "License: {}", "This program is free software under the {}.",
    "Available under the {}.", "See the {} for details.", "Published under {}.", "Covered by the {}.", "All code is under the {} unless stated otherwise.", "Dedicated to the public under {}.", "Use of this package is governed by the {}.", "licence = {}",
]
#: Licences outside the families, by what notices call them; every second calibrates and trains nothing.
OTHERS: dict[str, list[str]] = {
    "EPL": ["EPL-2.0", "Eclipse Public License 2.0", "Eclipse Public License - v 1.0"],
    "BSL": ["BSL-1.0", "Boost Software License, Version 1.0"],
    "Zlib": ["Zlib", "zlib License", "zlib/libpng license"],
    "EUPL": ["EUPL-1.2", "European Union Public Licence 1.2"],
    "Artistic": ["Artistic-2.0", "Artistic License 2.0", "Perl Artistic License"],
    "CDDL": ["CDDL-1.0", "Common Development and Distribution License 1.0"],
    "MS-PL": ["MS-PL", "Microsoft Public License"],
    "PSF": ["PSF-2.0", "Python Software Foundation License Version 2"],
    "OFL": ["OFL-1.1", "SIL Open Font License, Version 1.1"],
    "AFL": ["AFL-3.0", "Academic Free License version 3.0"],
    "OSL": ["OSL-3.0", "Open Software License 3.0"],
    "CPL": ["CPL-1.0", "Common Public License Version 1.0"],
    "GFDL": ["GFDL-1.3", "GNU Free Documentation License, Version 1.3"],
    "QPL": ["QPL-1.0", "Q Public License version 1.0"],
    "PostgreSQL": ["PostgreSQL", "PostgreSQL License"],
    "PHP": ["PHP-3.01", "PHP License, version 3.01"],
    "ODbL": ["ODbL-1.0", "Open Database License 1.0"],
    "UPL": ["UPL-1.0", "Universal Permissive License 1.0"],
    "CC-BY-ND": ["CC-BY-ND-4.0", "CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "SSPL": ["SSPL-1.0", "Server Side Public License, version 1"],
    "BUSL": ["BUSL-1.1", "Business Source License 1.1"],
    "Elastic": ["Elastic-2.0", "Elastic License 2.0"],
}
#: Wordings of some of them, used as their names are.
OTHER_WORDINGS: dict[str, list[str]] = {
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "BSL": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
    "CDDL": ["The contents of this file are subject to the terms of the Common Development and Distribution License. You may not use this file except in compliance with the License."],
    "OFL": ["Permission is hereby granted, free of charge, to any person obtaining a copy of the Font Software, to use, study, copy, merge, embed, modify, redistribute, and sell modified and unmodified copies of the Font Software"],
    "PostgreSQL": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted"],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
}
#: Prose that is no notice, for the class `unknown` and for the text around notices.
_OTHER = [
    "He renewed his driving licence last week.", "The shop lost its license to sell wine.", "Poetic licence is allowed in this poem.", "A licensed engineer must sign the plan.", "The painting is in the public domain of taste.",
    "Her fishing license expired in March.", "The software licence fee went up again.", "No license was found in this folder.", "All rights reserved; ask us about a commercial license.", "The licensee shall pay the licensor each year.",
    "She studied physics at MIT in Boston and later taught there.", "The Apache helicopter landed; version 2.0 of the engine was tested.", "We restarted the Apache web server after the upgrade to version 2.0.", "BSD and Linux are operating systems with long histories.",
    "The Mozilla foundation released a new browser, version 3, to the general public.", "The general public is free to use the library on Sundays.", "Version 3 of the plan was published by the city council.", "Creative people in the commons room wrote this work together.",
    "The work was distributed to all members under the terms of the contract.", "Any person may obtain a copy of the report free of charge from the public office.", "The author of the software gave no warranty for the machine that was sold.", "Nobody had permission to enter the building without a notice.",
    "Copyright law protects the rights of an author for many years.", "The court found that the holder was liable for damages and costs.", "The goods are provided as described, with a particular purpose in mind.", "GNU is an animal in a story, and the story is free for all.",
    "Wir fahren mit dem Zug nach Hause und kommen mit den Kindern wieder.", "Sie hat mit ihm von der Arbeit gesprochen, und er ist mit ihr gegangen.", "Das Haus mit dem Garten ist alt, und die Leute sind mit der Stadt zufrieden.",
]
_PROSE = [
    "It was a long day and the rain had not stopped since the morning, so we stayed in and read the papers that were left on the table.", "The committee will meet again in June to decide which of the two plans should be used for the new school and how it is to be paid for.",
    "You may find that the first step takes more time than the others, but it is the one that matters, and there is no way around it.", "In the second part of the book the author describes the town, its people, and the work they did in the mines and on the farms.",
    "Either of these methods can be applied if the conditions are met; the following list shows what is needed for each of them.", "Open the file, read each line, and return the number of words that start with a capital letter; this includes names and places.",
    "The results of the test are included in the table above, with the source of the data and the date on which it was collected.", "Most of the code was written by two people in one year, and the rest of the project was to change and modify what they had made.",
    "They sell bread, cheese and wine at the market, and on some days there is music or a play in the square behind the old church.", "A small river runs through the valley to the sea, and along it are the ruins of mills that once made paper and cloth.",
    "When the power went out the computers stopped, and it took until the next day to restore the documents that were lost.", "The minister said that the law would not be changed in this session, subject to the agreement of both houses.",
]
#: Function words: no feature on their own, only beside another word.
_PLAIN = frozenset("a all an and any are as at be but by can each for from has have if in is it its may no not of on one or other out s see shall so that the their there these this to under use used was were what which with you your we will".split())
_WORD = "[a-z0-9]+"


def _words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def _grams(words: list[str]) -> list[str]:
    return list(dict.fromkeys([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))]))


@lru_cache(1)
def wordings() -> dict[str, list[str]]:
    """All wordings by family: templates, further ones, names in their frames."""
    return {f: list(dict.fromkeys([*TEMPLATES[f], *WORDINGS[f], *(x.format(n) for n in NAMES[f] for x in FRAMES)])) for f in TEMPLATES}


@lru_cache(1)
def vocabulary() -> frozenset[str]:
    """The wordings' grams that are not made of function words alone."""
    return frozenset(g for ts in wordings().values() for t in ts for g in _grams(_words(t)) if any(w not in _PLAIN for w in g.split()))


def _runs(words: list[str]) -> list[str]:
    """Distinct runs of RUN words; the whole as one if there are fewer."""
    return list(dict.fromkeys(" ".join(words[i : i + RUN]) for i in range(max(1, len(words) - RUN + 1))))


def _bucket(gram: str) -> int:
    return zlib.crc32(gram.encode()) % BUCKETS


def _buckets(words: list[str]) -> list[int]:
    return sorted({_bucket(g) for g in _grams(words) if g in vocabulary()})


def _windows(words: list[str]) -> list[list[str]]:
    return [words[i * STRIDE : i * STRIDE + WINDOW] for i in range(max(0, math.ceil((len(words) - WINDOW) / STRIDE)) + 1)]


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # bucket x family
    bias: np.ndarray
    temperature: float
    limit: float

    def window(self, words: list[str]) -> tuple[str, float]:
        z = (self.weights[_buckets(words)].sum(axis=0) + self.bias) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        at = int(p.argmax())
        return (self.families[at] if p[at] >= self.limit else UNKNOWN), float(p[at])

    def predict(self, text: str) -> tuple[str, float]:
        """What the expressions compute, for the surest family of one paragraph."""
        search = re.compile(self.pattern())
        found = [self.window(w) for w in _windows(_words(text)) if search.search(" ".join(w))]
        known = [x for x in found if x[0] != UNKNOWN]
        return max(known, key=lambda x: (x[1], -self.families.index(x[0]))) if known else (UNKNOWN, min((x[1] for x in found), default=1.0))

    def reach(self, terms: set[str]) -> float:
        """The most by which a window without any of `terms` could lift a family over `unknown`, less what the limit takes."""
        free = sorted({_bucket(g) for g in vocabulary() if not any(w in terms for w in g.split())})
        lift = self.weights[free, 1:] - self.weights[free, :1]
        need = self.temperature * math.log(self.limit / (1 - self.limit)) if self.limit < 1 else math.inf
        return float((np.maximum(lift, 0).sum(axis=0) + self.bias[1:] - self.bias[0]).max() - need)

    def gate(self) -> list[str]:
        """Words without any of which no window reaches the limit: P(family) >= limit takes z(family) - z(unknown) >=
        temperature * log(limit / (1 - limit)), and the grams without these words, all at once, do not lift any that far."""
        lift: dict[str, float] = {}
        for g in sorted(vocabulary()):
            up = float((self.weights[_bucket(g), 1:] - self.weights[_bucket(g), 0]).max())
            for w in g.split():
                if w not in _PLAIN:
                    lift[w] = max(lift.get(w, 0.0), up * (1.0 if g == w else 0.5))
        order = sorted(lift, key=lambda w: (-lift[w], w))
        low, high = 0, len(order)
        if self.reach(set(order)) >= 0:
            raise ValueError("a window without any word of the vocabulary reaches the limit")
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.reach(set(order[:mid])) < 0 else (mid + 1, high)
        return sorted(order[:low])

    def pattern(self) -> str:
        if not hasattr(self, "_pattern"):
            self._pattern = "(?<![a-z0-9])(?:" + "|".join(self.gate()) + ")(?![a-z0-9])|" + "|".join(STEMS)
        return self._pattern


@lru_cache(1)
def train(seed: int = 11, each: int = 8, epochs: int = 30) -> Model:
    """Stochastic gradient descent on made windows; every fifth and the licences left out calibrate."""
    rng = random.Random(seed)
    families = [UNKNOWN, *TEMPLATES]
    common = [w for ts in wordings().values() for s in ts for w in _words(s)]

    def around() -> list[str]:
        most = rng.choice([0, 0, 10, 30])
        if rng.random() < 0.1:
            return rng.choices(common, k=rng.randint(0, min(most, 8)))
        words = _words(" ".join(rng.sample([*_PROSE, *_OTHER], 3)))
        at = rng.randrange(len(words))
        return words[at : at + rng.randint(0, most)]

    made: list[tuple[list[int], int]] = []
    far: list[tuple[list[int], int]] = []  # windows of licences that are left out of training
    for at, family in enumerate(families):
        plain = [n for n in NAMES.get(family, []) if len(_words(n)) > 1 or any(c.isdigit() for c in n)]  # telling without a frame
        for text in [*_OTHER, *_PROSE] * 8 if family == UNKNOWN else [*wordings()[family], *plain * 3]:
            # names in frames are many, so other wordings come more often, and so do short ones, which say least
            often = family == UNKNOWN or text in TEMPLATES[family] or text in WORDINGS[family] or len(_words(text)) < 5
            for _ in range(5 * each if often else each):
                words = _words(text)
                if len(words) > 12:  # a shorter one could lose the word that tells
                    words = [w for w in words if rng.random() > 0.04]
                if family == UNKNOWN and rng.random() < 0.4:
                    words = rng.choices(common, k=rng.randint(1, 30))
                elif family != UNKNOWN and len(words) > 24 and rng.random() < 0.3:
                    cut = rng.randint(0, len(words) - 20)
                    words = words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]
                before, after = around(), around()
                room = max(0, WINDOW - len(words))
                made.append((_buckets([*before[-(room // 2) :], *words, *after[: room - room // 2]] if room > 1 else words[:WINDOW]), at))
    others = [[*OTHER_WORDINGS.get(f, []) * 5, *(x.format(n) for n in ns for x in FRAMES), *ns] for f, ns in OTHERS.items()]
    for held, group in ((False, others[0::2]), (True, others[1::2])):
        for words in [_words(t) for ts in group for t in ts for _ in range(each)]:
            before, after = around(), around()
            room = max(0, WINDOW - len(words))
            (far if held else made).append((_buckets([*before[-(room // 2) :], *words, *after[: room - room // 2]] if room > 1 else words[:WINDOW]), 0))
    rng.shuffle(made)
    fitted = len(made)
    made += far
    own = np.unique(np.concatenate([np.array(b, np.int64) for b, _ in made]))
    x = np.zeros((len(made), len(own)), np.uint8)  # only the buckets in use, a byte each
    for i, (b, _) in enumerate(made):
        x[i, np.searchsorted(own, b)] = 1
    y = np.array([c for _, c in made])
    aside = (np.arange(len(made)) % 5 == 4) | (np.arange(len(made)) >= fitted)
    order = np.random.default_rng(seed)
    w, bias = np.zeros((len(own), len(families)), np.float32), np.zeros(len(families), np.float32)
    fit = np.flatnonzero(~aside)
    for epoch in range(epochs):
        rate = 0.5 / (1 + epoch / 5)
        for at in np.array_split(order.permutation(fit), max(1, len(fit) // 64)):
            seen = x[at].astype(np.float32)
            z = seen @ w + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), y[at]] -= 1
            w -= rate * (seen.T @ p / len(at) + 1e-4 * w)
            bias -= rate * p.mean(axis=0)
    w, bias = w.astype(float).round(4), bias.astype(float).round(4)
    z = np.concatenate([x[at].astype(float) @ w for at in np.array_split(np.flatnonzero(aside), max(1, aside.sum() // 1024))]) + bias

    def probabilities(heat: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / heat)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.1, 10, 40)
    heat = float(min(grid, key=lambda t: -np.log(probabilities(t)[np.arange(len(z)), y[aside]] + 1e-12).mean()))
    p = probabilities(heat)
    best, right = p.max(axis=1), p.argmax(axis=1) == y[aside]
    down = np.argsort(-best)
    good = np.flatnonzero(np.cumsum(right[down]) / np.arange(1, len(down) + 1) >= 0.99)
    full = np.zeros((BUCKETS, len(families)))
    full[own] = w
    return Model(families, full, bias, heat, float(max(0.5, best[down[good[-1]]])) if len(good) else 1.0)


def _constant(value: object, ddl: str) -> Column:
    """A constant array, folded once by the optimizer."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """Per paragraph that holds a gated word, and family found in it: doc_id, paragraph (its number), family, probability, template, similarity, confirmed."""
    model = model or train()
    gated = model.pattern()
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where(F.lower("text").rlike(gated))
    rows = rows.select("doc_id", F.posexplode(F.split("text", r"(?<=[.!?:;])[ \t\r]*\n|\n[ \t\r]*\n")).alias("paragraph", "t")).where(F.lower("t").rlike(gated))
    rows = rows.select("doc_id", "paragraph", F.regexp_extract_all(F.lower("t"), F.lit(_WORD), F.lit(0)).alias("w"))
    last = F.greatest(F.ceil((F.size("w") - WINDOW) / F.lit(STRIDE)), F.lit(0)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i * STRIDE + 1, F.lit(WINDOW)))
    windows = F.filter(windows, lambda w: F.array_join(w, " ").rlike(gated))

    known = _constant(sorted(vocabulary()), "array<string>")
    weights = _constant(model.weights.tolist(), "array<array<double>>")
    start = _constant(model.bias.tolist(), "array<double>")
    names = F.array(*map(F.lit, model.families))

    def scored(w: Column) -> Column:
        rest = F.greatest(F.size(w) - 1, F.lit(0))
        pairs = F.zip_with(F.slice(w, F.lit(1), rest), F.slice(w, F.lit(2), rest), lambda a, b: F.concat(a, F.lit(" "), b))
        buckets = F.array_distinct(F.transform(F.array_intersect(F.concat(w, pairs), known), lambda g: (F.crc32(g.cast("binary")) % BUCKETS).cast("int")))
        return F.aggregate(buckets, start, lambda acc, b: F.zip_with(acc, F.get(weights, b), lambda x, y: x + y), lambda acc: F.transform(acc, lambda x: x / F.lit(model.temperature)))

    rows = rows.select("doc_id", "paragraph", F.transform(windows, lambda w: F.struct(w.alias("w"), scored(w).alias("z"))).alias("s"))

    def judged(s: Column) -> Column:
        top = F.array_max(s["z"])
        best = F.lit(1.0) / F.aggregate(F.transform(s["z"], lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)
        at = F.array_position(s["z"], top).cast("int")
        return F.struct(best.alias("probability"), F.when(best >= model.limit, at).otherwise(F.lit(1)).alias("at"), s["w"].alias("w"))

    rows = rows.select("doc_id", "paragraph", F.transform("s", judged).alias("j"))
    found = F.filter("j", lambda x: x["at"] > 1)
    each = F.transform(F.array_distinct(F.transform(found, lambda x: x["at"])), lambda a: F.array_max(F.filter(found, lambda x: x["at"] == a)))
    rows = rows.select("doc_id", "paragraph", F.explode(F.when(F.size(found) > 0, each).otherwise(F.filter(F.array(F.array_min("j")), lambda x: x.isNotNull()))).alias("x"))
    rows = rows.select("doc_id", "paragraph", F.col("x.w").alias("w"), "x.probability", F.element_at(names, F.col("x.at")).alias("family"))

    texts = [{"family": f, "name": f"{f}#{i}", "runs": _runs(_words(t))} for f, ts in wordings().items() for i, t in enumerate(ts)]
    templates = _constant(texts, "array<struct<family:string,name:string,runs:array<string>>>")
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i <= F.size("w"))

    def held(n: int) -> Column:
        return F.transform(ends, lambda i: F.array_join(F.slice("w", i, F.lit(n)), " "))

    own = F.filter(templates, lambda t: t["family"] == F.col("family"))
    rows = rows.withColumn("held", F.array_distinct(F.concat(*map(held, range(1, RUN + 1)))))  # shorter runs for wordings that have no longer one
    near = F.transform(own, lambda t: F.struct((F.size(F.array_intersect(t["runs"], F.col("held"))) / F.size(t["runs"])).alias("s"), t["name"].alias("n")))
    rows = rows.withColumn("best", F.array_max(near))
    similarity = F.coalesce(F.col("best.s"), F.lit(0.0))
    return rows.select("doc_id", "paragraph", "family", F.round("probability", 6).alias("probability"), F.col("best.n").alias("template"), F.round(similarity, 6).alias("similarity"), (similarity >= CONFIRMED).alias("confirmed"))
