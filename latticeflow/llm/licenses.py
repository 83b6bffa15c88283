"""Licence notices in documents by a paragraph classifier, in DataFrame operations only.

A multinomial logistic regression over sparse word n-grams (one to three words around an
anchor, hashed into ``BUCKETS``) tells licence families and an unknown class apart.  It is
trained here, on names, notices and texts of licences and on a bounded sample of ordinary
paragraphs, and its temperature is fitted on held-out folds, so that the unknown class is
calibrated.  A predicted family must be confirmed by comparison with its templates: some
template must have ``CONFIRM`` of its two-word runs in the paragraph.

Paragraphs end at blank lines; a paragraph of several lines is looked at as a whole and line
by line, so neither a wrapped notice nor one among other lines is lost.  A paragraph without
an anchor has no feature, and the model says unknown for it; that is why only texts that hold
the letters of an anchor are taken apart.  Scoring is one narrow projection without a shuffle.
"""

from __future__ import annotations

import json
import random
import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "unknown"
SAMPLE_PARAGRAPHS = 1000
BUCKETS = 4096
CONFIRM = 0.6
FOLDS = 4
EPOCHS = 120
#: Names of each family, as notices and titles have them.
NAMES = {
    "apache": ("apache license, version 2.0", "apache license version 2.0", "apache license 2.0", "apache software license", "apache-2.0", "apache license", "apache 2.0 license", "apache v2"),
    "mit": ("mit license", "mit licence", "license: mit", "mit licensed", "expat license", "spdx-license-identifier: mit", "license mit", "licensed mit", "licensed under mit"),
    "gpl": ("gnu general public license", "gnu gpl", "gpl license", "gpl-2.0", "gpl-3.0", "gplv2", "gplv3", "gpl v2", "gpl v3", "gpl version 2", "gpl version 3", "license: gpl"),
    "lgpl": ("gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl license", "lgpl-2.1", "lgpl-3.0", "lgplv2.1", "lgplv3", "lgpl v3", "license: lgpl"),
    "agpl": ("gnu affero general public license", "gnu agpl", "agpl license", "agpl-3.0", "agplv3", "agpl v3", "license: agpl"),
    "bsd": ("bsd license", "bsd licence", "bsd-2-clause", "bsd-3-clause", "2-clause bsd", "3-clause bsd", "bsd 3-clause license", "simplified bsd license", "new bsd license", "bsd-style license", "license: bsd", "bsd licensed"),
    "isc": ("isc license", "license: isc", "spdx-license-identifier: isc", "isc licensed", "licensed under isc"),
    "mpl": ("mozilla public license", "mpl-2.0", "mpl 2.0", "mpl license", "license: mpl", "mpl version 2.0"),
    "cc-by": ("cc by 4.0", "cc by 3.0", "cc-by-4.0 license", "creative commons attribution 4.0", "creative commons attribution license", "creative commons attribution 3.0", "cc by license"),
    "cc-by-sa": ("cc by-sa", "cc by-sa 4.0", "cc by-sa 3.0", "creative commons attribution-sharealike", "creative commons attribution share alike"),
    "cc-by-nc": ("cc by-nc", "cc by-nc 4.0", "cc by-nc-sa 4.0", "creative commons attribution-noncommercial", "creative commons attribution non-commercial"),
    "cc0": ("cc0", "cc0 1.0", "cc0 license", "creative commons zero", "public domain dedication", "unlicense", "released into the public domain", "dedicated to the public domain"),
    "reserved": ("all rights reserved", "all rights are reserved"),
}
#: Ways to name a licence; training examples only.
FORMS = (
    "{}", "licensed under the {}", "released under the {}", "available under {}", "distributed under the terms of the {}", "this project is licensed under the {}", "license: {}", "code is under the {}", "content available under {}",
    "see the {} for details", "released under the {}. all rights reserved.", "{}. all rights reserved", "spdx-license-identifier: {}", "this work is licensed under a {} international license", "you may use this file under the {} see the license file", "copyright 2020 the authors, {}",
)
#: Usual texts of each family, a paragraph each.
TEXTS = {
    "apache": (
        "licensed under the apache license, version 2.0 (the \"license\"); you may not use this file except in compliance with the license. you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an \"as is\" basis, without warranties or conditions of any kind, either express or implied. see the license for the specific language governing permissions and limitations under the license.",
    ),
    "mit": (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"software\"), to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so, subject to the following conditions:",
        "permission is hereby granted, free of charge, to any person obtaining a copy",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software.",
        "the software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. in no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.",
    ),
    "gpl": (
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "this program is distributed in the hope that it will be useful, but without any warranty; without even the implied warranty of merchantability or fitness for a particular purpose. see the gnu general public license for more details.",
        "you should have received a copy of the gnu general public license along with this program.",
        "the gnu general public license is a free, copyleft license for software and other kinds of works.",
        "gnu general public license version 3, 29 june 2007",
    ),
    "lgpl": (
        "this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version.",
        "see the gnu lesser general public license for more details.",
        "you should have received a copy of the gnu lesser general public license along with this library",
    ),
    "agpl": (
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation, either version 3 of the license, or (at your option) any later version.",
        "see the gnu affero general public license for more details.",
        "you should have received a copy of the gnu affero general public license along with this program.",
    ),
    "bsd": (
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "redistribution and use in source and binary forms, with or without",
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "this software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. in no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages",
    ),
    "isc": (
        "permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at",
        "the contents of this file are subject to the mozilla public license version 1.1 (the \"license\"); you may not use this file except in compliance with the license.",
    ),
    "cc-by": ("this work is licensed under a creative commons attribution 4.0 international license.", "this work is licensed under the creative commons attribution license"),
    "cc-by-sa": ("this work is licensed under a creative commons attribution-sharealike 4.0 international license.",),
    "cc-by-nc": ("this work is licensed under a creative commons attribution-noncommercial 4.0 international license.",),
    "cc0": (
        "this is free and unencumbered software released into the public domain.",
        "to the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "dedicated to the public domain under the creative commons cc0 license",
    ),
    "reserved": ("all rights reserved.", "copyright by the author. all rights reserved.", "copyright (c) 2021 the company. all rights reserved. no part of this publication may be reproduced without prior written permission"),
}
ORDINARY = (
    "you need a driving license to rent a car", "the license plate was missing", "all licenses expired last year", "poetic license is allowed here", "the apache people live in arizona",
    "an apache helicopter landed", "the gnu is a large antelope", "copyright law is hard", "the warranty covers two years", "he has a license to sell wine", "the house of commons met today",
    "redistribution of wealth is debated", "the tragedy of the commons", "they licensed the song for a film", "this offer comes without warranty", "a fishing licence costs ten pounds",
    "he asked a person for permission to reserve a seat", "the table is reserved for us", "the museum gave permission to take pictures", "permission was denied by the server", "the rights of the tenants are protected",
    "the license office is closed on mondays", "the committee may license new operators", "send a cc to the office", "she joined the public domain debate", "a mozilla employee spoke at the fair", "the warranty on the car is void",
    "the copyright of the song expired", "see the licence of the pub", "the bsd conference is in may", "the reserved seats are all taken", "redistribution of land began", "without permission nobody enters", "the isc committee met",
)
#: A feature is a run of words with one of these.
ANCHORS = (
    "license", "licence", "licensed", "licenced", "licenses", "licences", "sublicense", "unlicense", "spdx", "gnu", "gpl", "gplv2", "gplv3", "lgpl", "lgplv2", "lgplv2.1", "lgplv3", "agpl", "agplv3", "apache", "bsd", "isc", "mozilla", "mpl",
    "commons", "cc", "cc0", "copyright", "copyleft", "warranty", "warranties", "redistribution", "redistributions", "permission", "reserved", "domain",
)
#: Letters without which no word is an anchor; the short ones are looked for as whole words.
SHORT = tuple(a for a in ANCHORS if len(a) < 4)
SIGNS = ("licen", *(a for a in ANCHORS if a not in SHORT and "licen" not in a and not any(b != a and b in a for b in (*ANCHORS,) if b not in SHORT)))
_SHORT = "(?i)(^|[^a-z0-9])(" + "|".join(SHORT) + ")([^a-z0-9]|$)"
_WORD = r"[a-z0-9]+(?:[.][0-9]+)*"
_BREAK = r"\n[ \t\r\f\x0B]*\n"


def words(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def units(text: str) -> list[tuple[int, str]]:
    """``(paragraph, text)``: paragraphs, and the lines of those with several."""
    out = []
    for k, p in enumerate(re.split(_BREAK, text)):
        out += [(k, p)] + ([(k, line) for line in p.split("\n")] if "\n" in p else [])
    return out


def runs(own: list[str]) -> list[str]:
    """A template's two-word runs; its word, if it is one."""
    return list(dict.fromkeys(" ".join(p) for p in zip(own, own[1:]))) or own


#: Per family, the runs of each template.
TEMPLATES = {f: [runs(words(t)) for t in (*NAMES[f], *TEXTS.get(f, ()))] for f in NAMES}


def grams(own: list[str]) -> list[str]:
    """Runs of one to three words with an anchor."""
    out: dict[str, None] = {}
    for i in (i for i, w in enumerate(own) if w in ANCHORS):
        for a, b in ((i, i), (i - 1, i), (i, i + 1), (i - 2, i), (i - 1, i + 1), (i, i + 2)):
            if a >= 0 and b < len(own):
                out[" ".join(own[a : b + 1])] = None
    return list(out)


def buckets(own: list[str]) -> list[int]:
    """Distinct places of the features."""
    return list(dict.fromkeys(xxhash.xxh64_intdigest(g.encode(), 42) % BUCKETS for g in grams(own)))


def confirmed(own: list[str], family: str) -> float:
    """The largest share of one of the family's templates' runs that the words have."""
    have = {" ".join(p) for p in zip(own, own[1:])} | set(own)
    return max((sum(r in have for r in t) / len(t) for t in TEMPLATES.get(family, ())), default=0.0)


def examples(names: dict[str, tuple[str, ...]], forms: tuple[str, ...], texts: dict[str, tuple[str, ...]]) -> list[tuple[list[str], str]]:
    """Words and family of training notices: names in their forms, texts, and halves of long texts."""
    out = []
    for family in names:
        for name in names[family]:
            out += [(words(form.format(name)), family) for form in forms]
        for text in texts.get(family, ()):
            own = words(text)
            middle = len(own) // 2
            out += [(own, family)] * 3
            if len(own) > 12:
                out += [(own[:middle], family), (own[middle:], family)]
    return out


class Classifier:
    """Sparse multinomial logistic regression; families in order, the last one unknown."""

    def __init__(self, ordinary: list[list[int]], notices: list[tuple[list[str], str]] | None = None, seed: int = 11):
        """Trained on the fixed notices and on ``ordinary`` paragraphs, given by their buckets."""
        rng = random.Random(seed)
        self.families = [*NAMES, UNKNOWN]
        unknown = len(self.families) - 1
        data = [(buckets(own), self.families.index(f)) for own, f in (examples(NAMES, FORMS, TEXTS) if notices is None else notices)]
        data += [(buckets(words(t)), unknown) for t in ORDINARY for _ in range(3)] + [(list(b), unknown) for b in ordinary]
        data = [d for d in data if d[0]] + [([], unknown)] * 40
        rng.shuffle(data)
        losses = np.zeros(38)
        heat = np.arange(3, 41) / 10
        for k in range(FOLDS):
            weights, bias = self._train([d for i, d in enumerate(data) if i % FOLDS != k])
            held = data[k::FOLDS]
            z = np.array([weights[b].sum(0) + bias for b, _ in held]).reshape(len(held), -1)
            for i, t in enumerate(heat):
                losses[i] -= _log_softmax(z / t)[np.arange(len(held)), [y for _, y in held]].sum()
        self.temperature = float(heat[losses.argmin()])
        weights, bias = self._train(data)
        self.weights = np.round(weights / self.temperature, 6)  # as the projection has them
        self.bias = np.round(bias / self.temperature, 6)
        if self.bias.argmax() != unknown:
            self.bias[unknown] = self.bias.max() + 1.0  # without features, unknown

    def _train(self, data: list[tuple[list[int], int]]) -> tuple[np.ndarray, np.ndarray]:
        """Full-batch steps of a size for each weight by its past gradients, with a quadratic penalty."""
        n = len(self.families)
        place = np.concatenate([np.array(b, np.int64) for b, _ in data])
        row = np.repeat(np.arange(len(data)), [len(b) for b, _ in data])
        goal = np.zeros((len(data), n))
        goal[np.arange(len(data)), [y for _, y in data]] = 1.0
        share = goal / np.maximum(goal.sum(0), 1) * len(data) / n  # classes weigh alike
        size = share.sum(1, keepdims=True)
        used, at = np.unique(place, return_inverse=True)
        weights, bias = np.zeros((len(used), n)), np.zeros(n)
        past, past_bias = np.full((len(used), n), 1e-3), np.full(n, 1e-3)

        def added(index: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
            return np.stack([np.bincount(index, values[:, k], rows) for k in range(n)], 1)

        for _ in range(EPOCHS):
            p = np.exp(_log_softmax(added(row, weights[at], len(data)) + bias))
            pull = (goal - p) * size
            slope = added(at, pull[row], len(used)) - 0.02 * weights
            past += slope**2
            weights += 0.5 * slope / np.sqrt(past)
            slope = pull.sum(0)
            past_bias += slope**2
            bias += 0.5 * slope / np.sqrt(past_bias)
        whole = np.zeros((BUCKETS, n))
        whole[used] = weights
        return whole, bias

    def predict(self, paragraph: str) -> list[float]:
        """Probabilities by family, in plain Python (what the projection computes)."""
        z = self.weights[buckets(words(paragraph))].sum(0) + self.bias
        return np.exp(_log_softmax(z[None]))[0].tolist()


def _log_softmax(z: np.ndarray) -> np.ndarray:
    z = z - z.max(1, keepdims=True)
    return z - np.log(np.exp(z).sum(1, keepdims=True))


# ---- the projection, as SQL ------------------------------------------------------------------------


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _constant(value: object, kind: str) -> str:
    """A literal that the planner folds once, however large."""
    return f"from_json('{json.dumps(value, separators=(',', ':'))}', '{kind}')"


def _strings(values: tuple[str, ...]) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _sql_words(p: str) -> str:
    return f"regexp_extract_all(translate({p}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), r'{_WORD}', 0)"


def _sql_sign(p: str) -> str:
    """Whether a text can hold an anchor: plain searches for letters, and the short anchors as words."""
    lowered = f"lower({p})"
    short = " or ".join(f"contains({lowered}, '{s}')" for s in SHORT if not any(o != s and o in s for o in SHORT))
    return "(" + " or ".join(f"contains({lowered}, '{s}')" for s in SIGNS) + f" or (({short}) and rlike({p}, r'{_SHORT}')))"


def _sql_units(text: str) -> str:
    lines = "transform(split(p, chr(10)), s -> struct(cast(k as int) as paragraph, s as body))"
    whole = "array(struct(cast(k as int) as paragraph, p as body))"
    return f"flatten(transform(split({text}, r'{_BREAK}'), (p, k) -> if(contains(p, chr(10)), concat({whole}, {lines}), {whole})))"


def _sql_buckets(w: str) -> str:
    ends = ", ".join(f"struct(i - {a} as a, i + {b} as b)" for a, b in ((0, 0), (1, 0), (0, 1), (2, 0), (1, 1), (0, 2)))
    gram = f"array_join(slice({w}, s.a + 1, s.b - s.a + 1), ' ')"
    around = f"transform(filter(array({ends}), s -> s.a >= 0 and s.b < size({w})), s -> cast(pmod(xxhash64({gram}), {BUCKETS}) as int))"
    places = f"filter(transform({w}, (x, i) -> if(array_contains({_strings(ANCHORS)}, x), i, -1)), i -> i >= 0)"
    return f"array_distinct(flatten(transform({places}, i -> {around})))"


def _sql_runs(w: str) -> str:
    pairs = f"transform(slice({w}, 1, greatest(size({w}) - 1, 0)), (x, i) -> concat(x, ' ', {w}[i + 1]))"
    return f"array_distinct(concat({pairs}, {w}))"


def _sql_overlap(templates: str, have: str) -> str:
    return f"coalesce(array_max(transform({templates}, n -> cast(size(array_intersect(n, {have})) as double) / size(n))), 0D)"


def _scan(model: Classifier) -> Column:
    """Array of ``(paragraph, family, probability, overlap)`` of the text's paragraphs and lines with an anchor."""
    table = _constant([r if any(r) else [] for r in model.weights.tolist()], "array<array<double>>")
    templates = _constant([TEMPLATES.get(f, []) for f in model.families], "array<array<array<string>>>")
    bias = "array(" + ", ".join(f"{v!r}D" for v in model.bias.tolist()) + ")"
    logits = f"aggregate(b, {bias}, (z, k) -> if(size({table}[k]) = 0, z, zip_with(z, {table}[k], (x, y) -> x + y)))"
    probability = "1D / aggregate(z, 0D, (s, v) -> s + exp(v - array_max(z)))"
    overlap = f"if(f = {len(model.families) - 1}, 0D, {_let('have', _sql_runs('w'), _sql_overlap(f'{templates}[f]', 'have'))})"
    verdict = f"named_struct('paragraph', u.paragraph, 'family', {_strings(tuple(model.families))}[f], 'probability', {probability}, 'overlap', {overlap})"
    body = _let("b", _sql_buckets("w"), f"if(size(b) = 0, null, {_let('z', logits, _let('f', 'cast(array_position(z, array_max(z)) as int) - 1', verdict))})")
    scored = f"transform({_sql_units('txt')}, u -> if({_sql_sign('u.body')}, {_let('w', _sql_words('u.body'), body)}, null))"
    return F.expr(f"filter({scored}, x -> x is not null)")


def fit(documents: DataFrame, sample: int = SAMPLE_PARAGRAPHS) -> Classifier:
    """Trained with up to ``sample`` ordinary paragraphs that have an anchor, those with the smallest hashes.

    A paragraph that some family's template is confirmed in is no ordinary one and is left
    out.  Only features travel: at most ``BUCKETS`` numbers a paragraph.
    """
    templates = _constant([TEMPLATES[f] for f in NAMES], "array<array<array<string>>>")
    texts = documents.select(F.col("text").cast("string").alias("txt")).where(F.expr(_sql_sign("txt")))
    found = texts.select(F.explode(F.expr(f"filter({_sql_units('txt')}, u -> {_sql_sign('u.body')})")).alias("u")).select("u.body")
    hashed = found.select(F.xxhash64("body").alias("h"), "body")
    chosen = hashed.select("h").distinct().orderBy("h").limit(sample)  # the texts themselves stay where they are
    first = hashed.join(F.broadcast(chosen), "h", "left_semi").dropDuplicates(["h"])
    worded = first.select(F.expr(_sql_words("body")).alias("w"))
    best = _let("have", _sql_runs("w"), f"array_max(transform({templates}, t -> {_sql_overlap('t', 'have')}))")
    rows = worded.where(F.expr(f"{best} < {CONFIRM}D")).select(F.expr(f"array_sort({_sql_buckets('w')})").alias("b")).where("size(b) > 0").collect()
    return Classifier(sorted(list(r["b"]) for r in rows))


def license_scan(documents: DataFrame, model: Classifier | None = None) -> DataFrame:
    """``(doc_id, n_notices, families, probability, notices)``, a row per document.

    ``families`` are the confirmed families in order, joined by commas (null if none),
    ``n_notices`` how many pairs of paragraph and family were confirmed, and ``probability``
    their best.  ``notices`` lists every paragraph, and every line of a paragraph of several,
    that has an anchor, with its verdict (the first of equal families on a tie).  Null and
    empty texts have none; null and repeated doc_ids keep their rows; other columns are not
    read; an empty table gives no rows.
    """
    model = model or fit(documents)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("txt"))
    scanned = docs.select("doc_id", F.when(F.expr(_sql_sign("txt")), _scan(model)).alias("notices"))
    sure = F.filter("notices", lambda x: (x["family"] != UNKNOWN) & (x["overlap"] >= CONFIRM))
    out = scanned.select("doc_id", "notices", sure.alias("sure"))
    some = F.size("sure") > 0
    return out.select(
        "doc_id",
        F.when(some, F.size(F.array_distinct(F.transform("sure", lambda x: F.struct(x["paragraph"], x["family"]))))).otherwise(0).cast("long").alias("n_notices"),
        F.when(some, F.array_join(F.array_sort(F.array_distinct(F.transform("sure", lambda x: x["family"]))), ",")).alias("families"),
        F.array_max(F.transform("sure", lambda x: x["probability"])).alias("probability"),
        "notices",
    )
