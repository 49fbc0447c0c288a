"""License scans: normalised text against licence templates, by Dice over word bigrams."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dealerlens.llm.common import document_runs, texts

# Wordings of well-known public licence notices.
TEMPLATES = {
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}

THRESHOLD = 0.75

#: Letters and digits stay (A-Z folded), line ends stay, other ASCII becomes a blank; bytes above ASCII belong to words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b == 10 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def bigrams(words: list[bytes]) -> set[tuple[bytes, bytes]]:
    return set(zip(words, words[1:]))


class Templates:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        grams = {name: bigrams(text.encode().translate(_FOLD).split()) for name, text in templates.items()}
        self.sized = sorted(((len(g), name, g) for name, g in grams.items() if g))
        # dice >= t needs t / (2 - t) <= size ratio <= (2 - t) / t
        self.low, self.high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.least = min((n for n, _, _ in self.sized), default=0) * self.low
        self.most = max((n for n, _, _ in self.sized), default=0) * self.high
        self.words = {name: len(text.encode().translate(_FOLD).split()) for name, text in templates.items()}
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for t, (_, _, g) in enumerate(self.sized):
            for x in g:
                self.holders.setdefault(x, []).append(t)

    def passages(self, words: list[bytes]) -> list[tuple[int, float, str, int, int]]:
        """(-bigrams shared, -dice, name, start, end) of every window of a template's
        word count at or above the threshold, most bigrams shared first.

        A window needs low * n hits (places whose bigram is in the template):
        only windows around so many hits are compared, no other can match.
        """
        hits: dict[int, list[int]] = {}
        holders = self.holders
        for i, x in enumerate(zip(words, words[1:])):
            if x in holders:
                for t in holders[x]:
                    hits.setdefault(t, []).append(i)
        out = []
        for t, h in hits.items():
            n, name, grams = self.sized[t]
            size, need = self.words[name], max(1, math.ceil(self.low * n - 1e-9))
            starts: set[int] = set()
            for first, last in zip(h, h[need - 1:]):
                starts.update(range(max(0, last - size + 2), min(first, len(words) - size) + 1))
            for s in starts:
                mine = bigrams(words[s:s + size])
                both = len(mine & grams)
                dice = 2 * both / (len(mine) + n)
                if dice >= self.threshold:
                    out.append((-both, -dice, name, s, s + size))
        return sorted(out)

    def best(self, words: list[bytes]) -> tuple[float, str, int] | None:
        """(dice, name, bigrams shared) of the closest template at or above the threshold; ties to the smaller name."""
        if len(words) - 1 < self.least:
            return None
        mine = bigrams(words)
        if not self.least <= len(mine) <= self.most:
            return None
        found = None
        for n, name, grams in self.sized:
            if not self.low * n <= len(mine) <= self.high * n:
                continue  # no overlap could reach the threshold
            both = len(mine & grams)
            dice = 2 * both / (len(mine) + n)
            if dice >= self.threshold and (found is None or (-dice, name) < (-found[0], found[1])):
                found = dice, name, both
        return found


def scan(data: bytes, templates: Templates) -> tuple[str | None, float, int, int]:
    """(licence, dice, unit, units matched) of one text: unit 0 is the whole text, unit i its ith line.

    A passage (words of a template's count anywhere in the text, line ends are
    blanks) is one more unit, numbered by the line it starts in, unless it
    overlaps a passage or a matched line that shares as many bigrams, or the
    whole text matches the same licence.
    """
    folded = data.translate(_FOLD)
    lines = [x.split() for x in folded.split(b"\n")]
    words = [w for x in lines for w in x]
    ends = np.cumsum([len(x) for x in lines])
    matched: list[tuple[float, str, int]] = []  # dice, licence, unit
    taken: list[tuple[int, int, int, str]] = []  # first word, end, bigrams shared, licence
    for i, unit in enumerate([words, *lines]):
        if found := templates.best(unit):
            matched.append((*found[:2], i))
            # The whole text hides its own licence only.
            taken.append((0, len(words), 0, found[1]) if i == 0 else (int(ends[i - 1]) - len(unit), int(ends[i - 1]), found[2], ""))
    kept = np.zeros(len(words), bool)
    for both, dice, name, a, b in templates.passages(words):
        if kept[a:b].any() or any(a < y and x < b and (k >= -both or name == other) for x, y, k, other in taken):
            continue
        kept[a:b] = True
        matched.append((-dice, name, int(np.searchsorted(ends, a, "right")) + 1))
    if not matched:
        return None, 0.0, -1, 0
    dice, name, unit = min(matched, key=lambda m: (-m[0], m[1], m[2]))
    return name, dice, unit, len(matched)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, license, dice, unit, n_matches for every row of ``docs``.

    A text is compared as a whole, line by line and by passages (see ``scan``);
    the best unit counts, ties to the smaller licence name, then the earlier unit.  Words are runs of
    letters and digits (A-Z folded, bytes above ASCII kept).  Without a match
    (null and empty texts too): null, 0, -1, 0.  Repeated rows give repeated results.
    """
    known = Templates(TEMPLATES if templates is None else templates, threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data in document_runs(batches):
            rows = list(zip(*(scan(x, known) for x in data)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(rows[0], pa.string()), pa.array(np.array(rows[1], float)), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                ["doc_id", "license", "dice", "unit", "n_matches"])

    return texts(docs).mapInArrow(run, "doc_id long, license string, dice double, unit long, n_matches long")


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The result of ``documents`` as DuckDB SQL, by whole texts and lines: equal where no notice is wrapped or shares a line."""
    rows = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    words = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {words.format('body')} AS w FROM (VALUES {rows}) v(name, body))),
docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
units AS (
  SELECT r, 0 AS unit, text AS body FROM docs
  UNION ALL
  SELECT r, unnest(range(1, len(l) + 1)) AS unit, unnest(l) AS body FROM (SELECT r, string_split(text, chr(10)) AS l FROM docs)),
cut AS (SELECT r, unit, {grams} AS g FROM (SELECT r, unit, {words.format('body')} AS w FROM units) WHERE len(w) > 1),
scored AS (
  SELECT c.r, c.unit, t.name, 2.0::DOUBLE * len(list_intersect(c.g, t.g)) / (len(c.g) + len(t.g)) AS dice
  FROM cut c JOIN t ON len(c.g) <= len(t.g) * {(2 - threshold) / threshold!r} AND len(c.g) >= len(t.g) * {threshold / (2 - threshold)!r}),
best AS (SELECT * FROM scored WHERE dice >= {threshold}
  QUALIFY row_number() OVER (PARTITION BY r, unit ORDER BY dice DESC, name) = 1),
one AS (SELECT r, name, dice, unit, count(*) OVER (PARTITION BY r) AS n FROM best
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY dice DESC, name, unit) = 1)
SELECT d.doc_id, one.name AS license, coalesce(one.dice, 0.0)::DOUBLE AS dice, CAST(coalesce(one.unit, -1) AS BIGINT) AS unit, CAST(coalesce(one.n, 0) AS BIGINT) AS n_matches
FROM docs d LEFT JOIN one USING (r)"""
