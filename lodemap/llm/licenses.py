"""License scans: winnowed fingerprints of templates pick candidates, banded alignment reports coverage and spans."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, code_points, mapped, utf8
from .decontam import FOLD

#: Words of a fingerprint, and fingerprints of a window of which the least is kept. A run of GRAM + WINDOW - 1 equal words
#: shares a fingerprint for certain.
GRAM, WINDOW = 3, 2
#: Words that an alignment may drift from the diagonal of its fingerprint, and half a template's words at most: so the next
#: copy of a short notice is out of reach.
BAND = 8
#: The part of a template's words that a report needs, in percent.
LEAST_COVERAGE = 70

#: Whole licenses, a file each.
TEXTS = Path(__file__).parent / "license_texts"


def _gnu(name: str, title: str, version: str, work: str) -> dict[str, str]:
    terms = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {title}"
    return {
        f"{name} short": f"This work is licensed under the {title}, version {version}.",
        f"{name} only": f"{terms} version {version} as published by the Free Software Foundation.",
        name: f"{terms} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any "
        "later version.",
    }


def _creative_commons() -> dict[str, str]:
    kinds = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial"}
    kinds |= {"BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    out = {}
    for kind, title in kinds.items():
        for version, port in (("4.0", "International"), ("3.0", "Unported"), ("2.5", "Generic"), ("2.0", "Generic")):
            name = f"CC-{kind}-{version}"
            short, long = (name, f"{name} notice") if kind in ("BY", "BY-NC") else (f"{name} short", name)
            out[short] = f"Licensed under CC {kind} {version}."
            out[long] = f"This work is licensed under a Creative Commons {title} {version} {port} License."
    return out


#: Notices by which texts state their license, openings, and the whole licenses of ``TEXTS`` as "... text".
TEMPLATES = {
    "Apache-2.0 short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
    "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by "
    "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
    "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met",
    "BSD-2-Clause short": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause short": "Released under the BSD 3-Clause License.",
    "CC0-1.0 short": "Released under CC0 1.0.",
    "CC0-1.0": "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.",
    "EPL-1.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "ISC short": "Released under the ISC License.",
    "MIT short": "Released under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this "
    "file except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    **_gnu("AGPL-3.0", "GNU Affero General Public License", "3", "program"),
    **_gnu("GPL-2.0", "GNU General Public License", "2", "program"),
    **_gnu("GPL-3.0", "GNU General Public License", "3", "program"),
    **_gnu("LGPL-2.0", "GNU Library General Public License", "2", "library"),
    **_gnu("LGPL-2.1", "GNU Lesser General Public License", "2.1", "library"),
    **_gnu("LGPL-3.0", "GNU Lesser General Public License", "3", "library"),
    **_creative_commons(),
    **{f"{p.stem} text": re.sub(r"^\W+|\W+$", "", p.read_text(encoding="utf-8")) for p in sorted(TEXTS.glob("*.txt"))},
}


def _keys(name: str) -> list[str]:
    """What tells a license from its neighbours: patterns over folded words that must all be in the aligned part; one that
    starts with ``!`` must not."""
    license, _, form = name.partition(" ")
    version = license.rpartition("-")[2].replace(".", " ")
    if "GPL" in license:
        if form == "text":
            titles = {
                "GPL-2.0": r"\bversion 2 june 1991\b|the gnu general public license is intended to guarantee your freedom",
                "GPL-3.0": r"(?<!affero )general public license version 3 29 june|the gnu general public license is a free copyleft license"
                r"|13 use with the gnu affero general public license",
                "LGPL-2.0": r"\blibrary general public license\b", "LGPL-2.1": r"\blesser general public license\b",
                "LGPL-3.0": r"\blesser general public license\b",
            }
            return [titles[license], *(["!library general public license version 2"] if license == "GPL-2.0" else [])]
        titles = {"AGPL": r"\baffero general public license\b|\bagpl", "LGPL": r"\b(?:lesser|library) general public license\b|\blgpl"}
        plain = r"(?<!affero )(?<!lesser )(?<!library )\bgeneral public license\b|\bgpl"
        number = version.removesuffix(" 0")
        return [titles.get(license.partition("-")[0], plain), rf"\b(?:version |v|[al]?gplv|[al]?gpl ){number}\b(?! [1-9]\b)"]
    if license.startswith("CC-"):
        if form == "text":
            return [r"\battribution", *(["sharealike"] if "-SA" in license else ["!sharealike"]), "!noncommercial", "!noderivatives"]
        kind = license[3:].rpartition("-")[0].lower().replace("-", " ")
        words = {"by": "attribution", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc": "non ?commercial"}
        title = " ".join(words[k] for k in kind.split())
        number = version.removesuffix(" 0")
        return [rf"\b(?:(?:cc|creative commons) {kind}|creative commons {title}) {number}\b(?! [1-9]\b)"]
    return {
        "Apache-2.0 short": [r"\bapache (?:software )?license\b", r"\b(?:version |v|license )2\b(?! [1-9]\b)"],
        "Apache-2.0": [r"\bapache (?:software )?license\b", r"\b(?:version |v|license )2\b(?! [1-9]\b)"],
        "BSD-2-Clause short": [r"\bbsd 2 clause\b"],
        "BSD-3-Clause short": [r"\bbsd 3 clause\b"],
        "BSD-2-Clause text": ["!neither the name", "!all advertising materials mentioning"],
        "BSD-3-Clause text": ["neither the name", "!all advertising materials mentioning"],
        "CC0-1.0 short": [r"\bcc0\b"],
        "CC0-1.0": [r"\bcc0\b"],
        "EPL-1.0": [r"\beclipse public license (?:version |v )?v?1\b"],
        "EPL-2.0": [r"\beclipse public license (?:version |v )?v?2\b"],
        "ISC text": [r"provided that the above copyright notice"],
        "0BSD text": [r"!provided that the above copyright notice"],
        "ISC short": [r"\bisc license\b"],
        "MIT short": [r"\bmit license\b"],
        "MIT text": [r"\bthe above copyright notice and this permission notice\b"],
        "MPL-1.1": [r"\bmozilla public license (?:version |v )?v?1 1\b"],
        "MPL-2.0": [r"\bmozilla public license (?:version |v )?v?2\b"],
    }.get(name, [])


_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fingerprints(words: list[bytes]) -> np.ndarray:
    """The hash of every run of GRAM words, in order; of fewer words, of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - GRAM + 1)
    return np.fromiter((xxhash.xxh3_64_intdigest(b" ".join(words[i : i + GRAM])) for i in range(n)), np.uint64, n)


def winnowed(prints: np.ndarray) -> np.ndarray:
    """The places of the least print of each window, the last one of equals."""
    if len(prints) <= WINDOW:
        return np.array([len(prints) - 1 - int(np.argmin(prints[::-1]))]) if len(prints) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(prints, WINDOW)
    return np.unique(np.arange(len(views)) + WINDOW - 1 - np.argmin(views[:, ::-1], axis=1))


@dataclass
class Templates:
    """The templates' words and the inverted index of their fingerprints: print to (template, place)."""

    texts: dict[str, str]

    def __post_init__(self):
        self.names = sorted(self.texts)
        self.words = [self.texts[n].encode().translate(FOLD).split() for n in self.names]
        self.index: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            prints = fingerprints(words)
            for i in winnowed(prints).tolist():
                self.index.setdefault(int(prints[i]), []).append((t, i))
        self.keys = [_keys(n) if self.texts[n] == TEMPLATES.get(n) else [] for n in self.names]
        self.wanted = [[re.compile(k.encode()) for k in keys if k[0] != "!"] for keys in self.keys]
        self.barred = [[re.compile(k[1:].encode()) for k in keys if k[0] == "!"] for keys in self.keys]
        self.number = {w: i for i, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.ids = [np.array([self.number[w] for w in words], np.int64) for words in self.words]
        self.counts = [np.bincount(ids, minlength=len(self.number)) for ids in self.ids]
        # the first words of runs with a fingerprint, so that the runs of a text that can have none aren't hashed
        self.first = {self.words[t][i] for hits in self.index.values() for t, i in hits}

    def candidates(self, words: list[bytes]) -> set[tuple[int, int]]:
        """Pairs of a template and the diagonal (text place less template place) of a shared fingerprint."""
        out: set[tuple[int, int]] = set()
        if self.first.isdisjoint(words):
            return out
        for i, w in enumerate(words):
            if w in self.first:
                for t, j in self.index.get(xxhash.xxh3_64_intdigest(b" ".join(words[i : i + GRAM])), ()):
                    out.add((t, i - j))
        return out

    def close(self, words: list[bytes], least: int) -> Iterator[tuple[int, int]]:
        """The candidates whose alignment can reach ``least`` %: as many of the template's words stand within the band. Those of
        a template are in order of that number."""
        by_template: dict[int, list[int]] = {}
        for t, diagonal in self.candidates(words):
            by_template.setdefault(t, []).append(diagonal)
        if not by_template:
            return
        text = np.array([self.number.get(w, -1) for w in words], np.int64)
        held = np.bincount(text[text >= 0], minlength=len(self.number))
        for t, diagonals in sorted(by_template.items()):
            ids = self.ids[t]
            n = len(ids)
            if 100 * int(np.minimum(held, self.counts[t]).sum()) < least * n:
                continue
            padded = np.full(len(text) + 2 * (n + 2 * BAND), -1, np.int64)
            padded[n + 2 * BAND : n + 2 * BAND + len(text)] = text
            bounds = []
            for diagonal in diagonals:
                at = n + BAND + diagonal
                near = np.zeros(n, bool)
                for o in range(2 * BAND + 1):
                    near |= padded[at + o : at + o + n] == ids
                if 100 * int(near.sum()) >= least * n:
                    bounds.append((-int(near.sum()), diagonal))
            yield from ((t, diagonal) for _, diagonal in sorted(bounds))

    def told(self, t: int, words: list[bytes], start: int, end: int) -> bool:
        """Whether the aligned words have what tells the license from its neighbours."""
        span = b" ".join(words[start:end])
        more = b" ".join(words[start : end + 2])
        return all(any(m.end() <= len(span) for m in k.finditer(more)) for k in self.wanted[t]) and not any(
            k.search(span) for k in self.barred[t]
        )


def reach(size: int) -> int:
    """The band of a template of as many words."""
    return min(BAND, size // 2)


def align(template: list[bytes], words: list[bytes], diagonal: int) -> tuple[int, int, int]:
    """The longest common subsequence within reach of a diagonal: words matched, and the first and last place in the text
    (exclusive) of one such sequence; of equally long ones the tightest that ends first."""
    band = reach(len(template))
    width = 2 * band + 1
    best = [(0, 0, 0)] * (width + 1)  # matched, -start, -end so far, at offset o of the previous template word
    top = (0, 0, 0)
    for i, w in enumerate(template):
        row = []
        left = (0, 0, 0)
        for o in range(width):
            j = i + diagonal + o - band
            # the same text place was one offset further on for the word before
            here = max(best[o + 1], left)
            if 0 <= j < len(words) and words[j] == w:
                m, start, _ = best[o]
                here = max(here, (m + 1, start if m else -j, -(j + 1)))
            row.append(here)
            left = here
        best = [*row, (0, 0, 0)]
        top = max(top, left)
    return top[0], -top[1], -top[2]


def find_licenses(text: bytes, templates: Templates, least: int = LEAST_COVERAGE) -> list[tuple[str, int, int, int, int]]:
    """(name, matched, words, start, end) for each place where ``least`` % of a template's words align, in code points.

    Of reports that overlap, the one of most matched words stays, then the better covered, then the earlier.
    """
    folded = text.translate(FOLD)
    words = folded.split()
    found = []
    full: set[tuple[int, int]] = set()
    for t, diagonal in templates.close(words, least):
        size = len(templates.words[t])
        # a long template within reach of a full match overlaps it and can't match more
        if size > 4 * BAND and any((t, diagonal + o) in full for o in range(-BAND, BAND + 1)):
            continue
        matched, start, end = align(templates.words[t], words, diagonal)
        if matched == size:
            full.add((t, diagonal))
        if 100 * matched >= least * size and templates.told(t, words, start, end):
            found.append((-matched, size - matched, start, end, t))
    kept: list[tuple[int, int, int, int, int]] = []  # by place; none overlaps another
    for f in sorted(set(found)):
        at = bisect_left(kept, f[2], key=lambda k: k[2])
        if (not at or kept[at - 1][3] <= f[2]) and (at == len(kept) or f[3] <= kept[at][2]):
            kept.insert(at, f)
    if not kept:
        return []
    bounds = [m.span() for m in _WORD.finditer(folded)]
    points = iter(code_points(text, (x for _, _, a, b, _ in kept for x in (bounds[a][0], bounds[b - 1][1]))))
    return [(templates.names[t], -m, len(templates.words[t]), next(points), next(points)) for m, _, _, _, t in kept]


REPORT = "array<struct<license:string,matched:long,words:long,start:long,end:long>>"


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", least: int = LEAST_COVERAGE
) -> DataFrame:
    """Key and ``licenses``: the license notices in every whole text, by place, with their coverage and code point spans.

    Templates are few and travel with the tasks. Null and empty texts have no reports; repeated rows are scanned each for
    itself; other columns are ignored; an empty table gives no rows.
    """
    known = Templates(TEMPLATES if templates is None else templates)
    one = pa.struct([("license", pa.string()), ("matched", pa.int64()), ("words", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
    names = [f.name for f in one]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "__text"):
            found = [[dict(zip(names, r, strict=True)) for r in find_licenses(x, known, least)] for x in utf8(block, "__text")]
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(found, pa.list_(one))], names=["__key", "licenses"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    return mapped(rows, run, f"__key {kind}, licenses {REPORT}").withColumnRenamed("__key", key)
