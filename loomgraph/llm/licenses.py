"""License scans: winnowed fingerprints of templates pick places, banded alignment measures them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import PUNCTUATION, Words, batches, gram_hashes

GRAM, WINNOW, BAND = 3, 2, 6
#: Templates go to every executor; together they may hold this many words (16 bytes each, with their fingerprints) at most,
#: several times those of all published licenses.
MAX_TEMPLATE_WORDS = 8_000_000

# Notices that texts carry, by SPDX identifier.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software"
    ),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-full": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a "
        "copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-full": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "BSD-full": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All-rights-reserved": "All rights reserved.",
    "All-rights-reserved-full": "All rights reserved. No part of this may be reproduced without permission.",
}


def _whole_texts(least: int = 12) -> dict[str, str]:
    """The license texts beside this file, each whole and by paragraphs of at least so many words, as clauses are copied alone."""
    words = lambda t: re.findall("[a-z0-9]+", t.lower())
    made, known = {}, [words(t) for t in TEMPLATES.values()]
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        made[f"{path.stem}-text"] = text
        parts = [p for p in re.split(r"\n\s*\n", text) if len(words(p)) >= least and words(p) not in known]
        made |= {f"{path.stem}-text-{k}": p for k, p in enumerate(parts, 1)}
    return made


TEMPLATES |= _whole_texts()


class Index:
    """Winnowed fingerprints of the templates: sorted hashes with the template and place of each."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.names = sorted(templates)
        words = Words(pa.array([templates[n] for n in self.names], pa.string()), lower=True, breaks=PUNCTUATION)
        if len(words.hash) > MAX_TEMPLATE_WORDS:
            raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
        self.words = [words.hash[a:b] for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
        if short := [n for n, own in zip(self.names, self.words, strict=True) if len(own) < GRAM]:
            raise ValueError(f"templates of under {GRAM} words have no fingerprint: {', '.join(short)}")
        rows = set()
        for t, own in enumerate(self.words):
            grams, at = _grams(own)
            for lo in range(max(1, len(grams) - WINNOW + 1)):
                part = grams[lo : lo + WINNOW]
                if len(part):
                    pick = lo + len(part) - 1 - int(part[::-1].argmin())
                    rows.add((int(grams[pick]), t, int(at[pick])))
        rows = sorted(rows)
        self.hashes = np.array([r[0] for r in rows], np.uint64)
        self.owner = np.array([r[1] for r in rows], np.int64)
        self.place = np.array([r[2] for r in rows], np.int64)


def _grams(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return gram_hashes(hashes, np.zeros(len(hashes), np.int64), min(GRAM, max(len(hashes), 1)))


def align(template: np.ndarray, text: np.ndarray, at: int, band: int = BAND) -> tuple[int, int, int]:
    """Most words of template matched in order by text near the diagonal text place = template place + at.

    A dynamic programme over the cells within band of the diagonal. Returns (matched words, first and last + 1 matched
    text place); of equal scores the one of the shortest stretch.
    """
    n, m = len(template), len(text)
    width = 2 * band + 1
    # state: (matches, -stretch, first, last)
    empty = (0, 0, -1, -1)
    before = [empty] * (width + 1)
    best = empty
    for i in range(n):
        now = [empty] * (width + 1)
        for c in range(width):
            j = i + at + c - band
            choice = max(now[c - 1] if c else empty, before[c + 1] if c + 1 < width else empty)
            if 0 <= j < m and template[i] == text[j]:
                got = before[c]
                first = got[2] if got[0] else j
                choice = max(choice, (got[0] + 1, first - j, first, j))
            now[c] = choice
        before = now
        best = max(best, max(now))
    return best[0], best[2], best[3] + 1


def _within(template: np.ndarray, text: np.ndarray, at: int, band: int = BAND) -> int:
    """How many words of template text has anywhere in the band, which align's matches cannot exceed."""
    hit, n, m = np.zeros(len(template), bool), len(template), len(text)
    for shift in range(at - band, at + band + 1):
        lo, hi = max(0, -shift), min(n, m - shift)
        if lo < hi:
            hit[lo:hi] |= template[lo:hi] == text[lo + shift : hi + shift]
    return int(hit.sum())


def find(index: Index, hashes: np.ndarray, grams: np.ndarray, places: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
    """(template, coverage, first word, last word + 1) of one text, by place; the best of matches that overlap."""
    lo, hi = np.searchsorted(index.hashes, grams, "left"), np.searchsorted(index.hashes, grams, "right")
    seen: dict[tuple[int, int], tuple[int, int]] = {}
    for k in np.flatnonzero(hi > lo).tolist():
        for f in range(int(lo[k]), int(hi[k])):
            diagonal = int(places[k] - index.place[f])
            seen.setdefault((int(index.owner[f]), diagonal // (BAND + 1)), (int(index.owner[f]), diagonal))
    found = []
    for t, diagonal in sorted(set(seen.values())):
        own = index.words[t]
        begin = max(0, diagonal - BAND)
        stretch = hashes[begin : diagonal + len(own) + BAND + 1]
        if _within(own, stretch, diagonal - begin) < least * len(own):  # no alignment can match more
            continue
        matched, first, last = align(own, stretch, diagonal - begin)
        if matched and matched / len(own) >= least:
            found.append((t, matched / len(own), begin + first, begin + last, matched))
    found.sort(key=lambda x: (-x[4], -x[1], x[2], x[0]))
    kept: list[tuple] = []
    for f in found:
        if all(f[3] <= k[2] or k[3] <= f[2] for k in kept):
            kept.append(f)
    return [f[:4] for f in sorted(kept, key=lambda x: (x[2], x[0]))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id and matches (template, coverage, start, end in code points, by start) of every row of docs.

    Words are runs of letters and digits, A-Z in lower case. A place is a candidate for a template if a run of GRAM words
    there is one of its winnowed fingerprints; the candidate's words are aligned with the template's in a band of BAND
    around the diagonal, and it is reported if at least ``least`` of the template's words match in order. Of matches
    that overlap the one with most matched words stays. A narrow operation; only the templates, whose size is checked,
    go to the executors.

    Null or empty text: no matches. Very long texts are scanned whole. Null doc_id: scanned. Repeated rows are scanned each.
    Ties: of equal matches that overlap, the one of greater coverage, then the earlier place, then the earlier name. Empty
    table: no rows. Extra columns are ignored. No template (an empty mapping): no matches; one of under GRAM words raises.
    """
    index = Index(TEMPLATES if templates is None else templates)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(items):
            words = Words(batch.column("text"), lower=True, breaks=PUNCTUATION)
            grams, at = words.grams(GRAM)
            place = np.minimum(np.searchsorted(index.hashes, grams), max(len(index.hashes) - 1, 0))
            hits = np.flatnonzero(index.hashes[place] == grams) if len(index.hashes) else np.zeros(0, np.int64)
            docs_hit = words.doc[at[hits]]
            out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d in np.unique(docs_hit).tolist():
                own_hits = hits[docs_hit == d] if len(hits) < 64 else hits[slice(*np.searchsorted(docs_hit, [d, d + 1]))]
                lo, hi = words.bounds[d], words.bounds[d + 1]
                raw = words.raw[words.offs[d] : words.offs[d + 1]]
                for t, coverage, a, b in find(index, words.hash[lo:hi], grams[own_hits], at[own_hits] - lo, least):
                    p, q = int(words.start[lo + a] - words.offs[d]), int(words.end[lo + b - 1] - words.offs[d])
                    begin = int(((raw[:p] & 0xC0) != 0x80).sum())
                    out[d].append({"template": index.names[t], "coverage": coverage, "start": begin, "end": begin + int(((raw[p:q] & 0xC0) != 0x80).sum())})
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "matches"])

    return own.mapInArrow(run, "doc_id long, matches array<struct<template:string,coverage:double,start:long,end:long>>")
