"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are windows of words: for templates of up to c words (c = 8, 16, 32, 64), 2c words at every
c-th place, so that any c words in a row lie in one block.  A block meets a template if it holds
THRESHOLD of the template's distinct words.

Tokens are ordered by how many documents hold them, rarest first, then by name.  To share t of a
template's m tokens, a block must hold one of the first m - t + 1 (prefix); it must have t distinct
tokens at least (length); and counting on from the i-th template token the rest must still
suffice (position).  The filters lose nothing, so the join finds every block over the threshold.

Besides, the base phrases are counted where their words stand in a row.

A short template has words that name its license; with most of the template around another name it
isn't that license's.  So a block gives its template's label only if it holds all the naming words too
(``named``); blocks and score are by containment alone.

Null and empty texts have no words and no labels; very long ones are scanned whole.  Repeated rows and
ties are scanned each; extra columns are ignored; an empty table gives no rows.  Counting the tokens sends
one row for each template token and task, a bounded table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm.common import slices

# The base phrases of the contract; sentences of public licenses with their labels and, last, the words that name the license.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
TEMPLATES = {
    "mit-notice": ("mit", "Released under the MIT License", "mit"),
    "mit-grant": ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    "apache-notice": ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    "apache-header": ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    "gpl-notice": ("gpl", "licensed under the GNU General Public License, version 3", "gnu general public"),
    "gpl-header": ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general public"),
    "cc-by-nc-notice": ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    "cc-by-notice": ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons attribution"),
    "bsd-terms": ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "isc-grant": ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    "mpl-header": ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    "unlicense": ("unlicense", "This is free and unencumbered software released into the public domain", "unencumbered"),
    "proprietary": ("proprietary", "All rights reserved. No part of this publication may be reproduced without prior written permission", "reserved publication reproduced"),
}
THRESHOLD = 0.8

#: A-Z to lower case; ASCII other than letters and digits to spaces; all else stays.
_WORD_BYTES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORD_BYTES).split()


class Template:
    def __init__(self, name: str, frequency: dict[bytes, int], threshold: float, label: str, text: str, naming: str = ""):
        words = words_of(text)
        self.name, self.label, self.naming = name, label, frozenset(words_of(naming))
        self.tokens = sorted(set(words), key=lambda w: (frequency.get(w, 0), w))
        self.need = max(1, math.ceil(threshold * len(self.tokens) - 1e-9))
        self.prefix = self.tokens[: len(self.tokens) - self.need + 1]
        self.size = next(c for c in (8, 16, 32, 64, 128, 256, 1 << 30) if len(words) <= c)

    def shared(self, block: set[bytes]) -> int:
        """Tokens that the block holds, or 0 once the needed number is out of reach."""
        if len(block) < self.need:
            return 0
        found = 0
        for place, token in enumerate(self.tokens):
            if token in block:
                found += 1
            elif found + len(self.tokens) - place - 1 < self.need:
                return 0
        return found


class Scanner:
    def __init__(self, frequency: dict[bytes, int], templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD):
        self.templates = [Template(n, frequency, threshold, *of) for n, of in templates.items()]
        self.by_prefix: dict[bytes, list[int]] = {}
        for i, t in enumerate(self.templates):
            for token in t.prefix:
                self.by_prefix.setdefault(token, []).append(i)

    def blocks(self, words: list[bytes]) -> list[tuple[str, str, int, int, float, bool]]:
        """(template, label, first word, words, containment, named) of every block over the threshold."""
        if self.by_prefix.keys().isdisjoint(words):
            return []
        candidates = set()
        for at, word in enumerate(words):
            for i in self.by_prefix.get(word, ()):
                c = self.templates[i].size
                candidates |= {(i, w * c) for w in (at // c - 1, at // c) if w >= 0}
        out = []
        for i, first in sorted(candidates):
            t = self.templates[i]
            block = words[first : first + 2 * t.size]
            held = set(block)
            shared = t.shared(held)
            if shared >= t.need:
                out.append((t.name, t.label, first, len(block), shared / len(t.tokens), t.naming <= held))
        return out


_PHRASES = [(p.encode().split(), label) for p, label in BASE.items()]


def base_places(words: list[bytes]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    out, at = [], -1
    while True:
        try:
            at = words.index(b"license", at + 1)
        except ValueError:
            return out
        for phrase, label in _PHRASES:
            first = at - len(phrase) + 1
            if first >= 0 and words[first : at + 1] == phrase:
                out.append((first, label))


def _count(tokens: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[bytes, int] = {}
        for part in slices(batches):
            for text in part.column(0).to_pylist():
                for token in tokens.intersection(words_of(text)):
                    n[token] = n.get(token, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], names=["token", "n"])

    return run


def token_frequency(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES) -> dict[bytes, int]:
    """Documents that hold each template token, over all documents; at most as many rows as there are such tokens."""
    tokens = frozenset(w for _, text, *_ in templates.values() for w in words_of(text))
    counted = docs.select("text").mapInArrow(_count(tokens), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return {bytes(r.token): r.n for r in counted.collect()}


_SCAN = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())])


def _scan(frequency, templates, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(frequency, templates, threshold)
        for part in slices(batches):
            rows = []
            for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                words = words_of(text)
                places, blocks = base_places(words), scanner.blocks(words)
                base = {label for _, label in places}
                starts = [at for at, _ in places]
                best = max([1.0 if places else 0.0, *(b[4] for b in blocks)])
                rows.append((doc, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | {b[1] for b in blocks if b[5]})), best, len(blocks)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SCAN)], schema=_SCAN)

    return run


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each document: its words, base places and labels, and its best containment."""
    frequency = token_frequency(docs, templates)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long"
    return docs.select("doc_id", "text").mapInArrow(_scan(frequency, templates, threshold), schema)


_BLOCKS = [("doc_id", pa.int64()), ("template", pa.string()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64()), ("named", pa.bool_())]


def _matches(frequency, templates, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(frequency, templates, threshold)
        for part in slices(batches):
            rows = [(doc, *b) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for b in scanner.blocks(words_of(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_BLOCKS)], names=[n for n, _ in _BLOCKS])

    return run


def matching_blocks(docs: DataFrame, templates: dict[str, tuple[str, ...]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Every block that meets a template, with its place and containment."""
    frequency = token_frequency(docs, templates)
    return docs.select("doc_id", "text").mapInArrow(_matches(frequency, templates, threshold), "doc_id long, template string, label string, first_word long, n_words long, containment double, named boolean")
