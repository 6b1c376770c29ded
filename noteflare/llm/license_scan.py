"""License scans by an exact set-similarity join of text blocks with license templates.

Template tokens are ordered by their number of documents in the whole corpus, rarest
first.  A block that holds a share ``threshold`` of a template's tokens holds one of
its ``|T| - need + 1`` rarest, so only those are looked up (prefix filter); a
block with fewer template tokens than needed is skipped (length filter), and a
hit is dropped when the tokens left after it in either order can't make up what is needed
(positional filter).  Survivors are verified on the sets.

Blocks are all runs of up to ``BLOCK_WORDS`` consecutive words of a text, wherever its
lines break (longer, if a template is).  They are filtered together in windows of twice that length
that overlap by half, so every block is in one; a survivor is verified by sliding a block over
its window.  Short
phrases are templates that need all their words, then verified to stand
consecutively anywhere in the text.

Licenses share most of their wording, so a block must also hold the words that name its license (a "GNU" notice
is none of Apache's, however alike), and a template under ``SHORT`` different words needs all of them within twice
its length: 80 % of seven words tells nothing apart.  Where a window meets a template and another that holds the
words naming the first and is named by words the first lacks (CC BY and CC BY-SA, GPL and LGPL), the other is
the closer one and stands alone.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteflare.llm.common import arrow_stage, with_fields

THRESHOLD = 0.8
BLOCK_WORDS = 128
SHORT = 20

# --- FIXED VALUES: phrases and the public wording of short license notices ---
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
TEMPLATES = (  # label, the words that name it, notice
    ("mit", "deal restriction", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
     "associated documentation files (the Software), to deal in the Software without restriction"),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
     "compliance with the License"),
    ("apache", "apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "gnu general", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "General Public License as published by the Free Software Foundation"),
    ("gpl", "gnu general", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "gnu general", "Licensed under the GNU General Public License, version 2"),
    ("lgpl", "lesser", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
     "Lesser General Public License as published by the Free Software Foundation"),
    ("lgpl", "lesser", "Licensed under the GNU Lesser General Public License"),
    ("agpl", "affero", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
     "Affero General Public License as published by the Free Software Foundation"),
    ("agpl", "affero", "Licensed under the GNU Affero General Public License"),
    ("bsd", "redistribution binary", "Redistribution and use in source and binary forms, with or without modification, are permitted "
     "provided that the following conditions are met"),
    ("isc", "fee copies", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
     "hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsl", "organization covered", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
     "software and accompanying documentation covered by this license"),
    ("zlib", "express implied", "This software is provided as-is, without any express or implied warranty. In no event will the authors "
     "be held liable for any damages arising from the use of this software"),
    ("mpl", "mozilla", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", "mozilla", "Licensed under the Mozilla Public License, version 2.0"),
    ("epl", "eclipse", "This program and the accompanying materials are made available under the terms of the Eclipse Public "
     "License 2.0 which is available at"),
    ("cc-by", "attribution", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "sharealike", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "noncommercial", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "noderivatives", "licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa", "noncommercial sharealike",
     "licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd", "noncommercial noderivatives",
     "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("cc-by", "cc by", "Licensed under CC BY 4.0"),
    ("cc-by-sa", "cc sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "cc nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "cc nd", "Licensed under CC BY-ND 4.0"),
    ("cc-by-nc-sa", "cc nc sa", "Licensed under CC BY-NC-SA 4.0"),
    ("cc-by-nc-nd", "cc nc nd", "Licensed under CC BY-NC-ND 4.0"),
    ("cc0", "waived", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
     "to this work"),
    ("unlicense", "unencumbered", "This is free and unencumbered software released into the public domain"),
)

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased words: runs of ASCII letters, digits and non-ASCII characters."""
    return _WORD.findall((text or "").encode("utf-8", "replace").lower())


def _windows(words: list[bytes], size: int):
    """Windows of twice ``size`` words; every run of ``size`` words is in one."""
    for a in range(0, max(1, len(words) - size), size):
        yield words[a:a + 2 * size]


def _densest(words: list[bytes], tokens: frozenset, size: int, names: frozenset = frozenset()) -> int:
    """The most different ``tokens`` in any run of ``size`` words that holds all ``names`` (a part of the tokens)."""
    at = [(i, w) for i, w in enumerate(words) if w in tokens]
    held, best, a = Counter(), 0, 0
    for i, w in at:
        held[w] += 1
        while at[a][0] <= i - size:
            gone = at[a][1]
            held[gone] -= 1
            if not held[gone]:
                del held[gone]
            a += 1
        if len(held) > best and names <= held.keys():
            best = len(held)
    return best


class Index:
    """Prefix index of the templates under a global token order."""

    def __init__(self, document_counts: dict[bytes, int], phrases=PHRASES, templates=TEMPLATES,
                 threshold: float = THRESHOLD):
        rank = lambda w: (document_counts.get(w, 0), w)
        self.tokens = sorted({w for *_, t in templates for w in words_of(t)} | {w for t, _ in phrases for w in words_of(t)},
                             key=rank)
        self.place = {w: i for i, w in enumerate(self.tokens)}
        self.phrases = []
        for text, label in phrases:
            words = words_of(text)
            rarest = min(words, key=rank)
            self.phrases.append((label, words, rarest, words.index(rarest)))
        self.templates, self.prefix = [], {}
        self.block_words = max([BLOCK_WORDS, *[2 * len(words_of(t)) for *_, t in templates]])
        for label, names, text in templates:
            ordered = sorted(set(words_of(text)), key=self.place.get)
            short = len(ordered) < SHORT
            need = len(ordered) if short else math.ceil(threshold * len(ordered) - 1e-9)
            size = 2 * len(words_of(text)) if short else self.block_words
            for i, w in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(w, []).append((len(self.templates), i))
            self.templates.append((label, ordered, frozenset(ordered), need, size, frozenset(words_of(names))))

    def window(self, words: list[bytes]):
        """(label, containment) of the closest templates that a block of the window meets."""
        mine = sorted({w for w in words if w in self.place}, key=self.place.get)
        seen, met = set(), {}
        for j, w in enumerate(mine):
            for t, i in self.prefix.get(w, ()):
                label, ordered, tokens, need, size, names = self.templates[t]
                if t in seen or len(mine) < need:  # length filter
                    continue
                seen.add(t)
                # the first hit of a template is its rarest token here: nothing before it is shared
                if min(len(ordered) - i, len(mine) - j) < need:  # positional filter
                    continue
                if not names.issubset(mine) or len(tokens.intersection(mine)) < need:
                    continue
                shared = _densest(words, tokens, size, names)
                if shared >= need:
                    met[t] = shared / len(ordered)
        for t, share in met.items():
            *_, tokens, _, _, names = self.templates[t]
            closer = [u for u in met if names <= self.templates[u][2] and not self.templates[u][5] <= tokens]
            if not closer:
                yield self.templates[t][0], share

    def scan(self, text: str | None):
        """(n_words, [(start, label)], {labels of the method}, score) of one text."""
        words = words_of(text)
        present = self.place.keys() & set(words)
        places = []
        for label, phrase, rarest, at in self.phrases:
            if present.issuperset(phrase):
                n = len(phrase)
                places += [(i - at, label) for i, w in enumerate(words)
                           if w == rarest and i >= at and words[i - at:i - at + n] == phrase]
        found, score = set(), 1.0 if places else 0.0
        if any(w in self.prefix for w in present):
            for window in _windows(words, self.block_words):
                for label, share in self.window(window):
                    found.add(label)
                    score = max(score, share)
        return len(words), places, found, score


def document_counts(docs: DataFrame, text_col: str, tokens: list[bytes]) -> dict[bytes, int]:
    """Number of documents that hold each template token, over the whole corpus."""
    wanted = frozenset(tokens)

    def count(batches):
        for b in batches:
            n = Counter()
            for t in b.column(0):
                n.update(wanted.intersection(words_of(t.as_py())))
            yield pa.RecordBatch.from_arrays(
                [pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["w", "n"])

    rows = arrow_stage(docs.select(text_col), count, "w string, n long").groupBy("w").agg(F.sum("n")).collect()
    return {w.encode(): n for w, n in rows}  # one number a template token


def scan(docs: DataFrame, text_col: str = "text", phrases=PHRASES, templates=TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Every input row with (n_words, n_base, first_word, last_word, base_labels, labels, score) appended.

    ``n_base`` counts the places of all phrases; ``first_word`` and ``last_word`` are
    their smallest and largest word offsets, null without any.  Label lists are
    distinct, sorted and comma-joined, empty without any; ``labels`` has the
    phrases' and the templates'.  ``score`` is the best containment (1 for a phrase).  Null
    and empty texts have no words.  Input columns of those names (in any case) are replaced;
    an empty table gives an empty result.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    src = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    index = Index(document_counts(src, text_col, Index({}, phrases, templates, threshold).tokens),
                  phrases, templates, threshold)
    at, names = src.columns.index(text_col), [*src.columns, *added]
    longs, text = [pa.int64()] * 4, pa.string()

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(at):
                n, places, found, score = index.scan(t.as_py())
                starts, base = [p[0] for p in places], {p[1] for p in places}
                rows.append((n, len(places), min(starts, default=None), max(starts, default=None),
                             ",".join(sorted(base)), ",".join(sorted(base | found)), float(score)))
            cols = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [*b.columns, *[pa.array(c, k) for c, k in zip(cols, [*longs, text, text, pa.float64()])]], names=names)

    return arrow_stage(src, run, with_fields(src.schema, ", ".join(
        f"{c} {k}" for c, k in zip(added, ["long"] * 4 + ["string", "string", "double"]))))
