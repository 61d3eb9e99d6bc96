"""License scans: base phrases, and an exact set-similarity join of text blocks with license templates."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import flat_map_batches, map_batches

#: Words of a text in UTF-8, A-Z lower-cased: digits, a-z and everything beyond ASCII.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
THRESHOLD = 0.8
#: Words in a block, for each word of the template, at most.
SPREAD = 2
#: Template words at most: the bound on what goes to every worker.
MOST_WORDS = 2_000_000

#: label, text. Statements and short headers of public licenses; a caller can give more.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http www apache org licenses LICENSE-2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License version 3"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc0", "To the extent possible under law the author has dedicated all copyright and related rights to the public domain"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("reserved", "All rights reserved"),
]


def words(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Join:
    """The templates side of the join, with tokens in the corpus's order of frequency, rarest first.

    A block meets a template if it holds threshold of the template's distinct tokens, so need = ceil(threshold * size) of them. Of the template's
    tokens in that order the first size - need + 1 are its prefix: a block that meets it holds one of these. Blocks of fewer than need tokens
    cannot; and when the shared tokens so far and those that can still follow do not make need, matching stops.
    """

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.rank = {w: i for i, (w, _) in enumerate(sorted(((w, frequency.get(w, 0)) for w in {w for _, t in templates for w in words(t)}), key=lambda x: (x[1], x[0])))}
        self.sets: list[list[int]] = []
        self.labels: list[str] = []
        self.need: list[int] = []
        self.length: list[int] = []
        self.members: list[set[int]] = []
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for label, text in templates:
            own = sorted({self.rank[w] for w in words(text)})
            if not own:
                continue
            need = max(1, -int(-threshold * len(own) // 1))
            for at, token in enumerate(own[: len(own) - need + 1]):
                self.index[token].append((len(self.sets), at))
            self.sets.append(own)
            self.labels.append(label)
            self.need.append(need)
            self.length.append(len(words(text)))
            self.members.append(set(own))

    def block(self, tokens: list[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets."""
        get = self.rank.get
        own = sorted({r for r in map(get, tokens) if r is not None})
        if not own:
            return []
        found, seen = [], set()
        for at, token in enumerate(own):
            for t, i in self.index.get(token, ()):
                if t in seen:
                    continue
                seen.add(t)  # the first shared token in the order: what comes before it is not shared
                need, other = self.need[t], self.sets[t]
                if len(own) - at < need or len(other) - i < need:
                    continue
                n, a, b = 0, at, i
                while a < len(own) and b < len(other) and n + min(len(own) - a, len(other) - b) >= need:
                    if own[a] == other[b]:
                        n, a, b = n + 1, a + 1, b + 1
                    elif own[a] < other[b]:
                        a += 1
                    else:
                        b += 1
                if n >= need:
                    n += len(set(own[a:]).intersection(other[b:]))
                    found.append((t, n / len(other)))
        return found

    def places(self, t: int, hits: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(shared tokens, first word, end word) of the blocks that meet a template, best first, then shortest; of those that overlap the best only.

        hits: place and rank of a text's words that are in any template, in order. A block has SPREAD words at most for each of the template's. For each
        place the window of that size that ends there is searched, less what it holds twice at its beginning; only windows about a token of the prefix can do.
        """
        own, need, size = self.members[t], self.need[t], SPREAD * self.length[t]
        count: Counter = Counter()
        at, left, found = [x for x in hits if x[1] in own], 0, []
        for i, r in at:
            count[r] += 1
            while i - at[left][0] >= size or count[at[left][1]] > 1:
                count[at[left][1]] -= 1
                if not count[at[left][1]]:
                    del count[at[left][1]]
                left += 1
            if len(count) >= need:
                found.append((len(count), at[left][0], i + 1))
        out: list[tuple[int, int, int]] = []
        ends: list[int] = []  # of out's blocks, in order; they do not overlap
        starts: list[int] = []
        for n, a, b in sorted(found, key=lambda x: (-x[0], x[2] - x[1], x[1])):
            k = bisect_right(starts, a)
            if (k and ends[k - 1] > a) or (k < len(starts) and starts[k] < b):
                continue
            starts.insert(k, a)
            ends.insert(k, b)
            out.append((n, a, b))
        return out

    def blocks(self, tokens: list[bytes]) -> list[tuple[int, int, int, float, bool]]:
        """template, first word, end word, containment, and whether it gives its label, of every block that meets a template.

        It does not where most of the block's words are in another template's block that fits better and the two templates share half their tokens, as with
        one license's name within another's.
        """
        hits = [(i, r) for i, r in enumerate(map(self.rank.get, tokens)) if r is not None]
        met = [(t, a, b, n / len(self.sets[t])) for t, _ in self.block(tokens) for n, a, b in self.places(t, hits)]
        out = []
        for t, a, b, s in met:
            own = self.members[t]
            better = any(x > s and 2 * (min(b, d) - max(a, c)) >= b - a and 2 * len(own & self.members[o]) >= min(len(own), len(self.members[o])) for o, c, d, x in met)
            out.append((t, a, b, s, not better))
        return out


def base_places(tokens: list[bytes]) -> tuple[list[int], set[str]]:
    places, labels = [], set()
    if b"license" not in tokens:
        return places, labels
    at = -1
    for _ in range(tokens.count(b"license")):
        at = tokens.index(b"license", at + 1)
        if at and tokens[at - 1] in (b"mit", b"apache"):
            places.append(at - 1)
            labels.add(tokens[at - 1].decode())
        if at > 1 and tokens[at - 2 : at] == [b"general", b"public"]:
            places.append(at - 2)
            labels.add("gpl")
    return places, labels


def token_frequency(docs: DataFrame, templates: list[tuple[str, str]], text_col: str = "text") -> dict[bytes, int]:
    """How often the templates' tokens occur in all texts. One row a task and token is shuffled; the result is bounded by the templates."""
    wanted = {w for _, t in templates for w in words(t)}

    def make():
        def run(texts):
            n: Counter = Counter()
            for t in texts:
                if t:
                    n.update(w for w in WORDS.findall(t.encode("utf-8", "surrogatepass").lower()) if w in wanted)
            return [[w.decode("utf-8", "surrogatepass") for w in n], list(n.values())]

        return run

    schema = T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.LongType())])
    return {r.word.encode(): r.n for r in flat_map_batches(docs, make, schema, [text_col]).groupBy("word").agg(F.sum("n").alias("n")).collect()}


def scan_licenses(docs: DataFrame, *, text_col: str = "text", keep: list[str] | None = None, templates: list[tuple[str, str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """keep's columns (all, if None) with the base phrases and the license templates of every whole text.

    New columns: n_words, n_base, first_word, last_word (starts of the base places, null without any), base_labels, labels, score (the best
    containment of any template in any block, 1 if a base phrase stands there, else 0) and blocks (label:first word:end word:containment of every
    block and template, comma-joined). A block is a run of words, whatever lines it spans, with SPREAD words at most for each of the template's: a statement may be
    wrapped and have other words between its own, but words scattered over a text are none. Null and empty texts
    have no words; repeated rows stay; an empty table gives no rows; columns with the new names are replaced. The templates have a
    checked size and go to the workers; only token counts are shuffled.
    """
    templates = TEMPLATES if templates is None else templates
    if sum(len(words(t)) for _, t in templates) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words; scan for them in parts")
    shared = docs.sparkSession.sparkContext.broadcast((templates, token_frequency(docs, templates, text_col), threshold))

    def make():
        join = Join(*shared.value)
        rare = set(join.index)

        def run(texts):
            return list(zip(*map(of, texts), strict=True))

        def of(text):
            tokens = words(text)
            places, base = base_places(tokens)
            labels = set(base)
            found: dict[tuple[str, int, int], float] = {}
            if tokens and not rare.isdisjoint(map(join.rank.get, tokens)):
                for t, a, b, s, stands in join.blocks(tokens):
                    key = join.labels[t], a, b
                    found[key] = max(s, found.get(key, 0.0))
                    if stands:
                        labels.add(join.labels[t])
            return (
                len(tokens), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
                1.0 if places else max(found.values(), default=0.0), ",".join(f"{k}:{a}:{b}:{s:.3f}" for (k, a, b), s in sorted(found.items(), key=lambda x: (x[0][1], x[0]))),
            )

        return run

    long, text = T.LongType(), T.StringType()
    new = [T.StructField(n, k) for n, k in (("n_words", long), ("n_base", long), ("first_word", long), ("last_word", long), ("base_labels", text), ("labels", text), ("score", T.DoubleType()), ("blocks", text))]
    names = [c for c in (docs.columns if keep is None else keep) if c not in {f.name for f in new}]
    return map_batches(docs, make, new, [text_col], names)
