"""License scans: an exact set-similarity join of windows of text with license templates, and literal phrases.

A template is looked for in each window of SPREAD times its own length in words, wherever lines and sentences end; every
window that contains at least THRESHOLD of the template's distinct words matches (a template of fewer than SHORT words has
to be contained whole: four of five words are those of any license). Templates of one family share most words, so that
a text of one matches others; which of a family fits best is told beside the matches, none of which is left out for it. A
text with a matching window has as many of these words in all, so whole texts are joined first. Words are ordered by how many blocks (lines, or parts of
a line between sentence ends) of the whole corpus have them, rarest first; a matching text must hold one of a
template's first words in that order.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the query: phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Fixed values. Template label -> its text: notices as licenses give them, and short ones as they are commonly written.
TEMPLATES = {
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted",
    "bsd-conditions": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "agpl-notice": "This work is licensed under the GNU Affero General Public License, version 3",
    "epl-notice": "This work is licensed under the Eclipse Public License, version 2",
    "lgpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-notice": "This work is licensed under the GNU Lesser General Public License, version 3",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-notice": "Released under the MIT License",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "mpl-notice": "This work is licensed under the Mozilla Public License, version 2",
    "public-domain": "This work has been released into the public domain",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Templates that share most of their words.
FAMILIES = (
    ("gpl-header", "lgpl-header", "lgpl-3-header", "agpl-header"),
    ("gpl-2.0", "gpl-3.0", "lgpl-notice", "agpl-notice", "mpl-notice", "epl-notice"),
    ("cc-by-4.0", "cc-by-nc-4.0"),
    ("mit-permission", "mit-grant"),
    ("apache-header", "apache-2.0"),
)
THRESHOLD = 0.8
#: Distinct words under which a template has to be contained whole.
SHORT = 10
#: Length of the window that a template is looked for in, as a multiple of the template's: room for words put between.
SPREAD = 2
_BLOCK = re.compile(rb"\n+|(?<=[.!?])[ \t]+(?=[A-Z])")


def blocks_of(data: bytes) -> list[bytes]:
    """The text's blocks, in order; joined with what parts them, they are the whole text."""
    return _BLOCK.split(data)


def template_sets(templates: dict[str, str]) -> dict[str, frozenset[bytes]]:
    return {k: frozenset(w) for k, t in templates.items() if (w := common.words_of(t))}


def needed(size: int, threshold: float) -> int:
    """Words of a template of this size that a matching block must have."""
    return size if size < SHORT else math.ceil(size * threshold - 1e-9)


def word_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many blocks of all of docs each word of the vocabulary stands. Only the vocabulary reaches the driver."""
    names = {w.decode(): w for w in vocabulary}

    def run(x: dict[str, list]) -> dict[str, list]:
        n: dict[bytes, int] = defaultdict(int)
        for t in x["text"]:
            data = common.utf8(t)
            if not vocabulary.isdisjoint(data.translate(common.WORD_BYTES).split()):
                for block in blocks_of(data):
                    for w in vocabulary.intersection(block.translate(common.WORD_BYTES).split()):
                        n[w] += 1
        return {"word": [w.decode() for w in n], "n": list(n.values())}

    counts = common.map_batches(docs.select(F.col(text_col).alias("text")), "word string, n long", run)
    return {names[r["word"]]: r["n"] for r in counts.groupBy("word").agg(F.sum("n").alias("n")).collect()}


class Index:
    """Templates by the words of their prefixes, words in global order of frequency."""

    def __init__(self, sets: dict[str, frozenset[bytes]], frequencies: dict[bytes, int], threshold: float):
        self.sets, self.threshold = sets, threshold
        words = set().union(*sets.values()) if sets else set()
        self.rank = {w: k for k, w in enumerate(sorted(words, key=lambda w: (frequencies.get(w, 0), w)))}
        self.prefix: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for name, words in sorted(sets.items()):
            ordered = sorted(words, key=self.rank.__getitem__)
            for at, w in enumerate(ordered[: len(ordered) - needed(len(ordered), threshold) + 1]):
                self.prefix[w].append((name, at))
        self.probes = frozenset(self.prefix)

    def match(self, block: set[bytes] | frozenset[bytes]) -> list[tuple[str, float]]:
        """(template, containment) for each template that the block's words contain enough of."""
        tried: dict[str, int] = {}
        for w in block & self.probes:
            for name, at in self.prefix[w]:
                tried[name] = min(at, tried.get(name, at))
        out = []
        for name, at in tried.items():
            size = len(self.sets[name])
            least = needed(size, self.threshold)
            # Length: a smaller block cannot hold enough. Position: words before the first shared one are missing.
            if len(block) >= least and size - at >= least and (n := len(block & self.sets[name])) >= least:
                out.append((name, n / size))
        return sorted(out)


def phrase_places(words: list[bytes], phrases: dict[tuple[bytes, ...], str]) -> dict[str, list[int]]:
    """label -> starts (in words) of its phrases."""
    out: dict[str, list[int]] = defaultdict(list)
    by_first: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = defaultdict(list)
    for p, label in phrases.items():
        by_first[p[0]].append((p, label))
    for first, each in by_first.items():
        at = -1
        while True:
            try:
                at = words.index(first, at + 1)
            except ValueError:
                break
            for p, label in each:
                if tuple(words[at : at + len(p)]) == p:
                    out[label].append(at)
    return out


def windows(words: list[bytes], template: frozenset[bytes], length: int, least: int) -> list[tuple[int, int]]:
    """(start, words of the template) of windows of so many words that hold at least `least` of the template's distinct
    words. Windows start at such a word; of those that start within one length of the first, the fullest is told for all.
    """
    at = [k for k, w in enumerate(words) if w in template]
    held: dict[bytes, int] = defaultdict(int)
    best: list[tuple[int, int]] = []
    n = end = group = 0
    for start in at:
        while end < len(at) and at[end] < start + length:
            n += not held[words[at[end]]]
            held[words[at[end]]] += 1
            end += 1
        if n >= least:
            if not best or start >= group + length:
                best.append((start, n))
                group = start
            elif n > best[-1][1]:
                best[-1] = (start, n)
        held[words[start]] -= 1
        n -= not held[words[start]]
    return best


def scan(
    docs: DataFrame,
    templates: dict[str, str] = TEMPLATES,
    phrases: dict[str, str] = PHRASES,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_words, places array<struct<label,at>>, matches array<struct<at,label,containment>>, chosen array<string>) for each row.

    places: where phrases stand, at in words from 0, by at; matches: windows (their first word, from 0) and their
    templates, by at; chosen: of each family the template that the text contains most of (of equal ones the longest), and
    all templates of none. A null text counts as empty; no words: no places, no matches. Repeated rows and null ids give a row each, an empty table none;
    other columns are left out.
    """
    sets = template_sets(templates)
    frequencies = word_frequencies(docs, frozenset().union(*sets.values()), text_col) if sets else {}
    index = docs.sparkSession.sparkContext.broadcast(Index(sets, frequencies, threshold))
    lengths = {name: SPREAD * len(common.words_of(t)) for name, t in templates.items()}
    families = [set(f) for f in FAMILIES]
    literal = {tuple(common.words_of(p)): label for p, label in phrases.items()}
    phrase_words = [frozenset(p) for p in literal]

    def run(x: dict[str, list]) -> dict[str, list]:
        found = index.value
        out: dict[str, list] = {"id": x[id_col], "n_words": [], "places": [], "matches": [], "chosen": []}
        for t in x[text_col]:
            data = common.utf8(t)
            words = data.translate(common.WORD_BYTES).split()
            whole = set(words)
            places = phrase_places(words, literal) if any(p <= whole for p in phrase_words) else {}
            matches = []
            for name, _ in found.match(whole):
                own = found.sets[name]
                for at, n in windows(words, own, lengths[name], needed(len(own), threshold)):
                    matches.append({"at": at, "label": name, "containment": n / len(own)})
            best: dict[str, tuple[float, int]] = {}
            for m in matches:
                best[m["label"]] = max(best.get(m["label"], (0.0, 0)), (m["containment"], len(found.sets[m["label"]])))
            beaten = {a for f in families for a in f & best.keys() for b in f & best.keys() if best[a] < best[b]}
            out["chosen"].append(sorted(best.keys() - beaten))
            out["n_words"].append(len(words))
            out["places"].append(sorted(({"label": n, "at": a} for n, each in places.items() for a in each), key=lambda p: (p["at"], p["label"])))
            out["matches"].append(sorted(matches, key=lambda m: (m["at"], m["label"])))
        return out

    schema = (
        f"{common.ddl(docs, id_col, 'id')}, n_words long, places array<struct<label:string,at:long>>,"
        " matches array<struct<at:long,label:string,containment:double>>, chosen array<string>"
    )
    return common.map_batches(docs.select(id_col, text_col), schema, run)


def oracle_sql(labels: dict[str, str]) -> str:
    """The query's rows in SQL: every phrase at every place, every template in every window. labels: what each template is
    reported as.
    """

    def text(x: str | bytes) -> str:
        return "'" + (x.decode() if isinstance(x, bytes) else x).replace("'", "''") + "'"

    places, best = [], []
    for phrase in PHRASES:
        stands = " AND ".join(f"w[i + {k}] = {text(word)}" for k, word in enumerate(common.words_of(phrase)))
        places.append(f"list_transform(list_filter(range(1, len(w) + 1), lambda i: {stands}), lambda i: {{'at': i - 1, 'label': {text(PHRASES[phrase])}}})")
    for name, template in TEMPLATES.items():
        own = sorted(set(common.words_of(template)))
        known = "[" + ", ".join(map(text, own)) + "]"
        length, least = SPREAD * len(common.words_of(template)), needed(len(own), THRESHOLD)
        window = f"w[i:i + {length - 1}]"
        held = f"len(list_intersect({known}, {window}))"
        best.append(
            f"""CASE WHEN len(list_intersect({known}, w)) >= {least} THEN list_max(list_transform(list_filter(range(1, len(w) + 1),
              lambda i: list_contains({known}, w[i]) AND {held} >= {least}), lambda i: {held})) / {len(own)}.0 END AS {name.replace("-", "_").replace(".", "_")}"""
        )
    columns = [n.replace("-", "_").replace(".", "_") for n in TEMPLATES]
    told = ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {text(labels[n])} END" for c, n in zip(columns, TEMPLATES, strict=True))
    sizes = {n: len(set(common.words_of(t))) for n, t in TEMPLATES.items()}
    # Containment first, then the longer template: sizes are under a thousand.
    weight = {n: f"({c} * 1000000 + {sizes[n]})" for c, n in zip(columns, TEMPLATES, strict=True)}
    chosen = []
    for c, n in zip(columns, TEMPLATES, strict=True):
        rivals = [m for f in FAMILIES if n in f for m in f if m != n]
        chosen.append(f"CASE WHEN {' AND '.join([f'{c} IS NOT NULL', *[f'{weight[n]} >= coalesce({weight[m]}, 0)' for m in rivals]])} THEN {text(labels[n])} END")
    upper, lower = common.UPPER, common.LOWER
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, len(w)::BIGINT AS n_words, flatten([{", ".join(places)}]) AS p, {", ".join(best)} FROM d),
l AS (SELECT *, list_distinct(list_transform(p, lambda x: x.label)) AS base, list_filter([{told}], lambda x: x IS NOT NULL) AS own, list_filter([{", ".join(chosen)}], lambda x: x IS NOT NULL) AS best FROM f)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base, list_min(list_transform(p, lambda x: x.at))::BIGINT AS first_word,
       list_max(list_transform(p, lambda x: x.at))::BIGINT AS last_word, array_to_string(list_sort(base), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(base, own))), ',') AS labels,
       array_to_string(list_sort(list_distinct(best)), ',') AS chosen, (CASE WHEN len(p) > 0 THEN 1.0 ELSE coalesce(greatest({", ".join(columns)}), 0.0) END)::DOUBLE AS score FROM l
"""
