"""Operator 8: licence scans with template automata.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lower-cased.
Two kinds of matches:

* base phrases (``PHRASES``): places where the words stand one after another;
* templates (``TEMPLATES``): licence wording with markup. ``[[ ... ]]`` is optional,
  ``{{n}}`` stands for up to n words that may be replaced. A template is
  compiled to an automaton over words. A text is accepted where all mandatory
  words follow in exactly that order, with nothing else between them than
  optional or replaced words.

Places where an automaton may begin (its first two words are mandatory) are found
for a whole batch at once, and only from there the automaton runs. ``score`` is
1 with a template match, 0.5 with a base phrase only, else 0. Null or empty
text: no words, null places, empty labels. Null ids, ties and repeated rows are
scanned one by one. An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens as T
from .util import arrow_map

# Base phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of well-known licences and notices, with markup.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0 [[(the \"License\"); you may not use this file except in compliance with the License]]",
        "under the terms of the Apache License, Version 2.0"],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, [[either]] version 3",
        "under the terms of the GNU General Public License [[as published by the Free Software Foundation]], [[either]] version 3",
        "GNU General Public License [[v3.0]] version 3"],
    "gpl-2.0": [
        "under the terms of the GNU General Public License [[as published by the Free Software Foundation]], [[either]] version 2"],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License", "This {{2}} is licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the {{2}}), to deal in the {{2}} without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the {{2}}"],
    "cc-by-4.0": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "bsd-3-clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met "
        "{{80}} Neither the name of {{12}} nor the names of its contributors may be used"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
}

_CHAR = np.zeros(256, bool)
_CHAR[48:58] = _CHAR[65:91] = _CHAR[97:123] = _CHAR[128:] = True
_WORD = re.compile(r"[0-9a-z\x80-\U0010ffff]+")


def _hashes(words: list[str]) -> list[int]:
    raw = [w.encode() for w in words]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return T.span_hash(np.frombuffer(b"".join(raw), np.uint8), off[:-1], off[1:]).tolist()


class Automaton:
    """Automaton of one template: per state the next state for a word, the
    states reached without a word, and whether any word may pass."""

    def __init__(self, template: str):
        self.next: list[dict[int, int]] = [{}]
        self.free: list[list[int]] = [[]]
        self.any: list[int | None] = [None]
        at, opened = 0, []
        for part in re.split(r"(\[\[|\]\]|\{\{\d+\}\})", template.translate({c: c + 32 for c in range(65, 91)})):
            if part == "[[":
                opened.append(at)
            elif part == "]]":
                self.free[opened.pop()].append(at)
            elif part.startswith("{{"):
                ends = []
                for _ in range(int(part[2:-2])):
                    ends.append(at)
                    new = self._state()
                    self.any[at] = new
                    at = new
                for e in ends:
                    self.free[e].append(at)
            else:
                for h in _hashes(_WORD.findall(part)) if _WORD.search(part) else []:
                    new = self._state()
                    self.next[at][h] = new
                    at = new
        if opened:
            raise ValueError("optional part without an end: " + template)
        self.final = at
        a = next(iter(self.next[0]), None)
        if a is None or len(self.next[0]) != 1 or self.free[0] or self.any[0] is not None:
            raise ValueError("a template must begin with a mandatory word: " + template)
        self.first = a

    def _state(self) -> int:
        self.next.append({})
        self.free.append([])
        self.any.append(None)
        return len(self.next) - 1

    def _closed(self, states) -> set[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo.extend(self.free[s])
        return out

    def accepts(self, words: np.ndarray, start: int, end: int) -> bool:
        """Does the wording begin at word ``start``, before ``end``?"""
        states = self._closed([0])
        for k in range(start, end):
            if self.final in states:
                return True
            w = int(words[k])
            moved = [self.next[s][w] for s in states if w in self.next[s]] + [self.any[s] for s in states if self.any[s] is not None]
            if not moved:
                return False
            states = self._closed(moved)
        return self.final in states


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word,
    base_labels, labels, score."""
    wanted = [(np.array(_hashes(p.split()), np.uint64), label) for p, label in (PHRASES if phrases is None else phrases).items()]
    machines = [(Automaton(t), label) for label, ts in (TEMPLATES if templates is None else templates).items() for t in ts]
    second = {}
    for m, label in machines:
        after = m._closed([m.next[0][m.first]])
        words = None if any(m.any[s] is not None for s in after) else {w for s in after for w in m.next[s]}
        second.setdefault(m.first, []).append((words, m, label))
    marks = np.zeros(1 << 16, bool)
    for h in [int(p[0]) for p, _ in wanted] + list(second):
        marks[h >> 48] = True

    def run(b: pa.RecordBatch):
        buf, off = T.flat(b.column(1))
        n_words, n_base, lo, hi, base_labels, labels, score = [], [], [], [], [], [], []
        for i, j in T.slices(off):
            x, o = T.LOWER[buf[off[i]:off[j]]], off[i:j + 1] - off[i]
            starts, ends, first = T.runs(_CHAR[x], o)
            h = T.span_hash(x, starts, ends)
            at = np.flatnonzero(marks[(h >> np.uint64(48)).astype(np.int64)])
            row = np.searchsorted(first, at, "right") - 1
            places: dict[int, list[int]] = {}
            found: dict[int, set[str]] = {}
            more: dict[int, set[str]] = {}
            for p, label in wanted:
                k = np.flatnonzero((h[at] == p[0]) & (at + len(p) <= first[row + 1])) if len(at) else np.zeros(0, int)
                for q in range(1, len(p)):
                    k = k[h[at[k] + q] == p[q]]
                for a, r in zip(at[k].tolist(), row[k].tolist()):
                    places.setdefault(r, []).append(a - int(first[r]))
                    found.setdefault(r, set()).add(label)
            for a, r in zip(at.tolist(), row.tolist()):
                end = int(first[r + 1])
                for words, m, label in second.get(int(h[a]), ()):
                    if label not in more.get(r, ()) and (words is None or a + 1 < end and int(h[a + 1]) in words) and m.accepts(h, a, end):
                        more.setdefault(r, set()).add(label)
            n_words.append(np.diff(first))
            for r in range(j - i):
                p = places.get(r)
                n_base.append(len(p) if p else 0)
                lo.append(min(p) if p else None)
                hi.append(max(p) if p else None)
                base = found.get(r, set())
                base_labels.append(",".join(sorted(base)))
                labels.append(",".join(sorted(base | more.get(r, set()))))
                score.append(1.0 if r in more else 0.5 if base else 0.0)
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array(np.concatenate(n_words), pa.int64()), pa.array(n_base, pa.int64()), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()),
             pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
            names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return arrow_map(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), run,
                     "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
