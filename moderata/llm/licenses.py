"""License scans by template-markup matching (operator 2).

A template is the wording of a notice in which ``[ ... ]`` marks optional words
and ``{m,n}`` a replaceable region of m to n words (a name, a year, a version).
Templates are compiled into automata over words; a notice matches where its
mandatory words stand exactly, one after the other, with nothing between them
but optional words and replaceable regions. All templates run as one automaton,
and only from words that can begin one.

The base phrases are templates without markup; every place where their words
stand consecutively counts. Words are runs of ASCII letters and digits and of
characters beyond ASCII, of the text with A-Z lower-cased.

Defined cases: null or empty texts have no words, no labels, null places and
score 0; overlapping matches of different templates all count; of one
template the longest match from each place counts, and its later matches start
behind it; repeated rows are scanned each. The score is the share of the
text's words that lie in a match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, slabs, word_spans, word_table

# fixed values: the base phrases with their labels
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# fixed values: public wordings of common notices, with markup
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0 [the license] [you may not use this {0,3} except in compliance with the license]"),
    ("gpl-3.0", "[this {1,4} is] [free software] [licensed] under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 3 [of the license] [or at your option any later version]"),
    ("gpl-2.0", "[this {1,4} is] [free software] [licensed] under the [terms of the] gnu general public license [as published by the free software foundation] [either] version 2 [of the license] [or at your option any later version]"),
    ("lgpl", "under the [terms of the] gnu lesser general public license [version {1,2}]"),
    ("agpl", "under the [terms of the] gnu affero general public license [version {1,2}]"),
    ("cc", "[this {1,4} is] licensed under [the] [a] [terms of the] [creative commons] cc by [nc] [nd] [sa] {1,2} [international] [license]"),
    ("cc-zero", "[licensed under] cc0 [1 0] [universal]"),
    ("mit", "[licensed] under the mit license"),
    ("mit-grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("isc-grant", "permission to use copy modify and [or] distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("all-rights-reserved", "[copyright [c] {1,8}] all rights reserved"),
]
_WORD = word_table(bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122)))
_MARK = re.compile(r"\[|\]|\{(\d+),(\d+)\}|[^\s\[\]{}]+")


class Automaton:
    """Word automaton of all templates: states 0..n-1, edges by word, by any word, and free ones."""

    def __init__(self, templates: list[tuple[str, str]]):
        self.word: list[dict[bytes, list[int]]] = []
        self.any: list[list[int]] = []
        self.free: list[list[int]] = []
        self.accepts: dict[int, int] = {}
        self.labels = [label for label, _ in templates]
        self.starts: list[list[int]] = []
        for k, (_, markup) in enumerate(templates):
            first = self._state()
            at, stack = first, []
            for m in _MARK.finditer(markup):
                token = m.group()
                if token == "[":
                    stack.append(at)
                elif token == "]":
                    end = self._state()
                    self.free[at].append(end)
                    self.free[stack.pop()].append(end)
                    at = end
                elif m.group(1):
                    low, high = int(m.group(1)), int(m.group(2))
                    exits = []
                    for n in range(high):
                        if n >= low:
                            exits.append(at)
                        nxt = self._state()
                        self.any[at].append(nxt)
                        at = nxt
                    for s in exits:
                        self.free[s].append(at)
                else:
                    nxt = self._state()
                    self.word[at].setdefault(token.encode(), []).append(nxt)
                    at = nxt
            self.accepts[at] = k
            self.starts.append(self._closed([first]))
        self.first = {w for states in self.starts for s in states for w in self.word[s]}
        letters = rb"0-9a-z\x80-\xff"
        words = b"|".join(re.escape(w) for w in sorted(self.first))
        self.begins = re.compile(rb"(?<![%s])(?:%s)(?![%s])" % (letters, words, letters))
        # words that every match of the template holds: the quick test is that all stand in the text
        self.needs = [max(_mandatory(t), key=len).encode() for _, t in templates]

    def _state(self) -> int:
        self.word.append({})
        self.any.append([])
        self.free.append([])
        return len(self.word) - 1

    def _closed(self, states) -> list[int]:
        out, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in out:
                out.add(s)
                todo.extend(self.free[s])
        return sorted(out)

    def longest(self, k: int, words, at: int, n: int) -> int:
        """Number of words of the longest match of template k from word ``at``, or 0."""
        states, best, i = self.starts[k], 0, at
        while states and i < n:
            w = words(i)
            moved = [t for s in states for t in (*self.word[s].get(w, ()), *self.any[s])]
            states = self._closed(moved)
            i += 1
            if any(self.accepts.get(s) == k for s in states):
                best = i - at
        return best


def _mandatory(markup: str) -> list[str]:
    depth, out = 0, []
    for m in _MARK.finditer(markup):
        token = m.group()
        depth += (token == "[") - (token == "]")
        if depth == 0 and token not in "[]" and not m.group(1):
            out.append(token)
    return out


def scan_text(raw: bytes, automaton: Automaton, base: re.Pattern):
    """n_words, n_base, first, last, base labels, labels, covered words of a lower-cased text."""
    starts, ends = word_spans(np.frombuffer(raw, np.uint8), _WORD)
    n = len(starts)

    def word(i):
        return raw[starts[i]:ends[i]]
    places, base_labels, covered, labels = [], set(), [], set()
    for m in base.finditer(raw):
        phrase = b" ".join(re.findall(rb"[a-z]+", m.group())).decode()
        i = int(np.searchsorted(starts, m.start()))
        places.append(i)
        base_labels.add(BASE[phrase])
        covered.append((i, i + len(phrase.split())))
    usable = [k for k, need in enumerate(automaton.needs) if need in raw]
    if usable:
        begins = np.searchsorted(starts, [m.start() for m in automaton.begins.finditer(raw)])
        for k in usable:
            free = 0
            for i in begins.tolist():
                if i >= free and (size := automaton.longest(k, word, i, n)):
                    labels.add(automaton.labels[k])
                    covered.append((i, i + size))
                    free = i + size
    total, upto = 0, 0
    for lo, hi in sorted(covered):
        total += max(0, hi - max(lo, upto))
        upto = max(upto, hi)
    return n, len(places), min(places, default=None), max(places, default=None), base_labels, labels | base_labels, total


def base_pattern() -> re.Pattern:
    gap = rb"[^0-9a-z\x80-\xff]+"
    phrases = b"|".join(gap.join(w.encode() for w in p.split()) for p in BASE)
    return re.compile(rb"(?<![0-9a-z\x80-\xff])(?:%s)(?![0-9a-z\x80-\xff])" % phrases)


_COLUMNS = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def scanner(templates: list[tuple[str, str]]):
    """A column function text -> the counts, places, labels and score."""
    @F.pandas_udf(_COLUMNS)
    def scan(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton, base = Automaton(templates), base_pattern()
        tests = set(automaton.needs) | {max(p.split(), key=len).encode() for p in BASE}
        for texts in it:
            rows = [(0, 0, None, None, "", "", 0.0)] * len(texts)
            words = np.zeros(len(texts), dtype=np.int64)
            for slab in slabs(texts):  # word counts of all texts; only texts that can match are scanned word by word
                buf, offsets, owner = joined(slab)
                starts, _ = word_spans(buf, _WORD)
                cuts = np.searchsorted(starts, np.append(offsets, len(buf)))
                np.add.at(words, owner, np.diff(cuts))
            for k, text in enumerate(texts):
                rows[k] = (int(words[k]), *rows[k][1:])
                raw = b"" if text is None else text.encode("utf-8").lower()
                if any(t in raw for t in tests):
                    n, n_base, lo, hi, base_labels, labels, total = scan_text(raw, automaton, base)
                    rows[k] = (n, n_base, lo, hi, ",".join(sorted(base_labels)), ",".join(sorted(labels)),
                               total / n if n else 0.0)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in _COLUMNS.split(", ")])
            yield out.astype({"first_word": "Int64", "last_word": "Int64"})
    return scan


def scanned(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per document row: doc_id, counts and places of base phrases, labels and score."""
    return (docs.select("doc_id", scanner(templates or TEMPLATES)(F.col("text")).alias("x"))
            .select("doc_id", "x.*"))


def brute_force(text: str | None, templates: list[tuple[str, str]] | None = None) -> tuple:
    """Plain version for tests: all ways to write each template as a regex over words joined by spaces."""
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
    places = [(i, BASE[p]) for p in BASE for i in range(len(words)) if words[i:i + len(p.split())] == p.split()]
    covered = {j for i, label in places for p in BASE if BASE[p] == label for j in range(i, i + len(p.split()))}
    line = " " + "".join(w + " " for w in words)
    labels = {label for _, label in places}
    for label, markup in templates or TEMPLATES:
        rx = ""
        for m in _MARK.finditer(markup):
            t = m.group()
            rx += ("(?:" if t == "[" else ")?" if t == "]" else r"(?:[^ ]+ ){%s,%s}" % m.group(1, 2) if m.group(1)
                   else re.escape(t) + " ")
        at = 0
        starts = [k + 1 for k, c in enumerate(line[:-1]) if c == " "]
        for i, s in enumerate(starts[:len(words)]):
            if i < at:
                continue
            ends = [e for e in range(i + 1, len(words) + 1)
                    if re.fullmatch(rx, " ".join(words[i:e]) + " ")]
            if ends:
                labels.add(label)
                covered |= set(range(i, max(ends)))
                at = max(ends)
    return (len(words), len(places), min((i for i, _ in places), default=None), max((i for i, _ in places), default=None),
            ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), len(covered) / len(words) if words else 0.0)
