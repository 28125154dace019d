"""License scans as an exact set-similarity join between text blocks and license templates.

A block for a template of n words is a window of n words of a text, at any place. Tokens are in one
global order: words that no template has, then template words by how many texts have each (counted
over all texts), rarest first. For a containment of t a block must share a = ceil(t |template|)
tokens with the template, so

* prefix filter: the first token in common is one of the template's first |template| - a + 1, so
  only windows around words of that prefix are looked at;
* length filter: the block has a distinct words or more;
* positional filter: when the first token in common is the template's i-th and the block's j-th, as
  many tokens can be common as come from there on in either, and that must reach a.

What is left is verified on the words themselves: an exact phrase must stand consecutively,
a text template must reach the containment. No block leaves the task that made it; only
frequencies of template tokens (as many as the templates have) go to the driver.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phraseweave.llm.common import WORD_BYTES, ratio, slices

#: Phrases whose words must stand consecutively, and their labels. Fixed values.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Texts that name a license; a block that holds enough of a text's words gets its label.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the creative commons attribution noncommercial license": "cc-by-nc",
    "this work is licensed under the gnu general public license version": "gpl",
    "under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "this work is licensed under the creative commons attribution sharealike license": "cc-by-sa",
}


@dataclass
class Template:
    words: tuple[bytes, ...]
    label: str
    exact: bool
    #: places of its tokens in the global order, ascending, and the place of each in that list
    tokens: list[int] = field(default_factory=list)
    nth: dict[int, int] = field(default_factory=dict)
    need: int = 0


class TemplateIndex:
    """Templates by the tokens of their prefixes, in the global frequency order."""

    def __init__(self, templates: list[Template], frequency: dict[bytes, int], threshold: float):
        top, below = ratio(threshold)
        every = sorted({w for t in templates for w in t.words}, key=lambda w: (frequency.get(w, 0), w))
        self.order = {w: i for i, w in enumerate(every)}
        self.prefix: dict[int, list[Template]] = {}
        #: windows looked at, and those that each filter let pass
        self.looked = self.long_enough = self.well_placed = 0
        for t in templates:
            t.tokens = sorted({self.order[w] for w in t.words})
            t.nth = {token: i for i, token in enumerate(t.tokens)}
            t.need = len(t.tokens) if t.exact else math.ceil(len(t.tokens) * top / below)
            for token in t.tokens[: len(t.tokens) - t.need + 1]:
                self.prefix.setdefault(token, []).append(t)

    def common(self, t: Template, block: list[bytes]) -> int:
        """Tokens that a block shares with a template, 0 if a filter tells that they aren't enough."""
        distinct = set(block)
        self.looked += 1
        if len(distinct) < t.need:
            return 0
        self.long_enough += 1
        # words that no template has come first in the order: they leave the block's last places to the others
        tokens = sorted(self.order[w] for w in distinct if w in self.order)
        j, i = next((j, t.nth[token]) for j, token in enumerate(tokens) if token in t.nth)
        if min(len(t.tokens) - i, len(tokens) - j) < t.need:
            return 0
        self.well_placed += 1
        return sum(token in t.nth for token in tokens[j:])

    def windows(self, t: Template, hits: list[int], words: int) -> Iterator[int]:
        """Starts of the windows that hold a token of the template's prefix."""
        n, done = len(t.words), -1
        for hit in hits:
            first, last = max(done + 1, hit - n + 1), min(hit, max(0, words - n))
            yield from range(first, last + 1)
            done = max(done, last)

    def scan(self, words: list[bytes]) -> tuple[set[int], dict[str, tuple[float, int, int]]]:
        """Starts of all phrases, and for each label the best containment found, with the first window that has it (start, words)."""
        starts: set[int] = set()
        labels: dict[str, tuple[float, int, int]] = {}
        hits: dict[int, tuple[Template, list[int]]] = {}
        for place, word in enumerate(words):
            for t in self.prefix.get(self.order.get(word, -1), ()):
                hits.setdefault(id(t), (t, []))[1].append(place)
        for t, places in hits.values():
            n = len(t.words)
            for start in self.windows(t, places, len(words)):
                block = words[start : start + n]
                share = self.common(t, block) / len(t.tokens)
                if share * len(t.tokens) < t.need - 1e-9:
                    continue
                if t.exact:
                    if tuple(block) != t.words:
                        continue
                    starts.add(start << 8 | PHRASE_NUMBER[t.label])
                best = labels.get(t.label)
                if best is None or (share, -start) > (best[0], -best[1]):
                    labels[t.label] = (share, start, len(block))
        return starts, labels


#: Numbers of the phrases' labels within a start.
PHRASE_NUMBER = {label: i for i, label in enumerate(PHRASES.values())}


def templates_of(phrases: dict[str, str], texts: dict[str, str]) -> list[Template]:
    return [Template(tuple(p.encode().split()), label, exact) for group, exact in ((phrases, True), (texts, False)) for p, label in group.items()]


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORD_BYTES).split()


def _frequencies(tokens: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                seen.update(tokens.intersection(_words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    return run


#: Where a label's best window is.
SPAN = pa.struct([("label", pa.string()), ("share", pa.float64()), ("start", pa.int64()), ("words", pa.int64())])


def _scan(templates: list[Template], frequency: dict[bytes, int], threshold: float):
    names = list(PHRASE_NUMBER)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(SPAN))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, frequency, threshold)
        for part in slices(batches):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                words = _words(text)
                starts, labels = index.scan(words)
                places = [s >> 8 for s in starts]
                base = sorted({names[s & 255] for s in starts})
                out.append((doc_id, len(words), len(places), min(places, default=None), max(places, default=None), ",".join(base), ",".join(sorted(labels)), max((share for share, *_ in labels.values()), default=0.0), [dict(zip(SPAN.names, (label, *labels[label]), strict=True)) for label in sorted(labels)]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None, threshold: float = 0.8) -> DataFrame:
    """Licenses that the whole texts of ``docs`` name, found by joining word blocks with templates.

    Takes doc_id and text. Returns a row for each row: doc_id, n_words, n_base (all places of
    PHRASES), first_word and last_word (smallest and largest start of one, in words from 0; else
    null), base_labels (of phrases), labels (of phrases and of templates ``texts`` whose words a
    window holds to the share ``threshold`` or more), score (the best share; 1 for a phrase, 0
    for nothing), spans (for each label the first window with its best share: label, share, start
    and number of words). Labels are distinct, sorted and joined by commas.

    Words are A-Z lower-cased runs of ASCII letters, digits and characters outside ASCII. Null
    and empty texts have no words, no labels and score 0. Repeated rows are scanned each, null
    ids stay null, an empty table gives no rows.
    """
    templates = templates_of(PHRASES, TEMPLATES if texts is None else texts)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = frozenset(w for t in templates for w in t.words)
    counted = rows.select("text").mapInArrow(_frequencies(tokens), "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))
    frequency = {bytes(r["token"]): r["n"] for r in counted.collect()}  # as many rows as the templates have tokens
    return rows.mapInArrow(_scan(templates, frequency, threshold), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, share: double, start: long, words: long>>")


def _sql_list(words: tuple[str, ...] | list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def scan_sql(texts: dict[str, str] | None = None, threshold: float = 0.8) -> str:
    """DuckDB SQL for the rows of ``scan_licenses`` without spans: every window of every text is compared."""
    top, below = ratio(threshold)
    places, shares = [], []
    for phrase, label in PHRASES.items():
        n = len(phrase.split())
        places.append(f"[{{'label': '{label}', 'at': i}} FOR i IN range(len(w) - {n - 1}) IF w[i + 1:i + {n}] = {_sql_list(phrase.split())}]")
    for text, label in (TEMPLATES if texts is None else texts).items():
        n, distinct = len(text.split()), sorted(set(text.split()))
        need, tokens = math.ceil(len(distinct) * top / below), _sql_list(distinct)
        best = f"list_max([len(list_intersect(w[i + 1:i + {n}], {tokens})) FOR i IN range(greatest(1, len(w) - {n - 1}))])"
        shares.append(f"{{'label': '{label}', 'share': CASE WHEN len(list_intersect(w, {tokens})) >= {need} AND {best} >= {need} THEN {best} / {len(distinct)}::DOUBLE ELSE 0.0 END}}")
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
f AS (SELECT doc_id, len(w) AS n_words, flatten([{", ".join(places)}]) AS p, list_filter([{", ".join(shares)}], lambda x: x.share > 0) AS t FROM d)
SELECT doc_id, n_words, len(p) AS n_base, list_min([x.at FOR x IN p]) AS first_word, list_max([x.at FOR x IN p]) AS last_word,
       array_to_string(list_sort(list_distinct([x.label FOR x IN p])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct([x.label FOR x IN p] || [x.label FOR x IN t])), ',') AS labels,
       coalesce(list_max([1.0::DOUBLE FOR x IN p] || [x.share FOR x IN t]), 0.0) AS score
FROM f
"""
