"""Licence scan with a positional index of rare words.

The templates' words are indexed by (template, position). One pass over the corpus counts in how many documents each
indexed word occurs. For a document, each template's words in it are looked up, highest IDF first; every occurrence votes for
(template, position in the document - position in the template). An alignment that two words agree on is
verified: the template's mandatory key phrases must stand there, and most of its words in place. A template's lookup ends only
when the words that are left can make no alignment that would change the result; so IDF decides on the work, not on what is found.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftstone.llm.common import ship, texts

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Label, template, mandatory key phrases. Words of public licence notices, lower case, without punctuation.
TEMPLATES = [
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit", "licensed under the mit license", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted", "free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", ["except in compliance with the license"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "licensed under the bsd 3 clause license", ["bsd 3 clause license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", ["attribution noncommercial"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license", ["attribution sharealike"]),
    ("cc-by", "licensed under cc by 4 0", ["cc by 4"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["commons attribution 4"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related rights to this work", ["waived all copyright"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
]
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
#: Alignments are tried by where they start, so many words at a time; memory for votes follows this, not the document.
BLOCK = 8192
#: Share of a template's words that must stand in place.
COVERAGE = 0.75

#: A-Z to a-z, and every byte that is in no word to a space. Bytes from 0x80 on are parts of letters beyond ASCII, which are word characters.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


class Index:
    """Places of each template's words, ranked by how few documents hold a word."""

    def __init__(self, templates: list[tuple[str, str, list[str]]], n_docs: int, df: dict[bytes, int]):
        self.templates = [(label, body.encode().split(), [k.encode().split() for k in keys]) for label, body, keys in templates]
        self.vocab = frozenset(w for _, body, _ in self.templates for w in body)
        self.idf = {w: math.log((1 + n_docs) / (1 + df.get(w, 0))) for w in self.vocab}
        self.longest = max((len(body) for _, body, _ in self.templates), default=0)
        #: For each template its words, rarest first, with all their places in it.
        self.postings = [[(w, [q for q, x in enumerate(body) if x == w]) for w in sorted(set(body), key=lambda w: (-self.idf[w], w))] for _, body, _ in self.templates]

    def found(self, ws: list[bytes]) -> tuple[set[str], float]:
        """Verified labels, and the best coverage of an alignment of two words or more: in full if verified, half of it otherwise."""
        labels, best = set(), 0.0
        if len(self.vocab.intersection(ws)) < 2:
            return labels, best
        for start in range(1 - self.longest, len(ws), BLOCK):
            best = self._block(ws, start, start + BLOCK, labels, best)
        return labels, best

    def _block(self, ws: list[bytes], begin: int, end: int, labels: set[str], best: float) -> float:
        """Try the alignments that start in [begin, end); adds to labels and returns the best coverage so far."""
        vocab, places = self.vocab, defaultdict(list)
        first = max(0, begin)
        for p, w in enumerate(ws[first : end + self.longest], first):
            if w in vocab:
                places[w].append(p)
        for (label, body, keys), postings in zip(self.templates, self.postings, strict=True):
            here = [(w, qs) for w, qs in postings if w in places]
            left, most, size = sum(len(qs) for _, qs in here), 0, len(body)
            votes: dict[int, bytes | None] = {}  # start: the one word that agrees on it, None if it has been tried
            for w, qs in here:
                # An alignment that isn't tried yet has in place what is left, and of the words before at most one.
                reach = (left + most) / size
                if reach < COVERAGE and reach / 2 <= best:
                    break
                for q in qs:
                    for p in places[w]:
                        start = p - q
                        if not begin <= start < end or (before := votes.setdefault(start, w)) is None or before == w:
                            continue
                        votes[start] = None
                        at = max(0, -start)
                        in_place = sum(map(eq, body[at:], ws[start + at : start + size])) / size
                        if in_place >= COVERAGE and self._keys(ws, max(0, start), start + size, keys):
                            labels.add(label)
                            best = max(best, in_place)
                        else:
                            best = max(best, in_place / 2)
                left, most = left - len(qs), max(most, len(qs))
        return best

    @staticmethod
    def _keys(ws: list[bytes], start: int, end: int, keys: list[list[bytes]]) -> bool:
        here = ws[start:end]
        return all(any(here[i : i + len(k)] == k for i in range(len(here) - len(k) + 1)) for k in keys)


def base_places(ws: list[bytes]) -> list[tuple[int, str]]:
    """Every (first word, label) at which the words of a base phrase stand consecutively."""
    whole, out = b" " + b" ".join(ws) + b" ", []
    for phrase, label in BASE.items():
        needle, at, counted, n = f" {phrase} ".encode(), -1, 0, 0
        while (at := whole.find(needle, at + 1)) >= 0:
            n += whole.count(b" ", counted, at)
            counted = at
            out.append((n, label))
    return out


def document_frequencies(docs: DataFrame, vocab: frozenset[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and of those that hold each word of vocab; what is collected is bounded by vocab."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, Counter()
        for batch in batches:
            column = batch.column("text")
            n += len(column)
            for i in range(len(column)):
                seen.update(vocab.intersection(words(column[i].as_py())))
        ws = [b"", *seen]
        yield pa.RecordBatch.from_arrays([pa.array(ws, pa.binary()), pa.array([n, *seen.values()], pa.int64())], names=["word", "n"])

    got = {bytes(r["word"]): r["n"] for r in docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return got.pop(b"", 0), got


def scan(docs: DataFrame, templates: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Licences of every whole text; a row for each row of docs.

    docs has doc_id and text; other columns are ignored. A null text is empty: no words, empty labels, score 0. n_base counts all places of base
    phrases, first_word and last_word are their smallest and largest start (null without any). score is 1 with a base place, else
    the best alignment's coverage, halved if it isn't verified. Repeated rows give repeated rows, null doc_ids stay null, an
    empty table gives no rows. Two narrow passes; what is shuffled is bounded by the templates' words.
    """
    ship(docs.sparkSession)
    docs = texts(docs)
    chosen = templates or TEMPLATES
    vocab = frozenset(w for _, body, _ in chosen for w in body.encode().split())
    n_docs, df = document_frequencies(docs, vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(chosen, n_docs, df)
        for batch in batches:
            column, rows = batch.column("text"), []
            for i in range(len(column)):
                ws = words(column[i].as_py())
                places = base_places(ws)
                base = {label for _, label in places}
                labels, best = index.found(ws)
                starts = [p for p, _ in places]
                rows.append((len(ws), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if base else best))
            cols = zip(*rows, strict=True) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, ARROW.types[1:], strict=True))], schema=ARROW)

    return docs.mapInArrow(run, SCHEMA)
