import random
import re

from siftstone.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain(text):
    """Base columns by definition."""
    ws = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    places = sorted((i, label) for phrase, label in licenses.BASE.items() for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split())
    return len(ws), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({label for _, label in places}))


def columns(df):
    return sorted(((r.doc_id is not None, r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in df.collect()), key=str)


def test_base_columns_equal_the_definition(spark, documents, texts):
    assert columns(licenses.scan(documents)) == sorted(((True, i, *plain(t)) for i, t in texts), key=str)


def test_odd_rows(odd, empty):
    got = licenses.scan(odd)
    assert columns(got) == sorted(((i is not None, i, *plain(t)) for i, t in ((r.doc_id, r.text) for r in odd.collect())), key=str)
    assert got.where("text is null").count() == 0 if "text" in got.columns else got.count() == 12
    assert licenses.scan(empty).isEmpty()


def test_labels_of_the_method(docs_of):
    rows = {
        1: "words before. Licensed under the Apache License, Version 2.0. words after", 2: "This work is licensed under the GNU General Public License, version 3.", 3: "general words of the public version 3 work",
        4: "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", 5: "Permission is granted free of charge to any person obtaining a copy of this software and associated documentation files",
        6: "MIT License Apache License version", 7: "under the mit license under the MIT LICENSE cc by-nc", 8: "ÉMIT license, cc by nc", 9: "licensed under the gnu gnu general public public license version 3",
    }
    got = {r.doc_id: r for r in licenses.scan(docs_of(list(rows.items()))).collect()}
    assert got[1].labels == "apache-2" and got[2].labels == "gpl-3" and got[2].base_labels == "" and got[3].labels == "" and got[4].labels == "mit" and got[5].labels == ""
    assert got[6].labels == "" and (got[7].n_base, got[7].first_word, got[7].last_word, got[7].labels) == (3, 0, 8, "cc-by-nc,mit") and got[8].labels == "cc-by-nc" and got[9].labels == ""
    assert all(0 <= r.score <= 1 for r in got.values()) and got[2].score == 1 and got[3].score < 0.5


def test_overlapping_places_all_count():
    ws = licenses.words("cc by nc cc by nc")
    assert licenses.base_places(ws) == [(0, "cc-by-nc"), (3, "cc-by-nc")]


def whole(ws, templates=licenses.TEMPLATES):
    """Labels and score by definition: every alignment of every template that two different words agree on."""
    labels, best = set(), 0.0
    for label, body, keys in templates:
        body = body.encode().split()
        for start in range(-len(body), len(ws)):
            hits = [w for q, w in enumerate(body) if 0 <= start + q < len(ws) and ws[start + q] == w]
            if len(set(hits)) < 2:
                continue
            share, there = len(hits) / len(body), b" %s " % b" ".join(ws[max(0, start) : start + len(body)])
            if share >= licenses.COVERAGE and all(b" %s " % k.encode() in there for k in keys):
                labels.add(label)
                best = max(best, share)
            else:
                best = max(best, share / 2)
    return labels, best


COMMON = {w: 200 for w in b"licensed under the gnu general public license version this work is".split()}


def test_two_licences_and_rare_words_elsewhere():
    index = licenses.Index(licenses.TEMPLATES, 10_000, COMMON)
    both = "Licensed under the BSD 3-Clause License. This work is licensed under the GNU General Public License, version 2."
    hidden = "Please save the source file in binary form and send one copy to the person in charge. This work is licensed under the GNU General Public License, version 3."
    assert index.found(licenses.words(both)) == ({"bsd", "gpl-2"}, 1)
    assert index.found(licenses.words(hidden)) == ({"gpl-3"}, 1)
    notices = " some words between ".join(body for _, body, _ in licenses.TEMPLATES)
    assert index.found(licenses.words(notices)) == ({label for label, _, _ in licenses.TEMPLATES}, 1)


def test_found_equals_the_definition_whatever_is_rare(monkeypatch):
    r = random.Random(5)
    vocab = sorted({w for _, body, _ in licenses.TEMPLATES for w in body.split()})
    for n in range(150):
        parts = []
        for _ in range(r.randint(0, 6)):
            body = r.choice(licenses.TEMPLATES)[1].split()
            for _ in range(r.randint(0, 5)):
                body[r.randrange(len(body))] = r.choice(vocab)
            parts += body[r.choice((0, 0, r.randrange(len(body)))) :] + [r.choice((*vocab, "other")) for _ in range(r.randint(0, 12))]
        ws = licenses.words(" ".join(parts))
        index = licenses.Index(licenses.TEMPLATES, 1000, {w.encode(): r.choice((0, 1, 30, 900)) for w in vocab})
        monkeypatch.setattr(licenses, "BLOCK", r.choice((7, 8192)))
        assert index.found(ws) == whole(ws)
