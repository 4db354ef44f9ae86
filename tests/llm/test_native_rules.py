"""Licence index and decision list against plain Python."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from eventide.llm import license_index as li
from eventide.llm import quality_rules as qr

LICENSED = [
    "intro words here\nLicensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0. and CC by nc again", "this is under the MIT license today",
    "This work is licensed under the GNU General Public License, version 3.", "mit license but not the other words", "apache version license 2", "cc by by nc", "cc  BY--nc",
    "under the mit license " * 50, "All rights reserved", "version 2 apache license version 2 apache license version 2",
]


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def places(words):
    out, labels = [], set()
    for phrase, label in li.BASE:
        p = phrase.split()
        got = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        out += got
        if got:
            labels.add(label)
    return out, labels


@pytest.mark.parametrize("source", ["real", "made"])
def test_license_base_columns(source, real, odd_docs, make_docs):
    docs = real("documents") if source == "real" else odd_docs.unionAll(make_docs(LICENSED, range(100, 100 + len(LICENSED))))
    texts = Counter()
    for r in docs.select("doc_id", "text").collect():
        w = words_of(r["text"])
        at, labels = places(w)
        texts[(r["doc_id"], len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels)))] += 1
    rows = li.scan_licenses(docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in rows) == texts
    for r in rows:
        assert 0 <= r["score"] <= 1
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))


def test_license_own_labels(make_docs):
    rows = {r["doc_id"]: r for r in li.scan_licenses(make_docs(LICENSED)).collect()}
    assert rows[3]["labels"] == "gpl-3" and rows[3]["n_base"] == 0
    assert rows[9]["labels"] == "" or rows[9]["labels"] == "proprietary"
    assert rows[4]["labels"] == rows[5]["labels"] == rows[6]["labels"] == ""
    assert rows[7]["base_labels"] == "cc-by-nc"


def brute_labels(words, idf, min_score=li.MIN_SCORE):
    """Labels and best score by trying every licence text at every place of the document."""
    labels, best = set(), 0.0
    for label, text, key in li.LICENSES:
        t, k = words_of(text), words_of(key)
        at = li.find(t, k)
        for p in range(len(words) - len(k) + 1):
            if words[p : p + len(k)] == k:
                score = sum(idf[w] for o, w in enumerate(t) if 0 <= p - at + o < len(words) and words[p - at + o] == w) / sum(idf[w] for w in t)
                best = max(best, score)
                if score >= min_score:
                    labels.add(label)
    return labels, best


def test_license_own_labels_equal_brute_force(make_docs, real):
    """Whole texts, texts cut short or edited, several in one document, all words scattered."""
    import math
    import random

    rng = random.Random(6)
    texts = [f"some words before\n{text}\nand after" for _, text, _ in li.LICENSES]
    for _, text, _ in li.LICENSES:
        w = text.split()
        texts += [" ".join(w[: max(3, len(w) * 3 // 4)]), " ".join(x for x in w if rng.random() > 0.02), " ".join(rng.sample(w, len(w)))]
    texts += ["\n\n".join(t for _, t, _ in rng.sample(li.LICENSES, 4)) for _ in range(10)] + LICENSED
    docs = make_docs(texts).select("doc_id", "text").unionAll(real("documents").selectExpr("doc_id + 10000", "text"))
    pairs = [(r["doc_id"], words_of(r["text"])) for r in docs.collect()]
    vocabulary = {w for _, t, _ in li.LICENSES for w in words_of(t)}
    count = Counter(w for _, words in pairs for w in set(words) & vocabulary)
    idf = {w: math.log((len(pairs) + 1) / (count[w] + 1)) + 1e-3 for w in vocabulary}
    rows = {r["doc_id"]: r for r in li.scan_licenses(docs).collect()}
    for doc, words in pairs:
        labels, best = brute_labels(words, idf)
        base = places(words)[1]
        got = set(filter(None, rows[doc]["labels"].split(",")))
        assert got == labels | base, (doc, got, labels)
        assert rows[doc]["score"] == pytest.approx(min(1.0, max(best, li.MIN_SCORE if base else 0.0))) or best < li.MIN_SCORE
    assert {"mit", "bsd", "isc", "zlib", "unlicense", "gpl-3", "apache-2"} <= {x for r in rows.values() for x in r["labels"].split(",")}


def test_license_case_of_other_letters_stays(make_docs):
    assert li.scan_licenses(make_docs(["under the M\u0130T license", "under the mit l\u0130cense", "UNDER THE MIT LICENSE"])).selectExpr("sum(n_base)").first()[0] == 1


def test_license_empty_table(make_docs):
    assert li.scan_licenses(make_docs([])).count() == 0


def numbers(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    marked = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked)


def test_quality_numbers(real, odd_docs, make_docs):
    repeats = ["a b c d e f a b c d e", "x " * 30, "a b c d e a b c d e a b c d", "l1 a\nl1 a\nl2\n\n \n \nl1 a", "w " * 9, "a b c d e q a b c d e z z z z z z"]
    for docs in (real("documents"), odd_docs.unionAll(make_docs(repeats, range(200, 200 + len(repeats))))):
        want = Counter((r["doc_id"], *numbers(r["text"])) for r in docs.select("doc_id", "text").collect())
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in qr.measure(docs).collect())
        assert got == want


def test_quality_verdicts(real):
    docs, labels = real("documents"), real("labels")
    rows = qr.apply_quality_rules(docs, labels).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    known = {r["doc_id"]: r["quality"] for r in labels.collect()}
    judged = [(known[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in known and not r["base_failed"]]
    assert sum(k == bool(q) for q, k in judged) / len(judged) > 0.9


def test_quality_without_labels(make_docs, labels, odd_docs):
    got = qr.apply_quality_rules(odd_docs, labels([])).collect()
    assert len(got) == odd_docs.count() and all(r["kept"] == (not r["base_failed"]) for r in got)
    assert qr.apply_quality_rules(make_docs([]), labels([(1, 0, 0)])).count() == 0
