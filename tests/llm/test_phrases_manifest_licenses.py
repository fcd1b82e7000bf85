"""Phrases, manifest and license scan: brute force, planted defects and edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from returnwise.llm import licenses, manifest, phrases

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, rank int, row int, n int"
LONG = " ".join(f"w{i % 997}" for i in range(30_000))
NOTICE = licenses.TEXTS[6][1]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "x", 1, 2, 3) for i, t, lang in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, None, "en"), (2, "", "de"), (3, LONG, None), (4, "one two", "en"), (4, "one two", "en"),
        (4, "one two three", "en"), (None, "a text, without. an id", "en"), (5, "The MIT License\nmit  LICENSE", ""),
        (6, "GNU General-Public License; Apache/license", "de"), (8, "12345 !!", "en"), (9, "päßword Ünï one two", None),
        *((20 + i, "a b a b a b a b. the same line of text in all of them", "x") for i in range(40)),
        *((100 + i, f"number {i} Ring ring ring ring ring ring", "x") for i in range(35)),
    ]
    return documents(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return documents(spark, [])


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    every = [nodes]
    while len(every[-1]) > 1:
        every.append([sha(*every[-1][i : i + 8]) for i in range(0, len(every[-1]), 8)])
    return every


def siblings(every, at):
    for level in every[:-1]:
        run = at - at % 8
        yield level[run:at], level[at + 1 : run + 8]
        at //= 8


def expected_manifest(rows):
    def leaf(r, text):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))

    trees = {}
    for r in rows:
        trees.setdefault((r.lang is not None, (r.lang or "").encode()), []).append((r.doc_id is not None, r.doc_id or 0, leaf(r, r.text), r))
    trees = {k: sorted(v, key=lambda x: x[:3]) for k, v in sorted(trees.items())}
    built = {k: levels([x[2] for x in v]) for k, v in trees.items()}
    top = levels([b[-1][0] for b in built.values()])
    for number, (key, members) in enumerate(trees.items()):
        for at, (_, _, own, r) in enumerate(members):
            way = [*siblings(built[key], at), *siblings(top, number)]
            changed = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            folded = leaf(r, r.text if r.text is None else r.text.encode().lower().decode()) if changed else own
            for before, after in way:
                folded = sha(*before, folded, *after)
            yield (r.doc_id, own, built[key][-1][0], top[-1][0], sha(*(x for b, a in way for x in (*b, *a))), folded, folded == top[-1][0])


def test_manifest_equals_brute_force(spark, odd, empty):
    got = Counter(tuple(r) for r in manifest.query(odd).collect())
    assert got == Counter(expected_manifest(odd.collect()))
    assert manifest.query(empty).collect() == []
    alone = documents(spark, [(7, "a Text", None)])
    (row,) = manifest.query(alone).collect()
    assert row.leaf == row.subroot == row.root and row.proof_sha256 == sha()


@pytest.mark.parametrize("count", [8, 9, 64, 65, 513])
def test_manifest_at_the_edges_of_levels(spark, count):
    docs = documents(spark, [(i, f"T{i}", "l%d" % (i % 9 if i < 9 else 0)) for i in range(count)])
    assert Counter(tuple(r) for r in manifest.query(docs).collect()) == Counter(expected_manifest(docs.collect()))


def test_store_is_content_addressed(spark):
    leaves = spark.createDataFrame([("t", i, 100, f"d{i % 8}") for i in range(100)], "tree string, rank long, remaining long, digest string")
    records = {r.digest: r.children for r in manifest.build(leaves).store().collect()}
    assert all(k == sha(*v) for k, v in records.items())
    assert len(records) == 2 + 2 + 1  # twelve equal runs and a rest, two runs of them, the root


def expected_phrases(rows, least=30):
    f, n = {}, Counter()
    for r in rows:
        lang = r.lang if r.lang is not None else "und"
        for piece in re.split(r"[.,;:!?\n-\r]", (r.text or "").encode().lower().decode()):
            words = re.findall(r"[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f.setdefault(lang, Counter())[tuple(words[i : i + size])] += 1
    result = set()
    for lang, each in f.items():
        frequent = {p: a for p, a in each.items() if len(p) > 1 and a >= least}
        scored = []
        for p, a in frequent.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in frequent.items()):
                continue
            score, k = min((2000000 * a // (each[p[:k]] + each[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), each[p[:k]], each[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[: phrases.FIRST], 1):
            result.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return result


def test_phrases_equal_brute_force(spark, odd, empty, monkeypatch):
    want = expected_phrases(odd.collect())
    assert {tuple(r) for r in phrases.query(odd).collect()} == want and len(want) > 5
    assert phrases.query(empty).collect() == []
    rng = np.random.default_rng(4)
    rows = [
        (i, " ".join(f"{'Wv'[i % 2]}{min(int(x), 30)}" + ("." if x > 60 else "") for x in rng.exponential(12, rng.integers(0, 400))), "ab"[i % 2])
        for i in range(120)
    ]
    docs = documents(spark, rows)
    want = expected_phrases(docs.collect())
    assert {tuple(r) for r in phrases.query(docs).collect()} == want and len(want) > 100
    # A table of pairs in which nearly every bit is shared changes nothing, nor do small buffers.
    for name, value in (("TABLE_BITS", 128), ("COUNTED", 50), ("REMEMBERED", 5), ("PATH_ROW", 2)):
        monkeypatch.setattr(phrases, name, value)
    assert {tuple(r) for r in phrases.query(docs).collect()} == want


def test_paths_follow_chains_forks_and_rings(spark):
    def edges(text):
        words = text.split()
        return [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]

    chain, ring = edges(" ".join(f"c{i}" for i in range(70))), edges("x y z x y z x y z")[:3]
    fork = edges("s1 s2 s3 s4 s5") + edges("s2 s3 s4 s6 s7")
    loop = ["o o o o"]
    rows = [("en", g, 30 + i) for i, g in enumerate([*chain, *ring, *fork, *loop])]
    got = phrases.paths(spark.createDataFrame(rows, "lang string, gram string, n long")).collect()
    runs = sorted((list(r.grams) for r in got), key=len)
    assert chain in runs and loop in runs
    assert any(sorted(r) == sorted(ring) for r in runs)
    assert edges("s1 s2 s3 s4 s5")[:1] in runs and fork[1:2] in runs and fork[2:] in runs
    assert sum(map(len, runs)) == len(rows)
    weights = {g: n for _, g, n in rows}
    assert all(list(r.weights) == [weights[g] for g in r.grams] for r in got)


def expected_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower().decode())
    places = [
        (i, label) for label, phrase in licenses.PHRASES for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_base_phrases_equal_brute_force(odd, empty):
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.query(odd).collect())
    assert got == Counter((r.doc_id, *expected_base(r.text)) for r in odd.collect())
    assert licenses.query(empty).collect() == []


def test_edited_notices_are_found_and_others_are_not(spark):
    words = NOTICE.split()
    cut, added = words[:9] + words[11:], words[:12] + ["quite", "new", "words"] + words[12:]
    swapped = [w if i != 10 else "other" for i, w in enumerate(words)]
    rng = np.random.default_rng(1)
    shuffled = list(rng.permutation(words))
    filler = [f"f{i}" for i in range(500)]
    rows = [
        (1, " ".join(filler + words + filler), "en"), (2, " ".join(filler + cut), "en"), (3, " ".join(added), "en"),
        (4, ", ".join(swapped).upper(), "en"), (5, " ".join(shuffled), "en"), (6, " ".join(words[:12]), "en"),
        (7, " ".join(words + filler + words), "en"), (8, "license " * 5000, "en"), (9, "Licensed under CC BY-NC 4.0.", "en"),
    ]
    got = {r.doc_id: r for r in licenses.query(documents(spark, rows)).collect()}
    assert [got[i].labels for i in (1, 2, 3, 4, 7)] == ["mit"] * 5
    assert [got[i].labels for i in (5, 6, 8)] == [""] * 3 and got[9].labels == "cc-by-nc"
    assert got[1].score == len(words) / (len(words) + 1) == got[3].score > got[4].score > 0 == got[5].score
    assert all(r.n_base == 0 for r in got.values())
    where = {(r.doc_id, r.first, r.last) for r in licenses.spans(licenses.votes(documents(spark, rows))).collect()}
    assert (1, 500, 500 + len(words) - 1) in where and sum(d == 7 for d, *_ in where) == 2
