"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from prismalake.llm import spelling

KIND = "doc_id long, text string, word string, n int, form string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "w", 1, "f") for i, t in rows], KIND).repartition(3)


def vocabulary(rows):
    n = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def edits(w, letters):
    for k in range(len(w) + 1):
        for c in letters:
            yield w[:k] + c + w[k:]
            if k < len(w):
                yield w[:k] + c + w[k + 1 :]
        if k < len(w):
            yield w[:k] + w[k + 1 :]


def brute(rows):
    n = vocabulary(rows)
    letters, out = sorted(set("".join(n))), {}
    for w in n:
        near = {x for x in edits(w, letters) if x in n and x != w}
        best = min(near, key=lambda x: (-n[x], x)) if near else None
        out[w] = (best if best and n[best] >= 2 * n[w] else None, n[w], len(near))
    rows = []
    for w, (form, own, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, own, near, n[form] if form else None))
    return sorted(rows)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def sample(seed, docs=60, size=400):
    """Few letters, so that many words are near each other; some letters beyond ASCII, capitals and joined runs."""
    r = random.Random(seed)
    stems = ["".join(r.choice("abé") for _ in range(r.randint(4, 8))) for _ in range(120)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀÿÖ÷×ab", "straßenbahn"]
    weights = [1 / (k + 1) for k in range(len(stems))]
    word = lambda: r.choice([str.upper, str, str, str.title])(r.choices(stems, weights)[0]) + r.choice(["", "", ".", "3", "ā", "'s"])
    return [(i, r.choice([" ", "\n", "-"]).join(word() for _ in range(size))) for i in range(docs)]


@pytest.mark.parametrize("shard", [7, 1 << 14])
def test_forms_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(spelling, "SHARD", shard)
    rows = sample(shard) + [(None, None), (7, ""), (8, "x"), (3, "aaaaa " * 50), (3, "aaaaa " * 50), (None, "straßenbahm straßenbahm straßenbahm"), (9, "ab" * 60_000 + " " + "Wort" * 30)]
    want = brute(rows)
    assert len(want) > 60 and sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert got(spelling.spelling_forms(table(spark, rows))) == want


def test_odd_tables(spark):
    assert got(spelling.spelling_forms(table(spark, []))) == []
    assert got(spelling.spelling_forms(table(spark, [(1, None), (2, "short short short")]))) == brute([(1, None), (2, "short short short")])
    rows = [(i, f"letter letter letters lettar {'x' * 3000} {'x' * 3001} {'xy' * 500}") for i in range(6)] + [(9, "lettes lettes lettes")]
    assert got(spelling.spelling_forms(table(spark, rows))) == brute(rows)


def test_checksums_of_joined_texts():
    r, sums = random.Random(5), spelling.Checksums()
    words = [r.randbytes(r.randint(1, 90)) for _ in range(400)]
    heads = [b"%d:" % r.randint(-9, 10**12) for _ in words]
    row, of = np.arange(len(words)), np.random.default_rng(5).permutation(len(words))
    out = sums.joined(heads, row, words, of)
    assert out.tolist() == [zlib.crc32(h + words[k]) for h, k in zip(heads, of)]


def test_automaton_numbers_and_is_minimal():
    r = random.Random(6)
    words = sorted({"".join(r.choice("abc") for _ in range(6)) for _ in range(300)})
    m = np.array([list(w.encode()) for w in words], np.uint8)
    a = spelling.Automaton(m)
    state, number = np.zeros(len(m), np.int64), np.zeros(len(m), np.int64)
    for k in range(6):
        state, number = a.follow(state, number, m[:, k])
    assert number.tolist() == list(range(len(m))) and set(state.tolist()) == {len(a.go) - 1}
    ends = {w[:k]: frozenset(x[k:] for x in words if x[:k] == w[:k]) for w in words for k in range(7)}
    assert len(a.go) == len(set(ends.values()))


def test_query_on_the_test_table_equals_brute_force(spark):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(spelling.op13_spelling_variants(spark, sf)) == brute(rows)
