"""Cross-tokenizer alignment against the plain libraries."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from prismalake.llm import alignment
from prismalake.llm.tokens import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
KIND = "doc_id long, text string, links string, n_a int, keys string, b int"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()

    def tokens(text):
        """Pairs (id, bytes) of both, or nothing."""
        if not text:
            return [], []
        one = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])

    return tokens


def brute(plain, rows):
    seen, docs = collections.Counter(), []
    for i, text in rows:
        one, two = plain(text)
        ends = [dict(), dict()]
        for side, own in enumerate((one, two)):
            at = 0
            for k, (_, raw) in enumerate(own):
                at += len(raw)
                ends[side][at] = k
        cuts = sorted(set(ends[0]) & set(ends[1]))
        links, groups, last = [], [], (0, 0)
        for c in cuts:
            x, y = ends[0][c], ends[1][c]
            links.append((one[x][0], two[y][0]))
            groups.append(",".join(str(t) for t, _ in one[last[0] : x + 1]) + "|" + ",".join(str(t) for t, _ in two[last[1] : y + 1]))
            last = (x + 1, y + 1)
        seen.update(links)
        docs.append((i, len(one), len(two), links, groups))
    top = collections.Counter()
    for (_, y), n in seen.items():
        top[y] = max(top[y], n)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    return sorted(((i, na, nb, len(groups), len(links), sum(seen[p] == top[p[1]] for p in links), sum(seen[p] for p in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "") for i, na, nb, links, groups in docs), key=key)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, "l", 1, "k", 2) for i, t in rows], KIND).repartition(parts)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  ", "  a  b \n c ", "\n", "a\nb", "a \n b", "<|endoftext|>", "x <|endoftext|> y</s><s><unk><0x41>", "a▁b", "▁", "don't I'll they're", "é è  ü", "a b  c", "　x  y", "你好 世界 a", "😀 😀😀 x", "a\0b \0", "tab\tx\t y", "\r\n a \r", "ﬁ Ａ", "é á", "12345 6789 1,234.5", "x" * 5000, "-" * 700 + " =" * 300, "﻿ a", "Ā āē ß straße", "\x1c a\x1d b"]


def test_odd_texts_equal_plain_libraries(spark, plain):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "same id"), (3, "same id"), (None, "no id"), (None, None)]
    want = brute(plain, rows)
    assert sum(r[1] > 0 for r in want) > 25
    assert got(alignment.cross_alignment(table(spark, rows), A, B)) == want
    assert got(alignment.cross_alignment(table(spark, []), A, B)) == []
    assert got(alignment.cross_alignment(table(spark, [(1, None), (2, "")]), A, B)) == brute(plain, [(1, None), (2, "")])


def test_shards_brought_by_spark(spark, plain, monkeypatch):
    rows = [(k, f"{t} and the other of {t}") for k, t in enumerate(ODD) if t]
    monkeypatch.setattr(alignment, "PARTIAL", 20)
    assert got(alignment.cross_alignment(table(spark, rows), A, B, ship=True)) == brute(plain, rows)


def test_fuzz_of_units(plain):
    """Many units in one call, small caches, and rows side by side equal the whole text by the plain libraries."""
    r, both = random.Random(8), alignment.Aligner(A, B)
    atoms = ["the", "The", "ing", "é", "ß", "ā", "世", "😀", " ", "  ", "   ", "\n", "\n\n", "\t", "\r", ".", ",", "'s", "'", "\"", "(", ")", "1", "23", "<s>", "<|endoftext|>", " ", " ", "▁", "-", "http://x.y/z", "x" * 30, "İ", "\u0085"]
    old, alignment.KEPT = alignment.KEPT, 50
    try:
        for _ in range(150):
            texts = ["".join(r.choice(atoms) for _ in range(r.randint(0, 25))) for _ in range(12)]
            a, na, b, nb = both.encode(pa.array([*texts, None]))
            i = j = 0
            for t, x, y in zip(texts, na, nb):
                one, two = plain(t)
                assert [k for k, _ in one] == a[i : i + x].tolist(), t
                assert [k for k, _ in two] == b[j : j + y].tolist(), t
                i, j = i + x, j + y
            assert na[-1] == nb[-1] == 0 and i == len(a) and j == len(b)
    finally:
        alignment.KEPT = old


def test_sums_of_runs():
    keys, counts = alignment.added(np.array([5, 3, 5, 1 << 40, 3, 5]), np.array([1, 2, 3, 4, 5, 6]))
    assert keys.tolist() == [3, 5, 1 << 40] and counts.tolist() == [7, 10, 4]
    assert [len(x) for x in alignment.added(np.zeros(0, np.int64), np.zeros(0, np.int64))] == [0, 0]


def test_query_on_the_test_table_equals_plain_libraries(spark, plain):
    import os

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables")
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got(alignment.op12_cross_tokenizer_alignment(spark, sf)) == brute(plain, rows)
