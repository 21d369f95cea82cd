"""Operators for training data against brute force, round trips and planted cases."""

import collections
import hashlib
import json
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prismalake.llm import chat, embeddings, langid, media, minhash, packing, pieces_sa, ppm, rans, suffix, tokens
from prismalake.llm.common import written
from prismalake.llm.tokens import tokenizer_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(r, n):
    return " ".join("".join(r.choice("abcdeéilnorst") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(7)
    base = [words(r, r.choice([1, 3, 40, 150, 400])) for _ in range(30)]
    shared = words(r, 90)
    out = base + [b + " tail" for b in base[:8]] + [base[3], base[3]] + [f"{words(r, 20)}\n{shared} {words(r, 20)}" for _ in range(6)]
    return [*out, "", None, " \n ", "x" * 3000, "The, end.\nOf It"]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", "fr", None][i % 3], "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def removed(texts, length=400):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for n, b in enumerate(data):
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((n, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [1, 20_000])
def test_repeats_equal_brute_force(spark, docs, texts, hot):
    got = suffix.remove_repeats(docs, hot=hot).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()
    assert sorted(map(tuple, got)) == removed(texts)
    assert suffix.remove_repeats(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [1, 20_000])
def test_stage_removes_passages_of_51_short_words(spark, hot):
    r = random.Random(11)
    short = [" ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 4))) for _ in range(n)) for n in (51, 51, 50, 70)]
    rare = ["日本語" * 50]  # one word of 450 bytes
    texts = [f"{words(r, 30)}{gap}{p} {mark}{words(r, 30)}" for p in short + rare for gap, mark in ((" ", "A"), ("\n", "B"), (" \t", "C"))]
    texts += [f"{short[3][:90]} {words(r, 5)} {short[3][-90:]}", short[0], words(r, 200), "", None, "a " * 200]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    split = [(t or "").split() for t in texts]
    seen = collections.Counter(tuple(s[i : i + 51]) for s in split for i in range(len(s) - 50))
    want = {}
    for n, s in enumerate(split):
        gone = [False] * len(s)
        for i in range(len(s) - 50):
            if seen[tuple(s[i : i + 51])] > 1:
                gone[i : i + 51] = [True] * 51
        want[n] = [w for w, g in zip(s, gone) if not g and w not in rare]
    got = {x.doc_id: x.kept.decode().split() for x in suffix.remove_repeats(df, hot=hot, whole_characters=True, words=51).collect()}
    assert got == want
    stage = {x.doc_id: x.text for x in suffix.drop_repeats(spark, df).collect()}
    assert 16 not in stage and all(stage[n].split() == w for n, w in want.items() if n in stage and stage[n])
    assert all(p not in t for t in stage.values() if t for p in (short[0], short[1], short[3], *rare)) and short[2] in stage[6]


def test_deep_shallow_sort():
    r = np.random.default_rng(3)
    rows = r.integers(0, 2, (200, 64)).astype(np.uint8)
    rows[:120, :50] = 1
    rows[5] = rows[6]
    group = np.sort(r.integers(0, 3, 200))
    order, common = suffix.deep_shallow(rows, np.full(200, 64), group)
    want = sorted(range(200), key=lambda i: (group[i], rows[i].tobytes()))
    assert [(group[i], rows[i].tobytes()) for i in order] == [(group[i], rows[i].tobytes()) for i in want]
    for k in range(1, 200):
        a, b = rows[order[k]], rows[order[k - 1]]
        assert common[k] == (-1 if group[order[k]] != group[order[k - 1]] else 64 if (a == b).all() else int(np.argmax(a != b)))


def test_rans_files_round_trip(spark, docs, texts, tmp_path):
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    rans.write_tokens(docs, str(tmp_path / "f"), tokenizer_path("word_bpe_49k.json"), end=1, block_tokens=500)
    got = {r.doc_id: r for r in rans.read_tokens(spark, str(tmp_path / "f")).collect()}
    start = 0
    for i, t in enumerate(texts):
        ids = coder.encode(t or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, bytes(got[i].ids)) == (start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_rans_checkpoints_and_damage():
    ids = np.random.default_rng(1).geometric(0.01, 50_000).astype(np.uint32)
    table = rans.Table(rans.frequencies(np.bincount(ids)))
    data = rans.pack_block(table, ids, [1], np.array([len(ids)]), lanes=16, every=32)
    block = rans.Block(data, table)
    assert (block.ids() == ids).all() and (block.ids(20_000, 20_100) == ids[20_000:20_100]).all()
    with pytest.raises(ValueError):
        rans.Block(data[:-1] + bytes([data[-1] ^ 1]), table)


def test_sentencepiece_equals_library(spark, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(8)
    some = ["a", "The", "é", "日本", "ﬁ", "２", "🎉", " ", "  ", "\n", "\t", ",", ".", "...", "▁", "\x00", "ing", "x" * 70, "ab" * 40, "Ω"]
    more = [*texts, "  a  b ", "é ﬁ ２ 日本語🎉", " " * 70 + "x", "ab" * 300, "a\x00b", "a\n\nb\n c \nd\n", *("".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(600))]
    own = pieces_sa.PieceCoder(path, held=200)
    for dense in (pieces_sa.DENSE, 0):
        pieces_sa.DENSE, keep = dense, pieces_sa.DENSE
        own.known = {}
        ids, n = own.encode(more)
        pieces_sa.DENSE = keep
        back = own.decode(ids, n)
        for t, got, text in zip(more, np.split(ids, np.cumsum(n)[:-1]), back):
            assert got.tolist() == model.encode(t or "") and text == model.decode(model.encode(t or "")), repr(t)
    rows = [(i, t, 1, 2) for i, t in enumerate(more)] + [(None, "a", 1, 2)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, coded int")
    coded = pieces_sa.encode(df, path)
    got = {x.doc_id: (np.frombuffer(bytes(x.ids), "<u4").tolist(), x.text) for x in pieces_sa.decode(coded, path).collect()}
    assert all(got[i] == (model.encode(t or ""), model.decode(model.encode(t or ""))) for i, t in enumerate(more)) and None in got
    assert pieces_sa.encode(df.limit(0), path, back=True).count() == 0


def test_sentencepiece_query_equals_library(spark, docs, texts, tmp_path):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.n_pieces, x.ids_crc32, x.text_crc32) for x in pieces_sa.op4_sentencepiece(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        ids = model.encode(t or "")
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), zlib.crc32(model.decode(ids).encode()))


def test_unigram_paths_have_the_best_sum():
    coder = pieces_sa.PieceCoder(tokenizer_path("piece_bpe_32k.model"), method="unigram")
    units = ["▁the", "▁tokens", "▁aab", "▁日本語", "▁internationalisation"]
    for u, ids in zip(units, coder.encode_units(units)):
        best = [0.0] + [-np.inf] * len(u)
        for e in range(1, len(u) + 1):
            for b in range(e):
                i = coder.id_of.get(u[b:e])
                step = coder.score[i] if i is not None else coder.least if e - b == 1 else -np.inf
                best[e] = max(best[e], best[b] + step)
        got, covered = 0.0, "".join(coder.names[i] for i in ids if i not in coder.byte_of)
        got = sum(coder.score[i] for i in ids if i not in coder.byte_of) + coder.least * sum(1 for c in u if c not in coder.id_of)
        assert np.isclose(got, best[-1]) and covered == "".join(c for c in u if c in coder.id_of or c in covered)


@pytest.mark.parametrize("name, style", [("word_bpe_49k.json", "words"), ("byte_bpe_50k.json", "leading")])
def test_word_coder_equals_library(name, style):
    from tokenizers import Tokenizer

    r = random.Random(5)
    some = ["a", "B", "the", "İ", "é", "ß", "日本", "ﬁ", "Σ", "σ", "1", "23", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\u3000", ",", ".", "...", "!", "|", "'s", "’", "<|endoftext|>", "<|startoftext|>", "e\u0301", "\u0307", "🎉", "-", "\r\n", "K", "ÿ", "Ǆ", "\x00", " | ", "Ω.", "İ.", "a.", "x,"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 12))) for _ in range(4000)] + [None, "", " ", "\n", "a\nb", "a. b, c.\nD", "x " * 3000, "y" * 5000]
    library, own = Tokenizer.from_file(tokenizer_path(name)), tokens.WordCoder(tokenizer_path(name), style, held=500)
    for k in range(0, len(texts), 500):
        ids, n = own.encode(pa.array(texts[k : k + 500], pa.string()))
        for t, got in zip(texts[k : k + 500], np.split(ids, np.cumsum(n)[:-1])):
            assert got.tolist() == library.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_packing_columns_equal_brute_force(spark, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    rows = [*enumerate([*texts, "a <|endoftext|> b"]), (None, "null id"), (3, texts[3]), (3, texts[3])]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, piece int")
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 64 or 64
        cuts = [0, *range(first, len(ids) + 1, 64)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = packing.pack_documents(df, tokenizer_path("byte_bpe_50k.json"), end=0, capacity=64, with_ids=True)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == sorted(want)
    assert packing.sequences(got).agg({"n_tokens": "sum"}).first()[0] == sum(w[3] for w in want)


def test_rans_of_odd_tables(spark, tmp_path):
    path = tokenizer_path("word_bpe_49k.json")
    rows = [(None, "no id", 1), (2, "<|endoftext|> a", 1), (2, "<|endoftext|> a", 1), (1, None, 1), (1, "b", 1)]
    rans.write_tokens(spark.createDataFrame(rows, "doc_id long, text string, n int"), str(tmp_path / "a"), path, end=1)
    got = rans.read_tokens(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 2] and 49407 in np.frombuffer(bytes(got[3].ids), "<u4")
    assert [r.start for r in got] == list(np.cumsum([0] + [r.n_tokens for r in got])[:-1])
    rans.write_tokens(empty(spark), str(tmp_path / "b"), path, end=1)
    assert rans.read_tokens(spark, str(tmp_path / "b")).count() == 0


def test_packing_places_everything(spark, docs, texts):
    rows = packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"), end=0, capacity=64).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == list(np.cumsum([0] + [n for _, n in own])[:-1]) and sum(n for _, n in own) <= 64
    total = sum(r.length for r in rows)
    assert len(by) <= -(-total // 64) * 1.02 + 1
    assert {r.doc_id for r in rows} == set(range(len(texts)))
    assert packing.pack_documents(empty(spark), tokenizer_path("byte_bpe_50k.json"), end=0).count() == 0


def ppm_brute_force(training, texts, orders=5):
    """log10 probabilities by a plain dictionary model."""
    def symbols(t):
        run = [x for w in (t or "").encode().lower().split() for x in [*w, 32]]
        return [(s, bytes([*b" " * orders, *run][i : i + orders])) for i, s in enumerate([*run, 256])]

    counts = collections.defaultdict(collections.Counter)
    for t in training:
        for s, ctx in symbols(t):
            for k in range(len(ctx) + 1):
                counts[ctx[len(ctx) - k :]][s] += 1

    def chance(s, ctx):
        p, gone = 1.0, set()
        for k in range(len(ctx), -1, -1):
            own = {x: n for x, n in counts.get(ctx[len(ctx) - k :], {}).items() if x not in gone}
            n, d = sum(own.values()), len(own)
            if not n:
                continue
            if s in own:
                return p * own[s] / (n + d)
            p *= d / (n + d)
            gone |= own.keys()
        return p / (257 - len(gone))

    return [sum(np.log10(chance(s, ctx)) for s, ctx in symbols(t)) for t in texts], chance


def test_ppm_equals_brute_force(spark, docs, texts):
    import math
    import re

    rows = ppm.score(docs.selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out", "1 as n", "2 as block")).collect()
    split = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())] + [None] for i, t in enumerate(texts)}
    c = collections.Counter(w for i, ws in split.items() if i % 5 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    want, chance = ppm_brute_force([t for i, t in enumerate(texts) if i % 5 != 1], texts)
    assert len(rows) == len(texts)
    for r in rows:
        own = split[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert math.isclose(r.score, want[r.doc_id], rel_tol=1e-9), r.doc_id
    for ctx in (b"", b" ", b"a ", b"e th", b"zzzz", b"x"):
        assert math.isclose(sum(chance(s, ctx) for s in range(257)), 1, rel_tol=1e-9)
    turned = docs.selectExpr("doc_id", "array_join(reverse(split(text, ' ')), ' ') as text", "false as held_out").where("doc_id in (5, 6, 7, 8)")
    both = docs.selectExpr("doc_id + 1000 as doc_id", "text", "false as held_out").unionByName(turned.selectExpr("doc_id", "text", "true as held_out"))
    got = {x.doc_id: x.score for x in ppm.score(both).collect()}
    assert any(abs(got[i] - got[i + 1000]) > 0.01 for i in (5, 6, 7, 8))  # the order of words counts
    assert ppm.score(empty(spark).selectExpr("doc_id", "text", "false as held_out")).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (3, "a b"), (3, "a b"), (4, None)], "doc_id long, text string").selectExpr("*", "true as held_out")
    assert [(x.n_known, x.train_tokens) for x in ppm.score(odd).collect()] == [(0, 0)] * 4


def test_ppm_scores_do_not_depend_on_the_size_of_a_share(spark, docs):
    rows = docs.selectExpr("doc_id", "text", "doc_id % 5 = 1 as held_out")
    one, many = ({x.doc_id: x.score for x in ppm.score(rows, max_trie=m).collect()} for m in (1 << 24, 6_000))
    assert one.keys() == many.keys() and all(abs(one[i] - many[i]) < 1e-6 for i in one)


def linked(vectors, labels, least=0.98):
    n = len(vectors)
    good = [v is not None and None not in v and np.isfinite(v).all() and any(v) and labels[i] is not None for i, v in enumerate(vectors)]
    root, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and labels[i] == labels[j] and len(vectors[i]) == len(vectors[j]):
                a, b = np.array(vectors[i], float), np.array(vectors[j], float)
                if a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least:
                    links[i] += 1
                    links[j] += 1
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
    return [(i, links[i], root[i], root[i] == i) for i in range(n)]


def test_embeddings_equal_brute_force(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(30, 16)).astype(np.float32)
    v = [(base[i % 30] + r.normal(size=16) * r.choice([0, 0.05, 0.12])).astype(np.float32).tolist() for i in range(150)]
    v += [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1e-30] * 16, [1e30] * 16, [1.0] * 8]
    labels = [i % 3 for i in range(150)] + [0, 0, 0, 0, 1, 1, 1]
    labels[4] = None
    rows = [(i, e, k, "extra") for i, (e, k) in enumerate(zip(v, labels))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, n string")
    assert sorted(map(tuple, embeddings.near_duplicates(df).collect())) == linked(v, labels)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", (t or "").lower())
        sets.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set())
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    want = [(i, len(s), root[i], root[i] == i) for i, s in enumerate(sets)]
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == want


def similar_groups(texts, n, percent):
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)})
    by = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            by[x].append(i)
    root = list(range(len(sets)))
    for i, j in sorted({(i, j) for own in by.values() for i in own for j in own if i < j}):
        if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            x, y = root[i], root[j]
            root = [min(x, y) if r in (x, y) else r for r in root]
    return root


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80), (3, 70)])
def test_near_duplicates_of_short_texts(spark, n, percent):
    r = random.Random(23)
    texts = []
    for size in range(7, 21):
        for _ in range(60 if size == 8 else 12):
            t = words(r, size)
            texts += [t, f"{t} {words(r, 1)}"] + ([f"{words(r, 1)} {t} {words(r, 1)}"] if size % 2 else [])
    common = words(r, 6)  # its shingles are in lists longer than SHORT
    for _ in range(30):
        t = f"{common} {words(r, 4)}"
        texts += [t, f"{t} {words(r, 1)}", f"{words(r, 1)} {t}"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in minhash.near_duplicates(df, words=n, percent=percent).collect()}
    want = similar_groups(texts, n, percent)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(want)


def test_language_held_out(spark):
    r = random.Random(3)
    make = {"xx": "abcde", "yy": "cdefg"}
    rows = [(i, " ".join("".join(r.choice(a) for _ in range(5)) for _ in range(60)), k, "s", 0) for i in range(200) for k, a in [("xx", make["xx"]) if i % 2 else ("yy", make["yy"])]]
    rows += [(900, None, "xx", "s", 0), (901, "12 !", "yy", "s", 0)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    got = {x.doc_id: x for x in langid.identify(df, F.col("doc_id") % 3 != 1, ["doc_id", "lang"]).collect()}
    assert got[900].lang_pred == got[901].lang_pred == "und" and got[900].score == 0
    held = [x for i, x in got.items() if i % 3 == 1 and i < 900]
    assert np.mean([x.lang == x.lang_pred for x in held]) > 0.97 and all(0 <= x.score <= 1 for x in held)


def test_language_stage_of_odd_tables(spark):
    rows = [(i % 40, "abc abd " * 9 if i % 2 else "xyz xzz " * 9, "ab" if i % 2 else "xy", "lang") for i in range(80)] + [(None, "12 34", None, "q"), (7, None, None, "q"), (None, "abc abd abc abd", None, "q"), (8, "xyz " * 20_000, None, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string").selectExpr("*", "1 as score", "2 as __text")
    got = langid.keep_identified(spark, df)
    assert got.columns == df.columns and sorted(r.text[:3] for r in got.collect()) == ["abc"] * 41 + ["xyz"] * 41
    none = df.withColumn("lang", df.lang.cast("string")).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert langid.keep_identified(spark, none).count() == df.count() and langid.keep_identified(spark, none.limit(0)).count() == 0


def photo(r, h=96, w=96):
    im = np.full((h, w), 128.0)
    for _ in range(25):
        y, x = r.integers(0, h - 8), r.integers(0, w - 8)
        im[y : y + r.integers(6, 30), x : x + r.integers(6, 30)] += r.integers(-90, 90)
    return np.clip(im, 0, 255).astype(np.uint8)


def test_image_copies(spark):
    r = np.random.default_rng(3)
    ims = [photo(r) for _ in range(12)]
    a = ims[0]
    ims += [a[8:80, 12:90].copy(), np.clip(a * 0.8 + 20, 0, 255).astype(np.uint8), a.copy(), np.rot90(a).copy()]
    rows = [(i, *m.shape, m.tobytes()) for i, m in enumerate(ims)] + [(None, 8, 8, bytes(64)), (90, 0, 0, b""), (91, 8, 8, None)]
    df = spark.createDataFrame(rows, "id long, height int, width int, pixels binary")
    got = {x.id: x for x in media.detect_copies(df).collect()}
    assert [got[i].component_id for i in range(16)] == [*range(12), 0, 0, 0, 0]
    assert got[0].n_class == 5 and got[None].component_id is None and got[91].component_id == 91 and got[91].n_class == 1
    assert media.detect_copies(df.limit(0)).count() == 0
    odd = df.unionAll(df.where("id < 3")).selectExpr("*", "1 as key", "2 as component")
    assert {(x.id, x.component_id, x.n_class) for x in media.detect_copies(odd).collect()} == {(x.id, x.component_id, x.n_class) for x in got.values()}


def test_image_copies_against_all_pairs(spark):
    """Classes are within those of all pairs; of the planted copies that agree with their image, at least 0.9 are found."""
    r = np.random.default_rng(8)
    base = [photo(r) for _ in range(50)]
    noisy = lambda m: np.clip(m + r.normal(0, 3, m.shape), 0, 255).astype(np.uint8)
    edits = [lambda m: m[9:-7, 6:-11].copy(), lambda m: np.clip(m * 0.8 + 20, 0, 255).astype(np.uint8), noisy, lambda m: np.rot90(m).copy()]
    ims = base + [e(m) for m in base for e in edits] + [noisy(base[0]) for _ in range(60)]
    marks = [media.describe(m[None])[0] for m in ims]
    roots = list(range(len(ims)))
    for i in range(len(ims)):
        for j in range(i):
            if roots[i] != roots[j] and media.agreeing(marks[i], marks[j]) >= 6:
                low, high = sorted((roots[i], roots[j]))
                roots = [low if x == high else x for x in roots]
    df = spark.createDataFrame([(i, *m.shape, m.tobytes()) for i, m in enumerate(ims)], "id long, height int, width int, pixels binary")
    got = [x.component_id for x in media.detect_copies(df).orderBy("id").collect()]
    assert all(roots[i] == roots[c] for i, c in enumerate(got))
    of = [*range(50), *(i for i in range(50) for _ in edits), *[0] * 60]
    planted = [i for i in range(50, len(ims)) if media.agreeing(marks[i], marks[of[i]]) >= 6]
    assert len(planted) > 240 and np.mean([got[i] == got[of[i]] for i in planted]) >= 0.9


def test_image_copies_long_lists(spark, monkeypatch):
    """Unlike images in long lists: all pairs that share enough lists, without the pairs of a long list."""
    r = np.random.default_rng(4)
    of = [sorted({*r.choice(6, int(r.integers(0, 3)), replace=False).tolist(), *(10 + r.integers(0, 900, 4)).tolist()}) for _ in range(600)]
    rows = [(k, i, i // 2) for i, keys in enumerate(of) for k in keys]
    size = np.bincount([k for k, _, _ in rows])
    lists = spark.createDataFrame([(*row, int(size[row[0]])) for row in rows], "key long, id long, c long, members long")
    assert size[:6].min() > 50 > media.LONG > 1
    made, met = [], media._met
    monkeypatch.setattr(media, "_met", lambda lists: made.append(met(lists)) or made[-1])
    for votes in (1, 2, 3):
        want = {(a, b) for a in range(600) for b in range(a + 1, 600) if a // 2 != b // 2 and len({*of[a]} & {*of[b]}) >= votes}
        made.clear()
        assert want and sorted((x.a, x.b) for x in media._sharing(lists, votes).collect()) == sorted(want)
        assert votes == 1 or sum(x.count() for x in made) < 8000 < int((size[:6] * (size[:6] - 1) // 2).sum())


def test_image_copies_rows_of_lists(spark, monkeypatch):
    """Images in many long lists: the tables between hold no row for two lists of an image or two members of a list."""
    r = np.random.default_rng(6)
    of = [sorted(r.choice(2000, 40, replace=False).tolist()) for _ in range(500)]
    rows = [(k, i, i // 2) for i, keys in enumerate(of) for k in keys]
    size = np.bincount([k for k, _, _ in rows])
    lists = spark.createDataFrame([(*row, int(size[row[0]])) for row in rows], "key long, id long, c long, members long")
    shared = {(a, b): len({*of[a]} & {*of[b]}) for a in range(500) for b in range(a + 1, 500) if a // 2 != b // 2}
    made = []
    for name in ("written", "_met"):
        monkeypatch.setattr(media, name, lambda df, *_, f=getattr(media, name): made.append(f(df, *_)) or made[-1])
    for votes, block in ((2, 4096), (3, 4096), (2, 5), (3, 5)):
        monkeypatch.setattr(media, "BLOCK", block, raising=False)
        want = [pair for pair, n in shared.items() if n >= votes]
        assert want and sorted((x.a, x.b) for x in media._sharing(lists, votes).collect()) == sorted(want)
    assert sum(df.count() for df in made) <= len(rows)


def test_image_copies_meetings():
    """Any number of meetings held at once gives the same pairs, none of one block where only those across count."""
    r = np.random.default_rng(7)
    part, block, c = np.repeat([0, 1, 2], 30), np.tile([0, 1], 45), r.integers(0, 40, 90)
    of = [np.sort(r.choice(60, r.integers(0, 12), replace=False)) for _ in range(90)]
    size, others, across = np.array([len(x) for x in of]), np.concatenate(of), part == 1
    for votes in (1, 2):
        want = [(i, j) for i in range(90) for j in range(i + 1, 90) if part[i] == part[j] and c[i] != c[j] and not (across[i] and block[i] == block[j]) and len({*of[i]} & {*of[j]}) >= votes]
        for most in (1, 50, 1 << 20):
            got = [(int(x), int(y)) for a, b in media.meeting(part, across, block, c, size, others, votes, most) for x, y in zip(a, b)]
            assert want and got == want
    none = np.zeros(0, np.int64)
    assert not list(media.meeting(none, none == 1, none, none, none, none, 1))


def test_tool_calls(spark):
    rows = [
        (1, 1, "assistant", None, "a", "search", '{"turn": 1, "query": "q"}'),
        (1, 2, "tool", "found", "a", None, None),
        (1, 3, "assistant", None, "b", "search", '{"query":"z","after":["a"],"turn":3}'),
        (1, 4, "assistant", None, "c", "search", '{"query":"z","after":["d"],"turn":3}'),
        (1, 5, "assistant", None, "d", "search", '{"query":"z","after":["c"],"turn":3}'),
        (1, 6, "assistant", None, "e", "score", '{"query":"z","turn":"3","points":1}'),
        (1, 7, "assistant", None, "f", "none", "{}"),
        (1, 8, "assistant", None, "g", "search", '{"query":'),
        (1, 9, "tool", "lost", "zz", None, None),
        (1, 10, "user", 'say "hi"\n', None, None, None),
        (None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string, name string, arguments string")
    got = {r.turn: r for r in chat.format_chat(df, chat.tool_schemas(spark)).collect()}
    assert [(got[t].depth, got[t].linked, got[t].status) for t in range(1, 10)] == [(0, True, "ok"), (0, True, "ok"), (1, False, "ok"), (-1, False, "ok"), (-1, False, "ok"), (0, False, "bad_arguments"), (0, False, "unknown_tool"), (0, False, "bad_json"), (None, False, "orphan")]
    assert got[3].json == '{"arguments":{"after":["a"],"query":"z","turn":3},"content":null,"id":"b","name":"search","role":"assistant"}'
    assert json.loads(got[10].json) == {"content": 'say "hi"\n', "role": "user"} and got[None].status == "message"
    assert chat.format_chat(df.limit(0), chat.tool_schemas(spark)).count() == 0


CALL = "conv_id long, turn long, role string, text string, call_id string, name string, arguments string"


def test_identifiers_hold_within_a_conversation(spark):
    make = lambda conv, turn, call, after: (conv, turn, "assistant", None, call, "search", json.dumps({"query": "q", "turn": turn, "after": after}))
    rows = [make(c, 1, "call_1", []) for c in (1, 2, 3, None)] + [(2, 2, "tool", "x", "call_1", None, None), (None, 2, "tool", "x", "call_1", None, None)]
    rows += [make(1, 3, "call_2", ["call_1", "call_9"]), make(3, 3, "call_3", ["call_1"]), make(3, 4, "call_1", ["call_3"])]  # a cycle in 3 only
    rows += [make(2, 5, "call_1", [])] * 2 + [(5, 1, "tool", "x", "call_2", None, None)]
    df = spark.createDataFrame(rows, CALL).selectExpr("*", "'clash' as key", "1 as row", "2 as depth")
    got = sorted((str(r.conv_id), r.turn, r.depth, r.linked) for r in chat.format_chat(df, chat.tool_schemas(spark)).collect())
    assert got == sorted([("1", 1, 0, False), ("1", 3, 1, False), ("2", 1, 0, True), ("2", 2, 0, True), ("2", 5, 0, True), ("2", 5, 0, True), ("3", 1, -1, False), ("3", 3, -1, False), ("3", 4, -1, False), ("None", 1, 0, True), ("None", 2, 0, True), ("5", 1, None, False)])


def test_depths_equal_brute_force(spark):
    r = random.Random(4)
    edges = [(i, i - 1) for i in range(1, 300)] + [(400 + i, 400 + r.randrange(i)) for i in range(1, 120) for _ in range(r.randint(1, 3))]
    edges += [(601, 602), (602, 603), (603, 601), (604, 603), (604, 5), (605, 605)]
    nodes = sorted({x for e in edges for x in e} | {900})
    before = collections.defaultdict(set)
    for a, b in edges:
        before[a].add(b)
    want: dict = {}
    while True:
        new = {n: max((want[b] + 1 for b in before[n]), default=0) for n in nodes if n not in want and all(b in want for b in before[n])}
        if not new:
            break
        want |= new
    found = chat.depths(spark.createDataFrame([(n,) for n in nodes], "id long"), spark.createDataFrame(edges, "id long, before long"))
    assert {x.id: x.depth for x in found.collect()} == {n: want.get(n, -1) for n in nodes}


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(rows.columns) and rows.count() > 0
    kept = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns, name


def test_crc_of_ids_is_unsigned():
    assert pieces_sa.checksum(np.array([1, 2], "<u4")) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


def test_depths_take_few_rounds(spark, monkeypatch):
    """A chain of one predecessor each, one of two, and one where every call names all before it, with a cycle behind."""
    rounds = []
    monkeypatch.setattr(chat, "written", lambda df, name: rounds.append(name) or written(df, name))
    ids = lambda n: spark.createDataFrame([(i,) for i in range(n)], "id long")
    for back, n, most in ((1, 64, 9), (2, 64, 10), (64, 24, 10)):
        edges = [(i, j) for i in range(n) for j in range(max(0, i - back), i)]
        want = {i: i for i in range(n)}
        edges += [(n, n - 1), (n, n + 1), (n + 1, n), (n + 2, n + 1)]
        want |= {n + i: -1 for i in range(3)}
        rounds.clear()
        got = {r.id: r.depth for r in chat.depths(ids(n + 3), spark.createDataFrame(edges, "id long, before long")).collect()}
        assert got == want
        assert len(rounds) <= most, (back, len(rounds))
