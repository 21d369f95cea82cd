"""The pipeline's stages over odd tables, and shingles of every small size."""

import os
import random
from urllib.parse import urlparse

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from prismalake.llm import minhash, packing, suffix
from prismalake.llm.common import SHUFFLES_GO, scratch, written

ODD = "doc_id long, text string, lang string, source string, n_chars long, __id long, __kept string, __row long, __rid long, rid long, times long, cut_id long, CUT_KEPT string"


@pytest.mark.parametrize("words", range(1, 9))
def test_shingles_of_small_batches(words):
    r = random.Random(words)
    for n in range(13):
        text = " ".join(r.choice("ab") for _ in range(n))
        for batch in ([text], [text, None], ["", text, text.upper()]):
            values, counts = minhash.shingles(pa.array(batch, pa.string()), words)
            parts = [(t or "").lower().split() for t in batch]
            sets = [[tuple(p[i : i + words]) for i in range(len(p) - words + 1)] if len(p) >= words else [tuple(p)] * bool(p) for p in parts]
            assert counts.tolist() == list(map(len, sets))
            flat = [s for own in sets for s in own]
            assert len(values) == len(flat) and len(set(zip(flat, values.tolist()))) == len(set(flat)) == len(set(values.tolist()))


def test_short_rows_equal_those_of_a_longer_batch():
    for n in range(1, 8):
        text = " ".join("abcdefgh"[:n])
        alone, _ = minhash.shingles(pa.array([text]), 5)
        beside, counts = minhash.shingles(pa.array(["x y z u v w q", text]), 5)
        assert alone.tolist() == beside[counts[0] :].tolist()


@pytest.fixture(scope="module")
def odd(spark):
    r = random.Random(3)
    passage = " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(90))
    own = ["".join(r.choice("hijklmn") for _ in range(6)) for _ in range(400)]
    rows = [(1, "one two three"), (2, "one two three"), (None, "one two three"), (3, f"{' '.join(own[:80])} {passage}"), (4, f"{' '.join(own[80:150])} {passage}"), (4, f"{' '.join(own[80:150])} {passage}"), (5, None), (6, ""), (5, None), (7, passage), (7, " ".join(own[200:260]))]
    return spark.createDataFrame([(i, t, "en", None, 1, 11, "k", 12, 13, 14, 15, 16, "c") for i, t in rows], ODD)


def test_near_duplicate_stage_of_odd_tables(spark, odd):
    out = minhash.keep_one_of_each(spark, odd)
    assert out.schema.names == odd.schema.names
    kept = [(x.doc_id, x.text) for x in out.collect()]
    texts = [t for _, t in kept]
    assert texts.count("one two three") == 1 and (1, "one two three") in kept
    assert len(kept) == len(set(kept)) and {(5, None), (6, "")} <= set(kept)
    assert {tuple(x[5:]) for x in out.collect()} == {(11, "k", 12, 13, 14, 15, 16, "c")}
    assert minhash.keep_one_of_each(spark, odd.limit(0)).count() == 0


def test_passage_stage_of_odd_tables(spark, odd):
    out = suffix.drop_repeats(spark, odd)
    assert out.schema.names == odd.schema.names
    rows = out.collect()
    assert all(tuple(x[5:]) == (11, "k", 12, 13, 14, 15, 16, "c") for x in rows)
    ids = [x.doc_id for x in rows]
    assert ids.count(4) == 0 and ids.count(7) == 1 and ids.count(5) == 2 and ids.count(None) == 1  # what repeats as a whole goes
    three = next(x for x in rows if x.doc_id == 3)
    assert len(three.text.split()) == 80 and three.n_chars == len(three.text)
    assert suffix.drop_repeats(spark, odd.limit(0)).count() == 0


def test_packing_stage_of_odd_tables(spark, odd):
    rows = packing.pack_stage(spark, odd)
    assert rows.count() >= odd.count() and packing.pack_stage(spark, odd.limit(0)).count() == 0


def test_scratch_deletes_its_tables_and_restores_the_setting(spark):
    before = spark.conf.get(SHUFFLES_GO)
    with pytest.raises(ZeroDivisionError), scratch(spark):
        with scratch(spark):
            inner = written(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "inner")
            kept = written(inner.join(inner.select("k"), "k"), "kept", keep=True)
            gone = inner.inputFiles()
        assert spark.conf.get(SHUFFLES_GO) == "true"
        assert kept.count() == kept.groupBy("k").count().count() == 7
        left = kept.inputFiles()
        assert left and not any(os.path.exists(urlparse(x).path) for x in gone)
        assert all(os.path.exists(urlparse(x).path) for x in left)
        1 / 0
    assert gone and not any(os.path.exists(urlparse(x).path) for x in left)
    assert spark.conf.get(SHUFFLES_GO) == before
