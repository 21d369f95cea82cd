"""Language identification: multinomial naive Bayes over hashed character n-grams.

Character n-grams (1 to 3 letters, runs of other characters read as one blank) are hashed into a fixed number of
buckets. Spark counts buckets by language over every learning row, the smoothed log-probabilities become one
``buckets x languages`` matrix, which is broadcast, and documents are scored in batches with numpy.

Size of the broadcast: ``buckets * languages * 4`` bytes. ``max_cells`` bounds it (an error is raised beyond);
the text never passes through the driver, only counts of buckets do.

Defined results: null text, or text without any letter -> ``und`` with score 0; without a single learning row every
document is ``und``; rows with a null label or null text teach nothing; repeated rows count as often as they occur
and each gets its own result; columns of the input other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U64, crc_share, free_name, mix64, pieces, written

UNKNOWN = "und"
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """Code point -> its lower-case code point if it is a letter, else 32."""
    global _fold
    if _fold is None:
        out = np.full(0x110000, 32, np.uint32)
        for a, b in ((0, 0xD800), (0xE000, 0x110000)):
            for c in map(chr, range(a, b)):
                if c.isalpha():
                    low = c.lower()
                    out[ord(c)] = ord(low) if len(low) == 1 else ord(c)
        _fold = out
    return _fold


def features(texts: list[str | None], buckets: int, orders: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the row of each, and whether each row has a letter."""
    rows = [t or "" for t in texts]
    raw = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), lengths)
    code = _folding()[raw]
    letter = code != 32
    known = np.zeros(len(rows), bool)
    known[owner[letter]] = True
    # A blank counts only after a letter of the same row: runs of other characters are one blank.
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (owner[1:] == owner[:-1])
    code, owner = code[keep].astype(U64), owner[keep]
    found, rows_of = [], []
    h = np.zeros(len(code), U64)
    for n in range(1, orders + 1):
        m = len(code) - n + 1
        if m <= 0:
            break
        h = h[:m] * U64(0x9E3779B97F4A7C15) + code[n - 1 :] + U64(n)
        same = owner[:m] == owner[n - 1 :]
        if n == 1:
            same = same & (code != 32)
        found.append((mix64(h[same]) % U64(buckets)).astype(np.int32))
        rows_of.append(owner[:m][same])
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), known
    return np.concatenate(found), np.concatenate(rows_of), known


def bucket_counts(docs: DataFrame, text: str, label: str, buckets: int) -> DataFrame:
    """(lang, bucket, n) over all rows with a text and a label; each task adds up before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in pieces(batches, "text", 1 << 20):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            place = {x: i for i, x in enumerate(names)}
            of = np.fromiter((place[x] for x in langs), np.int64, len(langs))
            hits, rows, _ = features(batch.column("text").to_pylist(), buckets)
            got = np.bincount(of[rows] * buckets + hits, minlength=len(names) * buckets).reshape(len(names), buckets)
            for i, x in enumerate(names):
                sums[x] = sums[x] + got[i] if x in sums else got[i]
                docs_of[x] = docs_of.get(x, 0) + int((of == i).sum())
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.record_batch([pa.array([x] * (len(at) + 1)), pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(v[at], docs_of[x]).astype(np.int64))], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("lang")).where("text is not null and lang is not null")
    return rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and their log-probabilities by bucket (the last row holds the class priors)."""

    def __init__(self, langs: list[str], weights: np.ndarray, priors: np.ndarray):
        self.langs, self.weights, self.priors = langs, weights, priors


def fit(docs: DataFrame, text: str = "text", label: str = "lang", buckets: int = 1 << 16, smoothing: float = 0.5, max_cells: int = 1 << 26) -> Model:
    """Learn from every row of ``docs`` that has a text and a label."""
    counts = written(bucket_counts(docs, text, label, buckets), "counts")
    langs = sorted(r[0] for r in counts.where("bucket = -1").select("lang").limit(max_cells // buckets + 1).collect())
    if len(langs) * buckets > max_cells:
        raise ValueError(f"more than {max_cells // buckets} languages; raise max_cells to broadcast a larger matrix")
    table = counts.toArrow()
    sums, priors = np.zeros((len(langs), buckets)), np.zeros(len(langs))
    if langs:
        place = {x: i for i, x in enumerate(langs)}
        of = np.array([place[x] for x in table.column("lang").to_pylist()])
        at, n = table.column("bucket").to_numpy(), table.column("n").to_numpy()
        priors[of[at < 0]] = n[at < 0]
        sums[of[at >= 0], at[at >= 0]] = n[at >= 0]
        weights = np.log((sums + smoothing) / (sums.sum(1, keepdims=True) + smoothing * buckets))
        return Model(langs, np.ascontiguousarray(weights.T, np.float32), np.log(priors / priors.sum()))
    return Model([], np.zeros((buckets, 0), np.float32), priors)


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", evidence: int = 60) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``.

    The score is the posterior when the evidence of a text counts as at most ``evidence`` n-grams, so that long texts
    of two languages do not all get 1.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        buckets, by_lang = len(m.weights), np.ascontiguousarray(m.weights.T)
        for batch in pieces(batches, read, 1 << 20):
            n = batch.num_rows
            hits, rows, known = features(batch.column(read).to_pylist(), buckets)
            if m.langs:
                total = np.empty((n, len(m.langs)))
                for j in range(len(m.langs)):
                    total[:, j] = np.bincount(rows, by_lang[j][hits], n)
                grams = np.maximum(np.bincount(rows, minlength=n), 1)
                best = np.argmax(total + m.priors, 1)
                z = total * np.minimum(1, evidence / grams)[:, None] + m.priors
                z = np.exp(z - z.max(1, keepdims=True))
                chance = (z / z.sum(1, keepdims=True))[np.arange(n), best]
            else:
                known = np.zeros(n, bool)
                best, chance = np.zeros(n, np.int64), np.zeros(n)
            names = [m.langs[b] if k else UNKNOWN for b, k in zip(best, known)]
            yield pa.record_batch([*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.where(known, chance, 0.0))], [*batch.schema.names[: len(keep)], *judged])

    # The text goes through Python once: as one of the kept columns if it is among them.
    read = text if text in keep and dict(docs.dtypes)[text] == "string" else free_name("text", keep)
    judged = [free_name("lang_pred", keep), free_name("score", keep)]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if read == text and text in keep else [F.col(f"`{text}`").cast("string").alias(read)]))
    schema = rows.select(*[F.col(f"`{c}`") for c in keep]).schema.add(judged[0], "string").add(judged[1], "double")
    return rows.mapInArrow(score, schema)


def identify(docs: DataFrame, learn: Column, keep: list[str], text: str = "text", label: str = "lang", **options) -> DataFrame:
    """Learn from the rows where ``learn`` holds, then predict every row."""
    return predict(docs, fit(docs.where(learn), text, label, **options), keep, text)


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held = (crc_share("doc_id", 3) == 1).alias("held_out")
    rows = docs.select("doc_id", "text", "lang", held)
    return identify(rows, ~F.col("held_out"), ["doc_id", "held_out"])


def keep_identified(spark, docs: DataFrame, sf_dir: str | None = None, least: float = 0.5) -> DataFrame:
    """Pipeline stage: keep the documents with a recognised language; the others go. Columns stay as they are, those with
    clashing names too. Without a single labelled text every document stays."""
    names = docs.columns
    model = fit(docs)
    if not model.langs:  # nothing to learn from, so nothing to reject by
        return docs
    judged = predict(docs, model, names)
    pred, score = judged.columns[len(names) :]
    return judged.where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in names])
