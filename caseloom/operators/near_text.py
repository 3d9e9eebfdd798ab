"""Near-equal texts: links between texts whose TF-IDF vectors of character 3- to 5-grams have a cosine of at least a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.skew import join_one_per_key
from caseloom.session import stored

SIZES = (3, 5)  # shortest and longest gram, in characters
BANDS, ROWS, SHARED = 48, 8, 3  # texts must share SHARED bands: of pairs whose gram sets have a Jaccard similarity of 0.85, 0.004 % don't, of 0.8, 0.9 %; of 0.4, 2 in 100,000 do
MOST_GRAMS = 4_000_000  # grams of two documents or more that are broadcast with their frequencies (16 bytes each); more are joined
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct grams of a text, ascending, and how often each occurs; blanks count as characters."""
    marks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    h, parts = marks * _A, []
    for n in range(2, SIZES[1] + 1):
        if len(marks) < n:
            break
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * _A + marks[n - 1 :] * _B
        if n >= SIZES[0]:
            parts.append(h)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(np.concatenate(parts).view(np.int64), return_counts=True)


def _frequencies(texts: DataFrame) -> DataFrame:
    """(gram, df) over texts (id, text, n), where n documents hold a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, copies = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for at in range(0, len(said), 256):  # so that memory stays flat
                held = [grams(t)[0] for t in said[at : at + 256]]
                names, place = np.unique(np.concatenate(held), return_inverse=True)
                df = np.bincount(place.ravel(), np.repeat(copies[at : at + 256], [len(g) for g in held]), len(names))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(df.astype(np.int64))], names=["gram", "df"])

    return texts.select("text", "n").mapInArrow(count, "gram long, df long").groupBy("gram").agg(F.sum("df").alias("df"))


def gram_bands(texts: DataFrame, seed: int = 5) -> DataFrame:
    """(id, band): BANDS keys of every text, each from ROWS minwise hashes of its set of grams."""
    draws = np.random.default_rng(seed)
    factors = draws.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    offsets = draws.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)

    def keys_of(text: str) -> np.ndarray:
        short = (grams(text)[0].view(np.uint64) >> np.uint64(32)).astype(np.uint32)
        least = np.full(len(factors), np.iinfo(np.uint32).max, np.uint32)
        for at in range(0, len(short), 256):  # long texts in slices, so that memory stays flat
            least = np.minimum(least, (short[at : at + 256, None] * factors + offsets).min(axis=0))
        rows = least.astype(np.uint64).reshape(BANDS, ROWS)
        keys = np.arange(BANDS, dtype=np.uint64) * _A
        for k in range(ROWS):
            keys = (keys ^ rows[:, k]) * _B
            keys ^= keys >> np.uint64(31)
        return keys.view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                keys = [keys_of(t) for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(np.repeat(np.arange(len(keys)), BANDS))), pa.array(np.concatenate(keys))], names=["id", "band"])

    return texts.select("id", "text").mapInArrow(sign, "id long, band long")


def _linked(banded: DataFrame) -> DataFrame:
    """(a, b) with a < b: texts that share SHARED bands. Equal texts are one row by now, so a band grows with its different texts only, and its join is split where it is hot."""
    left, right = banded.select("band", F.col("id").alias("a")), banded.select("band", F.col("id").alias("b"))
    return left.join(right, "band").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED).select("a", "b")


def _cosines_by_broadcast(pairs: DataFrame, texts: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """(a, b, cosine), where frequencies, at most MOST_GRAMS rows, are broadcast."""
    got = frequencies.toArrow()
    names, df = got.column("gram").to_numpy(), got.column("df").to_numpy()
    turn = np.argsort(names)
    shared = texts.sparkSession.sparkContext.broadcast((names[turn], df[turn]))
    said = texts.select("id", "text")
    whole = pairs.join(said.select(F.col("id").alias("a"), F.col("text").alias("s")), "a").join(said.select(F.col("id").alias("b"), F.col("text").alias("t")), "b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = shared.value

        def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
            g, tf = grams(text)
            at = np.minimum(np.searchsorted(known, g), max(len(known) - 1, 0))
            df = np.where(known[at] == g, counts[at], 1) if len(known) else np.ones(len(g))
            w = tf * (np.log((1 + documents) / (1 + df)) + 1)
            return g, w / np.sqrt((w * w).sum())

        for batch in batches:
            cosines = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                (g, w), (h, v) = vector(s), vector(t)
                _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                cosines.append(float(w[i] @ v[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosines, pa.float64())], names=["a", "b", "cosine"])

    return whole.select("a", "b", "s", "t").mapInArrow(compare, "a long, b long, cosine double")


def _cosines_by_join(pairs: DataFrame, texts: DataFrame, frequencies: DataFrame, documents: int) -> DataFrame:
    """(a, b, cosine), where the grams of the texts that some pair names are joined with their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                g, tf = grams(t)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k)), pa.array(g), pa.array(tf.astype(np.int64))], names=["id", "gram", "tf"])

    named = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = texts.join(named, "id", "left_semi").select("id", "text").mapInArrow(count, "id long, gram long, tf long")
    weight = F.col("tf") * (F.log((1 + F.lit(documents)) / (1 + F.coalesce("df", F.lit(1)))) + 1)
    held = stored(join_one_per_key(rows, frequencies, "gram", "left").select("id", "gram", weight.alias("w")), "weights")
    norms = stored(held.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm")), "norms")
    left = pairs.join(held.select(F.col("id").alias("a"), "gram", F.col("w").alias("x")), "a")
    both = left.join(held.select(F.col("id").alias("b"), "gram", F.col("w").alias("y")), ["b", "gram"])
    dots = both.groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("dot"))
    dots = dots.join(norms.select(F.col("id").alias("a"), F.col("norm").alias("m")), "a").join(norms.select(F.col("id").alias("b"), F.col("norm").alias("n")), "b")
    return dots.select("a", "b", (F.col("dot") / (F.col("m") * F.col("n"))).alias("cosine"))


def near_text_links(texts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """(a, b, cosine) of texts with a cosine of at least the threshold that share enough bands; texts has id (long, unique), text, n.

    n documents hold a text; frequencies count documents, idf is ln((1+N)/(1+df)) + 1, and cosines are exact. Texts meet through banded minwise hashes
    of their gram sets. In reports of this kind two texts of a cosine of 0.95 have gram sets of a Jaccard similarity of 0.93 or more, and nearly all others of less than 0.4.
    """
    texts = stored(texts.where("text <> ''").select("id", "text", F.col("n").cast("long").alias("n")), "texts")
    documents = texts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequencies = stored(_frequencies(texts).where("df > 1"), "frequencies")
    pairs = stored(_linked(gram_bands(texts)), "pairs")
    few = frequencies.count() <= MOST_GRAMS
    compared = (_cosines_by_broadcast if few else _cosines_by_join)(pairs, texts, frequencies, documents)
    return compared.where(F.col("cosine") + 1e-7 >= threshold)
