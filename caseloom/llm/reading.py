"""Reading level of each document: a familiar-word formula over sentences, fitted to rated documents."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import stored

TAG = regex.compile(r"<[!/]?\p{L}[^<>]*>")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
SENTENCE = re.compile(r"(?<=[.!?;])[\s\"”»')]+|\n+")
LIST_SIZES = (100, 200, 300)  # nested high-frequency lists; shares outside each of them enter the formula
LEAST_WORDS = 50
RATED_DOCUMENTS = 4000  # most rated documents that the fit uses, drawn by hash
SENTENCES = 50  # most sentences of a rated document that the fit uses

# Frequent function words by language, for telling English texts.
FUNCTION_WORDS = {
    "en": "the of and to in is was were that this with for on are as at by be from it or an which not you your we he she can will may has have had but than then",
    "es": "el la los las de en se no hay una un por para con del junto es que y ha dentro pero al su",
    "fr": "le la les des de du dans est il on un une et pas pour avec au sont par ne",
    "de": "der die das im ist und ein eine kein keine nicht mit zur sich wird in es den von zu",
    "it": "il lo la i gli le di del della che e un una per con non si nel nella sono da al",
    "pt": "o a os as do da de em que e um uma para com não se no na por dos ao",
}


def plain(text: str) -> str:
    """Text without mark-up and compatibility forms."""
    shown = TAG.sub(" ", html.unescape(text)) if "<" in text or "&" in text else text
    return unicodedata.normalize("NFKC", shown)


def sentences_of(text: str) -> list[list[str]]:
    """Lower-case words of every sentence that has one."""
    cut = (WORD.findall(s) for s in SENTENCE.split(text.lower()))
    return [words for words in cut if words]


def has_words(text: str, least: int) -> bool:
    """Whether at least `least` blank-separated words hold a letter or digit."""
    n = 0
    for word in text.split():
        n += word.isalnum() or any(map(str.isalnum, word))
        if n >= least:
            return True
    return False


_LANGUAGES: dict[str, list[int]] = {}
for _place, _words in enumerate(FUNCTION_WORDS.values()):
    for _word in _words.split():
        _LANGUAGES.setdefault(_word, []).append(_place)


def is_english(sentences: list[list[str]]) -> bool:
    """Whether English function words outnumber those of any other language."""
    counts = [0] * len(FUNCTION_WORDS)
    for words in sentences:
        for w in words:
            for place in _LANGUAGES.get(w, ()):
                counts[place] += 1
    return counts[0] > max(counts[1:])


def document_words(documents: DataFrame) -> DataFrame:
    """(doc_id, sentences): lower-case words by sentence of every English text of at least LEAST_WORDS words, mark-up left out.

    Null texts and ids, short texts and texts in other languages have no row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few whole texts are Python objects at a time
                batch = whole.slice(at, 256)
                ids, rows = [], []
                for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if doc is None or not text:
                        continue
                    shown = plain(text)
                    if not has_words(shown, LEAST_WORDS):
                        continue
                    sentences = sentences_of(shown)
                    if is_english(sentences):
                        ids.append(doc)
                        rows.append([" ".join(words) for words in sentences])
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(rows, pa.list_(pa.string()))], names=["doc_id", "sentences"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(cut, f"doc_id {kind}, sentences array<string>")


def familiar_words(cut: DataFrame, most: int) -> list[str]:
    """The `most` words that the most documents hold, most frequent first (ties by the word); counted over all documents."""
    words = cut.select(F.explode(F.array_distinct(F.split(F.array_join("sentences", " "), " "))).alias("word"))
    top = words.groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.desc("df"), "word").limit(most)
    return [r["word"] for r in top.collect()]


def sentence_features(words: list[str], rank: dict[str, int], sizes: tuple[int, ...]) -> list[float]:
    """Shares of words outside each list, log of the sentence's length, mean letters of a word."""
    places = [rank.get(w, 1 << 30) for w in words]
    n = len(words)
    return [*(sum(p >= k for p in places) / n for k in sizes), float(np.log(n)), sum(map(len, words)) / n]


def _squares(x: np.ndarray) -> np.ndarray:
    pairs = [x[:, i] * x[:, j] for i in range(x.shape[1]) for j in range(i + 1)]
    return np.column_stack([x, *pairs])


class LevelFormula:
    """Softmax over the features of a sentence and their products, fitted by gradient descent."""

    def __init__(self, features: np.ndarray, levels: np.ndarray, weights: np.ndarray, rounds: int = 800):
        self.levels = np.unique(levels)
        x = _squares(features)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        x = self._ready(features)
        hot = (levels[:, None] == self.levels[None, :]).astype(float)
        per_level = (hot * weights[:, None]).sum(axis=0)
        w = weights * (hot @ (1.0 / np.maximum(per_level, 1e-12)))
        w /= w.sum()
        self.beta = np.zeros((x.shape[1], len(self.levels)))
        for _ in range(rounds):
            self.beta -= 2.0 * (x.T @ ((self._share(x) - hot) * w[:, None]) + 1e-5 * self.beta)

    def _ready(self, features: np.ndarray) -> np.ndarray:
        x = (_squares(features) - self.mean) / self.scale
        return np.column_stack([x, np.ones(len(x))])

    def _share(self, x: np.ndarray) -> np.ndarray:
        z = x @ self.beta
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def shares(self, features: np.ndarray) -> np.ndarray:
        return self._share(self._ready(features))


def rated_levels(labels: DataFrame) -> DataFrame:
    """(doc_id, level_no): the level most raters gave a document, ties to the lower one; null ids and levels, and repeated rows, don't count."""
    rows = labels.where("doc_id is not null and level_no is not null").dropDuplicates(["doc_id", "level_no", "rater_id"])
    votes = rows.groupBy("doc_id", "level_no").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("n"), "level_no")
    return votes.withColumn("r", F.row_number().over(best)).where("r = 1").select("doc_id", "level_no")


def reading_levels(documents: DataFrame, labels: DataFrame, sizes: tuple[int, ...] = LIST_SIZES, most_rated: int = RATED_DOCUMENTS) -> DataFrame:
    """(doc_id, level_no, unfamiliar_share, words_per_sentence) of every English text of at least LEAST_WORDS words.

    Familiar words are those that the most documents of the corpus hold. The formula gives each
    sentence a level from its share of unfamiliar words and its length; the level of a document is
    the one that most of its words stand in, so that a stray sentence or an inserted passage doesn't
    move it (ties go to the lower level). The formula is fitted to at most `most_rated` rated documents;
    everything else covers all documents. A document written twice has
    one row (of its lowest level, if its texts differ). Without a usable rating, or without documents, the result is empty.
    """
    spark = documents.sparkSession
    cut = stored(document_words(documents), "sentences")
    rank = {w: i for i, w in enumerate(familiar_words(cut, max(sizes)))}
    drawn = rated_levels(labels).join(cut.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most_rated)  # ids and levels only
    rated = stored(drawn, "rated").join(cut, "doc_id")
    shared_rank = spark.sparkContext.broadcast((rank, sizes))

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, lists = shared_rank.value
        for frame in frames:
            rows = []
            for level, sentences in zip(frame["level_no"], frame["sentences"]):
                own = [s.split(" ") for s in sentences]
                total = sum(map(len, own))
                rows += [(level, len(w) / total, sentence_features(w, known, lists)) for w in own]
            yield pd.DataFrame(rows, columns=["level_no", "weight", "x"])

    # what reaches the driver is bounded: one rated text gives at most SENTENCES of its sentences
    mixed = F.array_sort(F.transform("sentences", lambda s: F.struct(F.xxhash64(s, F.lit(11)).alias("h"), s.alias("s"))))
    sample = rated.select("level_no", F.transform(F.slice(mixed, 1, SENTENCES), lambda x: x["s"]).alias("sentences"))
    fit = sample.mapInPandas(features, "level_no long, weight double, x array<double>").toPandas()
    kind = documents.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, level_no long, unfamiliar_share double, words_per_sentence double"
    if not len(fit):
        return spark.createDataFrame([], result)
    formula = LevelFormula(np.array(fit["x"].tolist()), fit["level_no"].to_numpy(), fit["weight"].to_numpy())
    shared = spark.sparkContext.broadcast(formula)

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, lists = shared_rank.value
        use = shared.value
        for whole in frames:
            for at in range(0, len(whole), 512):
                frame = whole.iloc[at : at + 512]
                own = [[s.split(" ") for s in sentences] for sentences in frame["sentences"]]
                counts = np.array([len(x) for x in own])
                x = np.array([sentence_features(w, known, lists) for sentences in own for w in sentences])
                words = np.array([len(w) for sentences in own for w in sentences], float)
                which = np.repeat(np.arange(len(own)), counts)
                votes = np.zeros((len(own), len(use.levels)))
                np.add.at(votes, (which, use.shares(x).argmax(axis=1)), words)
                total = votes.sum(axis=1)
                strange = np.zeros(len(own))
                np.add.at(strange, which, x[:, len(lists) - 1] * words)
                yield pd.DataFrame(
                    {"doc_id": frame["doc_id"].to_numpy(), "level_no": use.levels[votes.argmax(axis=1)].astype(np.int64), "unfamiliar_share": strange / total, "words_per_sentence": total / counts}
                )

    one = cut.mapInPandas(rate, result).groupBy("doc_id").agg(F.min(F.struct("level_no", "unfamiliar_share", "words_per_sentence")).alias("x"))
    return one.select("doc_id", "x.*")
