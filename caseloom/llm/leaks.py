"""Evaluation texts inside training text: a positional inverted index, phrases from their rarest terms, then proximity."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.session import stored

WORD = regex.compile(r"[^\W_]+")
ASCII_WORD = re.compile(r"[a-z0-9]+")
TAG = regex.compile(r"<[!/]?\p{L}[^<>]*>")
HIDDEN = regex.compile(r"[\p{Cf}\p{Mn}]+")
PHRASE = 5  # words of an aligned phrase of an item
RARE = 2  # rarest pairs of adjacent words of a phrase that are looked up in the index
ITEM_WORDS = 2_000_000  # most words of items that one pass broadcasts; more items take more passes


def words_of(text: str | None) -> list[str]:
    """Words without case, punctuation, mark-up, invisible signs or compatibility forms."""
    if not text:
        return []
    plain = TAG.sub(" ", html.unescape(text)) if "<" in text or "&" in text else text
    if plain.isascii():  # neither invisible signs nor compatibility forms
        return ASCII_WORD.findall(plain.lower())
    return WORD.findall(HIDDEN.sub("", unicodedata.normalize("NFKC", plain)).casefold())


class _Terms(dict):
    """64-bit terms of words, remembered."""

    def __missing__(self, word: str) -> int:
        term = self[word] = int(np.uint64(xxhash.xxh64_intdigest(word)).astype(np.int64))
        return term


def term_positions(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, terms): the 64-bit terms of a text in order of position; null keys and texts without words drop out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Terms()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # few whole texts are Python objects at a time
                batch = whole.slice(at, 256)
                keys, terms = [], []
                for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    words = words_of(t)
                    if k is None or not words:
                        continue
                    if len(memo) > 500_000:
                        memo.clear()
                    keys.append(k)
                    terms.append(np.fromiter(map(memo.__getitem__, words), np.int64, len(words)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field(0).type), pa.array(terms, pa.list_(pa.int64()))], names=[key, "terms"])

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, F.col(text).cast("string")).mapInArrow(cut, f"`{key}` {kind}, terms array<long>")


def adjacent_pairs(terms) -> Column:
    """Terms of adjacent words: the index is kept over these, as their lists are far shorter than those of single words."""
    n = F.size(terms) - 1
    return F.zip_with(F.slice(terms, 1, n), F.slice(terms, 2, n), lambda a, b: F.xxhash64(a, b))


def item_phrases(items: DataFrame, frequency: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Phrases of PHRASE successive words at every PHRASE-th position of an item, and their rarest terms.

    Gives (item_id, at, phrase) and (phrase, place, pair) with the RARE rarest pairs of each phrase by
    document frequency. A passage of 20 words with two changes holds an unchanged phrase, as does any
    longer one with one change in ten.
    """
    starts = F.transform(F.sequence(F.lit(0), (F.size("terms") / PHRASE).cast("int") - 1), lambda i: i * PHRASE)
    cut = items.where(F.size("terms") >= PHRASE).select("item_id", "terms", F.explode(starts).alias("at"))
    cut = cut.select("item_id", "at", F.slice("terms", F.col("at") + 1, PHRASE).alias("words")).withColumn("phrase", F.xxhash64("words"))
    places = cut.select("phrase", "words").dropDuplicates(["phrase"])
    places = places.select("phrase", F.posexplode(adjacent_pairs(F.col("words"))).alias("place", "pair"))
    ranked = places.join(frequency, "pair")  # a pair that no document has rules its phrase out
    order = Window.partitionBy("phrase").orderBy("df", "place")
    ranked = ranked.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("phrase")))
    return cut.select("item_id", "at", "phrase"), ranked.where((F.col("n") == PHRASE - 1) & (F.col("r") <= RARE)).select("phrase", "place", "pair")


def _reach(a: np.ndarray, b: np.ndarray, most: int) -> list[int]:
    """How many words of a can be matched from its start against the start of b, with 0, 1, ... most changed, missing or added words."""

    def slide(i: int, j: int) -> int:
        n = min(len(a) - i, len(b) - j)
        if n <= 0:
            return i
        differs = np.flatnonzero(a[i : i + n] != b[j : j + n])
        return i + (int(differs[0]) if len(differs) else n)

    front, out = {0: slide(0, 0)}, []
    for _ in range(most + 1):
        out.append(max(front.values()))
        step: dict[int, int] = {}
        for lead, i in front.items():  # lead: how far b is ahead of a
            for l2, i2 in ((lead, i + 1), (lead + 1, i), (lead - 1, i + 1)):
                if i2 <= len(a) and 0 <= i2 + l2 <= len(b):
                    step[l2] = max(step.get(l2, -1), i2)
        front = {lead: slide(i, i + lead) for lead, i in step.items()} or front
    return out


def longest_passage(item: np.ndarray, document: np.ndarray, at: int, start: int, share: float) -> int:
    """Words of the longest passage of the item around the phrase at `at` (at `start` in the document) of which at most `share` is changed."""
    if start < 0 or start + PHRASE > len(document) or not np.array_equal(item[at : at + PHRASE], document[start : start + PHRASE]):
        return 0
    most = int(len(item) * share)
    span = len(item) + most
    right = _reach(item[at + PHRASE :], document[start + PHRASE : start + PHRASE + span], most)
    left = _reach(item[:at][::-1], document[max(0, start - span) : start][::-1], most)
    best = 0
    for x, reach in enumerate(left):
        for y in range(most + 1 - x):
            n = PHRASE + reach + right[y]
            if (x + y) <= n * share:
                best = max(best, n)
    return best


class ItemWindows:
    """The items of one pass, and which of their places may hold a passage around a phrase that a document has.

    Some `least` successive words of a passage hold an unchanged phrase and at most `changes` changed, missing or added words. They lie
    within least - PHRASE words before and least words after the phrase's start, on diagonals at most `changes` off the phrase's own.
    So fewer than least - changes words that stand on those diagonals in the document rule a place out.
    """

    def __init__(self, rows: list[tuple], phrases: list[tuple], least: int, share: float):
        self.items = [r[0] for r in rows]
        self.terms = [np.array(r[1], np.int64) for r in rows]
        self.changes = int(least * share + 1e-9) + 1
        self.need, self.back, self.wide = least - self.changes, least - PHRASE, 2 * least - PHRASE
        edge = self.wide + self.changes
        starts = np.cumsum([0, *[len(t) + edge for t in self.terms]])[:-1] + edge
        self.flat = np.zeros(int(sum(len(t) + edge for t in self.terms)) + 2 * edge, np.int64)
        for at, t in zip(starts, self.terms):
            self.flat[at : at + len(t)] = t
        number: dict = {}
        for i, item in enumerate(self.items):
            number.setdefault(item, []).append(i)
        listed = sorted((phrase, i, at) for item, at, phrase in phrases for i in number[item] if at + PHRASE <= len(self.terms[i]))
        self.phrase = np.array([x[0] for x in listed], np.int64)
        self.of = np.array([x[1] for x in listed], np.int64)
        self.at = np.array([x[2] for x in listed], np.int64)
        self.place = starts[self.of] + self.at if len(listed) else np.zeros(0, np.int64)

    def candidates(self, terms: np.ndarray, phrase: np.ndarray, start: np.ndarray, block: int = 4096) -> Iterator[tuple[int, int, int]]:
        """(item number, place in the item, number of the spot) of the places that are left.

        terms are the words of some documents end to end, phrase and start the spots in them; words of the document before or after only let more places through.
        """
        low, high = np.searchsorted(self.phrase, phrase), np.searchsorted(self.phrase, phrase, "right")
        upto = np.cumsum(high - low)
        edge = self.wide + self.changes
        padded = np.full(len(terms) + 2 * edge, -1, np.int64)
        padded[edge : edge + len(terms)] = terms
        for begin in range(0, int(upto[-1]) if len(upto) else 0, block):
            n = np.arange(begin, min(begin + block, upto[-1]))
            spot = np.searchsorted(upto, n, "right")
            pick = high[spot] - (upto[spot] - n)
            asked = self.flat[(self.place[pick] - self.back)[:, None] + np.arange(self.wide)]
            there = padded[(start[spot] + edge - self.back - self.changes)[:, None] + np.arange(self.wide + 2 * self.changes)]
            met = np.zeros(asked.shape, bool)
            for shift in range(2 * self.changes + 1):
                met |= asked == there[:, shift : shift + self.wide]
            left = np.flatnonzero(met.sum(axis=1) >= self.need)
            yield from zip(self.of[pick[left]].tolist(), self.at[pick[left]].tolist(), spot[left].tolist())


def leaked_items(documents: DataFrame, items: DataFrame, least: int = 20, share: float = 0.1) -> DataFrame:
    """(doc_id, item_id, words): every document that holds at least `least` successive words of an item, of which at most `share` is changed, missing or added.

    Words changed at the ends of a passage count as part of it: 18 unchanged words can be a passage of 20. words is the length of the longest passage.

    The index's terms are pairs of adjacent words. Documents become lists of words in order of position, stored once; document frequencies of
    the items' pairs tell the rarest pairs of each phrase of an item, and the postings (pair, document, position) of those are stored once, in
    the order of pairs. Postings, moved back by a pair's place in its phrase, are intersected by (document, phrase, start). Around the places that are
    left, the words on diagonals near the phrase's own are counted, and what has enough of them is compared word by word.
    Whole documents are used. A posting list of any length is spread over tasks, as postings are joined to the short list of pairs where the
    documents are read, and combined before they are shuffled. Items are compared in passes of at most ITEM_WORDS words. Null or empty texts on
    either side, and null ids, give nothing; repeated rows change nothing; empty tables give an empty result. Least words and share must be such
    that a passage keeps an unchanged aligned phrase, as 20 and a tenth do.
    """
    if (least - PHRASE + 1) // PHRASE <= int(least * share + 1e-9):
        raise ValueError("a passage may be left without an unchanged phrase: ask for more words or a smaller share of changes")
    held = stored(term_positions(documents, "doc_id", "text"), "positions")  # repeated rows only repeat what is found
    asked = stored(term_positions(items.select(F.col("item_id"), "text").dropDuplicates(["item_id", "text"]), "item_id", "text"), "items")
    both = F.size("terms") > 1
    vocabulary = asked.where(both).select(F.explode(adjacent_pairs(F.col("terms"))).alias("pair")).distinct()
    frequency = held.where(both).select(F.explode(F.array_distinct(adjacent_pairs(F.col("terms")))).alias("pair"))
    frequency = stored(frequency.join(vocabulary, "pair", "left_semi").groupBy("pair").agg(F.count(F.lit(1)).alias("df")), "frequency")
    phrases, rare = item_phrases(asked, frequency)
    phrases, rare = stored(phrases, "phrases"), stored(rare, "rare")
    postings = held.where(both).select("doc_id", F.posexplode(adjacent_pairs(F.col("terms"))).alias("pos", "pair"))
    postings = stored(postings.join(rare.select("pair").distinct(), "pair", "left_semi").sortWithinPartitions("pair", "doc_id", "pos"), "postings")
    hits = postings.join(rare, "pair").select("doc_id", "phrase", (F.col("pos") - F.col("place")).alias("start")).where("start >= 0")
    hits = hits.groupBy("doc_id", "phrase", "start").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= RARE).select("doc_id", "phrase", "start")

    size = asked.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    passes = max(1, -(-size // ITEM_WORDS))
    hits = stored(hits, "hits") if passes > 1 else hits
    found = None
    for k in range(passes):
        own = F.pmod(F.xxhash64("item_id"), F.lit(passes)) == k
        rows = _verified(held, hits, asked.where(own), phrases.where(own), least, share)
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _verified(held: DataFrame, hits: DataFrame, asked: DataFrame, phrases: DataFrame, least: int, share: float) -> DataFrame:
    """(doc_id, item_id, words) of the passages around the hits of one pass; its items are bounded by ITEM_WORDS."""
    spark = held.sparkSession
    windows = ItemWindows([tuple(r) for r in asked.select("item_id", "terms").collect()], [tuple(r) for r in phrases.select("item_id", "at", "phrase").collect()], least, share)
    shared = spark.sparkContext.broadcast(windows)
    places = hits.groupBy("doc_id").agg(F.collect_list("phrase").alias("phrases"), F.collect_list("start").alias("starts"))
    kind = {"doc_id": held.schema["doc_id"].dataType.simpleString(), "item_id": asked.schema["item_id"].dataType.simpleString()}
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = [arrow[kind["doc_id"]], arrow[kind["item_id"]], pa.int32()]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, 256):
                ids, phrases, starts, words = whole.slice(first, 256).columns
                base = words.offsets.to_numpy() - words.offsets[0].as_py()
                terms, start = words.flatten().to_numpy(), starts.flatten().to_numpy().astype(np.int64)
                document = np.repeat(np.arange(len(ids)), np.diff(phrases.offsets.to_numpy()))
                best: dict[tuple[int, int], int] = {}
                for item, at, spot in of.candidates(terms, phrases.flatten().to_numpy(), base[document] + start):
                    d = int(document[spot])
                    if best.get((d, item), 0) < len(of.terms[item]):
                        n = longest_passage(of.terms[item], terms[base[d] : base[d + 1]], at, int(start[spot]), share)
                        best[d, item] = max(best.get((d, item), 0), n)
                out = [(ids[d].as_py(), of.items[item], n) for (d, item), n in best.items() if n >= least]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=["doc_id", "item_id", "words"])

    rows = places.join(held, "doc_id").select("doc_id", "phrases", "starts", "terms")
    return rows.mapInArrow(verify, f"doc_id {kind['doc_id']}, item_id {kind['item_id']}, words int")
