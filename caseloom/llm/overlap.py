"""Same or near-same reports across splits: minwise hashing, banded buckets, exact verification."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.llm.splits import shared_key
from caseloom.session import stored

WORD = regex.compile(r"[^\W_]+")
BANDS, ROWS = 40, 9  # a pair of similarity j is missed with probability (1 - j**ROWS)**BANDS: 0.3 % at 0.8, 0.08 % at 0.818
_MIX = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: str) -> list[str]:
    """Words without case, punctuation, spacing or compatibility forms."""
    return WORD.findall(unicodedata.normalize("NFKC", text).casefold())


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def counted(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct items of a bag: the k-th occurrence of a word is an item of its own."""
    ordered = np.sort(hashes)
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    nth = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered))))
    mixed = (ordered ^ (nth.astype(np.uint64) * _MIX)) * _MIX
    return np.sort(mixed ^ (mixed >> np.uint64(29)))


def least_hashes(items: np.ndarray, factors: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """BANDS * ROWS minwise hashes of 32 bits."""
    short = (items >> np.uint64(32)).astype(np.uint32)
    least = None
    for at in range(0, len(short), 256):  # long texts in slices, so that memory stays flat
        hashed = short[at : at + 256, None] * factors
        hashed += offsets
        least = hashed.min(axis=0) if least is None else np.minimum(least, hashed.min(axis=0))
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row of a matrix of minwise hashes, row by row."""
    rows = least.astype(np.uint64).reshape(len(least), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) * _MIX, rows.shape[:2])
    for k in range(ROWS):
        keys = (keys ^ rows[:, :, k]) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(31)
    return keys.ravel()


def report_bags(reports: DataFrame) -> DataFrame:
    """(study_id, class_id, items) per report row; text columns findings and impression.

    class_id stands for the exact bag of words: equal bags share it. Reports without a word have no row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):  # few whole texts are Python objects at a time
                ids, classes, items = [], [], []
                for study, findings, impression in zip(*(c.to_pylist() for c in whole.slice(at, 512).columns)):
                    words = plain_words(f"{findings or ''}\n{impression or ''}")
                    if not words:
                        continue
                    if len(memo) > 1_000_000:
                        memo.clear()
                    bag = counted(np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)))
                    ids.append(study)
                    classes.append(xxhash.xxh3_128_digest(bag.tobytes()))
                    items.append(bag.view(np.int64))
                columns = [pa.array(ids, pa.string()), pa.array(classes, pa.binary()), pa.array(items, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["study_id", "class_id", "items"])

    return reports.select("study_id", "findings", "impression").mapInArrow(cut, "study_id string, class_id binary, items array<long>")


def marked(numbers: DataFrame) -> dict[int, bytes]:
    """A set of row numbers as bitmaps of 32,768 numbers each: a bit a report at most, so that it can be broadcast."""
    place = F.col("number") + 1  # Spark's buckets begin at 1
    got = numbers.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).toArrow()
    return dict(zip((b - 1 for b in got.column("b").to_pylist()), got.column("bits").to_pylist()))


def _holds(bitmaps: dict[int, bytes], numbers: np.ndarray) -> np.ndarray:
    buckets = numbers >> 15
    out = np.zeros(len(numbers), bool)
    for b in np.unique(buckets):
        if b in bitmaps:
            rows = buckets == b
            out[rows] = np.unpackbits(np.frombuffer(bitmaps[b], np.uint8), bitorder="little")[numbers[rows] & 32767]
    return out


def picked(reports: DataFrame, numbers: DataFrame) -> DataFrame:
    """(number, class_id, items) of the reports with these numbers; they are picked where reports are read, so that no other items move."""
    shared = reports.sparkSession.sparkContext.broadcast(marked(numbers))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_holds(shared.value, batch.column(0).to_numpy())))

    return reports.select("number", "class_id", "items").mapInArrow(pick, "number long, class_id binary, items array<long>")


def short_marks(bags: DataFrame) -> DataFrame:
    """(number, marks): the first 16 bits of every item of a bag, as sorted binary, a quarter of the items' size."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [(bag.values.to_numpy().view(np.uint64) >> np.uint64(48)).astype("<u2").tobytes() for bag in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.binary())], names=["number", "marks"])

    return bags.select("number", "items").mapInArrow(cut, "number long, marks binary")


def possible_pairs(pairs: DataFrame, marks: DataFrame, least: float) -> DataFrame:
    """The pairs (x, y) whose bags can have a Jaccard similarity of `least`: equal items have equal marks, so common marks, as often as both bags hold them, are no fewer than common items."""

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                bags, sizes = [], []
                for c in (2, 3):
                    size = np.array([len(v) // 2 for v in batch.column(c).to_pylist()], np.int64)
                    values = np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").astype(np.int64)
                    bags.append(np.unique((np.repeat(np.arange(len(size)), size) << 16) | values, return_counts=True))
                    sizes.append(size)
                both, i, j = np.intersect1d(bags[0][0], bags[1][0], assume_unique=True, return_indices=True)
                common = np.bincount(both >> 16, np.minimum(bags[0][1][i], bags[1][1][j]), batch.num_rows)
                fits = common / np.maximum(sizes[0] + sizes[1] - common, 1) >= least
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(fits)) for c in (0, 1)], names=["x", "y"])

    held = pairs.join(marks.select(F.col("number").alias("x"), F.col("marks").alias("a")), "x").join(marks.select(F.col("number").alias("y"), F.col("marks").alias("b")), "y")
    return held.select("x", "y", "a", "b").mapInArrow(test, "x long, y long")


def class_bands(classes: DataFrame, seed: int = 7) -> DataFrame:
    """(number, band) with BANDS rows of each class; classes has number and items."""
    draws = np.random.default_rng(seed)
    factors = draws.integers(1, 2**32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
    offsets = draws.integers(0, 2**32, BANDS * ROWS, dtype=np.uint32)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                keys = band_keys(np.stack([least_hashes(bag.values.to_numpy().view(np.uint64), factors, offsets) for bag in batch.column(1)]))
                spread = pa.array(np.repeat(np.arange(batch.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(spread), pa.array(keys.view(np.int64))], names=["number", "band"])

    return classes.select("number", "items").mapInArrow(sign, "number long, band long")


def study_sides(splits: DataFrame, train: str, evaluation: list[str]) -> DataFrame:
    """(study_id, split_name, is_train), one row per study and split; studies without a known split have none."""
    name = F.lower(F.trim("split_name"))
    rows = splits.select(shared_key(F.col("study_id")).alias("study_id"), name.alias("split_name"))
    rows = rows.where(F.col("split_name").isin([train, *evaluation]) & F.col("study_id").isNotNull()).distinct()
    return rows.withColumn("is_train", F.col("split_name") == train)


def similar_classes(reports: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs (train_class, eval_class, jaccard) of different bags whose exact Jaccard similarity is at least `least`.

    reports has number (unique, for short keys), class_id, items; classes has the number of one report of each class, in_train, in_eval. Only pairs across the sides are formed: the
    join of a bucket is between its train and its evaluation classes. Most pairs of a bucket aren't similar: short marks of
    the bags leave those that can be, and the items move for these only.
    """
    sides = [class_bands(picked(reports, classes.where(side).select("number"))) for side in ("in_train", "in_eval")]
    left, right = sides[0].select("band", F.col("number").alias("x")), sides[1].select("band", F.col("number").alias("y"))
    pairs = stored(left.join(right, "band").where("x <> y").select("x", "y").distinct(), "candidates")
    marks = short_marks(picked(reports, pairs.select(F.explode(F.array("x", "y")).alias("number"))))
    pairs = stored(possible_pairs(pairs, marks, least), "possible")
    bags = picked(reports, pairs.select(F.explode(F.array("x", "y")).alias("number")))
    both = pairs.join(bags.select(F.col("number").alias("x"), F.col("class_id").alias("train_class"), F.col("items").alias("a")), "x")
    both = both.join(bags.select(F.col("number").alias("y"), F.col("class_id").alias("eval_class"), F.col("items").alias("b")), "y")
    common = F.size(F.array_intersect("a", "b"))
    sized = both.select("train_class", "eval_class", common.alias("i"), (F.size("a") + F.size("b")).alias("n"))
    return sized.select("train_class", "eval_class", (F.col("i") / (F.col("n") - F.col("i"))).alias("jaccard")).where(F.col("jaccard") >= least)


EVALUATION = ("calibration", "validation", "test")


class Overlap:
    """What the two sides of a split have in common, before it is spread over studies.

    members: (study_id, split_name, is_train, key), where a key is an exact bag of words, or a listed cluster;
    links: (train_key, eval_key) of bags that are equal or similar, and of clusters.

    The items compared are the words of a report as a bag (shingles of one word, numbered by occurrence), as sentence order and the border between the
    fields don't matter: bags that agree up to a tenth of the longer have a Jaccard similarity of at
    least 0.818. Equal bags form a class; minwise hashes are made and compared once per class, so groups of copies cost no hashing and no verification. Null and empty texts only
    match by cluster; repeated rows change nothing; a study without a split, or empty tables, give nothing.
    """

    def __init__(self, cases: DataFrame, splits: DataFrame, clusters: DataFrame, train: str = "train", evaluation: tuple[str, ...] = EVALUATION, least: float = 0.8):
        sides = study_sides(splits, train, list(evaluation))
        reports = cases.select(shared_key(F.col("study_id")).alias("study_id"), "findings", "impression")
        # reports without a split are cut as well, which is cheaper than a shuffle of all texts
        signed = stored(report_bags(reports).withColumn("number", F.monotonically_increasing_id()), "reports")
        written = signed.groupBy("study_id", "class_id").agg(F.min("number").alias("number")).join(sides, "study_id")
        flags = written.groupBy("class_id").agg(F.min("number").alias("number"), F.max("is_train").alias("in_train"), F.max(~F.col("is_train")).alias("in_eval"))
        flags, written = stored(flags, "classes"), written.drop("number")
        near = similar_classes(signed, flags, least).select("train_class", "eval_class")
        same = flags.where("in_train and in_eval").select(F.col("class_id").alias("train_class"), F.col("class_id").alias("eval_class"))
        listed = clusters.select(shared_key(F.col("case_id")).alias("study_id"), F.encode("cluster_id", "utf-8").alias("key")).where("key is not null").distinct()
        placed = listed.join(sides, "study_id")
        met = placed.groupBy("key").agg(F.max("is_train").alias("t"), F.max(~F.col("is_train")).alias("e")).where("t and e")
        bag, cluster = F.lit(b"b"), F.lit(b"c")  # a bag and a cluster never share a key
        columns = ["study_id", "split_name", "is_train"]
        self.members = written.select(*columns, F.concat(bag, "class_id").alias("key")).unionByName(placed.select(*columns, F.concat(cluster, "key").alias("key")))
        by_text = near.unionByName(same).select(F.concat(bag, "train_class").alias("train_key"), F.concat(bag, "eval_class").alias("eval_key"))
        by_cluster = met.select(F.concat(cluster, "key").alias("train_key"), F.concat(cluster, "key").alias("eval_key"))
        self.links = by_text.unionByName(by_cluster)


def cross_split_pairs(cases: DataFrame, splits: DataFrame, clusters: DataFrame, **settings) -> DataFrame:
    """(train_study, eval_study, split_name) for reports that occur the same or nearly so on both sides, or in one cluster.

    Settings and cases are those of Overlap. Classes are spread over their studies at the end; as the result lists pairs of studies, its rows grow with the square of a group of copies.
    """
    both = Overlap(cases, splits, clusters, **settings)
    left = both.members.where("is_train").select(F.col("key").alias("train_key"), F.col("study_id").alias("train_study"))
    right = both.members.where("not is_train").select(F.col("key").alias("eval_key"), F.col("study_id").alias("eval_study"), "split_name")
    pairs = both.links.join(left, "train_key").join(right, "eval_key").select("train_study", "eval_study", "split_name")
    return pairs.where("train_study <> eval_study").distinct()


def overlap_report(cases: DataFrame, splits: DataFrame, clusters: DataFrame, **settings) -> DataFrame:
    """(split_name, source, n_pairs, n_train_studies, n_eval_studies): the pairs of cross_split_pairs by evaluation split and source of the train study, without listing them.

    Studies of the same bags and clusters share a profile, and pairs of profiles are weighed by how many studies they have on either side; a study on
    both sides has a profile of its own, as it is no partner of itself. A study's source is its smallest non-null one.
    """
    both = Overlap(cases, splits, clusters, **settings)
    members = stored(both.members, "members")
    twice = members.groupBy("study_id").agg(F.count_distinct("is_train").alias("n")).where("n > 1").select("study_id", F.lit(True).alias("twice"))
    keys = members.select("study_id", "key").distinct()
    marks = [F.bit_xor(F.xxhash64("key")).alias("x"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y"), F.count(F.lit(1)).alias("n")]
    profiles = keys.groupBy("study_id").agg(*marks).join(twice, "study_id", "left")
    profiles = profiles.select("study_id", F.struct("x", "y", "n", F.when(F.col("twice"), F.col("study_id")).alias("s")).alias("profile"))
    source = cases.select(shared_key(F.col("study_id")).alias("study_id"), "source").groupBy("study_id").agg(F.min("source").alias("source"))
    studies = members.select("study_id", "split_name", "is_train").distinct().join(profiles, "study_id").join(source, "study_id", "left")
    studies = stored(studies.groupBy("profile", "split_name", "is_train", "source").agg(F.count(F.lit(1)).alias("n_studies")), "profiles")
    of = stored(keys.join(profiles, "study_id").select("key", "profile").distinct(), "profile-keys")
    pairs = both.links.join(of.select(F.col("key").alias("train_key"), F.col("profile").alias("a")), "train_key")
    pairs = pairs.join(of.select(F.col("key").alias("eval_key"), F.col("profile").alias("b")), "eval_key").select("a", "b").distinct()
    pairs = pairs.where("a.s is null or b.s is null or a.s <> b.s")
    left = studies.where("is_train").groupBy(F.col("profile").alias("a"), "source").agg(F.sum("n_studies").alias("n_a"))
    right = studies.where("not is_train").groupBy(F.col("profile").alias("b"), "split_name").agg(F.sum("n_studies").alias("n_b"))
    spread = stored(pairs.join(left, "a").join(right, "b"), "profile-pairs")
    counts = spread.groupBy("split_name", "source").agg(F.sum(F.col("n_a") * F.col("n_b")).alias("n_pairs"))
    trained = spread.select("a", "source", "split_name", "n_a").distinct().groupBy("split_name", F.col("source").alias("s")).agg(F.sum("n_a").alias("n_train_studies"))
    asked = spread.select("b", "source", "split_name", "n_b").distinct().groupBy("split_name", F.col("source").alias("s")).agg(F.sum("n_b").alias("n_eval_studies"))
    for part in (trained, asked):
        counts = counts.join(part.withColumnRenamed("split_name", "p"), (F.col("p") == F.col("split_name")) & F.col("s").eqNullSafe(F.col("source"))).drop("p", "s")
    return counts.select("split_name", "source", "n_pairs", "n_train_studies", "n_eval_studies")
