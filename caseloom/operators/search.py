"""Lexical and dense search of a stated query set against whole collections."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import ascii_tokens
from caseloom.operators.rank import ranked
from caseloom.operators.skew import join_one_per_key
from caseloom.session import stored

K1, B = 1.5, 0.75  # fixed values of the ranking function


def term_counts(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): term frequencies and text lengths; texts without a token have no row."""
    cut = texts.select(F.col(key).alias("key"), ascii_tokens(F.col(text)).alias("tokens"))
    return cut.select("key", F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("key", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


EVERY = ""  # stands for the text itself among its terms; no token is empty


def query_postings(texts: DataFrame, key: str, text: str, terms: DataFrame, scope: str | None = None) -> DataFrame:
    """(key, term, dl, tf) of the given terms, stored once; and one row of the term EVERY for each text, the empty ones too. Texts are cut once.

    Only postings of the given terms leave the scan: they filter before the shuffle.
    """
    also = [F.col(scope).alias("_scope")] if scope else []
    source = texts.select(F.col(key).alias("key"), *also, ascii_tokens(F.col(text)).alias("tokens"))
    rows = source.select("key", *(["_scope"] if scope else []), F.size("tokens").alias("dl"), F.explode(F.concat("tokens", F.array(F.lit(EVERY)))).alias("term"))
    wanted = terms.select("term").distinct().unionAll(texts.sparkSession.createDataFrame([(EVERY,)], "term string"))
    return stored(rows.join(wanted, "term", "left_semi").groupBy("key", "term", "dl", *(["_scope"] if scope else [])).agg(F.count(F.lit(1)).alias("tf")), "postings")


def bm25_scores(queries: DataFrame, texts: DataFrame, query: str, query_text: str, key: str, text: str, scope: tuple[str, str] | None = None) -> DataFrame:
    """(query, key, score) for every text that shares a term with the query; repeated query terms count repeatedly.

    idf = ln(1 + (N - df + 0.5)/(df + 0.5)), statistics over all texts, even for scoped search.
    scope (column of queries, column of texts) restricts each query to the texts with an equal value.
    """
    asked = queries.select(F.col(query), *([F.col(scope[0]).alias("_scope")] if scope else []), F.explode(ascii_tokens(F.col(query_text))).alias("term"))
    asked = asked.groupBy(query, "term", *(["_scope"] if scope else [])).agg(F.count(F.lit(1)).alias("qtf"))
    every = query_postings(texts, key, text, asked, scope[1] if scope else None)
    postings = every.where(F.col("term") != EVERY)
    size = every.where(F.col("term") == EVERY).agg(F.sum("tf").alias("n"), (F.sum(F.col("dl") * F.col("tf")) / F.sum("tf")).alias("avgdl"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = df.join(F.broadcast(size)).select("term", idf.alias("idf"), "avgdl")  # size is one row
    terms = asked.join(weighted, "term")
    hits = postings.join(terms, ["term", "_scope"] if scope else ["term"])
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query, F.col("key").alias(key)).agg(F.sum(part).alias("score"))


def leave_one_out_scores(queries: DataFrame, texts: DataFrame, query: str, query_text: str, key: str, text: str) -> DataFrame:
    """(query, key, score) as bm25_scores, where a query is itself a text's key: that text is neither scored nor counted in the statistics.

    Frequencies, number and mean length are those of all texts less the query's own, so nothing is counted anew per query.
    """
    asked = queries.select(F.col(query), F.explode(ascii_tokens(F.col(query_text))).alias("term")).groupBy(query, "term").agg(F.count(F.lit(1)).alias("qtf"))
    every = query_postings(texts, key, text, asked)
    postings, lengths = every.where(F.col("term") != EVERY), every.where(F.col("term") == EVERY).select("key", "dl")
    size = lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("total"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = postings.select(F.col("key").alias(query), "term", F.lit(1).alias("held"))
    rows = asked.join(df, "term").join(lengths.select(F.col("key").alias(query), F.col("dl").alias("own")), query).join(own, [query, "term"], "left").join(F.broadcast(size))  # size is one row
    n, held = F.col("n") - 1, F.col("df") - F.coalesce("held", F.lit(0))
    terms = rows.select(query, "term", "qtf", F.log(1 + (n - held + 0.5) / (held + 0.5)).alias("idf"), ((F.col("total") - F.col("own")) / n).alias("avgdl"))
    hits = postings.join(terms, "term").where(F.col("key") != F.col(query))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy(query, F.col("key").alias(key)).agg(F.sum(part).alias("score"))


def top_with_fill(scores: DataFrame, queries: DataFrame, texts: DataFrame, query: str, key: str, k: int) -> DataFrame:
    """Top k per query, where texts without a score follow with 0.0 in the order of their key.

    Only the k first keys can be needed as fillers, so the fill costs k rows a query.
    """
    best = ranked(scores.withColumn("score", F.round("score", 9)), query, key, "score", k)
    first = texts.select(key).orderBy(key).limit(k)
    fill = queries.select(query).distinct().join(F.broadcast(first))  # k rows
    fill = fill.join(best.select(query, key), [query, key], "left_anti").withColumn("score", F.lit(0.0))
    return ranked(best.select(query, key, "score").unionByName(fill.select(query, key, "score")), query, key, "score", k)


def tfidf_scores(queries: DataFrame, texts: DataFrame, query: str, query_text: str, key: str, text: str) -> DataFrame:
    """(query, key, score): cosine of tf/length · (ln((1+N)/(1+df)) + 1) vectors; unknown query terms weigh 0.

    Texts are cut and counted once. All terms are needed for the lengths of the vectors only; the products meet the queries' terms before anything is shuffled.
    """
    counts = stored(term_counts(texts, key, text), "counts")
    n = texts.agg(F.count(F.lit(1)).alias("n"))
    idf = document_frequencies(counts).join(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # n is one row
    idf = stored(idf, "idf")
    weigh = lambda rows: rows.withColumn("w", F.col("tf") / F.col("dl") * F.col("idf"))
    norms = weigh(join_one_per_key(counts, idf, "term")).groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = term_counts(queries.select(F.col(query).alias("q"), F.col(query_text).alias("t")), "q", "t")
    asked = stored(asked.join(idf, "term").select(F.col("key").alias("q"), "term", "idf", (F.col("tf") / F.col("dl") * F.col("idf")).alias("qw")), "asked")
    qnorms = asked.groupBy("q").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qnorm"))
    sums = weigh(counts.join(asked, "term")).groupBy("q", "key").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    whole = sums.join(norms, "key").join(qnorms, "q")
    return whole.select(F.col("q").alias(query), F.col("key").alias(key), (F.col("dot") / (F.col("norm") * F.col("qnorm"))).alias("score"))


def dense_top_k(queries: DataFrame, bank: DataFrame, query: str, key: str, vector: str, k: int, block: int = 50_000) -> DataFrame:
    """(query, key, score, rank): the k best cosines of every query vector with other bank vectors, to nine places, equal ones by the smaller key.

    The query set is a stated one (a hundredth of the bank). It is asked in blocks of at most about `block` vectors, which are broadcast; the bank is
    scanned once per block and never shuffled: every task keeps k keys per query. Zero vectors score 0; null and misshapen vectors, and null keys, drop out.
    """
    spark = bank.sparkSession
    wide = lambda df, name: F.col(name).cast("bigint") if df.schema[name].dataType.simpleString() in ("tinyint", "smallint", "int") else F.col(name)
    usable = lambda df, name: df.where(F.col(name).isNotNull() & F.col(vector).isNotNull()).select(wide(df, name).alias(name), F.col(vector).cast("array<double>").alias("v")).where(~F.exists("v", lambda x: x.isNull()))
    asked, held = usable(queries, query), usable(bank, key)
    kinds = [asked.schema[query].dataType.simpleString(), held.schema[key].dataType.simpleString()]
    passes = max(1, -(-asked.count() // block))
    found = None
    for i in range(passes):
        got = asked.where(F.pmod(F.xxhash64(query), F.lit(passes)) == i).toArrow()
        shared = spark.sparkContext.broadcast((got.column(query).to_pylist(), _unit(got.column("v").combine_chunks())))
        rows = held.mapInArrow(lambda batches, shared=shared: _best_of_task(batches, *shared.value, k), f"`{query}` {kinds[0]}, `{key}` {kinds[1]}, score double")
        found = rows if found is None else found.unionAll(rows)
    return ranked(found, query, key, "score", k)


def _unit(lists: pa.ListArray) -> np.ndarray:
    widths = np.unique(np.diff(lists.offsets.to_numpy()))
    if len(widths) > 1:
        raise ValueError("vectors of one length are needed")
    wide = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), int(widths[0]) if len(widths) else 0)
    return wide / np.maximum(np.linalg.norm(wide, axis=1, keepdims=True), 1e-300)


def _best_of_task(batches: Iterator[pa.RecordBatch], names: list, asked: np.ndarray, k: int, block: int = 512) -> Iterator[pa.RecordBatch]:
    """The k best keys of every query among the batches of one task; queries are held in blocks of scores and keys."""
    best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    own = np.array(names)
    for batch in batches:
        if not batch.num_rows or not names:
            continue
        keys = np.array(batch.column(0).to_pylist())
        turn = np.argsort(keys, kind="stable")
        keys, wide = keys[turn], _unit(batch.column(1))[turn]
        width = min(k + 1, len(keys))  # one more, as the query itself may be among them
        for at in range(0, len(names), block):
            cosines = np.round(asked[at : at + block] @ wide.T, 9) + 0.0
            order = np.round(cosines * 1e9).astype(np.int64) * len(keys) - np.arange(len(keys))
            keep = np.argpartition(-order, width - 1, axis=1)[:, :width]
            scores, held = np.take_along_axis(cosines, keep, 1), keys[keep]
            scores[held == own[at : at + block, None]] = -np.inf
            if at in best:
                scores, held = np.concatenate([best[at][0], scores], axis=1), np.concatenate([best[at][1], held], axis=1)
            first = np.lexsort((held, -scores), axis=-1)[:, :k]
            best[at] = np.take_along_axis(scores, first, 1), np.take_along_axis(held, first, 1)
    for at, (scores, held) in best.items():
        there = np.isfinite(scores)
        rows = np.repeat(own[at : at + block], there.sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows.tolist()), pa.array(held[there].tolist()), pa.array(scores[there])], names=["query", "key", "score"])
