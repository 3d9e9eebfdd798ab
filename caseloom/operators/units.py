"""Evidence units of cases, their ranking for a question, greedy selections within budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.functions.text import clean_text, normalized_key, plain_sentences

TOKEN = r"[\p{L}\p{N}_]{2,}"  # fixed value: what a term of a unit is


def rendered_fact(fact: Column) -> Column:
    """'entity|text|label' as 'text [label]', 'relation|subject|label|relation|object' as 'subject [label] relation object', others as they are."""
    p = F.transform(F.split(fact, r"\|"), clean_text)
    label = F.concat(p[1], F.lit(" ["), p[2], F.lit("]"))
    relation = F.concat_ws(" ", label, p[3], p[4])
    return F.when((p[0] == "entity") & (F.size(p) == 3), label).when((p[0] == "relation") & (F.size(p) == 5), relation).otherwise(clean_text(fact))


def case_units(cases: DataFrame, key: str, sections: list[str], facts: str | None = None) -> DataFrame:
    """(case_id, section, unit_index, text, provenance_id): the sentences of every section, and the distinct facts in their order as section 'facts'; indices begin at 0.

    Null sections and null or blank facts have no units.
    """
    lists = [F.struct(F.lit(s).alias("section"), plain_sentences(F.col(s)).alias("texts")) for s in sections]
    if facts:
        said = F.filter(F.transform(F.coalesce(F.col(facts), F.array().cast("array<string>")), rendered_fact), lambda t: t != "")
        lists.append(F.struct(F.lit("facts").alias("section"), F.array_sort(F.array_distinct(said)).alias("texts")))
    rows = cases.select(F.col(key).alias("case_id"), F.explode(F.array(*lists)).alias("x"))
    rows = rows.select("case_id", "x.section", F.posexplode("x.texts").alias("unit_index", "text"))
    return rows.withColumn("provenance_id", F.format_string("%s::%s::%04d", F.col("case_id"), F.col("section"), F.col("unit_index")))


def ranked_units(asked: DataFrame, units: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, case_id, provenance_id, section, unit_index, text, score, rank) of the units of every asked case, best first, ties by provenance.

    asked has qid, case_id, query, a pair of qid and case_id once. The score is the cosine of TF-IDF vectors of terms and term pairs, tf as 1 + ln tf, with statistics over the query and the
    units of the one case. A case's units, which come from one report, lie in one row, and so does all that a question asks of it: terms are never rows of a table. Units without a common term score 0; an empty query scores all 0.
    """
    held = units.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("provenance_id", "section", "unit_index", "text"))).alias("units"))
    terms = lambda text: F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))
    rows = asked.select("qid", "case_id", "query").join(held, "case_id")
    rows = rows.select("qid", "case_id", "units", F.concat(F.transform("units", lambda u: terms(u["text"])), F.array(terms(F.col("query")))).alias("terms"))
    schema = T.StructType([*rows.schema.fields[:3], T.StructField("score", T.ArrayType(T.DoubleType())), T.StructField("rank", T.ArrayType(T.IntegerType()))])
    found = rows.mapInArrow(_scored, schema).select("qid", "case_id", F.inline(F.arrays_zip("units", "score", "rank")).alias("unit", "score", "rank"))
    found = found if k is None else found.where(F.col("rank") <= k)
    return found.select("qid", "case_id", "unit.provenance_id", "unit.section", "unit.unit_index", "unit.text", "score", "rank")


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scores and ranks of each row's units: terms of a row are those of its units, then those of its query."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            sizes = pc.list_value_length(batch.column(3)).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = batch.column(3).flatten()
            row, query = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - 1
            lengths = pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
            words = texts.flatten().dictionary_encode()
            number, width = words.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(words.dictionary) + 1
            text = np.repeat(np.arange(len(lengths)), lengths)
            beside = text[1:] == text[:-1]
            grams = np.concatenate([number, ((number[:-1] + 1) * width + number[1:])[beside]])
            text = np.concatenate([text, text[1:][beside]])
            grams, gram = np.unique(grams, return_inverse=True)
            many = max(len(grams), 1)
            entry, tf = np.unique(text * many + gram, return_counts=True)
            text, gram = entry // many, entry % many
            owner, own, df = np.unique(row[text] * many + gram, return_inverse=True, return_counts=True)
            idf = np.log((1 + sizes[owner // many]) / (1 + df)) + 1
            w = (1 + np.log(tf)) * idf[own]
            of_query = text == query[row[text]]
            asked = np.zeros(len(owner))
            asked[own[of_query]] = w[of_query]
            norm, dot = (np.bincount(text, x, len(lengths)) for x in (w * w, w * asked[own]))
            norm = np.sqrt(norm)
            both = norm * norm[query[row]]
            score = np.round(np.divide(dot, both, out=np.zeros(len(both)), where=both > 0), 9)
            unit = np.ones(len(lengths), bool)
            unit[query] = False
            score, row = score[unit], row[unit]
            rank = np.empty(len(row), np.int32)
            rank[np.lexsort((np.arange(len(row)), -score, row))] = np.arange(len(row)) - np.repeat(np.cumsum(sizes - 1) - sizes + 1, sizes - 1) + 1
            ends = pa.array(np.append(0, np.cumsum(sizes - 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(ends, pa.array(score)), pa.ListArray.from_arrays(ends, pa.array(rank))], names=["qid", "case_id", "units", "score", "rank"])


def _fold(units: Column, most: Column | int, characters: Column, start_used: Column, distinct: bool) -> Column:
    """Greedy pick from array<struct<text, ...>>: struct<kept, used>; the first always fits, and of equal texts the first only where distinct."""
    kind = "array<struct<case_id:string,provenance_id:string,text:string>>"
    start = F.struct(F.array().cast(kind).alias("kept"), start_used.cast("int").alias("used"))

    def add(state: Column, unit: Column) -> Column:
        some = F.size(state["kept"]) > 0
        extra = F.length(unit["text"]) + F.when(some, 1).otherwise(0)
        twice = F.exists(state["kept"], lambda k: normalized_key(k["text"]) == normalized_key(unit["text"])) if distinct else F.lit(False)
        fits = (F.size(state["kept"]) < most) & ~twice & (~some | (state["used"] + extra <= characters))
        return F.when(fits, F.struct(F.concat(state["kept"], F.array(unit)).alias("kept"), (state["used"] + extra).cast("int").alias("used"))).otherwise(state)

    return F.aggregate(units, start, add)


def _lists(ranks: DataFrame, keys: list[str]) -> DataFrame:
    """Units of a case in order of rank; they come from the text of one report."""
    unit = F.struct("rank", F.struct("case_id", "provenance_id", "text").alias("u"))
    return ranks.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(unit)), lambda x: x["u"]).alias("units"))


def selected_units(ranks: DataFrame, most_units: int = 2, most_characters: int = 520) -> DataFrame:
    """(qid, case_id, units): the best units of each case, no text twice, at most most_units, within a budget of characters; the first always fits. ranks is the result of ranked_units."""
    rows = _lists(ranks, ["qid", "case_id"])
    return rows.select("qid", "case_id", _fold(F.col("units"), most_units, F.lit(most_characters), F.lit(0), True)["kept"].alias("units"))


def hierarchical_units(ranks: DataFrame, cases: DataFrame, most_cases: int = 3, per_case: int = 2, most_units: int = 6, most_characters: int = 1200, case_characters: int = 520) -> DataFrame:
    """(qid, units, case_ids): units over the first most_cases retrieved cases of a question, in their order, within budgets per case and in total.

    cases has qid, case_id, rank. Every case gives at most per_case units of at most case_characters, and they are kept while the totals allow.
    """
    own = selected_units(ranks, per_case, case_characters).join(cases.where(F.col("rank") <= most_cases), ["qid", "case_id"]).where(F.size("units") > 0)
    rows = own.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "units", "case_id"))).alias("x"))  # at most most_cases
    flat = F.flatten(F.transform("x", lambda c: c["units"]))
    kept = rows.select("qid", _fold(flat, most_units, F.lit(most_characters), F.lit(0), False)["kept"].alias("units"))
    return kept.withColumn("case_ids", F.array_distinct(F.transform("units", lambda u: u["case_id"])))
