"""Chunks of reports: sentences, token windows, greedy packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import capital_sentences, clean_text


def section_chunks(cases: DataFrame, key: str, sections: list[str]) -> DataFrame:
    """(chunk_id, case_id, section, position, text): one row per sentence; ids are case::section::NNN, from 001."""
    parts = F.array(*[F.struct(F.lit(s).alias("section"), capital_sentences(F.col(s)).alias("sentences")) for s in sections])
    rows = cases.select(F.col(key).alias("case_id"), F.explode(parts).alias("part"))
    rows = rows.select("case_id", "part.section", F.posexplode("part.sentences").alias("at", "text"))
    chunk = F.format_string("%s::%s::%03d", F.col("case_id"), F.col("section"), F.col("at") + 1)
    return rows.select(chunk.alias("chunk_id"), "case_id", "section", (F.col("at") + 1).alias("position"), "text")


def token_windows(text: Column, size: int) -> Column:
    """Windows of at most `size` blank-separated tokens, without overlap."""
    tokens = F.filter(F.split(clean_text(text), " "), lambda t: t != "")
    starts = F.when(F.size(tokens) > 0, F.sequence(F.lit(1), F.size(tokens), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(tokens, s, size), " "))


def packed_chunks(text: Column, size: int) -> Column:
    """Sentences packed greedily into chunks of at most `size` tokens, in order; a longer sentence is cut into windows first."""
    pieces = F.flatten(F.transform(capital_sentences(text), lambda s: token_windows(s, size)))
    count = lambda s: F.size(F.filter(F.split(s, " "), lambda t: t != ""))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(state: Column, piece: Column) -> Column:
        joined = F.concat_ws(" ", state["open"], piece)
        fits = (state["open"] != "") & (count(joined) <= size)
        return F.when(state["open"] == "", F.struct(state["done"].alias("done"), piece.alias("open"))).when(
            fits, F.struct(state["done"].alias("done"), joined.alias("open"))
        ).otherwise(F.struct(F.concat(state["done"], F.array(state["open"])).alias("done"), piece.alias("open")))

    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.aggregate(pieces, start, add, end)
