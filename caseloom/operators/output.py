"""Prompts, and the parsing of structured model output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from caseloom.functions.text import bounded_sentences, clean_text

NO_ANSWER = "Unable to provide a reliable answer from the available evidence."  # fixed value


def evidence_prompt(question: Column, indication: Column, evidence: Column) -> Column:
    """A prompt with numbered evidence in its order; evidence is array<struct<provenance_id, text>>. An empty question gives null."""
    lines = F.array_join(F.transform(evidence, lambda e, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), e["provenance_id"], F.lit(": "), clean_text(e["text"]))), "\n")
    body = F.concat_ws("\n", F.concat(F.lit("Indication: "), clean_text(indication)), F.concat(F.lit("Question: "), clean_text(question)), F.lit("Evidence:"), F.when(F.size(evidence) > 0, lines).otherwise(F.lit("none")), F.lit("Answer from the evidence only, as JSON with answer, uncertainty, evidence, abstain."))
    return F.when(clean_text(question) != "", body)


@F.pandas_udf(StringType())
def first_json_object(texts: pd.Series) -> pd.Series:
    """The first decodable JSON object of a text, as canonical JSON; null if there is none."""
    decoder = json.JSONDecoder(strict=False)

    def find(text: str | None) -> str | None:
        at = (text or "").find("{")
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
                if isinstance(value, dict):
                    return json.dumps(value, sort_keys=True)
            except (json.JSONDecodeError, RecursionError):
                pass
            at = text.find("{", at + 1)
        return None

    return texts.map(find)


def parse_compact_output(rows: DataFrame, key: str, text: str, allowed: str) -> DataFrame:
    """(key, answer, uncertainty, abstain, evidence, structured_output_valid, raw_json_valid, parser_repaired, usable).

    JSON first; else 'key: value' lines, which repair but never count as valid. Evidence ids that aren't in
    `allowed` are dropped and make the output invalid, as do an unknown uncertainty and a missing answer.
    """
    read = rows.select(key, F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(allowed).alias("ok"), first_json_object(F.col(text)).alias("j"))
    line = lambda name: F.trim(F.regexp_extract("t", rf"(?im)^\s*{name}:(.*)$", 1))
    said = F.trim(F.regexp_extract("t", r"(?is)(?:^|\n)\s*answer:(.*?)(?=\n\s*(?:uncertainty|abstain|evidence):|\z)", 1))
    has_lines = F.col("t").rlike(r"(?im)^\s*answer:")
    fields = F.from_json("j", "answer string, uncertainty string, abstain boolean, evidence array<string>")
    read = read.withColumn("f", fields).withColumn("json", F.col("j").isNotNull())
    read = read.withColumn("repaired", ~F.col("json") & has_lines)
    answer = bounded_sentences(F.when(F.col("json"), F.coalesce("f.answer", F.lit(""))).when(F.col("repaired"), said).otherwise(""))
    mood = F.lower(clean_text(F.when(F.col("json"), F.coalesce("f.uncertainty", F.lit("high"))).when(F.col("repaired") & (line("uncertainty") != ""), line("uncertainty")).otherwise("high")))
    none = F.array().cast("array<string>")
    ids = F.when(F.col("json"), F.coalesce("f.evidence", none)).when(F.col("repaired"), F.filter("ok", lambda i: F.contains(F.col("t"), i))).otherwise(none)
    kept = F.filter(ids, lambda i: F.array_contains(F.col("ok"), i))
    known = mood.isin("low", "medium", "high")
    valid = F.col("json") & known & (F.size(kept) == F.size(ids)) & (answer != "")
    stop = F.when(F.col("json"), F.coalesce("f.abstain", F.lit(False))).otherwise(F.lower(line("abstain")) == "true")
    return read.select(
        key, F.when(answer != "", answer).otherwise(F.lit(NO_ANSWER)).alias("answer"), F.when(known, mood).otherwise("high").alias("uncertainty"), stop.alias("abstain"), kept.alias("evidence"),
        valid.alias("structured_output_valid"), F.col("json").alias("raw_json_valid"), F.col("repaired").alias("parser_repaired"), (valid | ((answer != "") & F.col("repaired"))).alias("usable"),
    )


def without_trailing_commas(text: Column) -> Column:
    """Commas right before a closing brace or bracket dropped."""
    return F.regexp_replace(text, r",(\s*[}\]])", "$1")


def staged_output(rows: DataFrame, key: str, answer: str, support: str, allowed: str, no_history: Column) -> DataFrame:
    """(key, answer, uncertainty, historical_support, supporting_ids, no_reliable_history, evidence_abstained, answer_stage_valid, support_stage_valid) of a two-stage output.

    The first stage is a JSON object {a, u}, the second {s: [{p, t}]}; trailing commas and text around the objects are tolerated. An unknown uncertainty is high; without an answer the whole text is taken, or a fixed sentence.
    Support whose id isn't in `allowed`, or without a text, is dropped and makes that stage invalid; without reliable history (no_history) there is no support.
    """
    read = rows.select(key, F.coalesce(F.col(answer), F.lit("")).alias("_t"), F.col(allowed).alias("_ok"), no_history.alias("_none"), first_json_object(without_trailing_commas(F.col(answer))).alias("_j"), first_json_object(without_trailing_commas(F.col(support))).alias("_k"))
    read = read.withColumn("_f", F.from_json("_j", "a string, u string")).withColumn("_g", F.from_json("_k", "s array<struct<p:string,t:string>>"))
    said, mood = clean_text(F.col("_f.a")), F.lower(clean_text(F.col("_f.u")))
    known = mood.isin("low", "medium", "high")
    empty = F.array().cast("array<struct<p:string,t:string>>")
    given = F.transform(F.coalesce("_g.s", empty), lambda s: F.struct(clean_text(s["p"]).alias("p"), clean_text(s["t"]).alias("t")))
    kept = F.filter(given, lambda s: F.array_contains(F.col("_ok"), s["p"]) & (s["t"] != ""))
    shown = F.when(F.col("_none"), empty).otherwise(kept)
    return read.select(
        key, F.when(said != "", said).when(clean_text(F.col("_t")) != "", clean_text(F.col("_t"))).otherwise(F.lit(NO_ANSWER)).alias("answer"), F.when(known, mood).otherwise("high").alias("uncertainty"),
        shown.alias("historical_support"), F.array_sort(F.array_distinct(F.transform(shown, lambda s: s["p"]))).alias("supporting_ids"), F.col("_none").alias("no_reliable_history"), (F.size(shown) == 0).alias("evidence_abstained"),
        (F.col("_j").isNotNull() & known & (said != "")).alias("answer_stage_valid"), (F.col("_k").isNotNull() & F.col("_g.s").isNotNull() & (F.size(kept) == F.size(given))).alias("support_stage_valid"),
    )


def model_slot(rows: DataFrame, column: str, result: str, kind: str, load) -> DataFrame:
    """rows with `result` from an external model: load() is called once per task and gives a function from a pandas Series to a Series.

    Encoders, cross-encoders, entailment and generation plug in here; no weights come with this library.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{result}` {kind}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for frame in frames:
            yield frame.assign(**{result: model(frame[column])})

    return rows.mapInPandas(run, schema)
