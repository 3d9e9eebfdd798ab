"""Graded relevance of case pairs, selective confidence, answer polarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.text import NEGATION, ascii_tokens, normalized_key
from caseloom.functions.vectors import fact_f1, label_similarity, label_weights, set_f1, sigmoid

# Fixed values of the profile: words of severity and of uncertainty, and the weights of its components.
SEVERITY = "mild minimal moderate marked severe large small borderline prominent extensive subtle trace massive".split()
UNCERTAINTY = ["uncertain", "possible", "probable", "suggestive", "cannot exclude"]
WEIGHTS = {"lesion_type": 0.25, "anatomy": 0.20, "severity": 0.10, "polarity": 0.15, "uncertainty": 0.10, "indication": 0.10, "report_label": 0.10}


def report_gain(query_labels: Column, labels: Column, query_facts: Column, facts: Column, label_weight: float = 0.6, fact_weight: float = 0.4) -> Column:
    """Weighted sum of label similarity and fact F1, within [0, 1]."""
    none = F.array().cast("array<string>")
    gain = label_weight * label_similarity(label_weights(query_labels), label_weights(labels)) + fact_weight * fact_f1(F.coalesce(query_facts, none), F.coalesce(facts, none))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), gain))


def fact_attributes(facts: Column) -> Column:
    """struct of five word sets from 'entity|text|family::status' and 'relation|subject|label|relation|target' facts."""
    parts = F.transform(F.coalesce(facts, F.array().cast("array<string>")), lambda f: F.transform(F.split(f, r"\|"), normalized_key))
    entities = F.filter(parts, lambda p: (p[0] == "entity") & (F.size(p) >= 3))
    relations = F.filter(parts, lambda p: (p[0] == "relation") & (F.size(p) >= 5))
    family = lambda label: F.substring_index(label, "::", 1)
    status = lambda label: F.when(label.contains("::"), F.substring(label, F.instr(label, "::") + F.lit(2), F.lit(1000)))
    words = lambda rows, pick: F.flatten(F.transform(rows, lambda p: ascii_tokens(pick(p))))
    anatomy_entities = F.filter(entities, lambda p: family(p[2]) == "anatomy")
    other_entities = F.filter(entities, lambda p: family(p[2]) != "anatomy")
    lesion = F.array_union(words(other_entities, lambda p: p[1]), words(F.filter(relations, lambda p: p[2].contains("observation")), lambda p: p[1]))
    anatomy = F.array_union(words(anatomy_entities, lambda p: p[1]), words(F.filter(relations, lambda p: p[3].isin("located_at", "modify")), lambda p: p[4]))
    severity = F.filter(F.array_union(words(entities, lambda p: p[1]), words(relations, lambda p: p[1])), lambda w: w.isin(SEVERITY))
    states = F.array_distinct(F.filter(F.concat(F.transform(entities, lambda p: status(p[2])), F.transform(relations, lambda p: status(p[2]))), lambda s: s.isNotNull() & (s != "")))
    return F.struct(lesion.alias("lesion_type"), anatomy.alias("anatomy"), severity.alias("severity"), states.alias("polarity"), F.filter(states, lambda s: s.isin(UNCERTAINTY)).alias("uncertainty"))


def relevance_profile(pairs: DataFrame, query: str, candidate: str) -> DataFrame:
    """pairs with `profile`, a struct of component F1s, and qrel_v2 and its availability-normalised form.

    query and candidate name structs with the fields of WEIGHTS as word arrays; a component is available
    if both sides have words; without an available one the normalised score is 0.
    """
    parts = {n: set_f1(F.col(f"{query}.{n}"), F.col(f"{candidate}.{n}")) for n in WEIGHTS}
    there = {n: (F.size(F.col(f"{query}.{n}")) > 0) & (F.size(F.col(f"{candidate}.{n}")) > 0) for n in WEIGHTS}
    score = sum((F.lit(w) * parts[n] for n, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(there[n], w).otherwise(0.0) for n, w in WEIGHTS.items()), F.lit(0.0))
    out = pairs.withColumn("profile", F.struct(*[c.alias(n) for n, c in parts.items()])).withColumn("available_weight", weight)
    out = out.withColumn("qrel_v2", F.least(F.lit(1.0), score))
    normal = F.when(F.col("available_weight") > 0, F.least(F.lit(1.0), F.col("qrel_v2") / F.col("available_weight"))).otherwise(0.0)
    return out.withColumn("qrel_v2_available_normalized", normal)


def retrieval_confidence(top: Column, second: Column, low: Column, agreement: Column, coverage: Column, dispersion: Column) -> Column:
    """Confidence of a ranked list from its range-normalised top score and margin; the coefficients are fixed values."""
    span = top - low
    height = F.when(span > 0, (top - low) / span).otherwise(0.5)
    margin = F.when(span > 0, (top - second) / span).otherwise(0.0)
    return sigmoid(1.6 * height + 3.0 * margin + 0.8 * agreement + 0.8 * coverage - 1.2 * dispersion - 1.4)


def claim_polarity(answer: Column) -> Column:
    """negative if every sentence holds a negation, positive if none does, mixed if some do; none without a text."""
    text = normalized_key(answer)
    said = F.filter(F.split(text, r"[.!?;]+(?:\s+|$)"), lambda s: s != "")
    negated = F.size(F.filter(said, lambda s: s.rlike(NEGATION)))
    return F.when(F.size(said) == 0, "none").when(negated == F.size(said), "negative").when(negated == 0, "positive").otherwise("mixed")
