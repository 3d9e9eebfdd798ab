"""Text expressions: Columns in, Columns out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def strip_blanks(value: Column) -> Column:
    """Trims every kind of white space, not only U+0020; null stays null."""
    return F.regexp_replace(value, f"^{SPACES}+|{SPACES}+$", "")


def clean_text(value: Column) -> Column:
    """Collapses runs of white space to one blank and trims; null becomes ''."""
    return F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), f"{SPACES}+", " "))


def normalized_key(value: Column) -> Column:
    """Lower case over collapsed white space, as used for report and fact keys."""
    return F.lower(clean_text(value))


def clean_field(value: Column) -> Column:
    """clean_text, with the words 'nan' and 'none' read as missing ('')."""
    text = clean_text(value)
    return F.when(F.lower(text).isin("nan", "none"), F.lit("")).otherwise(text)


def report_text_key(value: Column) -> Column:
    """Collapsed white space, and no blank before . , ! ? ; :"""
    return F.regexp_replace(clean_text(value), r" +([.,!?;:])", "$1")


def ascii_tokens(value: Column) -> Column:
    """Lower-cased [a-z0-9]+ runs; accented letters split words; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(value, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(value: Column) -> Column:
    return F.array_distinct(ascii_tokens(value))


def normalized_answer(value: Column) -> Column:
    return F.array_join(ascii_tokens(value), " ")


def is_not_answerable(value: Column) -> Column:
    text = normalized_answer(value)
    return (text == "not answerable") | text.startswith("not answerable ")


def final_answer(value: Column) -> Column:
    """What follows the first 'final answer:' marker without a leading bullet; the whole text if there is none."""
    text = F.coalesce(value, F.lit(""))
    marked = text.rlike(r"(?is)\bfinal\s+answer\s*:")
    rest = F.regexp_extract(text, r"(?is)\bfinal\s+answer\s*:\s*(.*)", 1)
    return F.trim(F.when(marked, F.regexp_replace(F.trim(rest), r"^[-*]\s+", "")).otherwise(text))


def placeholder_ratio(value: Column) -> Column:
    """Share of blank-separated words containing XXXX; an empty text counts as 1.0."""
    words = F.filter(F.split(clean_text(value), " "), lambda w: w != "")
    hits = F.size(F.filter(words, lambda w: F.upper(w).contains("XXXX")))
    return F.when(F.size(words) == 0, F.lit(1.0)).otherwise(hits / F.size(words))


def capital_sentences(value: Column) -> Column:
    """Splits after . ! ? where white space and a capital or digit follow; drops empties."""
    parts = F.split(clean_text(value), r"(?<=[.!?])\s+(?=[A-Z0-9])")
    return F.filter(parts, lambda s: s != "")


def plain_sentences(value: Column) -> Column:
    """Splits after . ! ? before any white space; drops empties."""
    return F.filter(F.split(clean_text(value), r"(?<=[.!?])\s+"), lambda s: s != "")


# What numbers a sentence, and what ends one, in evidence checks.
NUMBERING, SENTENCE_END = r"\b(\d+)\.\s+", r"(?<=[.!?])\s+|[\r\n]+|\s*;\s*"


def numbered_sentences(value: Column) -> Column:
    """Third splitter: '1. ' numbering is protected; breaks at sentence ends, new lines and semicolons."""
    guarded = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), NUMBERING, "$1\u0001 ")
    parts = F.split(guarded, SENTENCE_END)
    return F.filter(F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(".")))), lambda s: s != "")


def bounded_sentences(value: Column, maximum: int = 2) -> Column:
    """The first complete sentences; the whole cleaned text if none is complete."""
    text = clean_text(value)
    done = F.slice(F.regexp_extract_all(text, F.lit(r".+?[.!?](?=\s|$)"), F.lit(0)), 1, maximum)
    joined = F.array_join(F.transform(done, lambda s: F.trim(s)), " ")
    return F.when(F.size(done) == 0, text).otherwise(joined)


# Words without content in evidence checks, and the cues of negation and of normality.
STOP_WORDS = (
    "a an and are as at be by based described evidence for finding findings from has have in indicating is it noted of "
    "on or report section the there this to was were with within yes"
).split()
NEGATION = r"(?i)\b(?:no|not|without|absent|absence\s+of|negative\s+for|free\s+of|neither|nor|cannot|can't|unable\s+to)\b"
NORMALITY = r"(?i)\b(?:normal|within\s+normal\s+limits|unremarkable|no\s+acute\s+(?:disease|abnormality))\b"


# Plural endings, longest first, with the least letters of a word, the ending that is spared, and what replaces them.
ENDINGS = (("ies", 5, None, "y"), ("es", 5, "ses", ""), ("s", 4, "ss", ""))


def stemmed(token: Column) -> Column:
    """Without the first of the plural ENDINGS that fits."""
    size, out = F.length(token), token
    for ending, least, spared, instead in reversed(ENDINGS):
        fits = (size >= least) & token.endswith(ending) & (~token.endswith(spared) if spared else F.lit(True))
        out = F.when(fits, F.concat(token.substr(F.lit(1), size - len(ending)), F.lit(instead))).otherwise(out)
    return out


def content_tokens(value: Column) -> Column:
    """Distinct stemmed tokens longer than one letter that are no stop words."""
    kept = F.filter(ascii_tokens(value), lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))
    return F.array_distinct(F.transform(kept, stemmed))


def contains_negation(value: Column) -> Column:
    """A cue of negation or of normality."""
    text = F.coalesce(value, F.lit(""))
    return text.rlike(NEGATION) | text.rlike(NORMALITY)
