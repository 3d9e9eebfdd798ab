"""Broken question-answer pairs: each defective answer with its one defect."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.metrics import wilson
from caseloom.operators.skew import join_one_per_key
from caseloom.session import stored

DEFECTS = ("empty", "refusal", "copies_question", "other_language", "truncated")

INVISIBLE = regex.compile(r"[\p{Cf}\p{Cc}\p{Z}⠀ㅤ]+")
TAG = regex.compile(r"</?\p{L}[^<>]*>")
LABEL = regex.compile(
    r"^(?:final\s+)?(?:answer|response|reply|output|result|assistant|a|r|antwort|respuesta|réponse|risposta|resposta)\s*[:：]\s*", regex.I
)
ASKING_LABEL = regex.compile(r"^(?:q|question|you ask(?:ed)?|the question (?:is|was)|pregunta|frage|domanda|pergunta)\s*[:：]\s*", regex.I)
CLOSING_LABEL = regex.compile(r"\s(?:a|answer|antwort|respuesta|réponse)\s*[:：]\s*$", regex.I)

LABEL_WORDS = frozenset("q a question answer the is you ask asked pregunta respuesta frage antwort réponse reponse".split())

# Words that stand for "no value" when they are all of an answer.
NO_VALUE = frozenset("n/a na nan null none nil nul undefined empty blank missing tbd void unknown_value nothing_here".split())
# Function words by language, for telling the language of an answer from that of its question.
FUNCTION_WORDS = {
    "en": "the of and is are in to was were with for this that on at by an it its no yes does what which how there has from be as not near list does any where within",
    "es": "el la los las de del en se no hay una un por para con y que qué su lo al pero dentro sin respecto ha han cómo cerca junto está",
    "fr": "le la les des du de dans est il on un une et pas pour avec au aux sont sans par que se tandis mais près a-t-il y",
    "de": "der die das im ist und ein eine kein keine nicht mit zur zum sich wird in den dem bei wegen von hat wie es gibt ohne jedoch was",
    "it": "il lo gli la le di del della che e un una per con non si nel nella da al dal fra senza nei è",
    "pt": "o a os as do da de dos em que e um uma para com não se no na por ao está sem nova",
}
_FUNCTION_SETS = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
LETTER, LETTERS, HYPHENATED = regex.compile(r"\p{L}"), regex.compile(r"\p{L}+"), regex.compile(r"\p{L}+(?:-\p{L}+)*")
QUOTED = regex.compile(r'["“«„][^"”»“«„]*["”»“]')
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Han", "Hiragana", "Katakana", "Hangul", "Devanagari", "Thai")
_SCRIPT = {s: regex.compile(rf"\p{{Script={s}}}") for s in SCRIPTS}

# A refusal is said by the answerer about itself: an optional opening, then a declining verb phrase, then what is declined.
_OPENING = (
    r"(?:(?:as an? (?:ai|artificial intelligence|language|assistant|medical|automated)[\w\s-]{0,30}|i am sorry|i'm sorry|sorry|apologies|my apologies|"
    r"regrettably|unfortunately|thank you(?: for [\w\s]{1,20})?|thanks(?: for [\w\s]{1,20})?)[\s,.:;!-]*(?:but|however|and|though)?[\s,]*)*"
)
_I = r"(?:i|we)"
_DECLINES = "|".join(
    [
        rf"{_I} (?:can ?not|can't|could not|couldn't|am not able to|are not able to|am unable to|cannot possibly) (?:help|assist|provide|give|offer|answer that|answer this|answer such|comply|fulfil|fulfill|interpret|diagnose|advise|discuss|comment|do that|share|supply|respond)",
        r"(?:i'm|we're|i am|we are) (?:unable|not able|not allowed|not permitted|not in a position) to (?:help|assist|provide|give|offer|answer|comply|interpret|diagnose|advise|discuss|comment|supply|respond)",
        r"unable to (?:assist|help|comply)",
        rf"{_I} (?:won't|will not|would rather not|must decline|have to decline|decline|refuse|must refuse|have to pass|must pass|prefer not|do not feel comfortable|don't feel comfortable|am not comfortable)",
        r"i'm not comfortable",
        r"(?:my|our) (?:guidelines|rules|policies|policy|instructions|programming)[\w\s]{0,20} (?:do not|don't|does not|doesn't|forbid|forbids|prevent|prevents|prohibit)",
        r"it (?:would|is|'s) (?:not be|not|be) (?:appropriate|possible|right|proper|inappropriate)[\w\s]{0,12} (?:for me|of me)",
        r"(?:this|that) (?:request|question) (?:is|falls) (?:outside|beyond|against)",
        r"(?:this|the) (?:service|system|assistant|tool|model|app|application) (?:is|was|can|does|will|may|must)(?: ?not|n't)? (?:permitted|allowed|able|designed|meant|authori[sz]ed|trained|provide|give|offer|produce|answer|interpret)",
    ]
)
REFUSAL = regex.compile(rf"^{_OPENING}(?:{_DECLINES})\b", regex.I)
REFUSAL_ELSEWHERE = regex.compile(
    "|".join(
        [
            r"^(?:lo siento[\s,]*(?:pero)?\s*)?(?:no me está permitido|no (?:puedo|podemos|me es posible) (?:ayudar|interpretar|dar|ofrecer|proporcionar|responder|asistir|opinar|facilitar))",
            r"^lo siento\b",
            r"^(?:je suis désolée?[\s,]*(?:mais)?\s*)?(?:je ne (?:peux|puis|suis) pas|il ne m'est pas (?:permis|possible)|il m'est interdit)",
            r"^je suis désolée?\b",
            r"^(?:es tut mir leid[\s,]*(?:aber|doch)?\s*)?(?:ich (?:darf|kann|möchte|werde) (?:\p{L}+\s+){0,6}nicht|dabei kann ich nicht|ich darf dieses|das darf ich nicht)",
            r"^es tut mir leid\b",
            r"^(?:mi dispiace[\s,]*(?:ma)?\s*)?(?:non posso|non mi è (?:permesso|consentito|possibile))",
            r"^(?:sinto muito|lamento|desculpe)[\s,]*(?:mas)?\s*(?:não posso|não me é permitido)?",
        ]
    ),
    regex.I,
)

_OPENERS = {"(": ")", "[": "]", "{": "}", "«": "»", "“": "”", "„": "“”", "‹": "›"}
_CLOSERS = set("".join(_OPENERS.values())) - {"“"}
# Words after which a sentence can't end.
DANGLING = frozenset(
    "a an the of to in on at by for from with and or but nor than as if because while since into onto over under between near towards "
    "beneath behind beside above below within without against about up per its their this these those which that who is are was were has "
    "have had be been being measuring see compare measured more less most least very slightly not no well peri sub non "
    "el la los las de del en y o con por para un una que le les des du dans et ou avec pour sur au aux "
    "der die das dem den des ein eine einen einer und oder mit von zu im am bei für auf".split()
)
# Finite verbs that make a run of words a sentence; such a run needs an end mark.
FINITE = frozenset(
    "is are was were has have had does do did shows show ends end measures measure describes advises accompanies projects "
    "occupies lies lie reach reaches follow follows tracks represent represents deviates sits blunts favour favours reads "
    "remains appears can cannot could should would speaks mentions gives points spread moved suggests "
    "hay está muestra termina presenta persiste recomienda observa ha han "
    "est sont présente persiste note montre ont termine "
    "ist sind zeigt zeigen liegt findet wird werden hat haben "
    "si osserva apresenta observa-se consiglia".split()
)


SIGNS = regex.compile(r"```|\*\*|__|</?\p{L}[^<>]*>|[\"`()\[\]{}«»“”„‹›]")
ITEM = regex.compile(r"^\s*(?:[-*•·–]|\p{N}{1,3}[.)])\s+(.*\S)", regex.M)
# Tags without an end tag, and tags whose end tag may be left out.
LONE_TAGS = frozenset(("br", "hr", "img"))
LOOSE_TAGS = frozenset(("<p>", "<li>", "<td>", "<th>", "<tr>", "<dt>", "<dd>"))
FOREIGN = regex.compile(r"[\p{L}--\p{Latin}]", regex.V1)


class PushdownParser:
    """Brackets, quotations, fences, emphasis, mark-up and list items of a text, with a stack of what is open.

    A closing sign also closes what was opened after its opening sign. Inside a fence brackets are code and don't count.
    items are the list items of the text outside fences.
    """

    def __init__(self, text: str):
        self.open: list[str] = []
        outside, at = [], 0
        for found in SIGNS.finditer(text):
            sign = found.group()
            if sign == "```" and "```" not in self.open:
                outside.append(text[at : found.start()])
            if sign[0] == "<":
                self._tag(sign)
            elif sign in ("```", "**", "__", '"', "`"):
                self._toggle(sign)
            elif sign in _OPENERS and "```" not in self.open:
                self.open.append(sign)
            elif sign in _CLOSERS:
                for depth in range(len(self.open) - 1, -1, -1):
                    if sign in _OPENERS.get(self.open[depth], ""):
                        del self.open[depth:]
                        break
            if sign == "```" and "```" not in self.open:
                at = found.end()
        if "```" not in self.open:
            outside.append(text[at:])
        self.items: list[str] = ITEM.findall("\n".join(outside)) if "\n" in text else []

    def last_item_is_open(self) -> bool:
        """Whether the last list item lacks the end mark that an item before it has."""
        ended = [item.rstrip(" *_`\"”»'").endswith((".", "!", "?", ";")) for item in self.items]
        return len(ended) > 1 and any(ended[:-1]) and not ended[-1] and len(self.items[-1].split()) > 1

    def _toggle(self, mark: str) -> None:
        if mark in self.open:
            del self.open[self.open.index(mark) :]
        else:
            self.open.append(mark)

    def _tag(self, tag: str) -> None:
        name = tag.strip("</> ").split()[0].lower() if tag.strip("</> ") else ""
        if tag.endswith("/>") or name in LONE_TAGS:
            return
        if tag.startswith("</"):
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth] == f"<{name}>":
                    del self.open[depth:]
                    return
        else:
            self.open.append(f"<{name}>")


def undressed(text: str) -> str:
    """The content of an answer: without mark-up, outer emphasis, quotation marks, labels and list marks."""
    now = INVISIBLE.sub(" ", TAG.sub(" ", text)).strip()
    while True:
        before = now
        now = now.strip("*_`#> \t")
        if len(now) > 1 and now[0] in "\"“«„'" and now[-1] in "\"”»“'":
            now = now[1:-1].strip()
        now = LABEL.sub("", now)
        now = regex.sub(r"^[-•·–—]\s+", "", now).strip()
        if now == before:
            return now


def is_empty(text: str | None) -> bool:
    """No content: null, blank, invisible or bare signs, a word for "no value", a bare label or tag."""
    if text is None:
        return True
    core = undressed(text + " ")
    bare = core.casefold().strip(" .:;,-–—_*\"'()[]{}")
    if not regex.search(r"[\p{L}\p{N}]", core) or bare in NO_VALUE:
        return True
    return LABEL.fullmatch(core + ":") is not None or LABEL.fullmatch(core) is not None


def is_refusal(core: str) -> bool:
    said = core.replace("’", "'")
    return REFUSAL.match(said) is not None or REFUSAL_ELSEWHERE.match(said) is not None


def _flat(text: str) -> list[str]:
    """Words as they are compared with the question: case, punctuation, accents and inner hyphens don't matter."""
    plain = unicodedata.normalize("NFKD", text).casefold()
    plain = regex.sub(r"\p{M}+", "", plain)
    return regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"(?<=[\p{L}\p{N}])[-‐‑'’.:](?=[\p{L}\p{N}])", "", plain))


_flat_question = lru_cache(maxsize=50_000)(lambda text: tuple(_flat(text)))


def tiled(a: list[str], b: list[str], least: int = 2) -> int:
    """Greedy string tiling: words of a covered by the longest common runs with b, longest first, each word used once."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best: list[tuple[int, int]] = []
        size = least
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                    k += 1
                if k > size or (k == size and best):
                    best, size = ([(i, j)] if k > size else [*best, (i, j)]), k
                elif k == size:
                    best = [(i, j)]
        if not best:
            return covered
        for i, j in best:
            if all(free_a[i : i + size]) and all(free_b[j : j + size]):
                free_a[i : i + size] = [False] * size
                free_b[j : j + size] = [False] * size
                covered += size


def copies_question(core: str, question: str | None) -> bool:
    """Nothing but its question, if need be with a label or in other dress, or with a word changed."""
    if not question:
        return False
    said = CLOSING_LABEL.sub("", ASKING_LABEL.sub("", core + " ")).strip(" \"“”«»'*_`")
    q = list(_flat_question(question))
    a = _flat(said)
    if not q or not a:
        return False
    if a == q or "".join(a) == "".join(q):
        return True
    rest = f" {' '.join(a)} ".replace(f" {' '.join(q)} ", "  ").replace(f" {' '.join(q)} ", "  ")
    if rest.strip() != " ".join(a):
        return not set(rest.split()) - LABEL_WORDS  # the question again and again, or the question and more
    need = max(0.6 * max(len(a), len(q)), max(len(a), len(q)) - 2)
    if min(len(a), len(q)) < need:
        return False
    return sum((Counter(a) & Counter(q)).values()) >= need and tiled(a, q) >= need  # tiles can't cover more than the common words


def language_of(text: str) -> tuple[str, float]:
    """Language by script, then by function words; and the share of words that are function words of it."""
    if not text.isascii() and FOREIGN.search(text):
        letters = len(LETTER.findall(text))
        for script, own in _SCRIPT.items():
            if script != "Latin" and len(own.findall(text)) > 0.5 * letters:
                return script, 1.0
    words = HYPHENATED.findall(text.casefold())
    if not words:
        return "", 0.0
    counts = {k: sum(w in known for w in words) for k, known in _FUNCTION_SETS.items()}
    if "ñ" in text or "¿" in text or "ción" in text:
        counts["es"] += 1
    if "ã" in text or "õ" in text or "ção" in text:
        counts["pt"] += 2
    best = max(counts, key=lambda k: (counts[k], k == "en"))
    return (best, counts[best] / len(words)) if counts[best] else ("", 0.0)


_language_of_question = lru_cache(maxsize=50_000)(language_of)


def other_language(core: str, question: str | None) -> bool:
    """Mainly in another language than the question, by the words of its sentences; quoted words don't count."""
    if not question:
        return False
    asked, sure = _language_of_question(question)
    unquoted = QUOTED.sub(" ", core)
    said, weight = language_of(unquoted)
    if said == asked:
        return False
    words = LETTERS.findall(unquoted)
    if not asked or not said or said == asked or sure < 0.1:
        return False
    counts = {k: sum(w.casefold() in known for w in words) for k, known in _FUNCTION_SETS.items()}
    if said in counts and asked in counts:
        return len(words) >= 4 and weight >= 0.15 and counts[said] >= counts[asked] + 2
    return True


def is_truncated(text: str, core: str) -> bool:
    """Breaks off within a sentence: something stays open, the end dangles, or a sentence lacks its end mark."""
    parser = PushdownParser(text)
    if set(parser.open) - LOOSE_TAGS or parser.last_item_is_open():
        return True
    end = core.rstrip(" *_`\"”»'")
    if not end:
        return False
    if end.endswith(("…", "...", ",", "-", "‐", "–", "—", ":", "/", "(", "[", "+", "&")):
        return True
    if end[-1] in ".!?。؟":
        return False
    tail = regex.split(r"(?<=[.!?])[\s\"”»*]+|\n+(?:[-*•]\s+|\d+[.)]\s+)?", end)[-1].strip()
    asked = regex.search(r"[?.]\s+[-–—•]\s+", end) or regex.search(r"\n[-–—•*]\s+", end)
    tail = regex.split(r"(?:^|\s)[-–—•]\s+", tail)[-1] if asked else tail
    listed = parser.items[-1].rstrip(" *_`\"”»'") if len(parser.items) > 1 else None
    if listed and end.endswith(listed):  # an item is judged by its own words
        asked, tail = True, regex.split(r"(?<=[.!?])\s+", listed)[-1]
    words = [w.casefold() for w in regex.findall(r"[\p{L}\p{N}]+(?:[.'’-][\p{L}\p{N}]+)*", tail)]
    if not words:
        return False
    if words[-1] in DANGLING or tail.endswith((")", "]")) and words[0] in ("the", "a", "an", "there", "it", "this"):
        return True
    multi = len(tail) < len(end) and not asked
    if multi and len(words) > 1:
        return not regex.match(r"^(?:[\p{L}\s-]{3,40}:\s)", tail) or any(w in FINITE for w in words)
    starts = words[0] in ("the", "a", "an", "there", "it", "this", "that", "these", "yes", "no") and len(words) > 3
    return starts or (len(words) > 3 and any(w in FINITE for w in words)) or tail.endswith("(")


def defect_of(question: str | None, answer: str | None, whole_sentences: frozenset[tuple[str, ...]] = frozenset()) -> str | None:
    """The one defect of an answer, or None; whole_sentences holds openings that only complete sentences have."""
    if is_empty(answer):
        return "empty"
    core = undressed(answer)
    if is_refusal(core):
        return "refusal"
    if copies_question(core, question):
        return "copies_question"
    if other_language(core, question):
        return "other_language"
    if is_truncated(answer, core) or opens_a_sentence(core, whole_sentences):
        return "truncated"
    return None


def _opening(sentence: str, size: int) -> tuple[str, ...] | None:
    words = regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"\p{N}+(?:[.,:]\p{N}+)*", "0", sentence.casefold()))
    return tuple(words[:size]) if len(words) >= size else None


def last_opening(core: str) -> tuple[str, ...] | None:
    """Opening of the last run of words, if it lacks an end mark."""
    end = core.rstrip(" *_`\"”»'")
    if not end or end[-1] in ".!?":
        return None
    tail = regex.split(r"(?<=[.!?])[\s\"”»*]+|\n+|(?:^|\s)[-–—•]\s+", end)[-1]
    return _opening(tail, 3) or _opening(tail, 2)


def opens_a_sentence(core: str, openings: frozenset[tuple[str, ...]]) -> bool:
    """Whether the last run of words without an end mark opens like the complete sentences of the corpus do."""
    return last_opening(core) in openings


def frequent_openings(answers: DataFrame, most_open: float = 0.3 / 1.3, z: float = 1.2816) -> DataFrame:
    """(opening): openings of two and three words (numbers masked, words joined by blanks) that complete sentences of the answers have and answers without an end mark seldom.

    Complete sentences are counted over all distinct answers, so that a text can't qualify its own opening by being repeated; those without an
    end mark in every row, as a short answer that is given again and again is whole. An opening qualifies if the share of its open sentences is below
    most_open by the upper end of its Wilson interval (one-sided, 90 %), so the evidence asked for doesn't depend on the size of the corpus.
    """
    text = F.lower(F.coalesce("answer", F.lit("")))
    marked = F.regexp_replace("text", r"\d+(?:[.,:]\d+)*", "0")
    pieces = F.filter(F.split(marked, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 3)
    texts = answers.select(text.alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("times"))
    sentences = texts.select("times", F.explode(pieces).alias("s"))
    words = F.regexp_extract_all("s", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    done = F.col("s").rlike(r"[.!?]$")
    heads = sentences.select("times", words.alias("w"), done.alias("done")).where(F.size("w") >= 2)
    heads = heads.select("times", "done", F.explode(F.array_distinct(F.array(F.slice("w", 1, 2), F.slice("w", 1, 3)))).alias("head"))
    open_rows = F.coalesce(F.sum(F.when(~F.col("done"), F.col("times"))), F.lit(0)).cast("double")
    counts = heads.groupBy(F.array_join("head", " ").alias("opening")).agg(open_rows.alias("open"), (F.count_if("done") + open_rows).alias("n"))
    return counts.where(wilson(F.col("open"), F.col("n"), z)[1] <= most_open).select("opening")


def broken_answers(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """(record_id, defect) of every answer that is no proper answer to its question.

    answers has record_id, qid, answer. What needs no question (empty, refused, broken off) is decided where the rows are read; only the
    content of the other answers meets its question (the latest row of a qid), in a join whose hot keys adaptive execution splits.
    A record without a known question is judged by its text alone; null record ids are left out. A record written twice counts once, with the first defect
    in the order of DEFECTS if its texts differ. Whole texts are parsed. Empty tables give an empty result.
    """
    latest = questions.where("qid is not null").groupBy("qid").agg(F.max(F.struct("created_at", "question")).getField("question").alias("question"))
    rows = answers.where("record_id is not null").select(F.col("record_id").cast("string").alias("record_id"), F.col("qid").cast("string").alias("qid"), F.col("answer").cast("string").alias("answer"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """place of a defect that needs no question; else the content, whether it breaks off, and how its open end begins."""
        for batch in _slices(batches):
            out: list[tuple] = []
            for record, qid, answer in zip(*(c.to_pylist() for c in batch.columns)):
                if is_empty(answer):
                    out.append((record, qid, DEFECTS.index("empty"), None, None, None))
                    continue
                core = undressed(answer)
                if is_refusal(core):
                    out.append((record, qid, DEFECTS.index("refusal"), None, None, None))
                    continue
                cut = is_truncated(answer, core)
                head = None if cut else last_opening(core)
                out.append((record, qid, None, core, cut, " ".join(head) if head else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(PARSED)], schema=PARSED)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            for record, core, cut, head, question in zip(*(c.to_pylist() for c in batch.columns)):
                name = "copies_question" if copies_question(core, question) else "other_language" if other_language(core, question) else "truncated" if cut else None
                if name or head:
                    out.append((record, DEFECTS.index(name) if name else None, head))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string()))], names=["record_id", "place", "opening"])

    # stored, so that the parser runs once for the rows that are decided and for those that are not
    parsed = stored(rows.mapInArrow(parse, "record_id string, qid string, place int, core string, cut boolean, opening string"), "parsed")
    decided = parsed.where("place is not null").select("record_id", "place")
    rest = parsed.where("place is null").select("record_id", "qid", "core", "cut", "opening")
    told = join_one_per_key(rest.where("qid is not null"), latest, "qid", "left").select("record_id", "core", "cut", "opening", "question")
    told = told.unionAll(rest.where("qid is null").select("record_id", "core", "cut", "opening", F.lit(None).cast("string").alias("question")))
    judged = told.mapInArrow(compare, "record_id string, place int, opening string")
    known = frequent_openings(answers).withColumn("known", F.lit(DEFECTS.index("truncated")))
    judged = join_one_per_key(judged, known, "opening", "left").select("record_id", F.coalesce("place", "known").alias("place")).where("place is not null")
    found = decided.unionAll(judged).groupBy("record_id").agg(F.min("place").alias("place"))
    names = F.array(*[F.lit(d) for d in DEFECTS])
    return found.select("record_id", names[F.col("place")].alias("defect"))


PARSED = pa.schema([("record_id", pa.string()), ("qid", pa.string()), ("place", pa.int32()), ("core", pa.string()), ("cut", pa.bool_()), ("opening", pa.string())])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that few whole texts are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
