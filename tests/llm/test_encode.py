import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseloom.llm.encode import DEFAULT_VOCABULARY, WORD_PATTERN, WordTrie, encode_corpus, read_ranks

tokenizers = pytest.importorskip("tokenizers")
regex = pytest.importorskip("regex")
HERE = os.path.dirname(DEFAULT_VOCABULARY)


@pytest.fixture(scope="module")
def public():
    t = tokenizers.Tokenizer.from_file(f"{HERE}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TRIE = WordTrie(read_ranks(DEFAULT_VOCABULARY))
CUT = regex.compile(WORD_PATTERN)


def encoded(text):
    words = CUT.findall(text)
    assert "".join(words) == text
    ids = TRIE.encode({w.encode() for w in words})
    return [i for w in words for i in ids[w.encode()]]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    t = tokenizers.Tokenizer.from_file(f"{HERE}/byte_bpe_50k.json") if not hasattr(test_any_text, "t") else test_any_text.t
    t.encode_special_tokens = True
    test_any_text.t = t
    assert encoded(text) == t.encode(text, add_special_tokens=False).ids


def test_odd_texts(public):
    for text in ["it's I'LL we'Re", "  a\t\n\n b  ", "x" * 5000, " " * 999 + "q", "<|endoftext|> hi", "日本語１２３ ½", "\x1c\x1d a\x85b", "🫁🩻" * 30, "е́́", "ab" * 3000]:
        assert encoded(text) == public.encode(text, add_special_tokens=False).ids


def test_corpus(spark, public):
    texts = ["a cat", None, "", "a cat", "the cats' " * 3000, "\x00 nul"]
    df = spark.createDataFrame([(i if i != 3 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = sorted(((r["doc_id"] is None, r["doc_id"]), r["ids"]) for r in encode_corpus(df, "doc_id", "text").collect())
    assert [x for _, x in got] == [public.encode(t or "", add_special_tokens=False).ids for t in [*texts[:3], *texts[4:], texts[3]]]
    assert encode_corpus(df.limit(0), "doc_id", "text").count() == 0


def test_round_trip():
    ids = {v: k for k, v in TRIE.ranks.items()}
    text = "Ünïcode täxt, with 12 mm nodules…"
    assert b"".join(ids[i] for i in encoded(text)).decode() == text
