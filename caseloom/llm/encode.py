"""Encoding of a corpus with a public byte-level BPE vocabulary, by prefix-sharing trie traversal."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = os.environ.get("CASELOOM_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"

# Fixed value: how byte_bpe_50k cuts a text into words before merging. White space is the Unicode property.
WORD_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\p{White_Space}\p{L}\p{N}]++|\p{White_Space}++(?!\P{White_Space})|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}"

MEMO_BYTES = 64_000_000  # words remembered by a task; when full it is emptied, which only costs time


class WordTrie:
    """Encodes distinct words together: what words share as a prefix is encoded once.

    The state of a trie node is the last token of the encoding of the bytes down to it. The encoding of
    a prefix is the encoding of the prefix before its last token, followed by that token; and of all
    vocabulary entries that end at a node, exactly one may follow the last token of the node where it
    begins. So states flow down the trie depth first, and an encoding is read off upwards.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def merged(self, piece: bytes) -> list[bytes]:
        """Plain merging of a short piece, by lowest rank, leftmost first."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether two tokens stay as they are when their bytes are encoded together; left is empty at the root."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = self.merged(left + right) == [part for part in (left, right) if part]
        return known

    def last_token(self, word: bytes, end: int, states: list[bytes]) -> bytes:
        """The state of the node at word[:end]; states[i] is that of word[:i]."""
        for size in range(min(end, self.longest), 0, -1):
            token = word[end - size : end]
            if token in self.ranks and self.may_follow(states[end - size], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, words: Iterable[bytes]) -> dict[bytes, list[int]]:
        """The ids of every word. Sorted words are the trie's paths in depth-first order."""
        out: dict[bytes, list[int]] = {}
        states: list[bytes] = [b""]
        before = b""
        for word in sorted(words):
            shared = len(os.path.commonprefix([before, word]))
            del states[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                states.append(self.last_token(word, end, states))
            ids, end = [], len(word)
            while end:
                ids.append(self.ranks[states[end]])
                end -= len(states[end])
            out[word] = ids[::-1]
            before = word
        return out


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its id on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_corpus(documents: DataFrame, key: str, text: str, vocabulary: str = DEFAULT_VOCABULARY, pattern: str = WORD_PATTERN) -> DataFrame:
    """(key, ids): the token ids of every document, without special tokens.

    Every task cuts its documents into words and inserts the distinct new ones of a batch into a trie,
    where shared prefixes are encoded once; nothing is shuffled. The words already encoded by a task
    are kept up to MEMO_BYTES. Null and empty texts get an empty list; special-token strings are ordinary text;
    a null key is kept; repeated rows give repeated rows; an empty table gives an empty result. The
    vocabulary path must be readable on every executor.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, cut = WordTrie(read_ranks(vocabulary)), regex.compile(pattern)
        memo: dict[str, np.ndarray] = {}
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                words = [cut.findall(t) if t else [] for t in part.column(1).to_pylist()]
                fresh = {w.encode() for ws in words for w in ws if w not in memo}
                if held + 200 * len(trie.fits) > MEMO_BYTES:
                    memo, held, trie.fits = {}, 0, {}
                    fresh = {w.encode() for ws in words for w in ws}
                for word, ids in trie.encode(fresh).items():
                    memo[word.decode()] = np.array(ids, np.int32)
                    held += 4 * len(ids) + len(word) + 200
                flat = [memo[w] for ws in words for w in ws]
                lengths = [sum(len(memo[w]) for w in ws) for ws in words]
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, values)], names=[key, "ids"])

    kind = documents.schema[key].dataType.simpleString()
    return documents.select(F.col(key), F.col(text).cast("string")).mapInArrow(encode, f"`{key}` {kind}, ids array<int>")
