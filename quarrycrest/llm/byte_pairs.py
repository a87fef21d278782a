"""Exact byte-pair encoding of a corpus with a public vocabulary.

Texts are cut into words by the vocabulary's own pattern.  A word's tokens are
found without replaying merges: an Aho-Corasick automaton gives all tokens that
match anywhere in the word; from left to right the longest is taken, and a shorter
one, or a step back, where two neighbours are not compatible, that is where merging
would have joined bytes across their border.  Compatibility is read off the table
of splits (each token's last merge).  Places that proved a dead end are not entered
again, so the work stays linear in the word's length.  Decoding copies bytes by an
offset table.

Null and empty texts have the empty list; no text is an error.  Special tokens are
never produced: their strings are ordinary text.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycrest.llm.common import map_texts

#: How byte-level vocabularies of this family cut a text into words (fixed value).
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words whose tokens a worker remembers; then it starts afresh.
REMEMBERED = 400_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_vocabulary(path: str) -> list[bytes]:
    """Tokens by id, from lines of base64 and rank.  Ids must be the ranks 0, 1, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    found = {int(rank): base64.b64decode(token) for token, rank in pairs}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


class Encoder:
    def __init__(self, tokens: list[bytes], words: str = WORDS):
        self.tokens = tokens
        self.length = [len(t) for t in tokens]
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.words = regex.compile(words)
        self.automaton = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.pairs: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = []
        for i, t in enumerate(tokens):
            self.split.append(self._last_merge(i, t))
        self.seen: dict[str, list[int]] = {}
        self.offsets = np.concatenate(([0], np.cumsum(self.length)))
        self.bytes = b"".join(tokens)

    def _prefix(self, token: bytes) -> int:
        """The longest token that begins this one and is shorter; -1: none."""
        for n in range(len(token) - 1, 0, -1):
            i = self.ids.get(token[:n])
            if i is not None:
                return i
        return -1

    def _last_merge(self, i: int, token: bytes) -> tuple[int, int]:
        """The two older tokens whose merge makes token i; (i, i) for single bytes."""
        a = self.shorter[i]
        while a >= 0:
            b = self.ids.get(token[self.length[a] :])
            if b is not None and a < i and b < i and self.compatible(a, b):
                self.pairs[a, b] = i
                return a, b
            a = self.shorter[a]
        return i, i

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between tokens a and b standing.  The
        merges that made them are undone, newest first; a merge across the border
        that is older than those already undone would have come before them."""
        newest = len(self.tokens) + 1
        while True:
            joined = self.pairs.get((a, b))
            if joined is not None and joined < newest:
                return False
            for side in (0, 1) if a > b else (1, 0):
                if side == 0:
                    inner = self.split[a][1] if a < len(self.split) else a
                    newest, moved, a = a, inner != a, inner
                else:
                    inner = self.split[b][0] if b < len(self.split) else b
                    newest, moved, b = b + 1, inner != b, inner
                if moved:
                    break
            else:
                return True

    def word(self, word: str) -> list[int]:
        raw = word.encode("utf-8", "surrogatepass")
        whole = self.ids.get(raw)
        if whole is not None and (len(raw) == 1 or self.split[whole] != (whole, whole)):
            return [whole]
        n = len(raw)
        longest = [-1] * (n + 1)
        for end, i in self.automaton.iter(raw.decode("latin-1")):
            start = end + 1 - self.length[i]
            if longest[start] < 0 or self.length[i] > self.length[longest[start]]:
                longest[start] = i
        out: list[int] = []
        alive = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + self.length[token]
                if alive[end] and (last < 0 or self.compatible(last, token)):
                    out.append(token)
                    at, token = end, longest[end] if end < n else -1
                    break
                token = self.shorter[token]
            else:
                if last < 0:
                    raise ValueError("the vocabulary lacks a byte")
                alive[at] = 0
                out.pop()
                at -= self.length[last]
                token = last
        return out

    def encode(self, text: str) -> list[int]:
        seen, out = self.seen, []
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in self.words.findall(text):
            ids = seen.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    seen[w] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        o = self.offsets
        return b"".join(self.bytes[o[i] : o[i + 1]] for i in ids).decode("utf-8", "replace")


@lru_cache(2)
def _encoder(packed: bytes) -> Encoder:
    import pickle

    return Encoder(pickle.loads(packed))


def _broadcast(df: DataFrame, path: str | None):
    """The vocabulary goes to the workers as a broadcast: its size is that of a file
    of fixed content (about half a megabyte), whatever the corpus."""
    import pickle

    return df.sparkSession.sparkContext.broadcast(pickle.dumps(read_vocabulary(path or vocabulary_path())))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): one row for each row of df, rows with null keys included."""
    vocabulary = _broadcast(df, path)

    def run(rows: pa.RecordBatch, texts: list):
        encoder = _encoder(vocabulary.value)
        ids = [encoder.encode(t) if t else [] for t in texts]
        return pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return map_texts(df.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), f"doc_id {dict(df.dtypes)[key]}, ids array<int>", "text", run)


def count_tokens(df: DataFrame, text: str = "text", path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of ``keep`` and ``tokens``, the length of the text's encoding."""
    vocabulary = _broadcast(df, path)
    types = dict(df.dtypes)

    def run(rows: pa.RecordBatch, texts: list):
        encoder = _encoder(vocabulary.value)
        n = pa.array([len(encoder.encode(t)) if t else 0 for t in texts], pa.int64())
        return pa.RecordBatch.from_arrays([*rows.columns[:-1], n], [*keep, "tokens"])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "tokens bigint"])
    return map_texts(df.select(*keep, F.col(text).alias("text_")), schema, "text_", run)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(doc_id, text) of encoded rows; null ids give a null text."""
    vocabulary = _broadcast(df, path)

    def run(batches):
        for rows in batches:
            encoder = _encoder(vocabulary.value)
            texts = [None if x is None else encoder.decode(x) for x in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return df.select(F.col(key).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, f"doc_id {dict(df.dtypes)[key]}, text string")
