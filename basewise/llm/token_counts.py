"""Token counts by overlap resynchronisation.

A text longer than CHUNK code points is encoded as overlapping chunks with offsets, of tokens, or of words with the number
of their tokens. Two neighbouring chunks are spliced at a boundary that is *common* (both encodings have a token or word
that starts there, and the last one before it ends there or earlier in both) and *proven stable* (the character before it is white space, which no token, added
token or normalisation step of the tokenizer crosses). Where an overlap has no such boundary, it is widened, up to the
rest of the text, where the encoding is the whole text's own.

Short texts are encoded whole. Where the tokenizer is of the kind WORD_KIND, its first steps (normal form, lower case,
split) are plain enough to be done on a whole text at once, and a worker keeps the library's answer for each word
(bounded by MEMO, kept from task to task); texts with code points from U+0300 on, with letters whose lower case is
there, or with the marks of special tokens go to the library as they are.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, table

CHUNK, OVERLAP, MEMO = 8192, 256, 200_000
VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048

#: The code points that Unicode calls White_Space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
BLANK = re.compile(f"[{SPACE}]")
#: Below U+0300 every text is its own NFC, and lower case goes by single characters; a few of them become letters beyond.
FAR = "".join(c for c in map(chr, range(0x300)) if any(ord(x) >= 0x300 and unicodedata.category(x)[0] in "LN" for x in c.lower()))
PLAIN = re.compile(f"[^\\x00-\u02ff]|[{FAR}]|<\\|")

#: The parts of the tokenizer file that make up WORD_KIND.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_STEPS = ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"]


def plain_split() -> re.Pattern[str]:
    """WORD_SPLIT for lower-cased texts below U+0300, with its classes written out."""
    kinds: dict[str, str] = {"L": "", "N": ""}
    for c in map(chr, range(0x300)):
        if (kind := unicodedata.category(c)[0]) in kinds:
            kinds[kind] += re.escape(c)
    return re.compile(f"'(?:[stmd]|re|ve|ll)|[{kinds['L']}]+|[{kinds['N']}]|[^{SPACE}{kinds['L']}{kinds['N']}]+")


class Words(dict):
    """The number of tokens of a word, as the library's model gives it."""

    def __init__(self, tokenizer):
        super().__init__()
        self.model, self.split = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        ready = [word] if word.isascii() and word.isprintable() else [x for x, _ in self.split(word)]
        n = self[word] = sum(len(self.model.tokenize(x)) for x in ready)
        return n


class Encoder:
    """The library's tokenizer, with offsets."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path) as f:
            told = json.load(f)
        steps = [*(told["normalizer"] or {}).get("normalizers", []), *(told["pre_tokenizer"] or {}).get("pretokenizers", [])]
        splits = [x["pattern"].get("Regex") for x in steps if x["type"] == "Split"]
        marks = all(x["content"].startswith("<|") for x in told["added_tokens"])
        self.words = Words(self.tokenizer) if [x["type"] for x in steps] == WORD_STEPS and splits == [WORD_SPLIT] and marks and not told["post_processor"] else None
        self.split = plain_split().findall
        self.find = plain_split().finditer

    def offsets(self, text: str) -> list[tuple[int, int, int]]:
        """Start and end of every word that the first steps make of text, with the number of its tokens; of every token, where they aren't plain."""
        if self.words is not None and PLAIN.search(text) is None and len(low := text.lower()) == len(text):
            return [(m.start(), m.end(), self.words[m[0]]) for m in self.find(low)]
        return [(s, e, 1) for s, e in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def counts(self, texts: list[str]) -> list[int]:
        out = [-1] * len(texts)
        if self.words is not None:
            count = self.words.__getitem__
            for i, t in enumerate(texts):
                if PLAIN.search(t) is None:
                    out[i] = sum(map(count, self.split(t.lower())))
        if rest := [i for i, n in enumerate(out) if n < 0]:
            for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
                out[i] = len(e.ids)
        return out


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """The encoder of a vocabulary; a worker keeps the last one."""
    if vocabulary not in _encoders:
        import public_tokenizers

        _encoders.clear()
        _encoders[vocabulary] = Encoder(public_tokenizers.path(vocabulary))
    return _encoders[vocabulary]


def splice(left: list[tuple[int, int, int]], right: list[tuple[int, int, int]], text: str, low: int) -> tuple[int, int] | None:
    """Entries of left to keep, and entries of right to drop, at the first proven common boundary at or after low; None if there is none.

    right must come from a chunk that begins at low. The boundary is the start of an entry (a token, or a word with all
    its tokens) in both, and both agree on it."""
    starts = {s: i for i, (s, _, _) in enumerate(right)}
    for i in range(bisect_left(left, (low, low, 0)), len(left)):
        s, e, n = left[i]
        j = starts.get(s)
        if j is not None and s > low and BLANK.match(text, s - 1) and right[j][1:] == (e, n) and (i == 0 or left[i - 1][1] <= s) and (j == 0 or right[j - 1][1] <= s):
            return i, j
    return None


def count_long(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[int, int]:
    """Tokens of text, from overlapping chunks, and how many chunks were encoded."""
    total, begin, end, width, chunks = 0, 0, min(len(text), chunk), overlap, 1
    left = encoder.offsets(text[:end])
    while end < len(text):
        low = max(begin, end - width)
        stop = min(len(text), low + max(chunk, 2 * width))
        right = [(s + low, e + low, n) for s, e, n in encoder.offsets(text[low:stop])]
        chunks += 1
        if at := splice(left, right, text, low):
            total += sum(x[2] for x in left[: at[0]])
            left, begin, end, width = right[at[1] :], right[at[1]][0], stop, overlap
        elif low > begin:
            width *= 4
        else:  # the overlap is the whole left chunk, and right the same chunk made longer
            left, end, width = right, stop, 4 * width
    return total + sum(x[2] for x in left), chunks


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, limit: int = LIMIT, chunk: int = CHUNK) -> DataFrame:
    """key, n_bytes, n_tokens, over_limit (n_tokens > limit) and n_chunks (overlapping chunks; 1: encoded whole) of every row.

    Null and empty texts have 0 bytes and tokens; repeated rows give repeated rows; other columns are not read; an
    empty table gives no rows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        held = encoder(vocabulary)
        texts = [t or "" for t in batch.column(1).to_pylist()]
        n = np.zeros(len(texts), np.int64)
        short = [i for i, t in enumerate(texts) if len(t) <= chunk]
        n[short] = held.counts([texts[i] for i in short])
        chunks = np.ones(len(texts), np.int64)
        for i, t in enumerate(texts):
            if len(t) > chunk:
                n[i], chunks[i] = count_long(t, held, chunk)
        size = [len(t.encode()) for t in texts]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit), pa.array(chunks)], names=[key, "n_bytes", "n_tokens", "over_limit", "n_chunks"])

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(key, text), run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean, n_chunks bigint")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
