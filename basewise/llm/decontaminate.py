"""Benchmark decontamination: documents are scanned for the windows of normalised words of test items.

The windows of the test items are broadcast as hashes if the items' text is at most BROADCAST_BYTES; larger sets are
dealt into blocks of that size, and the documents pass by one block after the other. Hits of hashes are verified word
by word.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM_WORDS, LOWER, cut, gram_hashes, map_batches, pieces, scratch, share, spare, table, utf8_view, word_hashes

WINDOW, MIN_ITEMS, BROADCAST_BYTES = 8, 2, 8 << 20


class Windows:
    """The windows of test items as arrays: by length, their distinct hashes in order, for each the place of one window of it and the items that hold it.

    A window is told by its words, which lie in one buffer; one whose hash another window has already (with other
    words) stands in a list of its own."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.names = [name for name, _ in items]
        data, offsets = utf8_view(pa.array([text for _, text in items], pa.large_string()))
        hashes, row, self.start, self.end = word_hashes(data, offsets, ALNUM_WORDS)
        self.low = LOWER[data].tobytes()
        edges = np.searchsorted(row, np.arange(len(items) + 1))
        counts = np.diff(edges)
        self.grams: dict[int, tuple[np.ndarray, ...]] = {}
        self.clashes: dict[tuple[int, int], list[tuple[tuple[bytes, ...], int]]] = {}
        for k in np.unique(np.minimum(counts[counts > 0], window)).tolist():
            grams = gram_hashes(hashes, k)
            place = np.arange(len(grams))
            of = row[: len(grams)]
            inside = (of == row[k - 1 :]) & ((counts[of] == k) if k < window else (counts[of] >= k))
            grams, place, of = grams[inside], place[inside], of[inside]
            order = np.lexsort((of, grams))
            grams, place, of = grams[order], place[order], of[order]
            first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
            group = np.cumsum(np.concatenate(([False], grams[1:] != grams[:-1])))
            # Windows of one hash have the same words, but for clashes; their lengths and bytes tell.
            same = self._same(place, place[first][group], k)
            for i in np.flatnonzero(~same).tolist():
                self.clashes.setdefault((k, int(grams[i])), []).append((self.words(int(place[i]), k), int(of[i])))
            again = np.concatenate(([False], (group[1:] == group[:-1]) & (of[1:] == of[:-1])))
            kept = same & ~again
            self.grams[k] = grams[first], place[first], np.concatenate((np.searchsorted(group[kept], np.arange(len(first))), [int(kept.sum())])), of[kept].astype(np.int32)

    def words(self, place: int, k: int) -> tuple[bytes, ...]:
        return tuple(self.low[s:e] for s, e in zip(self.start[place : place + k].tolist(), self.end[place : place + k].tolist(), strict=True))

    def _same(self, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
        """Whether the windows at a and b have the same words."""
        out = a == b
        for i in np.flatnonzero(~out).tolist():
            out[i] = self.words(int(a[i]), k) == self.words(int(b[i]), k)
        return out

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[set[int]], np.ndarray, np.ndarray]:
        """For the words of some texts: row, hit or not; for each row the numbers of its items; the words' byte positions."""
        hashes, row, start, end = word_hashes(data, offsets, ALNUM_WORDS)
        hit = np.zeros(len(hashes), bool)
        found: list[set[int]] = [set() for _ in range(len(offsets) - 1)]
        low = None
        for k, (known, place, edges, items) in self.grams.items():
            grams = gram_hashes(hashes, k)
            if not len(grams):
                continue
            at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
            for i in np.flatnonzero((known[at] == grams) & (row[: len(grams)] == row[k - 1 :])).tolist():
                low = LOWER[data].tobytes() if low is None else low
                words = tuple(low[s:e] for s, e in zip(start[i : i + k].tolist(), end[i : i + k].tolist(), strict=True))
                j = int(at[i])
                if words == self.words(int(place[j]), k):
                    names = items[edges[j] : edges[j + 1]].tolist()
                else:
                    names = [n for w, n in self.clashes.get((k, int(grams[i])), ()) if w == words]
                if names:
                    hit[i : i + k] = True
                    found[row[i]].update(names)
        return row, hit, found, start, end


def cut_items(items: DataFrame, size: int, window: int = WINDOW) -> DataFrame:
    """(key, text) with texts over size bytes cut into pieces of about that, which overlap so that every window lies in one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys, texts = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            data, offsets = utf8_view(pa.array([text], pa.large_string()))
            _, _, start, end = word_hashes(data, offsets, ALNUM_WORDS) if len(data) > size else ([], [], [0], [len(data)])
            at = 0
            while at < len(start):
                to = max(int(np.searchsorted(end, start[at] + size, "right")), at + window) if len(data) > size else 1
                keys.append(key)
                texts.append(data[start[at] : end[min(to, len(end)) - 1]].tobytes().decode())
                at = len(start) if to >= len(start) else to - window + 1
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(texts, pa.string())], names=["key", "text"])

    return map_batches(items, run, "key string, text string")


def item_blocks(items: DataFrame, key: str, text: str, size: int, window: int = WINDOW) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """The number of blocks of about size bytes, and a function that brings one of them here; items without key or text are left out."""
    items = items.select(F.col(key).cast("string").alias("key"), F.col(text).alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // size) or 1
    if n == 1:
        return 1, lambda _: [tuple(r) for r in items.collect()]
    held = cut(cut_items(items, size // 4, window).withColumn("block", F.pmod(F.xxhash64("key", "text"), F.lit(n))))
    return n, lambda b: [tuple(r) for r in held.where(F.col("block") == b).select("key", "text").collect()]


#: The function that ends a scan gets the batch (kept columns first), the text column, and for each row: bits of its words, number of words, sorted items, and byte positions of its runs of hit words.
Finish = Callable[[pa.RecordBatch, pa.Array, list[np.ndarray], list[list[str]], list[list[int]]], pa.RecordBatch | None]


def scan(docs: DataFrame, items: DataFrame, text: str, keep: list[str], finish: Finish, schema: str, item_key: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """What finish makes of every row, in one pass over the documents for each block of items.

    With several blocks, the passes before the last hand on one bit for each word and the items found so far, and each
    is written, so that driver and workers hold one block at a time."""
    spark, n_keep = docs.sparkSession, len(keep)
    t, h, i = spare(docs, "__text", "__hits", "__items")
    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    state = docs.select(*keep, F.col(text).alias(t))
    with scratch(spark) as hold:
        n, block = item_blocks(items, item_key, item_text, block_bytes, window)
        for number in range(n):
            # The last broadcast is read after this scope.
            held = share(spark, block(number)) if number < n - 1 else spark.sparkContext.broadcast(block(number))

            def run(batch: pa.RecordBatch, held=held, tag=uuid.uuid4().hex, later=number > 0, last=number == n - 1) -> pa.RecordBatch | None:
                windows = _windows(tag, held, window)
                column = batch.column(n_keep)
                data, offsets = utf8_view(column)
                before, listed = (batch.column(n_keep + 1).to_pylist(), batch.column(n_keep + 2).to_pylist()) if later else (None, None)
                bits, got, spans = [], [], []
                for a, b in pieces(offsets):
                    at = offsets[a : b + 1] - offsets[a]
                    row, hit, found, start, end = windows.scan(data[offsets[a] : offsets[b]], at)
                    edges = np.searchsorted(row, np.arange(b - a + 1))
                    for r in range(b - a):
                        lo, hi = int(edges[r]), int(edges[r + 1])
                        one = hit[lo:hi]
                        names = {windows.names[j] for j in found[r]}
                        if later:
                            one = one | np.unpackbits(np.frombuffer(before[a + r], np.uint8), count=hi - lo).astype(bool)
                            names |= set(listed[a + r])
                        where = np.flatnonzero(np.diff(np.concatenate(([False], one, [False])))).reshape(-1, 2) if one.any() else ()
                        spans.append([int(x - at[r]) for s, e in where for x in (start[lo + s], end[lo + e - 1])])
                        bits.append(one)
                        got.append(sorted(names))
                if last:
                    return finish(batch, column, bits, got, spans)
                new = [column, pa.array([np.packbits(x).tobytes() for x in bits], pa.binary()), pa.array(got, pa.list_(pa.string()))]
                return pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(n_keep)), *new], names=[*keep, t, h, i])

            if number < n - 1:
                state = cut(map_batches(state, run, f"{kinds}`{t}` string, `{h}` binary, `{i}` array<string>"))
            else:
                state = map_batches(state, run, schema)
        return hold(state) if n > 1 else state


_made: dict[str, Windows] = {}


def _windows(tag: str, held: Broadcast, window: int) -> Windows:
    """The windows of a broadcast; a worker keeps those of the last tag it saw."""
    if tag not in _made:
        _made.clear()
        _made[tag] = Windows(held.value, window)
    return _made[tag]


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", min_items: int = MIN_ITEMS, **more) -> DataFrame:
    """key, n_words, n_hit, n_items, items_sha256 and contaminated (n_items >= min_items) of every row.

    A null or empty text has no words; an empty set of items hits nothing; an empty table gives no rows; repeated rows
    give repeated rows; other columns, whatever their names, are not read."""
    names = [key, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]

    def finish(batch: pa.RecordBatch, _: pa.Array, bits: list[np.ndarray], got: list[list[str]], spans: list[list[int]]) -> pa.RecordBatch:
        arrays = [batch.column(0), pa.array([len(x) for x in bits], pa.int64()), pa.array([int(x.sum()) for x in bits], pa.int64()), pa.array([len(x) for x in got], pa.int64()), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in got]), pa.array([len(x) >= min_items for x in got])]
        return pa.RecordBatch.from_arrays(arrays, names=names)

    return scan(docs, items, text, [key], finish, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean", **more)


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", min_items: int = MIN_ITEMS, length: str | None = None, **more) -> DataFrame:
    """docs without the rows that hold windows of min_items or more items, and with the hit words of the others cut out.

    What stands between two hit words of one run goes with them; length names a column that holds the text's code
    points and is set anew for the texts that changed. Other columns pass as they are, whatever their names."""
    columns = docs.columns
    rest = [c for c in columns if c != text]

    def finish(batch: pa.RecordBatch, column: pa.Array, bits: list[np.ndarray], got: list[list[str]], spans: list[list[int]]) -> pa.RecordBatch | None:
        stays = [r for r, x in enumerate(got) if len(x) < min_items]
        part = batch.take(pa.array(stays, pa.int64()))
        texts = column.take(pa.array(stays, pa.int64()))
        sizes = part.column(rest.index(length)).to_pylist() if length else []
        if any(spans[r] for r in stays):
            out = texts.to_pylist()
            for at, r in enumerate(stays):
                if s := spans[r]:
                    data = out[at].encode()
                    edges = [0, *s, len(data)]
                    out[at] = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode()
                    if length:
                        sizes[at] = len(out[at])
            texts = pa.array(out, pa.string())
        arrays = {c: part.column(n) for n, c in enumerate(rest)} | {text: texts}
        if length:
            arrays[length] = pa.array(sizes, arrays[length].type)
        return pa.RecordBatch.from_arrays([arrays[c] for c in columns], names=columns)

    return scan(docs, items, text, rest, finish, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), **more)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP7_SQL = r"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
item as (
  select cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null),
grams as (
  select distinct item, least(8, len(w)) as k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') as g
  from (select item, w, unnest(generate_series(1, greatest(len(w) - 7, 1))) as i from item where len(w) > 0)),
lengths as (select distinct k from grams),
wins as (
  select r, i, k, array_to_string(w[i : i + k - 1], ' ') as g
  from (select r, w, k, unnest(generate_series(1, len(w) - k + 1)) as i from doc, lengths where len(w) >= k)),
hits as (select r, i, wins.k, item from wins join grams on wins.k = grams.k and wins.g = grams.g),
words as (select r, count(distinct p) as n_hit from (select r, unnest(generate_series(i, i + k - 1)) as p from hits) group by r),
found as (select r, count(*) as n_items, string_agg(item, ',' order by item) as names from (select distinct r, item from hits) group by r)
select doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(names, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from doc left join words using (r) left join found using (r)
"""
