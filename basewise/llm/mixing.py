"""Mixing sources to target weights, by blocks.

The words of a source's documents, one after the other in a fixed pseudorandom order, are packed into blocks of BLOCK
words. The output is a row of shards of SHARD blocks; each draws how many blocks it takes of each source from a multinomial
whose weights are what the sources still have to give. What a source can't give is drawn again from the others, and the
last shard takes the rest, so that the totals meet the targets to the word. A source's k-th slot takes the block at k under a
pseudorandom permutation of its block numbers, a new permutation for each round over the source. Slots and blocks
meet in a join by source and block number.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, map_batches, scratch, table

WEIGHTS, CAP, BLOCK, SHARD, SEED = (5.0, 2.0, 1.0), 3.0, 64, 4096, 11
#: Documents, and groups of documents, over which one running sum goes.
GROUP = 256
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


def targets(sizes: list[float], weights: list[float], cap: float = CAP) -> list[float]:
    """Shares of sum(sizes) by weight; one over cap times its size stops there, and the excess is shared anew by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), float(sum(sizes))
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > cap * sizes[i]]
        for i in over or free:
            out[i] = cap * sizes[i] if over else unit * weights[i]
        if not over:
            break
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def permute(k: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at k: a Feistel network over the next power of four, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    low, shift = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = k.astype(np.uint64), np.arange(len(k))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & low
        for turn in range(4):
            x = (right + np.uint64((salt * 8 + turn) & (2**64 - 1))) * _STEPS[0]
            x = (x ^ x >> np.uint64(29)) * _STEPS[1]
            x = (x ^ x >> np.uint64(32)) * _STEPS[2]
            left, right = right, left ^ (x >> np.uint64(17) & low)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def draw(counts: list[int], sizes: list[int], seed: list[int]) -> list[list[int]]:
    """For each size in turn, how many of each kind it draws out of what is left of counts; all is drawn in the end."""
    rng, left, out = np.random.Generator(np.random.PCG64(seed)), np.array(counts, np.int64), []
    for size in sizes:
        row, need = np.zeros_like(left), size
        while need:
            total = int(left.sum())
            got = left.copy() if need >= total else np.minimum(rng.multinomial(need, left / total), left)
            left -= got
            row += got
            need = need - int(got.sum()) if need < total else 0
        out.append(row.tolist())
    return out


def parts(total: int, size: int) -> list[int]:
    return [min(size, total - at) for at in range(0, total, size)]


WORD = r"[^ \t\n\x0B\f\r]+"


@dataclass
class Plan:
    """What a mix takes: by source (in order) its slots, blocks and the words of its last slots, and a row for each source."""

    slots: list[int]
    blocks: list[int]
    rest: list[int]
    info: DataFrame
    block: int
    shard: int
    seed: int


def _sized(docs: DataFrame, key: str, text: str, source: str, *more: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), words.alias("size"), row_hash(key, text).alias("h"), *more)


def row_hash(key: str, text: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"), F.col(text))


def plan(sized: DataFrame, weights: tuple[float, ...], cap: float, block: int, shard: int, seed: int) -> Plan:
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("docs")).collect()
    rows = sorted(rows, key=lambda r: (r["source"] is None, r["source"]))
    sizes = [r["size"] for r in rows]
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], cap)
    blocks = [-(-s // block) for s in sizes]
    # Whole rounds over a source, then the slots of the last one; its last slot may take a part of a block.
    rounds = [int(round(t) // s) if s else 0 for t, s in zip(aims, sizes, strict=True)]
    rest = [round(t) - r * s for t, r, s in zip(aims, rounds, sizes, strict=True)]
    slots = [r * b + -(-x // block) for r, b, x in zip(rounds, blocks, rest, strict=True)]
    info = sized.sparkSession.createDataFrame(
        [(i, r["source"], r["size"], t, max(1, -(-r["docs"] // GROUP))) for i, (r, t) in enumerate(zip(rows, aims, strict=True))],
        "n int, source string, source_size bigint, target double, groups bigint",
    )
    return Plan(slots, blocks, rest, info, block, shard, seed)


def mix_sources(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, with_hash: str | None = None) -> DataFrame:
    """key, source, size, source_size, target and taken of every row, and with_hash (row_hash) if it is named.

    size: words (runs of characters other than ASCII white space); null and empty texts have none and are never taken.
    Sources stand in code point order, null last, and have the weights in turn. Repeated rows count each on their own;
    an empty table gives no rows; other columns are not read. The same rows give the same result in any order."""
    with scratch(docs.sparkSession) as keep:
        sized = cut(_sized(docs, key, text, source))
        got = _taken(sized, plan(sized, weights, cap, block, shard, seed))
        names = [*([F.col("h").alias(with_hash)] if with_hash else []), F.col("key").alias(key), "source", "size", "source_size", "target", "taken"]
        return keep(got.select(*names))


def mix_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The mix itself: shard, slot (in the shard and source), source, keys (of the documents in the block, in order), words and text of every block taken.

    The same documents, weights and seed take of each document as many words as mix_sources says."""
    with scratch(docs.sparkSession) as keep:
        sized = cut(_sized(docs, key, text, source))
        mix = plan(sized, weights, cap, block, shard, seed)
        rows = docs.select(F.struct(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")).alias("r")).select("r.*")
        starts = _starts(_sized(rows, "key", "text", "source", "text"), sized, mix)
        return keep(_blocks(starts, mix, docs.schema[key].dataType.simpleString()))


def _starts(rows: DataFrame, sized: DataFrame, mix: Plan) -> DataFrame:
    """rows with their source's number n, group g, place in it (row), and the word of the source at which each begins (at): running sums over groups of groups, groups, and documents."""

    def placed(df: DataFrame) -> DataFrame:
        out = df.withColumnRenamed("source", "s").join(F.broadcast(mix.info), F.col("s").eqNullSafe(F.col("source"))).drop("s")
        return out.withColumn("g", F.pmod(F.xxhash64("h", "key", F.lit(mix.seed)), F.col("groups"))).drop("groups")

    sums = cut(placed(sized).groupBy("n", "g").agg(F.sum("size").alias("size")).withColumn("gg", F.expr(f"g div {GROUP}")))

    def before(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumn(name, F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, -1))).fillna(0, [name])

    tops = before(sums.groupBy("n", "gg").agg(F.sum("size").alias("size")), ["n"], ["gg"], "a0").drop("size")
    mids = before(sums, ["n", "gg"], ["g"], "a1").drop("size").join(tops, ["n", "gg"]).select("n", "g", (F.col("a0") + F.col("a1")).alias("a"))
    by = Window.partitionBy("n", "g").orderBy("key", "h")
    return before(placed(rows).withColumn("row", F.row_number().over(by)), ["n", "g"], ["row"], "a2").join(mids, ["n", "g"]).withColumn("at", F.col("a") + F.col("a2"))


def _slots(spark: SparkSession, mix: Plan) -> DataFrame:
    """run, shard, n, slot, block and words of every block that the mix takes: shards in runs, of which the driver draws the totals and an executor those of the shards."""
    slots, blocks, rest, block, shard, seed = mix.slots, mix.blocks, mix.rest, mix.block, mix.shard, mix.seed
    run = shard * max(1, int((sum(slots) / shard) ** 0.5))
    rows, begin = [], [0] * len(slots)
    for r, (row, size) in enumerate(zip(draw(slots, parts(sum(slots), run), [seed]), parts(sum(slots), run), strict=True)):
        rows.append((r, size, row, list(begin)))
        begin = [a + b for a, b in zip(begin, row, strict=True)]
    runs = spark.createDataFrame(rows, "run bigint, size bigint, counts array<bigint>, begin array<bigint>").repartition(max(1, min(len(rows), 256)), "run")

    def shards(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r, size, counts, begin in zip(*batch.to_pydict().values(), strict=True):
            for k, row in enumerate(draw(counts, parts(size, shard), [seed, r])):
                out += [(r, k, i, begin[i], c) for i, c in enumerate(row) if c]
                begin = [a + c for a, c in zip(begin, row, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, names=["run", "shard", "n", "first", "count"])

    def mapped(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for r, k, i, first, count in zip(*(batch.column(c).to_pylist() for c in ("run", "shard", "n", "first", "count")), strict=True):
            slot, b = np.arange(first, first + count), blocks[i]
            at = np.empty(count, np.int64)
            for turn in range(first // b, (first + count - 1) // b + 1):
                of = slot // b == turn
                at[of] = permute(slot[of] - turn * b, b, (seed << 40) + (i << 20) + turn)
            words = np.where(slot == slots[i] - 1, rest[i] - (-(-rest[i] // block) - 1) * block if rest[i] else block, block)
            out.append((np.full(count, r), np.full(count, k), np.full(count, i), slot, at, words))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["run", "shard", "n", "slot", "block", "words"])

    drawn = map_batches(runs, shards, "run bigint, shard bigint, n bigint, first bigint, count bigint")
    return map_batches(drawn, mapped, "run bigint, shard bigint, n bigint, slot bigint, block bigint, words bigint").withColumn("n", F.col("n").cast("int"))


def _taken(sized: DataFrame, mix: Plan) -> DataFrame:
    """The rows of sized with the words that the slots take of each."""
    block, starts = mix.block, _starts(sized, sized, mix)
    spans = starts.withColumn("block", F.explode_outer(F.expr(f"if(size > 0, sequence(at div {block}, (at + size - 1) div {block}), null)")))
    low = F.greatest(F.col("at") - F.col("block") * block, F.lit(0))
    spans = spans.withColumn("low", low).withColumn("high", F.least(F.col("at") + F.col("size") - F.col("block") * block, F.lit(block)))
    whole = F.col("words") == block
    times = _slots(sized.sparkSession, mix).groupBy("n", "block").agg(F.sum(whole.cast("bigint")).alias("times"), F.max(F.when(~whole, F.col("words"))).alias("part"))
    # The plan can't tell how many slots the few runs become, and would broadcast them.
    joined = spans.join(times.hint("merge"), ["n", "block"], "left")
    part = F.when(F.col("part").isNotNull(), F.greatest(F.least("high", "part") - F.col("low"), F.lit(0))).otherwise(0)
    share = F.coalesce("times", F.lit(0)) * (F.col("high") - F.col("low")) + part
    return joined.groupBy("n", "g", "row").agg(*(F.first(c).alias(c) for c in ("key", "h", "source", "size", "source_size", "target")), F.coalesce(F.sum(share), F.lit(0)).cast("bigint").alias("taken"))


def _blocks(starts: DataFrame, mix: Plan, kind: str) -> DataFrame:
    """The blocks that the slots take, with their words."""
    block = mix.block

    def packed(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for n, key, at, text in zip(*(batch.column(c).to_pylist() for c in ("n", "key", "at", "text")), strict=True):
            words = re.findall(r"[^ \t-\r]+", text or "")
            done = 0
            while done < len(words):
                b, low = divmod(at + done, block)
                some = words[done : done + block - low]
                out.append((n, b, low, key, " ".join(some)))
                done += len(some)
        names, kinds = ["n", "block", "low", "key", "text"], [pa.int32(), pa.int64(), pa.int64(), batch.schema.field("key").type, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    made = map_batches(starts.where("size > 0").select("n", "key", "at", "text"), packed, f"n int, block bigint, low bigint, key {kind}, text string")
    made = made.groupBy("n", "block").agg(F.array_sort(F.collect_list(F.struct("low", "key", "text"))).alias("parts"))
    got = _slots(starts.sparkSession, mix).hint("merge").join(made, ["n", "block"]).join(F.broadcast(mix.info.select("n", "source")), "n")
    held = F.filter("parts", lambda p: p["low"] < F.col("words"))
    words = F.slice(F.split(F.array_join(F.transform(held, lambda p: p["text"]), " "), " "), 1, F.col("words").cast("int"))
    w = max(1, int((sum(mix.slots) / mix.shard) ** 0.5))
    return got.select((F.col("run") * w + F.col("shard")).alias("shard"), "slot", "source", F.transform(held, lambda p: p["key"]).alias("keys"), F.size(words).cast("bigint").alias("words"), F.array_join(words, " ").alias("text"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
