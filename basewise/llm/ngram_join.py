"""Exact n-gram Jaccard join with signature trees.

1. Texts become sets of hashed word n-grams; texts of the same set are one class.
2. In any fixed order of all grams, two sets with Jaccard similarity of at least t share k of the first
   ``n - ceil(t n) + k`` grams of each (k by the smaller set's size; see prefix()). The order puts frequent grams last, so
   that passages that many texts share seldom count. Grams that stand among the first of one class only are dropped,
   then classes with fewer than k grams left. Of the k grams that two similar sets share, k/2 or more stand in PAIRED
   classes at most, or more than k/2 in more classes. The former are counted pair by pair, so that grams that sets share
   by chance, whose number grows with the table, join no families. Of the latter, grams and classes are dropped in turns,
   and each gram ties its classes to its smallest one. Pairs and ties make the families.
3. A family is searched by a signature tree. Its leaves are sets; a node holds the OR of the bitmaps of its sets, the
   range of their sizes, and how many grams a bitmap may hide. A traversal of the tree against itself (or another tree)
   prunes pairs of nodes whose largest possible overlap is too small, and those that are linked already; leaves are
   compared gram by gram. Only links that join two components are returned, never all pairs.
4. A family of more than CHUNK classes is dealt into chunks. Each is searched together with the family's hub (which most
   members of a group of copies resemble). Then the chunks' members of the family's largest component, and the rest
   dealt anew, are the leaves of an upper tree: from its top down, pairs of a node of the rest and any other that pass
   the bounds are opened, and the pairs of leaves that are left are searched, part against part.

Grams are told apart by 64 bits, classes by 128 and, where they are nodes of the graph, by 64. Two of N different classes
share those 64 bits (and become one component wrongly) with a chance of about N * N / 2**65: 3e-8 for a million classes,
0.03 for a billion. Two texts are compared wrongly only if different grams of theirs have the same hash (1e-13 for two
texts of a thousand grams).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK_WORDS, cut, drop, gram_hashes, map_batches, mix, pieces, release, scratch, settle, share, slices, small_batches, table, utf8_view, word_hashes

GRAM, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Sets in one search, bits of a leaf's bitmap, sets or nodes below a node.
CHUNK, BITS, FAN = 512, 4096, 8
#: Bits of a node of the upper tree; classes whose keys are broadcast, at most.
UPPER_BITS, BROADCAST = 1 << 16, 500_000
#: A gram is frequent if so many of SAMPLE neighbouring texts hold it; so many frequent grams are kept at most. A gram of
#: d in N texts meets itself in some sample from about d = sqrt(2 N / SAMPLE) on, and rarer ones need no rank.
LOCAL, SAMPLE, FREQUENT = 2, 8000, 400_000
#: k by size (a share of it), turns of dropping grams and classes, and the most classes of a gram that meet pair by pair.
EXTRA, TURNS, PAIRED = 0.1, 3, 6
#: A key of a join is hot if more than HOT rows have it, and more than one in HOT_KEYS: so there are HOT_KEYS of them at most.
HOT, HOT_KEYS = 100_000, 1000
#: A graph of so many edges at most is solved on the driver.
EDGES = 200_000


def need(sizes: np.ndarray | int) -> np.ndarray | int:
    """The smallest overlap that a set of this size can have with a similar one: ceil(t n)."""
    return -(-NUMERATOR * sizes // DENOMINATOR)


def extra(sizes: int) -> int:
    """k for a set of this size."""
    return max(1, int(EXTRA * sizes))


def prefix(size: int) -> tuple[int, int]:
    """How many first grams of a set count, and how many of them any similar set must share.

    Of two similar sets let A be the one whose last counted gram comes first in the order. They share ceil(t |A|) grams
    or more, of which at most |A| less the counted ones, ceil(t |A|) - k(A), don't count in A; so k(A) or more do, and as
    they come no later than the last counted gram of the other set, they count there too. The sizes of the two differ
    by the factor t at most."""
    return size - int(need(size)) + extra(size), extra(int(need(size)))


def gram_sets(data: np.ndarray, offsets: np.ndarray, k: int = GRAM) -> list[np.ndarray]:
    """The sorted distinct grams of each text; a text of fewer words is one gram, one without words none."""
    words, row, _, _ = word_hashes(data, offsets, BLANK_WORDS)
    edges = np.searchsorted(row, np.arange(len(offsets)))
    grams = gram_hashes(words, k)
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        else:
            out.append(gram_hashes(words[a:b], b - a) if b > a else grams[:0])
    return out


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set (two sums of its mixed grams); 0, 0 for the empty set."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    edges = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ np.uint64(salt)), dtype=np.uint64)))
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]]).astype(np.int64))
    return out[0], out[1]


# -- signature trees --------------------------------------------------------------------------------


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def bitmap(grams: np.ndarray, bits: int = BITS) -> np.ndarray:
    out = np.zeros(bits, bool)
    out[(grams >> np.uint64(7)) % np.uint64(bits)] = True
    return np.packbits(out).view(np.uint64)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(-1, dtype=np.int64)


class Tree:
    """Levels of nodes from the leaves up. Of each node: OR-ed bitmap, smallest and largest size, and the most grams that a set below it has beyond its bits."""

    def __init__(self, sets: list[np.ndarray], order: np.ndarray, bits: int = BITS, fan: int = FAN):
        self.order = order
        maps = np.stack([bitmap(sets[i], bits) for i in order])
        size = np.array([len(sets[i]) for i in order], np.int64)
        self.levels = [(maps, size, size, size - popcount(maps))]
        self.fan = fan
        while len(self.levels[-1][0]) > 1:
            m, low, high, hidden = self.levels[-1]
            at = np.arange(0, len(m), fan)
            self.levels.append((np.bitwise_or.reduceat(m, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))

    def children(self, level: int, node: int) -> range:
        return range(node * self.fan, min((node + 1) * self.fan, len(self.levels[level - 1][0])))


def possible(a: tuple, i: np.ndarray, b: tuple, j: np.ndarray) -> np.ndarray:
    """Which pairs of nodes may hold two similar sets.

    Two sets share at most as many grams as their nodes share bits, plus the grams that the bitmap of either hides;
    sets of sizes x and y are similar from an overlap of ceil(t (x + y) / (1 + t)) on."""
    low = a[1][i] + b[1][j]
    share = popcount(a[0][i] & b[0][j]) + np.minimum(a[3][i], b[3][j])
    fits = (DENOMINATOR * a[2][i] >= NUMERATOR * b[1][j]) & (DENOMINATOR * b[2][j] >= NUMERATOR * a[1][i])
    return fits & (share * (NUMERATOR + DENOMINATOR) >= NUMERATOR * low)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    same = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * same >= NUMERATOR * (len(a) + len(b) - same) and same > 0


def clustered(sets: list[np.ndarray]) -> np.ndarray:
    """An order in which similar sets stand near each other: by smallest gram, then size."""
    return np.lexsort((np.array([len(s) for s in sets]), np.array([s[0] for s in sets])))


def search(sets: list[np.ndarray], union: Union, left: list[int], right: list[int] | None = None) -> list[tuple[int, int]]:
    """Links between similar sets of left (and right, if given) that join two components; by dual traversal of signature trees."""

    def tree(which: list[int]) -> Tree:
        own = [sets[i] for i in which]
        # Bitmaps are long enough for the largest set of the tree pair, so that they tell something.
        return Tree(sets, np.array(which)[clustered(own)], bits)

    largest = max((len(sets[i]) for i in [*left, *(right or [])]), default=0)
    bits = BITS
    while bits < 4 * largest and bits < 1 << 18:
        bits *= 2
    one = tree(left)
    two = one if right is None else tree(right)
    links: list[tuple[int, int]] = []
    if right is None:  # copies of one text first: most components come together along the order
        for a, b in zip(one.order[:-1].tolist(), one.order[1:].tolist(), strict=True):
            if union.find(a) != union.find(b) and similar(sets[a], sets[b]) and union.join(a, b):
                links.append((a, b))
        hub = int(np.bincount([union.find(int(i)) for i in one.order]).argmax())
        for a in one.order.tolist():
            if union.find(a) != union.find(hub) and similar(sets[a], sets[hub]) and union.join(a, hub):
                links.append((a, hub))

    def component(t: Tree) -> list[np.ndarray]:
        """Of every node the one component that all below it belong to, or -1."""
        out = [np.array([union.find(int(i)) for i in t.order])]
        for _ in t.levels[1:]:
            at = np.arange(0, len(out[-1]), t.fan)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where((low == high) & (low >= 0), low, -1))
        return out

    of_one = component(one)
    of_two = of_one if two is one else component(two)
    stack = [(len(one.levels) - 1, 0, len(two.levels) - 1, 0)]
    while stack:
        la, a, lb, b = stack.pop()
        if la == lb == 0:
            x, y = int(one.order[a]), int(two.order[b])
            if x != y and union.find(x) != union.find(y) and similar(sets[x], sets[y]):
                union.join(x, y)
                links.append((x, y))
            continue
        # Open the higher node, or both of the same level.
        ca = np.array(one.children(la, a)) if la >= lb else np.array([a])
        cb = np.array(two.children(lb, b)) if lb >= la else np.array([b])
        na, nb = la - (la >= lb), lb - (lb >= la)
        i, j = np.repeat(ca, len(cb)), np.tile(cb, len(ca))
        if two is one and na == nb:
            half = i <= j
            i, j = i[half], j[half]
            if na == 0:
                i, j = i[i < j], j[i < j]
        same = (of_one[na][i] >= 0) & (of_one[na][i] == of_two[nb][j])
        i, j = i[~same], j[~same]
        if len(i):
            good = possible(one.levels[na], i, two.levels[nb], j)
            stack += [(na, int(x), nb, int(y)) for x, y in zip(i[good], j[good], strict=True)]
    return links


# -- the distributed join -----------------------------------------------------------------------------


def hot_keys(counts: DataFrame, key: str, total: int) -> list[int]:
    """The hot keys, of counts (key, n) that sum to total at most: no more than HOT_KEYS."""
    return [r[0] for r in counts.where(F.col("n") > max(HOT, total // HOT_KEYS)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list[int], how: str) -> DataFrame:
    """left.join(right, key, how), where right has one row for each key: rows of hot keys stay where they are, and right's come to them."""
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    return left.where(is_hot).join(F.broadcast(right.where(is_hot)), key, how).unionByName(left.where(~is_hot).join(right.where(~is_hot), key, how))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node reaches over edges. Rows for nodes that have edges only."""
    with scratch(edges.sparkSession) as keep:
        both = cut(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        return keep(_few_components(both) if both.count() <= EDGES else _many_components(both))


def _few_components(both: DataFrame) -> DataFrame:
    got = both.toArrow()
    nodes, at = np.unique(np.concatenate((got["u"].to_numpy(), got["v"].to_numpy())), return_inverse=True)
    union = Union(len(nodes))
    for x, y in zip(at[: len(got)].tolist(), at[len(got) :].tolist(), strict=True):
        union.join(x, y)
    roots = np.array([union.find(i) for i in range(len(nodes))], np.int64)
    return both.sparkSession.createDataFrame(pa.table({"node": nodes, "component": nodes[roots]}))


def _many_components(both: DataFrame) -> DataFrame:
    stars = both
    while True:
        # Every node to the smallest node it has seen, and what pointed elsewhere between the two.
        low = stars.groupBy("u").agg(F.min("v").alias("m"))
        hung = stars.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        tall = cut(low.select("u", F.col("m").alias("v")).unionByName(hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct())
        drop(stars)
        # Then paths of two become one.
        roots = tall.groupBy("u").agg(F.min("v").alias("m"))
        hot = hot_keys(tall.groupBy("v").agg(F.count(F.lit(1)).alias("n")), "v", n) if (n := tall.count()) > HOT else []
        short = spread_join(tall, roots.select(F.col("u").alias("v"), "m"), "v", hot, "left").select("u", F.coalesce("m", "v").alias("v"), F.col("v").alias("old"))
        flat = cut(short.select("u", "v").unionByName(short.where("old != v").select(F.col("old").alias("u"), "v")).distinct())
        drop(tall)
        bad = flat.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count() or flat.alias("x").join(flat.alias("y"), F.col("x.v") == F.col("y.u"), "left_semi").limit(1).count()
        if not bad:
            return flat.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(flat.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        stars = flat


def _frequent(docs: DataFrame, text: str) -> DataFrame:
    """Grams that many texts hold, with a count: the FREQUENT most counted at most. Counts are of neighbouring texts, and only set an order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        prints: set[int] = set()

        def out() -> pa.RecordBatch:
            grams = np.concatenate(held) if held else np.zeros(0, np.uint64)
            held.clear()
            prints.clear()
            grams.sort()
            # Only runs of equal grams: where one begins, and where it ends.
            same = np.concatenate(([False], grams[1:] == grams[:-1], [False]))
            edges = np.flatnonzero(same[1:] != same[:-1])
            first, n = edges[::2], edges[1::2] - edges[::2] + 1
            some = n >= LOCAL
            return pa.RecordBatch.from_arrays([pa.array(grams[first[some]].astype(np.int64)), pa.array(n[some])], names=["gram", "n"])

        settle()
        for batch in (x for y in batches for x in slices(y)):
            data, offsets = utf8_view(batch.column(0))
            for a, b in pieces(offsets):
                sets = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for s, p in zip(sets, fingerprints(sets)[0].tolist(), strict=True):
                    if p not in prints:  # exact copies count once
                        prints.add(p)
                        held.append(s)
                if len(held) >= SAMPLE or sum(map(len, held)) > 4_000_000:
                    yield out()
        yield out()
        release()

    small_batches(docs.sparkSession)
    counts = cut(docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= LOCAL))
    # The count from which on no more than FREQUENT are left.
    total, least = 0, None
    for r in sorted(counts.groupBy(F.floor(F.log2("n") * 4).alias("k")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n")).collect(), key=lambda r: -r["k"]):
        total += r["c"]
        if total > FREQUENT:
            break
        least = r["n"]
    return counts.where(F.col("n") >= (least if least is not None else 1 << 62))


def _prefixes(docs: DataFrame, text: str, frequent: DataFrame) -> DataFrame:
    """(gram, cls, often, least) for the first grams of every set in the order (count if frequent, gram).

    cls: half of the fingerprint; least: grams that a similar set must share."""
    got = frequent.toArrow()
    grams = got["gram"].to_numpy().astype(np.uint64)
    order = np.argsort(grams)
    held = share(docs.sparkSession, (grams[order], got["n"].to_numpy()[order]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known, counts = held.value
        data, offsets = utf8_view(batch.column(0))
        out: list[tuple[np.ndarray, ...]] = []
        seen: set[int] = set()
        for a, b in pieces(offsets):
            sets = gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for s, p in zip(sets, fingerprints(sets)[0].tolist(), strict=True):
                n = len(s)
                if not n or p in seen:
                    continue
                seen.add(p)
                often = np.zeros(n, np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    often = np.where(known[at] == s, counts[at], 0)
                first, least = prefix(n)
                chosen = np.argsort(often, kind="stable")[:first]
                out.append((s[chosen].astype(np.int64), np.full(len(chosen), p), often[chosen] > 0, np.full(len(chosen), least, np.int32)))
        if not out:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["gram", "cls", "often", "least"])

    return map_batches(docs.select(text), run, "gram bigint, cls bigint, often boolean, least int")


def _thinned(rows: DataFrame, turns: int) -> DataFrame:
    """rows (gram, cls, least; made by cut) without classes of fewer than least grams and grams of one class, in turns; with the hub (smallest class) and the number n of classes of each gram."""
    for turn in range(turns):
        enough = rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").select("cls")
        kept = cut(rows.select("gram", "cls", "least").join(enough, "cls", "left_semi"))
        total = kept.count()
        if turn and total == rows.count():  # no turn changes anything now
            drop(kept)
            break
        drop(rows)
        several = kept.groupBy("gram").agg(F.min("cls").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1")
        rows = cut(spread_join(kept, several, "gram", hot_keys(several, "gram", total) if total > HOT else [], "inner"))
        drop(kept)
    return rows


def _pairs(rows: DataFrame) -> DataFrame:
    """(cls, hub): the pairs of classes that share half of the grams they must, or more, in rows (gram, cls, least) of few classes for each gram."""
    w = Window.partitionBy("gram").orderBy("cls")
    ahead = [F.lead(F.struct("cls", "least"), j).over(w) for j in range(1, PAIRED)]
    met = rows.withColumn("others", F.array_compact(F.array(*ahead))).select("cls", "least", F.explode("others").alias("other")).select("cls", F.col("other.cls").alias("hub"), F.greatest("least", "other.least").alias("least"))
    return met.groupBy("cls", "hub").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("2 * n >= least").select("cls", "hub")


def _families(prefixes: DataFrame) -> DataFrame:
    """(node, component) of the classes that share enough first grams: by pairs, and by stars around the smallest class of each gram that many have."""
    # Frequent grams are held by several classes, as their counts tell; their rows need not meet here, and are spread.
    spread = F.when(F.col("often"), F.pmod(F.xxhash64("cls"), F.lit(1 << 20))).otherwise(F.lit(0))
    w = Window.partitionBy("gram", "spread").orderBy("cls")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = prefixes.withColumn("spread", spread).withColumns({"low": F.first("cls").over(whole), "high": F.last("cls").over(whole), "before": F.lag("cls").over(w)})
    with scratch(prefixes.sparkSession) as keep:
        rows = _thinned(cut(met.where("(often or low != high) and (before is null or before != cls)").select("gram", "cls", "least")), 1)
        many = rows.where(F.col("n") > PAIRED).select("gram", "cls", F.expr("least div 2 + 1").alias("least"))
        edges = _pairs(rows.where(F.col("n") <= PAIRED)).unionByName(_thinned(cut(many), TURNS).where("cls != hub").select("cls", "hub"))
        return keep(components(edges, "cls", "hub"))


LINK = "fam bigint, a bigint, b bigint"


def _read_sets(texts: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    data, offsets = utf8_view(texts)
    out: list[np.ndarray] = []
    for a, b in pieces(offsets):
        out += gram_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _inside(t: pa.Table) -> pa.Table:
    """Links inside one chunk of a family."""
    settle()
    cls, sets = t["cls"].to_numpy(), _read_sets(t["text"])
    links = search(sets, Union(len(sets)), list(range(len(sets)))) if len(sets) > 1 else []
    fam = t["fam"][0].as_py()
    return pa.table([pa.array([fam] * len(links), pa.int64()), pa.array([int(cls[x]) for x, _ in links], pa.int64()), pa.array([int(cls[y]) for _, y in links], pa.int64())], names=["fam", "a", "b"])


def _node(t: pa.Table) -> pa.Table:
    """A part of a family as a leaf of the upper tree."""
    settle()
    sets = _read_sets(t["text"])
    maps = np.stack([bitmap(s, UPPER_BITS) for s in sets])
    sizes = np.array([len(s) for s in sets])
    hidden = int((sizes - popcount(maps)).max())
    return pa.table([t["fam"][:1], t["rest"][:1], t["part"][:1], pa.array([np.bitwise_or.reduce(maps).tobytes()], pa.binary()), pa.array([int(sizes.min())], pa.int64()), pa.array([int(sizes.max())], pa.int64()), pa.array([hidden], pa.int64())], names=["fam", "rest", "part", "bits", "low", "high", "hidden"])


def _above(t: pa.Table) -> pa.Table:
    """Nodes of the upper tree as one node of the level above."""
    maps = np.frombuffer(b"".join(t["bits"].to_pylist()), np.uint64).reshape(len(t), -1)
    return pa.table([t["fam"][:1], t["rest"][:1], t["part"][:1], pa.array([np.bitwise_or.reduce(maps).tobytes()], pa.binary()), *(pa.array([f(t[c].to_numpy())], pa.int64()) for c, f in (("low", min), ("high", max), ("hidden", max)))], names=t.column_names)


def _between(t: pa.Table) -> pa.Table:
    """Links between two parts (or inside one) that join components."""
    settle()
    cls, comp, side, sets = t["cls"].to_numpy(), t["comp"].to_numpy(), t["side"].to_numpy(), _read_sets(t["text"])
    union, first = Union(len(sets)), {}
    for i, c in enumerate(comp.tolist()):
        union.join(first.setdefault(c, i), i)
    left, right = np.flatnonzero(side == 0).tolist(), np.flatnonzero(side == 1).tolist()
    links = search(sets, union, left, right or None)
    fam = t["fam"][0].as_py()
    return pa.table([pa.array([fam] * len(links), pa.int64()), pa.array([int(cls[x]) for x, _ in links], pa.int64()), pa.array([int(cls[y]) for _, y in links], pa.int64())], names=["fam", "a", "b"])


def _links(texts: DataFrame, chunk: int) -> DataFrame:
    """Links inside families; texts has fam, cls, text, one row for each class."""
    sizes = cut(texts.groupBy("fam").agg(F.count(F.lit(1)).alias("n"), F.min("cls").alias("hub")))
    large = sizes.where(F.col("n") > chunk)
    if not large.limit(1).count():
        return cut(texts.withColumn("part", F.lit(0)).groupBy("fam", "part").applyInArrow(_inside, LINK))
    small = texts.join(sizes.where(F.col("n") <= chunk).select("fam"), "fam", "left_semi").withColumn("part", F.lit(0))
    n_parts = F.expr(f"cast(ceil(n / {chunk // 2}) as int)")
    members = cut(texts.join(large, "fam").withColumn("part", F.pmod(F.xxhash64("cls"), n_parts)).withColumn("parts", n_parts))
    hubs = members.where("cls = hub").select("fam", "cls", "text", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)).alias("part"))
    chunks = members.where("cls != hub").select("fam", "cls", "text", F.col("part").cast("bigint").alias("part")).unionByName(hubs)
    links = cut(small.select("fam", "cls", "text", F.col("part").cast("bigint").alias("part")).unionByName(chunks).groupBy("fam", "part").applyInArrow(_inside, LINK))
    comps = components(links.join(large.select("fam"), "fam", "left_semi"))
    known = cut(members.drop("n", "hub", "parts").join(comps, F.col("cls") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "cls")).drop("node", "component"))
    drop(members)
    counts = cut(known.groupBy("fam", "comp").agg(F.count(F.lit(1)).alias("n")))
    tops = counts.groupBy("fam").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    if not tops.limit(1).count():
        return links
    rest = F.col("comp") != F.col("top")
    dealt = F.pmod(F.xxhash64("cls", F.lit(1)), F.expr(f"cast(ceil(others / {chunk // 2}) as bigint)"))
    parts = cut(known.join(tops, "fam").select("fam", "cls", "text", "comp", rest.cast("int").alias("rest"), F.when(rest, dealt).otherwise(F.col("part").cast("bigint")).alias("part")))
    drop(known)
    # The upper tree: of each two nodes one holds others than the largest component.
    schema = "fam bigint, rest int, part bigint, bits binary, low bigint, high bigint, hidden bigint"
    levels = [cut(parts.groupBy("fam", "rest", "part").applyInArrow(_node, schema))]
    while levels[-1].agg(F.max("part")).first()[0] >= FAN:
        levels.append(cut(levels[-1].withColumn("part", F.expr(f"part div {FAN}")).groupBy("fam", "rest", "part").applyInArrow(_above, schema)))

    def fits(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows = batch.to_pydict()
        node = [(np.frombuffer(b"".join(rows["bits" + s]), np.uint64).reshape(batch.num_rows, -1), *(np.array(rows[c + s], np.int64) for c in ("low", "high", "hidden"))) for s in ("", "2")]
        at = np.arange(batch.num_rows)
        good = pa.array(possible(node[0], at, node[1], at))
        return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)).filter(good) for c in ("fam", "rest", "part", "rest2", "part2")], names=["fam", "rest", "part", "rest2", "part2"])

    sizes_fit = (DENOMINATOR * F.col("high") >= NUMERATOR * F.col("low2")) & (DENOMINATOR * F.col("high2") >= NUMERATOR * F.col("low"))
    pairs = None
    for nodes in reversed(levels):
        second = nodes.select("fam", *(F.col(c).alias(c + "2") for c in ("rest", "part", "bits", "low", "high", "hidden")))
        if pairs is None:
            opened = nodes.where("rest = 1").join(second, "fam")
        else:
            above = pairs.select("fam", "rest2", F.col("part").alias("above"), F.col("part2").alias("above2"))
            opened = above.join(nodes.where("rest = 1").withColumn("above", F.expr(f"part div {FAN}")), ["fam", "above"])
            opened = opened.join(second.withColumn("above2", F.expr(f"part2 div {FAN}")), ["fam", "rest2", "above2"]).drop("above", "above2")
        opened = opened.where(((F.col("rest2") == 0) | (F.col("part") <= F.col("part2"))) & sizes_fit)
        pairs = cut(map_batches(opened, fits, "fam bigint, rest int, part bigint, rest2 int, part2 bigint"))
    columns = ["fam", "part", "rest2", "part2", "cls", "comp", "text", "side"]
    one = pairs.join(parts, ["fam", "rest", "part"]).withColumn("side", F.lit(0)).select(columns)
    other = parts.select("fam", F.col("rest").alias("rest2"), F.col("part").alias("part2"), "cls", "comp", "text")
    two = pairs.where("rest2 = 0 or part < part2").join(other, ["fam", "rest2", "part2"]).withColumn("side", F.lit(1)).select(columns)
    return links.unionByName(cut(one.unionByName(two).groupBy("fam", "part", "rest2", "part2").applyInArrow(_between, LINK)))


def jaccard_join(docs: DataFrame, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """key, n_shingles and component_id (the smallest key that is reachable by links) of every row.

    A text without words, or null, has no grams and is linked with nothing: its component is its own key. Texts with
    the same set of grams are linked. Rows with the same key count as one text each; an empty table gives no rows; other
    columns are not read. key must be a whole number."""
    with scratch(docs.sparkSession) as keep:
        return keep(_joined(docs, key, text, chunk))


def _joined(docs: DataFrame, key: str, text: str, chunk: int) -> DataFrame:

    def describe(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = _read_sets(batch.column(1))
        high, low = fingerprints(sets)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(high), pa.array(low)], names=["key", "n", "cls", "low"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    described = cut(map_batches(rows, describe, f"key {kind}, n bigint, cls bigint, low bigint"))
    frequent = _frequent(rows, "text")
    families = cut(_families(_prefixes(rows, "text", frequent)))
    classes = cut(described.where("n > 0").groupBy("cls", "low").agg(F.min("key").alias("key")))
    # One text of each class in a family: the row with its smallest key.
    chosen = cut(classes.join(families.select(F.col("node").alias("cls"), F.col("component").alias("fam")), "cls").select("key", "cls", "low", "fam"))
    texts = rows.join(F.broadcast(chosen) if chosen.count() <= BROADCAST else chosen, "key")

    def own(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        """Rows whose text is of the class, where a key has several."""
        high, low = fingerprints(_read_sets(batch.column(1)))
        good = pa.array((high == batch.column(2).to_numpy()) & (low == batch.column(3).to_numpy()))
        return pa.RecordBatch.from_arrays([batch.column(i).filter(good) for i in (4, 2, 1)], names=["fam", "cls", "text"])

    picked = cut(map_batches(texts.select("key", "text", "cls", "low", "fam"), own, "fam bigint, cls bigint, text string").dropDuplicates(["fam", "cls"]))
    linked = cut(components(_links(picked, chunk)))
    smallest = classes.join(linked, F.col("cls") == F.col("node")).groupBy("component").agg(F.min("key").alias("first"))
    ids = linked.join(smallest, "component").select(F.col("node").alias("cls"), "first")
    by_class = cut(classes.join(ids, "cls", "left").select("cls", "low", F.coalesce("first", "key").alias("component_id")))
    return described.join(by_class, ["cls", "low"], "left").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component_id", "key").alias("component_id"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
