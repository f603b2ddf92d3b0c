"""Personal data by bootstrapped contextual extraction.

Seeds are what fixed shapes find (the base kinds, and strings that only a generated secret looks like). The words and
signs before an identifier make its pattern: either a named field (``token = "``) or the two words before it. Patterns
and instances form a graph; Spark scores it in rounds: a pattern is as sure as the share of its occurrences in the whole
corpus that hold believed instances, and an instance is as believed as the surest pattern that holds it. The rounds end
with the one in which no further pattern becomes sure. What sure
patterns hold elsewhere is personal data too, whatever it looks like: a field's value up to white space, a quote or an
angle bracket, and any word behind two sure words. Only values of fields and words of 5 signs with a digit are instances
of the graph, so a word without a digit never makes another pattern sure.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_WORDS, cut, gram_hashes, map_batches, pieces, scratch, share, spare, table, utf8_view, word_hashes

KINDS = ("email", "ip", "card", "phone")
FOUND = "secret"
#: Sureness that a pattern needs, and distinct instances that it needs.
SURE, SUPPORT = 0.6, 5
#: Patterns of two words that are counted in one pass over the texts.
PATTERN_BLOCK = 200_000

EMAIL_REST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
EMAIL_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The sign and value of a named field, a sign in a value, and the rest of a word from its first digit on.
FIELD = re.compile(r"([=:])[ ]?([\"']?)([^\s\"'<>]{4,}+)")
SIGN = re.compile("[=:]")
NUMBERED = re.compile(r"[0-9]\S*+")
SECRET = re.compile(r"[0-9a-f]{32,}+|[0-9A-F]{32,}+|(?=[A-Za-z]*+[0-9])[A-Za-z0-9_-]{40,}+")


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and EMAIL_LOCAL.match(text, begin - 1) is None:
            begin -= 1
        if begin < at and (m := EMAIL_REST.match(text, at + 1)):
            end = m.end()
            out.append((begin, end))
        else:
            end = at + 1  # no address reaches over this sign
        at = text.find("@", max(at + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, by kind in the order of KINDS, then by start."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(x := p.lstrip("0")) <= 3 and int(x or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\0".join(parts).encode(), digest_size=8).digest(), "big", signed=True)


def _name(text: str, at: int) -> str:
    """The letters before a position, or before a space there."""
    end = begin = at - (text[at - 1 : at] == " ")
    while begin and text[begin - 1].isalpha():
        begin -= 1
    return text[begin:end].lower()


def _two_words(text: str, at: int) -> str | None:
    """The two words before a position, if they stand right before it."""
    words = []
    for _ in range(2):
        while at and text[at - 1].isspace():
            at -= 1
        end = at
        while at and not text[at - 1].isspace():
            at -= 1
        words.append(text[at:end])
    return f"{words[1]} {words[0]}" if words[1] else None


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """The span without the signs at its ends."""
    while b > a and not text[b - 1].isalnum():
        b -= 1
    while a < b and not text[a].isalnum():
        a += 1
    return a, b


def meeting(base: list[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """A test whether any of the spans overlaps a given one: some begin before its end, and the furthest end of those lies behind its start."""
    marks = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in marks], list(accumulate((b for _, b in marks), max))

    def meets(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i > 0 and furthest[i - 1] > a

    return meets


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int, int, int, bool, bool]]:
    """(start, end, pattern, instance, seed, named field) of everything that could be an identifier."""
    meets = meeting(base)
    out, seen = [], set()
    for m in FIELD.finditer(text) if "=" in text or ":" in text else ():
        a, b = m.span(3)
        while b > a and text[b - 1] in ".,;!?)":
            b -= 1
        fields = [(m.start(), m[1], m[2], a), *((x.start(), x[0], "", x.end()) for x in SIGN.finditer(text, a, m.end() - 4))]
        # Values that end together are hashed from their end on, so that a value of many fields takes no squared time.
        value, done = hashlib.blake2b(digest_size=8), b
        for at, sign, quote, a in reversed(fields):
            if a >= b:
                continue
            value.update(text[a:done].lower()[::-1].encode())
            done = a
            if len(name := _name(text, at)) >= 2:
                seen.add(a)
                out.append((a, b, _hash("field", name, sign, quote), int.from_bytes(value.digest(), "big", signed=True), meets(a, b) or SECRET.fullmatch(text, a, b) is not None, True))
    for m in NUMBERED.finditer(text):
        a, b = m.span()
        while a and not text[a - 1].isspace():
            a -= 1
        left = _two_words(text, a)
        a, b = _bare(text, a, b)
        if left and a not in seen and b - a >= 5:
            out.append((a, b, _bigram(left), _hash(text[a:b].lower()[::-1]), meets(a, b) or SECRET.fullmatch(text, a, b) is not None, False))
    return out


def _bigram(two: str) -> int:
    """The hash that word_hashes and gram_hashes give two words."""
    data = two.encode()
    words = word_hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]), BLANK_WORDS)[0]
    return int(gram_hashes(words, 2).astype(np.int64)[0]) if len(words) == 2 else 0


SPAN = "struct<kind:string,start:bigint,end:bigint>"
CANDIDATE = "struct<start:bigint,end:bigint,pattern:bigint,instance:bigint,seed:boolean,field:boolean>"


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, doc (a hash of key and text), the base spans and the candidates of every row."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = batch.column(0).to_pylist()
        doc, base, found = [], [], []
        for k, t in zip(keys, batch.column(1).to_pylist(), strict=True):
            t = t or ""
            spans = base_spans(t)
            doc.append(_hash(str(k), t))
            base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
            found.append([dict(zip(("start", "end", "pattern", "instance", "seed", "field"), c, strict=True)) for c in candidates(t, spans)])
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        candidate = pa.struct([*((n, pa.int64()) for n in ("start", "end", "pattern", "instance")), ("seed", pa.bool_()), ("field", pa.bool_())])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(doc, pa.int64()), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(candidate))], names=[key, "__doc", "__base", "__found"])

    return map_batches(docs.select(key, text), run, f"`{key}` {docs.schema[key].dataType.simpleString()}, __doc bigint, __base array<{SPAN}>, __found array<{CANDIDATE}>")


def blocks(patterns: DataFrame) -> Iterator[Broadcast]:
    """The patterns as sorted arrays of about PATTERN_BLOCK."""
    n = -(-patterns.count() // PATTERN_BLOCK)
    for block in range(n):
        known = np.sort(np.array([r[0] for r in patterns.where(F.pmod(F.xxhash64("pattern"), F.lit(n)) == block).collect()], np.int64))
        if len(known):
            yield share(patterns.sparkSession, known)


def count_patterns(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """(pattern, total): how often the two words of each pattern stand in the texts, one after the other."""
    out = docs.sparkSession.createDataFrame([], "pattern bigint, total bigint")
    for held in blocks(patterns):

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            known = held.value
            total = np.zeros(len(known), np.int64)
            data, offsets = utf8_view(batch.column(0))
            for a, b in pieces(offsets):
                hashes, row, _, _ = word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BLANK_WORDS)
                grams = gram_hashes(hashes, 2).astype(np.int64)
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                total += np.bincount(at[(known[at] == grams) & (row[:-1] == row[1:])], minlength=len(known))
            held_any = total > 0
            return pa.RecordBatch.from_arrays([pa.array(known[held_any]), pa.array(total[held_any])], names=["pattern", "total"])

        out = out.unionByName(map_batches(docs.select(text), run, "pattern bigint, total bigint"))
    return out.groupBy("pattern").agg(F.sum("total").alias("total"))


def behind(column: pa.Array, known: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, start, end) of every word behind two words whose pattern is known (sorted), without the signs at its ends."""
    data, offsets = utf8_view(column)
    for a, b in pieces(offsets) if len(known) else ():
        part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        hashes, row, begin, end = word_hashes(part, cuts, BLANK_WORDS)
        if len(hashes) < 3:
            continue
        grams = gram_hashes(hashes, 2).astype(np.int64)[:-1]
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        hit = np.flatnonzero((known[at] == grams) & (row[:-2] == row[2:])) + 2
        if not len(hit):
            continue
        points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
        for i in hit:
            word = part[begin[i] : end[i]].tobytes().decode()
            x, y = _bare(word, 0, len(word))
            if y > x:
                start = int(points[begin[i]] - points[cuts[row[i]]])
                yield a + int(row[i]), start + x, start + y


def words_behind(docs: DataFrame, key: str, text: str, patterns: DataFrame) -> DataFrame:
    """(__doc, start, end) of every word behind two words that are one of the patterns, whatever the word looks like."""
    schema = "__doc bigint, start bigint, end bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for held in blocks(patterns):

        def run(batch: pa.RecordBatch, held=held) -> pa.RecordBatch:
            found = [(_hash(str(batch.column(0)[i].as_py()), batch.column(1)[i].as_py()), x, y) for i, x, y in behind(batch.column(1), held.value)]
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["__doc", "start", "end"])

        out = out.unionByName(map_batches(docs.select(key, text), run, schema))
    return out


def score(found: DataFrame, docs: DataFrame, text: str, sure: float = SURE, support: int = SUPPORT) -> DataFrame:
    """The sure patterns of the graph of patterns and instances, in as many rounds as find any.

    Belief and sureness never fall from round to round, so a sure pattern stays one."""
    edges = cut(found.select(F.explode("__found").alias("c")).select("c.pattern", "c.instance", "c.seed", "c.field").groupBy("pattern", "instance", "field").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed")))
    # A pattern is looked at if enough different instances stand in it, whether one of them is a seed or not.
    looked = edges.groupBy("pattern", "field").agg(F.count(F.lit(1)).alias("instances"), F.sum("n").alias("held")).where(F.col("instances") >= support).drop("instances")
    graph = cut(edges.join(looked, ["pattern", "field"]))
    known = graph.sparkSession.createDataFrame([], "pattern bigint, total bigint")
    believed = graph.withColumn("belief", F.col("seed").cast("double"))
    before = 0
    while True:
        # Occurrences are counted once a pattern would be sure without those that hold no candidate: no other can be sure.
        near = cut(believed.groupBy("pattern", "field").agg(F.sum(F.col("belief") * F.col("n")).alias("believed"), F.max("held").alias("held")).where(F.col("believed") >= sure * F.col("held")))
        new = cut(near.join(known, "pattern", "left_anti"))
        totals = count_patterns(docs, text, new.where(~F.col("field")).select("pattern"))
        known = cut(known.unionByName(new.join(totals, "pattern", "left").select("pattern", F.greatest("held", F.coalesce("total", F.lit(0))).alias("total"))))
        patterns = cut(near.join(known, "pattern").select("pattern", (F.col("believed") / F.col("total")).alias("sureness")).where(F.col("sureness") >= sure))
        if (sure_now := patterns.count()) == before:
            return patterns
        before = sure_now
        by_instance = graph.join(patterns, "pattern", "left").groupBy("instance").agg(F.max("sureness").alias("sureness"), F.max("seed").alias("seed"))
        belief = by_instance.select("instance", F.greatest(F.col("seed").cast("double"), F.coalesce("sureness", F.lit(0.0))).alias("belief"))
        believed = cut(graph.join(belief, "instance"))


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", with_doc: str | None = None, **more) -> DataFrame:
    """key, base (array of spans), and spans (the base ones and those the method adds, by kind, then by start); and with_doc, a hash of key and text, if it is named.

    Spans count code points, end exclusive. Null and empty texts have none. Repeated rows give repeated rows; other
    columns are not read."""
    with scratch(docs.sparkSession) as keep:
        return keep(_personal_data(docs, key, text, with_doc, **more))


def _personal_data(docs: DataFrame, key: str, text: str, with_doc: str | None, **more) -> DataFrame:
    found = cut(scan(docs, key, text))
    patterns = score(found, docs, text, **more)
    spans = found.where(F.size("__found") > 0).select("__doc", F.explode("__found").alias("c")).withColumn("pattern", F.col("c.pattern")).join(patterns, "pattern").select("__doc", "c.start", "c.end")
    spans = cut(spans.unionByName(words_behind(docs, key, text, patterns.select("pattern"))).distinct())
    overlaps = F.exists("__base", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    hits = spans.join(found.select("__doc", "__base").dropDuplicates(["__doc"]), "__doc").where(~overlaps).select("__doc", F.struct(F.lit(FOUND).alias("kind"), "start", "end").alias("s"))
    added = hits.groupBy("__doc").agg(F.array_sort(F.collect_set("s")).alias("__added"))
    out = found.join(added, "__doc", "left")
    return out.select(*([F.col("__doc").alias(with_doc)] if with_doc else []), key, F.col("__base").alias("base"), F.concat("__base", F.coalesce("__added", F.array().cast(f"array<{SPAN}>"))).alias("spans"))


def _string(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = None, **more) -> DataFrame:
    """docs with every span of personal data replaced by its kind in square brackets.

    length names a column that holds the text's code points, set anew where a text changes. Null texts stay null;
    empty tables and repeated rows are as they come; other columns pass, whatever their names. Up to PATTERN_BLOCK sure
    patterns are broadcast and the texts pass once; of more, the spans are found by personal_data and joined."""
    spark, columns = docs.sparkSession, docs.columns
    rest = [c for c in columns if c != text]
    with scratch(spark) as keep:
        patterns = keep(score(cut(scan(docs, key, text)), docs, text, **more))
    if patterns.count() > PATTERN_BLOCK:
        t, k, s = spare(docs, "__text", "__row", "__spans")
        rows = personal_data(docs.select(key, text).distinct(), key, text, **more, with_doc="__doc").select(F.col("__doc").alias(k), F.col("spans").alias(s)).dropDuplicates([k])
        given = docs.withColumn(k, F.udf(lambda a, b: _hash(str(a), b or ""), "bigint")(key, text)).join(rows, k, "left").select(F.col(text).alias(t), *rest, s)
        held = None
    else:
        given = docs.select(F.col(text).alias(spare(docs, "__text")[0]), *rest)
        held = spark.sparkContext.broadcast(np.sort(np.array([r["pattern"] for r in patterns.collect()], np.int64)))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if held is None:
            spans = [[(x["kind"], x["start"], x["end"]) for x in s or ()] for s in batch.column(len(rest) + 1).to_pylist()]
        else:
            spans = sure_spans(batch.column(0), held.value)
        texts = batch.column(0)
        sizes = batch.column(1 + rest.index(length)).to_pylist() if length else []
        if any(spans):
            out = texts.to_pylist()
            for i, s in enumerate(spans):
                if s:
                    out[i] = replaced(out[i], s)
                    if length:
                        sizes[i] = len(out[i])
            texts = pa.array(out, pa.string())
        arrays = {c: batch.column(1 + n) for n, c in enumerate(rest)} | {text: texts}
        if length:
            arrays[length] = pa.array(sizes, arrays[length].type)
        return pa.RecordBatch.from_arrays([arrays[c] for c in columns], names=columns)

    return map_batches(given, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))


def sure_spans(column: pa.Array, sure: np.ndarray) -> list[list[tuple[str, int, int]]]:
    """Of every text the base spans, and behind them what the sure patterns (sorted) hold outside of those."""
    words, known = defaultdict(list), set(sure.tolist())
    for i, x, y in behind(column, sure):
        words[i].append((x, y))
    out = []
    for i, t in enumerate(column.to_pylist()):
        base = base_spans(t) if t else []
        added = [(c[0], c[1]) for c in candidates(t, base) if c[2] in known] + words[i] if t else []
        meets = meeting(base)
        out.append(base + [(FOUND, x, y) for x, y in added if not meets(x, y)])
    return out


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with its spans replaced by their kinds; of overlapping ones the first stands for all."""
    parts, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b > done:
            parts += [text[done : max(a, done)], f"[{kind.upper()}]" if a >= done else ""]
            done = b
    return "".join([*parts, text[done:]])


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = personal_data(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(k) for k in KINDS]
    n_spans = F.size("spans").cast("bigint").alias("n_spans")
    return got.select("doc_id", *counts, F.sha2(_string("base"), 256).alias("base_sha256"), _string("spans").alias("spans"), n_spans)
