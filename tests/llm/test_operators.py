"""Each operator against a brute-force version, round trips, and the defined results of odd rows."""

from __future__ import annotations

import hashlib
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basewise.llm import decontaminate, html_extract, importance, language_id, media_ts, mixing, ngram_join, pii, token_counts, toxicity
from basewise.llm.common import ALNUM_WORDS, BATCH_BYTES, BLANK_WORDS, cut, drop, scratch, small_batches, utf8_view, word_hashes

ODD = [(None, None, None, None), (1, None, "en", "s"), (2, "", "en", None), (3, " \n\t", None, "s"), (4, "a b", "en", "s"), (4, "a b", "en", "s"), (5, "Größe ÉTÉ \U0001f600 x", "de", "é")]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    long = ("lorem ipsum " * 30_000, "x" * 100_000)
    rows = [*ODD, (6, long[0], "en", "s"), (7, long[1], "en", "s")]
    return spark.createDataFrame([(*r, i, "clash", 1.5) for i, r in enumerate(rows)], SCHEMA + ", n int, key string, block double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text, pattern):
    return re.findall(pattern, "".join(c.lower() if c.isascii() else c for c in text or ""))


BLANK, ALNUM = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_word_hashes_find_words():
    texts = ["Ab c-d  é9", "", "ab", None, "\x85x\xa0y a"]
    data, offsets = utf8_view(pa.array(texts))
    for table, pattern in ((BLANK_WORDS, BLANK), (ALNUM_WORDS, ALNUM)):
        h, row, start, end = word_hashes(data, offsets, table)
        got = [(int(r), data[s:e].tobytes().decode().lower()) for r, s, e in zip(row, start, end, strict=True)]
        assert [(r, w) for r, w in got] == [(i, w.lower()) for i, t in enumerate(texts) for w in words(t, pattern)]
        by = defaultdict(set)
        for (_, w), x in zip(got, h.tolist(), strict=True):
            by[w].add(x)
        assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


def test_batches_are_bounded_by_bytes(spark):
    long = spark.range(0, 300, 1, 1).select(F.expr("repeat('0123456789', 10000)").alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["size"])

    small_batches(spark)
    got = [r["size"] for r in long.mapInArrow(sizes, "size long").collect()]
    assert sum(got) > 30_000_000 and max(got) <= BATCH_BYTES + 200_000


# -- 1 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    P = pytest.importorskip("public_tokenizers")
    return token_counts.Encoder(P.path(token_counts.VOCABULARY))


def test_token_counts_equal_the_library(encoder):
    rng = random.Random(1)
    parts = [*"ab é́É's1　\n​Σσ\x85\x1c\x00²İ_!", "<|endoftext|>", "aaaaaaaaaaaaaaaaaaaa", " ", " "]
    assert encoder.words is not None
    for k in range(1500):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 80)))
        if k % 2:
            t = "".join(c for c in t if c < "̀").replace("<|", "")
        n = len(encoder.tokenizer.encode(t, add_special_tokens=False).ids)
        assert encoder.counts([t]) == [n]
        assert token_counts.count_long(t, encoder, rng.choice([4, 8, 16]), rng.choice([1, 2, 4]))[0] == n


def test_letters_below_300_next_to_each_other(encoder):
    letters = [chr(c) for c in range(0x300) if chr(c).isalpha()]
    texts = [a + b for a in ("\u0130", "\u023a", "\u023e", "a", "\xe2", "7") for b in letters] + [b + "x 1" for b in letters]
    library = [len(e.ids) for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.counts(texts) == library


def test_long_texts_go_through_chunks(spark, encoder):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["word ", "Sp\xe9cial, ", "x", "\n\n", "12 ", "\U0001f600"]) for _ in range(n)) for n in (10, 3000, 9000)] + ["y" * 20_000]
    got = token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["n_tokens"] for r in sorted(got)] == [len(encoder.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [r["n_chunks"] > 1 for r in sorted(got)] == [len(t) > token_counts.CHUNK for t in texts] and max(r["n_chunks"] for r in got) > 2


def test_splice_needs_a_proven_boundary():
    assert token_counts.splice([(0, 2, 1), (2, 4, 1)], [(0, 2, 1), (2, 4, 1)], "abcd", 0) is None
    assert token_counts.splice([(0, 2, 1), (3, 5, 2)], [(1, 2, 1), (3, 5, 2)], "ab cd", 1) == (1, 1)
    assert token_counts.splice([(0, 2, 1), (3, 5, 2)], [(1, 2, 1), (3, 5, 3)], "ab cd", 1) is None


def test_token_counts_odd_rows(odd, empty):
    got = {r["n"]: r for r in token_counts.token_counts(odd, "n", chunk=5000).collect()}
    assert len(got) == 9 and got[0]["n_tokens"] == got[1]["n_tokens"] == got[2]["n_bytes"] == 0
    assert got[4]["n_tokens"] == 2 and got[7]["n_bytes"] == 360_000 and got[7]["over_limit"]
    assert token_counts.token_counts(empty).count() == 0


# -- 2 ------------------------------------------------------------------------------------------------


def test_importance_prefers_the_target(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["good", "fine", "nice"] if i % 2 else ["bad", "poor", "grim"]) for _ in range(30)), i % 2 == 1 and i < 100) for i in range(300)]
    got = importance.resample(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), "t", 0.5).toPandas()
    assert got.selected.sum() == 150 and got[got.doc_id % 2 == 1].selected.mean() > 0.99


def test_importance_weights_are_log_ratios(spark):
    rows = [(0, "a b a", True), (1, "b c", False), (2, None, None), (3, "", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, t boolean")
    got = {r["doc_id"]: r["log_weight"] for r in importance.resample(docs, "t", 0.5).collect()}

    def grams(t):
        w = (t or "").split()
        return [*w, *zip(w, w[1:], strict=False)]

    raw, target = Counter(g for _, t, _ in rows for g in grams(t)), Counter(grams("a b a"))
    n = importance.BUCKETS
    for i, t, _ in rows:
        want = sum(np.log((target[g] + 1) / (sum(target.values()) + n)) - np.log((raw[g] + 1) / (sum(raw.values()) + n)) for g in grams(t))
        assert abs(got[i] - want) < 1e-9


def test_kth_largest(spark):
    rng = random.Random(3)
    rows = [(round(rng.gauss(0, 1), 2), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "v double, h long")
    order = sorted(rows, reverse=True)
    for k in (1, 7, 1500, 3000):
        assert importance.kth_largest(df, "v", k, "h", bins=8, few=20) == order[k - 1]
    assert importance.kth_largest(df, "v", 0, "h") is None and importance.kth_largest(df, "v", 3001, "h") is None
    same = spark.createDataFrame([(1.0, i) for i in range(100)], "v double, h long")
    assert importance.kth_largest(same, "v", 10, "h", few=5) == (1.0, 90)


# -- 3 ------------------------------------------------------------------------------------------------

LANGS = {"xx": "ka ko ki ku ne na".split(), "yy": "sch ein und der die".split(), "zz": "tion ment eau oux".split()}


def invented(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def trained(spark):
    rng = random.Random(4)
    rows = [(i, invented(rng, lang := rng.choice(list(LANGS)), 60), lang) for i in range(200)]
    return language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language_accuracy_and_mixtures(spark, trained):
    rng, (names, model) = random.Random(5), trained
    assert names == ["xx", "yy", "zz"]
    rows = [(i, invented(rng, lang := rng.choice(names), 40), lang) for i in range(150)]
    got = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), names, model).collect()
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 148
    both = invented(rng, "xx", 150) + " " + invented(rng, "yy", 75)
    (r,) = language_id.identify(spark.createDataFrame([(both,)], "text string"), names, model).collect()
    told = dict(x.split(":") for x in r["mixture"].split(","))
    assert set(told) == {"xx", "yy"} and 0 < float(told["yy"]) < 0.6


def test_language_em_is_the_likelihood_of_its_segments(trained):
    names, model = trained
    import pyarrow as pa

    data, offsets = utf8_view(pa.array(["kako neka und der die ein", "x"]))
    share = language_id.mixtures(data, offsets, model)
    assert np.allclose(share.sum(1), 1)


def test_language_em_equals_a_plain_one():
    """Shares and chosen set, against expectation-maximisation written out for one text at a time."""
    rng = np.random.default_rng(3)
    model = np.log(rng.dirichlet(np.full(language_id.BUCKETS, 0.01), 3) + 1e-9)
    model = np.column_stack((model, np.zeros(3))).astype(np.float32)
    texts = [" ".join("".join(rng.choice(list("abcdefg"), 5)) for _ in range(n)) for n in (3, 40, 200)]

    def plain(text):
        data, offsets = utf8_view(pa.array([text]))
        grams, _ = language_id.trigrams(data, offsets)
        parts = [grams[i : i + language_id.SEGMENT] for i in range(0, len(grams), language_id.SEGMENT)]
        like = np.array([[float(sum(model[k, g] for g in p)) * language_id.TEMPER for k in range(3)] for p in parts])

        def em(share):
            last = -np.inf
            while True:
                joint = np.exp(like - like.max(1, keepdims=True)) * share
                now = sum(np.log(j.sum()) + t for j, t in zip(joint, like.max(1), strict=True))
                if now <= last + language_id.TOLERANCE:
                    return share, now
                last, share = now, (joint / joint.sum(1, keepdims=True)).mean(0)

        order = np.argsort(-em(np.full(3, 1 / 3))[0], kind="stable")
        best, value = np.eye(3)[like.sum(0).argmax()], like.sum(0).max()
        for k in (2, 3):
            share, now = em(np.isin(np.arange(3), order[:k]) / k)
            if now - value <= language_id.PENALTY * np.log(len(parts) + 1):
                break
            best, value = share, now
        return best

    data, offsets = utf8_view(pa.array(texts))
    assert language_id.mixtures(data, offsets, model) == pytest.approx(np.array([plain(t) for t in texts]), abs=1e-3)


def test_numbers_are_no_letters(spark, trained):
    docs = spark.createDataFrame([(1, "\xb2\xbd \u2460 \u2167", 0.5, "m"), (2, "a\xb2", 0.5, "m"), (3, "12 _", 0.5, "m")], "doc_id long, text string, score double, mixture string")
    got = language_id.identify(docs, *trained).collect()
    assert [r["lang_pred"] == "und" for r in got] == [False if r["doc_id"] == 2 else not language_id.has_letter(r["text"]) for r in got]
    assert not language_id.has_letter("\xb2\xbd \u2460") and docs.columns[:2] == ["doc_id", "text"]


def test_language_odd_rows(odd, empty, spark, trained):
    got = {r["n"]: r for r in language_id.identify(odd, *trained).collect()}
    assert [got[i]["lang_pred"] for i in range(4)] == ["und"] * 4 and got[0]["score"] == 0
    assert got[6]["lang_pred"] in trained[0] and 0 < got[6]["score"] <= 1
    assert language_id.train(empty)[0] == []
    assert {r["lang_pred"] for r in language_id.identify(odd, *language_id.train(empty)).collect()} == {"und"}


# -- 4 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<nav><ul><li><a href=1>Home</a></ul></nav><article><h1>T &amp; U</h1><p>One\n  two <b>three</b><p>four<br>five<div class=ad>buy</div></article><footer>f</footer>", "T & U\nOne two three\nfour five"),
        ("<body><div id='cookie-notice'>We use</div><div class='menu'><a>x</a></div><div><h1>T</h1><p>Long text here.</p></div><div class=comments><p>first</div></body>", "T\nLong text here."),
        ("<script>var t='</p>';</script><style>p{}</style><p>a &lt;b&gt; c</p>", "a <b> c"),
        ("<nav><li>open<article><p>in</p><form>no<input></form><section class='comments'>no</section></article>", "in"),
        ("plain", "plain"),
        ("<!-- <p>no</p> --><p>yes</p><!-- open", "yes"),
        ("", ""),
        (None, ""),
        ("<p", "<p"),
        ("<article></article><p>only</p>", "only"),
    ],
)
def test_main_text(html, text):
    assert html_extract.main_text(html) == text


def test_regions_are_between_surge_and_dive():
    assert html_extract.regions([0, 0, 5, 5, 0, 0, 0, 0, 2, 0], 3) == [(2, 3), (8, 8)]
    assert html_extract.regions([1, 0, 1], 3) == [(0, 2)] and html_extract.regions([0, 0], 3) == [] and html_extract.regions([], 3) == []


def test_window_sums_decide():
    long, ad = "<p>" + "text " * 20 + "end", "<div class=ad>buy</div>"
    for tag in ("div", "article"):  # one window for all pages: a neighbour in reach of a surge stays, what never surges goes
        assert html_extract.main_text(f"<{tag}>{long}{ad * 2}<p>near{ad * 3}<p>far</{tag}>") == "text " * 20 + "end\nnear"
    assert html_extract.regions([50, 0, 0, 4, 0, 0, 0, 9, 0, 0, 0, 12], 3, 0.2) == [(0, 3), (11, 11)]


def test_extract_odd_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "x"), (None, None, "<p>a</p>", "y"), (1, "u", "", "x")], "page_id long, url string, html string, text string")
    assert sorted(r["n_chars"] for r in html_extract.extract(df).collect()) == [0, 0, 1]
    assert html_extract.extract(df.limit(0)).count() == 0


# -- 5 ------------------------------------------------------------------------------------------------

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(t):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
            if {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None, "card": 16 <= len(d) <= 19 and total % 10 == 0, "phone": 8 <= len(d) <= 15}[kind]:
                out.append((kind, *m.span()))
    return out


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    for _ in range(20_000):
        t = "".join(rng.choice("a@.1 +()-9é%0 2.55\n٣@.") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(t) == plain_spans(t)
    assert pii.base_spans("4111 1111-1111 1111") == [("card", 0, 19)]


def test_base_spans_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 100_000, "+1 " * 100_000):
        pii.base_spans(t)


def bootstrapped():
    rng = random.Random(7)
    rows = [(i, f'words here token = "{rng.getrandbits(160):040x}" and more') for i in range(20)]
    rows += [(100, 'odd one token = "ZZ-unseen-77" stays'), (101, "mail me a.b@c.de now"), (102, "the year 1999 was the best of all"), (103, 'colour = "blue" and shape'), (104, None), (105, "")]
    return rows + [rows[0]]


def test_patterns_find_unseen_identifiers(spark):
    got = defaultdict(list)
    for r in pii.personal_data(spark.createDataFrame(bootstrapped(), "doc_id long, text string")).collect():
        got[r["doc_id"]].append([tuple(s) for s in r["spans"]])
    assert got[100] == [[("secret", 17, 29)]] and got[101] == [[("email", 8, 16)]]
    assert got[0] == [[("secret", 20, 60)]] * 2 and got[102] == got[103] == got[104] == got[105] == [[]]


def test_values_reach_their_end(spark):
    long = "aB.3" * 75
    assert [c[:2] for c in pii.candidates(f"x token={long} y", [])][0] == (8, 308)
    assert sorted(c[:2] for c in pii.candidates("http://h/?" + "a" * 300 + "&token=ZZ-1234-5", [])) == [(5, 326), (317, 326)]
    assert [c[:2] for c in pii.candidates("é account of jonathansmith4211, now", [])] == [(13, 30)]
    assert pii.SECRET.fullmatch("0af" * 100)
    pii.candidates("aa=" * 100_000, [])
    rows = bootstrapped() + [(200, f'token = "{long}"'), *((300 + i, f"É Éa account of u{i}ser{i:040x} now") for i in range(20)), (400, "é Éa account of (jonathan) now"), (401, "my account of jonathansmith4211.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got[200] == 'token = "[SECRET]"' and got[400] == "é Éa account of ([SECRET]) now" and got[401] == "my account of [SECRET]."
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(docs).collect()}
    assert spans[200] == [("secret", 9, 309)] and spans[400] == [("secret", 17, 25)] and spans[401] == [("secret", 14, 31)]


def test_patterns_two_hops_from_a_seed(spark):
    rows = [f"one account of {i:040x} now" for i in range(20)]  # seeds make "account of" sure,
    rows += [f"the account of unseen{i}x77 now" for i in range(8)] + [f"we call him unseen{i}x77 now" for i in range(8)]  # and that "call him", where no seed stands
    rows += ["we call him other99x1 now", "we call her other98x1 now"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in pii.personal_data(docs, sure=0.5).collect()}
    assert got[36] == [("secret", 12, 21)] and got[37] == [] and got[28] == [("secret", 12, 22)]


def test_patterns_many_hops_from_a_seed(spark):
    """Each pattern's instances stand in the next one too, so that the n-th pattern becomes sure in the n-th round; all are found."""
    hops = [f"{a} {b}" for a, b in zip(("account", "ticket", "folder", "badge", "locker", "permit"), ("of", "for", "by", "at", "to", "in"), strict=True)]
    rows = [f"one {hops[0]} {i:040x} now" for i in range(8)]
    for n, (left, right) in enumerate(zip(hops, hops[1:], strict=False)):
        rows += [f"the {p} unseen{n}{i}x77 now" for i in range(6) for p in (left, right)]
    rows += ["we see " + hops[-1] + " other99x1 now", "we see nothing like other98x1 now"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: len(r["spans"]) for r in pii.personal_data(docs, sure=0.01).collect()}
    assert all(got[i] == 1 for i in range(len(rows) - 1)) and got[len(rows) - 1] == 0


def test_redact(spark):
    got = {r["doc_id"]: r for r in pii.redact(spark.createDataFrame([(*r, 1) for r in bootstrapped()], "doc_id long, text string, n_chars long"), length="n_chars").collect()}
    assert got[100]["text"] == 'odd one token = "[SECRET]" stays' and got[100]["n_chars"] == 32
    assert got[101]["text"] == "mail me [EMAIL] now" and got[104]["text"] is None and got[103]["n_chars"] == 1


def test_personal_data_odd_rows(odd, empty):
    assert pii.personal_data(odd).count() == 9 and pii.personal_data(empty).count() == 0


def test_redact_beyond_one_block_of_patterns(spark, monkeypatch):
    rows = [(i, t and t.replace("token", "secret"), 1) for i, t in bootstrapped()] + [(1000 + i, t, 2) for i, t in bootstrapped()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row int")
    one = sorted(map(str, pii.redact(docs).collect()))
    assert sum("[SECRET]" in x for x in one) > 40
    monkeypatch.setattr(pii, "PATTERN_BLOCK", 1)
    assert sorted(map(str, pii.redact(docs).collect())) == one


def test_spans_meet_whatever_their_number():
    rng = random.Random(6)
    for _ in range(50):
        base = [("ip", a, a + rng.randint(1, 30)) for a in (rng.randint(0, 300) for _ in range(rng.randint(0, 12)))]
        meets = pii.meeting(base)
        for _ in range(50):
            a = rng.randint(0, 330)
            b = a + rng.randint(1, 20)
            assert meets(a, b) == any(x < b and y > a for _, x, y in base)


def test_pattern_blocks_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} a b") for i in range(30)], "doc_id long, text string")
    keys = [pii._bigram(x) for x in ("a b", "b c1", "zz top")]
    for size in (1, 1000):
        monkeypatch.setattr(pii, "PATTERN_BLOCK", size)
        got = {r["pattern"]: r["total"] for r in pii.count_patterns(docs, "text", spark.createDataFrame([(k,) for k in keys], "pattern long")).collect()}
        assert got == {keys[0]: 60, keys[1]: 10}


# -- 6 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [0, 1, 63, 64, 148, 149, 161, 162, 163, 176, 345, 346, 347, 5000, 70_000])
@pytest.mark.parametrize("pes", [100, 32_768])
def test_stream_round_trip(size, pes):
    payload = random.Random(size).randbytes(size)
    media = media_ts.write_stream(payload, pes)
    got = media_ts.read_stream(media)
    assert got.payload == payload and len(media) % 188 == 0 and got.gaps == got.damaged == 0
    units = max(1, -(-size // pes))
    assert [u[0] for u in got.units] == [k * 3600 for k in range(units)] and all(u[3] and u[4] for u in got.units)


def test_stream_faults():
    payload = random.Random(8).randbytes(3000)
    media = media_ts.write_stream(payload)
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    lost = media_ts.read_stream(b"".join(packets[:5] + packets[6:]))
    assert lost.gaps == 1 and not lost.units[0][4]
    twice = media_ts.read_stream(b"".join(packets[:5] + packets[4:]))
    assert twice.repeats == 1 and twice.payload == payload
    bad = media_ts.read_stream(packets[0] + packets[1] + b"\0" * 188 + b"".join(packets[2:]) + b"xx")
    assert bad.damaged == 2 and bad.payload == payload
    assert media_ts.read_stream(b"no stream").units == [] and media_ts.read_stream(b"").packets == 0
    broken = bytearray(packets[0])
    broken[10] ^= 1
    assert media_ts.read_stream(bytes(broken) + b"".join(packets[1:])).payload == b""


def test_lost_end_of_a_unit_without_length():
    payload = random.Random(9).randbytes(60_000)
    media = bytearray(media_ts.write_stream(payload))
    packets = [media[i : i + 188] for i in range(0, len(media), 188)]
    begins = [i for i, p in enumerate(packets) if p[1] & 0x40 and i > 1]
    at = bytes(packets[begins[0]]).index(b"\x00\x00\x01\xbd")
    packets[begins[0]][at + 4 : at + 6] = b"\x00\x00"
    whole = media_ts.read_stream(b"".join(packets))
    assert whole.payload == payload and all(u[4] for u in whole.units)
    lost = media_ts.read_stream(b"".join(packets[: begins[1] - 3] + packets[begins[1] :]))
    assert not lost.units[0][4] and lost.units[1][4] and lost.gaps == 1
    late = media_ts.read_stream(b"".join(packets[:2] + packets[begins[1] - 3 :]))
    assert late.damaged == 3 and len(late.units) == 1
    # A packet may say that its counter doesn't follow.
    packets[begins[1]][5] |= 0x80
    marked = media_ts.read_stream(b"".join(packets[: begins[1] - 3] + packets[begins[1] :]))
    assert marked.gaps == 0


def test_media_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, payload string").withColumn("media", F.lit(media_ts.write_stream(b"abc")))
    assert media_ts.read_media(df).first()["payload"] == b"abc"


def test_media_query(odd, empty):
    got = {r["n"]: r for r in media_ts.digests(media_ts.read_media(media_ts.store_media(odd, "n")).withColumnRenamed("n", "doc_id")).withColumnRenamed("doc_id", "n").collect()}
    for i, (_, text, *_) in enumerate(ODD):
        data = (text or "").encode()
        pad = data + bytes(-len(data) % 64 or (64 if not data else 0))
        assert got[i]["payload_sha256"] == hashlib.sha256(pad).hexdigest() and got[i]["tail_crc32"] == zlib.crc32(pad[-64:]) and got[i]["n_bytes"] == len(data)
    assert media_ts.store_media(empty).count() == 0


# -- 7 ------------------------------------------------------------------------------------------------


def plain_hits(docs, items, window=8):
    known = defaultdict(set)
    for i, t in items:
        w = words(t, ALNUM)
        k = min(window, len(w))
        if i is not None:
            for j in range(len(w) - k + 1 if w else 0):
                known[tuple(w[j : j + k])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, found = words(t, ALNUM), set(), set()
        for k in {len(g) for g in known}:
            for j in range(len(w) - k + 1):
                if names := known.get(tuple(w[j : j + k])):
                    hit |= set(range(j, j + k))
                    found |= names
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return out


def benchmark_case():
    rng = random.Random(9)
    pool = [f"w{i}" for i in range(12)] + ["É1", "ß"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 3, 8, 12])))) for i in range(40)] + [(None, "w1 w2"), (7, "W1, w2! w3"), (50, None), (51, "...")]
    docs = [(i, " - ".join(rng.choice(pool) for _ in range(rng.choice([0, 2, 9, 200])))) for i in range(60)] + [(100, None), (101, "?!"), (5, "w1 W2 w3"), (5, "w1 W2 w3")]
    for i, t in items[:20]:
        docs.append((200 + i, f"lead {t} tail {items[i + 20][1]}"))
    return docs, items


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_contamination_equals_brute_force(spark, block):
    docs, items = benchmark_case()
    got = decontaminate.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    assert sorted(map(tuple, got.collect())) == sorted(plain_hits(docs, items))


def test_decontaminate_cuts_and_drops(spark):
    docs = spark.createDataFrame([(1, "Keep. One two, three! End", 9), (2, "one two three and four five six", 9), (3, None, None), (4, "clean", 5)], "doc_id long, text string, n_chars long")
    items = spark.createDataFrame([(1, "one two three"), (2, "four five six")], "item_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in decontaminate.decontaminate(docs, items, length="n_chars").collect()}
    assert got == {1: ("Keep. ! End", 11), 3: (None, None), 4: ("clean", 5)}


def test_contamination_odd_rows(odd, empty, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    got = {r["n"]: r for r in decontaminate.contamination(odd, items, "n").collect()}
    assert got[4]["n_hit"] == 2 and got[0]["n_words"] == 0
    assert decontaminate.contamination(empty, items).count() == 0
    assert all(r["n_hit"] == 0 for r in decontaminate.contamination(odd, items.limit(0), "n").collect())


# -- 8 ------------------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1]) == pytest.approx([187.5, 75, 37.5])
    assert mixing.targets([10, 1000, 1000], [5, 2, 1]) == pytest.approx([30, 1980 * 2 / 3, 1980 / 3])
    assert mixing.targets([0, 5], [5, 2]) == pytest.approx([0, 5]) and mixing.targets([], []) == []


def test_permutations():
    for n in (1, 2, 3, 17, 64, 1000):
        for salt in (0, 5):
            assert sorted(mixing.permute(np.arange(n), n, salt)) == list(range(n))
    assert list(mixing.permute(np.arange(50), 50, 1)) != list(mixing.permute(np.arange(50), 50, 2))


def test_draws_add_up():
    got = mixing.draw([50, 3, 0, 47], [30, 30, 30, 10], [1])
    assert [sum(r) for r in got] == [30, 30, 30, 10] and [sum(c) for c in zip(*got, strict=True)] == [50, 3, 0, 47]
    assert got == mixing.draw([50, 3, 0, 47], [30, 30, 30, 10], [1]) != mixing.draw([50, 3, 0, 47], [30, 30, 30, 10], [2])


def test_mix(spark):
    rng = random.Random(10)
    rows = [(i, " ".join("w" for _ in range(rng.choice([0, 1, 50, 700]))), rng.choice(["a", "a", "a", "a", "b", "c", None, "é"])) for i in range(900)]
    rows += [(1000, None, "a"), (1001, "x y", "zz"), (5, "again", "a"), (5, "again", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=16, shard=64).toPandas()
    again = mixing.mix_sources(docs.repartition(7), block=16, shard=64).toPandas()
    key = ["doc_id", "taken"]
    assert len(got) == len(rows) and got.sort_values(key).reset_index(drop=True)[key].equals(again.sort_values(key).reset_index(drop=True)[key])
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(order, mixing.targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True))
    assert (got.taken <= 3 * got["size"]).all() and got["size"].sum() == sum(sizes.values())
    for s, g in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert g.target.iloc[0] == pytest.approx(want[s]) and g.source_size.iloc[0] == sizes[s] and abs(g.taken.sum() - want[s]) <= 17


def test_mix_equals_brute_force(spark):
    """The blocks that each slot takes, word by word."""
    rows = [(i, " ".join(["w"] * (7 * i % 23)), "ab"[i % 2]) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(docs, block=8, shard=4).toPandas()
    for n, (_, g) in enumerate(got.groupby("source")):
        size, target = int(g.source_size.iloc[0]), round(g.target.iloc[0])
        blocks, rounds = -(-size // 8), target // size
        rest = target - rounds * size
        times = np.full(blocks * 8, rounds)
        last = -(-rest // 8)
        for slot, b in enumerate(mixing.permute(np.arange(last), blocks, (mixing.SEED << 40) + (n << 20) + rounds)):
            times[b * 8 : b * 8 + (8 if slot < last - 1 else rest - 8 * (last - 1))] += 1
        assert g.taken.sum() == times[:size].sum()


def test_blocks_hold_what_is_taken(spark):
    """Every document's words, counted in the blocks; and every block's words, against the documents."""
    rng = random.Random(14)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([0, 3, 20, 150]))), rng.choice(["a", "a", "b", None])) for i in range(80)] + [(900, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("block", F.lit("clash"))
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix_sources(docs, block=16, shard=8).collect()}
    got = mixing.mix_blocks(docs, block=16, shard=8).collect()
    seen, of = Counter(), {i: (s, set(t.split())) for i, t, s in rows if t}
    for r in got:
        held = r["text"].split()
        seen.update(int(w[1:].split("w")[0]) for w in held)
        assert len(held) == r["words"] <= 16 and {int(w[1:].split("w")[0]) for w in held} == set(r["keys"]) and all(of[k][0] == r["source"] for k in r["keys"])
    assert {k: n for k, n in taken.items() if n} == dict(seen)
    shards = Counter()
    for r in got:
        shards[r["shard"]] += 1
    assert set(shards.values()) - {8} == ({len(got) % 8} if len(got) % 8 else set())


def test_mix_odd_rows(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 9 and all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixing.mix_sources(empty).count() == 0


# -- 9 ------------------------------------------------------------------------------------------------


def test_toxicity(spark):
    rng = random.Random(11)
    rows, labels = [], []
    for i in range(600):
        n = rng.choice([0, 0, 0, 1, 2, 4])
        w = [f"w{rng.randint(0, 400)}" for _ in range(30)] + rng.sample(["vile", "awful", "nasty", "foul", "rotten"], n)
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        if i < 400:
            labels.append((i, int(n > 0)))
    rows += [(900, None), (901, ""), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (1, None), (9999, 1)], "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.grade(docs, model).collect()}
    truth = {i: sum(x in t.split() for x in ("vile", "awful", "nasty", "foul", "rotten")) for i, t in rows[:600]}
    held = [i for i in truth if i >= 400]
    assert sum(got[i]["toxic"] == (truth[i] > 0) for i in held) >= len(held) - 2
    mean = [np.mean([got[i]["severity"] for i in held if truth[i] == n]) for n in (0, 1, 2, 4)]
    assert mean == sorted(mean) and not got[900]["toxic"] and not got[901]["toxic"]
    assert (np.diff(model[2]) > 0).all()


def test_likelihood_and_gradient():
    rng = np.random.default_rng(12)
    row, column = rng.integers(0, 30, 80), rng.integers(0, 6, 80)
    pair = np.unique(row * 6 + column)
    row, column, grade = pair // 6, pair % 6, rng.integers(0, toxicity.GRADES + 1, 30)
    x = rng.normal(size=6 + toxicity.GRADES)
    value, gradient = toxicity.likelihood(x, row, column, grade, 6)
    t = toxicity._thresholds(x[6:])
    plain = 0.0
    for i in range(30):
        score = sum(x[c] for r, c in zip(row, column, strict=True) if r == i)
        above = [1.0, *(1 / (1 + np.exp(v - score)) for v in t), 0.0]
        plain += np.log(above[grade[i]] - above[grade[i] + 1]) / 30
    assert value == pytest.approx(plain - toxicity.RIDGE / 2 * (x[:6] ** 2).sum())
    for k in range(len(x)):
        step = np.eye(len(x))[k] * 1e-5
        rise = toxicity.likelihood(x + step, row, column, grade, 6)[0] - toxicity.likelihood(x - step, row, column, grade, 6)[0]
        assert gradient[k] == pytest.approx(rise / 2e-5, abs=1e-6)


def test_grades_come_from_labels(spark):
    docs = spark.createDataFrame([(i, f"t{i} {'vile' if i % 3 else 'fine'} {'rotten' if i % 3 == 2 else ''}") for i in range(900)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 < 2)) for i in range(900)], "doc_id long, toxic int, quality int")
    got = toxicity.grade(docs, toxicity.fit(docs, labels)).collect()
    assert all(r["grade"] == r["doc_id"] % 3 for r in got)


def test_toxicity_without_labels(odd, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.grade(odd, toxicity.fit(odd, none)).collect()
    assert len(got) == 9 and not any(r["toxic"] for r in got)
    assert toxicity.grade(empty, toxicity.fit(empty, none)).count() == 0


def test_cut_leaves_no_shuffle_files(spark):
    def files():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString("\n").split("\n")
        return {b for b in blocks if b.startswith("shuffle_")}

    before, setting = files(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    with scratch(spark):
        got = cut(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count())
        for _ in range(50):
            if left := files() - before:
                time.sleep(0.1)
        assert not left and got.count() == 10 and spark.conf.get(setting, None) is None
        path = got.inputFiles()[0].removeprefix("file:")
        drop(got)
        assert not os.path.exists(path)


# -- 10 -----------------------------------------------------------------------------------------------


def plain_links(rows):
    sets = []
    for _, t in rows:
        w = words(t, BLANK)
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                up[find(a)] = find(b)
    first = {}
    for k, (i, _) in enumerate(rows):
        first[find(k)] = min(first.get(find(k), i), i)
    return sorted((i, len(sets[k]), first[find(k)]) for k, (i, _) in enumerate(rows))


def copies():
    rng = random.Random(12)
    rows = []

    def edited(base, p):
        return [x if rng.random() > p else f"q{rng.randint(0, 99999)}" for x in base]

    for size in (12, 40, 200, 60):
        base = [f"w{rng.randint(0, 60)}" for _ in range(size)]
        other = edited(base, 0.05)
        rows += [(7 * (len(rows) + k) + 3, " ".join(edited(rng.choice([base, other]), rng.choice([0, 0.01, 0.03, 0.05])))) for k in range(40)]
    rows += [(9000, None), (9001, ""), (9002, " \n"), (9003, "a b"), (9004, "A B"), (9005, "a b c"), (5, "x"), *rows[:5]]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("chunk", "hot", "fan"), [(512, 100_000, 8), (16, 100_000, 8), (8, 3, 2)])
def test_join_equals_brute_force(spark, chunk, hot, fan, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "HOT_KEYS", 10**6)
    monkeypatch.setattr(ngram_join, "FAN", fan)
    rows = copies()
    got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk)
    assert sorted(map(tuple, got.collect())) == plain_links(rows)


def test_join_with_few_pairs_equals_brute_force(spark, monkeypatch):
    """Grams of more than two classes take the way of many classes, and all others that of pairs."""
    rows = copies()
    for paired in (2, 64):
        monkeypatch.setattr(ngram_join, "PAIRED", paired)
        got = ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sorted(map(tuple, got.collect())) == plain_links(rows), paired


def test_chance_grams_make_no_family(spark):
    """40 pairs of near copies, each with three grams of each of six other pairs, stay 40 families: one family of all grows with the table."""
    rows = []
    for i in range(40):
        text = [f"u{i}x{k}" for k in range(60)]
        for step in (1, 2, 5):
            for j in (i, (i - step) % 40):
                text += [f"p{j}s{step}w{k}" for k in range(7)]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(["changed", *text[1:]]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    unranked = spark.createDataFrame([], "gram long, n long")
    sizes = Counter(r["component"] for r in ngram_join._families(ngram_join._prefixes(docs, "text", unranked)).collect())
    assert list(sizes.values()) == [2] * 40


def test_prefix_bound():
    """Two similar sets share the stated number of counted grams, in any order."""
    rng = random.Random(13)
    for _ in range(3000):
        n = rng.randint(1, 60)
        a = set(rng.sample(range(100), n))
        b = set(rng.sample(sorted(a), n - rng.randint(0, n // 5))) | set(rng.sample(range(100, 140), rng.randint(0, 6)))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        rank = list(range(140))
        rng.shuffle(rank)
        first = [set(sorted(s, key=rank.__getitem__)[: ngram_join.prefix(len(s))[0]]) for s in (a, b)]
        assert len(first[0] & first[1]) >= max(1, min(ngram_join.extra(len(a)), ngram_join.extra(len(b))))
        assert all(len(first[0] & first[1]) >= ngram_join.prefix(len(s))[1] for s in (a, b))


def test_tree_search_loses_no_component():
    rng = np.random.Generator(np.random.PCG64(14))
    for _ in range(30):
        base = [np.unique(rng.integers(0, 2**63, 80).astype(np.uint64)) for _ in range(4)]
        sets = []
        for _ in range(60):
            s = base[rng.integers(4)]
            sets.append(np.unique(np.concatenate((s[rng.random(len(s)) > rng.choice([0, 0.05, 0.15])], rng.integers(0, 2**63, rng.integers(0, 8)).astype(np.uint64)))))
        links = ngram_join.search(sets, ngram_join.Union(60), list(range(60)))
        got, want = ngram_join.Union(60), ngram_join.Union(60)
        for a, b in links:
            assert ngram_join.similar(sets[a], sets[b]) and got.join(a, b)
        for a in range(60):
            for b in range(a):
                if ngram_join.similar(sets[a], sets[b]):
                    want.join(a, b)
        assert [got.find(i) for i in range(60)] == [want.find(i) for i in range(60)]


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    union = ngram_join.Union(2000)
    for a, b in edges:
        union.join(a, b)
    got = {r["node"]: r["component"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: union.find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_large_graphs(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "EDGES", 0)
    test_components(spark)


def test_small_graphs_take_few_jobs(spark):
    """A path of 200 nodes is solved at once, not in rounds of jobs that shuffle."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    sc, group = spark.sparkContext, "test_small_graphs"
    sc.setJobGroup(group, group)
    try:
        got = ngram_join.components(edges).collect()
        assert len(sc.statusTracker().getJobIdsForGroup(group)) <= 10
    finally:
        sc._jsc.clearJobGroup()
    assert {tuple(r) for r in got} == {(i, 0) for i in range(201)}


def test_join_odd_rows(odd, empty):
    got = {r["n"]: r for r in ngram_join.jaccard_join(odd, "n").collect()}
    assert got[4]["component_id"] == got[5]["component_id"] == 4 and got[0]["n_shingles"] == 0 and got[3]["component_id"] == 3
    assert ngram_join.jaccard_join(empty).count() == 0
