"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns; against brute force."""

import hashlib
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pelagia.llm import bpe, fingerprint, jaccard_join, langid, license_scan, mixing, substring, topk, toxicity, urlfilter

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdefgh"), 4)) for _ in range(n))


def cases():
    a, b = words(120, 1), words(400, 2)
    near = a.split()
    near[60] = "changed"
    return [
        (0, a, "en", "s0", 1), (1, a, "en", "s0", 1), (2, " ".join(near), "fr", "s1", 2), (3, None, None, None, None), (4, "", "en", "s0", 0),
        (5, "one two", "en", "s1", 7), (6, "ONE\ttwo", "en", "s1", 7), (7, b + " " + a[:300] + " end", "de", "s2", 9), (8, "x " * 5000, "en", "s0", 10000),
        (9, "\u00e9t\u00e9 \u4e2d\u6587 \U0001f600 it's <|endoftext|> don't", "fr", "s0", 3), (10, b, "de", "s2", 4), (10, b, "de", "s2", 4), (None, b, "de", "s2", 4), (12, "!!! 123 ...", "en", "s0", 5),
    ]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(cases(), SCHEMA).withColumn("score", F.lit("clash")).withColumn("ids", F.lit(1)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_is_the_library(docs, empty):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(bpe.default_vocabulary())
    found = bpe.digests(bpe.round_trip(docs)).collect()
    want = sorted(str(digest(own, d, t)) for d, t, *_ in cases())
    assert sorted(str(tuple(r)) for r in found) == want
    assert bpe.digests(bpe.round_trip(empty)).count() == 0
    assert bpe.encode(docs).columns.count("ids") == 1


def digest(own, d, text):
    ids = own.encode(text or "", add_special_tokens=False).ids
    back = own.decode(ids, skip_special_tokens=False)
    return d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_bpe_over_all_kinds_of_characters():
    from tokenizers import Tokenizer

    own, mine = Tokenizer.from_file(bpe.default_vocabulary()), bpe.PairIndexBPE(open(bpe.default_vocabulary(), encoding="utf-8").read())
    rng = np.random.default_rng(0)
    pieces = ["a", "aa", "<|endoftext|>", " ", "  ", "\n", "'s", "\u00e9", "1", "x!", "\t", "'", "re", "'ll", "\u00a0", "\u4e2d", "\U0001f600", "\u0301"]
    texts = ["".join(rng.choice(pieces, 40)) for _ in range(300)] + ["a" * 20000]
    for got, text in zip(mine.encode(pa.array(texts)).to_pylist(), texts, strict=True):
        assert got == own.encode(text, add_special_tokens=False).ids


def test_bpe_keeps_special_tokens_when_words_are_evicted(monkeypatch):
    mine = bpe.PairIndexBPE(open(bpe.default_vocabulary(), encoding="utf-8").read())
    want = mine.encode(pa.array(["a <|endoftext|> b"])).to_pylist()
    monkeypatch.setattr(bpe, "CACHED", 10)
    mine.encode(pa.array([words(50)]))
    mine.encode(pa.array([words(50, 1)]))
    assert len(mine.known) < 80
    assert mine.encode(pa.array(["a <|endoftext|> b"])).to_pylist() == want and 50256 in want[0]


def test_fingerprints(spark, docs, empty):
    rows = fingerprint.neighbours(docs).collect()
    order = sorted(cases(), key=lambda r: (r[0] is not None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    want = defaultdict(list)
    for i, (d, *_) in enumerate(order):
        x, y = texts[i], texts[(i + 1) % len(texts)]
        cut = len(x) // 3
        want[d].append((len(x), hashlib.sha256((x[: len(x) - cut] + y[:cut]).encode()).hexdigest()))
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.n_chars, r.edited_sha256))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    prints = {r.doc_id: r.fingerprint for r in rows}
    assert prints[0] == prints[1] and fingerprint.neighbours(empty).count() == 0
    near = spark.createDataFrame([(prints[0], prints[1], prints[2], prints[10])], "a string, b string, c string, d string")
    near = near.select(*(fingerprint.likeness(F.col("a"), F.col(c)).alias(c) for c in "bcd")).first()
    assert near.b == 1.0 and near.c > 0.6 > near.d


def plain_fingerprint(data):
    """One byte after the other: a rolling window of 7 bytes ends chunks; letters from the sums of the chunks' hashes."""
    full, wide = 0xFFFFFFFF, (1 << 64) - 1

    def letter(total):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            total = (total ^ total >> shift) * times & wide
        return chr(fingerprint.ALPHABET[(total ^ total >> 31) >> 58])

    block = 3
    while block * 64 < len(data):
        block *= 2
    signatures = []
    for limit in (block, 2 * block):
        out, total, open_ = "", 0, False
        for i in range(len(data)):
            roll = sum((data[i - k] + 1) * pow(0x01000193, k, 1 << 32) for k in range(min(7, i + 1))) & full
            roll = (roll ^ roll >> 15) * 0x85EBCA6B & full
            roll ^= roll >> 13
            total, open_ = total + ((roll * 0xC2B2AE35 & full) ^ roll >> 11) & wide, True
            if roll % limit == limit - 1 and len(out) < 63:
                out, total, open_ = out + letter(total), 0, False
        signatures.append(out + (letter(total) if open_ else ""))
    return f"{block}:{signatures[0]}:{signatures[1]}"


def plain_likeness(a, b):
    def distance(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    parts = [(int(x.split(":")[0]) * (k + 1), x.split(":")[1 + k]) for x in (a, b) for k in (0, 1)]
    near = [1 - distance(x, y) / max(len(x), len(y)) if x or y else 1.0 for p, x in parts[:2] for q, y in parts[2:] if p == q]
    return 1.0 if a == b else max(near, default=0.0)


def test_fingerprints_and_likeness_against_plain_loops(spark):
    texts = ["", "a", "\u00e9\u4e2d" * 9, words(3), words(40, 5), words(41, 5), words(300, 6), words(300, 6) + " tail", "x" * 3000, words(1200, 6)]
    prints = fingerprint.fingerprint_column(pa.array(texts))
    assert prints == [plain_fingerprint(t.encode()) for t in texts]
    pairs = [(i, j, a, b) for i, a in enumerate(prints) for j, b in enumerate(prints)]
    found = spark.createDataFrame(pairs, "i int, j int, a string, b string").select("a", "b", fingerprint.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    assert all(abs(r.x - plain_likeness(r.a, r.b)) < 1e-12 for r in found)


def test_fingerprints_of_hot_ids(spark):
    rows = [(i if i % 2 else 7, words(6, i)) for i in range(200)] + [(None, words(5, i)) for i in range(60)] + [(None, "same"), (None, "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    keyed = [(r._d, r._h, r.text) for r in fingerprint.keys.rows(df).collect()]
    keyed.sort(key=lambda r: (-r[0], -r[1]))
    want = []
    for i, (d, _, x) in enumerate(keyed):
        y, cut = keyed[(i + 1) % len(keyed)][2], len(x) // 3
        want.append(str((None if d == fingerprint.keys.LAST else d, hashlib.sha256((x[: len(x) - cut] + y[:cut]).encode()).hexdigest())))
    assert sorted(str((r.doc_id, r.edited_sha256)) for r in fingerprint.neighbours(df).collect()) == sorted(want)


def brute_repeats(rows, size=50):
    first, out = {}, []
    rows = sorted(((float("inf") if d is None else d, d, WORD.findall((t or "").encode())) for d, t, *_ in rows), key=lambda r: r[0])
    for key, _, ws in rows:
        for j in range(len(ws) - size + 1):
            first.setdefault(tuple(ws[j : j + size]), key)
    for key, d, ws in rows:
        gone = [0] * len(ws)
        for j in range(len(ws) - size + 1):
            if first[tuple(ws[j : j + size])] < key:
                gone[j : j + size] = [1] * size
        out.append(str((d, len(ws), sum(gone), b" ".join(w for w, g in zip(ws, gone, strict=True) if not g).decode())))
    return sorted(out)


def test_substrings_against_brute_force(docs, empty):
    found = substring.dedup(docs).collect()
    assert sorted(str((r.doc_id, r.n_words, r.n_removed, r.kept)) for r in found) == brute_repeats(cases())
    assert substring.dedup(empty).count() == 0


def brute_groups(rows):
    sets, parent = [], list(range(len(rows)))
    for _, text, *_ in rows:
        ws = WORD.findall((text or "").encode().lower())
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {tuple(ws)} - {()})

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if both and 100 * both >= 80 * every:
                parent[root(i)] = root(j)
    least = defaultdict(lambda: float("inf"))
    for i, r in enumerate(rows):
        least[root(i)] = min(least[root(i)], float("inf") if r[0] is None else r[0])
    clean = lambda v: None if v == float("inf") else v
    return sorted(str((r[0], len(sets[i]), clean(least[root(i)]))) for i, r in enumerate(rows))


def near_rows():
    rng, rows = np.random.default_rng(5), []
    for g in range(6):
        base = words(int(rng.integers(20, 400)), 100 + g).split()
        for _ in range(8):
            text = list(base)
            for at in rng.integers(0, len(text), int(rng.integers(0, max(2, len(text) // 40)))):
                text[at] = "w%d" % rng.integers(1000)
            rows.append((len(rows), "a common line of words that all of them share\n" + " ".join(text), "en", "s", 1))
    return rows


def test_jaccard_join_against_brute_force(spark, docs, empty):
    for rows, df in ((cases(), docs), (near_rows(), spark.createDataFrame(near_rows(), SCHEMA).repartition(4))):
        found = jaccard_join.join(df).collect()
        assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == brute_groups(rows)
    assert jaccard_join.join(empty).count() == 0


def test_jaccard_join_in_small_blocks_and_salts(spark, monkeypatch):
    """Many members of one frequent signature, in several components: blocks of 3, all cells frequent."""
    for name, value in (("BLOCK", 3), ("SALTS", 3), ("FREQUENT_AT_LEAST", 2), ("FREQUENT", 1000)):
        monkeypatch.setattr(jaccard_join, name, value)
    common, rows = words(90, 9), near_rows()
    rows += [(100 + i, common + " " + words(10 + i % 4, 300 + i // 3), "en", "s", 1) for i in range(40)]
    rows += [(200 + i, common + " " + words(60, 400 + i), "en", "s", 1) for i in range(12)] + [(220, common, "en", "s", 1)] * 2
    found = jaccard_join.join(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in found) == brute_groups(rows)


def test_jaccard_pairs_within_a_signature(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    rows = [(1, i, 50 + i % 7, i if i < 9 else 100 + i % 3, bytes([i % 5] * 256)) for i in range(40)]
    got = jaccard_join._pairs_within(spark.createDataFrame(rows, "s long, g long, n int, root long, hist binary")).distinct().collect()
    want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[3] != b[3] and 9 * 256 * abs(a[1] % 5 - b[1] % 5) <= a[2] + b[2]}
    assert {(r.x, r.y) for r in got if (r.x, r.y) in want} == want and all(r.x < r.y for r in got)


def plain_cell(gram):
    """The cell of a gram, one character after the other."""
    h, full = 0, 0xFFFFFFFF
    for c in gram:
        h = (h * 0x01000193 + ord(c) + 1) & full
    h = ((h ^ h >> 15) * 0x85EBCA6B + ((len(gram) - 1) * 0x9E3779B9 & full)) & full
    return (h ^ h >> 13) & (langid.BUCKETS - 1)


def plain_bayes(learned, asked):
    """text -> (language, score), with Python's own counts; grams of characters, priors of texts."""
    lower = lambda t: "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 65536 else c for c in t)
    cut = lambda t: [plain_cell(t[i : i + k]) for k in (1, 2, 3) for i in range(len(t) - k + 1)]
    langs = sorted({x for _, x in learned})
    cells = {x: defaultdict(int) for x in langs}
    for t, x in learned:
        for c in cut(lower(t)):
            cells[x][c] += 1
    out = {}
    for t in asked:
        if not any(c.isalpha() for c in t or ""):
            out[t] = ("und", 0.0)
            continue
        own = np.zeros(len(langs))
        for j, x in enumerate(langs):
            total = sum(cells[x].values()) + 0.5 * langid.BUCKETS
            own[j] = sum(np.log((cells[x][c] + 0.5) / total) for c in cut(lower(t)))
        prior = np.log([sum(y == x for _, y in learned) / len(learned) for x in langs])
        soft = np.exp(prior + (own - own.max()) * 50 / max(len(t), 50))
        best = int((own + prior).argmax())
        out[t] = (langs[best], soft[best] / soft.sum())
    return out


def test_language(spark, docs, empty):
    rows = [("\u00c9t\u00e9 \u00e0 la plage", "fr"), ("le \u00c9T\u00c9 arrive", "fr"), ("\u4eca\u65e5\u306f\u826f\u3044\u5929\u6c17", "ja"), ("\u4eca\u65e5\u306f", "ja"), ("the day is fine", "en"), ("a fine summer day it is", "en"), ("", "en"), (None, "en"), ("lost", None)]
    asked = ["\u00e9t\u00e9", "\u826f\u3044\u65e5", "fine day", None, "", "12 !!", "\U0001f600 the", "qqqq", "\u0130x", "the day " * 30_000]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    found = langid.predict(spark.createDataFrame([(i, t, "mine") for i, t in enumerate([*asked, asked[0]])], "doc_id long, text string, score string"), model)
    assert found.columns == ["doc_id", "lang_pred", "score"]
    want = plain_bayes([(t, x) for t, x in rows if t is not None and x is not None], asked)
    got = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate([*asked, asked[0]]):
        assert got[i].lang_pred == want[t][0] and abs(got[i].score - want[t][1]) < 1e-4, t
    tied = langid.fit(spark.createDataFrame([("ab", "x"), ("ab", "w")], "text string, lang string"))
    assert langid.predict(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), tied).first().lang_pred == "w"
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.fit(empty) is None and langid.predict(empty, None).count() == 0


def test_language_held_out_accuracy(spark):
    found = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [r for r in found.where("held_out and lang is not null and lang_pred <> 'und'").collect()]
    assert len(held) > 150 and sum(r.lang == r.lang_pred for r in held) > 0.97 * len(held)


def test_language_learns_rare_languages_and_hot_copies(spark):
    copies = spark.range(30_000).select(F.lit("qqq www qqq").alias("text"), F.lit("hot").alias("lang"))
    others = spark.range(60_000).select(F.concat(F.lit("abc bcd "), F.col("id")).alias("text"), F.lit("big").alias("lang"))
    rare = spark.createDataFrame([(f"zyx zzy xyz {i}", "rare") for i in range(2)], "text string, lang string")
    model = langid.fit(copies.unionByName(others).unionByName(rare))
    assert model[0] == ["big", "hot", "rare"]
    asked = spark.createDataFrame([("zyx zzy",), ("qqq www",), ("abc bcd",)], "text string")
    assert sorted(r.lang_pred for r in langid.predict(asked.withColumn("doc_id", F.lit(1)).select("doc_id", "text"), model).collect()) == ["big", "hot", "rare"]


def test_toxicity_finds_marked_words_and_offsets(spark, empty):
    rows, labels = [], []
    for i in range(80):
        toxic = i % 3 == 0
        text = words(60, i) + (" caf\u00e9 zzgrumbl%s, " % "abc"[i % 3] if toxic else " \u00e9 ") + words(20, 1000 + i)
        rows.append((i, text))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (901, ""), (902, "Zzgrumblx")]
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, known)
    found = toxicity.tag(docs, model).collect()
    assert len(found) == len(rows)
    for r in found:
        if r.doc_id < 900:
            assert (r.score >= 0.5) == (r.doc_id % 3 == 0)
            assert all(r.text[s.first : s.last].startswith(("zzgrumbl", "caf")) for s in r.spans)
    by = {r.doc_id: r for r in found}
    assert by[900].score == by[901].score < 0.5 and by[902].spans[0].first == 0
    assert toxicity.fit(docs, known.where("toxic = 0")) is None and toxicity.tag(empty, model).count() == 0
    assert {r.score for r in toxicity.tag(docs, None).collect()} == {0.0}
    long = spark.createDataFrame([(1, words(100_000, 5) + " zzgrumblq", "mine")], "doc_id long, text string, score string")
    one = toxicity.tag(long, model).first()
    assert one.spans and one.text[one.spans[0].first :] == "zzgrumblq" and 0 <= one.score <= 1
    scores = [sorted((r.doc_id, r.score) for r in toxicity.tag(docs, toxicity.fit(docs.repartition(n), known.repartition(n))).collect()) for n in (1, 3, 7)]
    assert all(np.allclose([x[1] for x in scores[0]], [x[1] for x in s], atol=1e-9) for s in scores)


def test_toxicity_samples_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "b"), (2, "b"), (3, None)], "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1), (None, 1), (4, None)], "doc_id long, toxic int")
    got = sorted((r.doc_id, r.toxic) for r in toxicity._sample(docs, known).collect())
    assert got == [(1, 1), (2, 0), (2, 0), (3, 1)]


def test_field_fit_against_plain_gradients():
    """The fitted field's likelihood has no slope: expectations by enumeration equal the labels' counts, up to the penalty."""
    rng = np.random.default_rng(4)
    n, chunk_words = 6, 4
    chunk = np.repeat(np.arange(n), 2)
    place = np.tile([0, 2], n)
    ids = rng.integers(-1, 2, (2 * n, 2))
    labels = np.repeat(np.arange(n) % 2, 2)
    kept, toxicity.CHUNK = toxicity.CHUNK, chunk_words
    try:
        field = toxicity.fit_field(chunk, place, ids, labels, 2, steps=1500)
        theta = np.concatenate((field["weights"], [field["bias"]], field["moves"].ravel()))
        marginal, both = toxicity._expected(theta, n, chunk, place, np.repeat(np.arange(2 * n), (ids >= 0).sum(1)), ids[ids >= 0])
    finally:
        toxicity.CHUNK = kept
    for c in range(n):
        lift = np.full(chunk_words, field["bias"])
        for r in np.flatnonzero(chunk == c):
            lift[place[r]] += field["weights"][ids[r][ids[r] >= 0]].sum()
        p, moves, total = np.zeros(chunk_words), np.zeros((2, 2)), 0.0
        for code in range(2**chunk_words):
            tags = [code >> i & 1 for i in range(chunk_words)]
            x = np.exp(sum(lift[i] for i, t in enumerate(tags) if t) + sum(field["moves"][a, b] for a, b in zip(tags, tags[1:])))
            total += x
            p += x * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                moves[a, b] += x
        assert np.allclose(marginal[c], p / total) and np.allclose(both[c], moves / total)
    y = np.zeros((n, chunk_words))
    y[chunk, place] = labels
    assert abs((y - marginal).sum() / n - 1e-4 * field["bias"]) < 0.02


def test_toxicity_keeps_the_prior_of_all_labels(spark, monkeypatch):
    plain = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("nothing marked").alias("text"))
    known = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 10 == 0).cast("int").alias("toxic"))
    # half of the toxic and one in eight of the clean documents have the word
    marked = plain.withColumn("text", F.when(F.when(F.col("doc_id") % 10 == 0, F.col("doc_id") % 20 == 0).otherwise(F.col("doc_id") % 8 == 1), "one zzgrumbl here").otherwise("one plain text"))
    monkeypatch.setattr(toxicity, "features", lambda sample, found=toxicity.features: (np.zeros(0, np.uint64), found(sample)[1]))
    monkeypatch.setattr(toxicity, "MAX_DOCS", 30)
    assert abs(toxicity.tag(plain, toxicity.fit(plain, known)).first().score - 0.1) < 1e-6
    word = toxicity.Words(pa.array(["zzgrumbl"]), lower=True, inside=toxicity.LETTER).hashes
    monkeypatch.setattr(toxicity, "features", lambda sample: (word, np.array([30, 30])))
    few = toxicity.tag(marked, toxicity.fit(marked, known)).groupBy("text").agg(F.max("score").alias("s"), F.max(F.size("spans")).alias("n")).collect()
    assert all(r.s < 0.5 and r.n == 0 for r in few) and max(r.s for r in few) > 0.15


def test_toxicity_trains_on_all_chunks(spark):
    text = " ".join(f"zzgrumbl {words(31, i)}" for i in range(100))
    sample = spark.createDataFrame([(i, text, i % 2) for i in range(45)] + [(45, "zzgrumbl", 1)] * 2, "doc_id long, text string, toxic int")
    known = toxicity.Words(pa.array(["zzgrumbl"]), lower=True, inside=toxicity.LETTER).hashes
    one, other = (toxicity._chunks(sample.repartition(n), known) for n in (1, 7))
    assert one[0].max() + 1 == 45 * 100 + 2 and len(one[0]) == 4502 and not one[1].any()
    assert all((a == b).all() for a, b in zip(one, other))


def test_field_marginals_against_the_plain_recursion():
    rng = np.random.default_rng(3)
    field = {"weights": np.array([2.0, -1.0]), "bias": -1.5, "moves": rng.normal(size=(2, 2))}
    texts = ["aaa bbb mark ccc mark other ddd", "mark", "", "aaa bbb ccc ddd eee other"]
    hashes = {w: toxicity.Words(pa.array([w]), lower=True, inside=toxicity.LETTER).hashes[0] for w in ("mark", "other")}
    order = sorted(hashes, key=lambda w: hashes[w])
    field["weights"] = np.array([{"mark": 2.0, "other": -1.0}[w] for w in order])
    known = np.array(sorted(hashes.values()), np.uint64)
    m = toxicity.Marked(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]), known)
    got = toxicity.marginals(m, field)
    want = []
    for text in texts:
        ws = text.split()
        u = np.array([[0, field["bias"] + {"mark": 2.0, "other": -1.0}.get(w, 0)] for w in ws]).reshape(-1, 2)
        weight = defaultdict(float)
        for code in range(2 ** len(ws)):
            tags = [code >> i & 1 for i in range(len(ws))]
            s = sum(u[i, t] for i, t in enumerate(tags)) + sum(field["moves"][a, b] for a, b in zip(tags, tags[1:]))
            for i, t in enumerate(tags):
                weight[i, t] += np.exp(s)
        want += [weight[i, 1] / (weight[i, 0] + weight[i, 1]) for i, w in enumerate(ws) if w in hashes]
    assert np.allclose(got, want)


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(900, 8)).round(2).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(900, vectors[0]), (901, vectors[0]), (902, None), (903, [1.0, None]), (904, [float("nan")] * 8), (905, [float("inf")]), (906, [1.0]), (None, vectors[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.search(df, df.where("vec_id % 90 = 0"), 20).collect()
    ints = {i: np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v))).astype(int) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for q in (i for i in ints if i % 90 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:20]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)
    assert topk.search(df.limit(0), df.limit(0)).count() == 0


def test_top_k_over_several_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 100), ("LEAST_BLOCK", 50), ("QUERIES", 7)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6 if i % 50 else 8).round(1).tolist()) for i in range(900)]
    rows += [(20, rows[3][1]), (7, rows[7][1]), (40, rows[40][1])]  # two vectors under a query's id, repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit("clash"), "block": F.lit(None)})
    found = topk.search(df, df.where("vec_id % 20 = 0"), 5).collect()
    ints = [(i, np.pad(np.floor(64 * np.array(v)), (0, 8 - len(v))).astype(int)) for i, v in rows]
    want = []
    for q, v in {(i, tuple(v)) for i, v in ints if i % 20 == 0}:
        best = sorted((-int(np.dot(v, w)), i) for i, w in ints if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(map(tuple, found)) == sorted(want)


def test_top_k_stops_on_proof():
    rng = np.random.default_rng(2)
    rows, ids = rng.integers(-30, 30, (3000, 16)), np.arange(3000)
    index = topk.ImpactIndex(rows, ids)
    for at, (found, scores) in zip(range(0, 3000, 300), index.search(rows[::300], ids[::300], 20), strict=True):
        plain = rows @ rows[at]
        order = [i for i in np.lexsort((ids, -plain)) if i != at][:20]
        assert found.tolist() == order and scores.tolist() == plain[order].tolist()


def test_mixing_meets_its_targets(spark, docs, empty):
    rows = [(i, words(20 + i % 7, i), "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 5}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(df, iterations=20).toPandas()
    found["t"] = found.n_tokens * found.ratio
    for m in ("lang", "source"):
        share = found.groupby(m).n_tokens.sum() ** mixing.TEMPERATURE
        got = found.groupby(m).t.sum() / found.t.sum()
        assert np.allclose(got, share / share.sum(), atol=1e-3)
    assert np.allclose(found.probability * found.weight, found.ratio)
    assert mixing.mix(docs).count() == len(cases()) and mixing.mix(empty).count() == 0


def test_licences(spark, docs, empty):
    text = "code\nReleased under the MIT License."
    rows = [(0, text, "en", "s", 1), (7, "plain", "en", "s", 1), (60, "Licensed under the Apache License, Version 2.0.\nx", "en", "s", 1), (61, "plain", "en", "s", 1), (5000, None, None, None, None), (7, "plain", "en", "s", 1)]
    found = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (found[0].licence, found[60].own_licence, found[61].licence, found[7].licence) == ("MIT", "Apache-2.0", "Apache-2.0", "MIT")
    assert (found[7].found, found[7].licence_dir, found[5000].found) == ("inherited", "s/en", "none")
    assert license_scan.scan(docs).count() == len(cases()) and license_scan.scan(empty).count() == 0


def test_licences_of_null_and_repeated_ids(spark, tmp_path):
    mit, gpl = "Released under the MIT License.", "SPDX-License-Identifier: GPL-3.0-or-later"
    rows = [(None, mit, "en", "s", 1), (-1, gpl, "en", "s", 1), (-2, "plain", "en", "s", 1), (8, mit, "en", "t", 1), (8, gpl, "en", "t", 1), (9, None, "en", "t", 1), (9, None, "en", "t", 1), (None, "", None, None, None)]
    spark.createDataFrame(rows, SCHEMA).withColumns({"licence": F.lit("clash"), "dir": F.lit(0)}).write.parquet(f"{tmp_path}/documents.parquet")
    got = license_scan.query(spark, str(tmp_path))
    found = [tuple(r) for r in got.select("doc_id", "licence", "found").collect()]
    assert (-2, "GPL-3.0", "inherited") in found and found.count((9, "GPL-3.0", "inherited")) == 2
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(license_scan.sql()).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("doc_id", "dir", "own_licence", "cosine", "licence", "found", "licence_dir").collect())


def test_url_rules_and_models(spark):
    urls = [None, "no scheme", "http://A.Example.com/en/71?x", "ftp://com/en/", "https://xcom/en/", "http://www.example.net/de/8#t", "http://b.net/de/1", "http://w.org/es/2", "http://q.org", "x://h?/en/", "http://a.com/en/5"]
    rows = list(enumerate(urls)) + [(100 + i, f"http://spam{i}.com/en/{i}") for i in range(40)] + [(200 + i, f"http://good{i}.net/de/{i}") for i in range(40)]
    rows += [(300, "http://spam77.io/en/3"), (301, "http://good77.io/de/3")]
    found = {r.page_id: r for r in urlfilter.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert (found[0].host, found[0].path, found[1].host, found[9].host, found[9].path) == ("", "", "", "h", "")
    assert [found[i].rule for i in range(2, 9)] == ["example.com/en/7", "com/en/", None, "example.net/de/8", "net/de/", "org/es/", None]
    assert (found[2].verdict, found[5].verdict, found[10].verdict) == ("allow", "block", "block")
    assert (found[300].verdict, found[301].verdict) == ("block", "allow")
    none = urlfilter.filter_urls(spark.createDataFrame([(1, "http://a.b/c")], "page_id long, url string")).first()
    assert none.verdict == "allow" and none.score == 0


def test_urls_without_a_host_are_allowed(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "calibrate", lambda scored: -4.0)  # everything is above it
    urls = [None, "", "no scheme", "http:///x", "http://a.io/" + "y" * 200_000, "http://a.io/1", "http://a.io/1"] + [f"http://b.com/en/{i}" for i in range(9)] + [f"http://b.net/de/{i}" for i in range(9)]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, verdict string")
    found = {r.page_id: r for r in urlfilter.filter_urls(df).collect()}
    assert [found[i].verdict for i in range(7)] == ["allow"] * 4 + ["block"] * 3 and len(found) == len(urls)
    assert all(found[i].score == 0 and found[i].rule is None for i in range(4)) and found[5].score == found[6].score
    assert urlfilter.filter_urls(df.limit(0)).count() == 0


def test_licence_texts_and_wrapped_headers(spark):
    from pelagia.llm import licence_texts as t

    star = lambda text: "/*\n" + "\n".join(" * " + x for x in text.split("\n")) + "\n */\n"
    code = "int main() { return value + other; }\n" * 40
    texts = {
        "MIT": f"Copyright (c) 2020 A Person\n\n{t._MIT}\n\n{t._MIT_REST}",
        "BSD-2-Clause": f"Copyright 2001 A. Person\nAll rights reserved.\n\n{t._BSD}\n\n{t._BSD_REST}",
        "BSD-3-Clause": star(f"{t._BSD}\n{t._BSD_THIRD}\n\n{t._BSD_REST}") + "\n" + code,
        "ISC": f"{t._ISC}\n\n{t._ISC_REST}",
        "AGPL-3.0": star(t._gnu("GNU Affero General Public License", "3")) + "\n" + code,
        "EPL-2.0": dict(t._TEXTS)["EPL-2.0"],
        "Apache-2.0": dict(t.templates())["Apache-2.0"],
        "GPL-2.0": dict(t.templates())["GPL-2.0"],
    }
    wrapped = code + "# Use of this source code is governed by a BSD-style\n# license that can be found in the LICENSE file.\n" + code
    rows = [(10_000 * (i + 1) + 77, x, "en", f"s{i}", 1) for i, x in enumerate([*texts.values(), wrapped, code, "\n".join([words(300)] * 3)])]
    found = {r.doc_id: r.own_licence for r in license_scan.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [found[r[0]] for r in rows] == [*texts, "BSD-3-Clause", None, None]


def brute_scores(labelled, urls):
    """Exact counts of byte strings; contexts at a text's start are padded with zeros."""
    counts = [defaultdict(int), defaultdict(int)]
    padded = lambda u: b"\0" * 4 + u.lower().encode()
    for u, bad in labelled:
        t = padded(u)
        for i in range(4, len(t)):
            for k in range(5):
                counts[bad]["full", t[i - k : i + 1]] += 1
                counts[bad]["context", t[i - k : i]] += 1
    out = {}
    for u in urls:
        t, total = padded(u), 0.0
        for i in range(4, len(t)):
            p = [1 / 256, 1 / 256]
            for k in range(5):
                p = [(counts[c]["full", t[i - k : i + 1]] + 8 * p[c]) / (counts[c]["context", t[i - k : i]] + 8) for c in (0, 1)]
            total += np.log(p[1]) - np.log(p[0])
        out[u] = total / max(len(t) - 4, 1)
    return out


@pytest.mark.parametrize("hot", [1 << 18, 50])
def test_url_models_count_exactly(spark, monkeypatch, hot):
    monkeypatch.setattr(urlfilter, "HOT", hot, raising=False)
    rng = np.random.default_rng(4)
    urls = ["https://" + "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789-._"), 40)) + f"/{i}" for i in range(400)]
    df = spark.createDataFrame([(i, u, i % 2 == 0) for i, u in enumerate(urls)] + [(400, None, None), (401, urls[0], None), (402, "", None)], "page_id long, url string, bad boolean").repartition(3)
    fold = {r.url for r in df.where(F.crc32("url") % 5 == 0).select("url").collect()}
    want = brute_scores([(u, int(i % 2 == 0)) for i, u in enumerate(urls) if u not in fold], urls)
    got = urlfilter.filter_urls(df, rules=(), labels="bad").collect()
    assert len(got) == 403 and all(abs(r.score - want.get(r.url, 0.0)) < 1e-9 for r in got)


@pytest.mark.parametrize("name", ["op1_license_scan", "op8_topk_search", "op9_mixing", "op12_quantiles"])
def test_sql_agrees(spark, name):
    from pelagia.llm import registry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "clicks", "sale_lines", "items"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(str, got.values.tolist())) == sorted(map(str, want.values.tolist()))
