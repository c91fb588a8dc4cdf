"""Suffix dedup, quantile summaries and alignment against plain versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagia.llm import _blocks as B
from pelagia.llm import alignment, bpe, quantiles, suffix_dedup

# --- suffix dedup


def plain_dedup(rows: list[tuple], length: int) -> list[tuple]:
    """(doc_id, n_bytes, spans, kept) of each row, by a table of all strings; rows that are equal are one place."""
    keyed = sorted({(1 << 63 if d is None else d, t or "") for d, t in rows})
    seen: dict[bytes, tuple] = {}
    found = {}
    for place in keyed:
        raw = place[1].encode()
        gone = np.zeros(len(raw) + 1, int)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if seen.setdefault(s, (place, p)) != (place, p):
                gone[p] += 1
                gone[p + length] -= 1
        away = np.cumsum(gone[:-1]) > 0
        spans = [(int(i), int(j)) for i, j in zip(np.flatnonzero(away & ~np.append(False, away[:-1])), np.flatnonzero(away & ~np.append(away[1:], False)) + 1, strict=True)] if len(raw) else []
        found[place] = (len(raw), spans, bytes(np.frombuffer(raw, np.uint8)[~away]))
    return sorted(((d if d is not None else -1), *found[(1 << 63 if d is None else d, t or "")]) for d, t in rows)


def got_dedup(df) -> list[tuple]:
    return sorted(((r.doc_id if r.doc_id is not None else -1), r.n_bytes, [(s.first, s.last) for s in r.spans], bytes(r.kept)) for r in df.collect())


def passages(seed: int, n: int, alphabet: str = "abcdefgh ") -> list[tuple]:
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    shared = [word(rng.randrange(60, 300)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [word(rng.randrange(0, 120))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(shared)
            cut = rng.randrange(0, 40)
            parts += [p[cut:], word(rng.randrange(0, 30))]
        rows.append((rng.randrange(10_000) * 100 + i, "".join(parts)))
    return rows


@pytest.mark.parametrize("group", [2048, 2])
@pytest.mark.parametrize("length", [100, 40])
def test_suffix_dedup_equals_a_table_of_all_strings(spark, length, group):
    rows = passages(length, 150)
    rows += [(1, "ab" * 300), (2, "a" * 500), (3, "a" * 130), (None, "ab" * 90), (5, None), (6, ""), (7, "kurz"), (8, "ü€" * 80), (9, "x" + "ü€" * 80)]
    rows += [rows[0], rows[0], (11, rows[3][1]), (12, rows[3][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)
    assert got_dedup(suffix_dedup.dedup(df, length, group)) == plain_dedup(rows, length)


def test_suffix_dedup_of_one_common_passage(spark):
    """Every document has the passage between words of its own: one anchor, as many contents as documents."""
    rng = random.Random(4)
    word = lambda k: "".join(rng.choice("abcdefghijklmnop ") for _ in range(k))
    shared = word(260)
    rows = [(i, word(90) + shared + word(90)) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for group in (2048, 8):
        assert got_dedup(suffix_dedup.dedup(df, 100, group)) == plain_dedup(rows, 100)


def test_suffix_dedup_by_small_slices(spark, monkeypatch):
    rows = passages(9, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    assert got_dedup(suffix_dedup.dedup(df, 50)) == plain_dedup(rows, 50)


def test_suffix_dedup_of_an_empty_table(spark):
    assert suffix_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_corpus_order_is_the_order_of_suffixes():
    rng = random.Random(2)
    for alphabet, length in (("ab", 12), ("abcdefgh", 30), ("a", 9), ("abc", 4)):
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 200))) for _ in range(30)]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in texts]))
        at, equal = suffix_dedup.corpus_order(raw, offsets, length)
        places = [(k, p) for k, t in enumerate(texts) for p in range(len(t) - length + 1)]
        suffix = [texts[k][int(a - offsets[k]) :] for a in at for k in [int(np.searchsorted(offsets, a, "right")) - 1]]
        assert len(suffix) == len(places) and suffix == sorted(suffix)
        assert equal.tolist() == [i > 0 and suffix[i][:length] == suffix[i - 1][:length] for i in range(len(suffix))]


# --- quantile summaries


def stream(seed: int, n: int = 3000) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k = "hot" if i % 3 == 0 else f"k{rng.randrange(60)}"
        v = 7 if rng.random() < 0.3 else int(rng.lognormvariate(6, 2)) - 200
        rows.append((k, i % 4, v))
    return rows


def placed(spark, rows):
    df = spark.createDataFrame(rows, "k string, part int, x long").repartition(5)
    return quantiles.ranked(quantiles.counts(df, ["k"], "part", "x"), ["k"], "part", "x")


@pytest.mark.parametrize("ranges", ["1", "3", "16"])
def test_ranks_by_ranges(spark, ranges):
    rows = stream(1)
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = placed(spark, rows).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    by_part, by_key = defaultdict(list), defaultdict(list)
    for k, p, x in rows:
        by_part[k, p].append(x)
        by_key[k].append(x)
    assert len(got) == len(set(rows))
    for r in got:
        own, whole = by_part[r.k, r.part], by_key[r.k]
        assert (r.c, r.bp, r.np, r.i, r.m) == (own.count(r.x), sum(v < r.x for v in own), len(own), len({v for v in own if v < r.x}), len(set(own)))
        assert (r.bw, r.nw) == (sum(v < r.x for v in whole), len(whole))


def test_summaries_are_disjoint_bounded_and_near(spark):
    rows = stream(2, 8000)
    df = placed(spark, rows)
    parts = quantiles.summarise(df, ["k"], "part", "x")
    whole = quantiles.merge(parts, ["k"])
    assert {r.k: r.n for r in whole.groupBy("k").agg(F.sum("count").alias("n")).collect()} == dict(Counter(k for k, _, _ in rows))
    for of, found in ((lambda r: (r.k, r.part), parts.collect()), (lambda r: r.k, whole.collect())):
        keyed = defaultdict(list)
        for r in found:
            keyed[of(r)].append((r.low, r.high, r["count"]))
        for key, buckets in keyed.items():
            buckets.sort()
            assert all(a[1] < b[0] for a, b in zip(buckets, buckets[1:], strict=False))
            values = sorted(x for k, p, x in rows if key in ((k, p), k))
            assert (buckets[0][0], buckets[-1][1]) == (values[0], values[-1])
            assert min(4, len(set(values))) <= len(buckets) <= min(len(values), 2 * quantiles.WINDOWS + 3)
            n = len(values)
            if isinstance(key, tuple):
                assert all(c == sum(a <= v <= b for v in values) for a, b, c in buckets)
                assert all(c <= 2 * n / quantiles.WINDOWS + 1 for a, b, c in buckets if a < b)
    answers = quantiles.estimate(whole, ["k"]).collect()
    for r in answers:
        values = sorted(x for k, _, x in rows if k == r.k)
        n, target = len(values), -(-r.i * len(values) // 10)
        below, upto = sum(v < r.answer for v in values), sum(v <= r.answer for v in values)
        assert max(0, below + 1 - target, target - upto) <= 0.05 * n + 1


def test_below_counts_rows_of_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SALT", 10)
    rows = stream(3, 1500)
    df = placed(spark, rows)
    answers = quantiles.estimate(quantiles.merge(quantiles.summarise(df, ["k"], "part", "x"), ["k"]), ["k"])
    told = {(r.k, r.i): r.answer for r in answers.collect()}
    for r in quantiles.below(df, answers, ["k"], "x").collect():
        values = [x for k, _, x in rows if k == r.k]
        assert (r.n_below, r.n_upto) == (sum(v < told[r.k, r.i] for v in values), sum(v <= told[r.k, r.i] for v in values))


def shop(spark, tmp_path, clicks, lines, items):
    spark.createDataFrame(clicks, "click_id long, ts timestamp, client_id long, value double").write.parquet(f"{tmp_path}/clicks.parquet")
    spark.createDataFrame(lines, "sale_id long, item_id long, vendor_id long, stream string").write.parquet(f"{tmp_path}/sale_lines.parquet")
    spark.createDataFrame(items, "item_id long, brand string, price double").write.parquet(f"{tmp_path}/items.parquet")
    return str(tmp_path)


def test_quantile_query_with_nulls_repeats_and_broken_rows(spark, tmp_path):
    rng = random.Random(6)
    clicks = [(i, None, None if i % 50 == 0 else i % 3, None if i % 41 == 0 else float("nan") if i % 43 == 0 else round(rng.gauss(5, 90), 2)) for i in range(900)]
    clicks += clicks[:200]
    items = [(i, None if i == 3 else f"B{i % 2}", None if i == 4 else rng.randrange(100, 9999) / 100) for i in range(30)]
    lines = [(i, None if i % 30 == 0 else rng.randrange(40), None if i % 9 == 0 else i % 13, "x") for i in range(1500)]
    got = quantiles.query(spark, shop(spark, tmp_path, clicks, lines, items)).collect()
    known = {i: (b, p) for i, b, p in items}
    seen = {c[0]: c for c in clicks}.values()
    rows = [("value", c[2], c[0], c[3]) for c in seen] + [("price", *(known.get(i, (None, None))[:1]), v, known.get(i, (None, None))[1]) for _, i, v, _ in lines]
    found = defaultdict(list)
    for name, grp, ident, money in rows:
        if grp is None or money is None or money != money:
            continue
        b = zlib.crc32(b"" if ident is None else str(ident).encode()) % 8
        x = int(np.floor(100 * money + 0.5)) + 1000 * b
        found[name, str(grp), b].append(x)
        found[name, str(grp), -1].append(x)
    want = {k: sorted(v) for k, v in found.items() if len(v) >= 20}
    assert {(r.stream, r.grp, r.batch, r.i) for r in got} == {(*k, i) for k in want for i in range(1, 10)}
    for r in got:
        v = want[r.stream, r.grp, r.batch]
        target = -(-r.i * len(v) // 10)
        assert (r.n, r.target, r.exact_x) == (len(v), target, v[target - 1])
        assert (r.n_below, r.n_upto) == (sum(x < r.answer for x in v), sum(x <= r.answer for x in v))
        assert r.rank_error == max(0, r.n_below + 1 - target, target - r.n_upto) and r.within


def test_quantile_query_of_empty_tables(spark, tmp_path):
    assert quantiles.query(spark, shop(spark, tmp_path, [], [], [])).collect() == []


# --- alignment


def plain_groups(text: str | None, a, b) -> list[tuple]:
    letters = bpe.byte_letters()
    if not text:
        return []
    e = a.encode(" " + text, add_special_tokens=False)
    left = [(i, bytes(letters[c] for c in w)) for i, w in zip(e.ids, e.tokens, strict=True)]
    right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    raw = (" " + text).encode()
    if b"".join(x for _, x in left) != raw or b"".join(x for _, x in right) != raw:
        return []
    ends = lambda tokens: np.cumsum([len(x) for _, x in tokens])
    cuts = sorted(set(ends(left).tolist()) & set(ends(right).tolist()))
    place = lambda tokens: np.searchsorted(cuts, ends(tokens))
    out = [([], []) for _ in cuts]
    for side, tokens in ((0, left), (1, right)):
        for (i, _), g in zip(tokens, place(tokens), strict=True):
            out[g][side].append(i)
    return out


def tokenizers_of():
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


TEXTS = ["Hello  world", "", None, "ünïcödé 東京 🙂🙂", "a▁b", "<|endoftext|> <s> </s> <unk>", "a" * 700, "tab\tline\n\nend ", " lead", "naïve café, 1234567 years", "東京" * 90, "zero\0byte", "x" * 3 + " " * 50]


def expected(rows: list[tuple]) -> list[tuple]:
    a, b = tokenizers_of()
    groups = [(d, plain_groups(t, a, b)) for d, t in rows]
    held = Counter(pair for _, g in groups for pair in {(x, y) for p, q in g for x in p for y in q})
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for d, g in groups:
        links = [(x, y) for p, q in g for x in p for y in q]
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in g)
        out.append((d, sum(len(p) for p, _ in g), sum(len(q) for _, q in g), len(g), len(links), sum(held[k] == best[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if g else ""))
    return sorted(out, key=str)


@pytest.mark.parametrize("small", [64, 0])
def test_alignment_equals_plain_groups(spark, monkeypatch, small):
    monkeypatch.setattr(alignment, "SMALL", small)
    rng = random.Random(3)
    words = "the quick naïve Fuchs jumps über 42 東京 lazydogs! ".split(" ")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [rows[0], (None, "Hello  world"), (300, rows[30][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_a", F.lit(1)).repartition(4)
    got = sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in alignment.scores(df).collect()), key=str)
    assert got == expected(rows)


def test_alignment_lists_and_empty_table(spark):
    a, b = tokenizers_of()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for r in alignment.align(df).collect():
        groups = plain_groups(TEXTS[r.doc_id], a, b)
        assert r.a == [i for p, _ in groups for i in p] and r.b == [i for _, q in groups for i in q]
        assert r.group_a == [g for g, (p, _) in enumerate(groups) for _ in p] and r.group_b == [g for g, (_, q) in enumerate(groups) for _ in q]
    assert alignment.scores(df.limit(0)).collect() == []


def test_packed_arrays_and_parts():
    values = np.arange(1000, dtype=np.uint64)
    assert np.array_equal(B.unpack(B.pack(values), np.uint64), values) and len(B.unpack(B.pack(values[:0]), np.uint64)) == 0
    where = B.part(values, 7)
    found = dict(B.in_parts(where, 7))
    assert sorted(np.concatenate(list(found.values())).tolist()) == list(range(1000)) and all((where[k] == p).all() for p, k in found.items())
