"""The pipeline's stages against brute force, each on its predecessor's rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, brute_groups, brute_repeats, near_rows, words
from pelagia.llm import jaccard_join, mixing


def test_stages(spark, tmp_path):
    rows = near_rows() + [(1000 + i, words(200, 7) + " " + words(80, 50 + i), "en", f"s{i % 3}", 1) for i in range(5)]
    rows += [(2000 + i, words(30, 900 + i) + (" zzgrumbl" if i % 2 else ""), "en", "s", 1) for i in range(60)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(2000 + i, i % 2, 1) for i in range(60)], "doc_id long, toxic int, quality int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "substring_dedup", "mixing", "bpe"]
    after = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{i}")
        docs = spark.read.parquet(f"{sf}/{i}")
        after.append([tuple(r) for r in docs.collect()])
        if i < 4:
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    clean = {r[0] for r in rows if "zzgrumbl" not in r[1]}
    assert {r[0] for r in after[0]} == clean
    kept = {d for d, _, c in map(eval, brute_groups(after[0])) if d == c}
    assert {r[0] for r in after[1]} == kept
    gone = {d: (n, text) for d, _, n, text in map(eval, brute_repeats(after[1]))}
    before = {r[0]: r[1] for r in after[1]}
    assert {r[0]: r[1] for r in after[2]} == {d: (text if n else before[d]) for d, (n, text) in gone.items()}
    assert any(n for n, _ in gone.values())
    mixed = mixing.mix(spark.createDataFrame(after[2], SCHEMA)).where("sampled").collect()
    assert sorted(r[0] for r in after[3]) == sorted(r.doc_id for r in mixed for _ in range(r.copies)) and len(after[3]) > 0.5 * len(after[2])
    assert {r[0] for r in after[4]} == {r[0] for r in after[3]}


def test_null_and_repeated_ids(spark):
    a, b, c, d = (words(60, 70 + i) for i in range(4))
    near = a + " end"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "s", 1), (None, near, "en", "s", 1), (2, near, "en", "s", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, c, "en", "s", 1), (3, "", "en", "s", 1), (3, "", "en", "s", 1), (None, None, None, None, None), (4, d, "en", "s", 1)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = jaccard_join.stage(spark, df, "")
    assert found.columns == df.columns
    kept = [(1, a), (2, b), (None, c), (3, ""), (3, ""), (None, None), (4, d)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, kept))

    rows = [(i % 50 if i % 3 else None, words(20 + i % 7, i), "en" if i % 3 else None, "hot" if i % 2 else f"s{i % 5}", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    want = [r.doc_id for r in mixing.mix(df).collect() for _ in range(r.copies)]
    got = [r.doc_id for r in mixing.stage(spark, df, "").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want)) and None in got and 0.5 * len(rows) < len(got)


CLASHES = ["score", "spans", "n_words", "n_removed", "removed", "kept", "_d", "_h", "_r", "stays", "_source", "_lang", "_topic", "ratio", "topic", "w", "_c1", "Score", "rows"]


def test_clashing_columns_and_empty_tables_pass_all_stages(spark, tmp_path):
    a = words(80, 1)
    rows = [(i, a if i < 3 else a + " " + words(70, i), "en", "s", 9) for i in range(6)] + [(None, None, None, None, None), (7, "", "en", "s", 0)]
    names = [c for c in CLASHES if c != "Score"]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id"), F.lit(-1))).alias(c) for c in names))
    labels = [(i, int(i == 5)) for i in range(6)]
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (df, df.limit(0)):
            found = stage(spark, docs, str(tmp_path))
            assert found.columns == df.columns
            kept = found.collect()
            assert all(r[c] == f"{c}{-1 if r.doc_id is None else r.doc_id}" for r in kept for c in names)
            assert bool(kept) == bool(docs.head(1))


def test_mixing_meets_its_targets_by_copies(spark):
    rows = [(i, words(30, i % 20), "en" if i % 3 else "fr", "hot" if i % 2 else f"s{i % 10}", 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = mixing.mix(df).toPandas()
    share = found.groupby("source").n_tokens.sum() ** mixing.TEMPERATURE
    out = mixing.described(mixing.stage(spark, df, "")).toPandas().groupby("source").n_tokens.sum()
    assert (abs(out / out.sum() - share / share.sum()) < 0.02).all() and found.copies.max() > 1


def test_the_last_stage_hands_on_token_ids(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from pelagia.llm import bpe

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {1: "Hello  wörld", 2: "", 3: "1234 x\n\ny"}
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], SCHEMA)
    found = {r.doc_id: (r.n_tokens, list(r.ids)) for r in bpe.stage(spark, df, "").collect()}
    assert found == {i: (len(w), w) for i, t in texts.items() for w in [plain.encode(t, add_special_tokens=False).ids]}
