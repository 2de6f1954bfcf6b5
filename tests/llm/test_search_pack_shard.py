"""Nearest neighbours, language ID, packing, resharding and the pipeline."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shardloom.llm import language, neighbours, packing, resharding, tokens


def exact_nearest(rows, queries, k):
    out = {}
    for q, v in queries:
        scores = sorted((math.dist(v, w), i) for i, w in rows if i != q and len(w) == len(v))
        out[q] = [i for _, i in scores[:k]]
    return out


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_neighbours(spark):
    rnd = np.random.default_rng(4)
    centres = rnd.standard_normal((8, 16))
    rows = [(i, (centres[i % 8] + 0.3 * rnd.standard_normal(16)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(900 + i, rows[0][1]) for i in range(300)]  # a hot vector
    rows += [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [1.0] * 15 + [None]), (2004, [1.0] * 15 + [float("nan")]), (2005, [1.0] * 15 + [float("inf")])]
    rows += [(3000, [1.0, 2.0]), (3001, [1.0, 2.5]), (None, [1.0] * 16), (10, rows[10][1])]
    base = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS block", "2 AS score")
    queries = base.where("vec_id % 20 = 0 OR vec_id = 3000")
    good = [(i, v) for i, v in rows if i is not None and sound(v)]
    for block, chunk in ((8192, 1024), (100, 7)):
        got = neighbours.nearest_neighbours(base, queries, 10, block_rows=block, chunk_queries=chunk).collect()
        found = {}
        for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
            found.setdefault(r.query_id, []).append(r.vec_id)
            v, w = dict(good)[r.query_id], dict(good)[r.vec_id]
            assert r.score == pytest.approx(math.dist(v, w), abs=1e-12)
        want = exact_nearest(good, {i: v for i, v in good if i % 20 == 0 or i == 3000}.items(), 10)
        assert found.keys() == want.keys() and found[3000] == [3001]
        assert found[0] == list(range(900, 910)) and found[900] == [0, *range(901, 910)]
        hits = sum(len(set(found[q]) & set(want[q])) for q in want)
        assert hits >= 0.95 * sum(map(len, want.values()))
    assert neighbours.nearest_neighbours(base.limit(0), queries).count() == 0
    assert neighbours.nearest_neighbours(base, queries.limit(0)).count() == 0


def sample_texts():
    rnd = random.Random(1)
    said = {"en": "the house and water they with from under", "fr": "la maison et l'eau été avec où élève", "de": "das haus und wasser für über straße mit"}
    return [(i, " ".join(rnd.choice(said[k].split()) for _ in range(rnd.randint(3, 80))), k) for i, k in enumerate(list(said) * 40)]


def test_languages(spark):
    rows = sample_texts()
    odd = [(900, None, "en"), (901, "", None), (902, "123 !?", "fr"), (None, "the water", "en"), (903, "Ω" * 400, None), (904, "house and " * 40_000, None), (905, "é", None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS rejected")
    model = language.fit_documents(docs)
    got = language.identify(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "rejected"]
    found = {r.doc_id: r for r in got.collect()}
    assert all(found[i].lang_pred == k and 0 <= found[i].score <= 1 and not found[i].rejected for i, _, k in rows)
    for i in (900, 901, 902):
        assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
    assert found[903].rejected and found[903].lang_pred != "und" and found[904].lang_pred == "en" and not found[905].rejected
    # Labels of other rows, sources and ids play no part in a prediction.
    other = language.identify(docs.withColumn("lang", F.lit("xx")).withColumn("doc_id", F.col("doc_id") + 1), model)
    assert sorted(r.lang_pred for r in other.collect()) == sorted(r.lang_pred for r in found.values())
    nothing = language.fit(docs.limit(0))
    assert {r.lang_pred for r in language.identify(docs, nothing).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_outliers_make_no_centroid_of_their_own(spark):
    """Odd texts labelled like a language neither get a cluster nor reject what lies near them."""
    odd = [(500 + i, f"zq{i}xj " * 60, "de") for i in range(4)]
    docs = spark.createDataFrame(sample_texts() + odd, "doc_id long, text string, lang string")
    model = language.fit(docs)
    vectors = language.weighted(np.concatenate([language.gram_counts(pa.array([t])) for _, t, k in sample_texts() + odd if k == "de"]), model.idf)
    mine = np.array(model.owner) == model.languages.index("de")
    member = (vectors @ model.centroids[mine].T).argmax(axis=1)
    assert np.bincount(member, minlength=mine.sum()).min() >= 10
    near = [(i, " ".join(("das haus und wasser für über straße mit " * 5).split()) + f" {'77' * 9} zq{i}xj zq{i}xj", None) for i in range(4)]
    found = language.identify(spark.createDataFrame(near, "doc_id long, text string, lang string"), model).collect()
    assert all(r.lang_pred == "de" and not r.rejected for r in found)
    assert language.identify(spark.createDataFrame([(1, "Ω" * 400)], "doc_id long, text string"), model).first().rejected


def test_languages_of_few_texts_set_no_distance(spark):
    """One text alone is its own centroid at cosine 1, which says nothing about the distance of others."""
    one = spark.createDataFrame([("the house and water they with from under " * 8, "en")], "text string, lang string")
    model = language.fit(one)
    assert model.least.tolist() == [0.0]


def test_held_out_documents_are_not_learned_from(spark):
    docs = spark.createDataFrame(sample_texts(), "doc_id long, text string, lang string")
    changed = docs.withColumn("lang", F.when(language.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert "zz" not in language.fit_documents(changed).languages


def test_counts_of_slices_are_those_of_the_whole(monkeypatch):
    import pyarrow as pa

    texts = ["añb", None, "", "hello World " * 30, "x", "ü" * 50]
    whole = language.gram_counts(pa.array(texts))
    for size in (1, 7, 64):
        monkeypatch.setattr(language, "_CHUNK", size)
        assert (language.gram_counts(pa.array(texts)) == whole).all()


def test_accuracy_on_held_out_documents(spark):
    from shardloom.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    found = QUERIES["op7_language_id"](spark, "/root/testdata/sf0.01").where("held_out").join(docs, "doc_id")
    right, n = found.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.97 * n


@pytest.mark.parametrize("seed", range(4))
def test_recipes_use_every_piece(seed):
    rnd = np.random.default_rng(seed)
    counts = np.zeros(257, dtype=np.int64)
    for length in rnd.integers(1, 257, 3000) if seed else [256] * 5 + [128] * 3 + [100, 100, 56, 1]:
        counts[length] += 1
    found = packing.Recipes.fewest(counts)
    used = Counter()
    for lengths, n in found.recipes:
        assert sum(lengths) <= 256 and n > 0
        for length in lengths:
            used[length] += n
    assert used == Counter({k: int(c) for k, c in enumerate(counts) if c})
    least = -(-int((counts * np.arange(257)).sum()) // 256)
    assert sum(n for _, n in found.recipes) <= max(least + 1, 1.015 * least)
    assert packing.Recipes(np.zeros(9, dtype=np.int64)).recipes == []


def test_exact_complements():
    free = np.zeros(40, dtype=np.int64)
    free[[3, 5, 7, 8]] = 1, 2, 1, 1
    assert packing.Recipes._single(8, free) == [8] and packing.Recipes._single(9, free) is None
    assert packing.Recipes._pair(10, free) == [7, 3] and packing.Recipes._pair(16, free) is None
    assert packing.Recipes._triple(17, free) == [7, 5, 5] and packing.Recipes._triple(9, free) is None
    for total in range(3, 30):
        pool = [k for k in range(40) for _ in range(free[k])]
        assert (packing.Recipes._triple(total, free.copy()) is not None) == any(sum(c) == total for c in itertools.combinations(pool, 3))


def test_packed_documents(spark):
    rnd = random.Random(8)
    words = "red Green blue cyan's 12 black .. été".split()
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 40)))) for i in range(150)] + [(7, "same"), (7, "same"), (None, None), (8, None), (999, "long " * 700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS bucket").repartition(3)
    got = packing.pack_documents(docs, capacity=64).collect()
    encode = tokens.Encoder(tokens.tokenizer_file("word_bpe_49k.json"), False).tokenizer.encode
    want = Counter()
    for d, text in rows:
        ids = encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 64):
            piece = np.array(ids[k : k + 64], dtype=np.uint16)
            want[d, k // 64, k, len(piece), tokens.crc32s(piece, np.array([len(piece)]))[0]] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for _, rows_ in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in rows_:
            assert r.offset == at
            at += r.length
        assert at <= 64
    gaps: list[int] = []  # first fit, longest first
    for length in sorted((r.length for r in got), reverse=True):
        at = next((k for k, gap in enumerate(gaps) if gap >= length), None)
        if at is None:
            gaps.append(64 - length)
        else:
            gaps[at] -= length
    assert len({r.sequence_id for r in got}) <= len(gaps)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def cheapest(classes, capacities):
    """Least bytes that move, by trying all ways to send whole rows (small cases only)."""
    rows = [(old, size / n) for old, _, n, size in classes for _ in range(n)]
    best = math.inf
    for to in itertools.product(range(len(capacities)), repeat=len(rows)):
        if all(low <= to.count(j) <= high for j, (low, high) in enumerate(capacities)):
            best = min(best, sum(s for (old, s), t in zip(rows, to, strict=True) if old != t))
    return best


@pytest.mark.parametrize("seed", range(8))
def test_transfers_move_the_fewest_bytes(seed):
    rnd = random.Random(seed)
    classes = [(old, k, rnd.randint(1, 2), rnd.randint(1, 50)) for old in rnd.sample([0, 1, 2, 5, -1], 3) for k in range(rnd.randint(1, 2))]
    classes = [(old, k, n, n * size) for old, k, n, size in classes]
    total = sum(c[2] for c in classes)
    capacities = resharding.even(total, 3)
    blocks = resharding.plan_transfers(classes, capacities)
    moved = 0.0
    for old in {c[0] for c in classes}:
        # Ranks run from the largest class down.
        sizes = [s / n for _, _, n, s in sorted((c for c in classes if c[0] == old), key=lambda c: -c[3] / c[2]) for _ in range(n)]
        mine = sorted((b for b in blocks if b.old == old), key=lambda b: b.first)
        assert [b.first for b in mine] == [sum(x.rows for x in mine[:k]) for k in range(len(mine))] and sum(b.rows for b in mine) == len(sizes)
        moved += sum(s for b in mine if b.shard != old for s in sizes[b.first : b.first + b.rows])
    for j, (low, high) in enumerate(capacities):
        into = sorted((b for b in blocks if b.shard == j), key=lambda b: b.slot)
        assert low <= sum(b.rows for b in into) <= high
        assert [b.slot for b in into] == [sum(x.rows for x in into[:k]) for k in range(len(into))]
    assert moved == pytest.approx(cheapest(classes, capacities))


def test_resharding(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(resharding, "CELL_ROWS", 7)
    rows = [(i if i % 11 else None, "x" * (i % 50), i % 3 if i % 5 else None) for i in range(200)] + [(3, None, 0), (3, None, 0), (3, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int").selectExpr("*", "'a' AS slot0", "1 AS bytes")
    size = F.octet_length(F.coalesce("text", F.lit(""))) + 8
    placed, blocks = resharding.place_rows(docs, F.col("old"), size, ["doc_id", "text"], shards=5)
    got = resharding.rewrite(placed, blocks, str(tmp_path / "s")).collect()
    assert Counter((r.doc_id, r.text, r.old) for r in got) == Counter(rows)
    for shard in range(5):
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (40, 41)
    # Shards of the right size keep their rows and are not written.
    even = spark.range(10).selectExpr("id AS doc_id", "'t' AS text", "CAST(id % 2 AS int) AS old")
    placed, blocks = resharding.place_rows(even, F.col("old"), size, ["doc_id"], shards=2)
    assert resharding.affected_shards(blocks) == []
    assert all(r.shard == r.old for r in resharding.rewrite(placed, blocks, str(tmp_path / "e")).collect())
    placed, blocks = resharding.place_rows(docs.limit(0), F.col("old"), size, ["doc_id"])
    assert resharding.rewrite(placed, blocks, str(tmp_path / "n")).count() == 0
    with pytest.raises(ValueError):
        resharding.plan_transfers([(0, 1, 5, 50)], [(0, 2), (0, 2)])


def pipeline_fixture(spark, tmp_path):
    rnd = random.Random(2)
    # Words of their own for each document, so that nothing repeats but what is meant to.
    text = lambda n: " ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(4, 9))) for _ in range(n))
    rows, near = [], text(120)
    rows += [(10, near), (11, near), (12, near + " end"), (13, near.upper()), (14, near.replace(near.split()[60], "zz", 1))]
    passage, item = text(60), text(40)
    rows += [(20, text(80) + " " + passage), (21, passage + " " + text(90))]
    rows += [(30, item + " " + text(30)), (31, item + " " + text(2000)), (40, None), (41, "12 34 .."), (42, "")]
    rows += [(50 + i, text(100)) for i in range(20)] + [(None, text(50)), (99, text(5))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return dict(rows), passage, item


def test_pipeline_stages_take_effect(spark, tmp_path):
    texts, passage, item = pipeline_fixture(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, before, str(tmp_path))
        if name != "best_fit_packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            kept[name] = {r.doc_id: r for r in docs.collect()}
    everything = set(texts)
    assert set(kept["language_id"]) == everything - {40, 41, 42}
    assert set(kept["ngram_jaccard"]) == everything - {40, 41, 42, 11, 12, 13, 14}
    cut = kept["substring_dedup"]
    assert set(cut) == set(kept["ngram_jaccard"])
    assert passage.split()[30] not in cut[20].text and passage.split()[30] not in cut[21].text
    assert cut[20].n_chars == len(cut[20].text) and cut[50].text == texts[50]
    # The item's 40 words repeat in two documents, so they went with the passages: no document is contaminated any more.
    assert item.split()[20] not in cut[30].text and set(kept["decontamination"]) == set(cut)
    pieces = docs.collect()
    assert {r.doc_id for r in pieces} == set(cut)
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in pieces}
    alone = corpus_pipeline.remove_contaminated(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path))
    assert {r.doc_id for r in alone.collect()} == everything - {30}


def test_pipeline_of_nothing_and_of_odd_columns(spark, tmp_path):
    texts, _, _ = pipeline_fixture(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    odd = docs.selectExpr("*", "1 AS key", "2 AS n_words", "'a' AS lang_pred", "3 AS hits", "4 AS cluster", "array(1) AS items").where("doc_id < 32")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns
    twice = docs.where("doc_id = 50").unionByName(docs.where("doc_id = 50"))
    assert corpus_pipeline.keep_one_of_each_group(spark, twice, str(tmp_path)).count() == 1
