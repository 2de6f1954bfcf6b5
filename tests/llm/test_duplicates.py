"""N-gram Jaccard join, substring dedup and decontamination against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from shardloom.llm import components, decontaminate, fm_index, jaccard, substrings

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


def gram_set(text, n=5):
    words = BLANKS.findall(lowered(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def corpus(seed, n=120):
    """Texts with exact and near copies, a shared passage, periodic texts, short, empty and null ones."""
    rnd = random.Random(seed)
    word = lambda: rnd.choice("alpha Beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau é日".split())
    passage = [word() for _ in range(45)]
    texts = [None, "", " \n\t", "a", "a", "A", "a b c", "A B c", "x y z w v", "ha " * 200, "la le " * 90, "one " * 34, "one " * 35]
    while len(texts) < n:
        base = [word() for _ in range(rnd.randint(1, 120))]
        if rnd.random() < 0.4:
            at = rnd.randint(0, len(base))
            base[at:at] = passage
        for _ in range(rnd.choice([1, 1, 1, 3, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 5])):
                copy[rnd.randrange(len(copy))] = word()
            texts.append(rnd.choice([" ", "\n", "  "]).join(copy))
    return texts


def brute_components(rows, n=5, percent=80):
    sets = [gram_set(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_components_of_near_duplicates(spark, monkeypatch, small):
    if small:  # hubs, cut clusters and many tiles
        for name, value in (("PAIRED", 3), ("BLOCK_ROWS", 4), ("FREQUENT", 5)):
            monkeypatch.setattr(jaccard, name, value)
    rows = [(7 * i % 1009, t) for i, t in enumerate(corpus(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS a", "2 AS cluster").repartition(5)
    got = jaccard.near_duplicates(docs)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert Counter(map(tuple, got.collect())) == brute_components(rows)


def test_null_ids_and_repeated_rows_of_near_duplicates(spark):
    text = "one two three four five six seven"
    rows = [(4, text), (4, text), (None, text), (9, text.upper()), (None, "only here so"), (3, None), (None, "")]
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_links_through_rows_without_an_id(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(jaccard, "BLOCK_ROWS", 1)
    words = [f"w{i}" for i in range(60)]
    shifted = [" ".join(words[k : k + 50]) for k in (0, 4, 8)]  # neighbours link, the outer two do not
    other = [" ".join(f"v{i}" for i in range(k, k + 50)) for k in (0, 4)]
    rows = [(3, shifted[0]), (None, shifted[1]), (None, shifted[1]), (1, shifted[2]), (3, "one text of this id stands quite alone"), (None, other[0]), (None, other[1])]
    rows += [(8, shifted[0])] * 5
    got = jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, got)) == brute_components(rows)
    assert Counter(r.component_id for r in got) == {1: 9, 3: 1, None: 2}


def test_overlaps_and_prefixes():
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 60, n).astype(np.uint64)) for n in (3, 40, 40, 1, 25)]
    want = np.array([[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets])
    apart = ~np.eye(len(sets), dtype=bool)  # columns of one row are left out
    assert (jaccard.overlaps(sets)[apart] == want[apart]).all()
    for n in range(1, 400):  # one entry more than can be missed, and a tenth
        assert jaccard.prefix_size(n) == n - -(-8 * n // 10) + 1 + n // 10


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (5, 5), (None, 3), (3, None)] + [(200, 200 + k) for k in range(1, 30)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100} | {200 + k: 200 for k in range(30)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_kept(texts, window):
    lists = [BLANKS.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for w in lists:
        gone = {i + k for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for k in range(window)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


@pytest.mark.parametrize("window, shard", [(35, 1 << 19), (12, 600), (20, 5_000)])
def test_repeated_words_go(spark, monkeypatch, window, shard):
    monkeypatch.setattr(substrings, "SHARD_WORDS", shard)  # small shards also make hot names
    texts = corpus(6)
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)] + [(1, texts[20]), (1, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "text AS key", "3 AS spans", "4 AS n_words").repartition(4)
    got = substrings.remove_repeats(docs, window)
    want = brute_kept([t for _, t in rows], window)
    expected = Counter((d, n, g, hashlib.sha256(k.encode()).hexdigest(), k if g else t) for (d, t), (n, g, k) in zip(rows, want, strict=True))
    found = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got.collect())
    assert found == expected
    assert got.columns == ["doc_id", "text", "key", "spans", "n_words", "n_removed", "kept_sha256"]


def test_nothing_to_dedup(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        substrings.repeated_spans(spark.createDataFrame([], "key long, text string"), 5)


def test_backward_search_counts_patterns():
    rnd = np.random.default_rng(2)
    codes = np.append(rnd.integers(1, 4, 400), 0)
    index = fm_index.FMIndex(codes, 7, np.ones(len(codes), dtype=np.int64))
    for _ in range(50):
        pattern = rnd.integers(1, 5, rnd.integers(1, 7)) % 4 + 0
        pattern[pattern == 0] = 1
        low, high = np.array([0]), np.array([len(codes)])
        for c in pattern[::-1]:
            low, high = index.step(low, high, np.array([c]))
        want = sum(codes[i : i + len(pattern)].tolist() == pattern.tolist() for i in range(len(codes)))
        assert (high - low).tolist() == [want] and index.count(low, high).tolist() == [want]


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def brute_hits(text, items, window=13):
    words, hit, which = alnum(text), set(), set()
    for item, t in items:
        w = alnum(t)
        size = min(window, len(w))
        wins = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in wins:
                hit |= set(range(i, i + size))
                which.add(str(item))
    return len(words), len(hit), sorted(which)


@pytest.mark.parametrize("part_bytes", [1 << 24, 400])
def test_contamination(spark, part_bytes):
    rnd = random.Random(3)
    make = lambda n: " ".join(rnd.choice("red green blue Cyan black é9 x1".split()) for _ in range(n))
    items = [(10, make(30)), (2, make(13)), (3, make(14)), (4, "red, GREEN-blue"), (5, "cyan"), (6, None), (7, "..."), (8, make(60)), (8, make(20)), (None, make(15))]
    texts = [None, "", "?!", "cyan", "Red green, BLUE", "zz " * 100 + "cyan"] + [make(rnd.randint(1, 60)) for _ in range(20)]
    for item in items:
        if item[1]:
            texts += [f"zq {item[1]} zq " + "filler " * rnd.randint(0, 400), item[1].upper().replace(" ", "; ")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").selectExpr("*", "doc_id AS hits", "doc_id AS item_id", "1 AS __row", "2 AS __text", "3 AS __columns").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_matches(docs, benchmark, part_bytes=part_bytes).withColumn("n_hit", decontaminate.n_hit()).withColumn("bad", decontaminate.contaminated())
    for r in found.collect():
        n_words, n_hit, which = brute_hits(r.text, items)
        which = [w for w in which if w != "None"]  # an item without an id marks words only
        assert (r.n_words, r.n_hit, r["items"]) == (n_words, n_hit, which), r.text
        assert r.bad == (n_hit > 0 and 20 * n_hit >= n_words)
        words = alnum(r.text)
        for m in r.longest:
            mine = [alnum(t) for i, t in items if (None if i is None else str(i)) == m["item"]]
            same = words[m["word"] : m["word"] + m["length"]]
            assert any(w[m["item_word"] : m["item_word"] + m["length"]] == same for w in mine)
            if len(mine) == 1:
                w = mine[0]
                run = max(k for i in range(len(words)) for j in range(len(w)) for k in [next((k for k in range(len(w) + 1) if i + k >= len(words) or j + k >= len(w) or words[i + k] != w[j + k]), 0)])
                assert m["length"] == run
    clean = decontaminate.remove_contaminated(docs.drop("hits"), benchmark, part_bytes=part_bytes)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == {r.doc_id for r in found.where("NOT bad").select("doc_id").collect()}


@pytest.mark.parametrize("part_bytes", [1 << 24, 60])
def test_items_without_an_id_mark_words(spark, part_bytes):
    first, second = (" ".join(f"{c}{i}" for i in range(20)) for c in "ab")
    items = [(None, first), (None, "lone"), (7, second), (None, None), (8, first)]
    texts = [first, second, f"zq {second} zq {first[:60]} lone", "zq lone zq", "zq zq", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for some in (items, items[:4]):
        benchmark = spark.createDataFrame(some, "item_id long, text string")
        found = decontaminate.find_matches(docs, benchmark, part_bytes=part_bytes).withColumn("n_hit", decontaminate.n_hit())
        for r in found.withColumn("bad", decontaminate.contaminated()).collect():
            n_words, n_hit, which = brute_hits(r.text, some)
            assert (r.n_words, r.n_hit, r["items"]) == (n_words, n_hit, [i for i in which if i != "None"]), r.text
            assert r.bad == (n_hit > 0 and 20 * n_hit >= n_words)


def test_contamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    row = decontaminate.find_matches(docs, none).first()
    assert (row.n_words, row.hits, row["items"]) == (3, [], [])
    assert decontaminate.find_matches(docs.limit(0), none).count() == 0


def test_copies_of_a_hot_window_meet_in_no_single_group(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 600)
    monkeypatch.setattr(substrings, "SALT_ROWS", 200, raising=False)
    make = substrings._shard_masks

    def bounded(window):
        masks = make(window)

        def run(data):
            words = sum(len(w) // 8 for w in data.column("words").to_pylist())
            assert words <= 4 * 600, f"{words} words in one group"
            return masks(data)

        return run

    monkeypatch.setattr(substrings, "_shard_masks", bounded)
    rnd = random.Random(8)
    word = lambda: f"w{rnd.randrange(10**6)}"
    passage = [word() for _ in range(40)]
    texts = [" ".join([*(word() for _ in range(rnd.randint(5, 60))), *passage, *(word() for _ in range(rnd.randint(0, 60)))]) for _ in range(300)]
    texts += [" ".join(word() for _ in range(80)) for _ in range(50)] + texts[:2]
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    found = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in got.collect()}
    want = brute_kept(texts, 35)
    assert found == {i: (n, g, k if g else texts[i]) for i, (n, g, k) in enumerate(want)}


def test_patterned_words_and_clashing_names(spark):
    """Words whose difference cancels out in sums of powers are different words; names of helper columns are free."""
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word
    fill = [f"w{i}" for i in range(20)]
    one, two = (" ".join([*fill, w, *fill[::-1]]) for w in (word, other))
    docs = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").selectExpr("*", "1 AS __key", "2 AS __runs", "3 AS __row", "4 AS key", "5 AS __letters", "6 AS size")
    cut = substrings.remove_repeats(docs)
    assert {r.n_removed for r in cut.collect()} == {0} and cut.columns == [*docs.columns, "n_words", "n_removed", "kept_sha256"]
    linked = jaccard.near_duplicates(spark.createDataFrame([(1, f"a b c d {word}"), (2, f"a b c d {other}")], "doc_id long, text string"))
    assert {r.component_id for r in linked.collect()} == {1, 2}
    for part_bytes in (1 << 24, 1000):
        found = decontaminate.find_matches(docs, spark.createDataFrame([(7, one), (8, "zz yy")], "item_id long, text string"), part_bytes=part_bytes)
        hits = {r.doc_id: len(r["items"]) for r in found.collect()}
        assert hits == {1: 1, 2: 1}  # the windows of 13 words before and after the word differ from none
        n = {r.doc_id: r.n for r in found.select("doc_id", decontaminate.n_hit().alias("n")).collect()}
        assert n == {1: 41, 2: 40}
    # Equal rows repeat each other; each fragment is sent once.
    again = spark.createDataFrame([(1, one)] * 50 + [(None, one)], "doc_id long, text string")
    assert {r.n_removed for r in substrings.remove_repeats(again).collect()} == {41}
    from shardloom.llm import language
    said = language.identify(docs, language.fit(docs.selectExpr("doc_id", "text", "'xx' AS lang")))
    assert said.columns == [*docs.columns, "lang_pred", "score", "rejected"]


def test_texts_are_shuffled_once_for_ordinary_and_hot_names(spark, monkeypatch):
    rnd = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [" ".join(f"w{rnd.random()}" for _ in range(30)) + f" {passage} " + " ".join(f"w{rnd.random()}" for _ in range(30)) for _ in range(30)]
    texts += [" ".join(f"c{k}" for k in range(50))] * 2
    monkeypatch.setattr(substrings, "SHARD_WORDS", 600)
    write, plans = substrings.materialize, []

    def spy(df, name):
        if name == "found":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(substrings, "materialize", spy)
    got = substrings.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4))
    assert sorted(r.n_removed for r in got.collect()) == [40] * 30 + [50] * 2
    assert len(plans) == 1 and "ReusedExchange" in plans[0]
