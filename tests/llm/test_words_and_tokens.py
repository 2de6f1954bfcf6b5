"""Word scanning, chunked encoding, the range coder, and token files, against direct ways."""

import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings, strategies as st

from shardloom.llm import range_coder, token_files, tokens
from shardloom.llm.textscan import ALNUM, NOT_BLANK, chunks, mix, ngram_hashes, scan_words

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAzZ09 \n\t\x0b\x1c.,'é\u00a0日<|\\", max_size=40)), max_size=8)


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "")


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_patterns(texts):
    for flags, lower, pattern in ((NOT_BLANK, False, r"[^\x20\x09-\x0D]+"), (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = scan_words(pa.array(texts, pa.string()), flags, lower)
        got = [words.data[a:b].tobytes().decode() for a, b in zip(words.starts, words.ends, strict=True)]
        want = [re.findall(pattern, lowered(t) if lower else t or "") for t in texts]
        assert words.counts.tolist() == [len(w) for w in want]
        assert got == [x for w in want for x in w]
        by_word = {}
        for word, h in zip(got, words.hashes.tolist(), strict=True):
            assert by_word.setdefault(word, h) == h
        assert len(set(by_word.values())) == len(by_word)


def test_hashes_do_not_depend_on_the_place():
    one = scan_words(pa.array(["x " * 100 + "a b c d e"]), NOT_BLANK, False)
    two = scan_words(pa.array(["", None, "a b c d e"]), NOT_BLANK, False)
    assert ngram_hashes(one.hashes, 5)[-1] == ngram_hashes(two.hashes, 5)[0]


def thue_morse(bits, letters="ab"):
    """Two words of 2**bits letters whose difference cancels out in every sum of powers modulo 2**64."""
    word, other = letters
    for _ in range(bits):
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("bits", [3, 10, 11, 13])
def test_hashes_tell_patterned_words_apart(bits):
    assert len(set(scan_words(pa.array([" ".join(thue_morse(bits))]), NOT_BLANK, False).hashes.tolist())) == 2


def test_chunks_with_one_hash_are_told_apart(monkeypatch):
    few = lambda data, starts, ends: np.full(len(starts), 7, dtype=np.uint64)
    monkeypatch.setattr(tokens, "span_hashes", few)
    for file, keep in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        encoder = tokens.Encoder(tokens.tokenizer_file(file), keep)
        texts = ["same same", "same other", None, "a" * 600, "a" * 599 + "b", "same", "longer than eight", "longer thaN eight"]
        ids, counts = encoder.encode(pa.array(texts))
        stops = np.cumsum(counts)
        for text, a, b in zip(texts, stops - counts, stops, strict=True):
            assert encoder.tokenizer.encode(text or "", add_special_tokens=False).ids == ids[a:b].tolist(), text


@pytest.mark.parametrize("file, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_patterned_words_keep_their_ids(file, keep):
    encoder = tokens.Encoder(tokens.tokenizer_file(file), keep)
    texts = [w for bits in (10, 12, 13) for w in thue_morse(bits)]
    ids, counts = encoder.encode(pa.array(texts))
    stops = np.cumsum(counts)
    for text, a, b in zip(texts, stops - counts, stops, strict=True):
        assert encoder.tokenizer.encode(text, add_special_tokens=False).ids == ids[a:b].tolist()


def test_chunks_cover_a_batch():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 500, "", "c" * 3]})
    parts = list(chunks(batch, "text", 12))
    assert [x for p in parts for x in p.column("text").to_pylist()] == batch.column("text").to_pylist()
    assert all(p.num_rows for p in parts) and len(parts) > 2
    assert list(chunks(batch.slice(0, 0), "text")) == []


@pytest.mark.parametrize("file, keep", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_encoder_gives_the_librarys_ids(file, keep):
    encoder = tokens.Encoder(tokens.tokenizer_file(file), keep)
    rnd = np.random.default_rng(3)
    alphabet = list(" \n\taAbé1'!.,;\u0301\u00a0s<|日Σ\u3000\x1c") + ["<|endoftext|>", "<|startoftext|>", " the", " it's", "Hello"]
    texts = [None, "", " ", "\n\n", "a", "x" * 5000, " <|endoftext|> y"] + ["".join(rnd.choice(alphabet, rnd.integers(0, 30))) for _ in range(1500)]
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    stops = np.cumsum(counts)
    for text, a, b in zip(texts, stops - counts, stops, strict=True):
        assert encoder.tokenizer.encode(text or "", add_special_tokens=False).ids == ids[a:b].tolist(), text


def test_hash_index_finds_what_was_added():
    keys = np.random.default_rng(0).permutation(200_000).astype(np.uint64)
    keys = mix(keys)
    index = tokens.HashIndex()
    for at in range(0, len(keys), 7_001):
        assert (index.find(keys[at : at + 7_001]) < 0).all()
        index.add(keys[at : at + 7_001])
    assert (index.find(keys) == np.arange(len(keys))).all()


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 150), st.integers(1, 65_535), st.integers(0, 9)), max_size=5))
@example([(4096, 65_535, 1), (4096, 3, 2), (4095, 500, 3), (16, 2, 4), (17, 2, 5), (0, 1, 6)])
def test_coded_blocks_round_trip(shapes):
    blocks = [np.random.default_rng(seed).integers(0, top, n).astype(np.uint16) for n, top, seed in shapes]
    coded = range_coder.encode_blocks(blocks)
    for got, want in zip(range_coder.decode_blocks(coded), blocks, strict=True):
        assert (got == want).all() and len(got) == len(want)
    # Blocks are independent: each decodes alone, and alike.
    for raw, want in zip(coded[:2], blocks, strict=False):
        assert (range_coder.decode_blocks([raw])[0] == want).all()


def test_repetition_is_predicted_and_damage_is_found():
    block = np.tile(np.arange(64, dtype=np.uint16) * 700, 64)
    raw = range_coder.encode_blocks([block])[0]
    assert len(raw) < len(block) // 4
    for at in (17, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            range_coder.decode_blocks([bytes(bad)])
    for bad in (b"", raw[:-2], b"XXXX" + raw[4:]):
        with pytest.raises(ValueError):
            range_coder.decode_blocks([bad])


def test_token_files(spark, tmp_path):
    rows = [(5, "the end"), (None, None), (2, ""), (9, "a b " * 3000), (2, "twice"), (7, None), (1, "é 日")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS part", "'x' AS blocks")
    token_files.write_tokens(docs, str(tmp_path / "t"), parts=3)
    got = sorted(token_files.read_tokens(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    encode = tokens.Encoder(tokens.tokenizer_file("byte_bpe_50k.json"), True).tokenizer.encode
    at = 0
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in ordered]
    for row, (_, text) in zip(got, ordered, strict=True):
        ids = encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.start, row.n_tokens, bytes(row.ids)) == (at, len(ids), np.array(ids, "<u4").tobytes())
        assert row.ids_crc32 == zlib.crc32(row.ids)
        at += len(ids)


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_tokens(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"))
    assert token_files.read_tokens(spark, str(tmp_path / "t")).count() == 0


def test_blocks_of_a_common_model_decode_alone():
    rnd = np.random.default_rng(5)
    blocks = [np.minimum(rnd.zipf(1.3, n), 65_534).astype(np.uint16) for n in (4096, 900, 0, 4096)]
    model, coded = range_coder.encode_blocks(blocks, shared=True)
    for k in (3, 0, 2, 1):
        assert (range_coder.decode_blocks(coded[k : k + 1], model)[0] == blocks[k]).all()
    assert all((a == b).all() for a, b in zip(range_coder.decode_blocks(coded, model), blocks, strict=True))
    with pytest.raises(ValueError):
        range_coder.decode_blocks(coded)
    with pytest.raises(ValueError):
        range_coder.decode_blocks(coded, model[:-1] + bytes([model[-1] ^ 1]))


def test_new_words_go_to_the_tokenizer_together_and_without_their_stops():
    encoder = tokens.Encoder(tokens.tokenizer_file("byte_bpe_50k.json"), True)
    library, sent = encoder.tokenizer, []

    class Counted:
        model = library.model

        def encode(self, text, **kw):
            return library.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    encoder.tokenizer = Counted()
    words = [f"w{'abcdefghij'[k // 10]}{'éáxüzñyßåø'[k % 10]}" for k in range(100)]
    texts = [" ".join(w + stop for w in words) for stop in ("", ".", ",", "...", "....", ":;", "×.")]
    ids, counts = encoder.encode(pa.array(texts))
    stops = np.cumsum(counts)
    for text, a, b in zip(texts, stops - counts, stops, strict=True):
        assert library.encode(text, add_special_tokens=False).ids == ids[a:b].tolist()
    assert len(sent) < 320  # of 700 words; those with four stops or a sign before them stay whole


def test_plain_words_go_to_the_model_without_the_pre_tokenizer():
    encoder = tokens.Encoder(tokens.tokenizer_file("byte_bpe_50k.json"), True)
    library, sent = encoder.tokenizer, []

    class Counted:
        model = library.model

        def encode(self, text, **kw):
            sent.append(text)
            return library.encode(text, **kw)

        def encode_batch_fast(self, texts, **kw):
            sent.extend(texts)
            return library.encode_batch_fast(texts, **kw)

    encoder.tokenizer = Counted()
    plain = ["über$$$ łódź ŉ\nÉtat***\tend!!", "a\rb&&&(\x0bŻ" + " straße-" * 3, "ſĸÿ"]
    rnd = np.random.default_rng(8)
    alphabet = list(" \n\t\x0baZ'9×÷ÀſŁıƀ²ª́$!<|_~") + ["  ", "'s", "#a", "<|endoftext|>", "word", "Ġ", "日"]
    others = ["".join(rnd.choice(alphabet, rnd.integers(0, 25))) for _ in range(3000)]
    for texts in (plain, others):
        ids, counts = encoder.encode(pa.array(texts))
        if texts is plain:
            assert not sent
        stops = np.cumsum(counts)
        for text, a, b in zip(texts, stops - counts, stops, strict=True):
            assert library.encode(text, add_special_tokens=False).ids == ids[a:b].tolist(), text


def test_predictions_of_all_steps_at_once_are_those_of_single_steps():
    rnd = np.random.default_rng(4)
    ids = np.sort(rnd.integers(0, 5, (7, 300)) ** rnd.integers(1, 4, (7, 300)), axis=0).astype(np.uint16)
    lengths = np.array([300, 300, 300, 120, 3, 1, 0])
    guesses1, guesses2, contexts, tally = range_coder._predicted(ids, lengths, 65)
    state, counted = range_coder._Predictions(7, 65), np.zeros_like(tally)
    for t in range(300):
        guess1, guess2, context = state.next()
        assert all((a == b[:, t]).all() for a, b in ((guess1, guesses1), (guess2, guesses2), (context, contexts)))
        now = ids[:, t].astype(np.int32)
        which = np.where((guess2 == now) & (state.fared2 > 0), 2, (guess1 == now) & (state.fared1 > 0))
        np.add.at(counted, (3 * context + which)[lengths > t], 1)
        state.came(now, guess1 == now, guess2 == now)
    assert (counted == tally).all() and (tally.reshape(-1, 3).sum(axis=0) > 0).all()
