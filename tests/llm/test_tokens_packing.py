"""Token store and packing: exact round trips and brute force."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenlake.llm import packing, tokenstore
from tokenlake.llm.queries import vocabulary
from tokenlake.llm.tokens import Encoder

WORD, BYTE = vocabulary("word_bpe_49k.json"), vocabulary("byte_bpe_50k.json")
TEXTS = ["Hello there, world!", None, "", "  two  spaces\n\nand lines \t\r\n x", "naïve café ½ ² ª", "日本語 and 🙂 emoji", "don't we'll I'M <|endoftext|> <|startoftext|>", "é combined", "İstanbul ĠĊ", "word " * 3000, "x" * 5000, "\x00\x1f  ", "a_b __ 12345 ٣٤"]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_encoder_equals_the_library(path):
    from tokenizers import Tokenizer

    enc, library = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = "aZéßªº²½_'’.,!$ \n\t 09日ĠĊİ"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["a <|endoftext|> b", "<|ENDOFTEXT|>", "<|startoftext|><|endoftext|>", "x<|endoftext", "|endoftext|>" * 3]
    for t in texts:
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_cache_is_bounded(monkeypatch):
    from tokenlake.llm import tokens

    monkeypatch.setattr(tokens, "CACHE", 10)
    enc = Encoder(WORD)
    for i in range(200):
        t = f"word{chr(97 + i % 26)} {chr(97 + i // 26)}{i}"
        assert np.frombuffer(enc.encode(t), enc.dtype).tolist() == enc.whole.encode(t, add_special_tokens=False).ids
    assert len(enc.new) <= 11 and len(enc.old) <= 11


def documents(spark):
    rows = [(i, t, "en", "s") for i, t in enumerate(TEXTS)] + [(3, "again", "en", "s"), (3, "again", "en", "s"), (None, "no id", "en", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, start string, shard string")  # clashing names


def test_store_round_trip(spark):
    docs = documents(spark)
    enc = Encoder(WORD)
    store = tokenstore.write_store(docs, WORD, 1)
    got = tokenstore.read_store(store, with_ids=True).collect()
    assert len(got) == docs.count()
    got.sort(key=lambda r: r.start)
    order = [r.doc_id for r in got]
    assert order == sorted(order, key=lambda d: -1 if d is None else d)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4"))
        at += r.n_tokens
    want = sorted([*enc.whole.encode(t or "", add_special_tokens=False).ids, 1] for t in [*TEXTS, "again", "again", "no id"])
    assert sorted(r.ids for r in got) == want
    assert tokenstore.read_document(spark, store, 0) == [[*enc.whole.encode(TEXTS[0], add_special_tokens=False).ids, 1]]
    assert len(tokenstore.read_document(spark, store, 3)) == 3


def test_store_refuses_another_dictionary(spark):
    store = tokenstore.write_store(documents(spark), WORD, 1)
    store.dictionary_hash = b"12345678"
    with pytest.raises(Exception, match="not a token shard"):
        tokenstore.read_store(store).collect()


def test_store_of_nothing(spark):
    store = tokenstore.write_store(documents(spark).limit(0), WORD, 1)
    assert tokenstore.read_store(store).collect() == []


def check_packing(rows, docs, enc, capacity, end):
    own = {}
    for r in rows:
        own.setdefault(r.sequence_id, []).append(r)
        assert 0 < r.length <= capacity
    for parts in own.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for r in parts:
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(own)


def test_packing_of_documents(spark):
    docs = documents(spark)
    enc = Encoder(BYTE)
    rows = packing.pack_documents(docs, BYTE, 2, 64, with_ids=True).collect()
    check_packing(rows, docs, enc, 64, 2)
    n = sum(r.length for r in rows)
    texts = [*TEXTS, "again", "again", "no id"]
    assert n == sum(len(enc.whole.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts)
    for doc_id, text in ((9, TEXTS[9]), (0, TEXTS[0]), (1, "")):
        parts = sorted((r for r in rows if r.doc_id == doc_id), key=lambda r: r.piece)
        ids = [*enc.whole.encode(text or "", add_special_tokens=False).ids, 2]
        assert [x for r in parts for x in r.ids] == ids and all(r.length == 64 for r in parts[1:])
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4")) for r in parts)
    assert packing.pack_documents(docs.limit(0), BYTE, 2).count() == 0


def test_sequences_hold_the_ids(spark):
    packed = packing.pack_documents(documents(spark), BYTE, 2, 64, with_ids=True)
    got = packing.sequences(packed)
    assert got.where(F.size("input_ids") != F.col("n_tokens")).count() == 0 and got.where("n_tokens > 64").count() == 0


def test_local_search_beats_best_fit():
    assert len(packing.best_fit([4, 4, 5, 5, 5, 7], 10)) == 4
    assert len(packing.pack([6, 6, 6, 6, 3, 3, 3, 3, 4, 4, 4, 4], 13)) == 4
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randint(1, 40) for _ in range(rng.randint(1, 120))]
        bins = packing.pack(lengths, 40)
        assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in b) <= 40 for b in bins)
        assert -(-sum(lengths) // 40) <= len(bins) <= len(packing.best_fit(lengths, 40))


def test_local_search_solves_perfect_triples():
    solved = 0
    for seed in range(40):
        rng, lengths = random.Random(seed), []
        for _ in range(15):
            a, b = rng.randint(8, 18), rng.randint(8, 18)
            lengths += [a, b, 40 - a - b]
        rng.shuffle(lengths)
        assert len(packing.best_fit(lengths, 40)) > 15
        solved += len(packing.pack(lengths, 40)) == 15
    assert solved > 25


def test_improve_empties_bins():
    lengths = [7, 3, 6, 4, 5, 5]
    worst = [[i] for i in range(6)]
    assert len(packing.improve(worst, lengths, 10)) == 3


def test_many_tiny_and_equal_pieces():
    bins = packing.pack([1] * 5000 + [1024] * 3, 1024)
    assert len(bins) == 3 + -(-5000 // 1024)
