"""Token output, byte-pair encoding and packing against the tokenizers library."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from assetry.llm import bpe, packing, substring, wavelet
from assetry.llm.common import give_back
from assetry.llm.tokens import WordEncoder, tokenizer_path, word_encoder
from tests.llm.plain import frame, odd_texts

LETTERS = "aaabbe  \n\t\x1c\x85\xa0'sStiér日本👍🏽́ͅ0123½.,!?<|endoftext|>ßΣς"


def random_texts(n):
    rng = random.Random(3)
    for k in range(n):
        text = "".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 60)))
        if k % 5 == 0:
            text = text[:20] + "<|endoftext|>" + text[20:]
        if k % 7 == 0:
            text = "".join(rng.choice("ab") for _ in range(40))
        if k % 11 == 0:
            text = "a" * rng.randint(1, 300)
        yield text


def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def ids_of(tokenizer, text):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_word_encoder_equals_the_library():
    encoder, plain = WordEncoder(tokenizer_path()), library("word_bpe_49k.json")
    texts = list(random_texts(3000)) + [t for _, t in odd_texts()]
    assert encoder.encode_batch(texts) == [ids_of(plain, t) for t in texts]
    encoder.LIMIT = 10  # forgets all the time
    assert encoder.encode_batch(texts) == [ids_of(plain, t) for t in texts]


def test_word_encoder_holds_a_bounded_part():
    """Also within one text, and of chunks of any length."""
    encoder, plain = WordEncoder(tokenizer_path()), library("word_bpe_49k.json")
    encoder.LIMIT = 50
    words = [f"w{i}x{i}," for i in range(500)]
    texts = [" ".join([*words, "often", "1a" * 5000]), " ".join(f"often {w}" for w in words)]
    assert encoder.encode_batch(texts) == [ids_of(plain, t) for t in texts]
    assert len(encoder) <= 50
    assert max(map(len, encoder)) <= 64


def test_encoder_goes_with_the_next_operators_task():
    """A worker that has packed does not carry the words through other stages."""
    batch = pa.RecordBatch.from_pydict({"k1": [1], "k2": [2], "text": ["a b " * 40]})
    word_encoder(tokenizer_path()).encode_batch(["some words"])
    give_back(keep_encoder=True)
    assert word_encoder.cache_info().currsize == 1
    assert len(list(substring._send_probes(4, 35)(iter([batch])))) == 1
    assert word_encoder.cache_info().currsize == 0


def test_special_tokens_in_other_case():
    """Only the exact spelling is a control token, in ASCII texts too."""
    encoder, plain = WordEncoder(tokenizer_path()), library("word_bpe_49k.json")
    texts = ["a <|ENDOFTEXT|> b", "A<|EndOfText|>B <|endoftext|> c", "<|StartOfText|>\nTHE End", "x<|STARTOFTEXT|>"]
    assert encoder.encode_batch(texts) == [ids_of(plain, t) for t in texts]
    ids = np.frombuffer(encoder.encode_batch(texts[:1])[0], "<u4").tolist()
    assert len(ids) == 8 and not {49406, 49407} & set(ids)


def test_byte_pairs_equal_the_library():
    vocabulary = bpe.Vocabulary(tokenizer_path("byte_bpe_50k.json"))
    encoder, decoder = bpe.Encoder(vocabulary), bpe.Decoder(vocabulary)
    plain = library("byte_bpe_50k.json")
    for text in list(random_texts(3000)) + [t for _, t in odd_texts()]:
        ids = encoder.encode(text)
        assert ids == ids_of(plain, text)
        assert decoder.decode(ids).decode() == (text or "")
        back = plain.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)
        assert back == (text or "")
    assert decoder.decode(np.array([255, 50256], "<u4").tobytes()).decode("utf-8", "replace")


def test_bpe_over_tables(spark):
    rows, plain = odd_texts(), library("byte_bpe_50k.json")
    docs = frame(spark, rows)
    got = sorted((str(r.doc_id), bytes(r.ids), r.n_tokens) for r in bpe.encode(docs).collect())
    want = [(str(i), ids_of(plain, t)) for i, t in rows]
    assert got == sorted((i, x, len(x) // 4) for i, x in want)
    back = sorted((str(r.doc_id), r.text) for r in bpe.decode(bpe.encode(docs)).collect())
    assert back == sorted((str(i), t or "") for i, t in rows)
    assert bpe.round_trip(docs.limit(0)).count() == 0


def test_packing(spark):
    rows, plain = odd_texts(), library("word_bpe_49k.json")
    pieces = packing.pack(frame(spark, rows)).collect()
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    assert all(p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0 for p in pieces)
    assert all(len(p.ids) == 4 * p.length for p in pieces)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(ids_of(plain, t) + b"\1\0\0\0")
    for i, wanted in texts.items():
        own = sorted((p.sequence_id, p.start, bytes(p.ids), p.doc_tokens) for p in pieces if p.doc_id == i)
        documents, at = [], 0
        for _, start, ids, n in own:
            if start == 0:
                documents.append((b"", n))
            joined, n0 = documents[-1]
            assert len(joined) == 4 * start and n == n0
            documents[-1] = (joined + ids, n)
        assert sorted(d for d, _ in documents) == sorted(wanted)
        assert all(len(d) == 4 * n for d, n in documents)
    assert packing.piece_lengths(2048 * 2 + 5) == [2048, 2048, 4, 1]
    assert packing.pack(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), longest=1000)


def test_buckets(spark, tmp_path):
    pieces = packing.pack(frame(spark, odd_texts(), extra=False))
    packing.write_buckets(pieces, f"file://{tmp_path}/buckets")
    assert spark.read.parquet(f"file://{tmp_path}/buckets/length=8").count() == pieces.where("length = 8").count()


def test_wavelet_files(spark, tmp_path):
    rows, plain = odd_texts(), library("word_bpe_49k.json")
    shards = wavelet.write(frame(spark, rows), f"file://{tmp_path}/ids", shard_tokens=2000)
    got = sorted(wavelet.read(shards).collect(), key=lambda r: r.start)
    assert sum(r.n_tokens for r in got) == shards.groupBy().sum("n_tokens").first()[0]
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i))
    at = 0
    for r in got:
        assert r.start == at and len(r.ids) == 4 * r.n_tokens
        at += r.n_tokens
    want = sorted((str(i), zlib.crc32(ids_of(plain, t) + b"\2\0\0\0")) for i, t in rows)
    assert sorted((str(r.doc_id), zlib.crc32(r.ids)) for r in got) == want
    assert wavelet.read(wavelet.write(frame(spark, rows).limit(0))).count() == 0


def test_small_shards_are_read_together(spark, monkeypatch):
    shards = wavelet.write(frame(spark, odd_texts()), shard_tokens=500)
    n, tokens = shards.count(), shards.groupBy().sum("n_tokens").first()[0]
    cores = spark.sparkContext.defaultParallelism
    assert n > cores
    few = wavelet.read(shards)
    assert few.rdd.getNumPartitions() == cores
    monkeypatch.setattr(wavelet, "SHARD_TOKENS", 2 * tokens // (cores + 1))
    many = wavelet.read(shards)
    assert cores < many.rdd.getNumPartitions() <= n
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert sum(r.n_tokens for r in few.collect()) == tokens


@pytest.mark.parametrize("n", [0, 1, 1000, 5000])
def test_wavelet_queries(tmp_path, n, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 1 << 9)
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 300, n) ** 2 % 49408).astype("<u4")
    path = str(tmp_path / "x.wavelet")
    with open(path, "wb") as f:
        f.write(wavelet.shard_bytes(ids, [4, None], np.array([0, min(3, n)])))
    shard = wavelet.Shard(path)
    assert shard.doc_ids == [4, None] and shard.ids().tolist() == ids.tolist()
    for i in rng.integers(0, n, 50).tolist() if n else []:
        assert shard.access(i) == ids[i]
        low, high = sorted(rng.integers(0, n + 1, 2).tolist())
        token = int(ids[i])
        assert shard.count(token, low, high) == (ids[low:high] == token).sum()
        places = np.flatnonzero(ids == token)
        assert shard.occurrence(token, len(places) - 1) == places[-1]
        assert shard.occurrence(token, 0) == places[0]
    assert shard.count(70_000) == 0
    with pytest.raises(IndexError):
        shard.access(n)
    shard.close()


def test_lookups_over_all_shards(spark):
    rows = [(i, t) for i, t in odd_texts() if i is not None] + [(900 + i, "the same words") for i in range(40)]
    shards = wavelet.write(frame(spark, rows, extra=False), shard_tokens=500)
    assert shards.count() > 10
    read = wavelet.read(shards).orderBy("start").collect()
    ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in read]).astype(int)
    tokens = [2, int(ids[0]), int(ids[-2]), 49_000, 70_000]
    got = {r.token: r.n for r in wavelet.count(shards, [*tokens, 2]).collect()}
    assert got == {t: int((ids == t).sum()) for t in tokens}
    for token in tokens:
        found = wavelet.occurrences(shards, token).orderBy("position").collect()
        assert [r.position for r in found] == np.flatnonzero(ids == token).tolist()
        for r in found[:50]:
            [doc] = [d for d in read if d.start <= r.position < d.start + d.n_tokens]
            assert doc.doc_id == r.doc_id and r.place == r.position - doc.start
    asked = [0, 5, 5, 499, 500, 1234, len(ids) - 1, len(ids), -1, None]
    table = spark.createDataFrame([(a,) for a in asked], "position long")
    got = sorted(map(str, map(tuple, wavelet.access(shards, table).collect())))
    want = [(a, int(ids[a]) if a is not None and 0 <= a < len(ids) else None) for a in asked]
    assert got == sorted(map(str, want))
