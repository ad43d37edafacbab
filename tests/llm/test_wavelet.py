import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lectern.llm import wavelet

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "Bc", " ", "  ", "\n", "\n\n", "\t", "'s", "'", "don't", ",", ".", "|", "é", "ж", "中", "1", "23", " ", " ", "\x1c", "\x0b", "\r\n", "<|endoftext|>", "<|", "|>", "İ", "é", "\x00", "😀", "-", "\x85", "_", " the"]


def plain(texts):
    found = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    return [[*e.ids, wavelet.END_ID] for e in found]


def test_pieces_equal_the_tokenizer():
    rng = random.Random(5)
    texts = ["".join(rng.choices(PARTS, k=rng.randint(0, 30))) for _ in range(8000)]
    code = wavelet.PieceEncoder(PATH, limit=500)
    assert code.by_pieces
    for _ in range(2):  # the second time from the table, or after it was cleared
        assert [x.tolist() for x in code.documents([t.encode() for t in texts], wavelet.END_ID)] == plain(texts)


def test_long_texts_are_cut_where_nothing_changes(monkeypatch):
    monkeypatch.setattr(wavelet, "SEGMENT", 1000)
    rng = random.Random(6)
    text = " ".join("".join(rng.choices(PARTS, k=6)) for _ in range(20000))
    code = wavelet.PieceEncoder(PATH)
    assert [x.tolist() for x in code.documents([text.encode(), b"", text[:5000].encode()], 2)] == plain([text, "", text[:5000]])


def test_other_files_encode_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    code = wavelet.PieceEncoder(path)
    assert not code.by_pieces
    assert next(code.documents([b"Some words, and more"], 1)).tolist() == [*Tokenizer.from_file(path).encode("Some words, and more", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize(("n", "planes", "block"), [(0, 16, 64), (1, 16, 64), (1000, 5, 64), (70_001, 16, 1 << 16), (5000, 17, 512), (257, 1, 64)])
def test_matrix_answers_as_the_array_does(monkeypatch, n, planes, block):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", block)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), (1 << planes) - 1)
    file = wavelet.build(ids, planes)
    found = wavelet.WaveletMatrix(file)
    assert found.tokens().tolist() == ids.tolist()
    for at in rng.integers(0, n, 40) if n else []:
        assert found.access(int(at)) == ids[at]
        token = int(ids[at])
        places = np.flatnonzero(ids == token)
        assert found.rank(token) == len(places) and found.rank(token, int(at)) == (places < at).sum()
        k = int(rng.integers(0, len(places)))
        assert found.select(token, k) == places[k]
    absent = next((t for t in range(1 << planes) if t not in set(ids.tolist())), 1 << planes)
    assert found.rank(absent) == 0 and found.rank(1 << planes) == 0
    for wrong in (lambda: found.access(n), lambda: found.select(absent, 0), lambda: wavelet.WaveletMatrix(b"XXXX" + file[4:])):
        with pytest.raises((IndexError, ValueError)):
            wrong()


def corpus():
    rng = random.Random(8)
    rows = [(i, "".join(rng.choices(PARTS, k=rng.randint(0, 40)))) for i in rng.sample(range(-500, 5000), 300)]
    rows += [(None, "no id"), (None, None), (77_777, None), (77_778, ""), (77_779, "long " * 60_000)]
    return rows + [(9, f"same id {i % 7}") for i in range(60)]


@pytest.mark.parametrize("parts", [1, 6])
def test_documents_come_back_in_order(spark, parts):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, part string, seq string, h int").repartition(parts)
    shards = wavelet.write_shards(docs, shard_tokens=500)
    assert shards.count() > 6 and shards.agg({"n_tokens": "sum"}).first()[0] == sum(map(len, plain([t or "" for _, t in rows])))
    got = sorted(wavelet.read_documents(shards, with_ids=True).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    start = 0
    for r in got:
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes()))
        start += r["n_tokens"]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, list(r["ids"])) for r in got) == sorted((i is not None, i or 0, ids) for (i, _), ids in zip(rows, plain([t or "" for _, t in rows]), strict=True))
    stream = [t for r in got for t in r["ids"]]
    asked = [wavelet.END_ID, stream[0], 262, 50256, 40000]
    assert {r["token"]: r["n"] for r in wavelet.token_counts(shards, asked).collect()} == {t: stream.count(t) for t in asked}
    places = wavelet.occurrences(shards, [wavelet.END_ID, 50256]).collect()
    assert sorted((r["token"], r["place"]) for r in places) == sorted((t, i) for i, t in enumerate(stream) if t in (wavelet.END_ID, 50256))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert wavelet.token_documents(docs).count() == 0
