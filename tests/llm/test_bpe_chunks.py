"""BPE ids from shared chunks, against the tokenizer itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from llm import bpe_chunks
from llm.bpe_chunks import chunk_ends, cut_places, decode_bytes, decode_texts, encode_texts, op11_bpe_chunks, repair
from llm.token_files import TOKENIZER, _tokenizer

PATH = public_tokenizers.path(TOKENIZER)
LETTERS = [*" \n\t aZé0½'<|,.ßñ̀漢 \u0085　", "<|endoftext|>", " the", " don't we'll", "  ", "I'", "\x1c"]


def ids_of(text):
    return _tokenizer(PATH).encode(text or "", add_special_tokens=False).ids


def chunks_of(raw):
    data = np.frombuffer(raw, np.uint8)
    ends = chunk_ends(data, cut_places(data).tolist(), 0, len(data))
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


@pytest.fixture
def small(monkeypatch):
    for name, value in (("WINDOW", 4), ("LEAST", 4), ("MOST", 40), ("CUT_BITS", 3)):
        monkeypatch.setattr(bpe_chunks, name, value)


def test_joins_are_repaired_at_any_cut(small):
    """Cuts within words, contractions, special tokens, runs of white space and texts without any."""
    r = random.Random(5)
    texts = ["".join(r.choices(LETTERS, k=r.randint(1, 200))) for _ in range(1500)] + ["a" * 3000, " " * 2000, "漢" * 2000, "é" * 999]
    parts = [chunks_of(t.encode()) for t in texts]
    assert [b"".join(p).decode() for p in parts] == texts and sum(map(len, parts)) > 10 * len(texts)
    ids = bpe_chunks._encode_texts([c for p in parts for c in p], PATH)
    first = np.concatenate([[0], np.cumsum([len(i) for i in ids])])
    walls = first[np.concatenate([[0], np.cumsum([len(p) for p in parts])])]
    got, ends = repair(np.concatenate(ids).astype(np.int64), first[~np.isin(first, walls)], walls, PATH)
    assert [got[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])] == [ids_of(t) for t in texts]


def test_chunks_of_a_passage_do_not_depend_on_what_stands_before():
    r = random.Random(6)
    passage = " ".join(r.choices(["one", "two", "three", "fünf", "six,"], k=4000))
    a, b = ({*chunks_of((head + passage).encode())} for head in ("", "Something else, of some length. " * 40))
    assert len(a & b) >= len(a) - 3 and max(map(len, a | b)) <= bpe_chunks.MOST


def test_a_wide_text_is_cut_alike_in_pieces(monkeypatch):
    data = np.frombuffer(random.Random(7).randbytes(200_000), np.uint8)
    whole = cut_places(data)
    monkeypatch.setattr(bpe_chunks, "SCAN", 1000)
    assert (cut_places(data) == whole).all() and len(whole) > 100


def test_ids_of_odd_rows(spark, small, monkeypatch):
    monkeypatch.setattr(bpe_chunks, "PACK", 3000)
    monkeypatch.setattr(bpe_chunks, "REMEMBER", 500)
    r = random.Random(8)
    texts = ["".join(r.choices(LETTERS, k=r.randint(0, 90))) for _ in range(60)] + [None, "", "word " * 20_000]
    rows = [(k, t, "x") for k, t in enumerate(texts)] + [(0, texts[0], "x")] * 2 + [(1, "other", "x"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(5)
    got = sorted((x["doc_id"], x["ids"]) for x in encode_texts(docs).collect())
    assert got == sorted((d, ids_of(t)) for d, t, _ in rows if d is not None)
    back = decode_texts(encode_texts(docs.select("doc_id", "text"))).collect()
    assert sorted((x["doc_id"], x["text"]) for x in back) == sorted((d, t or "") for d, t, _ in rows if d is not None)
    assert encode_texts(docs.limit(0)).count() == 0


def test_decoding_of_any_ids(spark):
    r = random.Random(9)
    for _ in range(300):
        ids = [r.choice([50256, r.randrange(50257), r.randrange(256)]) for _ in range(r.randint(0, 20))]
        assert decode_bytes(np.array(ids, np.int64), PATH).decode() == _tokenizer(PATH).decode(ids, skip_special_tokens=False)
    frame = spark.createDataFrame([(1, [15496, 995], "old"), (2, None, "old"), (3, [], "old")], "k int, ids array<int>, text string")
    assert sorted((x["k"], x["text"]) for x in decode_texts(frame).collect()) == [(1, "Hello world"), (2, None), (3, "")]


def test_other_tokenizers_are_refused(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    with pytest.raises(ValueError):
        encode_texts(docs, public_tokenizers.path("word_bpe_49k.json"))


def test_digests_of_all_documents(spark, folder):
    texts = {x["doc_id"]: x["text"] or "" for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {x["doc_id"]: tuple(x)[1:] for x in op11_bpe_chunks(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for doc, text in texts.items():
        ids = ids_of(text)
        assert got[doc] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
