"""The corpus pipeline, stage by stage and as a whole, against plain versions."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_pipeline import ORACLE_SQL, STAGES, run
from llm import decontamination, token_files
from pyspark.sql import functions as F

from tests.llm import plain

TYPE = "doc_id long, text string, lang string, source string, n_chars long"
VILE = "vile"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents of known kinds, labels and a benchmark, as Parquet."""
    r = random.Random(11)
    vocabulary = [f"word{k}" for k in range(900)]
    say = lambda n: r.choices(vocabulary, k=n)
    items = [say(30) for _ in range(6)]
    kinds, texts = [], []
    for k in range(700):
        kind = ("clean", "clean", "clean", "toxic", "copy", "near", "leak")[k % 7]
        base = say(r.randint(20, 90))
        if kind == "toxic":
            base.insert(r.randrange(len(base)), VILE)
        elif kind in ("copy", "near") and k > 7:
            base = texts[r.choice([j for j in range(k) if kinds[j] == "clean"])].split()
            if kind == "near":
                base = base + say(1)
        elif kind == "leak":
            at = r.randrange(len(base))
            leaked = list(r.choice(items))
            leaked[9] = "swapped"
            base[at:at] = leaked
        kinds.append(kind)
        texts.append(" ".join(base))
    rows = [(k, t, r.choice(["en", "de"]), r.choice(["a", "a", "b"]), len(t)) for k, t in enumerate(texts)]
    rows += [(900, None, None, None, None), (901, "", "en", "a", 0)]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, TYPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(kind == "toxic")) for k, kind in enumerate(kinds)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string").write.parquet(
        f"{folder}/benchmark.parquet")
    return folder, rows, [" ".join(i) for i in items]


def plain_overlap(text, item):
    """Whether some diagonal with a seed hit has a stretch with enough equal words."""
    split = lambda t: [w for w in re.split(decontamination.SEPARATORS, (t or "").lower()) if w]
    a, b = split(text), split(item)
    for shift in range(-len(b) + 1, len(a)):
        same = [a[shift + j] == b[j] if 0 <= shift + j < len(a) else None for j in range(len(b))]
        hit = any(all(k + i < len(same) and same[k + i] for i, c in enumerate(m) if c == "1") and k + decontamination.SPAN <= len(b)
                  and 0 <= shift + k and shift + k + decontamination.SPAN <= len(a) for m in decontamination.MASKS for k in range(len(same)))
        total = count = best = most = 0
        for s in (x for x in same if x is not None):
            total, count = total + (1 if s else -2), count + bool(s)
            if total <= 0:
                total = count = 0
            if total > best:
                best, most = total, count
        if hit and most >= min(decontamination.LEAST, -(-len(b) * 9 // 10)):
            return True
    return False


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=lambda r: r[0])


def test_stages_and_the_whole(spark, tables):
    folder, rows, items = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert ORACLE_SQL is None and [n for n, _ in STAGES] == [
        "toxicity", "near_duplicates", "decontamination", "mixing", "token_files"]
    left = rows
    for name, stage in STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/after-{name}")
        docs = spark.read.parquet(f"{folder}/after-{name}")
        got = rows_of(docs)
        if name == "toxicity":
            want = [r for r in left if VILE not in (r[1] or "").split()]
            assert len(set(got) ^ set(want)) <= 0.01 * len(left) and set(got) <= set(left)
        elif name == "near_duplicates":
            classes = plain.jaccard([(r[0], r[1]) for r in left])
            assert got == [r for r in left if classes[r[0]][1] == r[0]]
        elif name == "decontamination":
            assert got == [r for r in left if not any(plain_overlap(r[1], i) for i in items)]
        else:
            assert 0.4 * len(left) < len(got) < len(left) and set(got) <= set(left)
        left = got
    tokenizer = token_files._tokenizer(public_tokenizers.path(token_files.TOKENIZER))
    at, want = 0, []
    for r in left:
        ids = tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [0]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert rows_of(STAGES[-1][1](spark, docs, folder)) == want
    assert rows_of(run(spark, folder)) == want


def test_stages_take_empty_tables_and_any_column(spark, tables):
    folder, _, _ = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = ("score", "item", "matched", "kept", "probability", "component_id", "doc", "node", "a")
    for frame in (docs.limit(0), docs.limit(12).withColumns({n: F.lit("x") for n in names})):
        for name, stage in STAGES:
            out = stage(spark, frame, folder)
            if name != "token_files":
                assert out.columns == frame.columns and out.drop("doc_id").count() <= frame.count()
                assert out.where("false").count() == 0 and (not frame.count() or name == "mixing" or out.count())
            else:
                assert out.count() == frame.count()
