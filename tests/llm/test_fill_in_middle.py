"""Fill-in-middle examples against a plain version, and their round trip."""

import hashlib
import random
import re

import pytest
from llm.fill_in_middle import NAMES, Rule, arrange, cut, fill_in_middle, op12_fill_in_middle, restore_texts
from pyspark.sql import functions as F

LETTERS = [*"ab é漢\n\n\r", "<P", "S>", "<M", ">", "<", "\n\n"]


def plainly(doc, text, rate=100, suffix_first=50, seed=7):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < suffix_first else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    texts = ["".join(r.choices(LETTERS, k=r.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "\n", "one line", "a <P> b\nc", "<S>", "x<M>", "line\n" * 60_000, "漢" * 100_000]
    rows = [(k, t, "old") for k, t in enumerate(texts)]
    return rows + rows[:3] + [(None, "a\nb\nc", "old"), (None, None, None)]


@pytest.mark.parametrize("rule", [{}, {"rate": 40, "suffix_first": 80, "seed": 3}, {"rate": 0}])
def test_outputs_and_what_is_rebuilt(spark, rows, rule):
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string").repartition(3)
    found = fill_in_middle(docs, Rule(**rule))
    assert found.columns == ["doc_id", "text", *NAMES]
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = sorted((tuple(x) for x in found.collect()), key=key)
    assert got == sorted(((d, t, *plainly(d, t, **rule)) for d, t, _ in rows), key=key)
    back = restore_texts(found.withColumn("kept", F.coalesce("text", F.lit(""))).drop("text"), Rule(**rule))
    assert back.where("text <> kept").count() == 0 and back.count() == len(rows)


def test_other_names_and_no_rows(spark):
    docs = spark.createDataFrame([("x", "a\nb", 1)], "name string, body string, n int")
    found = fill_in_middle(docs, doc="name", text="body", names=("lines", "form", "before", "between", "example"))
    assert found.columns == ["name", "body", "n", "lines", "form", "before", "between", "example"]
    row = found.first()
    assert (row["n"], row["lines"]) == (1, 2) and row["example"] == plainly("x", "a\nb")[4]
    assert fill_in_middle(docs.limit(0), doc="name", text="body").count() == 0
    with pytest.raises(ValueError):
        fill_in_middle(docs, doc="name", text="body", names=("body", "form", "a", "b", "c"))
    with pytest.raises(ValueError):
        Rule(prefix="<P>", middle="<P>").marks()


def test_cutting_splits_descriptors():
    pieces = [(0, 5, 9), (1, 0, 3), (0, 20, 20), (0, 30, 40)]
    for at in range(0, 18):
        left, right = cut(pieces, at)
        size = lambda p: sum(e - s for _, s, e in p)
        assert (size(left), size(right)) == (min(at, 17), max(17 - at, 0))
        spread = lambda p: [(b, k) for b, s, e in p for k in range(s, e)]
        assert spread(left) + spread(right) == spread(pieces)
    assert arrange([[(0, 0, 1)], [(0, 1, 2)], [(0, 2, 3)]], "spm", (b"P", b"M", b"S")) == [
        (1, 2, 3), (0, 2, 3), (1, 0, 1), (0, 0, 1), (1, 1, 2), (0, 1, 2)]


def test_digests_of_all_documents(spark, folder):
    texts = {x["doc_id"]: x["text"] for x in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {x["doc_id"]: tuple(x)[1:] for x in op12_fill_in_middle(spark, folder).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {d: (*plainly(d, t)[:4], sha(plainly(d, t)[4]), sha(t or "")) for d, t in texts.items()}
    assert {x[1] for x in got.values()} >= {"psm", "spm"}
