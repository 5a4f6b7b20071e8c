"""Substring dedup, the Jaccard join and decontamination against plain versions."""

import random

import pytest
from llm import decontamination, ngram_jaccard, substring_dedup
from llm.common import components
from llm.decontamination import contamination
from llm.ngram_jaccard import jaccard_components
from llm.substring_dedup import SuffixAutomaton, dedup_substrings
from pyspark.sql import functions as F

from tests.llm import plain

TYPE = "doc_id long, text string, size string, node string, doc string, a string"


def frame(spark, docs, shuffle=True):
    rows = [(d, t, "x", "y", "z", "w") for d, t in docs]
    if shuffle:
        random.Random(5).shuffle(rows)
    return spark.createDataFrame(rows, TYPE).repartition(5)


def corpus(seed=1):
    """Copies, near copies, shared passages, a frequent line, empty, null, short and very long texts."""
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    say = lambda n: r.choices(vocabulary, k=n)
    line, passage, base = say(22), say(70), say(120)
    texts = [None, "", " \t\n", "one", "One", "one two three", "one two three four five", "a " * 300, "a " * 90]
    for _ in range(60):
        texts.append(" ".join(say(r.randint(1, 400))))
    for _ in range(40):
        texts.append(" ".join(say(r.randint(0, 60)) + passage[r.randint(0, 10):] + say(r.randint(0, 60))))
    for _ in range(40):
        texts.append(" ".join(say(r.randint(5, 90)) + line + say(r.randint(0, 90)) + line))
    for _ in range(60):  # a large family of near copies, some of which link only through others
        copy = list(base)
        for _ in range(r.randint(0, 6)):
            copy[r.randrange(len(copy))] = r.choice(vocabulary)
        texts.append(" ".join(copy))
    for _ in range(40):
        short = say(12)
        texts += [" ".join(short), " ".join(short[:-1]), " ".join(short).upper(), "\n".join(short) + " tail"]
    texts += [texts[70]] * 5 + [texts[20]] * 30 + [" ".join(say(20_000)), "é" * 200_000, "x" * 5_000_000 + " y"]
    r.shuffle(texts)
    return list(enumerate(texts, 3))


def joined(found):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()}


def test_jaccard_equals_plain(spark):
    docs = corpus()
    assert joined(jaccard_components(frame(spark, docs))) == plain.jaccard(docs)


@pytest.mark.parametrize("group, shingles", [(2, 150_000), (12, 900)])
def test_jaccard_with_frequent_signatures_and_small_blocks(spark, monkeypatch, group, shingles):
    monkeypatch.setattr(ngram_jaccard, "GROUP", group)
    monkeypatch.setattr(ngram_jaccard, "BLOCK_SHINGLES", shingles)
    docs = corpus(2)
    # a task-side constant: workers import their own copy, so the function is called with what it closes over
    assert joined(jaccard_components(frame(spark, docs))) == plain.jaccard(docs)


def test_jaccard_of_many_short_rows_in_one_batch(monkeypatch):
    """More rows in a batch than row numbers fit beside a shingle."""
    import pyarrow as pa

    r = random.Random(10)
    texts = [r.choice([None, "", "one two", " ".join(r.choices("abcdefgh", k=r.randint(1, 9)))]) for _ in range(10_000)]
    docs = list(enumerate(texts))
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.array(texts, pa.string())], ["doc", "text"])
    rows = [x for b in ngram_jaccard._pack(5, 80, 8)(iter([batch])) for x in b.to_pylist() if x["doc"] is not None]
    assert {x["doc"]: x["size"] for x in rows} == {d: n for d, (n, _) in plain.jaccard(docs).items()}
    # equal sets and only these have equal digests
    sets = {}
    for x in rows:
        w = tuple(plain.words(texts[x["doc"]]))
        key = frozenset(w[k:k + 5] for k in range(len(w) - 4)) if len(w) >= 5 else w
        assert sets.setdefault(key, x["digest"]) == x["digest"]
    assert len(set(sets.values())) == len(sets)
    sets = pa.RecordBatch.from_arrays(
        [pa.array([x["digest"] for x in rows]), pa.array([1] * 10_000, pa.int64()), pa.array([1] * 10_000, pa.int32()),
         pa.array([texts[x["doc"]] for x in rows], pa.string())], ["node", "family", "blocks", "text"])
    found = [x["node"] for b in ngram_jaccard._sets(5)(iter([sets])) for x in b.to_pylist()]
    assert found == [x["digest"] for x in rows]


def test_jaccard_of_short_rows_equals_plain(spark):
    r = random.Random(11)
    texts = [" ".join(r.choices([f"w{k}" for k in range(50)], k=r.randint(4, 12))) for _ in range(300)]
    texts = [None] * 3000 + [""] * 2000 + texts * 2 + [f"{t} tail" for t in texts] + [None] * 4100
    docs = list(enumerate(texts))
    data = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    assert joined(jaccard_components(data)) == plain.jaccard(docs)


@pytest.mark.parametrize("percent", [50, 95])
def test_jaccard_at_other_thresholds(spark, percent):
    docs = corpus(3)
    assert joined(jaccard_components(frame(spark, docs), 3, percent)) == plain.jaccard(docs, 3, percent)


def test_meet_holds_no_frequent_group(monkeypatch):
    """Streaming over frequent keys gives the same pairs and members as one pass."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(0)
    entries = np.unique(np.stack([r.integers(0, 40, 3000) * 64, r.integers(0, 500, 3000)], 1).astype(np.uint64), axis=0)
    r.shuffle(entries)
    batches = [ngram_jaccard._blank(ngram_jaccard._PACKED_ARROW, 1, entries=pa.array([entries[k:k + 50].tobytes()]))
               for k in range(0, len(entries), 50)]

    def met():
        rows = [x for b in ngram_jaccard._meet(iter(batches)) for x in b.to_pylist()]
        return (sorted((x["a"], x["b"]) for x in rows if x["kind"] == "frequent"),
                sorted((x["a"], x["b"], x["size"]) for x in rows if x["kind"] == "pair"))

    once = met()
    monkeypatch.setattr(ngram_jaccard, "SORT_ENTRIES", 200)
    assert met() == once


def test_components_of_paths_stars_and_cycles(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(5, k) for k in range(200, 400)] + [(7, 8), (8, 9), (9, 7), (3, 3)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long"), "t").collect()}
    want = plain.classes({x for link in links for x in link}, links)
    assert {n: c for n, c in want.items() if n != c} == {n: c for n, c in got.items() if n != c}


def removed(found):
    return {r["doc"]: (r["n_words"], r["n_removed"], r["kept"]) for r in found.collect()}


@pytest.mark.parametrize("shard", [128, 2])
def test_dedup_equals_plain(spark, monkeypatch, shard):
    monkeypatch.setattr(substring_dedup, "SHARD", shard)
    docs = corpus(4)
    assert removed(dedup_substrings(frame(spark, docs), hashed=True)) == plain.dedup(docs)


def test_dedup_with_few_words(spark):
    """Much repetition within and across documents, and short windows."""
    r = random.Random(8)
    docs = [(k, " ".join(r.choices("ab", k=r.randint(0, 60)))) for k in range(80)] + [(200, None)]
    assert removed(dedup_substrings(frame(spark, docs), length=6, hashed=True)) == plain.dedup(docs, 6)


def test_dedup_keeps_the_words_as_they_are(spark):
    text = "Ein Wört, noch  eins\n" + " ".join(f"t{k}" for k in range(60))
    got = {r["doc"]: r["kept"] for r in dedup_substrings(frame(spark, [(1, text), (2, "vor " + text + " nach")])).collect()}
    assert got == {1: " ".join(plain.words(text)), 2: "vor nach"}


def test_automaton_finds_earlier_matches():
    r = random.Random(3)
    for _ in range(200):
        sequences = [[r.choice("abc") for _ in range(r.randint(0, 25))] for _ in range(r.randint(1, 6))]
        automaton, limit = SuffixAutomaton(), r.randint(1, 5)
        for owner, s in enumerate(sequences):
            got = automaton.earlier(s, owner, limit)
            before = {tuple(x[k:k + limit]) for x in sequences[:owner] for k in range(len(x) - limit + 1)}
            assert got == [k for k in range(limit - 1, len(s)) if tuple(s[k - limit + 1:k + 1]) in before]
            automaton.add(s, owner)


def test_decontamination(spark):
    r = random.Random(6)
    vocabulary = [f"v{k}" for k in range(500)]
    item = r.choices(vocabulary, k=40)
    short = r.choices(vocabulary, k=10)
    swapped = list(item)
    for k in range(6, 40, 7):
        swapped[k] = "other"
    say = lambda n: r.choices(vocabulary, k=n)
    docs = [(1, " ".join(say(50) + item + say(50))), (2, ", ".join(say(5) + [w.upper() for w in swapped] + say(9))),
            (3, " ".join(say(200))), (4, None), (5, ""), (6, " ".join(item[10:26])), (7, " ".join(item[10:18] + say(30))),
            (8, " ".join(say(3) + short + say(4))), (9, " ".join(say(20_000) + item)), (10, " ".join(item)), (11, " ".join(item))]
    benchmark = spark.createDataFrame([(0, " ".join(item), "q"), (1, None, "q"), (2, "too short", "q"), (3, " ".join(short), "q"),
                                       (4, " ".join(item), "q")], "item_id long, text string, doc string")
    got = {x["doc_id"]: (x["overlaps"], x["item"], x["matched"]) for x in
           contamination(frame(spark, docs), benchmark).collect()}
    assert set(got) == set(range(1, 12))
    assert {d for d, x in got.items() if x[0]} == {1, 2, 6, 8, 9, 10, 11}
    assert got[1] == (2, 0, 40) and got[2][1:] == (0, 35) and got[6] == (2, 0, 16) and got[8] == (1, 3, 10)
    assert got[10] == got[11] == got[9]


def test_decontamination_by_short_items_and_unspaced_scripts(spark):
    han = "中华人民共和国的首都是哪一座城市"
    items = [(0, "Who wrote Hamlet?"), (1, "What is the capital of the old republic"), (2, "东京在哪里?"), (3, han), (4, "!?"),
             (5, "Zugzwang"), (6, "one two three four five six seven eight nine")]
    docs = [(1, "they ask: who wrote hamlet, and why"), (2, "hamlet wrote who"), (3, "what is the capital of the old republic"),
            (4, "what is the capital of the new republic"), (5, "有人问:东京在哪里。没有人知道"), (6, "东京在这里"),
            (7, "問題「" + han + "」"), (8, "a zugzwang"), (9, "zugzwangs"), (10, "one two three four five six seven eight nine"),
            (11, None), (12, "who wrote hamlet who wrote hamlet"), (13, han[:8])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {x["doc_id"]: (x["overlaps"], x["item"], x["matched"]) for x in contamination(frame(spark, docs), benchmark).collect()}
    assert {d: x for d, x in got.items() if x[0]} == {
        1: (1, 0, 3), 3: (1, 1, 8), 5: (1, 2, 5), 7: (1, 3, 16), 8: (1, 5, 1), 10: (1, 6, 9), 12: (2, 0, 3)}


def test_decontamination_lists_seeds_in_one_pass_without_lambdas(spark, monkeypatch):
    plans = {}

    def noted(frame, name, save=decontamination.saved):
        plans[name] = frame._jdf.queryExecution().optimizedPlan().toString()
        return save(frame, name)

    monkeypatch.setattr(decontamination, "saved", noted)
    benchmark = spark.createDataFrame([(0, "who wrote hamlet"), (1, " ".join(f"v{k}" for k in range(20)))], "item_id long, text string")
    found = contamination(frame(spark, [(1, "they ask who wrote hamlet"), (2, "nobody")]), benchmark).where("overlaps > 0")
    assert [r["doc_id"] for r in found.collect()] == [1]
    plan = plans["decontamination-hits"]
    assert plan.count("split(") == 1  # texts are split once, for seeds and for short items
    seeds = [line for line in plan.split("\n") if "xxhash64(0," in line]
    assert len(seeds) == 1 and "xxhash64(-3," in seeds[0] and "lambdafunction" not in seeds[0]  # generated code


@pytest.mark.parametrize("piece, rows", [(256, 500_000), (4, 500_000), (256, 0)])
def test_decontamination_at_every_position(spark, monkeypatch, piece, rows):
    """An item is found wherever it starts, also across the ends of pieces; a passage one word short of the least isn't."""
    monkeypatch.setattr(decontamination, "PIECE", piece)
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    long, short, nine = ([f"{c}{k}" for k in range(n)] for c, n in (("l", 14), ("s", 3), ("n", 9)))
    items = [(0, " ".join(long)), (1, " ".join(short)), (2, " ".join(nine)), (3, "single"), (4, None)]
    docs, want = [], set()
    for at in [*range(0, 12), *range(240, 270), *range(505, 515)]:
        for item, words in enumerate((long, short, nine, ["single"], long[:12], short[:2], nine[:8])):
            docs.append((len(docs), " ".join([f"x{k}" for k in range(at)] + words + ["y"] * (at % 3))))
            if item < 4:
                want.add((docs[-1][0], item, at, len(words), len(words)))
    found = decontamination.find_overlaps(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert set(map(tuple, found.collect())) == want


def test_empty_tables(spark):
    none = spark.createDataFrame([], TYPE)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert jaccard_components(none).count() == 0
    assert dedup_substrings(none).count() == 0
    assert contamination(none, benchmark).count() == 0
    some = frame(spark, [(1, "a b c")])
    assert contamination(some, benchmark).select("overlaps", F.col("item").isNull()).collect() == [(0, True)]
