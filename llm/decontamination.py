"""Documents that hold passages of a benchmark, found by spaced seeds; DataFrame operations only.

A seed is a mask over consecutive words that looks at some positions and ignores the others, so a
substituted word at an ignored position does not hide a hit.  Hashes of the seeds of benchmark items
are joined with those of the documents.  A hit names an item and a diagonal (position in the
document less position in the item); on each diagonal the words are compared one by one, and the
stretch with the best balance of equal words (1 each) and substituted words (-2 each) is the overlap.

Items shorter than a seed have one exact key over all their words, which is joined with the document's
windows of that length.

A document is contaminated when an overlap has at least ``least`` equal words, or all but one in ten
of the words of an item shorter than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import saved

#: Positions looked at (1) and ignored (0).
MASKS = ("110110011", "101001111", "111010101")
SPAN = 9
LEAST = 13
#: Words of a document from which positions are listed at once.
PIECE = 256
#: Rows of benchmark seeds, and of words of its items, that are sent to every executor at most; beyond, the joins shuffle.
BROADCAST_ROWS = 500_000

#: What separates words: white space and ASCII signs.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Letters of scripts written without spaces, each of which is a word: Thai to Myanmar, Khmer, kana and Han.
UNSPACED = r"\u0E00-\u0E7F\u0E80-\u0EFF\u0F00-\u0FFF\u1000-\u109F\u1780-\u17FF\u3005-\u3007\u3040-\u30FF\u31F0-\u31FF" \
           r"\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF\uFF66-\uFF9F\x{20000}-\x{3FFFF}"
#: Signs of these scripts, which separate words.
UNSPACED_SIGNS = r"\u3000-\u3004\u3008-\u303F\u30FB\uFF00-\uFF0F\uFF1A-\uFF20\uFF3B-\uFF40\uFF5B-\uFF65"


def tokens(text: str) -> Column:
    """Words of a text in lower case, and single letters of scripts without spaces; none for a null text."""
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    apart = F.regexp_replace(F.regexp_replace(lower, f"[{UNSPACED_SIGNS}]", " "), f"([{UNSPACED}])", " $1 ")
    # All these scripts lie from U+0E00 on; one comparison spares letters before it the list of ranges.
    some = lower.rlike(f"[\\u0E00-\\x{{10FFFF}}&&[{UNSPACED}{UNSPACED_SIGNS}]]")
    return F.array_remove(F.split(F.when(some, apart).otherwise(lower), SEPARATORS), "")


def _positions(frame: DataFrame, *keep: str) -> DataFrame:
    """(*keep, at, h0 to h8): the hash of the word at each position of ``words`` and of the eight after it, null past the end.

    Words are hashed in pieces that overlap by a seed, so what a row carries while positions are listed has a fixed size
    at any length of the text.
    """
    last = F.size("words") - 1

    def piece(i: Column) -> Column:
        return F.struct(i.alias("first"), F.transform(
            F.sequence(i, F.least(i + (PIECE + SPAN - 2), last)), lambda j: F.xxhash64(F.get("words", j))).alias("h"))

    pieces = F.when(last >= 0, F.transform(F.sequence(F.lit(0), last, F.lit(PIECE)), piece))
    listed = frame.select(*keep, F.explode(pieces).alias("c")).select(*keep, "c.first", "c.h").select(
        *keep, "first", "h", F.explode(F.sequence(F.lit(0), F.least(F.size("h"), F.lit(PIECE)) - 1)).alias("p"))
    return listed.select(*keep, (F.col("first") + F.col("p")).alias("at"),
                         *[F.get("h", F.col("p") + k).alias(f"h{k}") for k in range(SPAN)])


def _keys(lengths: list[int]) -> Column:
    """Keys of a position: the hash of each mask, then that of the window of each length; null past the end."""
    def key(tag: int, places: list[int]) -> Column:
        return F.when(F.col(f"h{places[-1]}").isNotNull(), F.xxhash64(F.lit(tag), *[f"h{k}" for k in places]))

    return F.array(*[key(m, [k for k in range(SPAN) if mask[k] == "1"]) for m, mask in enumerate(MASKS)],
                   *[key(-n, list(range(n))) for n in lengths])


def find_overlaps(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id",
                  item_text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc, item, at, words, matched): overlaps of documents with benchmark items.

    ``at`` is the document word the overlap starts with.  Texts or items that are null or without words have no
    overlap; an item of fewer than ten words overlaps where all its words stand, also a single word; rows without
    an id are left out; equal items each count.
    """
    items = benchmark.select(F.col(item).alias("item"), tokens(item_text).alias("words")).where(
        F.col("item").isNotNull() & (F.size("words") > 0))
    items = saved(items.withColumn("total", F.size("words")), "decontamination-items")
    lengths = sorted(r["total"] for r in items.where(F.col("total") < SPAN).select("total").distinct().collect())
    # A window counts only as the key of a whole item.
    of = F.array(*[F.col("total")] * len(MASKS), *map(F.lit, lengths))
    seeds = _positions(items, "item", "total").select(
        "item", "total", F.col("at").alias("from"), F.posexplode(_keys(lengths)).alias("kind", "seed")).where(
        F.col("seed").isNotNull() & (F.get(of, F.col("kind")) == F.col("total"))).drop("kind").distinct()
    seeds = saved(seeds, "decontamination-seeds")
    small = seeds.count() <= BROADCAST_ROWS
    known = F.broadcast(seeds) if small else seeds
    named = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where("doc is not null")
    tested = _positions(named.select("doc", tokens("text").alias("words")), "doc").select(
        "doc", "at", F.explode(_keys(lengths)).alias("seed"))
    hits = tested.join(known, "seed").select(
        "doc", "item", "total", (F.col("at") - F.col("from")).alias("diagonal")).distinct()
    found = saved(hits.groupBy("doc").agg(F.collect_list(F.struct("item", "total", "diagonal")).alias("found")),
                  "decontamination-hits")
    # The part of the document that lies on the diagonal, and where it starts in the item.
    part = named.join(found, "doc").select("doc", tokens("text").alias("words"), "found").select(
        "doc", F.explode(F.transform("found", lambda c: F.struct(
            c["item"].alias("item"), F.greatest(-c["diagonal"], F.lit(0)).alias("skip"),
            F.greatest(c["diagonal"], F.lit(0)).alias("at"),
            F.slice("words", F.greatest(c["diagonal"], F.lit(0)) + 1,
                    c["total"] - F.greatest(-c["diagonal"], F.lit(0))).alias("part")))).alias("c")).select("doc", "c.*")
    texts = items.select("item", "total", F.col("words").alias("item_words"))
    pairs = part.join(F.broadcast(texts) if small else texts, "item")
    equal = F.zip_with("part", F.slice("item_words", F.col("skip") + 1, F.size("part")), lambda a, b: a == b)
    # (balance, start, equal words) of the running stretch and of the best so far.
    zero = F.expr("named_struct('n', 0, 'sum', 0, 'first', 0, 'same', 0, 'best', 0, 'from', 0, 'upto', 0, 'matched', 0)")

    def step(s: Column, same: Column) -> Column:
        balance = s["sum"] + F.when(same, 1).otherwise(-2)
        fresh = balance <= 0
        total = F.when(fresh, 0).otherwise(balance)
        first = F.when(fresh, s["n"] + 1).otherwise(s["first"])
        count = F.when(fresh, 0).otherwise(s["same"] + F.when(same, 1).otherwise(0))
        better = total > s["best"]
        return F.struct((s["n"] + 1).alias("n"), total.alias("sum"), first.alias("first"), count.alias("same"),
                        F.when(better, total).otherwise(s["best"]).alias("best"),
                        F.when(better, first).otherwise(s["from"]).alias("from"),
                        F.when(better, s["n"] + 1).otherwise(s["upto"]).alias("upto"),
                        F.when(better, count).otherwise(s["matched"]).alias("matched"))

    return pairs.withColumn("s", F.aggregate(equal, zero, step)).select(
        "doc", "item", (F.col("at") + F.col("s.from")).alias("at"), (F.col("s.upto") - F.col("s.from")).alias("words"),
        F.col("s.matched").alias("matched"), "total").where(
        F.col("matched") >= F.least(F.lit(least), F.ceil(F.col("total") * 0.9))).select(
        "doc", "item", "at", "words", "matched").distinct()


def contaminated_documents(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """(doc, overlaps, item, matched) of each document with an overlap: the number of overlaps, and the item
    and the number of equal words of the largest (the smallest item of equals)."""
    return find_overlaps(docs, benchmark, doc, **options).groupBy("doc").agg(
        F.count(F.lit(1)).alias("overlaps"),
        F.min(F.struct((-F.col("matched")).alias("size"), F.col("item").alias("item"))).alias("top")).select(
        F.col("doc").alias(doc), "overlaps", "top.item", (-F.col("top.size")).cast("long").alias("matched"))


def contamination(docs: DataFrame, benchmark: DataFrame, doc: str = "doc_id", **options) -> DataFrame:
    """All columns of ``docs`` with overlaps, item and matched; 0 and null without an overlap.

    Columns of these names are replaced.
    """
    found = contaminated_documents(docs, benchmark, doc, **options).withColumnRenamed(doc, "_doc")
    docs = docs.drop("overlaps", "item", "matched")
    return docs.join(found, docs[doc] == F.col("_doc"), "left").select(
        *docs.columns, F.coalesce("overlaps", F.lit(0)).cast("long").alias("overlaps"), "item", "matched")


def op2_decontamination(spark, folder: str) -> DataFrame:
    """All documents that hold passages of benchmark items, with the item they share most with."""
    docs, benchmark = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    found = contaminated_documents(docs, benchmark)
    return found.select("doc_id", F.col("item").alias("item_id"), "overlaps", "matched")
