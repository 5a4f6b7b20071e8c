"""Removal of word sequences that already occur in an earlier document, with suffix automata.

A window is ``length`` consecutive words.  Every window that also starts in a document with a
smaller id is covered and its words go; windows are judged on the input.

The reference of a document is all earlier text, so one automaton for each pair of shards would
read everything many times.  Instead the text is dealt to reference shards by content: each
window belongs to the shard named by the smallest hash among its k-word sequences, and windows that
follow each other in the same shard form a segment.  Equal windows fall in the same shard wherever
they stand.  In a shard with one distinct segment nothing but that segment repeats.  Otherwise
its segments, in the order of their first documents, are streamed against the shard's suffix
automaton for matching statistics and then added to it; each state knows the first document of its
strings, so that a match of ``length`` words tells whether it lies in an earlier document.

Only distinct segments of shards with two or more of them reach an automaton; equal copies of a
segment are settled by one aggregate.  A shard with more than ``SHARD`` distinct segments (a very
common passage in many contexts) is split to chunks and then to single windows, whose automata are
chains and are compared as hashes: aggregates that combine before the shuffle.  Windows are compared
by 64-bit hashes there, words by 32-bit hashes in an automaton.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import as_signed, grams, ranges_hash, row_slices, saved, strings, words

#: Words in the sequences whose smallest hash names a shard.
ANCHOR = 16
#: Windows in a segment at most; longer runs are cut.
RUN = 64
#: Distinct segments that one automaton takes.
SHARD = 128
#: Windows in a chunk of a segment, on average.
CHUNK = 8


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    reach = 1
    while reach * 2 <= width:
        values = np.minimum(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def segments(hashes: np.ndarray, first: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Row, first word, windows, shard and content hash of the segments of some rows."""
    empty = np.zeros(0, np.int64)
    anchor = min(ANCHOR, length)
    if len(hashes) < length:
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    least = _sliding_min(grams(hashes, anchor), length - anchor + 1)
    row = np.searchsorted(first, np.arange(len(least)), "right") - 1
    inside = np.arange(len(least)) + length <= first[row + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    begin = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (least[at[1:]] != least[at[:-1]]) | (row[at[1:]] != row[at[:-1]])])
    run = np.flatnonzero(begin)
    position = np.arange(len(at)) - np.repeat(run, np.diff(np.concatenate([run, [len(at)]])))
    run = np.flatnonzero(position % RUN == 0)
    count = np.diff(np.concatenate([run, [len(at)]]))
    start = at[run]
    return row[start], start - first[row[start]], count, least[start], ranges_hash(hashes, start, start + count + length - 1)


def _split(length: int):
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("doc", pa.int64()), ("start", pa.int64()),
                        ("windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for a, b in row_slices(offsets):
                _, _, hashes, first = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                row, start, count, shard, content = segments(hashes, first, length)
                yield pa.RecordBatch.from_arrays([as_signed(shard), as_signed(content), pa.array(ids[a:b][row], pa.int64()),
                                                  pa.array(start), pa.array(count)], schema=schema)

    return run


def _contents(length: int):
    """The words of chosen segments as 32-bit hashes."""
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("owner", pa.int64()), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in row_slices(offsets):
                _, _, hashes, first = words(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                short = (hashes >> np.uint64(32)).astype(np.uint32)
                out = [[], [], [], []]
                for k in range(a, b):
                    owner = batch.column("doc")[k].as_py()
                    for s in batch.column("segments")[k].as_py():
                        at, size = first[k - a] + s["start"], s["windows"] + length - 1
                        if at + size > first[k - a + 1]:
                            continue  # another text under the same id
                        for column, value in zip(out, (s["shard"], s["segment"], owner, short[at:at + size].tobytes())):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


class SuffixAutomaton:
    """A suffix automaton of several word sequences; each state has the first owner of its strings."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _state(self, following: dict, link: int, length: int, owner) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.link) - 1

    def _clone(self, parent: int, word) -> int:
        """Split the state that ``parent`` reaches by ``word`` so that it ends with parent's strings."""
        old = self.next[parent][word]
        new = self._state(dict(self.next[old]), self.link[old], self.length[parent] + 1, self.owner[old])
        self.link[old] = new
        while parent >= 0 and self.next[parent].get(word) == old:
            self.next[parent][word] = new
            parent = self.link[parent]
        return new

    def add(self, sequence, owner) -> None:
        """Add a sequence; owners must not decrease from one call to the next."""
        following, link, length = self.next, self.link, self.length
        last = 0
        for word in sequence:
            known = following[last].get(word)
            if known is not None:
                last = known if length[known] == length[last] + 1 else self._clone(last, word)
                continue
            state, parent = self._state({}, 0, length[last] + 1, owner), last
            while parent >= 0 and word not in following[parent]:
                following[parent][word] = state
                parent = link[parent]
            if parent >= 0:
                known = following[parent][word]
                link[state] = known if length[known] == length[parent] + 1 else self._clone(parent, word)
            last = state

    def earlier(self, sequence, owner, limit: int) -> list[int]:
        """Positions where a match of ``limit`` words ends whose first owner is before ``owner``."""
        following, link, length, owners = self.next, self.link, self.length, self.owner
        state, matched, found = 0, 0, []
        for at, word in enumerate(sequence):
            while state and word not in following[state]:
                state = link[state]
                matched = length[state]
            state = following[state].get(word, 0)
            matched = matched + 1 if state else 0
            if matched >= limit:
                matched = limit
                while length[link[state]] >= limit:
                    state = link[state]
                if owners[state] < owner:
                    found.append(at)
        return found


def _match(length: int):
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("first", pa.int64()), ("windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, automaton = None, None
        for batch in batches:
            out = [[], [], [], []]
            for shard, segment, owner, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "segment", "owner", "words"))):
                if shard != current:
                    current, automaton = shard, SuffixAutomaton()
                sequence = np.frombuffer(blob, np.uint32).tolist()
                ends = np.array(automaton.earlier(sequence, owner, length), np.int64) if automaton.link[1:] else []
                automaton.add(sequence, owner)
                if len(ends):
                    begin = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1] + 1]))
                    count = np.diff(np.concatenate([begin, [len(ends)]]))
                    for column, values in zip(out, ([shard] * len(begin), [segment] * len(begin),
                                                    ends[begin] - length + 1, count)):
                        column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def _chunks(length: int):
    """Segments cut at windows chosen by their content, with the hashes of each chunk's windows."""
    schema = pa.schema([("shard", pa.int64()), ("segment", pa.int64()), ("owner", pa.int64()), ("first", pa.int64()),
                        ("windows", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                sequences = [np.frombuffer(x.as_buffer(), np.uint32).astype(np.uint64) for x in part.column("words")]
                hashes = [grams(s, length) for s in sequences]
                firsts = [np.union1d([0], np.flatnonzero(h % np.uint64(CHUNK) == 0)) for h in hashes]
                counts = [np.diff(np.append(f, len(h))) for f, h in zip(firsts, hashes)]
                chunks = [ranges_hash(s, f, f + n + length - 1) for s, f, n in zip(sequences, firsts, counts)]
                each, count = [len(f) for f in firsts], np.concatenate(counts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()),
                                                 as_signed(np.concatenate(hashes)))
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(np.repeat(part.column(c).to_numpy(), each)) for c in ("shard", "segment", "owner")),
                     pa.array(np.concatenate(firsts)), pa.array(count), as_signed(np.concatenate(chunks)), lists], schema=schema)

    return run


def _chained(contents: DataFrame, length: int) -> DataFrame:
    """(shard, segment, first, windows): runs of windows with an earlier owner, by hashes.

    Whole chunks first: they collapse the inner part of a common passage.  Only one chunk of each
    content, its first, goes on to be compared window by window.
    """
    chunks = saved(contents.select("shard", "segment", "owner", "words").mapInArrow(
        _chunks(length), "shard long, segment long, owner long, first long, windows long, chunk long, hashes array<long>"),
        "dedup-chunks")
    first = chunks.groupBy("shard", "chunk").agg(F.min("owner").alias("before"), F.count(F.lit(1)).alias("n"))
    marked = chunks.join(first.where("n > 1").select("shard", "chunk", "before"), ["shard", "chunk"], "left")
    whole = marked.where("before < owner").select("shard", "segment", "first", "windows")
    windows = marked.where("before is null or before >= owner").select(
        "shard", "segment", "owner", "first", F.posexplode("hashes").alias("k", "window"))
    least = windows.groupBy("shard", "window").agg(F.min("owner").alias("before"), F.max("owner").alias("last")).where("before < last")
    single = windows.join(least, ["shard", "window"]).where("before < owner")
    found = single.groupBy("shard", "segment").agg(F.collect_set((F.col("first") + F.col("k")).cast("long")).alias("at"))
    begins = F.array_sort(F.filter("at", lambda x: ~F.array_contains("at", x - 1)))
    ends = F.array_sort(F.filter("at", lambda x: ~F.array_contains("at", x + 1)))
    runs = found.select("shard", "segment", F.explode(F.zip_with(begins, ends, lambda x, y: F.struct(
        x.alias("first"), (y - x + 1).alias("windows")))).alias("run")).select("shard", "segment", "run.*")
    return whole.unionByName(runs)


def repeated_spans(docs: DataFrame, length: int = 50, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, first, words): runs of words that lie in windows which start in an earlier document as well.

    Runs of a document may overlap.  Words are maximal runs without white space, compared as they
    are; null and empty texts have none.  Rows without an id are left out; ids are taken to be unique.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    parts = saved(docs.mapInArrow(_split(length), "shard long, segment long, doc long, start long, windows long"),
                  "dedup-segments")
    distinct = saved(parts.groupBy("shard", "segment").agg(
        F.min(F.struct("doc", "start", "windows")).alias("at"), F.count(F.lit(1)).alias("rows"))
        .select("shard", "segment", "rows", "at.*"), "dedup-distinct")
    mixed = distinct.groupBy("shard").agg(F.count(F.lit(1)).alias("distinct")).where("distinct > 1")
    queries = distinct.join(mixed, "shard")
    chosen = queries.groupBy("doc").agg(F.collect_list(F.struct("shard", "segment", "start", "windows")).alias("segments"))
    contents = chosen.join(docs, "doc").mapInArrow(
        _contents(length), "shard long, segment long, owner long, words binary").join(mixed, "shard")
    contents = saved(contents, "dedup-contents")
    matched = contents.where(F.col("distinct") <= SHARD).select("shard", "segment", "owner", "words").repartition(
        partitions, "shard").sortWithinPartitions("shard", "owner", "segment").mapInArrow(
        _match(length), "shard long, segment long, first long, windows long")
    chained = _chained(contents.where(F.col("distinct") > SHARD), length)
    matched = matched.unionByName(chained)
    owners = distinct.select("shard", "segment", F.col("doc").alias("owner"))
    copied = parts.join(owners.join(distinct.where("rows > 1").select("shard", "segment"), ["shard", "segment"], "semi"),
                        ["shard", "segment"]).where("doc > owner").select(
        "doc", F.col("start").alias("first"), (F.col("windows") + length - 1).alias("words"))
    # An owner may hold its segment more than once; what is matched is covered in each place.
    partly = parts.join(matched.withColumnRenamed("windows", "run"), ["shard", "segment"]).join(
        owners, ["shard", "segment"]).where("doc = owner").select(
        "doc", (F.col("start") + F.col("first")).alias("first"), (F.col("run") + length - 1).alias("words"))
    return copied.unionByName(partly)


def _keep(hashed: bool):
    """Texts without the covered words; as their SHA-256 or whole."""
    schema = pa.schema([("doc", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            ids, spans = batch.column("doc"), batch.column("spans")
            for a, b in row_slices(offsets):
                part = data[offsets[a]:offsets[b]]
                start, end, _, first = words(part, offsets[a:b + 1] - offsets[a])
                change = np.zeros(len(start) + 1, np.int64)
                flat = spans.slice(a, b - a)
                inner = flat.flatten()
                at = np.repeat(first[:-1], [len(x) if x.is_valid else 0 for x in flat]) if len(inner) else []
                if len(inner):
                    begin = at + inner.field("first").to_numpy()
                    np.add.at(change, begin, 1)
                    np.add.at(change, begin + inner.field("words").to_numpy(), -1)
                keep = np.cumsum(change[:-1]) == 0
                # kept words and one space after each, copied in one step
                size = (end - start)[keep]
                length = size + 1
                goal = np.cumsum(length) - length
                joined = np.full(int(length.sum()), 32, np.uint8)
                shift = np.repeat(start[keep] - goal, size)
                place = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
                joined[place] = part[place + shift]
                bounds = np.concatenate([[0], np.cumsum(keep)])[first]
                ends = np.concatenate([[0], np.cumsum(length)])[bounds]
                joined = joined.tobytes()
                texts = [joined[x:max(x, y - 1)] for x, y in zip(ends[:-1], ends[1:])]
                out = [hashlib.sha256(t).hexdigest() for t in texts] if hashed else [t.decode() for t in texts]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(np.diff(first)),
                                                  pa.array(np.diff(first) - np.diff(bounds)), pa.array(out)], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, length: int = 50, doc: str = "doc_id", text: str = "text",
                     hashed: bool = False) -> DataFrame:
    """(doc, n_words, n_removed, kept): each text without the words of repeated windows.

    ``kept`` joins the remaining words by one space, or is the SHA-256 of that text.  A null text is
    empty; other columns are ignored.
    """
    spans = repeated_spans(docs, length, doc, text).groupBy("doc").agg(
        F.collect_list(F.struct("first", "words")).alias("spans"))
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    return docs.join(spans, "doc", "left").select("doc", "text", F.coalesce(
        "spans", F.array().cast("array<struct<first:long,words:long>>")).alias("spans")).mapInArrow(
        _keep(hashed), "doc long, n_words long, n_removed long, kept string")


def op1_substring_dedup(spark, folder: str) -> DataFrame:
    """Words of 50-word windows that start in an earlier document, for all documents."""
    out = dedup_substrings(spark.read.parquet(f"{folder}/documents.parquet"), hashed=True)
    return out.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
