"""Byte-level BPE ids of whole texts, with content-defined chunks encoded once and their joins repaired.

1. Cutting.  A rolling hash over ``WINDOW`` bytes cuts texts where its top bits are zero, so the same
   passage is cut alike in every document, wherever it stands.  Chunks go to the bucket of their checksum.
2. Encoding.  A bucket's task encodes each distinct chunk once, whatever number of documents share it, and
   sends the ids to the documents.  Packed rows hold a content once beside the list of its occurrences, and
   a bucket that is too large is split by adaptive execution, so a chunk of a third of all documents is harmless.
3. Repair.  A document's chunks are strung together.  The tokenizer never joins a character and white space
   that follows it, so ids between two such places (a cell) don't depend on the rest of the text.  The cells
   that a join cuts are encoded anew together with the whole cells beside them; if the ids of those don't
   come out as they were, the stretch is widened and encoded again, up to the whole document.

Decoding looks up the bytes of ids in a table of the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import lean, mix, row_slices, strings, _BYTE
from llm.token_files import TOKENIZER, _encoder

#: Bytes under the rolling hash; it is a power of two.
WINDOW = 32
#: A place is a cut with a chance of one in 2**CUT_BITS; chunks have at least and at most so many bytes.
#: With LEAST no smaller than WINDOW the bytes before a text don't matter to its cuts.
CUT_BITS, LEAST, MOST = 10, 256, 8192
#: Bytes of text hashed at once, packed at once, and remembered with their ids.
SCAN, PACK, REMEMBER = 1 << 19, 32 << 20, 64 << 20
#: Compression level of packed rows.
LEVEL = 6

_GEAR = (_BYTE >> np.uint64(32)).astype(np.uint32)
_FACTOR = 0x9E3779B1


# -- cutting -----------------------------------------------------------------

def cut_places(data: np.ndarray) -> np.ndarray:
    """Places where the rolling hash cuts, as positions of the byte after; never within a character."""
    found = []
    for at in range(0, len(data), SCAN):
        begin = max(0, at - WINDOW + 1)
        value = _GEAR[data[begin:at + SCAN]]
        width, factor = 1, _FACTOR
        while width < WINDOW:  # twice as many bytes in each step
            longer = value.copy()
            longer[width:] += value[:-width] * np.uint32(factor) if len(value) > width else np.uint32(0)
            value, width, factor = longer, 2 * width, factor * factor & 0xFFFFFFFF
        found.append(np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + begin + 1)
        found[-1] = found[-1][found[-1] > at]
    places = np.concatenate(found) if found else np.zeros(0, np.int64)
    places = places[places < len(data)]
    return places[(data[places] & 0xC0) != 0x80]


def chunk_ends(data: np.ndarray, places: list[int], begin: int, end: int) -> list[int]:
    """Ends of the chunks of the text data[begin:end]; an empty text is one empty chunk."""
    ends, at = [], begin
    while end - at > LEAST:
        k = bisect_left(places, at + LEAST)
        stop = min(places[k] if k < len(places) else end, end, at + MOST)
        if stop == at + MOST < end:
            while data[stop] & 0xC0 == 0x80:
                stop -= 1
        ends.append(stop)
        at = stop
    if at < end or begin == end:
        ends.append(end)
    return ends


# -- packed rows -------------------------------------------------------------

_PACKED = "bucket int, packed binary"


def _codec() -> pa.Codec:
    return pa.Codec("zstd", LEVEL)


class _Packer:
    """Contents held once each, with their occurrences (document, tag, place in the document)."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.contents: list[bytes] = []
        self.docs, self.tags, self.places, self.which = [], [], [], []
        self.held = 0

    def add(self, content: bytes) -> int:
        k = self.index.setdefault(content, len(self.contents))
        if k == len(self.contents):
            self.contents.append(content)
            self.held += len(content)
        self.held += 24
        return k

    def occurrences(self) -> tuple[np.ndarray, ...]:
        return (np.array(self.docs, np.int64), np.array(self.tags, np.uint32), np.array(self.places, np.uint32),
                np.array(self.which, np.uint32))

    def rows(self, bucket_of_occurrence: np.ndarray, columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
        """A row for each bucket."""
        order = np.argsort(bucket_of_occurrence, kind="stable")
        docs, tags, places, which = (c[order] for c in columns)
        bucket = bucket_of_occurrence[order]
        bounds = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else [0]
        names, blobs = [], []
        for a, b in zip(bounds[:-1], bounds[1:]):
            used, local = np.unique(which[a:b], return_inverse=True)
            contents = [self.contents[k] for k in used]
            sizes = np.array([len(c) for c in contents], np.uint32)
            plain = b"".join([np.array([b - a, len(used)], np.uint32).tobytes(), np.diff(docs[a:b], prepend=0).tobytes(),
                              tags[a:b].tobytes(), places[a:b].tobytes(),
                              np.diff(local.astype(np.uint32), prepend=np.uint32(0)).tobytes(), sizes.tobytes(), *contents])
            blobs.append(len(plain).to_bytes(8, "little") + _codec().compress(plain, asbytes=True))
            names.append(bucket[a])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "packed"])
        self.clear()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    plain = _codec().decompress(blob[8:], int.from_bytes(blob[:8], "little"), asbytes=True)
    rows, count = np.frombuffer(plain, np.uint32, 2).tolist()
    at, columns = 8, []
    for kind, size in ((np.int64, rows), (np.uint32, rows), (np.uint32, rows), (np.uint32, rows), (np.uint32, count)):
        columns.append(np.frombuffer(plain, kind, size, at))
        at += columns[-1].nbytes
    docs, tags, places, which, sizes = columns
    ends = (at + np.cumsum(sizes, dtype=np.int64)).tolist()
    return np.cumsum(docs), tags, places, np.cumsum(which, dtype=np.uint32), [plain[a:b] for a, b in zip([at, *ends], ends)]


def _cut(buckets: int):
    """Packed rows of chunks by the bucket of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer()

        def flush():
            of = np.array([zlib.crc32(c) % buckets for c in packer.contents], np.int32)
            columns = packer.occurrences()
            return packer.rows(of[columns[3]] if len(of) else of, columns)

        for batch in batches:
            names = batch.column(0).to_numpy()
            data, offsets = strings(batch.column(1))
            for a, b in row_slices(offsets, SCAN):
                part = data[offsets[a]:offsets[b]]
                raw, bounds, places = part.tobytes(), (offsets[a:b + 1] - offsets[a]).tolist(), cut_places(part).tolist()
                for doc, begin, end in zip(names[a:b].tolist(), bounds[:-1], bounds[1:]):
                    tag, at = zlib.crc32(raw[begin:end]), begin
                    for k, stop in enumerate(chunk_ends(part, places, begin, end)):
                        packer.which.append(packer.add(raw[at:stop]))
                        packer.docs.append(doc)
                        packer.tags.append(tag)
                        packer.places.append(k)
                        at = stop
                    if packer.held >= PACK:
                        yield from flush()
        yield from flush()

    return lean(run)


# -- encoding ----------------------------------------------------------------

@lru_cache(2)
def vocabulary(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all ids, one after the other, and each id's first (one more at the end).

    Raises ValueError unless the file is a byte-level BPE without a normalizer or a prefix space.
    """
    with open(path) as file:
        config = json.load(file)
    splitter = config.get("pre_tokenizer") or {}
    if (splitter.get("type"), splitter.get("use_regex"), splitter.get("add_prefix_space")) != ("ByteLevel", True, False) or config.get(
            "normalizer") or (config.get("post_processor") or {}).get("type") not in (None, "ByteLevel"):
        raise ValueError("a byte-level BPE tokenizer is needed, without normalizer and prefix space")
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in config["added_tokens"]):
        raise ValueError("special tokens that take white space aren't supported")
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}  # byte-level files show other bytes as the characters from 256 on
    letters |= {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*shown}))}
    words = {k: bytes(letters[c] for c in word) for word, k in config["model"]["vocab"].items()}
    words |= {t["id"]: t["content"].encode() for t in config["added_tokens"]}
    table = [words.get(k, b"") for k in range(max(words) + 1)]
    first = np.concatenate([[0], np.cumsum([len(w) for w in table])])
    return np.frombuffer(b"".join(table), np.uint8), first


def bytes_of(ids: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that ids stand for, and each id's first (one more at the end)."""
    table, first = vocabulary(path)
    size = first[ids + 1] - first[ids]
    begin = np.concatenate([[0], np.cumsum(size)])
    return table[np.repeat(first[ids] - begin[:-1], size) + np.arange(begin[-1])], begin


def _encode_texts(texts: list[bytes], path: str) -> list[np.ndarray]:
    """The tokenizer's ids of each text; the words of a worker's texts are looked up once."""
    return [ids for k in range(0, len(texts), 4000) for *_, rows in _encoder(path)(pa.array(texts[k:k + 4000], pa.binary()))
            for ids in rows]


def _id_type(path: str) -> type:
    return np.uint16 if len(vocabulary(path)[1]) <= 1 << 16 else np.uint32


def _encode(path: str, buckets: int):
    """Packed rows of chunks' ids by the bucket of the document; a chunk that is held is not encoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, kind = _Packer(), _id_type(path)
        known: dict[bytes, bytes] = {}
        size = 0

        def flush():
            columns = packer.occurrences()
            return packer.rows((mix(columns[0].view(np.uint64)) % np.uint64(buckets)).astype(np.int32), columns)

        for batch in batches:
            for blob in batch.column(1).to_pylist():
                docs, tags, places, which, contents = _unpack(blob)
                new = [c for c in contents if c not in known]
                if size > REMEMBER:
                    known, size, new = {}, 0, contents
                for text, ids in zip(new, _encode_texts(new, path)):
                    known[text] = ids.astype(kind).tobytes()
                    size += len(text)
                place = np.array([packer.add(known[c]) for c in contents], np.uint32)
                packer.docs.extend(docs.tolist())
                packer.tags.extend(tags.tolist())
                packer.places.extend(places.tolist())
                packer.which.extend(place[which].tolist())
                packer.held += 24 * len(docs)
                if packer.held >= PACK:
                    yield from flush()
        yield from flush()

    return lean(run)


# -- repair ------------------------------------------------------------------

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0D]] = True


def cell_starts(data: np.ndarray) -> np.ndarray:
    """Places where white space follows a character that surely is none; ids on either side don't depend on the other.

    White space beyond ASCII is told by its first bytes, which some other characters share; those count as white space.
    """
    at = np.flatnonzero(_BLANK[data[1:]]) + 1
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    ascii_ = (one > 0x20) & (one < 0x7F)
    double = (one >= 0x80) & (two >= 0xC3) & (at >= 2)
    triple = (one >= 0x80) & (two >= 0x80) & (two < 0xC0) & (at >= 3)
    triple &= ~((three >= 0xE1) & (three <= 0xE3) & np.isin(two, [0x80, 0x81, 0x9A, 0xA0]))
    return at[ascii_ | double | triple]


def _once(values: np.ndarray) -> np.ndarray:
    """Ascending values without repeats."""
    return values[np.concatenate([values[:1] == values[:1], values[1:] != values[:-1]])]


def repair(ids: np.ndarray, joins: np.ndarray, walls: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of texts from the ids of their chunks, one after the other.

    joins: first ids of chunks within a text; walls: first ids of texts, with the end of all.  Returns
    the ids and each text's first (one more at the end).
    """
    joins = joins[(joins > 0) & (joins < len(ids))]
    if not len(joins):
        return ids, walls
    data, begin = bytes_of(ids, path)
    free = cell_starts(data)
    edge = np.searchsorted(begin, free)
    edges = _once(np.sort(np.concatenate([edge[begin[edge] == free], walls]), kind="stable"))  # first ids of cells, and the end
    wall = np.searchsorted(edges, walls)
    cells = np.searchsorted(edges, joins, "right") - 1
    cells = _once(cells[edges[cells] != joins])  # a join that is the start of a cell needs nothing
    if not len(cells):
        return ids, walls
    home = np.searchsorted(wall, cells, "right") - 1
    least, most = wall[home], wall[home + 1]  # cells of the text
    low, high = np.maximum(cells - 1, least), np.minimum(cells + 2, most)
    found: dict[tuple[int, int], np.ndarray] = {}
    encoded: dict[bytes, np.ndarray] = {}
    more = 1
    while True:
        # stretches of a text that meet become one
        first = np.concatenate([[True], (low[1:] >= np.maximum.accumulate(high)[:-1]) | (least[1:] != least[:-1])])
        low, least, most = low[first], least[first], most[first]
        high = np.maximum.reduceat(high, np.flatnonzero(first))
        spans = list(zip(low.tolist(), high.tolist()))
        texts = {s: data[begin[edges[s[0]]]:begin[edges[s[1]]]].tobytes() for s in spans if s not in found}
        new = [*{t for t in texts.values() if t not in encoded}]
        encoded.update(zip(new, _encode_texts(new, path)))
        found.update((s, encoded[t]) for s, t in texts.items())
        wrong = np.zeros(len(spans), bool)
        for k, (a, b) in enumerate(spans):
            got = found[a, b]
            if a > least[k]:
                same = ids[edges[a]:edges[a + 1]]
                wrong[k] |= not np.array_equal(got[:len(same)], same)
            if b < most[k]:
                same = ids[edges[b - 1]:edges[b]]
                wrong[k] |= not np.array_equal(got[len(got) - len(same):], same)
        if not wrong.any():
            break
        low = np.where(wrong, np.maximum(low - more, least), low)
        high = np.where(wrong, np.minimum(high + more, most), high)
        more *= 2
    parts, at, gained = [], 0, np.zeros(len(spans) + 1, np.int64)
    for k, (a, b) in enumerate(spans):
        x, y = int(edges[a]), int(edges[b])
        parts += [ids[at:x], found[a, b]]
        gained[k + 1] = gained[k] + len(found[a, b]) - (y - x)
        at = y
    parts.append(ids[at:])
    return np.concatenate(parts), walls + gained[np.searchsorted(edges[high], walls, "right")]


def _assemble(path: str):
    """The ids of documents from the packed rows of a partition, which are held with their ids, but not the texts."""
    schema = pa.schema([("doc", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def documents(blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        kind = _id_type(path)
        columns, pools, sizes, count = [], [], [], 0
        for blob in blobs:
            docs, tags, places, which, contents = _unpack(blob)
            columns.append((docs, tags, places, which.astype(np.int64) + count))
            pools.append(np.frombuffer(b"".join(contents), kind))
            sizes += [len(c) // pools[-1].itemsize for c in contents]
            count += len(contents)
        docs, tags, places, which = (np.concatenate(c) for c in zip(*columns))
        pool, first = np.concatenate(pools), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        order = np.lexsort((places, tags, docs))
        docs, tags, places, which = docs[order], tags[order], places[order], which[order]
        starts = np.concatenate([[True], (docs[1:] != docs[:-1]) | (tags[1:] != tags[:-1])])
        again = ~starts & np.concatenate([[False], places[1:] == places[:-1]])  # equal rows of the table
        copies = np.diff(np.append(np.flatnonzero(starts), len(docs)))
        docs, which, places, starts = docs[~again], which[~again], places[~again], starts[~again]
        heads = np.append(np.flatnonzero(starts), len(docs))
        copies //= np.diff(heads)
        bounds = np.concatenate([[0], np.cumsum(first[which + 1] - first[which])])
        for a, b in row_slices(bounds[heads], 1 << 20):  # about a million ids at once
            x, y = heads[a], heads[b]
            base, size = bounds[x], np.diff(bounds[x:y + 1])
            place = np.repeat(first[which[x:y]] - bounds[x:y] + base, size) + np.arange(bounds[y] - base)
            inner = bounds[x:y][~starts[x:y]] - base
            ids, walls = repair(pool[place].astype(np.int64), inner, bounds[heads[a:b + 1]] - base, path)
            rows = np.repeat(np.arange(b - a), copies[a:b])
            yield _batch(docs[heads[a:b]][rows], ids, walls, rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [blob for batch in batches for blob in batch.column(1).to_pylist()]
        if held:
            yield from documents(held)

    return lean(run)


def _batch(docs: np.ndarray, ids: np.ndarray, walls: np.ndarray, rows: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    if len(rows) != len(walls) - 1 or (rows != np.arange(len(rows))).any():
        size = np.diff(walls)[rows]
        ends = np.cumsum(size)
        ids = ids[np.repeat(walls[:-1][rows] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        walls = np.concatenate([[0], ends])
    return pa.RecordBatch.from_arrays([pa.array(docs), pa.ListArray.from_arrays(
        pa.array(walls.astype(np.int32)), pa.array(ids.astype(np.int32)))], schema=schema)


def encode_texts(docs: DataFrame, path: str | None = None, doc: str = "doc_id", text: str = "text", ids: str = "ids") -> DataFrame:
    """(doc, ids array<int>) for every row: the ids of the whole text as the tokenizer of ``path`` gives them.

    A null or empty text has no ids.  Strings of special tokens within a text become those tokens.  Equal
    rows give equal rows, different texts under one id a row each.  Rows without an id are left out,
    other columns are ignored.
    """
    return _encoded(docs, path or public_tokenizers.path(TOKENIZER), doc, text, _assemble, "doc long, ids array<int>").toDF(doc, ids)


def _encoded(docs: DataFrame, path: str, doc: str, text: str, last: Callable, schema: str) -> DataFrame:
    """``last`` makes the function of the tasks that put documents together."""
    vocabulary(path)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    chunks = rows.mapInArrow(_cut(partitions), _PACKED).hint("rebalance", "bucket")
    encoded = chunks.mapInArrow(_encode(path, partitions), _PACKED).repartitionById(partitions, "bucket")
    return encoded.mapInArrow(last(path), schema)


def decode_bytes(ids: np.ndarray, path: str) -> bytes:
    """The text of some ids in UTF-8, special tokens included; bytes that are no UTF-8 become U+FFFD."""
    raw = bytes_of(ids, path)[0].tobytes()
    try:
        raw.decode()
        return raw
    except UnicodeDecodeError:
        return raw.decode(errors="replace").encode()


def _lists(column: pa.Array) -> Iterator[np.ndarray | None]:
    values, offsets = column.values.to_numpy(zero_copy_only=False).astype(np.int64), column.offsets.to_numpy()
    for a, b, there in zip(offsets[:-1], offsets[1:], column.is_valid().to_pylist()):
        yield values[a:b] if there else None


def decode_texts(frame: DataFrame, path: str | None = None, ids: str = "ids", text: str = "text") -> DataFrame:
    """All columns of ``frame`` and the text of its ids in ``text``, which is replaced; null ids are a null text."""
    path = path or public_tokenizers.path(TOKENIZER)
    frame = frame.drop(text)
    at = frame.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else decode_bytes(x, path).decode() for x in _lists(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, text])

    return frame.mapInArrow(lean(run), ", ".join([f"`{c}` {kind}" for c, kind in frame.dtypes] + [f"`{text}` string"]))


def _digest(path: str):
    """Checksums of the ids and of the text decoded from them, in the task that has put the ids together."""
    assemble = _assemble(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in assemble(batches):
            rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(),
                     hashlib.sha256(decode_bytes(x, path)).hexdigest()) for x in _lists(batch.column(1))]
            sizes, ids, texts = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def op11_bpe_chunks(spark, folder: str) -> DataFrame:
    """Number and checksum of the ids of all documents, and the checksum of the text decoded from them."""
    return _encoded(spark.read.parquet(f"{folder}/documents.parquet"), public_tokenizers.path(TOKENIZER), "doc_id", "text",
                    _digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
