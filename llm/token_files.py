"""Token ids in files, compressed block by block with a context-mixing range coder.

A file holds documents in ascending id order: magic and counts, a table of documents (id, number of
ids), a table of blocks (ids, words, CRC-32 of the ids and the payload), the CRC-32 of all that, and the blocks'
payloads.  A block is ``BLOCK`` ids with a model and a coder of its own, so it can be read alone.

Model.  Orders 1 and 2 each predict an id: a slot named by the ids before holds the id seen most of
late and how sure it is.  The prediction of the highest order that is sure is the candidate.  Each
order gives its probability by its sureness and whether the other agrees, order 0 by how often
candidates are right at all; these are learned in the block and mixed by weights that follow the
better ones.  The candidate has the part of the range that the mix gives it; the rest is shared out to
magnitude classes by adaptive order-0 counts, and evenly within a class.  All arithmetic is on integers,
so every machine decodes the same.

Blocks are coded side by side: one step handles the next id of every block at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import fresh_folder, lean, ranges_hash, row_slices, saved, strings, _BYTE

TOKENIZER = "byte_bpe_50k.json"
END = 0
BLOCK = 2048
#: Blocks coded side by side, and ids in a file, at most.
LANES, FILE_IDS = 4096, 8_000_000
#: Distinct pieces of text whose ids a worker remembers, some 40 bytes each.
PIECES = 1_500_000
RECENT = 1 << 20

MAGIC = b"TOKMIX02"
#: Places for magnitude classes (31 are used), and what an id adds to the count of its own.
CLASSES, STEP = 32, 48
SLOTS, SLOT_SHIFT = 512, np.uint32(23)
#: A range below FLOOR gives away its top 16 bits.
FLOOR, U12, U16, U48, U56 = (np.uint64(k) for k in (1 << 48, 12, 16, 48, 56))
#: A product with it has the sum of a number's bytes on top.
EACH = np.uint64(0x0101010101010101)
ONE, TWO, THREE, FOUR = (np.uint32(k) for k in (1, 2, 3, 4))


def _class_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each id below 2**16, and first id and bits of each class."""
    x = np.arange(1 << 16) + 2
    power = np.frexp(x.astype(float))[1] - 1
    classes = (power - 1) * 2 + ((x >> (power - 1)) & 1)
    bits = np.arange(CLASSES) // 2
    return classes.astype(np.int64), (((2 + np.arange(CLASSES) % 2) << bits) - 2).astype(np.uint64), bits.astype(np.uint64)


CLASS_OF, CLASS_BASE, CLASS_BITS = _class_tables()
MOST_ID = len(CLASS_OF) - 1
#: What a class adds to the counts below each class.
RAISES = (np.arange(CLASSES) > np.arange(CLASSES)[:, None]).astype(np.uint16) * np.uint16(STEP)


def _turned(rows: np.ndarray) -> np.ndarray:
    """The transpose, some columns at a time; rows are a little apart, else all of them would share few places of the cache."""
    wide = np.empty((len(rows), rows.shape[1] + 24), rows.dtype)[:, :rows.shape[1]]
    wide[:] = rows
    out = np.empty((rows.shape[1], len(rows) + 24), rows.dtype)[:, :len(rows)]
    for k in range(0, rows.shape[1], 32):
        out[k:k + 32] = wide[:, k:k + 32].T
    return out


class _Model:
    """The models of several blocks, one step at a time.

    A slot holds an id times four and how sure it is, from 0 to 3.
    """

    def __init__(self, lanes: int) -> None:
        lane = np.arange(lanes)
        self.slot1, self.slot2 = np.zeros((2, lanes * SLOTS), np.uint32)
        self.base, self.eight, self.wide = lane * SLOTS, lane * 8, lane * CLASSES
        # by sureness, then the same where the other order agrees
        self.trust1 = np.tile(np.array([2000, 5000, 9000, 14000, 4000, 16000, 26000, 36000], np.int32), lanes)
        self.trust2 = np.tile(np.array([2000, 9000, 20000, 30000, 4000, 20000, 32000, 45000], np.int32), lanes)
        self.trust0 = np.full(lanes, 6000, np.int32)
        self.weight1, self.weight2 = np.full(lanes, 5000, np.int32), np.full(lanes, 8000, np.int32)
        self.counts = np.tile(np.arange(CLASSES, dtype=np.uint16), (lanes, 1))
        self.flat = self.counts.reshape(-1)
        self.total, self.turn = CLASSES - 1, 0
        self.before = self.two = np.zeros(lanes, np.uint32)

    def predict(self) -> np.ndarray:
        """Sets the candidates; returns their probabilities in 1 / 4096."""
        self.at1 = self.base + ((self.before * np.uint32(0x9E3779B1)) >> SLOT_SHIFT)
        self.at2 = self.base + (((self.before + self.two * np.uint32(0x2545F491)) * np.uint32(0x85EBCA6B)) >> SLOT_SHIFT)
        self.found1, self.found2 = self.slot1.take(self.at1), self.slot2.take(self.at2)
        self.sure1, self.sure2 = self.found1 & THREE, self.found2 & THREE
        self.id1, self.id2 = self.found1 >> TWO, self.found2 >> TWO
        self.some2 = self.sure2 > 0
        self.candidate = np.where(self.some2, self.id2, self.id1)
        agree = (self.id1 == self.id2) * FOUR
        self.state1, self.state2 = self.eight + (self.sure1 + agree), self.eight + (self.sure2 + agree)
        self.chance1, self.chance2 = self.trust1.take(self.state1), self.trust2.take(self.state2)
        self.off1, self.off2 = self.chance1 - self.trust0, self.chance2 - self.trust0
        self.mixed = self.trust0 + ((self.off1 * self.weight1 + self.off2 * self.weight2) >> 14)
        return np.minimum(np.maximum(self.mixed >> 4, 24), 4072).astype(np.uint64)

    def update(self, ids: np.ndarray, hit: np.ndarray, classes: np.ndarray) -> None:
        """Learn the ids that came; counts, and trust and weights, take their turns, which costs little size and saves time."""
        goal, self.turn = hit * np.int32(65535), self.turn + 1
        if self.turn & 1:
            self.counts += RAISES.take(classes, 0)
            self.total += STEP
        else:
            self.trust1[self.state1] = self.chance1 + ((goal - self.chance1) >> 4)
            self.trust2[self.state2] = self.chance2 + ((goal - self.chance2) >> 4)
            # a weight grows when its order was nearer to what came than the mix
            if self.turn & 2:
                error = (goal - self.mixed) >> 8
                self.weight1 = np.minimum(np.maximum(self.weight1 + ((error * (self.off1 >> 8)) >> 7), 500), 14000)
                self.weight2 = np.minimum(np.maximum(self.weight2 + ((error * (self.off2 >> 8)) >> 7), 500), 14000)
        self.trust0 += (goal - self.trust0) >> 6
        fresh = (ids << TWO) | ONE
        self.slot1[self.at1] = np.where(self.id1 == ids, self.found1 + (self.sure1 < THREE),
                                        np.where(self.sure1 > 0, self.found1 - ONE, fresh))
        self.slot2[self.at2] = np.where(self.id2 == ids, self.found2 + (self.sure2 < THREE),
                                        np.where(self.some2, self.found2 - ONE, fresh))
        self.two, self.before = self.before, ids


def encode_blocks(ids: np.ndarray) -> list[np.ndarray]:
    """Payloads of blocks, from rows of ids of one length."""
    lanes, length = ids.shape
    if int(ids.max(initial=0)) > MOST_ID:
        raise ValueError(f"ids above {MOST_ID} can't be coded")
    ids = _turned(ids.astype(np.uint32, copy=False))
    model, every = _Model(lanes), np.arange(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out, used = np.zeros((2 * length + 8, lanes), np.uint16), np.zeros(lanes, np.int64)

    for step in range(length):
        now = ids[step]
        # the candidate has the lower part of the range, the classes share the rest
        right = (width >> U12) * model.predict()
        hit = now == model.candidate
        classes = CLASS_OF.take(now)
        place = model.wide + classes
        begin = model.flat.take(place)
        share = model.flat.take(place + 1) - begin
        unit = (width - right) // np.uint64(model.total)
        inner = unit * share >> CLASS_BITS.take(classes)
        moved = low + np.where(hit, np.uint64(0), right + unit * begin + inner * (now - CLASS_BASE.take(classes)))
        over = np.flatnonzero(moved < low)
        at = used[over] - 1
        while len(over):  # a carry
            out[at, over] += np.uint16(1)
            more = out[at, over] == 0
            over, at = over[more], at[more] - 1
        low, width = moved, np.where(hit, right, inner)
        small = np.flatnonzero(width < FLOOR)
        while len(small):
            out[used[small], small] = low[small] >> U48
            used[small] += 1
            low[small] <<= U16
            width[small] <<= U16
            small = small[width[small] < FLOOR]
        model.update(now, hit, classes)
    for _ in range(4):
        out[used, every] = low >> U48
        used += 1
        low <<= U16
    return [row[:n].copy() for row, n in zip(_turned(out[:used.max(initial=0)]), used)]


def decode_blocks(payloads: list[np.ndarray], length: int) -> np.ndarray:
    """Rows of ``length`` ids each."""
    lanes = len(payloads)
    words = np.zeros((lanes, max(map(len, payloads)) + 5), np.uint16)
    for row, payload in zip(words, payloads):
        row[:len(payload)] = payload
    words, model = _turned(words), _Model(lanes)
    every, at, code = np.arange(lanes), np.full(lanes, 4), np.zeros(lanes, np.uint64)
    for k in range(4):
        code = (code << U16) | words[k]
    width = np.full(lanes, 2**64 - 1, np.uint64)
    out = np.zeros((length, lanes), np.uint32)

    for step in range(length):
        right = (width >> U12) * model.predict()
        hit = code < right
        left = code - right
        unit = (width - right) // np.uint64(model.total)
        value = np.minimum(left // unit, np.uint64(model.total - 1)).astype(np.uint16)
        below = (model.counts <= value[:, None]).view(np.uint64)  # eight classes in each of four numbers
        below = below[:, 0] + below[:, 1] + below[:, 2] + below[:, 3]
        classes = (below * EACH >> U56).astype(np.int64) - 1
        place = model.wide + classes
        begin = model.flat.take(place)
        share = model.flat.take(place + 1) - begin
        bits = CLASS_BITS.take(classes)
        inner = unit * share >> bits
        left -= unit * begin
        rest = np.minimum(left // inner, (np.uint64(1) << bits) - np.uint64(1))
        now = np.where(hit, model.candidate, (CLASS_BASE.take(classes) + rest).astype(np.uint32))
        code = np.where(hit, code, left - inner * rest)
        width = np.where(hit, right, inner)
        small = np.flatnonzero(width < FLOOR)
        while len(small):
            code[small] = (code[small] << U16) | words[at[small], small]
            at[small] += 1
            width[small] <<= U16
            small = small[width[small] < FLOOR]
        out[step] = now
        model.update(now, hit, CLASS_OF.take(now))
    return _turned(out)


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pack(docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """The content of a file of documents with so many ids each."""
    blocks = [ids[k:k + BLOCK] for k in range(0, len(ids), BLOCK)]
    payloads = []
    for k in range(0, len(blocks), LANES):
        group = blocks[k:k + LANES]
        rows = np.zeros((len(group), len(group[0])), np.uint32)
        for row, block in zip(rows, group):
            row[:len(block)] = block
        payloads += encode_blocks(rows)
    head = MAGIC + struct.pack("<IQQ", BLOCK, len(docs), len(blocks))
    head += docs.astype("<i8").tobytes() + sizes.astype("<u8").tobytes()
    payloads = [p.astype("<u2").tobytes() for p in payloads]
    checks = [zlib.crc32(p, _crc(b)) for b, p in zip(blocks, payloads)]
    head += np.array([(len(b), len(p) // 2, c) for b, p, c in zip(blocks, payloads, checks)], "<u4").reshape(-1, 3).tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(payloads)


def unpack(content: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, sizes and ids of a file; all checksums are verified."""
    if content[:8] != MAGIC:
        raise ValueError("not a token file")
    block, documents, blocks = struct.unpack_from("<IQQ", content, 8)
    at = 28
    docs = np.frombuffer(content, "<i8", documents, at)
    sizes = np.frombuffer(content, "<u8", documents, at + 8 * documents).astype(np.int64)
    at += 16 * documents
    table = np.frombuffer(content, "<u4", 3 * blocks, at).reshape(-1, 3)
    at += 12 * blocks
    if struct.unpack_from("<I", content, at)[0] != zlib.crc32(content[:at]):
        raise ValueError("the tables of a token file are damaged")
    at += 4
    payloads = []
    for _, words, _ in table.tolist():
        payloads.append(np.frombuffer(content, "<u2", words, at))
        at += 2 * words
    out = []
    for k in range(0, blocks, LANES):
        rows = decode_blocks(payloads[k:k + LANES], int(table[k, 0]))
        for row, payload, (size, _, crc) in zip(rows, payloads[k:k + LANES], table[k:k + LANES].tolist()):
            out.append(row[:size])
            if zlib.crc32(payload.tobytes(), _crc(out[-1])) != crc:
                raise ValueError("a block of a token file is damaged")
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    if len(ids) != sizes.sum():
        raise ValueError("a token file has other ids than its table says")
    return docs, sizes, ids


# -- text to ids -------------------------------------------------------------

def _byte_classes() -> tuple[np.ndarray, np.ndarray]:
    """Classes of characters below U+0250: 0 space, 1 other white space, 2 letter, 3 number, 4 other."""
    import unicodedata

    classes = np.full(0x250, 4, np.uint8)
    for c in range(0x250):
        kind = unicodedata.category(chr(c))[0]
        classes[c] = 2 if kind == "L" else 3 if kind == "N" else 4
    # White space below U+0250.
    classes[[9, 10, 11, 12, 13, 0x85, 0xA0]] = 1
    classes[0x20] = 0
    return classes[:128], classes


_ASCII, _LATIN = _byte_classes()
#: All but ASCII, continuation bytes and leads of two-byte characters below U+0240; an apostrophe may start
#: a contraction, "<" a special token.
_HARD = np.ones(256, bool)
_HARD[:0xC9] = False
_HARD[[0x27, 0x3C]] = True


@lru_cache(1)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts.

    The tokenizer splits text into pieces (words with the space before them, numbers, signs, white space)
    and encodes each piece by itself, so the ids of a piece are asked for once and remembered.
    Rows with characters whose splitting takes more than classes go to the tokenizer whole.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = _tokenizer(path)
        vocabulary = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocabulary.values()) + 1, np.int64)  # bytes of each id
        for token, k in vocabulary.items():
            self.width[k] = len(token)
        self.forget()

    def forget(self) -> None:
        #: Hashes of the known pieces, ascending, and the place of each in starts and sizes.
        self.known, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        # the piece last seen at each place, which answers most lookups at once
        self.recent, self.recent_place = np.zeros(RECENT, np.uint64), np.zeros(RECENT, np.int32)
        self.starts, self.sizes = np.zeros(1024, np.int64), np.zeros(1024, np.int32)
        self.pool, self.filled = np.zeros(4096, np.uint32), 0

    def _ids(self, texts: list[str]) -> np.ndarray:
        encoded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(encoded), np.uint32, sum(map(len, encoded)))

    def _learn(self, at: np.ndarray, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        """Pieces with hashes that belong before the places ``at`` of the known ones.

        Pieces that begin with a space and end in what surely is none can stand one after the other in a text,
        which costs less than a text for each.
        """
        raw, last = data.tobytes(), data[ends - 1]
        joined = (data[starts] == 0x20) & (ends - starts > 1) & (
            (last > 0x20) & (last < 0x7F) | (last >= 0x80) & (data[ends - 2] >= 0xC3))
        order = np.argsort(~joined, kind="stable")
        words = [raw[x:y].decode() for x, y in zip(starts[order].tolist(), ends[order].tolist())]
        many = int(joined.sum())
        flat = self._ids(["".join(words[k:min(k + 64, many)]) for k in range(0, many, 64)] + words[many:])
        cuts = np.searchsorted(np.cumsum(self.width[flat]), np.cumsum((ends - starts)[order])) + 1
        sizes = np.diff(cuts, prepend=0)
        first, need = len(self.known), self.filled + len(flat)
        while need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while first + len(hashes) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.sizes = np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.pool[self.filled:need] = flat
        self.starts[first + order], self.sizes[first + order] = self.filled + cuts - sizes, sizes
        self.filled = need
        self.known = np.insert(self.known, at, hashes)
        self.place = np.insert(self.place, at, np.arange(first, first + len(hashes)))

    def _pieces(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the pieces of some rows."""
        lead = (data >= 0xC2) & (data < 0xCA)
        classes = _ASCII[data & 127]
        at = np.flatnonzero(lead)
        if len(at):
            value = ((data[at].astype(np.int64) & 31) << 6) | (data[at + 1] & 63)
            classes[at] = classes[at + 1] = _LATIN[value]
        follow = (data & 0xC0) == 0x80
        row_start = np.zeros(len(data) + 1, bool)
        row_start[offsets] = True
        blank = classes < 2
        # by characters: the class before (of the character before) and whether a non-blank follows
        before = np.concatenate([[4], classes[:-1]]).astype(np.uint8)
        start = np.where(blank, before >= 2, (before == 1) | ((before >= 2) & (before != classes)))
        width = 1 + lead
        after = np.minimum(np.arange(len(data)) + width, len(data))
        followed = ~row_start[after] & ~np.concatenate([blank, [True]])[after]
        start |= blank & followed
        start |= row_start[:-1]
        return np.flatnonzero(start & ~follow)

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, sizes, ids) of consecutive rows, without end ids."""
        data, offsets = strings(column)
        for a, b in row_slices(offsets):
            part, bounds = data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
            hard = np.zeros(b - a, bool)
            if len(part):
                hard[np.searchsorted(bounds, np.flatnonzero(_HARD[part]), "right") - 1] = True
            ids, sizes = [np.zeros(0, np.uint32)] * (b - a), np.zeros(b - a, np.int64)
            if hard.any():
                rows = np.flatnonzero(hard)
                texts = [part[bounds[r]:bounds[r + 1]].tobytes().decode() for r in rows]
                for r, e in zip(rows, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
                    ids[r] = np.array(e.ids, np.uint32)
            easy = np.flatnonzero(~hard & (np.diff(bounds) > 0))
            if len(easy):
                if hard.any():
                    part = np.concatenate([part[bounds[r]:bounds[r + 1]] for r in easy])
                bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[easy])])
                found, ends = self._encode(part, bounds)
                for r, x, y in zip(easy, ends[:-1], ends[1:]):
                    ids[r] = found[x:y]
            sizes = np.array([len(i) for i in ids])
            yield a, b, sizes, ids

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > PIECES:
            self.forget()
        found = []
        for a, b in row_slices(offsets, 1 << 18):  # few enough for the cache
            part = data[offsets[a]:offsets[b]]
            starts = self._pieces(part, offsets[a:b + 1] - offsets[a])
            found.append((starts + offsets[a], ranges_hash(_BYTE[part], starts, np.append(starts[1:], len(part)), "byte")))
        starts, hashes = (np.concatenate(x) for x in zip(*found))
        ends = np.append(starts[1:], len(data))
        at = (hashes % np.uint64(RECENT)).astype(np.int64)
        place = self.recent_place.take(at)
        missed = np.flatnonzero(self.recent.take(at) != hashes)
        if len(missed):
            found, index, inverse = np.unique(hashes[missed], return_index=True, return_inverse=True)
            where = np.searchsorted(self.known, found)
            new = np.flatnonzero(np.append(self.known, np.uint64(0))[where] != found)
            if len(new):
                words = missed[index[new]]
                self._learn(where[new], found[new], data, starts[words], ends[words])
                where = np.searchsorted(self.known, found)
            place[missed] = self.place[where][inverse]
            self.recent[at[missed]], self.recent_place[at[missed]] = hashes[missed], place[missed]
        sizes = self.sizes[place]
        total = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[place] - total[:-1], sizes) + np.arange(total[-1])
        return self.pool[at], total[np.searchsorted(starts, offsets)]


_WORKER: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    """The encoder of this worker; workers serve many tasks and keep what they learned."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


_MANIFEST = "part long, number long, file string, documents long, ids long"


def _write(folder: str, path: str) -> Callable:
    schema = pa.schema([("part", pa.int64()), ("number", pa.int64()), ("file", pa.string()), ("documents", pa.int64()),
                        ("ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, where = pafs.FileSystem.from_uri(folder)
        encoder, part = _encoder(path), TaskContext.get().partitionId()
        done, docs, ids, held = [], [], [], 0

        def close():
            name = f"{where}/tokens-{part:05d}-{len(done):05d}-{uuid.uuid4().hex}.bin"
            sizes = np.array([len(i) + 1 for i in ids], np.int64)
            flat = np.full(int(sizes.sum()), END, np.uint32)
            keep = np.ones(len(flat), bool)
            keep[np.cumsum(sizes) - 1] = False
            flat[keep] = np.concatenate(ids)
            with store.open_output_stream(name, compression=None) as out:
                out.write(pack(np.array(docs, np.int64), sizes, flat))
            done.append((part, len(done), name, len(docs), len(flat)))

        for batch in batches:
            names = batch.column(0).to_numpy()
            for a, b, sizes, rows in encoder(batch.column(1)):
                docs.extend(names[a:b].tolist())
                ids.extend(rows)
                held += int(sizes.sum())
                if held >= FILE_IDS:
                    close()
                    docs, ids, held = [], [], 0
        if docs:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done) if done else [[]] * 5, schema)],
                                         schema=schema)

    return run


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of all texts in ascending document order; returns the manifest with each file's first position.

    Every document ends with id 0; a null or empty text is that id alone.  Rows without an id are left
    out.  Rows with the same id follow each other.
    """
    spark = docs.sparkSession
    path = path or public_tokenizers.path(TOKENIZER)
    rows = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    store, where = pafs.FileSystem.from_uri(folder)
    store.create_dir(where, recursive=True)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    manifest = saved(rows.repartitionByRange(parts, "doc").sortWithinPartitions("doc").mapInArrow(
        _write(folder, path), _MANIFEST), "tokens-manifest")
    # One row for each file.
    order = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    schema = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_stream(name, compression=None) as source:
                    docs, sizes, ids = unpack(source.read())
                ends = np.cumsum(sizes)
                crc = [_crc(ids[y - n:y]) for y, n in zip(ends.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start + ends - sizes), pa.array(sizes),
                                                  pa.array(crc, pa.int64())], schema=schema)

    files = manifest.count()
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(max(1, min(files, 8 * parts))).mapInArrow(
        lean(run), "doc long, start long, n_tokens long, ids_crc32 long")


def token_digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    folder = fresh_folder(spark, "tokens")
    found = read_tokens(write_tokens(docs, folder), folder)
    return found.select(F.col("doc").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op10_token_files(spark, folder: str) -> DataFrame:
    """Ids of all documents, written to files and read back."""
    return token_digest(spark, spark.read.parquet(f"{folder}/documents.parquet"))
