"""Fill-in-middle examples from whole texts, by piece tables.

A document is a list of descriptors (buffer, start, end) over two buffers that never change: the UTF-8
text of its batch and the sentinels.  Cutting splits descriptors at line ends, arranging permutes the
three sections and puts sentinel descriptors between them, restoring cuts at the sentinels and applies
the inverse permutation.  Texts are not copied on the way; checksums and outputs stream the descriptors.

Every row is handled by itself, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import row_slices, strings

TEXT, MARKS = 0, 1
#: Sections in the order of the output, by form; section 0 is the prefix, 1 the middle, 2 the suffix.
ARRANGEMENTS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}

Piece = tuple[int, int, int]


@dataclass(frozen=True)
class Rule:
    """How texts are cut: the seed of the hashes, the share (in 100) that is cut, and of those the share with the suffix first.

    Sentinels stand before prefix, middle and suffix.
    """

    seed: int = 7
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    middle: str = "<M>"
    suffix: str = "<S>"

    def marks(self) -> tuple[bytes, bytes, bytes]:
        """Sentinels of the sections; none may begin within another, so that each is found where it was put."""
        marks = tuple(m.encode() for m in (self.prefix, self.middle, self.suffix))
        if not all(marks) or len({*marks}) < 3 or any(m[0] in other[1:] for m in marks for other in marks):
            raise ValueError("sentinels have to differ, and none may hold another's first byte")
        return marks


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The descriptors before and after ``at`` bytes of a document."""
    left, right = [], []
    for buffer, start, end in pieces:
        middle = min(max(start, start + at), end)
        if middle > start:
            left.append((buffer, start, middle))
        if end > middle:
            right.append((buffer, middle, end))
        at -= end - start
    return left, right


def arrange(sections: list[list[Piece]], form: str, marks: tuple[bytes, ...]) -> list[Piece]:
    """The document in the order of a form, a sentinel before each section."""
    ends = np.cumsum([0, *map(len, marks)]).tolist()
    return [p for k in ARRANGEMENTS[form] for p in [(MARKS, ends[k], ends[k + 1]), *sections[k]]]


def restore(pieces: list[Piece], form: str, marks: tuple[bytes, ...], raw: bytes) -> list[Piece]:
    """The document that became ``pieces``, one descriptor over ``raw`` that holds an output."""
    if form == "plain":
        return pieces
    (_, at, end), sections = pieces[0], {}
    order = ARRANGEMENTS[form]
    for k, after in zip(order, [*order[1:], None]):
        at += len(marks[k])
        stop = end if after is None else raw.find(marks[after], at, end)
        sections[k] = [(TEXT, at, stop)]
        at = stop
    return [p for k in sorted(sections) for p in sections[k]]


def stream(pieces: list[Piece], buffers: tuple[memoryview, ...]) -> Iterator[memoryview]:
    return (buffers[buffer][start:end] for buffer, start, end in pieces)


def checksum(pieces: list[Piece], buffers: tuple[memoryview, ...]) -> str:
    digest = hashlib.sha256()
    for part in stream(pieces, buffers):
        digest.update(part)
    return digest.hexdigest()


def _numbers(rule: Rule, key: str) -> list[int]:
    digest = hashlib.sha256(f"{rule.seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[k:k + 4], "big") for k in range(0, 16, 4)]


def _transform(rule: Rule, key: int, text: int, keep: int, schema: Callable[[list], pa.RecordBatch]):
    marks = rule.marks()

    def one(raw: bytes, data: np.ndarray, begin: int, end: int, name: str) -> tuple:
        lines = np.flatnonzero(data[begin:end] == 10) + begin + 1
        n = len(lines) + (end > begin and (not len(lines) or int(lines[-1]) < end))
        one, two, three, four = _numbers(rule, name)
        pieces = [(TEXT, begin, end)]
        if begin == end or three % 100 >= rule.rate or any(raw.find(m, begin, end) >= 0 for m in marks):
            return n, "plain", None, None, pieces
        at = [end if k > len(lines) else int(lines[k - 1]) if k else begin for k in sorted((one % (n + 1), two % (n + 1)))]
        head, rest = cut(pieces, at[0] - begin)
        middle, tail = cut(rest, at[1] - at[0])
        form = "spm" if four % 100 < rule.suffix_first else "psm"
        sizes = [int(np.count_nonzero((data[a:b] & 0xC0) != 0x80)) for a, b in ((begin, at[0]), at)]
        return n, form, *sizes, arrange([head, middle, tail], form, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(text))
            names = batch.column(key).to_pylist()
            for a, b in row_slices(offsets):
                part = data[offsets[a]:offsets[b]]
                raw, bounds = part.tobytes(), (offsets[a:b + 1] - offsets[a]).tolist()
                buffers = memoryview(raw), memoryview(b"".join(marks))
                rows = [one(raw, part, x, y, name or "") for x, y, name in zip(bounds[:-1], bounds[1:], names[a:b])]
                outputs = [b"".join(stream(r[4], buffers)) for r in rows]
                yield schema([*(c.slice(a, b - a) for c in batch.columns[:keep]), pa.array([r[0] for r in rows], pa.int64()),
                              pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64()),
                              pa.array([r[3] for r in rows], pa.int64()), pa.array(outputs, pa.binary()).cast(pa.string())])

    return run


NAMES = ("n", "form", "prefix_chars", "middle_chars", "output")


def fill_in_middle(docs: DataFrame, rule: Rule = Rule(), doc: str = "doc_id", text: str = "text",
                   names: tuple[str, ...] = NAMES) -> DataFrame:
    """All columns of ``docs`` and, under ``names``, the number of lines, the form, the characters of prefix and middle, and the output.

    Where a text is cut depends on its id and its lines alone, so equal rows give equal outputs.  A null or empty text, or one
    that holds a sentinel, is plain: its output is the text and the sizes are null.  A missing id counts as empty.
    Columns of the new names are replaced.
    """
    for name in (doc, text):
        if name in names:
            raise ValueError(f"{name} is read and can't be replaced")
    docs = docs.drop(*names)
    keep, at = len(docs.columns), docs.columns.index(text)
    fields = [*docs.columns, *names]
    keyed = docs.select("*", F.col(doc).cast("string").alias("".join(fields) + "_"))
    schema = ", ".join([f"`{c}` {kind}" for c, kind in docs.dtypes] + [
        f"`{c}` {kind}" for c, kind in zip(names, ("long", "string", "long", "long", "string"))])
    return keyed.mapInArrow(_transform(rule, keep, at, keep, lambda columns: pa.RecordBatch.from_arrays(columns, fields)), schema)


def _restored(rule: Rule, output: int, form: int) -> Callable:
    """Buffer and descriptors of each row's text, from its output and form alone."""
    marks = rule.marks()

    def rows(batch: pa.RecordBatch) -> Iterator[tuple[tuple[memoryview, ...], Piece, list[Piece]]]:
        data, offsets = strings(batch.column(output))
        forms = batch.column(form).to_pylist()
        for a, b in row_slices(offsets):
            raw, bounds = data[offsets[a]:offsets[b]].tobytes(), (offsets[a:b + 1] - offsets[a]).tolist()
            buffers = memoryview(raw), memoryview(b"".join(marks))
            for x, y, kind in zip(bounds[:-1], bounds[1:], forms[a:b]):
                whole = [(TEXT, x, y)]
                yield buffers, whole, restore(whole, kind or "plain", marks, raw)

    return rows


def restore_texts(frame: DataFrame, rule: Rule = Rule(), output: str = "output", form: str = "form", text: str = "text") -> DataFrame:
    """All columns of ``frame`` and the text rebuilt from output and form in ``text``, which is replaced; a null output is empty."""
    frame = frame.drop(text)
    names = frame.columns
    rows = _restored(rule, names.index(output), names.index(form))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"".join(stream(pieces, buffers)) for buffers, _, pieces in rows(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).cast(pa.string())], [*names, text])

    return frame.mapInArrow(run, ", ".join([f"`{c}` {kind}" for c, kind in frame.dtypes] + [f"`{text}` string"]))


def op12_fill_in_middle(spark, folder: str) -> DataFrame:
    """Forms, sizes and checksums of the outputs of all documents, and checksums of the texts rebuilt from them."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    found = fill_in_middle(docs).select("doc_id", *NAMES)
    rows = _restored(Rule(), 5, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [(checksum(whole, buffers), checksum(pieces, buffers)) for buffers, whole, pieces in rows(batch)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *(pa.array([s[k] for s in sums], pa.string()) for k in (0, 1))],
                ["doc_id", *NAMES[:4], "output_sha256", "restored_sha256"])

    return found.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
                                 "output_sha256 string, restored_sha256 string")


def oracle() -> str:
    """The same in DuckDB."""
    number = ", ".join(f"('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || doc_id) AS h FROM documents),
      u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units, {number} FROM d),
      c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a,
          greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b FROM u),
      s AS (SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix, coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
          coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix,
          CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
               WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
      SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars,
        CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
               ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(CASE form WHEN 'plain' THEN t ELSE prefix || middle || suffix END) AS restored_sha256 FROM s"""
