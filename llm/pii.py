"""Personal data and the words that give it away.

Base spans are found by pattern: e-mail addresses, IP addresses, payment cards and phone numbers.
Each distinct value is a protected entity.  The corpus then tells which words disclose an entity:
with p(t) the share of documents that hold word t and p(t|e) its share of the distinct documents that
hold entity e, the pointwise mutual information log(p(t|e) / p(t)) is compared with the entity's own
information log(N / n(e)), which is the most that any word can give.  A word with a ratio of at least
``remove`` for some entity is removed wherever it stands in any document, from ``generalise`` on it is
generalised.  Documents of equal words count once, and words seen in fewer than ``support`` documents of
an entity tell nothing.

Offsets are code points, ends exclusive.  A null text is empty.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import as_signed, row_slices, saved, strings, words

KINDS = ("email", "ip", "card", "phone")
#: Distinct documents of an entity that a word must be seen in, and shares of the entity's information.
SUPPORT, GENERALISE, REMOVE = 3, 0.7, 0.9

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The digits before the first dot are found by going back, which stays linear in long runs of digits.
_IP = re.compile(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){12,}")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = frozenset("0123456789")

#: Letters in lower case and bytes beyond ASCII make words; all else separates.
_LETTERS = np.full(256, 32, np.uint8)
for _low, _high in ((65, 91), (97, 123), (128, 256)):
    _LETTERS[_low:_high] = np.arange(_low, _high)
_LETTERS[65:91] += 32
LEAST_BYTES = 3


def _back(text: str, at: int, floor: int, allowed: frozenset) -> int:
    while at > floor and text[at - 1] in allowed:
        at -= 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, floor = [], 0
    for m in _DOMAIN.finditer(text):
        start = _back(text, m.start(), floor, _LOCAL)
        if start < m.start():
            found.append((start, m.end()))
            floor = m.end()
    return found


def ips(text: str) -> list[tuple[int, int]]:
    spans = [(_back(text, m.start(), 0, _DIGIT), m.end()) for m in _IP.finditer(text)]
    return [(a, b) for a, b in spans if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in text[a:b].split("."))]


def cards(text: str) -> list[tuple[int, int]]:
    found = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if len(digits) <= 19 and luhn(digits):
            found.append(m.span())
    return found


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in _DIGIT for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start; per kind leftmost and without overlap."""
    found = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        found += [("ip", *s) for s in ips(text)]
    found += [("card", *s) for s in cards(text)]
    if "+" in text:
        found += [("phone", *s) for s in phones(text)]
    return found


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _terms(text: str, spans: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a text that touch no base span."""
    data = np.frombuffer(text.encode(), np.uint8)
    start, end, hashes, _ = words(_LETTERS[data], np.array([0, len(data)]))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep = end - start >= LEAST_BYTES
    # a code point ends with its last byte
    hashes, start, end = hashes[keep], points[start[keep]], points[end[keep]]
    covered = np.zeros(len(text) + 1, np.int64)
    for _, x, y in spans:
        covered[x + 1:y + 1] = 1
    covered = np.cumsum(covered)
    free = covered[start] == covered[end]
    return hashes[free], start[free], end[free]


_SCAN = pa.schema([("kind", pa.string()), ("entity", pa.int64()), ("term", pa.int64()), ("context", pa.int64()),
                   ("count", pa.int64()), ("terms", pa.list_(pa.int64()))])
_SCAN_TYPE = "kind string, entity long, term long, context long, count long, terms array<long>"
_FOUND = pa.schema([("doc", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base", pa.string()),
                    ("base_sha256", pa.string()), ("spans", pa.string())])
_FOUND_TYPE = "doc long, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, spans string"


def _rows(columns: dict[str, list | pa.Array]) -> pa.RecordBatch:
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in _SCAN], schema=_SCAN)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counted, held = [], 0

    def counts():
        terms = np.concatenate([c[0] for c in counted]) if counted else np.zeros(0, np.uint64)
        if not len(terms):
            return []
        number = np.concatenate([c[1] for c in counted])
        order = np.argsort(terms)
        terms, number = terms[order], number[order]
        begin = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
        return [(terms[begin], np.add.reduceat(number, begin))]

    def told(found):
        for terms, number in found:
            for k in range(0, len(terms), 50_000):
                part = terms[k:k + 50_000]
                yield _rows({"kind": ["count"] * len(part), "term": as_signed(part), "count": number[k:k + 50_000]})

    for batch in batches:
        data, offsets = strings(batch.column(1))
        for a, b in row_slices(offsets):
            yield _rows({"kind": ["rows"], "count": [b - a]})
            holds, texts = {"entity": [], "context": []}, {"context": [], "terms": []}
            for text in batch.column(1).slice(a, b - a).to_pylist():
                spans = base_spans(text or "")
                if not spans:
                    continue
                terms = _terms(text, spans)[0]
                context = int.from_bytes(hashlib.blake2b(terms.tobytes(), digest_size=8).digest(), "little", signed=True)
                texts["context"].append(context)
                texts["terms"].append(np.unique(terms).view(np.int64))
                entities = {_hash(f"{kind}:" + (text[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", text[s:e])))
                            for kind, s, e in spans}
                holds["entity"] += entities
                holds["context"] += [context] * len(entities)
            if texts["context"]:
                yield _rows({"kind": ["holds"] * len(holds["entity"]), **holds})
                yield _rows({"kind": ["text"] * len(texts["context"]), **texts})
            part = _LETTERS[data[offsets[a]:offsets[b]]]
            start, end, hashes, first = words(part, offsets[a:b + 1] - offsets[a])
            # a word counts once in a document
            row = np.repeat(np.arange(b - a), np.diff(first))
            keep = end - start >= LEAST_BYTES
            terms, inverse = np.unique(hashes[keep], return_inverse=True)
            pairs = np.unique(inverse.astype(np.int64) * (b - a) + row[keep])
            counted.append((terms, np.bincount(pairs // (b - a), minlength=len(terms))))
            held += len(terms)
            if held > 1_500_000:
                found = counts()
                if len(found[0][0]) > 700_000:
                    yield from told(found)
                    found = []
                counted, held = found, sum(len(f[0]) for f in found)
    yield from told(counts())


def _find(terms: np.ndarray, removed: np.ndarray):
    """Rows of results; ``terms`` are hashes of the disclosing words in order, ``removed`` tells which are removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            for a, b in row_slices(offsets):
                _, _, hashes, first = words(_LETTERS[data[offsets[a]:offsets[b]]], offsets[a:b + 1] - offsets[a])
                hits = np.concatenate([[0], np.cumsum(_places(terms, hashes) >= 0)])
                touched = hits[first[1:]] > hits[first[:-1]]
                out = {f.name: [] for f in _FOUND}
                rows = zip(batch.column(0).slice(a, b - a).to_pylist(), batch.column(1).slice(a, b - a).to_pylist(), touched)
                for doc, text, some in rows:
                    text = text or ""
                    spans = base_spans(text)
                    base = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                    kinds, added = [k for k, _, _ in spans], []
                    if some:
                        found, start, end = _terms(text, spans)
                        at = _places(terms, found)
                        added = sorted(("term_remove" if removed[k] else "term_generalise", x, y) for k, x, y in
                                       zip(at[at >= 0].tolist(), start[at >= 0].tolist(), end[at >= 0].tolist()))
                    told = ",".join(f"{k}:{x}:{y}" for k, x, y in added)
                    for column, value in zip(out.values(), (
                            doc, *(kinds.count(k) for k in KINDS), base, hashlib.sha256(base.encode()).hexdigest(),
                            ",".join(x for x in (base, told) if x))):
                        column.append(value)
                yield pa.RecordBatch.from_pydict(out, schema=_FOUND)

    return run


def _places(terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The place of each hash in ascending ``terms``, or -1."""
    if not len(terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    return np.where(terms[at] == hashes, at, -1)


def find_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", support: int = SUPPORT,
               generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """(doc, n_email, n_ip, n_card, n_phone, base, base_sha256, spans) of each document.

    base and spans list kind:start:end, joined by commas, by kind and start; spans has the base spans
    first and then all occurrences of disclosing words, of kinds term_generalise and term_remove, also in
    documents without the entity.  Equal rows give equal results; other columns are ignored.
    """
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    scanned = saved(docs.mapInArrow(_scan, _SCAN_TYPE), "pii-scan")
    total = scanned.where("kind = 'rows'").agg(F.sum("count")).first()[0] or 0
    holds = scanned.where("kind = 'holds'").select("entity", "context").distinct()
    contexts = holds.groupBy("entity").agg(F.count(F.lit(1)).alias("contexts")).where(
        (F.col("contexts") >= support) & (F.col("contexts") < total))
    texts = scanned.where("kind = 'text'").groupBy("context").agg(F.first("terms").alias("terms"))
    together = holds.join(contexts.select("entity"), "entity").join(texts, "context").select(
        "entity", F.explode("terms").alias("term")).groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    spread = scanned.where("kind = 'count'").groupBy("term").agg(F.sum("count").alias("documents"))
    ratio = (F.log(F.col("both") / F.col("contexts")) - F.log(F.col("documents") / F.lit(float(max(total, 1))))) / F.log(
        F.lit(float(max(total, 1))) / F.col("contexts"))
    # The stronger action holds where a word discloses several entities.
    strong = together.join(contexts, "entity").join(spread, "term").withColumn("ratio", ratio).where(
        F.col("ratio") >= generalise).groupBy("term").agg((F.max("ratio") >= remove).alias("removed")).toArrow()
    terms = strong["term"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(terms)
    removed = np.array(strong["removed"].to_pylist(), bool)
    return docs.mapInArrow(_find(terms[order], removed[order]), _FOUND_TYPE)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            text, at, parts = text or "", 0, []
            listed = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in (spans or "").split(",") if x))
            for s, e, kind in listed:
                if -e <= at:
                    continue
                parts += [text[at:max(s, at)], "" if kind == "term_remove" else
                          "[term]" if kind == "term_generalise" else f"[{kind}]"]
                at = -e
            out.append("".join(parts) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out), batch.column("spans")], ["doc", "text", "spans"])


def sanitise(docs: DataFrame, doc: str = "doc_id", text: str = "text", **limits) -> DataFrame:
    """(doc, text, spans): texts with entities replaced by their kind, and disclosing words generalised or removed."""
    spans = find_spans(docs, doc, text, **limits).select("doc", "spans")
    texts = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text"))
    return texts.join(spans.dropDuplicates(["doc"]), "doc", "left").select("doc", "text", "spans").mapInArrow(
        _apply, "doc long, text string, spans string")


def op5_pii(spark, folder: str) -> DataFrame:
    """Personal data in all documents and the words that disclose it."""
    found = find_spans(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), *(f"n_{k}" for k in KINDS), "base_sha256", "spans")
