"""Similarity join of documents on word shingles, by universe partitioning and the pigeonhole principle.

A document is the set of its shingles.  Sets of sizes a and b with Jaccard similarity of at least
p % differ in at most H = floor((100 - p)(a + b) / (100 + p)) shingles.  The universe of shingles
is hashed into segments; H differences touch at most H segments, so among H + 1 segments that are
not empty one has equal content in both sets, and equal content gives an equal signature.

* Size bands.  A scheme is made for sizes in [2^k, 2^(k+1)); a pair meets in the scheme of its
  smaller set, so larger sets near the lower limit of their band also sign for the band below.
* Allocation by cost.  Signing a segment exactly costs one row and stands for one difference;
  signing its one-deletion neighbourhood costs a row for each member and stands for two.  For each
  band the cheaper mix is taken among those that leave (nearly) no set without enough segments
  that are not empty: one-deletion neighbourhoods for small sets, exact segments for others.  The
  few sets that still lack some are indexed by their single shingles besides.
* Frequent signatures.  A signature that more than ``GROUP`` different sets share makes no pairs.
  As equal content is equally frequent on both sides, leaving it out is exact for every set that
  keeps H + 1 other signatures.  Sets that do not (members of large near-copy families) are linked
  by their frequent signatures into families instead, by one star for each signature.
* Verification.  Sets that may be similar form families; a family is cut into blocks and pairs of
  blocks, each of bounded size, in which similarities are counted exactly.  A block returns a
  spanning forest of its links and never all pairs.

Equal sets are one node from the start, so copies are never compared.  Sets are compared by 52-bit
hashes of shingles, nodes are 64-bit hashes of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import as_signed, components, grams, lean, mix, ranges_hash, row_slices, saved, strings, words

#: Sets that share a signature and still make pairs.
GROUP = 12
#: Shingles and sets in a block of a family.
BLOCK_SHINGLES, BLOCK_SETS = 150_000, 1000
#: The scheme that indexes single shingles.
SINGLES = 63
#: Entries (signature, set) that a task sorts at once.
SORT_ENTRIES = 4_000_000
#: Rows that shingle_sets takes at once: 12 bits beside a 52-bit shingle.
PACKED_ROWS = 1 << 12

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def most_different(a, b, percent: int):
    return (100 - percent) * (a + b) // (100 + percent)


def allocate(band: int, percent: int) -> tuple[int, bool]:
    """Number of segments for a band, and whether they are signed with one-deletion neighbourhoods."""
    size = 2 ** (band + 1) - 1
    needed = most_different(size, size * 100 // percent, percent) + 1

    def filled(segments: int) -> float:
        """Segments that are not empty, less three standard deviations; grows with the number of segments."""
        empty = segments * math.exp(-size / segments)
        return segments - empty - 3 * math.sqrt(empty)

    options = [((needed + 1) // 2 + size, (needed + 1) // 2, True)]
    if needed <= size and filled(size) >= needed:
        low, high = needed, size
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if filled(middle) >= needed else (middle + 1, high)
        options.append((low, low, False))
    return min(options)[1:]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of some rows, ordered by row, and each row's first (one more at the end).

    A row with fewer than n words has its whole sequence as one shingle, a row without words none.
    Takes at most PACKED_ROWS rows.
    """
    if len(offsets) - 1 > PACKED_ROWS:
        raise ValueError(f"at most {PACKED_ROWS} rows at once")
    _, _, hashes, first = words(_LOWER[data], offsets)
    size = np.diff(first)
    found = grams(hashes, n)
    full = np.flatnonzero(size >= n)
    rows = np.repeat(full, size[full] - n + 1)
    at = np.arange(len(rows)) - np.repeat(np.cumsum(size[full] - n + 1) - (size[full] - n + 1), size[full] - n + 1)
    values = found[first[rows] + at]
    short = np.flatnonzero((size > 0) & (size < n))
    rows = np.concatenate([rows, short])
    values = np.concatenate([values, ranges_hash(hashes, first[short], first[short + 1])])
    packed = np.sort((rows.astype(np.uint64) << np.uint64(52)) | (values >> np.uint64(12)))
    if len(packed):
        packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    rows = (packed >> np.uint64(52)).astype(np.int64)
    return packed & np.uint64((1 << 52) - 1), np.searchsorted(rows, np.arange(len(offsets)))


def _sign(shingles, owner, weight, scheme, segments, deletion, size):
    """Signatures of sets in one scheme: (key, owner) entries and each set's capacity.

    owner: row number of each shingle (ascending); weight: mixed shingles; scheme, segments and
    deletion: one value for all.
    """
    where = ((mix(shingles + np.uint64(scheme + 1)) >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    slot = owner * segments + where.astype(np.int64)
    order = np.argsort(slot, kind="stable")
    slot, token = slot[order], weight[order]
    begin = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    count = np.diff(np.concatenate([begin, [len(slot)]]))
    total = np.add.reduceat(token, begin)
    tag = (slot[begin] % segments).astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + np.uint64(scheme)
    who = slot[begin] // segments
    keys, owners = [total + tag], [who]
    if deletion:
        group = np.repeat(np.arange(len(begin)), count)
        several = count[group] >= 2
        keys.append((total[group] - token + tag[group])[several])
        owners.append(who[group][several])
    capacity = np.bincount(who, np.minimum(count, 1 + deletion), size).astype(np.int64)
    keys = (mix(np.concatenate(keys)) & ~np.uint64(63)) | np.uint64(scheme)
    return keys, np.concatenate(owners), capacity


def _digests(weight: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hashes of sets of mixed shingles."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(weight, dtype=np.uint64)])
    return mix(sums[first[1:]] - sums[first[:-1]] + np.diff(first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def _signatures(shingles, first, percent):
    """Entries (key, digest) of some sets, and the sets' digests, sizes and capacities (own scheme, scheme below)."""
    size = np.diff(first)
    rows = len(size)
    owner = np.repeat(np.arange(rows), size)
    weight = mix(shingles)
    digest = _digests(weight, first)
    band = np.frexp(np.maximum(size, 1).astype(float))[1] - 1
    below = (size * percent <= (2 ** band - 1) * 100) & (band > 0)
    # a set of which no other can be within reach needs no signature
    able = most_different(size, size * 100 // percent, percent) > 0
    capacity = np.full((2, rows), -1, np.int64)
    single = np.zeros(rows, bool)
    keys, who = [], []
    for lower in (0, 1):
        for k in np.unique(band[able & (below | (lower == 0))] - lower):
            take = able & (band - lower == k) & (below | (lower == 0))
            segments, deletion = allocate(int(k), percent)
            pick = take[owner]
            if not pick.any():
                continue
            key, own, cap = _sign(shingles[pick], owner[pick], weight[pick], int(k), segments, deletion, rows)
            keys.append(key)
            who.append(own)
            capacity[lower, take] = cap[take]
            partner = np.minimum(size * 100 // percent, 2 ** 62) if not lower else np.full(rows, 2 ** (int(k) + 1) - 1)
            single |= take & (cap <= most_different(size, partner, percent))
    pick = single[owner]
    if pick.any():
        keys.append((mix(weight[pick] + np.uint64(SINGLES)) & ~np.uint64(63)) | np.uint64(SINGLES))
        who.append(owner[pick])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    who = np.concatenate(who) if who else np.zeros(0, np.int64)
    return keys, digest[who], digest, size, capacity, single


_PACKED = "bucket long, doc long, size long, digest long, own long, below long, single boolean, entries binary"
_PACKED_ARROW = pa.schema([("bucket", pa.int64()), ("doc", pa.int64()), ("size", pa.int64()), ("digest", pa.int64()),
                           ("own", pa.int64()), ("below", pa.int64()), ("single", pa.bool_()), ("entries", pa.binary())])
_FOUND = "kind string, doc long, size long, own long, below long, single boolean, a long, b long, scheme long"
_FOUND_ARROW = pa.schema([("kind", pa.string()), ("doc", pa.int64()), ("size", pa.int64()), ("own", pa.int64()),
                          ("below", pa.int64()), ("single", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()),
                          ("scheme", pa.int64())])


def _blank(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns.get(f.name) if columns.get(f.name) is not None else pa.nulls(rows, f.type) for f in schema],
        schema=schema)


def _pack(n: int, percent: int, buckets: int):
    """Rows of documents, and their signatures packed by bucket: a few long rows instead of one for each signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column(1))
            ids = batch.column(0)
            entries = []
            for a, b in row_slices(offsets, rows=PACKED_ROWS):
                shingles, first = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n)
                keys, nodes, digest, size, capacity, single = _signatures(shingles, first, percent)
                yield _blank(_PACKED_ARROW, b - a, bucket=as_signed(digest % np.uint64(buckets)), doc=ids.slice(a, b - a),
                             size=pa.array(size), digest=as_signed(digest), own=pa.array(capacity[0]),
                             below=pa.array(capacity[1]), single=pa.array(single))
                entries.append(np.stack([keys, nodes], 1))
                if sum(map(len, entries)) > SORT_ENTRIES // 8:
                    yield from _packed(entries, buckets)
                    entries = []
            yield from _packed(entries, buckets)

    return lean(run)


def _packed(entries: list[np.ndarray], buckets: int) -> Iterator[pa.RecordBatch]:
    entries = np.concatenate(entries) if entries else np.zeros((0, 2), np.uint64)
    if not len(entries):
        return
    bucket = ((entries[:, 0] >> np.uint64(6)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    bucket, entries = bucket[order], entries[order]
    begin = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.concatenate([begin[1:], [len(bucket)]])
    yield _blank(_PACKED_ARROW, len(begin), bucket=pa.array(bucket[begin]),
                 entries=pa.array([entries[x:y].tobytes() for x, y in zip(begin, ends)], pa.binary()))


@lean
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of sets that share signatures, and the members of frequent signatures.

    Entries are held until a key turns out to be frequent; from then on its members are passed
    through, so what is held never depends on how many sets share a signature.
    """
    held, frequent, waiting = np.zeros((0, 2), np.uint64), np.zeros(0, np.uint64), []

    def settle(held, frequent, waiting):
        table = np.concatenate([held, *waiting])
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        if len(table):
            table = table[np.concatenate([[True], (table[1:] != table[:-1]).any(1)])]
        key, begin, count = np.unique(table[:, 0], return_index=True, return_counts=True)
        hot = (count > GROUP) | np.isin(key, frequent)
        member = np.repeat(hot, count)
        return table[~member], np.union1d(frequent, key[hot]), table[member]

    def passed(out):
        return _blank(_FOUND_ARROW, len(out), kind=pa.array(["frequent"] * len(out)), a=as_signed(out[:, 1].copy()),
                      b=as_signed(out[:, 0].copy()), scheme=pa.array((out[:, 0] & np.uint64(63)).astype(np.int64)))

    size = 0
    for batch in batches:
        documents = batch.filter(batch.column(1).is_valid())
        if documents.num_rows:
            yield _blank(_FOUND_ARROW, documents.num_rows, kind=pa.array(["document"] * documents.num_rows),
                         doc=documents.column(1), size=documents.column(2), a=documents.column(3),
                         own=documents.column(4), below=documents.column(5), single=documents.column(6))
        for entry in batch.column(7).drop_null():
            waiting.append(np.frombuffer(entry.as_buffer(), np.uint64).reshape(-1, 2))
            size += len(waiting[-1])
            if size > SORT_ENTRIES:
                held, frequent, out = settle(held, frequent, waiting)
                waiting, size = [], 0
                if len(out):
                    yield passed(out)
    held, frequent, out = settle(held, frequent, waiting)
    if len(out):
        yield passed(out)
    pairs = []
    for step in range(1, GROUP):
        same = np.flatnonzero(held[step:, 0] == held[:-step, 0]) if len(held) > step else np.zeros(0, np.int64)
        if not len(same):
            break
        pairs.append(np.stack([held[same, 1], held[same + step, 1], held[same, 0] & np.uint64(63)], 1))
    if pairs:
        pairs, count = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        for k in range(0, len(pairs), 100_000):
            part = pairs[k:k + 100_000]
            yield _blank(_FOUND_ARROW, len(part), kind=pa.array(["pair"] * len(part)), a=as_signed(part[:, 0].copy()),
                         b=as_signed(part[:, 1].copy()), scheme=pa.array(part[:, 2].astype(np.int64)),
                         size=pa.array(count[k:k + 100_000]))


def _sets(n: int):
    """The shingle sets of documents as binary columns."""
    schema = pa.schema([("node", pa.int64()), ("family", pa.int64()), ("i", pa.int32()), ("j", pa.int32()),
                        ("mine", pa.int32()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = strings(batch.column("text"))
            for a, b in row_slices(offsets, rows=PACKED_ROWS):
                shingles, first = shingle_sets(data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], n)
                blobs = [shingles[x:y].tobytes() for x, y in zip(first[:-1], first[1:])]
                digests = _digests(mix(shingles), first).view(np.int64).tolist()
                rows = {"node": [], "family": [], "i": [], "j": [], "mine": [], "shingles": []}
                for node, family, blocks, blob, digest in zip(
                        *(batch.column(c)[a:b].to_pylist() for c in ("node", "family", "blocks")), blobs, digests):
                    if node != digest:
                        continue  # another text under the same id
                    mine = (node & 0xFFFFFFFF) * blocks >> 32
                    for k in range(blocks):
                        for name, value in zip(rows, (node, family, min(mine, k), max(mine, k), mine, blob)):
                            rows[name].append(value)
                        if len(rows["node"]) >= 2000:
                            yield pa.RecordBatch.from_pydict(rows, schema=schema)
                            rows = {name: [] for name in rows}
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    return lean(run)


def _links(nodes: np.ndarray, side: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between sets of a block (or of two blocks)."""
    size = np.array([len(s) for s in sets])
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    begin = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
    count = np.diff(np.concatenate([begin, [len(tokens)]]))
    shared = np.repeat(count > 1, count)
    column = np.repeat(np.arange(len(begin)), count)[shared]
    owner = owner[shared]
    column = np.unique(column, return_inverse=True)[1]
    common = np.zeros((len(sets), len(sets)), np.float32)
    cut = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1025, 1024))
    for x, y in zip(cut[:-1], cut[1:]):
        part = np.zeros((len(sets), 1024), np.float32)
        part[owner[x:y], column[x:y] % 1024] = 1
        common += part @ part.T
    linked = (100 + percent) * common >= percent * (size[:, None] + size[None, :]).astype(np.float64)
    if side.min() != side.max():
        linked &= side[:, None] != side[None, :]
    label = np.arange(len(sets))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(sets)).min(1))
        least = np.minimum(least, least[least])
        if (least == label).all():
            break
        label = least
    other = np.flatnonzero(label != np.arange(len(sets)))
    return nodes[other], nodes[label[other]]


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []

        def finish():
            if len(rows) < 2:
                return pa.RecordBatch.from_pydict({"a": [], "b": []}, schema=schema)
            a, b = _links(np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), [r[2] for r in rows], percent)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("family", "i", "j", "node", "mine")]
            for family, i, j, node, mine, blob in zip(*columns, batch.column("shingles")):
                if (family, i, j) != current:
                    yield finish()
                    current, rows = (family, i, j), []
                rows.append((node, mine, np.frombuffer(blob.as_buffer(), np.uint64).copy()))
        yield finish()

    return lean(run)


def jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80, doc: str = "doc_id",
                       text: str = "text") -> DataFrame:
    """Near-duplicate classes of documents: (doc, n_shingles, component_id).

    Two documents link when their sets of n-word shingles have a Jaccard similarity of at least
    ``percent`` / 100; component_id is the smallest id reachable by links.  Texts that are null or
    without words have no shingles and link with nothing; a text with fewer than n words has its
    whole sequence as its one shingle.  Other columns are ignored; equal rows link with each other.
    Rows without an id are left out.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc).cast("long").alias("doc"), F.col(text).alias("text")).where("doc is not null")
    packed = docs.mapInArrow(_pack(n, percent, 4 * partitions), _PACKED)
    found = saved(packed.repartition(partitions, "bucket").mapInArrow(_meet, _FOUND), "jaccard-found")

    documents = found.where("kind = 'document'").select("doc", "size", F.col("a").alias("node"), "own", "below", "single")
    nodes = documents.where("size > 0").groupBy("node").agg(
        F.min("doc").alias("rep"), *[F.first(c).alias(c) for c in ("size", "own", "below", "single")])
    nodes = saved(nodes, "jaccard-nodes")
    band = F.floor(F.log2("size") + F.lit(1e-9)).cast("long")
    signed = nodes.select("node", "size", F.explode(F.array(
        F.struct(band.alias("scheme"), F.col("own").alias("capacity"),
                 F.floor(F.col("size") * 100 / percent).cast("long").alias("partner")),
        F.struct((band - 1).alias("scheme"), F.col("below").alias("capacity"),
                 (F.pow(F.lit(2), band) - 1).cast("long").alias("partner")),
        F.struct(F.lit(SINGLES).cast("long").alias("scheme"),
                 F.when(F.col("single"), F.col("size")).otherwise(F.lit(-1)).alias("capacity"),
                 F.floor(F.col("size") * 100 / percent).cast("long").alias("partner")))).alias("s")
    ).select("node", "size", "s.*").where("capacity >= 0")
    by_deletion = [k for k in range(40) if allocate(k, percent)[1]]
    frequent = found.where("kind = 'frequent'").select(F.col("a").alias("node"), F.col("b").alias("key"), "scheme").distinct()
    lost = frequent.groupBy("node", "scheme").agg(F.count(F.lit(1)).alias("lost"))
    apart = F.floor((100 - percent) * (F.col("size") + F.col("partner")) / (100 + percent)).cast("long")
    # Only sets with frequent signatures can lack others.
    lacking = signed.join(lost, ["node", "scheme"]).where(
        F.col("scheme").isin(by_deletion) | (F.col("capacity") - F.col("lost") <= apart)).select("node", "scheme")
    members = saved(frequent.join(lacking, ["node", "scheme"]).select("node", "key"), "jaccard-members")
    least = members.groupBy("key").agg(F.min("node").alias("b"))
    stars = members.join(least, "key").select(F.col("node").alias("a"), "b").where("a <> b").distinct()

    pairs = found.where("kind = 'pair'").groupBy("a", "b", "scheme").agg(F.sum("size").alias("common"))
    kept = signed.join(lost, ["node", "scheme"], "left").select(
        "node", "scheme", "size", (F.col("capacity") - F.coalesce("lost", F.lit(0))).alias("left"))
    one, two = (kept.select(F.col("node").alias(x), "scheme", F.col("size").alias(f"n{x}"), F.col("left").alias(f"left{x}"))
                for x in "ab")
    apart = F.floor((100 - percent) * (F.col("na") + F.col("nb")) / (100 + percent))
    pairs = pairs.join(one, ["a", "scheme"]).join(two, ["b", "scheme"]).where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (F.col("scheme").isin(by_deletion) | (F.col("common") >= F.greatest("lefta", "leftb") - apart))).select("a", "b")
    families = components(pairs.unionByName(stars), "jaccard-families")
    families = families.unionByName(families.select(F.col("component").alias("node"), "component").distinct())

    sized = families.join(nodes, "node")
    blocks = sized.groupBy("component").agg(F.ceil(F.greatest(
        F.sum("size") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int").alias("blocks"))
    chosen = sized.join(blocks, "component").select("rep", "node", F.col("component").alias("family"), "blocks")
    sets = chosen.join(docs, chosen.rep == docs.doc).select("node", "family", "blocks", "text").mapInArrow(
        _sets(n), "node long, family long, i int, j int, mine int, shingles binary")
    links = sets.repartition(partitions, "family", "i", "j").sortWithinPartitions("family", "i", "j").mapInArrow(
        _verify(percent), "a long, b long")
    classes = components(links, "jaccard-links")
    named = nodes.join(classes, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    ids = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(ids, "component").select("node", "component_id")
    return documents.join(named, "node", "left").select(
        F.col("doc").alias(doc), F.col("size").alias("n_shingles"),
        F.when(F.col("size") > 0, F.col("component_id")).otherwise(F.col("doc")).alias("component_id"))


def op9_ngram_jaccard(spark, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents on five-word shingles at a similarity of 0.8."""
    return jaccard_components(spark.read.parquet(f"{folder}/documents.parquet"))
