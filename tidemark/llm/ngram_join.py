"""Exact Jaccard join of documents on word n-grams, in metric space.

A document is its set of distinct shingles; two link when the Jaccard distance
is at most 0.25 (an intersection of at least 75 hundredths of the union).

*Pivots and regions.*  The first pivots are the shingles themselves, as sets of
one.  A document of n shingles is nearest, at 1 - 1/n, to those it contains;
an order of all shingles breaks the tie, and the first one's region is the
document's Voronoi region.  The order puts off the corpus' most frequent
shingles (a list of at most :data:`HEAVY_KEYS`, found by counting), so that
passages which many documents share do not make regions.

*Windows.*  By the triangle inequality a partner within the threshold lacks at
most a quarter of a document's shingles, so the partner's region is that of one
of the document's first ``n - ceil(3n/4) + 1`` pivots: into those regions the
document is replicated, and linked documents always meet in one of them.

*Recursion.*  In a region every document is first compared with a document
pivot, the one with the smallest id, which connects most copies; what is
connected already needs no comparison.  A region is then joined again around
two of its own documents far from each other, as pivots of two Voronoi regions;
the triangle inequality sends a document to both where its distances to them
differ by at most twice the threshold, so that linked documents still meet.
This goes on until a region has at most :data:`LEAF` documents, or pivots no
longer divide it (documents that share one passage are equally far from each
other).  It runs inside one task, on blocks of bounded size; a block gives a
spanning forest of its links, never all pairs.  Regions of at most
:data:`FEW_PAIRS` pairs are leaves from the start.

*Leaves.*  All pairs of different components are compared: first by odd
sketches, a bit for each part of the hash range that holds an odd number of
shingles.  Their Hamming distance is never more than the sets' symmetric
difference, so what it rules out is certain; the rest is compared as whole sets.

*Links.*  Linked documents are in one component, so once components are known
every pair of classes in one is compared exactly, each pair in one block of
bounded size, and a block gives its classes' numbers of links, never pairs.  A
class counts once for each of its documents.  The number of comparisons is
quadratic in a component's classes; ``links=False`` leaves this part out.

Hot groups: equal sets are one class before any pair is made; frequent pivots
go through joins and pre-aggregated groups only; no group is collected that
can grow with the data; a region is a star around pivots, never all its pairs.

Defined cases: null and empty texts have no shingles and link with nothing;
texts shorter than a shingle are one shingle; rows that repeat an id are one
document; an id of null links with nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WordHasher, discard, materialize, small_batches, window_hashes
from tidemark.llm.components import components, joined

WIDTH = 5
#: Frequent shingles that the order puts off, at most (8 bytes each, sent to all workers).
HEAVY_KEYS = 1 << 18
#: A shingle in fewer documents is never put off.
HEAVY_FROM = 32
#: Keys of a bucket, about, and held by a task before they are passed on.
BUCKET_KEYS, FLUSH_KEYS = 1 << 19, 1 << 19
#: Regions with at most so many pairs are leaves; a block has many of them.
FEW_PAIRS = 1024
#: Documents and shingles a side of a block, about.
BLOCK, BLOCK_SHINGLES = 2048, 1 << 20
#: Documents of a region that pivots divide no further; and the share of them that a part may have at most, else it is a leaf.
LEAF, DIVIDED = 64, 0.9
#: Pairs of sketches that are compared at once.
PAIRS_AT_ONCE = 1 << 14
#: Bits of a sketch at most; it has two to four for each shingle.
SKETCH_BITS = 1 << 16

#: Links are counted in blocks of about so many documents and shingles a side.
LINK_BLOCK, LINK_SHINGLES = 2048, 1 << 20
#: Of these so many on the left are multiplied with all on the right at once.
LINK_ROWS = 512
#: Shingles of a block that are multiplied as one matrix; those with few pairs are added up one by one.
LINK_COLUMNS, LINK_FEW = 2048, 200

_HALF = np.uint64(1 << 63)


def shingles(text: str | None, hashes: WordHasher) -> np.ndarray:
    """The document's set, as sorted 64-bit hashes."""
    u = window_hashes(hashes(text), WIDTH)
    u.sort()
    return u[np.concatenate([[True], u[1:] != u[:-1]])] if len(u) else u


def sketch(u: np.ndarray) -> bytes:
    """Parity of the shingles in each of equal parts of the hash range."""
    bits = min(max(8, (2 * len(u) - 1).bit_length()), SKETCH_BITS.bit_length() - 1)
    at = (u >> np.uint64(64 - bits)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=1 << bits).astype(np.uint8) & 1).tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    """Rows of packed sketches at a smaller size: neighbouring parts become one."""
    while bits.shape[1] > size:
        bits = np.packbits(np.bitwise_xor.reduce(np.unpackbits(bits, axis=1).reshape(len(bits), -1, 2), axis=2), axis=1)
    return bits


def _may_link(x: bytes, y: bytes, m: int, n: int) -> bool:
    """False only if sets of m and n shingles with these sketches cannot link: their symmetric difference is above a seventh."""
    if len(x) != len(y):
        size = min(len(x), len(y))
        x, y = (_folded(np.frombuffer(z, np.uint8)[None], size).tobytes() for z in (x, y))
    return 7 * (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() <= m + n


def window(n: int) -> int:
    """Regions that a document of ``n`` shingles can share with a partner."""
    return n - (3 * n + 3) // 4 + 1 if n else 0


def _by_bucket(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and number of 32 + bits bits, of hashes below 2**63."""
    number = (keys >> np.uint64(31 - bits)).astype(np.int64)
    return number >> 32, number


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, first bytes first: zeros lie together and compress."""
    return np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _sorted_planes(x: np.ndarray) -> bytes:
    """Ascending numbers as steps, which are small."""
    return _planes(np.diff(x, prepend=0))


def _heavy(docs: DataFrame, bits: int, most: int) -> np.ndarray:
    """Numbers of the most frequent shingles (of the lower half of all hashes)."""

    def count(batches):
        hashes, held, n = WordHasher(fold_case=True), [], 0

        def give():
            numbers, counts = np.unique(np.concatenate(held), return_counts=True)
            edges = np.flatnonzero(np.diff(numbers >> 32, prepend=-1))
            cut = lambda x, f: pa.array([f(part) for part in np.split(x, edges[1:])], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(numbers[edges] >> 32, pa.int64()), cut(numbers & 0xFFFFFFFF, _sorted_planes), cut(counts, _planes)], ["bucket", "keys", "counts"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                u = shingles(text, hashes)
                held.append(_by_bucket(u[u < _HALF], bits)[1])
                n += len(held[-1])
                if n >= FLUSH_KEYS:
                    yield give()
                    held, n = [], 0
        if n:
            yield give()

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.concatenate([np.cumsum(_numbers(x)) for x in pdf["keys"]])
        counts = np.concatenate([_numbers(x) for x in pdf["counts"]])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sums = np.add.reduceat(counts, first)
        much = sums >= HEAVY_FROM
        return pd.DataFrame({"number": keys[first][much] | int(pdf["bucket"].iloc[0]) << 32, "n": sums[much]})

    found = materialize(docs.select("text").mapInArrow(count, "bucket bigint, keys binary, counts binary").groupBy("bucket").applyInPandas(total, "number bigint, n bigint"), "heavy")
    sizes = sorted(((r.size, r.n) for r in found.groupBy(F.floor(F.log2("n") * 8).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    room, least = most, None
    for size, n in sizes:
        if n > room:
            break
        room, least = room - n, size
    if least is None:
        return np.zeros(0, np.int64)
    numbers = [r.number for r in found.where(F.floor(F.log2("n") * 8) >= least).select("number").collect()]
    discard(found)
    return np.sort(np.array(numbers, np.int64))


def _place(docs: DataFrame, bits: int, heavy: np.ndarray) -> DataFrame:
    """Rows of two kinds: a document (doc_id, n, same, frequent pivots), and a
    region of several documents (sign of its members, members).

    Documents and pivots go to buckets in one shuffle; a bucket's regions with
    the same members are one, and no region here has more members than a
    frequent shingle has documents."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)
    schema = pa.schema([("bucket", pa.int64()), ("keys", pa.binary()), ("ids", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("frequent", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches):
        often, hashes = sent.value, WordHasher(fold_case=True)
        held_keys, held_ids, n = [], [], 0

        def packed():
            numbers, ids = np.concatenate(held_keys), np.concatenate(held_ids)
            order = np.argsort(numbers, kind="stable")
            numbers, ids = numbers[order], ids[order]
            edges = np.flatnonzero(np.diff(numbers >> 32, prepend=-1))
            keys = [*map(_sorted_planes, np.split(numbers & 0xFFFFFFFF, edges[1:]))]
            none = [None] * len(keys)
            cols = [numbers[edges] >> 32, keys, [*map(_planes, np.split(ids, edges[1:]))], none, none, none, none, none]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    u = shingles(text, hashes)
                    same = hashlib.blake2b(u.tobytes(), digest_size=16).digest() if len(u) and doc is not None else None
                    frequent: list = []
                    if same is not None:
                        w = window(len(u))
                        low = u[: np.searchsorted(u, _HALF)]
                        numbers = _by_bucket(low, bits)[1]
                        put_off = np.zeros(len(low), bool)
                        if len(often):
                            put_off = often[np.minimum(np.searchsorted(often, numbers), len(often) - 1)] == numbers
                        seldom = numbers[~put_off][:w]
                        held_keys.append(seldom)
                        held_ids.append(np.full(len(seldom), doc, np.int64))
                        n += len(seldom)
                        if len(seldom) < w:
                            frequent = np.concatenate([low[put_off], u[len(low) :]])[: w - len(seldom)].view(np.int64).tolist()
                    rows.append((-1 - (doc or 0) % (1 << bits), None, None, doc, len(u), same, frequent, sketch(u) if same else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                if n >= FLUSH_KEYS:
                    yield packed()
                    held_keys, held_ids, n = [], [], 0
        if n:
            yield packed()

    dealt = docs.select("doc_id", "text").mapInArrow(run, "bucket bigint, keys binary, ids binary, doc_id bigint, n bigint, same binary, frequent array<bigint>, sketch binary")
    return dealt.groupBy("bucket").applyInArrow(_regions, "doc_id bigint, n bigint, same binary, frequent array<bigint>, sketch binary, sign binary, members array<bigint>")


def _regions(got: pa.Table) -> pa.Table:
    """A bucket's documents as they are; of its pivots the regions of several documents."""
    kinds = [("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("frequent", pa.list_(pa.int64())), ("sketch", pa.binary()), ("sign", pa.binary()), ("members", pa.list_(pa.int64()))]
    if got.column("bucket")[0].as_py() < 0:
        none = pa.nulls(got.num_rows)
        columns = [got.column(k) for k, _ in kinds[:5]] + [none.cast(t) for _, t in kinds[5:]]
        return pa.Table.from_arrays(columns, schema=pa.schema(kinds))
    keys = np.concatenate([np.cumsum(_numbers(x)) for x in got.column("keys").to_pylist()])
    ids = np.concatenate([*map(_numbers, got.column("ids").to_pylist())])
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(first, len(keys)))
    found = {}
    for at, k in zip(first[size > 1].tolist(), size[size > 1].tolist(), strict=True):
        members = ids[at : at + k]
        found[hashlib.blake2b(members.tobytes(), digest_size=16).digest()] = members
    ends = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found.values()])))
    columns = [pa.nulls(len(found)).cast(t) for _, t in kinds[:5]] + [pa.array([*found], pa.binary()), lists]
    return pa.Table.from_arrays(columns, schema=pa.schema(kinds))


def _compressed(docs: DataFrame) -> DataFrame:
    """doc_id and the text under zstd, which halves what the joins move."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([press(x.encode("utf-8", "surrogatepass")) for x in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), z], ["doc_id", "z"])

    return docs.where("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, z binary")


def _compare(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """a, b and linked of pairs, from the whole texts."""

    def run(batches):
        import zstandard

        hashes, last, b_set, plain = WordHasher(fold_case=True), None, None, zstandard.ZstdDecompressor().decompress
        text = lambda z: plain(z).decode("utf-8", "surrogatepass")
        for batch in batches:
            linked = []
            for x, y, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if b != last:
                    last, b_set = b, shingles(text(y), hashes)
                a_set = shingles(text(x), hashes)
                both = len(np.intersect1d(a_set, b_set, assume_unique=True))
                union = len(a_set) + len(b_set) - both
                linked.append(bool(union) and 100 * both >= threshold * union)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    left = pairs.join(texts.select(F.col("rep").alias("a"), F.col("z").alias("x")), "a")
    both = left.join(texts.select(F.col("rep").alias("b"), F.col("z").alias("y")), "b")
    return materialize(both.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint, linked boolean"), "compared")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of ``left`` with each of ``right``."""
    out = np.zeros((len(left), len(right)), np.int32)
    row, col = (np.repeat(np.arange(len(x), dtype=np.int64), [*map(len, x)]) for x in (left, right))
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b)
    if not len(shared):
        return out

    def by_shingle(values, owner):
        at = np.minimum(np.searchsorted(shared, values), len(shared) - 1)
        hit = shared[at] == values
        at, owner = at[hit], owner[hit]
        order = np.argsort(at, kind="stable")
        return at[order], owner[order], np.bincount(at, minlength=len(shared))

    (p, row, m), (q, col, n) = by_shingle(a, row), by_shingle(b, col)
    many = LINK_FEW * m * n > out.size
    number = np.cumsum(many) - 1
    for at in range(0, int(many.sum()), LINK_COLUMNS):
        x, y = np.zeros((len(left), LINK_COLUMNS), np.float32), np.zeros((LINK_COLUMNS, len(right)), np.float32)
        i, j = (many[z] & (number[z] >= at) & (number[z] < at + LINK_COLUMNS) for z in (p, q))
        x[row[i], number[p[i]] - at] = 1
        y[number[q[j]] - at, col[j]] = 1
        out += (x @ y).astype(np.int32)
    # each owner on the left with the run of owners on the right, some at a time
    start, few = np.cumsum(n) - n, np.flatnonzero(~many[p])
    held = np.cumsum(n[p[few]])
    for part in np.split(few, np.searchsorted(held, np.arange(1 << 22, held[-1], 1 << 22))) if len(few) else []:
        k = n[p[part]]
        step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        pairs = np.repeat(row[part], k) * len(right) + col[np.repeat(start[p[part]], k) + step]
        out += np.bincount(pairs, minlength=out.size).reshape(out.shape).astype(np.int32)
    return out


def _links(comp: DataFrame, texts: DataFrame, classes: DataFrame, threshold: int) -> DataFrame:
    """rep and the number of documents of other classes that its documents link with."""
    sizes = classes.where("rep is not null and doc_id is not null").groupBy("rep").agg(F.countDistinct("doc_id").alias("weight"), F.first("n").alias("n"))
    nodes = materialize(comp.select(F.col("node").alias("rep"), "component").join(sizes, "rep"), "nodes")
    blocks = nodes.groupBy("component").agg(F.ceil(F.greatest(F.count(F.lit(1)) / LINK_BLOCK, F.sum("n") / LINK_SHINGLES)).cast("int").alias("blocks"))
    total = nodes.agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("n")).first()
    # components of one block share one with others, as no documents of two components link
    buckets = 1 + max(2 * total.m // LINK_BLOCK, 2 * (total.n or 0) // LINK_SHINGLES)
    rows = nodes.join(blocks, "component").join(texts, "rep")
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("rep"), "blocks").cast("int")).otherwise(0)
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = F.when(F.col("blocks") > 1, F.col("component")).otherwise(F.pmod(F.xxhash64("component"), F.lit(buckets)))
    rows = rows.select((F.col("blocks") > 1).alias("large"), part.alias("part"), F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "rep", "weight", "z")

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        import zstandard

        hashes, plain = WordHasher(fold_case=True), zstandard.ZstdDecompressor().decompress
        sets = [shingles(plain(z).decode("utf-8", "surrogatepass"), hashes) for z in pdf["z"]]
        rep, weight, first = pdf["rep"].to_numpy(), pdf["weight"].to_numpy(), (pdf["own"] == pdf["u"]).to_numpy()
        one = pdf["u"].iloc[0] == pdf["v"].iloc[0]
        i, j = np.flatnonzero(first), np.arange(len(rep)) if one else np.flatnonzero(~first)
        links = np.zeros(len(rep), np.int64)
        size = np.array([*map(len, sets)], np.int64)
        if len(i) and len(j):
            right = [sets[k] for k in j]
            for at in range(0, len(i), LINK_ROWS):
                k = i[at : at + LINK_ROWS]
                both = _common([sets[x] for x in k], right)
                linked = 100 * both.astype(np.int64) >= threshold * (size[k][:, None] + size[j][None] - both)
                linked &= rep[k][:, None] != rep[j][None]
                links[k] += linked @ weight[j]
                if not one:
                    links[j] += weight[k] @ linked
        return pd.DataFrame({"rep": rep, "links": links})

    found = rows.groupBy("large", "part", "u", "v").applyInPandas(count, "rep bigint, links bigint")
    out = materialize(found.groupBy("rep").agg(F.sum("links").alias("links")), "links")
    discard(nodes, texts)
    return out


def jaccard_classes(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = 75, links: bool = True) -> DataFrame:
    """``key``, n_shingles, component_id, class_id (smallest id with an equal set)
    and, with ``links``, n_links: the number of other documents that it links with."""
    if threshold != 75:
        raise ValueError("regions are laid out for a threshold of 75")
    docs = small_batches(df).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(chars / 8 / BUCKET_KEYS, 1))), 5, 24))
    placed = materialize(_place(docs, bits, _heavy(docs, bits, HEAVY_KEYS)), "placed")

    rows = placed.where("members is null")
    first = rows.where("same is not null").groupBy("same").agg(F.min("doc_id").alias("rep"))
    classes = materialize(rows.select("doc_id", "n", "same").join(first, "same", "left").select("doc_id", "n", "rep"), "classes")
    found, texts = _components(docs, placed, classes, threshold)
    out = classes.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    columns = [F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id")]
    if links:
        same = classes.where("rep is not null").groupBy("rep").agg((F.countDistinct("doc_id") - 1).alias("equal"))
        out = out.join(same, "rep", "left").join(_links(found, texts, classes, threshold), "rep", "left")
        columns.append((F.coalesce("equal", F.lit(0)) + F.coalesce("links", F.lit(0))).alias("n_links"))
    else:
        discard(texts)
    return out.select(columns)


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Of pairs (a, b) those that the sketches don't rule out."""

    def run(batches):
        for batch in batches:
            keep = [_may_link(x, y, m, n) for x, y, m, n in zip(*(batch.column(k).to_pylist() for k in ("x", "y", "m", "n")), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda name, z, n: sketches.select(F.col("rep").alias(name), F.col("sketch").alias(z), F.col("n").alias(n))
    both = pairs.join(side("a", "x", "m"), "a").join(side("b", "y", "n"), "b")
    return materialize(both.select("a", "b", "x", "y", "m", "n").mapInArrow(run, "a bigint, b bigint"), "possible")


def _sketches(rows: pd.Series) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size of sketches: which rows have that size or twice it, and their sketches at that size."""
    size = rows.map(len).to_numpy(np.int64)
    out = {}
    for k in np.unique(size).tolist():
        at = np.flatnonzero((size == k) | (size == 2 * k))
        bits = np.zeros((len(at), k), np.uint8)
        for z in (k, 2 * k):
            own = size[at] == z
            if own.any():
                bits[own] = _folded(np.frombuffer(b"".join(rows.iloc[at[own]]), np.uint8).reshape(-1, z), k)
        out[k] = at, bits.view("<u8")
    return out


def _pairs(pdf: pd.DataFrame) -> np.ndarray:
    """Of small regions (``key``) the pairs, one of them apart, that may link."""
    pdf = pdf.sort_values("key", kind="stable", ignore_index=True)
    key, rep, n, comp, apart = (pdf[k].to_numpy() for k in ("key", "rep", "n", "comp", "apart"))
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    start, size = np.repeat(first, size), np.repeat(size, size)
    asks = np.flatnonzero(apart)
    i = np.repeat(asks, size[asks])
    j = np.arange(len(i)) - np.repeat(np.cumsum(size[asks]) - size[asks], size[asks]) + start[i]
    some = (comp[i] != comp[j]) & (4 * np.minimum(n[i], n[j]) >= 3 * np.maximum(n[i], n[j])) & (~apart[j] | (i < j))
    i, j = i[some], j[some]
    lengths = pdf["sketch"].map(len).to_numpy(np.int64)
    out = [np.zeros((0, 2), np.int64)]
    for k, (at, bits) in _sketches(pdf["sketch"]).items():
        place = np.full(len(pdf), -1)
        place[at] = np.arange(len(at))
        own = np.flatnonzero((np.minimum(lengths[i], lengths[j]) == k) & (np.maximum(lengths[i], lengths[j]) <= 2 * k))
        for part in np.split(own, range(PAIRS_AT_ONCE, len(own), PAIRS_AT_ONCE)):
            x, y = i[part], j[part]
            off = np.bitwise_count(bits[place[x]] ^ bits[place[y]]).sum(1, dtype=np.int64)
            hit = 7 * off <= n[x] + n[y]
            out.append(np.column_stack([rep[x[hit]], rep[y[hit]]]))
    return np.concatenate(out)


class _Region:
    """A block of a large region: documents on one side (``asks``, all apart) are
    joined with those on the other (``base``); a document may be on both."""

    def __init__(self, pdf: pd.DataFrame, threshold: int):
        import zstandard

        pdf = pdf.groupby("rep", as_index=False).agg({"n": "first", "comp": "first", "asks": "max", "base": "max", "sketch": "first", "z": "first"})
        self.rep, self.n, self.comp, self.asks, self.base = (pdf[k].to_numpy() for k in ("rep", "n", "comp", "asks", "base"))
        self.comp = self.comp.copy()
        self.lengths, self.sketches, self.z = pdf["sketch"].map(len).to_numpy(np.int64), _sketches(pdf["sketch"]), pdf["z"].tolist()
        self.place = {k: np.full(len(pdf), -1) for k in self.sketches}
        for k, (at, _) in self.sketches.items():
            self.place[k][at] = np.arange(len(at))
        self.sets: list = [None] * len(pdf)
        self.hashes, self.plain = WordHasher(fold_case=True), zstandard.ZstdDecompressor().decompress
        self.threshold, self.ties = threshold, []

    def set(self, i: int) -> np.ndarray:
        if self.sets[i] is None:
            self.sets[i], self.z[i] = shingles(self.plain(self.z[i]).decode("utf-8", "surrogatepass"), self.hashes), None
        return self.sets[i]

    def both(self, i: int, j: int) -> int:
        x, y = self.set(i), self.set(j)
        return int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())

    def distances(self, i: int, others: np.ndarray) -> np.ndarray:
        both = np.array([self.both(i, j) for j in others.tolist()])
        return 1 - both / (self.n[i] + self.n[others] - both)

    def leaf(self, idx: np.ndarray) -> None:
        for i in idx[self.asks[idx]].tolist():
            mine = self.lengths[i]
            # a pair of documents that are on both sides comes up once
            some = idx[(self.base[idx] & ~(self.asks[idx] & self.base[i] & (idx < i))) & (self.comp[idx] != self.comp[i]) & (4 * np.minimum(self.n[idx], self.n[i]) >= 3 * np.maximum(self.n[idx], self.n[i]))]
            found, offs = [], []
            for k in (mine, mine // 2):
                if k not in self.sketches:
                    continue
                j = some[(self.lengths[some] >= mine) & (self.lengths[some] <= 2 * mine) if k == mine else self.lengths[some] == k]
                bits = self.sketches[k][1]
                off = np.bitwise_count(bits[self.place[k][i]] ^ bits[self.place[k][j]]).sum(1, dtype=np.int64)
                hit = 7 * off <= self.n[i] + self.n[j]
                found.append(j[hit])
                offs.append(off[hit])
            j, off = np.concatenate(found), np.concatenate(offs)
            j = j[np.argsort(off, kind="stable")]
            while len(j):
                near, j = int(j[0]), j[1:]
                both = self.both(i, near)
                if 100 * both >= self.threshold * (self.n[i] + self.n[near] - both):
                    self.ties.append((self.rep[i], self.rep[near]))
                    self.comp[self.comp == self.comp[near]] = self.comp[i]
                    j = j[self.comp[j] != self.comp[i]]

    def join(self) -> np.ndarray:
        """Links that connect whatever the block's links connect."""
        todo = [np.arange(len(self.rep))]
        while todo:
            idx = todo.pop()
            if not self.asks[idx].any() or not self.base[idx].any():
                continue
            if len(idx) > LEAF:
                one = self.distances(idx[0], idx)
                two = self.distances(idx[int(one.argmax())], idx)
                reach = 2 * (1 - self.threshold / 100) + 1e-9
                parts = idx[one <= two + reach], idx[two <= one + reach]
                if max(map(len, parts)) <= DIVIDED * len(idx):
                    todo += parts
                    continue
            self.leaf(idx)
        return np.array(self.ties, np.int64).reshape(-1, 2)


def _regions_joined(now: DataFrame, sketches: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """(a, b, linked) of regions' documents: links of large regions that connect
    whatever their links connect, and of small ones the pairs to be compared yet."""
    asks = F.col("apart")
    size = lambda c: F.greatest(F.count(F.when(c, 1)) / BLOCK, F.sum(F.when(c, F.col("n"))) / BLOCK_SHINGLES)
    sizes = now.groupBy("key").agg(F.ceil(size(asks)).cast("int").alias("nu"), F.ceil(size(F.lit(True))).cast("int").alias("nv"), (F.count(F.when(asks, 1)) * F.count(F.lit(1)) > FEW_PAIRS).alias("large"))
    sizes = materialize(sizes.where("nu > 0"), "sizes")
    rows = now.select("key", "rep", "n", "comp", "apart").join(sizes, "key").join(sketches.select("rep", "sketch"), "rep")
    few = rows.where("not large").select("key", "rep", "n", "comp", "apart", "sketch")
    buckets = 1 + 2 * now.join(sizes.where("not large"), "key", "left_semi").count() // BLOCK

    def small(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _pairs(pdf)
        return pd.DataFrame({"a": np.maximum(got[:, 0], got[:, 1]), "b": np.minimum(got[:, 0], got[:, 1]), "linked": False})

    def large(pdf: pd.DataFrame) -> pd.DataFrame:
        got = _Region(pdf, threshold).join()
        return pd.DataFrame({"a": got[:, 0], "b": got[:, 1], "linked": True})

    out = few.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(buckets))).groupBy("part").applyInPandas(small, "a bigint, b bigint, linked boolean")
    most = rows.where("large").join(texts, "rep")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    block = lambda u, v, asking: F.struct(u.alias("u"), v.alias("v"), F.lit(asking).alias("asks"), F.lit(not asking).alias("base"))
    each = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    to = F.concat(F.when(asks, each("nv", lambda v: block(deal("nu"), v, True))).otherwise(F.array()), each("nu", lambda u: block(u, deal("nv"), False)))
    blocks = most.withColumn("to", F.explode(to)).select("key", "to.*", "rep", "n", "comp", "sketch", "z")
    out = materialize(out.unionByName(blocks.groupBy("key", "u", "v").applyInPandas(large, "a bigint, b bigint, linked boolean")), "joined")
    discard(sizes)
    return out


def _components(docs: DataFrame, placed: DataFrame, classes: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """Components of the classes' representatives, and the texts of all that meet another one."""
    one = classes.where("rep is not null").select("doc_id", "n", "rep").distinct()
    seldom = placed.where("members is not null").groupBy("sign").agg(F.first("members").alias("members"))
    seldom = seldom.select(F.xxhash64("sign").alias("key"), F.explode("members").alias("doc_id")).join(one, "doc_id").select("key", "rep", "n").distinct()
    frequent = placed.where(F.size("frequent") > 0).select("doc_id", "frequent").join(one.where("doc_id = rep"), "doc_id").select(F.explode("frequent").alias("key"), "rep", "n").distinct()
    # the sign of a region's members again, now that equal documents are one: equal regions are one
    members = materialize(seldom.unionByName(frequent), "members")
    signs = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot"), F.min_by("n", "rep").alias("pn"), F.bit_xor(F.xxhash64("rep")).alias("x"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("y")).where("size > 1")
    pivots = signs.groupBy("size", "pivot", "pn", "x", "y").agg(F.min("key").alias("key"))
    regions = materialize(members.join(pivots.select("key", "pivot", "pn"), "key").select("key", "rep", "n", "pivot", "pn"), "regions")
    discard(members)

    near = lambda m, n: 4 * F.least(m, n) >= 3 * F.greatest(m, n)
    met = regions.where("rep <> pivot").where(near("n", "pn")).select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    sketches = placed.where("members is null and sketch is not null").select(F.col("doc_id").alias("rep"), "n", "sketch").join(regions.select("rep").distinct(), "rep").groupBy("rep").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    sketches = materialize(sketches, "sketches")
    discard(placed)
    met = _possible(met, sketches)
    wanted = regions.select(F.col("rep").alias("doc_id")).distinct()
    texts = _compressed(docs).join(wanted, "doc_id").groupBy(F.col("doc_id").alias("rep")).agg(F.min("z").alias("z"))
    texts = materialize(texts, "texts")
    compared = _compare(met, texts, threshold)
    links = compared.where("linked").select("a", "b")

    comp = materialize(components(links, "a", "b"), "components")
    discard(met, compared)
    now = regions.join(comp.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep")).drop("component")
    parts = now.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("m"))
    main = parts.groupBy("key").agg(F.max(F.struct("m", "comp")).getField("comp").alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    # a region's pivot has been compared with all of it
    apart = (F.col("comp") != F.col("main")) & (F.col("rep") != F.col("pivot"))
    now = materialize(now.join(main, "key").select("key", "rep", "n", "comp", apart.alias("apart")), "apart")
    discard(regions)
    joins = _regions_joined(now, sketches, texts, threshold)
    left = _compare(joins.where("not linked").select("a", "b").distinct(), texts, threshold)
    found = joins.where("linked").select("a", "b").unionByName(left.where("linked").select("a", "b"))
    out = materialize(joined(comp, found, "a", "b"), "components")
    discard(comp, now, sketches, joins, left)
    return out, texts


def brute_force(texts: dict[int, str | None], threshold: int = 75) -> dict[int, tuple[int, int]]:
    """(n_shingles, component_id) of few documents, pair by pair (for tests)."""
    sets = {}
    for k, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + WIDTH]) for i in range(len(w) - WIDTH + 1)} or ({tuple(w)} if w else set())
    comp = {k: k for k in texts}

    def root(k):
        while comp[k] != k:
            k = comp[k]
        return k

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= threshold * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in ids}
