"""Near-duplicate embeddings by an inverted multi-index.

Independent codebooks on the two halves of a vector form a grid of cells, each
vector lies in the cell of its nearest pair of centroids.  A query's cells are
visited in the order of the summed squared distances of their two centroids
(multi-sequence order), up to the distance that finds pairs at the threshold
with the target recall; what lies in them is verified by cosine in double
precision.  A pair counts when either vector's traversal reaches the other's
cell, and counts once.

Neighbouring cells make up a block of some :data:`BASE_BLOCK` vectors, and a
vector goes once to each block that it visits, with the list of its cells there.

Bounds: codebooks are fitted on at most :data:`FIT_VECTORS` vectors; the counts
of the grid's cells (at most the square of :data:`LARGEST_BOOK`) go to the
driver; equal vectors are one class with a multiplicity; a block's vectors and
its visitors are dealt to parts of bounded size, so no group grows with the data; a block
gives counts, and ties of its nodes to local roots, never all pairs.

Defined cases: vectors that are null, zero, of another length than the most
frequent one, or with null or non-finite components link with nothing; an
empty table gives no rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, small_batches
from tidemark.llm.components import components

THRESHOLD = 0.9
#: Of pairs exactly at the threshold; nearer pairs are found more often.
TARGET_RECALL = 0.99
#: Vectors that codebooks and the traversal's reach are fitted on, at most.
FIT_VECTORS = 20_000
#: Vectors in a cell on average, which gives the codebooks' size.
PER_CELL = 50
LARGEST_BOOK = 1024
BASE_BLOCK, QUERY_BLOCK = 4096, 8192


def _unit(rows) -> np.ndarray:
    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ book.T + (book * book).sum(1)[None], 0)


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    book = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].copy()
    for _ in range(rounds):
        near = _distances(x, book).argmin(1)
        sums = np.zeros_like(book)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(book))
        book[n > 0] = sums[n > 0] / n[n > 0, None]
    return book


class MultiIndex:
    """Codebooks of both halves and the reach of the traversal."""

    def __init__(self, sample: np.ndarray, size: int, threshold: float = THRESHOLD, recall: float = TARGET_RECALL):
        rng, self.half = np.random.default_rng(7), sample.shape[1] // 2
        self.books = [_codebook(sample[:, : self.half], size, rng), _codebook(sample[:, self.half :], size, rng)]
        # partners of sampled vectors exactly at the threshold, in random directions
        q = sample[rng.choice(len(sample), min(4000, len(sample)), replace=False)]
        g = rng.normal(size=q.shape)
        g -= (g * q).sum(1)[:, None] * q
        norm = np.linalg.norm(g, axis=1, keepdims=True)
        v = threshold * q + np.sqrt(1 - threshold**2) * g / np.where(norm > 0, norm, 1)
        dq, dv = self.distances(q), self.distances(v)
        reach = lambda a, b: sum(a[h][np.arange(len(q)), b[h].argmin(1)] - a[h].min(1) for h in (0, 1))
        self.reach = float(np.quantile(np.minimum(reach(dq, dv), reach(dv, dq)), recall)) + 1e-9

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [_distances(x[:, : self.half], self.books[0]), _distances(x[:, self.half :], self.books[1])]

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own cell of each vector, and all cells its traversal visits (the own one first)."""
        d1, d2 = self.distances(x)
        width = len(self.books[1])
        visited = []
        for a, b in zip(d1, d2, strict=True):
            most = a.min() + b.min() + self.reach
            i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
            # multi-sequence: of each next-nearest first half only as far as the second half's order allows
            n = np.searchsorted(b[j], most - a[i], side="right")
            i = i[: np.count_nonzero(n)]
            n = n[: len(i)]
            cell = np.repeat(i, n) * width + np.concatenate([j[:k] for k in n])
            visited.append(cell[np.argsort(a[cell // width] + b[cell % width], kind="stable")])
        return d1.argmin(1) * width + d2.argmin(1), visited

    def visits(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether the traversal of each vector reaches each of ``cells``."""
        d1, d2 = self.distances(x)
        width = len(self.books[1])
        return d1[:, cells // width] + d2[:, cells % width] <= (d1.min(1) + d2.min(1) + self.reach)[:, None]


def _ties(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ties of linked nodes (ids) to their local component's smallest id."""
    nodes, at = np.unique(np.concatenate([q, b]), return_inverse=True)
    u, v = at[: len(q)], at[len(q) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        if (new == label).all():
            return nodes, nodes[label]
        label = new


def near_links(df: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding", recall: float = TARGET_RECALL) -> DataFrame:
    """``key``, n_links, component_id, kept: one row for each row of ``df``."""
    df = small_batches(df).select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    top = df.where("v is not null").groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dim = top.n if top else 0
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.coalesce((F.size("v") == dim) & F.lit(dim > 0) & ~F.exists("v", bad) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull(), F.lit(False))
    rows = df.withColumn("same", F.when(fine, F.md5(F.col("v").cast("string"))))
    classes = materialize(rows.where("same is not null").groupBy("same").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.min_by("v", "id").alias("v")), "vectors")
    n = classes.count()
    if n:
        links = _links(classes, n, threshold, recall)
        joined = rows.select("id", "same").join(classes.select("same", "rep", "mult"), "same", "left").join(links, "rep", "left")
        found = F.coalesce("links", F.lit(0)) + F.coalesce(F.col("mult") - 1, F.lit(0))
        out = joined.select("id", found.cast("bigint").alias("n_links"), F.coalesce("component", "rep", "id").alias("component_id"))
    else:
        out = rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return out.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _links(classes: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    """``rep``, links (with multiplicities) and component of classes that have a link."""
    picked = classes.select("v").where(F.pmod(F.xxhash64("rep"), F.lit(1_000_003)) < min(1.0, 0.95 * FIT_VECTORS / n) * 1_000_003)
    sample = [r.v for r in picked.limit(FIT_VECTORS).collect()] or [r.v for r in classes.select("v").limit(FIT_VECTORS).collect()]
    sample = _unit(sample)
    sample = sample[np.lexsort(sample.T)]  # the rows' order must not matter
    index = MultiIndex(sample, int(np.clip(round((n / PER_CELL) ** 0.5), 1, min(LARGEST_BOOK, len(sample)))), threshold, recall)

    width = len(index.books[1])

    def own_cells(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                d1, d2 = index.distances(_unit(pdf["v"].iloc[at : at + 2000].tolist()))
                yield pd.DataFrame({"cell": d1.argmin(1) * width + d2.argmin(1)})

    # neighbouring cells share a block, so that a vector goes once to each block that it visits, not to each cell
    filled = classes.select("v").mapInPandas(own_cells, "cell bigint").groupBy("cell").count().collect()  # a row for each cell of the grid at most
    sizes = np.zeros(len(index.books[0]) * width, np.int64)
    sizes[[r[0] for r in filled]] = [r[1] for r in filled]
    block_of = (np.cumsum(sizes) - sizes) // BASE_BLOCK

    def place(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                part = pdf.iloc[at : at + 2000]
                own, visited = index.cells(_unit(part["v"].tolist()))
                asked, cells = [], []
                for c in visited:
                    c = np.sort(c[sizes[c] > 0])
                    to = block_of[c]
                    edges = np.flatnonzero(np.diff(to, prepend=-1))
                    asked.append(to[edges])
                    cells.append([x.tolist() for x in np.split(c, edges[1:])] if len(c) else [])
                yield pd.DataFrame({"rep": part["rep"].to_numpy(), "mult": part["mult"].to_numpy(), "v": part["v"].to_numpy(), "own": own, "block": block_of[own], "blocks": asked, "cells": cells})

    placed = materialize(classes.select("rep", "mult", "v").mapInPandas(place, "rep bigint, mult bigint, v array<double>, own bigint, block bigint, blocks array<bigint>, cells array<array<bigint>>"), "placed")
    to = placed.select("rep", "mult", "v", "own", F.explode(F.arrays_zip("blocks", "cells")).alias("to"))
    asked = to.select("rep", "mult", "v", "own", F.col("to.blocks").alias("block"), F.col("to.cells").alias("cells"))
    base = placed.select("rep", "mult", "v", "own", "block", F.array().cast("array<bigint>").alias("cells"))
    visits = placed.select(F.explode("blocks").alias("block")).groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("nq"))
    parts = base.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / (2 * BASE_BLOCK)).alias("nb")).join(visits, "block")
    deal = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    asked, base = asked.join(parts, "block"), base.join(parts, "block")
    both = asked.withColumn("b", each("nb")).withColumn("q", deal("nq")).withColumn("asks", F.lit(True)).unionByName(base.withColumn("q", each("nq")).withColumn("b", deal("nb")).withColumn("asks", F.lit(False)))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        asks = pdf["asks"].to_numpy(bool)
        q, b = pdf[asks], pdf[~asks].sort_values("own", kind="stable")
        empty = pd.DataFrame({"u": [], "v": [], "n": []}).astype("int64")
        if not len(q) or not len(b):
            return empty
        qx, bx = _unit(q["v"].tolist()), _unit(b["v"].tolist())
        qi, bi = q["rep"].to_numpy(), b["rep"].to_numpy()
        qm, bm = q["mult"].to_numpy(), b["mult"].to_numpy()
        own, at = np.unique(q["own"].to_numpy(), return_inverse=True)
        in_cell = b["own"].to_numpy()
        got_q, got_b, ties = np.zeros(len(q), np.int64), np.zeros(len(b), np.int64), []
        lists = q["cells"].tolist()
        cells, row = np.concatenate([np.asarray(x, np.int64) for x in lists]), np.repeat(np.arange(len(q)), [*map(len, lists)])
        order = np.argsort(cells, kind="stable")
        cells, row = cells[order], row[order]
        edges = np.append(np.flatnonzero(np.diff(cells, prepend=-1)), len(cells))
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            lo, hi = np.searchsorted(in_cell, [cells[first], cells[first] + 1])
            if lo == hi:
                continue
            x, mult = bx[lo:hi], bm[lo:hi]
            for k in range(first, last, 256):
                s = row[k : min(k + 256, last)]
                link = (qx[s] @ x.T >= threshold) & (qi[s, None] != bi[None, lo:hi])
                if not link.any():
                    continue
                got_q[s] += link @ mult
                silent = ~index.visits(x, own[at[s]])  # base vectors that do not ask this visitor's cell themselves
                got_b[lo:hi] += (link & silent.T).T @ qm[s]
                i, j = np.nonzero(link)
                ties.append(_ties(qi[s][i], bi[lo:hi][j]))
        ids, counts = np.concatenate([qi, bi]), np.concatenate([got_q, got_b])
        held = counts > 0
        out = [pd.DataFrame({"u": ids[held], "v": ids[held], "n": counts[held]})]
        if ties:
            out.append(pd.concat([pd.DataFrame({"u": u, "v": r, "n": 0}) for u, r in ties]).drop_duplicates())
        return pd.concat(out) if held.any() else empty

    found = materialize(both.groupBy("block", "b", "q").applyInPandas(verify, "u bigint, v bigint, n bigint"), "links")
    counts = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    return counts.join(components(found.where("u <> v"), "u", "v").withColumnRenamed("node", "rep"), "rep", "left")


def brute_force(vectors: dict[int, list | None], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """(n_links, component) of few vectors, pair by pair (for tests)."""
    fine = {k: np.asarray(v, float) for k, v in vectors.items() if v is not None and len(v) and np.isfinite(np.asarray(v, float)).all() and np.any(v)}
    links = {k: set() for k in vectors}
    for a, b in itertools.combinations(fine, 2):
        x, y = fine[a], fine[b]
        if len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for k in sorted(vectors):
        if k not in out:
            seen, todo = {k}, [k]
            while todo:
                for x in links[todo.pop()] - seen:
                    seen.add(x)
                    todo.append(x)
            out |= {x: (len(links[x]), k) for x in seen}
    return out
