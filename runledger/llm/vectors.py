"""Embedding near-dedup: random-hyperplane sign hashing in several tables,
exact cosine verification, distributed connected components.

Equal vectors of a label are one class from the start.  A class meets another
in every table where the signs of all the table's hyperplanes agree.  Buckets
are split into chunks of bounded size, and each pair of chunks is compared as
one block of dot products in one task: no row is made per pair.  A pair counts
in the first table where it meets only, so link counts add up over tables.
A block gives each class its links and, for the components, edges that span
the block's links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store
from .components import components

LEAST_COSINE = 0.98
TABLES = 28
PLANES = 16
CHUNK = 256             # classes of a bucket that are compared as one side of a block
SEED = 20240607


def hyperplanes(dims: int, tables: int = TABLES, planes: int = PLANES, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((tables * planes, dims))


def _signatures(tables: int, planes: int, seed: int):
    powers = 1 << np.arange(planes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for dims, part in pdf.groupby(pdf["embedding"].map(len)):
                v = np.array(part["embedding"].tolist(), float)
                # scaled first: the squares of very large or small components stay finite
                v /= np.abs(v).max(axis=1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                signs = (v @ hyperplanes(int(dims), tables, planes, seed).T > 0).reshape(len(v), tables, planes)
                out.append(part.assign(unit=list(v), marks=list((signs * powers).sum(axis=2).astype("int32")))
                           [["class", "label", "copies", "unit", "marks"]])
            if out:
                yield pd.concat(out)
    return run


def _edges(a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that span the links between the classes of two chunks."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        p, q = root(int(a[i])), root(int(b[j]))
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.append((int(a[i]), int(b[j])))
    return out


def _block(rows: pd.DataFrame, least: float) -> tuple[list, list] | None:
    """(class, links) and edges of a block: one chunk with itself (side 0), or
    one chunk (side 1) with another (side 2).  Pairs that meet in an earlier
    table are left to it."""
    own = rows[rows["side"] < 2]
    other = rows[rows["side"] == 2] if int(rows["side"].iloc[0]) else own
    if own.empty or other.empty:
        return None
    linked = np.stack(own["unit"].tolist()) @ np.stack(other["unit"].tolist()).T >= least
    if other is own:
        linked = np.triu(linked, 1)
    i, j = np.nonzero(linked)
    if not len(i):
        return None
    table = int(rows["t"].iloc[0])
    if table:
        p, q = np.stack(own["marks"].tolist())[:, :table], np.stack(other["marks"].tolist())[:, :table]
        linked[i, j] = ~(p[i] == q[j]).any(axis=1)
    a, b = own["class"].to_numpy(), other["class"].to_numpy()
    to_own, to_other = linked @ other["copies"].to_numpy(), own["copies"].to_numpy() @ linked
    counts = [(c, n) for c, n in [*zip(a.tolist(), to_own.tolist(), strict=True),
                                  *zip(b.tolist(), to_other.tolist(), strict=True)] if n]
    return counts, _edges(a, b, linked)


def _verify(least: float):
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[list[pd.DataFrame]]:
        """The whole blocks of sorted rows, batch by batch; a block may go on in the next batch."""
        rest = None
        for pdf in batches:
            rows = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if rows.empty:
                continue
            key = rows["block"].to_numpy()
            cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
            parts = [rows.iloc[s:e] for s, e in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
            rest = parts.pop()
            yield parts
        if rest is not None:
            yield [rest]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for parts in blocks(batches):
            got = [x for x in (_block(p, least) for p in parts if len(p) > 1) if x]
            counts, edges = [c for x in got for c in x[0]], [e for x in got for e in x[1]]
            if counts:
                yield pd.DataFrame({
                    "class": [c for c, _ in counts] + [p for p, _ in edges],
                    "links": [n for _, n in counts] + [0] * len(edges),
                    "to": pd.array([None] * len(counts) + [q for _, q in edges], "Int64")})
    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, tables: int = TABLES, planes: int = PLANES,
                    chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """Near-duplicate vectors of ``vectors`` (vec_id, embedding, label).

    One row per row: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable), kept (the row's id is that one).  Vectors that
    are null, empty, zero, or hold null or non-finite components, and rows
    without a label or an id, link with nothing; nor do vectors of different
    lengths.  Repeated rows are rows of their own, linked with one another.
    An empty table gives no rows; other columns are not read.
    """
    e = F.col("embedding").cast("array<double>")
    sound = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & F.exists(e, lambda x: x != 0)
             & F.forall(e, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x)))
    rows = vectors.select("vec_id", "label", e.alias("embedding"), F.coalesce(sound, F.lit(False)).alias("sound"))
    classes = store(rows.filter("sound").groupBy("label", "embedding").agg(
        F.min("vec_id").alias("class"), F.count("*").alias("copies")), "classes")
    label = classes.schema["label"].dataType.simpleString()
    marked = store(classes.mapInPandas(
        _signatures(tables, planes, seed),
        f"class long, label {label}, copies long, unit array<double>, marks array<int>"), "marked")
    member = marked.select("class", F.concat("label", F.lit(":"), F.size("unit")).alias("space"),
                           F.posexplode("marks").alias("t", "mark"))
    bucket = ["space", "t", "mark"]
    sizes = member.groupBy(*bucket).agg(F.count("*").alias("n")).filter("n > 1").withColumn(
        "chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n")
    # a class's chunk meets every chunk of its bucket, its own included: as one side or the other
    dealt = member.join(sizes, bucket).withColumn("mine", F.pmod(F.xxhash64("class"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(
        "class", "t", F.xxhash64(*bucket, F.least("mine", "theirs"), F.greatest("mine", "theirs")).alias("block"),
        F.when(F.col("mine") == F.col("theirs"), 0).when(F.col("mine") < F.col("theirs"), 1).otherwise(2).alias("side"))
    blocks = dealt.join(marked.select("class", "copies", "unit", "marks"), "class").repartition("block", "t")
    found = store(blocks.sortWithinPartitions("block", "t", "class").mapInPandas(
        _verify(least), "class long, links long, to long"), "links")
    counts = found.filter("to is null").groupBy("class").agg(F.sum("links").alias("links"))
    groups = components(found.filter("to is not null").select(F.col("class").alias("a"), F.col("to").alias("b")))
    of = (classes.join(counts, "class", "left").join(groups, F.col("class") == F.col("node"), "left")
          .select(F.col("label").alias("of_label"), F.col("embedding").alias("of"),
                  (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                  F.coalesce("component", "class").alias("component")))
    linked = rows.join(of, F.col("sound") & (F.col("label") == F.col("of_label")) & (F.col("embedding") == F.col("of")), "left")
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                         F.coalesce("component", "vec_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
