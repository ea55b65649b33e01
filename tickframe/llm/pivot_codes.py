"""Product codes of vectors, with assignments pruned by fixed pivots (LAESA).

Components become whole numbers, vectors are cut into equal parts, and every part position has a codebook
that is refined in rounds: each part is assigned to its nearest entry, then each entry becomes the mean of
its parts, rounded down.

1. A few pivots per part position are fixed at the start. The distance of every part to every pivot is
   computed once and stored beside it.
2. In a round only the entries' distances to the pivots are new. For a part x, an entry e and any pivot p,
   abs(d(x, p) - d(e, p)) is at most d(x, e): the largest of these differences bounds the distance from below.
3. Entries are tried in ascending bound, by exact whole-number distances. A part is done once the next bound
   lies above its best distance; bounds are lowered by more than their rounding error, so no tie is cut off.
4. A task returns sums and counts per entry. Codebooks have a fixed size, so the driver holds them whole; the
   rows never reach it.

Edge cases: a vector that is null, empty, or holds a null or non-finite component is dropped. Rows without an
id are coded, but are not among the first entries. Repeated rows and ids are rows each; initial entries are the
smallest by id, then by vector. Fewer vectors than entries give smaller codebooks. No vectors: no rows.
Equal distances go to the lower index. Vectors of different lengths, a length that is no multiple of the number of
parts, or a component outside +-2**26 after scaling raise an error. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import staged
from tickframe.llm.topk import whole

PARTS, ENTRIES, ROUNDS, PIVOTS, SCALE = 4, 256, 4, 8, 1024
LIMIT = 1 << 26   # of a component, so that squared distances fit in 64 bits
WAVE = 4          # entries tried at once before the bounds are looked at again


class Nearest(NamedTuple):
    entry: np.ndarray
    error: np.ndarray
    tried: int  # exact distances computed


def pivots_of(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Up to ``n`` entries far from each other: each is the one farthest from those before it."""
    chosen = [0]
    far = ((entries - entries[0]) ** 2).sum(axis=1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((entries - entries[chosen[-1]]) ** 2).sum(axis=1))
    return entries[chosen]


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all parts (rows) to all pivots (columns)."""
    out = np.empty((len(parts), len(pivots)))
    for k, p in enumerate(pivots):
        out[:, k] = np.sqrt(((parts - p) ** 2).sum(axis=1))
    return out


def nearest(parts: np.ndarray, known: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> Nearest:
    """The nearest entry of every part; ``known`` are the parts' distances to the pivots."""
    rows, k = len(parts), len(entries)
    own = pivot_distances(entries, pivots)
    bound = np.zeros((rows, k))
    for p in range(known.shape[1]):
        np.maximum(bound, np.abs(known[:, p, None] - own[None, :, p]), out=bound)
    # Bounds above the best squared distance end the search; lowered by more than any rounding error.
    bound = np.maximum(bound * (1 - 1e-9) - 1e-6, 0) ** 2 * (1 - 1e-9)
    order = np.argsort(bound, axis=1)
    best, entry = np.full(rows, np.iinfo(np.int64).max), np.zeros(rows, np.int64)
    open_, tried = np.arange(rows), 0
    for at in range(0, k, WAVE):
        next_ = order[open_, at]
        open_ = open_[bound[open_, next_] <= best[open_]]
        if not len(open_):
            break
        wave = order[open_, at:at + WAVE]
        far = ((parts[open_, None, :] - entries[wave]) ** 2).sum(axis=2)
        tried += far.size
        for j in range(wave.shape[1]):
            d, e = far[:, j], wave[:, j]
            nearer = (d < best[open_]) | (d == best[open_]) & (e < entry[open_])
            best[open_[nearer]], entry[open_[nearer]] = d[nearer], e[nearer]
    return Nearest(entry, best, tried)


def stored(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label") -> DataFrame:
    """vec_id, label and v (whole components) of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(label_column).alias("label"),
                          whole(F.col(vector_column), SCALE).alias("v")).filter(F.col("v").isNotNull())
    fits = F.forall("v", lambda x: F.abs(x) <= LIMIT)
    return rows.withColumn("v", F.when(fits, F.col("v")).otherwise(
        F.raise_error(F.lit(f"a component lies outside +-{LIMIT} after scaling")).cast("array<bigint>")))


def _parts(values: pd.Series, parts: int, width: int) -> np.ndarray:
    """Vectors as (row, part, component)."""
    if any(len(v) != width for v in values):
        raise ValueError("vectors differ in length")
    return np.array(values.to_list(), dtype=np.int64).reshape(len(values), parts, width // parts)


class Codes(NamedTuple):
    rows: DataFrame           # vec_id, label, code, error
    codebooks: list[np.ndarray]


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, pivots: int = PIVOTS,
           **columns: str) -> Codes:
    """vec_id, label, code (one index per part) and error (squared distance) of every vector, and the codebooks."""
    rows = stored(vectors, **columns)
    first = rows.filter(F.col("vec_id").isNotNull()).orderBy("vec_id", "v").limit(entries).select("v").collect()
    layout = "vec_id long, label string, code array<int>, error long"
    if not first:
        first = rows.orderBy("v").limit(entries).select("v").collect()  # rows without ids only
    if not first:
        return Codes(vectors.sparkSession.createDataFrame([], layout), [])
    width = len(first[0][0])
    if width % parts:
        raise ValueError(f"vectors of {width} components cannot be cut into {parts} equal parts")
    initial = _parts(pd.Series([r[0] for r in first]), parts, width)
    books = [initial[:, j].copy() for j in range(parts)]
    fixed = [pivots_of(b, pivots) for b in books]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            v = _parts(batch["v"], parts, width)
            known = np.concatenate([pivot_distances(v[:, j], fixed[j]) for j in range(parts)], axis=1)
            yield batch.assign(known=list(known))

    # Ids go through pandas as text, since a batch with a null would turn them to floats.
    ready = staged(rows.withColumns({c: F.col(c).cast("string") for c in ("vec_id", "label")}).mapInPandas(
        measure, "vec_id string, label string, v array<long>, known array<double>").withColumn("v", F.col("v").cast("array<int>")), "parts")
    starts = np.cumsum([0, *[len(p) for p in fixed]])

    def assigned(batch: pd.DataFrame, books: list[np.ndarray]) -> tuple[np.ndarray, list[Nearest]]:
        v, known = _parts(batch["v"], parts, width), np.array(batch["known"].to_list())
        return v, [nearest(v[:, j], known[:, starts[j]:starts[j + 1]], books[j], fixed[j]) for j in range(parts)]

    def summed(books: list[np.ndarray]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            count = [np.zeros(len(b), np.int64) for b in books]
            total = [np.zeros(b.shape, np.int64) for b in books]
            for batch in batches:
                if len(batch):
                    v, found = assigned(batch, books)
                    for j, f in enumerate(found):
                        count[j] += np.bincount(f.entry, minlength=len(books[j]))
                        np.add.at(total[j], f.entry, v[:, j])
            for j in range(parts):
                used = np.flatnonzero(count[j])
                yield pd.DataFrame({"part": j, "entry": used, "n": count[j][used], "total": list(total[j][used])})
        return run

    at_most = width // parts
    for _ in range(rounds):
        sums = ready.select("v", "known").mapInPandas(summed(books), "part int, entry int, n long, total array<long>")
        merged = sums.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), *[F.sum(F.col("total")[c]).alias(f"t{c}") for c in range(at_most)]).collect()
        new = [b.copy() for b in books]
        for r in merged:
            new[r["part"]][r["entry"]] = [r[f"t{c}"] // r["n"] for c in range(at_most)]
        books = new

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                _, found = assigned(batch, books)
                yield pd.DataFrame({
                    "vec_id": batch["vec_id"], "label": batch["label"],
                    "code": list(np.stack([f.entry for f in found], axis=1).astype(np.int32)),
                    "error": np.sum([f.error for f in found], axis=0)})

    coded = ready.mapInPandas(code, "vec_id string, label string, code array<int>, error long")
    return Codes(coded.withColumn("vec_id", F.col("vec_id").cast("long")), books)


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal text, by part, entry and position."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel()).encode()).hexdigest()


def digests(vectors: DataFrame, **columns: str) -> DataFrame:
    """vec_id, code (two hex digits per part), error, the summed error of its label, and the codebooks' hash."""
    rows, books = encode(vectors, **columns)
    rows = staged(rows.select("vec_id", "label", F.lower(F.array_join(F.transform(
        "code", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("code"), "error"), "codes")
    # Staged before the join: beside an aggregation Spark cannot split a large label.
    labels = staged(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    named = labels.select(F.col("label").alias("other"), "label_error")
    return rows.join(named, F.col("label").eqNullSafe(F.col("other"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
