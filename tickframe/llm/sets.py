"""Sets of 64-bit tokens: names, exact comparison of candidate pairs, and what rules a pair out before it.

Two sets of n and m tokens have a Jaccard similarity of a / b or more if they share at least a / (a + b) * (n + m) tokens, so if
they differ in at most (b - a) / (a + b) * (n + m).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import discard, staged

MARK_BITS = 24  # of the bit table that picks the texts of compared sets
HELD = 1 << 21   # tokens a task counts at once
TABLE = 1 << 18  # frequent tokens that are told apart
Tokens = Callable[[str | None], np.ndarray]


def set_key(found: np.ndarray) -> int:
    """Names a sorted set of tokens, as a signed 64-bit integer."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), len(found))).view(np.int64))


def parities(found: np.ndarray) -> np.ndarray:
    """One bit per slot, set if an odd number of tokens falls into it; two to four slots per token, 256 at least.

    Two maps differ in no more bits than their sets do in tokens. Slots are the lowest bits of a token, so the map of a larger size
    class folds onto that of a smaller one.
    """
    slots = max(256, 2 << len(found).bit_length())
    odd = np.bincount((found & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _folded(bits: Column, longs: Column) -> Column:
    """A map of parities, or that of twice the size folded to so many longs."""
    halves = F.zip_with(F.slice(bits, 1, longs), F.slice(bits, longs + 1, longs), lambda x, y: x.bitwiseXOR(y))
    return F.when(F.size(bits) > longs, halves).otherwise(bits)


def possible(alike: tuple[int, int]) -> Column:
    """Whether sizes (n, m) and reaches allow a pair to be alike; a reach is the most tokens that it may share."""
    total = F.col("n") + F.col("m")
    return ((F.least("n", "m") * alike[1] >= F.greatest("n", "m") * alike[0])
            & (F.least("reach", "other_reach").cast("long") * sum(alike) >= total * alike[0]))


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]], most: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal tokens added; if more than ``most`` remain, all are lowered by what the next one has.

    This is the merge of Misra-Gries summaries: a count is too low by at most all counts / ``most``.
    """
    tokens, at = np.unique(np.concatenate([t for t, _ in parts]), return_inverse=True)
    counts = np.bincount(at, weights=np.concatenate([c for _, c in parts]), minlength=len(tokens)).astype(np.int64)
    if len(tokens) > most:
        counts = counts - np.partition(counts, len(counts) - most - 1)[len(counts) - most - 1]
        tokens, counts = tokens[counts > 0], counts[counts > 0]
    return tokens, counts


def token_counts(docs: DataFrame, tokens: Tokens, table: int = TABLE) -> tuple[np.ndarray, np.ndarray]:
    """The tokens that occur in most sets, sorted, and their counts over all rows; at most ``table``.

    A task reports the tokens it has met twice, so a token's count is too low by at most one per task
    and the error of the task's own summary.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        waiting, n = [], 0
        for batch in batches:
            for text in batch["text"]:
                found = np.unique(tokens(text))
                waiting.append(found)
                n += len(found)
            if n > HELD:
                held, waiting, n = merged_counts([held, np.unique(np.concatenate(waiting), return_counts=True)], HELD), [], 0
        every, counts = merged_counts([held, np.unique(np.concatenate([np.zeros(0, np.uint64), *waiting]), return_counts=True)], HELD)
        often = counts > 1
        for a in range(0, int(often.sum()), 50_000):
            yield pd.DataFrame({"h": every[often][a:a + 50_000].view(np.int64), "n": counts[often][a:a + 50_000]})

    counted = docs.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "h").limit(table).toPandas()
    found, counts = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(found)
    return found[order], counts[order]


def nodes_of(signed: DataFrame) -> DataFrame:
    """One row per set of a table with doc_id, key, n and odd (the map of parities): its smallest doc_id, and the mark of a row that has it.

    Copies of a set are combined before the shuffle.
    """
    return staged(signed.groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("odd").alias("odd"), F.first(mark()).alias("mark")), "nodes")


def _near(pairs: DataFrame, nodes: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs whose sizes and maps of parities do not rule them out."""
    maps = nodes.select("key", "n", "odd")
    both = pairs.join(maps, "key").join(maps.toDF("other", "m", "others"), "other").filter(
        F.least("n", "m") * alike[1] >= F.greatest("n", "m") * alike[0])
    longs = F.least(F.size("odd"), F.size("others"))
    differ = F.aggregate(F.zip_with(_folded(F.col("odd"), longs), _folded(F.col("others"), longs), lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                         F.lit(0), lambda a, x: a + x).cast("long")
    near = staged(both.filter(differ * sum(alike) <= (F.col("n") + F.col("m")) * (alike[1] - alike[0])).select("key", "other"), "near")
    return near


def _marks(hashes: DataFrame) -> np.ndarray:
    """A table of 2**MARK_BITS bits with those of the hashes in column h set; a filter before an exact join."""
    at = F.shiftrightunsigned("h", 64 - MARK_BITS)
    words = hashes.groupBy(F.shiftright(at, 6).alias("at")).agg(
        F.expr(f"bit_or(shiftleft(1L, CAST(shiftrightunsigned(h, {64 - MARK_BITS}) & 63 AS INT)))").alias("bits")).toPandas()
    table = np.zeros(1 << (MARK_BITS - 6), np.int64)
    table[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.view(np.uint64)


def full_sets(docs: DataFrame, tokens: Tokens, wanted: DataFrame) -> DataFrame:
    """key and tokens, once per set of ``wanted`` (key and mark, the hash of the id of one row that has it). Texts are not shuffled."""
    table = _marks(wanted.select(F.col("mark").alias("h")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = batch["h"].to_numpy(np.int64).view(np.uint64) >> np.uint64(64 - MARK_BITS)
            picked = (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
            found = [np.unique(tokens(text)) for text in batch["text"][picked]]
            if found:
                yield pd.DataFrame({"key": [set_key(f) for f in found], "tokens": [f.view(np.int64) for f in found]})

    made = docs.select(mark().alias("h"), "text").mapInPandas(run, "key long, tokens array<long>")
    return made.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"])


def mark() -> Column:
    """By what a row is found again."""
    return F.xxhash64(F.col("doc_id").cast("long"))


def verified(docs: DataFrame, tokens: Tokens, pairs: DataFrame, nodes: DataFrame, alike: tuple[int, int]) -> DataFrame:
    """The pairs (key, other) that are alike, as a staged table; ``nodes`` is that of ``nodes_of``."""
    pairs = staged(pairs.distinct(), "pairs")
    near = _near(pairs, nodes, alike)
    keys = near.select("key").union(near.select("other")).distinct()
    wanted = staged(nodes.join(keys, "key", "left_semi").select("key", "mark"), "wanted")
    full = staged(full_sets(docs, tokens, wanted), "sets")
    both = near.join(full, "key").join(full.select(F.col("key").alias("other"), F.col("tokens").alias("others")), "other")
    shared = F.size(F.array_intersect("tokens", "others")).cast("long")
    total = F.size("tokens").cast("long") + F.size("others")
    found = staged(both.filter(shared * sum(alike) >= total * alike[0]).select("key", "other"), "alike")
    discard(pairs, near, wanted, full)
    return found


def all_of(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out
