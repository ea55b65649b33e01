"""Mixing sources to target weights by a Pfair schedule of blocks.

Every source's documents are put in a random but reproducible order and cut into blocks. Time is counted
in slots of one block. With weight a of Q in all, block i of a source (from 1) is released at
floor((i - 1) Q / a) and due at ceil(i Q / a); in each slot the released block due first is taken. After t
slots a source has had between floor(t a / Q) and ceil(t a / Q) of them: less than one block off target.

Weights are whole numbers, so the schedule repeats after Q slots, their sum. Only this cycle is computed
ahead (its size depends on the weights, not on the data); each document finds its slot from its place in
its source. A source that has run out leaves its slots empty, and the others keep their order: all
documents are kept, once each.

Places are found without sorting a source in one task: rows are dealt by source and a range of their
hash, ranges are counted, and the counts before a range are added to the place within it.

Edge cases: a null source counts as the source with the empty name. Rows without doc_id come last within
their source. Repeated rows each have a place of their own. Sources without a weight get the default.
Empty tables give empty results. Extra columns are carried; ``slot`` and ``place`` take the place of
columns named so in ``mix``, and harm none in ``mixed_documents``.
"""

from __future__ import annotations

import heapq
import json
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 64           # documents of a block
RANGE_ROWS = 50_000  # rows that the largest source should have in a range of hashes

#: Target weights of the sources in the registered query and the pipeline; other sources get 1.
TARGETS = {f"src{k}": 1 + k % 4 for k in range(20)}


def cycle(weights: dict[str, int]) -> list[tuple[str, int, int]]:
    """(source, block within the cycle from 0, slot) by earliest deadline; ties by source name."""
    total = sum(weights.values())
    waiting = sorted((floor(Fraction(i * total, a)), ceil(Fraction((i + 1) * total, a)), s, i)
                     for s, a in weights.items() for i in range(a))[::-1]
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(total):
        while waiting and waiting[-1][0] <= slot:
            _, due, source, i = waiting.pop()
            heapq.heappush(ready, (due, source, i))
        _, source, i = heapq.heappop(ready)
        out.append((source, i, slot))
    return out


def _order() -> Column:
    return F.md5(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")))


def _slotted(docs: DataFrame, weights: dict[str, int] | None, default: int, block: int) -> DataFrame:
    """``row`` (the document), ``slot`` and ``place``."""
    weights = TARGETS if weights is None else weights
    named = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("src"))
    counts = {r["src"]: r["n"] for r in named.groupBy("src").agg(F.count("*").alias("n")).collect()}
    weights = {s: weights.get(s, default) for s in counts}
    total = sum(weights.values())
    # Hash ranges by leading hexadecimal digits, as many as the largest source needs.
    digits = 1
    while max(counts.values(), default=0) > RANGE_ROWS * 16 ** digits:
        digits += 1
    ranged = named.withColumn("order", _order()).withColumn(
        "range", F.when(F.col("row.doc_id").isNull(), F.lit("~")).otherwise(F.substring("order", 1, digits)))
    sizes = ranged.groupBy("src", "range").agg(F.count("*").alias("n"))
    before = sizes.select("src", "range", (F.sum("n").over(
        Window.partitionBy("src").orderBy("range")) - F.col("n")).alias("before"))
    within = Window.partitionBy("src", "range").orderBy("order", "row.doc_id", F.xxhash64("row.text"))
    placed = ranged.withColumn("within", F.row_number().over(within)).join(before, ["src", "range"]).withColumn(
        "at", F.col("before") + F.col("within") - 1)
    entries = [{"src": s, "k": k, "cycle_slot": slot, "share": weights[s]} for s, k, slot in cycle(weights)]
    plan = docs.sparkSession.range(1).select(F.explode(F.from_json(
        F.lit(json.dumps(entries)), "array<struct<src: string, k: long, cycle_slot: long, share: long>>")).alias("e")).select("e.*")
    shares = F.from_json(F.lit(json.dumps(weights)), "map<string, long>")
    number = F.floor(F.col("at") / block)
    slotted = placed.withColumn("share", F.element_at(shares, F.col("src"))).withColumn(
        "k", number % F.col("share")).withColumn("turn", F.floor(number / F.col("share"))).drop("share").join(plan, ["src", "k"])
    return slotted.select("row", (F.col("turn") * total + F.col("cycle_slot")).cast("long").alias("slot"),
                          (F.col("at") % block).cast("int").alias("place"))


def mix(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block: int = BLOCK) -> DataFrame:
    """The documents with ``slot`` (of the block) and ``place`` (within the block); unordered."""
    keep = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c not in ("slot", "place")]
    return _slotted(docs, weights, default, block).select(*keep, "slot", "place")


def mixed_documents(docs: DataFrame, weights: dict[str, int] | None = None, default: int = 1, block: int = BLOCK) -> DataFrame:
    """The documents with their own columns, in the order of the schedule: files in order, rows in order."""
    mixed = _slotted(docs, weights, default, block)
    return mixed.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select("row.*")
