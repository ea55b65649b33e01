"""SimHash near-duplicates: fingerprints linked by a sharded vantage-point tree, then grouped.

1. Fingerprints are computed per text in Arrow batches; equal ones are one point from here on.
2. The upper tree is built from a bounded sample of points. It only decides which shards meet, so a poor
   sample costs time, never a link.
3. Every point goes to its own side of each split; one that lies at most ``radius`` beyond the inner ball
   is copied inside as well. By the triangle inequality two linked points then meet in at least one shard.
4. A shard goes on splitting by the same rule and compares the rest exactly. It returns one link per point
   and leaf (to the smallest point reachable there), so a large group never emits its pairs.
5. Links become groups by alternating large-star and small-star steps, each a grouped minimum and a join.
6. ``one_per_group`` confirms these links by the exact Jaccard similarity and adds the pairs that fingerprints miss. Under any fixed order of shingles two sets that
   are ALIKE share one of the first n - ceil(ALIKE n) + 1 shingles of both, so a join of these prefixes misses
   no pair; each is confirmed by its exact Jaccard similarity. The order is by the number of documents that
   hold a shingle, counted over all of them, rare ones first: that saves candidates and loses none.

Nothing but the sample, the table of frequent shingles and two sums per step reaches the driver; the steps are staged in the shared folder.

Edge cases: a null text counts as empty; texts without words have fingerprint zero and link like any
other. Repeated rows have equal fingerprints and share a group. Rows with a null doc_id are grouped, but
never name a group (a group of only such rows has a null name). Empty tables give empty results. Extra
columns are ignored by ``groups`` and carried by ``one_per_group``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import discard, staged
from tickframe.llm.sets import all_of, nodes_of, parities, possible, set_key, token_counts, verified

SEED = 42
#: Multipliers that derive the hashes of further tables from the first one; table 0 uses the hash itself.
MIXER = 0x9E3779B97F4A7C15
SAMPLE = 32_768  # points the upper tree is built from
SHARD = 6_000    # points a shard should hold
DEAL = 20_000    # points a task sends to shards at once
LEAF = 384       # points compared all with all
ALIKE = (4, 5)   # least Jaccard similarity of near copies, as a fraction
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


# --- fingerprints -----------------------------------------------------------------------------

def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words (A-Z lower-cased); of all words if there are fewer."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, ends = b" ".join(found), np.cumsum([len(w) + 1 for w in found])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends[size - 1:] - 1).tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is set in over half of the hashes; 0 without hashes. As a signed 64-bit integer."""
    if not len(hashes):
        return 0
    octets = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def _rehashed(hashes: np.ndarray, table: int) -> np.ndarray:
    if not table:
        return hashes
    with np.errstate(over="ignore"):
        x = (hashes ^ np.uint64(table)) * np.uint64(MIXER)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(MIXER)
    return x ^ (x >> np.uint64(29))


def fingerprints(docs: DataFrame, shingle: int = 3, tables: int = 1) -> DataFrame:
    """doc_id and ``prints``, one fingerprint per table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                hashes = shingle_hashes(text, shingle)
                out.append([fingerprint(_rehashed(hashes, t)) for t in range(tables)])
            yield pd.DataFrame({"id": batch["id"], "prints": out})

    # Ids go through pandas as text, since a batch with a null would turn them to floats.
    made = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, "id string, prints array<long>")
    return made.select(F.col("id").cast("long").alias("doc_id"), "prints")


# --- vantage-point trees ----------------------------------------------------------------------

def _split(points: np.ndarray, radius: int) -> tuple[int, int, np.ndarray] | None:
    """Vantage point, ball radius and all distances, chosen so that both sides with copies stay small."""
    vantage = points[len(points) // 2]
    far = np.bitwise_count(points ^ vantage).astype(np.int64)
    upto = np.cumsum(np.bincount(far, minlength=65 + radius))
    inner, outer = upto[radius:], len(points) - upto[: len(upto) - radius]
    usable = (inner < len(points)) & (outer > 0)
    if not usable.any():
        return None
    cost = np.where(usable, inner.astype(float) ** 2 + outer.astype(float) ** 2, np.inf)
    return int(vantage), int(cost.argmin()), far


def build_tree(sample: np.ndarray, leaves: int, radius: int):
    """Nested (vantage point, ball radius, inner, outer); a leaf is None."""
    if leaves <= 1 or len(sample) < 8:
        return None
    cut = _split(sample, radius)
    if cut is None:
        return None
    vantage, ball, far = cut
    half = leaves / 2
    return (vantage, ball, build_tree(sample[far <= ball + radius], half, radius),
            build_tree(sample[far > ball], half, radius))


def route(points: np.ndarray, tree, radius: int) -> Iterator[tuple[str, np.ndarray]]:
    """(leaf name, indices of the points that belong there or overlap its boundary)."""
    todo = [("", tree, np.arange(len(points)))]
    while todo:
        name, node, own = todo.pop()
        if not len(own):
            continue
        if node is None:
            yield name, own
            continue
        vantage, ball, inner, outer = node
        far = np.bitwise_count(points[own] ^ np.uint64(vantage))
        todo.append((name + "i", inner, own[far <= ball + radius]))
        todo.append((name + "o", outer, own[far > ball]))


def _leaf_links(points: np.ndarray, radius: int) -> np.ndarray:
    """For each point the smallest index it reaches over links of this leaf; rows are compared in blocks."""
    label = np.arange(len(points))
    while True:
        new = label.copy()
        for a in range(0, len(points), 256):
            near = np.bitwise_count(points[a:a + 256, None] ^ points[None, :]) <= radius
            new[a:a + 256] = np.where(near, label[None, :], len(points)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def local_links(points: np.ndarray, radius: int) -> np.ndarray:
    """Index pairs that connect what is connected among ``points`` (distinct) by links of at most ``radius`` bits."""
    found, todo = [np.zeros((0, 2), np.int64)], [np.arange(len(points))]
    while todo:
        own = todo.pop()
        cut = _split(points[own], radius) if len(own) > LEAF else None
        if cut is not None:
            _, ball, far = cut
            inner, outer = own[far <= ball + radius], own[far > ball]
            # Where copies leave both sides nearly whole, splitting costs more than it saves.
            if len(inner) ** 2 + len(outer) ** 2 < 0.95 * len(own) ** 2:
                todo += [inner, outer]
                continue
        label = _leaf_links(points[own], radius)
        linked = label != np.arange(len(own))
        found.append(np.stack([own[linked], own[label[linked]]], axis=1))
    return np.unique(np.concatenate(found), axis=0)


def links(points: DataFrame, radius: int) -> DataFrame:
    """(a, b) node pairs that connect all points of one table within ``radius`` bits.

    ``points`` has ``tab``, ``print`` (distinct within a table) and ``node``, the value to return.
    """
    total = points.count()
    share = min(1.0, SAMPLE / max(total, 1))
    picked = points.filter(F.abs(F.xxhash64("print", "tab") % 1_000_000) < int(share * 1_000_000) + 1)
    sample = np.array([r[0] for r in picked.select("print").limit(2 * SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    tree = build_tree(np.sort(sample), max(1, total // SHARD), radius)

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if held:
            points_ = pd.concat(held, ignore_index=True)
            for name, own in route(points_["print"].to_numpy(np.int64).view(np.uint64), tree, radius):
                yield points_.iloc[own].assign(shard=name)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        node = group["node"].to_numpy(np.int64)
        pairs = local_links(group["print"].to_numpy(np.int64).view(np.uint64), radius)
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    spread = points.select("tab", "print", "node").repartition(max(1, total // DEAL), "print", "tab")
    dealt = spread.mapInPandas(deal, "tab int, print long, node long, shard string")
    return dealt.groupBy("tab", "shard").applyInPandas(link, "a long, b long")


# --- groups -----------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b); root is the smallest node reachable."""

    def checksum(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())

    now = staged(edges.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = checksum(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        now = staged(small.select("e.*").filter("u != v").distinct(), "links")
        after = checksum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _named(prints: DataFrame, radius: int, tables: int) -> DataFrame:
    """node and component_id for every node of a staged table of doc_id, prints and node."""
    nodes = prints.groupBy("node", "prints").agg(F.min("doc_id").alias("doc_id"))
    nodes = staged(nodes, "nodes")
    members = nodes.select("node", F.posexplode("prints").alias("tab", "print"))
    heads = members.groupBy("tab", "print").agg(F.min("node").alias("head"))
    edges = links(staged(heads.withColumnRenamed("head", "node"), "points"), radius)
    if tables > 1:
        edges = edges.union(members.join(heads, ["tab", "print"]).filter("node != head").select("node", "head"))
    roots = staged(nodes.select("node", "doc_id").join(components(edges), "node", "left").select(
        "node", "doc_id", F.coalesce("root", "node").alias("root")), "roots")
    # Staged before the join: beside an aggregation Spark cannot split a large group.
    names = staged(roots.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    return roots.join(names, "root").select("node", "component_id")


def _node(tables: int) -> Column:
    """Rows with the same fingerprints in all tables are one node; with one table that is the fingerprint."""
    return F.col("prints")[0] if tables == 1 else F.xxhash64("prints")


def groups(docs: DataFrame, shingle: int = 3, radius: int = 2, tables: int = 1) -> DataFrame:
    """doc_id, fingerprint (hex, of the first table) and component_id (the smallest doc_id of the group).

    Documents are linked if the fingerprints of any table differ in at most ``radius`` bits. More tables,
    each with its own hash, find more of the near copies whose distance varies around the radius.
    """
    prints = staged(fingerprints(docs, shingle, tables), "prints").withColumn("node", _node(tables))
    return prints.join(_named(prints, radius, tables), "node").select(
        "doc_id", F.lower(F.lpad(F.hex(F.col("prints")[0]), 16, "0")).alias("fingerprint"), "component_id")


# --- pairs by exact similarity ----------------------------------------------------------------

def frequent_shingles(docs: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that most documents hold, sorted, and in how many; all documents are counted."""
    return token_counts(docs, partial(shingle_hashes, size=shingle))


def _prefix(found: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a sorted set, rare ones first, of which two sets that are ALIKE share one."""
    held, counts = frequent
    if len(held):
        at = np.minimum(np.searchsorted(held, found), len(held) - 1)
        found = found[np.argsort(np.where(held[at] == found, counts[at], 0), kind="stable")]
    least = -(-ALIKE[0] * len(found) // ALIKE[1])
    return found[: len(found) - least + 1]


def signed(docs: DataFrame, shingle: int, frequent: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, fingerprint, and of the set of shingles its key, size, prefix and map of parities."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                hashes = shingle_hashes(text, shingle)
                found = np.unique(hashes)
                out.append((fingerprint(hashes), set_key(found), len(found), _prefix(found, frequent).view(np.int64), parities(found)))
            names = ["print", "key", "n", "prefix", "odd"]
            yield pd.DataFrame(out, columns=names).assign(id=batch["id"].to_numpy())[["id", *names]]

    made = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(
        run, "id string, print long, key long, n long, prefix array<long>, odd array<long>")
    return made.select(F.col("id").cast("long").alias("doc_id"), "print", "key", "n", "prefix", "odd")


def _candidates(prints: DataFrame, radius: int) -> DataFrame:
    """(key, other) of sets (key, print) whose fingerprints are equal or within ``radius`` bits, enough to connect them.

    A fingerprint counts repeated shingles, so one set may have several.
    """
    heads = staged(prints.groupBy(F.lit(0).alias("tab"), "print").agg(F.min("key").alias("node")), "points")
    near = links(heads, radius).select(F.col("a").alias("key"), F.col("b").alias("other"))
    same = prints.join(heads, "print").filter("key != node").select("key", F.col("node").alias("other"))
    return near.union(same)


def alike_links(docs: DataFrame, rows: DataFrame, nodes: DataFrame, shingle: int, radius: int) -> DataFrame:
    """(key, other) of sets that are ALIKE, enough of them to connect all that is connected.

    ``rows`` is what ``signed`` gives, staged, ``nodes`` its sets. Pairs that the fingerprints find come first. Then every set
    meets the leader of each of its prefix shingles, which joins a large group without its pairs: the set with the fewest
    shingles before it, since near copies have rare ones of their own and the text they were made from has none; then
    the pairs of sets that share a prefix shingle, are still apart and whose sizes and places in the order
    allow it. All are confirmed by their exact similarity.
    """
    tokens = partial(shingle_hashes, size=shingle)
    prints = rows.select("key", "print").distinct()
    found = [verified(docs, tokens, _candidates(prints, radius), nodes, ALIKE)]
    # Before the first shared shingle nothing is shared: the reach is what follows it.
    entries = rows.select("key", "n", F.posexplode("prefix").alias("pos", "h")).select("h", "key", "n", (F.col("n") - F.col("pos")).alias("reach"))
    shared = staged(entries.groupBy("h").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("h"), "shared")
    held = staged(entries.join(shared, "h").distinct().withColumn("comp", F.col("key")), "entries")
    discard(shared)
    other = F.struct(F.col("key").alias("other"), F.col("n").alias("m"), F.col("reach").alias("other_reach"), F.col("comp").alias("other_comp"))
    ordered = (F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other"))
    held = _apart(held, found)
    by = F.struct(F.col("n") - F.col("reach"), "key")
    first = staged(held.groupBy("h").agg(F.min_by(other, by).alias("o")).select("h", "o.*"), "leaders")
    pairs = held.join(first, "h").filter("comp != other_comp").filter(possible(ALIKE)).select(*ordered)
    found.append(verified(docs, tokens, pairs, nodes, ALIKE))
    discard(first)
    held = _apart(held, found)
    pairs = held.join(held.select("h", other.alias("o")).select("h", "o.*"), "h").filter("comp < other_comp").filter(
        possible(ALIKE)).select(*ordered)
    found.append(verified(docs, tokens, pairs, nodes, ALIKE))
    discard(held)
    return all_of(found)


def _apart(held: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The entries under their groups so far, of shingles that still hold two groups; ``held`` is discarded."""
    roots = components(all_of(found).toDF("a", "b")).distinct()
    named = staged(held.drop("comp").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "h", "key", "n", "reach", F.coalesce("root", "key").alias("comp")), "entries")
    discard(held)
    open_ = staged(named.groupBy("h").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("h"), "apart")
    left = staged(named.join(open_, "h"), "entries")
    discard(named, open_)
    return left


def one_per_group(docs: DataFrame, shingle: int = 5, radius: int = 3) -> DataFrame:
    """The documents with the smallest doc_id of their group, with all their columns.

    Groups are those of all documents ALIKE by their sets of shingles, directly or through others. Fingerprints find the nearer copies;
    at 0.8 two of them differ in some ten of 64 bits, where a tree has nothing left to prune, so ``alike_links``
    finds the others. Each link is confirmed.

    Rows that share an id are judged by their own texts; of those that are alike as well the first by text stays. Rows without an
    id stay as they are.
    """
    named = docs.filter(F.col("doc_id").isNotNull())
    rows = staged(signed(named, shingle, frequent_shingles(named, shingle)), "signed")
    nodes = nodes_of(rows)
    roots = components(alike_links(named, rows, nodes, shingle, radius).toDF("a", "b")).distinct()
    grouped = nodes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "doc_id", F.coalesce("root", "key").alias("root"))
    # One set per group: that of its smallest doc_id.
    chosen = staged(grouped.groupBy("root").agg(F.min(F.struct("doc_id", "key")).alias("c")).select("c.*"), "chosen")
    often = staged(rows.groupBy("doc_id").count().filter("count > 1").select("doc_id"), "often")
    discard(rows, nodes)
    once = chosen.join(often, "doc_id", "left_anti").select(F.col("doc_id").alias("chosen_id"))
    kept = docs.join(once, docs["doc_id"] == F.col("chosen_id"), "left_semi")
    return kept.union(_of_shared_ids(docs, often, chosen, shingle)).union(docs.filter(F.col("doc_id").isNull()))


def _of_shared_ids(docs: DataFrame, often: DataFrame, chosen: DataFrame, shingle: int) -> DataFrame:
    """Of the rows whose id others have too, one per chosen set."""
    own = docs.join(often.select(F.col("doc_id").alias("often_id")), docs["doc_id"] == F.col("often_id"), "left_semi").select(
        F.struct(*docs.columns).alias("row"))
    keyed = own.withColumn("key", _text_key(shingle)("row.text"))
    picked = keyed.join(chosen.select(F.col("doc_id").alias("chosen_id"), F.col("key").alias("chosen_key")),
                        (F.col("row.doc_id") == F.col("chosen_id")) & (F.col("key") == F.col("chosen_key")), "left_semi")
    first = F.row_number().over(Window.partitionBy("row.doc_id", "key").orderBy("row.text"))
    return picked.withColumn("place", first).filter("place = 1").select("row.*")


def _text_key(shingle: int):
    """The key of a text's set of shingles, as a function of a column."""

    def keys(texts: pd.Series) -> pd.Series:
        return pd.Series([set_key(np.unique(shingle_hashes(t, shingle))) for t in texts], dtype="int64")

    return F.pandas_udf(keys, "long")
