"""Groups of texts whose word n-gram sets are alike (Jaccard), by a join on prefixes of token combinations.

Tokens are the 64-bit hashes of n-grams. Two sets of n and m tokens are alike if they share at least
ALIKE / (1 + ALIKE) * (n + m) of them; then each shares all but t = n - ceil(ALIKE * n) of its own.

1. All tokens of all texts are counted in the tasks (within a bounded error each) and summed. The most frequent
   ones form a table of fixed size. It fixes one order of tokens, rare ones first, and their class: a rare token is
   a signature by itself; of class k, signatures are combinations of k tokens. A class is split into
   sections by hash, more of them for larger sets, so that combinations grow with the prefix, not with its square.
   What the counts miss costs time, never a link: the argument below holds for any order and any classes.
2. A set's prefix is extended until its tokens of class k, less k - 1 per section, are t + 1 in all. Take the
   prefix that ends first: of its tokens at most t are missing in the other set, so in some section both prefixes
   share k tokens, and with them a signature. Sections depend on the size class of a set; a set that may
   have partners in the next class is indexed for both.
3. A pair's first common signature bounds what it can share: the tokens after it, and k - 1 per section before, but no rare
   token if it is a combination. Each signature carries this reach, so a pair that cannot meet the bound is left out before anything is compared.
4. Every set has a bit map of the parities of its tokens' slots. Two maps differ in no more bits than the sets do in
   tokens, so a pair whose maps differ too much is left out as well; what remains is compared exactly.
5. Sets that share a signature are first compared with one leader each, which joins a group of near copies without
   its pairs: the set with the fewest tokens before the signature, since near copies have rare tokens of their own where
   they were changed, and the text that they were made from has none. Signatures whose sets are all joined drop out. After
   a second leader, sets that are still apart are compared pair by pair. Every comparison counts the exact intersection of the sets.
6. Equal sets are one node from the start; links become groups by the star steps of ``simhash.components``.

Only the table of frequent tokens and two sums per star step reach the driver. Results equal those of comparing all pairs,
unless two different n-grams that meet in one comparison share their 64-bit hash.

Edge cases: a null text counts as empty; texts without words have an empty set and are linked with nothing. With fewer words
than n, all of them are one n-gram. Repeated rows have equal sets and share a group, also under one doc_id.
Rows with a null doc_id are grouped, but never name a group (a group of only such rows has a null name). Empty
tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import discard, staged
from tickframe.llm.sets import TABLE, all_of, merged_counts, nodes_of, parities, possible, set_key, token_counts, verified  # noqa: F401
from tickframe.llm.simhash import components, shingle_hashes

ALIKE = (85, 100)
CLASSES = (1_000, 100_000)  # from so many occurrences a token is of class 2, of class 3
SECTION = 6         # prefix tokens a section should hold
LEADERS = 2         # rounds of comparing with leaders
_MIX = 0x9E3779B97F4A7C15


class Frequent(NamedTuple):
    """Frequent tokens, sorted, their occurrences, and from where on they are of class 2 and 3."""

    tokens: np.ndarray
    counts: np.ndarray
    classes: tuple[int, int] = CLASSES


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ np.uint64(salt * 2 + 1)) * np.uint64(_MIX)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(_MIX)
    return x ^ (x >> np.uint64(29))


def frequent_tokens(docs: DataFrame, shingle: int, table: int = TABLE, classes: tuple[int, int] = CLASSES) -> Frequent:
    """The tokens that occur in most sets, counted over all rows; at most ``table``."""
    return Frequent(*token_counts(docs, partial(shingle_hashes, size=shingle), table), classes)


def errors(n: int) -> int:
    """How many tokens of a set of ``n`` an alike set may lack."""
    return n + (-ALIKE[0] * n // ALIKE[1])


def size_classes(n: int) -> list[int]:
    """The size class of a set, and the next one if a partner may be in it."""
    own, next_ = n.bit_length(), (n * ALIKE[1] // ALIKE[0]).bit_length()
    return [own] if own == next_ else [own, next_]


def signatures(found: np.ndarray, frequent: Frequent) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of a sorted set of tokens and the reach of each: how many tokens a pair that meets there may share."""
    n = len(found)
    if n * ALIKE[1] // ALIKE[0] == n and errors(n) == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)  # alike only to an equal set
    counts = np.zeros(n, np.int64)
    if len(frequent.tokens):
        at = np.minimum(np.searchsorted(frequent.tokens, found), len(frequent.tokens) - 1)
        counts = np.where(frequent.tokens[at] == found, frequent.counts[at], 0)
    order = np.argsort(counts, kind="stable")  # equal counts stay in the order of tokens
    found, counts = found[order], counts[order]
    width = 1 + (counts >= frequent.classes[0]) + (counts >= frequent.classes[1])
    singles = int((width == 1).sum())  # the order puts them first
    out, reach = [], []
    for size in size_classes(n):
        need = errors(n) + 1
        alone = min(singles, need)
        out.append(mixed(found[:alone], size))
        reach.append(n - np.arange(alone))
        if alone == need:
            continue
        sections = section_count(size)
        rest, k = found[singles:], width[singles:]
        section = (mixed(rest, 77) % np.uint64(sections)).astype(np.int64) + k * sections
        members: dict[int, list[int]] = {}
        for j, s in enumerate(section.tolist()):
            own = members.setdefault(s, [])
            own.append(j)
            need_now = len(own) >= k[j]
            alone += need_now
            if alone == need:
                break
        slack = {2: sections, 3: 3 * sections}
        for s, own in members.items():
            w = s // sections
            if len(own) >= w:
                picked = np.array(list(combinations(own, w)))
                sig = mixed(np.uint64(s) + np.zeros(len(picked), np.uint64), size)
                for c in range(w):
                    sig = mixed(sig ^ rest[picked[:, c]], c)
                out.append(sig)
                # Without a common single, which would be an earlier signature, nothing of the singles is shared.
                reach.append(n - singles - np.maximum(picked[:, -1] - slack[w], 0))
    return np.concatenate(out), np.concatenate(reach)


def section_count(size_class: int) -> int:
    """Sections of a class of tokens for sets of a size class."""
    return max(1, errors(1 << (size_class - 1)) // SECTION)


def _signed(docs: DataFrame, shingle: int, frequent: Frequent) -> DataFrame:
    """doc_id, key, n, signatures, reach and map of parities of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"]:
                found = np.unique(shingle_hashes(text, shingle))
                sigs, reach = signatures(found, frequent)
                rows.append((set_key(found), len(found), sigs.view(np.int64), reach.astype(np.int32), parities(found)))
            names = ["key", "n", "sigs", "reach", "odd"]
            yield pd.DataFrame(rows, columns=names).assign(id=batch["id"].to_numpy())[["id", *names]]

    # Ids go through pandas as text, since a batch with a null would turn them to floats.
    made = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(
        run, "id string, key long, n long, sigs array<long>, reach array<int>, odd array<long>")
    return made.select(F.col("id").cast("long").alias("doc_id"), "key", "n", "sigs", "reach", "odd")


def links(docs: DataFrame, signed: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """(key, other) of alike sets, enough of them to connect all that is connected.

    ``signed`` is a staged table of key, n, sigs and reach, ``nodes`` one of its sets.
    """
    entries = signed.select("key", "n", F.explode(F.arrays_zip("sigs", "reach")).alias("e")).select(
        F.col("e.sigs").alias("sig"), "key", "n", F.col("e.reach").alias("reach"))
    met = entries.groupBy("sig").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low < high").select("sig")
    # A set may have two combinations of one signature, and a text many copies: the farthest reach counts.
    met = staged(met, "met")
    held = staged(entries.join(met, "sig").groupBy("sig", "key", "n").agg(F.max("reach").alias("reach")).withColumn(
        "comp", F.col("key")), "entries")
    discard(met)
    other = F.struct(F.col("key").alias("other"), F.col("n").alias("m"), F.col("reach").alias("other_reach"),
                     F.col("comp").alias("other_comp"))
    ordered = (F.least("key", "other").alias("key"), F.greatest("key", "other").alias("other"))
    tokens = partial(shingle_hashes, size=shingle)
    found: list[DataFrame] = []
    for turn in range(LEADERS):
        by = F.struct(F.lit(0) if turn else F.col("n") - F.col("reach"), F.xxhash64("comp", F.lit(turn)), "key")
        leader = staged(held.groupBy("sig").agg(F.min_by(other, by).alias("o")).select("sig", "o.*"), "leaders")
        pairs = held.join(leader, "sig").filter("comp != other_comp").filter(possible(ALIKE)).select(*ordered)
        found.append(verified(docs, tokens, pairs, nodes, ALIKE))
        discard(leader)
        held = _apart(held, found)
    pairs = held.join(held.select("sig", other.alias("o")).select("sig", "o.*"), "sig").filter("comp < other_comp").filter(
        possible(ALIKE)).select(*ordered)
    found.append(verified(docs, tokens, pairs, nodes, ALIKE))
    discard(held)
    return all_of(found)


def _apart(held: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The entries under their groups so far, of signatures that still hold two groups; ``held`` is discarded."""
    roots = components(all_of(found).toDF("a", "b")).distinct()
    named = staged(held.drop("comp").join(roots.select(F.col("node").alias("key"), "root"), "key", "left").select(
        "sig", "key", "n", "reach", F.coalesce("root", "key").alias("comp")), "entries")
    discard(held)
    open_ = staged(named.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("sig"), "open")
    left = staged(named.join(open_, "sig"), "entries")
    discard(named, open_)
    return left


def groups(docs: DataFrame, shingle: int = 4, table: int = TABLE, classes: tuple[int, int] = CLASSES) -> DataFrame:
    """doc_id, n_shingles (size of its set), component_id (smallest doc_id reachable over links, itself included)."""
    frequent = frequent_tokens(docs, shingle, table, classes)
    rows = staged(_signed(docs, shingle, frequent), "signed")
    some = rows.filter("n > 0")
    nodes = nodes_of(some)
    roots = components(links(docs, some, nodes, shingle).toDF("a", "b")).distinct()
    named = staged(nodes.select("key", "doc_id").join(roots.withColumnRenamed("node", "key"), "key", "left").select(
        "key", "doc_id", F.coalesce("root", "key").alias("root")), "roots")
    # Staged before the join: beside an aggregation Spark cannot split a large group.
    names = staged(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    named = staged(named.join(names, "root").select("key", "component_id"), "named")
    whole = rows.select("doc_id", "key", "n").join(named, "key", "left")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")).alias("component_id"))
