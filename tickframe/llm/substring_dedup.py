"""Substring dedup: a relative Lempel-Ziv parse of every document against the documents before it.

The reference is the whole corpus in doc_id order. In every window of WINDOW words the SEED words with the
smallest hash are its anchor, so equal passages have equal anchors wherever they stand. The words of all
windows of one anchor are a block; blocks overlap and together hold every window of a document once.

1. All blocks are written once, as hashes. The index maps a seed to the smallest document that holds it.
2. A document is factored against the indexed blocks: a block equal to one of an earlier document is a
   match, and matches that follow each other extend a factor. All windows inside a factor are duplicates.
3. At factor boundaries a block differs, though some of its windows may still repeat. Where a seed stands
   in different blocks, the windows of the unmatched ones are compared one by one, by 128-bit hashes. The
   first document to hold a window never has it inside a factor, so the smallest doc_id is exact.
4. Windows found either way become spans; their words are removed.

Windows without a seed in two documents are never shuffled. Grouped minima combine before the shuffle and
hot seeds meet only in joins, which Spark splits; no task sees all documents of a passage.

Edge cases: null and empty texts have no words and lose none. Texts shorter than a window lose none. Rows
without doc_id neither lose words nor serve as reference. Rows with the same doc_id are not smaller than
each other: each is judged on its own text. Extra columns are carried by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import staged

WINDOW = 50
SEED = 8
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


# --- hashes of runs of words ------------------------------------------------------------------

def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, at least ``size`` of each."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < size:
        size = 1 << max(12, size.bit_length())
        known = []
        for b in (base, pow(base, -1, 1 << 64)):
            run = np.full(size, b, np.uint64)
            run[0] = 1
            known.append(np.multiply.accumulate(run))
        known = _POWERS[base] = (known[0], known[1])
    return known


class Runs:
    """Hashes of any run of words of one text, from prefix sums."""

    def __init__(self, found: list[bytes]):
        self.n = len(found)
        digest = xxhash.xxh3_64_intdigest
        self.words = np.array([digest(w) for w in found], dtype=np.uint64)
        self._sums: dict[int, np.ndarray] = {}

    def hashes(self, starts: np.ndarray, stops: np.ndarray, which: int = 0) -> np.ndarray:
        up, down = _powers(_BASES[which], self.n + 1)
        if which not in self._sums:
            self._sums[which] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * up[: self.n], dtype=np.uint64)])
        sums = self._sums[which]
        x = (sums[stops] - sums[starts]) * down[starts]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def anchors(runs: Runs) -> np.ndarray:
    """The place of the anchor of every window; it never falls from one window to the next."""
    if runs.n < WINDOW:
        return np.zeros(0, np.int64)
    starts = np.arange(runs.n - SEED + 1)
    seeds = runs.hashes(starts, starts + SEED)
    near = np.lib.stride_tricks.sliding_window_view(seeds, WINDOW - SEED + 1)
    return near.argmin(axis=1) + np.arange(len(near))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _block_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per block: hash of the seed, hash of the block, its first window and the number of its windows."""
    for batch in batches:
        out = []
        for doc_id, rid, text in zip(batch["doc_id"], batch["rid"], batch["text"]):
            runs = Runs((text or "").encode().split())
            places, first, n = np.unique(anchors(runs), return_index=True, return_counts=True)
            if not len(places):
                continue
            block = runs.hashes(first, first + n - 1 + WINDOW)
            # Equal words with the anchor elsewhere are not the same windows.
            block ^= (places - first).astype(np.uint64) * np.uint64(_BASES[0])
            out.append(pd.DataFrame({
                "seed": _signed(runs.hashes(places, places + SEED)), "block": _signed(block), "doc_id": doc_id, "rid": rid,
                "pos": first.astype(np.int32), "n": n.astype(np.int32)}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The windows of the blocks asked for, each with its hash."""
    for batch in batches:
        out = []
        for doc_id, rid, text, blocks in zip(batch["doc_id"], batch["rid"], batch["text"], batch["blocks"]):
            runs = Runs((text or "").encode().split())
            at = np.unique(np.concatenate([np.arange(b["pos"], b["pos"] + b["n"]) for b in blocks]))
            out.append(pd.DataFrame({
                "doc_id": doc_id, "rid": rid, "pos": at.astype(np.int32),
                "h1": _signed(runs.hashes(at, at + WINDOW)), "h2": _signed(runs.hashes(at, at + WINDOW, 1))}))
        if out:
            yield pd.concat(out, ignore_index=True)


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text, and a key that tells rows with the same doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("rid"), "text")


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, rid and ``spans``: word ranges [pos, stop) covered by windows that start in an earlier document."""
    keyed = _keyed(docs).filter(F.col("doc_id").isNotNull())
    blocks = staged(keyed.mapInPandas(
        _block_rows, "seed long, block long, doc_id long, rid int, pos int, n int"), "blocks")
    # Grouped tables are staged before they are joined: beside an aggregation Spark cannot split a hot seed.
    seeds = staged(blocks.groupBy("seed").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
        F.min("block").alias("low"), F.max("block").alias("high")).filter("first < last"), "seeds")
    # Blocks of one seed that are all alike are settled by it; only the others need their own first document.
    shared = staged(blocks.join(seeds.select("seed", "first", (F.col("low") < F.col("high")).alias("differ")), "seed"), "shared")
    differ = shared.filter("differ")
    own = staged(differ.groupBy("seed", "block").agg(F.min("doc_id").alias("own_first")), "own")
    differ = staged(differ.join(own, ["seed", "block"]).select("doc_id", "rid", "pos", "n", "own_first"), "differ")
    matched = shared.filter("NOT differ AND doc_id > first").select("doc_id", "rid", "pos", "n").union(
        differ.filter("doc_id > own_first").select("doc_id", "rid", "pos", "n"))
    ask = differ.filter("doc_id = own_first").groupBy("doc_id", "rid").agg(F.collect_set(F.struct("pos", "n")).alias("blocks"))
    windows = staged(keyed.join(ask, ["doc_id", "rid"]).mapInPandas(
        _window_rows, "doc_id long, rid int, pos int, h1 long, h2 long"), "windows")
    first = staged(windows.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last"), "first")
    again = windows.join(first, ["h1", "h2"]).filter("doc_id > first")
    found = matched.select("doc_id", "rid", "pos", (F.col("pos") + F.col("n") - 1 + WINDOW).alias("stop")).union(
        again.select("doc_id", "rid", "pos", (F.col("pos") + WINDOW).alias("stop")))
    return found.groupBy("doc_id", "rid").agg(F.collect_set(F.struct("pos", "stop")).alias("spans"))


def _removed(n: int, found) -> np.ndarray:
    """Per word whether a span covers it."""
    change = np.zeros(n + 1, np.int64)
    for r in found if found is not None else ():
        change[r["pos"]] += 1
        change[r["stop"]] -= 1
    return np.cumsum(change)[:n] > 0


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space) per document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, found in zip(batch["text"], batch["spans"]):
                words = (text or "").encode().split()
                gone = _removed(len(words), found)
                kept = [w for w, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            rows = pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])
            yield pd.concat([batch[["id"]].reset_index(drop=True), rows], axis=1)

    joined = _keyed(docs).join(spans(docs), ["doc_id", "rid"], "left").select(
        F.col("doc_id").cast("string").alias("id"), "text", "spans")  # as text, since a batch with a null would turn to floats
    made = joined.mapInPandas(run, "id string, n_words long, n_removed long, kept_sha256 string")
    return made.select(F.col("id").cast("long").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def cut(text: str, found) -> str:
    """The text without the words of the spans and the spaces after them; all else is unchanged."""
    places = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    gone = _removed(len(places), found)
    starts = [a for a, _ in places[1:]] + [len(text)]
    kept = [text[: places[0][0]]] if places else [text]
    return "".join(kept + [text[a:b] for (a, _), b, g in zip(places, starts, gone) if not g])


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their columns, texts cut (and n_chars, if there, counted anew). No row is dropped."""
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {c: batch.column(k) for k, c in enumerate(names)}
            found = batch.column(len(names)).to_pylist()
            texts = columns["text"].to_pylist()
            texts = [t if s is None else cut(t, s) for t, s in zip(texts, found)]
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                old = columns["n_chars"]
                counted = [c if s is None else len(t) for t, s, c in zip(texts, found, old.to_pylist())]
                columns["n_chars"] = pa.array(counted, old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    keys = [F.col("doc_id").cast("long").alias("key_id"), F.hash("text").alias("key_rid")]
    rows = docs.select(F.struct(*names).alias("row"), *keys)
    found = spans(docs).select(F.col("doc_id").alias("key_id"), F.col("rid").alias("key_rid"), "spans")
    joined = rows.join(found, ["key_id", "key_rid"], "left").select("row.*", "spans")
    return joined.mapInArrow(run, docs.schema)
