"""LM scoring with a bigram trie in Elias-Fano levels, spread over shards.

Tokens are words (A-Z lower-cased) and one end per text. Words are counted exactly over all training
documents. The HEAD most frequent ones have numbers. The ``whole`` model tells all words apart:

    P1(w) = (c(w) + 1) / (N + V + 1)
    P(w | u) = (c(u w) + PRIOR P1(w)) / (c(u) + PRIOR)

Without ``whole``, words that have no number are one class, as context and as successor, within which a word has
its share of the unigram model:

    P(w | u) = P(class | u) P1(w) / P1(class)                        for a word of the class

Both sum to one over all words, one unseen word included.

Scoring is a shuffle of look-ups, not of the model: each batch of documents packs its (word pair,
document, count) entries per shard. A shard counts the pairs of the training documents, builds its trie,
answers all entries and returns one sum per document. Pairs of the HOT most frequent numbers are counted
in a small dense table instead and answered where they stand, so no pair left has more than about one in
HOT of all tokens. Words without a number are joined to their counts by Spark; in the whole model with what
precedes and follows them, and pairs that hold such a word are counted there. Documents are never shuffled.

Nothing of the corpus reaches the driver but the numbered words and the dense table, both bounded.

Edge cases: a null or empty text is one end token. Without training documents all counts are zero and
every probability is the unseen one. Rows without doc_id are training documents. Repeated rows count and
are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator
from math import ceil, log10

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickframe.llm.common import least_count, remainder, staged

HEAD = 1 << 18          # words with a number of their own
CLASS, END, START = 0, 1, 2
FIRST = 3               # number of the most frequent word
HOT = 256               # numbers whose pairs are counted densely
BITS = 20               # of a number
SHARD_ENTRIES = 2_000_000
PRIOR = 300.0
CODE = 1 / 2048         # step of a quantised log10 probability


# --- the trie ---------------------------------------------------------------------------------

class EliasFano:
    """A non-decreasing sequence: low bits packed apart, high bits in unary; sought by successor."""

    def __init__(self, values: np.ndarray, universe: int):
        self.n = len(values)
        self.low_bits = max(0, int(universe // max(self.n, 1)).bit_length() - 1)
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        ones = np.zeros(int(universe >> self.low_bits) + self.n + 2, np.uint8)
        ones[high + np.arange(self.n)] = 1
        self.upper = np.packbits(ones)
        mask = np.uint64((1 << self.low_bits) - 1)
        kind = np.uint8 if self.low_bits <= 8 else np.uint16 if self.low_bits <= 16 else np.uint32 if self.low_bits <= 32 else np.uint64
        self.lower = (values & mask).astype(kind)

    def arrays(self) -> list[np.ndarray]:
        return [self.upper, self.lower]

    def open(self, upper: np.ndarray, lower: np.ndarray) -> None:
        """Use mapped arrays; find where each bucket of equal high bits starts."""
        self.upper, self.lower = upper, lower
        ones = np.unpackbits(upper)
        self._starts = np.concatenate([[0], np.flatnonzero(ones == 0) - np.arange(int((ones == 0).sum()))])

    def get(self, at: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self._starts, at, side="right") - 1
        return (high.astype(np.uint64) << np.uint64(self.low_bits)) | self.lower[at].astype(np.uint64)

    def successor(self, values: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Per value the first place, from ``start`` and before ``stop``, that holds it or more; else ``stop``."""
        high = (values >> np.uint64(self.low_bits)).astype(np.int64)
        last = len(self._starts) - 1
        a, b = self._starts[np.minimum(high, last)], self._starts[np.minimum(high + 1, last)]
        if start is not None:
            a, b = np.clip(a, start, stop), np.clip(b, start, stop)
        low = values & np.uint64((1 << self.low_bits) - 1)
        while (open_ := a < b).any():
            middle = (a + b) // 2
            less = open_ & (self.lower[np.minimum(middle, self.n - 1)] < low)
            a, b = np.where(less, middle + 1, a), np.where(open_ & ~less, middle, b)
        return a


class Trie:
    """Two levels: contexts, and per context its successors, relative to it, with a quantised probability.

    A successor is stored as context place * 2**BITS + number, which never falls along the level. The
    levels lie in one unnamed temporary file, mapped to memory; it is gone when the trie is.
    """

    def __init__(self, contexts: np.ndarray, words: np.ndarray, log_p: np.ndarray):
        """Pairs sorted by context and word, without repeats."""
        unique, first = np.unique(contexts, return_index=True)
        place = np.repeat(np.arange(len(unique), dtype=np.uint64), np.diff(np.append(first, len(contexts))))
        span = max(len(unique), 1) << BITS
        self.size = len(words)
        self._levels = [
            EliasFano(unique.astype(np.uint64), 1 << BITS),
            EliasFano(np.append(first, len(contexts)).astype(np.uint64), len(contexts) + 1),
            EliasFano((place << np.uint64(BITS)) | words.astype(np.uint64), span)]
        codes = np.minimum(np.rint(-log_p / CODE), 65535).astype(np.uint16)
        arrays = [a for level in self._levels for a in level.arrays()] + [codes]
        with tempfile.TemporaryFile() as file:
            for a in arrays:
                file.write(a.tobytes())
                file.write(b"\0" * (-a.nbytes % 8))
            file.flush()
            whole = np.memmap(file, np.uint8, "r") if any(a.nbytes for a in arrays) else np.zeros(0, np.uint8)
        self.nbytes, at, mapped = len(whole), 0, []
        for a in arrays:
            mapped.append(whole[at:at + a.nbytes].view(a.dtype))
            at += a.nbytes + (-a.nbytes % 8)
        for k, level in enumerate(self._levels):
            level.open(mapped[2 * k], mapped[2 * k + 1])
        self._codes = mapped[-1]

    def log_p(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """log10 probability per pair; nan for a pair that is not held."""
        out = np.full(len(words), np.nan)
        if not self.size:
            return out
        ctx, starts, successors = self._levels
        place = ctx.successor(contexts.astype(np.uint64))
        known = np.flatnonzero(place < ctx.n)
        known = known[ctx.get(place[known]) == contexts[known].astype(np.uint64)]
        place = place[known]
        a, b = starts.get(place).astype(np.int64), starts.get(place + 1).astype(np.int64)
        wanted = (place.astype(np.uint64) << np.uint64(BITS)) | words[known].astype(np.uint64)
        at = successors.successor(wanted, a, b)
        held = at < b
        held[held] = successors.get(at[held]) == wanted[held]
        out[known[held]] = self._codes[at[held]] * -CODE
        return out


# --- packing ----------------------------------------------------------------------------------

def pack(sorted_codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Differences of sorted codes by byte plane, then the counts, compressed."""
    steps = np.diff(sorted_codes, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return zstandard.compress(steps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(packed), np.uint8)
    n = len(raw) // 12
    steps = np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.ascontiguousarray(raw[8 * n:].reshape(4, n).T).view("<u4").ravel()


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


# --- the job ----------------------------------------------------------------------------------

def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all whole texts; counted within each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(tokens(text))
            if len(held) > 300_000:
                yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())})

    return docs.select("text").mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Unigrams:
    """Counts of the numbered words, the class and the end, and what the formulas need of them."""

    def __init__(self, counts: np.ndarray, n: int, v: int):
        self.counts, self.n, self.v = counts, n, v
        self.log_total = log10(n + v + 1)

    def p1(self, held: int, held_words: int) -> np.ndarray:
        """P1 per number; the class holds ``held`` tokens of ``held_words`` words, and the unseen word."""
        p = (self.counts + 1.0) / (self.n + self.v + 1)
        p[CLASS] = (held + held_words + 1.0) / (self.n + self.v + 1)
        p[START] = 0
        return p


def score(docs: DataFrame, modulus: int = 7, held: int = 2, whole: bool = False) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per document.

    Documents whose crc32(doc_id as text) modulo ``modulus`` is ``held`` are held out of the training. ``whole`` counts
    the pairs of all words, also of those without a number.
    """
    marked = docs.select(F.col("doc_id"), "text", (remainder(F.col("doc_id"), modulus) == held).alias("held_out"))
    training = marked.filter(~F.col("held_out"))
    vocabulary = staged(word_counts(training), "lm-words")
    n_docs = training.count()
    found = vocabulary.agg(F.sum("n"), F.count("*")).first()
    n, v = (found[0] or 0) + n_docs, found[1] + (n_docs > 0)
    least = least_count(vocabulary, HEAD)
    head = vocabulary.filter(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    words = [bytes(w) for w in head["word"]]
    counts = np.concatenate([np.zeros(FIRST), head["n"].to_numpy(np.float64)])
    counts[CLASS], counts[END], counts[START] = n - n_docs - counts.sum(), n_docs, n_docs
    uni = Unigrams(counts, n, v)
    p1 = uni.p1(int(counts[CLASS]), found[1] - len(words))
    contexts = counts.copy()  # tokens that follow a number: as many as it has, and the start has one per text
    contexts[END] = 0
    shards = max(1, ceil((n + 1) * modulus / max(modulus - 1, 1) / SHARD_ENTRIES))

    def smooth(u: np.ndarray, w: np.ndarray, pairs: np.ndarray | float) -> np.ndarray:
        return np.log10((pairs + PRIOR * p1[w]) / (contexts[u] + PRIOR))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: k for k, w in enumerate(words, FIRST)}.get
        logs = np.log10(counts + 1)
        for batch in batches:
            if not len(batch):
                continue
            batch_id, us, ws, ds, rows, rare = int(batch["key"].iloc[0]), [], [], [], [], []
            for i, (doc_id, text, out) in enumerate(zip(batch["doc_id"], batch["text"], batch["held_out"])):
                found = tokens(text)
                ids = np.array([START, *[number(w, CLASS) for w in found], END], dtype=np.int64)
                us.append(ids[:-1])
                ws.append(ids[1:])
                ds.append(np.full(len(ids) - 1, i))
                plain, ctx_log = np.flatnonzero(ids == CLASS), 0.0
                if whole:
                    # A pair of two such words stands with the second one. Start and end are the empty word.
                    around = [b"", *found, b""]
                    others = Counter((around[k], around[k - 1], None) for k in plain)
                    others.update((around[k], around[k + 1], PRIOR * p1[ids[k + 1]]) for k in plain[ids[plain + 1] != CLASS])
                    rare += [(i, *key, m, out) for key, m in others.items()]
                    before = ids[plain - 1]
                    ctx_log = -float(np.log10(contexts[before[before != CLASS]] + PRIOR).sum())
                    us[-1], ws[-1], ds[-1] = (x[(ids[:-1] != CLASS) & (ids[1:] != CLASS)] for x in (us[-1], ws[-1], ds[-1]))
                else:
                    rare += [(i, w, None, None, m, out) for w, m in Counter(found[k - 1] for k in plain).items()]
                own = ids[1:][ids[1:] != CLASS]
                rows.append((i, doc_id, out, len(found) + 1, int((counts[own] > 0).sum()), float(logs[own].sum()),
                             len(ids) - 1 - len(own), ctx_log))
            docs_ = pd.DataFrame(rows, columns=["idx", "doc_id", "held_out", "n_tokens", "n_known", "log_sum", "n_class", "ctx_log"])
            yield _shaped(docs_.assign(kind="doc", batch=batch_id))
            if rare:
                yield _shaped(pd.DataFrame(rare, columns=["idx", "word", "other", "prior", "times", "held_out"]).assign(
                    kind="word", batch=batch_id))
            u, w, d = np.concatenate(us), np.concatenate(ws), np.concatenate(ds)
            codes, times = np.unique(
                ((u << BITS | w) << 16 | d).astype(np.uint64), return_counts=True)
            pair = codes >> np.uint64(16)
            hot = ((pair >> np.uint64(BITS)) < HOT) & ((pair & np.uint64((1 << BITS) - 1)) < HOT)
            to = np.where(hot, -1, (_mixed(pair) % np.uint64(shards)).astype(np.int64))
            flags = np.packbits(~batch["held_out"].to_numpy(bool)).tobytes()
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            parts = [(int(to[o[0]]), pack(codes[o], times[o])) for o in np.split(order, cuts) if len(o)]
            yield _shaped(pd.DataFrame(parts, columns=["shard", "packed"]).assign(
                kind="pair", batch=batch_id, flags=flags, idx=len(batch)))

    keyed = marked.withColumn("key", F.monotonically_increasing_id()).select(
        "key", F.col("doc_id").cast("string").alias("doc_id"), "text", "held_out")
    dealt = staged(keyed.mapInPandas(deal, _DEALT), "lm-dealt")
    pairs = dealt.filter("kind = 'pair'").select("shard", "batch", "packed", "flags", F.col("idx").alias("size"))

    # Pairs of frequent numbers: counted over all batches, then answered batch by batch.
    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = np.zeros(HOT * HOT)
        for batch in batches:
            for packed, flags in zip(batch["packed"], batch["flags"]):
                u, w, d, times = _entries(packed)
                keep = _flags(flags)[d]
                np.add.at(held, u[keep] * HOT + w[keep], times[keep])
        at = np.flatnonzero(held)
        yield pd.DataFrame({"code": at, "n": held[at].astype(np.int64)})

    hot_pairs = pairs.filter("shard = -1")
    table = np.zeros(HOT * HOT)
    for r in hot_pairs.select("packed", "flags").mapInPandas(dense, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        table[r["code"]] = r["n"]

    def answer_hot(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for packed, size in zip(batch["packed"], batch["size"]):
                u, w, d, times = _entries(packed)
                out.append(np.bincount(d, times * smooth(u, w, table[u * HOT + w]), minlength=size).tobytes())
            yield pd.DataFrame({"batch": batch["batch"], "sums": out})

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts = [_entries(p) for p in group["packed"]]
        keep = [_flags(f)[d] for f, (_, _, d, _) in zip(group["flags"], parts)]
        code = np.concatenate([(u << BITS | w)[k] for (u, w, _, _), k in zip(parts, keep)])
        held, where = np.unique(code, return_inverse=True)
        held_n = np.bincount(where, np.concatenate([t[k] for (_, _, _, t), k in zip(parts, keep)]), minlength=len(held))
        u, w = held >> BITS, held & ((1 << BITS) - 1)
        trie = Trie(u, w, smooth(u, w, held_n))
        out = []
        for (u, w, d, times), size in zip(parts, group["size"]):
            logs = trie.log_p(u, w)
            logs = np.where(np.isnan(logs), smooth(u, w, 0.0), logs)
            out.append(np.bincount(d, times * logs, minlength=size).tobytes())
        return pd.DataFrame({"batch": group["batch"], "sums": out})

    def add_up(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s) for s in group["sums"]], axis=0)
        return pd.DataFrame({"batch": group["batch"].iloc[0], "idx": np.arange(len(total)), "pair_sum": total})

    sums = pairs.filter("shard >= 0").groupBy("shard").applyInPandas(answer, "batch long, sums binary").union(
        hot_pairs.select("batch", "packed", "size").mapInPandas(answer_hot, "batch long, sums binary"))
    per_doc = sums.groupBy("batch").applyInPandas(add_up, "batch long, idx int, pair_sum double")
    around = dealt.filter("kind = 'word'").select("batch", "idx", "word", "other", "prior", "times", "held_out").join(
        vocabulary, "word", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "second": F.col("prior").isNull()})
    pair_log = F.lit(0.0)
    if whole:
        # Where the word comes second, what it adds as the context of its successor stands beside it.
        seen = F.sum(F.when(F.col("held_out"), 0).otherwise(F.col("times"))).over(Window.partitionBy("word", "other", "second"))
        around = around.withColumn("pairs", seen)
        as_second = F.log10(F.col("pairs") + PRIOR * (F.col("n") + 1) / (n + v + 1)) - F.log10(F.col("n") + PRIOR)
        pair_log = F.when(F.col("second"), as_second).otherwise(F.log10(F.col("pairs") + F.col("prior")))
    rare = around.groupBy("batch", "idx").agg(
        F.sum(F.when(F.col("second") & (F.col("n") > 0), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.when(F.col("second"), F.col("times") * F.log10(F.col("n") + 1.0)).otherwise(0.0)).alias("rare_log"),
        F.sum(F.col("times") * pair_log).alias("rare_pairs"))
    log_class = log10(p1[CLASS])
    rows = dealt.filter("kind = 'doc'").join(per_doc, ["batch", "idx"], "left").join(rare, ["batch", "idx"], "left")
    rare_log, n_class = F.coalesce("rare_log", F.lit(0.0)), F.col("n_class")
    return rows.select(
        F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("log_sum") + rare_log - F.col("n_tokens") * uni.log_total).alias("base_score"),
        (F.coalesce("pair_sum", F.lit(0.0)) + (F.coalesce("rare_pairs", F.lit(0.0)) + F.col("ctx_log") if whole else
                                               rare_log - n_class * (uni.log_total + log_class))).alias("score"))


_DEALT = ("kind string, batch long, idx int, doc_id string, held_out boolean, n_tokens long, n_known long, log_sum double, "
          "n_class long, ctx_log double, word binary, other binary, prior double, times long, shard int, packed binary, flags binary")


def _shaped(rows: pd.DataFrame) -> pd.DataFrame:
    """All columns of the dealt table; whole numbers that may be missing stay whole."""
    rows = rows.reindex(columns=[c.split()[0] for c in _DEALT.split(", ")])
    return rows.astype({c: "Int64" for c in ("n_tokens", "n_known", "n_class", "times", "shard")} | {"held_out": "boolean"} | {
        c: object for c in ("kind", "doc_id", "word", "other", "packed", "flags")} | {c: "float64" for c in ("ctx_log", "prior")})


def _mixed(code: np.ndarray) -> np.ndarray:
    x = code * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def _entries(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Context, word, document index and count of the entries of a packed row."""
    codes, times = unpack(packed)
    pair = (codes >> np.uint64(16)).astype(np.int64)
    return pair >> BITS, pair & ((1 << BITS) - 1), (codes & np.uint64(0xFFFF)).astype(np.int64), times


def _flags(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)
