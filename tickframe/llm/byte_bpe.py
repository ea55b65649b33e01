"""Byte-level BPE: encode whole texts to token ids and decode ids to bytes.

* A text is cut by the vocabulary's pattern; each match is encoded by itself.
* The distinct words that are frequent in a bounded sample of documents are encoded first, by Spark
  expressions: a fold over the array of a word's bytes merges, at each step, the adjacent pair of lowest
  rank (the leftmost of equals) until no pair has a rank. Ranks are a constant of the plan, in buckets by
  hash, so that a look-up touches a few entries.
* Texts are then encoded in Arrow batches: frequent words are looked up, other words take the same merges
  in the task that meets them, with a bounded memory of the latest ones. The table of frequent words is
  only a cache; results do not depend on it.

A fold for every word of every text was measured at 230 microseconds a word, some fifteen times what the
merges cost in a task; the fold therefore serves the words that make up most of a text, once each.

No shuffle of texts; nothing of the corpus reaches the driver but the cache, whose size is bounded.

Edge cases: a null text encodes as an empty one, to no ids. Text is ordinary text: strings that look
like special tokens are not special. Very long matches are merged by a heap, in n log n steps. Repeated
rows are encoded alike; extra columns are carried (``ids`` and ``bytes`` take the place of such columns).
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickframe.llm.common import least_count, staged

#: White space by the Unicode property, as the pattern's ``\s`` means it.
_SPACE = r"\t\n\x0B\f\r\x20\x85\xA0  -     　"
BUCKETS = 1 << 14
SAMPLE_DOCS = 20_000   # documents whose words may enter the cache
CACHE_WORDS = 100_000  # words the cache may hold
RECENT = 200_000       # other words a task remembers
LONG = 64              # bytes of a match from which a heap finds the pairs


def spelled(pattern: str) -> str:
    """The pattern with ``\\s`` and ``\\S`` spelled out, since engines differ on them."""
    return (pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\S", f"[^{_SPACE}]").replace(r"\s", f"[{_SPACE}]"))


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id from a rank file (base64 and rank per line)."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return [token for token, _ in sorted(ranks.items(), key=lambda x: x[1])]


def _buckets(entries: DataFrame) -> Column:
    """``entries`` (key, value) as one constant: maps in buckets by the hash of their keys, for ``_look_up``."""
    spark = entries.sparkSession
    bucket = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).alias("bucket")
    full = entries.select(bucket, F.struct("key", "value").alias("e")).groupBy("bucket").agg(F.collect_list("e").alias("e"))
    every = spark.range(BUCKETS).select(F.col("id").alias("bucket")).join(full, "bucket", "left")
    one = every.agg(F.sort_array(F.collect_list(F.struct("bucket", "e"))).alias("all"))
    return one.select(F.transform("all", lambda x: F.map_from_entries(x["e"])).alias("all")).scalar()


def _look_up(buckets: Column, key: Column) -> Column:
    return F.element_at(F.element_at(buckets, (F.pmod(F.xxhash64(key), F.lit(BUCKETS)) + 1).cast("int")), key)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _with_constants(df: DataFrame, constants: dict[str, Column], body) -> DataFrame:
    """Add ``made`` = body(constants). Each constant, a scalar subquery, is named once, so that the optimizer
    puts it into the expression instead of copying it into every row."""
    held = df.select("*", *[c.alias(name) for name, c in constants.items()])
    return held.select(*[F.col(c) for c in df.columns], _let(F.struct(*constants), body).alias("made"))


def fold(word: Column, ranks: Column) -> Column:
    """The token ids of one match: its bytes, merged pair by pair in order of rank."""
    none = F.lit(2**31 - 1)
    octets = F.regexp_extract_all(F.hex(F.encode(word, "UTF-8")), F.lit(".."), F.lit(0))

    def rank(pair: Column) -> Column:
        return F.coalesce(_look_up(ranks, pair), none)

    def step(s: Column) -> Column:
        """Merge the pair at the first lowest rank; the pairs beside it get new ranks."""
        p, r = s["pieces"], s["ranks"]

        def at(i: Column) -> Column:
            pair = F.concat(F.get(p, i - 1), F.get(p, i))
            before = F.when(i > 1, F.array(rank(F.concat(F.get(p, i - 2), pair)))).otherwise(F.array().cast("array<int>"))
            after = F.when(i + 1 < F.size(p), F.array(rank(F.concat(pair, F.get(p, i + 1))))).otherwise(F.array().cast("array<int>"))
            return F.struct(
                F.concat(F.slice(p, F.lit(1), i - 1), F.array(pair), F.slice(p, i + 2, F.size(p))).alias("pieces"),
                F.concat(F.slice(r, F.lit(1), F.greatest(i - 2, F.lit(0))), before, after, F.slice(r, i + 2, F.size(p))).alias("ranks"))

        return F.when(F.coalesce(F.array_min(r), none) == none, s).otherwise(
            _let(F.array_position(r, F.array_min(r)).cast("int"), at))

    def merged(start: Column) -> Column:
        pairs = F.zip_with(F.slice(start, F.lit(1), F.greatest(F.size(start) - 1, F.lit(0))), F.slice(start, F.lit(2), F.size(start)),
                           lambda a, b: rank(F.concat(a, b)))
        first = F.struct(start.alias("pieces"), pairs.alias("ranks"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(start), F.lit(1))), first, lambda s, i: step(s))["pieces"]

    return F.transform(_let(octets, merged), lambda piece: _look_up(ranks, piece))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The token ids of one match."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > LONG:
        return _merge_long(word, ranks)
    pieces, get = [word[k:k + 1] for k in range(len(word))], ranks.get
    found = [get(a + b, 1 << 31) for a, b in zip(pieces, pieces[1:])]
    while found and (lowest := min(found)) < 1 << 31:
        k = found.index(lowest)
        pieces[k:k + 2] = [pieces[k] + pieces[k + 1]]
        del found[k]
        if k:
            found[k - 1] = get(pieces[k - 1] + pieces[k], 1 << 31)
        if k < len(found):
            found[k] = get(pieces[k] + pieces[k + 1], 1 << 31)
    return [ranks[p] for p in pieces]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap of ranked pairs: n log n steps instead of n * n."""
    ends = list(range(1, len(word) + 1))        # piece starting at i ends at ends[i]; 0: merged away
    before = list(range(-1, len(word) - 1))
    heap: list[tuple[int, int, int]] = []

    def offer(a: int) -> None:
        b = ends[a]
        if b < len(word) and (rank := ranks.get(word[a:ends[b]])) is not None:
            heapq.heappush(heap, (rank, a, ends[b]))

    for a in range(len(word) - 1):
        offer(a)
    while heap:
        _, a, end = heapq.heappop(heap)
        if not ends[a] or (b := ends[a]) >= len(word) or ends[b] != end:
            continue  # one of the two has been merged since
        ends[a], ends[b] = end, 0
        if end < len(word):
            before[end] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    out, a = [], 0
    while a < len(word):
        out.append(ranks[word[a:ends[a]]])
        a = ends[a]
    return out


class Coder:
    """Encodes and decodes single texts in a task; ids are little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, tokens: list[bytes], pattern: str, words: list[str], ids: list[list[int]]):
        self.tokens, self._words, self._ids = tokens, words, ids
        self._pattern, self._cache = pattern, None

    def encode(self, text: str | None) -> bytes:
        if self._cache is None:
            self._find = regex.compile(self._pattern).findall
            self._ranks = {t: k for k, t in enumerate(self.tokens)}
            self._cache = {w: np.array(i, "<u4").tobytes() for w, i in zip(self._words, self._ids)}
            self._recent: dict[str, bytes] = {}
        known, recent = self._cache.get, self._recent
        out = []
        for word in self._find(text or ""):
            ids = known(word) or recent.get(word)
            if ids is None:
                if len(recent) >= RECENT:
                    recent.clear()
                ids = recent[word] = np.array(merge(word.encode(), self._ranks), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class ByteBpe:
    """Encoder and decoder of one vocabulary; ``tokens`` are the byte strings by id."""

    def __init__(self, spark: SparkSession, tokens: list[bytes], pattern: str):
        self.spark, self.tokens, self.pattern = spark, tokens, spelled(pattern)

    def ranks(self) -> Column:
        """The rank map as a constant."""
        table = pd.DataFrame({"key": [t.hex().upper() for t in self.tokens], "value": range(len(self.tokens))})
        return _buckets(staged(self.spark.createDataFrame(table, "key string, value int"), "bpe-ranks"))

    def frequent(self, docs: DataFrame) -> DataFrame:
        """(key, ids) of the words that are frequent in a sample of documents, chosen by the hash of their text."""
        every = max(1, docs.count() // SAMPLE_DOCS)
        sample = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
        matches = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(self.pattern), F.lit(0))
        found = sample.select(F.explode(matches).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
        found = staged(found.filter((F.col("n") > 1) & (F.length("key") <= LONG // 4)), "bpe-words")
        often = found.filter(F.col("n") >= least_count(found, CACHE_WORDS)).select("key").repartition(64, "key")
        return _with_constants(often, {"ranks": self.ranks()}, lambda m: fold(F.col("key"), m["ranks"])).withColumnRenamed("made", "ids")

    def coder(self, docs: DataFrame) -> Coder:
        """What a task needs: the vocabulary and the cache, both of bounded size."""
        rows = self.frequent(docs).collect()
        return Coder(self.tokens, self.pattern, [r["key"] for r in rows], [r["ids"] for r in rows])

    def encode(self, docs: DataFrame) -> DataFrame:
        """The documents with their columns and ``ids``, an array of token ids."""
        coder = self.coder(docs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                coded = [coder.encode(t) for t in batch.column("text").to_pylist()]
                ends = np.cumsum([0, *[len(c) // 4 for c in coded]]).astype(np.int32)
                values = np.frombuffer(b"".join(coded), "<u4").astype(np.int32)
                yield _with_column(batch, "ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(values)))

        return docs.mapInArrow(run, _schema_with(docs, "ids", T.ArrayType(T.IntegerType())))

    def decode(self, coded: DataFrame) -> DataFrame:
        """The rows with ``bytes``, what their ``ids`` stand for; null ids stand for nothing."""
        coder = Coder(self.tokens, self.pattern, [], [])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                pieces = [coder.decode(np.array(i or [], "<u4").tobytes()) for i in batch.column("ids").to_pylist()]
                yield _with_column(batch, "bytes", pa.array(pieces, pa.binary()))

        return coded.mapInArrow(run, _schema_with(coded, "bytes", T.BinaryType()))


def _schema_with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema if f.name != name]).add(name, kind)


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    kept = [k for k, n in enumerate(batch.schema.names) if n != name]
    return pa.RecordBatch.from_arrays(
        [*[batch.column(k) for k in kept], values], names=[*[batch.schema.names[k] for k in kept], name])


def digests(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 (of the decoded bytes) per document."""
    coder = bpe.coder(docs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text in batch["text"]:
                ids = coder.encode(text)
                out.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()))
            rows = pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([batch[["id"]].reset_index(drop=True), rows], axis=1)

    # Ids go through pandas as text, since a batch with a null would turn them to floats.
    made = docs.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(
        run, "id string, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return made.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")
