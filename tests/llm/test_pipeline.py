"""Every stage of the pipeline against brute force over its own input."""

import base64
import random
import re

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from tickframe.llm import mixing
from tickframe.llm import simhash as H

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    vocabulary = [f"v{k}" for k in range(900)]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passage, texts = prose(80), []
    for k in range(40):
        words = prose(rng.randrange(60, 200))
        if k % 7 == 0:
            words[30:30] = passage
        texts.append(" ".join(words))
    for k in range(0, 12, 3):  # exact and near copies
        texts.append(texts[k])
        words = texts[k + 1].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [None, "", "few words only", "again " * 100, "noisy# " * 2 + " ".join(f"{w}%" for w in prose(50))]
    return [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def base_kept(text):
    w = words(text)
    five = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    covered = {k + j for k, f in enumerate(five) if five.count(f) > 1 for j in range(5)}
    return len(w) >= 10 and 100 * len(covered) <= 20 * len(w)


def one_of_each_group(rows):
    """Documents whose sets of five-word shingles are 0.8 alike, directly or through others, leave the one with the smallest id."""
    prints = {r.doc_id: set(H.shingle_hashes(r.text, 5).tolist()) for r in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and 5 * len(prints[a] & prints[b]) >= 4 * len(prints[a] | prints[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in prints if find(i) == i}


def cut(rows):
    first, out = {}, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        w = words(r.text)
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), r.doc_id)
    for r in rows:
        w = words(r.text)
        gone = {k + j for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < r.doc_id for j in range(50)}
        out[r.doc_id] = [x for k, x in enumerate(w) if k not in gone]
    return out


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(corpus(), COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert [n for n, _ in P.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "mixing", "byte_bpe"]
    docs, made = spark.read.parquet(f"{sf}/documents.parquet"), [None]
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        out.write.parquet(f"{sf}/{name}")
        assert name == "byte_bpe" or out.columns == docs.columns
        docs = spark.read.parquet(f"{sf}/{name}")
        made.append(docs.collect())
    quality, near, repeats, mixed, coded = made[1:]

    assert {r.doc_id for r in quality} == {i for i, t, *_ in corpus() if base_kept(t)}
    assert {r.doc_id for r in near} == one_of_each_group(quality) and len(near) < len(quality)
    want = cut(near)
    assert {r.doc_id: words(r.text) for r in repeats} == want and any(len(want[r.doc_id]) < len(words(r.text)) for r in near)
    assert all(r.n_chars == len(r.text) for r in repeats)
    slots = {r.doc_id: (r.slot, r.place) for r in mixing.mix(spark.createDataFrame(repeats, COLUMNS)).collect()}
    assert [r.doc_id for r in mixed] == sorted(slots, key=slots.get) and sorted(mixed) == sorted(repeats)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert [r.doc_id for r in coded] == [r.doc_id for r in mixed]
    assert all(r.ids == library.encode_ordinary(r.text) and r.n_tokens == len(r.ids) and r.decodes for r in coded)

    whole = P.run(spark, sf)
    assert sorted(map(str, whole.collect())) == sorted(map(str, coded))


def test_empty_corpus(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert P.run(spark, sf).count() == 0
