import random
import zlib

import numpy as np

from tickframe.llm import language_id as G

SYLLABLES = {"aa": "ka ro mi to su ne".split(), "bb": "sch ver ung lich keit ein".split(), "cc": "que eau oi tre ment ion".split()}


def made(spark):
    rng = random.Random(5)
    rows = []
    for k in range(240):
        lang = "abc"[k % 3] * 2
        text = " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60)))
        rows.append((k, text, lang if k % 5 else None))
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !?", "cc"), (None, "karo mito", "aa"), (903, "karo mito " * 30000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_and_edges(spark):
    df = made(spark)
    got = G.predict(df).collect()
    assert len(got) == df.count()
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out and r.doc_id < 240]
    assert sum(r.lang_pred == "abc"[r.doc_id % 3] * 2 for r in held) >= 0.95 * len(held) > 0
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[k].lang_pred, by_id[k].score) == ("und", 0.0) for k in (900, 901, 902))
    assert by_id[903].lang_pred == by_id[None].lang_pred == "aa"


def test_prediction_uses_the_text_only(spark):
    df = made(spark)
    model = G.fit(df)
    a = model.predict(["karo mito sune", "schverung lich", "queeau oi trement"])
    assert a[0] == ["aa", "bb", "cc"]


def test_nothing_to_learn_from(spark, docs, no_docs):
    empty = docs.withColumn("lang", G.F.lit(None).cast("string"))
    assert {r.lang_pred for r in G.predict(empty).collect()} == {"und"}
    assert G.predict(no_docs).count() == 0


def test_sample_is_of_distinct_texts_and_holds_long_ones(spark, monkeypatch):
    seen = {}

    class Spy(G.Classifier):
        def __init__(self, texts, languages, *rest):
            for t, lang in zip(texts, languages):
                seen.setdefault(lang, []).append(t)
            super().__init__(texts, languages, *rest)

    monkeypatch.setattr(G, "Classifier", Spy)
    rows = [(f"karo mito {k}", "aa") for k in range(12) for _ in range(400)]
    rows += [(f"schver lich {k} " * 3000, "bb") for k in range(5)]
    model = G.fit(spark.createDataFrame(rows, "text string, lang string"), 20)
    assert sorted(seen["aa"]) == sorted(f"karo mito {k}" for k in range(12))
    assert len(seen["bb"]) == 5 and all(len(t) <= G.SAMPLE_CHARS + G.PIECES for t in seen["bb"])
    assert model.predict(["schver lich", "karo mito"])[0] == ["bb", "aa"]


def brute(texts, languages, asked, landmarks=40, ridge=0.1):
    """The same by sets of n-grams and dictionaries, one text at a time."""
    def grams(t):
        low = t.lower()
        return {low[k:k + n] for n in (1, 2, 3) for k in range(len(low) - n + 1)}

    names = sorted(set(languages))
    chosen = [t for name in names for t in [t for t, own in zip(texts, languages) if own == name][:landmarks]]
    chosen = [t for t in texts if t in chosen]
    known = set().union(*map(grams, chosen))
    marks = [grams(t) & known for t in chosen]

    def row(t):
        own = grams(t) & known
        return [len(own & m) / ((len(m) or 1) * (len(own) or 1)) ** 0.5 for m in marks]

    values, vectors = np.linalg.eigh(np.array([row(t) for t in chosen]))
    good = values > 1e-6 * max(values.max(), 1e-12)
    whiten = vectors[:, good] / np.sqrt(values[good])
    x = np.array([row(t) for t in texts]) @ whiten
    y = np.array([[1.0 if own == n else -1.0 for n in names] for own in languages])
    w = np.linalg.solve(x.T @ x + ridge * np.eye(x.shape[1]), x.T @ y)
    out = np.array([row(t) for t in asked]) @ whiten @ w
    return [names[k] for k in out.argmax(axis=1)], np.clip((out.max(axis=1) + 1) / 2, 0, 1)


def test_same_as_brute_force(spark):
    rows = [r for r in made(spark).collect() if r.doc_id is not None and r.doc_id < 240]
    train = [(r.text, r.lang) for r in rows if r.lang][:90]
    texts, languages = map(list, zip(*train))
    model = G.Classifier(texts, languages)
    asked = [r.text for r in rows[90:]]
    names, scores = model.predict(asked)
    want, sure = brute(texts, languages, asked)
    assert names == want
    np.testing.assert_allclose(scores, sure, atol=2e-4)


def test_thinning_picks_the_texts_that_the_ranking_would(spark, monkeypatch):
    """One text more or less, on either side of where thinning begins, gives the same sample but for that text."""
    seen = []
    monkeypatch.setattr(G, "Classifier", lambda texts, languages: seen.append(set(texts)))
    for n in (8 * 5, 8 * 5 + 1, 200):
        rows = [(f"karo mito {k}", "aa") for k in range(n)]
        G.fit(spark.createDataFrame(rows, "text string, lang string"), 5)
        hashes = spark.createDataFrame(rows, "text string, lang string").select(
            "text", G.F.pmod(G.F.xxhash64("text"), G.F.lit(G.SCALE)).alias("h")).collect()
        assert seen[-1] == {r.text for r in sorted(hashes, key=lambda r: r.h)[:5]}


def test_repeated_rows_and_clashing_columns(spark):
    df = made(spark).withColumns({"held_out": G.F.lit("x"), "score": G.F.lit("y"), "lang_pred": G.F.lit("z")})
    got = G.predict(df.union(df))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    pairs = {}
    for r in got.collect():
        pairs.setdefault(r.doc_id, set()).add((r.held_out, r.lang_pred, r.score))
    assert all(len(v) == 1 for v in pairs.values()) and got.count() == 2 * df.count()
