from collections import Counter
from math import ceil, floor

from tickframe.llm import license_scan as C
from tickframe.llm import mixing as M


def test_cycle_stays_within_one_block():
    for weights in ({"a": 1}, {"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2, "c": 1, "d": 13}, {f"s{k}": 1 + k % 4 for k in range(20)}):
        total, had = sum(weights.values()), Counter()
        slots = M.cycle(weights)
        assert [s for _, _, s in slots] == list(range(total))
        for source, i, slot in slots:
            assert had[source] == i
            had[source] += 1
            for s, a in weights.items():
                assert floor((slot + 1) * a / total) <= had[s] <= ceil((slot + 1) * a / total)
        assert had == weights


def test_mix_keeps_all_rows_in_blocks(docs, no_docs, monkeypatch):
    monkeypatch.setattr(M, "RANGE_ROWS", 2)
    weights = {"a": 2, "b": 3}
    mixed = M.mix(docs, weights, block=2)
    rows = mixed.collect()
    assert mixed.columns == [*docs.columns, "slot", "place"]
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in docs.collect())
    assert len({(r.slot, r.place) for r in rows}) == len(rows)
    source_of = {}
    for s, k, slot in M.cycle({"": 1, "a": 2, "b": 3}):
        source_of[slot] = (s, k)
    by_source = Counter()
    for r in sorted(rows, key=lambda r: (r.slot, r.place)):
        source = r.source or ""
        assert source_of[r.slot % 6][0] == source
        at = (r.slot // 6 * {"": 1, "a": 2, "b": 3}[source] + source_of[r.slot % 6][1]) * 2 + r.place
        assert at == by_source[source]
        by_source[source] += 1
    assert M.mix(no_docs).count() == 0


def test_mixed_documents_are_in_order(docs, no_docs):
    out = M.mixed_documents(docs, {"a": 2, "b": 3}, block=2)
    assert out.columns == docs.columns
    order = {(r.doc_id, r.text): (r.slot, r.place) for r in M.mix(docs, {"a": 2, "b": 3}, block=2).collect()}
    got = [(r.doc_id, r.text) for r in out.collect()]
    first = [order[k] for k in dict.fromkeys(got) if got.count(k) == 1]
    assert first == sorted(first) and len(got) == docs.count()
    assert M.mixed_documents(no_docs).count() == 0


def test_licenses(spark, docs, no_docs):
    mit = C.KNOWN["MIT"]
    texts = {1: mit, 2: "Copyright (c) 2020 Some One\n" + mit.upper(), 3: mit.replace("sublicense", "sub-license").replace('"', "“"),
             4: mit + " more", 5: "some prose\n  Released under the MIT licence!\nLicensed under CC BY-NC 4.0.", 6: None, 7: "", 8: "?!",
             9: "// © 2021 X\nReleased under the MIT License", 10: "words " * 30000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in C.scan(df).collect()}
    assert [got[k].license for k in range(1, 10)] == ["MIT", "MIT", "MIT", None, None, None, None, None, "MIT notice"]
    assert got[5].notices == ["CC-BY-NC-4.0 notice", "MIT notice"] and got[4].notices == [] and got[6].digest is None
    assert C.scan(docs).count() == docs.count() and C.scan(no_docs).count() == 0
    assert C.scan(df, {}).filter("license IS NOT NULL").count() == 0


def test_known_texts_without_a_plain_word_are_found_on_lines(spark):
    """Words that all have another spelling, other scripts, a copyright line that copies do without."""
    known = {"NC": "Noncommercial licence.", "free": "\u8457\u4f5c\u6a29\u30d5\u30ea\u30fc", "MIT": "Released under the MIT License.",
             "own": "Copyright (c) 2020 Extraordinarily Longnamed Holder\nUse it & keep it", "link": "see https://x"}
    lines = ["Non commercial license", "\u8457\u4f5c\u6a29\u30d5\u30ea\u30fc", "released under the mit licence", "use it and keep it", "See http://x"]
    for names in (list(known), ["NC", "MIT"], ["free", "MIT"], ["own", "MIT"], ["link", "MIT"], ["MIT"]):
        some = {n: known[n] for n in names}
        df = spark.createDataFrame([(1, "\n".join(["other words", *lines]), "x", "y")], "doc_id long, text string, license string, digest string")
        assert C.scan(df, some).first().notices == sorted(some)
    both = C.scan(df, {"b": "Same text", "a": "same TEXT!", "empty": "?!"})
    assert both.columns == ["doc_id", "digest", "license", "notices"] and both.first().notices == []
    assert C.scan(df.selectExpr("doc_id", "'SAME text' AS text"), {"b": "Same text", "a": "same TEXT!"}).first().license == "a"
