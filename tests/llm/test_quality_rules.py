import re
from collections import Counter

from tickframe.llm import quality_rules as Q


def expected(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
    covered = {k + j for k in range(len(w) - 4) if seen[tuple(w[k:k + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(text.count(x) for x in Q.SYMBOLS), len(lines) - len(set(lines)), len(covered)


def test_statistics_same_as_brute_force(docs):
    got = Counter(tuple(r[c] for c in ["doc_id", *Q.BASE]) for r in Q.statistics(docs).collect())
    assert got == Counter((r.doc_id, *expected(r.text)) for r in docs.collect())


def labelled(spark):
    texts = [("word%d " % k) * 1 + " ".join(f"t{k}x{j}" + ("#" if k % 3 == 0 else "") for j in range(40)) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 != 0), 0) for k in range(120)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_learns_the_rule_that_separates(spark):
    docs, labels = labelled(spark)
    rules = Q.learn(Q.statistics(docs), labels)
    assert rules and all(c.feature in Q.FEATURES for rule in rules for c in rule)
    judged = {r.doc_id: r for r in Q.judge(docs, labels).collect()}
    assert all(judged[k].kept == (k % 3 != 0) and not judged[k].base_failed for k in judged)
    assert judged[0].rule == 1 and judged[1].rule is None
    assert {r.doc_id for r in Q.kept_documents(docs, labels).collect()} == {k for k in range(120) if k % 3}


def test_base_rule_only_without_usable_labels(spark, docs):
    for rows in ([], [(1, None, 0), (None, 0, 0)], [(k, 1, 0) for k in range(30)]):
        labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
        judged = Q.judge(docs, labels).collect()
        assert len(judged) == docs.count()
        assert all(r.kept == (not r.base_failed) == (r.n_words >= 10 and 5 * r.n_repeat_words <= r.n_words) for r in judged)


def test_kept_documents_keep_their_columns(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.kept_documents(docs, labels).columns == docs.columns
    assert Q.kept_documents(no_docs, labels).count() == 0 and Q.judge(no_docs, labels).count() == 0
