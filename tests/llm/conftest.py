import random

import pytest

from tickframe.llm.common import small_batches


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with every edge case: nulls, empty and very long texts, copies, repeated rows, clashing columns."""
    small_batches(spark)
    rng = random.Random(7)
    vocabulary = [f"w{k}" for k in range(400)] + ["Émile", "naïve", "日本", "ß", "🙂"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    passage, base = prose(70), prose(300)
    texts = [None, "", "   \n\t", "one", "one two", "Two words\x0b\x0cand\rmore  spaces ", "!!! ???", "ABC abc", "abc ABC"]
    texts += [prose(40), passage, prose(60) + " " + passage + "\n" + prose(30), passage + " " + passage, prose(200)]
    texts += [base, base, base + " end", base.replace("w1 ", "w2 ", 1), "same " * 120, "x" * 5000, prose(6000)]
    texts += [prose(30) + "\n" + line for line in ("a line\na line\n\na line", "# * $ % & | < >")]
    texts += [passage[:200], prose(49), prose(50), "same " * 51]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or ""), k, "x") for k, t in enumerate(texts)]
    rows += [rows[11], rows[14], (None, base, "en", "a", 1, 1, "x"), (None, None, None, None, 0, 1, None)]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n long, row string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
