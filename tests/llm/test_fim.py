import hashlib

import pytest

from tickframe.llm import fim


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    text = text or ""
    h = [int(sha(f"1:{'' if doc_id is None else doc_id}")[8 * k:8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or h[2] % 100 >= 90 or any(s in text for s in ("<P>", "<S>", "<M>")):
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h[3] % 100 < 20
    out = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
    return (doc_id, n, "spm" if spm else "psm", a, b - a, sha(out), sha(text))


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_equals_brute_force(spark, docs, rows):
    odd = [(1000 + k, t) for k, t in enumerate(("<P>", "a<S", "<M> x", "<P", "x<", "<<P", "P>", "ß<é🙂>" * 40, "<", "🙂" * 9))]
    odd += [(2000 + k, f"text {k} " + "é<P" * (k % 5)) for k in range(200)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    want = sorted((expected(r.doc_id, r.text) for r in both.collect()), key=lambda t: tuple(map(str, t)))
    made = rows(fim.digests(both), *COLUMNS)
    assert made == want
    assert {r[2] for r in made} == {"plain", "psm", "spm"}


def test_texts_come_back(docs):
    back = fim.restore(fim.transform(docs, rate=100).select("output", "form", "output_sha256", "n")).collect()
    assert sorted(r.restored for r in back) == sorted(r.text or "" for r in docs.collect())
    assert all(sha(r.output) == r.output_sha256 and sha(r.restored) == r.restored_sha256 and len(r.restored) == r.n for r in back)


def test_pieces():
    t = fim.PieceTable.whole(b"abcdef")
    cut = t.cut(0, 2, 2, 6)
    assert [bytes(p) for p in cut.stream()] == [b"", b"ab", b"", b"cdef", b""] and cut.text() == "abcdef"
    again = cut.cut(1, 4)
    assert again.text() == "abcdef" and b"a" in [bytes(p) for p in again.stream()]
    order = (3, 0, 4, 2, 1)
    assert cut.arranged(order).restored(order).pieces == cut.pieces
    assert cut.arranged(order).buffers[0] is t.buffers[0]


@pytest.mark.parametrize("text", ["<P", "a<", "<S><", "x<M"])
def test_no_sentinel_across_a_border(text):
    for k in range(50):
        form, _, _, pieces = fim.arrange(text, str(k), rate=100)
        assert fim.rebuilt(pieces.text(), form).text() == text


def test_empty_table_and_clashing_columns(docs, no_docs):
    assert fim.digests(no_docs).count() == 0
    clashing = docs.withColumnRenamed("n", "form").withColumnRenamed("row", "output")
    assert fim.digests(clashing).columns == list(COLUMNS)
