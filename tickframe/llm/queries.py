"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.llm import (
    byte_bpe, fim, language_id, license_scan, mixing, ngram_join, ngram_lm, pivot_codes, quality_rules, simhash, substring_dedup,
    topk, url_filter)
from tickframe.llm.common import small_batches, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; sessions are prepared first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(small_batches(spark), sf_dir)

    _QUERIES[fn.__name__] = run
    return run


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.digests(table(spark, sf_dir, "documents"))


@query
def op2_quality_rules(spark, sf_dir):
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_language_id(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"))


@query
def op4_url_filter(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        "doc_id", "source", "slot", "place")


@query
def op6_simhash(spark, sf_dir):
    return simhash.groups(table(spark, sf_dir, "documents"))


@query
def op7_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("notices", F.array_join("notices", ", "))


@query
def op8_byte_bpe(spark, sf_dir):
    tokens = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return byte_bpe.digests(
        table(spark, sf_dir, "documents"), byte_bpe.ByteBpe(spark, tokens, public_tokenizers.PATTERN))


@query
def op9_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"))


@query
def op10_ngram_lm(spark, sf_dir):
    return ngram_lm.score(table(spark, sf_dir, "documents"), whole=True)


@query
def op11_fim(spark, sf_dir):
    return fim.digests(table(spark, sf_dir, "documents"))


@query
def op12_pivot_codes(spark, sf_dir):
    return pivot_codes.digests(table(spark, sf_dir, "embeddings"))


@query
def op13_ngram_join(spark, sf_dir):
    return ngram_join.groups(table(spark, sf_dir, "documents"))


# --- SQL --------------------------------------------------------------------------------------
# Learned rules (2, 4), models (3, 10), fingerprints (6) and tokenizing (8) are beyond SQL; they are tested
# against brute force, round trips and held-out accuracy.

def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _substring_sql() -> str:
    """Every window of every document, by its words."""
    return r"""
      WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
                 FROM documents),
      win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h
              FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)),
      first AS (SELECT h, min(doc_id) AS f FROM win GROUP BY h),
      gone AS (SELECT doc_id, list_sort(list_distinct(list(p))) AS ps
               FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE f < doc_id)
               GROUP BY doc_id),
      kept AS (SELECT d.doc_id, len(w) AS n, string_agg(word, ' ' ORDER BY p) AS text, count(word) AS k
               FROM (SELECT doc_id, w, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) d LEFT JOIN gone USING (doc_id)
               WHERE gone.ps IS NULL OR NOT list_contains(gone.ps, p) GROUP BY ALL)
      SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k, 0) AS BIGINT) AS n_removed,
             sha256(coalesce(kept.text, '')) AS kept_sha256
      FROM d LEFT JOIN kept USING (doc_id)"""


def _mixing_sql() -> str:
    """Earliest deadline first, slot by slot over one cycle, then the place of every document."""
    weights = ", ".join(f"{_quoted(k)}: {v}" for k, v in mixing.TARGETS.items())
    return f"""
      WITH RECURSIVE own AS (SELECT src, coalesce(MAP {{{weights}}}[src], 1) AS a
                             FROM (SELECT DISTINCT coalesce(source, '') AS src FROM documents)),
      w AS (SELECT list(src ORDER BY src) AS s, list(a ORDER BY src) AS a, CAST(sum(a) AS BIGINT) AS q FROM own),
      cyc(t, done, pick) AS (
        SELECT CAST(-1 AS BIGINT), list_transform(a, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM w
        UNION ALL
        SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i = p THEN 1 ELSE 0 END), p
        FROM (SELECT t, done, q, list_min(list_filter(list_transform(range(1, len(a) + 1), lambda i:
                CASE WHEN done[i] < a[i] AND (done[i] * q) // a[i] <= t + 1
                     THEN struct_pack(due := ((done[i] + 1) * q + a[i] - 1) // a[i], i := i) END),
                lambda x: x IS NOT NULL)).i AS p FROM cyc, w WHERE t + 1 < q)),
      plan AS (SELECT s[pick] AS src, done[pick] - 1 AS k, t AS cycle_slot, a[pick] AS share, q FROM cyc, w WHERE t >= 0),
      placed AS (SELECT doc_id, source, coalesce(source, '') AS src, row_number() OVER (
                   PARTITION BY coalesce(source, '') ORDER BY doc_id IS NULL, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS pos
                 FROM documents)
      SELECT doc_id, source, CAST((pos // {mixing.BLOCK} // share) * q + cycle_slot AS BIGINT) AS slot,
             CAST(pos % {mixing.BLOCK} AS INTEGER) AS place
      FROM placed JOIN plan ON plan.src = placed.src AND plan.k = (pos // {mixing.BLOCK}) % share"""


def _license_sql() -> str:
    def canonical(text: str) -> str:
        out = f"lower(coalesce({text}, ''))"
        for pattern, instead in license_scan.STEPS:
            out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(instead)}, 'g')"
        for other, usual in license_scan.SPELLINGS.items():
            out = f"regexp_replace({out}, {_quoted(chr(92) + 'b' + other + chr(92) + 'b')}, {_quoted(usual)}, 'g')"
        return f"trim({out})"

    known = ", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in license_scan.KNOWN.items())
    return f"""
      WITH known AS (SELECT digest, min(name) AS license
                     FROM (SELECT name, sha256({canonical('t')}) AS digest FROM (VALUES {known}) k(name, t)) GROUP BY digest),
      lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
      found AS (SELECT doc_id, string_agg(DISTINCT license, ', ' ORDER BY license) AS notices
                FROM (SELECT doc_id, sha256({canonical('line')}) AS digest FROM lines)
                JOIN known USING (digest) GROUP BY doc_id),
      whole AS (SELECT doc_id, {canonical('text')} AS c FROM documents)
      SELECT doc_id, CASE WHEN c <> '' THEN sha256(c) END AS digest, license, coalesce(notices, '') AS notices
      FROM whole LEFT JOIN known ON known.digest = sha256(c) AND c <> '' LEFT JOIN found USING (doc_id)"""


_TOPK_SQL = """
  WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
             WHERE vec_id IS NOT NULL AND len(embedding) > 0
               AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
  pairs AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs QUALIFY rank <= 5"""


_FIM_SQL = """
  WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
                    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
  drawn AS (SELECT doc_id, t, n, CAST('0x' || h[1:8] AS UBIGINT) % (n + 1) AS a, CAST('0x' || h[9:16] AS UBIGINT) % (n + 1) AS b,
                   CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                          OR CAST('0x' || h[17:24] AS UBIGINT) % 100 >= 90 THEN 'plain'
                        WHEN CAST('0x' || h[25:32] AS UBIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
  cut AS (SELECT *, CAST(least(a, b) AS BIGINT) AS x, CAST(greatest(a, b) AS BIGINT) AS y FROM drawn),
  made AS (SELECT *, CASE form WHEN 'plain' THEN t
                       WHEN 'psm' THEN '<P>' || substr(t, 1, x) || '<S>' || substr(t, y + 1, n - y) || '<M>' || substr(t, x + 1, y - x)
                       ELSE '<S>' || substr(t, y + 1, n - y) || '<P>' || substr(t, 1, x) || '<M>' || substr(t, x + 1, y - x) END AS o
           FROM cut),
  read AS (SELECT *, strpos(o, '<P>') AS p, strpos(o, '<S>') AS s, strpos(o, '<M>') AS m, length(o) AS l FROM made)
  SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars,
         CASE WHEN form <> 'plain' THEN y - x END AS middle_chars, sha256(o) AS output_sha256,
         sha256(CASE form WHEN 'plain' THEN o
                  WHEN 'psm' THEN substr(o, p + 3, s - p - 3) || substr(o, m + 3, l - m - 2) || substr(o, s + 3, m - s - 3)
                  ELSE substr(o, p + 3, m - p - 3) || substr(o, m + 3, l - m - 2) || substr(o, s + 3, p - s - 3) END) AS restored_sha256
  FROM read"""


def _codes_sql() -> str:
    """Every distance of every round, as whole numbers held exactly in doubles."""
    def nearest(book: str) -> str:
        return f"""SELECT vec_id, j, any_value(x) AS x, min(struct_pack(
                     d := list_inner_product(x, x) - 2 * list_inner_product(x, e) + list_inner_product(e, e), k := k)) AS m
                   FROM p JOIN {book} USING (j) GROUP BY vec_id, j"""

    rounds = "".join(f"""
      a{r} AS MATERIALIZED ({nearest(f"b{r - 1}")}),
      s{r} AS (SELECT j, k, list(t ORDER BY i) AS e
               FROM (SELECT j, m.k AS k, i, floor(sum(x[i]) / count(*)) AS t FROM a{r}, range(1, len(x) + 1) c(i) GROUP BY ALL) GROUP BY j, k),
      b{r} AS MATERIALIZED (SELECT j, k, coalesce(s.e, b.e) AS e FROM b{r - 1} b LEFT JOIN s{r} s USING (j, k)),"""
                     for r in range(1, pivot_codes.ROUNDS + 1))
    last = f"b{pivot_codes.ROUNDS}"
    return f"""
      WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor({pivot_codes.SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
                 WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
      p AS MATERIALIZED (SELECT vec_id, label, j, v[j * len(v) // 4 + 1:(j + 1) * len(v) // 4] AS x FROM v, range(4) r(j)),
      b0 AS MATERIALIZED (SELECT j, row_number() OVER (PARTITION BY j ORDER BY vec_id) - 1 AS k, x AS e FROM p
                          QUALIFY k < {pivot_codes.ENTRIES}),{rounds}
      coded AS (SELECT vec_id, string_agg(format('{{:02x}}', m.k), '' ORDER BY j) AS code, CAST(sum(m.d) AS BIGINT) AS error
                FROM ({nearest(last)}) GROUP BY vec_id),
      books AS (SELECT sha256(string_agg(CAST(CAST(t AS BIGINT) AS VARCHAR), ',' ORDER BY j, k, i)) AS codebooks_sha256
                FROM (SELECT j, k, e[i] AS t, i FROM {last}, range(1, len(e) + 1) c(i)))
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
      FROM coded JOIN v USING (vec_id), books"""


_JOIN_SQL = r"""
  WITH RECURSIVE d AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
  g AS MATERIALIZED (
    SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS g FROM d),
  s AS MATERIALIZED (SELECT doc_id, len(g) AS n, unnest(g) AS h FROM g),
  pairs AS MATERIALIZED (
    SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  near AS MATERIALIZED (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
  r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, near.b FROM r JOIN near ON near.a = r.other)
  SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id
  FROM g JOIN (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)"""


def all_oracles() -> dict[str, str]:
    return {
        "op1_substring_dedup": _substring_sql(), "op5_mixing": _mixing_sql(), "op7_license_scan": _license_sql(),
        "op9_topk": _TOPK_SQL, "op11_fim": _FIM_SQL, "op12_pivot_codes": _codes_sql(), "op13_ngram_join": _JOIN_SQL,
    }
