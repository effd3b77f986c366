"""Queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Tokenizer files by name; the folder is a parameter of ``tokenizer``.
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def tokenizer(name: str, folder: str | None = None) -> str:
    """Where a tokenizer file is: in ``folder``, else where the installed package has it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.spans(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), end_id=1, capacity=4096)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import tokenfile

    return tokenfile.round_trip(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE), end_id=2)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer(PIECE_BPE), limit=4096)


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import kn

    return kn.score(table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexicon

    return lexicon.round_trip(table(spark, sf_dir, "documents"), tokenizer(WORD_BPE))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import common, media

    return media.features(common.stored(media.to_media(table(spark, sf_dir, "documents")), "media"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard

    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=85)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import repair

    return repair.repair(table(spark, sf_dir, "conversations"), also=repair.damaged)


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontaminate

    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), size=10)


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import trie

    return trie.trie(trie.rebuilt(trie.sequences(table(spark, sf_dir, "conversations"))))


def crc32(text: str) -> str:
    """SQL for the CRC-32 of an ASCII text."""
    shift = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda a, b: {shift}), 4294967295)"


def closed(paths: str) -> str:
    """SQL for a list of paths (q: state, c: cost, a: letters): the best of each state, where up to two turns may be inserted at the end."""
    inserted = lambda p: f"list_transform({p}, lambda x: {{'q': CASE x.q WHEN 2 THEN 3 ELSE 2 END, 'c': x.c + 5, 'a': x.a || 'I'}})"
    best = ", ".join(f"list_min(list_filter(o, lambda x: x.q = {q}))" for q in range(4))
    return f"(SELECT list_filter([{best}], lambda x: x IS NOT NULL) FROM (SELECT list_concat(list_concat(p, i), {inserted('i')}) AS o FROM (SELECT p, {inserted('p')} AS i FROM (SELECT {paths} AS p))))"


QUERIES: dict[str, Query] = {
    "op1_pii": op1_pii,
    "op2_packing": op2_packing,
    "op3_quality": op3_quality,
    "op4_token_file": op4_token_file,
    "op5_token_counts": op5_token_counts,
    "op6_language_model": op6_language_model,
    "op7_bpe": op7_bpe,
    "op8_toxicity": op8_toxicity,
    "op9_media": op9_media,
    "op10_ngram_join": op10_ngram_join,
    "op11_repair": op11_repair,
    "op12_decontamination": op12_decontamination,
    "op13_trie": op13_trie,
}
#: Those that SQL can say; the others need a tokenizer, a learned model, a file format or a search.
ORACLE_SQL: dict[str, str] = {
    "op10_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, w, unnest(generate_series(1, CASE WHEN len(w) = 0 THEN 0 ELSE greatest(len(w) - 3, 1) END)) AS i FROM d),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
r(v, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM r JOIN l ON r.v = l.a)
SELECT documents.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.c) AS component_id
FROM documents JOIN r ON r.v = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id GROUP BY 1
""",
    "op11_repair": rf"""
WITH RECURSIVE w AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS how FROM conversations),
v AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE how WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM w WHERE how <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM v),
f AS (
  SELECT *, CASE WHEN t = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'd' WHEN t[-1] NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS before FROM n),
c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate, count(*) FILTER (WHERE fault = 't') AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, list({{'i': initial, 'f': fault}} ORDER BY k) AS codes, list({{'role': role, 'text': text}} ORDER BY k) AS rows_ FROM f GROUP BY conv_id),
r AS (
  SELECT conv_id, codes, 1 AS i, {closed("[{'q': 0, 'c': 0::BIGINT, 'a': ''}]")} AS p FROM c
  UNION ALL
  SELECT conv_id, codes, i + 1, {closed("s")} FROM (
    SELECT conv_id, codes, i, list_concat(list_transform(p, lambda x: {{'q': x.q, 'c': x.c + 2, 'a': x.a || 'D'}}), CASE WHEN e.f IN ('b', 'd') THEN [] ELSE list_concat(
      list_transform(p, lambda x: {{'q': CASE x.q WHEN 2 THEN 3 ELSE 2 END, 'c': x.c + 1 + CASE e.f WHEN 't' THEN 5 ELSE 0 END, 'a': x.a || 'R'}}),
      list_transform(list_filter(p, lambda x: x.q = 0 AND e.i IN ('s', 'u') OR x.q IN (1, 3) AND e.i = 'u' OR x.q = 2 AND e.i = 'a'),
        lambda x: {{'q': CASE e.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END, 'c': x.c + CASE e.f WHEN 't' THEN 5 ELSE 0 END, 'a': x.a || 'K'}})) END) AS s
    FROM (SELECT *, codes[i] AS e FROM r WHERE i <= len(codes)))),
b AS (SELECT conv_id, list_min(list_transform(list_filter(p, lambda x: x.q IN (0, 3)), lambda x: {{'c': x.c, 'a': x.a}})) AS b FROM r WHERE i = len(codes) + 1),
l AS (SELECT c.conv_id, rows_, string_split(b.b.a, '') AS l, unnest(generate_series(1, len(b.b.a))) AS j FROM c JOIN b ON b.conv_id IS NOT DISTINCT FROM c.conv_id),
o AS (
  SELECT conv_id, j, l[j] AS e, rows_[len(list_filter(l[1:j], lambda x: x <> 'I'))] AS was, row_number() OVER (PARTITION BY conv_id ORDER BY j) AS z FROM l WHERE l[j] <> 'D'),
q AS (SELECT *, max(CASE WHEN z = 1 AND e = 'K' AND was.role[1] = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS system FROM o),
h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN was.role WHEN (z - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE e WHEN 'I' THEN '' ELSE was.text END, chr(10) ORDER BY z)) AS repaired_sha256 FROM q GROUP BY 1)
SELECT u.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate, coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal,
  coalesce(b.b.c, 0) AS cost, coalesce(b.b.a, '') AS audit, coalesce(h.repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) u LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN b ON b.conv_id IS NOT DISTINCT FROM u.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM u.conv_id
""",
    "op12_decontamination": r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
s AS (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS win FROM s),
p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS p FROM d),
g AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS win FROM p JOIN (SELECT DISTINCT n FROM k) ON p + n - 1 <= len(w)),
h AS (SELECT doc_id, p, n, item_id FROM g JOIN k USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(generate_series(p, p + n - 1)) AS q FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(o.n_items, 0) AS n_items, coalesce(o.items_sha256, sha256('')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN o USING (doc_id)
""",
    "op13_trie": rf"""
WITH t AS (
  SELECT conv_id, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS k FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, {crc32("CAST(conv_id AS VARCHAR)")} % 4 AS h, list(t ORDER BY k) AS s FROM t GROUP BY 1),
r AS (SELECT o.conv_id, list_concat(CASE WHEN b.s IS NULL THEN o.s[1:0] ELSE b.s[1:o.h] END, o.s[o.h + 1:]) AS s FROM s o LEFT JOIN s b ON b.conv_id = o.conv_id - o.conv_id % 20),
p AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS node FROM (SELECT *, unnest(generate_series(0, len(s))) AS d FROM r)),
v AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * len(list_filter(regexp_split_to_array(node[d].x, '[\x20\x09-\x0D]+'), lambda w: w <> '')) END AS saved
  FROM p GROUP BY node, d),
c AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM v WHERE d > 0 GROUP BY 1),
w AS (SELECT v.*, coalesce(c.n_children, 0) AS n_children FROM v LEFT JOIN c USING (node)),
u AS (SELECT node[1:a] AS node, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, o.conv_id AS parent_conv_id, w.n_convs, w.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM w JOIN u USING (node) LEFT JOIN v o ON w.d > 0 AND o.node = w.node[1:w.d - 1]
""",
}
