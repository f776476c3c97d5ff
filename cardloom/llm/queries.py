"""The thirteen operators as queries over the driver's tables, with production parameters, and their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardloom.llm.chunk_encoding import DIGESTS, digests, encode_with_reuse
from cardloom.llm.common import passing, scratch_path
from cardloom.llm.exact_dedup import exact_groups, normalized
from cardloom.llm.fill_middle import fill_in_middle, restore_texts
from cardloom.llm.language_id import identify_languages, train
from cardloom.llm.lm_scoring import score_documents
from cardloom.llm.near_dedup import near_duplicates
from cardloom.llm.packing import pack_documents
from cardloom.llm.pii import span_report
from cardloom.llm.prefix_trie import prefix_trie
from cardloom.llm.quality_rules import judge_quality
from cardloom.llm.substring_dedup import remove_repeats
from cardloom.llm.token_records import read_token_records, write_token_records
from cardloom.llm.url_filters import judge_urls

END_ID = 2
CAPACITY = 1024


def tokenizer_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "records")
    write_token_records(table(spark, sf_dir, "documents"), path, tokenizer_path(), END_ID)
    passing(spark, path)
    return read_token_records(spark, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), more={"text_sha256": F.sha2(normalized(F.col("text")), 256)})


OP2_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), CAPACITY, END_ID)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify_languages(docs, train(docs))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).drop("lang", "source")


def op7_chunk_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_with_reuse(table(spark, sf_dir, "documents"), tokenizer_path(), digests, DIGESTS)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).drop("row")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP9_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.n + y.n - common)),
r AS (SELECT doc_id AS node, doc_id AS c FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d JOIN (SELECT node, min(c) AS c FROM r GROUP BY node) m ON m.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore_texts(fill_in_middle(table(spark, sf_dir, "documents")))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP11_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents
), h AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || x[1:8])::BIGINT AS h1, ('0x' || x[9:16])::BIGINT AS h2, ('0x' || x[17:24])::BIGINT AS h3, ('0x' || x[25:32])::BIGINT AS h4 FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h
), p AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)),
f AS (SELECT w, min({'d': doc_id, 'i': i}) AS p FROM s GROUP BY w HAVING count(*) > 1),
g AS (SELECT DISTINCT s.doc_id, s.i + k AS i FROM s JOIN f USING (w), range(20) r(k) WHERE {'d': s.doc_id, 'i': s.i} > f.p),
l AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(CASE WHEN gone IS NULL THEN array_to_string(ws, ' ') ELSE array_to_string(list_filter(ws, lambda x, i: NOT list_contains(gone, i)), ' ') END) AS kept_sha256
FROM d LEFT JOIN l ON l.doc_id = d.doc_id
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
WITH o AS (
  SELECT conv_id AS c, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own,
    list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS digits FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT c, own, xor(list_reduce(list_prepend(4294967295::BIGINT, digits), lambda z, x: list_reduce(list_prepend(xor(z, x), range(8)),
    lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 6 AS h FROM o
), r AS (SELECT h.c, list_concat(coalesce(b.own, [])[1:h.h], h.own[h.h + 1:]) AS s FROM h LEFT JOIN h b ON b.c = h.c - h.c % 100),
m AS (SELECT c, d, s[1:d] AS p, len(s) = d AS ended FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
n AS (SELECT d, p, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(CASE WHEN ended THEN c::VARCHAR END, ',' ORDER BY c), '') AS ends FROM m GROUP BY d, p),
k AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
e AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d = 0 THEN 0 ELSE (n_convs - 1) * length(n.p[n.d].t) END AS own FROM n LEFT JOIN k USING (d, p)),
t AS (SELECT a AS d, p[1:a] AS p, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM e) GROUP BY ALL)
SELECT e.conv_id, e.d::BIGINT AS depth, u.conv_id AS parent_conv_id, e.n_convs, e.n_children, t.n_leaves, t.saved::BIGINT AS saved_tokens, sha256(e.ends) AS ends_sha256
FROM e JOIN t ON t.d = e.d AND t.p = e.p LEFT JOIN e u ON e.d > 0 AND u.d = e.d - 1 AND u.p = e.p[1:e.d - 1]
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_records": op1_token_records,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_packing": op3_packing,
    "op4_url_filters": op4_url_filters,
    "op5_language_id": op5_language_id,
    "op6_quality_rules": op6_quality_rules,
    "op7_chunk_encoding": op7_chunk_encoding,
    "op8_pii": op8_pii,
    "op9_near_dedup": op9_near_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_fill_middle": op11_fill_middle,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_prefix_trie": op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op2_exact_dedup": OP2_SQL,
    "op9_near_dedup": OP9_SQL,
    "op11_fill_middle": OP11_SQL,
    "op12_substring_dedup": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
