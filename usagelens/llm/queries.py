"""The registered queries of this subpackage, one per operator, with SQL where SQL can state the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelens.llm import covertree, langid, lines, merkle, minhash, mixing, packing, phrases, quality, secrets, topk, toxicity, warc
from usagelens.llm.common import table
from usagelens.sources.workspace import fresh_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


@query
def op1_embedding_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, folder, "embeddings"), threshold=0.9)


ORACLE_SQL["op1_embedding_near_dups"] = r"""
WITH RECURSIVE whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM whole a JOIN whole b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reached AS (
  SELECT a AS vec_id, a AS other FROM links UNION SELECT vec_id, b FROM reached JOIN links ON other = a),
labels AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
degrees AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
       coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN degrees USING (vec_id) LEFT JOIN labels USING (vec_id)"""


@query
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.line_classes(table(spark, folder, "documents"), **lines.WHOLE)


@query
def op3_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mix_sources(table(spark, folder, "documents"))
    return mix.docs.select("doc_id", "size", "source_size", "target", "taken")


ORACLE_SQL["op3_mix_sources"] = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5(doc_id::VARCHAR) AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (SELECT *, rank % 3 + 1 AS weight, 3 * source_size AS cap FROM sources),
levels AS (
  SELECT *, cap / weight AS full_at,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, rank, source_size,
         least(cap::DOUBLE, coalesce((SELECT arg_min(level, (full_at, rank)) FROM levels WHERE level <= full_at) * weight, cap::DOUBLE)) AS target
  FROM levels),
served AS (
  SELECT doc_id, s.source, size, draw, rank, source_size, target,
         sum(size) OVER (PARTITION BY rank ORDER BY draw, size ROWS UNBOUNDED PRECEDING) AS served
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
pairs AS (
  SELECT doc_id, size, rank, draw, pass, (served + source_size * (pass - 1))::DOUBLE / target AS finish
  FROM served, (VALUES (1), (2), (3)) AS p(pass) WHERE size > 0),
ordered AS (
  SELECT doc_id, size, sum(size) OVER (ORDER BY finish, rank, draw, pass ROWS UNBOUNDED PRECEDING) AS words FROM pairs),
taken AS (
  SELECT doc_id, sum(size) AS taken FROM ordered WHERE words <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT doc_id, size::BIGINT AS size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM served LEFT JOIN taken USING (doc_id)"""


@query
def op4_warc_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    archives = fresh_path(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), archives)
    return warc.read_pages(spark, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


ORACLE_SQL["op4_warc_roundtrip"] = r"""
WITH page AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS digest FROM pages),
firsts AS (
  SELECT digest, min(page_id) AS first_page FROM page WHERE octet_length(payload) >= 100 GROUP BY digest)
SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_page <> page_id THEN first_page END AS refers_to, true AS intact
FROM page LEFT JOIN firsts USING (digest)"""


@query
def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    machine = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_minhash_near_dups(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op7_pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    learn_from = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 != 1, F.lit(True))
    return secrets.scan(table(spark, folder, "documents"), learn_from=learn_from)


@query
def op9_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, folder, "labels"))
    return quality.classify(table(spark, folder, "documents"), trusted)


@query
def op10_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLE_SQL["op10_top_k"] = r"""
WITH whole AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 5"""


@query
def op11_phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


ORACLE_SQL["op11_phrase_mining"] = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
sizes AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
occurrence AS (
  SELECT lang, k, array_to_string(w[i: i + k - 1], ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, range(1, 6) AS r(k) WHERE len(w) >= k)),
found AS (SELECT lang, k AS words, phrase, count(*) AS c FROM occurrence GROUP BY lang, k, phrase HAVING count(*) >= 100),
longer AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[i: i + k - 1], ' ') AS phrase, c AS a
  FROM (SELECT lang, phrase, c, words, k, unnest(range(1, words - k + 2)) AS i FROM found, range(2, 5) AS r(k) WHERE words > k)),
candidate AS (SELECT lang, words, phrase, c AS a FROM found ANTI JOIN longer ON found.lang = longer.lang AND found.phrase = longer.phrase AND found.c = longer.a WHERE words > 1),
cut AS (
  SELECT lang, words, phrase, a, k, array_to_string(string_split(phrase, ' ')[1: k], ' ') AS part, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, words)) AS k FROM candidate)),
scored AS (
  SELECT cut.lang, cut.phrase, a, cut.k, f.c AS l, g.c AS r, n, ((1000::HUGEINT * a * n) // (f.c::HUGEINT * g.c))::BIGINT AS score
  FROM cut JOIN found f ON cut.lang = f.lang AND part = f.phrase JOIN found g ON cut.lang = g.lang AND rest = g.phrase JOIN sizes ON cut.lang = sizes.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000"""


@query
def op12_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs, remainder = table(spark, folder, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.train(docs, F.coalesce(remainder != 2, F.lit(False)))
    held_out = F.coalesce(remainder == 2, F.lit(False)).alias("held_out")
    return langid.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


@query
def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return merkle.manifest(table(spark, folder, "documents"), tampered)


#: CRC-32 of the decimal digits of a number, by the table of its polynomial; the levels of a tree are unrolled by recursion.
ORACLE_SQL["op13_merkle_manifest"] = r"""
WITH RECURSIVE crc_steps AS (
  SELECT i AS i, 0 AS k, i AS c FROM range(256) AS r(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END FROM crc_steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc_steps WHERE k = 8),
page AS (
  SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS tree,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
           || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         text, doc_id::VARCHAR AS id_text
  FROM documents),
digits AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(id_text, ''), lambda x: ord(x)::BIGINT)),
           lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) AS crc32
  FROM page, crc WHERE id_text IS NOT NULL),
leaf AS (
  SELECT r, doc_id, tree, sha256(head || coalesce(octet_length(encode(text)) || ':' || text, '-')) AS leaf,
         sha256(head || coalesce(octet_length(encode(text)) || ':' || CASE WHEN crc32 % 3 = 0
           THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END, '-')) AS found
  FROM page LEFT JOIN digits USING (r)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rank, count(*) OVER (PARTITION BY tree) AS n FROM leaf),
node AS (
  SELECT 0 AS level, tree, rank AS i, n, leaf AS digest FROM ranked
  UNION ALL
  SELECT level + 1, tree, i // 8, ceil(any_value(n) / 8)::BIGINT, sha256(string_agg(digest, '' ORDER BY i)) FROM node WHERE n > 1 GROUP BY level, tree, i // 8),
top AS (SELECT tree, digest AS subroot FROM node WHERE n = 1),
forest AS (SELECT sha256(string_agg(subroot, '' ORDER BY tree)) AS root FROM top),
fold AS (
  SELECT r, 0 AS level, tree, rank AS i, n, found AS node, '' AS proof FROM ranked
  UNION ALL
  SELECT r, level + 1, tree, i // 8, ceil(n / 8)::BIGINT,
         sha256(array_to_string(list_transform(family, lambda x, k: CASE WHEN k = i % 8 + 1 THEN node ELSE x END), '')),
         proof || array_to_string(list_filter(family, lambda x, k: k <> i % 8 + 1), '')
  FROM fold JOIN (SELECT level, tree, i // 8 AS p, list(digest ORDER BY i) AS family FROM node WHERE n > 1 GROUP BY level, tree, i // 8) AS f
    USING (level, tree) WHERE n > 1 AND i // 8 = p),
done AS (
  SELECT r, tree, node, proof, (SELECT list(subroot ORDER BY tree) FROM top) AS all_roots, (SELECT list(tree ORDER BY tree) FROM top) AS trees FROM fold WHERE n = 1),
proved AS (
  SELECT r, tree, sha256(proof || array_to_string(list_filter(all_roots, lambda x, k: trees[k] <> tree), '')) AS proof_sha256,
         sha256(array_to_string(list_transform(all_roots, lambda x, k: CASE WHEN trees[k] = tree THEN node ELSE x END), '')) AS folded_root
  FROM done)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified
FROM leaf JOIN proved USING (r, tree) JOIN top USING (tree), forest"""
