"""The op queries of the training-data operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, exact_dedup, license_scan, minhash, mixing, mpeg_audio, packing, pii, prefix_trie, sentence_dedup, suffix_dedup, toxicity
from .common import save, tables


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(tables(spark, sf_dir, "documents"))


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    stored = mpeg_audio.write_audio(docs, mpeg_audio.payload_of(F.col("text")))
    a = mpeg_audio.read_audio(stored)
    payload = F.col("audio.payload")
    feature = F.format_string("frames=%d;samples=%d;rate=%d;vbr=%s;crc=%d/%d;junk=%d;first=%d;last=%d", "audio.n_frames", "audio.samples", "audio.sample_rate", "audio.is_vbr", F.col("audio.crc_checked") - F.col("audio.crc_bad"), "audio.crc_checked", "audio.junk_bytes", F.element_at("audio.seek_offsets", 1), F.element_at("audio.seek_offsets", -1))
    return a.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.substring(payload, -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), "audio.duration", "audio.seek_offsets")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(tables(spark, sf_dir, "documents"))


def coded(docs: DataFrame) -> DataFrame:
    """doc_id with the digests of a text's tokens; the pipeline ends with this as well."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    tokens = byte_bpe.encode(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN)
    return tokens.select("doc_id", byte_bpe.digests(F.col("token_ids"), path).alias("d")).select("doc_id", "d.*")


QUERIES = {"op4_exact_dedup": op4_exact_dedup, "op6_mpeg_audio": op6_mpeg_audio, "op10_byte_bpe": op10_byte_bpe}
ORACLE_SQL = {"op4_exact_dedup": OP4_SQL}


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(tables(spark, sf_dir, "documents").select("doc_id", "text"))
    x = lambda name: F.col(f"licence.{name}")
    return found.select("doc_id", x("n_words"), x("places").alias("n_base"), x("first_word"), x("last_word"), x("base_labels"), x("labels"), x("score"))


def _is(kind: str):
    return lambda s: F.when(s["kind"] == kind, 1)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(tables(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["base"])
    counts = [F.size(F.array_compact(F.transform(base, _is(k)))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    size = lambda keep: F.size(F.filter("pii", keep)).cast("long")
    more = [F.size("pii").cast("long").alias("n_spans"), size(lambda s: s["kind"] == "secret").alias("n_secret"), size(lambda s: ~s["base"] & (s["kind"] != "secret")).alias("n_other")]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"), *more)


QUERIES |= {"op1_license_scan": op1_license_scan, "op2_pii": op2_pii}


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, tables(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model).drop("text")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    x = F.col("toxicity.score")
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), x.alias("score"), (x >= toxicity.THRESHOLD).cast("int").alias("predicted"), F.col("toxicity.worst").alias("worst_sentence"), F.col("toxicity.offending").alias("offending"))


QUERIES |= {"op9_toxicity": op9_toxicity}


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(tables(spark, sf_dir, "documents"))


def op7_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.remove_repeated_spans(tables(spark, sf_dir, "documents"))


QUERIES |= {"op3_minhash": op3_minhash, "op7_sentence_dedup": op7_sentence_dedup}


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    mixed = mixing.mix_documents(docs, stored=lambda df: save(df.drop("text"), "measured"))
    cell = lambda i: F.element_at("mix.cell", i)
    return mixed.select("doc_id", cell(1).alias("source"), cell(2).alias("lang"), cell(3).alias("topic"), "mix.tokens", "mix.weight", "mix.probability", "mix.selected")


QUERIES |= {"op5_mixing": op5_mixing}


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(tables(spark, sf_dir, "documents")).drop("kept")


QUERIES |= {"op8_suffix_dedup": op8_suffix_dedup}


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(tables(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                     regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
              FROM documents),
words AS (SELECT d, lang, source, unnest(terms) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM words GROUP BY ALL HAVING count(DISTINCT d) >= 3),
langs AS (SELECT lang, count(*)::HUGEINT AS v, sum(total)::HUGEINT AS all_n FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(v, 0) AS v, coalesce((SELECT sum(n) FROM own o WHERE o.lang = g.lang AND o.source = g.source), 0)::HUGEINT AS size
           FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN langs USING (lang)),
ps AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000 * (coalesce(n, 0) + 1)) // (g.size + g.v) AS p,
              1 + (1000000000 * (total + 1)) // (all_n + g.v) AS q
       FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
          FROM ps a JOIN ps b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(value, 0) AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN pairs p ON p.lang = g.lang AND p.source = g.source AND p.item = h.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM ps WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM every)
WHERE part = 'pair' OR rank <= 200
"""

QUERIES |= {"op13_source_divergence": op13_source_divergence}
ORACLE_SQL["op13_source_divergence"] = OP13_SQL


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(tables(spark, sf_dir, "conversations"))


#: CRC-32 by eight shifts a byte, over the digits of conv_id.
OP12_SQL = """
WITH own AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, role, text) AS turns
             FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
crc AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT),
                      lambda c, b: list_reduce([xor(c, b)] || [0::BIGINT, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 9 AS h FROM own),
built AS (SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, turns[1:d] AS k, d, len(turns) = d AS ends FROM built, unnest(range(0, len(turns) + 1)) AS u(d)),
nodes AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, array_to_string(list(conv_id ORDER BY conv_id) FILTER (WHERE ends), ',') AS ends FROM prefixes GROUP BY k, d),
kids AS (SELECT k[1:d - 1] AS k, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
placed AS (SELECT n.*, n_children FROM nodes n LEFT JOIN kids USING (k)),
below AS (SELECT k[1:a] AS k, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum(CASE WHEN d > 0 THEN (n - 1) * strlen(k[d].text) ELSE 0 END) AS saved
          FROM placed, unnest(range(0, d + 1)) AS u(a) GROUP BY 1)
SELECT p.conv_id, p.d::BIGINT AS depth, q.conv_id AS parent_conv_id, p.n AS n_convs, coalesce(p.n_children, 0) AS n_children, n_leaves,
       saved::BIGINT AS saved_tokens, sha256(coalesce(p.ends, '')) AS ends_sha256
FROM placed p JOIN below b ON b.k = p.k LEFT JOIN nodes q ON p.d > 0 AND q.k = p.k[1:p.d - 1] AND q.d = p.d - 1
"""

QUERIES |= {"op12_prefix_trie": op12_prefix_trie}
ORACLE_SQL["op12_prefix_trie"] = OP12_SQL


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(tables(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(pieces)[0].drop("uid")


QUERIES |= {"op11_packing": op11_packing}
