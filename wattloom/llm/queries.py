"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattloom.llm import bpe, colloc, dac, decontam, embed, golay, hdlang, linededup, pii, sketches, spelling, suffix, warc
from wattloom.llm.common import new_path, staged, table

#: Where the vocabulary file lies; set it to use another copy.
TOKENIZER: str | None = None
#: Secret of the surrogates; a job of its own sets one of its own.
PII_KEY = b"wattloom-surrogates"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def tokenizer_path() -> str:
    if TOKENIZER:
        return TOKENIZER
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def wrap(build):
        QUERIES[name] = build
        if sql:
            ORACLE[name] = sql
        return build
    return wrap


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.edited_pairs(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                      sketches.as_text(F.col("sketch")).alias("fingerprint"), sketches.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                      sketches.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
                      sketches.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
                      sketches.distinct_shingles(F.col("sketch")).alias("shingles"),
                      sketches.containment(F.col("edited_sketch"), F.col("sketch")).alias("edited_contained"))


@query("op2_line_dedup", """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS line FROM documents),
w AS (SELECT doc_id, i AS pos, 3 AS lines, array_to_string(line[i + 1:i + 3], chr(10)) AS content FROM l, unnest(range(len(line) - 2)) r(i)
      UNION ALL
      SELECT doc_id, i, 1, line[i + 1] FROM l, unnest(range(len(line))) r(i) WHERE length(line[i + 1]) - length(replace(line[i + 1], ' ', '')) >= 49),
later AS (SELECT doc_id, pos, lines FROM w WHERE trim(replace(content, chr(10), '')) <> ''
          QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc_id, pos) > 1),
gone AS (SELECT doc_id, list(DISTINCT i) AS gone FROM later, unnest(range(pos, pos + lines)) r(i) GROUP BY doc_id)
SELECT doc_id, len(line) AS n_lines, coalesce(len(gone), 0) AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN line ELSE list_transform(list_filter(range(len(line)), lambda i: NOT list_contains(gone, i)), lambda i: line[i + 1]) END, chr(10))) AS kept_sha256
FROM l LEFT JOIN gone USING (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    out = linededup.dedup(docs, lines_name="n_lines", removed_name="n_removed")
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query("op3_suffix_dedup", """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, pos, md5(h[2 * pos + 1:2 * pos + 800]) AS k FROM b, unnest(range(length(h) // 2 - 399)) r(pos)),
r AS (SELECT doc_id, pos FROM p QUALIFY count(*) OVER (PARTITION BY k) > 1),
g AS (SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS step FROM r),
c AS (SELECT doc_id, pos, sum(CASE WHEN step <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM g),
s AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 400 AS hi FROM c GROUP BY ALL),
z AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
k AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS upto, string_agg(h[2 * before + 1:2 * lo], '' ORDER BY lo) AS kept FROM z JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(CASE WHEN n_spans IS NULL THEN unhex(h) ELSE unhex(kept || h[2 * upto + 1:]) END) AS kept_sha256,
       decode(unhex(array_to_string(list_filter(regexp_extract_all(CASE WHEN n_spans IS NULL THEN h ELSE kept || h[2 * upto + 1:] END,
         '[CD].[89AB].|E.[89AB].[89AB].|F.[89AB].[89AB].[89AB].|..'), lambda x: length(x) > 2 OR x < '80'), ''))) AS kept_text
FROM b LEFT JOIN k USING (doc_id)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove(documents(spark, sf_dir), keep_first=False)
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "kept_text")


@query("op4_directly_addressable_codes")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    dac.write(documents(spark, sf_dir), folder, tokenizer_path())
    return dac.documents(dac.read(spark, folder))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = hdlang.identify(docs, ["doc_id"], learn=~hdlang.held_out() & F.col("doc_id").isNotNull())
    return out.select("doc_id", hdlang.held_out().alias("held_out"), "lang_pred", "score")


@query("op6_golay_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = golay.near_duplicates(documents(spark, sf_dir))
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


@query("op7_bpe_round_trip")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), tokenizer_path())


@query("op8_pii_surrogates")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace(documents(spark, sf_dir).select("doc_id", "text"), PII_KEY, count_name="n_entities")


@query("op9_warc_chunked_records", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
g AS (SELECT page_id, html, min(page_id) OVER (PARTITION BY html) AS first FROM p),
hexed AS (SELECT page_id, first, html, strlen(html) AS payload_bytes, sha1(html) AS hex FROM g),
bits AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31 AS INTEGER), 1), '' ORDER BY k) AS digest
         FROM hexed, range(32) r(k) GROUP BY page_id)
SELECT page_id, payload_bytes, digest AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hexed JOIN bits USING (page_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    planned = warc.plan(staged(warc.measure(pages), "measured"))
    folder = new_path(spark, "archives")
    warc.records(pages, planned).write.option("compression", "zstd").parquet(folder)
    kind = pages.schema["page_id"].dataType
    found = warc.read(spark.read.parquet(folder))
    return found.select(F.col("id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


@query("op10_decontamination")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.matches(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "edits", "windows", F.col("of").alias("item_windows"))


@query("op11_spelling_variants")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


@query("op12_embedding_near_dedup", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
ok AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM e WHERE label IS NOT NULL AND v IS NOT NULL
       AND list_count(v) = len(v) AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
          WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.93),
reach AS (WITH RECURSIVE r(vec_id, other) AS (SELECT a, b FROM links UNION SELECT r.vec_id, links.b FROM r JOIN links ON links.a = r.other) SELECT vec_id, min(other) AS other FROM r GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id, least(vec_id, coalesce(other, vec_id)) = vec_id AS kept
FROM e LEFT JOIN n USING (vec_id) LEFT JOIN reach USING (vec_id)""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = embed.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


@query("op13_collocations", r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
g AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, w[i:i + size - 1] AS parts FROM w, unnest([1, 2, 3]) s(size), unnest(range(1, len(w) - size + 2)) r(i)),
f AS (SELECT lang, size, phrase, any_value(parts) AS parts, count(*) AS f FROM g GROUP BY lang, size, phrase),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE size > 1 AND f >= 10),
k AS (SELECT c.lang, c.size, c.phrase, c.f AS a, k, l.f AS l, r.f AS r, (c.f::HUGEINT * c.f * 1000000) // (l.f::HUGEINT * r.f) AS score
      FROM c, unnest(range(1, c.size)) x(k) JOIN f l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(c.parts[1:k], ' ')
      JOIN f r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(c.parts[k + 1:c.size], ' ')),
best AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY lang, size, phrase ORDER BY score, k) = 1),
kept AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.size = 3 AND b.size = 2 AND c.lang = b.lang AND 100 * c.f >= 50 * b.a
         AND b.phrase IN (array_to_string(c.parts[1:2], ' '), array_to_string(c.parts[2:3], ' '))))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = colloc.ranked(colloc.collocations(documents(spark, sf_dir)), 2000)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle_statements() -> dict[str, str]:
    return {k: v.strip() for k, v in ORACLE.items()}
