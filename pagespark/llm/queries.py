"""Registered queries of the operators, each over its whole table, with SQL twins where SQL can say it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagespark.llm import decontaminate as D
from pagespark.llm import entropy as E
from pagespark.llm import hashtree as H
from pagespark.llm import jaccard as J
from pagespark.llm import licences as LI
from pagespark.llm import merkle as K
from pagespark.llm import middle as M
from pagespark.llm import pieces as P
from pagespark.llm import pseudonyms as N
from pagespark.llm import repetition as R
from pagespark.llm import styletree as S
from pagespark.llm import switchlang as L
from pagespark.llm import toxicity as T
from pagespark.llm.folds import held_out
from pagespark.llm.textbytes import small_batches

TOKENIZERS = os.environ.get("TOKENIZERS_FOLDER", "/opt/tokenizers")
PIECE_MODEL = os.path.join(TOKENIZERS, "piece_bpe_32k.model")
KEY = "pseudonym-key-1"  # a job passes its own

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sha(column):
    return F.sha2(column, 256)


def op1(spark: SparkSession, folder: str) -> DataFrame:
    found = D.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = D.hit_words(F.col("hits"))
    ids = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
                        sha(ids).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i+9], ' ') AS s, least(len(w), 10) AS n
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
spots AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1], ' ') AS s
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, spots.n AS n FROM spots JOIN win USING (s, n)),
words AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hits GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def op2(spark: SparkSession, folder: str) -> DataFrame:
    return J.near_duplicates(table(spark, folder, "documents"))


def op3(spark: SparkSession, folder: str) -> DataFrame:
    return R.judged(R.repetition(table(spark, folder, "documents")))


def op4(spark: SparkSession, folder: str) -> DataFrame:
    return H.shard_documents(table(spark, folder, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5(spark: SparkSession, folder: str) -> DataFrame:
    return N.pseudonymise(table(spark, folder, "documents").select("doc_id", "text"), KEY)


def op6(spark: SparkSession, folder: str) -> DataFrame:
    return S.main_text(table(spark, folder, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"), "n_removed")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = E.scan_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in E.KINDS],
                        sha(_joined(F.filter("spans", lambda s: s["kind"] != "entropy"))).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return L.identify(docs, L.fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = T.score(docs, T.fit(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= T.THRESHOLD).cast("int").alias("predicted"))


def encoded(docs: DataFrame) -> DataFrame:
    found = P.encode_pieces(docs, PIECE_MODEL)
    listed = lambda c: sha(F.array_join(F.col(c).cast("array<string>"), " "))
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), listed("ids").alias("ids_sha256"),
                        sha(F.col("decoded")).alias("decoded_sha256"), F.hash("starts", "stops").alias("spans_hash"))


def op10(spark: SparkSession, folder: str) -> DataFrame:
    return encoded(table(spark, folder, "documents"))


def op11(spark: SparkSession, folder: str) -> DataFrame:
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    names = F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"])))
    return LI.scan_licences(table(spark, folder, "documents")).select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(names, ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score")


def op12(spark: SparkSession, folder: str) -> DataFrame:
    return M.fill_in_middle(table(spark, folder, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
        sha(M.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
           sha256('7:' || doc_id) AS h FROM documents),
g AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
      CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a+1:b], '') AS mid, array_to_string(u[b+1:n], '') AS suf FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(pre || mid || suf) AS restored_sha256
FROM p"""


def op13(spark: SparkSession, folder: str) -> DataFrame:
    tampered = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 2 == 0
    found = K.manifest(table(spark, folder, "documents"), tampered, F.translate("text", "\n", ""))
    return found.select("doc_id", "leaf", "subroot", "root", sha(F.array_join("proof", "")).alias("proof_sha256"),
                        "folded_root", "verified")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


LLM_QUERIES: dict[str, Query] = {
    "op1_decontaminate": op1, "op2_jaccard_join": op2, "op3_repetition": op3, "op4_hash_tree": op4, "op5_pseudonyms": op5,
    "op6_style_tree": op6, "op7_entropy_secrets": op7, "op8_switch_language": op8, "op9_toxicity": op9, "op10_pieces": op10,
    "op11_licence_scan": op11, "op12_wavelet_middle": op12, "op13_merkle_midstates": op13, "pipeline": pipeline,
}

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 90 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a, b FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a) USING (doc_id)"""

LLM_ORACLES: dict[str, str] = {"op1_decontaminate": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op12_wavelet_middle": OP12_SQL}


def oracles() -> dict[str, str]:
    import corpus_pipeline

    return LLM_ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
