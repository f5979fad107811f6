"""Registered queries of the training-data operators: thin digests over the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.llm import divergence, hamming, idfile, lines, merkle, packing, pii, quality, secrets, sharding, simhash, sql, transducer, warc
from leadloom.llm.common import table, work_folder
from leadloom.llm.tokens import vocabulary_file

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
TOP_K = 10


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = idfile.round_trip(table(spark, sf_dir, "documents"), vocabulary_file(BYTE_BPE), end_id=2)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans(table(spark, sf_dir, "documents"), keep=["doc_id"])
    one = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda kind: F.filter("spans", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in pii.BASE]
    digest = F.sha2(F.array_join(F.transform(base, one), ",").cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), F.array_join(F.transform("spans", one), ",").alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.kept_digests(table(spark, sf_dir, "documents"))


def op4_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.search(codes, codes.filter(F.col("id") % 50 == 0), TOP_K)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=3)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary_file(PIECES)
    back = transducer.decoded(transducer.encoded(table(spark, sf_dir, "documents"), path), path)
    return back.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary_file(BYTE_BPE), end_id=1, capacity=2048).drop("ids")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in counts))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.uniform_shards(table(spark, sf_dir, "documents"), shards=8)
    text = F.coalesce(F.col("text"), F.lit(""))
    dealt = dealt.withColumns({"size": (F.octet_length(text) + 1).cast("long"), "text_crc32": F.crc32(text)})
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_folder(spark)
    warc.write_bundles(table(spark, sf_dir, "pages"), path, least_bytes=1000)
    back = warc.records(spark, path, payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_documents=30, top_terms=50)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc_id, n_chars = F.col("doc_id").cast("long"), F.col("n_chars").cast("long")
    leaf = lambda n: merkle.leaf_of(doc_id, F.col("source"), F.col("lang"), n, F.col("text"))
    tampered = F.when(F.crc32(doc_id.cast("string")) % 7 == 0, leaf(n_chars + 1)).otherwise(leaf(n_chars))
    manifest = merkle.build(table(spark, sf_dir, "documents"), F.col("lang"), [doc_id], leaf(n_chars), doc_id=doc_id, claimed=tampered)
    return merkle.proofs(manifest)


_ALL = (
    op1_token_ids, op2_pii, op3_line_dedup, op4_hamming_top_k, op5_simhash, op6_pieces, op7_packing,
    op8_quality, op9_sharding, op10_secrets, op11_warc, op12_divergence, op13_merkle,
)
QUERIES = {f.__name__: f for f in _ALL}
SQL: dict[str, str] = {
    "op3_line_dedup": sql.LINES,
    "op11_warc": sql.WARC,
    "op12_divergence": sql.DIVERGENCE,
    "op13_merkle": sql.MERKLE,
    "op4_hamming_top_k": f"""
WITH signs AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x > 0) AS bits FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
pairs AS (
  SELECT q.id AS query_id, r.id AS neighbour_id,
    len(list_filter(list_zip(q.bits, r.bits), lambda z: z[1] <> z[2]))::INTEGER AS distance
  FROM signs q, signs r WHERE q.id % 50 = 0 AND q.id <> r.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id)::INTEGER AS rank FROM pairs)
SELECT query_id, rank, neighbour_id, distance FROM ranked WHERE rank <= {TOP_K}
""",
}
