"""A query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.catalog.tables import read
from splitloom.llm import alignment, automaton, bottomk, conversations, ctw, mixing, neighbours, packing, secrets, sharding, simhash, toxicity, warczip
from splitloom.llm.common import id_bucket

#: Target weights of the languages; equal shares.
LANGUAGES = {"de": 1.0, "en": 1.0, "es": 1.0, "fr": 1.0}
SHARDS = 24


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def labelled_languages(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents of the label table with their language as domain; hashed before the join."""
    known = labels.select("doc_id").where("doc_id IS NOT NULL").distinct()
    rows = docs.select("doc_id", "text", F.col("lang").alias("domain"), F.xxhash64("text").alias("text_hash"))
    return rows.join(known, "doc_id", "left_semi").drop("doc_id")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, labelled_languages(docs, read(spark, sf_dir, "labels")), LANGUAGES)
    names = F.array(*[F.lit(name) for name in sorted(LANGUAGES)])
    top = F.array_max("posterior")
    return mixed.select(
        "doc_id", "tokens", F.get(names, F.array_position("posterior", top).cast("int") - 1).alias("domain"),
        top.alias("membership"), "rate", "copies",
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"), words_each=4, max_bits=4)
    return found.select("doc_id", "fingerprint", "component_id")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warczip.round_trip(read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    return neighbours.nearest(table, table.where("vec_id % 20 = 0"), k=20)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "word", "part", F.length("value").alias("length"), F.sha2("value", 256).alias("value_sha256"),
        "probability", "is_secret",
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.minimax_shards(read(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


def op9_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    rows = docs.select(
        "doc_id", "text", (id_bucket("doc_id", 7) != 2).alias("train"), ctw.stored_blocks(docs, "lang").alias("block")
    )
    return ctw.score(rows).withColumn("held_out", ~F.col("train")).drop("train")


def op10_bottomk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bottomk.fingerprint_documents(read(spark, sf_dir, "documents"))
    sketch, edited = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        bottomk.digest(sketch).alias("fingerprint"), bottomk.digest(edited).alias("edited_fingerprint"),
        bottomk.resemblance(sketch, edited).alias("near_edited"),
        bottomk.resemblance(sketch, F.col("next_sketch")).alias("near_next"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return alignment.score(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = automaton.encode(read(spark, sf_dir, "documents"), vocabulary())
    return rows.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256")
    )


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    return conversations.summaries(conversations.repair(conversations.damaged(table), table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    function.__name__: function
    for function in (
        op1_mixing, op2_toxicity, op3_simhash, op4_warc, op5_neighbours, op6_secrets, op7_sharding, op8_packing,
        op9_ctw, op10_bottomk, op11_alignment, op12_bpe, op13_conversations,
    )
}

ORACLE: dict[str, str] = {
    "op4_warc": """
        WITH payloads AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), firsts AS (
            SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY 1
        )
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN f.first IS NOT NULL AND f.first IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END
                   AS record_type,
               CASE WHEN f.first IS DISTINCT FROM p.page_id THEN f.first END AS refers_to
        FROM payloads p LEFT JOIN firsts f ON f.payload_digest = p.payload_digest
    """,
}
