"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import conversations, decontam, embed_dedup, langid, licenses, manifest, neighbours, packing, quality, simhash, sql, substring_dedup, suffix_dedup, token_counts
from wayfold.llm.common import crc_remainder, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


QUALITY_FOLD, LANGUAGE_FOLD = 5, 4


def quality_model(docs: DataFrame, labels: DataFrame) -> quality.Machine:
    return quality.fit(docs, labels.where(crc_remainder("doc_id", QUALITY_FOLD) != 0))


@query("op8_quality_machine")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality_model(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", (crc_remainder("doc_id", QUALITY_FOLD) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op9_simhash_blocks")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op7_fm_substrings", sql.OP7)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents"))
    removed = F.aggregate("intervals", F.lit(0).cast("long"), lambda total, x: total + x.stop - x.start)
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents")))


@query("op2_license_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("spans")


@query("op3_lattice_neighbours", sql.OP3)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_language_pieces")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_remainder("doc_id", LANGUAGE_FOLD) == 2
    found = langid.predict(docs, langid.fit(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op5_template_decontamination")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), per_window=True)


@query("op6_suffix_intervals", sql.OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query("op10_edited_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents before and after their personal data is redacted."""
    counted = token_counts.update(token_counts.build(table(spark, sf_dir, "documents")), token_counts.redactions)
    return counted.select("doc_id", "n_tokens_before", "n_tokens", "n_edits", "n_encoded", F.length("text").cast("long").alias("n_chars"))


TAMPER_FOLD = 7


@query("op11_merkle_manifest", sql.OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest of all documents, and what becomes of the proofs when some documents' `n_chars` is off by one."""
    values = {c: F.col(c) for c in manifest.LEAF_FIELDS}
    tampered = manifest.leaf(*(values | {"n_chars": F.col("n_chars") + 1}).values())
    own = manifest.leaf(*values.values())
    shown = F.when((crc_remainder("doc_id", TAMPER_FOLD) == 0) & F.col("n_chars").isNotNull(), tampered).otherwise(F.lit(None))
    leaves = table(spark, sf_dir, "documents").select(manifest.group_key(F.col("lang")).alias("grp"), "doc_id", own.alias("leaf"), shown.alias("shown"))
    found = manifest.manifest(leaves).withColumn("shown", F.coalesce("shown", "leaf"))
    return manifest.verify(found, "shown").select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


#: What a remainder of the damage does to a row.
DROPPED, EMPTIED, UNSTOPPED, DOUBLED, MISNAMED = range(5)


def damaged(rows: DataFrame) -> DataFrame:
    """Turns with the contract's damage; `copies` is how often a row stands there afterwards. Nulls read as one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(case == EMPTIED, "").when(case == UNSTOPPED, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    copies = F.when(case == DROPPED, 0).when(case == DOUBLED, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(case == MISNAMED, "user").otherwise(blank("role")).alias("role"), text.alias("text"), copies.alias("copies"))


@query("op12_conversation_repair", sql.OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repair of all conversations after damage."""
    return conversations.report(conversations.repair(damaged(table(spark, sf_dir, "conversations")), copies_col="copies"))


QUERY_FOLD = 50


@query("op13_dimension_scan", sql.OP13)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(rows, rows.where(F.col("vec_id") % QUERY_FOLD == 0))
