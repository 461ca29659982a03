"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starcell.llm import classifier, idfiles, jaccard, langid, merkle, mixing, packing, phrases, quality, sql, suffixes, tokens, urlrules, vectors
from starcell.session import fresh_path

BPE_50K = public_tokenizers.path("byte_bpe_50k.json")
PIECE_32K = public_tokenizers.path("piece_bpe_32k.model")

URL_RULES = (urlrules.Rule("block", "net/"), urlrules.Rule("allow", "example.net/en/"),
             urlrules.Rule("block", "example.com/de/"), urlrules.Rule("allow", "org/fr/"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.mark_repeats(docs, 200).drop("text")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vectors.near_duplicates(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0.9)
    return found.drop("embedding")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, PIECE_32K, 4096).drop("text")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlrules.judge(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op5_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "ids")
    idfiles.write(table(spark, sf_dir, "documents"), path, BPE_50K, end_id=0)
    return idfiles.documents(spark, path, with_ids=False)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BPE_50K, 2048, end_id=0)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(docs).drop("text").select(*named, *[m for m in quality.MEASURES if m not in named])


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labels = table(spark, sf_dir, "labels").where(fold != 0).select("doc_id", F.col("quality").alias("label"))
    model = classifier.fit(docs, labels)
    return classifier.score(docs, model, 0.3).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")


MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.8, 2, 7


def mix_tree() -> mixing.Tree:
    """Given sources by number: the web is half of the mix, whatever it is of the corpus."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return mixing.Tree(
        levels={"domain": F.when(number < 8, "web").when(number < 14, "books").otherwise("news"),
                "language": F.col("lang"), "source": F.col("source")},
        weights={("web",): 5, ("books",): 3, ("news",): 2,
                 **{(domain, language): weight for domain in ("web", "books", "news")
                    for language, weight in (("en", 6), ("de", 2), ("fr", 2), ("es", 1))}})


def mix_tokens() -> Column:
    """A text's tokens by estimate: a quarter of its bytes."""
    return F.ceil(F.octet_length("text") / 4)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = mix_tree()
    mixed = mixing.mix(docs, tree, mix_tokens(), MIX_SHARE, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", *[c.alias(n) for n, c in tree.levels.items()],
                        mix_tokens().alias("n_tokens"), F.col("__epoch").alias("epoch"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard.classes(docs, 5, 75).select("doc_id", "n_shingles", "component_id")


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = langid.fit(docs.where(fold != 0), PIECE_32K)
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit("")))
    return merkle.audit(docs, tampered={"text": F.coalesce(cut, "text")})


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {f.__name__: f for f in (
    op1_suffix_dedup, op2_embedding_dedup, op3_token_counts, op4_url_filters, op5_id_files, op6_best_fit_packing, op7_quality_rules,
    op8_quality_classifier, op9_source_mix, op10_jaccard_join,
    op11_language_id, op12_merkle_manifest, op13_phrase_mining)}
SQL = {
    "op2_embedding_dedup": sql.EMBEDDINGS,
    "op4_url_filters": sql.URLS,
    "op7_quality_rules": sql.quality(quality.MAX_COVERED, quality.MAX_LINE_COVERED, quality.MAX_SYMBOLS_PCT),
    "op9_source_mix": sql.mix(MIX_SHARE, MIX_EPOCHS, MIX_SEED),
    "op10_jaccard_join": sql.JACCARD,
    "op12_merkle_manifest": sql.MERKLE,
    "op13_phrase_mining": sql.PHRASES,
}
