"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.bytes import chain
from tagloom.llm import chat, decontaminate, exact, forest, language, maintext, mixing, neardup, periodic, pii, toxicity, urls, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(n: int) -> F.Column:
    """What decides whether a document may be learnt from."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def held_out(n: int, rest: int) -> F.Column:
    """Whether a document is held out; one without an id is neither held out nor learnt from."""
    return F.coalesce(remainder(n) == rest, F.lit(False)).alias("held_out")


#: The rules of the url query: verdict, host and beginning of the path.
RULES = (
    (urls.ALLOW, "org/"),
    (urls.BLOCK, "example.org/es/"),
    (urls.BLOCK, "example.org/en/1"),
    (urls.ALLOW, "com/fr/"),
    (urls.BLOCK, "com/de/"),
)
#: Stands for the key that a production job takes from its secret store.
PSEUDONYM_KEY = b"key of the registered query"
#: A conversation whose texts hold the template's control strings.
QUOTING = "\\### Assistant: </turn> ok"


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.fit(docs.where(remainder(4) != 2), "doc_id", "text", "lang")
    return language.identify(docs, filters).select(
        "doc_id", held_out(4, 2), "lang_pred", "score", "coverage"
    )


def main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    # The url goes along in the id, so that nothing is joined.
    named = pages.select(F.struct("page_id", "url").alias("page"), "html")
    return maintext.extract(named, "page").select(
        "page.page_id", "page.url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(remainder(3) != 1))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(3, 1), "score", "predicted"
    )


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    quoting = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(QUOTING).alias("text"),
    )
    return chat.read_back(chat.format_chats(turns.unionByName(quoting)))


def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.judge_rows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def with_periods(docs: DataFrame) -> DataFrame:
    """``docs`` in a tenth of which, by a hash of doc_id, the words from one on repeat a period.

    Let h be the hash, g its tenth and n the number of words: those from a = g % n on repeat the 1 + (n - a) div (3 + g % 8) words from a on.
    """
    h = "crc32(CAST(doc_id AS STRING))"
    words = r"regexp_extract_all(text, r'([^\x20\x09-\x0D]+)', 1)"
    repeated = chain(
        [
            ("g", f"{h} DIV 10"),
            ("w", words),
            ("a", "CAST(g % size(w) AS INT)"),
            ("p", "1 + CAST((size(w) - a) DIV (3 + g % 8) AS INT)"),
        ],
        "array_join(transform(w, (x, i) -> IF(i < a, x, w[a + (i - a) % p])), ' ')",
    )
    drawn = F.expr(f"{h} % 10 = 0") & F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(drawn, F.expr(repeated)).otherwise(F.col("text")).alias("text"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.find_runs(with_periods(table(spark, sf_dir, "documents")))
    best = periodic.longest_repetition(F.col("runs"))
    lines = F.expr("transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n'))")
    # The outer generator keeps the run from being looked for once a column.
    return found.select("*", F.explode_outer(F.array(best)).alias("best")).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": url_filter,
    "op2_near_duplicates": near_duplicates,
    "op3_language_id": language_id,
    "op4_main_text": main_text,
    "op5_toxicity": toxicity_scores,
    "op6_exact_duplicates": exact_duplicates,
    "op7_source_mix": source_mix,
    "op8_chat_windows": chat_windows,
    "op9_pseudonyms": pseudonyms,
    "op10_decontamination": decontamination,
    "op11_periodic_runs": periodic_runs,
    "op12_embedding_whitening": embedding_whitening,
    "op13_embedding_duplicates": embedding_duplicates,
}
