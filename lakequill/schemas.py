"""Schemas, enumerations and row checks of the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The allowed values of the enumerated columns.
SPLITS = ("dev", "test")
SIZES = (256, 512, 1024, 2048)
PROVIDERS = ("qwen", "qwen4b", "qwen8b", "nemotron", "nemotron8b")

PAGE = "id string, title string, text string, language string, country string, categories array<string>, latitude double, longitude double, url string, char_count long, word_count long, machine_generated boolean, summary string, fetched_at string"
CHUNK = "id string, page_id string, size long, n long, title string, breadcrumb string, text string, tokens long, role string"
VECTOR = "provider string, size long, chunk_id string, vec array<float>"
QUESTION = "question_id string, page_id string, qtype string, text string, quotes array<string>, answer_ok boolean, split string"
RANKING = "method string, query_id string, rank int, chunk_id string, score double"
QREL = "question_id string, chunk_id string"
SOURCE_URL = "source string, url string"
FETCHED = "id string, source string, url string, final_url string, status int, content_type string, language string, title string, sha256 string, char_count long, error string, fetched_at timestamp, text string"
TABLES = {"pages": PAGE, "chunks": CHUNK, "vectors": VECTOR, "questions": QUESTION, "rankings": RANKING, "qrels": QREL, "source_urls": SOURCE_URL, "fetched": FETCHED}


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df, whose reading fails with the rule's name at the first row that breaks one; null counts as broken."""
    broken = F.lit(None).cast("string")
    for name, ok in reversed(rules.items()):
        broken = F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)).otherwise(broken)
    first = df.columns[0]
    return df.withColumn(first, F.when(broken.isNotNull(), F.raise_error(F.concat(F.lit("row breaks rule: "), broken)).cast(df.schema[first].dataType)).otherwise(F.col(first)))


def chunk_rules() -> dict[str, Column]:
    return {
        "id": F.col("id") == F.concat_ws(":", "page_id", F.col("size").cast("string"), F.col("n").cast("string")),
        "size": F.col("size").isin(*SIZES),
        "text": F.length("text") > 0,
        "tokens": F.col("tokens") <= F.col("size") + 50,
        "role": F.coalesce(F.length("role") <= 300, F.lit(True)),
    }


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def orphans(df: DataFrame, key: str, parents: DataFrame, parent_key: str) -> DataFrame:
    return df.join(parents.select(F.col(parent_key).alias(key)), key, "left_anti")
