"""Task and query files: JSON lines in, ranked lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASK = "id string, created long, base string, head string, text string"
QUERY = "id string, text string"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Tasks, one a line; blank lines are left out. A task without time was created after everything."""
    return spark.read.schema(TASK).json(path).where("id is not null").withColumn("created", F.coalesce("created", F.lit((1 << 63) - 1)))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, text) of query lines; ids of any JSON type are kept as they are written."""
    return spark.read.schema(QUERY).json(path).where("text is not null").select(F.col("id").alias("qid"), "text")


def write_ranks(hits: DataFrame, tests: DataFrame, path: str) -> None:
    """A line {id, hits, tests} for each query, ids of units in order of rank. Both have (qid, doc, rank)."""

    def ordered(df: DataFrame, name: str) -> DataFrame:
        listed = F.array_sort(F.collect_list(F.struct("rank", "doc")))  # a query's hits: at most k
        return df.groupBy("qid").agg(F.transform(listed, lambda x: x["doc"]).alias(name))

    none = F.array().cast("array<string>")
    both = ordered(hits, "hits").join(ordered(tests, "tests"), "qid", "full")
    both.select(F.col("qid").alias("id"), F.coalesce("hits", none).alias("hits"), F.coalesce("tests", none).alias("tests")).write.mode("overwrite").json(path)


def pull_request_tasks(pulls: DataFrame) -> DataFrame:
    """(id, created, base, head, text) of merged pull requests (number, author_is_bot, title, body, merged_at, head).

    Bots are left out, comments in HTML dropped, bodies cut at 2000 characters; the base is the commit before the head.
    """
    body = F.substring(F.trim(F.regexp_replace(F.coalesce("body", F.lit("")), "(?s)<!--.*?-->", "")), 1, 2000)
    text = F.concat_ws("\n\n", "title", F.when(body != "", body))
    created = F.unix_timestamp(F.to_timestamp("merged_at"))
    return pulls.where("not author_is_bot").select(F.col("number").cast("string").alias("id"), created.alias("created"), F.concat("head", F.lit("^1")).alias("base"), "head", text.alias("text")).orderBy("created")
