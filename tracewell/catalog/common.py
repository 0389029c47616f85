"""What the catalogue's queries and their SQL share: tables of the driver, and token and score expressions in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[\p{L}\p{N}_]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, *cols: str) -> DataFrame:
    """Float sums depend on the order of rows in their last digits; what is compared does not."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in cols})


def near(sql: str, digits: int = 6) -> str:
    """The same in SQL (adding 0 makes -0 the plain 0)."""
    return f"(round({sql}, {digits}) + 0.0)"


def sql_parts(word: str) -> str:
    """Lower-cased parts of an identifier."""
    cut = rf"regexp_replace(regexp_replace({word}, '([\p{{Ll}}0-9])(\p{{Lu}})', '\1_\2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1_\2', 'g')"
    return f"[lower(p) FOR p IN string_split({cut}, '_') IF p <> '']"


def sql_terms(text: str) -> str:
    """Terms of a text without CJK: each word, then its parts."""
    bare = "trim(w, '_')"
    return f"flatten([[lower({bare})] || [q FOR q IN {sql_parts(bare)} IF length(q) >= 2 AND q <> lower({bare})] FOR w IN regexp_extract_all({text}, '{WORDS}') IF length({bare}) >= 2])"


def sql_dph(tf: str, dl: str, avg: str, n: str, cf: str) -> str:
    f = f"({tf}) / ({dl})"
    gain = f"({tf}) * log2((({tf}) * ({avg}) / ({dl})) * (({n}) / ({cf}))) + 0.5 * log2(2 * pi() * ({tf}) * greatest(1 - {f}, 1e-12))"
    return f"CASE WHEN ({tf}) <= 0 OR ({dl}) <= 0 OR ({cf}) <= 0 THEN 0.0 ELSE pow(1 - {f}, 2) / (({tf}) + 1) * ({gain}) END"


class Book:
    """Queries by name, with the SQL of those that SQL can express."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = sql.strip()
            return f

        return put
