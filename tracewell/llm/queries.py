"""The thin queries of this subpackage and their SQL, for the registry at the top of the repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, decontaminate, exact_dedup, langid, linededup, packing, simhash, substrings, toxicity, warc
from .common import in_fold, read_table

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def vocabulary() -> str:
    """The packing query's tokenizer file; packing itself takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability under context-tree weighting and under a unigram base."""
    return ctw.score_corpus(read_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that an earlier one equals, or comes within an edit of: counts and digest."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    done = linededup.dedup_lines(docs, count_col="n_removed")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return done.select("doc_id", lines.alias("n_lines"), "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


#: Two lines within an edit have an equal first or second half, counted from the nearer end; levenshtein() then decides.
OP3_SQL = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND text <> ''),
o AS (SELECT doc_id, k, ls[k] AS line FROM d, unnest(range(1, len(ls) + 1)) AS t(k) WHERE regexp_matches(ls[k], '[^ \\t\\n\\v\\f\\r]')),
f AS (SELECT line, length(line) AS n, min(struct_pack(d := doc_id, k := k)) AS place FROM o GROUP BY line),
c AS (SELECT *, left(line, n // 2) AS a0, left(line, (n - 1) // 2) AS a1, right(line, n - n // 2) AS b0, right(line, (n - 1) - (n - 1) // 2) AS b1 FROM f WHERE n >= 20),
near AS (
  SELECT x.line FROM c x JOIN c y ON x.n = y.n AND x.a0 = y.a0 WHERE y.place < x.place AND levenshtein(x.line, y.line) <= 1
  UNION SELECT x.line FROM c x JOIN c y ON x.n = y.n AND x.b0 = y.b0 WHERE y.place < x.place AND levenshtein(x.line, y.line) <= 1
  UNION SELECT x.line FROM c x JOIN c y ON x.n = y.n - 1 AND x.a0 = y.a1 WHERE y.place < x.place AND levenshtein(x.line, y.line) <= 1
  UNION SELECT x.line FROM c x JOIN c y ON x.n = y.n - 1 AND x.b0 = y.b1 WHERE y.place < x.place AND levenshtein(x.line, y.line) <= 1
  UNION SELECT x.line FROM c x JOIN c y ON x.n - 1 = y.n AND x.a1 = y.a0 WHERE y.place < x.place AND levenshtein(x.line, y.line) <= 1
  UNION SELECT x.line FROM c x JOIN c y ON x.n - 1 = y.n AND x.b1 = y.b0 WHERE y.place < x.place AND levenshtein(x.line, y.line) <= 1
),
gone AS (SELECT o.doc_id, list(o.k) AS ks FROM o JOIN f ON o.line = f.line WHERE struct_pack(d := o.doc_id, k := o.k) <> f.place OR o.line IN (SELECT line FROM near) GROUP BY o.doc_id),
done AS (
  SELECT documents.doc_id, documents.text IS NULL AS none, coalesce(len(ks), 0) AS n,
    coalesce(array_to_string([x[1] FOR x IN list_zip(string_split(documents.text, chr(10)), range(1, len(string_split(documents.text, chr(10))) + 1)) IF NOT list_contains(coalesce(ks, []), x[2])], chr(10)), '') AS text
  FROM documents LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, CASE WHEN none THEN 0 ELSE len(string_split(text, chr(10))) END::BIGINT AS n_lines, n::BIGINT AS n_removed, sha256(text) AS text_sha256 FROM done
"""


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of each document lie in 8-word windows of benchmark items, and of which items."""
    found = decontaminate.decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n = F.size("items").cast("long")
    return found.select("doc_id", "n_words", "n_hit", n.alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n >= 2).alias("contaminated"))


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), win AS (
  SELECT DISTINCT item_id, w[p : least(p + 7, len(w))] AS win FROM i, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS t(p) WHERE len(w) > 0
), f AS (
  SELECT item_id, win, win[1] AS first, len(win) AS n FROM win
), tok AS (
  SELECT r, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)
), hit AS (
  SELECT tok.r, tok.p, f.item_id, f.n FROM tok JOIN f ON tok.word = f.first JOIN d ON d.r = tok.r WHERE tok.p + f.n - 1 <= len(d.w) AND d.w[tok.p : tok.p + f.n - 1] = f.win
), words AS (
  SELECT r, count(DISTINCT q) AS n_hit FROM hit, unnest(range(p, p + n)) AS t(q) GROUP BY r
), items AS (
  SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that near-duplicate an earlier passage of the corpus, with their sources."""
    return substrings.substring_dedup(read_table(spark, sf_dir, "documents"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint and the component of its near-duplicates."""
    done = simhash.simhash(read_table(spark, sf_dir, "documents"))
    return done.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language under a model of three of four folds."""
    docs = read_table(spark, sf_dir, "documents")
    out = in_fold(F.col("doc_id"), 4, 2)
    model = langid.train(docs.where(~out))
    return langid.identify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, written to dictionary-compressed archives and read back."""
    return warc.archive_pages(read_table(spark, sf_dir, "pages"))


#: Base32 of SHA-1: 40 hex digits are 8 groups of 5 digits, and a group is 4 letters.
OP8_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
g AS (SELECT page_id, b, max(page_id) OVER (PARTITION BY b) AS top, sha1(b) AS h FROM p),
five AS (SELECT page_id, b, top, [('0x' || substr(h, 5 * i + 1, 5))::BIGINT FOR i IN range(8)] AS v FROM g)
SELECT page_id, octet_length(b) AS payload_bytes,
  list_aggregate(flatten([[substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> (15 - 5 * j)) & 31)::INTEGER + 1, 1) FOR j IN range(4)] FOR x IN v]), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM five
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's toxicity under a model of two of three folds."""
    docs = read_table(spark, sf_dir, "documents")
    out = in_fold(F.col("doc_id"), 3, 1)
    model = toxicity.train(docs.where(~out), read_table(spark, sf_dir, "labels"))
    return toxicity.toxicity(docs, model).select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the one that stays of its equals."""
    return exact_dedup.exact_dedup(read_table(spark, sf_dir, "documents"))


OP10_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_lm_scoring, op2_best_fit_packing, op3_line_dedup, op4_benchmark_decontamination, op5_substring_dedup, op6_simhash_near_dedup, op7_language_id, op8_warc, op9_toxicity, op10_exact_dedup)}


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": OP3_SQL, "op8_warc": OP8_SQL, "op4_benchmark_decontamination": OP4_SQL, "op10_exact_dedup": OP10_SQL}
