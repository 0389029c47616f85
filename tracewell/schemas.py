"""The stored tables and the constants of the data model."""

from __future__ import annotations

SCHEMA_VERSION = 4
DERIVATION = "derive-v3"

#: Evidence tables hold what was read; derived tables can always be computed again from them.
EVIDENCE = {
    "files": "path string, hash string, size long",
    "units": "id string, parent string, kind string, path string, start_line int, end_line int, label string, text string, is_leaf boolean, len double, ord long",
    "postings": "term string, unit_id string, tf double, path string",
    "definitions": "unit_id string, name string, kind string, path string",
    "mentions": "unit_id string, name string, kind string, line int, path string",
    "commits": "id string, ts long, subject string, body string, merge boolean, seq long",
    "hunks": "commit_id string, path string, start_line int, len int",
    "commit_blobs": "commit_id string, path string, blob string",
    "stat_cache": "path string, size long, mtime_ns long, checked_ns long",
}
DERIVED = {
    "fpostings": "field string, term string, doc string, tf double, path string",
    "fdocs": "field string, doc string, len double, path string",
    "edges": "src string, dst string, kind string, origin string, weight double, line int",
    "hist_postings": "term string, unit_id string, tf double",
    "hist_docs": "unit_id string, len double",
    "unit_changes": "unit_id string, commit_id string",
    "cochange": "src string, dst string, weight double",
    "closure": "ancestor string, descendant string, depth int",
}
TABLES = EVIDENCE | DERIVED

# Fixed values of the data model: kinds, fields, limits, weights and thresholds decide what is found and in which order.

UNIT_KINDS = ("file", "module", "type", "impl", "function", "method", "section", "paragraph", "code_block", "gap")
#: Kinds whose ids hold an ordinal and so shift when something is inserted before them.
ORDINAL_KINDS = ("paragraph", "code_block", "gap")
UNIT_FIELDS = ("code", "name", "path", "history")

TEXT_LIMIT, TEXT_WEIGHT_WITH_ANCHOR = 400, 0.25
LIMITS = {"text": TEXT_LIMIT, "refs_in": 50, "refs_out": 50, "tree_near": 30, "same_file": 30, "cochange": 50}
WEIGHTS = {"refs_in": 0.8, "refs_out": 0.8, "tree_near": 0.3, "same_file": 0.2, "cochange": 0.5}
RANK_CAP, TEST_FILES, TESTS_SHOWN = 200, 5, 3
TITLE_BOOST, VIA_LEAST = 1.5, 0.005
#: Scores are sums whose last digits depend on the order of rows; ranks compare them to this many decimals.
RANK_DIGITS = 9
LIFT_SIBLINGS, LIFT_LINES = 4, 300
K_MIN, K_MAX, MASS, GAP_TIE = 5, 10, 0.5, 1e-12
TAU_DAYS, SUPPORT, MAX_SET = 365.0, 2, 40
BRIDGE_CAP, JACCARD_LEAST = 3, 0.3
PARAGRAPH_LINES, GAP_LINES = 40, 60
FILE_BYTES, NUL_WINDOW, RACY_SECONDS = 2 * 1024 * 1024, 8192, 2
FIND_LIMIT, AMBIGUOUS_SHOWN, HISTORY_DEPTH = 50, 10, 5000
