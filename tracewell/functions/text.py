"""Tokens, names and paths as Column expressions: all of it stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = "\\uAC00-\\uD7A3\\u1100-\\u11FF\\u3130-\\u318F\\u3040-\\u30FF\\u4E00-\\u9FFF"
ALNUM = "\\p{IsAlphabetic}\\p{N}"
RUNS = f"[{ALNUM}_&&[^{CJK}]]+|[{CJK}]+"
HUMPS = "(?<=[\\p{IsLowercase}0-9])(?=\\p{IsUppercase})|(?<=\\p{IsUppercase})(?=\\p{IsUppercase}\\p{IsLowercase})|_+"
TEST_DIRS = ("test", "tests", "testing", "__tests__", "spec", "specs")


def split_identifier(word: Column) -> Column:
    """Lower-cased parts of an identifier: at underscores and where its case says so."""
    return F.transform(F.filter(F.split(word, HUMPS), lambda p: p != ""), lambda p: F.lower(p))


def word_terms(word: Column) -> Column:
    """The whole word (two characters or more), then its parts where it has several.

    Most words have neither capitals nor underscores: such a word is one part, and no other branch is evaluated for it.
    """
    plain = F.when(F.char_length(word) >= 2, F.array(F.lower(word))).otherwise(F.array().cast("array<string>"))
    return F.when(word.rlike("[_\\p{IsUppercase}]"), _parted(F.trim(word, F.lit("_")))).otherwise(plain)


def _parted(bare: Column) -> Column:
    whole, none = F.lower(bare), F.array().cast("array<string>")
    parts = split_identifier(bare)
    others = F.filter(parts, lambda p: (F.char_length(p) >= 2) & (p != whole))
    return F.when(F.char_length(whole) < 2, none).otherwise(F.concat(F.array(whole), F.when(F.size(parts) > 1, others).otherwise(none)))


def bigrams(run: Column) -> Column:
    """Overlapping character pairs; a single character is kept."""
    n = F.char_length(run)
    return F.when(n < 2, F.array(run)).otherwise(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(run, i, F.lit(2))))


def tokenize_raw(text: Column) -> Column:
    """All terms of a text in order, duplicates kept, without stems."""
    runs = F.regexp_extract_all(text, F.lit(RUNS), 0)
    return F.flatten(F.transform(runs, lambda r: F.when(r >= "\u1100", F.when(r.rlike(f"^[{CJK}]"), bigrams(r)).otherwise(word_terms(r))).otherwise(word_terms(r))))


def lines(text: Column) -> Column:
    """Lines split at LF with an optional CR before it; no last empty line."""
    parts = F.split(text, "\r?\n", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def first_line(text: Column) -> Column:
    return F.regexp_extract(text, "^([^\r\n]*)", 1)


def is_identifier_shaped(word: Column) -> Column:
    """Whether a bare word looks like code: three characters or more, with a path, an underscore or mixed case."""
    w = F.regexp_replace(word, f"^[^{ALNUM}_]+|[^{ALNUM}_]+$", "")
    upper, lower = "\\p{IsUppercase}", "\\p{IsLowercase}"
    mixed = w.rlike(f"{lower}{upper}") | (w.rlike(f"^{upper}.*{upper}") & w.rlike(lower))
    return (F.char_length(w) >= 3) & (w.contains("::") | w.contains("_") | mixed)


def path_text(path: Column) -> Column:
    return F.translate(path, "/.", "  ")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def name_text(unit_id: Column, path: Column) -> Column:
    """Identifiers of the id after its path, and the file's stem up to its first dot."""
    rest = F.when(unit_id.startswith(F.concat(path, F.lit("::"))), F.substring(unit_id, F.char_length(path) + 3, F.char_length(unit_id))).otherwise(F.lit(""))
    names = F.filter(F.regexp_extract_all(rest, F.lit("[A-Za-z0-9_]+"), 0), lambda n: ~n.rlike("^[0-9]"))
    return F.array_join(F.concat(names, F.array(F.substring_index(file_name(path), ".", 1))), " ")


def is_test(unit_id: Column, path: Column) -> Column:
    """Whether a unit is test code, by directory, file name or an inline tests module."""
    stem = F.regexp_replace(file_name(path), "(?<=.)\\.[^.]*$", "")
    named = stem.startswith("test_") | stem.rlike("(_test|\\.test|\\.spec|_spec)$") | (stem == "conftest")
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, TEST_DIRS))) | named | unit_id.contains("::tests::")


def signature(text: Column) -> Column:
    """The first line that says something: not blank and no attribute or decorator, cut at 100 characters."""
    bare = F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != "")
    best = F.coalesce(F.get(F.filter(bare, lambda x: ~x.rlike("^(#\\[|#!\\[|@)")), F.lit(0)), F.get(bare, F.lit(0)), F.lit(""))
    return F.when(F.char_length(best) > 100, F.concat(F.substring(best, 1, 100), F.lit("…"))).otherwise(best)


def short_name(unit_id: Column, path: Column) -> Column:
    """A unit's name for people: what its id adds to the path, at most its last two segments."""
    rest = F.when(unit_id.startswith(path), F.substring(unit_id, F.char_length(path) + 1, F.char_length(unit_id))).otherwise(unit_id)
    bare = F.when(rest.startswith("::"), F.substring(rest, F.lit(3), F.char_length(rest))).otherwise(F.regexp_replace(rest, "^[#/]+", ""))
    return F.when(bare == "", F.lit("(file)")).otherwise(F.substring_index(bare, "/", -2))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; two empty ones are the same."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def is_trivial(line: Column) -> Column:
    return line.rlike("^[\\s{}()\\[\\];,]*$")


def slugify(heading: Column) -> Column:
    return F.lower(F.regexp_replace(F.translate(F.trim(heading), " ", "-"), f"[^{ALNUM}_-]", ""))


def token_cost(text: Column) -> Column:
    """Tokens a reader pays: a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(text) / 4).cast("long")


def is_prose(path: Column) -> Column:
    return path.rlike("\\.(md|rst|txt)$")


def extension(path: Column) -> Column:
    """What follows the last dot of the whole path, lower-cased; empty if there is none."""
    return F.when(path.contains("."), F.lower(F.substring_index(path, ".", -1))).otherwise(F.lit(""))


def path_and_line(ref: Column) -> Column:
    """struct(path, line) of ``path:line``, null for anything else."""
    line = F.regexp_extract(ref, "^(.*[^:]):(\\d+)$", 2)
    return F.when(line != "", F.struct(F.regexp_extract(ref, "^(.*[^:]):(\\d+)$", 1).alias("path"), line.cast("int").alias("line")))


def dph(tf: Column, dl: Column, avg: Column, n: Column, cf: Column) -> Column:
    """Bits of a term by the parameter-free DPH model; may be negative, 0 without evidence."""
    f = tf / dl
    gain = tf * F.log2((tf * avg / dl) * (n / cf)) + F.lit(0.5) * F.log2(F.lit(2 * 3.141592653589793) * tf * F.greatest(1 - f, F.lit(1e-12)))
    return F.when((tf <= 0) | (dl <= 0) | (cf <= 0), F.lit(0.0)).otherwise(F.pow(1 - f, F.lit(2.0)) / (tf + 1) * gain)
