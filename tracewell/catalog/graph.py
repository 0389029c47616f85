"""Queries of derived relations, lookups and scorers over a graph of units.

The driver's tables stand in for the index: documents define a name (their first word) in the file of their source
and mention names (the words of their last line); orders are commits that touch parts; regions, nations and
customers are a tree; conversations are files whose turns are units in order; events fall on spans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokenize_raw
from ..operators import lookups, ranking, relations
from ..schemas import RANK_DIGITS
from .common import Book, near, rounded, sql_terms, table

BOOK = Book()
#: Kinds of mentions by language.
KINDS = {"en": "call", "fr": "method", "de": "bridge", "es": "type"}


def seconds(ts):
    """Unix seconds of a timestamp without time zone, whatever the session's is."""
    return F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = docs.select(F.lower(F.regexp_extract("text", "[\\p{L}\\p{N}_]+", 0)).alias("name"), "source").where("name <> ''")
    symbols = words.select(F.concat_ws("::", "source", "name").alias("unit_id"), "name", F.lit("symbol").alias("kind"), F.col("source").alias("path"))
    anchors = docs.select(F.concat_ws("#", "source", "lang").alias("unit_id"), F.col("lang").alias("name"), F.lit("anchor").alias("kind"), F.col("source").alias("path"))
    return symbols.unionByName(anchors).distinct()


def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("ls", F.split("text", "\n"))
    kind = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in KINDS.items()], F.lit("import"))
    unit, line = F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("unit_id"), F.size("ls").alias("line")
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.element_at("ls", -1)), F.lit("[\\p{L}\\p{N}_]+"), 0))
    said = docs.select(unit, F.explode(words).alias("name"), kind.alias("kind"), line, F.col("source").alias("path"))
    links = docs.select(unit, F.col("lang").alias("name"), F.lit("link").alias("kind"), line, F.col("source").alias("path"))
    return said.unionByName(links)


SQL_EDGES = f"""defs AS (
  SELECT DISTINCT lower(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+')) AS name, source || '::' || lower(regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+')) AS dst, false AS anchor, source AS dpath FROM documents WHERE regexp_extract(text, '[\\p{{L}}\\p{{N}}_]+') <> ''
  UNION SELECT DISTINCT lang, source || '#' || lang, true, source FROM documents),
ls AS (SELECT doc_id, source, CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in KINDS.items())} ELSE 'import' END AS kind, string_split(text, chr(10)) AS ls, lang FROM documents),
men AS (
  SELECT DISTINCT 'doc' || doc_id AS src, unnest(regexp_extract_all(lower(ls[-1]), '[\\p{{L}}\\p{{N}}_]+')) AS name, kind, len(ls)::INTEGER AS line, source AS path, false AS anchor FROM ls
  UNION ALL SELECT 'doc' || doc_id, lang, 'link', len(ls)::INTEGER, source, true FROM ls),
cand AS (SELECT m.*, d.dst, d.dpath, bool_or(d.dpath = m.path AND m.kind NOT IN ('link', 'bridge')) OVER (PARTITION BY src, m.name, kind, line) AS own
  FROM men m JOIN defs d ON m.name = d.name AND m.anchor = d.anchor WHERE m.kind <> 'bridge' OR d.dpath <> m.path),
mass AS (SELECT *, count(*) OVER (PARTITION BY src, name, kind, line) AS m FROM cand WHERE NOT own OR dpath = path),
kept AS (SELECT *, CASE WHEN kind = 'link' THEN 'explicit' WHEN kind = 'bridge' THEN 'bridge' WHEN own THEN 'same_file' ELSE 'global' END AS origin,
  1.0 / (m + CASE WHEN kind = 'method' THEN 1 ELSE 0 END) AS w FROM mass WHERE (kind <> 'bridge' OR m <= 3) AND dst <> src),
edges AS (SELECT src, dst, kind, min(origin) AS origin, sum(w) AS weight, min(line) AS line FROM kept GROUP BY src, dst, kind)"""
SQL_EDGE_ROWS = f"WITH {SQL_EDGES} SELECT src, dst, kind, origin, {near('weight', 9)} AS weight, line FROM edges"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.resolve(definitions(spark, sf_dir), mentions(spark, sf_dir))


@BOOK.add(SQL_EDGE_ROWS)
def resolve_edges(spark, sf_dir):
    """Reference edges of all mentions."""
    return rounded(edges(spark, sf_dir), 9, "weight")


@BOOK.add(SQL_EDGE_ROWS + " WHERE kind = 'method'")
def resolve_method_mass(spark, sf_dir):
    """Edges of methods, which share one more part of their mass with code outside."""
    return rounded(relations.resolve(definitions(spark, sf_dir), mentions(spark, sf_dir).where("kind = 'method'")), 9, "weight")


@BOOK.add(SQL_EDGE_ROWS + " WHERE kind = 'bridge'")
def resolve_bridge_cap(spark, sf_dir):
    """Edges of prose to code: to other files, and only where at most three symbols are meant."""
    return rounded(relations.resolve(definitions(spark, sf_dir), mentions(spark, sf_dir).where("kind = 'bridge'")), 9, "weight")


@BOOK.add(SQL_EDGE_ROWS + " WHERE origin = 'same_file'")
def resolve_same_file(spark, sf_dir):
    """Edges that a definition in the mention's own file decides."""
    return rounded(edges(spark, sf_dir).where("origin = 'same_file'"), 9, "weight")


@BOOK.add("""SELECT DISTINCT translate(n, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS asked, source || '::' || n AS unit_id FROM (SELECT source, lower(regexp_extract(text, '[\\p{L}\\p{N}_]+')) AS n FROM documents) WHERE n <> '' AND source IS NOT NULL""")
def symbol_definitions(spark, sf_dir):
    """Definers of every name, asked for in upper case (A-Z only, as the lookup has it)."""
    defs = definitions(spark, sf_dir)
    asked = defs.where("kind = 'symbol'").where("name <> ''").select(F.translate("name", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ").alias("name"))
    return lookups.symbol_definitions(defs, asked)


def touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit, ts, unit): orders and their parts."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), seconds(F.col("o_orderdate")).alias("ts"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("unit")).join(orders, "commit").distinct()


SQL_COCHANGE = f"""sets AS (SELECT DISTINCT o_orderkey AS c, floor(epoch(o_orderdate))::BIGINT AS ts, l_partkey AS u FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
sized AS (SELECT sets.c, u, exp(-greatest((SELECT arg_max(ts, c) FROM sets) - ts, 0) / (365.0 * 86400.0)) / (n - 1) AS w FROM sets JOIN (SELECT c, count(*) AS n FROM sets GROUP BY c HAVING count(*) BETWEEN 2 AND 40) z ON z.c = sets.c),
half AS (SELECT a.u AS a, b.u AS b, sum(a.w) AS weight FROM sized a JOIN sized b ON a.c = b.c AND a.u < b.u GROUP BY a.u, b.u HAVING count(*) >= 2 AND sum(a.w) > 0),
pairs AS (SELECT a AS src, b AS dst, weight FROM half UNION ALL SELECT b, a, weight FROM half)"""


@BOOK.add(f"WITH {SQL_COCHANGE} SELECT src, dst, {near('weight', 9)} AS weight FROM pairs")
def cochange_pairs(spark, sf_dir):
    """Parts that are ordered together, recent orders more."""
    return rounded(relations.cochange(touched(spark, sf_dir)), 9, "weight")


@BOOK.add(f"""WITH {SQL_COCHANGE}, s AS (SELECT a.p_brand AS anchor, dst AS doc, sum(weight) AS score FROM pairs JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand GROUP BY 1, 2)
SELECT anchor, doc, {near('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, {RANK_DIGITS}) DESC, doc) AS rank FROM s) WHERE rank <= 50""")
def cochange_neighbors(spark, sf_dir):
    """The 50 parts outside a brand that are most ordered with its parts."""
    anchors = table(spark, sf_dir, "part").select(F.col("p_brand").alias("anchor"), F.col("p_partkey").alias("unit"))
    scores = relations.neighbours(relations.cochange(touched(spark, sf_dir)), anchors)
    return rounded(ranking.top_k(scores, 50, by=["anchor"], positive=False), 6, "score")


SQL_HISTORY = f"""sets AS (SELECT DISTINCT l_orderkey AS c, l_partkey AS u FROM lineitem),
small AS (SELECT c, u FROM sets WHERE c IN (SELECT c FROM sets GROUP BY c HAVING count(*) <= 40)),
words AS (SELECT o_orderkey AS c, unnest({sql_terms("o_orderpriority || ' ' || o_orderstatus")}) AS term FROM orders),
post AS (SELECT term, u AS unit_id, count(*)::DOUBLE AS tf FROM small JOIN words ON words.c = small.c GROUP BY term, u)"""


def history(spark: SparkSession, sf_dir: str):
    messages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("message"))
    sets = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("commit"), F.col("l_partkey").alias("unit"))
    return relations.history_field(sets, messages, stems=False)


@BOOK.add(f"WITH {SQL_HISTORY} SELECT * FROM post")
def history_field(spark, sf_dir):
    """Words of orders at the parts they touch."""
    return history(spark, sf_dir)[1]


@BOOK.add(f"WITH {SQL_HISTORY} SELECT u AS unit_id, c AS commit_id FROM small")
def unit_changes(spark, sf_dir):
    """Which order touched which part."""
    return history(spark, sf_dir)[0]


@BOOK.add(f"WITH {SQL_HISTORY}, docs AS (SELECT unit_id, sum(tf) AS len FROM post GROUP BY unit_id) SELECT term, unit_id, tf, len FROM post JOIN docs USING (unit_id) WHERE unit_id IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def hist_postings(spark, sf_dir):
    """History postings of the parts that are still there (here: the larger ones), with lengths."""
    _, postings, docs = history(spark, sf_dir)
    return lookups.hist_postings(postings, docs, table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_partkey").alias("id")))


SPANS = 6


def hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.col("user_id").cast("string").alias("path"), F.floor(seconds(F.col("ts")) / 3600).cast("int").alias("h"), (F.lit(1) + F.pmod(F.floor(F.col("value")), F.lit(13))).cast("int").alias("len"))


SQL_SPANS = f"""e AS (SELECT event_id, user_id::VARCHAR AS path, (floor(epoch(ts))::BIGINT // 3600)::INTEGER AS h, (1 + ((floor(value)::BIGINT % 13) + 13) % 13)::INTEGER AS len FROM events),
u AS (SELECT DISTINCT path, h // {SPANS} AS k FROM e)"""


@BOOK.add(f"WITH {SQL_SPANS} SELECT DISTINCT event_id AS commit, e.path || '/' || k AS unit FROM e JOIN u ON e.path = u.path WHERE k * {SPANS} <= h + len - 1 AND h <= k * {SPANS} + {SPANS - 1}")
def hunk_touch(spark, sf_dir):
    """Which spans of its user's time an event overlaps."""
    e = hours(spark, sf_dir)
    leaves = e.select("path", F.floor(F.col("h") / SPANS).alias("k")).distinct().select("path", F.concat_ws("/", "path", F.col("k").cast("string")).alias("unit"), (F.col("k") * SPANS).alias("start_line"), (F.col("k") * SPANS + SPANS - 1).alias("end_line"))
    return relations.hunk_touch(e.select(F.col("event_id").alias("commit"), "path", F.col("h").alias("start_line"), "len"), leaves, ["path"]).select("commit", "unit")


@BOOK.add(f"""WITH {SQL_SPANS}, s AS (SELECT path, k * {SPANS} AS a, k * {SPANS} + {SPANS - 1} AS b, path || '/' || k AS id, true AS leaf FROM u UNION SELECT path, (k // 4) * {4 * SPANS}, (k // 4) * {4 * SPANS} + {4 * SPANS - 1}, path || '/day' || (k // 4), false FROM u),
m AS (SELECT DISTINCT e.path, h AS line, id, b - a AS span, leaf, a FROM e JOIN s ON e.path = s.path AND h BETWEEN a AND b)
SELECT path, line, id FROM m QUALIFY row_number() OVER (PARTITION BY path, line ORDER BY span, NOT leaf, a, id) = 1""")
def unit_at_point(spark, sf_dir):
    """The smallest of nested spans around each event."""
    e = hours(spark, sf_dir)
    k = e.select("path", F.floor(F.col("h") / SPANS).alias("k")).distinct()

    def spans(width, name, leaf):
        b = F.floor(F.col("k") * SPANS / width)
        return k.select("path", F.concat("path", F.lit("/" + name), b.cast("string")).alias("id"), (b * width).alias("start_line"), (b * width + width - 1).alias("end_line"), F.lit(leaf).alias("is_leaf"), (b * width).alias("ord")).distinct()

    return lookups.units_at(spans(SPANS, "", True).unionByName(spans(4 * SPANS, "day", False)), e.select("path", F.col("h").alias("line")))


@BOOK.add(f"""WITH t AS (SELECT conv_id, role, conv_id || '/¶' || turn AS id, list_sort(list_distinct({sql_terms('text')})) AS w FROM conversations),
j AS (SELECT a.id AS old_id, a.conv_id::VARCHAR AS path, b.id, len(list_intersect(a.w, b.w)) / len(list_distinct(a.w || b.w)) AS j FROM t a JOIN t b ON a.conv_id = b.conv_id WHERE a.role = 'user' AND b.role <> 'user' AND len(a.w || b.w) > 0)
SELECT old_id, path, id FROM j WHERE j >= 0.05 QUALIFY row_number() OVER (PARTITION BY old_id ORDER BY j DESC, id) = 1""")
def jaccard_match(spark, sf_dir):
    """The answer in its conversation that each user's turn is most alike to."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/¶", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("path"), F.lit("paragraph").alias("kind"), F.lit(True).alias("is_leaf"), F.lit("").alias("label"), "text", "role")
    return relations.map_leaves(c.where("role = 'user'"), c.where("role <> 'user'"), least=0.05)


def source_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(anchor, unit): each source with what it defines and its documents."""
    defs = definitions(spark, sf_dir).select(F.col("path").alias("anchor"), F.col("unit_id").alias("unit"))
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("anchor"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("unit"))
    return defs.union(docs).distinct()


SQL_ANCHORS = f"WITH {SQL_EDGES}, anchors AS (SELECT dpath AS anchor, dst AS unit FROM defs UNION SELECT source, 'doc' || doc_id FROM documents)"


def sql_refs(here: str, there: str) -> str:
    return f"""{SQL_ANCHORS}, s AS (SELECT anchor, {there} AS doc, sum(weight) AS score FROM edges JOIN anchors a ON a.unit = {here} WHERE (anchor, {there}) NOT IN (SELECT (anchor, unit) FROM anchors) GROUP BY 1, 2)
SELECT anchor, doc, {near('score')} AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY round(score, {RANK_DIGITS}) DESC, doc) AS rank FROM s WHERE score > 0) WHERE rank <= 50"""


@BOOK.add(sql_refs("src", "dst"))
def refs_out(spark, sf_dir):
    """The 50 units outside a source that it refers to most."""
    return rounded(ranking.top_k(relations.neighbours(edges(spark, sf_dir), source_anchors(spark, sf_dir)), 50, by=["anchor"]), 6, "score")


@BOOK.add(sql_refs("dst", "src"))
def refs_in(spark, sf_dir):
    """The 50 units outside a source that refer to it most."""
    return rounded(ranking.top_k(relations.neighbours(edges(spark, sf_dir), source_anchors(spark, sf_dir), outward=False), 50, by=["anchor"]), 6, "score")


@BOOK.add("""SELECT a.n_name AS anchor, b.n_name AS doc, round(1.0 / (1 + abs(a.n_nationkey - b.n_nationkey)), 6) AS score FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name
QUALIFY row_number() OVER (PARTITION BY a.n_name ORDER BY score DESC, doc) <= 30""")
def tree_near(spark, sf_dir):
    """Siblings of each nation in its region, the nearest in order first."""
    n = table(spark, sf_dir, "nation")
    units = n.select(F.col("n_name").alias("id"), F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("ord"))
    near_ = relations.near_in_order(units, units.withColumnRenamed("id", "anchor"), units.select(F.col("id").alias("anchor"), F.col("id").alias("unit")), "parent")
    return rounded(ranking.top_k(near_, 30, by=["anchor"]).drop("rank"), 6, "score")


@BOOK.add("""SELECT a.conv_id || '/' || a.turn AS anchor, b.conv_id || '/' || b.turn AS doc, round(1.0 / (1 + abs(a.turn - b.turn) / 4.0), 6) AS score FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn <> b.turn
QUALIFY row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY score DESC, doc) <= 30""")
def same_file(spark, sf_dir):
    """Other turns of each turn's conversation, the nearest first."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").alias("file"), F.col("turn").alias("ord"))
    near_ = relations.near_in_order(c, c.withColumnRenamed("id", "anchor"), c.select(F.col("id").alias("anchor"), F.col("id").alias("unit")), "file", scale=4.0)
    return rounded(ranking.top_k(near_, 30, by=["anchor"]).drop("rank"), 6, "score")


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, parent, label): regions, nations, customers."""
    r = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("label"), "r_regionkey")
    n = table(spark, sf_dir, "nation").join(r.select(F.col("id").alias("parent"), F.col("r_regionkey").alias("n_regionkey")), "n_regionkey").select(F.concat_ws("::", "parent", "n_name").alias("id"), "parent", F.col("n_name").alias("label"), "n_nationkey")
    c = table(spark, sf_dir, "customer").join(n.select(F.col("id").alias("parent"), F.col("n_nationkey").alias("c_nationkey")), "c_nationkey").select(F.concat_ws("::", "parent", "c_name").alias("id"), "parent", F.col("c_name").alias("label"))
    return r.drop("r_regionkey").unionByName(n.drop("n_nationkey")).unionByName(c)


SQL_TREE = """tree AS (SELECT r_name AS id, NULL::VARCHAR AS parent, r_name AS label FROM region
  UNION ALL SELECT r_name || '::' || n_name, r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT r_name || '::' || n_name || '::' || c_name, r_name || '::' || n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
up AS (SELECT id AS ancestor, id AS descendant, 0 AS depth FROM tree UNION ALL SELECT t.parent, up.descendant, up.depth + 1 FROM up JOIN tree t ON up.ancestor = t.id WHERE t.parent IS NOT NULL)"""


@BOOK.add(f"WITH RECURSIVE {SQL_TREE} SELECT * FROM up")
def subtree_closure(spark, sf_dir):
    """Every unit of the tree with all below it."""
    return relations.closure(tree(spark, sf_dir))


@BOOK.add(f"WITH RECURSIVE {SQL_TREE} SELECT descendant AS id, string_agg(ancestor, ' < ' ORDER BY depth) AS chain FROM up WHERE depth > 0 GROUP BY descendant")
def ancestors(spark, sf_dir):
    """The chain of parents of every unit."""
    up = relations.closure(tree(spark, sf_dir)).where("depth > 0")
    chain = F.array_sort(F.collect_list(F.struct("depth", "ancestor")))  # a tree's depth at most
    return up.groupBy(F.col("descendant").alias("id")).agg(F.array_join(F.transform(chain, lambda x: x["ancestor"]), " < ").alias("chain"))


@BOOK.add(f"""WITH RECURSIVE {SQL_TREE}, refs AS (SELECT lower(n_name) AS ref FROM nation UNION SELECT r_name FROM region UNION SELECT n_name FROM nation UNION SELECT c_name FROM customer UNION SELECT r_name || '::nowhere' FROM region),
f AS (SELECT ref, id FROM refs JOIN tree ON id = ref UNION SELECT ref, id FROM refs JOIN tree ON label = ref WHERE ref NOT IN (SELECT id FROM tree)
  UNION SELECT ref, id FROM refs JOIN tree ON lower(label) = lower(ref) AND contains(id, '::') WHERE ref NOT IN (SELECT id FROM tree))
SELECT ref, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY length(id), id) AS rank FROM f) WHERE rank <= 50""")
def find_unit_suffix(spark, sf_dir):
    """What references to units of the tree mean: by id, label or ending."""
    units = tree(spark, sf_dir)
    names = [table(spark, sf_dir, "nation").select(F.lower("n_name").alias("ref")), table(spark, sf_dir, "region").select("r_name"), table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "customer").select("c_name"), table(spark, sf_dir, "region").select(F.concat("r_name", F.lit("::nowhere")))]
    refs = names[0]
    for x in names[1:]:
        refs = refs.union(x)
    return lookups.find_units(units, refs)


def tests_inputs(spark: SparkSession, sf_dir: str):
    """Conversations as test units of one line each that use the names that documents define."""
    c = table(spark, sf_dir, "conversations")
    unit, path = F.concat_ws("::", F.lit("tests"), F.col("conv_id").cast("string"), F.col("turn").cast("string")), F.concat(F.lit("tests/"), F.col("conv_id").cast("string"))
    units = c.select(unit.alias("id"), F.lit(True).alias("is_leaf"), F.col("role").alias("label"), F.regexp_replace("text", "\n", " ").alias("text"), F.lit(1).alias("start_line"))
    used = c.select(unit.alias("unit_id"), F.explode(F.array_distinct(tokenize_raw(F.col("text")))).alias("name"), F.lit("call").alias("kind"), F.lit(1).alias("line"), path.alias("path"))
    files = definitions(spark, sf_dir).select("path").distinct()
    return definitions(spark, sf_dir), used, units, files


@BOOK.add(f"""WITH {SQL_EDGES}, simple AS (SELECT name, dst, dpath FROM defs WHERE NOT anchor AND length(name) >= 3 AND NOT (starts_with(name, '__') AND ends_with(name, '__'))),
c AS (SELECT conv_id, turn, {sql_terms('text')} AS w, {sql_terms('role')} AS r FROM conversations),
used AS (SELECT DISTINCT conv_id, turn, unnest(w) AS name FROM c), m AS (SELECT name, count(*) AS m FROM simple GROUP BY name),
said AS (SELECT dpath AS file, 1.0 / m AS w, conv_id, turn FROM used JOIN simple USING (name) JOIN m USING (name)),
pooled AS (SELECT file, conv_id, turn, sum(w) AS w FROM said GROUP BY ALL)
SELECT file AS doc, term, {near('sum(w)')} AS tf FROM (SELECT file, p.w, unnest(c.w || c.r) AS term FROM pooled p JOIN c USING (conv_id, turn)) GROUP BY file, term""")
def tests_field_terms(spark, sf_dir):
    """What conversations say of the sources whose names they use (terms without stems)."""
    postings, _ = relations.tests_field(*tests_inputs(spark, sf_dir), stems=False)
    return rounded(postings.select("doc", "term", "tf"), 6, "tf")


@BOOK.add("SELECT 's' || s_suppkey AS src, 'n' || s_nationkey AS dst, s_suppkey % 5 + 1.0 AS weight FROM supplier WHERE s_nationkey = 3")
def edges_to_unit(spark, sf_dir):
    """Edges of suppliers into one nation."""
    edges = table(spark, sf_dir, "supplier").selectExpr("concat('s', s_suppkey) AS src", "concat('n', s_nationkey) AS dst", "CAST(s_suppkey % 5 + 1 AS DOUBLE) AS weight")
    return lookups.edges_to(edges, "n3")


@BOOK.add("SELECT 'c' || conv_id || '/' || turn AS id, turn AS ord FROM conversations WHERE conv_id = 7")
def children_of_unit(spark, sf_dir):
    """Turns of one conversation."""
    turns = table(spark, sf_dir, "conversations").selectExpr("concat('c', conv_id, '/', turn) AS id", "concat('c', conv_id) AS parent", "turn AS ord")
    return lookups.children(turns, "c7").select("id", "ord")


@BOOK.add("SELECT url AS path, sha256(coalesce(html, '')) AS hash FROM pages WHERE starts_with(url, 'https://')")
def file_hashes_below(spark, sf_dir):
    """Hashes of pages below a path, as of files."""
    from ..sources.scan import content_hash

    files = table(spark, sf_dir, "pages").select(F.col("url").alias("path"), content_hash(F.coalesce("html", F.lit(""))).alias("hash"))
    return lookups.file_hashes(files).join(lookups.file_paths(files, "https://").distinct(), "path", "left_semi")


@BOOK.add("SELECT page_id, NOT (lower(string_split(f, '.')[-1]) IN ('png', 'zip', 'lock') AND contains(f, '.')) AND n <= 2097152 AS admitted FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'a.PNG' WHEN 1 THEN 'b.rs' WHEN 2 THEN 'zip' WHEN 3 THEN 'c.d.zip' ELSE 'e.py' END AS f, page_id * 100000 AS n FROM pages)")
def files_admitted(spark, sf_dir):
    """What can be said of a file by its name and size: one per page."""
    from ..sources.scan import admissible

    names = table(spark, sf_dir, "pages").selectExpr("page_id", "concat('x/', element_at(array('a.PNG', 'b.rs', 'zip', 'c.d.zip', 'e.py'), CAST(page_id % 5 + 1 AS INT))) AS path", "page_id * 100000 AS n")
    return names.select("page_id", admissible(F.col("path"), F.col("n")).alias("admitted"))
