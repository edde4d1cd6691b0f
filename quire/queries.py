"""The library's queries over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.functions import barcode, geometry, text
from quire.operators import glyphs, objects, pages, search
from quire.queries_base import ORACLES, QUERIES, query, spread  # noqa: F401
from quire.queries_base import table as _table

#: The wrap of plain text as SQL: one step of the recursion takes one line off what is left.
_WRAP = """
WITH RECURSIVE parts AS (
  SELECT doc_id, lang, generate_subscripts(l, 1) AS line_no, unnest(l) AS rest
  FROM (SELECT doc_id, lang, string_split(CASE WHEN text LIKE '%' || chr(10) THEN left(text, length(text) - 1) ELSE text END, chr(10)) AS l FROM documents WHERE text <> '')
), w AS (
  SELECT doc_id, lang, line_no, 0 AS seg, CAST(NULL AS VARCHAR) AS piece, rest, false AS done FROM parts
  UNION ALL
  SELECT doc_id, lang, line_no, seg + 1,
    CASE WHEN length(rest) <= 78 THEN rest WHEN contains(left(rest, 78), ' ') THEN left(rest, 78 - strpos(reverse(left(rest, 78)), ' ')) ELSE left(rest, 78) END,
    CASE WHEN length(rest) <= 78 THEN '' WHEN contains(left(rest, 78), ' ') THEN ltrim(substr(rest, 79 - strpos(reverse(left(rest, 78)), ' '))) ELSE ltrim(substr(rest, 79)) END,
    length(rest) <= 78
  FROM w WHERE NOT done AND (seg = 0 OR rest <> '')
), pieces AS (
  SELECT doc_id, lang, piece, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, seg) - 1 AS k FROM w WHERE seg > 0
)
"""


@query(_WRAP + """
SELECT d.doc_id, count(p.k) AS n_lines, CAST(greatest(ceil(count(p.k) / 54.0), 1) AS BIGINT) AS n_pages
FROM documents d LEFT JOIN pieces p ON p.doc_id = d.doc_id GROUP BY d.doc_id""")
def doc_page_count(spark, sf_dir):
    """Lines and pages of every document as plain text."""
    return pages.page_counts(spread(_table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


_SEARCH_PAGES = _WRAP + """
, paged AS (SELECT lang, doc_id, k // 54 AS page_index, string_agg(piece, chr(10) ORDER BY k) AS text FROM pieces GROUP BY ALL)
SELECT lang, count(*) AS n_pages, CAST(sum((contains(text, 'tion'))::INT) AS BIGINT) AS pages_with_hits,
       CAST(sum((length(text) - length(replace(text, 'tion', ''))) // 4) AS BIGINT) AS hits
FROM paged GROUP BY lang"""


@query(_SEARCH_PAGES)
def page_search_by_lang(spark, sf_dir):
    """Paginate all documents that have a text, search the pages, and report hits for each language. (An empty text is a page without lines, which has nothing to search.)"""
    docs = spread(_table(spark, sf_dir, "documents").select("doc_id", "lang", "text").where("text <> ''"))
    paged = pages.paginate(docs).select("lang", F.array_join("lines", "\n").alias("text"))
    n = search.count_hits(F.col("text"), "tion")
    return paged.groupBy("lang").agg(F.count("*").alias("n_pages"), F.count(F.when(n > 0, 1)).alias("pages_with_hits"), F.sum(n).alias("hits"))


def _hits_sql(pattern: str, lower: bool = False) -> str:
    t = "lower(text)" if lower else "text"
    n = len(pattern)
    return f"SELECT doc_id, CAST(len(list_filter(range(1, length(text) - {n} + 2), lambda i: substr({t}, i, {n}) = '{pattern}')) AS BIGINT) AS hits FROM documents"


@query(_hits_sql("anan"))
def search_exact_hits(spark, sf_dir):
    """Overlapping exact hits."""
    return _table(spark, sf_dir, "documents").select("doc_id", search.count_hits(F.col("text"), "anan").alias("hits"))


@query(_hits_sql("the", True))
def search_ci_hits(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", search.count_hits(F.col("text"), "The", True).alias("hits"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, 'th[aeiou]+[\\p{L}\\p{N}_]*ing')) AS BIGINT) AS hits FROM documents")
def search_regex_hits(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", search.count_pattern(F.col("text"), r"th[aeiou]+\w*ing").alias("hits"))


_TOPK = """
SELECT doc_id, CAST(i - 1 AS BIGINT) AS char_start, CAST(i + 3 AS BIGINT) AS char_end, substr(text, i, 4) AS matched_text FROM (
  SELECT doc_id, text, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r
  FROM (SELECT doc_id, text, unnest(list_filter(range(1, length(text) - 2), lambda i: substr(text, i, 4) = 'anan')) AS i FROM documents)) WHERE r <= 3"""


@query(_TOPK)
def search_topk_per_doc(spark, sf_dir):
    """The first three hits of each document, with their places."""
    return search.hits(_table(spark, sf_dir, "documents"), "doc_id", "anan", max_results=3)


@query("""
SELECT page_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(length(t) - length(replace(t, chr(10), '')) AS BIGINT) AS n_breaks, md5(t) AS digest FROM (
SELECT page_id, regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(html, '(?i)<(?:[^>]*<)?(?:/?(?:p|div|h1|h2|h3)|br/?)(?:\\s[^>]*)?>', chr(10), 'g'), '<[^>]*>|<[^>]*$|>', '', 'g'),
  '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '), '&#39;', ''''), '[\\r\\n]+', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM pages)""")
def markup_text(spark, sf_dir):
    """Loose markup to text."""
    t = text.strip_markup(F.col("html"))
    rows = _table(spark, sf_dir, "pages").select("page_id", t.alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_chars"), (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit("")))).cast("long").alias("n_breaks"), F.md5("t").alias("digest"))


_SCRIPT_ROWS = [(-1, "abc שלום"), (-2, "مرحبا"), (-3, "かな kana"), (-4, "한국"), (-5, "ㄅㄆ"), (-6, "汉字"), (-7, "plain")]
_SCRIPT_SQL = " UNION ALL ".join(f"SELECT {i}, '{t}'" for i, t in _SCRIPT_ROWS)


def _re2(p: str) -> str:
    return p


@query(f"""
SELECT doc_id, regexp_matches(text, '{text.RTL}') AS rtl,
  CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in text.CJK)} ELSE 'Identity' END AS ordering
FROM (SELECT doc_id, text FROM documents UNION ALL {_SCRIPT_SQL})""")
def script_flags(spark, sf_dir):
    """Right-to-left and CJK detection, over the documents and some literal rows."""
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.createDataFrame(_SCRIPT_ROWS, "doc_id long, text string"))
    return rows.select("doc_id", text.contains_rtl(F.col("text")).alias("rtl"), text.cjk_ordering(F.col("text")).alias("ordering"))


_ESC = "replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


def _turn_pages(spark, sf_dir):
    t = _table(spark, sf_dir, "conversations")
    return t.select("conv_id", F.col("turn").alias("page_index"), "role", "text")


@query(f"""
SELECT conv_id, md5('{pages.HTML_HEAD.replace(chr(10), "' || chr(10) || '")}' || string_agg('<h2>Page ' || (turn + 1) || '</h2>' || chr(10) || '<div class="page">' || chr(10) || '  <p>' ||
  replace({_ESC}, chr(10), '<br/>' || chr(10) || '    ') || '</p>' || chr(10) || '</div>' || chr(10), '' ORDER BY turn) || '</body>' || chr(10) || '</html>') AS digest
FROM conversations GROUP BY conv_id""")
def html_pages(spark, sf_dir):
    """Conversations as HTML documents, a turn a page."""
    p = _turn_pages(spark, sf_dir).withColumn("blocks", F.array(F.split("text", "\n")))
    return pages.html_documents(p, "conv_id").select("conv_id", F.md5("html").alias("digest"))


@query("""
SELECT conv_id, md5(string_agg('## Page ' || (turn + 1) || chr(10) || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY turn)) AS digest
FROM conversations GROUP BY conv_id""")
def markdown_pages(spark, sf_dir):
    p = _turn_pages(spark, sf_dir).withColumn("blocks", F.array(F.array("text")))
    return pages.markdown_documents(p, "conv_id").select("conv_id", F.md5("markdown").alias("digest"))


@query("SELECT conv_id, turn, '\"' || replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(9), chr(92) || 't') || '\"' AS json FROM conversations")
def json_strings(spark, sf_dir):
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", text.json_string(F.col("text")).alias("json"))


@query("SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def text_pages(spark, sf_dir):
    return pages.text_documents(_turn_pages(spark, sf_dir), "conv_id").select("conv_id", F.md5("text").alias("digest"))


def _roman_sql(v: str) -> str:
    table = {100: "C CC CCC CD D DC DCC DCCC CM", 10: "X XX XXX XL L LX LXX LXXX XC", 1: "I II III IV V VI VII VIII IX"}
    pick = lambda n: f"(['', {', '.join(repr(x) for x in table[n].split())}])[({v}) // {n} % 10 + 1]"
    return f"CASE WHEN ({v}) > 0 THEN repeat('M', CAST(({v}) // 1000 AS INT)) || {pick(100)} || {pick(10)} || {pick(1)} ELSE '' END"


@query(f"SELECT doc_id, {_roman_sql('n_chars % 4000')} AS roman FROM documents")
def roman_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.roman(F.col("n_chars") % 4000).alias("roman"))


@query("""
WITH RECURSIVE a AS (
  SELECT doc_id, n_chars % 20000 AS v, '' AS s FROM documents
  UNION ALL SELECT doc_id, (v - 1) // 26, chr(CAST(65 + (v - 1) % 26 AS INT)) || s FROM a WHERE v > 0)
SELECT doc_id, s AS label FROM a WHERE v = 0""")
def alpha_numbers(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.alpha(F.col("n_chars") % 20000).alias("label"))


@query(f"""
SELECT p.conv_id, p.turn AS page_index, CASE WHEN r.start_page IS NULL THEN CAST(p.turn + 1 AS VARCHAR) ELSE r.prefix ||
  CASE r.style WHEN 'decimal' THEN CAST(r.first + p.turn - r.start_page AS VARCHAR) ELSE lower({_roman_sql('r.first + p.turn - r.start_page')}) END END AS label
FROM conversations p ASOF LEFT JOIN (
  SELECT DISTINCT conv_id, 1 AS start_page, 'lower_roman' AS style, '' AS prefix, 1 AS first FROM conversations
  UNION ALL SELECT DISTINCT conv_id, 4, 'decimal', 'p', 10 FROM conversations) r ON p.conv_id = r.conv_id AND p.turn >= r.start_page""")
def page_label_asof(spark, sf_dir):
    """Page labels by the last range at or before the page."""
    p = _turn_pages(spark, sf_dir).select("conv_id", "page_index")
    ids = p.select("conv_id").distinct()
    ranges = ids.select("conv_id", F.inline(F.expr(
        "array(named_struct('start_page', 1L, 'style', 'lower_roman', 'prefix', '', 'logical_start', 1L), named_struct('start_page', 4L, 'style', 'decimal', 'prefix', 'p', 'logical_start', 10L))")))
    return pages.labels(p, ranges, "conv_id")


@query("""
SELECT page_id, array_to_string(list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN lpad(p, greatest(20, length(p))::INT, '0') ELSE lower(p) END), '') AS natural_key FROM pages""")
def natural_sort_key(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.natural_key(F.col("url")).alias("natural_key"))


@query("""
SELECT page_id, CASE lower(regexp_extract(url, '[^/\\\\]\\.([^./\\\\]+)$', 1)) WHEN 'pdf' THEN 'Pdf' WHEN 'txt' THEN 'PlainText' WHEN 'svg' THEN 'Svg' ELSE 'Unknown' END AS by_name,
  CASE WHEN length(html) < 4 THEN 'Unknown' WHEN starts_with(html, '%PDF') THEN 'Pdf'
       WHEN (starts_with(html, '<?xml') OR starts_with(html, '<svg')) AND contains(left(html, 1024), '<svg') THEN 'Svg' ELSE 'Unknown' END AS by_content FROM pages""")
def detect_format(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", text.format_of_path(F.col("url")).alias("by_name"), text.format_of_bytes(F.col("html").cast("binary")).alias("by_content"))


_PAGES_SQL = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS page_index, turn, md5(text) AS digest FROM conversations"


@query("SELECT conv_id % 16 AS target, row_number() OVER (PARTITION BY conv_id % 16 ORDER BY conv_id, turn) - 1 AS page_index, conv_id, md5(text) AS digest FROM conversations")
def merge_documents(spark, sf_dir):
    """Conversations as documents, merged into sixteen."""
    merged = pages.merge(_turn_pages(spark, sf_dir), F.col("conv_id") % 16, ["conv_id", "page_index"])
    return merged.select("target", "page_index", "conv_id", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn - 1 AS page_index, md5(text) AS digest FROM conversations WHERE turn BETWEEN 1 AND 3")
def split_range(spark, sf_dir):
    return pages.split(_turn_pages(spark, sf_dir), "conv_id", 2, 4).select("conv_id", "page_index", F.md5("text").alias("digest"))


@query("""SELECT conv_id, CAST(place AS BIGINT) AS place, md5(text) AS digest FROM conversations
JOIN (VALUES (3, 0), (0, 1), (0, 2), (99, 3), (1, 4)) o(page, place) ON turn = page""")
def reorder_pages(spark, sf_dir):
    return pages.reorder(_turn_pages(spark, sf_dir), [3, 0, 0, 99, 1]).select("conv_id", "place", F.md5("text").alias("digest"))


@query("SELECT conv_id, turn - (turn > 1)::INT AS page_index, md5(text) AS digest FROM conversations WHERE turn <> 1")
def delete_page(spark, sf_dir):
    return pages.delete(_turn_pages(spark, sf_dir), "conv_id", 1).select("conv_id", "page_index", F.md5("text").alias("digest"))


@query("SELECT page_id, CAST(unnest(list_filter(list_concat(range(0, least(5, t)), CASE WHEN t >= 10 THEN range(9, t) ELSE [] END), lambda x: true)) AS INT) AS page_index FROM (SELECT page_id, CAST(length(html) // 1000 + 1 AS BIGINT) AS t FROM pages)")
def page_ranges(spark, sf_dir):
    """The range "1-5,10-" of every page's count."""
    rows = _table(spark, sf_dir, "pages").select("page_id", (F.floor(F.length("html") / 1000) + 1).cast("int").alias("t"))
    return rows.select("page_id", F.explode(text.page_range(F.lit("1-5,10-"), F.col("t"))).alias("page_index"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS keeper FROM documents GROUP BY 1")
def dedup_sha256(spark, sf_dir):
    return objects.duplicates(_table(spark, sf_dir, "documents"), "text", "doc_id")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) AS keeper FROM documents")
def dedup_remap(spark, sf_dir):
    return objects.remapped(_table(spark, sf_dir, "documents"), "text", "doc_id")


@query("""SELECT user_id, event_type, event_id, value, props FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def latest_wins(spark, sf_dir):
    e = _table(spark, sf_dir, "events")
    return objects.latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value", "props")


@query("""SELECT user_id, event_type, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events WHERE value >= 10) WHERE r = 1""")
def journal_state(spark, sf_dir):
    """The state of a log in which small values are undone."""
    log = _table(spark, sf_dir, "events").withColumn("undone", F.coalesce(F.col("value") < 10, F.lit(True))).withColumn("key", F.struct("user_id", "event_type"))
    out = objects.replay(log.drop("user_id", "event_type"), "key", "event_id", "undone")
    return out.select("key.user_id", "key.event_type", "event_id")


def _edges(spark, sf_dir):
    o, li = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "lineitem")
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    return (
        o.select(node("c", "o_custkey").alias("src"), node("o", "o_orderkey").alias("dst"))
        .union(li.select(node("o", "l_orderkey"), node("p", "l_partkey"))).union(li.select(node("p", "l_partkey"), node("s", "l_suppkey")))
    )


@query("""
WITH RECURSIVE e AS (
  SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst FROM orders
  UNION ALL SELECT 'o' || l_orderkey, 'p' || l_partkey FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem)),
r AS (SELECT 'c' || c_custkey AS node FROM customer WHERE c_acctbal > 9000 UNION SELECT dst FROM r JOIN e ON src = node)
SELECT left(node, 1) AS kind, count(*) AS n FROM r GROUP BY 1""")
def reachability_gc(spark, sf_dir):
    """What is reached from rich customers over orders, parts and suppliers, by kind."""
    roots = _table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    return objects.reachable(_edges(spark, sf_dir), roots).groupBy(F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def unreferenced_antijoin(spark, sf_dir):
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return objects.unreferenced(c, _table(spark, sf_dir, "orders").where("o_totalprice > 300000"), "c_custkey", "o_custkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS number FROM orders")
def renumber_objects(spark, sf_dir):
    o = _table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    return objects.renumbered(o, "o_custkey", "o_orderkey")


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT s_suppkey % 25 AS nation, s_acctbal * 10 AS x0, s_acctbal * 10 + 20000 AS x1 FROM supplier) r
  WHERE r.nation = o.o_custkey % 25 AND o.o_totalprice BETWEEN r.x0 AND r.x1 AND o.o_orderkey BETWEEN 0 AND 1000000000)""")
def redaction_antijoin(spark, sf_dir):
    """Rows that lie in no rectangle of their group."""
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 25).alias("g"), F.col("o_totalprice").alias("x"), F.col("o_orderkey").cast("double").alias("y"))
    rects = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 25).alias("g"), (F.col("s_acctbal") * 10).alias("x0"), (F.col("s_acctbal") * 10 + 20000).alias("x1"), F.lit(0.0).alias("y0"), F.lit(1e9).alias("y1"))
    return objects.redacted(rows, rects, ["g"]).select("o_orderkey")


_BITS = ", ".join(f"((event_id * 4) & {bit}) <> 0 AS {name}" for name, bit in geometry.PERMISSION_BITS.items())


@query(f"SELECT event_id, {_BITS} FROM events")
def permission_bits(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", *geometry.permissions(F.col("event_id") * 4))


@query("""SELECT l_orderkey, l_linenumber, round(1 - least(1.0, c + k), 6) AS r, round(1 - least(1.0, m + k), 6) AS g, round(1 - least(1.0, y + k), 6) AS b
FROM (SELECT *, l_discount * 5 AS c, l_tax * 5 AS m, l_quantity / 50 AS y, l_discount AS k FROM lineitem)""")
def cmyk_to_rgb(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    c = geometry.cmyk_to_rgb(F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_quantity") / 50, F.col("l_discount"))
    return rows.select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", *(F.round(F.col("c")[x], 6).alias(x) for x in "rgb"))


@query("""SELECT l_orderkey, l_linenumber, round(2 * (l_quantity * 0.5 + l_tax) + 10, 4) AS x, round(3 * (l_extendedprice - 5) - 7, 4) AS y FROM lineitem""")
def matrix_transform(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    m = geometry.matrix_concat(geometry.matrix(0.5, 0, 0, 1, F.col("l_tax"), -5), geometry.matrix(2, 0, 0, 3, 10, -7))
    p = geometry.transform_point(F.col("m"), F.col("l_quantity"), F.col("l_extendedprice"))
    return rows.withColumn("m", m).withColumn("p", p).select("l_orderkey", "l_linenumber", F.round("p.x", 4).alias("x"), F.round("p.y", 4).alias("y"))


@query("SELECT source, lang, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, max(n_chars) AS longest, count(DISTINCT md5(text)) AS texts FROM documents GROUP BY source, lang")
def analyze_documents(spark, sf_dir):
    """Counts and sizes by source and language."""
    d = _table(spark, sf_dir, "documents")
    return d.groupBy("source", "lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.max("n_chars").alias("longest"), F.countDistinct(F.md5("text")).alias("texts"))


_EAN_SQL = """
SELECT page_id, d || CAST((10 - s % 10) % 10 AS VARCHAR) AS code FROM (
  SELECT page_id, d, list_sum(list_transform(range(1, 13), lambda i: CAST(substr(d, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END)) AS s
  FROM (SELECT page_id, lpad(CAST(page_id * 7919 + 13 AS VARCHAR), 12, '4') AS d FROM pages))"""


@query(_EAN_SQL)
def ean13_codes(spark, sf_dir):
    d = F.lpad((F.col("page_id") * 7919 + 13).cast("string"), 12, "4")
    return _table(spark, sf_dir, "pages").select("page_id", barcode.ean13_digits(d).alias("code"))


@query("""
SELECT conv_id, turn, CAST(k - 1 AS BIGINT) AS word_seq, w AS text FROM (
  SELECT conv_id, turn, unnest(l) AS w, generate_subscripts(l, 1) AS k FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda x: x <> '') AS l FROM conversations))""")
def word_islands(spark, sf_dir):
    """Turns laid out as glyphs (a line break moves down), and the words found again from the glyphs' places."""
    t = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.split(F.trim(F.translate("text", "\r", "")), "").alias("g"))
    order = Window.partitionBy("conv_id", "turn").orderBy("char_seq")
    g = t.select("conv_id", "turn", F.posexplode("g").alias("char_seq", "unicode")).withColumn("line", F.count(F.when(F.col("unicode") == "\n", 1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chars = g.where("unicode <> '\n'").select("conv_id", "turn", "char_seq", "unicode", (72.0 + F.col("char_seq") * 6.0).alias("x"), (720.0 - F.col("line") * 12.0).alias("y"), F.lit(10.0).alias("font_size"), F.lit(6.0).alias("width"))
    w = glyphs.words(chars, ["conv_id", "turn"])
    return w.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("word_seq")) - 1).cast("long").alias("word_seq"), "text")


# --- documents written as PDF and read again ---


def _written(spark, sf_dir):
    from quire.sources import write

    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return d.select("doc_id", write.text_to_pdf(F.col("text"), F.col("source")).alias("content"))


def _glyph_text():
    """The glyphs of all pages without white space."""
    return F.regexp_replace(F.array_join(F.transform("pages", lambda p: p["raw"]), ""), r"\s+", "")


@query(_WRAP + """
SELECT d.doc_id, n AS n_pages, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS digest
FROM (SELECT doc_id, regexp_replace(text, '\\s+', '', 'g') AS t FROM documents) d
JOIN (SELECT x.doc_id, CAST(greatest(ceil(count(p.k) / 54.0), 1) AS BIGINT) AS n FROM documents x LEFT JOIN pieces p ON p.doc_id = x.doc_id GROUP BY 1) c ON c.doc_id = d.doc_id""")
def pdf_roundtrip_chars(spark, sf_dir):
    """All documents written as PDF, parsed, and their glyphs put together again."""
    from quire.sources import pdf

    parsed = pdf.parse(_written(spark, sf_dir), parts=["raw"])
    rows = parsed.select("doc_id", F.col("page_count").cast("long").alias("n_pages"), _glyph_text().alias("t"))
    return rows.select("doc_id", "n_pages", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(_WRAP + """
, paged AS (SELECT doc_id, CAST(k // 54 AS INT) AS page_index, string_agg(piece, '' ORDER BY k) AS t FROM pieces GROUP BY ALL)
SELECT doc_id, page_index, CAST((length(t) - length(replace(t, 'tion', ''))) // 4 AS BIGINT) AS hits FROM paged WHERE contains(t, 'tion')""")
def pdf_search_hits(spark, sf_dir):
    """Hits on the pages of the written documents; they cross lines as the glyphs do."""
    from quire.sources import pdf

    return pdf.search_files(_written(spark, sf_dir), "tion").groupBy("doc_id", "page_index").agg(F.count("*").alias("hits"))


@query("SELECT doc_id, 'ok' AS status, '1.7' AS version, false AS encrypted, source AS title FROM documents")
def pdf_metadata(spark, sf_dir):
    from quire.sources import pdf

    parsed = pdf.parse(_written(spark, sf_dir), parts=["images"])
    return parsed.select("doc_id", "status", "version", "encrypted", F.element_at("metadata", "Title").alias("title"))


@query("SELECT conv_id, md5(regexp_replace(string_agg(text, '' ORDER BY turn), '\\s+', '', 'g')) AS digest FROM conversations GROUP BY conv_id")
def pdf_merge_turns(spark, sf_dir):
    """Every turn as a document, and each conversation's documents merged into one."""
    from quire.sources import pdf, write

    t = spread(_table(spark, sf_dir, "conversations"))
    files = t.select("conv_id", "turn", write.text_to_pdf(F.col("text")).alias("content"))
    parsed = pdf.parse(write.merge(files, F.col("conv_id"), "turn"), key="target", parts=["raw"])
    return parsed.select(F.col("target").cast("long").alias("conv_id"), F.md5(_glyph_text()).alias("digest"))


@query("SELECT item_id, true AS encrypted, true AS locked, md5(regexp_replace(text, '\\s+', '', 'g')) AS digest FROM benchmark")
def pdf_encrypt_decrypt(spark, sf_dir):
    """Test items as encrypted documents: locked without the password, whole with it."""
    from quire.sources import pdf, write

    b = _table(spark, sf_dir, "benchmark")
    files = b.select("item_id", write.encrypt(write.text_to_pdf(F.col("text")), "secret", "owner").alias("content"))
    # the locked reading's verdict and the open one's text come from one pass over the written bytes
    shut = pdf.parse(files.select(F.struct("item_id", "content").alias("file"), "content"), key="file", parts=["info"])
    kept = shut.select("file.item_id", "file.content", F.col("encrypted"), F.col("locked"))
    open_ = pdf.parse(kept.select(F.struct("item_id", "encrypted", "locked").alias("row"), "content"), key="row", password="secret", parts=["raw"])
    return open_.select("row.item_id", "row.encrypted", "row.locked", F.md5(_glyph_text()).alias("digest"))


from quire import queries_documents  # noqa: E402, F401  (registers its own)
