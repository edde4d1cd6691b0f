"""Column functions and operators, on literal rows and against DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import queries
from quire.functions import barcode, geometry, text
from quire.operators import glyphs, objects, pages, search
from quire.pdf import layout

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    found = duck.sql(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def one(spark, *columns, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(*[c.alias(f"c{k}") for k, c in enumerate(columns)]).first()


def test_numbering(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 1, 4, 9, 26, 27, 28, 703, 1994)], "n long")
    got = rows.select(text.roman(F.col("n")), text.alpha(F.col("n"))).collect()
    assert [r[0] for r in got] == ["", "I", "IV", "IX", "XXVI", "XXVII", "XXVIII", "DCCIII", "MCMXCIV"]
    assert [r[1] for r in got] == ["", "A", "D", "I", "Z", "AA", "AB", "AAA", "BXR"]


def test_labels(spark):
    p = spark.createDataFrame([("d", k) for k in range(6)] + [("e", 0)], "doc string, page_index long")
    ranges = spark.createDataFrame([("d", 0, "lower_roman", "", 1), ("d", 4, "decimal", "", 1)], "doc string, start_page long, style string, prefix string, logical_start long")
    got = {(r.doc, r.page_index): r.label for r in pages.labels(p, ranges, "doc").collect()}
    assert [got["d", k] for k in range(6)] == ["i", "ii", "iii", "iv", "1", "2"] and got["e", 0] == "1"


def test_ranges_and_keys(spark):
    r = one(spark, *(text.page_range(F.lit(s), F.lit(12)) for s in ("1-3,8,10-", "-2", "0", "13", "x", "5-99", "3,3")))
    assert list(r) == [[0, 1, 2, 7, 9, 10, 11], [0, 1], None, None, None, [4, 5, 6, 7, 8, 9, 10, 11], [2, 2]]
    names = spark.createDataFrame([("page10",), ("Page2",), ("page1",)], "n string")
    assert [x.n for x in names.orderBy(text.natural_key(F.col("n"))).collect()] == ["page1", "Page2", "page10"]
    r = one(spark, *(text.format_of_path(F.lit(p)) for p in ("a/b.PDF", "x.tar.docx", "noext", ".pdf", "a.rst")))
    assert list(r) == ["Pdf", "Docx", "Unknown", "Unknown", "PlainText"]
    r = one(spark, *(text.format_of_bytes(F.lit(b).cast("binary")) for b in ("%PDF-1.4", "PK\x03\x04", "<?xml?><svg>", "<?xml?><a>", "ab")))
    assert list(r) == ["Pdf", "Unknown", "Svg", "Unknown", "Unknown"]


def test_text_functions(spark):
    r = one(spark, text.html_escape(F.lit('<a & "b">')), text.json_string(F.lit('q"\\\n\t')), text.strip_markup(F.lit("<P class=a>x &amp; y</p><script>z</script>")))
    assert list(r) == ["&lt;a &amp; &quot;b&quot;&gt;", '"q\\"\\\\\\n\\t"', "x & y\nz"]


def test_search(spark):
    d = spark.createDataFrame([(1, "aaa (x) aAa"), (2, ""), (3, None)], "doc_id long, text string")
    assert [(r.char_start, r.matched_text) for r in search.hits(d, "doc_id", "aa").orderBy("char_start").collect()] == [(0, "aa"), (1, "aa")]
    assert [(r.char_start, r.matched_text) for r in search.hits(d, "doc_id", "AA", case_insensitive=True).orderBy("char_start").collect()] == [(0, "aa"), (1, "aa"), (8, "aA"), (9, "Aa")]
    assert search.hits(d, "doc_id", "aa", case_insensitive=True, max_results=1).count() == 1 and search.hits(d, "doc_id", "").count() == 0
    assert one(spark, search.count_hits(F.lit("aaaa"), "aa"), search.count_hits(F.lit("x"), "")).c0 == 3
    got = search.pattern_hits(d, "doc_id", r"(x)|a+").orderBy("char_start").collect()
    assert [(r.char_start, r.matched_text) for r in got] == [(0, "aaa"), (1, "aa"), (2, "a"), (4, "(x)"), (8, "a"), (10, "a")]
    for bad in ("[ab", "{2}", "\\"):
        with pytest.raises(ValueError):
            search.translate_pattern(bad)


def test_places_of_hits_are_those_of_the_text(spark):
    """Folding case may change a text's length; places and matched text are the text's own."""
    d = spark.createDataFrame([(1, "İx anan"), (2, "ananAN"), (3, "x"), (4, None), (5, "ANAN")], "doc_id long, text string")
    want = {(1, 3, 7, "anan"), (2, 0, 4, "anan"), (2, 2, 6, "anAN"), (5, 0, 4, "ANAN")}
    for n in (0, 5):
        assert {tuple(r) for r in search.hits(d, "doc_id", "ANAN", case_insensitive=True, max_results=n).collect()} == want
        assert {tuple(r) for r in search.hits(d, "doc_id", "anan", max_results=n).collect()} == {(1, 3, 7, "anan"), (2, 0, 4, "anan")}
    assert {tuple(r) for r in search.hits(d, "doc_id", "anan", case_insensitive=True, max_results=1).collect()} == want - {(2, 2, 6, "anAN")}
    odd = spark.createDataFrame([(1, r"a\E.b a\Eb a\E.b")], "doc_id long, text string")
    assert [r.char_start for r in search.hits(odd, "doc_id", r"a\E.b", max_results=3).collect()] == [0, 11]


def test_merge_numbers_all_pages(spark):
    rows = [(d, p, f"{d}/{p}") for d in (0, 1, 2, 3, None) for p in range((d or 1) + 1)] + [(2, 0, "2/0")]
    frame = spark.createDataFrame(rows, "doc long, page_index long, text string")
    got = sorted(tuple(r) for r in pages.merge(frame, F.coalesce(F.col("doc"), F.lit(1)) % 2, ["doc", "page_index"]).select("target", "page_index", "doc", "text").collect())
    for target in (0, 1):
        own = [r for r in got if r[0] == target]
        assert [r[1] for r in own] == list(range(len(own)))
        assert [r[3] for r in own] == [t for _, _, t in sorted((r for r in rows if (1 if r[0] is None else r[0]) % 2 == target), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]


def test_copies_of_nothing_and_long_chains(spark):
    d = spark.createDataFrame([(1, "a"), (2, None), (3, "a"), (4, None), (5, "b")], "doc_id long, text string")
    assert {tuple(r) for r in objects.remapped(d, "text", "doc_id").collect()} == {(1, 1), (2, 2), (3, 1), (4, 2), (5, 5)}
    chain = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(5, 0), (90, 91)], "src long, dst long")
    assert sorted(r.node for r in objects.reachable(chain, spark.createDataFrame([(0,)], "node long")).collect()) == list(range(13))


def test_pages_operators(spark):
    assert pages.wrap("a" * 80 + " b\n\nc d", 78) == ["a" * 78, "aa b", "", "c d"] and pages.wrap("") == [] and pages.wrap(" " * 90)[0] == " " * 77
    d = spark.createDataFrame([(1, "x\n" * 120), (2, ""), (3, None)], "doc_id long, text string")
    got = {(r.doc_id, r.page_index): len(r.lines) for r in pages.paginate(d).collect()}
    assert got == {(1, 0): 54, (1, 1): 54, (1, 2): 12, (2, 0): 0, (3, 0): 0}


def test_object_operators(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "node long")
    assert sorted(r.node for r in objects.reachable(edges, roots).collect()) == [1, 2, 3]
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", True), ("b", 3, "z", False)], "key string, seq long, v string, undone boolean")
    assert {r.key: r.v for r in objects.replay(log, "key", "seq", "undone").collect()} == {"a": "x", "b": "z"}


def test_geometry(spark):
    m = geometry.matrix_concat(geometry.matrix(2, 0, 0, 2, 0, 0), geometry.matrix(1, 0, 0, 1, 5, 7))
    p = geometry.transform_point(m, F.lit(1.0), F.lit(1.0))
    r = one(spark, p, geometry.cmyk_to_rgb(*map(F.lit, (0.0, 0.5, 1.0, 0.5))), geometry.rgb_to_cmyk(*map(F.lit, (0.0, 0.0, 0.0))), geometry.stitched(F.lit(0.7), [0.5], [lambda x: x, lambda x: geometry.exponential(x, 0.0, 1.0, 2.0)]))
    assert tuple(r.c0) == (7.0, 9.0) and tuple(r.c1) == (0.5, 0.0, 0.0) and tuple(r.c2) == (0.0, 0.0, 0.0, 1.0) and abs(r.c3 - 0.49) < 1e-9


def test_barcodes(spark):
    r = one(spark, barcode.ean13(F.lit("5901234123457")), barcode.ean13(F.lit("5901234123450")), barcode.code39(F.lit("A1")), barcode.code128_values(F.lit("Wiki")))
    assert r.c0 == "10100010110100111011001100100110111101001110101010110011011011001000010101110010011101000100101" and r.c1 is None
    assert r.c2.startswith("1000101110111010") and len(r.c2) == 4 * 15 + 3 and r.c3 == [104, 55, 73, 75, 73, 101, 106]


def test_code128(spark):
    assert len(set(barcode.CODE128)) == 107 and all(sum(map(int, w)) == (13 if len(w) == 7 else 11) for w in barcode.CODE128)
    r = one(spark, barcode.code128(F.lit("Wiki")), barcode.code128(F.lit("é")))
    assert r.c0.startswith("11010010000") and r.c0.endswith("1100011101011") and len(r.c0) == 11 * 6 + 13 and r.c1 is None


def test_word_islands_match_the_kernel(spark):
    chars = [("d", 0, k, c, x, y, 10.0, 6.0) for k, (c, x, y) in enumerate([("a", 0.0, 0.0), ("b", 6.0, 0.0), (" ", 12.0, 0.0), ("c", 18.0, 0.0), ("d", 40.0, 0.0), ("e", 46.0, 9.0)])]
    frame = spark.createDataFrame(chars, "doc string, page int, char_seq int, unicode string, x double, y double, font_size double, width double")
    got = glyphs.words(frame, ["doc", "page"]).orderBy("word_seq").collect()
    want = layout.words_of([(c, x, y, s, "F", w) for _, _, _, c, x, y, s, w in chars])
    assert [(r.text, r.x, r.width) for r in got] == [(w["text"], w["x"], w["width"]) for w in want]
