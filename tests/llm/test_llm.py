"""The operators against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import chat, common, decontaminate, embedding_dedup, html, jaccard_join, kernels, licenses, oracles, packing, quality, registry, sharding, tokencount

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


def docs_frame(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


EDGE = [(1, None), (2, ""), (3, "one"), (None, "some text with a few words"), (4, "same text here now"), (4, "same text here now"), (5, "word " * 30_000), (6, " \n\t "), (7, "Ünï code — 文字")]


# --- SQL ---------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_queries_match_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    found = con.sql(oracles.ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    want = [tuple(r[[d[0] for d in found.description].index(c)] for c in columns) for r in found.fetchall()]
    frame = registry.QUERIES[name](spark, SF)
    assert sorted(frame.columns) == columns
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in frame.select(*columns).collect()), key=key) == sorted(want, key=key)


def test_license_sql_reads_passages(spark):
    """The SQL for licenses on texts that hold passages, too."""
    rng = random.Random(5)
    rows = [(k, f"{prose(rng, 9)} {p} {prose(rng, 5)} {p.upper() if k % 2 else ''}") for k, (p, _) in enumerate(licenses.PASSAGES + licenses.TEXTS)]
    rows += [(100 + k, " ".join(w for w in p.split() if rng.random() > 0.04)) for k, (p, _) in enumerate(licenses.PASSAGES + licenses.TEXTS)] + [(200, None), (201, "of this software and " * 9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r for r in con.sql(oracles.LICENSES).fetchall()}
    got = {r.doc_id: tuple(r) for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert got.keys() == want.keys() and all(got[k][:-1] == want[k][:-1] and abs(got[k][-1] - want[k][-1]) < 1e-12 for k in got)
    assert sum(r[6] != r[5] for r in got.values()) > 15


# --- kernels ----------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("abAB \n\té文.,|0"), max_size=60))
def test_word_hashes_follow_the_words(text):
    words = [w for w in re.split("[\x20\t-\r]+", text.translate(str.maketrans("AB", "ab"))) if w]
    got = kernels.word_hashes(text.encode()).tolist()
    assert len(got) == len(words)
    assert len(set(got)) == len(set(words)) and all((a == b) == (x == y) for a, x in zip(got, words) for b, y in zip(got, words))


def test_long_texts_hash_like_short_ones(monkeypatch):
    text = prose(random.Random(1), 3000).encode()
    whole = kernels.word_hashes(text)
    monkeypatch.setattr(kernels, "_SEGMENT", 97)
    assert (kernels.word_hashes(text) == whole).all()


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 6000 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    for most in (common.ONE_TASK_EDGES, 0):
        got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long"), one_task=most).collect()}
        assert got == {x: find(x) for x in linked}
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# --- 1 decontamination --------------------------------------------------------


def bm25(items, passage, k1=1.2, b=0.75):
    """Scores of a passage for all items by the formula, relative to each item's own."""
    terms = [collections.Counter(w) for w in items]
    mean = sum(map(len, items)) / len(items)
    df = collections.Counter(t for c in terms for t in c)
    weight = lambda t, i: np.log1p((len(items) - df[t] + 0.5) / (df[t] + 0.5)) * terms[i][t] * (k1 + 1) / (terms[i][t] + k1 * (1 - b + b * len(items[i]) / mean))
    return [sum(weight(t, i) for t in terms[i] if t in passage) / sum(weight(t, i) for t in terms[i]) for i in range(len(items))]


def test_retrieval_is_bm25_above_the_threshold():
    rng = random.Random(5)
    items = [prose(rng, rng.randrange(5, 40)) for _ in range(60)]
    index = decontaminate.Index(list(enumerate(items)), theta=0.3, block_items=4)
    text = " ".join([prose(rng, 90), items[7], prose(rng, 50), " ".join(items[9].split()[: len(items[9].split()) * 2 // 3]), prose(rng, 40)])
    words, want = text.split(), set()
    assert len(index.bands) > 1
    for i, t in enumerate(items):
        window = decontaminate.window_of(len(t.split()))
        assert window >= 2 * len(t.split()) and (window == decontaminate.MIN_WINDOW or window < 4 * len(t.split()))
        for start in range(0, max(1, len(words) - window // 2), window // 2):
            if bm25([x.split() for x in items], set(words[start : start + window]))[i] >= 0.3:
                want.add((i, start))
    got = {(i, s) for i, s, _ in index.retrieve(decontaminate.words_of(text.encode()))}
    assert got == want and any(i == 7 for i, _ in got)


def test_postings_of_dead_blocks_are_not_read(monkeypatch):
    """Most postings of a common term lie in blocks that cannot reach the threshold."""
    rng = random.Random(15)
    items = [f"common words here {prose(rng, 20)}" for _ in range(400)]
    index = decontaminate.Index(list(enumerate(items)))
    (band,) = index.bands
    read = []
    monkeypatch.setattr(decontaminate.Band, "_gather", staticmethod(lambda lists, first, old=decontaminate.Band._gather: (read.append((first is band.post_first, len(out := old(lists, first)))), out)[1]))
    assert {i for i, _, _ in index.retrieve(decontaminate.words_of(f"{prose(rng, 30)} {items[7]} {prose(rng, 30)}".encode()))} == {7}
    posts = max(n for is_post, n in read if is_post)
    assert 0 < posts < len(band.post_item) / 5


def leaks_by_hand(docs, items):
    """(doc_id, item_id): score, by scoring every window for every item and counting runs of words."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(t.lower())
    runs = lambda w, n=3: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    kept = [(i, t, split(t)) for i, t in items if t and split(t)]
    terms = [collections.Counter(w) for *_, w in kept]
    mean, df = sum(len(w) for *_, w in kept) / len(kept), collections.Counter(t for c in terms for t in c)
    weight = []
    for c, (*_, w) in zip(terms, kept):
        own = {t: np.log1p((len(kept) - df[t] + 0.5) / (df[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in c.items()}
        weight.append({t: x / sum(own.values()) for t, x in own.items()})
    by_term = collections.defaultdict(list)
    for k, own in enumerate(weight):
        for t, x in own.items():
            by_term[t].append((k, x))
    windows = [decontaminate.window_of(len(w)) for *_, w in kept]
    out = {}
    for d, text in docs:
        words = split(text or "")
        for window in set(windows):
            for start in range(0, max(1, len(words) - window // 2), window // 2):
                score = collections.Counter()
                for t in set(words[start : start + window]):
                    for k, x in by_term.get(t, ()):
                        score[k] += x
                for k, x in score.items():
                    if windows[k] != window or x < 0.5 - 1e-9:
                        continue
                    here = words[max(0, start - window // 2) : start + window + window // 2]
                    share = lambda w: np.mean([r in runs(here, min(3, len(w))) for r in runs(w)]) if w else 1.0  # noqa: B023, E731
                    q, a = map(split, decontaminate.question_and_answer(kept[k][1]))
                    if share(q) >= 0.5 and share(a) >= 0.5 or share(kept[k][2]) >= 0.6:
                        out[d, kept[k][0]] = max(out.get((d, kept[k][0]), 0), round(x, 6))
    return out


def test_the_documents_leaks_by_hand(spark):
    """The registered query on its whole tables."""
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    got = {(r.doc_id, r.item_id): round(r.score, 6) for r in registry.QUERIES["op1_bm25_decontamination"](spark, SF).collect()}
    want = leaks_by_hand(docs, items)
    assert len(want) >= 3 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in got)


def test_leaks_are_found_and_clean_texts_left(spark):
    rng = random.Random(6)
    items = [(i, f"{prose(rng, 15)}. {prose(rng, 8)}.") for i in range(30)] + [(99, None), (98, "")]
    rows = [(i, prose(rng, 200)) for i in range(60)]
    for i in (3, 17, 41):
        a, b = rows[i][1][:300], rows[i][1][300:]
        rows[i] = (i, f"{a} {items[i % 30][1].upper()} {b}")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.find_leaks(docs_frame(spark, rows + [(500, None), (501, "")]), bench)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(3, 3), (17, 17), (41, 11)}
    frame = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    kept = decontaminate.without_leaks(frame, bench)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == set(range(60)) - {3, 17, 41}
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_leaks(frame, empty).count() == 0 and decontaminate.without_leaks(frame, empty).count() == 60
    assert decontaminate.find_leaks(frame.limit(0), bench).count() == 0


def test_items_in_parts_give_the_same_leaks(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    ids = lambda parts: {leak[0] for index in parts for r in docs.collect() for leak in index.leaks(r.text.encode())}
    many = list(decontaminate.index_parts(bench, max_words=300))
    assert len(many) > 2 and ids(many) == ids(decontaminate.index_parts(bench))


def test_scores_do_not_depend_on_the_parts(spark):
    rng = random.Random(12)
    items = [(i, f"{prose(rng, rng.randrange(10, 60))}. {prose(rng, rng.randrange(4, 20))}.") for i in range(60)] + [(98, ""), (99, None), (97, "...")]
    passages = [" ".join([prose(rng, 60), *rng.choice(items[:60])[1].split()[: rng.randrange(5, 40)], prose(rng, 60)]).encode() for _ in range(150)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = list(decontaminate.index_parts(bench)), list(decontaminate.index_parts(bench, max_words=400))
    assert len(one) == 1 and len(many) > 3 and {b.window for i in many for b in i.bands} == {b.window for b in one[0].bands}
    found = lambda parts: sorted((k, i.item_ids[item], start, round(score, 9)) for i in parts for k, p in enumerate(passages) for item, start, score in i.retrieve(decontaminate.words_of(p)))
    assert found(many) == found(one) and len(found(one)) > 50


# --- 2 sharding -----------------------------------------------------------------


def check_shards(rows, n):
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    sizes = [sum(r.size for r in by.get(s, [])) for s in range(n)]
    assert max(sizes) - min(sizes) <= max(r.size for r in rows)


def test_sharding_by_bytes(spark):
    rows = registry.QUERIES["op2_slot_sharding"](spark, SF).collect()
    assert sorted(map(str, rows)) == sorted(map(str, registry.QUERIES["op2_slot_sharding"](spark, SF).collect())) and {r.map_version for r in rows} == {1}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
    check_shards(rows, 40)


def test_sharding_edges(spark):
    frame = docs_frame(spark, [(*r, 7) for r in EDGE], ", shard int")
    rows = sharding.shard(frame, 3).collect()
    assert len(rows) == len(EDGE) and {r.doc_id for r in rows} == {1, 2, 3, 4, 5, 6, 7, None}
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    assert sharding.shard(frame.limit(0), 3).count() == 0


def test_maps_have_versions_and_move_little(spark, tmp_path):
    rng = random.Random(2)
    size = [rng.randrange(1000) for _ in range(600)]
    first = sharding.assign(size, 10)
    second = sharding.rebalance(first, size, 11)
    load = [sum(b for b, s in zip(size, second) if s == k) for k in range(11)]
    assert max(load) - min(load) <= 0.03 * sum(size) / 11 + 1000
    moved = [k for k in range(600) if first[k] != second[k]]
    assert len(moved) < 600 / 5 and sum(second[k] == 10 for k in moved) > 0.8 * len(moved)
    fewer = sharding.rebalance(second, size, 8)
    assert max(fewer) == 7
    path = str(tmp_path / "map")
    for v, m in ((1, first), (2, second)):
        sharding.save_map(spark, path, v, m)
    assert [r.shard for r in sharding.load_map(spark, path, 1).orderBy("slot").collect()] == first
    assert [r.shard for r in sharding.load_map(spark, path).orderBy("slot").collect()] == second
    with pytest.raises(ValueError):
        sharding.save_map(spark, path, 2, first)
    assert sharding.versions(spark, path) == [1, 2] and sharding.versions(spark, path + "x") == []


def test_a_map_is_loaded_and_edited(spark, tmp_path):
    """The same rows move nothing; grown rows and one more shard move few slots, as a next version; an edited text stays in its slot."""
    rng = random.Random(4)
    rows = [(k, "x" * rng.randrange(2000)) for k in range(1500)]
    path = str(tmp_path / "map")
    run = lambda own, n: {r.doc_id: r for r in sharding.shard(docs_frame(spark, own), n, 512, path).collect()}
    first, again = run(rows, 8), run(rows, 8)
    assert {r.map_version for r in [*first.values(), *again.values()]} == {1} and {k: (r.shard, r.slot) for k, r in first.items()} == {k: (r.shard, r.slot) for k, r in again.items()}
    more = run([*rows, *((2000 + k, "y" * 900) for k in range(300))], 9)
    assert {r.map_version for r in more.values()} == {2} and sharding.versions(spark, path) == [1, 2]
    assert sum(more[k].shard != first[k].shard for k in first) < len(first) / 4
    edited = run([(k, t + "!") for k, t in rows], 9)
    assert all(edited[k].virtual_slot == first[k].virtual_slot for k in first)
    for got, n in ((first, 8), (more, 9), (edited, 9)):
        check_shards(list(got.values()), n)


def test_a_hot_id_keeps_places_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 200)
    rows = sharding.shard(docs_frame(spark, [(1, "same")] * 900 + [(k, "t" * k) for k in range(100)]), 5).collect()
    assert len(rows) == 1000
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


# --- 3 packing --------------------------------------------------------------------


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (3, 3)])
def test_hilbert_keys_walk_the_grid(dims, bits):
    grid = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
    key = packing.hilbert_key(grid, bits)
    assert sorted(key) == list(range(len(grid)))
    walk = grid[np.argsort(key)]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def check_packing(pieces, docs, seq_len=4096, end_id=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    total = 0
    for doc_id, text in docs:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id], "<u4")
        total += len(ids)
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.length > 0
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_seq.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= seq_len
    assert len(by_seq) <= -(-total // seq_len) + 1 + total // seq_len // 50
    return by_seq


def test_packing_is_whole(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(registry.QUERIES["op3_hilbert_packing"](spark, SF).collect(), docs)


def test_packing_edges(spark):
    docs = [(1, None), (2, ""), (3, "a\x1cb <|endoftext|> c"), (5, "word " * 9000), (6, "İstanbul ΟΔΟΣ 文字 x²"), (None, "no id")]
    frame = docs_frame(spark, [(*d, 3) for d in docs], ", offset int")
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(frame, path).collect()
    check_packing(got, docs)
    assert all(zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length for p in got)
    assert packing.pack(frame.limit(0), path).count() == 0


def test_tails_fill_up():
    places = packing.lay_tails([(0, 2, 1000), (1, 0, 4096), (2, 5, 3000), (3, 0, 96), (4, 1, 2000)])
    by = {p[0]: p for p in places}
    assert [by[k][1] for k in range(5)] == [0, 2, 3, 8, 8] and by[1][2] == -1
    assert by[2][3:] == (9, 0) and by[0][3:] == (9, 3000) and by[3][3:] == (9, 4000) and by[4][3:] == (10, 0)


# --- 4 html -----------------------------------------------------------------------


def test_page_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header>
    <nav><ul><li><a href="/">Home</a></ul></nav><div id="cookie-notice">We use cookies</div><script>var t="</p><p>no";</script>
    <main><article><header><h2>Head&nbsp;&amp; line</h2></header><p>First <b>bold<p>Second&#33;  line<br>after<div class="ad">Buy</div>
    <form><input>Search</form>Loose text<ul><li>one<li>two</ul><aside>Side</aside></article><section class="comments"><p>Nice!</p></section></main>
    <!-- gone --><footer>&copy; 2020</footer></body></html>"""
    assert html.Page(page).text() == "Head & line\nFirst bold\nSecond! line after\nLoose text\none\ntwo"
    assert html.Page("<div class='wrap has-sidebar'><article class=long-form>kept<p class='adSlot'>gone</p></article></div>").text() == "kept"
    assert html.Page(None).text() == html.Page("").text() == html.Page("<div class=ad>x").text() == ""
    assert html.Page("plain &lt;b&gt; text <3 you").text() == "plain <b> text <3 you"


def test_site_templates_go_and_articles_stay(spark):
    rng = random.Random(4)
    page = lambda k, site: f"<body><div><p>Terms of {site}</p><p>Call us</p></div><div class=x><h1>Title {k}</h1><p>{prose(rng, 30)}</p></div><p>{prose(rng, 5)}</p></body>"
    rows = [(k, f"http://{s}.example/{k}", page(k, s)) for k in range(24) for s in "ab"]
    copied = "<body><article><p>Often copied story</p><p>with parts</p></article><footer>x</footer></body>"
    rows += [(1000 + k, f"http://a.example/c{k}", copied) for k in range(40)] + [(2000, None, None), (2000, None, None), (2001, "http://c.example", "<p>Terms of a</p>")]
    frame = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = html.extract(frame).collect()
    assert sorted(map(str, got)) == sorted(map(str, html.extract(frame, broadcast=0).collect()))
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id < 1000:
            assert "Terms" not in r.text and "Call" not in r.text and r.text.startswith(f"Title {r.page_id}\n")
    assert {r.text for r in got if 1000 <= r.page_id < 2000} == {"Often copied story\nwith parts"}
    assert sorted(r.text for r in got if r.page_id >= 2000) == ["", "", "Terms of a"]
    assert html.extract(frame.limit(0)).count() == 0


def test_templates_of_a_section_go_on_a_large_host(spark):
    """A notice on enough pages goes though it is on few of the host's; one on fewer than that stays."""
    rows = [(k, f"http://a.example/{k}", f"<body><p>Page {k}</p>{'<div>Notice to all</div>' * (k < 210)}{'<div>Said often</div>' * (300 <= k < 340)}</body>") for k in range(1300)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "text").collect()}
    assert got == {k: f"Page {k}" + "\nSaid often" * (300 <= k < 340) for k in range(1300)}


def test_templates_without_telling_tags(spark):
    """Boilerplate that no element name, class or role gives away: by content, also within main, and by shape where its text differs."""
    rng = random.Random(14)
    rows = []
    for k in range(60):
        x, y = (f"<p>{prose(rng, rng.randrange(5, 30))}</p>" * rng.randrange(1, 4) for _ in "xy")
        quoted = "<p>A line that many articles quote.</p>" * (k % 3 == 0)
        top = f"<div class=q7><div><a href=/x>{prose(rng, 3)}</a></div><div><a href=/y>{prose(rng, 2)}</a></div></div>"
        body = f"<main><h1>Title {k}</h1>{x}{quoted}<p>Told by the site of a.</p><div class=z1>Same words always</div></main>"
        # some pages of the host have no main element; there only the template tells
        bare = f"<div class=w><h1>Title {k}</h1>{y}</div>"
        rows.append((k, f"http://a.example/{k}", f"<body>{top}{bare if k >= 50 else body}<div class=q9>Written by {prose(rng, 2)}</div></body>"))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html.extract(frame).collect()}
    assert got == {r.page_id: r for r in html.extract(frame, broadcast=0).collect()}
    for k, _, page in rows:
        wanted = [re.sub("<[^>]*>", "", b) for b in re.findall("<h1>.*?</h1>|<p>.*?</p>", page)]
        assert got[k].text == "\n".join(b for b in wanted if not b.startswith("Told")), k
        assert got[k].template_chars > 0


def test_templates_change_real_pages(spark):
    """On hosts with pages enough the template is found and taken away."""
    got = registry.QUERIES["op4_site_template_text"](spark, SF.replace("0.001", "0.1")).collect()
    share = sum(r.template_chars > 0 for r in got) / len(got)
    print(f"template removal changes {share:.3f} of {len(got)} pages")
    assert share > 0.5


def test_pages_by_plain_rules(spark):
    """The test pages' text is the text of their article's blocks."""
    from html import unescape

    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    got = {r.page_id: r.text for r in registry.QUERIES["op4_site_template_text"](spark, SF).collect()}
    for r in pages:
        body = re.search("<article>(.*)</article>", r.html, re.S)[1]
        blocks = (" ".join(unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", body))
        assert got[r.page_id] == "\n".join(b for b in blocks if b)


# --- 5 quality -----------------------------------------------------------------------


def test_quality_on_held_out_labels(spark):
    sf = SF.replace("0.001", "0.01")
    got = {r.doc_id: r for r in registry.QUERIES["op5_additive_quality"](spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for k, r in got.items())
    held = [(got[x.doc_id].predicted, x.quality) for x in labels if got[x.doc_id].held_out]
    assert len(held) > 80 and np.mean([a == b for a, b in held]) > 0.95


def features_by_hand(text):
    """The classifier's features of a text, in plain Python."""
    data = text.encode()
    words = [w.encode() for w in re.split("[\x20\t-\r]+", text) if w]
    lines = [x for x in data.split(b"\n") if x]
    count = lambda chars: sum(b in chars for b in data)
    upper, lower, n = count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), count(b"abcdefghijklmnopqrstuvwxyz"), len(words)
    if not data:
        return [0.0] * len(quality.FEATURES)
    out = [np.log1p(len(data)), upper / (upper + lower) if upper + lower else 0]
    out += [count(c) / max(n, 1) for c in (b"#$%&*@^~=+<>{}[]\\", b"!?", b"|", b"0123456789", b".,;:")]
    out += [(upper + lower) / len(data), sum(b > 127 for b in data) / len(data), count(b"\n") / max(n, 1)]
    pairs = list(zip(words, words[1:]))
    out += [sum(map(len, words)) / n if n else 0, len(set(words)) / n if n else 0, sum(a == b for a, b in pairs) / (n - 1) if n > 1 else 0]
    out += [len(set(pairs)) / (n - 1) if n > 1 else 0, max(collections.Counter(words).values()) / n if n else 0, 1 - len(set(lines)) / len(lines) if lines else 0]
    return out + ([sum(len(w) > 12 for w in words) / n, sum(len(w) <= 3 for w in words) / n] if n else [0, 0])


def test_the_documents_scores_by_hand(spark):
    """The registered query on its whole table: features in plain Python, and one entry of each table added up."""
    docs, labels = (common.table(spark, SF, t) for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in registry.QUERIES["op5_additive_quality"](spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        x = features_by_hand(r.text or "")
        place = lambda v, cuts: sum(c <= v + 1e-12 for c in cuts)
        total = model.base + sum(t[place(v, c)] for v, c, t in zip(x, model.cuts, model.tables))
        total += sum(t[place(x[i], a), place(x[j], b)] for i, j, a, b, t in model.pairs)
        assert abs(got[r.doc_id] - 1 / (1 + np.exp(-total))) < 1e-6


def test_held_out_labels_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", (1 - labels.quality)).where(quality.held_out(labels.doc_id)).unionByName(labels.where(~quality.held_out(labels.doc_id)))
    scores = [sorted((r.doc_id, r.score) for r in quality.classify(docs, quality.train(docs, x)).collect()) for x in (labels, flipped)]
    assert scores[0] == scores[1]


def test_quality_edges(spark):
    frame = docs_frame(spark, [(*r, 0.1) for r in EDGE], ", score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.classify(frame, quality.train(frame, none)).collect()
    assert len(got) == len(EDGE) and {r.score for r in got} == {0.5}
    ones = spark.createDataFrame([(k, 1) for k in range(9)] + [(None, 0), (3, None)], "doc_id long, quality int")
    model = quality.train(frame, ones)
    assert all(r.score > 0.9 for r in quality.classify(frame, model).collect())
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == len(EDGE)
    assert quality.classify(frame.limit(0), model).count() == 0


def test_repeated_ids_do_not_crowd_out_a_class(spark):
    """Rows of one hot id or of many repeats neither drop the positives nor weigh more than one row."""
    rng = random.Random(8)
    text = lambda good: prose(rng, 40) if good else "!!! ||| ### " * rng.randrange(5, 15)
    known = [k for k in range(60) if zlib.crc32(str(k).encode()) % 3 != 1]
    rows = [(k, text(k % 2)) for k in known]
    labels = spark.createDataFrame([(k, k % 2) for k in known], "doc_id long, quality int")
    bad = [r for r in rows if not r[0] % 2]
    repeated = rows + bad[:1] * 400 + bad * 9
    x = quality.feature_matrix([t.encode() for _, t in rows])
    once, often = (quality.train(docs_frame(spark, r), labels, max_labelled=len(known)).scores(x) for r in (rows, repeated))
    assert (once == often).all()
    assert all((s >= 0.5) == bool(k % 2) for (k, _), s in zip(rows, often))
    # different texts of one id: as many rows as there are, one in the fit
    hot = rows + [(bad[0][0], "!!! ||| ### " * n) for n in range(20, 320)]
    got = quality.train(docs_frame(spark, hot), labels, max_labelled=len(known)).scores(x)
    assert all((s >= 0.5) == bool(k % 2) for (k, _), s in zip(rows, got))


def test_pairs_catch_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = np.zeros((4000, len(quality.FEATURES)))
    x[:, :4] = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.scores(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


# --- 6 token counts -----------------------------------------------------------------


def greedy(word, vocabulary):
    data, at, n = b" " + word.encode(), 0, 0
    while at < len(data):
        end = len(data)
        while data[at:end] not in vocabulary or b" " in data[at:end][1:]:
            end -= 1
        at, n = end, n + 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", max_size=4), max_size=8), st.text("abc", min_size=1, max_size=14))
def test_automaton_is_greedy_longest_match(inner, first, word):
    vocabulary = {*"abc ".encode()} and {b"a", b"b", b"c", b" "} | {w.encode() for w in inner} | {b" " + w.encode() for w in first}
    assert tokencount.LongestMatch(vocabulary).count(b" " + word.encode()) == greedy(word, vocabulary)


def test_a_vocabulary_without_some_bytes(tmp_path):
    match = tokencount.LongestMatch({b"a", b"ab", b" a"})
    assert [match.count(w) for w in (b" a", b" ab", b" ba", b" zz", b" a\xff")] == [1, 2, 3, 3, 2]
    path = tmp_path / "v.json"
    path.write_text('{"added_tokens": [{"content": "<s>", "special": true}, {"content": "b", "special": false}], "model": {"vocab": {"<s>": 0, "b": 1, "Ġa": 2}}}', encoding="utf-8")
    assert tokencount.read_vocabulary(str(path)) == {b"b", b" a"}


def test_token_counts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    vocabulary = tokencount.read_vocabulary(path)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + EDGE[:4] + EDGE[6:]
    got = tokencount.count_tokens(docs_frame(spark, [(*d, 1) for d in docs], ", n_tokens int"), path).collect()
    want = collections.Counter()
    known: dict[str, int] = {}
    for doc_id, text in docs:
        words = (text or "").split()
        want[doc_id, len(words), sum(known.setdefault(w, greedy(w, vocabulary)) for w in words)] += 1
    assert collections.Counter(tuple(r) for r in got) == want


# --- 7 licenses -----------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(licenses.UPPER, licenses.LOWER)


def places(text):
    words = WORD.findall((text or "").translate(FOLD))
    found = [(k, label) for p, label in licenses.PHRASES for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), found


def check_licenses(got, docs):
    want = collections.Counter()
    for doc_id, text in docs:
        n, found = places(text)
        starts = [k for k, _ in found]
        want[doc_id, n, len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))] += 1
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in got)


def test_license_places(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_licenses(registry.QUERIES["op7_diagonal_licenses"](spark, SF).collect(), docs)
    odd = [
        *EDGE[:4], *EDGE[6:], (20, "CC-BY cc by cc. BY;by MIT\nLicense apache  LICENSE"), (21, "gnu general public gnu general public license license"),
        (22, "cc"), (23, "cc by"), (24, "Émit license mit licensé"), (25, "\u212ait mit license İ c\u212a by \u0130 MİT license apache LICENSE\u212a apache license"), (20, "CC-BY"), (20, "CC-BY"),
    ]
    frame = docs_frame(spark, [(*d, "x") for d in odd], ", labels string")
    check_licenses(licenses.scan(frame).collect(), odd)
    assert licenses.scan(frame.limit(0)).count() == 0


def test_license_passages(spark):
    passage = dict((label, p) for p, label in licenses.PASSAGES)
    edited = passage["bsd"].replace("and binary forms", "and in binary or other forms")
    rows = [(1, "foo " + passage["isc"].upper() + " bar"), (2, edited), (3, " ".join(passage["bsd"].split()[:8])), (4, passage["apache"])]
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert [got[k].labels for k in (1, 2, 3, 4)] == ["isc", "bsd", "", "apache"] and got[4].base_labels == "apache"
    assert got[1].score == 1.0 and 0.6 <= got[2].score < 1


def test_repeated_or_shuffled_words_are_no_license(spark):
    """A place of the template counts once, and only in the template's order."""
    passage = dict((label, p) for p, label in licenses.PASSAGES)["mit"].split()
    blocks = [" ".join(passage[k : k + 4]) for k in range(0, len(passage), 4)]
    every = [" ".join(passage[k : k + 4]) for k in range(len(passage) - 3)]
    rows = [
        (1, "of this software and " * 20), (2, " ".join(reversed(blocks))), (3, " ".join(reversed(every))), (4, " ".join(passage) + " of this software and" * 20),
        (5, "of this software and " * 20 + " ".join(passage)), (6, " ".join(passage[:9] + ["x", "y"] + passage[9:20] + passage[21:])),
    ]
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    assert [got[k].labels for k in range(1, 7)] == ["", "", "", "mit", "mit", "mit"]
    assert [got[k].score for k in (1, 2, 3, 4, 5)] == [0.0, 0.0, 0.0, 1.0, 1.0] and 0.6 <= got[6].score < 1


def test_whole_license_texts(spark):
    rng = random.Random(31)
    rows = []
    for k, (text, _) in enumerate(licenses.TEXTS):
        words = text.split()
        rows += [(10 * k, f"{prose(rng, 20)} {text.upper()} {prose(rng, 20)}"), (10 * k + 1, " ".join(w for w in words if rng.random() > 0.03)), (10 * k + 2, " ".join(words[60:90]))]
    got = {r.doc_id: r for r in licenses.scan(docs_frame(spark, rows)).collect()}
    for k, (_, label) in enumerate(licenses.TEXTS):
        assert label in got[10 * k].labels.split(",") and got[10 * k].score == 1.0
        assert label in got[10 * k + 1].labels.split(",") and got[10 * k + 2].labels == ""


# --- 8 Jaccard join ---------------------------------------------------------------------


def shingles(text):
    words = [w for w in re.split("[\x20\t-\r]+", (text or "").translate(FOLD)) if w]
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_components(rows):
    sets = [shingles(t) if d is not None else set() for d, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    low = {}
    for k, (d, _) in enumerate(rows):
        low[find(k)] = min(low.get(find(k), d), d) if d is not None else None
    return collections.Counter((d, len(shingles(t)), low[find(k)]) for k, (d, t) in enumerate(rows))


def varied(rng, base, share):
    return " ".join(w if rng.random() > share else w + "x" for w in base.split())


def test_jaccard_components(spark, monkeypatch):
    rng = random.Random(8)
    passage = prose(rng, 70)
    rows = [(k, prose(rng, rng.randrange(1, 120))) for k in range(60)]
    for base in range(6):
        text = prose(rng, rng.randrange(30, 200))
        rows += [(1000 * base + 100 + k, varied(rng, text, rng.choice([0, 0.01, 0.03, 0.05]))) for k in range(25)]
    rows += [(9000 + k, f"{passage} {prose(rng, 40)}") for k in range(40)] + [(9500 + k, f"{passage} {prose(rng, 4)}") for k in range(10)]
    rows += [*EDGE[:4], *EDGE[6:], (4, "same text here now"), (4, "same text here now"), (12, "SAME text  here\nnow"), (13, "a b"), (14, "a b c"), (15, "a b")]
    frame = docs_frame(spark, [(*r, 5) for r in rows], ", component_id int")
    want = brute_components(rows)
    assert collections.Counter(tuple(r) for r in jaccard_join.join_components(frame).collect()) == want
    monkeypatch.setattr(jaccard_join, "PART", 8)
    monkeypatch.setattr(jaccard_join, "COMMON", 15)
    assert collections.Counter(tuple(r) for r in jaccard_join.join_components(frame).collect()) == want
    kept = jaccard_join.keep_one(frame)
    assert kept.columns == frame.columns
    check_one_of_each_group([tuple(r)[:2] for r in kept.collect()], rows)
    assert jaccard_join.join_components(frame.limit(0)).count() == 0


def check_one_of_each_group(kept, rows):
    """Of each group of linked rows its row with the smallest id, and every row that can link with none."""
    sets = [shingles(t) if d is not None else set() for d, t in rows]
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and group[a] != group[b] and near(a, b):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    alone = collections.Counter(rows[k] for k in range(len(rows)) if not sets[k])
    got = collections.Counter(kept)
    assert not alone - got
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        if sets[k]:
            groups[group[k]].append(rows[k])
    left = got - alone
    assert sum(left.values()) == len(groups)
    for own in groups.values():
        low = min(d for d, _ in own)
        assert any(left[r] for r in own if r[0] == low)


def test_a_text_that_copies_nothing_stays(spark):
    """Where an id repeats, each of its texts is judged by its own group."""
    a, b = "one two three four five six seven", "other words that nobody has copied at all"
    for rows in ([(2, a), (4, a), (4, b)], [(4, b), (4, a), (2, a)]):
        assert sorted(tuple(r) for r in jaccard_join.keep_one(docs_frame(spark, rows)).collect()) == [(2, a), (4, b)]
    rng = random.Random(21)
    texts = [prose(rng, 60) for _ in range(80)]
    first = [(k, texts[k]) for k in range(40)]
    own, copies = [(100 + k, texts[40 + k]) for k in range(40)], [(100 + k, texts[k]) for k in range(40)]
    empty = [(100 + k, None) for k in range(20)] + [(100 + k, " \n") for k in range(20)]
    for rows in (first + own + copies + empty, empty + copies + own + first):
        got = collections.Counter(tuple(r) for r in jaccard_join.keep_one(docs_frame(spark, rows)).collect())
        assert got == collections.Counter(first + own + empty)


def test_links_are_written_once(spark, monkeypatch):
    """Each list of links is written for its components and not before; on a local disk every file starts a process."""
    rng, names, write = random.Random(33), [], common.stored
    for module in (common, jaccard_join):
        monkeypatch.setattr(module, "stored", lambda df, name, *more: names.append(name) or write(df, name, *more))
    texts = [prose(rng, 60) for _ in range(20)]
    rows = [(k, varied(rng, texts[k % 20], 0.02)) for k in range(80)]
    assert collections.Counter(tuple(r) for r in jaccard_join.join_components(docs_frame(spark, rows)).collect()) == brute_components(rows)
    assert names.count("edges") == names.count("components") == 2


def test_jaccard_on_the_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert collections.Counter(tuple(r) for r in registry.QUERIES["op8_count_tree_jaccard"](spark, SF).collect()) == brute_components(rows)


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(rng.random((400, 1)) * 3, (400, jaccard_join.GROUPS))
    points[200:] = np.maximum(points[:200] + rng.integers(-1, 2, (200, jaccard_join.GROUPS)) * (rng.random((200, jaccard_join.GROUPS)) < 0.2), 0)
    n = points.sum(1)
    tree = jaccard_join.CountTree(points, n)
    for k in range(0, 400, 7):
        fits = (np.minimum(points, points[k]).sum(1) >= jaccard_join.needed(n, n[k])) & (100 * np.minimum(n, n[k]) >= 75 * np.maximum(n, n[k]))
        assert sorted(tree.search(points[k], int(n[k]))) == list(np.flatnonzero(fits))


# --- 9 chat -----------------------------------------------------------------------------

TRICKY = st.lists(st.sampled_from(["\\", "#", "###", "### ", "</turn>", " </turn>\n", ":", "\n", "a", "é", " ", "Assistant: "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TRICKY, TRICKY), min_size=1, max_size=4))
def test_chat_round_trip(turns):
    done = [chat.render(r, t) for r, t in turns]
    text = "".join(d[0] for d in done)
    parsed = chat.parse(text)
    assert [p[:2] for p in parsed] == turns
    assert all(chat.unescape(d[0][d[1] : d[2]]) == t for d, (_, t) in zip(done, turns))


def test_escaping_is_sparing():
    assert chat.render("user", "plain: text\nwith # and lines")[3] == 0
    assert chat.render("user", r"\### Assistant: </turn> ok")[3] > 0
    for bad in ("### a: b", "x", "### a: b </turn>", "### a b </turn>\n", "### a: ### </turn>\n"):
        with pytest.raises(ValueError):
            chat.parse(bad)


def test_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    odd = r"\### Assistant: </turn> ok"
    by = collections.defaultdict(list)
    for conv, turn, role, text in [*rows, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]:
        by[conv].append((turn, role, text))
    got = {r.conv_id: r for r in registry.QUERIES["op9_grammar_chat"](spark, SF).collect()}
    assert set(got) == set(by)
    for conv, turns in by.items():
        turns.sort()
        said = "".join(t for _, r, t in turns if r == "assistant")
        r = got[conv]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(said))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for _, a, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_ties_go_by_role_and_text(spark):
    """By what was said, not by how it is escaped."""
    texts = ["#### z", "$ y", "\\### a", "### a", "</turn>", "<a"]
    rows = [(1, 0, "user", t) for t in texts] + [(1, 0, r, "x") for r in ("a:b", "a b", "###", "$")]
    got = chat.read_back(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    said = "".join(f"{r}\n{t}\n" for r, t in sorted((r, t) for _, _, r, t in rows))
    assert got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def test_the_loss_is_what_the_mask_names(spark):
    rows = [(1, 0, "user", "ask"), (1, 1, "assistant", "tell ### me"), (1, 2, "assistant", "more")]
    done = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    right = chat.read_back(done).first()
    assert (right.loss_chars, right.loss_sha256) == (15, hashlib.sha256(b"tell ### memore").hexdigest())
    shifted = chat.read_back(done.withColumn("body_end", F.col("body_end") - 1)).first()
    swapped = chat.read_back(done.withColumn("in_loss", ~F.col("in_loss"))).first()
    assert shifted.loss_chars == 13 and swapped.loss_chars == 3 and shifted.turns_sha256 == swapped.turns_sha256 == right.turns_sha256


def test_chat_edges(spark):
    rows = [(None, 1, "user", "x"), (None, None, None, None), (1, 0, "assistant", None), (1, 0, "assistant", None), (2, 5, "a: b\n###", "t" * 200_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(frame)).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {None: 2, 1: 2, 2: 1}
    assert got[None].turns_sha256 == hashlib.sha256(b"\n\nuser\nx\n").hexdigest() and got[1].loss_chars == 0
    assert chat.read_back(chat.format_turns(frame.limit(0))).count() == 0


# --- 10 embeddings ------------------------------------------------------------------------


def brute_links(x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (unit @ unit.T >= threshold) & ~np.eye(len(x), dtype=bool)


def labels_of(links):
    label = np.arange(len(links))
    while True:
        low = np.minimum(label, np.where(links, label[None, :], len(links)).min(1))
        if (low == label).all():
            return label
        label = low


def test_near_duplicate_vectors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    x = np.concatenate([rng.standard_normal((400, 64)), *(b + rng.standard_normal((25, 64)) * s for b, s in zip(base, rng.uniform(0.05, 0.33, 60))), np.repeat(base[:1], 50, 0)])
    x = x.astype("f4").astype(float)[rng.permutation(len(x))]
    want = brute_links(x)
    monkeypatch.setattr(embedding_dedup, "PART", 64)
    monkeypatch.setattr(embedding_dedup, "COUNTED", 4)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 48)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = sorted(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    found, true = sum(r.n_links for r in got), want.sum()
    assert 0.995 * true <= found <= true and all(r.n_links <= want[r.vec_id].sum() for r in got)
    label = labels_of(want)
    assert np.mean([r.component_id == label[r.vec_id] for r in got]) > 0.995
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8, 0.9, "hot"])
def test_vectors_round_a_common_direction(spark, mean):
    """Recall at the threshold, with vectors that share a direction by a mean of so much, or a third of them near copies of one."""
    rng = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    common = unit(rng.standard_normal(64))
    if mean == "hot":
        x = np.concatenate([unit(rng.standard_normal((1000, 64))), unit(common + 0.36 * unit(rng.standard_normal((500, 64))))])[rng.permutation(1500)]
    else:
        x = unit(mean * common + (1 - mean**2) ** 0.5 * unit(rng.standard_normal((1500, 64))))
    own = x[:300]
    turn = rng.standard_normal(own.shape)
    cos = rng.uniform(0.901, 0.92, (300, 1))
    x = np.concatenate([x, cos * own + np.sqrt(1 - cos**2) * unit(turn - (turn * own).sum(1, keepdims=True) * own)])
    want = brute_links(x)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = sorted(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    found, true = sum(r.n_links for r in got), want.sum()
    assert true >= 600 and 0.99 * true <= found <= true and all(r.n_links <= want[r.vec_id].sum() for r in got)
    assert np.mean([r.component_id == c for r, c in zip(got, labels_of(want))]) > 0.99


def test_the_embeddings_by_brute_force(spark):
    """The registered query on its whole table."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    usable = [r for r in rows if r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    want = brute_links(np.array([r.embedding for r in usable], float))
    label = labels_of(want)
    ids = np.array([r.vec_id for r in usable])
    low = {k: ids[label == k].min() for k in set(label.tolist())}
    expect = {r.vec_id: (0, r.vec_id) for r in rows} | {int(i): (int(n), int(low[k])) for i, n, k in zip(ids, want.sum(1), label.tolist())}
    got = registry.QUERIES["op10_itq_near_dedup"](spark, SF).collect()
    assert len(got) == len(rows)
    off = [r for r in got if (r.n_links, r.component_id) != expect[r.vec_id]]
    assert len(off) <= 0.005 * len(rows) and all(r.n_links <= expect[r.vec_id][0] and r.kept == (r.vec_id == r.component_id) for r in got)


def test_many_lengths_of_vectors(spark, monkeypatch):
    """Only a few lengths are fitted; vectors of the others find theirs by drawn rotations."""
    monkeypatch.setattr(embedding_dedup, "LENGTHS", 2)
    rng = np.random.default_rng(9)
    rows = []
    for d in range(3, 13):
        base = rng.standard_normal((12, d))
        rows += [v.tolist() for v in np.concatenate([base, base * 3.0, base + 0.05 * rng.standard_normal((12, d))])]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")).collect()}
    for d in range(3, 13):
        ids = [k for k, v in enumerate(rows) if len(v) == d]
        want = brute_links(np.array([rows[k] for k in ids]))
        assert sum(got[k].n_links for k in ids) >= 0.99 * want.sum() and all(got[k].n_links <= n for k, n in zip(ids, want.sum(1)))


def test_vector_edges(spark):
    nan = float("nan")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [nan, 1.0]), (7, [float("inf"), 1.0]), (8, []),
        (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.0]), (10, [1.0, 0.0]), (None, [1.0, 0.0]), (11, [0.0, -1.0]), (12, [1e-300, 0.0]),
    ]
    frame = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, n_links int")
    got = collections.Counter(tuple(r) for r in embedding_dedup.near_duplicates(frame).collect())
    alone = [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11)] + [(None, 0, None, None)]
    assert got == collections.Counter(alone + [(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (10, 4, 1, False), (12, 4, 1, False)])
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


# --- the pipeline ---------------------------------------------------------------------------


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    kept, frames = dict(rows), docs
    model = quality.train(docs, common.table(spark, SF, "labels"))
    items = [tuple(r) for r in common.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        frames = common.stored(stage(spark, frames, SF), name)
        if name == "quality":
            kept = {k: t for k, t in kept.items() if model.scores(quality.feature_matrix([t.encode()]))[0] >= 0.5}
        elif name == "near_duplicates":
            keep = {c for _, _, c in brute_components(list(kept.items()))}
            kept = {k: t for k, t in kept.items() if k in keep}
        elif name == "decontamination":
            leaked = {d for d, _ in leaks_by_hand(list(kept.items()), items)}
            assert leaked
            kept = {k: t for k, t in kept.items() if k not in leaked}
        if name != names[-1]:
            assert frames.columns == docs.columns
            assert {r.doc_id: r.text for r in frames.collect()} == kept
    assert 0 < len(kept) < len(rows)
    check_packing(frames.collect(), list(kept.items()))


def pipeline_tables(spark, folder, docs):
    """A folder of the pipeline's tables with documents of one's own, which have columns that clash with the stages' names."""
    rows = [(d, t, "en", "s", len(t or ""), 0.5, "k", 7) for d, t in docs]
    spark.createDataFrame(rows, DOCS + ", score double, kept string, mark int").write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        common.table(spark, SF, t).write.parquet(f"{folder}/{t}.parquet")
    return str(folder)


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and ids, clashing columns: every stage keeps what it is to keep."""
    known = [(r.doc_id, r.text) for r in common.table(spark, SF, "documents").collect()]
    odd = [(None, known[0][1]), (None, None), (9001, None), (9001, ""), (9002, known[0][1]), (9002, known[1][1] + " changed at its very end"), (9003, " ".join(t for _, t in known)), (9003, " ".join(t for _, t in known))]
    folder = pipeline_tables(spark, tmp_path / "a", known + odd)
    frame = docs = common.table(spark, folder, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = collections.Counter((r.doc_id, r.text) for r in frame.collect())
        frame = common.stored(stage(spark, frame, folder), name)
        assert frame.schema.names == docs.schema.names
        after = collections.Counter((r.doc_id, r.text) for r in frame.collect())
        assert not after - before
        if name == "near_duplicates":
            check_one_of_each_group(list(after.elements()), list(before.elements()))
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert sum(p.length for p in pieces) == sum(p.doc_tokens for p in pieces if p.start == 0)
    assert {p.doc_id for p in pieces} == {r.doc_id for r in frame.collect()}
    empty = pipeline_tables(spark, tmp_path / "b", [])
    assert corpus_pipeline.run(spark, empty).count() == 0


MIXED = st.lists(st.sampled_from(["the", "The", "they're", "don't", "IT'S", "x²", "½", "a1b2", "...", ".,", "?!", "***", "_", "snake_case", "É", "straße", "×", "İ", "Σας", "é", "文字", "“q”", " ", "\n", "\x1c", "\x85", " ", ".", ",", "ab.cd", "<|endoftext|>", "<|", "ǅ", "K"]), max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(MIXED, st.sampled_from(["", " "])), min_size=1, max_size=4))
def test_pieces_match_the_tokenizer(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [joint.join(t) for t, joint in texts]
    pieces = packing.pieces(path)
    assert [p.tolist() for p in pieces(texts)] == [pieces.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
