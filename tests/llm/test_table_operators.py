"""Operators on pages and on pairs of documents, and the pipeline, against brute force."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import html_text, ngram_join, packing, quality, registry, secrets, warc
from marlstone.operators.components import components

SF = "/root/testdata/sf0.001"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no, no, no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu one</a></ul></nav><div class="cookie-notice"><p>We use cookies, as all, do.</p></div>
<div id=wrap><div class="col sidebar"><p>Side text, with commas, many, of them, here.</p></div>
<article class=post><h1>A &amp; B&nbsp;title</h1><p>First   paragraph, with
 <b>bold</b> &#233;t&eacute; &lt;tag&gt;.<p>Second one, unclosed<br>after break
<ul><li>Item one, long enough<li>Item two</ul><aside>aside, text</aside><div class="ad">Buy, now</div><blockquote><p>Quoted, words.</p></blockquote>
<table><tr><td>cell a<td>cell b</table><form><p>form, text</p></form><!-- <p>comment</p> --><pre>code
 x</pre></article>
<section id="comments"><p>Reader says, well, this is a long comment, with commas, and more, and more text than the article has, maybe.</p></section></div>
<footer><p>&copy; foot, note</p></footer><p>stray"""


def test_html_text():
    want = ["A & B title", "First paragraph, with bold été <tag>.", "Second one, unclosed after break", "Item one, long enough", "Item two", "Quoted, words.", "cell a", "cell b", "code x"]
    assert html_text.main_text(PAGE).split("\n") == want
    plain = "<body><div class=nav><a href=x>Home, sweet</a></div><div><div class=story>" + "<p>Some text, with commas, that goes on and on for a while, and ends.</p>" * 4 + "</div><div class=comments><p>I say, hm.</p></div></div>"
    assert html_text.main_text(plain).count("Some text") == 4 and "I say" not in html_text.main_text(plain) and "Home" not in html_text.main_text(plain)
    for odd in (None, "", "   ", "<", "<p", "</p></div>", "no markup, at all", "<p>a &am", "<div " * 50, "<b>" * 5000 + "x" + "</b>" * 5000):
        html_text.main_text(odd or "")
    assert html_text.main_text("no markup, at all") == "no markup, at all"
    assert html_text.main_text("<article><p>one<p>two &lt;x <a hre") == "one\ntwo <x"


def test_html_wrappers_and_rest_of_main():
    text = "<p>Some text, with commas, that goes on and on for a while, and ends.</p>"
    for tag in ("form", "header", "dialog", "object", "map"):
        for inner in (text * 4, f"<article>{text * 4}</article>", f"<div class=story>{text * 4}</div><form><p>Search, now</p></form>"):
            page = f"<body><{tag} id=x action=y><nav><a href=x>Home</a></nav>{inner}</{tag}><footer><p>foot</p></footer></body>"
            got = html_text.main_text(page)
            assert got.count("Some text") == 4 and "Search" not in got and "Home" not in got and "foot" not in got, page
    assert html_text.main_text(f"<p>short<form><header>{text * 4}</header></form>").count("Some text") == 4
    kept = html_text.main_text(f"<header><p>{'Site, of words ' * 30}</p></header><form><p>{'Fill in, please ' * 30}</p></form><article>{text}</article>")
    assert kept.startswith("Some text") and "\n" not in kept
    page = f"<main><h1>Title</h1><p>Lead, in short.</p><div><article>{text * 4}</article><p>After it.</p></div>bare words<ul><li>Item</ul><ul><li><a href=x>Link</a></ul><aside>side</aside><article><p>x</p></article></main><p>out"
    assert html_text.main_text(page).split("\n") == ["Title", "Lead, in short.", *["Some text, with commas, that goes on and on for a while, and ends."] * 4, "After it.", "bare words", "Item"]


def test_attributes_and_names():
    """Quotes only where a value starts; whole attribute names; weak words only as whole names or outside the article's own."""
    text = html_text.main_text
    assert text("<p>One <a title=don't href=x>two</a> three.</p><p>It's four, five.</p><p>Six.</p>") == "One two three.\nIt's four, five.\nSix."
    assert text("<article><p data-hidden='false'>one, here</p><p data-id='ad'>two</p><p title='the hidden gem'>three</p><p hidden>no</p><p aria-hidden=true>no</p><p style='Display : none'>no</p></article>") == "one, here\ntwo\nthree"
    assert text("<article><div class='post-header'><h1>Title</h1></div><p>text, here</p><div class='site-header'>no</div><div class='share'>no</div></article>") == "Title\ntext, here"
    assert text("<article><p>a<br/>b</p><p class=x/>c</p><p>d</p") == "a b\nc\nd"


def test_nesting_takes_linear_time():
    import time

    for tag in ("<div>", "<ul>", "<form>", "<div class=menu>", "<table><tr><td>", "<p><b>"):
        page = (tag + "<p>x, y and z</p>") * 8000
        began = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - began < 4, tag


def layout(rng, blocks):
    """A page of one of several layouts around the blocks of an article."""
    body = "".join(f"<{t}>{b}</{t}>" for t, b in blocks)
    menu = "<ul>" + "".join(f"<li><a href=/{k}>Section {k}</a></li>" for k in range(rng.randrange(3, 9))) + "</ul>"
    noise = {
        "nav": f"<nav>{menu}</nav>", "header": f"<header><a href=/>Site name</a>{menu}</header>", "side": f"<div class='{rng.choice(['sidebar', 'col left-side', 'widget related'])}'><p>Most read, this week, and more.</p>{menu}</div>",
        "ads": f"<div id={rng.choice(['ad-slot', 'advert1', 'sponsored'])}><p>Buy now, while stocks last, at once.</p></div>", "cookie": "<div class='cookie-banner'><p>We use cookies, as you know, and more.</p><button>OK</button></div>",
        "comments": "<section class=comments><article class=comment><p>Well, I for one, having read it, agree, with all, of it.</p></article></section>", "footer": f"<footer><p>Rights, all, reserved.</p>{menu}</footer>",
        "script": "<script>if (a < b) { c = '<p>no, no, no</p>' }</script><style>p > a { x: y }</style>",
    }
    wrap = rng.choice([
        "<article>{}</article>", "<main><article class='post'>{}</article></main>", "<div class='story-body'>{}</div>", "<div id=content><div class=entry-content>{}</div></div>",
        "<main>{}</main>", "<table><tr><td>{}</td></tr></table>", "<form action=x><div class=text>{}</div></form>", "<div class='has-sidebar layout'><article>{}</article></div>",
    ])
    keys = list(noise)
    rng.shuffle(keys)
    before, after = keys[: rng.randrange(len(keys))], keys[-2:]
    return "<html><head><title>no</title></head><body>" + "".join(noise[k] for k in before) + wrap.format(body) + "".join(noise[k] for k in after if k not in before) + "</body></html>"


def test_many_layouts():
    rng = random.Random(8)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part".split()
    for _ in range(300):
        blocks = [("p", " ".join(rng.choice(words) for _ in range(rng.randrange(25, 90))) + ", " + " ".join(rng.choice(words) for _ in range(9)) + ".") for _ in range(rng.randrange(4, 10))]
        page = layout(rng, blocks)
        assert html_text.main_text(page).split("\n") == [b for _, b in blocks], page


def test_extract_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.extract(pages).join(pages.select("page_id", "html"), "page_id").collect():
        body = re.search(r"<article>(.*?)(</article>|<footer>|\Z)", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", body)
        import html

        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)
    assert html_text.extract(pages.where("false")).count() == 0
    odd = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>x, y")], "page_id long, url string, html string").selectExpr("*", "1 as text")
    assert sorted(r["text"] for r in html_text.extract(odd).collect()) == ["", "", "x, y"]


def test_warc(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 500)
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    more = spark.createDataFrame([(1001, "http://a\r\nX: y", "same"), (1002, None, "same"), (1003, "u", None), (1004, "u", ""), (1005, "u", "same"), (None, "u", "same"), (1005, "u", "same")], "page_id long, url string, html string")
    rows = pages.unionByName(more).withColumn("digest", F.lit("clash"))
    bundles = warc.write_bundles(rows)
    got = warc.read_records(bundles).collect()
    assert len(got) == rows.count()
    largest = collections.defaultdict(int)
    for r in rows.collect():
        largest[r["html"] or ""] = max(largest[r["html"] or ""], r["page_id"] or 0)
    want = collections.Counter()
    for r in rows.collect():
        p = r["html"] or ""
        digest = base64.b32encode(hashlib.sha1(p.encode()).digest()).decode()
        first = r["page_id"] == largest[p]
        want[r["page_id"], len(p.encode()), digest, "response" if first else "revisit", None if first else largest[p]] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    index = {(r["record_id"], r["bundle"]): r for r in warc.record_index(bundles).collect()}
    data = {r["bundle"]: bytes(r["data"]) for r in bundles.collect()}
    r = index[next(k for k in index if k[0] == "urn:x-page:7")]
    _, _, body = warc.parse_record(warc.BundleReader(data[r["bundle"]]).record(r["frame"], r["offset"], r["length"]))
    assert body.decode() == pages.where("page_id = 7").first()["html"]
    import io

    import zstandard

    for d in data.values():  # the frames and the seek table are a plain Zstandard stream too
        assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(d), read_across_frames=True).read().count(b"WARC/1.1\r\n") == sum(1 for k in index if data[k[1]] is d or data[k[1]] == d)
    assert warc.read_records(warc.write_bundles(pages.where("false"))).count() == 0
    small = warc.read_records(warc.write_bundles(more, least=5)).collect()
    assert {r["record_type"] for r in small} == {"response"}


def brute(rows, k, percent):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    low = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    sets = []
    for _, t in rows:
        w = word.findall((t or "").translate(low))
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.fixture(scope="module")
def families():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for size in (60, 200, 25, 8):
        base = [rng.choice(vocabulary) for _ in range(size)]
        chain = list(base)
        for step in range(25):
            copy = list(chain if step % 2 else base)
            for _ in range(rng.randrange(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if step % 2:
                chain = copy
            rows.append((n, " ".join(copy)))
            n += 1
    shared = " ".join(rng.choice(vocabulary) for _ in range(70))
    rows += [(n + i, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(60))) for i in range(40)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "One TWO"), (904, "one two"), (905, "one two three"), (906, "É a b c"), (907, "é a b c"), (908, "a b c d"), (None, rows[0][1]), (3, rows[40][1]), (909, "z " * 3000)]
    return rows


@pytest.mark.parametrize("k,percent,block,tokens,hubs", [(5, 80, 512, 1 << 19, 6), (3, 90, 7, 1 << 19, 2), (2, 60, 16, 500, 1)])
def test_ngram_join(spark, families, monkeypatch, k, percent, block, tokens, hubs):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BUCKET", block)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", tokens)
    monkeypatch.setattr(ngram_join, "HUBS", hubs)
    docs = spark.createDataFrame(families, "doc_id long, text string").selectExpr("*", "1 as node", "2 as size")
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs, k, percent).collect())
    assert got == brute(families, k, percent)


def test_ngram_join_of_null_and_repeated_ids(spark):
    words = [f"w{i}" for i in range(100)]
    changed = lambda *at: " ".join("x" + w if i in at else w for i, w in enumerate(words))
    # of one family at 0.9, since prefixes meet, but none is like another
    apart = [changed(), changed(50), changed(20, 50), changed(20, 50, 80)]
    far = [changed(10, 30, 50), changed(10, 30, 60), changed(10, 40, 70)]
    rows = [(None, t) for t in apart + far] * 3 + [(7, t) for t in far] + [(7, apart[3]), (9, apart[0]), (None, changed(5, 15))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for percent in (80, 95):
        got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.link(docs, 3, percent).collect())
        assert got == brute(rows, 3, percent)
    reps = spark.createDataFrame([(i, -(2**63), i) for i in range(7)], "node long, label long, key long")
    texts = spark.createDataFrame([(None, t, i) for i, t in enumerate(apart + far)] * 3, "doc_id long, text string, key long")
    classes = spark.sparkContext.broadcast(ngram_join.sketch_classes(texts, 3))
    sets = ngram_join.sets_of(texts, reps, classes, 3, 90).cache()
    assert {r["node"]: r["n_shingles"] for r in sets.collect()} == dict.fromkeys(range(7), 98)
    edges = {tuple(sorted(e)) for e in ngram_join.verified_edges(sets, reps.selectExpr("node", "1L as family"), classes, 90).collect()}
    assert edges == {(0, 1), (1, 2), (2, 3)}


def test_ngram_join_moves_few_sets_of_a_family_without_links(spark, monkeypatch):
    # long sets of one family: part counts of 64 can't tell them apart, and each would meet all blocks
    rng = random.Random(5)
    alone = [[rng.getrandbits(64) for _ in range(1500)] for _ in range(120)]
    near = [[*alone[0][: 1500 - 10 * k], *(rng.getrandbits(64) for _ in range(10 * k))] for k in range(1, 31)]
    sets = [(k, 1500, bytearray(np.sort(np.array(x, "u8")).tobytes())) for k, x in enumerate(alone + near)]
    sets = spark.createDataFrame(sets, "node long, n_shingles long, tokens binary")
    moved, linked = [], ngram_join._linked_pairs
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "REFINED", 1 << 15)
    monkeypatch.setattr(ngram_join, "_linked_pairs", lambda rows, *a: moved.append(rows.count()) or linked(rows, *a))
    classes = spark.sparkContext.broadcast(np.zeros(ngram_join.SLOTS, np.uint8))
    edges = ngram_join.verified_edges(sets, sets.selectExpr("node", "0L as family"), classes, 80).collect()
    joined = {0}
    for _ in range(150):
        joined |= {x for e in edges for x in e if joined & {*e}}
    whole = [*alone, *near]
    links = {(i, j) for i in range(150) for j in range(i) if 180 * len(both := set(whole[i]) & set(whole[j])) >= 80 * 3000 and both}
    assert joined == {0} | {x for e in links for x in e} and len(joined) > 10
    assert sum(moved) < 2 * 150  # 3,036 before


def test_slabs_of_long_texts(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "É", "C d", "e\tf", "x" * 90]) for _ in range(300)), "y" * 5000, "  " * 900, "a b"]
    whole = [s.tolist() for s in ngram_join.shingle_sets(texts, 3)]
    monkeypatch.setattr(ngram_join, "SLAB", 64)
    assert [s.tolist() for s in ngram_join.shingle_sets(texts, 3)] == whole


def test_ngram_join_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link(docs).count() == 0
    assert ngram_join.keep_one(spark.createDataFrame([(1, None), (2, None), (3, "a b"), (4, "a b")], "doc_id long, text string")).count() == 3


def test_keep_one_row_of_each_component(spark):
    rows = [
        (None, "alone with no id", "x"),
        (None, "b c d e f", "x"), (5, "b c d e f", "x"),
        (7, "g h i j k", "x"), (7, "g h i j k", "x"), (7, "g h i j k", "y"),
        (7, "another text of this id", "x"), (2, "another text of this id", "x"),
        (None, "l m n o p", "x"), (None, "l m n o p", "x"),
        (None, None, "x"), (None, None, "x"), (None, "", "x"), (None, None, "y"), (8, " ", None),
        (7, "the third text of seven", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = collections.Counter(map(tuple, ngram_join.keep_one(docs).collect()))
    seven = [r for r in got if r[1] == "g h i j k"]
    assert len(seven) == 1 and seven[0][0] == 7
    want = [rows[0], rows[2], rows[7], rows[8], rows[10], rows[12], rows[13], rows[14], rows[15], seven[0]]
    assert got == collections.Counter(want)


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 50)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: find(x) for x in got}
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "best-fit packing"]
    first = stages["quality classifier"](spark, docs, SF)
    net = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r["doc_id"] for r in docs.collect() if net.score([(r["text"] or "").encode()])[0] >= quality.THRESHOLD}
    assert first.columns == docs.columns and abs(len({r[0] for r in first.select("doc_id").collect()} ^ want)) <= 1
    second = stages["n-gram Jaccard join"](spark, docs, SF)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    kept = {c for _, _, c in brute(rows, 5, 80)}
    assert {r[0] for r in second.select("doc_id").collect()} == kept and second.columns == docs.columns and second.count() == len(kept)
    third = stages["secret scans"](spark, docs, SF)
    assert third.columns == docs.columns and third.count() == docs.count()
    masked = {r["doc_id"]: r["text"] for r in third.collect()}
    for d, t in rows:
        assert masked[d] == t if not secrets.scan_text(t)[1] else not secrets.base_spans(masked[d])
    fourth = stages["mixing sources to target weights"](spark, docs, SF)
    assert fourth.columns == docs.columns and max(collections.Counter(r[0] for r in fourth.select("doc_id").collect()).values()) <= 3
    fifth = stages["best-fit packing"](spark, docs, SF)
    spots = sorted((r["sequence_id"], r["offset"], r["length"]) for r in fifth.collect())
    for (s, o, n), (s2, o2, _) in zip(spots, spots[1:]):
        assert o2 == (o + n if s == s2 else 0) and o + n <= packing.CAPACITY
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_stages_on_odd_tables(spark):
    """Nulls in every column, empty and repeated rows, extra columns of clashing names, and no rows at all."""
    good = "The committee met on Monday, and after some hours of talk it agreed on the plan, which was sent out the same day. " * 3
    rows = [(i, f"{good} Number {i} of {i * 7}, as {i * 13} said.", "en", f"s{i % 3}", 300) for i in range(12)]
    rows += [(None, good, "en", None, None), (20, None, None, None, None), (21, "", "en", "s1", 0), (3, rows[3][1], "en", "s0", 300), (3, rows[3][1], "en", "s0", 300), (3, "password=hunter22 and " + good, "de", "s0", 5), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    names = {"score": "1.5", "node": "cast(null as string)", "size": "7L", "row": "'x'", "doc": "array(1)", "copies": "2", "tree": "1", "key": "'k'", "label": "0", "u": "0.5", "rest": "1", "stratum": "1"}
    docs = plain.selectExpr("*", *(f"{e} as `{n}`" for n, e in names.items()))
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = collections.Counter(str(r) for r in out.collect())
        given = collections.Counter(str(r) for r in docs.collect())
        if name == "n-gram Jaccard join":
            assert max(got.values()) == 1 and set(got) <= set(given)
        elif name == "mixing sources to target weights":
            assert all(n <= 3 * given[r] for r, n in got.items())
        elif name == "secret scans":
            assert sum(got.values()) == len(rows) and "hunter22" not in str(got)
        else:
            assert not got - given
        empty = stage(spark, docs.where("false"), SF)
        assert empty.columns == docs.columns and empty.count() == 0, name
    last = corpus_pipeline.STAGES[4][1]
    packed = last(spark, docs, SF).collect()
    assert len({(r["sequence_id"], r["offset"]) for r in packed}) == len(packed) == len(rows)
    assert last(spark, docs.where("false"), SF).count() == 0


def test_every_query_is_there():
    names = set(registry.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)}
