"""Operators on single rows: URLs, pages, pieces, personal data, training order, toxicity."""

import hashlib
import itertools
import random
import re
import time
from html.parser import HTMLParser
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.llm import html, order, pieces, queries, toxicity, urls
from orrery.llm.common import Scratch

ODD = [None, "", " ", "a", "  two  spaces ", "line\n\nline\n", "▁ mark ▁", "<s> </s> <unk>", "naïve – “quotes” 漢字 😀‍", "x" * 5000, "ab " * 40_000, "\x00\x01", "...!!! a.b,c"]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, k string, node int, root int")


def test_rules_and_redirects(spark):
    canon = '<html><head><link rel="canonical" href="{}"></head></html>'
    rows = [
        (1, "http://Example.ORG/es/1?x", None), (2, "https://a.example.org/en/12#f", ""), (3, "http://other.org/x", ""), (4, "http://b.com/de/9", ""), (5, "http://b.com/fr/9", ""),
        (6, None, None), (7, "no scheme", "x"), (8, "http://c.net/1", canon.format("http://b.com/de/9")), (9, "http://c.net/2", canon.format("http://c.net/1")),
        (10, "http://d.net/1", canon.format("http://b.com/de/10")), (11, "http://d.net/1", canon.format("http://z.org/")), (12, "http://e.net/p/q", '<meta http-equiv="refresh" content="0; url=../de">'),
        (13, "http://f.net", ""), (8, "http://c.net/1", canon.format("http://b.com/de/9")),
    ]
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages(spark, [(*r, "c", 1, 2) for r in rows])).collect())
    want = [
        (1, "example.org", "/es/1", "example.org/es/", "block"), (2, "a.example.org", "/en/12", "example.org/en/1", "block"), (3, "other.org", "/x", "org/", "allow"), (4, "b.com", "/de/9", "com/de/", "block"), (5, "b.com", "/fr/9", "com/fr/", "allow"),
        (6, "", "", None, "allow"), (7, "", "", None, "allow"), (8, "c.net", "/1", None, "block"), (8, "c.net", "/1", None, "block"), (9, "c.net", "/2", None, "block"),
        (10, "d.net", "/1", None, "allow"), (11, "d.net", "/1", None, "allow"), (12, "e.net", "/p/q", None, "allow"), (13, "f.net", "", None, "allow"),
    ]
    assert got == want
    assert urls.judge(pages(spark, [])).count() == 0


def test_links_that_are_easily_lost(spark):
    canon = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://b.com/x/y", canon.format("../de/9")), (2, "http://b.com/x/z", canon.format("http://b.com:80/de/./9")), (3, "http://c.net/1", "<!-- " + canon.format("http://b.com/de/9") + " -->"),
        (4, "http://c.net/2", canon.format("http://c.net/3") + canon.format("http://b.com/de/8")), (5, "http://c.net/4", '<meta http-equiv=refresh content="5; URL=\'http://c.net/5\'"><meta http-equiv="Refresh" content="0;url=//b.com/de/7">'),
        (6, "http://c.net/6", f"<script>var x = '{canon.format('http://b.com/de/9')}'</script>"), (7, "http://c.net/7", '<base href="http://b.com/de/">' + canon.format("1")), (8, "https://b.com:443/fr/../x/../de/3", None),
        (9, "http://c.net/9", "<LINK HREF=http://b.com/de/9?a=1&amp;b=2 REL=canonical>"), (10, "http://c.net/10", '<link rel="alternate" href="http://b.com/de/9">'), (11, "http://user:pw@c.net:8080/", canon.format("http://b.com/de/9")), (12, "http://c.net:8080/", ""),
        (13, "http://c.net/../..", canon.format("/..")), (14, "http://b.com/de", canon.format("?x")),
    ]
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages(spark, [(*r, "c", 1, 2) for r in rows])).collect()}
    assert {i for i, v in got.items() if v == "block"} == {1, 2, 4, 5, 7, 8, 9, 11, 12}


def test_classes_of_100_000_links_with_a_hub(spark):
    rnd = random.Random(8)
    hub = [(f"http://h{i}.net/", "http://hub.net/") for i in range(40_000)]
    chains = [(f"http://c.net/{i}/{j}", f"http://c.net/{i}/{j + 1}") for i in range(800) for j in range(40)]
    rings = [(f"http://r.net/{i}/{j}", f"http://r.net/{i}/{(j + 1) % 5}") for i in range(4000) for j in range(5)]
    loose = [(f"http://l.net/{rnd.randrange(9000)}", f"http://l.net/{rnd.randrange(9000)}") for _ in range(8000)]
    ends = [("http://h7.net/", "http://b.com/de/1"), ("http://c.net/3/20", "http://b.com/de/2"), ("http://c.net/3/40", "http://x.org/"), ("http://c.net/9/1", "http://b.com/de/3"), ("http://r.net/44/0", "http://b.com/de/4"), ("http://l.net/5", "http://b.com/de/5")]
    edges = [*hub, *chains, *rings, *loose, *ends]
    assert len(edges) > 100_000
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    groups = {}
    for x in root:
        groups.setdefault(find(x), []).append(x)
    bad = {x for g in groups.values() if any("/de/" in x for x in g) and not any(".org" in x for x in g) for x in g}
    asked = sorted({a for a, _ in edges})
    table = spark.createDataFrame([(k, x, "") for k, x in enumerate(asked)], "page_id long, url string, html string")
    got = {asked[r["page_id"]] for r in urls.judge(table, redirects=spark.createDataFrame(edges, "from_url string, to_url string")).collect() if r["verdict"] == "block"}
    assert got == bad & set(asked) and len(got) > 40_000


def test_rules_against_plain_python(spark):
    for r in queries.op3_url_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "page_id").collect():
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", r["url"] or "")
        host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"]) == (host, path, max(fits)[1] if fits else None)
        assert not fits or r["verdict"] == max(fits)[2]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="ad">Buy now, cheap.</div><article><h1>Title &amp; more</h1><p>First   <b>paragraph</b>, with a comma, and
another line of some length so that it scores.<p>Second &lt;one&gt;<br>goes on, and on, and on.</p><ul><li>item one</li><li>item two</li></ul></article>
<section class="comments"><p>I like it, really, a lot, indeed.</p></section><form><p>Your name</p></form><footer>&copy; someone</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Title & more\n\nFirst paragraph, with a comma, and another line of some length so that it scores.\n\nSecond <one> goes on, and on, and on.\n\nitem one\n\nitem two"
    assert html.main_text("just text") == "just text"
    for x in (None, "", "<p>", "<div", "<!--", "<script>x", "<a href=x>only</a>", "</p></p>", "<p>" * 5000 + "deep", "<div>" * 20_000 + "deep, deep"):
        assert isinstance(html.main_text(x), str)


LONG = "One sentence, two clauses, and some more words that make a paragraph."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><article><p>{LONG}</p></article><article><p>Short.</p></article></div>", [LONG, "Short."]),
        (f"<main><div><p>{LONG}</p><p>{LONG}</p></div><div><p>The end.</p></div></main>", [LONG, LONG, "The end."]),
        (f'<body><h2 id="related-work">Related work</h2><p class="lead related">{LONG}</p><p>{LONG}</p></body>', ["Related work", LONG, LONG]),
        (f'<span class="ad">BUY <span>x</span> LEAKED</span><p>{LONG}</p>', [LONG]),
        (f'<p>{LONG} <span class="ad">BUY <b>x</b> LEAKED</span> end</p>', [LONG + " end"]),
        ("<p>a < b and 5 <6 or <3, " + LONG + "</p>", ["a < b and 5 <6 or <3, " + LONG]),
        (f'<a href="x>text</a><p>{LONG}</p>', ["text", LONG]),
        (f'<body class="has-sidebar"><form action="/"><div class="content-with-sidebar"><p>{LONG}</p></div><div class="sidebar"><p>{LONG[:30]}</p></div></form></body>', [LONG]),
        (f'<div class="content-sidebar"><p>{LONG}</p><p>{LONG}</p></div><footer>{LONG}</footer>', [LONG, LONG]),
        (f'<article><header><h1>Head</h1></header><p>{LONG}</p></article><header>Site</header>', ["Head", LONG]),
        (f'<article><p>{LONG}</p></article><div class="comments"><article class="comment"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></div>', [LONG]),
        (f"<article><p>{LONG}</p></article><footer><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></footer>", [LONG]),
        (f'<article><p>{LONG}</p></article><div class="cookie-banner"><p>{LONG}</p><p>{LONG}</p></div><div class="site-notice">{LONG}</div>', [LONG]),
        (f"<table><tr><td>{LONG}<td>two<tr><td>three</table>", [LONG, "two", "three"]),
        (f"<ul><li>{LONG}<ul><li>in</ul><li>out</ul>", [LONG, "in", "out"]),
        (f'<p>x&amp;y&nbsp;z &#x41;&lt;b&gt;</p><p hidden>no</p><p style="display: none">no</p><textarea><p>no</p></textarea><p>{LONG}', ["x&y z A<b>", LONG]),
    ],
)
def test_pages_of_many_kinds(page, want):
    assert html.main_text(page) == "\n\n".join(want)


class Plain(HTMLParser):
    """The blocks inside article elements, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        self.blocks += [""] * (tag in ("article", "h1", "p"))
        self.blocks[-1] += " " * (tag == "br")

    def handle_endtag(self, tag):
        self.inside &= tag != "article"
        self.blocks += [""] * (tag in ("h1", "p"))

    def handle_data(self, data):
        self.blocks[-1] += data if self.inside else ""


def test_every_page_against_the_standard_parser(spark):
    at = "/root/testdata/sf0.01"
    texts = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    rows = queries.op7_main_text(spark, at).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = Plain()
        p.feed(texts[r["page_id"]])
        p.close()
        want = "\n\n".join(x for x in (" ".join(b.split()) for b in p.blocks) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


@pytest.mark.parametrize("unit", ["<a ", "<ul>", "<li>", "<b>", "<p><div>", "<td><p>", "<!", "<", '<a x="', "<a href=x>y", "</p>", "<div>x, y", "<script>", "<a" + " " * 99, "<span class=ad>", "<form>"])
def test_a_million_characters_of_broken_markup(unit):
    began = time.time()
    html.main_text(unit * (1_000_000 // len(unit)) + '"')
    assert time.time() - began < 20  # about a second on an idle core


def test_pages_as_a_table(spark):
    rows = [(1, "u", PAGE, "c", 1, 2), (2, None, None, "c", 1, 2), (None, "u", "", "c", 1, 2), (1, "u", PAGE, "c", 1, 2)]
    got = html.extracted(pages(spark, rows)).collect()
    assert sorted(len(r["text"]) for r in got)[:2] == [0, 0] and len(got) == 4
    assert html.extracted(pages(spark, [])).count() == 0


@pytest.fixture(scope="module")
def model():
    return pieces.load()


def best(text, p):
    """Largest sum of log-probabilities, over the whole text at once."""
    score = [0] + [None] * len(text)
    for k in range(len(text)):
        for end in range(k + 1, min(len(text), k + p.longest) + 1):
            hit = p.log_p.get(text[k:end])
            if hit and score[k] is not None and (score[end] is None or score[k] + hit[0] > score[end]):
                score[end] = score[k] + hit[0]
        if score[k + 1] is None:
            score[k + 1] = score[k] + pieces.BYTE_LOG_P * len(text[k].encode())
    return score[-1]


def total(ids, p):
    value = {i: v for v, i in p.log_p.values()}
    return sum(value.get(i, pieces.BYTE_LOG_P) for i in ids)


def test_streamed_path_is_the_best_path(model):
    for t in [x for x in ODD if x and len(x) <= 5000] + [r"The house, on-the hill... \n and%%% to&&& " * 20, "Straßenbahnhaltestelle éèçà " * 15]:
        ids = list(pieces.encode(t, model))
        assert pieces.decode(ids, model) == t
        assert total(ids, model) == best(t, model)
        assert ids == [i for run in pieces.viterbi(t, model) for i in run]


def test_window_is_bounded(model):
    runs = [len(r) for r in pieces.viterbi("theandofto" * 3000, model)]
    assert len(runs) > 50 and max(runs) <= 4 * model.longest


def test_pieces_as_a_table(spark, model):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(ODD)] + [(None, "x", "c"), (3, "a", "c")], "doc_id long, text string, ids string")
    rows = pieces.encoded(docs).collect()
    assert len(rows) == len(ODD) + 2 and all(r["exact"] for r in rows)
    assert pieces.encoded(docs.limit(0)).count() == 0
    back = pieces.decoded(pieces.encoded(docs).withColumn("text", F.lit("clash")))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"]) for r in back.collect()) == sorted((i is None, i, t or "") for i, t in [*enumerate(ODD), (None, "x"), (3, "a")])
    odd = spark.createDataFrame([(1, None), (2, []), (3, [model.byte_ids[0xC3]]), (4, [10**6, -5, None]), (5, [model.byte_ids[0x41]])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(odd).collect()} == {1: None, 2: "", 3: "\ufffd", 4: "\ufffd" * 3, 5: "A"}


@pytest.mark.parametrize("total", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutation(total):
    slots = order.permuted(np.arange(total), total, 99)
    assert sorted(slots.tolist()) == list(range(total))
    assert (order.permuted(slots, total, 99, back=True) == np.arange(total)).all()


def test_shards_hold_every_text_once(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ODD * 3)], "doc_id long, text string").repartition(3)
    rows = order.materialise(docs, f"file://{tmp_path}/s", length=64, per_shard=16).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    enc, end = order.encoder(ranks := order.load_ranks()), max(order.load_ranks().values()) + 1
    assert end == len(ranks)
    read = list(order.read_slots(f"file://{tmp_path}/s", 0, len(rows), length=64, per_shard=16))
    by = {r["slot"]: r for r in rows}
    assert all(hashlib.sha256(x.tobytes()).hexdigest() == by[k]["sha256"] and by[k]["offset"] == k % 16 * 128 and by[k]["shard"] == k // 16 for k, x in enumerate(read))
    assert [x.tolist() for x in order.read_slots(f"file://{tmp_path}/s", 5, 20, length=64, per_shard=16)] == [x.tolist() for x in read[5:25]]
    # Put back into their order, the sequences are the texts, each with its end mark.
    back = order.permuted(np.arange(len(rows)), len(rows), 20240607, back=True)
    ids = [i for k in np.argsort(back) for i in read[k][: by[int(k)]["n_tokens"]].tolist()]
    texts, run = [], []
    for i in ids:
        if i == end:
            texts.append(enc.decode_bytes(run).decode())
            run = []
        else:
            run.append(i)
    assert not run and sorted(texts) == sorted(t or "" for t in ODD * 3)
    assert order.materialise(docs.limit(0), f"file://{tmp_path}/e").count() == 0


def test_long_runs_have_the_ids_of_the_vocabulary(monkeypatch):
    enc = order.encoder(order.load_ranks())
    for t in ("x" * 200_001, " " * 1_000_000 + "b", "a" + "\n" * 300_000, "\t" * 50_000 + " .", "😀" * 30_000, " " * 20_001 + "\x1c" + " " * 20_001):
        assert enc.decode_bytes(order.encode(t, enc)) == t.encode()
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(" \n\tab.1\x1c\u00a0") * rnd.choice([1, 1, 2, 5, 9]) for _ in range(40)) for _ in range(400)]
    want = [enc.encode_ordinary(t) for t in texts]
    monkeypatch.setattr(order, "RUN", 4)
    monkeypatch.setattr(order, "_LONG", re.compile(r"[^\S\x1c-\x1f]{4,}"))
    assert [order.encode(t, enc) for t in texts] == want


def subsequence_kernel(s, t):
    """Order three, by definition."""
    value = 0.0
    for i in itertools.combinations(range(len(s)), 3):
        for j in itertools.combinations(range(len(t)), 3):
            if [s[x] for x in i] == [t[x] for x in j]:
                value += toxicity.LAMBDA ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
    return value


def test_kernel_is_the_definition():
    for s, t in (("idiot", "idxiot"), ("abcabc", "acb"), ("aaaa", "aaa"), ("word", "other")):
        assert np.isclose(toxicity.raw_kernel(toxicity.codes([s]), toxicity.codes([t]))[0], subsequence_kernel(s, t), rtol=1e-4)


@pytest.mark.parametrize(("at", "recall", "precision"), [("/root/testdata/check_s", 0.97, 0.97), ("/root/testdata/sf0.1", 0.75, 0.7)])
def test_held_out_accuracy(spark, at, recall, precision):
    """The small table has 305 labelled toxic texts to learn from, in four invented languages; the other has about 2,000."""
    if not Path(at).exists():
        pytest.skip(f"{at} is not here")
    rows = queries.op1_toxicity(spark, at).join(spark.read.parquet(f"{at}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out")
    r = rows.agg(F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 1)).alias("tp"), F.count_if((F.col("predicted") == 1) & (F.col("toxic") == 0)).alias("fp"), F.count_if(F.col("toxic") == 1).alias("p")).first()
    assert r["tp"] / r["p"] > recall and r["tp"] / max(1, r["tp"] + r["fp"]) > precision


def test_toxicity_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "text"), (2, "again")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score(docs, none).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.0}
    assert toxicity.score(docs.limit(0), none).count() == 0


def test_scratch_is_in_the_shared_folder(spark):
    assert Scratch(spark).base.startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_links_as_browsers_read_them(spark):
    """What the attributes of a page say: (html, the targets without the base)."""
    cases = [
        ('<link rel=canonical data-href="x" href="http://b.com/de/4">', ["http://b.com/de/4"]),
        ('<link title="a > b" rel="canonical" href="http://b.com/de/6">', ["http://b.com/de/6"]),
        ('<link rel="not-canonical" href="http://b.com/de/6">', []),
        ('<link rel="alternate\n Canonical" href="http://b.com/de/6">', ["http://b.com/de/6"]),
        ('<p title="<link rel=\'canonical\' href=\'http://b.com/de/1\'>">', []),
        ('<meta http-equiv=refresh content="0;URL=http&#58;//b.com/de/7">', ["http://b.com/de/7"]),
        ("<meta content='5; url=\"http&#x3A;//b.com&sol;de/8?a=1&amp;b=2&unknown;\"' HTTP-EQUIV='Refresh'>", ["http://b.com/de/8?a=1&b=2&unknown;"]),
        ('<meta name=refresh http-equiv=x content="0;url=http://b.com/9">', []),
        ('<link rel=canonical href=http://b.com/1 href=http://b.com/2>', ["http://b.com/1"]),
        ('<linker rel=canonical href=http://b.com/1>', []),
        ("<p class=it's><link rel=canonical href=http://b.com/3/>", ["http://b.com/3/"]),
        ('<link rel="canonical" href="http://b.com/&#128512;&#0;&#xD800;&#99999999;">', ["http://b.com/\U0001f600&#0;&#xD800;&#99999999;"]),
        ("<link rel=canonical href=http://b.com/3", []),
        ("<p " + "a=1 " * 100_000 + "><link rel=canonical " + "b='>' " * 50_000 + "href=/far>", ["/far"]),
        ("canonical" + "<" * 300_000 + "<a b='" * 50_000, []),
        ("canonical", []),
    ]
    rows = spark.createDataFrame([(i, h) for i, (h, _) in enumerate(cases)], "i int, html string")
    got = {r["i"]: r["t"][1:] for r in rows.select("i", urls.targets(F.col("html")).alias("t")).collect()}
    assert [got[i] for i in range(len(cases))] == [t for _, t in cases]


PROSE = "The river rose again in spring, and the bridge stood under water, as it had every year. People waited."
NAMES = [
    # name, tag, is its text kept
    ("social-science", "div", True), ("login-guide", "div", True), ("promo-code", "p", True), ("cookie-recipes", "section", True), ("newsletterHistory", "div", True),
    ("cookieBanner", "div", False), ("adbox", "div", False), ("social-links", "div", False), ("login-form", "div", False), ("ad-300x250", "div", False), ("cookie_notice", "div", False), ("newsletter-signup", "p", False), ("mainNav", "div", False), ("commentlist", "div", False),
    ("loaded", "div", True), ("adobe", "div", True), ("adverbs", "div", True), ("menus-of-paris", "div", True),
]


@pytest.mark.parametrize("attribute", ["class", "id"])
def test_names_that_are_topics_stay_and_parts_of_a_page_go(attribute):
    one, two, three = (f"{w} {PROSE}" for w in ("First:", "Second:", "Third:"))
    for name, tag, kept in NAMES:
        inner = two if tag == "p" else f"<p>{two}</p>"
        part = f'<{tag} {attribute}="{name}">{inner}</{tag}>'
        want = [one, two, three] if kept else [one, three]
        for page in ("<main><p>{}</p>{}<p>{}</p></main>", "<body><div><p>{}</p>{}<p>{}</p></div></body>", "<article><h1>Title</h1><p>{}</p>{}<p>{}</p></article>"):
            got = html.main_text(page.format(one, part, three)).split("\n\n")
            assert [t for t in got if t != "Title"] == want, (name, page)
        if kept:
            assert html.main_text(f'<html><body><{tag} {attribute}="{name}">{inner}</{tag}></body></html>') == two


def test_prose_beside_the_article_stays_and_labels_go():
    page = f"<body><div><div><p>{PROSE}</p><p>{PROSE}</p></div><div>{PROSE}</div><div>Read more here soon my friends</div></div></body>"
    assert html.main_text(page) == "\n\n".join([PROSE] * 3)
