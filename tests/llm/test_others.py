"""Pages, archive records, vectors and the pipeline against plain versions."""

import random
import re
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest

import corpus_pipeline
from pulsetrace.llm import byte_bpe, html_text, queries, topk, warc_revisits
from pulsetrace.llm.common import connected
from tests.llm.test_documents import plain_base, plain_classes, plain_print, reference_encoding

FOLDER = "/root/testdata/sf0.001"


# --- main text


CASES = {
    "<p>a<b>b</b> c<br>d &amp; e&nbsp;f<p>g<div class='sidebar'><p>x</div>tail": ["ab c d & e f", "g", "tail"],
    "<body><header><h1>S</h1></header><div class=main><p>One two<ul><li>x<li>y</ul></div><div id=comments><p>no</div></body>": ["One two", "x", "y"],
    "<p>out</p><article><p>t<aside>q</aside>u</p><form><p>f</form><p>v": ["out", "t", "u", "v"],
    "<main>a<script>if(a<b){'</div>'}</script>b<!-- <p>z --> c</main>x < y & z": ["ab c", "x < y & z"],
    "<nav><ul><li>m</nav><p>k</p>": ["k"],
    "<article><section class='reader-comments'><p>hi</p></section><p>ok</p></article>": ["ok"],
    "<p class='ad'>buy<p>text": ["text"],
    "<article title='a > b'>x<style>p{}</style></article><div hidden>h</div><div style='display: none'>n</div>": ["x"],
    "<article>&lt;p&gt; &#233;&eacute;  \n z</article>": ["<p> éé z"],
    "": [], "plain": ["plain"], "<": ["<"], "<p": ["<p"], "<article>": [],
}


@pytest.mark.parametrize("page", CASES)
def test_blocks(page):
    assert [t for t, role in html_text.blocks(page) if role != html_text.CHROME] == CASES[page]


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    menu = "<div>home products about contact imprint help jobs press</div>"
    pages = [(i, f"https://shop.example/{i}", f"{menu}<p>story {i} " + " ".join(f"w{i}x{j}" for j in range(20)) + "</p>") for i in range(30)]
    pages += [(100, "https://other.example/a", menu + "<p>alone</p>"), (101, "https://shop.example/x", menu),
              (102, "https://shop.example/x", menu), (103, None, None), (104, None, ""), (None, "https://shop.example/3", None)]
    pages += [(200 + i, f"https://copy.example/{i}", "<p>the very same words on each of these pages here</p>") for i in range(5)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len(out) == len(pages)
    assert all(out[i].startswith(f"story {i} w{i}x0 ") for i in range(30))
    assert out[100].endswith("alone") and "home" in out[100]  # no other page of its host has the menu
    assert out[101].startswith("home")  # nothing else on the page
    assert out[103] == out[104] == out[None] == ""
    assert all(out[200 + i] for i in range(5))


@pytest.mark.parametrize("page", [
    "<body class='has-sidebar'><nav>m</nav><p>one</p><article><p>two</p></article></body>",
    "<div class='layout header-fixed'><p>one</p><article><p>two</p><div class='share'>s</div></article></div>",
    "<article class='post share-on'><p>one</p><p>two</p></article><div class=ad>buy</div>",
    "<main id=related><div class='widget'><article><p>one</p><p>two</p></article></div></main>",
    "<body class=sidebar><div class='layout header-fixed'><p>one</p><p>two</p></div></body>"])
def test_a_word_on_a_wrapper_drops_no_main_text(spark, page):
    pages = spark.createDataFrame([(1, "https://a.example/1", page)], "page_id long, url string, html string")
    assert html_text.extract(pages).first().text == "one\ntwo"


def test_articles_keep_what_they_share(spark):
    notice = "all rights reserved by the publisher of this paper"
    own = lambda i, n=20: " ".join(f"w{i}x{j}" for j in range(n))
    pages = [(1000 * n + i, f"https://host{n}.example/{i}", f"<article><p>{own(i)}</p><p>{notice}</p></article>")
             for n in (2, 8, 60) for i in range(n)]
    pages += [(200 + i, f"https://copy.example/{i}", f"<article><p>{own(7)}</p><p>{notice} {i}</p></article>") for i in range(40)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[1000 * n + i] == f"{own(i)}\n{notice}" for n in (2, 8, 60) for i in range(n))
    assert all(out[200 + i] == f"{own(7)}\n{notice} {i}" for i in range(40))


def test_furniture_goes_from_articles(spark):
    line = "subscribe now to get our weekly letter by mail"
    own = lambda i, n=20: " ".join(f"w{i}x{j}" for j in range(n))
    foot = lambda t: f"<footer>{t} and much more</footer>"
    pages = [(i, f"https://news.example/{i}", f"<article><h1>title {i}</h1><p>{own(i)}</p><p>{line}</p></article>"
              + (foot(line) if i < 2 else "<footer>x</footer>")) for i in range(6)]
    # A title and a lead that menus tease stay, also where another article quotes them.
    title, lead = "ten words of a title that menus have as well", own(100, 12)
    tease = lambda t: f"<nav>{title}</nav><aside>{lead}</aside><article><h1>{t}</h1><p>{own(t)}</p>"
    pages += [(100, "https://tease.example/100", f"<article><h1>{title}</h1><p>{lead}</p><p>{own(101, 30)}</p></article>")]
    pages += [(100 + i, f"https://tease.example/{100 + i}", tease(200 + i) + (f"<p>{lead}</p>" if i == 1 else "") + "</article>") for i in range(1, 6)]
    # Views of one article do not make its lead furniture, nor does a line that other hosts have outside articles.
    pages += [(300 + i, f"https://views.example/{i}", f"<header>{lead}</header><article><h1>t</h1><p>{lead}</p><p>{own(7)}</p><p>seen {i}</p></article>") for i in range(4)]
    pages += [(400 + i, f"https://plain.example/{i}", f"<article><h1>t</h1><p>{own(400 + i)}</p><p>{line}</p></article>") for i in range(4)]
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert all(out[i] == f"title {i}\n{own(i)}" for i in range(6))
    assert out[100] == f"{title}\n{lead}\n{own(101, 30)}" and out[101] == f"201\n{own(201)}\n{lead}"
    assert all(out[300 + i] == f"t\n{lead}\n{own(7)}\nseen {i}" for i in range(4))
    assert all(out[400 + i] == f"t\n{own(400 + i)}\n{line}" for i in range(4))


def plain_template_lines(pages, run, covered, common):
    """(host, block) of article blocks that are furniture, by the sets of their token runs."""
    runs = lambda t: [tuple(t.split()[i: i + run]) for i in range(len(t.split()) - run + 1)]
    rest = [(i, u, "".join(f"<p>{t}</p>" for t, r in html_text.settled(html_text.parts_of(p)) if r != html_text.CONTENT)) for i, u, p in pages]
    furniture, articles = {}, {}
    for host, t in plain_boilerplate(rest, run, covered):
        furniture.setdefault(host, set()).update(runs(t))
    for _, url, page in pages:
        if own := [t for t, r in html_text.settled(html_text.parts_of(page)) if r == html_text.CONTENT]:
            articles.setdefault(html_text.host_of(url), {}).setdefault(max(own, key=lambda t: (len(t), t)), set()).update(own)
    out = set()
    for host, cores in articles.items():
        for t in set().union(*cores.values()):
            n, hit = sum(t in own for own in cores.values()), [0] * len(t.split())
            for i, r in enumerate(runs(t)):
                if r in furniture.get(host, ()):
                    hit[i: i + run] = [1] * run
            if sum(hit) > covered * len(hit) and n > 1 and n > common * len(cores):
                out.add((host, t))
    return out


def test_article_suffixes_equal_a_plain_version(spark):
    rng = random.Random(3)
    menu = [f"m{i}" for i in range(40)]
    piece = lambda: " ".join(menu[(at := rng.randint(0, 20)): at + rng.randint(4, 18)])
    lines = [[piece() + " tail" * rng.randint(0, 9) for _ in range(6)] for _ in range(3)]
    pages = []
    for n in range(60):
        own = [" ".join(f"w{rng.randint(0, 9)}" for _ in range(rng.randint(1, 60)))]
        blocks = own + [t for t in lines[n % 3] if rng.random() < 0.6]
        rng.shuffle(blocks)
        outside = "".join(f"<{tag}>{piece()}</{tag}>" for tag in rng.choices(["footer", "nav", "p", "aside"], k=2))
        pages.append((n, f"https://h{n % 3}.example/{n}", f"<article>{''.join(f'<p>{t}</p>' for t in blocks)}</article>{outside}"))
    pages += [(100 + i, *p[1:]) for i, p in enumerate(pages[:9])]  # exact copies
    gone, rest = plain_template_lines(pages, 6, 0.5, 0.5), plain_boilerplate(
        [(i, u, re.sub("<article>.*</article>", "", p)) for i, u, p in pages], 6, 0.5)
    lost = 0
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, url, page in pages:
        host, found = html_text.host_of(url), html_text.settled(html_text.parts_of(page))
        keep = [t for at, (t, r) in enumerate(found) if r == html_text.CONTENT and (at == 0 or (host, t) not in gone)
                or r == html_text.OPEN and (host, t) not in rest]
        lost += sum(r == html_text.CONTENT for _, r in found) - sum(t in keep for t, r in found if r == html_text.CONTENT)
        assert out[i] == "\n".join(keep), i
    assert lost > 20


def test_a_full_bitmap_changes_nothing(spark, monkeypatch):
    line = "subscribe now to get our weekly letter by mail"
    pages = [(i, "https://a.example/", f"<article><h1>t</h1><p>{' '.join(f'w{i}x{j}' for j in range(15))}</p><p>{line}</p></article>"
              f"<footer>{line}</footer><nav>{i}</nav>") for i in range(5)]
    pages = spark.createDataFrame(pages, "page_id long, url string, html string")
    before = sorted(html_text.extract(pages).collect())
    monkeypatch.setattr(html_text, "bitmap_of", lambda blocks, run: np.full(html_text.BITS // 8, 255, np.uint8))
    assert sorted(html_text.extract(pages).collect()) == before and line not in before[0].text


MAIN_TEXT = {
    "<body><form id='aspnetForm'><p>one</p><article><p>two</p></article></form>": "one\ntwo",
    "<nav><a>Home</a><article><p>two</p></article>": "two",
    "<article><header><h1>The title</h1><p>lead</p></header><p>a <label>b</label> c</p></article>": "The title\nlead\na b c",
    "<article><div class='share-price'>up</div><p class='hidden-gem'>gem</p><div class='share-buttons'>x</div></article>": "up\ngem",
    "<aside><article><p>teaser</p></article></aside><article><p>two</p></article>": "two",
    "<main><fieldset><p>in</p></fieldset><form><p>f</p></form><div hidden><p>h</p></div><footer>end</footer></main>": "in",
    "<div hidden><article>h</article></div><p>open</p>": "open",
}


def test_no_element_or_class_drops_main_text(spark):
    rows = [(i, f"https://h{i}.example/", page) for i, page in enumerate(MAIN_TEXT)]
    clash = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], "page_id long, url string, html string, text string, row int, host string")
    out = {r.page_id: r.text for r in html_text.extract(clash).collect()}
    assert [out[i] for i in range(len(rows))] == list(MAIN_TEXT.values())


def plain_boilerplate(pages, run, covered):
    """(url, block) of open blocks that repeat on their host, by the sets of their token runs."""
    hosts = {}
    for _, url, page in pages:
        found = tuple(t for t, _ in html_text.settled(html_text.parts_of(page)))
        hosts.setdefault(html_text.host_of(url), set()).add(found)
    out = set()
    for host, texts in hosts.items():
        runs = lambda t: [tuple(t.split()[i: i + run]) for i in range(len(t.split()) - run + 1)]
        for found in texts:
            others = [t for other in texts if other != found for t in other]
            seen = {r for t in others for r in runs(t)}
            for t in found:
                hit = [0] * len(t.split())
                for i, r in enumerate(runs(t)):
                    if r in seen:
                        hit[i: i + run] = [1] * run
                if t in others or sum(hit) > covered * len(hit):
                    out.add((host, t))
    return out


def test_host_suffixes_equal_a_plain_version(spark):
    rng = random.Random(12)
    menu = [f"m{i}" for i in range(40)]
    pages = []
    for n in range(120):
        blocks = []
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.5:
                at = rng.randint(0, 30)
                words = menu[at: at + rng.randint(1, 14)]
            else:
                words = [rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(rng.randint(1, 25))]
            if rng.random() < 0.3:
                words = words + [f"u{n}"] * rng.randint(1, 8)
            blocks.append("<p>" + " ".join(words) + "</p>")
        pages.append((n, f"https://h{n % 3}.example/{n}", "".join(blocks)))
    pages += [(200 + i, url, page) for i, (_, url, page) in enumerate(pages[:20])]  # exact copies
    gone = plain_boilerplate(pages, 6, 0.5)
    assert 20 < len(gone)
    out = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i, url, page in pages:
        blocks = [t for t, _ in html_text.parts_of(page)]
        kept = [t for t in blocks if (html_text.host_of(url), t) not in gone]
        assert out[i] == "\n".join(kept or blocks), i


def test_a_very_long_page(spark):
    page = "<article>" + "<p>one two three</p>" * 50_000 + "</article>"
    assert html_text.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first().text.count("\n") == 49_999


def test_article_text_of_the_table(spark):
    import html

    def article(page):
        body = re.search("<article>(.*?)</article>", page, re.S)[1]
        parts = re.split("</?(?:p|h1)>", re.sub("</?b>", "", body))
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts]
        return "\n".join(filter(None, lines))

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in queries.op8_html_text(spark, FOLDER).collect():
        assert r.text == article(pages[r.page_id]) and r.n_chars == len(r.text)


def test_no_pages(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string, text string, blocks int")
    assert html_text.extract(empty).count() == 0


# --- revisits


RECORD = "record_id string, uri string, date timestamp, kind string, status int, headers map<string,string>, body string, url int, hit int"


def plain_resolve(records):
    out = {}
    place = lambda r: (r[2], r[0])
    for r in records:
        if r[3] != "revisit":
            continue
        mine = {k.lower(): v for k, v in sorted((r[5] or {}).items())}
        key = plain_url(r[1])
        earlier = [s for s in records if s[3] == "response" and s[4] in (200, None) and s[2] and r[2] and key is not None
                   and plain_url(s[1]) == key and place(s) < place(r)]
        if not earlier:
            out[r[0]] = ("no_response", None, mine)
            continue
        full = max(earlier, key=place)
        old = {k.lower(): v for k, v in sorted((full[5] or {}).items())}
        tags = [h["etag"].removeprefix("W/") if "etag" in h else None for h in (mine, old)]
        dates = [h.get("last-modified") for h in (mine, old)]
        same = next((a == b for a, b in (tags, dates) if a is not None and b is not None), None)
        if same is False:
            out[r[0]] = ("mismatch", None, mine)
        else:
            merged = old | {k: v for k, v in mine.items() if k not in warc_revisits.KEPT_AS_STORED}
            out[r[0]] = ("unverified" if same is None else "match", full[0], merged)
    return out


def plain_url(uri):
    if uri is None:
        return None
    bare = re.sub("^[A-Za-z][A-Za-z0-9+.-]*://", "", uri.strip().split("#")[0])
    address, _, query = bare.partition("?")
    host, slash, path = address.partition("/")
    params = sorted(p for p in query.split("&") if p and not re.match("(utm_[a-z]+|fbclid|gclid)(=|$)", p))
    return re.sub(r"^www\.|:(80|443)$", "", host.lower()) + (slash + path).rstrip("/") + ("?" + "&".join(params) if params else "")


def test_revisits_equal_a_plain_version(spark):
    draw, start = random.Random(9), datetime(2024, 1, 1)
    urls = ["http://A.example/x", "https://www.a.example:443/x/", "a.example/x#top", "http://a.example/x?b=2&a=1", "https://a.example/x?a=1&b=2&utm_source=q", "http://b.example", None]
    records = []
    for i in range(1500):
        kind = draw.choice(["response", "revisit", "revisit", "request"])
        headers = {k: v for k, v in (("ETag", draw.choice(['"1"', 'W/"1"', '"2"'])), ("last-modified", draw.choice("MN")), ("Content-Length", str(i)),
                                     ("X-Cache", str(i)), ("Connection", "close")) if draw.random() < 0.6}
        records.append((f"r{i:05d}", draw.choice(urls[:5] * 8 + urls), start + timedelta(minutes=draw.randint(0, 400)) if draw.random() < 0.98 else None,
                        kind, draw.choice([200, 200, None, 404]) if kind == "response" else 304, headers if draw.random() < 0.95 else None, f"body {i}", 1, 2))
    df = spark.createDataFrame(records, RECORD)
    resolved = warc_revisits.resolve(df)
    got = {r.record_id: (r.verdict, r.source_id, r.headers) for r in resolved.collect()}
    assert got == plain_resolve(records)
    assert len({v for v, _, _ in got.values()}) == 4
    bodies = {r[0]: r[6] for r in records}
    for r in warc_revisits.with_payload(df, resolved).collect():
        assert r.body == bodies[r.source_id]
    assert warc_revisits.resolve(df.limit(0)).count() == 0


# --- top-k


def test_search_equals_a_plain_version(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=8).round(1).tolist(), "x") for i in range(600)]
    rows += [(1000 + i, [0.5] * 8, "x") for i in range(150)]  # ties
    rows += [(2000, None, "x"), (2020, [0.1, None] + [0.0] * 6, "x"), (2040, [float("nan")] * 8, "x"), (2060, [float("inf")] * 8, "x"),
             (2080, [1.0, 2.0], "x"), (2081, [2.0, 1.0], "x"), (None, [9.0] * 8, "x"), (2100, [], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    out = {}
    for r in topk.nearest(df, settings=topk.Search(k=7, tile_queries=10, tile_vectors=50, block=4, fan_in=3)).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    usable = {i: np.floor(64 * np.array(v, np.float32).astype(float)).astype(int) for i, v, _ in rows
              if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = {}
    for q, a in usable.items():
        if q % 20 == 0:
            hits = sorted((-int(a @ b), i) for i, b in usable.items() if i != q and len(a) == len(b))[:7]
            if hits:
                want[q] = [(n, i, -s) for n, (s, i) in enumerate(hits, 1)]
    assert {q: sorted(x) for q, x in out.items()} == want
    assert topk.nearest(df.limit(0)).count() == 0


def test_products_stay_exact():
    a, b = np.array([[2**40, -3]]), np.array([[2**20, 5], [2**30, 1]])
    assert topk.product(a, b).tolist() == [[2**60 - 15, 2**63 - 1]]


# --- connected groups


def test_connected_groups(spark):
    draw = random.Random(12)
    edges = [(i, i + 1) for i in range(1, 60)] + [(draw.randint(100, 400), draw.randint(100, 400)) for _ in range(200)] + [(1000, 1000 + i) for i in range(300)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    found = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: find(x) for e in edges if e[0] != e[1] for x in e}


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "simhash_dedup", "secret_scan", "source_mix", "byte_bpe"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = kept[name] = spark.read.parquet(str(tmp_path / name))
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    judged = {r.doc_id for r in queries.op2_quality_rules(spark, FOLDER).collect() if r.kept}
    rows = {name: [(r.doc_id, r.text) for r in df.collect()] for name, df in kept.items() if name != names[-1]}
    assert Counter(i for i, _ in rows["quality_rules"]) == Counter(judged)
    prints = [(i, plain_print(t)) for i, t in rows["quality_rules"]]
    assert sorted(i for i, _ in rows["simhash_dedup"]) == sorted(set(plain_classes(prints)))
    assert sorted(i for i, _ in rows["secret_scan"]) == sorted(i for i, _ in rows["simhash_dedup"])
    assert not any(plain_base(t or "") for _, t in rows["secret_scan"])
    clean = {i: t for i, t in rows["simhash_dedup"] if not plain_base(t or "")}
    assert sum(dict(rows["secret_scan"])[i] == t for i, t in clean.items()) > 0.98 * len(clean)
    assert {i for i, _ in rows["source_mix"]} <= {i for i, _ in rows["secret_scan"]}
    known, taken = reference_encoding(), Counter(rows["source_mix"])
    last = kept["byte_bpe"].collect()
    assert len(last) == sum(taken.values())
    ids = {i: t for i, t in rows["source_mix"]}
    assert all(np.frombuffer(r.tokens, "<u4").tolist() == known.encode_ordinary(ids[r.doc_id] or "") for r in last)
    assert byte_bpe.decode(kept["byte_bpe"]).count() == len(last)
