import math
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from leaklens.llm import chat, embedding_dedup, html_text, url_filter


def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>t</title>{head}</head><body>{body}</body></html>"


ARTICLE = "<article><h1>A &amp; B</h1><p>One<b>two</b>  three.<br>\n four<p>Fi&eacute;ve</p><script>x</script></article>"


@pytest.mark.parametrize("body", [
    "<nav><a href=x>Home</a></nav>" + ARTICLE + "<footer>&copy; us</footer>",
    '<div class="cookie-notice">We use cookies</div>' + ARTICLE + '<aside>Also read</aside><div id="comments"><p>First!</p></div>',
    '<div class="sidebar"><p>Side</p></div><form><p>Mail <input></p></form>' + ARTICLE + '<div class="ad">Buy</div>',
    "<header><p>Site</p></header><main>" + ARTICLE + '<section class="comments"><p>nice</p></section></main>',
])
def test_boilerplate_goes_and_the_article_stays(body):
    empty = {"known": set(), "links": set(), "template": set()}
    assert html_text.main_text(page(body), empty) == "A & B\n\nOnetwo three. four\n\nFiéve"


def test_wrapper_without_semantic_tags(spark):
    rng = random.Random(1)
    rows = []
    for i in range(20):
        texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(20)) for _ in range(2 + i % 3)]
        body = ('<div class="top"><a href=/>Home</a> <a href=/b>About</a></div><div class="c"><h1>Title %d</h1>%s</div>'
                '<div class="low">Powered by nothing</div>') % (i, "".join(f"<p>{t}</p>" for t in texts))
        rows.append((i, f"http://one.example.org/{i}", page(body), "x", "\n\n".join([f"Title {i}", *texts])))
    rows += [(100, None, None, "x", ""), (101, "nohost", "", "x", ""), (102, "http://h/", "<p>unclosed <b>text", "x", "unclosed text")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, want string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    for i, url, _, _, want in rows:
        assert got[i].text == want and got[i].n_chars == len(want) and got[i].url == url


def test_wrapper_covers_copies_and_second_layouts(spark):
    rng = random.Random(2)
    rows = []
    for i in range(60):
        text = " ".join(f"w{rng.randrange(999)}" for _ in range(20))
        body = (f'<div class="c"><p>{text}</p></div><div class="x"><p>Our tagline</p></div>' if i < 45 else
                f'<table class="k"><tr><td>{text}</td></tr></table><div class="y"><p>Ring the bell</p></div>')
        rows += [(100 * i + k, f"http://two.example.org/{i}", page(body), text) for k in range(40 if i in (0, 50) else 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: want for i, _, _, want in rows}


def test_wrapper_decides_on_framed_pages(spark):
    rng = random.Random(3)
    rows = []
    for i in range(20):
        texts = [" ".join(f"w{rng.randrange(999)}" for _ in range(40)) for _ in range(3)]
        body = ('<div class="q1">Welcome back</div><main><div class="q2"><p>Our hosts say hello</p></div><article><p>%s</p><p>%s</p></article>'
                '<div class="q3"><p><a href=/%d>More of w%d</a></p></div></main><div class="q4"><p>%s</p></div><div class="q5">%d visits</div>'
                ) % (*texts[:2], i, i, texts[2], i)
        rows.append((i, f"http://three.example.org/{i}", page(body), "\n\n".join(texts)))
        copy = "<main><p>%s</p><p>Copy %d</p></main>" % (" ".join(["same words"] * 20), i)         # near copies keep their text
        rows.append((100 + i, f"http://four.example.org/{i}", page(copy), " ".join(["same words"] * 20) + f"\n\nCopy {i}"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    assert got == {i: want for i, _, _, want in rows}


def test_wrapper_alignment_finds_slots_options_and_repeats():
    pages = [[("h", "A", 0), ("p", "x", 0), ("p", "y", 0), ("f", "same", 0)], [("h", "B", 0), ("ad", "z", 0), ("p", "q", 0), ("f", "same", 0)]]
    nodes = {n["path"]: n for n in html_text.infer_wrapper(pages)}
    assert nodes["h"]["text"] is None and nodes["f"]["text"] == "same"
    assert nodes["p"]["repeated"] and nodes["ad"]["optional"] and not nodes["h"]["optional"]


def as_rows(df, columns):
    return sorted(tuple(str(None if pd.isna(v) else v) for v in row) for row in df[columns].astype(object).values.tolist())


def test_urls_equal_sql(spark):
    urls = [None, "", "no scheme", "http://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "http://x.www.example.com/en/", "http://s.net/es/1",
            "http://net/fr/", "http://example.com", "http://casino.org/", "http://cheap.org/free", "http://cheap.org/cheap", "http://freedom.org/sale",
            "http://xn--casino2.org/", "ftp://a://b/c", "http://h.org?casino", "http://h.org#porn", "http://ü.org/win-bonus", "http://x.com/casino"]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(3, urls[3], "h"), (None, "http://a.com/", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = url_filter.judge_urls(pages).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(url_filter.ORACLE).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and as_rows(got, columns) == as_rows(want, columns)
    verdict = dict(zip(got.page_id, got.verdict))
    assert verdict[3] == "block" and verdict[4] == "allow" and verdict[9] == "block" and verdict[10] == "block"
    assert verdict[11] == "allow" and verdict[12] == "allow" and verdict[18] == "allow"
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_chats_equal_sql(spark):
    rng = random.Random(3)
    rows = []
    for c in range(60):
        base = rng.randrange(8)
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"turn {base} {t}", "x"))
    rows += [(100, 0, None, "a", "x"), (101, 0, "", "a", "x"), (102, 0, "user", None, "x"), (103, None, "user", "a", "x"), (None, 0, "user", "b", "x"),
             (104, 0, "user", "q", "x"), (104, 0, "user", "q", "x"), (104, 0, "user", "r", "x"), (105, 0, "user", "q", "x")]
    rows += [(200, t, "user", f"long {t}", "x") for t in range(1300)] + [(201, t, "user", f"long {t}", "x") for t in range(1200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")
    got = chat.format_chats(turns).toPandas()
    con = duckdb.connect()
    con.register("conversations", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text", "part"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.execute(chat.ORACLE).df()
    columns = sorted(want.columns)
    assert as_rows(got, columns) == as_rows(want, columns)
    assert 201 not in set(got.conv_id) and 105 not in set(got.conv_id) and (got.conv_id == 200).sum() == 3
    assert chat.format_chats(turns.limit(0)).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2):
        centre = rng.standard_normal((12, 16))
        for _ in range(300):
            v = centre[rng.integers(12)] + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.6])
            rows.append((n, v.tolist(), label))
            n += 1
    rows += [(5000 + i, rows[0][1], 0) for i in range(5)] + [(5100, [2 * x for x in rows[0][1]], 0), (5101, rows[0][1], None)]
    rows += [(5200, [x * 1e200 for x in rows[0][1]], 0), (5201, [x * 1e-200 for x in rows[0][1]], 0)]
    rows += [(6000, None, 0), (6001, [], 0), (6002, [0.0] * 16, 0), (6003, [math.nan] + [1.0] * 15, 0), (6004, [None] + [1.0] * 15, 0),
             (6005, [math.inf] + [1.0] * 15, 0), (6006, rows[0][1][:8], 0), (None, rows[0][1], 0)]
    table = spark.createDataFrame([(i, v, lab, 1) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table).collect()}
    assert len(got) == len(rows)
    usable = [(i, np.array(v) / max(map(abs, v)), lab) for i, v, lab in rows if i is not None and i < 6000 and lab is not None]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}
    for k, (i, v, lab) in enumerate(usable):
        for j, w, other in usable[:k]:
            if lab == other and v @ w / (np.linalg.norm(v) * np.linalg.norm(w)) >= 0.98:
                links[i], links[j] = links[i] + 1, links[j] + 1
                a, b = sorted((root[i], root[j]))
                root = {x: a if r == b else r for x, r in root.items()}
    assert {i: r.n_links for i, r in got.items()} == links
    assert {i: r.component_id for i, r in got.items()} == root
    assert embedding_dedup.near_duplicates(table.limit(0)).count() == 0


def test_names_of_the_page_and_its_frame_do_not_empty_it():
    unknown = {"known": (), "links": (), "template": ()}
    pages = {
        '<body class="no-sidebar"><p>Text.</p></body>': "Text.",
        '<div class="content-with-sidebar"><article><p>Text.</p></article></div>': "Text.",
        "<form><article><p>Text.</p></article></form>": "Text.",
        '<article class="post share"><p>Text.</p></article>': "Text.",
        '<article><header class="entry-header"><h1>Title</h1></header><p>Sum <math><mi>x</mi></math>.</p></article>': "Title\n\nSum x.",
        '<article><p>Text.</p></article><article class="comment"><p>reader</p></article>': "Text.",
        '<header class="site-header"><p>logo</p></header><article><p>Text.</p><form><p>mail</p></form></article>': "Text.",
        '<div class="sidebar"><p>side</p></div><main><p>Text.</p></main>': "Text.",
    }
    assert {p: html_text.main_text(p, unknown) for p in pages} == pages
