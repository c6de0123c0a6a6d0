"""Chat formatting, HTML extraction and nearest neighbours."""

import hashlib
import os
import re

import numpy as np
import pytest

from stratalog.llm import ann, chat, html

SIZE = "/root/testdata/sf0.01"
CONV = "conv_id long, turn long, role string, text string, seg string, loss int"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "s", 1) for r in rows], CONV)


def test_chat_round_trip(spark):
    nasty = ["", None, "\\", "\\\\<turn>", "</turn>\n", "<turn>user\n", chat.EXTRA_TEXT, "a\nb", "\\" * 5 + "</turn>", "é" * 1000]
    rows = [(c, i, role, nasty[(c + i) % len(nasty)]) for c in range(10) for i, role in enumerate(["system", "user", "assistant", "user", "assistant"][c % 2 :])]
    rows += [(50, 0, None, "x"), (50, 1, "we\nird\\", "y"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (60, 1, "user", "b"), (60, 1, "user", "a"), (60, 1, "user", "a")]
    out = {r.conv_id: r for r in chat.read_back(chat.segments(conversations(spark, rows))).collect()}
    want = {}
    for c, i, role, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", t or ""))
    assert set(out) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert out[c].n_turns == len(turns) and out[c].loss_chars == len(loss)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert out[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert out[0].valid and out[1].valid and not out[50].valid and not out[60].valid and out[None].valid
    assert chat.read_back(chat.segments(conversations(spark, rows).limit(0))).count() == 0


def test_segments_text_and_loss(spark):
    got = [(r.seg, r.text, r.loss) for r in chat.segments(conversations(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "<turn>")])).collect()]
    assert "".join(t for _, t, _ in got) == "<turn>user\nhi</turn>\n<turn>assistant\n\\<turn></turn>\n"
    assert [t for _, t, loss in got if loss] == ["\\<turn>"]


PAGES = [
    ("<article><h1>T &amp; t</h1><p>First  long\nparagraph of <b>the</b> story, with text.<p>Second one.<br>More</article><footer>&copy; x</footer>", "T & t\n\nFirst long paragraph of the story, with text.\n\nSecond one. More"),
    ("<nav><a>Home</a></nav><div class='ad'>Buy!</div><main><header><h1>Head</h1></header><p>Body text that is long enough to be the main text.</p><aside>Side</aside><div id='comments'><p>I am a reader and this is my long comment on it.</p></div><form>Mail<input></form></main>", "Head\n\nBody text that is long enough to be the main text."),
    ("<div class='header'>Site</div><div class='content'><p>A body without any article element, long enough to be found.</p><ul><li>one</li><li>two</li></ul></div><div class='sidebar'>links</div>", "A body without any article element, long enough to be found.\n\none\n\ntwo"),
    ("<div class='page with-sidebar'><div class='sidebar'>links</div><article><p>Inside a frame that names its sidebar.</p></article><div id='comments'><article><p>A reader's comment, which is as long as the article.</p></article></div></div>", "Inside a frame that names its sidebar."),
    ("<script>var a='<p>no</p>'</script><style>p{}</style>", ""),
    ("", ""),
    (None, ""),
    ("just text &lt;here&gt;", "just text <here>"),
    ("<article><p>cut off in an enti &am", "cut off in an enti &am"),
]


def test_html(spark):
    df = spark.createDataFrame([(i, f"u{i}", h, "t", 3) for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string, n_chars int")
    out = html.extract(df).orderBy("page_id").collect()
    assert [r.text for r in out] == [w for _, w in PAGES]
    assert [r.n_chars for r in out] == [len(w) for _, w in PAGES]
    assert html.extract(df.limit(0)).count() == 0


def test_html_of_long_articles(spark):
    body = [f"Paragraph {i} " + "word " * (i % 40) for i in range(300)]
    page = "<body><nav>" + "<a>x</a>" * 50 + "</nav><article>" + "".join(f"<p>{p}</p>" for p in body) + "</article></body>"
    assert html.main_text(page) == "\n\n".join(re.sub(r"\s+", " ", p).strip() for p in body)


def test_html_without_article_element_keeps_all_but_boilerplate():
    said = lambda i, n: f"Part {i} " + "word " * n + "end."
    nav, links = "<div><a href='/'>Home</a> <a href='/all'>All</a></div>", "<ul><li><a href='/x'>Another page</a></li><li><a href='/y'>And one more</a></li></ul>"
    section = "".join(f"<p>{said(i, 50)}</p>" for i in range(6))
    page = f"<body>{nav}<div id='content'><h1><a href='/t'>Title</a></h1><p>{said('intro', 100)}</p><section>{section}</section></div>{links}</body>"
    assert html.main_text(page) == "\n\n".join(["Title", said("intro", 100), *(said(i, 50) for i in range(6))])
    items = [said(i, 80) for i in range(20)]
    rows = "".join(f"<li>{x}</li>" for x in items)
    post = f"<body>{nav}<div><h2>Post</h2><p>A short intro.</p><ul>{rows}</ul><p>Sincerely, me</p></div>{links}</body>"
    assert html.main_text(post) == "\n\n".join(["Post", "A short intro.", *items, "Sincerely, me"])
    apart = f"<body>{nav}<div><h1>Head</h1></div><div><p>Lead, {said(0, 4)}</p></div><div><section><p>{said(1, 900)}</p></section></div>{links}</body>"
    assert html.main_text(apart) == "\n\n".join(["Head", "Lead, " + said(0, 4), said(1, 900)])


@pytest.mark.parametrize("around", ["article", "main", "div"])
def test_html_ids_and_classes_of_article_parts(around):
    ids = ["related-work", "recommendations", "social-impact", "side-effects", "legal-background", "cookies", "share"]
    heads = [x for i in ids for x in (f"On {i}", f"What is to be said of {i}, at some length.")]
    body = "".join(f"<h2 id='{i}'>{heads[2 * n]}</h2><p id='{i}-text'>{heads[2 * n + 1]}</p>" for n, i in enumerate(ids))
    body += "<section id='discussion'><h2>Discussion</h2><p>Which is a section of the article.</p></section>"
    want = [*heads, "Discussion", "Which is a section of the article."]
    if around != "div":
        body += "<div class='notice'><p>A remark of the author.</p></div>"
        want.append("A remark of the author.")
    body += "<div class='box ads'><p>Buy a thing, it is good.</p></div><div class='Share'><p>Tell all your friends of it.</p></div><section id='comments'><p>I liked it, says a reader.</p></section>"
    assert html.main_text(f"<body><{around}>{body}</{around}></body>") == "\n\n".join(want)


SAID = "A sentence of the article that is as long as sentences are, and then some more of it."


def test_html_keeps_what_only_sounds_like_boilerplate():
    parts = ["<section id='discussion'><p>{}</p></section>", "<div class='legal'><p>{}</p></div>", "<p class='share-price'>{}</p>", "<p hidden>{}</p>", "<p>{} <math><mi>x</mi></math></p>"]
    for around in ("article", "div"):
        said = [f"{SAID} {i}" for i in range(len(parts))]
        body = "".join(p.format(x) for p, x in zip(parts, said))
        want = "\n\n".join([SAID, *said[:-1], f"{said[-1]} x", SAID])
        assert html.main_text(f"<body><nav><a>Home</a></nav><{around}><p>{SAID}</p>{body}<p>{SAID}</p></{around}></body>") == want
    assert html.main_text(f"<article><p>{SAID} <span class='ad'>BUY NOW</span>Go on.</p></article>") == f"{SAID} Go on."
    assert html.main_text(f"<main><article><p>{SAID}</p></article><article><p>{SAID} Two.</p></article></main>") == f"{SAID}\n\n{SAID} Two."


def test_html_regions_come_from_the_clustering(monkeypatch):
    teasers = "".join(f"<article><a href='/{i}'>More {i}</a><p>Soon</p></article>" for i in range(6))
    story = "".join(f"<p>{SAID} {SAID} {i}</p>" for i in range(8))
    page = f"<body><ul><li><a>Home</a></li><li><a>News</a></li></ul><article><h1>Title</h1>{story}<p>Short.</p></article>{teasers}</body>"
    want = "\n\n".join(["Title", *(f"{SAID} {SAID} {i}" for i in range(8)), "Short."])
    assert html.main_text(page) == want
    monkeypatch.setattr(html, "_threshold", lambda x: -1.0)  # everything is content
    assert "Soon" in html.main_text(page)
    monkeypatch.undo()
    weak = f"<body><div><p>{SAID}</p><p>{SAID}</p></div><div class='related'><p>Read this</p></div></body>"
    assert html.main_text(weak) == f"{SAID}\n\n{SAID}"
    monkeypatch.setattr(html, "WEAK_SHARE", 99)
    assert html.main_text(weak) != f"{SAID}\n\n{SAID}"


def test_html_against_pages_of_known_articles():
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(rng.choice(["river", "stone", "of", "evening", "the", "walk"], n)) + "."
    for _ in range(60):
        around = rng.choice(["article", "main", "div"])
        lines = [text(rng.integers(12, 60)) for _ in range(rng.integers(3, 12))]
        junk = [f"<nav>{''.join(f'<a>{text(1)}</a>' for _ in range(5))}</nav>", f"<div class='cookie-notice'>{text(8)}</div>", f"<header>{text(3)}</header>"]
        after = [f"<aside>{text(6)}</aside>", f"<div id='comments'><p>{text(30)}</p></div>", f"<form>{text(4)}<input></form>", f"<footer>{text(5)}</footer>"]
        body = "".join(f"<p>{x}</p>" if rng.random() < 0.8 else f"<ul><li>{x}</li></ul>" for x in lines)
        page = f"<html><body>{''.join(rng.permutation(junk))}<{around}><h1>{text(4)}</h1>{body}</{around}>{''.join(rng.permutation(after))}</body></html>"
        title = re.search("<h1>(.*?)</h1>", page)[1]
        assert html.main_text(page) == "\n\n".join([title, *lines])


def test_html_is_linear_in_nesting():
    import time

    def seconds(n):
        at = time.process_time()
        assert html.main_text("<div>x" * n + "</b>" * n + "<span>" * n + "<p>y" * n).startswith("x")
        return time.process_time() - at

    seconds(200)
    assert seconds(16_000) < 12 * max(seconds(4000), 0.02)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, rank string, score int")


@pytest.mark.parametrize("block", [4096, 300])
def test_nearest(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "SMALL_BLOCK", block)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    odd = [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (5060, [float("inf")] * 16), (5080, [1.0, None] * 8), (5100, [1.0])]
    df = vectors(spark, rows + odd)
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    exact = np.array([v for _, v in rows], np.float64)
    assert set(got) == set(range(0, 3000, 20))
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        score = exact @ exact[q]
        assert all(abs(score[v] - s) < 1e-9 and v != q for _, v, s in found)
        assert [(-s, v) for _, v, s in found] == sorted((-s, v) for _, v, s in found)
        score[q] = -np.inf
        hits += len({v for _, v, _ in found} & set(np.argsort(-score)[:20].tolist()))
    assert hits / (20 * len(got)) >= 0.9


def test_sample_of_vectors_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 200)
    base = spark.range(5000).selectExpr("id", "array(double(id), 1D) as v")
    own = {int(v[0]) for v in ann._sample(base, 5000).to_pylist()}
    assert 150 < len(own) <= 200 and max(own) > 2500
    assert len(ann._sample(spark.range(3).selectExpr("id", "array(double(id)) as v"), 3)) == 3
    copies = spark.range(5000).selectExpr("1L as id", "array(1D, 2D) as v")
    assert len(ann._sample(copies, 5000)) == 200


def test_nearest_of_few(spark):
    df = vectors(spark, [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 0.0])])
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4), (0, 2, 20), (0, 3, 3), (20, 1, 0), (20, 2, 4), (20, 3, 3)]
    assert ann.search(df.limit(0), df).count() == 0 and ann.search(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 3])
def test_nearest_of_repeated_rows_and_lengths(spark, parts):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [1e9, 1.0]), (3, [1e9, 2.0]), (20, [0.5]), (7, [3.0]), (40, [1.0] * 3)]
    want = sorted([(20, 1, 2, 1e9), (20, 2, 3, 1e9), (20, 3, 1, 2.0), (20, 4, 20, 1.0)] * 2 + [(20, 1, 7, 1.5)])
    for order in (rows, rows[::-1]):
        df = vectors(spark, order).repartition(parts)
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(df, df.where("vec_id % 20 = 0")).collect()) == want
        df = df.where("size(embedding) = 2")
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in ann.search(df, df.where("vec_id % 20 = 0"), k=2).collect()) == [(20, 1, 2)] * 2 + [(20, 2, 3)] * 2


@pytest.mark.skipif(not os.path.isdir(SIZE), reason="no test data")
def test_recall_of_the_query(spark):
    x = spark.read.parquet(f"{SIZE}/embeddings.parquet").select("vec_id", "embedding").where("embedding is not null").collect()
    ids, v = np.array([r.vec_id for r in x]), np.array([r.embedding for r in x], np.float64)
    got = {}
    for r in ann.op9_ann(spark, SIZE).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for i, q in zip(ids, v):
        if i % 20 == 0:
            score = v @ q
            score[ids == i] = -np.inf
            near = set(ids[np.lexsort((ids, -score))[:20]].tolist())
            hits, total = hits + len(near & got[int(i)]), total + len(near)
    assert total and hits / total >= 0.9


@pytest.mark.parametrize("radius", [3, 9, 20])
def test_probing_reaches_every_code_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    x = rng.normal(size=(2000, 24))
    coder = ann.Coder(x, float(np.linalg.norm(x, axis=1).max()), 5)
    coder.radius = radius
    index = ann.Index(np.arange(2000), x, coder)
    for code in coder.encode(x[:20], True):
        far = np.bitwise_count(index.codes ^ code).sum(1)
        assert set(index.within(code).tolist()) == set(np.flatnonzero(far <= radius).tolist())
