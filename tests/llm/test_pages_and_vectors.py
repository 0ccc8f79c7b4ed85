"""HTML extraction and nearest neighbours against brute force, and their defined results."""

import html
import re

import numpy as np
import pytest

from revlens.llm import ann, html_extract
from tests.conftest import SMALL

MIDDLE = "/root/testdata/sf0.01"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def article(page):
    """Blocks of the article element of the given test pages."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page or "", re.S)
    if not inner:
        return ""
    blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", inner[1]))
    return "\n".join(x for x in blocks if x)


def test_whole_table_matches_articles(spark):
    df = spark.read.parquet(f"{MIDDLE}/pages.parquet")
    got = {r["page_id"]: r for r in html_extract.extract_pages(df).collect()}
    for r in df.collect():
        assert got[r["page_id"]]["text"] == article(r["html"]) and got[r["page_id"]]["n_chars"] == len(article(r["html"])) and got[r["page_id"]]["url"] == r["url"]


BODY = "Long enough paragraph text that speaks for the container, number {0} of the page. " * 3


def templated(i):
    return (f"<html><body><div id='top-nav' class='Menu'><a href='/'>Home</a></div><div class='wrap{i} with-sidebar'><div class='post-{i}'><h1>Title {i}</h1>"
            f"<p>{BODY.format(i)}<div class='ad-box'>Buy now</div><p>Second&nbsp;&amp; last<br>line</div><div class='side'><p>{BODY.format('x') * 4}</p></div></div>"
            f"<section class='comments'><p>{BODY.format('c') * 5}</p></section><footer>Foot</footer></body></html>")


def test_templates_boilerplate_and_votes(spark):
    rows = [(i, f"http://H.example/{i}", templated(i)) for i in range(30)]
    # a page whose own best container would be another one follows its host
    odd = "<html><body><div class='with-sidebar wrap7'><div class='post-7'><p>Short post.</p></div></div><div class='other'><p>" + BODY * 9 + "</p></div></body></html>"
    out = {r["page_id"]: r["text"] for r in html_extract.extract_pages(pages(spark, rows + [(100, "http://h.example:80/z?q", odd)])).collect()}
    for i in range(30):
        assert out[i] == "\n".join([f"Title {i}", " ".join(BODY.format(i).split()), "Second & last", "line"])
    assert out[100] == "Short post."


AWKWARD_PAGES = [
    (1, None, None), (2, "", ""), (None, "not a url", "plain text &lt;only&gt;"), (4, "http://a/b", "<p>unclosed <b>bold <p>next <i>it"), (4, "http://a/b", "<p>unclosed <b>bold <p>next <i>it"),
    (5, "http://a/c", "<script>var x='<p>no</p>'</script><!-- <p>no</p> --><p>yes</p><style>p{}</style><p>cut <a hre"), (6, "http://c/", "<div>" * 50_000 + "deep" + "</div>" * 50_000),
    (7, "http://c/", "<article><p>" + "long " * 100_000 + "</p></article>"), (8, "http://c/", "</p></div><<>&am <b"), (9, "http://d/", "<table><tr><td>a<td>b<tr><td>c</table><ul><li>x<li>y</ul>"),
]


@pytest.mark.parametrize("page,want", [
    ("<article><h1>Title</h1><div class='content'><p>One is long enough to count.</p><p>Two.</p></div></article><div class='menu'>x</div>", "Title\nOne is long enough to count.\nTwo."),
    ("<header><h1>Site</h1></header><main><section><p>First part of it all.</p></section><section><p>Second part of it.</p></section></main>", "First part of it all.\nSecond part of it."),
    ("<div id=left><p>" + "Story text goes on. " * 20 + "</p><ul><li>Point</ul></div><div id=right><p>Short note aside</p><a href=x>" + "link " * 50 + "</a></div>", ("Story text goes on. " * 20).strip() + "\nPoint"),
    ("<article><p>An introduction before the parts.</p><section><p>" + "Part. " * 60 + "</p></section></article>", "An introduction before the parts.\n" + ("Part. " * 60).strip()),
    ("<article><header><h1>Head</h1></header><p>Body of the piece.</p><aside>no</aside><figure>pic<figcaption>Caption</figcaption></figure></article>", "Head\nBody of the piece.\npic\nCaption"),
])
def test_own_vote(page, want):
    found = html_extract.blocks(f"<html><body>{page}</body></html>")
    assert html_extract.extract(found, [html_extract.vote(found)[0]]) == want


STORY = "The story goes on and on for quite a while. " * 8
TOLD = STORY.strip()


@pytest.mark.parametrize("page,want", [
    (f"<form id=aspnetForm role=form><div class=nav><a href=x>Home</a></div><div class=content><h1>Title</h1><p>{STORY}</p></div><div class=sidebar><p>Side note</p></div></form>", f"Title\n{TOLD}"),
    (f"<div class='page overlay'><nav>Menu of it</nav><article><h1>Title</h1><p>{STORY}</p></article><form><label>Name</label><p>Sign up</p></form></div><div>Powered by it</div>", f"Title\n{TOLD}"),
    (f"<div class=widget><main><p>{STORY}</p></main></div><div><p>{STORY[:200]}</p></div>", f"{TOLD}\n{STORY[:200].strip()}"),
    (f"<div class='a widget'><p>{STORY}</p></div><div class='b widget'><p>{STORY}</p></div><div class='menu'><a href=x>Home</a></div>", f"{TOLD}\n{TOLD}"),
    (f"<form><div class=content><p>{STORY}</p></div><div class=sidebar><article><p>A teaser of another piece.</p></article></div></form>", TOLD),
    (f"<div class=post><p>{STORY}</p></div><div class=comments><article><p>{STORY * 9}</p></article></div>", TOLD),
    (f"<div class=post><p>{STORY}</p></div><div class=notice><p>{STORY}</p></div><form><p>{STORY}</p></form>", TOLD),
])
def test_wrappers_of_the_whole_page(page, want):
    found = html_extract.blocks(f"<html><body>{page}</body></html>")
    assert html_extract.extract(found, [html_extract.vote(found)[0]]) == want


def test_names_that_only_contain_a_boilerplate_word_mark_nothing():
    keep = ["share-price", "social-history", "ad-hoc", "side-note", "adHocQuery", "alert_level", "footnote", "menu-of-the-day", "notice-period"]
    page = "<html><body><article><h1>T</h1>" + "".join(f"<div class='{c}'><p>{c} {'word ' * 20}</p></div>" for c in keep) + "</article></body></html>"
    found = html_extract.blocks(page)
    assert [t.split()[0] for t in html_extract.extract(found, None).split("\n")] == ["T", *keep]
    drop = ["ad", "ad-slot", "site-footer", "share-buttons", "commentList", "related_posts", "sidebar-left", "newsletter-signup"]
    page = "<html><body><article><p>" + "word " * 200 + "</p>" + "".join(f"<div class='{c}'>no {c}</div>" for c in drop) + "</article></body></html>"
    assert html_extract.extract(html_extract.blocks(page), None) == " ".join(["word"] * 200)


def test_a_host_of_many_even_templates_keeps_paths(spark):
    rows = [(i, "https://many.example/x", f"<html><body><div class='t{chr(97 + i % 25)}'><p>{'text ' * 30}</p></div></body></html>") for i in range(50)]
    kept = html_extract.host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(kept) == 1 and len(kept[0]["paths"]) == html_extract.MOST_PATHS


def test_awkward_pages(spark):
    df = pages(spark, AWKWARD_PAGES).selectExpr("*", "'x' as text", "1 as host", "2 as paths")
    got = html_extract.extract_pages(df).collect()
    assert len(got) == len(AWKWARD_PAGES)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[1] == text[2] == "" and text[None] == "plain text <only>" and text[4] == "unclosed bold\nnext it" and text[5] == "yes\ncut"
    assert text[6] == "deep" and text[7] == " ".join(["long"] * 100_000) and text[9] == "a\nb\nc\nx\ny"
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_no_pages(spark):
    assert html_extract.extract_pages(pages(spark, [])).count() == 0


def exact(ids, x, q, k=20):
    score = np.zeros(len(x))
    for d in range(x.shape[1]):
        score += x[q, d] * x[:, d]
    score[ids == ids[q]] = -np.inf
    order = np.lexsort((ids, -score))[:min(k, int((score > -np.inf).sum()))]
    return ids[order].tolist(), score[order]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def compare(df, got):
    rows = sorted({r["vec_id"]: r["embedding"] for r in df.collect()}.items())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        want, _ = exact(ids, x, q)
        mine = sorted(found[ids[q]])
        assert [m[0] for m in mine] == list(range(1, len(mine) + 1)) and [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        score = dict(zip(ids.tolist(), (x * x[q]).sum(1)))
        assert all(abs(score[v] - s) < 1e-12 and v != ids[q] for _, v, s in mine)
        hits, total = hits + len(set(want) & {m[1] for m in mine}), total + len(want)
    return hits / max(1, total)


@pytest.mark.parametrize("where", [MIDDLE, "/root/testdata/sf0.1"])
def test_recall_on_whole_table(spark, where):
    df = spark.read.parquet(f"{where}/embeddings.parquet")
    assert compare(df, ann.search(df)) >= 0.9


def test_recall_where_most_leaves_are_never_visited(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF", 32)
    monkeypatch.setattr(ann, "BLOCK", 64)
    trees, fitted = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **k: trees.append(fitted(*a, **k)) or trees[-1])
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(60, 16)) * 8
    x = centres[rng.integers(0, 60, 6000)] + rng.normal(size=(6000, 16))
    df = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])
    assert compare(df, ann.search(df)) >= 0.9
    assert trees[0].visits < len(trees[0].leaves) / 4


def test_hot_leaf_and_ties_are_exact(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 50)  # the copies fill many blocks
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(300)] + [(1000 + i, [float(i % 7), 1.0, -float(i % 5) - 1], 0) for i in range(200)]
    df = vectors(spark, rows)
    assert compare(df, ann.search(df, recall=1.0)) == 1.0


def test_small_leaves_still_give_k_neighbours(spark, monkeypatch):
    """One visit to a leaf of its own bin: the query goes on until it has met k others."""
    monkeypatch.setattr(ann, "BLOCK", 1)
    monkeypatch.setattr(ann, "LEAF", 16)
    monkeypatch.setattr(ann.Tree, "calibrate", lambda self, *a: setattr(self, "visits", 1) or self)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 8))[rng.integers(0, 40, 1200)] * 5 + rng.normal(size=(1200, 8)) * 0.01
    got = {}
    for r in ann.search(vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(x)])).collect():
        got.setdefault(r["query_id"], []).append(r["rank"])
    assert set(got) == set(range(0, 1200, 20)) and all(sorted(ranks) == list(range(1, 21)) for ranks in got.values())


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (1, [0.5, 0.5], 1), (1, [0.5, 0.5], 1), (40, None, 1), (60, [], 1), (2, [0.0, 0.0], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1),
            (5, [None, 1.0], 1), (6, [1.0, 2.0, 3.0], 1), (None, [1.0, 1.0], 1), (-20, [-1.0, 0.0], 1)]
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(vectors(spark, rows).withColumnRenamed("label", "rank")).collect())
    assert got == [(-20, 1, 20, 0.0), (-20, 2, 1, -0.5), (-20, 3, 0, -1.0), (0, 1, 1, 0.5), (0, 2, 20, 0.0), (0, 3, -20, -1.0), (20, 1, 1, 0.5), (20, 2, -20, 0.0), (20, 3, 0, 0.0)]


def test_no_vectors(spark):
    assert ann.search(vectors(spark, [])).count() == 0 and ann.search(vectors(spark, [(0, [0.0], 1)])).count() == 0
    assert [c for c in ann.search(spark.read.parquet(f"{SMALL}/embeddings.parquet")).columns] == ["query_id", "rank", "vec_id", "score"]
