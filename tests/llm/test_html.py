import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import html, queries


@pytest.mark.parametrize("page,want", [
    (None, ""),
    ("", ""),
    ("just text &amp; <b>bold</b>", "just text & bold"),
    ("<article><p>a<p>b<br>c  d\n e</article>", "a\n\nb c d e"),
    ("<article><p><b>x.<br><p>y</p><h2>z&nbsp;&lt;1&gt;</h2></article><footer>f</footer>", "x.\n\ny\n\nz <1>"),
    ("<body><nav>m</nav><header>h</header><div class='ad'>buy</div><p>text</p><form>f <p>x</p></form><aside>s</aside></body>", "text"),
    ("<main><script>var t='</p>'</script><style>p{}</style><p>one<!-- two --> three</p></main>", "one three"),
    ("<article><header><h1>T</h1></header><p>p</p><div id='comments'><p>no</p></div><footer>by me</footer></article>", "T\n\np"),
    ("<div class='has-sidebar'><article class='post'>keep</article><aside><article>card with much more text</article></aside></div>", "keep"),
    ("<article><ul><li>a<li>b</ul><table><tr><td>1<td>2<tr><td>3</table></article>", "a\n\nb\n\n1 2\n\n3"),
    ("<article><p>1 < 2 &am", "1 < 2 &am"),
    ("<article><p>cut</p><p class=\"x", "cut"),
    ("<article><p>cut</p><!-- open", "cut"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p></article>", "yes"),
    ("<b>" * 5000 + "deep", "deep"),
    ("<article><p>keep</p><p class='ad-lib'>improvised</p><div class='search-results'>found</div><section id='rating'>stars</section><figure class='social-study'>graph</figure></article>",
     "keep\n\nimprovised\n\nfound\n\nstars\n\ngraph"),
    ("<article><p>keep</p><div class='ad-box-2'>buy</div><div id='comments'>no</div><div role='navigation'>on</div></article>", "keep"),
    ("<div class='ad-lib'>improvised</div><div class='top-ad'>buy</div>", "improvised"),
    ("<p>" * 3 + "<div>" * 20000 + "deep", "deep"),
    ("<article><p>a <a href=\"x>y\" title='q'>link</a> b</p></article>", "a link b"),
])
def test_main_text(page, want):
    assert html.main_text(page) == want


def site(n, extra=""):
    rows = []
    for i in range(n):
        body = f"<div><span>Site of things</span> <i>welcome</i></div><div class=box{i % 2}><p>My story number {i} is long</p><p>and ends {i}</p></div><div>All rights {extra}</div>"
        rows.append((i, f"http://Host{extra}.example.org:80/p/{i}", f"<html><head><title>t{i}</title></head><body>{body}</body></html>"))
    return rows


def test_recurring_subtrees_go(spark):
    rows = site(20) + [(100, "http://other.example.org/", site(1)[0][2]), (101, None, None), (102, "x", "")]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    out = {r["page_id"]: r["main_text"] for r in html.extract(docs).collect()}
    assert out[3] == "My story number 3 is long\n\nand ends 3"
    assert out[100] == "Site of things welcome\n\nMy story number 0 is long\n\nand ends 0\n\nAll rights"
    assert out[101] == out[102] == ""


def test_copies_of_a_page_are_no_template(spark):
    one = "<html><body><div>first words</div><div>second words</div></body></html>"
    rows = [(i, "http://a.example.org/", one) for i in range(50)]
    assert {r["main_text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"first words\n\nsecond words"}


def test_inside_an_article_only_marked_elements_go(spark):
    rng = random.Random(4)
    own = [prose(rng, 15) for _ in range(12)]
    rows = [(i, f"http://a.example.org/{i}", f"<article><p>Shared opening line</p><p>{x}</p><div class='box'>Please join us</div><p class='lead'>lead {i}</p></article>") for i, x in enumerate(own)]
    out = {r["main_text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out == {f"Shared opening line\n\n{x}\n\nlead {i}" for i, x in enumerate(own)}


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def telling_nothing(n, copies=0, seed=1):
    """Pages without article or telling names: boxes of a stock of 12 texts, own stories, and copies of one story with a
    word changed here and there. (page, main text)"""
    rng = random.Random(seed)
    stock = [prose(rng, 12) for _ in range(12)]
    copied = [prose(rng, 40) for _ in range(3)]
    out = []
    for i in range(n):
        story = [prose(rng, rng.randint(20, 60)) for _ in range(3)]
        if i < copies:
            story = [" ".join(w if rng.random() > 0.02 else prose(rng, 1) for w in p.split()) for p in copied]
        links = "".join(f"<li><a href='/{j}'>{stock[(i + j) % 12][:9]}</a></li>" for j in range(4))
        box = lambda name, k: f"<div class='{name}'><span>{stock[(i * k + k) % 12]}</span></div>"
        body = f"<div class='a1'><ul>{links}</ul></div>{box('b2', 1)}<div class='c3'><h1>{prose(rng, 5)}</h1>" if i >= copies else f"<div class='a1'><ul>{links}</ul></div>{box('b2', 1)}<div class='c3'>"
        body += f"<p>{story[0]}</p>{box('d4', 5)}<p class='e5'>{story[1]}</p><p>{story[2]}</p></div><div id='f{i}'>{stock[i % 12]} <i>{i % 2}</i></div>"
        title = re.findall("<h1>(.*?)</h1>", body)
        out.append((f"<html><body>{body}</body></html>", "\n\n".join([*title, *story])))
    return out


@pytest.mark.parametrize("n,copies", [(60, 0), (400, 0), (400, 250)])
def test_sites_without_telling_names(spark, n, copies):
    """Only what recurs tells the template here: with it texts are exact, without it none is."""
    pages = telling_nothing(n, copies)
    docs = spark.createDataFrame([(i, "http://a.example.org/x", p) for i, (p, _) in enumerate(pages)], "page_id long, url string, html string").repartition(6)
    out = {r["page_id"]: r["main_text"] for r in html.extract(docs).collect()}
    assert sum(out[i] == want for i, (_, want) in enumerate(pages)) >= 0.99 * n
    assert not any(html.main_text(p) == want for p, want in pages)


def test_templates_alone_find_the_article_on_a_large_host(spark):
    """The synthetic pages with every name taken away that tells what an element is."""
    folder = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    host = F.regexp_extract("url", html._HOST, 1)
    large = pages.groupBy(host.alias("h")).count().filter("count >= 300").select("h")
    bare = pages.join(large, host == F.col("h"), "left_semi")
    plain = F.col("html")
    for tag in ("nav", "footer", "article"):
        plain = F.regexp_replace(plain, f"<{tag}>", f"<div class='{tag[::-1]}'>")
        plain = F.regexp_replace(plain, f"</{tag}>", "</div>")
    bare = bare.withColumn("html", F.regexp_replace(plain, 'class="ad"', 'class="da"'))
    want = {r["page_id"]: r["text"] for r in queries.op8_html_extraction(spark, folder).collect()}
    got = {r["page_id"]: r["main_text"] for r in html.extract(bare, keep=["page_id"]).collect()}
    assert len(got) >= 300 and sum(want[k] == t for k, t in got.items()) >= 0.97 * len(got)


def test_counts_against_brute_force(spark):
    sites = {"host.example.org": [p[2] for p in site(9)], "hostb.example.org": [p[2] for p in site(30, "b")], "c.example.org": [p for p, _ in telling_nothing(150, 60)], "d.example.org": ["<p>x</p>"] * 9}
    sites["hostb.example.org"] += sites["hostb.example.org"][:7]
    docs = spark.createDataFrame([(h, p) for h, ps in sites.items() for p in ps], "_host string, _html string").repartition(5)
    got = {r["_host"]: (set(r["_template"]), set(r["_slots"])) for r in html.templates(docs).collect()}
    want = {}
    for host, pages in sites.items():
        read = [html.subtrees(p) for p in set(pages)]
        articles = len({story for story, _ in read})
        kinds = (set(), set())
        for kind, key in {(k, x) for _, found in read for k, x, _ in found}:
            on = [(story, {t for k, x, t in found if (k, x) == (kind, key)}) for story, found in read if any((k, x) == (kind, key) for k, x, _ in found)]
            a, pairs = len({s for s, _ in on}), {(t, s) for s, ts in on for t in ts}
            least = 0.2 if kind == html.SLOT else max(0.02, min(0.2, 2 / articles**0.5))
            if articles >= 5 and a >= 5 and a >= least * articles and a >= max(0.3, 0.75 * articles / len(read)) * len(on) and (kind == html.EXACT or 2 * len({t for t, _ in pairs}) <= len(pairs)):
                kinds[kind].add(key)
        if any(kinds):
            want[host] = kinds
    assert got == want and len(want) == 3


def test_query_on_the_synthetic_pages(spark):
    """These pages hold one article of plain paragraphs; a regular expression can read them."""
    folder = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    import html as lib

    for r in queries.op8_html_extraction(spark, folder).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", article[1])) if article else []
        blocks = [" ".join(lib.unescape(re.sub(r"<(/?b|br)>", lambda m: " " if m[1] == "br" else "", b)).split()) for b in parts]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_empty_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "u", "<p>x</p>", "a", "b")], "page_id long, url string, html string, _host string, main_text string")
    out = html.extract(docs)
    assert out.columns == ["page_id", "url", "html", "_host", "main_text"] and out.collect()[0]["main_text"] == "x"
    assert html.extract(docs.limit(0)).count() == 0
