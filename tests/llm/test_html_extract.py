"""Extraction from marked and unmarked pages; pairing against a brute-force version."""

import html as H
import random
import re

from lineforge.llm import html_extract as X


def text(page, shared=None):
    return "\n".join(X.main_lines(page, shared))


def test_marked_article():
    page = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>menu</li></ul></nav>"
            "<div class=ad>buy</div><article><h1>A &amp; B</h1><p>one <b>two</b>\n  three&nbsp;x<br>four<p>five</p>"
            "<div class='share-box'>tweet</div><aside>side</aside><form><p>name</p></form><!-- no --><section id=comments><article><p>reader</p></article></section>"
            "<ul><li>i<li>ii</ul></article><footer>&copy; x</footer>")
    assert text(page) == "A & B\none two three x four\nfive\ni\nii"


def test_odd_pages():
    assert text("") == "" and text("   ") == "" and text("plain &lt;b&gt; text") == "plain <b> text"
    assert text("<p>a<p>b") == "a\nb" and text("<article><p>cut &am") == "cut &am"
    assert text("<div hidden>x</div><div style='display: none'>y</div><p>z") == "z"
    assert text("<p>a <span class=ad>buy</span> b</p>") == "a\nb"
    assert text("</div></p>a<b>b</i>c") == "abc"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    X.blocks("<div>" * 3000 + "x" + "<p><b>y<br>" * 3000)


def subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_alignment_is_longest():
    rng = random.Random(8)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = X.common_lines(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got) and got == sorted(set(got)) and len(got) == subsequence(a, b)


def plain(rows):
    """Pairs by one sort of everything."""
    line = sorted({(X.place(u), p, k, h) for p, u, h, k in rows}, key=lambda r: (*r[0], r[1], r[2]))
    out = {}
    for n, (where, p, k, h) in enumerate(line):
        other = line[n - 1] if n and line[n - 1][0][0] == where[0] else line[n + 1] if n + 1 < len(line) and line[n + 1][0][0] == where[0] else None
        names = {}
        mine, theirs = ([names.setdefault(t, len(names)) for t, _ in X.blocks(x)] for x in (h, other[3] if other else ""))
        out[k] = "\n".join(X.main_lines(h, X.common_lines(mine, theirs) if other else None))
    return out


def test_pairs_do_not_depend_on_partitions(spark):
    rng = random.Random(2)
    rows = []
    for i in range(90):
        host = rng.choice(["a.example.com", "a.example.com", "b.example.com", f"c{i}.example.com"])
        if rng.random() < 0.2:
            page = f"<article><p>all rights</p><p>text {i}</p></article><p>all rights</p>"
        else:
            page = f"<div>{host} menu</div><p>text {i}</p><p>more {rng.randint(0, 40)}</p><div>all rights</div>"
        rows.append((i, f"https://{host}/en/{rng.randint(1, 500)}?x=1", page))
    rows += [(900, None, "<p>lost</p>"), (901, "http://[broken", None), (None, "https://a.example.com/en/7", "<p>text</p>"), rows[3], rows[3]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' AS text", "1 AS lines", "2 AS part")
    keys = {(r.page_id, r.url, r.html): r.k for r in pages.select("*", X.row_key(pages).alias("k")).collect()}
    want = plain([(p, u, h or "", keys[p, u, h]) for p, u, h in rows if p is not None])
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            known = pages.where("page_id IS NOT NULL")
            got = X.extract(known).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert len(got) == len(rows) - 1
        by_page = {p: want[keys[p, u, h]] for p, u, h in rows if p is not None}
        assert all(r.text == by_page[r.page_id] for r in got)
    assert X.extract(pages).count() == len(rows) and X.extract(pages.limit(0)).count() == 0


def test_given_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r.page_id: r.text for r in X.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()}
    for r in rows:
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = [" ".join(H.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|div|article)[^>]*>", body)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_copies_are_not_furniture(spark):
    """Equal and nearly equal pages next to each other keep their text and still lose what other pages share."""
    story = "<p>" + "</p><p>".join(f"a long paragraph of the one story, number {n}" for n in range(12)) + "</p>"
    page = lambda body: f"<div>site menu</div>{body}<div>all rights</div>"
    rows = [(n, f"https://a.example.com/en/7?utm={n}", page(story)) for n in range(30)]
    rows += [(40 + n, f"https://a.example.com/en/7?print={n}", page(f"{story}<p>seen {n}</p>")) for n in range(30)]
    rows += [(80, "https://a.example.com/en/9", page("<p>another story altogether</p>"))]
    rows += [(90 + n, f"https://b.example.com/en/7?utm={n}", page(story)) for n in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    whole = [t for t, _ in X.blocks(story)]
    for parts in ("1", "3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.page_id: r.text.split("\n") for r in X.extract(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert all(got[n] == whole for n in range(30))
        assert all(got[40 + n] == [*whole, f"seen {n}"] for n in range(30))
        assert got[80] == ["another story altogether"]
        assert got[90] == got[91] == ["site menu", *whole, "all rights"]  # only copies on this host


def test_names_around_the_article():
    body = "<p>the first paragraph of the main text</p><p>the second paragraph of it</p>"
    want = "the first paragraph of the main text\nthe second paragraph of it"
    for start, end in (("<article class='post comments-open'>", "</article>"), ("<article class='category-social'>", "</article>"),
                       ("<div role=main id=sidebar>", "</div>"), ("<form action=x><div class=promo><article>", "</article></div></form>"),
                       ("<div id=content class=has-sidebar>", "</div>"), ("<form><div>", "</div></form>"),
                       ("<section class='has-sidebar'><article class='social'>", "</article></section>")):
        assert text(f"<nav>menu</nav>{start}{body}{end}<div class=ad>buy</div><footer>end</footer>") == want, start
    assert text(f"<article>{body}</article><section id=comments><article><p>reader</p></article></section>") == want
    assert text(f"<form><article>{body}<div class=ad>buy</div></article><div id=comments><article>reader</article></div></form>") == want
    assert text("<article><p>so <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds<object><p>shown</p></object></article>") == "so x=2 holds\nshown"


def test_class_words_alone_delete_nothing():
    page = ("<article><p>Main</p><div class='notice-board'>posts</div><ul class='menu-list'><li>soup</li></ul><p class='ad-hoc'>made up</p>"
            "<div class='share-box'>tweet</div><div class='ad-300x250 ad_2'>buy</div><div id='newsletter-form'>mail</div><nav class=toc>1 2</nav>"
            "<div class=toc>one two</div><p class='read-more'>next</p><ol class='comment-list'><li>nice</li></ol></article>")
    assert text(page) == "Main\nposts\nsoup\nmade up"


def test_reader_comments():
    assert text("<article class=post><p>it</p></article><article class=comment><p>reader</p></article>") == "it"
    assert text("<article><h1>T</h1><p>it</p><article><p>reader says a lot more than that</p></article></article>") == "T\nit"
    assert text("<main><h1>T</h1><p>a long text of the page's own</p><article>reader says</article></main>") == "T\na long text of the page's own"
    assert text("<main><h1>Blog</h1><article><p>first post</p></article><article><p>second post</p></article></main>") == "Blog\nfirst post\nsecond post"
    assert text("<article><article><h2>T</h2><p>it</p></article></article>") == "T\nit"
    assert text("<article class=comment><p>the only text</p></article>") == "the only text"


def test_markup_of_any_kind_in_linear_time():
    import time
    assert text("<p>a</p><!-- open <p>b</p>") == "a" and text("<p>a<!-->b<!--->c<!-- x --!>d") == "abcd"
    assert text("<p>a</p><a href='x><p>b") == "a" and text("<p title='>'>a</p>1 < 2 <3 </> </ x>y") == "a\n1 < 2 <3 y"
    assert text("<!doctype html><?xml x?><p>a<SCRIPT>if (a</b>) '</p>'</Script >b<style>x") == "a\nb"
    assert text("<p class=ad class=x>buy</p><p ID = 'ads'>buy</p><br/><div/>z<p/>y") == "z\ny"
    for piece, n in (("<a ", 350_000), ("<!--", 250_000), ("<b>", 300_000), ("<div class=ad>", 70_000), ("</i><b>", 150_000), ("<p>x", 250_000), ("<", 500_000),
                     ("<a b='", 150_000), ("<article>x", 100_000), ("<td><b>", 130_000), ("&", 500_000)):
        began = time.process_time()
        X.blocks(piece * n)
        assert time.process_time() - began < 5, piece
    rng = random.Random(3)
    a, b = ([rng.randint(0, 2) for _ in range(6000)] for _ in range(2))
    began = time.process_time()
    found = X.common_lines(a, b)
    assert time.process_time() - began < 2
    it = iter(b)
    assert all(a[i] in it for i in found)


def test_dense_alignment_is_longest(monkeypatch):
    rng = random.Random(9)
    for _ in range(800):
        a, b = ([rng.randint(0, 3) for _ in range(rng.randint(0, 40))] for _ in range(2))
        got = X.dense_common(a, b)
        it = iter(b)
        assert all(a[i] in it for i in got) and got == sorted(set(got)) and len(got) == subsequence(a, b)


def test_many_waiting_pages(spark, monkeypatch):
    """A host that begins with more near copies than may wait gives the same as one that holds them all."""
    story = "".join(f"<p>a long paragraph of the one story, number {n}</p>" for n in range(12))
    rows = [(n, f"https://a.example.com/en/{n}", f"<div>menu</div>{story}<p>seen {n}</p><div>rights</div>") for n in range(40)]
    rows += [(90, "https://a.example.com/en/90", "<div>menu</div><p>other</p><div>rights</div>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: r.text for r in X.extract(pages).collect()}
    assert want[90] == "other" and want[3].startswith("a long") and want[3].endswith("seen 3")
    source = X.shared_lines.__globals__
    monkeypatch.setitem(source, "WAITING", 7)   # closures in tasks take the value with them
    assert {r.page_id: r.text for r in X.extract(pages).collect()} == want


def test_the_difference_decides_inside_articles(spark):
    """What several pages repeat inside their articles goes; a quoted passage, a mirrored article and versions of a story stay."""
    rows, want = [], {}
    for n in range(9):
        story = [f"a long paragraph {n} of its own, number {k}" for k in range(4)]
        if n in (3, 4):
            story.insert(2, "a passage that one page quotes from the other one")
        lines = ["you are here: home", *story, "read more of our letters"]
        for host, parts in (("a", lines), ("b", lines if n < 2 else lines[1:-1])):
            page_id = n + 100 * (host == "b")
            rows.append((page_id, f"https://{host}.example.com/en/{n}", f"<nav>menu</nav><article><p>{'</p><p>'.join(parts)}</p></article><footer>end</footer>"))
            want[page_id] = story if host == "a" else parts   # two pages of b share the lines: too few to tell
        rows.append((200 + n, f"https://c.example.com/en/{n}", "<article><p>the one story that all these pages tell</p><p>and its end</p>" + f"<p>version {n}</p></article>"))
        want[200 + n] = ["the one story that all these pages tell", "and its end", f"version {n}"]
    rows.append((50, "https://a.example.com/en/3?print=1", rows[9][2]))
    want[50] = want[3]
    assert rows[9][0] == 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            got = {r.page_id: r.text.split("\n") for r in X.extract(pages).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        assert got == want
