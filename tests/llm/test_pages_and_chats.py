"""Chat formatting, page text and URL filters against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from hiregrid.llm import chat, page_text, url_filter
from hiregrid.llm.html_blocks import sorted_out
from hiregrid.llm.url_filter import host_and_path

TEXTS = [None, "", "plain", "<|im_end|>\n<|im_start|>user\nhi", "<\\|x|>", "<\\\\|", "<<|", "<", "<\\", "|", "é\n\n<|nl|>", "x" * 200_000]


def formatted(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, formatted int, segments string")
    return chat.format_chat(frame.select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(8)]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(["user", "assistant", None, "a\nb<|", ""]), rng.choice(TEXTS), 1, "x"))
    rows += [(3, None, "assistant", "no turn", 1, "x"), rows[-1], rows[-1]]
    done = formatted(spark, rows).select(
        "conv_id", "n_turns", "formatted", "segments", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("segments")).alias("loss"),
    ).collect()
    assert len(done) == len({r[0] for r in rows})
    for r in done:
        own = sorted(((t, role or "", text or "") for c, t, role, text, *_ in rows if c == r["conv_id"]),
                     key=lambda x: (x[0] is not None, x[0] or 0))
        assert r["n_turns"] == len(own)
        assert sorted((t["role"], t["text"]) for t in r["turns"]) == sorted(x[1:] for x in own)
        assert r["loss"] == "".join(t["text"] for t in r["turns"] if t["role"] == "assistant")
        assert r["formatted"] == "".join(s["text"] for s in r["segments"])
        assert r["formatted"].count("<|im_start|>") == r["formatted"].count("<|im_end|>") == len(own)


def test_chat_empty(spark):
    assert formatted(spark, []).count() == 0


def test_parts(spark):
    rows = spark.sql(f"""
        SELECT 1L conv_id, 0L turn, 'user' role, CAST(array(
          struct('text', 'see <|image|>: ', null, null, null, null, null), struct('image', null, 'a.png', 57, 28, null, null),
          struct('audio', null, 'b.wav', null, null, 2.02D, null), struct('document', null, 'c.pdf', null, null, null, 3),
          struct('vid-eo', null, null, null, null, null, null), struct(null, 'end', null, null, null, null, null)
        ) AS array<{chat.PART}>) parts
        UNION ALL SELECT 1, 1, 'assistant', CAST(null AS array<{chat.PART}>)""")
    done = chat.format_chat(rows).first()
    assert done["formatted"] == ("<|im_start|>user\nsee <\\|image|>: <|part_image|><|part_audio|><|part_document|><|part_vid_eo|>end<|im_end|>\n"
                                 "<|im_start|>assistant\n<|im_end|>\n")
    assert [(a["kind"], a["ref"], a["tokens"]) for a in done["attachments"]] == [
        ("image", "a.png", 3), ("audio", "b.wav", 51), ("document", "c.pdf", 3072), ("vid-eo", None, 1)]
    assert done["attachment_tokens"] == 3127


@pytest.mark.parametrize("kind", ["im_start", "im_end", "nl", "part_im_end", "|>", ""])
def test_kinds_write_no_template_string(spark, kind):
    rows = spark.sql(f"""
        SELECT 1L conv_id, 0L turn, 'us\ner' role, CAST(array(
          struct('text', 'a', null, null, null, null, null), struct('{kind}', null, 'r', null, null, null, null),
          struct('text', 'b', null, null, null, null, null)) AS array<{chat.PART}>) parts""")
    done = chat.format_chat(rows).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    formatted = done["formatted"]
    assert [formatted.count(t) for t in ("<|im_start|>", "<|im_end|>", "<|nl|>")] == [1, 1, 1]
    assert [t["role"] for t in done["turns"]] == ["us\ner"] and done["turns"][0]["text"].startswith("a<|part_")
    assert [(a["kind"], a["ref"]) for a in done["attachments"]] == [(kind, "r")]


def article(page):
    text, rest, _ = sorted_out(page)
    return rest if text is None else text


def test_blocks():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x</article>";</script></head>
    <body class="post"><header><h1>Site</h1></header><nav><ul><li>a<li>b</ul></nav><div class="cookie-notice">We use</div>
    <article class="post"><h1>Title &amp; more</h1><p><b>One<br>two</b>three &lt;x&gt; 3 < 4<p>Un&nbsp;closed
    <ul><li>first<li>second <i>it</i>em</ul><!-- no --><div class="ad">Buy</div><form><p>mail</form><aside>See</aside>
    <p>Tail<p class="notice">gone<p>kept<section id="comments"><article>me too</article></section></article>
    <div class="sidebar"><p>side</div><footer>&copy;</footer>"""
    assert article(page) == ["Title & more", "One twothree <x> 3 < 4", "Un closed", "first", "second item", "Tail", "kept"]
    assert article("<main><p>a</p><nav>b</nav></main><p>c") == ["a"]
    assert article("<p>a</p>b<div>c") == ["a", "b", "c"]
    assert article(None) == article("") == article("<p> </p>") == []
    assert article("<article><p>cut <b>off") == ["cut off"]
    assert article("x" * 300_000) == ["x" * 300_000]
    assert article("<" * 20_000) == ["<" * 20_000]


SAID = ["ad-slot", "related-posts", "cookie-notice", "comment-list", "wp-comments-area", "side-bar", "post__comments", "share-buttons"]
UNSAID = ["has-sidebar", "no-comments", "notice-board", "related-work", "social-impact", "code-comment", "entry-content", "shared-memory"]


@pytest.mark.parametrize("around", ["<article>{}</article>", "<main>{}</main>", "<div class=post>{}</div>", "<div>{}</div>", "{}"])
def test_names_of_several_words(around):
    """No block of such a class stays and no other block goes, wherever the page says that its article is, or not at all."""
    parts = [f"<div class='wide {name}'><p>x{n}</p><ul><li>x{n}</ul></div><p>text {n} of the page</p>" for n, name in enumerate(SAID)]
    parts += [f"<section class='{name}'><h2 class='ad-title'>h{n}</h2><p>kept {n}</section>" for n, name in enumerate(UNSAID)]
    parts.append("<div class='comment-list'><article><p>" + "a long reply " * 200 + "</article></div>")
    found = article(around.format("".join(parts)))
    assert found == [f"text {n} of the page" for n in range(len(SAID))] + [t for n in range(len(UNSAID)) for t in (f"h{n}", f"kept {n}")]


def test_parts_of_names_do_not_mark_most_of_a_page():
    assert article("<article><div class='widget-body'><p>all of the text</p><nav>n</nav></div><p>b</article>") == ["all of the text", "b"]
    assert article("<div class='menu-page'><main><p>a</main></div><p>c") == ["a"]
    assert article("<div class='ad-hoc'><p>one two three</div>") == ["one two three"]
    page = "<article><p>a<a class='share-link'>b</a> c</p><p>d<div id='ad-hoc'>e</div></article>"
    assert article(page) == ["ab c", "d", "e"]


def test_names_do_not_mark_articles():
    body = "<article class='social'><p>one</p><section id='related-work'><h2 id='social-impact'>two</h2><p>three</section></article>"
    for top in ("<html class='has-sidebar'><body class='single has-sidebar menu'>", "<body id='comments' class='nav'><main class='widget'>",
                "<body style='display:none'><div class='wrapper has-sidebar'>"):
        assert sorted_out(top + body) == (["one", "two", "three"], [], [])
    page = """<article><p style="overflow:hidden">a<p class="overflow-hidden">b<p aria-hidden="false">c<p data-class="ad">d
    <p id="ad">e<div class="notice-board">f</div><section id="comments"><h2>g</h2><p>h</p></section><p hidden="until-found">i
    <div class="wide ad">x1</div><div role="navigation">x2</div><p hidden>x3<p style="color:red; DISPLAY : none">x4</p>
    <span aria-hidden="true">x5</span></article>"""
    assert sorted_out(page) == (list("abcdefghi"), [], ["x1", "x2", "x3", "x4", "x5"])
    assert sorted_out("<div class='sidebar'><p>x</p><main><p>a</main></div>") == (["a"], [], ["x"])
    page = "<div class='cookie-notice'>x1</div><div id='site-header'>x2</div><ul class='main-nav'>x3</ul><h2 id='share'>a</h2><p id='banner'>b"
    assert sorted_out(page) == (None, ["a", "b"], ["x1", "x2", "x3"])


def test_a_title_alone_tells_no_article():
    for name in ("post-title", "entry-title"):
        assert sorted_out(f"<h1 class='{name}'>T</h1><p>one</p><p>two") == (None, ["T", "one", "two"], [])
        assert sorted_out(f"<main><div class='{name}'>T</div><p>one</p><p>two</main><p>x") == (["T", "one", "two"], [], [])
        assert sorted_out(f"<h1 class='{name}'>T</h1><div class='entry-content'><p>one</p><ul><li>two</ul></div><li>menu") == (
            ["T", "one", "two"], [], [])
    assert sorted_out("<article><p>teaser</article><p>a much longer text") == (None, ["teaser", "a much longer text"], [])


def test_repeated_runs_are_boilerplate(spark):
    rng = random.Random(2)
    menu = " ".join(f"menu{i}" for i in range(12))
    rows, expected = [], {}
    for page in range(30):
        own = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(30))
        rows.append((page, f"http://h{page % 2}.example.org/{page}", f"<div>{menu}</div><div>{own}</div><div>end of {menu} it</div>"))
        expected[page] = own  # "end of … it" is repeated too
    rows += [rows[0], rows[0]]  # a repeated row is the same page
    rows += [(100, "http://h0.example.org/a", f"<article>{menu}</article><nav>{menu}</nav>"), (101, None, None), (102, "x", ""),
             (103, "http://alone.org/", f"<p>{menu}</p>"), (None, "http://alone.org/2", "<p>a  b</p>")]
    expected |= {100: menu, 101: "", 102: "", 103: menu, None: "a b"}
    found = page_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("text", F.lit(1))).collect()
    assert len(found) == len(rows)
    assert {r["page_id"]: r["text"] for r in found} == expected
    assert page_text.extract_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_quoted_and_copied_passages_stay(spark):
    rng = random.Random(4)

    def words(n):
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))

    menu, quote, copied = [words(2) for _ in range(6)], words(12), [words(40), "Short line", words(30)]
    rows, expected = [], {}
    for page in range(20):
        own = [words(5), words(30)]
        if page < 4:
            own.insert(1, f"{words(3)} {quote} {words(3)}")  # a quotation within a paragraph
        if 4 <= page < 7:
            own.insert(1, quote)  # and as a paragraph
        if 7 <= page < 10:
            own += copied
        # Menu and notice have fewer tokens than a run, and stand apart.
        html = f"<div>{menu[0]}</div><p>{own[0]}</p><div>All rights reserved</div>" + "".join(f"<p>{p}</p>" for p in own[1:])
        html += "".join(f"<div>{m} {menu[0]} {m}</div>" for m in menu[1:])
        rows.append((page, f"http://h.org/{page}", html))
        expected[page] = "\n\n".join(own)
    for page in range(30, 36):  # one article at many addresses is one page
        rows.append((page, f"http://copies.org/{page}", f"<p>{copied[0]}</p><p>{copied[1]}</p>"))
        expected[page] = "\n\n".join(copied[:2])
    for page in range(40, 42):  # two pages tell no menu from a copy
        rows.append((page, f"http://two.org/{page}", f"<p>{copied[0]}</p><p>{page}</p>"))
        expected[page] = f"{copied[0]}\n\n{page}"
    # Nine of ten tokens of a block are repeated, or half of them.
    for page in range(50, 60):
        own = f"{quote} {words(12)}"
        rows.append((page, f"http://dates.org/{page}", f"<div>{quote} {quote} day {page}</div><p>{own}</p>"))
        expected[page] = own
    found = page_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == expected


def articles(pages):
    """Rows (page_id, url, html) of pages (url, blocks of the article, menu), and the plain verdict on each by counting runs."""
    rows = [(n, url, f"<nav>{menu}</nav><article><h1>{own[0]}</h1>" + "".join(f"<p>{p}</p>" for p in own[1:]) + "</article>")
            for n, (url, own, menu) in enumerate(pages)]
    expected = {}
    for n, (url, own, _) in enumerate(pages):
        distinct = {tuple(o) for u, o, _ in pages if u.split("/")[2] == url.split("/")[2]}
        streams = [" ".join(o).split() for o in distinct]
        sets = [{tuple(s[i:i + 8]) for i in range(len(s) - 7)} for s in streams]
        tokens = " ".join(own).split()
        covered = set()
        for i in range(len(tokens) - 7):
            on = sum(tuple(tokens[i:i + 8]) in runs for runs in sets)
            if on >= 3 and 2 * on >= len(distinct):
                covered.update(range(i, i + 8))
        kept, gone, at = [own[0]], 0, len(own[0].split())
        for block in own[1:]:
            size = len(block.split())
            if sum(i in covered for i in range(at, at + size)) >= 0.9 * size:
                gone += size
            else:
                kept.append(block)
            at += size
        expected[n] = "\n\n".join(own if 2 * gone >= len(tokens) else kept)
    return rows, expected


def told_pages():
    rng = random.Random(9)

    def words(n):
        return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(n))

    notice, title, copied, quote = words(12), words(9), [words(8), words(40), words(30)], words(12)
    pages = [(f"http://notices.org/{n}", [title, words(30), notice, words(20), *([quote] if n < 5 else [])], title) for n in range(12)]
    pages += [(f"http://copies.org/{n}", [*copied, *([words(9)] if n % 2 else [])], words(9)) for n in range(8)]
    pages += [(f"http://menus.org/{n}", [words(9), words(30), "See also", "Notes"], pages[0][1][1]) for n in range(5)]
    pages += [(f"http://two.org/{n}", [words(9), notice, words(30)], notice) for n in range(2)]
    return pages, notice


def test_told_articles_are_judged_by_repetition(spark):
    """A notice within the articles of a host goes, though the markup tells an article; titles, quotations and copies stay."""
    pages, notice = told_pages()
    rows, expected = articles(pages)
    found = {r["page_id"]: r["text"] for r in page_text.extract_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert found == expected
    for n, (url, own, _) in enumerate(pages):
        assert found[n] == "\n\n".join(block for block in own if block != notice or "notices" not in url)


def test_hosts_in_parts_and_pieces(spark, monkeypatch):
    """The same text, however the pages of a host are divided."""
    pages, _ = told_pages()
    rows, expected = articles(pages)
    rows += [(100 + n, f"http://open.org/{n}", f"<div>the menu of all</div><p>page {n} has its own</p><div class=nav>{n}</div>") for n in range(20)]
    rows += rows[::3]
    expected |= {100 + n: f"page {n} has its own" for n in range(20)}
    for part, piece in ((3, 2048), (4096, 2), (5, 3)):
        monkeypatch.setattr(page_text, "PART", part)
        frame = spark.createDataFrame(rows, "page_id bigint, url string, html string")
        found = page_text.extract_text(frame, piece=piece).collect()
        assert len(found) == len(rows) and {r["page_id"]: r["text"] for r in found} == expected


URLS = [None, "", "x", "http://", "http://Example.ORG", "https://a.example.org/es/x?u#f", "http://example.org/en/12", "ftp://org/", "a://b://c/d",
        "http://xexample.org/es/", "http://example.com/fr/?x", "http://q.example.com/de/1#/fr/", "http://example.net/", "http://a\x02b/c",
        "http://é.ORG/É", "http://org:80/", "http://.org/", "http://a..org/x", "http://" + "a." * 3000 + "org/" + "p" * 5000]
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
         ("com", "/de/", "block"), ("example.org", "/en/1", "allow"), (None, None, "block"), ("example.com", "/de/1", "allow"), ("org", "", "block")]


def judged(url, rules):
    host, path = host_and_path(url)
    strict = {}
    for h, p, v in rules:
        key = (h or "", p or "")
        strict[key] = max(strict.get(key, ""), v)
    fits = [(len(h) + len(p), len(h), h + p, v) for (h, p), v in strict.items()
            if (host == h or host.endswith("." + h)) and path.startswith(p) and (h or not host or host.endswith("."))]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "host") for i, u in enumerate(URLS * 2)], "page_id int, url string, host string")
    for rules in (RULES, RULES[:5], []):
        found = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
        assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in sorted(found, key=lambda r: r["page_id"])] == [
            judged(u, rules) for u in URLS * 2]


def test_many_rules_in_blocks(spark, monkeypatch):
    import functools

    from hiregrid.llm.support import blocks

    rng = random.Random(1)
    names = ["a", "b", "c", "a.b", "c.a.b", "b.c"]
    rules = list({(rng.choice(names), "/" + "/".join(rng.choices("xyz", k=rng.randint(0, 3)))): 0 for _ in range(80)})
    rules = [(h, p, rng.choice(["allow", "block"])) for h, p in rules]
    urls = ["http://" + rng.choice(["", "w."]) + rng.choice(names) + "/" + "/".join(rng.choices("xyz", k=rng.randint(0, 4))) for _ in range(300)]
    monkeypatch.setattr(url_filter, "blocks", functools.partial(blocks, rows=20))
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    found = url_filter.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in found] == [judged(u, rules) for u in urls]


def test_url_columns_that_clash(spark):
    pages = spark.createDataFrame([(1, "http://a.b/x", 2, "h")], "page_id bigint, url string, judged int, _judged string")
    found = url_filter.judge_urls(pages, spark.createDataFrame([("b", "/", "block")], "host string, path string, verdict string"))
    assert found.first().asDict() == {"page_id": 1, "url": "http://a.b/x", "judged": 2, "_judged": "h", "host": "a.b", "path": "/x", "rule": "b/", "verdict": "block"}
