"""Pages with planted full texts, held against what is extracted."""

import json

from kerbline.llm import html_extract

from .helpers import prose


def read_all(pages, wrapped=8):
    wrappers = html_extract.ready(json.dumps(html_extract.induce(pages[:wrapped])))
    return [html_extract.main_text(p, wrappers) for p in pages]


def test_div_pages_keep_title_lead_and_end():
    parts = [[f"Title {i}", prose(i, 15), prose(100 + i, 60), f"The end of {i}"] for i in range(9)]
    pages = ["<body><div id=page><h1>{}</h1><p>{}</p><div class=entry><p>{}</p></div><p>{}</p></div></body>".format(*p) for p in parts]
    want = ["\n".join(p) for p in parts]
    assert read_all(pages) == want
    assert [html_extract.main_text(p, None) for p in pages] == want


def test_text_that_only_pages_outside_the_sample_have_is_kept():
    pages = [f"<div><div class=entry><p>{prose(i, 40)}</p></div></div>" for i in range(8)]
    pages.append(f"<div><p>Erratum</p><div class=entry><p>{prose(8, 40)}</p></div><div class=entry><p>more</p></div></div>")
    assert read_all(pages)[8] == f"Erratum\n{prose(8, 40)}\nmore"


def test_all_articles_and_sections_of_a_page_are_read_in_order():
    for tag in ("article", "section"):
        pages = [f"<body><{tag}><p>{prose(i, 40)}</p></{tag}></body>" for i in range(8)]
        pages.append(f"<body><{tag}><p>short</p></{tag}><p>between</p><{tag}><p>{prose(8, 40)}</p></{tag}></body>")
        assert read_all(pages)[8] == f"short\nbetween\n{prose(8, 40)}"


def test_a_title_outside_the_article_is_kept_and_a_page_with_a_quoted_article_stays_whole():
    pages = [f"<body><h1>Title {i}</h1><article><p>{prose(i, 40)}</p></article></body>" for i in range(8)]
    assert read_all(pages)[3] == f"Title 3\n{prose(3, 40)}"
    pages = [f"<div><p>{prose(i, 40)}</p></div>" for i in range(8)] + ["<div><p>before</p><article><p>quoted</p></article></div>"]
    assert read_all(pages)[8] == "before\nquoted"


def test_names_that_only_hold_a_listed_word_are_content():
    for page, want in [
        ("<div id=page class=no-sidebar><p>all</p></div>", "all"),
        ("<div class='content has-sidebar'><p>all</p></div>", "all"),
        ("<div class=article-header><h1>Title</h1></div><p>text</p>", "Title\ntext"),
        ("<article><div class=entry-header><h1>Title</h1></div><div class=header>Lead</div><p>text</p></article>", "Title\nLead\ntext"),
        ("<p>text</p><div class=related-work>others</div><div class=side-effects>few</div>", "text\nothers\nfew"),
        ("<h2 id=discussion>Discussion</h2><section id=discussion><p>text</p></section>", "Discussion\ntext"),
        ("<article class=commentary><p>text</p></article>", "text"),
        ("<article data-id=comments><p>text</p><div class=comments>c</div></article>", "text"),
    ]:
        assert html_extract.main_text(page, None) == want


def test_whole_names_of_other_parts_are_left_out():
    for mark in ("class=sidebar", "class='x ad'", "id=comments", "class=site-footer", "class=ad-banner", "role=navigation", "class=related-posts", "id=ad-3"):
        assert html_extract.main_text(f"<p>text</p><div {mark}>other</div>", None) == "text"
    assert html_extract.main_text("<p>text</p><section class=comments>c</section><article class=comment>c</article>", None) == "text"


def texts(spark, pages):
    rows = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    return {r["page_id"]: r["text"] for r in rows}


def test_template_is_counted_over_all_distinct_pages(spark):
    notice = "<p>A notice of the site</p>"
    pages, want = [], {}
    for i in range(40):  # a quarter of the site, and so some sampled page, lacks the notice
        pages.append((i, "http://large/", f"<body>{'' if i % 4 == 0 else notice}<p>{prose(i, 30)}</p></body>"))
        want[i] = prose(i, 30)
    for i in range(100, 104):  # a host of four distinct pages
        pages.append((i, "http://few/", f"<body>{notice}<p>{prose(i, 30)}</p></body>"))
        want[i] = prose(i, 30)
    for i in range(200, 300):  # copies of one page outnumber the six others
        n = i if i < 206 else 0
        pages.append((i, "http://copies/", f"<body>{notice}<p>{prose(n, 30)}</p></body>"))
        want[i] = prose(n, 30)
    for i in range(400, 402):  # too few to tell
        pages.append((i, "http://two/", f"<body>{notice}<p>{prose(i, 30)}</p></body>"))
        want[i] = f"A notice of the site\n{prose(i, 30)}"
    assert texts(spark, pages) == want


def test_near_copies_keep_their_common_text(spark):
    pages = [(i, "http://h/", f"<body><article><h1>Title</h1><p>{prose(1, 40)}</p><p>{prose(2, 40)}</p><p>Version {i}</p></article></body>") for i in range(10)]
    assert texts(spark, pages) == {i: f"Title\n{prose(1, 40)}\n{prose(2, 40)}\nVersion {i}" for i in range(10)}


def test_pages_are_told_apart_by_html_not_by_id(spark):
    pages = [(7 if i % 2 else None, "http://h/", f"<body><p>A notice of the site</p><p>{prose(i, 30)}</p></body>") for i in range(6)]
    rows = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert sorted(r["text"] for r in rows) == sorted(prose(i, 30) for i in range(6))


def page_of(i, body, menu="div"):
    """A page without any name or tag that tells its parts apart."""
    links = "".join(f"<{menu}><a href=/{w}>{w}</a></{menu}>" for w in prose(500 + i, 6).split())
    return f"<body><div class=a>{links}</div><div class=b>{prose(600 + i, 4)}</div><div class=c>{body}</div><div class=d>Site {prose(700 + i, 3)}</div></body>"


def test_slots_alone_choose_the_container():
    bodies = [f"<h1>Title {i}</h1><p>{prose(i, 60 + 10 * i)}</p><p>{prose(50 + i, 30)}</p>" for i in range(8)]
    pages = [page_of(i, b) for i, b in enumerate(bodies)]
    want = [f"Title {i}\n{prose(i, 60 + 10 * i)}\n{prose(50 + i, 30)}" for i in range(8)]
    wrappers = html_extract.ready(json.dumps(html_extract.induce(pages, marks=False)))
    assert wrappers[0]["container"] == ["body", "div.c"]
    assert [html_extract.main_text(p, wrappers, marks=False) for p in pages] == want
    assert all(html_extract.main_text(p, None, marks=False) != w for p, w in zip(pages, want))


def test_small_unmarked_parts_outside_the_container_are_left_out_and_large_ones_kept():
    pages = [page_of(i, f"<h1>Title {i}</h1><p>{prose(i, 200)}</p>") for i in range(8)]
    assert read_all(pages) == [f"Title {i}\n{prose(i, 200)}" for i in range(8)]
    pages = [f"<body><div class=lead>{prose(900 + i, 20)}</div><div class=c><p>{prose(i, 100)}</p></div></body>" for i in range(8)]
    assert read_all(pages) == [f"{prose(900 + i, 20)}\n{prose(i, 100)}" for i in range(8)]


def test_a_host_with_two_templates_has_two_wrappers():
    one = [page_of(i, f"<h1>Title {i}</h1><p>{prose(i, 200)}</p>") for i in range(4)]
    two = [f"<body><table><tr><td class=x><a href=/a>{prose(800 + i, 5)}</a></td><td class=y><p>{prose(i, 90)}</p></td></tr></table></body>" for i in range(4)]
    pages = [p for both in zip(one, two) for p in both]
    assert len(html_extract.induce(pages)) == 2
    got = read_all(pages)
    assert got[::2] == [f"Title {i}\n{prose(i, 200)}" for i in range(4)]
    assert [t.split("\n")[-1] for t in got[1::2]] == [prose(i, 90) for i in range(4)]


def test_all_members_of_a_run_are_aligned():
    same = "<ul><li>Home</li><li>News</li></ul>"
    trees = [html_extract.Slot("#root", [html_extract.parse(f"<body>{same}<ul><li>Home</li><li>{prose(i, 3)}</li></ul></body>")]) for i in range(3)]
    lists = trees[0].below[0].below[0]
    assert len(lists.nodes) == 2 and len(lists.below[0].nodes) == 4
    assert id(lists.below[0]) not in html_extract.constants(trees)[0]  # the last item of the run varies
    trees = [html_extract.Slot("#root", [html_extract.parse(f"<body>{same}<p>{prose(i, 3)}</p></body>")]) for i in range(3)]
    fixed = html_extract.constants(trees)[0]
    assert id(trees[0].below[0].below[0].below[0]) in fixed and id(trees[0].below[0].below[1]) not in fixed


def test_very_many_differing_children_are_matched_in_bounded_time():
    pages = ["<body><div>" + "".join(f"<p class=x{'abcdefghij'[(j * k) % 10]}{'klmnop'[j % 6]}>{j} {i}</p>" for j in range(3000)) + "</div></body>" for i, k in ((0, 1), (1, 3), (2, 7))]
    assert read_all(pages) == ["\n".join(f"{j} {i}" for j in range(3000)) for i in range(3)]


def test_awkward_pages(spark):
    pages = [(0, None, None), (1, None, ""), (2, "http://h/", "<p>cut off <b"), (3, "http://h/", "no tags at all"), (4, "not a url", "<div>" * 3000 + "deep"), (None, "http://h/", "<p>a &amp; b</p>")]
    rows = html_extract.extract(spark.createDataFrame(pages + pages, "page_id long, url string, html string")).collect()
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["text"], r["n_chars"]) for r in rows) == sorted([(0, "", 0), (1, "", 0), (2, "cut off", 7), (3, "no tags at all", 14), (4, "deep", 4), (-1, "a & b", 5)] * 2)
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_headings_that_recur_in_articles_are_kept(spark):
    pages = [(i, "http://h/", f"<body><div class=box><h1>Title {i}</h1><h2>Summary</h2><p>{prose(i, 20)}</p><h2>References</h2><p>{prose(50 + i, 30)}</p></div></body>") for i in range(8)]
    assert texts(spark, pages) == {i: f"Title {i}\nSummary\n{prose(i, 20)}\nReferences\n{prose(50 + i, 30)}" for i in range(8)}


def test_unmarked_notices_go_however_large_they_are(spark):
    notice = "".join(f"<p>{prose(900 + k, 25)}</p>" for k in range(3))
    for box in (f"<div>{notice}</div>", f"<div><h3>Our rules</h3>{notice}</div>", notice):
        pages = [(i, "http://h/", f"<body><div class=box><h2>{prose(700 + i, 3)}</h2><p>{prose(i, 6)}</p>{box}</div></body>") for i in range(8)]
        assert texts(spark, pages) == {i: f"{prose(700 + i, 3)}\n{prose(i, 6)}" for i in range(8)}


def plain_match(left, right, weight):
    best = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i, x in enumerate(left, 1):
        for j, y in enumerate(right, 1):
            best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + (weight(x, y) if x.signature == y.signature else 0))
    return best[-1][-1]


def test_matching_is_as_heavy_as_the_whole_table_gives():
    import random

    draw = random.Random(3)
    for _ in range(60):
        left, right = ([html_extract._bare(html_extract.Node(draw.choice("abcdef"[: draw.randint(1, 6)]))) for _ in range(draw.randint(0, 14))] for _ in range(2))
        weights = {(id(x), id(y)): draw.randint(1, 9) for x in left for y in right}
        weight = lambda x, y: weights[id(x), id(y)]
        total, pairs = html_extract._pairs(left, right, weight)
        assert total == plain_match(left, right, weight) == sum(weight(left[i], right[j]) for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:])) and all(left[i].signature == right[j].signature for i, j in pairs)


def test_long_lists_of_unlike_children_are_matched_whole():
    for n, m in ((400, 500), (500, 600), (3000, 3000)):
        trees = [html_extract.Slot("#root", [html_extract.parse("<body>" + "".join(f"<p class={'abcdefghij'[j % 10]}{'klmnop'[j // 10 % 6]}{'qrstuvwxyz'[j // 60 % 10]}{'ABCDE'[j // 600 % 5]}>{j}</p>" for j in range(k)) + "</body>")]) for k in (n, m)]
        assert html_extract.align(*trees)[0] == 2 + n


def test_own_blocks_are_those_without_a_path():
    pages = ["<p>a<b>b</b>c<div>d<a href=x>e</a></div>f<br>g</p>h", "<div><span>x<div>y</div>z<a>link <i>two</i></a></span><nav>n</nav>t</div>", "<article><header>h</header>own</article>", "a<script>s</script>b<button>c</button>d"]
    for page in pages:
        todo = [html_extract.parse(page)]
        while todo:
            node = todo.pop()
            todo += [c for c in node.children if isinstance(c, html_extract.Node)]
            for marks in (True, False):
                assert html_extract.own_blocks(node, marks) == [(t, n) for path, t, n in html_extract.blocks(node, marks=marks) if not path]


def test_deeply_nested_pages_cost_their_length():
    import time

    took = []
    for n in (1500, 6000):
        began = time.perf_counter()
        html_extract.induce([f"<body>{'<div>' * n}{prose(i, 20)}</body>" for i in range(3)])
        took.append(time.perf_counter() - began)
    assert took[1] < 3.0


def test_a_rare_template_of_a_large_host_has_a_wrapper_of_its_own(spark):
    pages = [(i, "http://h/", f"<body><div class=main><h1>Title {i}</h1><p>{prose(i, 40)}</p></div></body>") for i in range(60)]
    pages += [(i, "http://h/", page_of(i, f"<h1>Title {i}</h1><p>{prose(i, 200)}</p>")) for i in range(60, 64)]
    assert texts(spark, pages) == {i: f"Title {i}\n{prose(i, 40 if i < 60 else 200)}" for i in range(64)}


def test_parts_of_few_pages_decide_no_container(spark):
    pages = [(i, "http://h/", page_of(i, f"<h1>Title {i}</h1><p>{prose(i, 200)}</p>").replace("</body>", f"<p>Erratum {i}</p></body>" if i in (3, 17) else "</body>")) for i in range(40)]
    assert texts(spark, pages) == {i: f"Title {i}\n{prose(i, 200)}" + (f"\nErratum {i}" if i in (3, 17) else "") for i in range(40)}
