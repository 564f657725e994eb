"""Main text of pages with known articles, and the wrapper algebra."""

import random
import time

from textloom.llm.html_extract import align, blocks, expression, extract_text, matching_blocks, slots_of, stream


def page(title, paragraphs, extra=""):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p {{}}</style></head><body><header><h1>Site</h1></header>"
        f"<nav><ul><li><a href='/'>Home</a></li></ul></nav><article><h1>{title}</h1>{body}</article>{extra}"
        "<div class=\"comments\"><p>first!</p></div><aside><p>more</p></aside><form><p>mail?</p></form>"
        "<script>var p = '<p>no</p>';</script><footer><p>imprint</p></footer></body></html>"
    )


def plain(title, paragraphs):
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<html><body><div id='menu'>Menu</div><div><p>Welcome to our site of stories</p><h2>{title}</h2>{body}</div><div class='ad-slot ads'>Buy</div></body></html>"


def test_articles_come_out_whole(spark):
    draw = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        paragraphs = [" ".join(draw.choice(["one", "two", "three"]) + str(draw.randrange(99)) for _ in range(draw.randrange(3, 30))) for _ in range(draw.randrange(1, 6))]
        maker = page if k % 2 else plain
        rows.append((k, f"http://h{k % 2}.org/{k}", maker(f"Title {k}", paragraphs)))
        want[k] = "\n".join([f"Title {k}", *paragraphs])
    rows += [(100, None, None), (101, "http://h1.org/e", ""), (102, "http://h1.org/x", page("T &amp; <b>U</b>", ["a&nbsp;&eacute; \n\t b<br>c", "", "&#x1F4A1; d"])), (103, "u", "plain &lt;text&gt;")]
    want |= {100: "", 101: "", 102: "T & U\na é b c\n💡 d", 103: "plain <text>"}
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["text"] == want[r["page_id"]], r["page_id"]
        assert r["n_chars"] == len(r["text"])


def test_wrappers_repeat_and_lack():
    one, two = stream(blocks(page("a", ["x", "y", "z"]))), stream(blocks(page("a", ["x"])))
    assert "article/p:2+" in expression(align(one, two))
    assert expression(align(one, one)) == expression(one)
    lacking = stream(blocks("<article><h1>t</h1></article>"))
    assert "?" in expression(align(one, lacking))


def test_edges(spark):
    schema = "page_id long, url string, html string, text string, host string"
    assert extract_text(spark.createDataFrame([], schema)).count() == 0
    long_ = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    rows = [(None, None, None, None, None), (1, "http://a.b/", "<p>x", "t", "h"), (1, "http://a.b/", "<p>x", "t", "h"), (2, "http://a.b/", long_, None, None), (3, "http://a.b/", "<div <p>>", None, None)]
    found = extract_text(spark.createDataFrame(rows, schema)).collect()
    assert len(found) == 5
    assert {r["n_chars"] for r in found if r["page_id"] == 2} == {5 * 20_000 - 1}


def test_pages_that_the_marks_do_not_fit(spark):
    rows, want = [], {}

    def add(url, html, text):
        rows.append((len(rows), url, html))
        want[len(rows) - 1] = text

    # A host of mixed pages, most with an article; a host of two pages; equal pages.
    for k in range(20):
        add("http://mixed.org/", f"<article><p>own {k}</p></article>", f"own {k}")
    for k in range(6):
        add("http://mixed.org/", f"<div>Our offices are closed</div><p>story {k}</p>", f"story {k}")
    for k in range(2):
        add("http://two.org/", f"<div>Our offices are closed</div><p>story {k}</p>", f"story {k}")
        add("http://same.org/", "<p>one story</p>", "one story")
    # Articles inside layouts, not in what stands apart from the article.
    for n, wrapper in enumerate(("<div class='layout has-sidebar'>", "<form id=page>", "<section class='with-menu'><div class='share-layout'>")):
        add(f"http://l{n}.org/", f"{wrapper}<p>side</p><article><header><h1>t</h1></header><p>in</p><div class=share>s</div></article>", "t\nin")
    add("http://l7.org/", "<div class=sidebar><article>teaser</article></div><main><p>in</p></main>", "in")
    add("http://l8.org/", "<div class=comments><article>first!</article></div><p>story</p>", "story")
    # Linked paragraphs among others, and a slot of links.
    add("http://links.org/", "<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><p><a href=c>a linked paragraph</a></p><p>and a much longer one that is not linked</p>", "a linked paragraph\nand a much longer one that is not linked")
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == want


def test_the_wrapper_decides_where_names_mean_nothing(spark):
    rows, want = [], {}
    draw = random.Random(8)

    def prose(n):
        return " ".join(draw.choice("abcdefgh") * draw.randrange(1, 8) for _ in range(n))

    for k in range(30):
        paragraphs = [prose(draw.randrange(20, 60)) for _ in range(draw.randrange(1, 5))]
        again = "<section class=q8><p>We never close. Call us any time.</p></section>" if k % 3 else ""
        remarks = "".join(f"<div><p>{prose(4)}</p></div>" for _ in range(draw.randrange(3)))
        rows.append((k, f"http://plain.org/{k}", (
            f"<div class=q1>Home About Contact {k % 2}</div><div class=q2><div><p>Good news, every day</p></div><div class=q7><h2>Story {k}</h2>"
            f"{''.join(f'<p>{p}</p>' for p in paragraphs)}</div>{again}</div><div class=q3>{remarks}</div><div>All rights reserved</div>"
        )))
        want[k] = "\n".join([f"Story {k}", *paragraphs])
    # Of an article: what all pages repeat goes, unless the pages are copies.
    for k in range(12):
        rows.append((100 + k, f"http://art.org/{k}", f"<article><p>Read this in our app</p><h1>t{k}</h1><div class='share-prices'>{prose(9)} {k}</div><p class='tag-menu-x'>About us all</p></article>"))
        want[100 + k] = None
        rows.append((200 + k, f"http://copy.org/{k}", f"<p>visit {k}</p><article><p>the very same story</p><p>{k}</p></article>"))
        want[200 + k] = f"the very same story\n{k}"
    for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        if want[r["page_id"]] is None:
            lines = r["text"].split("\n")
            assert len(lines) == 2 and lines[0] == f"t{r['page_id'] - 100}" and lines[1].endswith(f" {r['page_id'] - 100}")
        else:
            assert r["text"] == want[r["page_id"]], r["page_id"]


def test_names_that_say_more_than_a_mark(spark):
    pages = [
        ("<article class='comment-free'><p>in</p></article>", "in"),
        ("<article><div class='share-price-table'><p>Share prices rose</p></div><p class='notice-period'>two weeks</p><div class='comment-list'><p>first!</p></div></article>", "Share prices rose\ntwo weeks"),
        ("<article><p>in</p></article><script>var x = 1; <p>no</p>", "in"),
        ("<article><p>in</p><style>p {", "in"),
        ("<article><p>in</p><!-- never ends <p>no</p>", "in"),
        ("<article><p>a <button>Share<span>it</span></button> b</p><select><option>1</option></select></article>", "a b"),
        ("<article><p data-note=\"<b>no</b>\">x < y</p></article>", "x < y"),
    ]
    rows = [(k, f"http://n{k}.org/", html) for k, (html, _) in enumerate(pages)]
    found = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found == {k: text for k, (_, text) in enumerate(pages)}


def test_odd_pages_take_linear_time():
    for part in ("<button>", '<a "', "<p", "<a '<>'", "<!--", "</p>", "<div>a</p>"):
        began = time.process_time()
        blocks(part * 100_000)
        small = time.process_time() - began
        assert small < 20
        began = time.process_time()
        blocks(part * 400_000)
        assert time.process_time() - began < 12 * small + 1, part


def test_slots_follow_the_wrapper():
    one, two = stream(blocks("<div>m</div><h1>t</h1><p>a</p><p>b</p><div>f</div>")), stream(blocks("<div>m</div><p>a</p>"))
    wrapper = align(one, two)
    assert expression(wrapper) == "div:1 h1:1? p:1+ div:1?"
    assert slots_of(one, wrapper) == ["0", "1", "2", "3"] and slots_of(two, wrapper) == ["0", "2"]


def test_names_do_not_overrule_an_article(spark):
    """Inside an article names of its own parts say nothing, and marks around all of its text neither;
    adverts, comments, forms and asides go."""
    parts = [
        ("<div class='content-header'><h1>The Title {k}</h1></div><p>Body {k} of it.</p>", "The Title {k}\nBody {k} of it."),
        ("<header class='post-header'><h1>The Title {k}</h1></header><p>Body {k}.</p>", "The Title {k}\nBody {k}."),
        ("<div class='social'><p>One {k}.</p><p>Two {k}.</p></div>", "One {k}.\nTwo {k}."),
        ("<p>Text {k}.</p><div class='comments'><p>reader {k}</p></div><div class='ad-box'>buy {k}</div><ul class='comment-list'><li>c {k}</li></ul><aside>a {k}</aside><form>f</form>", "Text {k}."),
    ]
    rows, want = [], {}
    for h, (html, text) in enumerate(parts):
        for k in range(10):
            rows.append((100 * h + k, f"http://h{h}.example/p{k}", f"<html><body><nav>menu</nav><article>{html.format(k=k * 7 + 1)}</article><footer>foot</footer></body></html>"))
            want[100 * h + k] = text.format(k=k * 7 + 1)
    found = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["text"] for r in found} == want


def test_long_pages_are_aligned_like_short_ones():
    # 360,000 pairs of places: these were once not aligned by place, but by token alone.
    one = [[f"p{k}:1", False, False] for k in range(600)]
    two = one[:300] + [["h2:1", False, False]] + one[301:]
    wrapper = align(one, two)
    assert [i[0] for i in wrapper[299:303]] == ["p299:1", "p300:1", "h2:1", "p301:1"]
    assert [i[2] for i in wrapper[299:303]] == [False, True, True, False]
    assert slots_of(two, wrapper)[300] == "301"


def test_blocks_are_those_of_difflib_at_any_length():
    from difflib import SequenceMatcher

    draw = random.Random(3)
    for n, m, kinds in ((300, 500, 3), (900, 700, 6), (40, 2000, 2)):
        one, two = ([draw.choice("abcdefgh"[:kinds]) for _ in range(k)] for k in (n, m))
        kept = [t for t in one if draw.random() < 0.9]
        for other in (two, kept, kept * 2):
            plain = SequenceMatcher(None, one, other, autojunk=False).get_matching_blocks()
            assert matching_blocks(one, other) == [tuple(b) for b in plain if b[2]]


def test_tables_on_the_way_are_compressed_and_texts_of_slots_counted_once(spark, monkeypatch):
    # The largest table, of all texts, and a second count of them took 1.63 x the input on disk.
    import glob

    import pyarrow.parquet as pq

    from textloom.llm import html_extract

    put, seen = html_extract.Shelf.put, {}

    def spied(shelf, df, name):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        out = put(shelf, df, name)
        codecs = {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in glob.glob(f"{shelf.root}/{name}/*.parquet") if pq.read_metadata(f).num_rows}
        seen[name] = (plan.count("Generate explode"), codecs)
        return out

    monkeypatch.setattr(html_extract.Shelf, "put", spied)
    rows = [(k, f"http://h.org/{k}", page(f"Title {k}", [f"text {k} of its own"])) for k in range(12)]
    got = extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r["page_id"]: r["text"] for r in got.collect()} == {k: f"Title {k}\ntext {k} of its own" for k in range(12)}
    assert seen["parsed"][1] == {"ZSTD"}
    assert sum(n for n, _ in seen.values()) == 1
