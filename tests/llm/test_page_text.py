import random

from crewframe.llm import page_text as pt

PAGE = "page_id long, url string, html string"


def page(i, body, host="h.example", path=None):
    return (i, f"https://{host}/{path or f'en/{i}'}?x=1#top", f"<html><head><title>T</title></head><body>{body}</body></html>")


def texts(spark, rows):
    df = spark.createDataFrame(rows, PAGE).selectExpr("*", "'p' as path", "'d' as digest", "1 as host").repartition(3)
    out = pt.extract(df)
    assert set(df.columns) <= set(out.columns)
    return sorted(((r.page_id, r.text, r.n_chars) for r in out.collect()), key=repr)


def test_longest_common_subsequence():
    draw = random.Random(1)
    for size in (1 << 28, 8):
        pt.ALIGN_BITS = size
        for _ in range(300):
            a, b = ([draw.randrange(5) for _ in range(draw.randrange(12))] for _ in "ab")
            best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
            kept = pt.common(a, b)
            assert sum(kept) == best[-1][-1]
            rest = iter(b)
            assert all(x in rest for x, k in zip(a, kept) if k)
    pt.ALIGN_BITS = 1 << 28


def test_pieces_stay_a_common_subsequence(monkeypatch):
    monkeypatch.setattr(pt, "ALIGN_BITS", 1)
    draw = random.Random(2)
    a, b = [draw.randrange(40) for _ in range(500)], [draw.randrange(40) for _ in range(400)]
    kept = pt.common(a, b)
    rest = iter(b)
    assert sum(kept) > 20 and all(x in rest for x, k in zip(a, kept) if k)


def test_markup():
    html = """<!DOCTYPE html><body><!-- <p>no</p> --><nav><p>menu</p></nav><div class="cookie-notice">ok?</div>
    <article><h1>A &amp;  B</h1><p>one<b>two</b> <i>three</i><br>four<p>fi&eacute;ve <a href="x>y">link</a>
    <script>var s = "</p><p>no";</script><aside>side</aside><form><input><p>mail</p></form><div id=comments><p>nice!</p></div>
    <p hidden>gone</p><p style="display: none">gone</p><ul><li>x<li>y</ul></article><footer>&copy; f"""
    assert pt.main_text(html, None) == "A & B onetwo three four fiéve link x y"
    assert pt.main_text(None, None) == "" == pt.main_text("<<< <", None).replace("<", "").strip()
    assert pt.main_text("plain  text\n<", [1]) == "plain text <"
    assert pt.main_text("<form><article>in a form</article></form>", None) == "in a form"


def test_comments_and_sidebars_are_out_by_a_part_of_their_name():
    html = (
        '<article><p>text</p><div class="comment-list"><p>reader says</p></div><div class="sidebar-left">side</div>'
        '<div id="user_comments">more</div><div class="no-sidebar">kept</div><div id="related-work">own</div></article>'
    )
    assert pt.main_text(html, [1]) == "text kept own"
    assert pt.main_text(html, None) == "text"
    assert pt.main_text('<div class="top">menu</div><div class="article">the text</div><div>end</div>', None) == "the text"
    assert pt.main_text('<article class="post tag-sidebar comments">all of it</article>', None) == "all of it"


def test_columns_with_the_names_used_inside(spark):
    names = "__host __digest __lines host digest lines partner all path n_chars text we.ird".split()
    df = spark.createDataFrame([page(1, "<article>a</article>"), (2, None, None), page(3, "<p>b</p>")], PAGE)
    df = df.select("*", *[pt.F.lit(f"{n}!").alias(n) for n in names])
    got = pt.extract(df)
    assert got.columns == df.columns
    rows = {r["page_id"]: r for r in got.collect()}
    assert [rows[i]["text"] for i in (1, 2, 3)] == ["a", "", "b"] and rows[1]["n_chars"] == 1
    assert all(r[n] == f"{n}!" for r in rows.values() for n in names if n not in ("text", "n_chars"))


def test_shared_lines_of_near_pages_go(spark):
    frame = "<div>Welcome to us</div>{}<div>All rights with us</div><span>bottom</span>"
    rows = [page(i, frame.format(f"<p>Story {i}</p><p>Told once more {i}</p>")) for i in range(12)]
    rows += [page(100 + i, frame.format("<p>Story 1</p><p>Told once more 1</p>"), path=f"en/1{i}") for i in range(3)]
    rows += [page(200, frame.format("<p>alone</p>"), host="other")]
    got = {i: t for i, t, _ in texts(spark, rows)}
    assert all(got[i] == f"Story {i} Told once more {i}" for i in range(12))
    assert got[100] == "Story 1 Told once more 1"
    assert got[200] == "Welcome to us alone All rights with us bottom"


def test_articles_keep_what_they_share(spark):
    rows = [page(i, f"<nav>n</nav><article><p>Shared words</p><p>own {i}</p></article><p>foot</p>") for i in range(6)]
    assert [t for _, t, _ in texts(spark, rows)] == [f"Shared words own {i}" for i in range(6)]


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (2, "", ""), (None, "nonsense", "<p>a"), (3, "http://h/x", "<p>" + "long " * 50_000)]
    got = texts(spark, rows)
    assert [(i, n) for i, _, n in got] == [(1, 0), (1, 0), (2, 0), (3, 249_999), (None, 1)]
    assert texts(spark, []) == []


def test_neighbours_do_not_depend_on_the_tasks(spark):
    rows = [(f"h{i % 2}", f"/p/{i * 37 % 101}", str(i)) for i in range(100)] + [("h0", "/p/5", "9")]
    df = spark.createDataFrame(rows, "host string, path string, digest string")
    want = None
    for n in ("1", "7"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = sorted(map(tuple, pt.neighbours(df).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        want = want or got
        assert got == want and all(p is not None and p != d for _, d, p in got)


def test_the_difference_decides_on_weak_evidence(spark):
    body = (
        '<div class="site-banner-wrap"><p>Our site</p></div><div class="ad">buy {0}</div><p>Lead {0}</p>'
        '<article class="post tag-social"><p>Shared words</p><p>own {0}</p><div id="related-work"><p>Earlier work {0}</p></div>'
        '<div class="search-result"><p>Result {0}</p><p>Was this result good?</p></div></article><p>foot</p>'
    )
    rows = [page(i, body.format(i)) for i in range(6)] + [page(9, body.format(9), host="alone")]
    got = {i: t for i, t, _ in texts(spark, rows)}
    assert all(got[i] == f"Lead {i} Shared words own {i} Earlier work {i} Result {i}" for i in range(6))
    assert got[9] == "Shared words own 9"


def test_names_of_an_article_do_not_make_it_chrome():
    for name in ('class="post tag-social"', 'class="category-notice"', 'id="no-sidebar"', 'class="widget"'):
        assert pt.main_text(f"<p>foot</p><article {name}><p>text</p></article>", None) == "text"
    assert pt.main_text("<p>foot</p><article hidden><p>text</p></article>", None) == "foot"


def test_long_pages_are_aligned_exactly(monkeypatch):
    draw = random.Random(3)
    a, b = [draw.randrange(60) for _ in range(700)], [draw.randrange(60) for _ in range(900)]
    best = sum(pt.common(a, b))
    # an early entry that the other has at its end is no reason to lose the rest
    late = [7, *range(1000, 1063), *range(100, 400)], [*range(100, 400), 7]
    monkeypatch.setattr(pt, "ALIGN_BITS", 64)
    kept = pt.common(a, b)
    rest = iter(b)
    assert sum(kept) == best and all(x in rest for x, k in zip(a, kept) if k)
    assert sum(pt.common(*late)) == 300
