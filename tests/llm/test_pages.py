import random

import pytest

from trailmark.llm import pages


def extract(html):
    return "\n".join(t for region, _, t in pages.blocks(html) if region != pages.DROPPED)


def test_structure():
    assert extract("<body><nav>Menu</nav><article><h1>T &amp; x</h1><p>a\n <b>b</b><br>c<p>d</article><footer>f</footer>") == "T & x\na b c\nd"
    assert extract("<div class='sidebar'>s</div><main><p>x</p><aside>y</aside><form>z</form><div id=comments>w</div></main>") == "x"
    assert extract("<script>var t='</p>';</script><style>p{}</style><p>only</p><!-- no -->") == "only"
    assert extract("<p>one<div class=ad>buy</div>two") == "one\ntwo"
    assert extract("") == "" and extract("plain") == "plain" and extract("<p>x&nbsp;y &#233;</p>") == "x y é"
    assert extract("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a\nb\nc\nd"
    assert extract("<article>" + "<div>" * 3000 + "deep") == "deep"
    assert extract("<p>x" + "<div>" * 3000 + "<nav>menu</nav>" + "</div>" * 3000 + "y") == "x\ny"
    assert extract("<ul><li>a<ul><li>b<p>c<li>d</ul>e<li>f</ul>") == "a\nb\nc\nd\ne\nf"
    assert len(extract("<p><b>x" * 20_000).split("\n")) == 20_000


def brute(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@pytest.mark.parametrize("most", [pages.MOST_BITS, 4])
def test_alignment(monkeypatch, most):
    monkeypatch.setattr(pages, "MOST_BITS", most)
    r = random.Random(4)
    for n in [12] * 300 + [100] * 10:
        a, b = ([r.randint(0, 4 if n == 12 else 30) for _ in range(r.randint(0, n))] for _ in range(2))
        found = pages.shared_lines(a, b)
        assert len(found) == brute(a, b) and found == sorted(set(found))
        rest = iter(b)
        assert all(a[i] in rest for i in found)


def test_long_pages_are_aligned_whole():
    head, own, other = list(range(500)), list(range(1000, 1700)), list(range(2000, 2250))
    found = pages.shared_lines([*own, *head, 7, *own], [*other, *head, 7])
    assert found == [*range(700, 1201)]


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], "page_id long, url string, html string, key string, lines int")


@pytest.mark.parametrize("most", [pages.MOST_BROADCAST, -1])
def test_differencing(spark, monkeypatch, most):
    monkeypatch.setattr(pages, "MOST_BROADCAST", most)
    page = lambda body: f"<div>Site name</div><div>Follow us</div>{body}<div>Imprint</div>"
    rows = [(1, "http://a.org/x/1", page("<p>one</p>")), (2, "http://a.org/x/2", page("<p>two</p>")), (3, "http://b.org/", page("<p>alone</p>")), (4, None, None), (5, "http://c.org/1", "")]
    rows += [(6, "http://d.org/1", "<article><p>same</p></article>"), (7, "http://d.org/2", "<article><p>same</p></article>"), (7, "http://d.org/2", "<article><p>same</p></article>"), (None, "http://e.org", "<p>x</p>")]
    for parts in (1, 6):
        out = sorted((-1 if r.page_id is None else r.page_id, r.text) for r in pages.main_text(frame(spark, rows).repartition(parts)).collect())
        assert out == [(-1, "x"), (1, "one"), (2, "two"), (3, "Site name\nFollow us\nalone\nImprint"), (4, ""), (5, ""), (6, "same"), (7, "same"), (7, "same")]
    assert pages.main_text(frame(spark, rows).limit(0)).count() == 0


def test_neighbours_across_ranges(spark):
    rows = [(i, f"http://h.org/{i:03}", f"<div>shared head</div><p>text {i}</p>") for i in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = pages.main_text(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r.text for r in out) == sorted(f"text {i}" for i in range(40))


def generated(host, n, seed, marked):
    """(url, html, article) of a host whose template has names that say nothing, and of which only some lines repeat from page to page."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    menu, out = [word() for _ in range(6)], []
    for i in range(n):
        items = "".join(f"<div class=x{host}q>{t}</div>" for t in [*menu, *([word()] if i % 6 == 0 else [])])
        body = [" ".join(word() for _ in range(12)) for _ in range(r.randint(1, 6))]
        text = "".join(f"<p>{t}</p>" for t in body)
        out.append((f"http://h{host}.org/{i % 3}/{i:03}", f"<body><section>{items}</section>{'<article>' * marked}{text}{'</article>' * marked}<section class=z>{menu[0]} and {menu[1]}</section></body>", "\n".join(body)))
    return out


def brute_text(rows):
    """What pairing, alignment and the two tests of a path give, over generated pages, without Spark."""
    found = {}
    for url, html, _ in rows:
        found.setdefault(url.split("/")[2], []).append((url.split("/", 3)[3], pages.blocks(html)))
    out = []
    for host in found.values():
        host.sort(key=lambda x: x[0])
        shared, paths = [], {}
        for k, (url, lines) in enumerate(host):
            near = [host[j] for j in (k - 1, k + 1) if 0 <= j < len(host)]
            common = lambda x: next((i for i, (a, b) in enumerate(zip(url, x[0], strict=False)) if a != b), min(len(url), len(x[0])))  # noqa: B023, E731
            best = max(near, key=common, default=None)
            own = {i for i in pages.shared_lines([hash(t) for *_, t in lines], [hash(t) for *_, t in best[1]]) if lines[i][0] != pages.ARTICLE} if best else set()
            shared.append(own)
            for i, (region, path, _) in enumerate(lines):
                if region != pages.ARTICLE:
                    n, s, r = paths.get(path, (0, 0, 0))
                    paths[path] = (n + 1, s + (i in own), max(r, region))
        marks = {p for p, (n, s, r) in paths.items() if s and (r == pages.DROPPED or 100 * s >= pages.TEMPLATE_PERCENT * n)}
        out += ["\n".join(t for i, (region, path, t) in enumerate(lines) if region != pages.DROPPED and not (region == pages.OPEN and (i in own or path in marks))) for (_, lines), own in zip(host, shared, strict=True)]
    return sorted(out)


@pytest.mark.parametrize("marked", [0, 1])
def test_differencing_decides_on_generated_hosts(spark, monkeypatch, marked):
    rows = [x for h in range(4) for x in generated(h, 18, h, marked)]
    df = frame(spark, [(i, u, h) for i, (u, h, _) in enumerate(rows)]).repartition(3)
    out = pages.main_text(df).collect()
    assert {r.page_id: r.text for r in out} == {i: a for i, (*_, a) in enumerate(rows)} and sorted(r.text for r in out) == brute_text(rows)
    assert sum(r.n_template for r in out) >= 7 * len(rows) and sum(r.n_structure for r in out) == 0
    monkeypatch.setattr(pages, "shared_lines", lambda own, other: [])
    off = pages.main_text(df).collect()
    assert sum(r.n_template for r in off) == 0
    if marked:
        assert sum(r.n_structure for r in off) >= 7 * len(rows)
    else:
        assert all(r.text != rows[r.page_id][2] for r in off)


@pytest.mark.parametrize("part", ["<a ", '<a "', '<a ">" ', "<a x='>' ", "<p <", "<!-- ", "</", "<a x=\"> "])
def test_open_tags_and_quotes_take_linear_time(part):
    import time

    began = time.perf_counter()
    pages.blocks("<p>text</p>" + part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 5


def test_text_after_the_last_tag():
    assert extract("<p>x</p>a < b <c &amp; d") == "x\na < b <c & d"
    assert extract("<p>x</p>a <!-- b") == "x\na"
    assert extract("<p title='a>b'>x</p><p title='>y</p>z") == "x\ny\nz"


def test_copies_are_not_their_own_template(spark):
    rows = [(i, f"http://m.org/{i}", "<div>head</div><p>the one text</p>") for i in range(3)] + [(3, "http://m.org/9", "<div>head</div><p>another</p>")]
    assert sorted(r.text for r in pages.main_text(frame(spark, rows)).collect()) == ["another", *["the one text"] * 3]
