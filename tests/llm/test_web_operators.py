"""Pages and WARC records."""

import random
import time

import duckdb
import pytest

CASES = [
    ("<html><body><nav><a href=1>Home</a></nav><article><h1>Title</h1><p>One <b>two<br>three</b> &lt;x&gt; &amp &eacute;.<p>Next\n  line here.</p></article><footer>foot</footer></body></html>", "Title\n\nOne two three <x> & é.\n\nNext line here."),
    ("<body><div class='top-nav'><a href=x>Home</a></div><div id=cookie-notice>We use cookies.</div><div class='content post-12'><p>First paragraph with words.</p><ul><li>item one goes here<li>item two goes here</ul></div><div id=comments><p>Nice post, I liked it a lot indeed.</p></div></body>", "First paragraph with words.\n\nitem one goes here\n\nitem two goes here"),
    ("just text", "just text"), ("", ""), ("<script>var a='<p>no</p>';</script><style>p{}</style><p>Yes, this is it.</p>", "Yes, this is it."), ("<p>a<b>c</p>d", "ac\n\nd"),
    ("<div><form><p>Your name please, dear reader.</p></form><aside>More things to read on this site.</aside><p>Body text is right here.</p></div>", "Body text is right here."),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_extract(page, text):
    from tripforge.llm.html_extract import extract

    assert extract(page, None) == text


STORY = "<h1>A title here</h1><p>The first paragraph of the story, of some length.</p><p>The second paragraph of the story, longer still.</p>"


@pytest.mark.parametrize("page", [
    f"<body><form id=aspnetForm><div id=wrap>{STORY}</div></form></body>", f"<body><div class='content has-sidebar'>{STORY}</div></body>", f"<body><div class='no-footer'>{STORY}</div></body>",
    f"<body><div class='layout-with-header'>{STORY}</div></body>", f"<body><div class='widget-content'>{STORY}<div class=sidebar><p>More for you to read here.</p></div></div></body>",
    f"<body><article><div class='article-header'>{STORY[:21]}</div>{STORY[21:]}</article></body>", f"<body><div class=comments>{STORY}</div></body>",
    f"<body><div id=wrap>{STORY}</div><div class=comments>{'<p>A reader writes at great length.</p>' * 20}</div></body>",
])
def test_wrappers_with_marked_names_keep_the_story(page):
    from tripforge.llm.html_extract import extract

    assert extract(page, None) == "A title here\n\nThe first paragraph of the story, of some length.\n\nThe second paragraph of the story, longer still."


INSIDE = "<h1>A title here</h1><p>The first paragraph of the story, of some length.</p>"


@pytest.mark.parametrize(("block", "stays"), [
    ("<div class='search-results-study'><p>What the study of search results has found is told here.</p></div>", True), ("<div class='ad'><p>Buy these things now, they are cheap.</p></div>", False),
    ("<div class='banner-of-the-king'><p>The banner that the king carried was a red one.</p></div>", True), ("<div class='related-posts'><p>Another story that you could read now.</p></div>", False),
    ("<div class='social-studies'><a href=1>One link to another place</a> <a href=2>and one more</a></div>", False), ("<p>A <span class='search-term'>word</span> looked for.</p>", True),
    ("<div class='entry-header'><h2>A heading of the story</h2></div>", True), ("<div class='newsletter-signup'><p>Get our letters by mail every day.</p></div>", False),
])
def test_names_drop_only_furniture_inside_a_story(block, stays):
    from tripforge.llm.html_extract import extract

    for page, path in ((f"<body><article>{INSIDE}{block}</article></body>", None), (f"<body><div class=story>{INSIDE}{block}</div></body>", "body>div.story")):
        found = extract(page, path).split("\n\n")
        assert found[:2] == ["A title here", "The first paragraph of the story, of some length."] and len(found) == (3 if stays else 2)


LONG = "The council met on Tuesday and spoke at length of the bridge, the school and the river, and of what each of them would cost the town next year."


@pytest.mark.parametrize(("block", "text"), [
    ("<p class='alert'>Water levels are rising in the valley, officials said on Monday.</p>", "Water levels are rising in the valley, officials said on Monday."),
    ("<p>We know <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> here.</p>", "We know x=2 here."), ("<p>Seen <object data=x><param name=a>in the picture</object> above.</p>", "Seen in the picture above."),
    ("<div class='notice'><a href=1>Log in to read on</a></div>", None), ("<div class='responses'><p>I liked this story very much.</p></div>", None), ("<p>A <span class='alert'>word</span> of warning.</p>", "A word of warning."),
    (f"<p>{LONG}</p><ol>{'<li class=x1><b class=user>Ann</b> <time>May 5</time><p>I liked this story very much.</p></li>' * 2}</ol>", LONG),
    (f"<p>{LONG}</p><div>{'<div class=x1><h2>Another part</h2><i class=author>Ann</i> <time>May 5</time></div>' * 2}</div>", f"{LONG}\n\nAnother part\n\nAnn May 5\n\nAnother part\n\nAnn May 5"),
])
def test_blocks_inside_a_story_go_by_content(block, text):
    from tripforge.llm.html_extract import extract

    want = "A title here\n\nThe first paragraph of the story, of some length." + (f"\n\n{text}" if text else "")
    for page, path in ((f"<body><article>{INSIDE}{block}</article></body>", None), (f"<body><div class=story>{INSIDE}{block}</div></body>", "body>div.story")):
        assert extract(page, path) == want


def test_prose_off_the_winning_path_stays_where_there_is_more():
    from tripforge.llm.html_extract import extract

    page = f"<body><nav><a href=1>Home</a></nav><div class=a><p>A short first story.</p></div><div class=b><p>{LONG}</p></div><div class=ad><p>Buy these things now.</p></div></body>"
    assert extract(page, "body>div.a") == f"A short first story.\n\n{LONG}"
    same = f"<body><div class=a><p>{LONG}</p></div><div class=a><p>{LONG}</p></div></body>"
    assert extract(same, "body>div.a") == f"{LONG}\n\n{LONG}"
    assert extract(same.replace("<div class=a>", "<div class=b>", 1), "body>div.a") == f"{LONG}\n\n{LONG}"
    less = f"<body><div class=a><p>{LONG}</p></div><div class=b><p>A box that says something of this site.</p></div></body>"
    assert extract(less, "body>div.a") == LONG


LAYOUTS = [
    "<body><nav>{n}</nav><article>{s}</article><footer>{f}</footer></body>", "<body><div class=top-nav>{n}</div><div class=story-7>{s}</div><div class=footer>{f}</div></body>",
    "<body><main><div class=lead>{s}</div><aside>{f}</aside></main></body>", "<body><form id=f><div id=wrap>{s}</div></form><div class=sidebar>{f}</div></body>",
    "<body><table><tr><td class=menu>{n}</td><td>{s}</td></tr></table></body>", "<body><div class='content has-sidebar'>{s}</div><div id=comments>{c}</div></body>",
    "<body><div class=a><section>{s}</section></div><div class=cookie-notice>{f}</div></body>", "<body><div class=page><header>{n}</header><center>{s}</center></div><ul class=menu>{n}</ul></body>",
    "<body><article>{s}<div class=responses>{c}</div></article></body>", "<body><div class=post>{s}</div><ol class=thread>{c}</ol><div class=newsletter>{f}</div></body>",
]


def test_blocks_of_ten_layouts(spark):
    from tripforge.llm.html_extract import extract_pages

    rng, rows, want = random.Random(8), [], {}
    for k in range(400):
        host = k % 10
        blocks = [f"Part {k} {j} of the story says {' '.join(rng.choice(('river', 'bridge', 'town', 'school')) for _ in range(rng.randint(8, 40)))}." for j in range(rng.randint(2, 6))]
        marks = [rng.choice(("<p>", "<p class=alert>", "<blockquote>", "<p>")) for _ in blocks]
        story = "".join(f"{m}{b}</{m[1:].split('>')[0].split()[0]}>" for m, b in zip(marks, blocks, strict=True))
        talk = "".join(f"<li class=c{j}><b class=author>Ann</b> <time>May {j}</time><p>Reader {j} writes something here.</p></li>" for j in range(3))
        page = LAYOUTS[host].format(s=story, n="<a href=1>Home of it</a> <a href=2>News of it</a>", f="<p>All of this is the site's own, and not the story's.</p>", c=talk)
        rows.append((k, f"http://h{host}.example/{k}", page))
        want[k] = blocks
    hit = said = known = 0
    for row in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        found = set(row.text.split("\n\n"))
        hit, said, known = hit + len(found & set(want[row.page_id])), said + len(found), known + len(want[row.page_id])
    assert hit / known >= 0.99 and hit / said >= 0.97, (hit, said, known)


@pytest.mark.parametrize("page", ['<a "' * 250_000, "<a href='x" * 200_000, "<p class=\"" * 200_000, "<div>" * 100_000 + "</x>" * 100_000, "<i>" * 100_000, "<!--" * 100_000, "<" * 500_000, "</" * 200_000])
def test_broken_pages_take_linear_time(page):
    from tripforge.llm.html_extract import extract

    began = time.time()
    extract(page + "<p>The end of it all.</p>", "body>div")
    assert time.time() - began < 20


def test_unclosed_quotes_keep_the_text():
    from tripforge.llm.html_extract import extract

    assert extract("<p class=\"a>First words of it.</p><p>Second words of it.</p>", None) == "First words of it.\n\nSecond words of it."
    assert extract("<p title='x > y' class = z>Some text.</p><a href=\"u>v\">w</a>", None) == "Some text.\n\nw"


def test_vote_equals_plain_counting(spark):
    import math

    from tripforge.llm.html_extract import host_paths, vote

    rng = random.Random(6)
    rows = []
    for k in range(120):
        boxes = "".join(f"<div class=b{rng.choice('xyz')}{rng.randint(0, 9)}><p>{'Some words here. ' * rng.randint(1, 9)}</p></div>" for _ in range(rng.randint(1, 3)))
        rows.append((k, f"http://h{k % 7}/", f"<body>{boxes}</body>"))
    sums = {}
    for _, url, page in rows:
        path, score = vote(page)
        sums.setdefault(url[7:-1], {}).setdefault(path, []).append(math.log1p(score))
    want = {h: max((round(sum(v), 6), p) for p, v in by.items())[1] for h, by in sums.items()}
    assert {r.host: r.path for r in host_paths(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == want


def test_host_consensus_overrides_a_page(spark):
    from tripforge.llm.html_extract import extract_pages, host_paths

    good = "<body><div class='main-{}'><p>This is the story of the page number {}, told at length.</p></div><div class=extra><a href=x>Short one here for you</a> <a href=y>and another one</a></div></body>"
    odd = "<body><div class='main-9'><p>Tiny story.</p></div><div class=extra><p>This time the extra box is by far the longer of the two boxes on it.</p></div></body>"
    rows = [(i, f"https://WWW.host.example/{i}", good.format(i, i)) for i in range(5)] + [(9, "http://host.example:80/9", odd), (10, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.host: r.path for r in host_paths(pages).collect()} == {"host.example": "body>div.main-#"}
    text = {r.page_id: r.text for r in extract_pages(pages).collect()}
    assert text[9] == "Tiny story."
    assert text[3].startswith("This is the story of the page number 3")
    assert text[10] == ""


def test_canonical_urls(spark):
    from pyspark.sql import functions as F

    from tripforge.llm.warc import canonical_url

    cases = {
        "HTTP://WWW.Example.com:80": "example.com/", "https://u:p@example.com:8080/A?b=2&a=1#f": "example.com:8080/A?a=1&b=2", "//example.com/x?": "example.com/x", "mailto:x": None, "": None, None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in df.select("u", canonical_url(F.col("u")).alias("c")).collect()} == cases


def test_revisits_resolve_to_the_latest_earlier_response(spark):
    from tripforge.llm.warc import resolve_revisits

    u, v = "http://a.example/x", "https://www.a.example/x#y"
    rows = [
        (1, u, 10, 200, {"etag": '"a"', "content-length": "5", "x": "1"}, "one"), (2, u, 20, 200, {"etag": '"b"'}, "two"), (3, v, 15, 304, {"etag": 'W/"a"', "content-length": "0", "x": "2"}, None),
        (4, v, 20, 304, {"etag": '"a"'}, None), (5, v, 21, 304, {"etag": '"a"'}, None), (6, v, 5, 304, {"etag": '"a"'}, None), (7, None, 30, 304, None, None), (8, v, None, 304, {"etag": '"b"'}, None),
        (9, v, 10**6, 304, {"etag": '"b"'}, None), (10, v, 30, 304, None, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, uri string, at long, status int, headers map<string,string>, payload string")
    got = {r.record_id: r for r in resolve_revisits(df).collect()}
    assert {k: (r.outcome, r.response_id, r.payload) for k, r in got.items()} == {
        3: ("resolved", 1, "one"), 4: ("resolved", 1, "one"), 5: ("validators_differ", None, None), 6: ("no_response", None, None), 7: ("no_response", None, None), 8: ("no_response", None, None),
        9: ("resolved", 2, "two"), 10: ("validators_differ", None, None),
    }
    assert got[3].headers == {"etag": 'W/"a"', "content-length": "5", "x": "2"}


def test_carry_over_many_blocks(spark):
    from tripforge.llm.warc import latest_earlier

    rows = [(i, "http://a.example/", i * 7, 200 if i % 5 == 0 else 304, {"n": str(i)}) for i in range(400)]
    df = spark.createDataFrame(rows, "record_id long, uri string, at long, status int, headers map<string,string>")
    for stretch in (1, 10, 200, 10**6):
        assert all(r.found.id == r.record_id // 5 * 5 for r in latest_earlier(df, stretch).collect())


def test_as_of_join_equals_brute_force(spark):
    from tripforge.llm.warc import resolve_revisits

    rng = random.Random(2)
    rows = []
    for k in range(400):
        full, at = rng.random() < 0.4, rng.choice([None, 10**12, -5, *range(30)])
        rows.append((rng.choice([None, rng.randint(0, 50)]), f"http://h/{rng.choice('aaab')}", at, 200 if full else 304, {"etag": "x"}, f"body {k}" if full else None))
    df = spark.createDataFrame(rows, "record_id long, uri string, at long, status int, headers map<string,string>, payload string")
    want = []
    for i, uri, at, status, _, _ in rows:
        if status == 304:
            earlier = [r for r in rows if r[3] == 200 and r[1] == uri and r[2] is not None and at is not None and r[2] < at]
            best = max(((r[2], r[0] is not None, r[0] or 0) for r in earlier), default=None)
            bodies = {r[5] for r in earlier if (r[2], r[0] is not None, r[0] or 0) == best}
            want.append((i, at, uri[7:], "resolved" if best else "no_response", bodies))
    got = [(r.record_id, r.at, r.url, r.outcome, r.payload, r.response_id) for r in resolve_revisits(df).collect()]
    key = lambda r: tuple(map(str, r[:4]))
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert key(g) == key(w)
    assert all((p is None) == (o == "no_response") for *_, o, p, _ in got)
    bodies = {}
    for w in want:
        bodies.setdefault(w[:4], set()).update(w[4])
    assert all(p is None or p in bodies[i, a, u, o] for i, a, u, o, p, _ in got)


def test_broken_warc_files(spark, tmp_path):
    import gzip

    from tripforge.llm.warc import read_warc

    good = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Date: never\r\nContent-Length: 19\r\n\r\nHTTP/1.1 200\r\n\r\nabc\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(good + good.replace(b"19", b"x9") + good)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(good) + gzip.compress(good)[:-20])
    (tmp_path / "c.warc").write_bytes(good + good[:-8])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [(r.record_id, r["at"], bytes(r.payload)) for r in read_warc(spark, str(tmp_path)).collect()] == [("<a>", None, b"abc")] * 3
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_warc_files(spark, tmp_path):
    import gzip

    from tripforge.llm.warc import read_warc

    def record(kind, uri, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{uri}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2024-01-01T00:00:10Z\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    full = record("response", "http://a/", b"HTTP/1.1 200 OK\r\nETag: x\r\n\r\nbody WARC/1.0\r\n")
    again = record("revisit", "http://a/", b"HTTP/1.1 304 Not Modified\r\nETag: x\r\n\r\n")
    (tmp_path / "a.warc").write_bytes(record("warcinfo", "i", b"software: x") + full)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(full) + gzip.compress(again))
    rows = sorted((r.status, r.headers["etag"], bytes(r.payload)) for r in read_warc(spark, str(tmp_path)).collect())
    assert rows == [(200, "x", b"body WARC/1.0\r\n")] * 2 + [(304, "x", b"")]


def test_digest_revisits_are_no_responses(spark, tmp_path):
    from tripforge.llm.warc import read_warc, resolve_revisits

    def record(k, kind, second, digest, block):
        return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {k}\r\nWARC-Target-URI: http://a/\r\nWARC-Date: 2024-01-01T00:00:{second}Z\r\nWARC-Payload-Digest: {digest}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    ok = b"HTTP/1.1 200 OK\r\nETag: %s\r\n\r\n%s"
    (tmp_path / "a.warc").write_bytes(
        record("r1", "response", 10, "sha1:A", ok % (b"x", b"old")) + record("r2", "response", 11, "sha1:B", ok % (b"y", b"new")) + record("v1", "revisit", 12, "sha1:B", ok % (b"y", b""))
        + record("v2", "revisit", 13, "sha1:A", ok % (b"x", b"")) + record("v3", "revisit", 14, "sha1:B", b"HTTP/1.1 304 Not Modified\r\nETag: y\r\n\r\n") + record("v4", "revisit", 15, "sha1:C", ok % (b"z", b""))
    )
    got = {r.record_id: (r.outcome, r.response_id, r.payload and bytes(r.payload)) for r in resolve_revisits(read_warc(spark, str(tmp_path))).collect()}
    assert got == {"v1": ("resolved", "r2", b"new"), "v2": ("resolved", "r1", b"old"), "v3": ("resolved", "r2", b"new"), "v4": ("no_response", None, None)}


def test_revisit_query_equals_sql(spark, tmp_path):
    from tripforge.llm import warc

    rows = [(i, [f"https://www.h{i % 3}.example/p{i % 4}?b=1&a={i % 2}", f"http://h{i % 3}.example:443/p{i % 4}?a={i % 2}&b=1#z", None][i % 7 % 3], [f"<p>{i % 2}</p>", None][i % 11 == 0]) for i in range(80)]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = warc.op6_warc_revisits(spark, str(tmp_path))
    names, key = sorted(got.columns), lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(con.sql(f"select {', '.join(names)} from ({warc.SQL})").fetchall(), key=key)
