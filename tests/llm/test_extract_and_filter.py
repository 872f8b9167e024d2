"""HTML extraction and URL filters."""

import html
import random
import re
import time

import pytest

from kinweave.llm import html_crf, queries, url_filter

CASES = {
    "<article><h1>Title</h1><p>First &amp; second.<br>Still  it.</p><p>Next\n one.</p></article>": "Title\n\nFirst & second. Still it.\n\nNext one.",
    "<nav><a href=/>Home</a></nav><div class='ad'>Buy it now!</div><article><p>The text of the page is here.</p></article><footer>&copy; us</footer>": "The text of the page is here.",
    "<script>var a='</p>';</script><style>p{}</style><article><p>One sentence stands here.</p></article>": "One sentence stands here.",
    "<article><p>Unclosed paragraph here.<p>And another one there.": "Unclosed paragraph here.\n\nAnd another one there.",
    "": "",
    "<html><head><title>x</title></head><body></body></html>": "",
}


@pytest.fixture(scope="module")
def chain():
    return html_crf.model()


def test_known_pages(chain):
    assert {k: html_crf.main_text(k, chain) for k in CASES} == CASES
    assert html_crf.main_text(None, chain) == ""


def test_held_out(chain):
    right = total = 0
    for f, y in html_crf.labelled_pages(150, seed=77):
        got = chain.decode(f)
        right += sum(a == b for a, b in zip(got, y))
        total += len(y)
    assert right / total > 0.97


def test_viterbi_is_the_best_labelling(chain):
    from itertools import product

    for f, _ in [p for p in html_crf.labelled_pages(60, seed=3) if len(p[1]) <= 9][:15]:
        e, w = chain.emissions(f), chain.between
        value = lambda y: sum(x for x, k in zip(e, y) if k) + sum(w[a][b] for a, b in zip(y, y[1:]))  # noqa: E731, B023
        assert abs(value(chain.decode(f)) - max(map(value, product((0, 1), repeat=len(f))))) < 1e-9


def test_gradient_fits_the_labels():
    pages = html_crf.labelled_pages(40, seed=8)
    few, many = html_crf.fit(pages, rounds=2), html_crf.fit(pages, rounds=120)
    wrong = lambda c: sum(a != b for f, y in pages for a, b in zip(c.decode(f), y))
    assert wrong(many) < wrong(few)


def test_broken_markup_and_long_pages(chain):
    for page in ("<" * 500, "<p" * 200, "a < b > c", "<a href='x", "<p>" * 3000 + "end of it all.", "<!-- never closed", "<script>never closed", "&#x41;&bogus;&lt;"):
        html_crf.main_text(page, chain)
    long = "<article>" + "<p>Some words of a sentence here.</p>" * 20_000 + "</article>"
    assert html_crf.main_text(long, chain).count("\n\n") == 19_999


def test_extract_rows(spark):
    rows = [(1, k, "mine", 5) for k in CASES] + [(1, None, "mine", 5), (None, next(iter(CASES)), None, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = html_crf.extract(df).collect()
    assert sorted(r["text"] for r in got) == sorted([*CASES.values(), "", next(iter(CASES.values()))])
    assert html_crf.extract(df.limit(0)).count() == 0


def test_query_on_pages(spark):
    d = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    got = queries.op1_html_crf(spark, d).collect()
    assert len(got) == len(pages)
    same = 0
    for r in got:
        inner = re.search("<article>(.*)</article>", pages[r["page_id"]], re.S).group(1)
        parts = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split("</?p>|</?h1>", inner)]
        same += r["text"] == "\n\n".join(x for x in parts if x)
        assert r["n_chars"] == len(r["text"])
    assert same >= 0.98 * len(got)


URLS = {
    "http://WWW.A.Example.com/en/7/x?q#f": ("www.a.example.com", "/en/7/x", "example.com/en/7"),
    "https://example.com/en/1": ("example.com", "/en/1", "com/en/"),
    "https://example.com": ("example.com", "", None),
    "https://xcom/en/": ("xcom", "/en/", None),
    "com://com/en/?a": ("com", "/en/", "com/en/"),
    "http://example.net/de/8?x=://y/z": ("example.net", "/de/8", "example.net/de/8"),
    "http://a.net/de/9#x": ("a.net", "/de/9", "net/de/"),
    "http://ÄB.org/es/Ü": ("Äb.org", "/es/Ü", "org/es/"),
    "no scheme": ("", "", None),
    "://": ("", "", None),
    "": ("", "", None),
    None: ("", "", None),
    "http://h?x/y": ("h", "", None),
}


def test_urls(spark):
    df = spark.createDataFrame([(k, u, "x", None) for k, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = {r["page_id"]: r for r in url_filter.judge(df, queries.URL_RULES).collect()}
    for k, (u, want) in enumerate(URLS.items()):
        assert (got[k]["host"], got[k]["path"], got[k]["rule"]) == want, u
        if want[2]:
            assert got[k]["verdict"] == {h + p: v for v, h, p in queries.URL_RULES}[want[2]]
    assert url_filter.judge(df.limit(0), queries.URL_RULES).count() == 0
    assert url_filter.judge(df, []).where("rule is not null").count() == 0


def test_model_generalises():
    """Held out by word: no host of a word held out, with or without a subdomain, is in training."""
    table = url_filter.labelled_urls()
    word = [url_filter._split(u)[0].removeprefix("www.").removeprefix("m.").removeprefix("blog.").split(".")[0] for u, _ in table]
    out = {w for k, w in enumerate(sorted(set(word))) if k % 5 == 0}
    weights = url_filter.train([x for x, w in zip(table, word) if w not in out])
    hold = [x for x, w in zip(table, word) if w in out]
    right = [(url_filter.probability(u, weights) > 0.5) == y for u, y in hold]
    allowed = [r for r, (_, y) in zip(right, hold) if not y]
    assert len(hold) > 200 and sum(right) / len(right) > 0.85 and sum(allowed) / len(allowed) > 0.95


def test_urls_against_brute_force(spark):
    rng = random.Random(2)
    part = lambda: "".join(rng.choice("abcde-") for _ in range(rng.randint(1, 6)))
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}{rng.choice(['://', ':/', '://'])}{rng.choice(['', 'www.', 'Sub.a.'])}{rng.choice(['example.com', 'net', 'EXAMPLE.net', 'org', part() + '.org', part(), ''])}{rng.choice(['/en/', '/de/', '/de/8', '/es/', '/en/7', '/', ''])}{part()}{rng.choice(['', '?' + part(), '#x', '?a://b/'])}" for _ in range(800)]
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*urls, None, ""])], "page_id long, url string")
    labelled = url_filter.read_labels(spark.createDataFrame([(u, k % 2) for k, u in enumerate(urls[:60])] + [(None, None), ("http://x.com/", 1)], "url string, label int"))
    assert len(labelled) == 61
    weights = url_filter.train(labelled).astype("float32")
    for r in url_filter.judge(df, queries.URL_RULES, labelled=labelled).collect():
        u = None if r["page_id"] == len(urls) else "" if r["page_id"] == len(urls) + 1 else urls[r["page_id"]]
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        p_block = url_filter.probability(u, weights)
        best = max(fits, default=(0, None, "block" if p_block > 0.5 else "allow"))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert abs(r["p_block"] - p_block) < 1e-5 and (r["verdict"] == best[2] or abs(p_block - 0.5) < 1e-4)


def test_grams_do_not_cross_rows():
    from kinweave.llm.common import text_buffers

    import pyarrow as pa

    row, bucket = url_filter.hashed_grams(*text_buffers(pa.array(["abcdef", "", None, "ab", "abcdef"])))
    assert set(row.tolist()) == {0, 4}
    assert sorted(bucket[row == 0]) == sorted(bucket[row == 4])


def test_text_after_an_unclosed_element():
    said = lambda page: " ".join(b[0] for b in html_crf.blocks(page))
    for name in ("svg", "math", "object", "canvas", "audio", "video", "noscript"):
        assert "after" in said(f"<article><p>one</p><{name}><p>after</p></article>")
    for name in ("math", "object", "noscript", "audio", "video"):
        assert "within" in said(f"<article><p>one <{name}>within</{name}> two</p></article>")
    for name in ("script", "style", "textarea", "iframe"):
        assert "after" not in said(f"<article><p>one</p><{name}><p>after</p></article>")


@pytest.mark.parametrize("page", ['<p>hi</p><a ' + '"" ' * 10_000 + "<b", "<a " + '"' * 20_001 + "<b>x", "<" * 50_000, "<p" * 50_000, "<!" * 50_000, "<svg>" * 20_000, "<div>x" * 30_000, "<div>" * 10_000 + "</p>" * 30_000, '<a "<a \'<a "<a \'<b' * 10_000, ('<a x="<b y=\'<c z=">\' ' * 10_000)])
def test_reading_takes_linear_time(page):
    began = time.perf_counter()
    html_crf.features(html_crf.blocks(page))
    assert time.perf_counter() - began < 10
    began = time.perf_counter()
    html_crf.blocks(page[: len(page) // 10])
    assert time.perf_counter() - began < 1


def test_quotes_and_unclosed_elements():
    text = lambda page: [b[0] for b in html_crf.blocks(page)]
    assert text('<p title="a > b <c>">x<br/>y</p><img src="a\'b"><p class="x>t</p>a < b') == ["x y", "t", "a < b"]
    for name in ("svg", "canvas", "noscript", "object", "math", "audio", "video"):
        assert text(f"<p>one</p><{name}><p>two</p><article><p>three</p></article>")[0] == "one"
        assert text(f"<p>one</p><{name}><p>two</p><article><p>three</p></article>")[-1] == "three"
    deep = "<div>" * 1000 + "<p>in</p>" + "</div>" * 1000 + "<p>out</p>"
    assert text(deep) == ["in", "out"] and html_crf.path(html_crf.blocks(deep)[1][1]) == [("p", "")]


def test_pages_of_another_hand(chain):
    """Layouts and names that the labelled pages do not know; every block is tagged with what it is."""
    rng = random.Random(11)
    say = lambda n: " ".join("".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(n))
    right = total = 0
    for k in range(120):
        prose = [(say(rng.randint(12, 60)).capitalize() + ".", 1) for _ in range(rng.randint(3, 9))]
        title = [(say(rng.randint(3, 8)).capitalize(), 1)]
        menu, foot = [(say(rng.randint(1, 2)), 0) for _ in range(rng.randint(3, 8))], [("© 2024 " + say(3), 0)]
        listed = "".join(f'<li><a href="/{i}">{t}</a></li>' for i, (t, _) in enumerate(menu))
        kind = rng.choice(["div", "section"])
        body = f'<h1>{title[0][0]}</h1>' + "".join(f"<p>{t}</p>" for t, _ in prose)
        body = f'<article>{body}</article>' if k % 2 else f'<{kind} class="qx{k}">{body}</{kind}>'
        page = f'<body><nav><ul>{listed}</ul></nav>{body}<footer><p>{foot[0][0]}</p></footer></body>'
        truth = [*menu, *title, *prose, *foot]
        found = html_crf.blocks(page)
        assert [b[0] for b in found] == [t for t, _ in truth]
        got = chain.decode(html_crf.features(found))
        right += sum(a == y for a, (_, y) in zip(got, truth))
        total += len(truth)
    assert right / total > 0.95
