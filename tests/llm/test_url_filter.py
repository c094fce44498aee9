"""URL rules and aliases against plain Python: html.parser, urljoin and a search over links."""

import random
import re
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pytest
from pyspark.sql import functions as F

from tidewater.llm import url_filter

RULES = [*url_filter.RULES, ("block", "bad.org/"), ("allow", "bad.org/ok/"), ("allow", "deep.bad.org/"), ("block", "m.bad.org/ok/")]
SCHEMA = "page_id int, url string, html string, host string, verdict int"


def host_path(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def by_rule(url):
    host, path = host_path(url)
    fits = []
    for verdict, rule in RULES:
        of, _, rest = rule.partition("/")
        if (host == of or host.endswith("." + of)) and path.startswith("/" + rest):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else (None, None)


def node(url):
    if url is None or "://" not in url:
        return None
    url = urldefrag(url)[0]
    scheme, rest = url.split("://", 1)
    at = re.search(r"[/?]|$", rest).start()
    origin, rest = f"{scheme}://{rest[:at]}".lower(), rest[at:]
    path, mark, query = rest.partition("?")
    if "/." in path:
        path = urljoin("http://x/", path)[len("http://x") :]
    return origin + (path or "/") + mark + query


class Links(HTMLParser):
    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        at = {}
        for k, v in attrs:
            at.setdefault(k, v or "")
        if tag == "link" and "canonical" in at.get("rel", "").lower().split() and "href" in at:
            self.found.append(at["href"].strip())
        if tag == "meta" and at.get("http-equiv", "").strip().lower() == "refresh":
            m = re.match(r"""(?i)\s*[0-9.]+\s*[;,]\s*(?:url\s*=\s*)?["']?\s*([^"']+)""", at.get("content", ""))
            self.found += [m[1].strip()] if m else []

    handle_startendtag = handle_starttag


def expected(rows, redirects=()):
    links, seen = {}, {}

    def join(a, b):
        if a and b and a != b:
            links.setdefault(a, set()).add(b)
            links.setdefault(b, set()).add(a)

    for r in rows:
        reader = Links()
        reader.feed(r[2] or "")
        for href in reader.found:
            if href and not href.startswith("#") and not (re.match(r"[A-Za-z][\w+.-]*:", href) and "://" not in href) and "://" in (r[1] or href):
                join(node(r[1]), node(urljoin(r[1] or "", href)))
    for a, b in redirects:
        join(node(a), node(b))
    out = []
    for r in rows:
        rule, verdict = by_rule(r[1])
        start, alias = node(r[1]), None
        if rule is None and start in links:
            if start not in seen:
                reached, todo = {start}, [start]
                while todo:
                    new = links[todo.pop()] - reached
                    reached |= new
                    todo += new
                least = min((n for n in reached if by_rule(n)[1] == "block"), key=lambda n: n.encode(), default=None)
                seen |= dict.fromkeys(reached, least)
            alias = seen[start]
        out.append((r[0], *host_path(r[1]), rule, verdict or ("block" if alias else "allow"), alias))
    return out


def judged(spark, rows, redirects=None):
    table = spark.createDataFrame(rows, SCHEMA).repartition(3)
    edges = spark.createDataFrame(redirects, "source string, target string, extra int") if redirects else None
    return url_filter.judge(table, url_filter.rules_table(spark, RULES), edges)


def key(r):
    return tuple((x is None, x if x is not None else 0) for x in r)


def same(got, want):
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)


HOSTS = ["a.org", "B.Org", "www.bad.org", "deep.bad.org", "m.bad.org", "x.example.net", "example.com", "c.io", "d.io", "net", "notnet", "e.io:80"]
PATHS = ["", "/", "/en/1", "/de/2?x=1#f", "/ok/p", "/fr/3", "/en/../de/4", "/a/./b/..", "?q=1", "#only", "/x#y"]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_verdicts_are_those_of_plain_python(spark, seed):
    rng = random.Random(seed)
    url = lambda: rng.choice(["http", "https", "HTTPS"]) + "://" + rng.choice(HOSTS) + rng.choice(PATHS)
    to = lambda: rng.choice([url(), "/en/1", "../de/2", "x?y=1&amp;z=2", "?p=3", "//c.io/en/1", "mailto:a@b", "#frag", "", " http://d.io/ ", "javascript:go()"])
    forms = [
        lambda: f'<link rel="canonical" href="{to()}">', lambda: f"<LINK href='{to()}' data-x rel='nofollow Canonical' />", lambda: f"<link rel=stylesheet href=\"{to()}\">", lambda: f'<!-- <link rel="canonical" href="{url()}"> -->',
        lambda: f'<meta http-equiv="refresh" content="0; url={to()}">', lambda: f"<meta content='5;URL=\"{url()}\"' http-equiv=Refresh>", lambda: f'<script>"<link rel=canonical href={url()}>"</script>', lambda: '<meta http-equiv="refresh" content="30">',
        lambda: f'<link title="rel=canonical" href="{url()}">', lambda: f'<link rel="canonical" href="{url()}" href="{url()}">', lambda: "<p>canonical text</p>",
    ]
    rows = [(i, url(), "<html>" + "".join(rng.choice(forms)() for _ in range(rng.randrange(0, 3))) + "<body>x", "clash", 1) for i in range(120)]
    rows += [(None, None, None, None, None), (500, "no scheme", "<link rel=canonical href='http://a.org/'>", None, None), (501, None, "<link rel=canonical href='http://a.org/'>", "x", 2), (502, "://", "", "", 0), rows[0], rows[0]]
    redirects = [(url(), url(), 1) for _ in range(10)] + [(None, "http://a.org/", 2), ("http://c.io/", None, 3)]
    same(judged(spark, rows), expected(rows))
    same(judged(spark, rows, redirects), expected(rows, [r[:2] for r in redirects]))


def test_a_long_chain_and_a_hub_are_blocked_from_their_ends(spark):
    chain = [(i, f"http://c{i}.io/", f'<link rel="canonical" href="http://c{i + 1}.io/">' if i < 59 else "", "", 0) for i in range(60)]
    hub = [(100 + i, f"http://h{i}.io/", '<link rel="canonical" href="http://hub.io/">', "", 0) for i in range(300)]
    ends = [(900, "http://c59.io/", '<meta http-equiv="refresh" content="0;url=http://www.bad.org/x">', "", 0), (901, "http://hub.io/", "", "", 0), (902, "http://deep.bad.org/y", '<link rel="canonical" href="http://c5.io/">', "", 0)]
    rows = [*chain, *hub, *ends]
    want = expected(rows)
    assert sum(r[4] == "block" for r in want) == 61 and want[-1][4] == "allow"
    same(judged(spark, rows), want)


def test_no_rows_and_no_python(spark):
    assert judged(spark, []).count() == 0
    assert "Python" not in judged(spark, [(1, "http://a.org/", "<link rel=canonical href=/x>", "", 0)])._jdf.queryExecution().toString()


@pytest.mark.parametrize("part", ["<link ", "<link rel=canonical href='", "<!--", "<script>", '<meta content="', "<link rel=canonical x y=' >"])
def test_long_broken_markup_takes_little_time(spark, part):
    html = "canonical" + part * (400_000 // len(part))
    assert url_filter.link_edges(spark.createDataFrame([("http://a.org/", html)], "url string, html string")).count() <= 1


def test_rules_of_a_host_with_most_pages(spark):
    pages = spark.range(4000).select(F.col("id").cast("int").alias("page_id"), F.concat(F.lit("http://www.hot.net/en/"), "id").alias("url"), F.lit("").alias("html"))
    got = url_filter.judge(pages, url_filter.rules_table(spark, [("block", "net/"), ("allow", "hot.net/en/1")]))
    assert got.where("verdict = 'allow'").count() == 1111
