import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from bidscope.llm import url_filter as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]


def rule(host, path):
    best = None
    for action, text in U.RULES:
        h, slash, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(text) > len(best[1])):
            best = action, text
    return best or (None, None)


def raw_tokens(host, path):
    text = re.sub(r"\d+", " 0 ", (host + "/" + path).lower())
    return [x for x in re.sub(r"[^\W\d_]+|0|(.)", lambda m: " " if m[1] else m[0], text, flags=re.S).split() if x]


def slow(rows):
    counts = Counter()
    for _, _, page in rows:
        visible = re.sub(r"<[^>]*>", " ", re.sub(r"<(script|style)\b.*?</\1>", " ", page or "", flags=re.S))
        counts.update(w for w in re.findall(r"[^\W\d_]+", visible.lower()) if len(w) <= U.MAX_WORD)
    total = sum(counts.values()) or 1
    cut = {}
    made_of = set(U.rule_tokens(U.RULES))
    words = lambda host, path: [w for t in raw_tokens(host, path) if t not in made_of for w in (["0"] if t == "0" else cut.setdefault(t, U.segment(t, counts, total)))]
    bags = {"allow": Counter(), "block": Counter()}
    ruled = Counter()
    for _, url, _ in rows:
        h, p = host_path(url)
        a, _r = rule(h, p)
        if a:
            ruled[a] += 1
            bags[a].update(words(h, p))
    v = len(set(bags["allow"]) | set(bags["block"]))
    every = {w for _, url, _ in rows for w in words(*host_path(url))}
    v = len(every) or 1
    n = {k: sum(b.values()) for k, b in bags.items()}
    out = []
    for i, url, _ in rows:
        h, p = host_path(url)
        a, r = rule(h, p)
        if a is None:
            odds = sum(
                math.log((bags["block"][w] + 1) / (n["block"] + v)) - math.log((bags["allow"][w] + 1) / (n["allow"] + v)) for w in words(h, p))
            a = "block" if ruled["block"] and round(odds, 9) > 0 else "allow"
        out.append((i, h, p, r, a))
    return sorted(out, key=str)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=9), st.dictionaries(st.text(alphabet="abc", min_size=1, max_size=4), st.integers(1, 50), max_size=8))
def test_segmentation_equals_all_splits(run, counts):
    total = sum(counts.values()) or 1

    def cost(parts):
        return sum(math.log(counts[w] / total) if w in counts else math.log(10 / total) - len(w) * math.log(10) for w in parts)
    best = max(cost([run[a:b] for a, b in zip([0, *cuts], [*cuts, len(run)])]) for k in range(1 << (len(run) - 1))
               for cuts in [[i + 1 for i in range(len(run) - 1) if k >> i & 1]])
    got = U.segment(run, counts, total)
    assert "".join(got) == run and abs(cost(got) - best) < 1e-9


ROWS = [(1, "http://www.Example.com/en/x?q=1", "<p>cheap pills</p>"), (2, "https://a.example.com/en/1#t", "x"), (3, "http://example.com", None), (4, "ftp://cheappills.net/es/a/b", "cheap news"),
        (5, "http://news.org/de/12", "news <script>var zzz</script>"), (6, None, None), (7, "no scheme", ""), (8, "", "x"), (9, "http://ünï.net/fr/ä", "ünï"), (10, "http://notexample.com/en/", "x"),
        (11, "http://x.cheap-pills.org/es/1\n2", "pills"), (5, "http://news.org/de/12", "news"), (12, "http://user@h.net:80/fr", "x"), (None, "http://a.com/", None), (13, "://", ""), (14, "a://b://c/en/", "")]


def test_rows_equal_slow_version(spark):
    df = spark.createDataFrame([(*r, "clash", 1) for r in ROWS], "page_id long, url string, html string, verdict string, word int").repartition(3)
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in U.judge(df).collect()), key=str)
    assert got == slow(ROWS)
    assert U.judge(df.limit(0)).count() == 0
    none = U.judge(df.where("page_id in (5, 6, 7)")).collect()
    assert {r.verdict for r in none} == {"allow"} and len(none) == 4


def test_query_equals_slow_version(spark):
    from bidscope.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in QUERIES["op9_url_filter"](spark, sf).collect()), key=str)
    assert got == slow(rows)


def test_words_of_concatenated_hosts_decide(spark):
    """Names are only told apart once they are cut into words; the rules' own tokens and the number of ruled urls say nothing."""
    page = "<p>" + "cheap pills casino bonus garden news daily recipes " * 40 + "</p>"
    blocked = [("http://cheapcasino.net/es/bonus", page), ("http://pillsbonus.net/fr/cheap", page), ("http://casinopills.net/es/", page)] * 4
    allowed = [("http://gardennews.com/daily", page), ("http://dailyrecipes.com/garden", page)]
    asked = [("http://bonuspills.org/x", "block"), ("http://cheapbonus.info/", "block"), ("http://newsrecipes.org/x", "allow"), ("http://dailygarden.info/", "allow"),
             ("http://net.org/es", "allow"), ("http://recipes.net/de/news", "allow")]
    rows = [(i, u, p) for i, (u, p) in enumerate(blocked + allowed + [(u, None) for u, _ in asked])]
    got = {r.page_id: r.verdict for r in U.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    first = len(blocked) + len(allowed)
    assert [got[first + k] for k in range(len(asked))] == [v for _, v in asked]
