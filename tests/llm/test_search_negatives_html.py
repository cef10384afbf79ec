"""Ranked search, hard negatives and page texts: brute-force twins, and nulls, empty tables, repeats and clashing columns."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from groundline.llm import html_text, negatives, ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    bags = [(d, t) for d, x in docs if (t := terms(x))]
    n, length = len(bags), sum(len(t) for _, t in bags)
    df = Counter(w for _, t in bags for w in set(t))
    out = []
    for item, text in set(items):
        scores = []
        for d, t in bags:
            tf, m = Counter(t), 75 + 25 * len(t) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * tf[w] // (1000 * tf[w] + 12 * m)) for w in terms(text) if tf[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return Counter(out)


def test_ranked_search_matches_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    common, rare = ["the", "of", "And", "Ünit"], [f"w{i}" for i in range(300)]
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.6 else rare) for _ in range(n))
    docs = [(i, text(rng.randrange(1, 60))) for i in range(600)]
    docs += [(1000, None), (1001, ""), (1002, " .,\n"), (7, docs[7][1]), (7, docs[7][1]), (None, docs[9][1]), (2**53 + 1, docs[9][1]), (1003, "w1," * 400_000 + "the" * 100), (1004, "x" * 1_500_000)]
    items = [(1, text(30)), (2, "the the the of"), (3, None), (4, ""), (5, "nowhere else"), (6, docs[9][1]), (6, docs[9][1]), (None, "w3 w4 and"), (7, docs[9][1])]
    d = spark.createDataFrame([(*r, 5, "c") for r in docs], "doc_id long, text string, item long, term string").repartition(3)
    i = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = Counter(tuple(r) for r in ranked.ranked_search(d, i, 20).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(docs, items, 20)
    monkeypatch.setattr(ranked, "QUERIES", 2)  # in blocks of queries
    assert Counter(tuple(r) for r in ranked.ranked_search(d, i, 20).select("item_id", "rank", "doc_id", "score").collect()) == got
    assert ranked.ranked_search(d.where("false"), i).count() == ranked.ranked_search(d, i.where("false")).count() == 0


def test_walk_skips_and_finds_all():
    rng = np.random.default_rng(1)
    n = 20_000
    lists = []
    for share, top in [(0.9, 5), (0.7, 9), (0.5, 20), (0.02, 400), (0.01, 900), (0.001, 2000)]:
        at = np.flatnonzero(rng.random(n) < share)
        adds = rng.integers(0, top, len(at))
        lists.append(ranked.Postings(at, adds, int(adds.max())))
    total = np.zeros(n, dtype=np.int64)
    for x in lists:
        total[x.at] += x.adds
    want = sorted(((-s, d) for d, s in enumerate(total.tolist()) if s > 0))[:20]
    best = ranked.Best(20)
    scored = ranked.walk([*ranked.summed(lists[3:]), *lists[:3]], n, best, np.zeros(n, dtype=np.int64), np.arange(n))
    assert list(zip((-best.score).tolist(), best.id.tolist())) == want
    assert scored < n / 4  # most documents are in long lists only and are never scored
    assert ranked.summed([]) == []


def test_segments_hold_the_index(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"a b{i % 3} a") for i in range(10)] + [(11, "")], "doc_id long, text string").coalesce(1)
    wanted = ranked.terms_of(spark.createDataFrame([("q", "A b1")], "key string, text string"), "key")
    rows = ranked.search_index(docs, wanted.select("term")).collect()
    assert [sorted(r.sizes) for r in rows] == [[3, 10]] and sum(len(r.docs) for r in rows) == 10 and sum(map(sum, (r.tf for r in rows))) == 23 and sum(map(sum, (r.n for r in rows))) == 30


@pytest.mark.parametrize("shape", [(1, 1, 1), (70, 64, 90), (129, 130, 131), (300, 65, 33)])
def test_strassen_is_exact(shape):
    rng = np.random.default_rng(2)
    a, b = rng.integers(-(2**40), 2**40, shape[:2]), rng.integers(-(2**16), 2**16, shape[1:])
    assert (negatives.product(a, b) == a @ b).all()
    big = rng.integers(-(2**62), 2**62, (shape[0], shape[1]))
    assert (negatives.product(big, b) == big @ b).all()  # wraps as 64-bit sums do


def brute_negatives(rows):
    clean = [(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    anchors = {}
    for i, lab, v in clean:
        if i % 10 == 0:
            anchors[i] = min(anchors.get(i, (lab, v)), (lab, v))
    out = []
    for a, (lab, v) in anchors.items():
        dot = lambda w: sum(x * y for x, y in zip(v, w))
        scored = [(-dot(w), i, x == lab) for i, x, w in clean if i != a]
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            own = sorted(x for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out += [(a, p, r + 1, n, -s, -t) for r, (t, n, _) in enumerate(own)]
    return Counter(out)


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, int(rng.integers(0, 3)), [float(np.float32(x)) for x in rng.normal(0.4, 0.5, 9)]) for i in range(300)]
    rows += [(301, None, rows[0][2]), (302, 1, None), (303, 1, [float("nan")] * 9), (304, 1, [None] + [1.0] * 8), (305, 1, [float("inf")] * 9), (None, 1, rows[0][2]), (306, 1, []), (307, 2, [9.0, 9.0]), (308, 2, [1.0] * 12), (310, 1, []), (33, rows[33][1], rows[33][2]), (33, rows[33][1], rows[33][2]), (40, rows[40][1], rows[40][2]), (2**53 + 1, 1, rows[40][2]), *((320 + i, 0, rows[0][2]) for i in range(9))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, label int, vector array<float>, rank int").repartition(3)
    got = Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())
    # A pair's negatives do not depend on how often its positive stands in the table; repeated positives are rows of their own.
    assert got == brute_negatives(rows)
    monkeypatch.setattr(negatives, "GROUP", 7)
    assert Counter(tuple(r) for r in negatives.hard_negatives(df, F.col("id") % 10 == 0).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()) == got
    assert negatives.hard_negatives(df.where("false"), F.col("id") % 10 == 0).count() == 0


def test_heaps_merge():
    rng = np.random.default_rng(5)
    lists, scores, ids = rng.integers(0, 4, 500), rng.integers(0, 30, 500), np.arange(500)
    heaps = negatives.Heaps(4, 5)
    for at in range(0, 500, 60):
        heaps.add(lists[at : at + 60], scores[at : at + 60], ids[at : at + 60])
    got = list(zip(*(x.tolist() for x in heaps.rows())))
    assert got == [(k, -s, i) for k in range(4) for s, i in sorted((-s, i) for own, s, i in zip(lists.tolist(), scores.tolist(), ids.tolist()) if own == k)[:5]]


ARTICLE = "First words, with marks. And more of them; enough for an article."
PAGES = [
    (f"<nav><a href=/a>Home</a></nav><article><header><h1>Title</h1><p>by me</p></header><p>{ARTICLE}</p><aside>see also</aside><footer>tags</footer></article><footer>&copy;</footer>", f"Title\n{ARTICLE}"),
    (f"<div class='top-menu'><p>Menu entry one, two.</p></div><h1>Title</h1><div id=content><p>{ARTICLE}<p>{ARTICLE}<ul><li>one<li>two</ul></div><div class=sidebar><p>{ARTICLE}</p></div>", f"Title\n{ARTICLE}\n{ARTICLE}\none\ntwo"),
    (f"<ul><li><a>a b</a><li><a>c d</a><li><a>e f</a></ul><div><p>{ARTICLE}</p></div>", ARTICLE),
    ("<main><p>a &lt;b&gt; &amp; c&#233; \n\t d<br>e<!-- no --><script>if (a<b) 'x</p>'</script><style>p{}</style></main>", "a <b> & cé d e"),
    (f"<article><p>{ARTICLE}</p><section class='comments-area'><p>{ARTICLE}</p></section><article class='comment'><p>{ARTICLE}</p></article><form><p>sign up, now.</p></form></article>", ARTICLE),
    (f"<form><div class='cookie-notice'>We use, things.</div><article class='post has-sidebar'><p>{ARTICLE}</p></article></form>", ARTICLE),
    (f"<article><p>One <b>two<p>three</b> four</p></article><foot", "One two\nthree four"),
    (f"<article><p title=\"a > b\">x<span hidden>y</span><span style='display: none'>z</span></p><div class=ad>buy, now!</div></article>", "x"),
    ("just text, without tags", "just text, without tags"),
    ("", ""),
    (None, ""),
    ("<p", ""),
]


def test_page_texts(spark):
    rows = [(i, f"u{i}", html, "clash", 3) for i, (html, _) in enumerate(PAGES)]
    pages = spark.createDataFrame([*rows, rows[0], (None, None, PAGES[3][0], None, None), (2**53 + 1, "u", None, None, None)], "page_id long, url string, html string, text string, path long").coalesce(1)
    got = html_text.main_text(pages)
    assert got.columns == ["page_id", "url", "path", "text", "n_chars"]
    out = got.collect()
    assert Counter((r.page_id, r.text) for r in out) == Counter([*((i, want) for i, (_, want) in enumerate(PAGES)), (0, PAGES[0][1]), (None, PAGES[3][1]), (2**53 + 1, "")])
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_text.main_text(pages.where("false")).count() == 0


def test_long_and_broken_pages_stay_whole():
    long = "word, " * 200_000
    assert html_text.content_blocks(f"<article><p>{long}</p></article>")[0].text == long.strip()
    assert len(html_text.content_blocks("<div>a" * 3000)) == 3000
    assert html_text.content_blocks("<b>" + "<div>" * 2000 + "</b>" * 2000 + "<a href='" * 2000) == []


def test_path_ratios_choose_among_unmarked_boxes():
    box = lambda name, *texts: f"<div id={name}>" + "".join(f"<p>{t}</p>" for t in texts) + "</div>"
    page = box("x1", "Log in", "Help", "Terms") + box("x2", *[ARTICLE * 3] * 6) + box("x3", "A b", "C d")
    assert [b.text for b in html_text.content_blocks(page)] == [ARTICLE * 3] * 6
