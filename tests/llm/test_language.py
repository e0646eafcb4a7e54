"""Accuracy, the fusion against plain Python, and edge cases of language identification."""

import math
import random
import re
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from seqlake.llm import language


def test_pages_are_identified(spark, small):
    out = language.op8_language(spark, small).collect()
    pages = spark.read.parquet(f"{small}/pages.parquet")
    assert len(out) == pages.count() and all(0 < r.probability <= 1 for r in out)
    assert np.mean([r.lang == r.declared for r in out if r.declared]) > 0.9


def corpus(spark):
    texts = {"de": "der die das und ist nicht ein ", "en": "the and of to in is that it ", "fr": "le la les des est dans que une "}
    docs = [(i, texts[x] * 5, x) for i, x in enumerate(["de", "en", "fr"] * 5)]
    return texts, spark.createDataFrame(docs, "doc_id long, text string, lang string")


def test_host_and_declaration_decide_where_the_text_is_silent(spark):
    texts, docs = corpus(spark)
    page = lambda host, lang, body: (f"http://{host}/x", f'<html lang="{lang}"><body><article>{body}</article></body></html>' if lang else f"<html><body>{body}</body></html>")
    rows = [page("a.site.de", "de", texts["de"]) for _ in range(20)] + [page("b.other.fr", "fr", texts["fr"]) for _ in range(20)] + [page("c.more.com", "en", texts["en"]) for _ in range(20)]
    rows += [page("a.site.de", "", ""), page("new.site.de", "", ""), page("x.y.fr", "", ""), page("z.q.org", "en", ""), (None, None)]
    pages = spark.createDataFrame([(i, *r, "p") for i, r in enumerate(rows)], "page_id long, url string, html string, lang string")
    got = {r.page_id: r for r in language.identified(pages, docs).collect()}
    assert len(got) == len(rows)
    assert [got[i].lang for i in range(60, 64)] == ["de", "de", "fr", "en"]
    assert all(got[i].lang == x for i, x in enumerate(["de"] * 20 + ["fr"] * 20 + ["en"] * 20))
    assert got[64].host == "" and got[64].suffix is None and got[64].lang in texts


def by_hand(pages, docs):
    """page_id -> posterior, by the formulas in plain Python."""
    grams = lambda t: [tuple((b" " + t.lower().encode() + b" ")[k : k + 3]) for k in range(len(t.encode()))]
    bucket = lambda g: ((((g[0] * 0x9E3779B1) ^ (g[1] * 0x85EBCA77) ^ (g[2] * 0xC2B2AE3D)) & 0xFFFFFFFF) ^ ((((g[0] * 0x9E3779B1) ^ (g[1] * 0x85EBCA77) ^ (g[2] * 0xC2B2AE3D)) & 0xFFFFFFFF) >> 15)) * 0x2C1B3C6D % 2**32 >> 16
    names = sorted({x for _, _, x in docs})
    counts = {x: Counter(bucket(g) for _, t, y in docs if y == x for g in grams(t)) for x in names}
    totals = {x: sum(c.values()) + 0.1 * language.BUCKETS for x, c in counts.items()}
    norm = lambda v: [x / sum(v) for x in v]
    seen = {}
    for i, url, html in pages:
        g = [bucket(x) for x in grams(language.visible(html or ""))]
        logs = [sum(math.log((counts[x][b] + 0.1) / totals[x]) for b in g) * min(len(g), language.MOST_TRIGRAMS) / max(1, len(g)) for x in names]
        host = (re.match(r"[a-z]+://([^/:?#]*)", url or "") or [None, ""])[1].lower().rstrip(".")
        declared = (re.search(r"<html[^>]*?\slang=\"([a-z]{2,3})", html or "") or [None, ""])[1]
        path = (re.match(r"[^:]+://[^/]*/([a-z]{2})(?:/|$)", url or "") or [None, ""])[1]
        suffix = (re.search(r"([^.]+)$", host) or [None, ""])[1]
        domain = (re.search(r"([^.]+\.[^.]+)$", host) or [None, ""])[1]
        seen[i] = dict(logs=logs, p=norm([math.exp(x - max(logs)) for x in logs]), host=host, declared=declared, path=path, level=((suffix, domain, host), (suffix, domain), (suffix,)))
    ks = range(len(names))
    base = [(sum(s["p"][k] for s in seen.values()) + 1) / (len(seen) + len(names)) for k in ks]
    out = {}
    for i, s in seen.items():
        prior = base
        for depth in (2, 1, 0) if s["host"] else ():  # without a host the prior is that of all pages
            mine = [t for t in seen.values() if t["level"][depth] == s["level"][depth]]
            prior = [(sum(t["p"][k] for t in mine) - s["p"][k] + language.SMOOTH * prior[k]) / (len(mine) - 1 + language.SMOOTH) for k in ks]
        evidence = [s["logs"][k] + math.log(max(prior[k], 1e-9)) for k in ks]
        for c in ("declared", "path"):
            if s[c]:
                values = {t[c] for t in seen.values() if t[c]}
                for k in ks:
                    evidence[k] += math.log((sum(t["p"][k] for t in seen.values() if t[c] == s[c]) + 1) / (sum(t["p"][k] for t in seen.values() if t[c]) + len(values) + 1))
        out[i] = dict(zip(names, norm([math.exp(x - max(evidence)) for x in evidence]), strict=True))
    return out


def test_the_fusion_against_plain_python(spark):
    texts, docs = corpus(spark)
    hosts = ["a.one.de", "b.one.de", "c.two.de", "a.one.fr", "localhost", "x.net."]
    pages = []
    for i in range(60):
        body = list(texts.values())[i % 3] if i % 4 else ""
        lang = f' lang="{list(texts)[(i // 2) % 3]}"' if i % 5 else ""
        pages.append((i, f"http://{hosts[i % 6]}/{'fr/' if i % 7 == 0 else ''}p{i}" if i % 11 else None, f"<html{lang}><body>{body}</body></html>" if i % 13 else None))
    pages += [(100, "http://a.one.de/", "der die and the"), (101, "http://a.one.de/", "der die and the")]
    want = by_hand(pages, [tuple(r) for r in docs.collect()])
    got = {r.page_id: r for r in language.identified(spark.createDataFrame(pages, "page_id long, url string, html string"), docs).collect()}
    assert set(got) == set(want)
    for i, p in want.items():
        assert abs(got[i].probability - max(p.values())) < 1e-4, i
        assert p[got[i].lang] > max(p.values()) - 1e-4


def test_edges(spark):
    texts, docs = corpus(spark)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert language.identified(empty, docs).count() == 0
    pages = spark.createDataFrame([(1, "http://a.com/", texts["en"] * 3000), (1, "http://a.com/", texts["en"] * 3000), (None, "nonsense", "<p>")], "page_id long, url string, html string")
    out = language.identified(pages, docs).collect()
    assert len(out) == 3 and [r.lang for r in out if r.page_id == 1] == ["en", "en"]
    unknown = language.identified(pages, docs.where(F.lit(False))).collect()
    assert len(unknown) == 3 and all(r.lang is None for r in unknown)


def test_hosts_without_a_dot_give_one_row_a_page(spark):
    texts, docs = corpus(spark)
    urls = ["http://localhost/a", "http://intranet/b", "http://wiki/c", "http://a.com./d", None, "nonsense", "http://www.site.de/e"]
    pages = spark.createDataFrame([(i, u, texts["en"]) for i, u in enumerate(urls)], "page_id long, url string, html string")
    out = language.identified(pages, docs).collect()
    assert sorted(r.page_id for r in out) == list(range(len(urls)))
    assert all(r.lang == "en" for r in out)


def test_all_languages_take_part(spark):
    names = [f"x{i:02}" for i in range(80)]
    texts = {x: " ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}q" for k in range(26)) for i, x in enumerate(names)}
    docs = spark.createDataFrame([(i * 10 + k, texts[x], x) for i, x in enumerate(names) for k in range(1 + (i < 70))], "doc_id long, text string, lang string")
    pages = spark.createDataFrame([(i, f"http://h{i}.site/", texts[x]) for i, x in enumerate(names)], "page_id long, url string, html string")
    got = {r.page_id: r for r in language.identified(pages, docs).collect()}
    assert [got[i].text_lang for i in range(80)] == names and [got[i].lang for i in range(80)] == names


def test_visible_text():
    html = '<html><head><title>t</title></head><body><nav>no</nav><!-- no --><script>var t="</p>";</script><article>A &amp; B<br>c</article></body></html>'
    assert language.visible(html).split() == ["A", "&", "B", "c"]
    assert language.visible("<p>x</p> y").split() == ["x", "y"]


def test_pages_without_a_host_do_not_speak_for_one_another(spark):
    texts, docs = corpus(spark)
    rows = [(i, None if i % 2 else "no address", texts["de"]) for i in range(30)] + [(i + 30, "http://e.com/", texts["en"]) for i in range(40)] + [(99, None, "12 34")]
    alone = {r.page_id: r for r in language.identified(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert alone[99].lang == "en" and alone[99].host == "" and all(alone[i].lang == "de" for i in range(30))
    one_host = [(i, "http://d.com/" if u is None else u, t) for i, u, t in rows]
    assert {r.page_id: r for r in language.identified(spark.createDataFrame(one_host, "page_id long, url string, html string"), docs).collect()}[99].lang == "de"


def old_way(html):
    """As the same was told by patterns that look again from each mark."""
    html = re.sub(r"<!--.*?-->|<(script|style|nav|head)\b.*?</\1\s*>", " ", html, flags=re.S | re.I)
    parts = [m.group(2) for m in re.finditer(r"<(article|main)\b[^>]*>(.*?)</\1\s*>", html, re.S | re.I)]
    return re.sub(r"<[^>]*>", " ", " ".join(parts) if parts else html)


def test_broken_markup_is_read_in_one_pass():
    rng = random.Random(3)
    marks = ["<!--", "-->", "<nav >", "</nav >", "<NAV", "</nav", "<head>", "</head>", "<header>", "<article a=1>", "<article", "</article>", "<main>", "</main>", "<script>", "</script>", "<style>", "<", ">", "x ", "y", "<p>", "<a <b>"]
    for _ in range(3000):
        html = "".join(rng.choice(marks) for _ in range(rng.randint(0, 14)))
        assert language.visible(html) == old_way(html), html
    for mark in ("<!-- x", "<nav >", "<article ", "<main>", "<", "<html ", "<html lang", "</nav ", "&#9", "<script", "<nav></head>", "&#" + "9" * 5000 + ";"):
        html = mark * (2_000_000 // len(mark))
        began = time.thread_time()
        language.visible(html)
        assert language.declared_in(html) == ""
        assert time.thread_time() - began < 5, mark
    assert language.declared_in('<html><HTML dir="x" LANG = de>') == "de" and language.declared_in("<html a> lang=fr") == "" and language.declared_in("<html \n lang='pt-BR'") == "pt"
