"""Extraction and language model against plain statements."""

import html as h
import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from scholarlens import session
from scholarlens.llm import extraction, katz, queries

SF = "/root/testdata/sf0.01"


def plain_article(page):
    """The blocks inside <article>, for pages of the test tables' layout."""
    body = re.search(r"<article>(.*?)(</article>|$)", page or "", re.S)
    if not body:
        return ""
    text = re.sub(r"<[^<>]*$", "", body.group(1))
    blocks = re.split(r"</?(?:p|h1)>", text)
    clean = [" ".join(h.unescape(re.sub(r"<br>", " ", b).replace("<b>", "").replace("</b>", "")).split())
             for b in blocks]
    return "\n".join(b for b in clean if b)


def test_articles_of_all_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op1_html_extraction(spark, SF).collect():
        assert r["text"] == plain_article(pages[r["page_id"]]) and r["n_chars"] == len(r["text"])


def test_odd_pages(spark):
    long = "word " * 30
    pages = [None, "", "<", "<p", "plain", f"<div>{long}</div>", "<b>" * 5000 + long, f"<p>{long}&amp;é 😀",
             f"<div class='comment'>{long}</div><p>{long}", "<nav>" + f"<a>{long}</a>", "<script>" + long]
    df = spark.createDataFrame([(i, p, "x", "y") for i, p in enumerate(pages * 2)],
                               "page_id long, html string, text string, row string")
    got = {r["row"]["page_id"]: r["text"] for r in extraction.extract(df).collect()}
    body = long.strip()
    want = ["", "", "", "", None, body, body, body + " &é 😀", body, "", ""]
    assert len(got) == 22
    assert all(w is None or got[i] == w == got[i + 11] for i, w in enumerate(want))
    assert extraction.extract(df.limit(0)).count() == 0


def test_layouts_named_like_frames():
    say = lambda i: f"paragraph {i} of a text that runs on for a good many words and has no link at all"
    art = "<p>" + "<p>".join(map(say, range(4)))
    want = "\n".join(map(say, range(4)))
    tree = extraction.trained()
    foot = "<div><a>Home</a></div><div><a>Terms</a></div>"
    for page in (
            f"<body class='has-sidebar'>{art}{foot}", f"<div class='content no-nav'>{art}</div>{foot}",
            f"<article class='post with-comments'>{art}</article>{foot}", f"<main id='search'>{art}</main>",
            f"<html class='nav'><body id='header'><article>{art}</article>",
            f"<div class='site-header'><div class='related wide'>{art}</div></div>{foot}",
            f"<div><p class='ad'>Buy now.{art}</div>{foot}",
            f"<table><tr><td class='menu'>Menu<td>{art}</table>{foot}",
            f"<dl><dt class='promo'>Offer<dd>{art}</dl>{foot}", f"<ul><li class='ad'>Buy<li>{art}</ul>{foot}"):
        assert extraction.main_text(page, tree) == want, page
    assert extraction.main_text(f"<nav><a>Home</a></nav><div><a>News</a></div>{art}{foot}", tree) == want
    linked = f"<article>{art}<div class='ad'><a>Buy it</a></div></article>"
    assert extraction.main_text(linked, tree) == want
    thread = "<div class='comments'>" + f"<p>{say(9)}</p>" * 9 + "</div>"
    for page in (f"<article>{art}{thread}</article>", f"<article>{art}</article>{thread}"):
        assert extraction.main_text(page, tree) == want, page


def test_unclosed_silent_elements_end():
    say = lambda i: f"paragraph {i} of a text that runs on for a good many words and has no link at all"
    art, want = "".join(f"<p>{say(i)}</p>" for i in range(4)), "\n".join(map(say, range(4)))
    tree = extraction.trained()
    for tag in ("button", "svg", "noscript", "select", "object"):
        for page in (f"<{tag}>Share<article>{art}</article>", f"<div><{tag}>Share</div><article>{art}</article>",
                     f"<{tag}>Share<article>{art}</article><{tag}>Again</{tag}>", f"<{tag}>Share<div>{art}</div>",
                     f"<article>{art}<{tag}>Share</{tag}></article>", f"<{tag}/><article>{art}</article>"):
            assert extraction.main_text(page, tree) == want, page
    inner = f"<article>{art}<noscript><div><p>{say(9)}</p></div></noscript></article>"
    assert extraction.main_text(inner, tree) == want
    assert extraction.main_text(f"<template><button>x<section>{art}</section></template>", tree) == ""


def plain_katz(rows):
    toks = [[w for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
            + ["\n"] for _, t in rows]
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    uni, bi = Counter(), Counter()
    for x, out in zip(toks, held):
        if not out:
            uni.update(x)
            bi.update(zip([" ", *x], x))
    n, v = sum(uni.values()), len(uni)
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    d = katz.discounts(Counter(bi.values()))
    after = defaultdict(dict)
    for (a, w), c in bi.items():
        after[a][w] = c

    def p(a, w):
        row = after.get(a)
        if not row:
            return p1(w)
        c, s = sum(row.values()), sum(d.get(x, 1) * x for x in row.values())
        full = c + (s > c - 1e-9)
        if w in row:
            return d.get(row[w], 1) * row[w] / full
        return (1 - s / full) / (1 - sum(map(p1, row))) * p1(w)
    for a in list(after)[:40]:  # exactly normalised, the unknown word included
        assert abs(sum(p(a, w) for w in uni) + p(a, "\0 none") - 1) < 1e-9
    for (k, _), x, out in zip(rows, toks, held):
        yield (k, out, len(x), sum(uni[w] > 0 for w in x), n, sum(math.log10(p1(w)) for w in x),
               sum(math.log10(p(a, w)) for a, w in zip([" ", *x], x)))


def same(got, want):
    order = lambda r: (str(r[0]), r[2], r[5])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a[5:], b[5:]))


def test_scores_of_all_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op5_katz_scores(spark, sf).collect()
    same(got, list(plain_katz(rows)))
    out = [r for r in got if r["held_out"]]
    assert out and sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_scores_of_odd_rows(spark):
    texts = [None, "", "a b a b a c", "A B", "é 😀 a", "x " * 40000, "a b", "q r s t"] * 3
    rows = [*enumerate(texts), (3, "A B"), (None, "a b")]
    df = spark.createDataFrame([(k, t, 1, 2) for k, t in rows], "doc_id long, text string, rid int, w int")
    same(katz.scored(df).collect(), list(plain_katz(rows)))
    assert katz.scored(df.limit(0)).count() == 0


def test_scores_with_frequent_contexts_dealt(spark):
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    df = spark.createDataFrame([(*r, [1]) for r in [*rows, *rows[:5], (None, None)]],
                               "doc_id long, text string, cut array<int>")
    got = katz.scored(df.coalesce(2), cut_bytes=20_000, bucket=2000, hot=40).collect()
    same(got, list(plain_katz([*rows, *rows[:5], (None, None)])))


def test_scratch_tables_of_scores(spark, tmp_path, monkeypatch):
    """What stays on disk while the result is read is far below two hashes for each pair."""
    monkeypatch.setattr(session, "scratch_root", lambda _: str(tmp_path))
    sf = "/root/testdata/sf0.01"
    out = katz.scored(spark.read.parquet(f"{sf}/documents.parquet"))
    assert out.count() == 1000
    tables = {p.name.split("-")[0] for p in tmp_path.iterdir()}
    assert tables == {"cuts", "back"}
    size = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet"))
    tokens = out.agg(F.sum("n_tokens")).first()[0]
    assert size < 12 * tokens
