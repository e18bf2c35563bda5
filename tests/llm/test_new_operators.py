"""Fill-in-middle, collocations and main text against brute force, SQL-free, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wovengraph.llm import collocations, fill_middle, main_text

BIG = 2**60 + 1
SCHEMA = "doc_id long, text string, lang string, form string, n long, h1 string, output string, word string, score double"


def frame(spark, rows):
    """Rows (id, text, lang) with columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "h", "o", "w", 0.5) for r in rows], SCHEMA)


# Fill in the middle.


def test_boundaries_against_brute_force():
    rng, kinds = random.Random(1), set()
    for turn in range(120):
        n = rng.choice([0, 1, 5, 3000, 70_000, 200_000]) if turn < 40 else rng.randint(0, 500)
        share = rng.choice([0.001, 0.1, 0.5, 0.99])
        letters = np.random.default_rng(turn).choice(list("\naé😀"), n, p=[share, (1 - share) / 2, (1 - share) / 4, (1 - share) / 4])
        text = "".join(letters)
        lines = re.findall(r"[^\n]*\n|[^\n]+", text)
        ends, own = np.cumsum([0, *map(len, lines)]), fill_middle.Boundaries(text)
        kinds |= {x.kind for x in own.containers}
        assert len(own) == len(lines)
        for k in range(len(lines) + 1) if len(lines) < 300 else rng.sample(range(len(lines) + 1), 100):
            assert own.offset(k) == ends[k]
    assert kinds == {fill_middle.ARRAY, fill_middle.BITMAP, fill_middle.RUNS}


def brute(i, text, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, _, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return len(lines), "plain", None, None, text
    a, b = sorted((h1 % (len(lines) + 1), h2 % (len(lines) + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < 50:
        return len(lines), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(lines), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark):
    long = "".join(f"line {k} é\n" for k in range(40_000))
    texts = [None, "", "\n", "a", "a\r\nb\n\nc", "one\ntwo <S> three\n", "<\n<P\n>S>\n<M\nend<", "😀\n x\n", long, long, "x\x00y\n\n"]
    rows = [(k, t, None) for k, t in enumerate(texts)] + [(None, "a\nb\n", "en"), (BIG, "a\nb\nc", "en"), (BIG + 2, "a\nb\nc", "en"), (BIG, "a\nb\nc", "en")]
    rows += [(100 + k, "".join(random.Random(k).choices("ab\n<PSM>", k=30)), "en") for k in range(150)]
    got = fill_middle.fill_in_middle(frame(spark, rows))
    got = got.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    key = lambda x: str(x)
    assert sorted(map(key, [tuple(r) for r in got])) == sorted(map(key, [(i, *brute(i, t), t or "") for i, t, _ in rows]))
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(frame(spark, rows).limit(0)).isEmpty()
    half = fill_middle.fill_in_middle(frame(spark, [(k, "a\nb", "en") for k in range(400)]), percent=30).groupBy("form").count().collect()
    assert 200 < {r["form"]: r["count"] for r in half}["plain"] < 340
    with pytest.raises(ValueError):
        fill_middle.restored(F.col("output"), F.col("form"), ("<P>", "<S>", "<S>"))


# Collocations.


def test_double_array_against_a_dictionary():
    rng = np.random.default_rng(1)
    for turn in range(60):
        top, depth, n = int(rng.choice([3, 20, 3000, 2**21])), int(rng.integers(1, 5)), int(rng.integers(0, 60))
        rows = np.unique(np.minimum(rng.zipf(1.3, (n, depth)) - 1, top - 1).astype(np.int32), axis=0).reshape(-1, depth)
        rng.shuffle(rows)
        noise = np.where(rng.random(300) < 0.1, -1, np.minimum(rng.zipf(1.3, 300) - 1, top - 1))
        flat = np.concatenate([noise, *[np.append(r, -1) for r in rows], np.full(depth + 1, -1)]).astype(np.int32)
        at, row = collocations.DoubleArray(rows).walk(flat, depth)
        known = {tuple(r): k for k, r in enumerate(rows)}
        assert list(zip(at.tolist(), row.tolist(), strict=True)) == [(p, known[w]) for p in range(len(flat) - depth) if (w := tuple(flat[p : p + depth])) in known]


def test_words_in_chunks():
    rng = random.Random(5)
    for _ in range(200):
        raw = "".join(rng.choices("aB é\t.\n,-😀", k=rng.randint(0, 80))).encode()
        want = [w for part in collocations.words(raw) for w in part]
        for chunk in (1, 2, 7, 30):
            assert [w for part in collocations.words(raw, chunk) for w in part] == want


def brute_collocations(rows, least, top):
    counts, totals = {}, Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                for at in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[at : at + k])] += 1
    out = []
    for lang, own in counts.items():
        often, found = {p: f for p, f in own.items() if f >= least}, []
        for phrase, a in often.items():
            if len(phrase) < 2:
                continue
            score, k = min((1000 * a * totals[lang] // (own[phrase[:k]] * own[phrase[k:]]), k) for k in range(1, len(phrase)))
            inside = any(f >= a and len(q) > len(phrase) and any(q[s : s + len(phrase)] == phrase for s in range(len(q))) for q, f in often.items())
            if not inside:
                found.append((-score, -a, " ".join(phrase).encode(), own[phrase[:k]], own[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(3)
    vocabulary = ["The", "of", "rivér", "a\xa0b", "x\x1fy", "Ünder", "new", "york", "city", "ÀB", "\x00"]
    rows = []
    for k in range(400):
        words = []
        while len(words) < rng.randint(0, 60):
            words += rng.choice([[rng.choice(vocabulary)], ["new", "york"], ["New", "York", "city", "hall", "park"], ["of", "the"]])
        rows.append((k if k % 7 else None, "".join(w + rng.choice([" ", " ", "  ", "\t", " ", ". ", ",", "\r\n"]) for w in words), rng.choice(["en", "de", None])))
    return rows + [(1, None, "en"), (2, "", None), (3, " \t\n", "en"), (4, "rare words only here", "xx"), (5, "new york " * 3000, "en")] + rows[:20]


@pytest.mark.parametrize("limits", [{}, {"BLOCK": 7, "WORDS": 5, "SHARD": 500, "HELD": 6, "BATCH": 3, "DIGIT": 2}])
def test_collocations_against_brute_force(spark, monkeypatch, limits):
    """Also with limits so small that there are many tries, dictionaries, shards and chunks."""
    for name, value in limits.items():
        monkeypatch.setattr(collocations, name, value)
    rows = corpus()
    got = sorted(tuple(r) for r in collocations.collocations(frame(spark, rows).repartition(5), least=30, top=25).collect())
    assert got == brute_collocations(rows, 30, 25) and len({r[0] for r in got}) == 3


def test_no_collocations(spark):
    assert collocations.collocations(frame(spark, [(1, "a b c", "en")]).limit(0)).isEmpty()
    assert collocations.collocations(frame(spark, [(1, "a b c", "en"), (2, None, None)])).isEmpty()


# Main text.

TEXT = "<p>The river rises in the hills and runs for forty miles, past mills and meadows, to the sea.</p>"
PLAIN = "The river rises in the hills and runs for forty miles, past mills and meadows, to the sea."
PAGES = [
    (
        "<html><head><title>T</title><script>var a='</p>';</script></head><body><header><h1>Site</h1><p>Slogan here.</p></header><nav><a href=x>Home</a></nav>"
        f"<main><article><h1>Head</h1>{TEXT}<p>Short.</p><aside>Related: x</aside><ul><li>One<li>Two</ul><div class='ad'>Buy &amp; go.</div><footer>Posted in x</footer></article>"
        "<section id='comments'><h2>Comments</h2><article class='comment'><p>Great text, thanks a lot.</p></article></section></main><aside>Side</aside>"
        "<form><label>Name</label><input></form><footer>&copy; 2020</footer></body></html>",
        f"Head {PLAIN} Short. One Two",
    ),
    (
        f"<body><div><a href=a>Home</a> <a href=b>News</a> <a href=c>About</a></div><div><h2>The river</h2>{TEXT}<p>Short.</p>{TEXT}{TEXT}</div>"
        "<div><a href=1>Privacy</a> | <a href=2>Terms</a></div><div>&copy; 2020 Company</div></body>",
        f"The river {PLAIN} Short. {PLAIN} {PLAIN}",
    ),
    (
        "<body><div id='cookie-banner'>We use cookies to improve your experience, and we hope you agree.</div><div class='container'><div class='sidebar-left'>"
        f"<p>Subscribe to our letter, it is free and fun.</p></div><div class='post-content with-sidebar'><h1>Title</h1>{TEXT}<p>Tiny</p><div class='related-posts'>More: abc</div></div>"
        "<div class='comments-area'><p>I liked this piece very much, thank you for it.</p></div></div></body>",
        f"Title {PLAIN} Tiny",
    ),
    ("<article><h1>A</h1><p>One<br><p><b>Two <i>three</i></b>four<p>x&nbsp;&nbsp;y &lt;tag&gt; a &lt b < c</article><footer>f</footer>", "A One Two threefour x y <tag> a < b < c"),
    (f"<body class='has-cookie-notice'><article class='post hentry comments-open tag-social'><h1>H</h1>{TEXT}</article></body>", f"H {PLAIN}"),
    ("<article><p title=it's>a</p><p data-x='>'>b</p><p class=\"x>y\">c</p><!-- <p>no</p> --><!--> d<p clas", "a b c d"),
    ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</p><template><p>no</p></template><svg><title>no</title></svg><textarea>no</textarea></article>", "yes"),
    ("<nav><a>x</a></nav><footer>y</footer>", ""),
    ("", ""),
    (None, ""),
]


def test_pages():
    for html, want in PAGES:
        assert main_text.main_text(html) == want


def test_cut_against_all_labellings():
    rng = random.Random(3)
    for _ in range(800):
        n = rng.randint(1, 8)
        gain = [rng.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(n)]
        edges = [{} for _ in range(n)]
        for _ in range(rng.randint(0, 14)):
            a, b = rng.randrange(n), rng.randrange(n)
            if a != b:
                edges[a][b] = edges[b][a] = edges[a].get(b, 0) + rng.choice([0.25, 0.5, 1, 2])

        def cost(x):
            own = sum(max(g, 0) if not kept else max(-g, 0) for g, kept in zip(gain, x, strict=True))
            return own + sum(w for a in range(n) for b, w in edges[a].items() if a < b and x[a] != x[b])

        ways = list(itertools.product([False, True], repeat=n))
        least, got = min(map(cost, ways)), main_text.cut(gain, edges)
        assert abs(cost(got) - least) < 1e-9
        assert sum(got) == min(sum(x) for x in ways if abs(cost(x) - least) < 1e-9)


def test_extract_keeps_rows_and_ids(spark):
    rows = [(k, f"u{k}", h, "a", 0.5) for k, (h, _) in enumerate(PAGES)] + [(None, None, TEXT, "a", 1.0), (BIG, "x", TEXT, "a", 1.0), (BIG + 2, "x", TEXT, "a", 1.0), (BIG, "x", TEXT, "a", 1.0)]
    big = "<article>" + "<p>Some words stand here, again.</p>" * 20_000 + "</article>"
    pages = spark.createDataFrame([*rows, (7000, "big", big, "b", 0.0)], "page_id long, url string, html string, text string, key double")
    got = main_text.extract(pages, weights=main_text.PRIOR).collect()
    assert sorted(str(r["id"]) for r in got) == sorted(str(r[0]) for r in rows + [(7000,)])
    by = {r["id"]: r for r in got}
    assert all(by[k]["text"] == want and by[k]["n_chars"] == len(want) for k, (_, want) in enumerate(PAGES))
    assert by[7000]["text"].split(", again.")[:-1] == ["Some words stand here"] + [" Some words stand here"] * 19_999
    assert main_text.extract(pages.limit(0)).isEmpty()


def test_learned_weights_on_pages_without_hints(spark):
    """What is learned where elements tell must hold where they don't: held-out accuracy on pages stripped to divs."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = main_text.learn(pages)
    assert not np.array_equal(weights, main_text.PRIOR)
    assert np.allclose(weights, main_text.learn(pages.repartition(3)))
    whole = {r["id"]: r["text"] for r in main_text.extract(pages, weights).collect()}
    bare = pages.withColumn("html", F.regexp_replace("html", "<(/?)(?:article|nav|footer)>", "<$1div>"))
    bare = bare.withColumn("html", F.regexp_replace("html", ' class="ad"', ""))
    share = []
    for r in main_text.extract(bare, weights).collect():
        want, got = Counter(whole[r["id"]].split()), Counter(r["text"].split())
        share.append(2 * sum((want & got).values()) / (sum(want.values()) + sum(got.values())))
    assert np.mean(share) > 0.95


def test_trie_walks_in_strides():
    rng = np.random.default_rng(1)
    rows = np.unique(rng.integers(0, 50, (2000, 3)).astype(np.int32), axis=0)
    flat = np.concatenate([rng.integers(-1, 50, 1 << 20).astype(np.int32), np.full(3, -1, dtype=np.int32)])
    trie = collocations.DoubleArray(rows)
    tracemalloc.start()
    at, row = trie.walk(flat, 3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    place = {tuple(r): i for i, r in enumerate(rows.tolist())}
    found = [(i, place[t]) for i, t in enumerate(zip(*(flat[k : k + (1 << 20)].tolist() for k in range(3)), strict=True)) if t in place]
    assert list(zip(at.tolist(), row.tolist(), strict=True)) == found
    assert most < 24 * len(flat)
