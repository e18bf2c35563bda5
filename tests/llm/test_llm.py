"""The training-data operators against brute force, libraries and round trips, and on odd rows."""

from __future__ import annotations

import hashlib
import json
import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from wovengraph.llm import bpe, common, exact_dedup, hyperplanes, jaccard, language, licences, packing, quality, rans, resharding
from wovengraph.llm.common import components, numbered
from wovengraph.llm.queries import vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"
LONG = " ".join(f"word{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "Same text."), (5, "same text."), (5, "same text."), (None, "No id here."), (8, LONG), (9, LONG), (10, "ÉÀ ÉÀ x")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", None, None, 0.5) for i, t in ODD]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet").cache()


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_numbered_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.pmod(F.col("id") * 7919, F.lit(1000)).alias("v"))
    for order in (["v"], []):
        by = defaultdict(list)
        for r in numbered(df, ["k"], order).collect():
            by[r["k"]].append((r["rank"], r["v"]))
        for rows in by.values():
            rows.sort()
            assert [r for r, _ in rows] == list(range(len(rows)))
            assert not order or [v for _, v in rows] == sorted(v for _, v in rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 300), (300, 200)] + [(500, 501 + i) for i in range(50)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[200] == got[300] == 100 and got[530] == 500
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_quality(spark, odd, none):
    labels, documents = spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.rank_quality(documents, labels).join(labels, "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert out and sum(r["predicted"] == r["quality"] for r in out) / len(out) > 0.95
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    got = quality.rank_quality(odd, labels).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert quality.rank_quality(none, labels).count() == 0
    assert len({r["score"] for r in quality.rank_quality(odd, labels.limit(0)).collect()}) == 1


def test_exact_duplicates(odd, none):
    groups = defaultdict(list)
    for i, t in ODD:
        groups[folded(t)].append(i)
    got = exact_dedup.exact_duplicates(odd).collect()
    want = []
    for i, t in ODD:
        ids = [x for x in groups[folded(t)] if x is not None]
        keep = max(ids) if ids else None
        want.append((i, keep, len(groups[folded(t)]), i == keep, hashlib.sha256(folded(t).encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in exact_dedup.unique(odd).collect()) == sorted(["2", "3", "5", "None", "9", "10"])


def test_clashing_chunks_are_told_apart(spark, monkeypatch):
    """With every hash equal, only the content can tell texts apart."""
    docs = spark.createDataFrame([(1, "abc"), (2, "abd"), (3, "abc"), (4, "")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.exact_duplicates(docs).collect()}
    assert got == {1: (3, 2), 2: (2, 1), 3: (3, 2), 4: (4, 1)}


def test_bpe_against_the_library(spark, documents, odd, none):
    path = vocabulary("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(5)
    letters = "aabdeehinost \n'.,!-_=0123456789ÉèüßñΣσςİ²½中文あ한😀́\xa0\x85"
    texts = [t for _, t in ODD if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 120))) for _ in range(500)]
    texts += ["a" * 5000, "ha" * 3000, "=-" * 900, "<|endoftext|> I'll 'S<|startoftext|>"]
    words = bpe.Words(bpe.Merges(path))
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(b"".join(bpe.encoded(text, words)), dtype="<u4").tolist()
        assert got == want, text[:50]
        machine = bpe.Decoder(words.merges, True)
        parts = [machine.feed(got[k : k + 7]) for k in range(0, len(got), 7)] + [machine.finish()]
        assert "".join(parts) == library.decode(want, skip_special_tokens=False)
    rows = bpe.round_trip(documents, path).join(documents, "doc_id").limit(40).collect()
    for r in rows:
        ids = library.encode(r["text"], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
    plain = {r["doc_id"]: r["text"] for r in bpe.decode(bpe.encode(odd, path), path).collect()}
    assert plain[1] == "" and plain[4] == "same text . " and plain[10] == "éà éà x "
    assert bpe.round_trip(none, path).count() == 0


@pytest.mark.parametrize("counts", [{0: 9, 1: 0, 2: 30}, {0: 1}, {0: 5, 1: 5, 5: 7}, {0: 100, 1: 3, 2: 3, 3: 2}])
def test_flow_moves_the_fewest_bytes(counts):
    rng = random.Random(3)
    sizes = {i: sorted(rng.randint(1, 50) for _ in range(n)) for i, n in counts.items()}
    total, shards = sum(counts.values()), 4
    floor, extra = divmod(total, shards)
    ceil = floor + (extra > 0)
    marginal = {i: sizes[i][n - ceil] for i, n in counts.items() if i < shards and n >= ceil and extra}
    blocks = resharding.solve(counts, shards, marginal)
    new = defaultdict(int)
    for b in blocks:
        new[b.new] += b.end - b.start
    assert sum(new.values()) == total and all(floor <= new[j] <= ceil for j in range(shards))
    moved = sum(sum(sizes[b.old][b.start : b.end]) for b in blocks if b.old != b.new)
    least = None
    for given in range(2 ** len(counts)):
        more = [i for k, i in enumerate(sorted(counts)) if given >> k & 1]
        if len(more) > extra or any(i >= shards or counts[i] < ceil for i in more):
            continue
        cost = sum(sum(sizes[i][: max(0, n - (ceil if i in more else floor))] if i < shards else sizes[i]) for i, n in counts.items())
        least = cost if least is None else min(least, cost)
    assert moved == least


def test_resharding(documents, odd, none):
    for docs in (documents, odd):
        old = resharding.lay_out(docs, F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)) % 3, F.lit(2)))
        rows = resharding.slots(resharding.reshard(old, 4), F.col("row.doc_id").alias("i"), F.col("row.text").alias("t"), F.col("size")).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
            assert r["size"] == len((r["t"] or "").encode()) + 1
        assert sorted(str(r["i"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs.collect())
        assert all(sorted(s) == list(range(len(s))) for s in by.values())
        sizes = [len(by[j]) for j in range(4)]
        assert max(sizes) - min(sizes) <= 1
    empty = resharding.reshard(resharding.lay_out(none, F.lit(0)), 4)
    assert resharding.slots(empty, F.col("size")).count() == 0


def _sets(rows, width):
    out = []
    for i, text in rows:
        words = folded(text).encode().split()
        out.append((i, frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()))
    return out


def test_jaccard_components(spark, odd, none):
    rng = random.Random(11)
    vocabulary_ = [f"w{i}" for i in range(400)]
    rows = list(ODD)
    shared = [rng.choice(vocabulary_) for _ in range(60)]
    for g in range(12):
        base = [rng.choice(vocabulary_) for _ in range(rng.choice([5, 40, 150]))]
        for k in range(rng.choice([2, 5, 40])):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary_)
            rows.append((1000 + 100 * g + k, " ".join(text + (shared if k % 3 == 0 else []))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for width, percent in ((4, 85), (5, 80)):
        sets = [s for s in _sets(rows, width) if s[0] is not None]
        root = {i: i for i, _ in sets}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for k, (a, x) in enumerate(sets):
            for b, y in sets[:k]:
                if x and y and 100 * len(x & y) >= percent * len(x | y):
                    p, q = sorted((find(a), find(b)))
                    root[q] = p
        got = jaccard.jaccard_components(docs, width, percent).collect()
        assert len(got) == len(rows)
        assert {(r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, find(i)) for i, _ in sets}
        assert sorted(r["n_shingles"] for r in got) == sorted(len(s) for _, s in _sets(rows, width))
    assert jaccard.jaccard_components(none).count() == 0
    assert sorted(str(r["doc_id"]) for r in jaccard.representatives(odd).collect()) == ["1", "10", "2", "3", "4", "8", "None"]


def test_language(documents, odd, none):
    rows = language.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.9
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    assert language.identify(none).count() == 0


def test_mixture_proportions():
    table = np.full((language.CELLS, 3), 1e-9)
    a, b = np.unique(language.cells("alpha beta gamma")), np.unique(language.cells("qux zyx vwu"))
    table[a, 0], table[b, 1] = 1 / len(a), 1 / len(b)
    model = language.Languages(["x", "y", "z"], table)
    assert model.mixture("alpha beta gamma " * 3) == ("x", 1.0)
    name, share = model.mixture("alpha beta gamma " * 6 + "qux zyx vwu " * 4)
    assert name == "x" and 0.5 < share < 0.9


def test_licences(spark, none):
    files = [
        ("a/b/c.txt", "Hello there.\nReleased under the MIT License.\nmore"),
        ("a/LICENSE", "Licensed under CC BY-NC 4.0."),
        ("a/b/d.txt", "nothing here"),
        ("a/b/LICENSE.md", "This work is licensed under the GNU General Public License, version 3."),
        ("a/x.txt", None),
        ("e/x.txt", ""),
        (None, "Released under the MIT License."),
    ] + [(f"f/{i}.txt", f"plain words number {i}") for i in range(60)]
    rows = licences.scan(spark.createDataFrame(files, "path string, text string").withColumn("score0", F.lit(1))).collect()
    got = {r["path"]: (r["own"], r["licence"], r["inherited_from"]) for r in rows}
    assert len(rows) == len(files)
    assert got["a/b/c.txt"] == ("MIT", "MIT", None)
    assert got["a/b/d.txt"] == (None, "GPL-3.0", "a/b")
    assert got["a/x.txt"] == (None, "CC-BY-NC-4.0", "a")
    assert got["e/x.txt"] == (None, None, None) and got[""] == ("MIT", "MIT", None)
    assert licences.scan(none.withColumnRenamed("source", "path")).count() == 0


def test_licences_that_most_files_carry(spark):
    """A licence in nearly every file, a notice broken over lines, a whole licence text, a very long one, clashing names."""
    mit = dict((n, t) for n, t in licences.TEMPLATES)["MIT"]
    files = [(f"a/{i}.txt", f"Item number {i}.\nReleased under the MIT License.\nMore of item {i}.") for i in range(40)]
    files += [
        ("b/x.py", "# About it\n# Licensed under the Apache\n# License, Version 2.0.\n\ncode"),
        ("c/LICENSE", "Some name\n\nCopyright 2001\n\n" + mit.replace(". ", ".\n\n")),
        ("c/d/e.txt", "plain"),
        ("g/long.txt", "filler words of no licence " * 40_000 + "\nReleased under the MIT License."),
    ]
    docs = spark.createDataFrame(files, "path string, text string").withColumn("score", F.lit(1)).withColumn("row", F.lit(2))
    rows = licences.scan(docs)
    assert rows.columns == ["path", "given_score", "row", "own", "score", "licence", "inherited_from"]
    got = {r["path"]: (r["own"], r["licence"], r["inherited_from"]) for r in rows.collect()}
    assert all(got[f"a/{i}.txt"] == ("MIT", "MIT", None) for i in range(40)) and got["g/long.txt"][0] == "MIT"
    assert got["b/x.py"][0] == "Apache-2.0" and got["c/LICENSE"][0] == "MIT" and got["c/d/e.txt"] == (None, "MIT", "c")


def test_block_round_trip():
    rng = np.random.default_rng(2)
    for n in (1, 2, 63, 64, 5000, 300_000):
        ids = rng.zipf(1.3, n) % 5000
        counts = np.bincount(ids)
        table = rans.Frequencies(counts.nonzero()[0], counts[counts.nonzero()[0]])
        block = rans.encode_block(ids, table)
        assert (rans.decode_block(block, table) == ids).all()
        if n == 300_000:
            lanes = min(rans.LANES, n // 64)
            assert (rans.decode_block(block, table, 1) == ids[rans.CHECKPOINT * lanes :]).all()
        with pytest.raises(ValueError):
            rans.decode_block(block[:-9] + b"\x00" + block[-8:] if block[-9] else block[:-9] + b"\x01" + block[-8:], table)


def test_token_files(odd, none):
    path = vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    before, want = 0, []
    for i, t in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, before, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        before += len(ids)
    written = rans.write(odd, path)
    assert sorted(map(tuple, written.checksums().collect()), key=lambda r: r[1]) == want
    assert [len(r["ids"]) for r in written.read().orderBy("start").collect()] == [n for _, _, n, _ in want]
    assert rans.write(none, path).checksums().count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    vectors = []
    for label in (1, 2, None):
        for _ in range(6):
            base = rng.standard_normal(16)
            vectors += [(label, (base + 0.08 * rng.standard_normal(16)).tolist()) for _ in range(8)]
        vectors += [(label, [1.0] * 16)] * 5 + [(label, [2.0] * 16)]
    vectors += [(1, None), (1, [0.0] * 16), (1, [float("nan")] * 16), (1, [None] * 16), (1, [1.0] * 3), (1, []), (2, [float("inf")] * 16)]
    rows = [(i, v, k) for i, (k, v) in enumerate(vectors)]
    got = {r["vec_id"]: r for r in hyperplanes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=0.999999).collect()}
    good = {i: np.array(v) / np.linalg.norm(v) for i, v, k in rows if k is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    links = defaultdict(set)
    for i in good:
        for j in good:
            if i != j and rows[i][2] == rows[j][2] and len(good[i]) == len(good[j]) and good[i] @ good[j] >= 0.98:
                links[i].add(j)
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            fresh = links[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(seen), min(seen) == i)
    assert hyperplanes.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def _check_bins(rows, sizes):
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        end = 0
        for r in held:
            assert r["bin_offset"] == end
            end += r["length"]
        assert held[0]["bin_size"] == min(s for s in sizes if s >= end)


def test_packing(spark, odd, none):
    sizes = (8, 16, 64)
    rng = random.Random(9)
    lengths = [(i, rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 30, 63, 64, 65, 200])) for i in range(700)]
    df = spark.createDataFrame(lengths, "doc_id long, n long")
    rows = packing.best_fit(df.withColumn("text", F.lit("")), sizes, F.col("n")).collect()
    _check_bins(rows, sizes)
    whole = defaultdict(int)
    for r in rows:
        whole[r["doc_id"]] += r["length"]
    assert dict(whole) == dict(lengths)
    rows = packing.best_fit(odd).collect()
    _check_bins(rows, packing.SIZES)
    assert sum(r["length"] for r in rows) == sum(len((t or "").split()) + 1 for _, t in ODD)
    assert packing.best_fit(none).count() == 0


def test_pipeline(spark, documents):
    docs, columns = documents, documents.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA).cache()
        assert kept.columns == columns and 0 < kept.count() <= docs.count(), name
        docs = kept
    assert len({folded(r["text"]) for r in docs.collect()}) == docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    _check_bins(packed, packing.SIZES)


def test_large_ids_beside_null_ids(spark):
    """A batch with a null id keeps ids above 2 ** 53 as they are, and a null id stays null."""
    ids = [2**53 + 1, 2**62 + 1, None, 2**53 + 3]
    docs = spark.createDataFrame([(i, f"A text of its own, number {k}, in plain words.", "en") for k, i in enumerate(ids)], "doc_id long, text string, lang string")
    docs = docs.coalesce(1)
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    written = rans.write(docs, vocabulary("byte_bpe_50k.json"))
    results = [
        quality.rank_quality(docs, labels),
        language.identify(docs),
        bpe.round_trip(docs, vocabulary("word_bpe_49k.json")),
        jaccard.jaccard_components(docs),
        packing.best_fit(docs),
        written.checksums().withColumnRenamed("id", "doc_id"),
        written.read().withColumnRenamed("id", "doc_id"),
        exact_dedup.exact_duplicates(docs),
    ]
    for df in results:
        assert {r["doc_id"] for r in df.collect()} == set(ids)


def test_repeated_vector_ids(spark):
    """Two vectors with one id stay apart; null ids link and are kept only without another id."""
    rows = [
        (1, [1.0, 0.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0, 0.0], 0), (2, [0.0, 0.0, 1.0, 0.0], 0), (3, [0.0, 0.0, 0.0, 1.0], 0),
        (4, [0.0, 1.0, 0.001, 0.0], 0), (None, [0.0, 0.0, 1.0, 0.001], 0), (None, [-1.0, 0.0, 0.0, 0.0], 0),
    ]
    got = hyperplanes.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), recall=0.999999).collect()
    found = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got)
    assert found == [(0, 0, 0, True), (0, 1, 2, False), (1, 0, 1, True), (1, 1, 1, True), (2, 1, 2, True), (3, 0, 3, True), (4, 1, 1, False)]


def test_texts_that_meet_under_powers(spark):
    """Two words that alternate by the parity of their places' bits have no common hash."""
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    words = ["".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)]
    got = jaccard.jaccard_components(spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0, 1}


def test_repeated_ids_and_clashing_names(spark):
    """Unrelated texts under one id both stay, and working names may be columns of the input."""
    a = " ".join(f"a{i}" for i in range(60))
    b = " ".join(f"b{i}" for i in range(60))
    rows = [(3, a), (5, a + " end"), (5, b), (6, b + " end"), (7, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("_gone", "_id", "_sha", "_text_sha", "mark", "id", "row", "n", "keep", "sha", "first"):
        docs = docs.withColumn(name, F.lit(name))
    one = jaccard.representatives(docs)
    assert one.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in one.collect()) == [(3, a), (5, b)]
    assert all(r["_gone"] == "_gone" and r["mark"] == "mark" for r in one.collect())
    unique = exact_dedup.unique(docs)
    assert unique.columns == docs.columns
    assert sorted(r["doc_id"] for r in unique.collect()) == [5, 5, 6, 7]


def test_words_of_a_batch_are_those_of_each_text(monkeypatch):
    """Words cut side by side, in short slices, have the ids that the library gives each text."""
    tokens = rans.Tokens(vocabulary("byte_bpe_50k.json"))
    assert tokens.direct is not None
    monkeypatch.setattr(rans, "SLICE", 60)
    draw, signs = random.Random(3), "aAbet rin01é-='''stmdrevl 2²½ \n\t\r\x1c\x1f\xa0\x85 漢"
    for _ in range(300):
        texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 80))) for _ in range(draw.randint(0, 6))]
        texts += ["", "x<|endoftext|> y", "it's we're" * 30]
        for text, ids in zip(texts, tokens.encode_all(texts), strict=True):
            assert np.frombuffer(ids, "<u2").tolist() == tokens.library.encode(text, add_special_tokens=False).ids, repr(text)


def test_merges_not_in_order_of_ids_are_left_to_the_library(tmp_path):
    with open(vocabulary("byte_bpe_50k.json")) as f:
        stored = json.load(f)
    stored["model"]["merges"] = stored["model"]["merges"][::-1]
    path = tmp_path / "reversed.json"
    path.write_text(json.dumps(stored))
    tokens = rans.Tokens(str(path))
    assert tokens.direct is None
    assert np.frombuffer(tokens.encode("the words there"), "<u2").tolist() == tokens.library.encode("the words there", add_special_tokens=False).ids


# Sets alike but not linked, and what is left on disk.


def test_jaccard_alike_but_not_linked(spark, monkeypatch):
    """Each text of a group keeps 35 of 50 words in a row and has own ones after them: all share regions, few are linked."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(50)]
    texts = [base[: 35 if i % 40 else 49] + [f"x{rng.randrange(10**9)}" for _ in range(15 if i % 40 else 1)] for i in range(400)]
    for t in texts[1::2]:
        t[3:15] = base[4:16]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    checked, linked = [], jaccard._linked

    def counted(pairs, whole, percent):
        checked.append(pairs.count())
        return linked(pairs, whole, percent)

    monkeypatch.setattr(jaccard, "_linked", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs, 1, 85).collect()}
    sets, up = [frozenset(t) for t in texts], list(range(400))
    for a in range(400):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                up = [min(up[a], up[b]) if x in (up[a], up[b]) else x for x in up]
    assert got == dict(enumerate(up))
    assert len(set(up)) < 400 and sum(checked) < 4000


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    sets = [rng.choice(pool, n, replace=False) for n in (0, 1, 5, 60, 700, 2500, 2990) for _ in range(3)]
    bits = jaccard.sketches(np.concatenate(sets), np.cumsum([0, *map(len, sets)])).view(np.uint64)
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            apart = len(set(a.tolist()) ^ set(b.tolist()))
            assert int(np.bitwise_count(x ^ y).sum()) <= apart and (apart > 5 or int(np.bitwise_count(x ^ y).sum()) % 2 == apart % 2)


def test_jaccard_leaves_little_on_disk(spark, tmp_path, monkeypatch):
    folders = itertools.count()
    monkeypatch.setattr(common, "shared_folder", lambda session: f"{tmp_path}/{next(folders)}")
    words = [f"a{i} b c d{i % 9} e f g h i{i % 4} j k l m n o p" for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert jaccard.jaccard_components(docs).count() == 300
    columns = [set(spark.read.parquet(str(p)).columns) for p in tmp_path.iterdir()]
    assert columns and not [x for x in columns if x & {"keys", "sketch", "elements", "key"}]
