"""Neighbours, the manifest and collocations against brute force, awkward rows included."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwick.llm import collocations, hash_tree, merkle, order, queries, rp_forest

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "v", "h1", "node", "tree", "at", "size", "path", "leaf", "root", "key", "f", "word", "ids", "n", "rank", "score", "__at", "__part", "block")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# --- places in an order ---


def test_numbered(spark):
    rows = [(g, k % 7) for g in ("a", None, "b") for k in range(50 if g == "a" else 5)]
    got = order.numbered(spark.createDataFrame(rows, "g string, k int").repartition(5), ["g"], ["k"], "at", "size").collect()
    for g in ("a", None, "b"):
        own = sorted((r["at"], r["k"]) for r in got if r["g"] == g)
        assert [at for at, _ in own] == list(range(len(own))) and [k for _, k in own] == sorted(k for _, k in own)
        assert {r["size"] for r in got if r["g"] == g} == {len(own)}


# --- 11: neighbours ---


def dotted(v, w):
    out = 0.0
    for a, b in zip(v, w):  # not sum(), which compensates
        out += a * b
    return out


def exact(rows, k=20):
    """(query, rank, id, score) of (row id, vector) by brute force."""
    ok = [(i, [float(x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for n, (i, v) in enumerate(ok):
        if i % 20 == 0:
            dot = lambda w: dotted(v, w)
            best = sorted((-dot(w), j) for m, (j, w) in enumerate(ok) if m != n)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


def found(spark, rows, **how):
    df = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).repartition(3)
    got = rp_forest.neighbours(df, F.col("vec_id") % 20 == 0, **how)
    return sorted((r.query_id, r["rank"], r["id"], r.score) for r in got.collect())


def test_neighbours_of_few_rows_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(60)]  # whole numbers: many ties
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(50)]  # copies
    rows += [(200, None), (201, []), (202, [0.0] * 4), (203, [1.0, None]), (204, [math.nan, 1.0]), (205, [math.inf, 1.0]), (None, [1.0, 1.0]), (220, [2.0]), (221, [-0.0, 3.0])]
    rows += [(240, [5.0, 5.0, 0.0, 0.0]), (240, [5.0, 5.0, 0.0, 0.0])]  # a repeated row
    assert found(spark, rows) == exact(rows)
    assert found(spark, rows[:3]) == exact(rows[:3])  # all candidates
    assert found(spark, []) == []


def test_leaves_blocks_and_pieces(spark):
    """Small blocks and leaves that share nothing: whole leaves are dealt to several blocks and no row is lost."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.integers(-5, 6, (700, 3)))]
    limits = rp_forest.Limits(trees=3, leaf_points=20, block_points=16, block_queries=4, target=1.0)
    want, got = exact(rows, 5), found(spark, rows, k=5, limits=limits)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert len(set((q, i) for q, _, i, _ in got) & set((q, i) for q, _, i, _ in want)) >= 0.95 * len(want)
    by = dict(rows)
    assert all(s == dotted(by[q], by[i]) for q, _, i, s in got)


def test_few_visits_still_give_all_places(spark):
    """A search that visits few leaves gives as many rows as are asked for, of what is in those leaves."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3000, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for target, points in ((0.01, 16), (0.3, 64)):
        got = defaultdict(list)
        for r in rp_forest.neighbours(df, F.col("vec_id") % 20 == 0, limits=rp_forest.Limits(leaf_points=points, target=target, block_points=500)).collect():
            got[r.query_id].append((r["rank"], r["id"], r.score))
        assert set(got) == set(range(0, 3000, 20))
        for rows in got.values():
            rows.sort()
            assert [k for k, _, _ in rows] == list(range(1, 21)) and len({i for _, i, _ in rows}) == 20
            assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))


def test_recall_on_vectors_of_any_length(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((30, 16)) * 2
    x = centres[rng.integers(0, 30, 6000)] + rng.standard_normal((6000, 16)) * 0.6
    x *= rng.lognormal(0, 0.5, (6000, 1))
    got = defaultdict(set)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for r in rp_forest.neighbours(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r["id"])
    recall = []
    for q in range(0, 6000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        recall.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_op11(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = {(q, i): s for q, _, i, s in exact(rows)}
    got = queries.op11_rp_forest(spark, SF).collect()
    hits = [(r.query_id, r.vec_id) for r in got if (r.query_id, r.vec_id) in want]
    assert len(got) == len(want) and len(hits) >= 0.9 * len(want)
    assert all(r.score == want[r.query_id, r.vec_id] for r in got if (r.query_id, r.vec_id) in want)


# --- 12: manifest ---


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 16]) for k in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        first = i // 16 * 16
        out += [n for k, n in enumerate(level[first : first + 16], first) if k != i]
        i //= 16
    return out


def enc(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def manifest_of(rows):
    """(doc_id, leaf, subroot, root, digest of the proof) of (doc_id, text, lang, source, n_chars) by brute force."""
    groups = defaultdict(list)
    for i, text, lang, source, n in rows:
        groups[source].append((i is not None, i or 0, H(enc(i), enc(source), enc(lang), enc(n), enc(text))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([g[2] for g in sorted(groups[s])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    return sorted(
        (i if known else -1, leaf, trees[s][-1][0], top[-1][0], H(*siblings(trees[s], k), *siblings(top, n)))
        for n, s in enumerate(names) for k, (known, i, leaf) in enumerate(sorted(groups[s]))
    )


def check_manifest(spark, rows):
    df = clashing(spark.createDataFrame(rows, DOC)).repartition(4)
    made = merkle.manifest(df).withColumns({"proof": merkle.path_digest(F.col("path")), "up": merkle.folded(F.col("leaf"), F.col("path"))}).drop("path").collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in made) == manifest_of(rows)
    assert all(r.up == r.root for r in made)
    assert Counter(r.source for r in made) == Counter(r[3] for r in rows)


@pytest.mark.parametrize("sizes", [(1,), (2, 1), (16, 17, 1), (300, 5, 4), tuple([1] * 20)])
def test_manifest(spark, sizes):
    check_manifest(spark, [(k, f"text {k}", "en" if k % 2 else None, f"s{n}" if n else None, k) for n, size in enumerate(sizes) for k in range(size)])


def test_manifest_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 16)
    check_manifest(spark, [(k, f"t{k}", "en", "hot" if k % 3 else f"é{k % 40}", k) for k in range(1500)])


def test_walk_over_full_and_cut_blocks():
    for n in (1, 2, 15, 16, 17, 255, 256, 257, 600, 4096):
        leaves = [H(str(k)) for k in range(n)]
        depth = merkle.depth_of(n)
        tree = levels(leaves)
        for k, path in enumerate(merkle.walk(leaves, depth)):
            assert "".join(s["siblings"] for s in path) == "".join(siblings(tree, k))
        assert merkle.block_root(leaves, depth) == tree[-1][0]


def test_manifest_of_awkward_rows(spark):
    long = "Word " * 1_000_001
    rows = [(None, "null id", "en", "s", 1), (1, None, None, None, None), (1, "", "", "", 0), (1, "same", "en", "s", 4), (1, "same", "en", "s", 4), (1, "other", "en", "s", 5)]
    rows += [(2**53 + 1, "é漢字🎉\x00", "en", "s", 5), (-7, long, "en", "s", len(long)), (3, "-", "en", "-", None)]
    check_manifest(spark, [r for r in rows if r[0] is None or r[0] >= 0] + [(7, long, "en", "s", len(long))])
    assert merkle.manifest(spark.createDataFrame([], DOC)).count() == 0


def test_tampering_is_seen(spark):
    got = queries.op12_merkle_manifest(spark, SF).collect()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    changed = {i for i, t in text.items() if zlib.crc32(str(i).encode()) % 5 == 0 and re.search("[A-Z]", t or "")}
    assert {r.doc_id for r in got if not r.verified} == changed and 0 < len(changed) < len(got)


# --- 13: collocations ---


def collocations_of(rows, least, longest=5, top=2000):
    """(lang, rank, phrase, a, l, r, n, score) of (text, lang) by brute force."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for k in range(len(words) - m + 1):
                    f[lang, *words[k : k + m]] += 1
    found = {g: c for g, c in f.items() if c >= least}
    out = defaultdict(list)
    for (lang, *g), a in found.items():
        m = len(g)
        longer = [c for (other, *h), c in found.items() if other == lang and len(h) > m and any(h[k : k + m] == g for k in range(len(h) - m + 1))]
        if m < 2 or any(c >= a for c in longer):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (found[lang, *g[:k]] * found[lang, *g[k:]]), k, found[lang, *g[:k]], found[lang, *g[k:]]) for k in range(1, m))  # noqa: E741
        out[lang].append((-score, -a, " ".join(g).encode(), l, r))
    return sorted((lang, k, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1))  # noqa: E741


def check_collocations(spark, rows, least, **how):
    df = clashing(spark.createDataFrame(rows, "text string, lang string")).repartition(3)
    got = sorted(tuple(r) for r in collocations.collocations(df, least, **how).collect())
    assert got == collocations_of(rows, least, **how)
    return got


def phrases_at_random(seed, vocabulary, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(vocabulary)
    fixed = [" ".join(word() for _ in range(rng.randint(2, 7))) for _ in range(6)]
    text = lambda: "".join(rng.choice([word(), rng.choice(fixed)]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ". ", "\n", "!", "\x0b"]) for _ in range(rng.randint(0, 40)))
    return [(text(), rng.choice(["en", "de", None, "und"])) for _ in range(n)]


def test_collocations(spark):
    vocabulary = ["The", "the", "of", "Straße", "漢字", "x\x01", "x", "\x1cy", "É", "é", "a", "b", "#1", "’s"]
    assert len(check_collocations(spark, phrases_at_random(1, vocabulary, 150), 5)) > 50
    check_collocations(spark, phrases_at_random(2, [f"w{k}" for k in range(60)], 200), 4, top=7)


@pytest.mark.parametrize("name,value", [("HELD", 50), ("WORDS_HELD", 5), ("RANKED", 16), ("BITMAP_BITS", 64), ("BROADCAST_BYTES", 200)])
def test_collocations_beyond_each_bound(spark, monkeypatch, name, value):
    monkeypatch.setattr(collocations, name, value)
    check_collocations(spark, phrases_at_random(3, [f"word{k}" for k in range(25)], 120), 4)


def test_keys_of_any_width():
    rng = np.random.default_rng(6)
    for most in (1, 3, 4095, 4096, 70_000, 2**21, 2**31):
        keys = collocations.Keys(most, 5)
        ids = rng.integers(1, most + 1, (200, 5))
        ids[::3, 3:] = 0
        packed = keys.pack(ids)
        assert (keys.unpack(packed) == ids).all() and (keys.from_arrow(keys.to_arrow(packed)) == packed).all()
        assert sorted(range(200), key=lambda k: ids[k].tolist()) == sorted(range(200), key=lambda k: keys.to_arrow(packed)[k].as_py())


def test_collocations_of_awkward_rows(spark):
    long = "one two three " * 400_000
    rows = [(None, "en"), ("", "en"), ("a b", None), ("a b", "und"), ("a b", None), ("...", "en"), (" \t", "fr"), (long, "en"), ("q" * 5_000_000 + " z", "en")]
    df = clashing(spark.createDataFrame(rows, "text string, lang string"))
    got = {(r.lang, r.phrase): (r.a, r.n) for r in collocations.collocations(df, 3).collect()}
    assert got[None or "und", "a b"] == (3, 6) and got["en", "one two three one two"] == (399_999, 1_200_002)
    assert collocations.collocations(df.limit(0)).count() == 0 and collocations.collocations(df.where("lang = 'fr'")).count() == 0


# --- 10: the plan of sharding ---


def test_shards_are_drawn_in_generated_code_that_compiles(spark):
    """Code beyond 64 KB fails to compile and falls back; the generated code of every stage stays far under that."""
    rows = spark.range(1000).select(F.col("id").alias("doc_id"))
    for df in (queries.op10_hash_tree(spark, SF), hash_tree.shard_of(rows, F.col("doc_id"), hash_tree.Tree(hash_tree.equal(8, 8, 16)), "s")):
        assert df.collect()  # the plan is final when it has run
        text = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text)]
        assert all(n < 8000 for n in sizes) and "Failed to compile" not in text  # beyond 8000 bytes the JVM leaves a method interpreted


# --- texts of five million characters, for every operator ---

WORDS = " ".join(f"w{k % 4999}" for k in range(900_000))  # one line
LINES = "\n".join(f"line {k % 9973} of a text" for k in range(250_000))
WORD = "x7" * 2_500_000


def very_long(spark, texts):
    return clashing(spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOC)).repartition(4)


def test_very_long_texts(spark):
    from tarnwick.llm import bpe_chunks, dart_minhash, exact_dedup, importance, license_scan, line_frequency, mixing, quotation, token_counts

    byte, word = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    texts = [WORDS, LINES, WORD, "a short one"]
    df = very_long(spark, texts)
    for path, made in ((byte, token_counts.with_prefix_counts(df, byte)), (word, bpe_chunks.encode_and_decode(df, word))):
        library = Tokenizer.from_file(path)
        got = {r.doc_id: r.n_tokens for r in made.select("doc_id", "n_tokens").collect()}
        assert got == {k: len(library.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)}
    sha = {r.doc_id: r.text_sha256 for r in exact_dedup.exact_dedup(df).collect()}
    assert sha == {k: hashlib.sha256("".join(t.split()).encode()).hexdigest() for k, t in enumerate(texts)}
    assert {r.doc_id: len(r.own_text) for r in quotation.link_quotations(df.withColumnsRenamed({"doc_id": "conv_id", "n_chars": "turn", "lang": "role"}).withColumn("doc_id", F.col("conv_id"))).collect()} == dict(enumerate(map(len, texts)))
    assert mixing.mix(df, {"s": 1.0}).where("n_copies > 0").selectExpr("bool_and(length(text) > 10)").first()[0]
    assert all(not r.licenses for r in license_scan.scan_licenses(df.drop("licenses")).collect())
    near = {r.doc_id: r.n_shingles for r in dart_minhash.near_duplicates(df).collect()}
    assert near == {k: len({tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))}) for k, w in enumerate(t.split() for t in texts)}
    assert importance.resample(df, spark.createDataFrame([(0, 1), (3, 0)], "doc_id long, quality int")).count() == 4
    assert {r.doc_id: r.n_words for r in line_frequency.quality_rules(df).collect()} == {k: len(t.split()) for k, t in enumerate(texts)}
    assert {r.doc_id: r.size for r in hash_tree.assign_shards(df).collect()} == {k: len(t) + 8 for k, t in enumerate(texts)}
