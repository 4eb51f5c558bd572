"""The registered queries against SQL or brute force, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib
import struct
import sys
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tarnwick.llm import hash_tree, queries, quotation

sys.path.append(str(Path(__file__).parent))
from test_operators import brute_links  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    pick = lambda cols, rows: sorted(tuple(str(r[cols.index(c)]) for c in sorted(cols)) for r in rows)
    assert pick(df.columns, df.collect()) == pick(names, found.fetchall())


def texts(duck):
    return duck.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall()


def test_op1(spark, duck):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op1_token_counts(spark, SF).collect()}
    for i, t in texts(duck):
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len(t.encode()), n, n > 512)


def test_op2(spark, duck):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in queries.op2_bpe_chunks(spark, SF).collect()}
    for i, t in texts(duck):
        ids = library.encode(t, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def near_classes(rows):
    sets = {}
    for i, t in rows:
        w = t.split()
        n = min(5, len(w))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    by, root = defaultdict(set), {i: i for i, _ in rows}
    for i, s in sets.items():
        for x in s:
            by[x].add(i)
    find = lambda x: x if root[x] == x else find(root[x])
    pairs = {(a, b) for ids in by.values() if len(ids) > 1 for a in ids for b in ids if a < b}
    for a, b in pairs:
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


#: Conversations with nested quotations, and by hand: parent, kind, own text, place in reply order.
QUOTATIONS = [
    ("c", 0, "first words"), ("c", 1, "second words"), ("c", 2, "third words"), ("c", 3, ">> First words\nonly deep"), ("c", 4, "> second words\n>> first words\nboth"),
    ("c", 5, "On Monday A wrote:\n> unknown\n>> third  words\ndeep known"), ("c", 6, "plain"), (None, 0, "hello there"), ("~", 1, "> hello there\nyes"),
]
QUOTATIONS_WANT = [
    ("c", 0, None, "first", "first words", 1), ("c", 1, 0, "next", "second words", 2), ("c", 2, 1, "next", "third words", 3), ("c", 3, 0, "quote", "only deep", 7),
    ("c", 4, 1, "quote", "both", 6), ("c", 5, 2, "quote", "deep known", 4), ("c", 6, 5, "next", "plain", 5), (None, 0, None, "first", "hello there", 1), ("~", 1, None, "first", "yes", 1),
]


def test_literal_quotations(spark):
    rows = spark.createDataFrame(QUOTATIONS, "conv_id string, turn long, text string").withColumn("role", F.lit("user"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("order_key"))
    got = quotation.link_quotations(rows).select("conv_id", "turn", "parent_turn", "reply_kind", "own_text", place)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, QUOTATIONS_WANT))


def test_quoted_conversations(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    texts, plain = defaultdict(list), {}
    for r in queries.quoting(turns).collect():
        texts[r.conv_id].append((r.turn, r.text))
    for r in turns.collect():
        plain[r.conv_id, r.turn] = r.text.strip(" \n\t\r")
    got = defaultdict(list)
    for r in queries.quoted_conversations(spark, SF).collect():
        got[r.conv_id].append(r)
    assert sum(len(v) for v in got.values()) == len(plain) and sum(r.reply_kind == "quote" for v in got.values() for r in v) > len(plain) / 3
    for conv, messages in texts.items():
        parents, order = brute_links(messages)
        mine = sorted(got[conv], key=lambda r: r.order_key)
        assert {r.turn: r.parent_turn for r in mine} == parents and [r.turn for r in mine] == order
        assert all(r.own_text == plain[conv, r.turn] for r in mine)


def test_op7(spark, duck):
    want = near_classes(texts(duck))
    got = {r.doc_id: r for r in queries.op7_dart_minhash(spark, SF).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.class_id) for r in got.values())


def test_op8(spark):
    got = queries.op8_importance(spark, SF).collect()
    keys = sorted((r.gumbel_key for r in got), reverse=True)
    k = sum(r.kept for r in got)
    assert 0 < k < len(got) and {r.doc_id for r in got if r.kept} == {r.doc_id for r in got if r.gumbel_key >= keys[k - 1]}


def test_op10(spark, duck):
    sql = hash_tree.shard_sql("doc_id", queries.TREE, "(SELECT doc_id FROM documents)")
    grown = hash_tree.shard_sql("doc_id", queries.TREE.grown(), "(SELECT doc_id FROM documents)")
    want, more = (dict(duck.execute(f"SELECT doc_id, sh FROM ({s})").fetchall()) for s in (sql, grown))
    slots = defaultdict(list)
    for r in queries.op10_hash_tree(spark, SF).collect():
        assert (r.shard, r.grown_shard) == (want[r.doc_id], more[r.doc_id])
        slots[r.shard].append(r.slot)
    crc = {i: (zlib.crc32(t.encode()), len(t.encode()) + 8) for i, t in texts(duck)}
    assert all((r.text_crc32, r.size) == crc[r.doc_id] for r in queries.op10_hash_tree(spark, SF).collect())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_pipeline_stages(spark, duck, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tables = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], SF).write.parquet(str(tmp_path / str(k)))
        tables.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, ruled, exact, near, mixed, coded = tables
    assert all(t.columns == docs.columns for t in tables[:-1])
    kept = {r.doc_id for r in queries.op9_line_frequency(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == kept
    strip = lambda t: "".join(c for c in t if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for r in ruled.collect():
        groups[strip(r.text)].append((-len(r.text), r.doc_id))
    assert {r.doc_id for r in exact.collect()} == {min(g)[1] for g in groups.values()}
    classes = near_classes([(r.doc_id, r.text) for r in exact.collect()])
    assert {r.doc_id for r in near.collect()} == set(classes.values())
    assert {r.doc_id for r in mixed.collect()} <= set(classes.values()) and mixed.count() == coded.count()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = {r.doc_id: r.text for r in near.collect()}
    assert all(r.n_tokens == len(library.encode(text[r.doc_id], add_special_tokens=False).ids) for r in coded.collect())


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "ids_sha256" in out.columns


LONG = " ".join(f"word{k}" for k in range(30_000))
PROSE = " ".join(f"prose{k}" for k in range(40))


def stage(spark, k, rows, **extra):
    """The rows that a stage gives for (doc_id, text, source), in a table with columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], schema)
    df = df.withColumns({c: F.lit("clash") for c in ("id", "kept", "text_key", "ids", "class_id", "size", "rate", "copy", "n_words", "__id", "__text")})
    return corpus_pipeline.STAGES[k][1](spark, df, SF).collect()


def test_quality_rules_stage(spark):
    rows = [(1, None, "s"), (2, "", "s"), (3, LONG, None), (4, PROSE, "s"), (4, PROSE, "s"), (None, PROSE, None), (5, "too short", "s")]
    got = stage(spark, 0, rows)
    assert sorted((r.doc_id or 0, r.text[:5], r.n_chars) for r in got) == [(0, "prose", len(PROSE)), (3, "word0", len(LONG)), (4, "prose", len(PROSE)), (4, "prose", len(PROSE))]


def test_exact_dedup_stage(spark):
    rows = [(1, None, "s"), (2, "", "s"), (None, " ", "s"), (3, LONG, "s"), (4, LONG + " ", "s"), (6, PROSE, "s"), (5, PROSE, None), (5, PROSE, None)]
    # Blank texts are one group, of which the longest stays; of equal lengths the least id; of repeated rows one.
    assert sorted((repr(r.doc_id), r.text) for r in stage(spark, 1, rows)) == [("4", LONG + " "), ("5", PROSE), ("None", " ")]


def test_near_dedup_stage(spark):
    near = PROSE + " and a little more"
    rows = [(1, None, "s"), (2, "", "s"), (3, LONG, "s"), (9, LONG + " end", "s"), (7, PROSE, "s"), (6, near, None), (None, PROSE, "s"), (6, near, "s"), (8, "else", "s")]
    # Texts without words are alone; rows that repeat id and text are one document and stay together.
    assert sorted((repr(r.doc_id), r.text) for r in stage(spark, 2, rows)) == sorted([("1", None), ("2", ""), ("3", LONG), ("6", near), ("6", near), ("8", "else")], key=repr)


def test_mixing_stage(spark):
    rows = [(k, PROSE if k % 2 else None, "s") for k in range(200)] + [(7, PROSE, "s")] + [(None, LONG, None)]
    got = stage(spark, 3, rows)
    copies = defaultdict(int)
    for r in got:
        copies[r.doc_id, r.text, r.source] += 1
    assert set(copies) <= {(i, t, s) for i, t, s in rows} and {r.text for r in got} >= {None, PROSE}
    assert copies[7, PROSE, "s"] % 2 == 0  # repeated rows draw the same count


def test_encoding_stage(spark):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [(1, None, "s"), (2, "", None), (3, LONG, "s"), (4, PROSE, "s"), (4, PROSE, "s"), (None, PROSE, "s")]
    got = stage(spark, 4, rows)
    want = {t: library.encode(t or "", add_special_tokens=False).ids for _, t, _ in rows}
    assert sorted((repr(r.doc_id), repr(r.source), list(struct.unpack(f"<{r.n_tokens}I", bytes(r.ids)))) for r in got) == sorted((repr(i), repr(s), want[t]) for i, t, s in rows)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, docs.limit(0), SF).count() == 0
