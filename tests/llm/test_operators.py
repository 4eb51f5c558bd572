"""The text operators against brute force on small cases, awkward ones included."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import textwrap
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tarnwick.llm import bpe_chunks, common, components, dart_minhash, exact_dedup, hash_tree, importance, license_scan, line_frequency, mixing, quotation, quotient_filter, shingles, token_counts

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
# Columns that clash with what operators make, or with common internal names.
CLASH = ("n_tokens", "ids", "kept", "keep_id", "shard", "slot", "size", "copy", "rate", "text_key", "class_id", "licenses", "clean_text", "id", "h1", "k", "n", "host", "line")


def clashing(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


def docs(spark, texts, source="s", ids=None):
    rows = [(ids[k] if ids else k, t, "en", source if isinstance(source, str) else source[k], None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


AWKWARD = [None, "", " ", "\n\n", "a", "same text here", "same text here", "é漢字🎉", "x" * 5000, "word " * 3000, "<|endoftext|>", "\x00\x1c\x85　"]


def awkward(spark, clash=True):
    df = docs(spark, AWKWARD + AWKWARD[:3], ids=[*range(len(AWKWARD)), None, 1, 1])
    return clashing(df) if clash else df


# --- 1: token counts ---

BITS = ["a", "the", "ing", " ", "  ", "\n", "\t", "'", "'s", "'re", "'ll", "'v", "1", "23", "!", "?!", "é", "ß", "漢字", "🎉", " ", "　", "<|endoftext|>", "<|end", "\x1c", "\x85", "aaaa", "zzzzzzz", "    ", "՘", "\x00"]


def test_prefix_counts_equal_encoding_each_prefix():
    library, counter = Tokenizer.from_file(BYTE), token_counts.counter(BYTE)

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.sampled_from(BITS), max_size=9).map("".join) | st.text(max_size=12))
    def check(text):
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert token_counts.prefix_counts(token_counts.store(counter.text(text))).tolist() == want

    check()


def test_code_points_of_other_unicode_versions():
    """Unassigned here, or classed otherwise by ``regex`` than by the library: the same counts, in linear time."""
    import time
    import unicodedata

    library, counter, rng = Tokenizer.from_file(BYTE), token_counts.counter(BYTE), random.Random(4)
    unknown = [chr(c) for c in range(0x370, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    newer = ["\u0558", "\u1c89", "\u1c8a", "\U00010d40", "\U00010d4a", "\U00016d40", "\U0001ccf0", "\ua7cb", "\U000105c0", "\U0001e5d0", "\U0001e5f1"]
    for _ in range(600):
        text = "".join(rng.choice([rng.choice(newer), rng.choice(unknown), rng.choice(BITS)]) for _ in range(rng.randint(1, 9)))
        want = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert token_counts.prefix_counts(token_counts.store(counter.text(text))).tolist() == want, ascii(text)
    text = "".join(rng.choice(["word ", "two, ", "\n", "x1 "]) for _ in range(25_000))[:99_999] + "\u0558"
    text = (text * 2)[:100_000]
    began = time.perf_counter()
    counts = counter.text(text)
    assert time.perf_counter() - began < 1 and counts.sum() == len(library.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    library = Tokenizer.from_file(BYTE)
    got = token_counts.with_prefix_counts(awkward(spark), BYTE, budget=20).select("text", "n_tokens", "fit_chars", "prefix_counts").collect()
    assert len(got) == len(AWKWARD) + 3
    for r in got:
        text = r.text or ""
        assert r.n_tokens == len(library.encode(text, add_special_tokens=False).ids)
        assert len(library.encode(text[: r.fit_chars], add_special_tokens=False).ids) <= 20
        assert len(token_counts.prefix_counts(r.prefix_counts)) == len(text) + 1
    assert token_counts.with_prefix_counts(awkward(spark).limit(0), BYTE).count() == 0


def test_questions_without_encoding_again(spark):
    df = token_counts.with_prefix_counts(docs(spark, ["the cat sat on the mat", None]), BYTE)
    got = df.select(token_counts.tokens_of_prefix(F.col("prefix_counts"), F.lit(0)).alias("none"), token_counts.prefix_within(F.col("prefix_counts"), F.lit(3)).alias("fit"), "text").collect()
    assert [r.none for r in got] == [0, 0] and got[0].text[: got[0].fit] == "the cat sat"


# --- 2: chunked BPE ---


def test_chunk_joins_are_exact(monkeypatch):
    for name, value in (("MEAN", 12), ("LEAST", 4), ("LARGEST", 20)):
        monkeypatch.setattr(bpe_chunks, name, value)
    encoder, rng = bpe_chunks.ChunkEncoder(WORD), random.Random(5)
    bits = [*BITS, ".", ",", "%%%", "x.", "#b", "<|x.|>", ".'", "'s.", "É", "Σ", "\x0b", "é", "́.", "<|startoftext|>"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        assert encoder.encode_all([text])[0].tolist() == encoder.library.encode(text, add_special_tokens=False).ids, repr(text)
    assert encoder.disagreed == 0 and encoder.used > 3000


def check_bpe(rows):
    library = Tokenizer.from_file(WORD)
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids) and r.n_tokens == len(ids)
        assert r.decoded == library.decode(ids, skip_special_tokens=False) and r.sha == hashlib.sha256(bytes(r.ids)).hexdigest()


def test_bpe_round(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(awkward(spark, False).select("doc_id", "text"))
    df = df.withColumns({"parcel": F.lit(1), "c1": F.lit(2), "n": F.lit(3), "owner": F.lit(4)})
    got = bpe_chunks.encode_and_decode(clashing(df), WORD).select("text", "ids", "n_tokens", "decoded", "parcel", F.sha2("ids", 256).alias("sha")).collect()
    assert len(got) == df.count() and {r.parcel for r in got} == {1}
    check_bpe(got)
    assert bpe_chunks.encode_and_decode(df.limit(0), WORD).count() == 0


@pytest.mark.parametrize("limit", [16 << 20, 30_000, 0])  # parcels broadcast, only their texts' names broadcast, all shuffled
def test_shared_chunks_are_encoded_once(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    rng = random.Random(8)
    prose = lambda n: " ".join(rng.choice(["Alpha,", "beta", "gamma.", "déjà", "x1", "%%%"]) + str(rng.randrange(999)) for _ in range(n))
    passage = prose(1500)
    texts = [prose(rng.randint(1, 400)) + " " + passage + prose(rng.randint(1, 400)) for _ in range(6)] + [prose(900) for _ in range(20)]
    texts += [texts[7]] * 5 + ["short", "short", None, ""]
    df = docs(spark, texts).repartition(3)
    keyed = df.select(F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.select(*[c.alias(n) for n, c in bpe_chunks.text_names(F.col("text")).items()], "text")
    # No chunk of a parcel is in one place only, and every chunk that is in two places is in a parcel.
    places = Counter(c for t in texts for c in bpe_chunks.chunks_of(t or ""))
    shared = {bpe_chunks.named(c) for c, n in places.items() if n > 1}
    held = [{(x.c1, x.c2) for x in r.parcel} for r in bpe_chunks._parcels(keyed, WORD).collect()]
    assert set().union(*held) == shared and len(shared) > 8
    check_bpe(bpe_chunks.encode_and_decode(df, WORD).select("text", "ids", "n_tokens", "decoded", F.sha2("ids", 256).alias("sha")).collect())


# --- 3: exact dedup ---


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 20), max_size=300), st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 20), max_size=300))
def test_quotient_filters_merge_without_loss(a, b):
    blocks = []
    for values in (a, b):
        v, c = quotient_filter.counted(np.array(values, np.uint64), np.full(len(values), 200))
        blocks.append(quotient_filter.pack(v, c, 0, 64))
    values, counts = quotient_filter.merge(blocks)
    want = Counter(a) + Counter(b)
    assert dict(zip(values.tolist(), (counts // 200).tolist())) == dict(want) and values.tolist() == sorted(want)


def brute_dedup(rows):
    strip = lambda t: "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r")
    groups = defaultdict(list)
    for i, t in rows:
        groups[strip(t)].append((-len(t or ""), i is None, i if i is not None else 0, i))
    return {k: (min(g)[3], len(g)) for k, g in groups.items()}


def test_exact_dedup(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 4))) + rng.choice(["", "\n", " "]) for _ in range(300)] + [None, "   "]
    want = brute_dedup(enumerate(texts))
    got = exact_dedup.exact_dedup(clashing(docs(spark, texts).repartition(5))).collect()
    assert len(got) == len(texts)
    for r in got:
        key = "".join((r.text or "").split())
        assert (r.keep_id, r.group_size) == want[key] and r.kept == (r.doc_id == r.keep_id)
        assert r.text_sha256 == hashlib.sha256(key.encode()).hexdigest()


@pytest.mark.parametrize("limit", [16 << 20, 0])
def test_one_row_stays_of_repeated_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    df = docs(spark, ["t", "t", "t", "u", None, None], ids=[7, 7, 8, 9, None, None])
    got = exact_dedup.exact_dedup(df).groupBy("text_sha256").agg(F.sum(F.col("kept").cast("int")).alias("n")).collect()
    assert [r.n for r in got] == [1, 1, 1]
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0
    got = exact_dedup.exact_dedup(awkward(spark)).collect()
    want = brute_dedup((r.doc_id, r.text) for r in got)
    assert len(got) == len(AWKWARD) + 3
    assert all((r.keep_id, r.group_size) == want["".join(c for c in r.text or "" if c not in " \t\n\x0b\x0c\r")] for r in got)
    hot = exact_dedup.exact_dedup(docs(spark, ["same", None] * 1500 + ["x", "y"] * 2, ids=[*range(2000), *[5] * 1000, 1, 2, 3, 4])).collect()
    assert sum(r.kept for r in hot) == 4 and sorted(r.keep_id for r in hot if r.kept) == [0, 1, 1, 2]


def test_ranges_grow_with_the_rows():
    assert [exact_dedup.range_bits_for(n, 12) for n in (0, 10**6, 10**9, 10**11)] == [4, 4, 8, 15]


# --- 4: quotation linking ---


def brute_links(msgs):
    """Parents and reply order of one conversation's (turn, text) list, by plain loops."""
    norm = lambda t: " ".join(t.lower().split())

    def parse(text):
        own, runs, last = [], [], 0
        lines = text.split("\n")
        levels = []
        for line in lines:
            rest, level = line, 0
            while rest.lstrip(" \t").startswith(">"):
                rest, level = rest.lstrip(" \t")[1:], level + 1
            levels.append((level, rest[1:] if level and rest[:1] in " \t" else rest))
        for level, body in levels:
            if level:
                if level == last:
                    runs[-1][1].append(body)
                else:
                    runs.append((level, [body]))
            else:
                own.append(body)
            last = level
        return "\n".join(own).strip(" \n\t\r"), [(lv, "\n".join(b)) for lv, b in runs]

    keys = lambda t: [k for k in dict.fromkeys(map(norm, [t, *t.split("\n")])) if k]
    parsed = {turn: parse(text) for turn, text in msgs}
    parents, before = {}, None
    for turn, _ in sorted(msgs):
        asked = sorted([lv, n, k] for n, (lv, k) in enumerate((lv, k) for lv, p in parsed[turn][1] for k in keys(p)))
        target = None
        for _, _, k in asked:  # the least level with a known passage, whichever it is
            hits = [t for t in parsed if t < turn and k in keys(parsed[t][0])]
            if hits:
                target = max(hits)
                break
        parents[turn] = None if before is None else (before if target is None else target)
        before = turn
    children = defaultdict(list)
    for turn, p in parents.items():
        children[p].append(turn)
    order = []

    def visit(turn):
        order.append(turn)
        for c in sorted(children[turn]):
            visit(c)

    for root in children[None]:
        visit(root)
    return parents, order


def test_quotation_linking(spark, monkeypatch):
    monkeypatch.setattr(quotation, "BLOCK", 4)
    rng, rows, want = random.Random(3), [], {}
    words = ["alpha", "beta", "gamma", "delta"]
    for conv in range(25):
        msgs = []
        for turn in range(rng.randint(1, 14)):
            lines = [" ".join(rng.choices(words, k=3)) for _ in range(rng.randint(1, 2))]
            if msgs and rng.random() < 0.6:
                quoted = [x for x in rng.choice(msgs)[1].split("\n") if not x.startswith(">")]
                deep = ">" * rng.randint(1, 3)
                if rng.random() < 0.3:
                    lines = [">> " + rng.choice(words)] + lines
                if rng.random() < 0.3:
                    lines = [deep + "> " + q for q in rng.choice(msgs)[1].split("\n") if not q.startswith(">")] + lines
                lines = [deep + " " + q.upper() for q in quoted] + lines
            msgs.append((turn, "\n".join(lines)))
        rows += [(conv, turn, "user", text) for turn, text in msgs]
        want[conv] = brute_links(msgs)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = quotation.link_quotations(df.repartition(4)).collect()
    assert len(got) == len(rows)
    for conv, (parents, order) in want.items():
        mine = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.order_key)
        assert {r.turn: r.parent_turn for r in mine} == parents
        assert [r.turn for r in mine] == order
    assert all(">" not in r.own_text for r in got)


def test_deeper_quotations_are_linked(spark):
    texts = ["first words", "second words", "third words", ">> First words\nonly deep", "> second words\n>> first words\nboth", "> unknown\n>> third words\ndeep known"]
    df = spark.createDataFrame([(1, k, "u", t) for k, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    got = {r.turn: (r.parent_turn, r.reply_kind, [tuple(x) for x in r.links]) for r in quotation.link_quotations(df).collect()}
    assert got[2] == (1, "next", []) and got[3] == (0, "quote", [(2, 0)])
    assert got[4] == (1, "quote", [(1, 1), (2, 0)]) and got[5] == (2, "quote", [(2, 2)])


def test_a_null_conversation_is_none_of_any_name(spark):
    rows = [(None, 0, "u", "hello there"), ("~", 1, "u", "> hello there\nyes"), ("-", 2, "u", "> hello there\nno"), (None, 3, "u", "> hello there\nyes")]
    got = {r.turn: (r.parent_turn, r.reply_kind) for r in quotation.link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got == {0: (None, "first"), 1: (None, "first"), 2: (None, "first"), 3: (0, "quote")}


def test_a_passage_that_all_messages_share(spark, monkeypatch):
    monkeypatch.setattr(quotation, "BLOCK", 8)
    rows = [(1, k, "u", "the same line" if k % 10 == 0 else "> the same line\nreply") for k in range(95)]
    got = {r.turn: r.parent_turn for r in quotation.link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[k] == (k // 10 * 10 if k % 10 else k - 1) for k in range(1, 95))


def test_awkward_conversations(spark):
    rows = [(None, 0, "u", None), (1, None, "u", ""), (1, 5, "u", "> x\n>> y\n> z"), (1, 5, "u", "> x"), (1, 6, None, "On Monday A wrote:\n> x\nyes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"own_text": F.lit(1), "order_key": F.lit(2)})
    got = quotation.link_quotations(df).collect()
    assert len(got) == 5 and sorted(r.own_text for r in got) == ["", "", "", "", "yes"]
    assert quotation.link_quotations(df.limit(0)).count() == 0


# --- 5: mixing ---


def test_mixing_counts_are_poisson(spark):
    rows = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 10 < 7, "big").otherwise("small").alias("source"))
    got = mixing.mix(rows, {"big": 1.0, "small": 1.0})
    stat = {r.source: r for r in got.groupBy("source").agg(F.count("*").alias("n"), F.first("rate").alias("rate")).collect()}
    assert abs(stat["big"].n / 10000 - 1) < 0.05 and abs(stat["small"].n / 10000 - 1) < 0.05
    lam = stat["small"].rate
    counts = Counter(r.n_copies for r in got.where("source = 'small'").dropDuplicates(["doc_id"]).collect())
    for k in (1, 2, 3):
        assert abs(counts[k] / 6000 - np.exp(-lam) * lam**k / [1, 1, 2, 6][k]) < 0.02
    again = mixing.mix(rows.repartition(7), {"big": 1.0, "small": 1.0})
    assert got.select("doc_id", "copy").exceptAll(again.select("doc_id", "copy")).count() == 0


def test_large_rates_do_not_underflow(spark):
    rows = docs(spark, ["x", *["y" * 2000] * 40], ["tiny", *["huge"] * 40])
    got = mixing.mix(rows, {"tiny": 1.0, "huge": 0.01}, total=30.0).where("source = 'tiny'")
    rate = got.first().rate
    assert rate > 1000 and abs(got.count() / rate - 1) < 0.15


def test_awkward_mixing(spark):
    assert mixing.mix(awkward(spark), power=1.0, total=3.0).count() > 0
    assert mixing.mix(awkward(spark).limit(0)).count() == 0
    nulls = awkward(spark).withColumn("source", F.lit(None).cast("string"))
    assert mixing.mix(nulls, power=1.0, total=5.0).count() > 0


# --- 6: licences ---


def test_licenses(spark):
    mit = (
        "Copyright (c) 2020 Someone\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all "
        "copies or substantial portions of the Software.\nOther words here."
    )
    texts = ["prose.\nReleased under the MIT License.\nmore", mit, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "license to print money", None, ""]
    got = {r.doc_id: r for r in license_scan.scan_licenses(clashing(docs(spark, texts))).collect()}
    assert [got[k].licenses for k in range(6)] == [["MIT"], ["MIT"], ["Apache-2.0", "CC-BY-NC-4.0"], [], [], []]
    assert got[0].license_spans[0].sentence == 1 and got[2].license_kinds == ["non-commercial", "permissive"]
    assert license_scan.scan_licenses(docs(spark, [None]).limit(0)).count() == 0


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without "
    "restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions:",
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
    "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE.",
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with "
    "the distribution.",
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
)
GPL2 = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of "
    "the License, or (at your option) any later version.",
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY.",
)


def wrapped(paragraphs, width=72, mark="", end="\n"):
    return f"{end}{mark.rstrip()}{end}".join(end.join(mark + x for x in textwrap.wrap(p, width)) for p in paragraphs)


def test_wrapped_licenses(spark):
    styles = [{}, {"mark": "# "}, {"mark": " * ", "width": 50}, {"mark": "dnl "}, {"mark": "// ", "end": "\r\n"}, {"width": 9999}, {"width": 20}]
    texts = [wrapped(p, **style) for style in styles for p in (MIT, BSD, GPL2)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    want = [[1, 2, 3], [30, 31, 32, 33], [20, 21, 23, 24]] * len(styles)
    assert [got[k].license_ids for k in range(len(texts))] == want
    assert [got[k].licenses for k in range(len(texts))] == [["MIT"], ["BSD-3-Clause"], ["GPL-2.0-or-later"]] * len(styles)


def test_short_notices_in_their_phrasings(spark):
    texts = {
        "This file is licensed under the Apache License, Version 2.0.": ["Apache-2.0"],
        "Prose before. The source code of it is distributed under the terms of the MIT License; prose.": ["MIT"],
        "It is made available under the BSD 2-Clause\n# License.": ["BSD-2-Clause"],
        "All files are released under the GPLv3.": ["GPL-3.0"],
        "Released under the GNU Affero General Public License, version 3": ["AGPL-3.0"],
        "this is not licensed under the MIT License": [],
        "Licensed under the MIT License and other terms": [],
        "Copyright 2020 A. All rights reserved.\n\n" + "\n\n".join(BSD).replace("the copyright holder", "Example & Sons Ltd."): ["BSD-2-Clause"],
        "Copyright 2020 A. All rights reserved.\n\n" + "\n\n".join(BSD).replace("the copyright holder", "Example and Sons"): ["BSD-3-Clause"],
        "\n\n".join(BSD) + "\n\n" + "\n\n".join(BSD[:3]): ["BSD-2-Clause", "BSD-3-Clause"],
        "Apache License\n   Version 2.0, January 2004\n   http://www.apache.org/licenses/": ["Apache-2.0"],
    }
    got = {r.text: r.licenses for r in license_scan.scan_licenses(docs(spark, list(texts))).collect()}
    assert got == texts


def test_licence_sql_has_the_same_on_single_lines(spark):
    import duckdb

    texts = [" ".join(p) for p, _, _ in NOTICES] + ["This file is licensed under the Apache License, Version 2.0.", "Licensed under CC BY 4.0. Licensed under CC BY 4.0.", None, "", "All rights reserved."]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {r[0]: (r[1], r[2], r[3]) for r in con.execute("SELECT doc_id, n_known, license_ids, licenses FROM (" + license_scan.scan_sql() + ")").fetchall()}
    got = {r.doc_id: (len(r.license_ids), ",".join(map(str, r.license_ids)), ",".join(r.licenses)) for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert got == want


def test_license_sentences_end_at_boundaries(spark):
    texts = [
        "no stop here\nLicensed under the\nMIT License\nnor here",
        "no stop here\nReleased under the MIT License\nLicensed under CC BY 4.0\nnor here",
        "Licensed under the\n\nMIT License",
        "Licensed under the. MIT License",
        "not licensed under the MIT License",
        "a. b\n\nLicensed under\nthe MIT License; all rights\nreserved",
    ]
    got = {r.doc_id: [tuple(s) for s in r.license_spans] for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    assert [got[k] for k in range(6)] == [[(1, 4)], [(1, 4), (2, 41)], [], [], [], [(3, 4), (4, 90)]]


GPL = "This program is free software{} you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation{} either version {} of the License, or (at your option) any later version."
APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "http://www.apache.org/licenses/LICENSE-2.0",
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
    "express or implied. See the License for the specific language governing permissions and limitations under the License.",
)
LGPL = "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation{} of the License, or (at your option) any later version."
ISC = "Permission to use, copy, modify, and{} distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
NOTICES = [
    (MIT, "MIT", {(1, 2, 3), (1, 2)}),
    (MIT[:2], "MIT", {(1, 2)}),
    (["Licensed under the MIT License."], "MIT", {(4,)}),
    (APACHE, "Apache-2.0", {(10, 11, 12, 13), (10,)}),
    ([GPL.format(":", ",", 3)], "GPL-3.0-or-later", {(20, 27)}),
    ([GPL.format(";", ";", 3)], "GPL-3.0-or-later", {(20, 21, 22)}),
    ([GPL.format(";", ";", 2)], "GPL-2.0-or-later", {(20, 21, 23)}),
    ([GPL.format(":", ",", 2)], "GPL-2.0-or-later", {(20, 28)}),
    (["Licensed under the GNU General Public License, version 3."], "GPL-3.0", {(25,)}),
    (["Licensed under the GNU General Public License, version 2."], "GPL-2.0", {(26,)}),
    (BSD, "BSD-3-Clause", {(30, 31, 32, 33)}),
    (BSD[:3], "BSD-2-Clause", {(30, 31, 32)}),
    (["Licensed under the BSD 3-Clause License."], "BSD-3-Clause", {(34,)}),
    (["Licensed under the BSD 2-Clause License."], "BSD-2-Clause", {(35,)}),
    (["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."], "CC-BY-NC-4.0", {(40,)}),
    (["This work is licensed under a Creative Commons Attribution 4.0 International License."], "CC-BY-4.0", {(41,)}),
    (["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."], "CC-BY-SA-4.0", {(42,)}),
    (["This is free and unencumbered software released into the public domain."], "Unlicense", {(50,)}),
    ([ISC.format("/or")], "ISC", {(51,)}),
    ([ISC.format("")], "ISC", {(51,)}),
    ([MPL], "MPL-2.0", {(60,)}),
    (["Mozilla Public License Version 2.0"], "MPL-2.0", {(61,)}),
    (["Released under the Mozilla Public License 2.0."], "MPL-2.0", {(62,)}),
    (["Distributed under the ISC License."], "ISC", {(52,)}),
    (["Apache License\n\nVersion 2.0, January 2004".replace("\n\n", " ")], "Apache-2.0", {(15,)}),
    ([LGPL.format("; either version 2.1")], "LGPL-2.1-or-later", {(29, 70, 71)}),
    ([LGPL.format(", either version 2.1")], "LGPL-2.1-or-later", {(29, 72)}),
    ([LGPL.format("; either version 3")], "LGPL-3.0-or-later", {(29, 70, 22)}),
    ([LGPL.format(", either version 3")], "LGPL-3.0-or-later", {(29, 73)}),
    (["Licensed under the GNU Lesser General Public License, version 3."], "LGPL-3.0", {(76,)}),
    ([GPL.format(";", ";", 3).replace("GNU", "GNU Affero")], "AGPL-3.0-or-later", {(20, 74, 22)}),
    ([GPL.format(":", ",", 3).replace("GNU", "GNU Affero")], "AGPL-3.0-or-later", {(20, 75)}),
    (["Licensed under the AGPLv3."], "AGPL-3.0", {(77,)}),
    (["Copyright (c) 2020 Someone. All rights reserved."], "Proprietary", {(90,)}),
]


def test_each_rule_fires_on_its_text(spark):
    assert {*license_scan.RULES, ("Proprietary", (90,))} == {(name, ids) for _, name, rules in NOTICES for ids in rules}
    texts = [f(p) for p, _, _ in NOTICES for f in ("\n\n".join, wrapped)]
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, texts)).collect()}
    for k in range(len(texts)):
        _, name, rules = NOTICES[k // 2]
        found = "," + ",".join(map(str, got[k].license_ids)) + ","
        assert got[k].licenses == [name] and all("," + ",".join(map(str, ids)) + "," in found for ids in rules), (k, name, found)


# --- 7: near duplicates ---


def test_darts_estimate_weighted_jaccard():
    rng = np.random.default_rng(2)
    a, wa, wb = rng.integers(0, 2**63, 60).astype(np.uint64), rng.integers(1, 9, 60).astype(float), rng.integers(1, 9, 60).astype(float)
    got = np.mean([(lambda s: (s[0] == s[1]).mean())(dart_minhash.signatures([(a + np.uint64(k), wa), (a + np.uint64(k), wb)], 192)) for k in range(25)])
    assert abs(got - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_exact_overlaps():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(30):
        e = np.unique(rng.integers(0, 40, 30)).astype(np.uint64)
        sets.append((e, rng.integers(1, 4, len(e)).astype(float)))
    want = set()
    for i in range(30):
        for j in range(i + 1, 30):
            x, y = (dict(zip(s[0].tolist(), s[1])) for s in (sets[i], sets[j]))
            inter, union = sum(min(x.get(k, 0), y.get(k, 0)) for k in {*x, *y}), sum(max(x.get(k, 0), y.get(k, 0)) for k in {*x, *y})
            if inter / union >= 0.4:
                want.add((i, j))
    assert set(dart_minhash.alike(sets, 0.4, columns=7)) == want and want
    asks = np.array([3, 8, 20])
    got = list(dart_minhash.alike(sets, 0.4, columns=7, asks=asks))
    assert {tuple(sorted(p)) for p in got} == {p for p in want if set(p) & set(asks.tolist())} and len(got) == len({tuple(sorted(p)) for p in got})


def brute_classes(texts):
    sh = []
    for t in texts:
        w = (t or "").split()
        n = min(5, len(w))
        sh.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(texts)):
        for j in range(i):
            if sh[i] and sh[j] and len(sh[i] & sh[j]) >= 0.8 * len(sh[i] | sh[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_equal_brute_force(spark, block):
    rng, texts = random.Random(7), []
    vocabulary = [f"w{k}" for k in range(400)]
    for size in (1, 1, 2, 5, 40, 3, 1):
        base = rng.choices(vocabulary, k=rng.randint(60, 160))
        for _ in range(size):
            words = base[:]
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += [None, "", "a b", "a b", "a  b c", texts[0]]
    want = brute_classes(texts)
    got = {r.doc_id: r for r in dart_minhash.near_duplicates(clashing(docs(spark, texts)), near=dart_minhash.Near(block_nodes=block)).collect()}
    assert [got[k].class_id for k in range(len(texts))] == want
    assert all(got[k].kept == (want[k] == k) and got[k].class_size == want.count(want[k]) for k in got)


def test_large_families_lose_no_link(spark, monkeypatch):
    """Chains and hubs, with so few leaders that the rest of a family has to meet its blocks."""
    monkeypatch.setattr(dart_minhash, "LEADERS", 1)
    rng, texts = random.Random(11), []
    base = [f"w{k}" for k in range(150)]
    for _ in range(25):  # copies of an original that differ more from each other than from it
        words = base[:]
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    for k in range(0, 90, 5):  # a chain: neighbours are alike, the ends are not
        texts.append(" ".join(f"c{i}" for i in range(k, k + 100)))
    want = brute_classes(texts)
    got = {r.doc_id: r.class_id for r in dart_minhash.near_duplicates(docs(spark, texts), near=dart_minhash.Near(block_nodes=4)).collect()}
    assert [got[k] for k in range(len(texts))] == want and len(set(want)) < len(texts)


def test_awkward_near_duplicates(spark):
    got = dart_minhash.near_duplicates(awkward(spark)).collect()
    assert len(got) == len(AWKWARD) + 3
    assert dart_minhash.near_duplicates(awkward(spark).limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(400, 440)] + [(500, k) for k in range(501, 560)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_are_hashed_as_words():
    assert shingles.word_hashes(" a\tb a\x0b\n").tolist()[0] == shingles.word_hashes("a").tolist()[0]
    assert len(shingles.word_hashes("é x y")) == 2 and len(shingles.shingle_hashes("one two")) == 1


# --- 8: importance resampling ---


def test_importance_separates_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    texts, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    held = labels.where("doc_id % 3 = 0")
    got = importance.resample(texts, labels.where("doc_id % 3 <> 0")).join(held, "doc_id").collect()
    good, bad = [r.log_weight for r in got if r.quality == 1], [r.log_weight for r in got if r.quality == 0]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.9
    assert np.mean([r.kept for r in got if r.quality == 1]) > 0.95


def brute_importance(texts, good, keep, buckets):
    """Weights and keys by plain loops: (id, text) pairs, the ids of good labels, how many to keep."""
    m64 = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m64
        return x ^ (x >> 31)

    def grams(text):
        runs = re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff\x20\x09-\x0d]+", (text or "").lower().encode())
        base = 0x9E3779B97F4A7C15 | 1
        tokens = [mix((sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(r)) + len(r)) & m64) for r in runs]
        return [mix((t + 7) & m64) % buckets for t in tokens] + [mix((a * 0xD6E8FEB86659FD93 + b) & m64) % buckets for a, b in zip(tokens, tokens[1:])]

    raw, target = [1] * buckets, [1] * buckets
    for i, t in texts:
        for g in grams(t):
            raw[g] += 1
            target[g] += i in good
    ratio = [math.log(a / sum(target)) - math.log(b / sum(raw)) for a, b in zip(target, raw)]
    weights = [sum(ratio[g] for g in grams(t)) for _, t in texts]
    drawn = [(int(hashlib.md5(f"gumbel|{'~' if i is None else i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i, _ in texts]
    keys = [w - math.log(-math.log(u)) for w, u in zip(weights, drawn)]
    least = sorted(keys, reverse=True)[keep - 1] if keep else math.inf
    return [(w, k, k >= least - 1e-9) for w, k in zip(weights, keys)]


def test_importance_equals_brute_force(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice(["Good", "fine,", "bad!!", "spam", "Éa1", "--"]) for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", "good"]
    labels = [(k, int(k % 3 == 0), 0) for k in range(0, 60, 2)]
    good = {i for i, q, _ in labels if q}
    keep = round(len(texts) * len(good) / len(labels))
    want = brute_importance(list(enumerate(texts)), good, keep, 500)
    df = clashing(docs(spark, texts)).withColumns({"log_weight": F.lit("x"), "gumbel_key": F.lit("y")})
    got = {r.doc_id: r for r in importance.resample(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), buckets=500).collect()}
    for k, (weight, key, kept) in enumerate(want):
        assert abs(got[k].log_weight - weight) < 2e-6 and abs(got[k].gumbel_key - key) < 2e-6 and got[k].kept == kept
    assert sum(r.kept for r in got.values()) == keep


def test_kth_largest_is_exact(spark):
    rng = random.Random(2)
    values = [rng.choice([rng.gauss(0, 1), 1e9 * rng.random(), 3.0, -1e-300]) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in (1, 7, 500, 1500, 2000):
        assert importance.kth_largest(df, "x", k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df.limit(0), "x", 3) is None


def test_awkward_importance(spark):
    labels = spark.createDataFrame([(5, 1, 0), (1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.resample(awkward(spark), labels).collect()
    rows = awkward(spark).select("doc_id", "text").collect()
    want = brute_importance([(r.doc_id, r.text) for r in rows], {5}, round(len(rows) / 2), importance.BUCKETS)
    order = lambda x: (repr(x[0]), round(x[1], 4), round(x[2], 4))
    mine = sorted(((r.doc_id, r.log_weight, r.gumbel_key, r.kept) for r in got), key=order)
    theirs = sorted(((r.doc_id, *w) for r, w in zip(rows, want)), key=order)
    assert len(mine) == len(theirs) and all(a[0] == b[0] and abs(a[1] - b[1]) < 2e-6 and abs(a[2] - b[2]) < 2e-6 and a[3] == b[3] for a, b in zip(mine, theirs))
    empty = [r for r in got if r.doc_id == 0]  # a null text: nothing speaks for or against it
    assert empty[0].log_weight == 0
    assert importance.resample(awkward(spark), labels.limit(0)).where("kept").count() == len(AWKWARD) + 3
    assert importance.resample(awkward(spark).limit(0), labels).count() == 0


# --- 9: quality rules ---


def brute_rules(rows, limits):
    lines_of = lambda t: [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    norm = lambda x: " ".join(x.lower().split())
    held, texts = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        texts[host or ""].add(t or "")
        for x in lines_of(t or ""):
            held[host or "", norm(x)].add(t or "")
    out = {}
    for i, t, host in rows:
        t, h = t or "", host or ""
        words = t.split()
        wins = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
        counts = Counter(wins)
        covered = {k + j for k, w in enumerate(wins) if counts[w] > 1 for j in range(8)}
        ls = lines_of(t)
        gone = lambda x: x.strip() and len(held[h, norm(x)]) > max(limits.min_documents, limits.max_share * len(texts[h]))
        left = sum(len(x.split()) for x in t.split("\n") if not gone(x))
        failed = len(words) < limits.min_words or 100 * len(covered) > limits.max_repeat_percent * len(words)
        out[i] = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(ls) - len(set(ls)), len(covered), failed, not failed and left >= limits.min_words and left >= limits.min_left * len(words))
    return out


def test_quality_rules(spark):
    rng, rows = random.Random(5), []
    limits = line_frequency.Limits(min_documents=3, max_share=0.2, min_words=10)
    common = "This line is on every page of the site and says nothing at all"
    for k in range(120):
        lines = [" ".join(rng.choices(["uno", "dos", "tres", "|", "$$", "é"], k=rng.randint(1, 12))) for _ in range(rng.randint(0, 6))]
        if k % 3 == 0:
            lines += [common, common.upper() + " "][: 1 + k % 2]
        if k % 7 == 0:
            lines += [lines[0] if lines else "x"] * 3
        rows.append((k, "\n".join(lines), rng.choice(["h1", "h2", None])))
    rows += [(900, None, "h1"), (901, " \n", "h2"), (902, " ".join(["same eight words are here again and again"] * 40), "h1")]
    want = brute_rules(rows, limits)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    df = clashing(df)
    got = line_frequency.quality_rules(df, limits=limits).collect()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == want[r.doc_id], r.doc_id
    assert any(r.n_lines_removed for r in got) and not any(common in r.clean_text for r in got if r.source)
    assert line_frequency.quality_rules(df.limit(0)).count() == 0
    assert line_frequency.quality_rules(awkward(spark)).count() == len(AWKWARD) + 3


def test_line_limit_does_not_rise_with_the_host(spark, monkeypatch):
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(25))
    rows = docs(spark, [own(k) + ("\nFollow us for more" if k % 16 == 0 else "") for k in range(640)] + [own(0) + "\nFollow us for more"] * 3)
    for limit in (16 << 20, 0):  # broadcast, salted shuffle
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        got = line_frequency.quality_rules(rows).collect()
        assert len(got) == 643 and sum(r.n_lines_removed for r in got) == 43 and not any("Follow" in r.clean_text for r in got)


def test_copies_are_not_boilerplate(spark):
    text = " ".join(f"clean{k}" for k in range(40))
    got = line_frequency.quality_rules(docs(spark, [text] * 200)).select("kept").distinct().collect()
    assert [r.kept for r in got] == [True]


# --- 10: sharding ---


def brute_shard(key, tree):
    def straw(name, weight):
        h = int(hashlib.md5(f"{'~' if key is None else key}|{name}".encode()).hexdigest()[:13], 16)
        return -np.log((h + 0.5) / 2**52) / weight if weight else np.inf

    least = lambda options: min((straw(n, w), k) for k, (n, w) in enumerate(options))[1]
    r = least([(f"region {k}", w) for k, (w, _) in enumerate(tree.regions)])
    racks = tree.regions[r][1]
    rack = least([(f"rack {r} {k}", w) for k, (w, _) in enumerate(racks)])
    leaf = least([(f"shard {r} {rack} {k}", w) for k, w in enumerate(racks[rack][1])])
    before = sum(len(shards) for _, rs in tree.regions[:r] for _, shards in rs) + sum(len(shards) for _, shards in racks[:rack])
    return before + leaf


def test_shards(spark):
    import zlib

    n, tree = 6000, hash_tree.Tree()
    df = docs(spark, [None if k % 100 == 0 else "é" * (k % 9) for k in range(n)])
    df = clashing(df)
    got = hash_tree.assign_shards(df.repartition(6), tree=tree, cells=8).collect()
    assert len(got) == n
    slots = defaultdict(list)
    for r in got:
        text = ("" if r.doc_id % 100 == 0 else "é" * (r.doc_id % 9)).encode()
        assert (r.size, r.text_crc32, r.law) == (len(text) + 8, zlib.crc32(text), "key")
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    for r in got[:300]:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, tree), brute_shard(r.doc_id, tree.grown()))
    assert sorted(slots) == list(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) < 1.4 * n / 24 and 0.5 * n / 25 < sum(r.grown_shard == 24 for r in got) < 1.6 * n / 25


def test_every_growth_moves_rows_only_to_the_new_shard(spark):
    trees = [hash_tree.Tree()]
    for _ in range(3):
        trees.append(trees[-1].grown())
    df = spark.range(3000).select(F.col("id").alias("doc_id"))
    for k, t in enumerate(trees):
        df = hash_tree.shard_of(df, F.col("doc_id"), t, f"s{k}")
    for k in range(3):
        assert df.where(f"s{k} <> s{k + 1} and s{k + 1} <> {24 + k}").count() == 0 and df.where(f"s{k + 1} = {24 + k}").count() > 0


UNEVEN = hash_tree.Tree(((3.0, ((2.0, (1.0, 3.0)), (1.0, (1.0,)))), (1.0, ((1.0, (2.0, 1.0, 1.0)),))))


@pytest.mark.parametrize("tree", [hash_tree.Tree(), UNEVEN])
@pytest.mark.parametrize("change", [((1,), 2.5), ((0,), 0.5), ((0, 1), 4.0), ((0, 0), 0.0), ((0, 0, 1), 5.0), ((1, 0, 0), 0.0)])
def test_a_changed_weight_moves_rows_only_into_or_out_of_its_subtree(spark, tree, change):
    path, weight = change
    old = [tree.regions[path[0]][0], *([tree.regions[path[0]][1][path[1]][0]] if len(path) > 1 else []), *([tree.regions[path[0]][1][path[1]][1][path[2]]] if len(path) > 2 else [])][-1]
    # A region's weight counts among regions of many shards.
    weight = weight * old if len(path) < 3 else weight
    other = tree.with_weight(weight, *path)
    places = [(r, k, j) for r, (_, racks) in enumerate(tree.regions) for k, (_, shards) in enumerate(racks) for j in range(len(shards))]
    inside = [n for n, p in enumerate(places) if p[: len(path)] == path]
    family = [n for n, p in enumerate(places) if p[: len(path) - 1] == path[:-1]]
    df = hash_tree.shard_of(hash_tree.shard_of(spark.range(4000).select(F.col("id").alias("doc_id")), F.col("doc_id"), tree, "a"), F.col("doc_id"), other, "b")
    rows = df.collect()
    assert all(r.a == brute_shard(r.doc_id, tree) and r.b == brute_shard(r.doc_id, other) for r in rows[:300])
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all((b in inside and a not in inside) if weight > old else (a in inside and b not in inside) for a, b in moved)
    assert all(a in family and b in family for a, b in moved)  # siblings only


def test_weights_are_met(spark):
    counts = Counter(r.s for r in hash_tree.shard_of(spark.range(20000).select(F.col("id").alias("doc_id")), F.col("doc_id"), UNEVEN, "s").collect())
    want = [3 / 4 * 2 / 3 * 1 / 4, 3 / 4 * 2 / 3 * 3 / 4, 3 / 4 * 1 / 3, 1 / 4 * 2 / 4, 1 / 4 * 1 / 4, 1 / 4 * 1 / 4]
    assert all(abs(counts[k] / 20000 - w) < 0.015 for k, w in enumerate(want))


def test_awkward_shards(spark):
    got = hash_tree.assign_shards(awkward(spark)).collect()
    tree, by_shard = hash_tree.Tree(), defaultdict(list)
    assert len(got) == len(AWKWARD) + 3 and not {"text"} & set(got[0].asDict())
    for r in got:
        assert (r.shard, r.grown_shard) == (brute_shard(r.doc_id, tree), brute_shard(r.doc_id, tree.grown()))
        by_shard[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    nulls = [(r.size, r.text_crc32) for r in got if r.doc_id in (0, None)]
    assert nulls == [(8, 0)] * 2  # a null text, with an id and without
    same = docs(spark, ["t"] * 40 + [None] * 20, ids=[None] * 50 + [3] * 10)
    got = hash_tree.assign_shards(same, cells=4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert {r.shard for r in got} == {brute_shard(None, tree), brute_shard(3, tree)} and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert hash_tree.assign_shards(awkward(spark).limit(0)).count() == 0
