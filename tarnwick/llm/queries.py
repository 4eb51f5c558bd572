"""The operators applied to the driver's tables, and their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.llm import bpe_chunks, collocations, dart_minhash, exact_dedup, hash_tree, importance, license_scan, line_frequency, merkle, mixing, quotation, rp_forest, token_counts
from tarnwick.shipping import ship

TREE = hash_tree.Tree()
TOKEN_LIMIT = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.with_prefix_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), budget=TOKEN_LIMIT)
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return counted.select("doc_id", n_bytes.alias("n_bytes"), "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fit_chars")


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe_chunks.encode_and_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op4_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotation.link_quotations(table(spark, sf_dir, "conversations"))
    return linked.select("conv_id", "turn", "role", "parent_turn", "reply_kind", "n_passages", "deepest_level", "order_key", "own_text")


def quoting(turns: DataFrame) -> DataFrame:
    """Conversations in which three turns of four quote an earlier turn of theirs, a third of those another one deeper.

    Which ones is hashed from conversation and turn.  A quotation is the whole earlier text, in capitals half of the time.
    """
    draw = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "conv_id", "turn"), n).cast("long")
    first = F.when((F.col("turn") > 0) & (draw("quotes", F.lit(4)) > 0), draw("first", F.greatest(F.col("turn"), F.lit(1))))
    second = F.when(first.isNotNull() & (draw("deeper", F.lit(3)) == 0), draw("second", F.greatest(F.col("turn"), F.lit(1))))
    rows = turns.withColumns({"__first": first, "__second": second, "__capitals": draw("capitals", F.lit(2)) == 0})
    of = turns.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), "text")
    for k in ("first", "second"):
        side = of.withColumnsRenamed({"__conv": f"__conv_{k}", "__turn": f"__turn_{k}", "text": f"__text_{k}"})
        rows = rows.join(side, (F.col("conv_id") == F.col(f"__conv_{k}")) & (F.col(f"__{k}") == F.col(f"__turn_{k}")), "left")
    marked = lambda text, marks: F.concat(F.lit(marks), F.regexp_replace(text, "\n", "\n" + marks))
    shown = F.when(F.col("__capitals"), F.upper("__text_first")).otherwise(F.col("__text_first"))
    parts = [F.when(F.col("__second").isNotNull(), marked(F.col("__text_second"), ">> ")), F.when(F.col("__first").isNotNull(), marked(shown, "> ")), F.col("text")]
    return rows.select(*[c for c in turns.columns if c != "text"], F.concat_ws("\n", *parts).alias("text"))


def quoted_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linking over the whole table, whose turns hold no quotation, with quotations of its own turns in them."""
    linked = quotation.link_quotations(quoting(table(spark, sf_dir, "conversations")))
    return linked.select("conv_id", "turn", "parent_turn", "reply_kind", "n_passages", "deepest_level", "order_key", "own_text")


def op5_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", "text", F.round("rate", 6).alias("rate"), "n_copies", "copy", "shuffle_key")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.array_join(F.col("license_ids").cast("array<string>"), ",")
    return scanned.select("doc_id", F.size("license_ids").alias("n_known"), ids.alias("license_ids"), F.array_join("licenses", ",").alias("licenses"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights are 1: the contract's similarity is of sets of shingles, and signatures by counts would miss pairs of it."""
    near = dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return near.select("doc_id", "class_id", "class_size", "n_shingles", "kept")


def op8_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return importance.resample(docs, table(spark, sf_dir, "labels"))


def op9_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    ruled = line_frequency.quality_rules(docs)
    return ruled.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed", "n_words_left"
    )


def op10_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return hash_tree.assign_shards(docs, tree=TREE)


def op11_rp_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = rp_forest.neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return near.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = merkle.leaf_of("doc_id", "source", "lang", "n_chars", F.translate("text", UPPER, LOWER))
    made = merkle.manifest(docs, carry={"claimed": F.when(tampered, claimed)})
    root = merkle.folded(F.coalesce("claimed", "leaf"), F.col("path"))
    out = made.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


WS = r"[\x20\x09-\x0D]"
TEXT = "coalesce(text, '')"

OP3_SQL = f"""
WITH t AS (SELECT doc_id, length({TEXT}) AS cp, regexp_replace({TEXT}, '{WS}', '', 'g') AS norm FROM documents),
g AS (SELECT norm, count(*)::BIGINT AS group_size, (list(doc_id ORDER BY cp DESC, doc_id))[1] AS keep_id FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256 FROM t JOIN g USING (norm)"""

_L = line_frequency.Limits()
_NORMAL = f"trim(regexp_replace(lower(line), '{WS}+', ' ', 'g'), ' ')"
OP9_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, {TEXT} AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS win FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM win) WHERE n > 1),
gap AS (SELECT r, least(8, i - coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), -8)) AS g FROM rep),
cov AS (SELECT r, sum(g)::BIGINT AS n_repeat_words FROM gap GROUP BY r),
l AS (SELECT r, host, t, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS k FROM w),
ln AS (SELECT r, host, t, line, k, {_NORMAL} AS norm FROM l),
hosts AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
freq AS (SELECT host, norm FROM (SELECT host, norm, count(DISTINCT t) AS n FROM ln WHERE norm <> '' GROUP BY host, norm) JOIN hosts USING (host)
         WHERE n > {_L.min_documents} AND n > {_L.max_share} * docs),
marked AS (SELECT ln.r, f.norm IS NOT NULL AS gone, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words
           FROM ln LEFT JOIN freq f ON f.host = ln.host AND f.norm = ln.norm),
lost AS (SELECT r, sum(gone::INT)::BIGINT AS n_lines_removed, sum(CASE WHEN gone THEN 0 ELSE words END)::BIGINT AS n_words_left FROM marked GROUP BY r),
m AS (SELECT w.r, doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(t, '{WS}', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
             n_lines_removed, n_words_left
      FROM w LEFT JOIN cov USING (r) JOIN lost USING (r)),
b AS (SELECT *, (n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.max_repeat_percent} * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT (n_words_left < {_L.min_words} OR n_words_left < {_L.min_left}::DOUBLE * n_words)) AS kept, n_lines_removed, n_words_left FROM b"""

# CRC-32 by bytes; the table follows from its polynomial.
_TABLE = """(SELECT list(t ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, range(0, 8)),
 lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END) AS t FROM (SELECT unnest(range(0, 256)) AS i)))"""
_CELLS = f"(SELECT greatest({hash_tree.LEAST_CELLS}, (count(*) + {TREE.size * hash_tree.CELL_ROWS - 1}) // {TREE.size * hash_tree.CELL_ROWS}) FROM documents)"
_CELL = "floor((('0x' || substr(md5(concat_ws('|', 'cell', coalesce(doc_id::VARCHAR, '~'), text_crc32::VARCHAR)), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE) * {cells})"
OP10_SQL = f"""
WITH tab AS (SELECT {_TABLE} AS t), b AS (SELECT doc_id, octet_length(encode({TEXT}))::BIGINT + 8 AS size, hex(encode({TEXT})) AS h FROM documents),
c AS (SELECT doc_id, size, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS bytes FROM b),
d AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1])), 4294967295::BIGINT) AS text_crc32 FROM c, tab),
e AS (SELECT *, {_CELL.format(cells=_CELLS)} AS cell FROM d),
s1 AS ({hash_tree.shard_sql("doc_id", TREE, "e")}),
s2 AS ({hash_tree.shard_sql("doc_id", TREE.grown(), "(SELECT * RENAME (sh AS shard) FROM s1)")})
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY cell, doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, sh AS grown_shard FROM s2"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR))::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = lambda text: "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
_CLIMB = """SELECT tree, 0 AS lvl, pos, node, size FROM {0} UNION ALL
 SELECT tree, lvl + 1, pos // 16, sha256(string_agg(node, '' ORDER BY pos)), (any_value(size) + 15) // 16 FROM {1} WHERE size > 1 GROUP BY tree, lvl, pos // 16"""
_STEPS = """SELECT l.rn, {2} AS part, r.lvl, (l.pos // (16 ** r.lvl)::BIGINT) % 16 AS i, r.ns FROM {0} l
 JOIN (SELECT tree, lvl, pos // 16 AS run, list(node ORDER BY pos) AS ns FROM {1} WHERE size > 1 GROUP BY ALL) r ON r.tree = l.tree AND r.run = l.pos // (16 ** (r.lvl + 1))::BIGINT"""
OP12_SQL = f"""
WITH RECURSIVE tab AS (SELECT {_TABLE} AS t), d AS (SELECT *, row_number() OVER () AS rn, hex(encode(doc_id::VARCHAR)) AS h FROM documents),
c AS (SELECT d.*, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
      lambda a, x: xor(a // 256, t[(xor(a, x) % 256) + 1])), 4294967295::BIGINT) AS crc FROM d, tab),
l AS (SELECT rn, doc_id, coalesce('=' || source, '') AS tree, {_LEAF("text")} AS node, CASE WHEN crc % 5 = 0 THEN {_LEAF(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claimed FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, node) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS size FROM l),
up AS ({_CLIMB.format("p", "up")}),
subs AS (SELECT tree AS src, node AS subroot FROM up WHERE size = 1),
q AS (SELECT '' AS tree, src, subroot AS node, row_number() OVER (ORDER BY encode(src)) - 1 AS pos, count(*) OVER () AS size FROM subs),
top AS ({_CLIMB.format("q", "top")}),
steps AS ({_STEPS.format("p", "up", 0)} UNION ALL {_STEPS.format("(SELECT p.rn, q.tree, q.pos FROM p JOIN q ON q.src = p.tree)", "top", 1)}),
paths AS (SELECT rn, list(lpad(i::VARCHAR, 2, '0') || array_to_string(list_concat(ns[:i], ns[i + 2:]), '') ORDER BY part, lvl) AS steps FROM steps GROUP BY rn),
o AS (SELECT p.*, coalesce(steps, []) AS steps FROM p LEFT JOIN paths USING (rn)),
f AS (SELECT *, list_reduce(list_prepend(coalesce(claimed, node), steps), lambda a, s: sha256(substr(s, 3, s[:2]::BIGINT * 64) || a || substr(s, 3 + s[:2]::BIGINT * 64))) AS folded_root FROM o)
SELECT doc_id, f.node AS leaf, subroot, r.node AS root, sha256(array_to_string(list_transform(steps, lambda s: s[3:]), '')) AS proof_sha256, folded_root, folded_root = r.node AS verified
FROM f JOIN subs ON subs.src = f.tree, (SELECT node FROM top WHERE size = 1) r"""

OP13_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
f AS (SELECT lang, m, g, count(*)::BIGINT AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
inside AS (SELECT lang, g[i:i + s - 1] AS g, max(f) AS most FROM (SELECT lang, g, f, m, s, unnest(range(1, m - s + 2)) AS i FROM f, (SELECT unnest(range(2, 5)) AS s) WHERE s < m) GROUP BY ALL),
c AS (SELECT f.* FROM f LEFT JOIN inside USING (lang, g) WHERE m > 1 AND (most IS NULL OR 100 * most < 100 * f)),
cuts AS (SELECT lang, g, f AS a, k, g[1:k] AS g1, g[k + 1:] AS g2 FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
s AS (SELECT cuts.lang, cuts.g, a, k, f1.f AS l, f2.f AS r, n, ((1000::HUGEINT * a * n) // (f1.f::HUGEINT * f2.f))::BIGINT AS score
      FROM cuts JOIN f f1 ON f1.lang = cuts.lang AND f1.g = g1 JOIN f f2 ON f2.lang = cuts.lang AND f2.g = g2 JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(array_to_string(g, ' '))) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, n, score
FROM b QUALIFY rank <= 2000"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_bpe_chunks": op2_bpe_chunks,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_quotation_linking": op4_quotation_linking,
    "op5_poisson_mixing": op5_poisson_mixing,
    "op6_license_scan": op6_license_scan,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_importance": op8_importance,
    "op9_line_frequency": op9_line_frequency,
    "op10_hash_tree": op10_hash_tree,
    "op11_rp_forest": op11_rp_forest,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_collocations": op13_collocations,
    "quoted_conversations": quoted_conversations,
}

ORACLE_SQL: dict[str, str] = {
    "op3_exact_dedup": OP3_SQL,
    "op5_poisson_mixing": "SELECT doc_id, source, text, round(rate, 6) AS rate, n_copies, copy, shuffle_key FROM (" + mixing.mix_sql("d.doc_id, d.source, d.text") + ")",
    "op6_license_scan": license_scan.scan_sql(),
    "op9_line_frequency": OP9_SQL,
    "op10_hash_tree": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
