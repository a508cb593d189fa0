"""Registered queries of the text operators, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speciframe.session import cut_lineage

from . import (
    bpe, conversation_trie, fingerprints, language_model, licenses, merkle, neardup, packing, partition_index, pii,
    quality, secret_scan, toxicity,
)
from .common import documents, held_out, span_text
from .native import let

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/labels.parquet")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: span_text(s["kind"], s["start"], s["end"])), ",")


def of_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op3_quality_rules")
def op3(spark, sf):
    m = F.col("_measures")
    return quality.judge(documents(spark, sf)).select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"),
        m["n_dup_lines"].alias("n_dup_lines"), m["n_repeat_words"].alias("n_repeat_words"),
        F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"),
    )


@query("op5_personal_data")
def op5(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs)).withColumn("b", F.col("_personal.base")).withColumn("a", F.col("_personal.spans"))
    return found.select(
        "doc_id", *[of_kind(F.col("b"), k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(listed(F.col("b")), 256).alias("base_sha256"), listed(F.col("a")).alias("spans"),
    )


@query("op6_toxicity")
def op6(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text")
    model = toxicity.fit(docs, labels(spark, sf), lambda doc_id: ~held_out(doc_id))
    rated = toxicity.score(docs, model)
    return rated.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity.score").alias("score"),
        F.when(F.col("_toxicity.score") >= 0.5, 1).otherwise(0).alias("predicted"),
        F.col("_toxicity.segments").alias("passages"),
    )


@query("op9_forced_boundary_bpe")
def op9(spark, sf):
    coded = bpe.digests(documents(spark, sf).select("doc_id", "text"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", "_coded.*")


@query("op10_residual_packing")
def op10(spark, sf):
    return packing.pack(documents(spark, sf), vocabulary("byte_bpe_50k.json"))


@query("op7_near_duplicates", """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
one AS (SELECT min(doc_id) AS id, list_sort(s) AS s FROM shingled WHERE len(s) > 0 GROUP BY list_sort(s)),
flat AS (SELECT id, len(s) AS n, unnest(s) AS g FROM one),
pairs AS (
  SELECT a.id AS x, b.id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.id < b.id AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.id, b.id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
links AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
reach AS (
  WITH RECURSIVE r(id, c) AS (SELECT id, id FROM one UNION SELECT l.y, r.c FROM r JOIN links l ON l.x = r.id AND r.c < l.y)
  SELECT id, min(c) AS c FROM r GROUP BY id),
named AS (SELECT one.s, reach.c FROM one JOIN reach USING (id))
SELECT d.doc_id, len(d.s) AS n_shingles, coalesce(n.c, d.doc_id) AS component_id, coalesce(n.c, d.doc_id) = d.doc_id AS kept
FROM shingled d LEFT JOIN named n ON list_sort(d.s) = n.s
""")
def op7(spark, sf):
    return neardup.groups(documents(spark, sf)).select(
        "doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


@query("op1_order_minhash")
def op1(spark, sf):
    pairs = fingerprints.with_next(documents(spark, sf))
    changed = fingerprints.edited(F.col("text"), F.col("next_text"))
    told = let(changed, lambda e: let(fingerprints.fingerprint(e), lambda g: F.struct(
        F.sha2(e.cast("binary"), 256).alias("edited_sha256"), fingerprints.spelled(g).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("f"), g).alias("near_edited"))))
    return pairs.withColumn("told", told).select(
        "doc_id", F.char_length("text").cast("long").alias("n_chars"), "told.edited_sha256",
        fingerprints.spelled(F.col("f")).alias("fingerprint"), "told.edited_fingerprint", "told.near_edited",
        fingerprints.likeness(F.col("f"), F.col("next_f")).alias("near_next"),
    )


@query("op2_secret_scan")
def op2(spark, sf):
    base = F.col("base")
    return secret_scan.scan(documents(spark, sf)).select(
        "doc_id", *[of_kind(base, k).alias(f"n_{k}") for k in secret_scan.KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), "n_live", "n_example")


@query("op4_stupid_backoff", """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
tokens AS (SELECT doc_id, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS t, unnest(list_concat([NULL], w)[1:len(w)]) AS p FROM words),
one AS (SELECT t, count(*) AS c FROM tokens GROUP BY t), two AS (SELECT p, t, count(*) AS c FROM tokens WHERE p IS NOT NULL GROUP BY p, t),
own1 AS (SELECT doc_id, t, count(*) AS c FROM tokens GROUP BY doc_id, t),
own2 AS (SELECT doc_id, p, t, count(*) AS c FROM tokens WHERE p IS NOT NULL GROUP BY doc_id, p, t),
size AS (SELECT count(*) AS n FROM tokens),
rated AS (
  SELECT k.doc_id, coalesce(b.c - ob.c, 0) AS c2, a.c - oa.c AS c1, q.c - oq.c AS cp, size.n - k.n AS others, k.p
  FROM tokens k CROSS JOIN size JOIN one a ON a.t = k.t JOIN own1 oa ON oa.doc_id = k.doc_id AND oa.t = k.t
  LEFT JOIN two b ON b.p = k.p AND b.t = k.t LEFT JOIN own2 ob ON ob.doc_id = k.doc_id AND ob.p = k.p AND ob.t = k.t
  LEFT JOIN one q ON q.t = k.p LEFT JOIN own1 oq ON oq.doc_id = k.doc_id AND oq.t = k.p),
summed AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE c2 > 0) AS n_seen, sum(
    CASE WHEN c2 > 0 THEN ln(c2 / cp) ELSE (CASE WHEN p IS NULL THEN 0 ELSE ln(0.4) END)
      + (CASE WHEN c1 > 0 THEN ln(c1 / greatest(others, 1)) ELSE -ln(others + 1) END) END) AS s FROM rated GROUP BY doc_id)
SELECT w.doc_id, coalesce(n_tokens, 0) AS n_tokens, coalesce(n_seen, 0) AS n_seen,
  round(coalesce(s / n_tokens, 0), 6) AS mean_log_score FROM words w LEFT JOIN summed USING (doc_id)
""")
def op4(spark, sf):
    rated = language_model.score(documents(spark, sf))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).otherwise(0.0)
    return rated.select("doc_id", "n_tokens", "n_seen", F.round(mean, 6).alias("mean_log_score"))


@query("op8_license_scan")
def op8(spark, sf):
    docs = documents(spark, sf)
    found = licenses.scan(docs, licenses.fit(docs))
    told = F.transform("_licences", lambda r: F.concat_ws(":", r["paragraph"].cast("string"), r["family"], r["probability"].cast("string")))
    return found.select("doc_id", F.size("_licences").cast("long").alias("n_notices"),
                        F.array_join(F.array_sort(F.array_distinct(F.col("_licences.family"))), ",").alias("families"),
                        F.array_join(told, ",").alias("notices"))


#: DuckDB has no crc32: the checksum of a decimal number ``{0}``, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
  lambda r, b: list_reduce(list_concat([xor(r, b)], list_transform(range(8), lambda z: 0)),
    lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295)"""


def _field(value: str) -> str:
    return f"coalesce(CAST(octet_length(encode(CAST({value} AS VARCHAR))) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
_UP = "list_transform(range(0, len({0}), 3), lambda i: sha256(array_to_string({0}[i + 1:i + 3], '')))"


@query("op13_merkle_manifest", f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, source, sha256({_HEAD} || {_field("text")}) AS leaf,
    sha256({_HEAD} || {_field(f"CASE WHEN {CRC32.format('doc_id')} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS changed FROM documents),
up(source, level, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY doc_id NULLS FIRST, leaf) FROM leaves GROUP BY source
  UNION ALL SELECT source, level + 1, {_UP.format("nodes")} FROM up WHERE len(nodes) > 1),
subroots AS (SELECT source, nodes[1] AS subroot FROM up WHERE len(nodes) = 1),
over(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY encode(source) NULLS FIRST) FROM subroots
  UNION ALL SELECT level + 1, {_UP.format("nodes")} FROM over WHERE len(nodes) > 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g FROM leaves),
levels AS (
  SELECT source, list(nodes ORDER BY level) AS levels FROM up WHERE len(nodes) > 1 GROUP BY source),
paths AS (
  SELECT p.doc_id, p.leaf, p.changed, s.subroot, t.nodes[1] AS root,
    list_concat(
      list_transform(range(1, len(coalesce(l.levels, [])) + 1), lambda j: [
        array_to_string(l.levels[j][p.i // (3 ** (j - 1))::BIGINT // 3 * 3 + 1 : p.i // (3 ** (j - 1))::BIGINT], ''),
        array_to_string(l.levels[j][p.i // (3 ** (j - 1))::BIGINT + 2 : p.i // (3 ** (j - 1))::BIGINT // 3 * 3 + 3], '')]),
      list_transform(range(1, len(coalesce(o.levels, [])) + 1), lambda j: [
        array_to_string(o.levels[j][p.g // (3 ** (j - 1))::BIGINT // 3 * 3 + 1 : p.g // (3 ** (j - 1))::BIGINT], ''),
        array_to_string(o.levels[j][p.g // (3 ** (j - 1))::BIGINT + 2 : p.g // (3 ** (j - 1))::BIGINT // 3 * 3 + 3], '')])) AS path
  FROM placed p JOIN subroots s ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN levels l ON l.source IS NOT DISTINCT FROM p.source
  CROSS JOIN (SELECT list(nodes ORDER BY level) AS levels FROM over WHERE len(nodes) > 1) o
  CROSS JOIN (SELECT nodes FROM over WHERE len(nodes) = 1) t),
told AS (
  SELECT *, list_reduce(list_concat([[changed, '']], path), lambda a, s: [sha256(s[1] || a[1] || s[2]), ''])[1] AS folded FROM paths)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(flatten(path), '')) AS proof_sha256, folded AS folded_root,
  folded = root AS verified FROM told
""")
def op13(spark, sf):
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    told = merkle.documents_manifest(documents(spark, sf), tampered).withColumn("folded", merkle.fold(F.col("row.changed"), F.col("path")))
    return told.select(
        "row.doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


@query("op12_conversation_trie", f"""
WITH RECURSIVE own AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST,
    md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
  SELECT o.conv_id, list_concat(coalesce(l.turns[1:o.h], []), o.turns[o.h + 1:]) AS turns
  FROM (SELECT *, {CRC32.format('conv_id')} % 6 AS h FROM own) o LEFT JOIN own l ON l.conv_id = o.conv_id - o.conv_id % 100),
passing AS (SELECT conv_id, unnest(range(0, len(turns) + 1)) AS depth, turns FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM passing GROUP BY turns[1:depth], depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, count(c.conv_id) AS n_children FROM nodes n
  LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
  LEFT JOIN nodes c ON c.depth = n.depth + 1 AND c.path[1:n.depth] = n.path GROUP BY ALL),
upward AS (
  SELECT path[1:d] AS path, d AS depth, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].t) END AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM linked)),
below AS (SELECT path, depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM upward GROUP BY path, depth)
SELECT l.conv_id, l.depth, l.parent_conv_id, l.n_convs, l.n_children, b.n_leaves, b.saved_tokens, l.ends_sha256
FROM linked l JOIN below b ON b.depth = l.depth AND b.path = l.path
""")
def op12(spark, sf):
    conversations = spark.read.parquet(f"{sf.rstrip('/')}/conversations.parquet")
    own = cut_lineage(conversation_trie.ordered_turns(conversations))
    grafted = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    heads = own.filter(F.col("conv_id") % 100 == 0).select(F.col("conv_id").alias("leader"), F.slice("turns", 1, 5).alias("head"))
    joined = own.withColumn("leader", F.col("conv_id") - F.col("conv_id") % 100).withColumn("h", grafted.cast("int")).join(heads, "leader", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    rest = F.slice("turns", F.col("h") + 1, F.size("turns"))
    return conversation_trie.trie(joined.select("conv_id", *conversation_trie.path_of(F.concat(head, rest))))


@query("op11_partition_index", """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
apart AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.v) + 1),
    lambda i: (c.v[i] - q.v[i]) * (c.v[i] - q.v[i])), lambda a, b: a + b)) AS score
  FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM apart)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
""")
def op11(spark, sf):
    vectors = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    index = partition_index.fit(vectors)
    return partition_index.search(index, index.rows.filter(F.col("vec_id") % 100 == 0))
