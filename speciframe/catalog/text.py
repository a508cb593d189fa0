"""Text cleaning, tokens and reductions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import tokens as K
from .base import ctes, lexicon, query, spread, table

PUNCT = r"[!-/:-@\[-`{-~]"
WORDS = (
    r"regexp_extract_all({0}, '(?i)<start_of_text>|<end_of_text>|''s|''t|''re|''ve|''m|''ll|''d|[\p{{L}}]+|[\p{{N}}]|[^\s\p{{L}}\p{{N}}]+')"
)
ENTITIES = (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"))


def collapse(expr):
    return f"trim(regexp_replace({expr}, '\\s+', ' ', 'g'))"


def unescape(expr):
    for name, ch in ENTITIES:
        expr = f"replace({expr}, '{name}', '{ch}')"
    return f"regexp_replace({expr}, '&amp;?', '&', 'g')"


BASIC = f"trim({unescape(unescape('html'))}, ' ' || chr(10) || chr(9) || chr(13))"


@query("basic_clean", f"SELECT page_id, {BASIC} AS text FROM pages")
def basic_clean(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.basic_clean("html").alias("text"))


@query("whitespace_clean", f"SELECT doc_id, {collapse('text')} AS text FROM documents")
def whitespace_clean(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.whitespace_clean("text").alias("text"))


def canonical(expr):
    bare = f"regexp_replace(replace({expr}, '_', ' '), '{PUNCT}', '', 'g')"
    return collapse(f"lower({bare})")


@query("canonicalize_text", f"SELECT doc_id, {canonical('text')} AS text FROM documents")
def canonicalize_text(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.canonicalize_text("text").alias("text"))


_KEPT = f"array_to_string(list_transform(string_split(replace(html, '_', ' '), '</p>'), lambda p: regexp_replace(p, '{PUNCT}', '', 'g')), '</p>')"


@query("canonicalize_keep", f"SELECT page_id, {collapse(f'lower({_KEPT})')} AS text FROM pages")
def canonicalize_keep(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.canonicalize_text("html", keep="</p>").alias("text"))


@query(
    "clean_modes",
    f"SELECT page_id, {canonical(BASIC)} AS canonicalize, lower({collapse(BASIC)}) AS lower_case, {collapse(BASIC)} AS whitespace FROM pages",
)
def clean_modes(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id",
        X.cleaner("canonicalize")("html").alias("canonicalize"),
        X.cleaner("lower")("html").alias("lower_case"),
        X.cleaner("whitespace")("html").alias("whitespace"),
    )


@query(
    "pretokenize",
    f"SELECT doc_id, len({WORDS.format('text')}) AS n_words, md5(array_to_string({WORDS.format('text')}, '|')) AS words FROM documents",
)
def pretokenize(spark, sf):
    words = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", X.pretokenize("text").alias("w"))
    return words.select("doc_id", F.size("w").alias("n_words"), F.md5(F.array_join("w", "|")).alias("words"))


# Merges for the checks, in rank order; each uses pieces that exist before it.
MERGES = (
    ("t", "h"), ("e", "n"), ("o", "n</w>"), ("th", "e</w>"), ("o", "u"), ("i", "on</w>"), ("t", "ion</w>"), ("e", "r"),
    ("i", "n"), ("e", "s</w>"), ("a", "n"), ("Ã", "©"), ("l", "e</w>"), ("en", "t</w>"), ("an", "d</w>"), ("in", "g</w>"),
)
VOCABULARY = K.Vocabulary(MERGES)


def _vocab_values():
    quoted = lambda e: "'" + e.replace("'", "''") + "'"
    return ", ".join(f"({quoted(e)}, {i})" for i, e in enumerate(VOCABULARY.entries))


def _bpe_sql():
    expr = "s"
    for a, b in MERGES:
        quoted = lambda e: "'" + e.replace("'", "''") + "'"
        expr = (
            f"replace({expr}, chr(1) || {quoted(a)} || chr(2) || chr(1) || {quoted(b)} || chr(2), chr(1) || {quoted(a + b)} || chr(2))"
        )
    return expr


_CLEAN = f"lower({collapse(unescape(unescape('text')))})"
_ENCODE_SQL = f"""WITH words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos
  FROM (SELECT doc_id, {WORDS.format(_CLEAN)} AS w FROM documents)),
 codes AS (SELECT word, list_transform(range(0, octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), (2 * i + 1)::INT, 2))::INT) AS b
  FROM (SELECT DISTINCT word FROM words)),
 chars AS (SELECT word, list_transform(b, lambda c: chr(CASE WHEN c <= 32 THEN 256 + c WHEN c BETWEEN 127 AND 160 THEN 289 + c - 127
   WHEN c = 173 THEN 323 ELSE c END)) AS l FROM codes),
 split AS (SELECT word, chr(1) || array_to_string(l, chr(2) || chr(1)) || '</w>' || chr(2) AS s FROM chars),
 merged AS (SELECT word, string_split(substr({_bpe_sql()}, 2, length({_bpe_sql()}) - 2), chr(2) || chr(1)) AS parts FROM split),
 vocab(entry, id) AS (VALUES {_vocab_values()}),
 ids AS (SELECT word, list(id ORDER BY i) AS ids FROM (SELECT word, unnest(parts) AS entry, generate_subscripts(parts, 1) AS i FROM merged)
  JOIN vocab USING (entry) GROUP BY word)
 SELECT doc_id, sum(len(ids))::BIGINT AS n_tokens, md5(string_agg(array_to_string(ids, ' '), ' ' ORDER BY pos)) AS tokens
 FROM words JOIN ids USING (word) GROUP BY doc_id"""


def framed_sql(source, key, column, length):
    """CTEs up to ``framed`` (key, tokens): texts of ``source`` encoded as above, between start and end marks, cut and padded."""
    inner = _ENCODE_SQL.replace("WITH words AS", "words AS", 1).replace("FROM documents", f"FROM {source}").replace("doc_id", key)
    inner = inner.replace(unescape(unescape("text")), unescape(unescape(column)))
    upto = inner[: inner.rindex(f" SELECT {key}, sum(len(ids))")]
    start, end = VOCABULARY.start_id, VOCABULARY.end_id
    body = f"([{start}] || flatten(list(ids ORDER BY pos))[1:{length - 2}] || [{end}])"
    return f"""{upto}, coded AS (SELECT {key}, {body} AS t FROM words JOIN ids USING (word) GROUP BY {key}),
 framed AS (SELECT s.{key}, {_pad_sql(f"coalesce(t, [{start}, {end}])", length, 0)} AS tokens FROM {source} s LEFT JOIN coded USING ({key}))"""


def _encoded(spark, sf):
    docs = spread(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", K.encode_text("text", VOCABULARY).alias("t"))


@query("encode_corpus", _ENCODE_SQL)
def encode_corpus(spark, sf):
    return _encoded(spark, sf).select(
        "doc_id",
        F.size("t").cast("bigint").alias("n_tokens"),
        F.md5(F.array_join(F.transform("t", lambda x: x.cast("string")), " ")).alias("tokens"),
    )


@query(
    "decode_tokens",
    f"SELECT doc_id, array_to_string(list_transform({WORDS.format(_CLEAN)}, lambda w: w || ' '), '') AS text FROM documents",
)
def decode_tokens(spark, sf):
    return _encoded(spark, sf).select("doc_id", K.decode_tokens("t", VOCABULARY).alias("text"))


# Word lengths stand for token ids below.
_LENGTHS = "list_transform(regexp_extract_all(text, '[^\\s]+'), lambda w: length(w))"


def _lengths():
    return F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"[^\s]+"), F.lit(0)), lambda w: F.length(w))


def _joined(tokens):
    return F.array_join(F.transform(tokens, lambda t: t.cast("string")), " ").alias("tokens")


def _pad_sql(body, length, pad):
    return f"list_concat({body}, list_transform(range(0, greatest({length} - len({body}), 0)), lambda i: {pad}))"


@query(
    "frame_tokens",
    "SELECT conv_id, turn, array_to_string(" + _pad_sql(f"([1001] || {_LENGTHS}[1:22] || [1002])", 24, 0) + ", ' ') AS tokens FROM conversations",
)
def frame_tokens(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", _joined(K.frame_tokens(_lengths(), 1001, 1002, 24)))


@query(
    "frame_cls",
    "SELECT conv_id, turn, array_to_string("
    + _pad_sql(f"([1001] || list_transform({_LENGTHS}[1:21], lambda t: CASE WHEN t = 3 THEN 0 ELSE t END) || [1002])", 23, 7)
    + " || [101], ' ') AS tokens FROM conversations",
)
def frame_cls(spark, sf):
    tokens = K.blank_separator(_lengths(), 3)
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", _joined(K.frame_with_class_token(tokens, 1001, 1002, 101, 7, 24))
    )


_DOC_WORDS = "SELECT doc_id, regexp_extract_all(text, '[^\\s]+') AS w FROM documents"
_EACH_WORD = f"SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM ({_DOC_WORDS})"


def _doc_words(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select(
        "doc_id", F.regexp_extract_all(F.col("text"), F.lit(r"[^\s]+"), F.lit(0)).alias("w")
    )


def _reduce_sql(order):
    return f"""WITH each_word AS ({_EACH_WORD}), ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id
  ORDER BY md5(concat_ws(':', '5', doc_id, pos)), pos) AS rn, count(*) OVER (PARTITION BY doc_id) AS n FROM each_word)
 SELECT doc_id, string_agg(word, ' ' ORDER BY {order}) AS words FROM ranked WHERE rn <= 30 GROUP BY doc_id"""


def _reduced(mode):
    def run(spark, sf):
        words = _doc_words(spark, sf).filter(F.size("w") > 0)
        return words.select("doc_id", F.array_join(K.reducer(mode)("w", "doc_id", 5, 30), " ").alias("words"))

    return run


query("reduce_random", _reduce_sql("pos"))(_reduced("random"))
query("reduce_shuffle", _reduce_sql("CASE WHEN n > 30 THEN rn ELSE pos END"))(_reduced("shuffle"))
query(
    "reduce_block",
    f"""WITH d AS ({_DOC_WORDS}), s AS (SELECT doc_id, w, CASE WHEN len(w) > 30
   THEN ('0x' || substr(md5('5:' || doc_id), 1, 8))::BIGINT % (len(w) - 29) ELSE 0 END AS st FROM d WHERE len(w) > 0)
 SELECT doc_id, array_to_string(list_slice(w, st + 1, st + 30), ' ') AS words FROM s""",
)(_reduced("simple"))


@query(
    "reduce_priority",
    ctes("lexicon")
    + f""", tags AS (SELECT word, min(CASE WHEN tag LIKE 'NN%' THEN 1 WHEN tag LIKE 'JJ%' THEN 2 WHEN tag LIKE 'VB%' THEN 3 ELSE 4 END) AS p
   FROM lexicon GROUP BY word),
 caps AS (SELECT p_partkey, string_split(p_name || ' of ' || p_type || ' and ' || p_name, ' ') AS w FROM part),
 each_word AS (SELECT p_partkey, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM caps),
 ranked AS (SELECT e.*, row_number() OVER (PARTITION BY p_partkey ORDER BY coalesce(p, 4), pos) AS rn FROM each_word e LEFT JOIN tags USING (word))
 SELECT p_partkey, string_agg(word, ' ' ORDER BY pos) AS words FROM ranked WHERE rn <= 3 GROUP BY p_partkey""",
)
def reduce_priority(spark, sf):
    caption = F.concat("p_name", F.lit(" of "), "p_type", F.lit(" and "), "p_name")
    words = table(spark, sf, "part").select("p_partkey", K.split_text_for_priority(caption).alias("w"))
    reduced = K.reduce_priority(words, lexicon(spark, sf), "p_partkey", "w", 3)
    return reduced.select("p_partkey", F.array_join("reduced", " ").alias("words"))
