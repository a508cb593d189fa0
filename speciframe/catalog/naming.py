"""Naming, prompts and class numbering."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions import templates as P
from ..operators import joins, sampling
from .base import class_strings, ctes, query, table, taxa

TAXON = N.TaxonColumns(kingdom="kingdom", phylum="phylum", cls="cls", order="ord", family="family", genus="genus",
                       species="species", subspecies="subspecies", common_name="common_name")


def cap(c):
    return f"(upper(substr({c},1,1)) || lower(substr({c},2)))"


_LONG = f"concat_ws(' ', {cap('kingdom')}, {cap('phylum')}, {cap('cls')}, {cap('ord')}, {cap('family')}, {cap('genus')}, lower(species))"
_SHORT = f"concat_ws(' ', {cap('genus')}, lower(species))"
SCI = (
    f"CASE WHEN subspecies <> '' THEN {cap('genus')} || ' ' || lower(species) || ' ' || lower(subspecies)"
    f" WHEN species <> '' THEN {cap('genus')} || ' ' || lower(species) WHEN genus <> '' THEN {cap('genus')} END"
)
TAX = (
    f"CASE WHEN kingdom = '' THEN {_SHORT} ELSE {_LONG} END || CASE WHEN subspecies <> '' THEN ' ' || lower(subspecies) ELSE '' END"
)
WITH_COMMON = "CASE WHEN common_name <> '' THEN ({base}) || ' with common name ' || common_name ELSE ({base}) END"
SCI_COM, TAX_COM = WITH_COMMON.format(base=SCI), WITH_COMMON.format(base=TAX)

_RANKS = ("kingdom", "phylum", "cls", "order", "family", "genus", "species", "subspecies")
_PARSED = ", ".join(f'coalesce(t[{i + 1} + d], \'\') AS "{r}"' for i, r in enumerate(_RANKS))


@query(
    "parse_taxon",
    ctes("class_strings")
    + f""" SELECT id, {_PARSED}, CASE WHEN d = 1 THEN t[1]::INT ELSE -1 END AS dataset_id FROM (
  SELECT id, string_split(cls, '_') AS t, CASE WHEN regexp_matches(cls, '^[0-9]') THEN 1 ELSE 0 END AS d FROM class_strings)""",
)
def parse_taxon(spark, sf):
    parsed = class_strings(spark, sf).select("id", N.parse_taxon("cls").alias("t"))
    return parsed.select("id", *[F.col(f"t.{r}").alias(r) for r in _RANKS], "t.dataset_id")


_WRITTEN = ", ".join(f"{cap('ord' if r == 'order' else r)} AS \"{r}\"" for r in N.RANKS[:-1])


@query("taxon_ranks", ctes("taxa") + f" SELECT id, {_WRITTEN}, lower(species) AS species FROM taxa")
def taxon_ranks(spark, sf):
    return taxa(spark, sf).select("id", *N.taxon_ranks(TAXON))


def _named(name, sql, column):
    @query(name, ctes("taxa") + f" SELECT id, {sql} AS name FROM taxa")
    def run(spark, sf):
        return taxa(spark, sf).select("id", column().alias("name"))


_named("scientific_name", SCI, lambda: N.scientific_name(TAXON))
_named("taxonomic_name", TAX, lambda: N.taxonomic_name(TAXON))
_named("common_name", "common_name", lambda: N.common_name(TAXON))
_named("sci_common_name", SCI_COM, lambda: N.sci_common_name(TAXON))
_named("taxon_common_name", TAX_COM, lambda: N.taxon_common_name(TAXON))


@query(
    "text_types",
    ctes("taxa") + f" SELECT id, cls AS asis, {SCI} AS sci, {TAX} AS taxon, common_name AS com, {SCI_COM} AS sci_com, {TAX_COM} AS taxon_com FROM taxa",
)
def text_types(spark, sf):
    return taxa(spark, sf).select("id", *[N.class_text(t, TAXON, "cls").alias(t) for t in N.TEXT_TYPES])


@query("class_prompt_name", ctes("class_strings") + " SELECT id, array_to_string(string_split(cls, '_')[2:], ' ') AS name FROM class_strings")
def class_prompt_name(spark, sf):
    return class_strings(spark, sf).select("id", N.class_prompt_name("cls").alias("name"))


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


TEMPLATE_VALUES = ", ".join(f"({i}, {_quoted(t)})" for i, t in enumerate(P.EVALUATION_TEMPLATES))


@query(
    "prompt_expand",
    ctes("taxa")
    + f""", names AS (SELECT DISTINCT {SCI} AS name FROM taxa), t(template_id, template) AS (VALUES {TEMPLATE_VALUES})
 SELECT name, template_id, replace(template, '{{}}', name) AS prompt FROM names CROSS JOIN t WHERE name IS NOT NULL""",
)
def prompt_expand(spark, sf):
    names = taxa(spark, sf).select(N.scientific_name(TAXON).alias("name")).distinct().filter("name IS NOT NULL")
    return P.expand_prompts(names, "name")


@query(
    "prompt_templates",
    ctes("taxa")
    + f""", names AS (SELECT DISTINCT {SCI} AS name FROM taxa)
 SELECT name, 0 AS template_id, 'a photo of ' || name || '.' AS prompt FROM names WHERE name IS NOT NULL
 UNION ALL SELECT name, 1, lower(name) || ' (' || length(name) || ')' FROM names WHERE name IS NOT NULL""",
)
def prompt_templates(spark, sf):
    """A format string and a function from the name to the prompt side by side."""
    names = taxa(spark, sf).select(N.scientific_name(TAXON).alias("name")).distinct().filter("name IS NOT NULL")
    own = lambda name: F.concat(F.lower(name), F.lit(" ("), F.length(name).cast("string"), F.lit(")"))
    return P.expand_prompts(names, "name", ["a photo of {}.", own])


@query(
    "random_text_type",
    ctes("taxa")
    + f""", t AS (SELECT id, [{SCI}, common_name, {TAX}, {SCI_COM}, {TAX_COM}] AS v FROM taxa)
 SELECT id, v[1 + (('0x' || substr(md5('3:' || id), 1, 8))::BIGINT % 5)] AS text FROM t""",
)
def random_text_type(spark, sf):
    kinds = ("sci", "com", "taxon", "sci_com", "taxon_com")
    texts = taxa(spark, sf).select("id", *[N.class_text(t, TAXON).alias(t) for t in kinds])
    return texts.select("id", P.random_text_type("id", kinds, seed=3).alias("text"))


# -- class numbering ---------------------------------------------------------------------------


@query(
    "label_encode",
    """WITH c AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS class_idx FROM (SELECT DISTINCT p_type FROM part))
 SELECT p_partkey, p_type, class_idx FROM part JOIN c USING (p_type)""",
)
def label_encode(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_type")
    return sampling.label_encode(part, sampling.class_index_sorted(part, "p_type"), "p_type")


@query(
    "class_to_idx",
    """SELECT a.source, a.class_idx, g.class_idx AS given_idx FROM (
  SELECT source, row_number() OVER (ORDER BY first) - 1 AS class_idx FROM (SELECT source, min(doc_id) AS first FROM documents GROUP BY source)) a
 JOIN (SELECT source, arg_max(n_chars, doc_id) AS class_idx FROM documents GROUP BY source) g USING (source)""",
)
def class_to_idx(spark, sf):
    docs = table(spark, sf, "documents")
    given = sampling.class_index_given(docs, "source", "n_chars", "doc_id").withColumnRenamed("class_idx", "given_idx")
    return sampling.class_index_by_appearance(docs, "source", "doc_id").join(given, "source")


@query(
    "class_to_idx_sorted",
    "SELECT p_name, row_number() OVER (ORDER BY p_name) - 1 AS class_idx FROM (SELECT DISTINCT p_name FROM part)",
)
def class_to_idx_sorted(spark, sf):
    return sampling.class_index_sorted(table(spark, sf, "part"), "p_name")


@query(
    "permute_classes",
    """SELECT split, p_name, row_number() OVER (PARTITION BY split ORDER BY md5('1337:' || p_name), p_name) - 1 AS class_idx
 FROM (SELECT DISTINCT p_name FROM part), UNNEST(['pretraining', 'seen', 'unseen']) AS s(split)""",
)
def permute_classes(spark, sf):
    return sampling.permute_classes(table(spark, sf, "part"), "p_name", 1337)


@query(
    "relabel_priority",
    """SELECT p_brand, row_number() OVER (ORDER BY CASE p_brand WHEN 'Brand#9' THEN 1 WHEN 'Brand#2' THEN 2 WHEN 'Brand#14' THEN 3 ELSE 4 END, p_brand) - 1
 AS class_idx FROM (SELECT DISTINCT p_brand FROM part)""",
)
def relabel_priority(spark, sf):
    return sampling.relabel_priority(table(spark, sf, "part"), "p_brand", ["Brand#9", "Brand#2", "Brand#14"])


@query("sorted_classes", "SELECT DISTINCT p_brand FROM part ORDER BY p_brand")
def sorted_classes(spark, sf):
    return table(spark, sf, "part").select("p_brand").distinct().orderBy("p_brand")


@query("distinct_classes", "SELECT count(DISTINCT p_name) AS n_classes, count(DISTINCT p_type) AS n_types FROM part")
def distinct_classes(spark, sf):
    return table(spark, sf, "part").agg(F.countDistinct("p_name").alias("n_classes"), F.countDistinct("p_type").alias("n_types"))


@query("new_classes", "SELECT DISTINCT p_name FROM part WHERE p_size < 10 EXCEPT SELECT DISTINCT p_name FROM part WHERE p_size > 45")
def new_classes(spark, sf):
    part = table(spark, sf, "part")
    return joins.except_ids(part.filter("p_size < 10").select("p_name"), part.filter("p_size > 45").select("p_name"))


@query(
    "old_new_mask",
    """WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS class_idx FROM (SELECT DISTINCT p_brand FROM part))
 SELECT p_partkey, class_idx < 12 AS is_old FROM part JOIN c USING (p_brand)""",
)
def old_new_mask(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    coded = sampling.label_encode(part, sampling.class_index_sorted(part, "p_brand"), "p_brand")
    return joins.old_new_mask(coded, "class_idx", 12).select("p_partkey", "is_old")


def taxonomy_texts(spark, sf):
    """(id, text, target): taxonomic names with the order of their family name as class."""
    rows = taxa(spark, sf).select("id", N.taxonomic_name(TAXON).alias("text"), "family")
    classes = sampling.class_index_sorted(rows, "family")
    return rows.join(classes, "family").select("id", "text", F.col("class_idx").cast("int").alias("target"))
