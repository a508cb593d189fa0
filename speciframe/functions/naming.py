"""Taxon records and the five ways of writing their names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = ("kingdom", "phylum", "cls", "order", "family", "genus", "species")
NAME_FIELDS = RANKS + ("subspecies",)
# The joining phrase and the accepted text types.
COMMON_NAME_PHRASE = " with common name "
TEXT_TYPES = ("asis", "sci", "taxon", "com", "sci_com", "taxon_com")
UNKNOWN_ID = -1


def capitalize(c) -> Column:
    """First character upper case, all the rest lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))


def parse_taxon(cls) -> Column:
    """``[id_]kingdom_phylum_..._species`` to a struct; a leading digit announces the id."""
    c = F.col(cls) if isinstance(cls, str) else cls
    tiers = F.split(c, "_")
    has_id = c.rlike("^[0-9]")
    shift = F.when(has_id, F.lit(1)).otherwise(F.lit(0))
    names = [F.coalesce(F.get(tiers, shift + i), F.lit("")).alias(name) for i, name in enumerate(NAME_FIELDS)]
    dataset_id = F.when(has_id, F.get(tiers, F.lit(0)).cast("int")).otherwise(F.lit(UNKNOWN_ID))
    return F.struct(
        *names,
        F.lit(UNKNOWN_ID).alias("website_id"),
        dataset_id.alias("dataset_id"),
        F.lit("").alias("common_name"),
    )


class TaxonColumns:
    """The columns holding one taxon. Ranks may be renamed; absent ones count as empty."""

    def __init__(self, **columns):
        self._columns = columns
        self._known: dict[str, Column] = {}

    @classmethod
    def of_struct(cls, struct) -> "TaxonColumns":
        s = F.col(struct) if isinstance(struct, str) else struct
        return cls(**{name: s[name] for name in NAME_FIELDS + ("common_name",)})

    def _once(self, name: str, make) -> Column:
        if name not in self._known:
            self._known[name] = make()
        return self._known[name]

    def __getitem__(self, name: str) -> Column:
        c = self._columns.get(name)
        if c is None:
            return F.lit("")
        return self._once(name, lambda: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))

    def written(self, name: str) -> Column:
        """The rank in canonical case: species and subspecies lower, the others capitalised."""
        lower = name in ("species", "subspecies")
        return self._once(f"written {name}", lambda: F.lower(self[name]) if lower else capitalize(self[name]))


def taxon_ranks(taxon: TaxonColumns) -> list[Column]:
    return [taxon.written(name).alias(name) for name in RANKS]


def scientific_name(taxon: TaxonColumns) -> Column:
    """Genus, species and subspecies as far as they are known; NULL when none is."""
    genus, species, sub = (taxon.written(n) for n in ("genus", "species", "subspecies"))
    return (
        F.when(taxon["subspecies"] != "", F.concat_ws(" ", genus, species, sub))
        .when(taxon["species"] != "", F.concat_ws(" ", genus, species))
        .when(taxon["genus"] != "", genus)
    )


def taxonomic_name(taxon: TaxonColumns) -> Column:
    """All ranks, or genus onwards without a kingdom. Empty ranks keep their separator."""
    def joined(names):
        short = F.concat_ws(" ", *[taxon.written(n) for n in names])
        return F.when(taxon["subspecies"] != "", F.concat_ws(" ", short, taxon.written("subspecies"))).otherwise(short)

    return F.when(taxon["kingdom"] == "", joined(RANKS[5:])).otherwise(joined(RANKS))


def common_name(taxon: TaxonColumns) -> Column:
    return taxon["common_name"]


def _with_common(base: Column, taxon: TaxonColumns) -> Column:
    known = taxon["common_name"] != ""
    return F.when(known, F.concat(base, F.lit(COMMON_NAME_PHRASE), taxon["common_name"])).otherwise(base)


def sci_common_name(taxon: TaxonColumns) -> Column:
    """Scientific name plus common name; NULL when there is no scientific name."""
    return _with_common(scientific_name(taxon), taxon)


def taxon_common_name(taxon: TaxonColumns) -> Column:
    return _with_common(taxonomic_name(taxon), taxon)


def class_text(text_type: str, taxon: TaxonColumns, asis="class") -> Column:
    """Class text in one of ``TEXT_TYPES``."""
    writers = {
        "sci": scientific_name,
        "taxon": taxonomic_name,
        "com": common_name,
        "sci_com": sci_common_name,
        "taxon_com": taxon_common_name,
    }
    if text_type == "asis":
        return F.col(asis) if isinstance(asis, str) else asis
    if text_type not in writers:
        raise ValueError(f"text type must be one of {', '.join(TEXT_TYPES)}, not {text_type!r}")
    return writers[text_type](taxon)


def class_prompt_name(cls) -> Column:
    """Folder name to prompt name: the leading number goes, underscores become spaces."""
    c = F.col(cls) if isinstance(cls, str) else cls
    parts = F.split(c, "_")
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " ")
