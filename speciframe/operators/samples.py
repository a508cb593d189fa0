"""Members of shards grouped into samples, sample filters, and parts by preference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import has_caption_and_image, image_part, text_part
from ..session import cut_lineage
from .ranking import _offsets, _range_sorted

# Fixed value: a member name is everything before the first dot of its file name, and the rest.
NAME_PATTERN = r"(?s)^((?:.*/|)[^.]+)[.]([^/]*)$"
# Members of one run that are folded as one array; longer runs are cut by pointer doubling.
RUN_LIMIT = 512
_CHUNK = 1 << 16


def split_member_name(fname) -> tuple[Column, Column]:
    """Key and suffix; NULL when the name has no suffix."""
    c = F.col(fname) if isinstance(fname, str) else fname
    ok = c.rlike(NAME_PATTERN)
    return F.when(ok, F.regexp_extract(c, NAME_PATTERN, 1)), F.when(ok, F.regexp_extract(c, NAME_PATTERN, 2))


def mark_samples(
    members: DataFrame, url: str = "url", order: str = "member_no", fname: str = "fname", keys=split_member_name,
    lower: bool = True, suffixes: Sequence[str] | None = None, run_limit: int = RUN_LIMIT,
) -> DataFrame:
    """(url, member_no, key, suffix, stored, sample): ``sample`` is the position of the first
    member of the sample a member belongs to.

    A sample ends when the key changes or a suffix comes again. Members are sorted by ranges, so
    one huge shard is many partitions; runs of equal keys are numbered by running sums. Inside a
    run, the next sample starts at the first suffix that came before in this one.
    """
    key, suffix = keys(fname)
    named = members.select(url, order, key.alias("key"), (F.lower(suffix) if lower else suffix).alias("suffix"))
    named = named.filter(F.col("key").isNotNull())
    stored = F.lit(True) if suffixes is None else F.col("suffix").isin(list(suffixes))
    placed = _range_sorted(named.withColumn("stored", stored), [url, order])
    placed = (
        placed.join(F.broadcast(_offsets(placed, F.lit(1))), "_p").withColumn("_pos", F.col("_before") + F.col("_o")).drop("_before")
    )
    # The member before the first one of a sort partition is the last one of an earlier partition.
    here = Window.partitionBy("_p").orderBy("_o")
    tag = F.struct(F.col(url).alias("u"), F.col("key").alias("k"))
    lasts = placed.groupBy("_p").agg(F.max_by(tag, "_o").alias("_t"))
    lasts = lasts.select("_p", F.lag("_t").over(Window.orderBy("_p")).alias("_carry"))
    before = F.when(F.row_number().over(here) == 1, F.col("_carry")).otherwise(F.lag(tag).over(here))
    flagged = placed.join(F.broadcast(lasts), "_p").withColumn("_prev", before)
    flagged = flagged.withColumn("_new", (~F.col("_prev").eqNullSafe(tag)).cast("bigint")).drop("_carry", "_prev")
    runs = flagged.join(F.broadcast(_offsets(flagged, F.col("_new"))), "_p").withColumn(
        "_run", F.col("_before") + F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0))
    )
    runs = cut_lineage(runs.select(url, order, "key", "suffix", "stored", "_pos", "_run"))
    sizes = runs.groupBy("_run").agg(F.count("*").alias("_n"), F.min("_pos").alias("_start"))
    # At most one long run per run_limit members; AQE picks the join by the size of this table.
    long_runs = sizes.filter(F.col("_n") > run_limit).select("_run", "_start")
    short = _fold_short(runs.join(long_runs, "_run", "left_anti"), url, order)
    if long_runs.isEmpty():
        return short
    return short.unionByName(_cut_long(runs.join(long_runs, "_run"), url, order))


def _fold_short(runs: DataFrame, url: str, order: str) -> DataFrame:
    entry = F.struct("_pos", F.col(order).alias("_m"), "suffix", "stored")
    lists = runs.groupBy(url, "_run", "key").agg(F.array_sort(F.collect_list(entry)).alias("_l"))

    def add(state: Column, e: Column) -> Column:
        again = e["stored"] & F.array_contains(state["seen"], e["suffix"])
        fresh = again | (state["start"] < 0)
        kept = F.when(again, F.array().cast("array<string>")).otherwise(state["seen"])
        seen = F.when(e["stored"], F.concat(kept, F.array(e["suffix"]))).otherwise(kept)
        start = F.when(fresh, e["_pos"]).otherwise(state["start"])
        return F.struct(seen.alias("seen"), start.alias("start"), F.concat(state["out"], F.array(start)).alias("out"))

    empty = F.struct(
        F.array().cast("array<string>").alias("seen"), F.lit(-1).cast("bigint").alias("start"),
        F.array().cast("array<bigint>").alias("out"),
    )
    folded = lists.withColumn("_s", F.aggregate("_l", empty, add, lambda s: s["out"]))
    rows = folded.select(url, "key", F.explode(F.arrays_zip("_l", "_s")).alias("_e"))
    return rows.select(
        url, F.col("_e._l._m").alias(order), "key", F.col("_e._l.suffix").alias("suffix"),
        F.col("_e._l.stored").alias("stored"), F.col("_e._s").alias("sample"),
    )


def _nearest_after(rows: DataFrame, group: Sequence[str], value: str, out: str, inclusive: bool) -> DataFrame:
    """Smallest ``value`` at a later position of the group (or from here on), in two levels: inside
    chunks of positions, and over one row per chunk."""
    group = list(group)
    chunked = rows.withColumn("_c", F.floor(F.col("_pos") / _CHUNK))
    inside = Window.partitionBy(*group, "_c").orderBy("_pos").rowsBetween(0 if inclusive else 1, Window.unboundedFollowing)
    later = Window.partitionBy(*group).orderBy("_c").rowsBetween(1, Window.unboundedFollowing)
    chunks = chunked.groupBy(*group, "_c").agg(F.min(value).alias("_v"))
    chunks = chunks.select(*group, "_c", F.min("_v").over(later).alias("_later"))
    both = chunked.withColumn("_near", F.min(value).over(inside)).join(chunks, [*group, "_c"])
    return both.withColumn(out, F.least("_near", "_later")).drop("_c", "_near", "_later")


def _cut_long(rows: DataFrame, url: str, order: str) -> DataFrame:
    """Sample starts of long runs. From a start, the next one is the nearest position whose suffix
    also occurs between the start and it; starts are collected by doubling the jump length."""
    stored = rows.filter("stored").select("_run", "_pos", "suffix")
    again = _nearest_after(stored, ["_run", "suffix"], "_pos", "_again", inclusive=False)
    everyone = rows.select("_run", "_start", "_pos").join(again.select("_run", "_pos", "_again"), ["_run", "_pos"], "left")
    jumps = _nearest_after(everyone, ["_run"], "_again", "_to", inclusive=True)
    jumps = cut_lineage(jumps.filter("_to IS NOT NULL").select(F.col("_pos").alias("_from"), "_to"))
    starts = cut_lineage(rows.select(F.col("_start").alias("_pos")).distinct())
    while True:
        reached = starts.join(jumps, starts["_pos"] == jumps["_from"]).select(F.col("_to").alias("_pos"))
        reached = cut_lineage(reached.join(starts, "_pos", "left_anti").distinct())
        if reached.isEmpty():
            break
        starts = cut_lineage(starts.unionByName(reached))
        further = jumps.select(F.col("_from").alias("_to"), F.col("_to").alias("_next"))
        jumps = cut_lineage(jumps.join(further, "_to").select("_from", F.col("_next").alias("_to")))
    marked = rows.join(starts.withColumn("_is", F.lit(True)), "_pos", "left")
    own = F.when(F.col("_is"), F.col("_pos"))
    chunked = marked.withColumn("_c", F.floor(F.col("_pos") / _CHUNK)).withColumn("_own", own)
    inside = Window.partitionBy("_run", "_c").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_run").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunked.groupBy("_run", "_c").agg(F.max("_own").alias("_v"))
    chunks = chunks.select("_run", "_c", F.max("_v").over(earlier).alias("_earlier"))
    placed = chunked.withColumn("_near", F.max("_own").over(inside)).join(chunks, ["_run", "_c"])
    return placed.select(
        url, order, "key", "suffix", "stored", F.coalesce("_near", "_earlier").alias("sample")
    )


def group_samples(members: DataFrame, value: str, url: str = "url", order: str = "member_no", **how) -> DataFrame:
    """(url, key, sample, parts): one row per sample with suffix -> value. The values are joined
    to the marks only here, so the sort moves names, not contents."""
    marks = mark_samples(members, url, order, **how)
    filled = marks.join(members.select(url, order, F.col(value).alias("_value")), [url, order])
    entry = F.when(F.col("stored"), F.struct(F.col("suffix"), F.col("_value")))
    grouped = filled.groupBy(url, "key", "sample").agg(F.collect_list(entry).alias("_e"))
    return grouped.select(url, "key", "sample", F.map_from_entries("_e").alias("parts"))


def complete_samples(samples: DataFrame, parts: str = "parts") -> DataFrame:
    """Samples with a caption and an image."""
    return samples.filter(has_caption_and_image(parts))


def valid_samples(samples: DataFrame, parts: str = "parts") -> DataFrame:
    """Samples that hold something."""
    return samples.filter(F.col(parts).isNotNull() & (F.size(parts) > 0))


def pick_parts(samples: DataFrame, text_types: Sequence[str] = ("",), parts: str = "parts") -> DataFrame:
    """Image part and one text column per text type."""
    texts = [text_part(parts, t).alias(t or "text") for t in text_types]
    return samples.withColumn("image", image_part(parts)).select("*", *texts)
