"""Scans, shard lists, samples, sinks."""

from __future__ import annotations

import tarfile

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import portions
from ..operators import joins
from ..operators import samples as S
from ..operators.ranking import row_index
from ..operators.sampling import class_index_sorted
from ..plans import training_mix as M
from ..session import scratch_path
from ..sources import shards as H
from ..sources import sinks, tables, tar
from . import text
from .base import ctes, features, members, query, r6, samples, shards, table, taxa

_TAXON_COLUMNS = ("kingdom", "phylum", "cls", "ord", "family", "genus", "species", "subspecies", "common_name")


@query(
    "scan_metadata",
    ctes("taxa") + f" SELECT 'img/' || id || '.jpg' AS filepath, {', '.join(_TAXON_COLUMNS)}, CAST(length(kingdom) AS INT) AS class_idx FROM taxa",
)
def scan_metadata(spark, sf):
    root = scratch_path(spark, "metadata")
    rows = taxa(spark, sf).select(
        F.col("id").alias("index"), F.concat(F.lit("img/"), "id", F.lit(".jpg")).alias("filepath"),
        *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in _TAXON_COLUMNS], F.length("kingdom").alias("class_idx"),
    )
    rows.write.option("header", True).csv(f"{root}/{tables.METADATA_FILE}")
    return tables.scan_metadata(spark, root)


@query("metadata_rows", "SELECT 'c' || c_custkey AS filepath, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer")
def metadata_rows(spark, sf):
    root = scratch_path(spark, "numbered")
    rows = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("index"), F.concat(F.lit("c"), "c_custkey").alias("filepath"), F.col("c_name").alias("name")
    )
    rows.orderBy("index").write.option("header", True).csv(f"{root}/{tables.METADATA_FILE}")
    return tables.scan_metadata(spark, root, numbered=True).select("filepath", "row_id")


@query("scan_captions", "SELECT url AS image, 'page ' || page_id || ' \"' || length(html) || '\"' AS caption FROM pages")
def scan_captions(spark, sf):
    path = scratch_path(spark, "captions")
    caption = F.concat(F.lit("page "), "page_id", F.lit(' "'), F.length("html"), F.lit('"'))
    rows = table(spark, sf, "pages").select("page_id", F.col("url").alias("filepath"), caption.alias("title"), F.lit("x").alias("other"))
    rows.write.option("header", True).option("sep", "\t").option("escape", '"').csv(path)
    return tables.scan_captions(spark, path)


@query("read_dataset", "SELECT CAST(s_suppkey AS VARCHAR) AS image, s_name AS caption FROM supplier")
def read_dataset(spark, sf):
    path = scratch_path(spark, "dataset") + ".tsv"
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("filepath"), F.col("s_name").alias("title"))
    rows.write.option("header", True).option("sep", "\t").csv(path)
    return tables.read_dataset(spark, path)


@query("scan_image_folder", "SELECT s_name || '.jpg' AS file, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') || '_nation' AS class, length(s_name) AS size FROM supplier")
def scan_image_folder(spark, sf):
    root = scratch_path(spark, "images")
    name = F.concat(F.lpad(F.col("s_nationkey").cast("string"), 5, "0"), F.lit("_nation/"), "s_name", F.lit(".jpg"))
    sinks.write_files(table(spark, sf, "supplier").select(name.alias("path"), F.col("s_name").alias("content")), root)
    files = tables.scan_image_folder(spark, root, content=True)
    return files.select(paths.file_name("path").alias("file"), "class", F.length("content").alias("size"))


@query("path_parts", "SELECT page_id, string_split(url, '/')[-1] AS name, string_split(url, '/')[-2] AS folder, 'root/' || string_split(url, '/')[-2] || '/' || string_split(url, '/')[-1] AS path FROM pages")
def path_parts(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", paths.file_name("url").alias("name"), paths.parent_folder("url").alias("folder"))
    return pages.withColumn("path", paths.under_root("root", "folder", "name"))


def _bits(key):
    return F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.pmod(F.floor(F.col(key) / F.pow(F.lit(2), i)), F.lit(2)).cast("int"))


def _write_class_files(spark, sf):
    root = scratch_path(spark, "classes")
    rows = table(spark, sf, "customer").select("c_custkey", "c_name").orderBy("c_custkey")
    rows.select(F.concat_ws("\t", (F.col("c_custkey") + 1).cast("string"), "c_name").alias("value")).write.text(f"{root}/classes")
    bits = F.array_join(F.transform(_bits("c_custkey"), lambda b: b.cast("string")), " ")
    rows.select(bits.alias("value")).write.text(f"{root}/matrix")
    return root


_BITS_SQL = "array_to_string(list_transform(range(0, 10), lambda i: (c_custkey >> i) & 1), ' ')"


@query("scan_predicate_matrix", f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line_no, c_name AS class, {_BITS_SQL} AS attributes FROM customer")
def scan_predicate_matrix(spark, sf):
    root = _write_class_files(spark, sf)
    out = tables.scan_predicate_matrix(spark, f"{root}/classes", f"{root}/matrix")
    return out.select("line_no", "class", F.array_join(F.transform("attributes", lambda b: b.cast("string")), " ").alias("attributes"))


@query("zip_lines", f"SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS line_no, (c_custkey + 1) || chr(9) || c_name AS class_line, {_BITS_SQL} AS bits FROM customer")
def zip_lines(spark, sf):
    root = _write_class_files(spark, sf)
    return joins.zip_lines(tables.scan_lines(spark, f"{root}/classes", "class_line"), tables.scan_lines(spark, f"{root}/matrix", "bits"))


@query(
    "attach_attributes",
    "SELECT s_name, n_name AS class, array_to_string(list_transform(range(0, 5), lambda i: (n_regionkey >> i) & 1), '') AS attributes FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def attach_attributes(spark, sf):
    bits = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.pmod(F.floor(F.col("n_regionkey") / F.pow(F.lit(2), i)), F.lit(2)).cast("int"))
    classes = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("class"), bits.alias("a"))
    joined = table(spark, sf, "supplier").select("s_name", "s_nationkey").join(classes, "s_nationkey")
    return joined.select("s_name", "class", F.array_join(F.transform("a", lambda b: b.cast("string")), "").alias("attributes"))


@query("json_lookup", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def json_lookup(spark, sf):
    path = scratch_path(spark, "lookup")
    table(spark, sf, "conversations").write.json(path)
    rows = tables.json_lookup(spark, path, "conv_id bigint, turn bigint, role string, text string")
    missing = tables.json_lookup(spark, path + "-absent", "conv_id bigint, turn bigint, role string, text string")
    return rows.unionByName(missing).select("conv_id", "turn", "role", F.length("text").alias("n"))


_FEATURE_ROWS = ctes("features") + " SELECT id, target, 'img/' || id || '.jpg' AS path, round(list_sum(features::DOUBLE[]), 6) AS total FROM features"


def _feature_rows(spark, sf):
    return features(spark, sf).withColumn("path", F.concat(F.lit("img/"), "id", F.lit(".jpg")))


def _sum(vec):
    return r6(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda s, x: s + x), "total")


@query("feature_roundtrip", _FEATURE_ROWS)
def feature_roundtrip(spark, sf):
    rows = _feature_rows(spark, sf)
    path = sinks.write_features(rows, scratch_path(spark, "bundle"), class_index_sorted(rows, "target"))
    back, classes = sinks.load_bundle(spark, path)
    return back.join(classes, "target").select("id", "target", "path", _sum("features"))


@query("read_features", _FEATURE_ROWS)
def read_features(spark, sf):
    """The layout of parallel arrays: one row per thousand ids."""
    rows = _feature_rows(spark, sf)
    path = scratch_path(spark, "arrays")
    entry = F.array_sort(F.collect_list(F.struct("id", "features", "target", "path")))
    parts = rows.groupBy(F.floor(F.col("id") / 1000).alias("part")).agg(entry.alias("e"))
    parts.select(
        F.transform("e", lambda e: e["features"]).alias("features"),
        F.transform("e", lambda e: e["target"]).alias("target"),
        F.transform("e", lambda e: e["path"]).alias("samples"),
    ).write.parquet(path)
    back = tables.read_features(spark, path)
    number = F.regexp_extract("path", "([0-9]+)", 1).cast("bigint")
    return back.select(number.alias("id"), "target", "path", _sum("features"))


@query("export_features", _FEATURE_ROWS)
def export_features(spark, sf):
    path = sinks.export_features(_feature_rows(spark, sf), scratch_path(spark, "export"))
    names = spark.read.schema("id bigint, path string").json(f"{path}/paths")
    both = spark.read.parquet(f"{path}/features").join(spark.read.parquet(f"{path}/labels"), "id").join(names, "id")
    return both.select("id", "target", "path", _sum("features"))


@query("metrics_sink", "SELECT user_id, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id, event_type")
def metrics_sink(spark, sf):
    path = scratch_path(spark, "metrics")
    events = table(spark, sf, "events")
    for part in (F.col("event_type") <= "e", F.col("event_type") > "e"):
        summed = events.filter(part).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        sinks.append_metrics(summed, path)
    return sinks.read_metrics(spark, path, "user_id bigint, event_type string, n bigint, total double")


# -- shards ------------------------------------------------------------------------------------

_LIST = """SELECT s_suppkey, 's' || s_suppkey || '-' || chr(123) || lpad(CAST(s_suppkey % 7 AS STRING), 3, '0') || '..' || lpad(CAST(s_suppkey % 7 + 3 + s_nationkey % 4 AS STRING), 3, '0')
 || chr(125) || '.tar::t' || s_suppkey || '-' || chr(123) || CAST(s_suppkey % 9 AS STRING) || '..' || CAST(s_suppkey % 9 + 4 AS STRING) || chr(125) || '.' || chr(123) || 'tar,tgz' || chr(125) AS urls,
 '1.5::' || CAST(s_nationkey AS STRING) AS weights FROM {supplier}"""


@query(
    "expand_shards",
    """SELECT s_suppkey, 0 AS part_no, 's' || s_suppkey || '-' || lpad(CAST(n AS VARCHAR), 3, '0') || '.tar' AS url, 1.5::DOUBLE AS weight
 FROM (SELECT *, unnest(range(s_suppkey % 7, s_suppkey % 7 + 4 + s_nationkey % 4)) AS n FROM supplier)
 UNION ALL SELECT s_suppkey, 1, 't' || s_suppkey || '-' || n || '.' || ext, s_nationkey::DOUBLE
 FROM (SELECT *, unnest(range(s_suppkey % 9, s_suppkey % 9 + 5)) AS n FROM supplier), UNNEST(['tar', 'tgz']) AS x(ext)""",
)
def expand_shards(spark, sf):
    lists = spark.sql(_LIST, supplier=table(spark, sf, "supplier"))
    return H.expand_shards(lists, "urls", "weights").select("s_suppkey", "part_no", "url", "weight")


@query(
    "dataset_size",
    ctes("shards") + """ SELECT 'part' || (shard_no % 4) AS folder, CAST(CASE min(shard_no % 4) WHEN 0 THEN sum(shard_no * 10) WHEN 1 THEN sum(CASE WHEN weight > 1 THEN shard_no * 10 ELSE 0 END)
  WHEN 2 THEN 4321 END AS BIGINT) AS num_samples, count(*) AS num_shards FROM shards GROUP BY 1""",
)
def dataset_size(spark, sf):
    """Four folders: sizes of all shards, nested sizes of some, a length, and nothing beside the shards."""
    root = scratch_path(spark, "sizes")
    listed = shards(spark, sf).withColumn("part", F.col("shard_no") % 4)
    entry = F.struct("url", F.col("shard_no") * 10)
    maps = listed.filter("part = 0 OR (part = 1 AND weight > 1)").groupBy("part").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    nested = F.to_json(F.struct(F.col("m").alias("per_shard")))
    beside = maps.select(F.concat(F.lit("part"), "part", F.lit("/sizes.json")).alias("path"), F.when(F.col("part") == 1, nested).otherwise(F.to_json("m")).alias("content"))
    others = listed.select("part").distinct().filter("part > 1").select(
        F.concat(F.lit("part"), "part", F.when(F.col("part") == 2, "/__len__").otherwise("/readme.txt")).alias("path"), F.lit("4321\n").alias("content"))
    sinks.write_files(beside.unionByName(others), root)
    told = H.probed_sizes(listed.select(F.concat(F.lit(f"{root}/part"), "part", F.lit("/"), "url").alias("url")))
    return told.select(paths.file_name("folder").alias("folder"), "num_samples", "num_shards")


@query("existing_shards", ctes("shards") + " SELECT url, weight FROM shards WHERE shard_no IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
def existing_shards(spark, sf):
    root = scratch_path(spark, "listing")
    listed = shards(spark, sf)
    there = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("shard_no"))
    sinks.write_files(listed.join(there, "shard_no").select(F.col("url").alias("path"), F.col("url").alias("content")), root)
    listing = H.list_files(spark, root, "*.tar").select(paths.file_name("path").alias("path"), "length")
    return H.existing_shards(listed, listing).select("url", "weight")


@query(
    "mirror_diff",
    """SELECT source || '/' || doc_id || '.txt' AS path, n_chars AS length FROM documents d WHERE lang <> 'de' AND NOT EXISTS
 (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 0)""",
)
def mirror_diff(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    named = F.when(F.col("lang") == "de", F.concat(path, F.lit("-epoch_latest"))).otherwise(path)
    local = docs.select(named.alias("path"), F.col("n_chars").alias("length"))
    there = docs.join(table(spark, sf, "labels"), "doc_id").select(path.alias("path"), (F.col("n_chars") + F.col("toxic")).alias("length"))
    return H.mirror_diff(local, there)


@query(
    "verify_checksums",
    "SELECT doc_id::VARCHAR AS path, toxic = 0 AS ok FROM documents JOIN labels USING (doc_id)",
)
def verify_checksums(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"), "doc_id")
    digest = F.substring(F.sha2("content", 256), 1, 16)
    manifest = docs.join(table(spark, sf, "labels"), "doc_id").select("path", F.when(F.col("toxic") == 0, digest).otherwise(F.reverse(digest)).alias("expected"))
    return H.verify_checksums(docs, manifest)


_KEYS = "CASE WHEN regexp_matches(fname, '^[^.]+[.]') THEN split_part(fname, '.', 1) END AS key, lower(substr(fname, strpos(fname, '.') + 1)) AS suffix"
GREEDY = f""", m AS (SELECT url, member_no, text, {_KEYS}, row_number() OVER (PARTITION BY url ORDER BY member_no) AS rn FROM members),
 RECURSIVE_WALK AS (SELECT url, rn, key, suffix, 1 AS sample, [suffix] AS seen FROM m WHERE rn = 1
  UNION ALL SELECT m.url, m.rn, m.key, m.suffix, w.sample + CASE WHEN m.key <> w.key OR list_contains(w.seen, m.suffix) THEN 1 ELSE 0 END,
   CASE WHEN m.key <> w.key OR list_contains(w.seen, m.suffix) THEN [m.suffix] ELSE list_append(w.seen, m.suffix) END
  FROM RECURSIVE_WALK w JOIN m ON m.url = w.url AND m.rn = w.rn + 1)
 SELECT url, sample_no, key, string_agg(suffix || '=' || md5(text), ',' ORDER BY suffix) AS parts
 FROM (SELECT w.url, w.sample - 1 AS sample_no, w.key, w.suffix, m.text FROM RECURSIVE_WALK w JOIN m ON m.url = w.url AND m.rn = w.rn) GROUP BY 1, 2, 3"""
GROUPED = (ctes("members") + GREEDY).replace("WITH ", "WITH RECURSIVE ", 1).replace("RECURSIVE_WALK", "walk")


def _described(parts):
    entries = F.array_sort(F.map_entries(parts))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.md5(e["value"].cast("binary")))), ",")


# There a sample is named by the position of its first member among all members.
POSITIONED = GROUPED.replace("SELECT url, sample_no, key, string_agg", "SELECT url, min(pos) AS sample, key, string_agg").replace(
    "w.suffix, m.text FROM walk", "w.suffix, m.text, m.pos FROM walk"
).replace("GROUP BY 1, 2, 3", "GROUP BY url, sample_no, key").replace(
    "row_number() OVER (PARTITION BY url ORDER BY member_no) AS rn",
    "row_number() OVER (PARTITION BY url ORDER BY member_no) AS rn, row_number() OVER (ORDER BY url, member_no) - 1 AS pos",
)


@query("group_samples", POSITIONED)
def group_samples(spark, sf):
    grouped = S.group_samples(members(spark, sf), "text")
    return grouped.select("url", "sample", "key", _described("parts").alias("parts"))


# A key function of the caller's own: samples are runs with one first letter; two suffixes are kept.
OWN_KEYS = (
    POSITIONED.replace(_KEYS, "substr(fname, 1, 1) AS key, lower(substr(fname, strpos(fname, '.') + 1)) AS suffix")
    .replace("1 AS sample, [suffix] AS seen", "1 AS sample, CASE WHEN suffix IN ('jpg', 'txt') THEN [suffix] ELSE [] END AS seen")
    .replace("THEN [m.suffix] ELSE list_append(w.seen, m.suffix) END", "THEN CASE WHEN m.suffix IN ('jpg', 'txt') THEN [m.suffix] ELSE [] END WHEN m.suffix IN ('jpg', 'txt') THEN list_append(w.seen, m.suffix) ELSE w.seen END")
    .replace("string_agg(suffix || '=' || md5(text), ',' ORDER BY suffix)", "coalesce(string_agg(suffix || '=' || md5(text), ',' ORDER BY suffix) FILTER (WHERE suffix IN ('jpg', 'txt')), '')")
)


@query("group_samples_by_key", OWN_KEYS)
def group_samples_by_key(spark, sf):
    own = lambda fname: (F.substring(fname, 1, 1), S.split_member_name(fname)[1])
    grouped = S.group_samples(members(spark, sf), "text", keys=own, suffixes=["jpg", "txt"])
    return grouped.select("url", "sample", "key", _described("parts").alias("parts"))


def _tar_entries(batches):
    """Each member as its entry in a tar file: header, contents, zeros up to a full block."""
    for batch in batches:
        data = batch.column("content")
        for start, n in portions(pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)):
            some, entries = batch.slice(start, n), []
            for name, content in zip(some.column("fname").to_pylist(), some.column("content").to_pylist()):
                info = tarfile.TarInfo(name)
                info.size = len(content)
                entries.append(info.tobuf() + content + bytes(-len(content) % tarfile.BLOCKSIZE))
            yield pa.RecordBatch.from_arrays([some.column("path"), some.column("member_no"), pa.array(entries, pa.binary())], ["path", "member_no", "content"])


def write_shards(spark, rows, root):
    """Tar files from member rows; a source is cut into shards of at most 2000 consecutive members. Entries are
    made where the rows are, and meet in their file one after the other."""
    shard = F.concat_ws("-", "url", F.lpad(F.floor(F.col("member_no") / 2000).cast("string"), 6, "0"))
    cut = rows.select(F.concat(shard, F.lit(".tar")).alias("path"), F.col("member_no").cast("bigint").alias("member_no"), "fname", F.col("text").cast("binary").alias("content"))
    entries = cut.mapInArrow(_tar_entries, "path string, member_no bigint, content binary")
    sinks.write_files(entries, root, part="member_no", end=bytes(2 * tarfile.BLOCKSIZE))


TAR_SQL = (
    (ctes("members") + GREEDY)
    .replace("WITH ", "WITH RECURSIVE ", 1)
    .replace("RECURSIVE_WALK", "walk")
    .replace("SELECT url, member_no, text, CASE", "SELECT url || '-' || lpad(CAST(CAST(floor(member_no / 2000) AS BIGINT) AS VARCHAR), 6, '0') || '.tar' AS url, member_no, text, CASE")
    .replace("PARTITION BY url ORDER BY member_no", "PARTITION BY url, floor(member_no / 2000) ORDER BY member_no")
)


@query("scan_tar_shards", TAR_SQL)
def scan_tar_shards(spark, sf):
    root = scratch_path(spark, "shards")
    write_shards(spark, members(spark, sf), root)
    found = tar.read_tar_samples(spark, root)
    return found.select(paths.file_name("url").alias("url"), "sample_no", "key", _described("parts").alias("parts"))


@query(
    "rejected_shards",
    ctes("members") + """ SELECT url || '-' || lpad(CAST(CAST(floor(member_no / 2000) AS BIGINT) AS VARCHAR), 6, '0') || '.tar' AS url, CAST(substr(url, 4) AS BIGINT) % 2 = 1 AS rejected
 FROM members GROUP BY 1, url""",
)
def rejected_shards(spark, sf):
    """Every other shard ends within its first member; what is wrong with it comes as a row, and the others are read."""
    root = scratch_path(spark, "shards")
    write_shards(spark, members(spark, sf), root)
    number = F.regexp_extract(paths.file_name("path"), "src([0-9]+)", 1).cast("bigint")
    whole = spark.read.format("binaryFile").option("pathGlobFilter", "*.tar").load(root).select("path", "content")
    damaged = whole.withColumn("content", F.when(number % 2 == 1, F.substring("content", 1, 514)).otherwise(F.col("content")))
    told = tar.tar_samples(damaged, with_rejects=True)
    return told.groupBy(paths.file_name("url").alias("url")).agg(F.bool_or(F.col("error").isNotNull()).alias("rejected"))


@query(
    "scan_tar_members",
    "SELECT source AS shard, doc_id AS member, strlen(text) AS n_bytes FROM documents",
)
def scan_tar_members(spark, sf):
    root = scratch_path(spark, "shards")
    named = members(spark, sf).withColumn("fname", F.concat(F.col("member_no").cast("string"), F.lit(".txt")))
    write_shards(spark, named, root)
    found = tar.tar_members(tar.list_shards(spark, root))
    shard = F.split(paths.file_name("url"), "-")[0]
    return found.select(shard.alias("shard"), F.split("fname", "[.]")[0].cast("bigint").alias("member"), F.length("content").cast("bigint").alias("n_bytes"))


# -- samples -----------------------------------------------------------------------------------


@query("filter_complete_samples", ctes("samples") + " SELECT id FROM samples WHERE txt IS NOT NULL AND (jpg IS NOT NULL OR png IS NOT NULL)")
def filter_complete_samples(spark, sf):
    return S.complete_samples(samples(spark, sf)).select("id")


@query("coalesce_parts", ctes("samples") + " SELECT id, coalesce(jpg, png) AS image, txt AS text FROM samples")
def coalesce_parts(spark, sf):
    return S.pick_parts(samples(spark, sf)).select("id", "image", "text")


@query("skip_bad_samples", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_type <> 'error'")
def skip_bad_samples(spark, sf):
    """Records cut short (those of type error) are dropped, not failed on."""
    cut = F.when(F.col("event_type") == "error", F.expr("substr(props, 1, 3)")).otherwise(F.col("props"))
    parsed = table(spark, sf, "events").select("event_id", F.from_json(cut, "map<string,bigint>", {"mode": "PERMISSIVE"}).alias("parts"))
    return S.valid_samples(parsed).select("event_id", F.col("parts")["k"].alias("k"))


@query("drop_null_traits", ctes("samples") + " SELECT id FROM samples WHERE txt IS NOT NULL AND jpg IS NOT NULL AND png IS NOT NULL")
def drop_null_traits(spark, sf):
    return tables.drop_null_traits(samples(spark, sf).select("id", "txt", "jpg", "png"), ["txt", "jpg", "png"]).select("id")


@query(
    "encode_traits",
    """SELECT p_partkey, (CASE WHEN p_type = 'ECONOMY' THEN '1' ELSE '0' END) || (CASE WHEN p_size > 25 THEN '1' ELSE '0' END)
 || (CASE WHEN p_retailprice > 1000 THEN '1' ELSE '0' END) AS traits FROM part""",
)
def encode_traits(spark, sf):
    feeding = F.when(F.col("p_type") == "ECONOMY", "pelagic").otherwise("benthic")
    packed = paths.encode_traits(feeding, F.col("p_size") > 25, F.col("p_retailprice") > 1000)
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.transform(packed, lambda t: t.cast("string")), "").alias("traits"))


@query(
    "task_catalog",
    """SELECT source AS task, arg_min(lang, doc_id) AS task_cluster, coalesce(nullif(arg_min(CASE WHEN n_chars % 2 = 0 THEN '' ELSE lang END, doc_id), ''), 'none') AS task_subcluster
 FROM documents GROUP BY source""",
)
def task_catalog(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("source").alias("task"), F.col("lang").alias("task_cluster"),
        F.when(F.col("n_chars") % 2 == 0, "").otherwise(F.col("lang")).alias("task_subcluster"), F.col("doc_id").alias("row_idx"),
    )
    return tables.task_catalog(rows)


_NAMES_SQL = "SELECT s_suppkey, 'Run_' || (s_suppkey % 13) || '/epoch_' || s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN '.PT' ELSE '.pt' END AS path FROM supplier"


def _named(spark, sf):
    return spark.sql(_NAMES_SQL.replace("FROM supplier", "FROM {supplier}"), supplier=table(spark, sf, "supplier"))


@query("natural_sort", f"SELECT path, row_number() OVER (ORDER BY s_suppkey % 13, s_suppkey) - 1 AS position FROM ({_NAMES_SQL})")
def natural_sort(spark, sf):
    keyed = _named(spark, sf).select("path", paths.natural_key("path").alias("_k"))
    return row_index(keyed, ["_k", "path"], "position").select("path", "position")


@query("latest_by_natural_key", f"SELECT split_part(path, '/', 1) AS run, arg_max(path, s_suppkey) AS path FROM ({_NAMES_SQL}) GROUP BY 1")
def latest_by_natural_key(spark, sf):
    named = _named(spark, sf).withColumn("run", F.split("path", "/")[0])
    return named.groupBy("run").agg(F.max_by("path", paths.natural_key("path")).alias("path"))


# -- from shards to batches --------------------------------------------------------------------

# Shards hold four members per sample, numbered from the sample's id; tokens come from the shared vocabulary.
SHARD_MIX = (
    ctes("samples").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, listed AS (SELECT id, url, CAST(id AS VARCHAR) AS key, txt, coalesce(jpg, png) AS image, url || '-' || lpad(CAST(id * 4 // 2000 AS VARCHAR), 6, '0') || '.tar' AS shard
   FROM samples WHERE txt IS NOT NULL AND coalesce(jpg, png) IS NOT NULL),
 main AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws(':', '11', shard, key, sample_no)), shard, key, sample_no) - 1) // 32 AS b, count(*) OVER () AS n FROM ok WHERE url > 'src15'),
 rep AS (SELECT *, (row_number() OVER (ORDER BY md5(concat_ws(':', '11', shard, key, sample_no)), shard, key, sample_no) - 1) // 8 AS b, count(*) OVER () AS n FROM ok WHERE url <= 'src15'),
 m AS (SELECT * FROM main WHERE b < n // 32), r AS (SELECT * FROM rep WHERE b < n // 8),
 mixed AS (SELECT m.*, b AS batch_no, 'main' AS segment FROM m
  UNION ALL SELECT r.*, x.b, 'replay' FROM (SELECT DISTINCT b FROM m) x, (SELECT max(b) + 1 AS n FROM r) c, r WHERE r.b = x.b % c.n)
 SELECT shard, key, CAST(batch_no AS BIGINT) AS batch_no, segment, md5(array_to_string(tokens, ' ')) AS tokens, md5(image) AS image, md5(txt) AS caption FROM mixed JOIN framed USING (id)"""
)


def _shard_mix_sql():
    """Sample numbers count the samples of a shard, complete or not; every sample has at least the member of its language."""
    numbered = """ ok AS (SELECT listed.*, s.sample_no FROM listed JOIN (SELECT id, row_number() OVER (PARTITION BY url, id * 4 // 2000 ORDER BY id) - 1 AS sample_no FROM samples) s USING (id)),
 """ + text.framed_sql("listed", "id", "txt", 16) + ","
    return SHARD_MIX.replace(" main AS (", numbered + " main AS (", 1)


@query("training_mix", _shard_mix_sql())
def training_mix(spark, sf):
    """From a folder of shards to batches: listed, read, filtered, tokenised, mixed, contents attached."""
    root = scratch_path(spark, "mix-shards")
    entry = F.posexplode(F.array(*[F.struct(F.lit(s).alias("suffix"), F.col("parts")[s].alias("text")) for s in ("txt", "jpg", "png")],
                                 F.struct(F.concat("lang", F.lit(".meta")).alias("suffix"), F.col("lang").alias("text")))).alias("i", "e")
    rows = samples(spark, sf).select("url", "id", entry).filter("e.text IS NOT NULL").select(
        "url", (F.col("id") * 4 + F.col("i")).alias("member_no"), F.concat(F.col("id").cast("string"), F.lit("."), "e.suffix").alias("fname"), "e.text")
    write_shards(spark, rows, root)
    found = tar.list_shards(spark, root)
    late = paths.file_name("path") > "src15."
    mixed = M.mix_from_shards(spark, found.filter(late), found.filter(~late), text.VOCABULARY, 32, 8, 10, 1, length=16)
    told = F.md5(F.array_join(F.transform("tokens", lambda t: t.cast("string")), " "))
    return mixed.select("shard", "key", "batch_no", "segment", told.alias("tokens"), F.md5("image").alias("image"), F.md5("caption").alias("caption"))


@query(
    "epoch_shards",
    ctes("shards") + """, p AS (SELECT url, row_number() OVER (ORDER BY md5(concat_ws(':', '13', url)), url) - 1 AS position FROM shards)
 SELECT url, position, CAST(position % 4 AS INT) AS node, CAST((position // 4) % 2 AS INT) AS worker FROM p""",
)
def epoch_shards(spark, sf):
    return M.shards_for_epoch(spark, shards(spark, sf).select("url"), 10, 3, nodes=4, workers=2)
