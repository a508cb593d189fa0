"""Hand-written cases."""

import io
import tarfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from speciframe import catalog
from speciframe.functions import naming as N
from speciframe.functions import paths, templates
from speciframe.functions import text as X
from speciframe.functions import tokens as K
from speciframe.functions import vectors as V
from speciframe.operators import aggregates, joins, metrics, ranking, sampling
from speciframe.plans import few_shot, training_mix
from speciframe.sources import shards as H
from speciframe.sources import sinks, tables, tar
from speciframe.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def taxon(**values):
    return N.TaxonColumns(**{k: F.lit(v) for k, v in values.items()})


FULL = dict(kingdom="animalia", phylum="CHORDATA", cls="aves", order="passeriformes", family="corvidae", genus="corvus",
            species="Corax", common_name="Common Raven")


@pytest.mark.parametrize("values,sci,tax", [
    (FULL, "Corvus corax", "Animalia Chordata Aves Passeriformes Corvidae Corvus corax"),
    ({**FULL, "subspecies": "Principalis"}, "Corvus corax principalis",
     "Animalia Chordata Aves Passeriformes Corvidae Corvus corax principalis"),
    ({**FULL, "kingdom": ""}, "Corvus corax", "Corvus corax"),
    ({**FULL, "cls": ""}, "Corvus corax", "Animalia Chordata  Passeriformes Corvidae Corvus corax"),
    ({**FULL, "species": ""}, "Corvus", "Animalia Chordata Aves Passeriformes Corvidae Corvus "),
    ({"kingdom": "plantae"}, None, "Plantae      "),
    ({}, None, " "),
    ({"genus": "x Y", "subspecies": "Z"}, "X y  z", "X y  z"),
])
def test_names(spark, values, sci, tax):
    t = taxon(**values)
    assert one(spark, N.scientific_name(t)) == sci
    assert one(spark, N.taxonomic_name(t)) == tax
    common = values.get("common_name", "")
    suffix = f" with common name {common}" if common else ""
    assert one(spark, N.sci_common_name(t)) == (None if sci is None else sci + suffix)
    assert one(spark, N.taxon_common_name(t)) == tax + suffix


def test_parse_taxon(spark):
    t = one(spark, N.parse_taxon(F.lit("00042_Animalia_Chordata_Aves_Pa_Co_Corvus_corax")))
    assert (t["dataset_id"], t["kingdom"], t["species"], t["subspecies"], t["website_id"]) == (42, "Animalia", "corax", "", -1)
    t = one(spark, N.parse_taxon(F.lit("Animalia_Chordata")))
    assert (t["dataset_id"], t["phylum"], t["genus"]) == (-1, "Chordata", "")


def test_text_type_errors():
    with pytest.raises(ValueError):
        N.class_text("latin", N.TaxonColumns())
    with pytest.raises(ValueError):
        X.cleaner("shout")
    with pytest.raises(ValueError):
        K.reducer("first")


def test_templates(spark):
    assert len(templates.EVALUATION_TEMPLATES) == 81 and len(templates.IMAGE_TEMPLATES) == 80 and len(templates.SIMPLE_TEMPLATES) == 7
    df = spark.createDataFrame([("fox",)], "name string")
    out = templates.expand_prompts(df, "name", ["a {}.", lambda c: F.concat(c, F.lit("!"))]).orderBy("template_id").collect()
    assert [r["prompt"] for r in out] == ["a fox.", "fox!"]


@pytest.mark.parametrize("raw,clean", [
    ("  a &amp;amp; b ", "a & b"), ("&lt;p&gt;", "<p>"), ("cafÃ© crÃ¨me", "café crème"), ("itâ€™s", "it's"), ("\u201cﬁne\u201d\r\nｏｋ\x00", '"fine"\nok'), ("e\u0301", "é"), ("\x1b[1;31mred\x1b[0m", "red"),
    ("plain Ã text", "plain Ã text"), ("naïve", "naïve"), (None, None),
    (" \t two\n lines \n", "two\n lines"), ("\x0b\x1c a\x85\xa0", "a"), ("", ""), (" a &amp b ", "a & b"),
])
def test_basic_clean(spark, raw, clean):
    assert one(spark, X.basic_clean(F.lit(raw).cast("string"))) == clean


def test_cleaning(spark):
    assert one(spark, X.whitespace_clean(F.lit(" a  b\x1cc\n"))) == "a b c"
    assert one(spark, X.canonicalize_text(F.lit("Hello, {World}_{} {}!"))) == "hello world"
    assert one(spark, X.canonicalize_text(F.lit("Hello, {World}_{} {}!"), keep="{}")) == "hello world {} {}"
    assert one(spark, X.pretokenize(F.lit("it's 42 été!!"))) == ["it", "'s", "4", "2", "été", "!!"]
    assert one(spark, X.pretokenize(F.lit("<start_of_text>Don'T"))) == ["<start_of_text>", "Don", "'T"]


def test_subwords(spark):
    v = K.Vocabulary([("a", "b"), ("ab", "c</w>"), ("a", "a")])
    encode = v.encoder()
    decode = lambda ids: one(spark, K.decode_tokens(F.array(*map(F.lit, ids)).cast("array<int>"), v))
    name = lambda word: [v.entries[i] for i in encode(word)]
    assert name("abc") == ["abc</w>"]
    assert name("aaaab") == ["aa", "aa", "b</w>"]
    assert name("é") == ["Ã", "©</w>"]
    assert name("x") == ["x</w>"]
    assert encode("<start_of_text>") == [v.start_id]
    assert decode(encode("abc") + encode("é")) == "abc é "
    assert decode([]) == "" and one(spark, K.decode_tokens(F.lit(None).cast("array<int>"), v)) is None
    symbols = K.byte_symbols()
    for raw in (b"\xc3", b"a\xe2\x82b", b"\xf0\x9f\x98", b"\xffz\x80", b"\xe2\x82\xac \xed\xa0\x80", b"\xc0\xaf"):
        assert decode([v.ids[symbols[b]] for b in raw]) == raw.decode("utf-8", errors="replace"), raw
    assert len(v.entries) == 512 + 3 + 2 and v.end_id == 516
    df = spark.createDataFrame([(["abc", "x"],), (None,), ([],)], "w array<string>")
    got = [r["t"] for r in df.select(K.encode_words("w", v).alias("t")).collect()]
    assert got == [encode("abc") + encode("x"), None, []]


def test_framing(spark):
    ids = lambda n: F.array(*[F.lit(i + 1) for i in range(n)])
    assert one(spark, K.frame_tokens(ids(2), 90, 91, 6)) == [90, 1, 2, 91, 0, 0]
    assert one(spark, K.frame_tokens(ids(4), 90, 91, 6)) == [90, 1, 2, 3, 4, 91]
    assert one(spark, K.frame_tokens(ids(9), 90, 91, 6)) == [90, 1, 2, 3, 4, 91]
    assert one(spark, K.frame_tokens(F.array().cast("array<int>"), 90, 91, 4)) == [90, 91, 0, 0]
    assert one(spark, K.frame_with_class_token(ids(2), 90, 91, 99, 7, 7)) == [90, 1, 2, 91, 7, 7, 99]
    assert one(spark, K.frame_with_class_token(ids(9), 90, 91, 99, 7, 7)) == [90, 1, 2, 3, 4, 91, 99]
    assert one(spark, K.blank_separator(ids(3), 2)) == [1, 0, 3]


def test_reductions(spark):
    words = F.array(*[F.lit(w) for w in "abcdefghij"])
    kept = one(spark, K.reduce_random(words, F.lit(1), 5, 4))
    mixed = one(spark, K.reduce_random(words, F.lit(1), 5, 4, shuffle=True))
    assert kept == sorted(kept) and sorted(mixed) == kept and len(kept) == 4
    block = one(spark, K.reduce_block(words, F.lit(1), 5, 4))
    assert "".join(block) in "abcdefghij" and len(block) == 4
    for mode in ("simple", "random", "shuffle"):
        assert one(spark, K.reducer(mode)(words, F.lit(1), 5, 10)) == list("abcdefghij")


def test_priority(spark):
    df = spark.createDataFrame([(1, "the quick fox may run away".split()), (2, [])], "id int, w array<string>")
    lexicon = spark.createDataFrame([("quick", "JJ"), ("fox", "NNP"), ("run", "VBZ"), ("may", "MD")], "word string, tag string")
    got = {r["id"]: r["reduced"] for r in K.reduce_priority(df, lexicon, "id", "w", 4).collect()}
    assert got == {1: ["the", "quick", "fox", "run"], 2: []}


def test_vectors(spark):
    v = F.array(F.lit(3.0), F.lit(4.0))
    zero = F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, V.l2_normalize(v)) == [0.6, 0.8]
    assert one(spark, V.l2_normalize(zero)) == [0.0, 0.0]
    assert all(x != x for x in one(spark, V.l2_normalize(zero, clamp=False)))
    assert one(spark, V.euclidean_distance(v, zero)) == 5.0
    assert one(spark, V.threshold_labels(F.array(F.lit(0.4), F.lit(0.6)))) == [0, 1]


def test_natural_key_of_long_numbers(spark):
    names = ["9" * 40, "1" + "0" * 39 + "1", "1" + "0" * 39 + "2", "0" * 50 + "7"]
    got = [r["n"] for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(paths.natural_key("n")).collect()]
    assert got == [names[3], names[0], names[1], names[2]]


def test_image_extensions_in_any_case(spark, tmp_path):
    (tmp_path / "c").mkdir()
    for name in ("a.TIF", "b.Jpg", "c.BMP", "d.txt"):
        (tmp_path / "c" / name).write_bytes(b"x")
    assert tables.scan_image_folder(spark, str(tmp_path)).count() == 3


def test_natural_key(spark):
    names = ["epoch_10.pt", "epoch_9.pt", "Epoch_010b.pt", "epoch_1.pt", "2x"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(paths.natural_key("n"), "n")
    assert [r["n"] for r in df.collect()] == ["2x", "epoch_1.pt", "epoch_9.pt", "epoch_10.pt", "Epoch_010b.pt"]


def test_traits(spark):
    assert one(spark, paths.encode_traits(F.lit("pelagic"), F.lit(True), F.lit(0))) == [1, 1, 0]
    with pytest.raises(PySparkException):
        one(spark, paths.encode_traits(F.lit("demersal"), F.lit(1)))


def test_expand_shards(spark):
    df = spark.createDataFrame([("a-{08..11}.tar::b-{1..3}{x,y}.tar::c.tar", "1::0.5::2")], "u string, w string")
    got = [(r["part_no"], r["url"], r["weight"]) for r in H.expand_shards(df, "u", "w").collect()]
    assert sorted(got) == [
        (0, "a-08.tar", 1.0), (0, "a-09.tar", 1.0), (0, "a-10.tar", 1.0), (0, "a-11.tar", 1.0),
        (1, "b-1x.tar", 0.5), (1, "b-1y.tar", 0.5), (1, "b-2x.tar", 0.5), (1, "b-2y.tar", 0.5), (1, "b-3x.tar", 0.5), (1, "b-3y.tar", 0.5),
        (2, "c.tar", 2.0),
    ]
    more = spark.createDataFrame([("{a..c}{0..10..5}.tar",), ("{a,b}{a,b}{a,b}{a,b}{a,b}{a,b}",), ("x{3..1}-{e..a..2}",)], "u string")
    found = [r["url"] for r in H.expand_shards(more, "u").collect()]
    assert len(found) == 9 + 64 + 9 and {"c10.tar", "a0.tar", "bababa", "x1-c"} <= set(found)
    with pytest.raises(PySparkException):
        H.expand_shards(spark.createDataFrame([("a::b", "1")], "u string, w string"), "u", "w").collect()


def test_sizes_beside_the_shards(spark, tmp_path):
    files = {"a/sizes.json": '{"x.tar": 3, "y.tar": 4, "z.tar": 9}', "b/sizes.json": '{"per_shard": {"x.tar": 5}}', "b/__len__": "77",
             "c/__len__": " 1234\n", "d/readme": "-"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    shards = spark.createDataFrame([(f"{tmp_path}/{u}",) for u in ("a/x.tar", "a/y.tar", "b/x.tar", "b/y.tar", "c/x.tar", "d/x.tar")], "url string")
    told = {r["folder"].rsplit("/", 1)[1]: (r["num_samples"], r["num_shards"]) for r in H.probed_sizes(shards).collect()}
    assert told == {"a": (7, 2), "b": (5, 2), "c": (1234, 1), "d": (None, 1)}
    assert tuple(H.probed_size(shards).first()) == (None, 6)
    assert tuple(H.probed_size(shards.filter("url NOT LIKE '%/d/%'")).first()) == (1246, 5)
    assert tuple(H.probed_size(shards.limit(0)).first()) == (None, 0)
    local = shards.select(F.concat(F.lit("file:"), "url").alias("url"))
    assert tuple(H.probed_size(local.filter("url LIKE '%/a/%'")).first()) == (7, 2)


def test_dataset_size(spark):
    shards = spark.createDataFrame([("/d/a.tar",), ("/d/b.tar",)], "url string")
    for text in ('{"a.tar": 3, "b.tar": 4, "z.tar": 9}', '{"per_shard": {"a.tar": 3, "b.tar": 4}}'):
        sizes = H.parse_sizes(spark.createDataFrame([(text,)], "value string"))
        assert tuple(H.dataset_size(shards, sizes).first()) == (7, 2)
    assert tuple(H.dataset_size(shards, total=50).first()) == (50, 2)
    assert tuple(H.dataset_size(shards).first()) == (None, 2)


def write_tar(path, members, cut=None):
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as out:
        for name, data in members:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            out.addfile(info, io.BytesIO(data))
    path.write_bytes(buffer.getvalue()[:cut])


def test_tar_samples(spark, tmp_path):
    write_tar(tmp_path / "a.tar", [("x/1.jpg", b"1"), ("x/1.sci.txt", b"s"), ("x/2.JPG", b"2"), ("x/2.jpg", b"again"), ("__meta__.json", b"{}"), ("plain", b"")])
    write_tar(tmp_path / "b.tar", [("1.txt", b"t" * 600), ("2.txt", b"u" * 5000)], cut=3000)
    (tmp_path / "c.tar").write_bytes(b"not a tar file")
    got = sorted((r["url"][-5:], r["sample_no"], r["key"], {k: bytes(v) for k, v in r["parts"].items()}) for r in tar.read_tar_samples(spark, str(tmp_path)).collect())
    assert got[:3] == [
        ("a.tar", 0, "x/1", {"jpg": b"1", "sci.txt": b"s"}), ("a.tar", 1, "x/2", {"jpg": b"2"}), ("a.tar", 2, "x/2", {"jpg": b"again"}),
    ]
    assert all(u != "c.tar" for u, *_ in got)
    rejects = tar.read_tar_samples(spark, str(tmp_path), with_rejects=True).filter("error IS NOT NULL").collect()
    assert sorted(r["url"][-5:] for r in rejects) == ["b.tar", "c.tar"]
    with pytest.raises(PySparkException):
        tar.read_tar_samples(spark, str(tmp_path), on_error="fail").collect()
    chosen = tar.read_tar_samples(spark, str(tmp_path / "a.tar"), suffixes=["sci.txt"], keys=lambda n: tuple(n.rsplit("/", 1)) if "/" in n else (None, None))
    assert [r["key"] for r in chosen.collect()] == ["x"]


def test_metadata(spark, tmp_path):
    (tmp_path / "metadata.csv").write_text(',filepath,genus,class_idx\n0,a.jpg,Corvus,3\n1,b.jpg,,1\n2,"c,d.jpg","x ""y""",1\n')
    rows = tables.scan_metadata(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("a.jpg", "Corvus", 3), ("b.jpg", "", 1), ("c,d.jpg", 'x "y"', 1)]
    (tmp_path / "other.csv").write_text("i,name\n0,a\n")
    with pytest.raises(ValueError):
        tables.scan_metadata(spark, str(tmp_path), "other.csv")


def test_dataset_kinds(spark, tmp_path):
    (tmp_path / "t.csv").write_text("filepath,title\na,b\n")
    assert tuple(tables.read_dataset(spark, str(tmp_path / "t.csv")).first()) == ("a", "b")
    assert tables.read_dataset(spark, "", "synthetic", n=3, caption="c").count() == 3
    with pytest.raises(ValueError):
        tables.read_dataset(spark, "file.parquet")


def test_feature_check(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(ValueError):
        tables.read_features(spark, str(tmp_path / "bad"))


def test_json_lookups(spark, tmp_path):
    (tmp_path / "names.json").write_text('{"corvus corax": "Common Raven"}')
    assert tuple(tables.json_map_lookup(spark, str(tmp_path / "names.json")).first()) == ("corvus corax", "Common Raven")
    assert tables.json_lookup(spark, str(tmp_path / "none.json"), "a int").count() == 0


def test_retry():
    calls, waits = [], []

    def action():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("busy")

    assert sinks.retried(action, 5, 0.5, waits.append) == 3 and waits == [0.5, 1.0]
    with pytest.raises(ZeroDivisionError):
        sinks.retried(lambda: 1 / 0, 2, 0.0, waits.append)


def test_guards(spark):
    df = spark.createDataFrame([(i, 0 if i < 9 else 1) for i in range(12)], "id int, c int")
    flags = {r["c"]: (r["too_few"], r["scarce"]) for r in sampling.kshot_guard(df, "c", 5).collect()}
    assert flags == {0: (False, True), 1: (True, False)}
    with pytest.raises(PySparkException):
        sampling.kshot_guard(df, "c", 5, strict=True).collect()
    with pytest.raises(PySparkException):
        sampling.balanced_validation(df, 4, 0, "c", "id").collect()
    feats = df.select("id", F.array(F.lit(1.0), F.col("id").cast("double")).alias("features"), F.col("c").alias("target"))
    with pytest.raises(ValueError):
        few_shot.few_shot_accuracy(feats, ks=[5], folds=1)


def test_shares_and_batches(spark):
    df = spark.range(10)
    padded = ranking.pad_shares(df, ["id"], 4).collect()
    assert len(padded) == 12 and {r["share"] for r in padded} == {0, 1, 2, 3}
    assert len(ranking.pad_shares(spark.range(2), ["id"], 5).collect()) == 5
    assert ranking.assign_batches(df, 4, order=["id"], drop_last=True).count() == 8
    assert ranking.epoch_shuffle(df, 1, 0, ["id"]).orderBy("position").collect() != ranking.epoch_shuffle(df, 1, 1, ["id"]).orderBy("position").collect()


def test_replay_restarts(spark):
    main = spark.range(5).select("id", F.col("id").alias("batch_no"))
    replay = spark.range(100, 102).select("id", (F.col("id") - 100).alias("batch_no"))
    got = sorted((r["batch_no"], r["id"]) for r in joins.replay_pairing(main, replay).filter("segment = 'replay'").collect())
    assert got == [(0, 100), (1, 101), (2, 100), (3, 101), (4, 100)]
    few = joins.replay_pairing(main.filter("id < 1"), replay).filter("segment = 'replay'").collect()
    assert [r["id"] for r in few] == [100]


def test_f1_and_votes(spark):
    df = spark.createDataFrame([([1, 0, 0], [1, 0, 0]), ([1, 1, 0], [0, 1, 0])], "p array<int>, t array<int>")
    assert abs(metrics.macro_f1(df, "p", "t").first()["macro_f1"] - (2 / 3 + 1 + 0) / 3) < 1e-12
    assert abs(metrics.macro_f1(df, "p", "t", [0, 1]).first()["macro_f1"] - (2 / 3 + 1) / 2) < 1e-12
    assert metrics.accuracy_ks(2) == [1, 2] and metrics.accuracy_ks(100) == [1, 3, 5]


def test_stream_resume_reads_only_new_files(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.range(5).write.parquet(source)
    schema = spark.read.parquet(source).schema
    stream = lambda: streams.stream_table(spark, source, schema)
    streams.run_available(stream(), out, mark)
    spark.range(5, 8).write.mode("append").parquet(source)
    streams.run_available(stream(), out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == list(range(8))


@pytest.mark.parametrize("limit", [1, 1 << 20])
def test_stream_scores_at_any_size(spark, tmp_path, limit):
    protos = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label bigint, w array<double>")
    rows = spark.createDataFrame([(5, [0.1, 0.9]), (6, None)], "id bigint, v array<double>")
    rows.write.parquet(str(tmp_path / "in"))
    stream = streams.stream_table(spark, str(tmp_path / "in"), rows.schema)
    how = dict(vec="v", proto_vec="w", label="label", keep=["id"], ship_limit=limit)
    streams.stream_scores(stream, protos, str(tmp_path / "out"), str(tmp_path / "mark"), **how)
    found = {r["id"]: [h["label"] for h in r["hits"]] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert found == {5: [1], 6: []}


def test_streams_read_tables_of_several_files(spark, tmp_path):
    vectors = [(i, [1.0 if j == i % 3 else 0.0 for j in range(3)], i % 3) for i in range(30)]
    vectors = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int")
    vectors.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    lines = spark.createDataFrame([(i, 0, "user", "x" * i) for i in range(20)], "conv_id bigint, turn bigint, role string, text string")
    lines.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    found = catalog.load()[0]["stream_scores"](spark, str(tmp_path)).collect()
    assert sorted((r["id"], r["pred"]) for r in found) == [(i, i % 3) for i in range(30)]
    found = catalog.load()[0]["stream_results"](spark, f"{tmp_path}/").collect()
    assert sorted((r["conv_id"], r["n"]) for r in found) == [(i, i) for i in range(20)]


def test_portions_are_bounded_and_whole():
    import numpy as np

    sizes = np.array([3, 0, 4, 20, 1, 9, 0])
    cut = list(X.portions(sizes, 10))
    assert cut == [(0, 3), (3, 1), (4, 3)] and list(X.portions(sizes[:0])) == []


def test_encoding_memory_follows_the_portion():
    # ids are put together a step at a time: less than the three index arrays of 8 bytes a token of one go
    import tracemalloc

    import pyarrow as pa

    words = pa.array([["abcdefgh"] * 400_000, None, [], ["xy"]])
    tracemalloc.start()
    out = K._coded(words, K.Vocabulary().encoder())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(x) if x is not None else None for x in out.to_pylist()] == [3_200_000, None, 0, 2]
    assert peak < 12 * 3_200_000


def test_texts_beyond_a_portion(spark):
    v = K.Vocabulary([("t", "h")])
    rows = [(0, "thé &amp; " * 200_000), (1, None), (2, ""), (3, "th"), (4, "é&lt;")]
    df = spark.createDataFrame(rows, "id int, t string").coalesce(1)
    found = {r["id"]: r["text"] for r in df.select("id", K.decode_tokens(K.encode_text("t", v), v).alias("text")).collect()}
    assert found == {0: "thé & " * 200_000, 1: None, 2: "", 3: "th ", 4: "é < "}


def test_pieces_of_files_meet_in_order(spark, tmp_path):
    rows = [("a/x", 2, "c"), ("b", 0, "z"), ("a/x", 0, "a"), ("a/x", 1, "b"), ("a/x", None, "d")]
    pieces = spark.createDataFrame(rows, "path string, no int, content string").repartition(4)
    assert sinks.write_files(pieces, f"file:{tmp_path}", part="no", end=b"!") == 2
    assert (tmp_path / "a" / "x").read_bytes() == b"abcd!" and (tmp_path / "b").read_bytes() == b"z!"


def test_shards_hold_their_members_in_order(spark, tmp_path):
    from speciframe.catalog.sources import write_shards

    rows = [("s", i, f"{'n' * (i % 130)}{i}.txt", "é" * (i % 700)) for i in range(3000)]
    write_shards(spark, spark.createDataFrame(rows, "url string, member_no bigint, fname string, text string").repartition(5), f"file:{tmp_path}")
    found = []
    for name in ("s-000000.tar", "s-000001.tar"):
        with tarfile.open(tmp_path / name) as shard:
            found += [(m.name, shard.extractfile(m).read().decode()) for m in shard]
    assert found == [(f, t) for _, _, f, t in rows]


def test_retried_batch_replaces_itself(spark, tmp_path):
    write = sinks.idempotent_parquet(str(tmp_path / "out"))
    write(spark.range(3), 0)
    write(spark.range(3), 0)
    write(spark.range(2), 1)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_distances_far_from_the_origin():
    import numpy as np

    from speciframe.operators import dense

    w = np.array([[1e8, 0.0], [1e8 + 0.3, 0.0]])
    assert dense.closeness(w[1:], w, "l2").argmax() == 1
    assert np.array_equal(dense.own_closeness(w, w[::-1], "l2"), np.diag(dense.closeness(w, w[::-1], "l2")))


def test_one_random_text_type_per_batch(spark):
    types = training_mix.TEXT_TYPES
    words = dict(zip(types, ("one", "two", "three", "four", "five")))
    parts = {"jpg": bytearray(b"x"), **{f"{t}.txt": bytearray(w.encode()) for t, w in words.items()}}
    lacking = {k: v for k, v in parts.items() if k != "taxon.txt"}
    rows = [("a", str(i), i, parts) for i in range(40)] + [("a", "40", 40, lacking), ("a", "41", 41, None)]
    samples = spark.createDataFrame(rows, "url string, key string, sample bigint, parts map<string,binary>")
    vocabulary = K.Vocabulary()
    drawn = set()
    for epoch in (0, 1):
        mixed = training_mix.training_mix(samples, None, vocabulary, 4, 4, 3, epoch, text_type="random", length=12)
        body = F.filter("tokens", lambda t: ~t.isin(0, vocabulary.start_id, vocabulary.end_id))
        found = mixed.select("key", "batch_no", K.decode_tokens(body, vocabulary).alias("text")).collect()
        assert sorted(int(r["key"]) for r in found) == list(range(40))
        by_batch = {}
        for r in found:
            by_batch.setdefault(r["batch_no"], set()).add(r["text"].strip())
        assert len(by_batch) == 10 and all(len(texts) == 1 for texts in by_batch.values())
        drawn.add(tuple(min(by_batch[b]) for b in sorted(by_batch)))
    assert len(drawn) == 2 and all(len(set(d)) > 1 for d in drawn)


def test_kshot_split_joins_once(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)] + [(30, 7)], "id int, c int")
    rows = sampling.kshot_split(df, [1, 4], [0, 1], "c", "id").collect()
    assert len(rows) == 31 * 4
    for c, size in ((0, 10), (1, 10), (2, 10), (7, 1)):
        for k in (1, 4):
            for fold in (0, 1):
                roles = [r["role"] for r in rows if (r["c"], r["k"], r["fold"]) == (c, k, fold)]
                assert roles.count("train") == min(k, size) and len(roles) == size
    train = {(r["k"], r["fold"], r["id"]) for r in rows if r["role"] == "train"}
    assert all((4, fold, i) in train for k, fold, i in train if k == 1)


def test_vector_means(spark):
    rows = [("a", 1, [1.0, 2.0]), ("a", 1, [3.0, 4.0]), ("a", 2, [5.0, 6.0]), ("b", 1, None), ("b", 2, [7.0, 8.0])]
    df = spark.createDataFrame(rows * 3, "g string, h int, v array<double>").repartition(4)
    got = {(r["g"], r["h"]): (r["n"], r["mean"]) for r in aggregates.vector_mean(df, "v", ["g", "h"]).collect()}
    assert got == {("a", 1): (6, [2.0, 3.0]), ("a", 2): (3, [5.0, 6.0]), ("b", 2): (3, [7.0, 8.0])}
    assert [tuple(r) for r in aggregates.vector_mean(df, "v").collect()] == [(12, [4.0, 5.0])]
    assert aggregates.vector_mean(df.limit(0), "v").collect() == []
    assert aggregates.vector_mean(df.limit(0), "v", ["g"]).collect() == []


def test_mix_from_shards_draws_shards_and_attaches_contents(spark, tmp_path):
    for shard in "ab":
        with tarfile.open(tmp_path / f"{shard}.tar", "w") as out:
            for i in range(6):
                for suffix, data in (("txt", f"text {shard}{i}"), ("jpg", f"image {shard}{i}"), ("PNG", "other")):
                    info = tarfile.TarInfo(f"k{i}.{suffix}")
                    info.size = len(data)
                    out.addfile(info, io.BytesIO(data.encode()))
    shards = tar.list_shards(spark, str(tmp_path))
    rows = training_mix.mix_from_shards(spark, shards, None, K.Vocabulary(), 4, 1, 3, 0, length=12, resample=3).collect()
    assert len(rows) == 16 and len({(r["url"], r["key"], r["draw"]) for r in rows}) == 16
    assert {r["batch_no"] for r in rows} == set(range(4)) and {r["draw"] for r in rows} <= {0, 1, 2}
    for r in rows:
        name = f"{r['shard'][0]}{r['key'][1]}"
        assert (bytes(r["image"]), bytes(r["caption"]), len(r["tokens"])) == (f"image {name}".encode(), f"text {name}".encode(), 12)
    once = training_mix.mix_from_shards(spark, shards, shards, K.Vocabulary(), 5, 3, 3, 0, length=12).collect()
    assert sorted(r["segment"] for r in once) == ["main"] * 10 + ["replay"] * 6


def test_hollow_parts_are_there_but_empty(spark, tmp_path):
    with tarfile.open(tmp_path / "x.tar", "w") as out:
        for suffix in ("txt", "JPG"):
            info = tarfile.TarInfo(f"k.{suffix}")
            info.size = 5
            out.addfile(info, io.BytesIO(b"12345"))
    row = tar.tar_samples(tar.list_shards(spark, str(tmp_path)), hollow=["jpg"]).first()
    assert {k: bytes(v) for k, v in row["parts"].items()} == {"txt": b"12345", "jpg": b""}
