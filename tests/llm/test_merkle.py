"""The Merkle manifest against a plain tree, and its odd cases."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from speciframe.llm import catalog, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, row string, grp string, path string, leaf string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def ways(nodes):
    """Root of ``nodes`` and each one's siblings, level by level."""
    paths, spots = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for path, spot in zip(paths, spots):
            run = spot // 3 * 3
            path.append(("".join(nodes[run:spot]), "".join(nodes[spot + 1 : run + 3])))
        spots = [s // 3 for s in spots]
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for doc, text, lang, source, n_chars, *_ in rows:
        groups.setdefault(source, []).append((doc, leaf(doc, source, lang, n_chars, text), text, lang, n_chars))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[name] = ways([r[1] for r in groups[name]])
    root, upper = ways([trees[n][0] for n in names])
    out = []
    for name, above in zip(names, upper):
        subroot, paths = trees[name]
        for (doc, own, text, lang, n_chars), path in zip(groups[name], paths):
            changed = text
            if doc is not None and zlib.crc32(str(doc).encode()) % 2 == 0 and text is not None:
                changed = text.replace("\n", "")
            folded = leaf(doc, name, lang, n_chars, changed)
            for left, right in path + above:
                folded = digest(left, folded, right)
            out.append((doc, own, subroot, root, digest(*[x for s in path + above for x in s]), folded, folded == root))
    return sorted(out, key=repr)


def answer(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    df = catalog.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


def row(doc, text, source, lang="en"):
    return (doc, text, lang, source, None if text is None else len(text), "e", "r", "g", "p", "l")


def test_sources_of_every_size_against_a_plain_tree(spark, tmp_path):
    # one source beyond a block of 243, one beyond two rounds' first run, exact powers, one leaf, null, '' and bytewise order
    sizes = {"hot": 800, "full": 243, "more": 244, "nine": 9, "ten": 10, "a": 1, None: 4, "": 2, "é": 3, "z": 2, "Z": 1, "=": 1}
    rows, doc = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            doc += 7
            rows.append(row(doc * 31 % 9973, f"line {doc}\nnext é\n" if doc % 3 else f"one {doc}", source))
    got = answer(spark, rows, tmp_path)
    assert got == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_odd_rows(spark, tmp_path):
    rows = [row(1, "", "s"), row(2, None, "s"), row(3, "\n", "s"), row(3, "\n", "s"), row(3, "a", "s"), row(None, "no id\n", "s"),
            row(None, None, None, None), row(-4, "x\n" * 100_000, "s"), row(5, "漢字\n🙂", "t", None)]
    assert answer(spark, rows, tmp_path) == brute(rows)


def test_single_document_is_its_own_root(spark, tmp_path):
    rows = [row(6, "a\nb", "s")]
    got = answer(spark, rows, tmp_path)
    assert got == brute(rows) and got[0][1] == got[0][3] and got[0][4] == digest("")


def test_empty_table(spark, tmp_path):
    assert answer(spark, [], tmp_path) == []


def test_path_folds_to_the_root_and_any_change_shows(spark):
    docs = spark.range(600).select(F.col("id").alias("k"), F.concat(F.lit("v"), "id").alias("v"), F.lit("g").alias("grp"))
    made = merkle.manifest(docs, F.col("grp"), F.col("k"), merkle.leaf(F.col("k"), F.col("v")), F.struct("k", "v"))
    checked = made.select(
        (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"),
        (merkle.fold(merkle.leaf(F.col("row.k"), F.lit("w")), F.col("path")) == F.col("root")).alias("forged")).distinct().collect()
    assert [tuple(r) for r in checked] == [(True, False)]


def test_every_row_is_folded_from_its_leaf(spark, tmp_path, monkeypatch):
    # a fold that always ends elsewhere must show on all rows, not only on those whose text was changed
    monkeypatch.setattr(merkle, "fold", lambda digest, path: F.sha2(digest.cast("binary"), 256))
    rows = [row(k, f"line {k}\n" if k % 4 else f"line {k}", "s") for k in range(30)]
    assert not any(r[-1] for r in answer(spark, rows, tmp_path))


@pytest.mark.parametrize("values", [(None, ""), ("", None), ("1:a", "b"), ("1", ":ab")])
def test_fields_are_told_apart(spark, values):
    one = spark.range(1).select(merkle.leaf(*[F.lit(v).cast("string") for v in values])).first()[0]
    assert one == leaf(*values)
