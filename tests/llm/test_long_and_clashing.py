"""Very long words, runs and blobs take linear time with unchanged results; names of columns never clash."""

import random
import time

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from speciframe.llm import bpe, neardup, pii, quality, toxicity
from speciframe.llm.common import held_out

CLASHING = ("_measures", "_base_failed", "_kept", "_KEPT2", "_lang", "_source", "_high_symbols", "_low_mean_word", "_cleaned", "cleaned", "_toxicity",
            "_personal", "_id", "_row", "row", "kept", "_labelled", "_one", "component_id", "n_shingles", "f1", "_component", "a.b")


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def test_heap_and_scan_merge_alike(encoder):
    rng, merges = random.Random(2), encoder.merges
    for _ in range(400):
        word = "".join(rng.choice("aetionsrhl") for _ in range(rng.randrange(1, 70)))
        ids = [merges.vocab[c] for c in word[:-1]] + [merges.vocab[word[-1] + merges.suffix]]
        assert merges._merged(list(ids)) == merges._merged_short(list(ids))


@pytest.mark.parametrize("letters", ["a", "aetionsrhl"])
def test_word_of_100_000_letters(encoder, letters):
    rng = random.Random(4)
    word = "".join(rng.choice(letters) for _ in range(100_000))
    start = time.time()
    ids = encoder.merges.encode_word(word.encode())
    assert time.time() - start < 20 and ids == encoder.tokenizer.encode(word, add_special_tokens=False).ids


def quadratic_segments(scores):
    """Of all candidates the latest that starts lower, by looking at each."""
    kept, total = [], 0.0
    for at, score in scores:
        before, total = total, total + score
        if score <= 0:
            continue
        new = [at, at, before, total]
        while kept:
            j = max((j for j in range(len(kept)) if kept[j][2] < new[2]), default=-1)
            if j < 0 or kept[j][3] >= new[3]:
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append(new)
    return [(a, b, high - low) for a, b, low, high in kept]


def test_segments_are_those_of_a_full_search_in_linear_time():
    rng = random.Random(9)
    for _ in range(500):
        scores = [(i, rng.choice([-2, -1, -0.5, 0.5, 1, 2, 3])) for i in range(rng.randrange(40))]
        assert toxicity.maximal_segments(scores) == quadratic_segments(scores)
    start = time.time()
    falling = [(i, -2.0 if i % 2 else 1.0) for i in range(200_000)]
    assert len(toxicity.maximal_segments(falling)) == 100_000 and time.time() - start < 10


@pytest.fixture(scope="module")
def field():
    model, rng = pii.Model(), random.Random(1)
    for _ in range(60):
        text = f"mail x{rng.randrange(99)}@site{rng.randrange(9)}.org, call +1 407 555 {rng.randrange(1000, 9999)} from 10.0.{rng.randrange(256)}.7 or 12 of 34"
        for window, spans in pii._labelled(text):
            model.learn(window, spans, 0.3)
    return model


@pytest.mark.parametrize("text", ["a" * 200_000 + " 1", "7" * 200_000, "ab" * 50_000 + "@", "1 " + "b" * 200_000, "@" * 20_000, "1." * 20_000,
                                  "".join(random.Random(3).choice("0123456789abcdef") for _ in range(60_000))], ids=range(7))
def test_runs_and_blobs_are_searched_in_linear_time(field, text):
    start = time.time()
    base, spans = field.find(text)
    assert time.time() - start < 20 and set(base) <= set(spans)


def test_best_segmentation_against_all_segmentations(field):
    rng = random.Random(6)
    for _ in range(150):
        window = "".join(rng.choice(["1", "22", "@", "x", ".", "-", " ", "+4"]) for _ in range(rng.randrange(1, 8)))
        tokens, ends = pii.candidates(window)

        def best(at, before):
            if at == len(tokens):
                return 0.0, ()
            found = [(lambda r: (field.step_score(before, "") + r[0], r[1]))(best(at + 1, ""))]
            for j in range(at, len(tokens)):
                for first, features in ends[j]:
                    if first == at:
                        for kind in pii.KINDS:
                            rest = best(j + 1, kind)
                            found.append((field.step_score(before, kind) + field.span_score(features, kind) + rest[0],
                                          ((kind, tokens[at][0], tokens[j][1]), *rest[1])))
            return max(found, key=lambda f: f[0])

        value, chosen = best(0, "")
        got = field.decode(window)

        def worth(spans):
            total, before, at = 0.0, "", 0
            starts = {t[0]: i for i, t in enumerate(tokens)}
            stops = {t[1]: i for i, t in enumerate(tokens)}
            by_start = {starts[a]: (k, stops[b]) for k, a, b in spans}
            while at < len(tokens):
                kind, j = by_start.get(at, ("", at))
                total += field.step_score(before, kind)
                if kind:
                    total += field.span_score(next(f for i, f in ends[j] if i == at), kind)
                before, at = kind, j + 1
            return total

        assert abs(worth(got) - value) < 1e-9


def test_stages_leave_columns_of_any_name_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wide = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in CLASHING})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    allowed = lambda doc_id: ~held_out(doc_id)
    for stage in (quality.keep_good, lambda d: toxicity.drop_toxic(d, labels, allowed), neardup.keep_one, pii.redact):
        plain, got = stage(docs), stage(wide)
        assert got.columns == wide.columns
        rows = got.collect()
        assert all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in CLASHING)
        assert sorted(tuple(r[c] for c in docs.columns) for r in rows) == sorted(map(tuple, plain.collect()))


def test_redaction_without_a_length(spark):
    docs = spark.createDataFrame([(1, "write to ann@site.org now"), (2, None), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "write to [email] now", 2: None, 3: ""}


def test_stages_of_the_pipeline_are_documented():
    assert all(stage.__doc__ for _, stage in corpus_pipeline.STAGES)


def test_secrets_are_not_written_in_clear(spark, tmp_path):
    from pathlib import Path

    from speciframe.llm import secret_scan
    from speciframe.session import shared_dir

    value = "Zq81KxPv0LmN72TrWb5Yc3Hd"
    docs = spark.createDataFrame([(1, f"token = {value} end", "s")], "doc_id long, text string, source string")
    root = Path(shared_dir(spark).replace("file:", "", 1))
    before = set(root.rglob("*.parquet"))
    rows = secret_scan.scan(docs).collect()
    assert rows[0]["n_live"] >= 1 and [(s["start"], s["end"]) for s in rows[0]["base"]]
    assert not [f for f in set(root.rglob("*.parquet")) - before if value.encode() in f.read_bytes()]
    assert value not in str(rows)
