"""The text operators against brute-force versions, and their defined odd cases."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from speciframe.llm import (
    bpe, catalog, fingerprints, language_model, licenses, neardup, packing, pii, quality, secret_scan, toxicity,
)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string"
LONG = " ".join(f"word{i % 977} tok{i % 31}" for i in range(15_000))
ODD = [
    "", None, " \t\n", "one", "two words", "a b c d e f g h i j", "a b c d e f g h i j", "x " * 400, LONG,
    "mail bob.1@site.example.org or +1 (407) 555-7710 from 10.0.0.255, card 4929 3483 8514 6306",
    'token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" and AKIA' + "Q" * 16, "Released under the MIT License.\nplain text follows here",
    "é ñ 漢字 🙂 \x1c\x85 <|endoftext|> tail", "secret: token: abcdefgh", "1.2.3.4.5.6.7.8 999.1.1.1 " + "7" * 300, "#" * 50,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, len(t or ""), "e") for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id here at all", None, None, 0, None)]  # a repeated row, and nulls everywhere else
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


def next_of(ids):
    order = sorted(ids, reverse=True)
    return dict(zip(order, [*order[1:], order[0]]))


def test_order_minhash(spark, sf):
    known = texts(sf)
    after = next_of(known)
    rows, prints = by_id(catalog.QUERIES["op1_order_minhash"](spark, sf)), {}
    assert rows.keys() == known.keys()
    for doc, r in rows.items():
        half = len(known[doc]) // 2
        changed = known[doc][: len(known[doc]) - half] + known[after[doc]][:half]
        assert r["n_chars"] == len(known[doc]) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert prints.setdefault(known[doc], r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(changed, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_edited"] == 1.0) == (r["fingerprint"] == r["edited_fingerprint"])


def test_order_minhash_selects_least_numbered_kmers_in_text_order(spark):
    text = "a b c d e a b c d e a b c d e f g h"
    df = spark.createDataFrame([(text,)], "t string")
    hashes = df.select(fingerprints.kmers(F.col("t"))).first()[0]
    numbered = df.select(fingerprints.numbered(fingerprints.kmers(F.col("t"))).alias("n")).first()["n"]
    count, want = Counter(), []
    for p, v in enumerate(hashes):
        r = v if not count[v] else spark.range(1).select(F.xxhash64(F.lit(v).cast("bigint"), F.lit(count[v]))).first()[0]
        count[v] += 1
        want.append((r, p, v))
    assert [tuple(x) for x in numbered] == sorted(want)
    bins = {}
    for r, p, v in sorted(want):
        if len(bins.setdefault(r >> 58, [])) < 2:
            bins[r >> 58].append((p, v))
    got = df.select(fingerprints.fingerprint(F.col("t"))).first()[0]
    assert [g >> 48 for g in got] == [b + 32 for b in sorted(bins)]
    for entry, b in zip(got, sorted(bins)):
        pair = [F.lit(v).cast("bigint") for _, v in sorted(bins[b])]
        assert entry & (1 << 48) - 1 == (spark.range(1).select(F.xxhash64(*pair)).first()[0] & (1 << 64) - 1) >> 16


def base_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in re.finditer(
        r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[1]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_spans(spark, sf, odd):
    known = texts(sf)
    for doc, r in by_id(catalog.QUERIES["op2_secret_scan"](spark, sf)).items():
        assert r["base_sha256"] == hashlib.sha256(base_secrets(known[doc]).encode()).hexdigest()
    found = secret_scan.scan(odd).select("doc_id", catalog.listed(F.col("base")).alias("b")).collect()
    assert len(found) == len(ODD) + 2
    assert all(r["b"] == base_secrets(ODD[r["doc_id"]] or "") for r in found if r["doc_id"] is not None)


def test_shared_tokens_are_examples_and_owned_ones_live(spark):
    shared, owned = "Xy9kLmNoPqRsTuVwXyZ01", "Qw3rTyUiOpAsDfGhJkL7z"
    rows = [(i, f"use {shared} here" + (f" not {owned}" if i == 1 else ""), "en", f"s{i}", 0, "") for i in range(3)]
    found = by_id(secret_scan.scan(spark.createDataFrame(rows, SCHEMA)))
    assert [s["kind"] for s in found[1]["spans"]] == ["live"] and not found[0]["spans"]


def test_examples_need_many_repositories_for_their_owners(spark):
    copied, near, pasted, own = "Xy9kLmNoPqRsTuVwXyZ01", "Qw3rTyUiOpAsDfGhJkL7z", "Zx8cVbNmAsDfGhJkLqW2e", "Pl5oKmIjNuHbYgVtFcR4d"
    rows = [(i, f"use {copied} here", "en", f"s{i}", 0, "") for i in range(4)]  # one repository, four owners
    rows += [(10 + i, f"use {near} here" + " again" * i, "en", f"s{i}", 0, "") for i in range(2)]
    rows += [(20 + i, f"use {pasted} here {i}", "en", "s0", 0, "") for i in range(40)]
    rows += [(60 + i, f"use {own} here {i}", "en", "s0", 0, "") for i in range(3)]
    found = by_id(secret_scan.scan(spark.createDataFrame(rows, SCHEMA)))
    assert {i for i, r in found.items() if r["n_live"] == 1 and len(r["spans"]) == 1} == {0, 1, 2, 3, 10, 11, 60, 61, 62}
    assert not any(found[i]["n_live"] or found[i]["spans"] for i in range(20, 60))


def test_free_tokens_after_names_with_padding_and_of_any_length(spark):
    token, long = "AbCdEf0123456789AbCdEf01", "Ab1" * 2_000
    tokens = {f"auth={token}": (5, 29), f"AWS_SECRET_ACCESS_KEY={token}": (22, 46), f"x {token}== y": (2, 28), f"x {token}=": (2, 27),
              f"a {long} b": (2, 6_002), f"My{token}=short": None, f"My{token}==1": None, f"{token[:19]} x": None}
    for i, (text, at) in enumerate(tokens.items()):
        (row,) = secret_scan.scan(spark.createDataFrame([(i, text, "en", "s", 0, "")], SCHEMA)).collect()
        assert [(s["kind"], s["start"], s["end"]) for s in row["spans"]] == ([("live", *at)] if at else [])


def test_running_sums(spark):
    from speciframe.llm.native import running_sums

    for n in (0, 1, 2, 7, 50):
        got = spark.range(1).select(running_sums(F.array(*[F.lit(i * i) for i in range(n)]).cast("array<bigint>"))).first()[0]
        assert got == list(np.cumsum([i * i for i in range(n)]))


def test_quality_measures():
    def slow(words):
        marked = set()
        for i in range(len(words) - 4):
            if sum(words[j : j + 5] == words[i : i + 5] for j in range(len(words) - 4)) > 1:
                marked |= set(range(i, i + 5))
        return len(marked)

    for text in ("a a a a a a", "a b c d e", "a b c d e x a b c d e y", "p q " * 9, "1 2 3 4 5 6 1 2 3 4 5 6 7"):
        assert quality.repeated_words(text.encode().split()) == slow(text.split())
    assert quality.measure_text("a b c\na b c\n\n#") == (5, 9, 1, 1, 0, 3)
    assert quality.measure_text(None) == (0,) * 6


def test_quality_cutoffs_adapt(spark, odd, empty):
    rows = []
    for i in range(400):
        marks = "| " * 6 if i % 2 == 0 else ""  # tables are usual in s0, odd in s1
        rows.append((i, f"{marks}" + " ".join(f"w{(i * 7 + j) % 50}x{j}" for j in range(30)), "en", f"s{i % 2}", 0, ""))
    rows.append((1001, "| " * 9 + " ".join(f"w{j + 10}x{j}" for j in range(30)), "en", "s1", 0, ""))
    rows.append((1002, "| " * 7 + " ".join(f"w{j + 10}x{j}" for j in range(30)), "en", "s0", 0, ""))
    found = by_id(quality.judge(spark.createDataFrame(rows, SCHEMA)))
    assert not found[1001]["_kept"] and found[1002]["_kept"] and sum(r["_kept"] for r in found.values()) == 401
    assert quality.judge(odd).count() == len(ODD) + 2
    assert quality.keep_good(odd).columns == odd.columns and quality.keep_good(empty).count() == 0


def test_backoff_odd_cases(odd, empty, spark):
    rows = by_id(language_model.score(odd, order=3))
    assert rows[0]["log_score"] == 0.0 and rows[1]["n_tokens"] == 0 and rows[8]["n_tokens"] == 30_000
    assert language_model.score(empty).count() == 0
    two = spark.createDataFrame([(1, "a b", "", "", 0, ""), (2, "a b", "", "", 0, "")], SCHEMA)
    assert by_id(language_model.score(two, order=2))[1]["log_score"] == pytest.approx(np.log(1 / 2) + np.log(1 / 1))


def emails(text):
    return [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", text)]


def test_personal_data_base():
    for text in ("a@b.c@d.e", "x@y z@", "@@a.b@c.d..e@f.g", "el.01@mail8.example.com.", "a@b", "--@--.-@x.y"):
        assert [(a, b) for _, a, b in pii._emails(text)] == emails(text)
    kinds = [k for k, _, _ in pii.base_spans(ODD[9])]
    assert kinds == ["email", "phone", "ip", "card"]
    assert [k for k, *_ in pii.base_spans("1.2.3.4.5.6.7.8 999.1.1.1 0004.0.0.255")] == ["ip", "ip", "ip"]


def test_semi_markov_decoding_is_the_best_segmentation():
    model = pii.Model()
    for _ in range(30):
        model.learn("call +1 407 555 7710 now", [("phone", 5, 20)], 0.5)
        model.learn("host 10.0.0.7 up", [("ip", 5, 13)], 0.5)

    def best(window):
        tokens, ends = pii.candidates(window)

        def tails(at, before):
            if at == len(tokens):
                yield 0.0, []
                return
            for value, rest in tails(at + 1, ""):
                yield value + model.step_score(before, ""), rest
            for stop in range(at, len(tokens)):
                for first, features in ends[stop]:
                    if first == at:
                        for kind in pii.KINDS:
                            own = model.span_score(features, kind) + model.step_score(before, kind)
                            for value, rest in tails(stop + 1, kind):
                                yield value + own, [(kind, tokens[at][0], tokens[stop][1]), *rest]

        return max(tails(0, ""), key=lambda r: r[0])[1]

    for window in ("+1 407 555 7710", "10.0.0.7 4", "ab1 +2"):
        assert model.decode(window) == best(window)
    assert model.decode("+1 407 555 7710") == [("phone", 0, 15)]


def test_personal_data(spark, sf, odd, empty):
    known = texts(sf)
    for doc, r in by_id(catalog.QUERIES["op5_personal_data"](spark, sf)).items():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in pii.base_spans(known[doc]))
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(r["spans"].split(","))
    clean = by_id(pii.redact(odd))
    assert clean[9]["text"].startswith("mail [email] or [phone] from [ip], card [card]") and clean[9]["n_chars"] == len(clean[9]["text"])
    assert clean[1]["text"] is None and clean[5]["text"] == ODD[5]
    assert pii.redact(empty).columns == empty.columns


def test_maximal_segments():
    def slow(scores):
        """Ruzzo and Tompa's definition: take the best segment, then go on to its left and right."""
        best = max(((sum(s for _, s in scores[i:j]), -(j - i), i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)),
                   default=(0, 0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = best[2:]
        return [*slow(scores[:i]), (scores[i][0], scores[j - 1][0], best[0]), *slow(scores[j:])]

    rng = np.random.default_rng(5)
    for _ in range(60):
        scores = [(i, float(s)) for i, s in enumerate(rng.integers(-5, 6, 12) + rng.random(12) / 100)]
        got = toxicity.maximal_segments(scores)
        assert [g[:2] for g in got] == [s[:2] for s in slow(scores)]


def test_toxicity(spark, sf, odd, empty):
    model = toxicity.fit(*[spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")], lambda c: ~catalog.held_out(c))
    rated = toxicity.score(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), model)
    rows = rated.join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").filter(catalog.held_out(F.col("doc_id")))
    counts = {(r["toxic"], r["hit"]): r["count"] for r in rows.groupBy("toxic", (F.col("_toxicity.score") >= 0.5).alias("hit")).count().collect()}
    assert counts[1, True] >= 0.9 * (counts[1, True] + counts.get((1, False), 0))
    assert counts[0, False] >= 0.98 * (counts[0, False] + counts.get((0, True), 0))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    kept = toxicity.drop_toxic(odd, none, lambda c: ~catalog.held_out(c))
    assert kept.count() == len(ODD) + 2 and kept.columns == odd.columns
    assert toxicity.score(empty, model).count() == 0


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 3]) for i in range(len(words) - 2)} if len(words) > 2 else ({tuple(words)} if words else set())


def test_near_duplicates(spark, odd, empty):
    rng = np.random.default_rng(2)
    rows, doc = [], 0
    for family in range(4):
        words = [f"f{family}w{i}" for i in range(120)]
        for _ in range(700 if family == 0 else 20):
            changed = list(words)
            for at in rng.integers(0, 120, rng.integers(0, 6)):
                changed[at] = f"r{rng.integers(0, 10**9)}"
            rows.append((doc, " ".join(changed), "en", "s", 0, ""))
            doc += 1
    sets = [shingles(r[1]) for r in rows]
    root = list(range(doc))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(doc):
        for j in range(i):
            if rows[i][1][:2] == rows[j][1][:2] or rows[i][1].split()[60] == rows[j][1].split()[60]:
                common = len(sets[i] & sets[j])
                if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                    root[max(find(i), find(j))] = min(find(i), find(j))
    got = by_id(neardup.groups(spark.createDataFrame(rows, SCHEMA)))
    assert all(got[i]["component_id"] == find(i) and got[i]["n_shingles"] == len(sets[i]) for i in range(doc))
    small = neardup.groups(odd).collect()
    assert len(small) == len(ODD) + 2
    assert {r["doc_id"]: r["component_id"] for r in small}[6] == 5
    kept = neardup.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)  # 6 repeats 5, and so does the repeated row
    assert neardup.keep_one(empty).count() == 0


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark, sf):
    import corpus_pipeline

    words = [f"w{i}" for i in range(500)]
    longer = [*words, *[f"a{i}" for i in range(115)]]  # 496 of 611 shingles of five words
    other = [*words, *[f"b{i}" for i in range(130)]]  # 496 of 626
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0, "") for i, w in enumerate((words, longer, other))], SCHEMA)
    assert {r["doc_id"] for r in corpus_pipeline.distinct(spark, docs, sf).collect()} == {0, 2}
    assert neardup.groups(docs).filter("doc_id = component_id").count() == 3
    assert {r["n_shingles"] for r in neardup.groups(docs, 5, 80).collect()} == {496, 611, 626}
    assert (neardup.rows_for(85), neardup.rows_for(80)) == (4, 3)


def families_of(sets):
    """Least index reachable over links between all pairs of sets, by brute force."""
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(sets))]


def test_single_links_into_a_large_family(spark, monkeypatch):
    """Strangers that are linked with one member of a family of many chunks: the third pass alone finds
    them, all in one bucket; the other families in the bucket stay apart."""
    monkeypatch.setattr(neardup, "CHUNK", 16)
    monkeypatch.setattr(neardup, "BLOCK", 8)
    base = [f"w{i}" for i in range(120)]

    def changed(words, places, tag):
        return [f"{tag}p{i}" if i in places else w for i, w in enumerate(words)]

    found = [changed(base, {i}, f"m{i}") for i in range(100)]
    for n in range(10):
        bridge = changed(base, {5, 35, 65}, f"b{n}")
        found += [bridge, changed(bridge, {20, 50, 80}, f"s{n}")]
    found += [[f"o{n}w{i}" for i in range(118 + n % 3)] + [f"t{n}"] for n in (1, 2, 3)] + [["o1w0"] * 9]
    rows = [(i, " ".join(w), "en", "s", 0, "") for i, w in enumerate(found)]
    sets = [shingles(r[1]) for r in rows]
    expected = families_of(sets)
    assert len(set(expected)) == 5
    docs = spark.createDataFrame(rows, SCHEMA)
    keyed = neardup.signatures(docs).select(F.col("doc_id").alias("id"), "f1", "f2", "n_shingles")
    bucket = keyed.select("id", F.lit(0).alias("i"), F.lit(7).cast("bigint").alias("ka"))
    label = spark.createDataFrame([(i, 0) for i in range(1, 100)], "id long, component long")
    edges = neardup.finished(bucket, label, keyed, docs)
    stars = label.select(F.col("id").alias("u"), F.col("component").alias("v"))
    got = {r["id"]: r["component"] for r in neardup.components(stars.union(edges)).collect()}
    assert [got.get(i, i) for i in range(len(rows))] == expected


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101)]
    found = {r["id"]: r["component"] for r in neardup.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 103: 100}


def test_licences(odd, empty):
    model = licenses.fit(odd)
    rows = by_id(licenses.scan(odd, model))
    assert [(n["paragraph"], n["family"]) for n in rows[11]["_licences"]] == [(0, "MIT")]
    assert [(i, n["paragraph"], n["family"]) for i, r in rows.items() for n in r["_licences"]] == [(11, 0, "MIT")]
    assert licenses.scan(empty, licenses.fit(empty)).count() == 0


def test_wrapped_notices_and_spdx_tags(spark, empty):
    model = licenses.fit(empty)
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:"""
    narrow = "Permission is hereby\ngranted, free of charge,\nto any person obtaining\na copy of this software\nand associated\ndocumentation files"
    texts = {
        f"Some title here\n\n{bsd}\n\nmore": [(2, "BSD")], "\n".join(f" * {x}" for x in bsd.split("\n")): [(0, "BSD")], narrow: [(0, "MIT")],
        "x\n// SPDX-License-Identifier: (MIT OR EPL-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0 */": [(1, "MIT"), (1, "EPL-2.0"), (1, "GPL")],
        "Redistributions of source code must retain the above copyright notice,\nthis list of conditions and the following disclaimer.": [(0, "BSD")],
        "the forms of use are\nwith the following in\nsource and binary\nconditions met": [], "a line\nand another": [],
    }
    rows = [(i, t, "en", "s", 0, "") for i, t in enumerate(texts)]
    got = by_id(licenses.scan(spark.createDataFrame(rows, SCHEMA), model))
    for i, wanted in enumerate(texts.values()):
        assert [(n["paragraph"], n["family"]) for n in got[i]["_licences"]] == wanted, i


def test_byte_pair_encoding(spark, sf, odd):
    from tokenizers import Tokenizer

    path = catalog.vocabulary("word_bpe_49k.json")
    whole, known = Tokenizer.from_file(path), texts(sf)
    for doc, r in by_id(catalog.QUERIES["op9_forced_boundary_bpe"](spark, sf)).items():
        ids = whole.encode(known[doc], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    coded = by_id(bpe.decode(bpe.encode(odd, path), path))
    for i, text in enumerate(ODD):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert coded[i]["_ids"] == ids and coded[i]["_decoded"] == whole.decode(ids, skip_special_tokens=False)


def test_forced_boundaries_are_cuts():
    encoder = bpe.Encoder(catalog.vocabulary("word_bpe_49k.json"))
    word = "".join(encoder.merges.symbol[b] for b in "ab漢zq".encode())
    fragments = encoder.merges.fragments(word)
    assert "".join(fragments) == word and len(fragments) > 1
    assert not any(word[i : i + 2] in encoder.merges.joined for i in np.cumsum([len(f) for f in fragments])[:-1] - 1)


def check_packing(rows, known):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(catalog.vocabulary("byte_bpe_50k.json"))
    bins = {}
    pieces = {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, own in pieces.items():
        ids = np.array([*whole.encode(known[doc] or "", add_special_tokens=False).ids, 2], "<u4")
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:]) and (len(own) == 1 or len(ids) > 1024)
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 1024
    return len(bins)


def test_packing(spark, sf, odd, empty, monkeypatch):
    known = texts(sf)
    rows = catalog.QUERIES["op10_residual_packing"](spark, sf).collect()
    assert {r["doc_id"] for r in rows} == known.keys()
    n = check_packing(rows, known)
    assert n <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1
    path = catalog.vocabulary("byte_bpe_50k.json")
    monkeypatch.setattr(packing, "PER_TASK", 3)  # several rounds of several tasks
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(6)
    rows = packing.pack(docs, path).collect()
    check_packing(rows, known)
    distinct = packing.pack(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path)
    check_packing(distinct.collect(), dict(enumerate(ODD)))
    assert packing.pack(empty, path).count() == 0


def test_best_fit():
    rng = np.random.default_rng(3)
    for _ in range(20):
        sizes = [int(s) for s in rng.integers(1, 101, 60)]
        bins, offsets, fills = packing.best_fit(sizes, 100)
        slow = []
        for s in sorted(sizes, reverse=True):
            room = min((r for r in slow if r >= s), default=100)
            if room in slow:
                slow.remove(room)
            slow.append(room - s)
        assert sorted(100 - f for f in fills) == sorted(slow) and sum(fills) == sum(sizes)
        assert len(set(zip(bins, offsets))) == len(sizes)


def test_pipeline(spark, sf):
    import corpus_pipeline as pipeline

    docs = catalog.documents(spark, sf)
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.cut_lineage(stage(spark, docs, sf))
        assert docs.columns == columns, name
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids), name
        ids = left
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    known = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"] for r in packed} == ids
    check_packing(packed, known)


@pytest.mark.parametrize("name", ["op4_stupid_backoff", "op7_near_duplicates"])
def test_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).select(*columns).collect())) == want
