"""The pipeline's decisions against plain versions of its stages."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from vecloom.llm import lines, neardup, packing, quality


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Documents with junk, boilerplate lines, near copies and benchmark passages."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["ta", "re", "mo", "lin", "es", "un", "vo", "ka"]) for _ in range(rng.randint(1, 4)))
    say = lambda n: " ".join(word() for _ in range(n))
    items = [(k, say(20)) for k in range(5)] + [(9, "too short")]
    docs = []
    for i in range(240):
        text = f"{say(60)}\n{say(40)}" if i % 6 else say(60).upper().replace(" ", "!! ")
        if i % 10 == 3 and i % 6:
            text = docs[-1][1].replace("ta", "TA", 1) if i % 20 == 3 and docs[-1][0] % 6 else f"{text}\n{say(2)} {items[i % 5][1]}"
        docs.append((i, f"{text}\nshared footer" if i % 4 == 0 and i % 6 else text, "en", f"s{i % 2}", 0))
    docs += [(400, f"{say(30)} Too, SHORT! {say(30)}", "en", "s0", 0), (500, "", "en", "s0", 0), (501, None, None, None, None), (502, docs[1][1], "en", "s1", 0)]
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_equal_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit_quality(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, model).collect()}
    want = {r["doc_id"]: r for r in docs.collect() if scores[r["doc_id"]] >= pipeline.QUALITY_CUT}
    assert {i for i in want if i < 240} == {i for i in range(240) if i % 6}
    got = pipeline.quality(spark, docs, sf_dir)
    assert got.columns == docs.columns and {r["doc_id"]: r for r in got.collect()} == want

    pages, total = Counter(), Counter()
    for r in want.values():
        total[r["source"]] += 1
        pages.update({(r["source"], x.strip(" ")) for x in (r["text"] or "").split("\n") if x.strip(" ")})
    drop = {k for k, n in pages.items() if total[k[0]] >= 5 and n >= 5 and n > lines.RATIO * total[k[0]]}
    assert drop
    texts = {i: "\n".join(x for x in r["text"].split("\n") if (r["source"], x.strip(" ")) not in drop) if r["text"] is not None else None for i, r in want.items()}
    got = pipeline.line_dedup(spark, got, sf_dir)
    assert got.columns == docs.columns and {r["doc_id"]: r["text"] for r in got.collect()} == texts

    sets, root = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in sorted(sets):
        for b in sorted(sets):
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                old, new = max(root[a], root[b]), min(root[a], root[b])
                root = {i: new if r == old else r for i, r in root.items()}
    texts = {i: t for i, t in texts.items() if root[i] == i}
    assert 502 not in texts and len(texts) < len(root)
    got = pipeline.near_dedup(spark, got, sf_dir)
    assert got.columns == docs.columns and {r["doc_id"]: r["text"] for r in got.collect()} == texts

    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = word.findall(r["text"].encode().lower())
        windows |= {tuple(w[k : k + 8]) for k in range(max(1, len(w) - 7))}

    def clean(text):
        w = word.findall((text or "").encode().lower())
        return not any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    left = {i: t for i, t in texts.items() if clean(t)}
    assert len(left) < len(texts) and 400 in texts and 400 not in left
    got = pipeline.decontamination(spark, got, sf_dir)
    assert got.columns == docs.columns and {r["doc_id"]: r["text"] for r in got.collect()} == left

    size = defaultdict(int)
    for r in pipeline.run(spark, sf_dir).collect():
        size[r["doc_id"]] += r["length"]
        assert r["length"] == 0 or r["bin_offset"] + r["length"] <= r["bin_size"] and r["bin_size"] in packing.SIZES
    assert size == {i: len((t or "").encode()) for i, t in left.items()}


def test_rows_that_share_an_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id in (1, 2, 4)")
    assert pipeline.near_dedup(spark, docs.union(docs), sf_dir).count() == 3
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, one, "x", "s", 0), (1, two, "x", "s", 0), (2, one + " c", "x", "s", 0), (3, two + " c", "x", "s", 0), (None, one, "x", "s", 0), (4, one, "y", "s", 0), (4, one, "x", "s", 0), (5, "d " + two, "z", "t", 1)]
    odd = spark.createDataFrame(rows, docs.schema).withColumn("mark", F.lit(0)).withColumn("c0", F.lit(0))
    got = pipeline.near_dedup(spark, odd, sf_dir)
    assert got.columns == odd.columns and sorted((r["doc_id"] or 0, r["text"]) for r in got.collect()) == [(0, one), (1, one), (1, two)]
    assert pipeline.near_dedup(spark, docs.limit(0), sf_dir).count() == 0


def test_stage_names_and_width():
    assert [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"] and neardup.WIDTH == 5
