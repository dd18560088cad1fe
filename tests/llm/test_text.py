import hashlib
import os
import random
import re
import time
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecloom.llm import decontam, lines, neardup, packing, pii, quality, suffix, tokens
from vecloom.llm.components import components

ODD = [(7001, ""), (7002, None), (None, "a row without an id"), (7003, "twice"), (7003, "twice")]


def frame(spark, rows, **extra):
    """doc_id, text and columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("term", "key", "score", "list", "n", "h", "kept", "host", "found", "label"):
        df = df.withColumn(c, F.lit(c))
    for c, v in extra.items():
        df = df.withColumn(c, v)
    return df


def empty(spark):
    return frame(spark, [])


# Token counts


@lru_cache
def loaded():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return loaded()


PIECES = st.sampled_from([*"abcthe  \n\t'sremvld019.,!?-éß中😀\x1c\x85 ", "'s", "'ll", " the", "<|endoftext|>", "<|endo", "   ", "\r\n", "'re", "ᲀ", "a" * 150])


@settings(max_examples=150, deadline=None)
@given(st.lists(PIECES, max_size=30).map("".join))
def test_every_prefix_counts_as_the_library_does(text):
    lib = loaded()
    got = tokens.counter(tokens.tokenizer_path()).prefix_counts(text)
    for i in {0, len(text), len(text) // 2, *range(max(0, len(text) - 15), len(text))}:
        assert got[i] == len(lib.encode(text[:i], add_special_tokens=False).ids), text[:i]


def test_token_prefixes(spark, library):
    rows = [(1, "A few words, don't they? " * 100), (2, "x" * 3000), *ODD]
    got = tokens.token_prefixes(frame(spark, rows), budget=20).collect()
    assert len(got) == len(rows)
    for r, (i, text) in zip(sorted(got, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["n_bytes"])), sorted(rows, key=lambda r: (r[0] is None, r[0], len(r[1] or "")))):
        text = text or ""
        assert r["n_bytes"] == len(text.encode()) and r["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)
        cut = r["cut_chars"]
        assert tokens.cut_at(r["prefix_steps"], 20) == cut and tokens.count_at(r["prefix_steps"], cut) <= 20
        assert cut == len(text) or len(library.encode(text[:cut], add_special_tokens=False).ids) <= 20
    assert tokens.token_prefixes(empty(spark)).collect() == []


# Personal data

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def strict(kind, span):
    digits = re.sub("[^0-9]", "", span)
    return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in span.split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def test_strict_spans_equal_plain_patterns(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("0123456789+ -.()@ab%_é😀:/") for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows += [(1000 + i, "".join(rng.choice("12.@a-_") for _ in range(rng.randint(0, 150)))) for i in range(200)]
    rows += [(2000, "4111 1111 1111 1111 and +1 (555) 010-9999, 10.0.0.1"), (2001, "1" * 4000), (2002, "a" * 9000 + "@b.c"), *ODD]
    model = pii.fit_pii(spark)
    found = pii.find_pii(spark, frame(spark, rows), model=model)
    got = Counter((r["doc_id"], r["b"]) for r in found.select("doc_id", pii.span_list(F.col("base")).alias("b")).collect())
    want = Counter((i, ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in p.finditer(t or "") if strict(k, m[0]))) for i, t in rows)
    assert got == want
    assert pii.find_pii(spark, empty(spark), model=model).collect() == []


def test_trees_add_spelled_out_forms_and_leave_prose_alone(spark):
    rows = [(1, "write to jo.doe (at) example (dot) org today"), (2, "Look at dot seven. Chapter 1.2.3 has 2024-01-05 and 555 lines."), (3, "pay by card 4111.1111.1111.1111 now")]
    found = pii.find_pii(spark, frame(spark, rows)).select("doc_id", pii.span_list(F.col("extra")).alias("x")).collect()
    got = {r["doc_id"]: r["x"] for r in found}
    assert got[1].startswith("email:9:") and got[2] == "" and got[3] == "card:12:31"
    text = pii.redacted(pii.find_pii(spark, frame(spark, [(1, "mail a@b.co and a@b.co")]))).head()["text"]
    assert text == "mail [email] and [email]"


def test_secrets_and_long_texts(spark):
    model = pii.fit_pii(spark)
    token = 'token = "9c8b45435718dcc700c184a7e303cdc64c6a8f7f"'
    rows = [(1, f"some words {token} and more"), (2, "commit 9c8b45435718dcc700c184a7e303cdc64c6a8f7f is in")]
    got = {r["doc_id"]: r["x"] for r in pii.find_pii(spark, frame(spark, rows), model=model).select("doc_id", pii.span_list(F.col("extra")).alias("x")).collect()}
    assert got == {1: f"secret:11:{10 + len(token)}", 2: ""}
    many = [(1, "".join(f"jo{i} (at) ab (dot) com, jo{i}@ab.com " for i in range(20_000))), (2, "1" * 2_000_000), (3, "a@" * 500_000)]
    began = time.time()
    sizes = {r["doc_id"]: r["n"] for r in pii.find_pii(spark, frame(spark, many), model=model).select("doc_id", F.size("base").alias("n")).collect()}
    assert sizes == {1: 20_000, 2: 0, 3: 0} and time.time() - began < 120


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(1, 12), st.booleans(), st.integers(0, 3)), max_size=30))
def test_added_spans_equal_a_plain_choice(spark, spans):
    rows = [(0, s, s + n, base, score / 4) for s, n, base, score in spans]
    base, more = [r for r in rows if r[3]], [r for r in rows if not r[3]]
    free = sorted(m for m in more if not any(m[1] < b[2] and b[1] < m[2] for b in base))
    want, end, chain = [], -1, []
    for m in [*sorted(free, key=lambda m: m[1]), (0, 10**6, 10**6 + 1, False, 0.0)]:
        if m[1] >= end and chain:
            want.append(min(chain, key=lambda m: (-m[4], m[1], m[2])))
            chain = []
        end = max(end, m[2])
        chain.append(m)
    df = spark.createDataFrame([(base, more)], f"b array<{pii.RATED}>, m array<{pii.RATED}>")
    got = df.select(pii._added(F.col("b"), F.col("m"))).head()[0]
    assert sorted((r["start"], r["score"]) for r in got) == sorted((m[1], m[4]) for m in want)


def test_candidates_keep_their_precision_on_held_out_texts(spark):
    assert min(pii.fit_pii(spark).precision) >= 0.98


# Packing


def test_packing_is_whole_and_within_capacity(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([1, 50, 700, 3000, 3000, 20_000, 40_000])) for i in range(300)] + ODD
    out = packing.packed(spark, frame(spark, rows), F.octet_length("text")).collect()
    assert sum(r["length"] for r in out) == sum(len(t or "") for _, t in rows)
    bins = defaultdict(list)
    for r in out:
        assert (r["bin_id"] is None) == (r["length"] == 0)
        if r["length"]:
            bins[r["bin_id"]].append(r)
    for b in bins.values():
        b.sort(key=lambda r: r["bin_offset"])
        used = sum(r["length"] for r in b)
        assert b[0]["bin_size"] == min(s for s in packing.SIZES if s >= used)
        assert all(x["bin_offset"] + x["length"] == y["bin_offset"] for x, y in zip(b, b[1:]))
    assert sum(r["length"] for b in bins.values() for r in b) / sum(b[0]["bin_size"] for b in bins.values()) > 0.95
    assert packing.packed(spark, empty(spark), F.octet_length("text")).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_best_fit_keeps_order_and_bounds(sizes):
    sizes = sorted(sizes, reverse=True)
    of, at, size = packing.pack(sizes, (10, 20, 40), 2)
    used = Counter()
    for n, b, a in zip(sizes, of, at):
        assert a == used[b]
        used[b] += n
    assert all(used[b] <= s and s == min(x for x in (10, 20, 40) if x >= used[b]) for b, s in enumerate(size))


def best_fit_by_brute_force(lengths, sizes, overhead):
    """The same rules, written out: every open bin is looked at, and each size is filled from all that is left."""
    left, bins, of = list(lengths), [], []
    for n in lengths:
        left.remove(n)
        fits = [(room - used - n, b) for b, (room, used) in enumerate(bins) if room - used >= n]
        if fits:
            b = min(fits)[1]
        else:
            costs = []
            for size in sizes:
                if size >= n:
                    held = n
                    for x in sorted(left, reverse=True):
                        held += x if held + x <= size else 0
                    costs.append(((size + overhead) / held, -size))
            b = len(bins)
            bins.append((-min(costs)[1], 0))
        bins[b] = (bins[b][0], bins[b][1] + n)
        of.append(b)
    return of, [min(s for s in sizes if s >= used) for _, used in bins]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=40))
def test_best_fit_equals_brute_force(lengths):
    lengths = sorted(lengths, reverse=True)
    of, _, size = packing.pack(lengths, (10, 20, 40), 2)
    assert (of, size) == best_fit_by_brute_force(lengths, (10, 20, 40), 2)


def test_shards_fill_as_one_best_fit_does_and_no_id_crowds_one(spark, monkeypatch):
    rng = random.Random(4)
    lengths = [min(int(rng.lognormvariate(6, 1.3)) + 1, 16_384) for _ in range(3000)]
    rows = [(None if i % 2 else i % 3, "x" * n) for i, n in enumerate(lengths)]
    _, _, size = packing.pack(sorted(lengths, reverse=True))
    monkeypatch.setattr(packing, "SHARD_PIECES", 500)
    out = packing.packed(spark, frame(spark, rows), F.octet_length("text")).collect()
    bins = {r["bin_id"]: r["bin_size"] for r in out}
    assert sum(bins.values()) < 1.03 * sum(size)
    shards = Counter(r["bin_id"] >> 32 for r in out)
    assert len(shards) == 6 and max(shards.values()) < 700


# Suffix arrays


def kept_by_brute_force(rows, length):
    counts, out = Counter(), Counter()
    for _, t in rows:
        raw = (t or "").encode()
        counts.update(raw[k : k + length] for k in range(len(raw) - length + 1))
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if counts[raw[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        out[i, len(raw), sum(gone), sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1])), hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("few", [256, 2])
def test_long_repeats_equal_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(suffix, "FEW_SPANS", few)
    rng = random.Random(5)
    make = lambda s, n: "".join(rng.choice(s) for _ in range(n))
    common = make("abcdefgh ", 420)
    rows = [(i, make("xyzé", rng.randint(0, 300)) + common[rng.randint(0, 60) : 400 - rng.randint(0, 60)] + make("uvw", rng.randint(0, 300))) for i in range(80)]
    rows += [(900, "a" * 900), (901, "ab" * 300), (902, "q" * 200), (903, "z" * 199), (904, "same id one " * 40), (904, "another text " * 40), (905, "x" * 700), *ODD]
    got = Counter(tuple(r) for r in suffix.without_repeats(spark, frame(spark, rows).repartition(3), kept_bytes=False).collect())
    assert got == kept_by_brute_force(rows, 200)


def test_no_long_repeats(spark):
    assert suffix.without_repeats(spark, empty(spark)).collect() == []
    out = suffix.without_repeats(spark, frame(spark, [(1, "short")])).collect()
    assert bytes(out[0]["kept"]) == b"short" and out[0]["n_removed"] == 0


def test_levels_merge_geometrically(spark):
    family = suffix.SuffixFamily(spark)
    entries = spark.createDataFrame([(1, 1), (1, 2)], "anchor long, span long")
    sizes = []
    for _ in range(5):
        family.add(entries)
        sizes.append(sorted(family.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    assert {(r["span"], r["copies"]) for r in family.repeats().collect()} == {(1, 5), (2, 5)}


@pytest.mark.parametrize("hot", [1 << 18, 3])
def test_a_hot_anchors_spans_are_dealt_into_parts(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix, "FEW_SPANS", 2)
    monkeypatch.setattr(suffix, "HOT_ANCHORS", hot)
    rng = random.Random(8)
    rows = [(1, rng.randint(0, 400)) for _ in range(900)] + [(rng.randint(2, 300), rng.randint(0, 2)) for _ in range(500)] + [(1000, 7)]
    family = suffix.SuffixFamily(spark)
    for k in range(3):
        family.add(spark.createDataFrame(rows[k::3], "anchor long, span long"))
    copies, spans = Counter(rows), Counter(a for a, _ in set(rows))
    want = {(a, s, c, spans[a]) for (a, s), c in copies.items() if c > 1 or spans[a] > 1}
    got = [(r["anchor"], r["span"], r["copies"], r["spans"]) for r in family.repeats().collect()]
    assert len(got) == len(want) and set(got) == want


def test_many_rows_without_an_id_keep_their_own_cuts(spark):
    rng = random.Random(9)
    make = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    common = make(250)
    rows = [(None, make(40) + common + make(k)) if k % 2 else (None, make(250 + k)) for k in range(60)]
    got = Counter(tuple(r) for r in suffix.without_repeats(spark, frame(spark, rows), kept_bytes=False).collect())
    assert got == kept_by_brute_force(rows, 200)


# Near-duplicates


def components_by_brute_force(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids = [i for i in sets if i is not None]
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            n = len(sets[a] & sets[b])
            if a < b and n and 100 * n >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    base = [f"w{rng.randint(0, 500)}" for _ in range(300)]
    rows = []
    for i in range(90):
        w = list(base)
        for _ in range(rng.randint(0, 9)):
            w[rng.randint(0, 299)] = f"x{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    for i in range(60):
        w = base[:12]
        if rng.random() < 0.7:
            w[rng.randint(0, 11)] = f"x{rng.randint(0, 3)}"
        rows.append((200 + i, " ".join([*w, *[f"y{i % 7}"] * rng.randint(0, 3)])))
    rows += [(500, "a b"), (501, "A\tB"), (502, "é É"), (503, " \n"), (504, "É é"), *ODD]
    got = neardup.near_duplicates(spark, frame(spark, rows)).collect()
    want = components_by_brute_force(rows)
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    assert neardup.near_duplicates(spark, empty(spark)).collect() == []


def test_components_of_long_chains_with_shuffled_ids(spark):
    ids = list(range(1000))
    random.Random(5).shuffle(ids)
    for step, names in ((1, ids), (3, ids), (1, sorted(ids))):
        links = [(names[i], names[i + k]) for i in range(1000) for k in range(1, step + 1) if i + k < 1000]
        links += [(2000, 2000), (3001, 3000)]
        got = components(spark, spark.createDataFrame(links, "a long, b long")).collect()
        assert {r["node"]: r["component"] for r in got} == dict.fromkeys(ids, 0) | {2000: 2000, 3000: 3000, 3001: 3000} and len(got) == 1003


def test_a_chain_of_1000_texts_is_one_component(spark):
    ids = list(range(1000))
    random.Random(6).shuffle(ids)
    rows = [(i, " ".join(f"w{w}" for w in range(5 * k, 5 * k + 44))) for k, i in enumerate(ids)]  # 35 of 45 shingles shared with the next, 30 of 50 with the one after
    got = neardup.near_duplicates(spark, frame(spark, rows)).collect()
    assert len(got) == 1000 and {r["component_id"] for r in got} == {0} and [r["doc_id"] for r in got if r["kept"]] == [0]


@pytest.mark.parametrize("few", [256, 3])
def test_large_components_are_named_as_small_ones_are(spark, few, monkeypatch):
    monkeypatch.setattr(neardup, "FEW_ROWS", few)
    rng = random.Random(12)
    rows = [(bytes([k % 256, k // 256]), 1 if k < 300 else rng.randint(2, 60), rng.randint(-50, 10_000)) for k in range(500)]
    least = defaultdict(lambda: 10**6)
    for _, part, doc in rows:
        least[part] = min(least[part], doc)
    out = neardup.component_ids(spark, spark.createDataFrame(rows, "print binary, part long, doc_id long")).collect()
    assert sorted((bytes(r["print"]), r["part"], r["component_id"]) for r in out) == sorted((p, part, least[part]) for p, part, _ in rows)


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = neardup.near_duplicates(spark, frame(spark, [(1, one), (1, two), (2, one + " z"), (3, two + " z"), (5, two + " y"), (5, "c " * 9)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got) == [(1, 1, 36), (1, 1, 36), (2, 1, 37), (3, 1, 37), (5, 1, 37), (5, 5, 1)]
    assert len({r["part"] for r in got}) == 3


def test_register_estimates():
    rng = np.random.default_rng(0)
    table = neardup.chance_table()
    errors = []
    for share in (0.2, 0.5, 0.8):
        for _ in range(20):
            both = rng.integers(0, 2**63, 2000).astype(np.uint64)
            n = int(2000 * share)
            a, b = np.concatenate([both[:n], rng.integers(0, 2**63, 1000).astype(np.uint64)]), np.concatenate([both[:n], rng.integers(0, 2**63, 1000).astype(np.uint64)])
            got = neardup.estimate(neardup.sketch(np.unique(a))[None], neardup.sketch(np.unique(b))[None], np.array([len(a)]), np.array([len(b)]), table)[0]
            errors.append(got - n / (n + 2000))
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


# Quality


def test_quality_learns_from_documents(spark):
    rng = random.Random(0)
    word = lambda: "".join(rng.choice(["ta", "re", "mo", "lin", "es", "un"]) for _ in range(rng.randint(1, 3)))
    good = lambda: " ".join(word() for _ in range(rng.randint(5, 300))) + "."
    bad = lambda: " ".join(word().upper() + "!!" for _ in range(rng.randint(5, 300)))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (9999, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows + ODD)
    model = quality.fit_quality(spark, docs, labels)
    got = quality.quality_scores(docs, model).collect()
    assert len(got) == len(rows) + len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    held = {r["doc_id"] for r in docs.where(quality.fold_of(F.col("doc_id")) == 0).select("doc_id").collect()}
    told = [(r["score"] >= 0.3) == (r["doc_id"] % 3 > 0) for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and r["doc_id"] in held]
    assert len(told) > 50 and np.mean(told) > 0.97
    kept = quality.quality_scores(docs, model, keep=docs.columns[:3], text_back=True)
    assert kept.columns == [*docs.columns[:3], "score"] and kept.where("text is null").count() == 1
    none = quality.fit_quality(spark, docs, labels.where("quality = 5"))
    assert {r["score"] for r in quality.quality_scores(docs, none).collect()} == {0.5}
    assert quality.quality_scores(empty(spark), model).collect() == []


def test_scores_do_not_depend_on_batches(spark):
    rng = random.Random(2)
    docs = frame(spark, [(i, "".join(rng.choice("ab! X.\n9") for _ in range(rng.randint(1, 900)))) for i in range(300)] + [(1000, "hello world!"), (1001, "hello world!")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    model = quality.fit_quality(spark, docs, labels)
    scores = lambda df: {r["doc_id"]: r["score"] for r in quality.quality_scores(df, model).collect()}
    one = scores(docs.coalesce(1))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert scores(docs.repartition(5)) == one and one[1000] == one[1001]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_attention_equals_a_plain_pass_and_numeric_gradients():
    rng = np.random.default_rng(3)
    z, cuts, y = rng.normal(size=(7, quality.N_FEATURES)), np.array([0, 1, 4]), np.array([1.0, 0, 1])
    m = quality.AttentionModel()
    p = m.p
    for k, (a, b) in enumerate(((0, 1), (1, 4), (4, 7))):
        h = [np.tanh(r @ p["W"] + p["b"]) for r in z[a:b]]
        weight = np.exp([np.sum(p["w"] * np.tanh(x @ p["V"]) / (1 + np.exp(-x @ p["U"]))) for x in h])
        bag = sum(w * x for w, x in zip(weight / weight.sum(), h))
        assert abs(m.forward(z, cuts)[0][k] - 1 / (1 + np.exp(-(bag @ p["c"] + p["d"][0])))) < 1e-12
    loss = lambda: -np.mean(y * np.log(m.forward(z, cuts)[0]) + (1 - y) * np.log(1 - m.forward(z, cuts)[0]))
    for name, g in m.gradients(z, cuts, y).items():
        for at in [tuple(rng.integers(n) for n in g.shape) for _ in range(4)]:
            old, ends = p[name][at], []
            for step in (1e-6, -1e-6):
                p[name][at] = old + step
                ends.append(loss())
            p[name][at] = old
            assert abs((ends[0] - ends[1]) / 2e-6 - g[at]) < 1e-6, (name, at)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables here")
def test_quality_on_documents_not_learned_from(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = quality.fold_of(F.col("doc_id")) == 0
    rows = quality.quality_scores(docs.where(held), quality.fit_quality(spark, docs, labels)).join(labels, "doc_id").collect()
    good, bad = (np.array([r["score"] for r in rows if r["quality"] == q]) for q in (1, 0))
    assert len(good) > 500 and len(bad) > 100 and np.mean(good[:, None] > bad[None]) > 0.99


def test_attention_gradients():
    rng = np.random.default_rng(1)
    x, cuts, y = rng.normal(size=(9, quality.N_FEATURES)), np.array([0, 2, 3, 7]), np.array([1.0, 0, 1, 0])
    loss = lambda m: -np.mean(y * np.log(m.scores(x, cuts)) + (1 - y) * np.log(1 - m.scores(x, cuts)))
    before = quality.AttentionModel()
    before.mean, before.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    after = quality.AttentionModel().fit(x, cuts, y, epochs=60)
    assert loss(after) < 0.2 * loss(before)


# Lines


def test_lines_by_share_of_pages(spark):
    rows = [(i, f"menu\nown line {i}\n\n menu \nrare") for i in range(10)] + [(20 + i, f"line {i}") for i in range(10)] + [(50, "menu\nmenu"), *ODD]
    docs = frame(spark, rows, site=F.when(F.col("doc_id") < 30, "a").when(F.col("doc_id") == 50, "b"))
    out = lines.drop_boilerplate(spark, docs, "site", "text").collect()
    got = {(r["doc_id"], r["text"], r["n_lines_dropped"]) for r in out}
    assert len(out) == len(rows) and (3, "own line 3\n", 3) in got and (50, "menu\nmenu", 0) in got and (7002, None, 0) in got
    assert lines.drop_boilerplate(spark, empty(spark).withColumn("site", F.lit("a")), "site", "text").collect() == []
    page = spark.createDataFrame([("HTTPS://u:p@Www.X.org:80/a", "<p>One</p><script>no()</script>two<!-- x --><br>three")], "url string, html string")
    assert page.select(lines.host_of(F.col("url")), lines.page_text(F.col("html"))).head() == ("www.x.org", "One\ntwo\nthree")


def test_a_line_on_a_tenth_of_a_source_goes(spark):
    rows = [(i, f"own {i}\n" + ("license line" if i % 10 == 0 else "often said" if i % 25 == 1 else f"other {i}")) for i in range(300)]
    out = lines.drop_boilerplate(spark, frame(spark, rows).withColumn("site", F.lit("a")), "site", "text").collect()
    assert {r["n_lines_dropped"] for r in out if r["doc_id"] % 10 == 0} == {1} and sum(r["n_lines_dropped"] for r in out) == 30


def test_long_pages_take_linear_time(spark):
    pieces, rng = ["<script", "</script>", "<style", "</style>", "<!--", "-->", "<!-->", "<p>", "<b", "a", ">", " ", "\n", "-"], random.Random(1)
    odd = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 25)))) for i in range(1000)]
    html = F.col("text")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(html, lines.HIDDEN, ""), lines.BREAKS, "\n"), "<[^>]*>", "")
    plain = F.array_join(F.filter(F.transform(F.split(plain, "\n"), lambda x: F.trim(x)), lambda x: x != ""), "\n")
    assert frame(spark, odd).where(plain != lines.page_text(html)).count() == 0
    long = [(1, "<script " * 250_000), (2, "<" * 2_000_000), (3, "<!--" * 500_000), (4, "<p " * 600_000), (5, "</style>" + "<style " * 300_000)]
    began = time.time()
    assert frame(spark, long).select(F.length(lines.page_text(html))).count() == 5 and frame(spark, long).agg(F.max(F.length(lines.page_text(html)))).head()[0] > 10**6
    assert time.time() - began < 60


# Decontamination

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_contamination_equals_brute_force(spark):
    rng = random.Random(4)
    words = ["Alpha", "beta", "GAMMA", "délta", "É", "eps1", "zeta", "eta", "theta", "io"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(rng.randint(1, 14))) for i in range(12)] + [(50, ""), (51, None), (52, "alpha-beta!"), (None, "beta gamma")]
    rows = [(i, say(rng.randint(0, 60)) + (" " + items[i % 12][1] + ". " + items[(i + 3) % 12][1] if i % 2 else "")) for i in range(60)] + [*ODD, (None, items[2][1] + " " + items[5][1]), (7003, items[4][1]), (7003, items[6][1])] + [(800, items[3][1].replace(" ", ",\n"))]
    table = frame(spark, [], item_id=F.lit(1).cast("long")).select("item_id", "text", "term", "n").union(spark.createDataFrame(items, "item_id long, text string").select("item_id", "text", F.lit("x"), F.lit("y")))
    got = decontam.contamination(spark, frame(spark, rows), table).collect()
    windows = defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").encode().lower())
        for k in range(max(1, len(w) - 7) if w and i is not None else 0):
            windows[tuple(w[k : k + 8])].add(i)
    want = Counter()
    for i, t in rows:
        w, hit, found = WORD.findall((t or "").encode().lower()), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want[i, len(w), len(hit), ",".join(sorted(map(str, found))), len(found) >= 2] += 1
    assert Counter((r["doc_id"], r["n_words"], r["n_hit"], ",".join(r["item_ids"]), r["contaminated"]) for r in got) == want
    assert decontam.contamination(spark, empty(spark), table).collect() == []
    assert {r["n_items"] for r in decontam.contamination(spark, frame(spark, rows), table.limit(0)).collect()} == {0}


def test_places_of_terms_too_many_to_broadcast(spark, monkeypatch):
    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice("abcdefgh") for _ in range(n))
    items = spark.createDataFrame([(i, say(10)) for i in range(5)], "item_id long, text string")
    rows = [(i % 20, f"{say(20)} {r['text']}") for i, r in enumerate(items.collect() * 6)] + [(None, say(30)), *ODD]
    found = lambda: sorted(map(str, decontam.contamination(spark, frame(spark, rows), items).collect()))
    few = found()
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", -1)
    assert found() == few


def test_near_matches(spark):
    item = "one two three four five six seven eight"
    docs = frame(spark, [(1, item.replace("three four", "four three")), (2, "one two three")])
    got = decontam.matches(spark, docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["kind"]) for r in got] == [(1, "near")]
