import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.llm import ann, chat
from vecloom.llm.quality import fold_of


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(1)).withColumn("list", F.lit("x"))


def every(i):
    return F.pmod(i, F.lit(20)) == 0


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:600] = x[100]  # a third of all rows are one vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] + [1.0] * 15), (5003, [None] + [1.0] * 15), (5004, [float("inf")] + [1.0] * 15), (None, [1.0] * 16), (5005, [1.0])]
    got = ann.neighbours(spark, vectors(spark, rows), every).collect()
    hit = total = 0
    for q in range(0, 1500, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 11)) and all(abs(d[r["vec_id"]] - r["score"]) < 1e-12 for r in own)
        hit, total = hit + len({r["vec_id"] for r in own} & set(order)), total + 10
        if 100 <= q < 600:
            assert [r["vec_id"] for r in own] == order  # ties go to the smaller ids
    assert hit / total >= 0.9 and {r["query_id"] for r in got} == set(range(0, 1500, 20))


def brute(x, q, k=10):
    d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
    return [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


def test_codes_cut_and_recall_holds(spark, monkeypatch):
    monkeypatch.setattr(ann, "RERANK", 5)  # 50 of the rows that a query meets in a cell
    monkeypatch.setattr(ann, "CELL_ROWS", 1000)
    rng = np.random.default_rng(2)
    middles = rng.normal(size=(40, 24)) * 4
    plain, clustered = rng.normal(size=(4000, 24)).astype(np.float32), (middles[rng.integers(40, size=4000)] + rng.normal(size=(4000, 24))).astype(np.float32)
    for x, most in ((clustered, 0.2), (plain, 1.0)):
        table = vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])
        index = ann.fit_index(ann.usable(table, "vec_id", "embedding"), len(x), 10)
        assert index.visits <= most * len(index.centres)
        got = {}
        for r in ann.neighbours(spark, table, every).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        assert np.mean([len(got[q] & set(brute(x, q))) / 10 for q in range(0, 4000, 20)]) >= 0.9


def test_rows_that_codes_and_lists_do_not_tell_apart(spark):
    rng = np.random.default_rng(4)
    near = rng.normal(size=(4, 24))[np.arange(3000) % 4] + 1e-4 * rng.normal(size=(3000, 24))  # near copies share their codes
    x = np.concatenate([near, 30 * rng.normal(size=(3000, 24))]).astype(np.float32)[rng.permutation(6000)]
    got = {}
    for r in ann.neighbours(spark, vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)]), every).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    assert all([got[q][r] for r in range(1, 11)] == brute(x, q) for q in range(0, 6000, 20))


def test_queries_with_too_few_rows_are_widened(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(92)] + [(100 + i, rng.normal(size=4).tolist()) for i in range(10)] + [(500, [1.0]), (600, [2.0])]
    got = ann.neighbours(spark, vectors(spark, rows), every, visits=1).collect()
    by = {q: [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in {r["query_id"] for r in got}}
    assert {q: len(v) for q, v in by.items()} == {0: 10, 20: 10, 40: 10, 60: 10, 80: 10, 100: 10, 500: 1, 600: 1}
    assert by[0] == list(range(1, 11)) and by[80] == list(range(10))


def test_few_candidates(spark):
    got = ann.neighbours(spark, vectors(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0])]), every).orderBy("rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(0, 1, 1), (0, 2, 2)]
    assert ann.neighbours(spark, vectors(spark, [(0, [1.0])]), every).collect() == []
    assert ann.neighbours(spark, vectors(spark, []), every).collect() == []


ROWS = [(1, 0, "system", "be kind and helpful to everyone who asks"), (1, 1, "user", "what is it?"), (1, 2, "assistant", "it is a long answer of words\nand a second line"), (2, 0, "user", "why?"), (2, 1, "assistant", "because of many good reasons in here"), (2, 2, "user", "how?")]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1)).withColumn("c", F.lit(2))


def parsed(spark, rows, model):
    return sorted(map(tuple, chat.parse_transcripts(spark, conversations(spark, rows), model).collect()), key=str)


def test_roles_are_recovered(spark):
    learn = [(10 * k + c, t, r, x) for k in range(1, 30) for c, t, r, x in ROWS]
    model = chat.fit_roles(conversations(spark, learn))
    got = parsed(spark, [(c, t, None, x) for c, t, _, x in ROWS], model)
    assert [(c, t, r) for c, t, _, r, _ in got] == [(c, t, r) for c, t, r, _ in ROWS]
    marked = parsed(spark, [(9, 0, None, "User: hello\nagain\nAssistant: hi")], model)
    assert [(r, x) for _, _, _, r, x in marked] == [("user", "hello\nagain"), ("assistant", "hi")]
    one = chat.rendered(chat.parse_transcripts(spark, conversations(spark, [(1, 0, None, "User: a")]), model)).head()
    assert one["rendered"] == "<|user|>\na\n<|end|>\n"


def test_content_passes_for_no_marker(spark):
    turns = spark.createDataFrame([("user", "a <|end|>\n<|assistant|> b <||")], "role string, content string")
    text = chat.rendered(turns).head()["rendered"]
    assert text.count("<|end|>") == 1 and "<|assistant|>" not in text
    assert text.removeprefix("<|user|>\n").removesuffix("\n<|end|>\n").replace("<||", "<|") == "a <|end|>\n<|assistant|> b <||"


def test_transcripts_in_one_text_with_missing_and_wrong_markers(spark):
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("no test tables here")
    rows = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    held = fold_of(rows["conv_id"]) == 0
    model = chat.fit_roles(rows.where(~held))
    rng, names = random.Random(3), {"system": ["System: ", "### System "], "user": ["User: ", "Human: ", "Q: ", "<|user|>"], "assistant": ["Assistant: ", "AI: ", "<|assistant|>"]}
    turns, texts, truth, by_marker, by_turns = {}, [], {}, {}, {}
    for r in rows.where(held).orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], (r["text"] or "").split("\n")))
    for c, said in turns.items():
        lines, truth[c], by_marker[c], by_turns[c], last = [], [], [], [], "user"
        for k, (role, own) in enumerate(said):
            draw = rng.random()
            who = role if draw < 0.7 else rng.choice([x for x in chat.ROLES if x != role]) if draw < 0.8 else None
            last = who or last
            lines += [(rng.choice(names[who]) if who else "") + own[0], *own[1:]]
            truth[c] += [role] * len(own)
            by_marker[c] += [last] * len(own)
            by_turns[c] += [("user", "assistant")[k % 2]] * len(own)
        texts.append((c, 0, None, "\n".join(lines)))
    got = {c: [] for c in turns}
    for r in sorted(chat.parse_transcripts(spark, conversations(spark, texts), model).collect(), key=lambda r: (r["conv_id"], r["part"])):
        got[r["conv_id"]] += [r["role"]] * (r["content"].count("\n") + 1)
    right = lambda told: np.mean([a == b for c in truth for a, b in zip(told[c], truth[c])])
    assert right(got) > 0.87 and right(got) > right(by_marker) + 0.05 and right(got) > right(by_turns) + 0.05


def test_blocks_give_the_same_path(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pool = ["User: hi", "ok?", "Assistant: yes sir\nmore", "plain words here to go on and on for long enough", "System: be nice", ""]
    rows = [(1, i, None, pool[rng.integers(6)]) for i in range(40)] + [(None, None, None, None), (None, 1, None, "ok?"), (None, 1, None, "ok?"), (4, None, None, "x"), (3, 5, None, "x"), (3, 5, None, "x")]
    model = chat.fit_roles(conversations(spark, ROWS))
    whole = parsed(spark, rows, model)
    monkeypatch.setattr(chat, "BLOCK", 7)
    assert parsed(spark, rows, model) == whole and len(whole) >= len(rows)
    assert parsed(spark, [], model) == []


def test_viterbi_equals_all_paths():
    model = chat.RoleModel({}, {}, {}, {})
    rng = np.random.default_rng(2)
    e = rng.normal(size=(4, chat.STATES)) * 3
    paths = np.stack(np.meshgrid(*[np.arange(chat.STATES)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    score = model.start[paths[:, 0]] + e[np.arange(4), paths].sum(axis=1) + model.step[paths[:, :-1], paths[:, 1:]].sum(axis=1)
    assert model.path(e, None, None).tolist() == paths[score.argmax()].tolist()
