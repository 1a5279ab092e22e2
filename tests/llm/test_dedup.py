"""MinHash, suffix-array and embedding deduplication against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import documents, frame, near_groups, prose, repeats, union_find
from talentloom.llm import embedding_dedup, minhash_dedup, suffix_dedup
from talentloom.llm.common import components


def test_components_follow_long_paths_and_hubs(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(60)] + [(5, 5)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    assert got == union_find(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(seed):
    """A group of many near copies, a chain, and texts that share a passage."""
    r, rows = random.Random(seed), []
    base = prose(seed, 80).split()
    for k in range(40):
        words = list(base)
        words[r.randrange(80)] = f"w{k}"
        rows.append((k, " ".join(words)))
    chain = prose(seed + 1, 60).split()
    for k in range(12):
        chain[r.randrange(60)] = f"c{k}"
        rows.append((100 + k, " ".join(chain)))
    rows += [(200 + k, prose(seed + 2, 20) + " " + prose(seed + 10 + k, 12 + k)) for k in range(20)]
    return rows + [(300 + k, " ".join(prose(seed + 3, 6).split()[: 2 + k % 4])) for k in range(8)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_equal_all_pairs(spark, size):
    rows = copies(5) + [(i + 1000 if i is not None else 999, t) for i, t, *_ in documents() if t is None or len(t) < 20_000]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(x) for x in minhash_dedup.component_rows(minhash_dedup.near_duplicates(df, words=size)).collect()]
    sizes, root = near_groups(rows, size)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[root[k]] = min(low.get(root[k], i), i)
    want = [(i, sizes[k], low[root[k]], i == low[root[k]]) for k, (i, _) in enumerate(rows)]
    assert sorted(got) == sorted(want)


def test_one_document_of_each_group_stays(spark):
    df = frame(spark)
    left = minhash_dedup.without_copies(df)
    assert left.columns == df.columns
    ids = sorted((x["doc_id"] or 0 for x in left.collect()))
    assert ids.count(4) == 1 and 8 not in ids and 7 in ids and 10 not in ids and {1, 2, 3, 5, 9}.issubset(ids)
    assert minhash_dedup.without_copies(frame(spark, [])).count() == 0


def test_removed_bytes_equal_plain_search(spark):
    rows = documents() + [(500 + i, t, None, "s", 0, *(3, "x", "y", 0.5, "z", "k", 9)) for i, t in copies(3)]
    got = sorted(tuple(x)[1:] for x in suffix_dedup.span_digest(suffix_dedup.repeated_spans(frame(spark, rows))).collect())
    assert got == sorted(repeats([r[1] for r in rows]))
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_crowded_anchors_are_counted_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", 3)
    passage = prose(50, 60)
    rows = [(k, prose(60 + k, 20) + passage + prose(90 + k, 20)) for k in range(12)] + [(99, "Of " * 150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(x)[1:] for x in suffix_dedup.span_digest(suffix_dedup.repeated_spans(df)).collect())
    assert got == sorted(repeats([t for _, t in rows]))


def test_long_texts_come_in_slices(monkeypatch, spark):
    monkeypatch.setattr(suffix_dedup, "SHEET", 700)
    rows = [(k, prose(70, 400)[k * 13 :] + prose(80 + k, 50)) for k in range(4)]
    texts = [t.encode() for _, t in rows]
    whole = {}
    for number, low, high, anchor, _ in suffix_dedup.sheets(texts, 200):
        for n, a, b, x in zip(number, low, high, anchor):
            whole.update({(n, k): x for k in range(a, b)})
    assert len(whole) == sum(len(t) - 199 for t in texts)
    same = {}
    for (n, k), x in whole.items():
        assert same.setdefault(texts[n][k : k + 200], x) == x


def test_run_index_streams_matching_statistics():
    r = random.Random(2)
    for _ in range(30):
        texts = [bytes(r.choice(b"ab") for _ in range(r.randint(1, 60))) for _ in range(r.randint(1, 6))]
        index = suffix_dedup.RunIndex(texts)
        got = index.matching()
        for t, start in zip(texts, index.starts.tolist()):
            for k in range(len(t)):
                most = 0
                for n, u in enumerate(texts):
                    for j in range(len(u)):
                        if (index.starts[n] + j) != start + k:
                            m = 0
                            while k + m < len(t) and j + m < len(u) and t[k + m] == u[j + m]:
                                m += 1
                            most = max(most, m)
                assert got[start + k] == most


def test_removed_letters_stay_whole(spark):
    df = frame(spark)
    left = suffix_dedup.without_repeats(df)
    assert left.columns == df.columns and left.count() == df.count()
    assert {x["text"] for x in left.where("doc_id in (7, 8)").collect()} == {""}
    assert left.where("doc_id = 9").first()["text"] != prose(2, 120)


def vectors(seed=0):
    r = np.random.default_rng(seed)
    base = r.normal(size=(6, 16))
    rows = [b + 0.2 * r.normal(size=16) for b in base for _ in range(25)] + list(r.normal(size=(150, 16)))
    rows += [rows[0], rows[0], 3 * rows[1]]
    return [(k, [float(v) for v in x], 1) for k, x in enumerate(rows)]


def test_linked_vectors_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    rows = vectors()
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] + [1.0] * 15, 1), (1003, [1.0] * 15 + [None], 1), (1004, [1.0, 2.0], 2), (1005, [], 1),
           (1006, [float("inf")] + [1.0] * 15, 1), (1007, [2.0, 4.0], 2), (1007, [2.0, 4.0], 2)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")
    got = sorted(tuple(x) for x in embedding_dedup.linked_vectors(df).collect())
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = x @ x.T >= 0.9
    np.fill_diagonal(linked, False)
    root = union_find(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(linked))])
    want = [(k, int(linked[k].sum()), root[k], root[k] == k) for k in range(len(x))]
    want += [(i, 0, i, True) for i in (1000, 1001, 1002, 1003, 1005, 1006)] + [(1004, 2, 1004, True)] + [(1007, 2, 1004, False)] * 2
    assert got == sorted(want)


def test_crowds_of_many_shards_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 20)
    monkeypatch.setattr(embedding_dedup, "CHUNK_BYTES", 40_000)
    r = np.random.default_rng(4)
    tight, wide, chain = r.normal(size=(3, 16)), r.normal(size=16), np.linspace(0, 3, 60)
    x = np.concatenate([tight[0] + 0.1 * r.normal(size=(700, 16)), wide + 0.33 * r.normal(size=(500, 16)),
                        np.stack([np.cos(chain), np.sin(chain)], axis=1) @ tight[1:], r.normal(size=(200, 16))])
    df = spark.createDataFrame([(k, [float(v) for v in y]) for k, y in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(y) for y in embedding_dedup.linked_vectors(df).collect())
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    root = union_find(range(len(x)), [(int(a), int(b)) for a, b in zip(*np.nonzero(near))])
    assert got == [(k, int(near[k].sum()), root[k], root[k] == k) for k in range(len(x))]


def test_audit_refuses_lost_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    search = embedding_dedup._searched

    def losing(*args):
        run = search(*args)
        return lambda batches: (b.slice(0, b.num_rows // 2) for b in run(batches))

    monkeypatch.setattr(embedding_dedup, "_searched", losing)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int")
    with pytest.raises(RuntimeError, match="audit"):
        embedding_dedup.linked_vectors(df)


def test_vectors_none_or_no_good_ones(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.linked_vectors(spark.createDataFrame([], schema)).count() == 0
    assert [tuple(x) for x in embedding_dedup.linked_vectors(spark.createDataFrame([(1, None, 0)], schema)).collect()] == [(1, 0, 1, True)]
    same = spark.createDataFrame([(k, [1.0, 0.5], 0) for k in (3, 2, 9)], schema)
    assert sorted(tuple(x) for x in embedding_dedup.linked_vectors(same).collect()) == [(2, 2, 2, True), (3, 2, 2, False), (9, 2, 2, False)]


def test_search_recall_on_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").alias("rep"), F.col("embedding").cast("array<double>").alias("vector"))
    pairs, recall = embedding_dedup.links(rows, 0.5)
    x = embedding_dedup.unit(np.array([r["vector"] for r in rows.orderBy("rep").collect()]))
    truth = int((x @ x.T >= 0.5).sum()) - len(x)
    assert pairs.count() >= 0.9 * truth and recall >= 0.9
