"""Language, toxicity, language-model scores, subwords and token counts against plain versions, libraries and held-out rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpus import backoff, documents, frame, prose
from talentloom.llm import language_id, lm_score, sentencepiece_trie, token_counts, toxicity

FOLDER = "/root/testdata/sf0.01"


def test_languages_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = language_id.languages(docs).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.where("held_out")
    assert held.count() > 200 and held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert found.where("rejected").count() <= 0.01 * found.count()
    assert found.where("score < 0 or score > 1").count() == 0


def test_language_of_awkward_rows(spark):
    df = frame(spark)
    rows = language_id.languages(df).collect()
    assert len(rows) == df.count()
    for row in rows:
        bare = row["doc_id"] in (1, 2, 3, 14)
        assert (row["lang_pred"] == "und") == bare and (row["score"] == 0.0) == bare and (not bare or row["rejected"])
        assert row["lang_pred"] in ("und", "en")
    left = language_id.without_rejected(df)
    assert left.columns == df.columns and left.where("doc_id in (1, 2, 3, 14)").count() == 0
    assert language_id.languages(frame(spark, [])).count() == 0
    unlabelled = language_id.languages(df.withColumn("lang", F.lit(None).cast("string")))
    assert {x["lang_pred"] for x in unlabelled.collect()} == {"und"}


def test_language_model_learns_and_calibrates():
    r = random.Random(4)
    subwords = lambda w: language_id.buckets([w])[0]
    rows = [(subwords(w), k) for k, stems in enumerate((["ung", "heit"], ["ment", "eau"])) for w in (r.choice(stems) + r.choice(stems) for _ in range(200))]
    sizes = np.array([len(x) for x, _ in rows])
    model = language_id.fit(np.concatenate([x for x, _ in rows]), sizes, np.array([k for _, k in rows]), ["de", "fr"])
    p = model.probabilities(np.stack([model.scores[subwords(w)].mean(axis=0) for w in ("heitung", "eaument")]))
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9 and 0 <= model.bar <= 0.75


def test_buckets_of_words_do_not_hang_on_their_neighbours():
    words = ["Straße,", "a", "", "123", "niño's", "the"]
    values, place = language_id.buckets(words)
    for k, w in enumerate(words):
        assert sorted(values[place == k]) == sorted(language_id.buckets([w])[0])
    assert not (place == 2).any() and not (place == 3).any() and len(language_id.buckets([])[0]) == 0


def test_toxic_documents_of_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out")
    caught = found.where("toxic = 1").agg(F.avg("predicted")).first()[0]
    wrong = found.where("toxic = 0").agg(F.avg("predicted")).first()[0]
    assert caught >= 0.85 and wrong <= 0.01


def test_toxicity_of_awkward_rows(spark):
    df = frame(spark)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(20)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.5) for x in rows)
    none = toxicity.toxicity(df, labels.where("false")).collect()
    assert {x["score"] for x in none} == {0.0}
    assert toxicity.toxicity(frame(spark, []), labels).count() == 0


def test_trees_and_isotonic_fit():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.5) & (x[:, 1] < 0.3)).astype(float)
    trees = toxicity.Trees().fit(x, y)
    assert ((trees.logits(x) > 0) == (y > 0)).mean() > 0.97
    at, value = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 2.0, 5.0]), np.array([1.0, 0.0, 1.0, 0.0, 1.0]))
    assert (np.diff(at) >= 0).all() and (np.diff(value) >= 0).all() and 0 < value[0] < value[-1] < 1


def test_features_see_hidden_words_and_second_persons():
    kinds = toxicity.WordKinds(frozenset({"idiot"}), frozenset())
    x = dict(zip(toxicity.FEATURES, toxicity.features("You are an id1ot! IDIOT, really??", kinds)))
    assert x["n_sure"] == 1 and x["hidden"] > 0 and x["n_close"] == 2 and x["shouted"] > 0 and x["runs"] > 0
    assert toxicity.features(None, kinds) == toxicity.features(" ", kinds) == [0.0] * len(toxicity.FEATURES)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_backoff_scores_equal_plain_counts(spark, order, monkeypatch):
    monkeypatch.setattr(lm_score, "SEGMENT_BYTES", 20_000)
    rows = [r for r in documents() if r[0] not in (5,)]
    got = sorted((x["n_words"], x["n_backed_off"], round(x["log_score"], 6)) for x in lm_score.backoff_scores(frame(spark, rows), order).collect())
    assert got == sorted((n, k, round(s, 6)) for n, k, s in backoff([r[1] for r in rows], order))
    assert lm_score.backoff_scores(frame(spark, [])).count() == 0


def test_usual_pairs_in_unusual_order_score_lower(spark):
    rows = [(1, "a b c"), (2, "a b e"), (3, "a b c"), (4, "a b c"), (5, "d b e"), (6, "d b e")]
    got = {x["id"]: x for x in lm_score.backoff_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["log_score"] > got[2]["log_score"] + 0.1  # words and pairs alone give both the same
    plain = backoff([t for _, t in rows], 3)
    assert [(got[i]["n_words"], got[i]["n_backed_off"], round(got[i]["log_score"], 6)) for i, _ in rows] == [(n, k, round(s, 6)) for n, k, s in plain]


def test_each_round_of_lengths_is_stored_before_the_next(spark, monkeypatch):
    """Requests of all lengths lay on disk at once."""
    steps, real = [], lm_score.stored
    monkeypatch.setattr(lm_score, "stored", lambda df: steps.append(df.columns) or real(df))
    texts = ["a b c d e", "a b c d f", "x a b c", "", None, "a a a a a a"]
    got = {x["id"]: x for x in lm_score.backoff_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 4).collect()}
    assert ["totals" in c for c in steps] == [True, True, True, False]
    assert [(got[i]["n_words"], got[i]["n_backed_off"], round(got[i]["log_score"], 6)) for i in range(len(texts))] == [
        (n, k, round(s, 6)) for n, k, s in backoff(texts, 4)]


def random_text(r, n):
    return "".join(r.choice(" aab'st  \n\t.,1é日 re'll▁😀") for _ in range(n))


def test_pieces_equal_the_library():
    import sentencepiece

    vocabulary = sentencepiece_trie.Vocabulary.load()
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.MODEL)
    r = random.Random(3)
    texts = [random_text(r, r.randint(0, 80)) for _ in range(800)] + ["a" * 400, "   " * 30, " x", "x ", "\n\n", "", "the in" * 40] + [prose(9, 300)]
    cut, encoder = sentencepiece_trie.cutter(vocabulary), sentencepiece_trie.Encoder(vocabulary)
    words = sorted({w for t in texts for w in cut.findall(sentencepiece_trie.marked(t))})
    ids = dict(zip(words, encoder.encode(words)))
    for t in texts:
        got = [i for w in cut.findall(sentencepiece_trie.marked(t)) for i in ids[w]]
        assert got == library.encode(t), t
        assert sentencepiece_trie.spell(got, vocabulary.bytes) == t.replace("▁", " ")


def test_unigram_paths_are_best():
    pieces = ["<unk>", "▁", "a", "b", "ab", "ba", "▁ab", "aba"]
    scores = [0.0, -2.0, -3.0, -3.0, -4.0, -4.5, -5.5, -6.5]
    vocabulary = sentencepiece_trie.Vocabulary(pieces, scores, "unigram", {}, set(), 0)

    def best(word):
        table = {0: 0.0}
        for end in range(1, len(word) + 1):
            table[end] = max((table[k] + scores[pieces.index(word[k:end])] for k in range(end) if word[k:end] in pieces), default=-99)
        return table[len(word)]

    words = sorted({"▁" + "".join(random.Random(k).choice("ab") for _ in range(1 + k % 9)) for k in range(80)})
    for word, ids in zip(words, sentencepiece_trie.Encoder(vocabulary).encode(words)):
        assert "".join(pieces[i] for i in ids) == word and abs(sum(scores[i] for i in ids) - best(word)) < 1e-9


def test_round_trip_of_awkward_rows(spark):
    import sentencepiece

    df = frame(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_trie.MODEL)
    rows = sentencepiece_trie.round_trip(df).collect()
    want = sorted((d[0] or -1, library.encode(d[1]) if d[1] is not None else []) for d in documents())
    assert sorted((x["doc_id"] or -1, x["ids"] or []) for x in rows) == want
    assert all(x["round_trip"] and x["n_pieces"] == max(0, len(x["ids"] or [])) for x in rows)
    assert [x["ids"] for x in rows if x["doc_id"] == 1] == [None]
    assert sentencepiece_trie.round_trip(frame(spark, [])).count() == 0


def test_edits_count_as_a_whole_recount():
    counter, r = token_counts.Counter(token_counts.read_ranks()), random.Random(5)
    again = whole = 0
    for n in range(600):
        text = prose(n, 400) if n % 3 == 0 else random_text(r, r.randint(0, 900))
        tree = token_counts.Tree.of(text, counter)
        for _ in range(r.randint(1, 5)):
            low = r.randint(0, len(text))
            high = min(len(text), low + r.choice([0, 0, 1, 3, 40, 400]))
            text, tree, counted = token_counts.apply_edit(text, tree, low, high, random_text(r, r.choice([0, 1, 2, 10, 300])), counter)
            assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.chars[1] == len(text)
            again, whole = again + counted, whole + len(text)
    assert again < whole


def test_counts_after_masking(spark):
    df = frame(spark, documents() + [(700, "Mail jo.do@ex-ample.org or +1 (436) 555-8670 now. " * 60, "en", "s", 0, 3, "x", "y", 0.5, "z", "k", 9)])
    counter = token_counts.Counter(token_counts.read_ranks())
    rows = token_counts.count_rows(token_counts.edited(token_counts.token_trees(df), token_counts.mask_private)).collect()
    want = []
    for i, text, *_ in df.collect():
        new = text or ""
        edits = token_counts.mask_private(new)
        for low, high, put in sorted(edits, reverse=True):
            new = new[:low] + put + new[high:]
        count = lambda t: len(counter.encoding.encode_ordinary(t))
        want.append((i or -1, len(edits), count(text or ""), count(new), len(new)))
    assert sorted((x["doc_id"] or -1, x["n_edits"], x["n_tokens_before"], x["n_tokens"], x["n_chars"]) for x in rows) == sorted(want)
    assert [x["n_edits"] for x in rows if x["doc_id"] == 700] == [120]
    assert token_counts.token_trees(frame(spark, [])).count() == 0
