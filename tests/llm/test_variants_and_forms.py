"""Spelling variants, fill-in-middle rows and chat formatting against plain versions and exact round trips."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from corpus import documents, frame, prose
from talentloom.llm import chat_template, fill_in_middle, gram_index, queries

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


# --- spelling variants ------------------------------------------------------------------------------------------------------------------------------

def plain_variants(rows, least=5, ratio=5, slip=199):
    n = Counter()
    for key, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 6
    n = {w: c for w, c in n.items() if c >= least}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in n:
        for k in range(len(w)):
            gaps[w[:k], w[k + 1 :]].add(w)
    for (a, b), same in gaps.items():
        same = same | ({a + b} & n.keys())
        for w in same:
            near[w] |= same - {w}
    near = {w: {o for o in others if abs(len(o) - len(w)) < 2} for w, others in near.items()}
    form = {}
    for w in n:
        if near.get(w):
            best = min(near[w], key=lambda o: (-n[o], o))
            if n[best] >= ratio * n[w]:
                form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near.get(w, ())), n[form[w]] if w in form else None))
    return out


def variant_rows(df):
    return [(x["word"], x["form"], x["root"], x["n"], x["n_near"], x["form_n"]) for x in df.collect()]


def test_variants_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = variant_rows(queries.op11_spelling_variants(spark, "/root/testdata/sf0.01"))
    want = plain_variants([tuple(x) for x in docs.select("doc_id", "text").collect()])
    assert len(got) == len(want) and set(got) == want and len([x for x in want if x[1]]) > 300


def test_variants_of_awkward_rows(spark):
    r = random.Random(5)
    stem = "organisation"
    spoilt = [stem[:k] + c + stem[k + d :] for k in range(12) for c, d in (("", 1), ("x", 1), ("y", 0), ("é", 0))]
    texts = [" ".join([stem] * 700 + ["Organisations"] * 130), None, "", "ORGANISATION ÄRGERNIS ärgernis " * 40, "a" * 3000 + " " + "日本".join(["bbbbbbb"] * 9)]
    texts += [" ".join(r.choice(spoilt) for _ in range(60)) for _ in range(12)] + ["a" * 3000 + " b" + "a" * 2999] * 6 + ["ab" * 3 + "×÷ éééééé ééééé " * 6]
    rows = [(k % 9 or None, t, None, None, None, 3, "x", "y", 0.5, "z", "k", 9) for k, t in enumerate(texts)]
    df = frame(spark, rows * 2)  # every row stands twice
    got = variant_rows(gram_index.spelling_variants(df))
    want = plain_variants([x[:2] for x in rows * 2])
    assert len(got) == len(want) and set(got) == want and sum(x[4] for x in want) > 50
    assert gram_index.spelling_variants(frame(spark, [])).count() == 0
    assert gram_index.near_words(spark.createDataFrame([(None, 5), ("abc", 5)], "word string, n long")).count() == 0


def test_split_lists_and_long_grams_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(gram_index, "LIST_PART", 3)
    monkeypatch.setattr(gram_index, "SAMPLE", 200)
    r = random.Random(8)
    words = sorted({"".join(r.choice("abc") for _ in range(r.randint(6, 9))) for _ in range(3000)})
    table = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    got = [(x["word"], x["other"]) for x in gram_index.near_words(table).collect()]
    want = set()
    for w in words:
        for k in range(len(w) + 1):
            for c in "abc":
                want |= {frozenset((w, o)) for o in (w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]) if o != w and o in set_of(words)}
    assert len(got) == len(want) and {frozenset(p) for p in got} == want


def test_no_list_is_broadcast(spark, monkeypatch):
    plans = []
    keep = gram_index.stored
    monkeypatch.setattr(gram_index, "stored", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    rows = [(k, " ".join(w for w in ("organisation", "organisatoin", "organisatio", "organisation") for _ in range(6 + k)), None, None, None, 3, "x", "y", 0.5, "z", "k", 9) for k in range(4)]
    out = gram_index.spelling_variants(frame(spark, rows), ratio=2)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 4 and not any("Broadcast" in p for p in plans)
    assert set(variant_rows(out)) == plain_variants([x[:2] for x in rows], ratio=2)


def set_of(words, held={}):  # noqa: B006
    return held.setdefault(id(words), set(words))


def test_grams_hang_on_their_own_characters_and_the_bound_holds():
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(6, 14))) for _ in range(300)]
    hashes = np.concatenate([h[inside] for _, c, s in gram_index.matrices(words) for _, h, inside in gram_index.windows(c, s, 5)])
    found, n = np.unique(hashes, return_counts=True)
    frequent = found[n > 12]

    def grams(word):
        (_, codes, sizes), = gram_index.matrices([word])
        g, lengths = gram_index.grams_of(codes, sizes, frequent)
        bound = gram_index.affected(lengths)[0]
        return Counter(g[0][lengths[0] > 0].tolist()), bound, lengths[0]

    for word in words:
        mine, bound, lengths = grams(word)
        assert sum(mine.values()) == len(word) + 1 and lengths.max() <= 6 and bound < sum(mine.values())
        for k in range(len(word)):
            for edit in (word[:k] + word[k + 1 :], word[:k] + "d" + word[k:], word[:k] + "e" + word[k + 1 :]):
                other, _, _ = grams(edit)
                assert sum((mine & other).values()) >= sum(mine.values()) - bound


# --- fill in middle ---------------------------------------------------------------------------------------------------------------------------------

def plain_rows(rows, unit="token"):
    out = []
    for key, text in rows:
        text = text or ""
        units = {"token": re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text), "char": list(text)}[unit]
        digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
        h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
        a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 50:
            out.append((key, len(units), "plain", None, None, text, text))
        elif h[3] % 100 < 80:
            out.append((key, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text))
        else:
            out.append((key, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text))
    return out


AWKWARD = [None, "", " ", "\n\t x", "x", "日本 語 é 😀a😀", "<P>", "a <S> b", "<M", "< P>", "\x00 \x1f\x0b\x0c", "🙂" * 50, " ".join(["é", "😀😀", "a"] * 400), "퟿ <S" * 9]


@pytest.mark.parametrize("unit", ["token", "char"])
def test_forms_of_awkward_rows(spark, unit):
    rows = [(k, t) for k in [None, *range(40)] for t in AWKWARD] + [(r[0], r[1]) for r in documents()] * 2
    df = frame(spark, [(*r, None, None, None, 3, "x", "y", 0.5, "z", "k", 9) for r in rows])
    made = fill_in_middle.fill_in_middle(df, unit)
    back = made.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output")))
    got = [tuple(x) for x in back.collect()]
    assert sorted(got, key=repr) == sorted(plain_rows(rows, unit), key=repr)
    assert {x[2] for x in got} == {"plain", "spm", "psm"}
    assert fill_in_middle.fill_in_middle(frame(spark, [])).count() == 0


def test_cuts_in_bytes_fall_between_characters(spark):
    df = frame(spark, [(k, "😀é" * 30 + "a", *documents()[0][2:]) for k in range(60)])
    made = fill_in_middle.fill_in_middle(df, "byte", rate=100, suffix_first=50)
    rows = made.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect()
    assert all(x["back"] == "😀é" * 30 + "a" and x["n_units"] == 181 and x["prefix_chars"] + x["middle_chars"] <= 61 for x in rows)
    assert len({x["prefix_chars"] for x in rows}) > 20 and {x["form"] for x in rows} == {"psm", "spm"}
    with pytest.raises(ValueError, match="unit"):
        fill_in_middle.fill_in_middle(df, "line")


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("a \néß日😀𝔸ÿĀ"), max_size=60))
def test_index_of_exceptions_converts_every_place(text):
    index = fill_in_middle.Exceptions(np.frombuffer(text.encode(), np.uint8))
    places = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert index.chars == len(text) and len(index.places) == sum(not c.isascii() for c in text)
    assert index.to_bytes(np.arange(len(text) + 1)).tolist() == places.tolist()
    every = np.arange(places[-1] + 1)
    assert index.to_chars(every).tolist() == (np.searchsorted(places, every, "right") - 1).tolist()


def test_twin_of_null_ids_and_texts(spark, tmp_path):
    docs = frame(spark, [(*r[:2], *documents()[0][2:]) for r in [(None, "a b c d"), (3, None), (5, ""), *[(k, t) for k, t in enumerate(AWKWARD) if t and "\x00" not in t]]])
    docs.select("doc_id", "text").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(x) for x in queries.op12_fill_in_middle(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(got, key=repr) == sorted(con.execute(fill_in_middle.SQL).fetchall(), key=repr)


# --- chat formatting --------------------------------------------------------------------------------------------------------------------------------

def render(source, **names):
    return chat_template.Template(source).render(**names)


def test_the_language():
    people = [{"role": "user", "text": " a "}, {"role": "assistant", "text": "b"}]
    assert render("{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", ms=people)[0] == "1,2"
    assert render("{% for m in ms %}{% if m.role == 'user' and loop.first %}U{% elif m.role in 'assistant' %}A{% else %}?{% endif %}{% endfor %}", ms=people)[0] == "UA"
    assert render("x {{- m.text | trim | upper ~ 1 + 2 -}} y", m=people[0])[0] == "xA3y"
    assert render("{% set k = 'a\\'b\\n' %}{{ k }}{# gone #}{{ none }}{{ true }}", k=1)[0] == "a'b\ntrue"
    assert render("{{ 7 % 4 }}{{ 'b' not in 'abc' }}{{ 2 >= 2 or x }}{{ m.absent }}", m={})[0] == "3falsetrue"
    text, spans = render("{% for m in ms %}[{% generation %}{{ m.text }}{% endgeneration %}]{% endfor %}", ms=people)
    assert text == "[ a ][b]" and [text[a:b] for a, b in spans] == [" a ", "b"]
    inner, _ = render("{% for m in ms %}{% set last = m.text %}{% for k in ks %}{{ loop.index0 }}{% endfor %}{{ loop.index }}{% endfor %}", ms=people, ks=[1, 2])
    assert inner == "011012"


def test_constants_fold():
    tree = chat_template.fold(chat_template.parse("a{{ 'b' ~ 1 + 1 }}{% if 1 == 2 %}c{% else %}d{% endif %}{{ 'E' | lower }}{% if x or true %}f{% endif %}"))
    assert tree == ("list", (("text", "ab2de"), ("if", ("binary", "or", ("name", "x"), ("value", True)), ("list", (("text", "f"),)), ("list", ()))))
    assert chat_template.Template("{{ 'a' + 'b' }}").tree == ("list", (("text", "ab"),))


@pytest.mark.parametrize("source", [
    "{% for m in ms %}", "{{ m.__class__ }}", "{{ m._x }}", "{{ f(1) }}", "{{ m['a'] }}", "{% import os %}", "{{ 1 +", "{{ 'a }}", "{{ x | unknown }}", "{{ 1 + 'a' }}",
    "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{% endif %}", "{{ (1 }}", "{% set x 1 %}", "{{ }}", "{{ 5 % 0 }}"])
def test_what_is_not_in_the_language_is_refused(source):
    with pytest.raises(chat_template.TemplateError):
        chat_template.Template(source)


def test_values_that_do_not_fit_are_refused():
    for source, names in (("{{ x }}", {}), ("{{ x.y }}", {"x": "text"}), ("{{ x.upper }}", {"x": str}), ("{% for k in x %}{% endfor %}", {"x": "text"}),
                          ("{% for k in x %}{% endfor %}", {"x": 5}), ("{{ x < 'a' }}", {"x": 1}), ("{{ 'a' in x }}", {"x": 3})):
        with pytest.raises(chat_template.TemplateError):
            render(source, **names)
    once = chat_template.Template("{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}")
    with pytest.raises(chat_template.TemplateError, match="once"):
        list(once.pieces(messages=chat_template._Once(iter([]))))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*chat_template.CONTROL, "\\", "<", "<<", "[", "/", "s>", "INST]", "a", " ", "\n", "é", "<\\s>", "[\\\\INST]"]), max_size=12).map("".join),
       st.sampled_from(["system", "user", "assistant", "tool", "", "[TEXT]"]))
def test_escapes_are_exact(text, role):
    guarded = chat_template.GUARD.guarded(text)
    assert not any(c in guarded for c in chat_template.CONTROL) and chat_template.GUARD.plain(guarded) == text
    template = chat_template.Template(chat_template.CHAT, {**chat_template.FILTERS, "guard": chat_template.GUARD.guarded})
    made, spans = template.render(messages=[{"role": role, "text": text}, {"role": "user", "text": text}])
    assert list(chat_template.turns_of(made)) == [(role, text), ("user", text)]
    assert [chat_template.GUARD.plain(made[a:b]) for a, b in spans] == [text] * (role == "assistant")


def plain_conversations(rows):
    held = defaultdict(list)
    for key, turn, role, text in rows:
        held[key].append((turn, role, text))
    out = []
    for key, turns in held.items():
        turns.sort(key=lambda t: [(v is not None, v if v is not None else 0) if k == 0 else (v is not None, v or "") for k, v in enumerate(t)])
        said = [(r or "", t or "") for _, r, t in turns]
        loss = "".join(t for r, t in said if r == "assistant")
        out.append((key, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_conversations_of_awkward_rows(spark):
    trial = chat_template.TRIAL_TEXT
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, None, "system", None), (2, 0, None, "x"), (2, 0, "tool", trial), (None, 5, "user", "n"),
            (None, 4, "assistant", trial), (3, 0, "assistant", ""), (4, 0, "user", prose(3, 30_000)), (4, 1, "assistant", "\\<s>日本😀"), (5, 2, "user", "<\\s>"), (5, 2, "user", None)]
    rows += [(6, k, "assistant" if k % 2 else "user", f"{trial} {k}") for k in range(300)]
    table = spark.createDataFrame([(*r, 7, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, part long, id string, loss string").repartition(4)
    want = plain_conversations(rows)
    for most in (4_000_000, 200):  # parts of a conversation read back alike
        made = chat_template.formatted(table, part_chars=most)
        got = chat_template.read_back(made).collect()
        assert sorted([tuple(x)[:5] for x in got], key=repr) == want
        sizes = {x["id"]: x["n"] for x in made.groupBy("id").agg(F.sum(F.char_length("text")).alias("n")).collect()}
        assert {x["id"]: x["formatted_chars"] for x in got} == sizes
        assert (made.where("part > 0").count() > 0) == (most == 200)
    assert chat_template.formatted(table.where("false")).count() == 0
    with_trial = chat_template.with_trial(table)
    row = chat_template.read_back(chat_template.formatted(with_trial)).where("id = -7").first()
    assert tuple(row)[:5] == plain_conversations([(-7, 0, "user", trial), (-7, 1, "assistant", trial)])[0]


def test_twins_of_the_new_queries(spark):
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"create view {name} as select * from '/root/testdata/sf0.01/{name}.parquet'")
    for name in ("op12_fill_in_middle", "op13_chat_formatting"):
        df = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        got = [tuple(x) for x in df.collect()]
        rows = con.execute(queries.ORACLES[name])
        assert [d[0] for d in rows.description] == df.columns
        assert sorted(got, key=repr) == sorted(rows.fetchall(), key=repr)
