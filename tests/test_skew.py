"""Order-dependent operators against brute force, with one key holding a third of the rows."""

import random
from collections import Counter, defaultdict
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentloom.operators import enrich, intake, market, match, ordered

N = 3000


@pytest.fixture(scope="module")
def roles():
    rnd = random.Random(7)
    out = []
    for i in range(N):
        key = 0 if i % 3 == 0 else rnd.randrange(1, 200)
        start = date(2010, 1, 1) + timedelta(days=rnd.randrange(0, 900 if key == 0 else 3000))
        end = None if rnd.random() < 0.02 else start + timedelta(days=rnd.randrange(-3, 60))
        out.append((key, i, rnd.choice("abcd"), start, end, round(rnd.choice([100.0, rnd.uniform(0, 9e4), 50_000.0]), 2)))
    return out


@pytest.fixture(scope="module")
def experience(spark, roles):
    return spark.createDataFrame(roles, "resume_id int, exp_id int, title string, start_date date, end_date date, salary double").repartition(6).cache()


def test_next_role(roles, experience):
    want = {}
    for key in {r[0] for r in roles}:
        mine = sorted((r for r in roles if r[0] == key), key=lambda r: (r[3], r[1]))
        for a, b in zip(mine, mine[1:] + [None]):
            want[a[1]] = b and b[2]
    got = {r.exp_id: r.next_title for r in enrich.next_role(experience).collect()}
    assert got == want


def test_next_role_inside_one_crowded_day(spark, monkeypatch):
    monkeypatch.setattr(enrich, "ID_BLOCK", 7)
    rows = [(1, i, str(i)) for i in range(100)]
    df = spark.createDataFrame(rows, "resume_id int, exp_id int, title string").withColumn("start_date", F.lit("2020-01-01").cast("date"))
    out = {r.exp_id: r.next_title for r in enrich.next_role(df).collect()}
    assert out == {i: str(i + 1) if i < 99 else None for i in range(100)}
    text = df.withColumn("exp_id", F.lpad(F.col("exp_id").cast("string"), 3, "0"))
    assert {int(r.exp_id): r.next_title for r in enrich.next_role(text).collect()} == out


def test_next_value_may_be_null_inside_a_key(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "c")], "k int, t int, v string")
    out = ordered.next_in_order(df, ["k"], F.floor(F.col("t") / 2), ["t"], ["v", "t"]).orderBy("t").collect()
    assert [(r.next_v, r.next_t) for r in out] == [(None, 2), ("c", 3), (None, None)]


def merged(spans):
    out = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
            out[-1][2] += 1
        else:
            out.append([start, end, 1])
    return out


def test_merged_employment_and_years(roles, experience):
    until = date(2020, 1, 1)
    spans = defaultdict(list)
    for key, _, _, start, end, _ in roles:
        end = end or until
        if start <= end:
            spans[key].append((start, end))
    want = {(k, s, e, n) for k, xs in spans.items() for s, e, n in merged(xs)}
    out = enrich.merge_employment(experience, "2020-01-01").collect()
    assert {(r.resume_id, r.start_date, r.end_date, r.n_roles) for r in out} == want
    for r in out:
        before = [e for k, s, e, _ in want if k == r.resume_id and e < r.start_date]
        assert r.gap_days == ((r.start_date - max(before)).days if before else None)
    months = {k: sum((e.year - s.year) * 12 + e.month - s.month for s, e, _ in merged(xs)) for k, xs in spans.items()}
    assert {r.resume_id: r.months for r in enrich.years_of_experience(experience, "2020-01-01").collect()} == months


def test_exact_quantiles(roles, experience):
    probs = {"low": 0.0, "p25": 0.25, "mid": 0.5, "p95": 0.95, "high": 1.0}
    for width in (10.0, 1000.0, 1e7):
        out = ordered.exact_quantiles(experience, ["title"], "salary", probs, width).collect()
        assert len(out) == 4
        for r in out:
            mine = [x[5] for x in roles if x[2] == r.title]
            assert r.n_rows == len(mine)
            for name, p in probs.items():
                assert r[name] == pytest.approx(np.quantile(mine, p), abs=1e-6)


def test_counted_quantiles_equal_plain_ones(experience):
    counted = experience.groupBy("title", "salary").agg(F.count("*").alias("n"))
    a = ordered.exact_quantiles(counted, ["title"], "salary", {"q": 0.3}, 1000.0, weight="n").orderBy("title").collect()
    b = ordered.exact_quantiles(experience, ["title"], "salary", {"q": 0.3}, 1000.0).orderBy("title").collect()
    assert a == b


def test_percent_rank(roles, experience):
    out = market.score_rank(experience, "title", "salary").collect()
    assert len(out) == N
    by_title = defaultdict(list)
    for r in roles:
        by_title[r[2]].append(r[5])
    for r in random.Random(1).sample(out, 200):
        mine = by_title[r.title]
        assert r.pct_rank == pytest.approx(round(sum(x < r.salary for x in mine) / (len(mine) - 1), 4), abs=1.01e-4)


def test_a_single_row_ranks_zero(spark):
    df = spark.createDataFrame([("x", 5.0)], "g string, s double")
    assert market.score_rank(df, "g", "s").first().pct_rank == 0.0


def test_bulk_accept(roles, experience):
    out = intake.bulk_accept(experience.select("resume_id", "exp_id"), "resume_id", "exp_id", 20).collect()
    assert len(out) == N
    first = defaultdict(list)
    for r in sorted(roles, key=lambda r: r[1]):
        first[r[0]].append(r[1])
    assert {r.exp_id for r in out if r.accepted} == {i for xs in first.values() for i in xs[:20]}
    assert all((r.reason is None) == r.accepted for r in out)
    report = {r.resume_id: r for r in intake.bulk_report(intake.bulk_accept(experience, "resume_id", "exp_id", 20), "resume_id").collect()}
    assert report[0].accepted_files == 20 and report[0].total_files == len(first[0]) and report[0].rejected_files == len(first[0]) - 20


def test_top_matches(spark):
    rnd = random.Random(3)
    pairs = {(0 if i % 3 == 0 else rnd.randrange(1, 50), i): rnd.randrange(0, 20) for i in range(N)}
    df = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], "resume_id int, job_id int, overall_score int").repartition(6)
    got = {(r.resume_id, r["rank"]): r.job_id for r in match.top_matches(df, "resume_id", 4).collect()}
    want = {}
    for key in {a for a, _ in pairs}:
        best = sorted(((-s, b) for (a, b), s in pairs.items() if a == key))[:4]
        want |= {(key, n + 1): b for n, (_, b) in enumerate(best)}
    assert got == want


def test_matching_scores_asked_pairs_only(spark):
    rnd = random.Random(5)
    have = {r: {f"s{0 if rnd.random() < .5 else rnd.randrange(1, 30)}" for _ in range(8)} for r in range(60)}
    need = {j: {f"s{rnd.randrange(0, 40)}": rnd.choice(["required", "preferred"]) for _ in range(6)} for j in range(20)}
    asked = {(0 if i % 3 == 0 else rnd.randrange(60), rnd.randrange(20)) for i in range(300)} | {(999, 1)}
    out = match.match_skills(
        spark.createDataFrame([(r, s) for r, xs in have.items() for s in xs], "resume_id int, skill string"),
        spark.createDataFrame([(j, s, n) for j, xs in need.items() for s, n in xs.items()], "job_id int, skill string, need string"),
        spark.createDataFrame(list(asked), "resume_id int, job_id int"),
    ).collect()
    assert {(r.resume_id, r.job_id) for r in out} == asked
    for r in out:
        mine = have.get(r.resume_id, set())
        for kind in ("required", "preferred"):
            wanted = {s for s, n in need[r.job_id].items() if n == kind}
            assert (r[f"{kind}_n"], r[f"{kind}_hit"]) == (len(wanted), len(wanted & mine))


def test_missing_skills(spark):
    rnd = random.Random(9)
    title = {r: "t0" if r % 3 == 0 else f"t{rnd.randrange(1, 4)}" for r in range(120)}
    own = {r: {f"s{min(rnd.randrange(12), rnd.randrange(12))}" for _ in range(5)} for r in range(120)}
    skills = spark.createDataFrame([(r, s) for r, xs in own.items() for s in xs], "resume_id int, skill string")
    roles = spark.createDataFrame(list(title.items()), "resume_id int, title string")
    got = {r.resume_id: r.areas for r in enrich.missing_skills(skills, roles, roles, k=3).collect()}
    for r, t in title.items():
        holders = [x for x in title if title[x] == t]
        counts = Counter(s for x in holders for s in own[x])
        ranked = sorted((-n, s) for s, n in counts.items())
        assert got[r] == [s for _, s in ranked if s not in own[r]][:3]


def test_market_windows(spark):
    rnd = random.Random(11)
    rows = list({(rnd.randrange(40), date(2024, 3, 1) - timedelta(days=rnd.randrange(0, 80)), "hot" if i % 3 == 0 else f"s{rnd.randrange(9)}")
                 for i in range(900)})
    df = spark.createDataFrame(rows, "resume_id int, seen_on date, skill string")
    got = {r.skill: r for r in market.skill_trend(df, "30d", "2024-03-01").collect()}
    for s in {r[2] for r in rows}:
        age = lambda r: (date(2024, 3, 1) - r[1]).days
        now = len({r[0] for r in rows if r[2] == s and age(r) < 30})
        past = len({r[0] for r in rows if r[2] == s and 30 <= age(r) < 60})
        assert (got[s].current, got[s].previous) == (now, past)
        assert got[s].growth_rate == (round((now - past) / past, 4) if past else None)
    assert all(r.trend == "stable" and r.growth_rate is None for r in market.skill_trend(df, "all", "2024-03-01").collect())


@pytest.mark.parametrize("scale", [1.0, 1e9])
def test_slices_follow_the_values(spark, scale):
    """Scores in 0..1, up to 1e9, and bunched together: a bounded number of slices, none of them much larger than its share."""
    n = 40_000
    base = spark.range(n).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
                                 F.pow(F.rand(5), F.lit(6.0)).alias("s"), F.col("id"))
    df = base.select("g", (F.col("s") * scale).alias("s"), "id").cache()
    cut = ordered.equal_slices(df, ["g"], "s").groupBy("g", "_slice").count().cache()
    hot = cut.where("g = 'hot'")
    assert 200 < hot.count() <= ordered.SLICES and hot.agg(F.max("count")).first()[0] <= 8 * (n / 3) / ordered.SLICES + 8
    assert cut.agg(F.max("_slice")).first()[0] < ordered.SLICES
    got = {(r.g, r.id): r.pct_rank for r in market.score_rank(df, "g", "s").collect()}
    want = df.selectExpr("g", "id", "round(percent_rank() over (partition by g order by s), 4) as p").collect()
    assert len(got) == n and all(abs(got[r.g, r.id] - r.p) < 1e-9 for r in want)


def test_slices_of_awkward_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", None), ("b", -5.0), (None, 2.0), ("c", None)] + [("d", float(k % 2)) for k in range(9)], "g string, s double")
    out = {r.g: (r.n_rows, r.q) for r in ordered.exact_quantiles(df, ["g"], "s", {"q": 0.5}).collect()}
    assert out == {"a": (2, 1.0), "b": (1, -5.0), "d": (9, 0.0)}
    assert ordered.exact_quantiles(df.where("false"), ["g"], "s", {"q": 0.5}).count() == 0
