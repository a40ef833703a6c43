import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from tallygrove.operators import match, similar

SYLLABLES = ["ma", "ro", "son", "kel", "li", "an", "der", "st", "o", "berg", "hu", "ta", "ne", "mc", "gi", "vi", "ch", "ez", "al", "win"]


def names(rng, n):
    out = set()
    while len(out) < n:
        name = "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 5))).upper()
        for _ in range(rng.choice([0, 0, 1, 2])):  # slips of the pen
            i = rng.randrange(len(name))
            name = rng.choice([name[:i] + rng.choice("ABCDEF '") + name[i:], name[:i] + name[i + 1 :], name[: i + 1] + name[i:]]) or "A"
        out.add(name)
    return sorted(out)


def ratio(a, b):
    m = SequenceMatcher()
    m.set_seq2(a)
    m.set_seq1(b)
    return m.ratio()


def all_against_all(left, right, cutoff):
    """Every pair that reaches the cutoff; only pairs whose letters alone rule it out are passed over."""
    letters = sorted(set("".join([*left, *right])))
    count = lambda x: np.array([[n.count(c) for c in letters] for n in x], np.uint8)
    a, b, size = count(left), count(right), np.array([len(x) for x in right])
    out = {}
    for i, x in enumerate(left):
        both = np.minimum(a[i], b).sum(1)
        for j in np.flatnonzero(2 * both >= cutoff * (len(x) + size) - 1e-9):
            if (r := ratio(x, right[j])) >= cutoff:
                out[x, right[j]] = r
    return out


def test_no_pair_of_a_large_block_is_lost(spark):
    rng = random.Random(8)
    own = names(rng, 10_000)
    df = spark.createDataFrame([("TX", 1, n) for n in own], "state string, district int, name string")
    found = similar.candidates(df, df, ["state", "district"])
    got = {(r["a"], r["b"]): r["ratio"] for r in found.withColumn("ratio", similar.likeness("a", "b")).where("ratio >= 0.85").collect()}
    want = all_against_all(own, own, 0.85)
    assert got == want
    n = found.count()
    print(f"{len(own)} names: {n} candidates of {len(own) ** 2} pairs, {len(want)} similar")
    assert n < 4 * len(want) and n < len(own) ** 2 / 1000


@pytest.mark.parametrize("cutoff", [0.85, 0.9, 1.0])
def test_short_and_odd_names(spark, cutoff):
    own = ["A", "B", "AB", "BA", "ABA", "ABAB", "ABABAB", "ABABABA", "BABABAB", "AAAAAAA", "AAAAAAAA", "ÜNÏÇÖDÉS", "UNÏÇÖDÉS", "ÜNÏÇÖDÉ", "O'NEIL-SMITH", "ONEIL SMITH", "X" * 30, "X" * 29 + "Y", "🙂🙂🙂🙂🙂🙂🙂", "🙂🙂🙂🙂🙂🙂"]
    df = spark.createDataFrame([("TX", n) for n in own] + [("CA", "AB")], "state string, name string")
    got = {(r["a"], r["b"]): r["ratio"] for r in similar.similar(df, df, ["state"], cutoff).where("state = 'TX'").collect()}
    assert got == {(a, b): ratio(a, b) for a in own for b in own if ratio(a, b) >= cutoff}
    held = {(r["a"], r["b"]) for r in similar.contained(df, df, ["state"]).where("state = 'TX'").collect()}
    assert held == {(a, b) for a in own for b in own if a in b or b in a}


def test_cutoffs_that_imply_no_shared_gram(spark):
    assert similar.usable(0.85) and not similar.usable(0.6)
    df = spark.createDataFrame([("TX", "A")], "state string, name string")
    with pytest.raises(ValueError, match="shared gram"):
        similar.candidates(df, df, ["state"], 0.6)


def plain_fuzzy(rows, records, cutoff=0.85):
    """rows: (row_id, state, district, last_name, party); records: (cand_id, state, district, last_name, party)."""
    out = {}
    for row_id, state, district, name, party in rows:
        pool = [r for r in records if r[1:3] == (state, district)]
        pool = [r for r in pool if party in ("D", "R") and r[4] == party] or pool
        target = (name or "").strip().upper()
        likely = [(ratio(target, r[3]), r[3], -r[0]) for r in pool if r[3] and target and ratio(target, r[3]) >= cutoff]
        holds = [(len(r[3]), r[3], r[0]) for r in pool if r[3] and target and (target in r[3] or r[3] in target)]
        if likely:
            out[row_id] = (-max(likely)[2], "ratio")
        elif holds:
            out[row_id] = (min(holds)[2], "contained")
    return out


def test_fuzzy_equals_brute_force(spark):
    rng = random.Random(9)
    own = names(rng, 400)
    records = [(i, rng.choice("AB"), rng.randint(0, 3), n if i % 50 else None, rng.choice(["D", "R", None])) for i, n in enumerate(own + own[:40])]
    rows = [(i, rng.choice("ABC"), rng.randint(0, 3), rng.choice([rng.choice(own), rng.choice(own)[:-1], " " + rng.choice(own).lower() + "X", None, ""]), rng.choice(["D", "R", None])) for i in range(300)]
    fields = "state string, district int, last_name string, party_major string"
    got = match.fuzzy(spark.createDataFrame(rows, "row_id int, " + fields), spark.createDataFrame(records, "cand_id int, " + fields)).collect()
    assert {r["row_id"]: (r["cand_id"], r["how"]) for r in got} == plain_fuzzy(rows, records) and len(got) > 50


def most_rows(df):
    """The most rows that a step of the executed plan gave."""
    df.collect()
    found, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name, metric, below = p.getClass().getSimpleName(), p.metrics().get("numOutputRows"), p.children()
        found = max(found, metric.get().value() if metric.isDefined() else 0)
        plans += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else [below.apply(i) for i in range(below.size())]
    return found


def test_copies_of_names_are_not_paired(spark):
    base = ["SANDERSON", "SANDERSEN", "KELLER", "VICHEZ", "MARO", "MAROSON"]
    records = [(i, "A", 1, base[i % 6], ["D", "R", None][i % 3]) for i in range(360)]
    rows = [(i, "A", 1, base[i % 6] if i % 4 else base[i % 6][:-1], ["D", "R", None][i // 6 % 3]) for i in range(360)]
    fields = "state string, district int, last_name string, party_major string"
    got = match.fuzzy(spark.createDataFrame(rows, "row_id int, " + fields), spark.createDataFrame(records, "cand_id int, " + fields))
    assert {r["row_id"]: (r["cand_id"], r["how"]) for r in got.collect()} == plain_fuzzy(rows, records) and got.count() > 200
    assert 360 <= most_rows(got) < 3000  # 60 x 60 pairs of copies a name before
