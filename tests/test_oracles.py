"""Every query with SQL equals DuckDB's answer on the smallest tables."""

import datetime
import decimal
import math

import numpy as np
import pytest

from tallygrove.plans import models, quantiles, queries, queries_legacy, queries_models, queries_sources, standin  # noqa: F401

from .test_boosting import plain as plain_boosting
from .test_similar import plain_fuzzy


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else v


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, sf_dir, duck, name):
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in want.fetchall()]
    assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=repr) == sorted(rows, key=repr)


# The queries that SQL cannot express, against plain Python.


def races(spark, sf_dir):
    rows = [r.asDict() for r in standin.races(spark, sf_dir).orderBy("district").collect()]
    level = lambda r: r["cook_rating"] if r["cook_rating"] is not None else next((v for low, v in ((10, 7.0), (3, 6.0), (-2, 4.0), (-9, 2.0)) if r["cpvi"] >= low), 1.0)
    x = np.array([[level(r), r["incumbent"], r["cpvi"]] for r in rows], float)
    return rows, x, np.array([r["cycle"] for r in rows]), np.array([r["margin_pct"] for r in rows])


def test_logistic_scores(spark, sf_dir):
    """The gradient of the penalised likelihood is 0 at the weights behind the scores."""
    _, x, cycle, margin = races(spark, sf_dir)
    got = {r["district"]: r["competitiveness"] for r in queries.QUERIES["q_alg_logistic_ro"](spark, sf_dir).collect()}
    train = standin.races(spark, sf_dir).where("cycle < 2000")
    w, b = models.fit_logistic(train, "naive+pvi")
    own, hit, scale = x[cycle < 2000], np.abs(margin[cycle < 2000]) < 0.05, x[cycle < 2000].std(0)
    p = 1 / (1 + np.exp(-(own @ np.array(w) + b)))
    assert np.abs((own - own.mean(0)).T / scale[:, None] @ (p - hit) + np.array(w) * scale).max() < 1e-3 * len(own) and abs((p - hit).sum()) < 1e-3 * len(own)
    rows, *_ = races(spark, sf_dir)
    want = {r["district"]: 1 / (1 + math.exp(-(v @ np.array(w) + b))) for r, v in zip(rows, x, strict=True) if r["cycle"] == 2000}
    assert got == pytest.approx(want, abs=1e-9) and len(got) > 300


def test_quantile_scores(spark, sf_dir):
    """The planes are those of the whole program, solved at once; scores follow from them."""
    rows, x, cycle, margin = races(spark, sf_dir)
    own, y = x[cycle < 2000], margin[cycle < 2000]
    scaled, planes = (own - own.mean(0)) / own.std(0), []
    fits = models.fit_quantiles(standin.races(spark, sf_dir).where("cycle < 2000"), "naive+pvi")
    for f in fits:
        w, b = np.array(f["weights"]) * own.std(0), f["intercept"] + float(np.array(f["weights"]) @ own.mean(0))
        assert quantiles.pinball(scaled, y, f["level"], 0.1, w, b) <= quantiles.pinball(scaled, y, f["level"], 0.1, *quantiles.fit_quantile(scaled, y, f["level"], 0.1)) + 1e-9
        planes.append(x @ np.array(f["weights"]) + f["intercept"])
    at = np.sort(np.array(planes).T, 1)
    got = {r["district"]: r for r in queries.QUERIES["q_alg_multiquantile_ro"](spark, sf_dir).collect()}
    assert set(got) == {r["district"] for r in rows if r["cycle"] == 2000} and len(got) > 300
    for r, q in zip(rows, at, strict=True):
        if r["cycle"] == 2000:
            assert got[r["district"]]["quantiles"] == pytest.approx(q.tolist(), abs=1e-9)


def test_floors(spark, sf_dir):
    rows, _, _, _ = races(spark, sf_dir)
    weights, intercept = models.fit_floor(standin.races(spark, sf_dir).where("cycle < 2000"))
    won = [r for r in rows if r["cycle"] < 2000 and r["winner"] and abs(r["margin_pct"]) <= 0.10]
    x, y = np.array([[r[c] for c in models.FLOOR_FEATURES] for r in won]), np.array([float(r["total_trans"]) for r in won])
    scaled = (x - x.mean(0)) / x.std(0)
    w, b = np.array(weights) * x.std(0), intercept + float(np.array(weights) @ x.mean(0))
    assert len(won) >= 30 and quantiles.pinball(scaled, y, 0.25, 0.1, w, b) <= quantiles.pinball(scaled, y, 0.25, 0.1, *quantiles.fit_quantile(scaled, y, 0.25, 0.1)) * (1 + 1e-9)
    got = {r["district"]: r for r in queries.QUERIES["q_alg_viable_floor_ro"](spark, sf_dir).collect()}
    for r in (r for r in rows if r["cycle"] == 2000):
        floor = max(1.0, intercept + sum(a * r[c] for a, c in zip(weights, models.FLOOR_FEATURES, strict=True)))
        assert got[r["district"]]["viable_floor"] == pytest.approx(floor) and got[r["district"]]["need"] == pytest.approx(min(max((floor - r["total_trans"]) / floor, 0), 1), abs=1e-9)


def test_boosted_margins(spark, sf_dir):
    """Trees over the query's own edges, which lie among the fitted rows' values."""
    rows = {r["district"]: r for r in standin.races(spark, sf_dir).collect()}
    q = queries_models
    edges = q.boosting.fit(standin.races(spark, sf_dir).where("cycle < 2000"), q.BOOSTED_FEATURES, "margin_pct", q.boosting.Settings(trees=0)).edges
    train = [r for r in rows.values() if r["cycle"] < 2000]
    x, y = np.array([[float(r[c]) for c in q.BOOSTED_FEATURES] for r in train]), np.array([r["margin_pct"] for r in train])
    assert all(set(e) <= set(x[:, j]) for j, e in enumerate(edges))
    want = dict(zip((r["district"] for r in train), plain_boosting(x, y, edges, q.BOOSTED)[-1], strict=True))
    got = {r["district"]: r["prediction"] for r in queries.QUERIES["q_leg_huber_ro"](spark, sf_dir).collect()}
    assert set(got) == set(rows) and {k: got[k] for k in want} == pytest.approx(want, abs=1e-9)
    held = [k for k in rows if k not in want]
    assert len(held) > 300 and all(math.isfinite(got[k]) for k in held)


def test_fuzzy_names(spark, sf_dir):
    parts = [tuple(r) for r in standin.read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size").collect()]
    side = lambda k: "D" if k % 2 == 0 else "R"
    rows = [(k, size, k % 5, name[:4] + name[5:], side(k)) for k, name, size in parts]
    records = [(k, size, k % 5, name.upper(), side(k)) for k, name, size in parts]
    got = {r["row_id"]: (r["cand_id"], r["how"]) for r in queries.QUERIES["q_join_fuzzy_ro"](spark, sf_dir).collect()}
    assert got == plain_fuzzy(rows, records) and len(got) > 100


def test_html_tables(spark, sf_dir):
    pages = {r["page_id"]: r["url"] for r in standin.read(spark, sf_dir, "pages").collect()}
    got = sorted((r["page_id"], r["table_no"], r["row_no"], tuple(r["header"]), tuple(r["cells"])) for r in queries.QUERIES["q_src_html_table_ro"](spark, sf_dir).collect())
    assert got == sorted((k, 0, 0, ("id", "url", "url"), (str(k), " ".join(u.split()), "x")) for k, u in pages.items())


def test_no_query_is_left_out():
    assert set(queries.QUERIES) - set(queries.ORACLES) == {"q_alg_logistic_ro", "q_alg_multiquantile_ro", "q_alg_viable_floor_ro", "q_join_fuzzy_ro", "q_leg_huber_ro", "q_src_html_table_ro"}
