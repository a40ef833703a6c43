import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallygrove.llm import bpe, chat, decontaminate, lines, links, neardup, quality, queries, sharding, spans, winnow

from .helpers import by_id, documents, empty, sentence, texts

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


# Winnowing


def test_winnowing_against_plain_python(spark):
    out = winnow.fingerprint(documents(spark), "text", "h", "p")
    assert out.columns[-2:] == ["h", "p"]
    for r in out.collect():
        words = (r["text"] or "").lower().split(None)
        n = max(len(words) - winnow.GRAM + 1, 1 if words else 0)
        assert len(r["h"]) == len(r["p"]) and r["p"] == sorted(r["p"]) and all(0 <= i < n for i in r["p"])
        if n > winnow.WINDOW:  # every window has a chosen gram
            assert r["p"][0] < winnow.WINDOW and n - r["p"][-1] <= winnow.WINDOW and max(np.diff(r["p"]), default=0) <= winnow.WINDOW


def test_equal_grams_choose_the_rightmost(spark):
    df = spark.createDataFrame([("same " * 100,)], "text string")
    (row,) = winnow.fingerprint(df, "text", "h", "p").collect()
    assert row["p"] == list(range(winnow.WINDOW - 1, 96)) and len(set(row["h"])) == 1


def test_shared_passages_are_noticed(spark):
    rng = random.Random(4)
    passage = sentence(rng, winnow.GRAM + winnow.WINDOW - 1)
    df = spark.createDataFrame([(sentence(rng, 50) + " " + passage + " " + sentence(rng, 9),), (passage + " " + sentence(rng, 77),)], "text string")
    a, b = winnow.fingerprint(df, "text", "h", "p").collect()
    assert set(a["h"]) & set(b["h"])


def test_short_texts_keep_all_grams(spark):
    words = sentence(random.Random(6), 19).split()
    df = spark.createDataFrame([(i, " ".join(words[:n])) for i, n in enumerate((19, 14, 5, 4, 0))], "i int, text string")
    rows = winnow.fingerprint(df, "text", "h", "p").orderBy("i").collect()
    assert [r["p"] for r in rows] == [list(range(15)), list(range(10)), [0], [0], []]
    assert set(rows[1]["h"]) < set(rows[0]["h"])


def test_edited_texts(spark):
    for repeat in (False, True):
        rows = {r["doc_id"]: r for r in winnow.compare_edited(documents(spark, repeat=repeat, null_id=repeat)).collect()}
        plain = [t or "" for t in texts()]
        assert len(rows) == len(plain)
        for i, t in enumerate(plain):
            n, after = len(t) // 4, plain[(i + 1) % len(plain)]
            edited = t[: len(t) - n] + after[:n]
            assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            assert (rows[i]["fingerprint"] == rows[i]["edited_fingerprint"]) or t != edited
        assert rows[6]["fingerprint"] == rows[7]["fingerprint"] and rows[6]["near_next"] == 1.0
    assert winnow.compare_edited(empty(spark)).count() == 0


def plain_fingerprint(text):
    """The chosen grams' hashes and places, word by word and window by window."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [xxhash.xxh64_intdigest(w, 42) for w in text.lower().encode().split()]
    if not hashes:
        return [], []
    grams = []
    for i in range(len(hashes) - winnow.GRAM + 1):
        rolled = 0
        for h in hashes[i : i + winnow.GRAM]:
            rolled = (rolled << 1 | rolled >> 63) & (1 << 64) - 1 ^ h
        grams.append(signed(rolled))
    if not grams:
        seed = 42
        for h in hashes:
            seed = xxhash.xxh64_intdigest(h.to_bytes(8, "little"), seed)
        grams = [signed(seed)]
    chosen = list(range(len(grams))) if len(grams) < winnow.WINDOW else []
    for i in range(len(grams) - winnow.WINDOW + 1):
        window = range(i, i + winnow.WINDOW)
        least = min(grams[k] >> winnow.PLACE_BITS for k in window)
        chosen.append(max(k for k in window if grams[k] >> winnow.PLACE_BITS == least))
    places = sorted(set(chosen))
    return [grams[k] for k in places], places


def test_winnowing_equals_brute_force(spark):
    plain = [t or "" for t in texts()]
    want = [plain_fingerprint(t) for t in plain]
    own = spark.createDataFrame(list(enumerate(plain)), "doc_id int, text string")
    got = {r["doc_id"]: (r["h"], r["p"]) for r in winnow.fingerprint(own, "text", "h", "p").collect()}
    assert got == dict(enumerate(want))
    near = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    for r in winnow.compare_edited(documents(spark)).collect():
        i, t = r["doc_id"], plain[r["doc_id"]]
        after, n = plain[(i + 1) % len(plain)], len(t) // 4
        edited = set(plain_fingerprint(t[: len(t) - n] + after[:n])[0])
        assert r["near_edited"] == pytest.approx(near(set(want[i][0]), edited), abs=1e-12)
        assert r["near_next"] == pytest.approx(near(set(want[i][0]), set(want[(i + 1) % len(plain)][0])), abs=1e-12)


# URL filters


def page_rows():
    return [(1, "http://a.Example.net/en/x?q", '<a href="http://good.org/">'), (2, "https://net/", None), (3, "http://b.example.com/de/1#x", "<a href=http://c.example.com/>"), (4, "http://c.example.com/en/", '<A HREF=\'http://b.example.com/de/1\'>'),
            (5, None, "<a href='http://a.example.net/en/'>"), (6, "no scheme", ""), (7, "http://x.org/fr/", ""), (8, "http://example.network/", ""), (9, "http://a.net", ""), (9, "http://a.net", "")]


def test_urls(spark):
    df = spark.createDataFrame([(*r, "x") for r in page_rows()], "page_id bigint, url string, html string, host string")
    rows = links.judge(df, tolerance=0.01).collect()
    out = {r["page_id"]: r for r in rows}
    assert len(rows) == 10
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (out[2]["rule"], out[2]["verdict"]) == ("net/", "block")
    assert (out[3]["rule"], out[3]["verdict"]) == ("example.com/de/", "block")
    assert out[4]["rule"] is None and out[4]["verdict"] == "block"  # it links to a blocked host
    assert (out[5]["host"], out[5]["path"], out[5]["verdict"]) == ("", "", "allow") and (out[6]["host"], out[6]["path"]) == ("", "")
    assert (out[7]["rule"], out[7]["verdict"]) == ("org/fr/", "allow")
    assert out[8]["rule"] is None and out[9]["rule"] is None and out[9]["path"] == ""
    assert links.judge(df.limit(0)).count() == 0


def test_propagation_against_numpy(spark):
    rng = random.Random(2)
    edges = sorted({(rng.randrange(8), rng.randrange(8)) for _ in range(25)})
    edges = [(f"h{a}", f"h{b}", float(1 + a)) for a, b in edges if a != b]
    seeds = [("h0", 0.5, 0.0), ("h1", 0.5, 0.25), ("h2", 0.0, 0.75)]
    got = {r["host"]: (r["trust"], r["distrust"]) for r in links.propagate(spark.createDataFrame(edges, "source string, target string, weight double"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), tolerance=1e-4).collect()}
    w = np.zeros((8, 8))
    for a, b, x in edges:
        w[int(a[1]), int(b[1])] = x
    for k, m in ((0, w), (1, w.T)):
        s = np.zeros(8)
        for h, *v in seeds:
            s[int(h[1])] = v[k]
        p = m / np.where(m.sum(1) > 0, m.sum(1), 1)[:, None]
        x = s.copy()
        for _ in range(300):
            y = x @ p
            x = 0.85 * y + s * (1 - 0.85 * y.sum())
        assert np.allclose([got.get(f"h{i}", (0, 0))[k] for i in range(8)], x, atol=1e-3)


def test_verdicts_on_a_graph_equal_a_dense_computation(spark):
    rng = random.Random(6)
    hosts = ["a.net", "example.net", "b.org", "example.com", "c.info", "d.info", "e.info", "f.info"]
    paths = {"a.net": "/x", "example.net": "/en/1", "b.org": "/fr/1", "example.com": "/de/1"}
    rows, edges = [], np.zeros((8, 8))
    for i, host in enumerate(hosts):
        for k in range(3):
            own = [rng.randrange(8) for _ in range(2)]
            for j in own:
                edges[i, j] += i != j
            scheme = ["http://", "//", "HTTPS://"]
            rows.append((10 * i + k, f"http://{host}{paths.get(host, '/') if k else '/other'}", "".join(f"<a class=x href='{rng.choice(scheme)}{hosts[j]}/z'>.</a>" for j in own) + "<a href='/in'><a href=in>"))
    out = {r["page_id"]: r for r in links.judge(spark.createDataFrame(rows, "page_id int, url string, html string"), tolerance=1e-4).collect()}
    ruled = {i: [r["verdict"] for r in out.values() if r["host"] == h and r["rule"]] for i, h in enumerate(hosts)}
    share = {i: x.count("allow") / len(x) for i, x in ruled.items() if x}
    mass = {}
    for name, m, seed in (("trust", edges, share), ("distrust", edges.T, {i: 1 - x for i, x in share.items()})):
        s = np.array([seed.get(i, 0.0) for i in range(8)])
        s /= s.sum()
        p = m / np.where(m.sum(1) > 0, m.sum(1), 1)[:, None]
        x = s.copy()
        for _ in range(300):
            y = x @ p
            x = 0.85 * y + s * (1 - 0.85 * y.sum())
        mass[name] = x
    assert edges.sum() > 20 and {r["verdict"] for r in out.values() if r["rule"] is None} == {"allow", "block"}
    for r in out.values():
        i = hosts.index(r["host"])
        assert r["trust"] == pytest.approx(mass["trust"][i], abs=1e-3) and r["distrust"] == pytest.approx(mass["distrust"][i], abs=1e-3)
        if r["rule"] is None:
            assert r["verdict"] == ("block" if mass["distrust"][i] > mass["trust"][i] else "allow")


# Chats


def test_chats(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "a"), (3, 0, "user", "a"), (3, 1, "assistant", "b"), (3, 2, "user", "c"), (4, 0, "user", "z"), (5, 0, "user", "z"), (5, 0, "user", "z"), (6, None, None, None), (None, 0, "user", "lost"), (7, 0, "user", "a"), (7, 1, "user", "b")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id bigint, turn bigint, role string, text string, place int")
    out = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["chat"]) for r in chat.render(df).collect()}
    assert set(out) == {3, 4, 6, 7}
    assert out[3] == (3, 1, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>user\nc<|im_end|>\n")
    assert out[4][:2] == (1, 2) and out[6] == (1, 1, "<|im_start|>\n<|im_end|>\n")
    assert chat.render(df.limit(0)).count() == 0
    con = duckdb.connect()
    conversations = df.toPandas()  # noqa: F841
    con.register("conversations", conversations)
    assert {r[0]: tuple(r[1:4]) for r in con.execute(queries.OP6_SQL).fetchall()} == out


# Decontamination


def plain_distance(item, text):
    """Least edit distance of item to any passage of text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_myers_equals_the_full_table():
    rng = random.Random(3)
    for _ in range(60):
        item, text = ("".join(rng.choice("abc ") for _ in range(rng.randint(1, 90))) for _ in range(2))
        best, end = decontaminate.search(decontaminate.masks(item), len(item), text)
        assert best == plain_distance(item, text)
        assert best == len(item) or plain_distance(item, text[:end]) == best


def test_leaks(spark):
    rng = random.Random(8)
    items = [sentence(rng, 30) for _ in range(4)]
    edited = list(items[1])
    for k in (10, 60, 100):
        edited[k] = "#"
    rows = [(0, items[0], 1), (1, "x " + items[0].upper().replace(" ", " \n ") + " y", 1), (2, sentence(rng, 10) + " " + "".join(edited), 1), (3, items[2][: len(items[2]) // 2], 1), (4, None, 1), (5, "", 1), (6, sentence(rng, 400) + items[3] + items[3], 1), (6, items[3], 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, item_id int")
    bench = spark.createDataFrame([(i, x) for i, x in enumerate(items)] + [(9, None), (10, " "), (11, items[3])], "item_id bigint, text string")
    got = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find(docs, bench).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 1, 3), (6, 3, 0), (6, 3, 0), (6, 11, 0), (6, 11, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4, 5]
    assert decontaminate.drop_leaks(docs, bench.limit(0)).count() == 8 and decontaminate.find(docs, bench.limit(0)).count() == 0
    assert decontaminate.find(docs.limit(0), bench).count() == 0


def test_blocks_give_what_one_gives(spark):
    rng = random.Random(9)
    items = [sentence(rng, 12) for _ in range(12)]
    docs = spark.createDataFrame([(i, sentence(rng, 9) + " " + items[i % 12] + " " + items[(i + 5) % 12]) for i in range(9)] + [(20, sentence(rng, 50))], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert len(list(decontaminate.blocks(bench, 120))) > 5
    rows = [sorted(tuple(r) for r in decontaminate.find(docs, bench, most=n).collect()) for n in (120, 10_000)]
    assert rows[0] == rows[1] and len(rows[0]) == 18
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench, most=120).collect()] == [20]


def test_leaks_equal_brute_force():
    rng = random.Random(5)
    items = [(i, decontaminate.normal(sentence(rng, 12))) for i in range(6)]
    block = decontaminate.Items(items)
    for _ in range(80):
        text = list(sentence(rng, 5) + " " + rng.choice(items)[1] + " " + sentence(rng, 5))
        for _ in range(rng.randint(0, 5)):
            k = rng.randrange(len(text))
            rng.choice([lambda k=k, t=text: t.pop(k), lambda k=k, t=text: t.insert(k, "q"), lambda k=k, t=text: t.__setitem__(k, "z")])()
        text = decontaminate.normal("".join(text))
        want = {(i, d) for i, x in items if (d := plain_distance(x, text)) <= int(decontaminate.RATE * len(x))}
        assert {(i, d) for i, d, _, _ in block.matches(text)} == want


# BPE


def strange_texts():
    rng = random.Random(3)
    letters = list("abc ABC'sS tT're 12٣½ıİIΣσς ß\x1c\x1d 　éé日本語🙂#$%&*!!\n\t\x85_-") + ["<|endoftext|>", "<|startoftext|>", "<|"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(600)] + ["aaaaaaaaaaaaa" * 900, ""]


def test_bpe_equals_the_library():
    lib, own = Tokenizer.from_file(VOCABULARY), bpe.WordBpe(open(VOCABULARY, "rb").read())
    all_texts = strange_texts() + [t or "" for t in texts()]
    want = [e.ids for e in lib.encode_batch(all_texts, add_special_tokens=False)]
    got = list(own.encode_batch(all_texts))
    assert got == want and list(own.encode_batch(all_texts)) == want
    assert all(own.decode(x) == lib.decode(x, skip_special_tokens=False) for x in want)


def test_bpe_rows(spark):
    lib = Tokenizer.from_file(VOCABULARY)
    out = bpe.encode(documents(spark), VOCABULARY, tuple(bpe.COLUMNS))
    for i, row in by_id(out, "n_tokens", "ids", "ids_sha256", "decoded", "decoded_sha256").items():
        ids = lib.encode(texts()[i] or "", add_special_tokens=False).ids
        plain = lib.decode(ids, skip_special_tokens=False)
        assert row == (len(ids), ids, hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), plain, hashlib.sha256(plain.encode()).hexdigest())
    assert bpe.encode(empty(spark), VOCABULARY).count() == 0
    assert bpe.encode(documents(spark, repeat=True, null_id=True), VOCABULARY).count() == len(texts()) + 8


def test_bpe_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        bpe.WordBpe(open(public_tokenizers.path("byte_bpe_50k.json"), "rb").read())


# Quality


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    logit, edge = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    got, pairs = quality.forward_backward(logit, np.array([5]), edge)
    total, good, both = 0.0, np.zeros(5), np.zeros((2, 2))
    for code in range(32):
        y = [code >> k & 1 for k in range(5)]
        w = np.exp(sum(logit[0, k] * y[k] for k in range(5)) + sum(edge[y[k], y[k + 1]] for k in range(4)))
        total += w
        good += w * np.array(y)
        for k in range(4):
            both[y[k], y[k + 1]] += w
    assert np.allclose(got[0], good / total) and np.allclose(pairs, both / total)


def test_quality_of_held_out_documents(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.score(docs, quality.fit(docs, labels)).withColumn("held_out", quality.held_out()).toPandas().merge(labels.toPandas(), on="doc_id")
    held = out[out["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4) == 2]
    assert held["held_out"].all() and len(held) == out["held_out"].sum() >= 10
    assert set(held["quality"]) == {0, 1} and quality.auc(held["score"], held["quality"]) > 0.95
    # Labels of held-out rows, and other columns, never reach the score.
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), quality.fit(docs, turned)).toPandas().merge(labels.toPandas(), on="doc_id")
    assert np.allclose(out.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"], atol=1e-9)


def test_scores_equal_plain_sums_over_labellings():
    rng = np.random.default_rng(4)
    width = 3 * len(quality.NAMES) + 3
    model = quality.LineCrf(rng.normal(size=width) * 0.3, rng.normal(size=(2, 2)), np.zeros(len(quality.NAMES)), np.ones(len(quality.NAMES)), 0.4)
    docs = ["one line only.", "A first line!\n\n12 34 | x y\nthe same\nthe same", "", "\n"]
    for text, got in zip(docs, model.score(docs), strict=True):
        rows = text.split("\n")
        x = np.array(quality.line_features(rows), float)
        zero, n = np.zeros(x.shape[1]), len(rows)
        node = [float(np.concatenate([x[i], x[i - 1] if i else zero, x[i + 1] if i + 1 < n else zero, [i == 0, i + 1 == n, 1]]) @ model.weights) for i in range(n)]
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [code >> k & 1 for k in range(n)]
            w = np.exp(sum(a * b for a, b in zip(node, y, strict=True)) + sum(model.edge[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            good += w * np.array(y)
        sizes = np.array([len(r) for r in rows])
        assert got == pytest.approx(float((good / total * sizes).sum() / sizes.sum()) if sizes.sum() else 0.4, abs=1e-9)


def test_the_fit_is_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, ("good line here.\n" * 3 if i % 2 else "### $$ |||\n") + "x" * (900 if i > 40 else 0)) for i in range(60)] + [(1, "b"), (1, "a")], "doc_id int, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id int, quality int")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(quality.LineCrf, "fit", classmethod(lambda cls, texts, good, **_: seen.append(texts)))
        quality.fit(docs, labels, max_docs=1000, max_chars=500)
        quality.fit(docs, labels, max_docs=7)
    assert max(map(len, seen[0])) <= 500 and len(seen[0]) <= 41 and "a" in seen[0] and "b" not in seen[0] and len(seen[1]) <= 7


def test_quality_edges(spark):
    docs = documents(spark, repeat=True, null_id=True)
    labels = spark.createDataFrame([(6, 1, 0), (6, 0, 0), (7, None, 0), (999, 0, 0), (84, 0, 0), (10, 1, 0), (11, 1, 0), (9, 1, 1), (85, 0, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["score"] for r in rows if r["doc_id"] in (0, 1)} == {model.prior}
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, model).columns == docs.columns and quality.score(empty(spark), model).count() == 0


# Sharding


@pytest.mark.parametrize("copies", [0, 30, 400])
def test_shards(spark, copies):
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(1000 + i, "copy", 1) for i in range(copies)] + [(5, "one", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(4)
    out = sharding.assign(df, shards=7).toPandas()
    assert len(out) == len(rows) and out["grown_shard"].isna().all()
    sizes = out.groupby("shard").size()
    assert len(sizes) == 7 and sizes.max() - sizes.min() <= 1
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in out.groupby("shard"))
    want = sorted((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert sorted(zip(out["doc_id"], out["size"], out["text_crc32"], strict=True)) == want
    cut = out[out["doc_id"] >= 1000].groupby("shard").size()
    assert len(cut) <= -(-copies // (len(rows) // 7)) + 1  # as few shards as the copies need


def test_shards_of_a_group_that_needs_many_rounds(spark):
    rows = [(i, f"text {i}") for i in range(2668)] + [(i, "the same") for i in range(2668, 4000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shards=40).toPandas()
    assert out[out["doc_id"] >= 2668]["shard"].nunique() <= -(-1332 // 100) + 1


def test_shards_cut_few_links(spark):
    rng = random.Random(2)
    rows = [(i, f"text {rng.randrange(700)}") for i in range(2000)]
    out = sharding.assign(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4), shards=20).toPandas().merge(pd.DataFrame(rows, columns=["doc_id", "text"]), on="doc_id")
    pairs = lambda key: int(sum(n * (n - 1) // 2 for n in out.groupby(key).size()))
    cut = 1 - pairs(["text", "shard"]) / pairs(["text"])
    out["shard"] = [rng.randrange(20) for _ in range(len(out))]
    assert cut < 0.08 and 1 - pairs(["text", "shard"]) / pairs(["text"]) > 0.9


def test_shards_of_an_empty_table(spark):
    assert sharding.assign(empty(spark)).count() == 0


# Long rows


def test_every_operator_bears_very_long_texts(spark):
    rng = random.Random(1)
    words = [sentence(rng, 1) for _ in range(500)]
    long = " ".join(rng.choice(words) for _ in range(200_000))
    rows = [(1, long), (2, long + "\nend"), (3, "x" * 300_000), (4, long.replace(" ", "\n")), (5, "short one.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    out = by(neardup.classes(docs))
    assert out[1]["component_id"] == out[2]["component_id"] == out[4]["component_id"] == 1 and out[5]["component_id"] == 5
    assert {i: r["n_words"] for i, r in by(spans.dedup(docs)).items()} == {1: 200_000, 2: 200_001, 3: 1, 4: 200_000, 5: 2}
    assert by(winnow.fingerprint(docs, "text", "h", "p"))[1]["p"][-1] > 199_000
    bench = spark.createDataFrame([(7, long[500_000:500_400])], "item_id bigint, text string")
    assert {r["doc_id"] for r in decontaminate.find(docs, bench).collect()} == {1, 2, 4}
    assert sharding.assign(docs, shards=2).count() == 5
    model = quality.LineCrf.fit(["a good line.\nanother one."] * 3 + ["### ||"] * 3, [True] * 3 + [False] * 3)
    assert all(0 <= r["score"] <= 1 for r in quality.score(docs, model).collect())
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).alias("turn"), F.lit("user").alias("role"), "text")
    assert chat.render(turns).count() == 5
    pages = docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("http://a.net/"), F.col("text")).alias("url"), F.col("text").alias("html"))
    assert links.judge(pages).count() == 5


def test_long_lines_are_deduplicated(spark):
    rng = random.Random(1)
    long = " ".join(sentence(rng, 1) for _ in range(60_000))
    out = lines.dedup(spark.createDataFrame([(1, long), (2, "head\n" + long), (3, long.replace("a", "b", 3))], "doc_id bigint, text string"))
    assert by_id(out, "text") == {1: long, 2: "head", 3: ""}
