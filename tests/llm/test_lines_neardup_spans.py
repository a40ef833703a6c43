import hashlib
import re
from itertools import combinations

import numpy as np

from tallygrove.llm import lines, lsh, neardup, spans, vec

from .helpers import by_id, documents, empty, texts


def roots(n, links):
    top = list(range(n))

    def lead(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = lead(a), lead(b)
        top[max(a, b)] = min(a, b)
    return [lead(x) for x in range(n)]


def brute_classes(docs, size, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()

    sets = [shingles(t) for t in docs]
    links = [(a, b) for a, b in combinations(range(len(sets)), 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(s), r) for i, (s, r) in enumerate(zip(sets, roots(len(sets), links), strict=True))}


def test_classes_equal_brute_force(spark):
    for seed, size in ((1, 4), (2, 5)):
        got = by_id(neardup.classes(documents(spark, seed), size), "n_shingles", "component_id")
        assert got == brute_classes(texts(seed), size, 80)


def test_classes_with_repeated_and_null_ids(spark):
    got = neardup.classes(documents(spark, repeat=True, null_id=True), 4)
    assert got.count() == len(texts()) and by_id(got, "n_shingles", "component_id") == brute_classes(texts(), 4, 80)


def test_classes_of_an_empty_table(spark):
    out = neardup.classes(empty(spark))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.count() == 0


def test_sketches_estimate_and_merge():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.unique(base[:2600]), np.unique(base[400:])
    s = neardup.registers([a, b, np.unique(base)])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    got = neardup.estimate(s[:, [0]].T, s[:, [1]].T, np.array([len(a)], float), np.array([len(b)], float))[0]
    assert abs(got - true) < 0.1
    assert (neardup.merged(s[:, 0], s[:, 1]) == s[:, 2]).all()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in lsh.components(spark.createDataFrame(edges, "a bigint, b bigint"), 4).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 160)}


def test_intersections_are_exact():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in (0, 1, 50, 200, 200)]
    got = lsh.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5) if i != j)


def brute_lines(docs):
    first: dict[str, tuple[int, int]] = {}
    for i, t in enumerate(docs):
        for j, line in enumerate((t or "").split("\n") if t is not None else []):
            if line.strip(" \t\n\r\x0b\x0c"):
                first.setdefault(line.lower(), (i, j))
    names = list(first)
    sets = [{x[i : i + lines.SHINGLE] for i in range(max(1, len(x) - lines.SHINGLE + 1))} for x in names]
    links = [(a, b) for a, b in combinations(range(len(names)), 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    top = roots(len(names), links)
    keep: dict[int, tuple[int, int]] = {}
    for x, r in enumerate(top):
        keep[r] = min(keep.get(r, first[names[x]]), first[names[x]])
    kept = set(keep.values())
    return {i: None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if not x.strip(" \t\n\r\x0b\x0c") or (i, j) in kept) for i, t in enumerate(docs)}


def test_lines_equal_brute_force(spark):
    docs = documents(spark)
    out = lines.dedup(docs)
    assert out.columns[:-2] == docs.columns
    assert by_id(out, "text") == brute_lines(texts())


def test_lines_of_rows_that_share_an_id(spark):
    alpha, own = "alpha beta gamma delta epsilon zeta", "second line only here, nowhere else"
    rows = [(1, "the same line in all of them"), (2, alpha + "\nthe same line in all of them"), (2, "first of other row\n" + own), (2, None), (3, alpha + "!"), (4, "whole row twice"), (4, "whole row twice")]
    out = lines.dedup(spark.createDataFrame(rows, "doc_id int, text string"))
    got = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    assert got == [(1, "the same line in all of them"), (2, ""), (2, alpha), (2, "first of other row\n" + own), (3, ""), (4, ""), (4, "whole row twice")]


def test_lines_with_clashing_names_and_other_ids(spark):
    rows = [("b", "x y z one", 1, 2, 3), ("a", "x y z one\nmore", 4, 5, 6), (None, "x y z one", 7, 8, 9)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, N_LINES_ int, n_removed_ int, _row int")
    out = lines.dedup(docs)
    assert out.columns == [*docs.columns, "n_lines__", "n_removed__"]
    assert by_id(out, "text", "N_LINES_", "n_removed__") == {"b": ("", 1, 1), "a": ("x y z one\nmore", 4, 0), None: ("x y z one", 7, 0)}


def test_different_lines_of_one_hash_both_stay():
    rows = np.zeros(3, lines._PLACE)
    rows["key"], rows["check"], rows["doc"] = 5, [1, 2, 1], [0, 1, 2]
    first, again = lines._split(rows)
    assert first["doc"].tolist() == [0, 1] and again["doc"].tolist() == [2]


def test_lines_keep_other_rows(spark):
    out = lines.dedup(documents(spark, repeat=True, null_id=True))
    assert out.count() == documents(spark, repeat=True, null_id=True).count()
    assert [r["text"] for r in out.where("doc_id is null").collect()] == ["a text without an id"]
    assert lines.dedup(empty(spark)).count() == 0


def test_spans_equal_brute_force(spark):
    for repeat in (False, True):
        out = spans.dedup(documents(spark, repeat=repeat, null_id=repeat))
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept"].encode()).hexdigest()) for r in out.collect()}
        assert got == spans.brute_force({i: t or "" for i, t in enumerate(texts())})
    assert spans.dedup(empty(spark)).count() == 0


def test_runs_hold_each_window_once():
    raw = [(t or "").encode() for t in texts()]
    rows, begins = spans.runs(raw)
    assert int(rows["n"].sum()) == sum(max(0, n - spans.WINDOW + 1) for n in np.diff(begins).tolist())
    cut, _ = spans.runs(raw, segment=64)  # a text of more windows than one segment holds
    windows = lambda r: sorted((d, s + i) for d, s, n in zip(r["doc"].tolist(), r["start"].tolist(), r["n"].tolist(), strict=True) for i in range(n))
    assert windows(cut) == windows(rows) and len(cut) > len(rows)


def test_paths_end_where_a_node_branches(spark):
    # In document 1 three pieces follow each other; one more piece leaves the node (8) between the second and the third.
    rows = [(10, 1, 0, 5, 1, 7), (11, 1, 5, 2, 7, 8), (12, 1, 7, 4, 8, 9), (13, 2, 0, 1, 8, 5), (14, 1, 30, 3, 9, 4)]
    pathed = spans.paths(spark.createDataFrame(rows, "piece bigint, doc_id bigint, start int, n int, head bigint, tail bigint"))
    assert {r["piece"]: (r["source"], r["path"]) for r in pathed.collect()} == {10: (1, 0), 11: (1, 0), 12: (1, 7), 13: (2, 0), 14: (1, 30)}
    again = spark.createDataFrame([(10, 5, 100, 5), (11, 5, 105, 2), (12, 5, 107, 4), (11, 6, 0, 2)], "piece bigint, doc_id bigint, start int, n int")
    got = sorted(tuple(r) for r in spans.spans_of(again, pathed).collect())
    assert got == [(5, 100, 7, 1, 0), (5, 107, 4, 1, 7), (6, 0, 2, 1, 5)]


def test_nodes_of_one_half_in_common_stay_apart(spark):
    """Piece 2 follows piece 1; pieces 3 and 4 end and begin at nodes that differ from theirs in one half only."""
    node = (5 << 32) + 9
    rows = [(1, 1, 0, 4, 1, node), (2, 1, 4, 4, node, 2), (3, 2, 0, 4, 3, node + 1), (4, 3, 0, 4, node + (1 << 32), 4)]
    pathed = spans.paths(spark.createDataFrame(rows, "piece bigint, doc_id bigint, start int, n int, head bigint, tail bigint"))
    assert {r["piece"]: r["path"] for r in pathed.collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    found, _ = spans.runs([b" ".join(b"w%d" % i for i in range(4000))])
    assert len(found) > 100 and len(set(found["head"].tolist())) == len(found) and (found["head"] >> np.uint64(32)).any() and (found["head"] & np.uint64(0xFFFFFFFF)).any()
    assert found["tail"][:-1].tolist() == found["head"][1:].tolist()
    kept = spans._rows([(spans.PIECE, spans._as(found, spans._PIECE))])
    assert (kept["head"].to_numpy().view(np.uint64) == found["head"]).all() and (kept["tail"].to_numpy().view(np.uint64) == found["tail"]).all()


def test_a_span_goes_only_if_its_words_are_those_of_its_source():
    words = [b"w%d" % i for i in range(30)]
    right = spans.word_digest(words, 2, 1)
    assert len(spans._kept(words, [{"start": 2, "n": 1, "digest": right}])) == 10
    assert spans._kept(words, [{"start": 3, "n": 1, "digest": right}]) == words


def test_word_hashes_do_not_depend_on_place():
    a, _ = vec.words([b"x Foo bar", b"foo  BAR"], fold=True)
    assert a[1] == a[3] and a[2] == a[4] and len(set(a.tolist())) == 3
    b, begins = vec.words([b"x Foo bar", b"", b"foo"], fold=False)
    assert b[1] != b[3] and begins.tolist() == [0, 3, 3, 4]


def missed(signatures, bands, union=60, pairs=20_000, rounds=5):
    """The share of pairs of random sets of similarity 0.8 whose signatures share no band."""
    rng, shared, own, missing = np.random.default_rng(3), union * 8 // 10, union // 10, 0
    for _ in range(rounds):
        common = rng.integers(0, 1 << 63, (pairs, shared), dtype=np.uint64)
        a, b = (signatures(np.concatenate([common, rng.integers(0, 1 << 63, (pairs, own), dtype=np.uint64)], 1)) for _ in range(2))
        missing += pairs - int(np.any([(a[x] == b[x]).all(0) for x in bands], axis=0).sum())
    return missing / (pairs * rounds)


def test_line_bands_miss_few_pairs_at_the_threshold():
    def signatures(sets):
        return vec.minima((sets >> np.uint64(31)).astype(np.uint32).ravel(), np.arange(len(sets)) * sets.shape[1], lines.MINIMA)

    assert missed(signatures, lines._DRAWN) < 1e-4


def test_register_bands_miss_few_pairs_at_the_threshold():
    assert missed(lambda sets: neardup.registers(list(sets)), neardup._DRAWN, pairs=10_000, rounds=4) < 1e-4


def test_families_let_all_pairs_of_a_bucket_meet(spark, monkeypatch):
    """In one square where that is less, else bucket by bucket; never more rows than the cheaper of both."""
    monkeypatch.setattr(lsh, "BLOCK", 4)
    chain = [(k, (i,)) for k in range(20) for i in (k, k + 1, k + 2)]  # 22 items, 20 buckets of 3
    shared = [(100 + k, (100 + i,)) for k in range(30) for i in range(12) if i != k % 12]  # 12 items, 30 buckets of 11
    small = [(200, (200 + i,)) for i in range(3)]
    keys: dict[int, list[int]] = {}
    for key, (item,) in chain + shared + small:
        keys.setdefault(key, []).append(item)
    rows = [(item, item % 3, key, len(items)) for key, items in keys.items() for item in items]
    sets = spark.createDataFrame(rows, "item bigint, root bigint, key bigint, n bigint")
    out = lsh.blocked(lsh.families(sets, 12), 12).collect()
    held: dict[int, set[int]] = {}
    for r in out:
        assert r["root"] == r["item"] % 3
        held.setdefault(r["block"], set()).add(r["item"])
    for items in keys.values():
        for a in items:
            for b in items:
                assert any({a, b} <= block for block in held.values())
    assert sum(r["item"] < 100 for r in out) == 60 and sum(100 <= r["item"] < 200 for r in out) == 36 and len(out) == 99
    empty = spark.createDataFrame([], sets.schema)
    assert lsh.families(empty, 12).count() == 0
