import itertools
import random

import numpy as np
import pytest

from quern.llm.neardup import BKTree, bands_for, class_links, duplicate_groups, hot_bands, near_duplicate_pairs, near_values, radius_for, text_classes
from quern.llm.words import words


def corpus(seed=1, families=12, copies=5, size=40):
    rng = random.Random(seed)
    vocab = [f"слово{i}" for i in range(400)]
    rows = []
    for f in range(families):
        base = [rng.choice(vocab) for _ in range(size)]
        for c in range(copies):
            w = base[:]
            for _ in range(c):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.pop(i), lambda: w.insert(i, rng.choice(vocab)), lambda: w.__setitem__(i, rng.choice(vocab))])()
            rows.append(("t", f"{f}-{c}", " ".join(w)))
        rows.append(("t", f"{f}-same", " ".join(base).upper() + "!!"))
        rows.append(("u", f"{f}-other", " ".join(base)))
    return rows + [("t", "null", None), ("t", None, rows[0][2]), ("t", "empty", ""), ("t", "short", "одно слово"), ("t", "long", "очень длинный текст " * 20_000), rows[0], rows[0]]


def brute(rows, run, least, threshold):
    sets = {}
    for tbl, key, text in rows:
        w = words(text)
        if key and len(w) >= max(least, run):
            sets[tbl, key] = {tuple(w[i : i + run]) for i in range(len(w) - run + 1)}
    out = {}
    for (ta, a), (tb, b) in itertools.combinations(sorted(sets), 2):
        x, y = sets[ta, a], sets[tb, b]
        j = len(x & y) / len(x | y)
        if ta == tb and j >= threshold:
            out[ta, a, b] = j
    return out


@pytest.mark.parametrize("limit", [4096, 2])
def test_pairs_against_brute_force(spark, limit):
    rows = corpus()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "tbl string, key string, text string, band int, sh int")
    got = near_duplicate_pairs(df, limit=limit).collect()
    pairs = {(r["tbl"], r["key_a"], r["key_b"]): r["similarity"] for r in got}
    want = brute(rows, 3, 20, 0.5)
    assert len(got) == len(pairs) and set(pairs) <= set(want)
    assert {k: want[k] for k in want if k not in pairs and want[k] >= 0.6} == {}
    assert len(pairs) >= 0.97 * len(want)
    assert all(abs(pairs[k] - want[k]) < 1e-6 for k in pairs)


def test_a_hot_group_of_copies(spark):
    rows = [("t", f"c{i}", "это один и тот же текст который повторили очень много раз подряд без всяких правок кроме знаков и больше ничего") for i in range(60)] + corpus(2, 3, 2)
    df = spark.createDataFrame(rows, "tbl string, key string, text string").repartition(3)
    assert near_duplicate_pairs(df, limit=8).where("key_a like 'c%' and key_b like 'c%'").count() == 60 * 59 // 2
    groups = duplicate_groups(df)
    assert groups.count() == len({(t, k) for t, k, x in rows if k and len(words(x)) >= 5})
    assert groups.where("key like 'c%'").select("cls").distinct().count() == 1


def test_empty(spark):
    empty = spark.createDataFrame([], "tbl string, key string, text string")
    assert near_duplicate_pairs(empty).count() == 0 and duplicate_groups(empty).count() == 0


def test_every_record_has_a_group(spark):
    texts = {"a": "Ну такое", "b": "ну, такое!", "c": "такое ну", "d": "...", "e": "...", "f": "?!", "g": "", "h": None, "i": "раз два три четыре пять шесть", "j": "Раз, два: три четыре пять шесть"}
    df = spark.createDataFrame([("t", k, x) for k, x in texts.items()] + [("t", "a", texts["a"])], "tbl string, key string, text string").repartition(3)
    got = duplicate_groups(df, short=True).collect()
    cls = {r["key"]: r["cls"] for r in got}
    assert len(got) == len(cls) == len(texts) and {r["links"] for r in got} == {0}
    assert {k for k in cls if cls[k] is None} == {"h"}
    groups = {}
    for k, c in cls.items():
        groups.setdefault(c, set()).add(k)
    assert sorted(map(sorted, groups.values())) == [["a", "b"], ["c"], ["d", "e"], ["f"], ["g"], ["h"], ["i", "j"]]


def test_the_query_of_groups_has_every_record(spark, tmp_path):
    from quern.llm.neardup_queries import p3_groups

    spark.createDataFrame([(1, "c", "Ну такое"), (2, "c", "ну такое"), (3, "c", None)], "id bigint, channel string, text string").write.parquet(str(tmp_path / "messages.parquet"))
    spark.createDataFrame([(7, None), (8, "?")], "article_id bigint, content_text string").write.parquet(str(tmp_path / "articles.parquet"))
    got = {(r["tbl"], r["key"]): r["cls"] for r in p3_groups(spark, str(tmp_path)).collect()}
    assert len(got) == 5 and got["messages", "c:1"] == got["messages", "c:2"] != None  # noqa: E711
    assert got["messages", "c:3"] is None and got["articles", "7"] is None and got["articles", "8"] is not None


def test_pairs_alike_by_frequent_shingles_only(spark):
    """Reposts of one text with own words added, and pairs with own words of which a few are shared."""
    hot, n = " ".join(f"общее{i}" for i in range(102)), itertools.count()
    own = lambda k: " ".join(f"своё{next(n)}" for _ in range(k))
    rows = [("t", f"a{i}", f"{hot} {own(i)}".strip()) for i in range(6)] + [("t", f"b{i}", f"{hot} {own(80)}") for i in range(30)]
    part = " ".join(hot.split()[:47])
    for i in range(30):
        both = own(24)
        rows += [("t", f"c{i}-{k}", f"{part} {both} {own(31)}") for k in "xy"]
    rows += [("t", f"d{i}", own(150)) for i in range(100)]
    df = spark.createDataFrame(rows, "tbl string, key string, text string").repartition(4)
    got = {(r["tbl"], r["key_a"], r["key_b"]) for r in near_duplicate_pairs(df).collect()}
    want = brute(rows, 3, 20, 0.5)
    assert got <= set(want)
    for kind, least in (("ab", 0.95), ("cc", 0.9)):
        of = [k for k in want if k[1][0] + k[2][0] == kind]
        assert len(of) >= 30 and len(got & set(of)) >= least * len(of), (kind, len(of), len(got & set(of)))


def test_tree_finds_all_within_the_radius():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(300)] + [0, 0]
    tree = BKTree(values[0], 0)
    for i, v in enumerate(values[1:], 1):
        tree.add(v, i)
    for r in (0, 20, 30):
        for q in values[:40]:
            assert sorted(tree.within(q, r)) == [i for i, v in enumerate(values) if (q ^ v).bit_count() <= r]
    assert 16 < radius_for(0.5) < 32


def test_searches_of_all_values_at_once():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 20, dtype=np.int64).astype(np.uint64)
    values = np.r_[np.repeat(base, 30) ^ (np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)), rng.integers(0, 2**63, 400, dtype=np.int64).astype(np.uint64)]
    values = np.stack([values, rng.permutation(values)], axis=1)
    values[:600, 1] = 7
    for radius in (0, 2, 47):
        near = np.bitwise_count(values[:, None] ^ values[None, :]).sum(axis=2) <= radius
        a, b = near_values(values, radius)
        assert sorted(zip(a.tolist(), b.tolist())) == [(x, y) for x, y in zip(*map(np.ndarray.tolist, np.nonzero(near))) if x < y]
        inner = np.arange(100, 300)
        a, b = near_values(values, radius, inner)
        assert len(a) == near[np.ix_(inner, np.r_[0:100, 300:1000])].sum()
    assert bands_for(0.5) == 28 and bands_for(0.8) < 14 and bands_for(1.0) == 1


def test_hot_bands_are_cut_before_they_are_shuffled(spark):
    rng, vocab = random.Random(9), [f"м{i}" for i in range(3000)]
    base = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(300):
        w = base[:]
        w[rng.randrange(60)] = f"x{i}"
        rows.append(("t", f"h{i}", " ".join(w)))
    rows += [("t", f"o{i}", " ".join(rng.choice(vocab) for _ in range(40))) for i in range(100)]
    df = spark.createDataFrame(rows, "tbl string, key string, text string").repartition(4)
    classes = text_classes(df, 3, 20)
    assert hot_bands(classes, 3, 28, 8, 100) and not hot_bands(classes, 3, 28, 8)
    want = {(a, b) for _, a, b in brute(rows, 3, 20, 0.5)}
    got = {(r["key_a"], r["key_b"]) for r in near_duplicate_pairs(df, limit=8, sample=100).collect()}
    assert got <= want and len(got) >= 0.999 * len(want) > 40_000


def test_links_between_classes(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "tbl string, key string, text string")
    cls = {(r["tbl"], r["key"]): r["cls"] for r in duplicate_groups(df).collect()}
    want = {(t, *sorted((cls[t, a], cls[t, b]))) for t, a, b in brute(rows, 5, 5, 0.8) if cls[t, a] != cls[t, b]}
    got = class_links(df).collect()
    assert {(r["tbl"], r["cls_a"], r["cls_b"]) for r in got} == want and len(got) == len(want)
