import random

import numpy as np

from quern.llm.contamination import leaked_items, passage, seeds
from quern.llm.words import WordHasher


def test_leaks(spark):
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(5000)]
    text = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = {i: text(45) for i in range(30)} | {90: text(10)}
    docs, want = {}, set()
    for d in range(120):
        body = text(60)
        if d % 3 == 0:
            k = rng.randrange(30)
            n = rng.choice([14, 20, 40])
            part = items[k][5 : 5 + n]
            for e in range(len(part) // 7 - (n > 14)):
                i = 3 + e * 7 if d % 2 else rng.randrange(2, len(part) - 2)
                kind = rng.randrange(3)
                if kind == 0:
                    part[i] = "zz"
                elif kind == 1 and n > 20:
                    part.insert(i, "zz")
            body[30:30] = part
            want.add((d, k))
        elif d % 3 == 1:
            body[20:20] = items[d % 30][:9]
        docs[d] = " ".join(body).replace("w1 ", "W1,\n") if d % 2 else " ".join(body)
    rows = [(d, t, "x") for d, t in docs.items()] + [(500, None, "x"), (None, " ".join(items[0]), "x"), (501, "", "x"), (502, "a b " * 50_000 + " ".join(items[1]), "x"), (0, docs[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    ev = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(91, None), (None, "a"), (92, ""), (1, " ".join(items[1]))], "item_id long, text string")
    want |= {(502, 1)}
    for block in (20_000, 7):
        got = [(r["doc_id"], r["item_id"]) for r in leaked_items(df, ev, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert leaked_items(df.limit(0), ev).count() == 0 and leaked_items(df, ev.limit(0)).count() == 0


def test_passage_and_seeds():
    item = [f"i{k}" for k in range(30)]
    assert passage(item, item[3:17]) == (14, 0)
    assert passage(item, item[3:16]) is None
    changed = item[:7] + ["x"] + item[8:]
    assert passage(item, changed) == (30, 1)
    broken = [w if k % 4 else "x" for k, w in enumerate(item)]
    assert passage(item, broken) is None
    h = WordHasher()(item)
    other = h.copy()
    other[2] = np.uint64(5)
    assert seeds(h, "11011")[0] == seeds(other, "11011")[0] and seeds(h, "1111")[0] != seeds(other, "1111")[0]
    assert len(seeds(h[:3], "1111")) == 0


def test_every_place_of_edits(spark):
    """All places of one and of two words changed, dropped or added in the shortest passage, the rims of changed words too."""
    item = [f"k{i}" for i in range(14)]
    docs = {}
    for kind in ("change", "drop", "add"):
        for i in range(14):
            for j in range(i, 14):
                w = item[:]
                for p in sorted({i, j}, reverse=True):
                    if kind == "change":
                        w[p] = "zz"
                    elif kind == "drop":
                        del w[p]
                    else:
                        w.insert(p, "zz")
                # a word left out at the rim leaves no trace of a longer passage
                whole = kind != "drop" or 0 < i and j < 13
                docs[len(docs)] = (" ".join(["aa"] * 9 + w + ["bb"] * 9), whole)
    df = spark.createDataFrame([(k, t) for k, (t, _) in docs.items()], "doc_id long, text string")
    ev = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: r["edits"] for r in leaked_items(df, ev).collect()}
    assert {k for k, (_, whole) in docs.items() if whole} - set(got) == set()
    assert max(got.values()) == 2


def test_repeated_words_are_aligned_best():
    item = "a b a b c a b a b d e f g h i j k l a b".split()
    text = "a b c a b a b d e f g h i j k l a b".split()
    assert passage(item, text) == (20, 2)
