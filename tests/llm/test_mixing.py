import os
import random

import pytest

from quern.llm.mixing import fair_mix, mix_report, token_counts


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(i, "big" if i % 3 else "small", rng.randrange(5, 60)) for i in range(900)] + [(901, None, 10), (902, "unlisted", 10), (None, "big", 10), (903, "big", 0), (904, "big", None), (0, "small", 0)]
    sizes = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, tokens long, finish int")
    targets = spark.createDataFrame([("big", 0.5, 1, 7), ("small", 0.45, 3, 7), ("missing", 0.05, 2, 7), (None, 0.1, 1, 7), ("zero", 0.0, 1, 7)], "source string, target_share double, max_repeats long, tokens int")
    return sizes, targets


@pytest.mark.parametrize("budget", [100, 5000, 20_000, None])
def test_shares(tables, budget):
    sizes, targets = tables
    mix = fair_mix(sizes, targets, budget)
    got = mix.collect()
    have = {}
    for r in sizes.collect():
        if r["doc_id"] is not None and r["source"] in ("big", "small") and (r["tokens"] or 0) > 0:
            have[r["source"], r["doc_id"]] = r["tokens"]
    total = {s: sum(v for (x, _), v in have.items() if x == s) for s in ("big", "small")}
    budget = budget or sum(total.values())
    used = {s: sum(r["tokens"] for r in got if r["source"] == s) for s in total}
    full = min(budget, total["big"] + 3 * total["small"])
    assert full - 60 <= sum(used.values()) <= full
    assert len({(r["source"], r["doc_id"], r["copy_no"]) for r in got}) == len(got) and all(have[r["source"], r["doc_id"]] == r["tokens"] for r in got)
    assert max(r["copy_no"] for r in got if r["source"] == "small") <= 3 and all(r["copy_no"] == 1 for r in got if r["source"] == "big")
    if used["big"] < total["big"]:
        assert abs(used["big"] * 0.45 - used["small"] * 0.5) <= 120
    assert [r["finish"] for r in got] == sorted(r["finish"] for r in got)
    assert got == mix.collect()
    # finish times are running sums over the share, also across repeats
    for s, share in (("big", 0.5), ("small", 0.45)):
        total_s, mine = 0, [r for r in got if r["source"] == s]
        for r in mine:
            total_s += r["tokens"]
            assert r["finish"] == pytest.approx(total_s / share)
    report = {r["source"]: r for r in mix_report(mix, sizes, targets).collect()}
    assert report["big"]["tokens"] == used["big"] and report["missing"]["uses"] == 0


def test_empty(tables):
    sizes, targets = tables
    assert fair_mix(sizes.limit(0), targets).count() == 0
    assert fair_mix(sizes, targets.limit(0)).count() == 0


def test_token_counts(spark):
    path = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
    if not os.path.exists(path):
        pytest.skip("no tokenizer")
    df = spark.createDataFrame([(1, "a", "hello world"), (2, None, None), (3, "b", "")], "doc_id long, source string, text string")
    assert [(r["doc_id"], r["tokens"] > 0) for r in token_counts(df, path).collect()] == [(1, True), (2, False), (3, False)]
