import random

import pytest

from weftline.llm import mixing
from weftline.llm.mixing import allocate, mix_sources, pivot, pool_pivot, share_report
from weftline.llm.packing import fill_report, pack, pack_items
from weftline.llm.tokens import PART, encoding, n_tokens, with_sizes

CAPS = [512, 2048, 8192]


def test_pack_is_whole_and_tight():
    rng = random.Random(1)
    sizes = [min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)] + [8192, 512, 1]
    bins = pack(sizes, CAPS)
    assert sorted(i for _, items in bins for i in items) == list(range(len(sizes)))
    for cap, items in bins:
        used = sum(sizes[i] for i in items)
        assert used <= cap and cap == min(c for c in CAPS if c >= used)
    assert sum(sizes) / sum(c for c, _ in bins) > 0.99
    assert pack([], CAPS) == []


def test_every_capacity_is_weighed():
    assert {c for c, _ in pack([750] * 40, [1000, 1500, 4000])} == {1500}  # the largest would leave 6 %, the least 25 %
    assert [c for c, _ in pack([900, 90, 10, 700, 5], [1000, 4000])] == [1000, 1000]
    mixed = pack([1000] * 7 + [333] * 9, [1000, 2100])
    assert {c for c, items in mixed if 0 in items} == {1000} and sum(c for c, _ in mixed) == 10_000
    rng = random.Random(3)
    for caps in ([512, 2048, 8192], [100, 130, 170], [64]):
        sizes = [rng.randrange(1, max(caps) + 1) for _ in range(800)]
        joint, single = (sum(c for c, _ in pack(sizes, k)) for k in (caps, caps[-1:]))
        assert joint <= single


@pytest.mark.parametrize("block", [50, 100_000])
def test_pack_items(spark, block):
    rng = random.Random(2)
    rows = [(i, rng.randrange(1, 700), "x") for i in range(400)] + [(900, 20000, "x"), (901, 8192, "x"), (902, 0, "x"), (903, None, "x"), (None, 5, "x")]
    packed = pack_items(spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, bin string"), CAPS, block).collect()
    by_doc, by_bin = {}, {}
    for r in packed:
        by_doc.setdefault(r.doc_id, []).append((r.part, r.n_tokens))
        by_bin.setdefault((r.bin, r.capacity), []).append(r.n_tokens)
    assert {d: sum(n for _, n in p) for d, p in by_doc.items()} == {d: n for d, n, _ in rows if d is not None and n}
    assert all(len(p) == 1 for d, p in by_doc.items() if d != 900) and sorted(by_doc[900]) == [(0, 8192), (1, 8192), (2, 3616)]
    assert len({b for b, _ in by_bin}) == len(by_bin) and all(sum(v) <= c for (_, c), v in by_bin.items())
    assert sum(r.n_tokens for r in packed) / sum(c for _, c in by_bin) > 0.97


def test_pack_nothing(spark):
    empty = spark.createDataFrame([], "doc_id bigint, n_tokens bigint")
    assert fill_report(pack_items(empty, CAPS)).count() == 0
    with pytest.raises(ValueError):
        pack_items(empty, [])


def test_pivots_keep_mass_and_chance():
    rng = random.Random(4)
    sizes = [(i, rng.randrange(1, 1000)) for i in range(300)]
    for seed in range(5):
        out = dict(pool_pivot(sizes, 0.37, seed))
        assert sum(0 < x < 1 for x in out.values()) <= 1
        assert sum(out[i] * s for i, s in sizes) == pytest.approx(0.37 * sum(s for _, s in sizes))
        loose = dict(pivot([(i, s, 0.2 + 0.6 * (i % 2)) for i, s in sizes], seed))
        assert sum(0 < x < 1 for x in loose.values()) <= 1
        assert sum(loose[i] * s for i, s in sizes) == pytest.approx(sum(s * (0.2 + 0.6 * (i % 2)) for i, s in sizes))
    for way in (lambda seed: pool_pivot(sizes, 0.37, seed), lambda seed: pivot([(i, s, 0.37) for i, s in sizes], seed)):
        assert abs(sum(dict(way(seed))[5] for seed in range(400)) / 400 - 0.37) < 0.1


def test_mix_is_the_same_however_rows_are_split(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET", 50)  # several levels of the tree
    rng = random.Random(9)
    rows = [(i, rng.choice("aab"), rng.randrange(1, 300)) for i in range(2500)]
    sized = spark.createDataFrame(rows, "doc_id bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3)], "source string, target_share double, max_repeats int")
    one, many = ({(r.doc_id, r.copies) for r in mix_sources(sized.repartition(n), targets).collect()} for n in (1, 7))
    assert one == many and len(one) == 2500
    total = {s: sum(n * c for (i, t, n), (_, c) in zip(rows, sorted(one), strict=True) if t == s) for s in "ab"}
    has = sum(n for _, _, n in rows)
    assert all(abs(total[s] / has - share) < 300 / has for s, share in (("a", 0.6), ("b", 0.4)))


def test_allocate():
    got = allocate({"a": 100, "b": 100, "c": 10}, {"a": (0.5, 1), "b": (0.3, 2), "c": (0.2, 3), "none": (0.0, 1), "gone": (0.1, 5)}, 200)
    assert got["c"] == 30 and got["a"] == 100 and got["b"] == pytest.approx(70) and got["gone"] == 0 and got["none"] == 0


def test_mix(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["big", "big", "small", None, "other"]), rng.randrange(1, 300)) for i in range(3000)] + [(9001, "big", None), (9002, "tiny", 40)]
    sized = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id bigint, source string, n_tokens bigint, p double").repartition(5, "doc_id")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("tiny", 0.1, 2), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed = mix_sources(sized, targets)
    got = {r.doc_id: (r.source, r.copies) for r in mixed.collect()}
    assert set(got) == {d for d, s, _ in rows if s in ("big", "small", "tiny")} and got[9001][1] == 0 and got[9002][1] == 2
    report = {r.source: r for r in share_report(mixed, targets).collect()}
    assert report["big"].most_copies <= 1 and report["small"].most_copies <= 3 and report["absent"].used_tokens == 0
    ratio = report["small"].used_tokens / report["big"].used_tokens
    assert ratio == pytest.approx(0.8, abs=0.005) and sum(r.actual_share for r in report.values()) == pytest.approx(1)
    assert mix_sources(sized.where("false"), targets).count() == 0


def test_token_counts(spark):
    enc = encoding.__wrapped__
    text = "Hello, world! " * 3 + "naïve 東京 <|endoftext|>\n\n  x"
    from weftline.llm.tokens import RANKS

    assert n_tokens(text) == len(encoding(RANKS).encode_ordinary(text)) and n_tokens("") == n_tokens(None) == 0 and enc
    long = "lorem ipsum dolor, sit amet 12 times. " * (PART // 8)
    assert n_tokens(long) == len(encoding(RANKS).encode_ordinary(long))
    df = spark.createDataFrame([(1, "a b", 7), (2, None, 7), (3, "", 7)], "doc_id bigint, text string, n_tokens int")
    assert sorted(tuple(r) for r in with_sizes(df, ["doc_id"]).collect()) == [(1, 2), (2, 0), (3, 0)]
