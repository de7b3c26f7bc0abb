import random
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeline.llm import packing
from ridgeline.llm.common import n_words

SCHEMA = "doc_id long, text string, pid int, length int"


@given(st.lists(st.integers(1, 100), max_size=200))
@settings(deadline=None, max_examples=60)
def test_bins_hold_their_pieces(lengths):
    lengths = sorted(lengths, reverse=True)
    caps = (10, 40, 100)
    got = packing.pack(lengths, caps)
    bins = defaultdict(list)
    for n, (b, off, cap, load) in zip(lengths, got):
        bins[b].append((off, n, cap, load))
    for own in bins.values():
        at = 0
        for off, n, _, _ in sorted(own):
            assert off == at
            at += n
        assert all(load == at for *_, load in own) and own[0][2] == min(c for c in caps if c >= at)
    if lengths:
        assert sum(own[0][2] for own in bins.values()) <= 2 * sum(lengths) + 100


def plainly(lengths, opened, sizes):
    """The rule of pack(), bin by bin."""
    bins = []  # room, load, pieces
    where = []
    for j, n in enumerate(lengths):
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= n]
        if fits:
            room = min(fits)[0]
            i = max(i for r, i in fits if r == room and bins[i][2] == max(bins[k][2] for q, k in fits if q == room))
        else:
            def per_token(c):
                later = sum(x for x in lengths[j + 1 :] if x <= c - n)
                return (packing.price(c) / (n + min(c - n, later)), -c)

            bins.append([min((c for c in opened if c >= n), key=per_token), 0, 0])
            i = len(bins) - 1
        where.append(i)
        bins[i][0] -= n
        bins[i][1] += n
        bins[i][2] = j
    return sum(packing.price(min(c for c in sizes if c >= b[1])) for b in bins), sorted(b[1] for b in bins)


@given(st.lists(st.integers(1, 100), max_size=60))
@settings(deadline=None, max_examples=80)
def test_choices_against_the_plain_rule(lengths):
    lengths, sizes = sorted(lengths, reverse=True), [10, 40, 100]
    want = min((plainly(lengths, sizes[i:], sizes) for i in range(3)), key=lambda x: x[0])
    bins = {b: (cap, load) for b, _, cap, load in packing.pack(lengths, sizes)}
    assert sum(packing.price(c) for c, _ in bins.values()) == want[0]


def total(lengths, sizes):
    bins = {b: cap for b, _, cap, _ in packing.pack(sorted(lengths, reverse=True), sizes)}
    return sum(map(packing.price, bins.values())), Counter(bins.values())


def test_several_lengths_cost_less_than_one():
    rng = random.Random(1)
    lengths = [min(8192, int(rng.lognormvariate(5.5, 1.2)) + 1) for _ in range(5000)]
    cost, used = total(lengths, (512, 2048, 8192))
    assert all(used[c] > 20 for c in (512, 2048, 8192))
    assert cost < 0.97 * total(lengths, (8192,))[0]


def test_the_length_opened_follows_what_is_left():
    # Alone, pieces of 1500 leave bins of 2048 a quarter empty, and the longest bins are cheapest; short pieces fill them up.
    assert set(total([1500] * 500, (2048, 8192))[1]) == {8192}
    assert set(total([1500] * 500 + [100] * 3000, (2048, 8192))[1]) == {2048}


def test_best_fit_and_least_cost():
    # 60 opens the bin that can be filled; 40 fits there exactly; the last piece opens the least length.
    assert [x[0] for x in packing.pack([60, 40, 7], (10, 100))] == [0, 0, 1]
    assert packing.pack([7], (10, 100))[0][2] == 10


def test_whole_table(spark):
    rows = [(i, " ".join(["w"] * n), 1, 1) for i, n in enumerate([0, 1, 5, 30, 31, 100, 7, 7, 7])] + [(None, "a b", 0, 0), (3, "a b c", 0, 0), (3, "a b c", 0, 0), (9, None, 0, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.best_fit(df.repartition(3), n_words("text"), ["doc_id"], (8, 30), per_group=4).collect()
    pieces = defaultdict(int)
    for r in got:
        pieces[r["doc_id"]] += r["length"]
        assert r["bin_offset"] + r["length"] <= r["bin_load"] <= r["bin_capacity"] and r["length"] <= 30
    assert pieces == {1: 1, 2: 5, 3: 30 + 6, 4: 31, 5: 100, 6: 7, 7: 7, 8: 7, None: 2}
    loads = defaultdict(int)
    for r in got:
        loads[r["bin_id"]] += r["length"]
    assert all(loads[r["bin_id"]] == r["bin_load"] for r in got)
    again = packing.best_fit(df.coalesce(1), n_words("text"), ["doc_id"], (8, 30), per_group=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert packing.best_fit(spark.createDataFrame([], SCHEMA), n_words("text"), ["doc_id"]).count() == 0
