"""Packing against a plain best-fit, and the invariants of a packing."""

import numpy as np

from reviewloom.llm.common import table
from reviewloom.llm.packing import SIZES, pack, pack_documents


def plain(lengths, sizes):
    """(bin of each piece, final size and contents of each bin), by looking at all bins and all waiting pieces."""
    bins, turn, place = [], [], []  # [size, used], when last filled
    for i, length in enumerate(lengths):
        fits = [b for b, (c, u) in enumerate(bins) if c - u >= length]
        if fits:
            b = min(fits, key=lambda b: (bins[b][0] - bins[b][1], -turn[b]))
        else:
            costs = []
            for c in sizes:
                if c >= length:
                    room = c - length
                    for other in lengths[i + 1 :]:  # longest first
                        if other <= room:
                            room -= other
                    costs.append(((16 + c * (1 + c / (4 * max(sizes)))) / (c - room), c))
            bins.append([min(costs)[1], 0])
            turn.append(0)
            b = len(bins) - 1
        place.append(b)
        bins[b][1] += length
        turn[b] = i
    return place, [min(c for c in sizes if c >= u) for _, u in bins], [u for _, u in bins], [c for c, _ in bins]


def test_pack_equals_plain_best_fit():
    rng = np.random.default_rng(0)
    larger = smaller = 0
    for turn in range(60):
        sizes = ((16, 32, 64), (512, 1024, 2048, 4096), (40, 100))[turn % 3]
        lengths = np.sort(np.minimum(rng.geometric((0.02, 0.004, 0.05)[turn % 3], 80), sizes[-1]))[::-1]
        bins, offsets, size, used = pack(lengths, sizes)
        want, want_size, want_used, opened = plain(lengths.tolist(), sizes)
        assert (bins.tolist(), size.tolist(), used.tolist()) == (want, want_size, want_used)
        first = {b: n for b, n in zip(want[::-1], lengths[::-1].tolist())}
        larger += sum(c > min(x for x in sizes if x >= first[b]) for b, c in enumerate(opened))
        smaller += sum(c > f for c, f in zip(opened, want_size))
        for b in range(len(size)):
            own = sorted((offsets[i], lengths[i]) for i in np.flatnonzero(bins == b))
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and sum(n for _, n in own) == used[b]
    # The choice of a size is a real one.
    assert larger > 50
    assert [len(x) for x in pack(np.zeros(0, np.int64))] == [0, 0, 0, 0]


def test_a_larger_size_wins_where_the_smallest_stays_half_empty():
    bins, _, size, used = pack(np.full(12, 300))
    assert size.tolist() != [512] * 12 and (used / size).min() > 0.8
    # Alone, a piece takes the smallest size that holds it.
    assert pack(np.array([300]))[2].tolist() == [512]
    # Opened for more than it got in the end, a bin is downsized to what it holds.
    assert pack(np.array([600, 500, 100]))[2].tolist() in ([2048], [1024, 512])


def check(docs, packed):
    want = sorted((len((r.text or "").encode().split()) + 1) for r in docs.collect())
    rows = packed.collect()
    by_row, by_bin = {}, {}
    for r in rows:
        by_row.setdefault(r.row_id, []).append(r)
        by_bin.setdefault((r.shard, r.bin), []).append(r)
    assert sorted(sum(p.length for p in own) for own in by_row.values()) == want
    for own in by_row.values():
        own.sort(key=lambda p: p.piece)
        assert [p.start for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
    for own in by_bin.values():
        own.sort(key=lambda p: p.offset)
        total = sum(p.length for p in own)
        assert [p.offset for p in own] == np.cumsum([0, *[p.length for p in own]])[:-1].tolist()
        assert {p.bin_used for p in own} == {total} and {p.bin_size for p in own} == {min(s for s in SIZES if s >= total)}
    return rows


def test_documents_are_whole_and_bins_hold(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    rows = check(docs, pack_documents(docs, shard_pieces=300))
    assert len({r.shard for r in rows}) > 1
    bins = {(r.shard, r.bin): (r.bin_used, r.bin_size) for r in rows}
    assert sum(u for u, _ in bins.values()) / sum(s for _, s in bins.values()) > 0.9


def test_odd_rows(spark):
    rows = [(1, None, 1), (None, "", 2), (2, "a b", 3), (2, "a b", 4), (3, "w " * 50_000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int")
    assert len(check(docs, pack_documents(docs))) == 4 + -(-50_001 // 4096)
    assert pack_documents(docs.limit(0)).count() == 0
