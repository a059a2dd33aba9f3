import numpy as np

from syllabrook.llm.neighbours import nearest


def test_copies_hide_no_neighbours(spark):
    rng = np.random.default_rng(1)
    a, turn = rng.normal(size=64), rng.normal(size=64)
    rows = [(i, a.tolist()) for i in range(400)]
    # two near copies, nearer to each other than to the copies, with all copies between their ids
    rows += [(-1, (a + 0.05 * turn).tolist()), (1000, (a + 0.051 * turn).tolist())]
    rows += [(2000 + i, rng.normal(size=64).tolist()) for i in range(40)]
    out = nearest(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v", k=5, curves=2, window=16).collect()
    lists: dict[int, list[int]] = {}
    for r in sorted(out, key=lambda r: (r.id, r.rank)):
        lists.setdefault(r.id, []).append(r.other)
    assert len(lists) == len(rows) and all(len(x) == 5 for x in lists.values())
    assert lists[0] == [1, 2, 3, 4, 5] and lists[3] == [0, 1, 2, 4, 5] and lists[399] == [0, 1, 2, 3, 4]
    assert lists[-1] == [1000, 0, 1, 2, 3] and lists[1000] == [-1, 0, 1, 2, 3]
