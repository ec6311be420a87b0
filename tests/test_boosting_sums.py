"""Sums of the nodes of a level: of two neighbours only the smaller is added up."""

import numpy as np

from neurotab.learn import boosting as bo


def test_half_of_the_rows_are_added_up(monkeypatch):
    rng = np.random.default_rng(5)
    cells = rng.integers(0, bo.BINS, (3000, 9)).astype(np.uint8)
    label = (cells[:, 0] > 12).astype(int) + (cells[:, 1] > 20)
    counted, features, plain = [], [], bo.histograms

    def watched(cells, places, used):
        counted.append(sum(len(p[0]) for p in places))
        features.append(len(used))
        return plain(cells, places, used)

    asked = []

    def checked(cells, at, own, place, before, used):
        sums = level_sums(cells, at, own, place, before, used)
        asked.append(sum(len(own[k]) for k in at))
        assert (sums == plain(cells, [place(k) for k in at], used)).all()
        return sums

    level_sums = bo.level_sums
    monkeypatch.setattr(bo, "histograms", watched)
    monkeypatch.setattr(bo, "level_sums", checked)
    bo.grow(bo.Plan(4, 5, 0.3, rows=0.9, features="sqrt", leave_out=1), cells, label, np.arange(3000) % 4, np.arange(3000), 3)
    assert set(features) == {3}  # the root of 9, not all features
    deeper = [(a, c) for a, c in zip(asked, counted, strict=True) if c < a]
    assert len(deeper) >= 12 and sum(c for _, c in deeper) <= sum(a for a, _ in deeper) / 2
    assert sum(counted) < 0.7 * sum(asked)


def test_blocks_of_rows_give_the_same_sums(monkeypatch):
    rng = np.random.default_rng(6)
    cells = rng.integers(0, bo.BINS, (500, 4)).astype(np.uint8)
    places = [(r, rng.integers(-99, 99, len(r)).astype(float), rng.integers(0, 99, len(r)).astype(float)) for r in np.split(rng.permutation(500), [7, 7, 300])]
    used = np.array([0, 2, 3])
    whole = bo.histograms(cells, places, used)
    monkeypatch.setattr(bo, "ROWS_AT_ONCE", 13)
    assert (bo.histograms(cells, places, used) == whole).all()
    for i, (rows, g, h) in enumerate(places):
        for j, f in enumerate(used):
            for b in range(bo.BINS):
                assert whole[i, :, j, b].tolist() == [g[cells[rows, f] == b].sum(), h[cells[rows, f] == b].sum()]


def test_columns_give_the_same_sums(monkeypatch):
    """Pairs, one number for g and h, parts of the table and blocks of rows change no sum."""
    rng = np.random.default_rng(7)
    n = 6000
    cells = rng.integers(0, bo.BINS, (n, 7)).astype(np.uint8)
    cells[:, 1], cells[:, 2], cells[:, 3] = 0, rng.integers(0, 2, n), bo.BINS - 1  # codes that very many rows have
    for most_g, most_h in ((bo.UNIT, bo.UNIT / 2), (4 * bo.UNIT, bo.UNIT), (3, 0)):
        g, h = rng.integers(-int(most_g), int(most_g) + 1, (3, n)).astype(float), rng.integers(0, int(most_h) + 1, (3, n)).astype(float)
        g[0], h[0] = most_g, most_h  # as large as they can be
        rows = np.arange(n)
        roots = [(rows, g[c], h[c]) for c in range(3)]
        nodes = [(r, g[c][r], h[c][r]) for c in range(3) for r in map(np.sort, np.split(rng.permutation(n), [3, 3, 40, 1500, 4000]))]
        for used in (np.arange(7), np.array([0, 2, 5]), np.array([4, 6])):
            for parts in (1, 8):
                for block in (bo.COLUMN_AT_ONCE, 1000):
                    monkeypatch.setattr(bo, "PARTS", 8)
                    monkeypatch.setattr(bo, "PAIRED", 100 * parts)
                    monkeypatch.setattr(bo, "COLUMN_AT_ONCE", block)
                    table = bo.Columns(cells)
                    for places in (roots, nodes, []):
                        assert (bo.histograms(table, places, used) == bo.histograms(cells, places, used)).all()


def test_a_row_is_added_up_once_for_two_features(monkeypatch):
    rng = np.random.default_rng(8)
    n, d = 9000, 10
    cells = rng.integers(0, bo.BINS, (n, d)).astype(np.uint8)
    label = (cells[:, 0] > 12).astype(int) + (cells[:, 1] > 20)
    added, alone = [], []
    sums, bincount = bo.level_sums, np.bincount

    def watched(x, weights=None, minlength=0):
        added.append(len(x) if weights is not None else 0)
        return bincount(x, weights, minlength)

    def level(cells, at, own, place, before, used):
        alone.append(2 * d * sum(len(own[k]) for k in at) * (0.5 if before else 1))  # g and h of a feature by themselves
        return sums(cells, at, own, place, before, used)

    monkeypatch.setattr(np, "bincount", watched)
    monkeypatch.setattr(bo, "level_sums", level)
    bo.grow(bo.Plan(3, 2, 0.3), cells, label, np.zeros(n, int), np.arange(n), 3)
    assert sum(added) < 0.4 * sum(alone)
