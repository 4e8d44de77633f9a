import pytest
from hypothesis import given
from hypothesis import strategies as st

from dyadix.plans import costmodel, layout

TOTALS = {16: 134, 32: 323, 48: 540, 63: 688, 64: 692, 96: 994, 128: 1160, 256: 2253, 384: 3407, 512: 4500, 1024: 8994, 8192: 71910}


@pytest.mark.parametrize("length, total", TOTALS.items())
def test_feature_totals(length, total):
    assert sum(len(layout.features(n)) for n in layout.representation_lengths(length).values()) == total


@pytest.mark.parametrize("length, want", [(32, (89, 290, 112, 32, 702)), (64, (120, 642, 192, 0, 2046))])
def test_golden_counts(length, want):
    c = costmodel.counts(length)
    assert (c["n_intervals"], c["total_width"], c["n_quantiles"], c["n_points"], costmodel.sort_work(length, 6)) == want


@given(st.integers(3, 3000), st.integers(1, 8), st.integers(1, 6))
def test_closed_forms_equal_enumeration(length, depth, div):
    ivs = layout.intervals(length, depth)
    assert costmodel.n_intervals(length, depth) == len(ivs)
    assert costmodel.total_width(length, depth) == sum(iv.width for iv in ivs)
    assert costmodel.n_quantiles(length, depth, div) == len(layout.features(length, depth, div))
    assert all(0 <= iv.start < iv.end <= length for iv in ivs)


def test_lower_median_differs_only_at_the_known_lengths():
    odd = [n for n in range(3, 400) if layout.intervals(n) != layout.intervals(n, lower_median=True)]
    assert odd == [3, 6, 12, 24, 48]


def test_names():
    names = layout.feature_names(64, "exact")
    assert len(names) == 692 and len(set(names)) == 678
    assert len(layout.feature_names(64, "exact", channels=2)) == 1384
    assert names[0] == "raw_iv[0:64]_d0_q0.00_exact"


def test_short_series_are_refused():
    with pytest.raises(ValueError):
        layout.representation_lengths(2)


@pytest.mark.parametrize("length", [3, 48, 64, 97])
@pytest.mark.parametrize("lower", [False, True])
def test_engine_layout_equals_driver_layout(spark, length, lower):
    got = [(r.interval_id, r.depth, r.shifted, r.s, r.e) for r in layout.interval_table(spark, length, lower_median=lower).orderBy("interval_id").collect()]
    assert got == [(iv.interval_id, iv.depth, iv.shifted, iv.start, iv.end) for iv in layout.intervals(length, 6, lower)]


def test_crossover_is_where_costs_meet():
    c, k, s = (1e-8, 2e-8, 1e-8), costmodel.overhead_curve(4e-5, 2e-4), costmodel.power_curve(1e-5, 1e-6, 0.5)
    n = costmodel.crossover("exact", 128, 6, 4, c, k, (2e-8, 2e-8, 1e-8), s)
    a, b = costmodel.intervals_cost("exact", n, 128, 6, 4, c, k), costmodel.series_cost("exact", n, 128, 6, 4, (2e-8, 2e-8, 1e-8), s)
    assert a == pytest.approx(b)
    assert costmodel.crossover("exact", 128, 6, 4, (1, 1, 1), k, (0, 0, 0), lambda n: 0.0) is None
    with pytest.raises(ValueError):
        costmodel.overhead_curve(0.0, 1.0)(10)
