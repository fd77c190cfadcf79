"""Heat cells whose mean lies at the half of a thousandth."""

from kerbline.operators import cells

#: Metres and stress of a cell whose mean is 4.4375: sums of floats in these two orders round to 4.438 and 4.437.
ORDERS = (
    [(38.5, 3.0), (40.5, 8.0), (30.0, 1.0), (92 / 3, 2.0), (38.5, 3.0), (40.5, 8.0)],
    [(92 / 3, 2.0), (40.5, 8.0), (40.5, 8.0), (30.0, 1.0), (38.5, 3.0), (38.5, 3.0)],
)


def test_stress_of_a_cell_is_the_same_in_any_order_of_its_samples(spark):
    assert sorted(ORDERS[0]) == sorted(ORDERS[1])
    for order in ORDERS:
        samples = spark.createDataFrame([(1, 2, m, s) for m, s in order], "col long, row long, m double, stress double").coalesce(1)
        assert [tuple(r) for r in cells.stress_heat(samples).collect()] == [(1, 2, 218.667, 4.438, "medium")]


def test_bands_and_least_metres_hold_at_their_limits(spark):
    rows = [(0, 0, 10.0, 2.0), (0, 0, 20.0, 2.0), (1, 0, 30.0, 5.0), (2, 0, 29.9, 1.0), (3, 0, 15.0, 1.4), (3, 0, 15.0, 10.0)]
    got = cells.stress_heat(spark.createDataFrame(rows, "col long, row long, m double, stress double")).collect()
    assert sorted(map(tuple, got)) == [(0, 0, 30.0, 2.0, "low"), (1, 0, 30.0, 5.0, "medium"), (3, 0, 30.0, 5.7, "high")]
