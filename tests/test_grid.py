import pytest
from terrane.operators import grid


@pytest.mark.parametrize("descending", [True, False])
def test_running_sum_keeps_rows_without_key(spark, descending):
    rows = [(k, None if k % 4 == 0 else float(k % 7), k % 5 + 1) for k in range(60)]
    want, total = {}, 0
    order = lambda r: (r[1] is None, -r[1] if r[1] is not None else 0, r[0]) if descending else (r[1] is not None, r[1] or 0, r[0])
    for unit, _, value in sorted(rows, key=order):
        total += value
        want[unit] = total
    frame = spark.createDataFrame(rows, "unit long, key double, value long")
    assert {r.unit: r.s for r in grid.running_sum(frame, "key", descending, "unit", "value", "s").collect()} == want
