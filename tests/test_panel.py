import statistics

import pytest

from regionlens.operators import panel as pnl

ROWS = [
    # uf, ano, mes, setor, empregos, massa, salario medio
    ("A", 2020, 1, "x", 10, 100.0, 10.0),
    ("A", 2020, 2, "x", 20, 300.0, 15.0),
    ("A", 2021, 1, "x", 30, 300.0, 10.0),
    ("A", 2021, 1, "y", 10, 50.0, 5.0),
    ("B", 2020, 1, "x", 5, 50.0, 10.0),
]
SCHEMA = "uf string, ano int, mes int, setor string, empregos long, massa_salarial double, salario_medio_nominal double"


def test_panel_features(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    # from month 2 of 2020 to month 1 of 2021 there is a gap: stepped over here, no growth by default
    assert pnl.volatility_index(df).where("uf = 'A'").first().volatility_index is None
    f = {r.uf: r for r in pnl.territory_features(df, gaps="step").collect()}
    a = f["A"]
    assert a.avg_growth_rate == pytest.approx((40 - 30) / 30)
    mom = [(20 - 10) / 10, (40 - 20) / 20]
    assert a.volatility_index == pytest.approx(statistics.stdev(mom))
    assert a.avg_salary_nominal == pytest.approx(10.0)
    assert a.productivity_proxy == pytest.approx(750.0 / 70)
    assert a.diversification_index == pytest.approx(1 - ((60 / 70) ** 2 + (10 / 70) ** 2))
    b = f["B"]
    assert b.avg_growth_rate is None and b.diversification_index == pytest.approx(0.0)


GAPS = [("A", 2020, 1, 100), ("A", 2020, 2, 110), ("A", 2020, 6, 220), ("A", 2020, 7, 110), (None, 2019, 12, 5), (None, 2020, 1, 0), (None, 2020, 2, 7), ("C", 2020, None, 3)]


def test_growth_over_gaps(spark):
    df = spark.createDataFrame(GAPS, "uf string, ano int, mes int, empregos long").where("mes is not null")
    growth = lambda gaps: {(r.uf, r.ano, r.mes): r.growth for r in pnl.period_growth(df, "uf", ["ano", "mes"], "empregos", gaps).collect()}
    null = growth("null")
    assert null["A", 2020, 2] == pytest.approx(0.1) and null["A", 2020, 6] is None and null["A", 2020, 7] == pytest.approx(-0.5)
    assert null[None, 2020, 1] == pytest.approx(-1.0) and null[None, 2020, 2] is None  # from zero: no ratio
    assert growth("step")["A", 2020, 6] == pytest.approx(1.0)
    fill = growth("fill")
    assert [fill["A", 2020, m] for m in range(2, 8)] == pytest.approx([0.1, 0.0, 0.0, 0.0, 1.0, -0.5])
    with pytest.raises(ValueError):
        growth("other")


def test_calendar(spark):
    df = spark.createDataFrame(GAPS, "uf string, ano int, mes int, empregos long")
    rows = [(r.uf, r.ano, r.mes, r.empregos, r.filled) for r in pnl.calendar(df, ["uf"], ["ano", "mes"], "empregos").collect()]
    assert sorted(rows, key=str) == sorted(
        [("A", 2020, m, {1: 100, 2: 110, 6: 220, 7: 110}.get(m), {1: 100, 6: 220, 7: 110}.get(m, 110)) for m in range(1, 8)]
        + [(None, 2019, 12, 5, 5), (None, 2020, 1, 0, 0), (None, 2020, 2, 7, 7)], key=str
    )
    years = spark.createDataFrame([("A", 2001, 1), ("A", 2004, 2)], "uf string, ano int, empregos long")
    assert [(r.ano, r.filled) for r in pnl.calendar(years, ["uf"], ["ano"], "empregos").orderBy("ano").collect()] == [(2001, 1), (2002, 1), (2003, 1), (2004, 2)]
