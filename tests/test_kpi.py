import pytest
from pyspark.sql import functions as F

from goldens import CLUSTER_PROFILES, KPI_SUMMARY
from regionlens.operators import kpi, ml

FACTS = [
    ("A", "s1", 10, 1000.0, 300.0, 50.0, 20.0, 70.0),
    ("A", "s2", 30, 2000.0, 900.0, 100.0, 30.0, 80.0),
    ("B", "s1", 0, 0.0, 0.0, 0.0, 0.0, 60.0),
    ("B", "s2", 20, 500.0, 100.0, 10.0, 5.0, None),
]
SCHEMA = ("uf string, setor string, emprego_industrial int, valor_adicionado_brut double, massa_salarial double, "
          "consumo_energia_mwh double, investimento_inovacao double, indice_esg double")


def test_ratios_null_on_zero(spark):
    df = kpi.add_ratio_kpis(spark.createDataFrame(FACTS, SCHEMA))
    r = df.where("uf = 'B' AND setor = 's1'").first()
    assert r.produtividade_trabalho is None and r.taxa_inovacao is None
    r = df.where("uf = 'A' AND setor = 's1'").first()
    assert (r.produtividade_trabalho, r.custo_medio_trabalho, r.intensidade_energetica, r.taxa_inovacao) == pytest.approx((100.0, 30.0, 0.05, 0.02))


def test_profile_forms_agree(spark):
    facts = spark.createDataFrame(FACTS, SCHEMA)
    a = {r.uf: r for r in kpi.territory_profile(facts).collect()}
    b = {r.uf: r for r in kpi.territory_profile(facts, method="weighted_mean").collect()}
    assert a["A"].total_emprego == 40 and a["A"].total_valor_adicionado == 3000.0
    assert a["A"].produtividade_media_uf == pytest.approx(75.0)
    assert a["A"].custo_trabalho_medio_uf == pytest.approx(30.0)
    assert a["A"].indice_esg_uf == pytest.approx(75.0)
    for c in kpi.PROFILE_INDICATORS:
        assert getattr(a["A"], c) == pytest.approx(getattr(b["A"], c))
        assert getattr(a["B"], c) == pytest.approx(getattr(b["B"], c))


def test_report_rounding_and_order(spark):
    prof = kpi.territory_profile(spark.createDataFrame(FACTS, SCHEMA))
    rows = kpi.kpi_report(prof).collect()
    assert [r.UF for r in rows] == ["A", "B"]
    assert rows[0].PIB_Industrial_Milhoes == 0.0 and rows[0].Inovacao_Pct_VA == pytest.approx(1.67)


def test_cluster_profile_golden(spark):
    member = {u: i for i, (s, _) in enumerate(CLUSTER_PROFILES) for u in s}
    df = spark.createDataFrame([(u, member[u], p) for u, _, p in KPI_SUMMARY], "uf string, cluster_id int, produtividade_media_uf double")
    got = {r.cluster_id: r.produtividade_media_uf for r in kpi.cluster_profile(df, "cluster_id", ["produtividade_media_uf"]).collect()}
    for i, (_, mean) in enumerate(CLUSTER_PROFILES):
        assert got[i] == pytest.approx(mean, rel=1e-14)


def test_label_rules(spark):
    df = spark.createDataFrame(
        [(0, 250000.0, 0.01, 5000.0), (1, 150000.0, 0.01, 5000.0), (2, 150000.0, 0.02, 4000.0), (3, 150000.0, 0.02, 3000.0)],
        "cluster_id int, produtividade_media_uf double, taxa_inovacao_uf double, custo_trabalho_medio_uf double",
    )
    got = [r.cluster_label[:1] for r in ml.label_clusters(df).orderBy("cluster_id").collect()]
    assert got == ["1", "4", "2", "3"]


def test_group_means_and_top_n(spark):
    facts = spark.createDataFrame(FACTS, SCHEMA)
    m = {r.setor: r for r in kpi.group_means(facts, "setor").collect()}
    assert m["s2"].emprego_industrial == pytest.approx(25.0) and m["s1"].indice_esg == pytest.approx(65.0)
    top = kpi.top_n(kpi.territory_profile(facts), 1, F.desc("total_emprego")).collect()
    assert [r.uf for r in top] == ["A"]
