"""Golden values for the reference-shaped fixtures (27 territories, 8 sectors).

Fixed values: committed outputs of the original project (KPI summary, LISA table,
centrality ranking, cluster profiles) that the operators must reproduce.
"""

# Fixed values: (uf, total_emprego, produtividade_media) from the committed KPI summary, in its order.
KPI_SUMMARY = [
    ("AC", 46147, 125637.21777953897), ("AL", 43733, 128865.24209313947), ("AM", 45990, 135485.01910198774),
    ("AP", 52746, 128426.60229119338), ("BA", 41906, 184905.968528835), ("CE", 47195, 136314.27613757103),
    ("DF", 51490, 135779.15106664554), ("ES", 48216, 136475.2061195729), ("GO", 43640, 206152.33199961204),
    ("MA", 52006, 142951.85518724774), ("MG", 54678, 228052.40140501806), ("MS", 44317, 189761.7906118642),
    ("MT", 46605, 189285.1291765294), ("PA", 50260, 132184.41526451972), ("PB", 48059, 125016.63570446114),
    ("PE", 45819, 136015.63603285974), ("PI", 40910, 121700.99485619241), ("PR", 47801, 197673.590925126),
    ("RJ", 53828, 231674.18357227024), ("RN", 49590, 138793.89416767232), ("RO", 48503, 139210.22459866625),
    ("RR", 47152, 135454.61859409968), ("RS", 42678, 235687.32777216804), ("SC", 45898, 224036.53232012407),
    ("SE", 48075, 128905.94225587841), ("SP", 522424, 216291.74437883892), ("TO", 56111, 132958.93285053797),
]

# Fixed values: (uf, lisa_I, lisa_p_value, lisa_label) of total_emprego, k = 4, committed LISA table.
LISA_TABLE = [
    ("SP", -0.8119522108042919, 0.07, "High-Low (Outlier Espacial)"),
    ("RJ", -0.1424411996107971, 0.016, "Low-High (Outlier Espacial)"),
    ("MG", -0.13288815684186325, 0.006, "Low-High (Outlier Espacial)"),
    ("ES", -0.21137963330150777, 0.023, "Low-High (Outlier Espacial)"),
    ("RS", -0.2710805588632216, 0.141, "Não Significativo"),
    ("SC", -0.23633333923111213, 0.081, "Low-High (Outlier Espacial)"),
    ("PR", -0.21226920926918588, 0.093, "Low-High (Outlier Espacial)"),
    ("BA", 0.053346911371798596, 0.172, "Não Significativo"),
    ("PE", 0.0422527849994307, 0.333, "Não Significativo"),
    ("CE", 0.04204921804744206, 0.166, "Não Significativo"),
    ("RN", 0.03631467563242522, 0.184, "Não Significativo"),
    ("PB", 0.03858089337127355, 0.261, "Não Significativo"),
    ("SE", 0.042535619474469086, 0.054, "Low-Low (Coldspot)"),
    ("AL", 0.04540229454017835, 0.398, "Não Significativo"),
    ("PI", 0.04104101251072756, 0.195, "Não Significativo"),
    ("MA", 0.028238960710125317, 0.446, "Não Significativo"),
    ("DF", -0.17277565824785068, 0.008, "Low-High (Outlier Espacial)"),
    ("GO", 0.03579933330981434, 0.181, "Não Significativo"),
    ("MT", 0.03712668181279794, 0.402, "Não Significativo"),
    ("MS", 0.04544419043892063, 0.332, "Não Significativo"),
    ("AM", 0.038927975841293566, 0.456, "Não Significativo"),
    ("PA", 0.027091909122777903, 0.224, "Não Significativo"),
    ("RO", 0.03826168949247249, 0.21, "Não Significativo"),
    ("RR", 0.034986652986807566, 0.336, "Não Significativo"),
    ("AP", 0.02741487767413886, 0.375, "Não Significativo"),
    ("AC", 0.04224008845242197, 0.29, "Não Significativo"),
    ("TO", 0.0204352987447041, 0.327, "Não Significativo"),
]

# Committed centrality ranking
# (setor, betweenness, pagerank, closeness, in_degree_weight, out_degree_weight).
CENTRALITY = [
    ("Química e Farmacêutica", 0.11904761904761904, 0.08724967499512062, 0.2857142857142857, 0.95, 1.9000000000000001),
    ("Alimentos e Bebidas", 0.09523809523809523, 0.22148459432736417, 0.5714285714285714, 1.15, 0.2),
    ("Automotiva e Equipamentos", 0.09523809523809523, 0.15347481153426834, 0.5102040816326531, 2.1, 0.3),
    ("Metalurgia", 0.023809523809523808, 0.09324851837276008, 0.2857142857142857, 1.15, 1.65),
    ("Indústria Extrativa", 0.0, 0.04568013577575814, 0.0, 0.0, 1.35),
    ("Têxtil e Confecção", 0.0, 0.2534595507151678, 0.5, 0.7, 0.0),
    ("Celulose e Papel", 0.0, 0.0612931169649541, 0.19047619047619047, 0.4, 0.75),
    ("Máquinas e Aparelhos Elétricos", 0.0, 0.0841095973146067, 0.19047619047619047, 0.8, 1.1),
]

COMMUNITIES = [
    {"Alimentos e Bebidas", "Têxtil e Confecção", "Celulose e Papel", "Química e Farmacêutica"},
    {"Indústria Extrativa", "Metalurgia", "Automotiva e Equipamentos", "Máquinas e Aparelhos Elétricos"},
]

# Cluster memberships and their committed mean productivity.
CLUSTER_PROFILES = [
    ({"MG", "RJ", "RS", "SC", "SP"}, 227148.43788968385),
    ({"BA", "GO", "MS", "MT", "PR"}, 193555.76224839332),
    ({"AC", "AM", "AP", "CE", "DF", "MA", "PA", "RN", "TO"}, 134281.26264965715),
    ({"AL", "ES", "PB", "PE", "PI", "RO", "RR", "SE"}, 131455.56253185874),
]
