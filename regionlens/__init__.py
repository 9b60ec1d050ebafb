"""regionlens: territorial and industrial analytics as Spark DataFrame operators.

Layers
------
* tabular: ratio KPIs, weighted territory profiles, panel features, clustering
  (``regionlens.operators.kpi``, ``.panel``, ``.ml``)
* spatial: neighbour weights, spatial lag, global/local Moran with
  deterministic permutation inference (``.weights``, ``.autocorr``)
* network: directed weighted graphs, centralities, modularity communities
  (``.graph``)

Every operator takes and returns ``pyspark.sql.DataFrame`` objects.
"""

__version__ = "0.1.0"
