"""Queries of the models. Fitted ones are checked by rows alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast, models, vectors
from .relational_plans import ORACLE as _O
from .relational_plans import QUERIES as _Q
from .relational_plans import _add as _add_there

QUERIES: dict = {}
ORACLE: dict = {}


def _add(name, run, sql=None):
    _add_there(name, run, sql or "")
    QUERIES[name] = _Q.pop(name)
    text = _O.pop(name)
    if sql:
        ORACLE[name] = text


_X = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_K = ["l_orderkey", "l_linenumber"]


def _items(t):
    return t("lineitem").withColumns({"returned": (F.col("l_returnflag") == "R").cast("double"), "open": (F.col("l_linestatus") == "O").cast("double")})


_add("m5_risk_models", lambda t: models.RiskModels(_X, ["returned", "open"]).fit(_items(t)).transform(_items(t), _K))
_add("m6_score_model", lambda t: models.ScoreModel(["l_quantity", "l_discount", "l_tax"], "l_extendedprice").fit(t("lineitem")).transform(t("lineitem"), _K))
_add("m13_coef_importance", lambda t: models.ScoreModel(["l_quantity", "l_discount", "l_tax"], "l_extendedprice").fit(t("lineitem")).importance_table(2))
_add("m7_forecast", lambda t: models.forecast(t.events(), 7.0).select("patient_id", "analyte", "n", "forecast", "method"),
     """@events, g as (select patient_id, analyte, count(*) as n, avg(epoch_us(ts) / 86400e6 - 20000) as mx, avg(value) as my, covar_pop(epoch_us(ts) / 86400e6 - 20000, value) as c, var_pop(epoch_us(ts) / 86400e6 - 20000) as vx, max(epoch_us(ts) / 86400e6 - 20000) as lx, arg_max(value, (ts, evidence_id)) as last from o where value is not null group by 1, 2)
  select patient_id, analyte, n, round(case when n >= 3 and vx > 1e-9 then my + c / vx * (lx + 7 - mx) else last end, 3) as forecast, case when n >= 3 and vx > 1e-9 then 'line' else 'persistence' end as method from g""")
_add("m7_forecast_regression", lambda t: forecast.SeriesForecast().fit(t.events()).transform(t.events(), 7.0))
_add("m9_local_outlier_factor", lambda t: models.local_outlier_factor(t("embeddings"), 5, vectors.build_index(t("embeddings"), 0.95, 5)).select("vec_id", F.round("lof", 3).alias("lof")))
_add("x15_knn_index", lambda t: vectors.build_index(t("embeddings")).search(t("embeddings").filter("vec_id % 100 = 0"), 10))
_add("x15_index_recall", lambda t: vectors.recall_of(vectors.build_index(t("embeddings")), t("embeddings").filter("vec_id % 100 = 0"), 10))
_add("m10_isolation_forest", lambda t: models.isolation_forest(t("embeddings"), "vec_id", "embedding"))
