"""Queries: models, clusterings, attributions and streams (checked by properties)."""

from pyspark.sql import functions as F

from .. import constants as k
from ..functions.columns import uniform
from ..operators import (
    attributions as ab, features as fe, mixed_clusters as mc, models as mo, reports as rp,
)
from ..plans import flows
from ..session import materialize
from ..sources import shop_views as views
from ..streaming import state as st
from . import feature_queries as fq, oracle_views as v
from .feature_queries import PCA_NAMES
from .entries import add

TREES = 100  # boosting rounds
_FITTED: dict = {}


def _once(s, name, fit):
    """A model that several queries of one application describe is fitted once for the files
    that lie in the folder; other files, or files written anew, are fitted again."""
    key = (s.spark.sparkContext.applicationId, s.folder, name)
    state = s.file_state()
    if _FITTED.get(key, (None,))[0] != state:
        _FITTED[key] = state, fit()
    return _FITTED[key][1]


def _scaled(s):
    return materialize(fe.log_robust(s.cluster_table, flows.SCALE_FEATURES))


def _mixed(s):
    """Prototype rows with numbers scaled to [0, 1]."""
    return materialize(fe.minmax_scale(s.prototype_table, flows.TREE_NUMERIC))


def _prototypes(s, k=4):
    rows = _mixed(s)
    model = mc.kprototypes(rows, flows.TREE_NUMERIC, flows.TREE_CATEGORICAL, k)
    return model.assign(rows).select("CustomerId", "OneAndDone", "Cluster", "Distance")


def _tree_rows(s):
    rows = fe.one_hot_drop_first(materialize(s.tree_table), ["ShippingType"])
    return rows.withColumn("HasPromoDiscount", F.col("HasPromoDiscount").cast("int"))


def _tree_columns(rows):
    return [c for c in rows.columns if c not in ("CustomerId", "OneAndDone", "Cluster")]


add("pca_by_variance", lambda s: mo.pca_by_variance(
    flows.pca_table(s.stored_summary), _pca_columns(s))[1])


def _pca_columns(s):
    return [c for c in flows.pca_table(s.stored_summary).columns if c != "CustomerId"]


def _pca_mixed(s):
    rows = materialize(flows.mixed_table(s.stored_first_summary, s.stored))
    return mo.pca_mixed(rows, ["AvgOrderValue", "AvgPromoDiscount", "AvgQuantity"],
                        ["ShippingSimple", *flows.SEASON_FLAGS])[0]


add("pca_mixed", _pca_mixed)
add("pca_top_loadings", lambda s: mo.top_loadings(_pca_mixed(s)))


def _kmeans_on_components(s):
    scored, table = mo.pca_by_variance(flows.pca_table(s.stored_summary), _pca_columns(s))
    components = [f"PC{r['Component']}" for r in table.filter("Kept").collect()]
    return mo.kmeans(materialize(scored), components, 4).select("CustomerId", "Cluster")


add("kmeans_on_components", _kmeans_on_components)
add("kmeans", lambda s: mo.kmeans(_scaled(s), flows.SCALE_FEATURES, 3).select("CustomerId", "LikelyChurned", "Cluster"))
add("kmeans_masked", lambda s: mo.kmeans_masked(s.cluster_table, flows.SCALE_FEATURES)[0].select("CustomerId", "Cluster"))
add("kprototypes", _prototypes)
add("kprototypes_churn", lambda s: rp.churn_by_cluster(_prototypes(s)))


def _gower(s):
    rows = materialize(s.prototype_table)
    return mc.gower_to_landmarks(rows, mc.landmarks(rows), flows.TREE_NUMERIC, flows.TREE_CATEGORICAL)


v.BLOCKS["proto_data"] = f"""
select * from (select CustomerId, AvgOrderItemTotal, AvgItemsPerOrder, AvgRushFeeAndShipPrice,
    coalesce(AvgPromoDiscount < 0, false) as HasPromoDiscount, {v.SHIP_UNCATEGORIZED} as ShippingType
  from first_summary left join (select CustomerId, OrderItemPriceTotal, ShippingTotal from first_values) using (CustomerId)
  where FirstOrderDate >= timestamp '1999-01-01' and PctOrdersWithLabel = 1)
where AvgOrderItemTotal is not null and AvgItemsPerOrder is not null and AvgRushFeeAndShipPrice is not null
"""
_width = lambda c: f"(select nullif(max({c}) - min({c}), 0) from proto_data)"
_part = lambda c: f"coalesce(abs(a.{c} - b.{c}) / {_width(c)}, 0)"
add("gower_to_landmarks", _gower, f"""
select CustomerId, arg_min(mark, (d, mark)) as NearestLandmark, min(d) as NearestDistance, avg(d) as MeanDistance from (
  select a.CustomerId, b.CustomerId as mark, ({' + '.join(map(_part, flows.TREE_NUMERIC))}
      + (a.HasPromoDiscount <> b.HasPromoDiscount)::int + (a.ShippingType <> b.ShippingType)::int) / 5.0 as d
  from proto_data a cross join (select * from proto_data order by md5(cast(CustomerId as varchar) || ':42') limit 200) b)
group by CustomerId""", "NearestDistance MeanDistance")


def _hierarchy(s):
    rows = _mixed(s)
    return mc.hierarchical_segments(rows, flows.TREE_NUMERIC, flows.TREE_CATEGORICAL)[0].select("CustomerId", "Cluster")


add("hierarchical_segments", _hierarchy)
add("hierarchical_values", lambda s: rp.cluster_value_summary(
    materialize(s.prototype_table).join(_hierarchy(s), "CustomerId")))


def _first_order_rows(s):
    return materialize(flows.mixed_table(s.stored_first_summary, s.stored))


def _first_order_prototypes(s):
    rows = materialize(flows.mixed_prototypes(_first_order_rows(s)))
    model = mc.kprototypes(rows, [f"Scaled_{c}" for c in flows.MIXED_NUMERIC], flows.MIXED_CATEGORICAL, 4)
    return model.assign(rows)


add("kprototypes_first_order", lambda s: _first_order_prototypes(s).select("CustomerId", "OneAndDone", "Cluster"))
add("kprototypes_value_bins", lambda s: rp.crosstab_share(
    rp.with_bucket(_first_order_prototypes(s), "ValueBin", "AvgOrderValue", k.ORDER_VALUE_EDGES,
                   k.ORDER_VALUE_LABELS, include_lowest=False), "Cluster", "ValueBin"))


def _tree(s):
    rows = _tree_rows(s)
    return mo.decision_tree(rows, _tree_columns(rows), "OneAndDone")[1]


add("decision_tree", lambda s: _tree(s).select("CustomerId", "OneAndDone", "LeafID", "Predicted"))
add("decision_tree_leaves", lambda s: rp.leaf_summary(_tree(s)))


def _explained(s):
    rows = _tree_rows(s)
    columns = _tree_columns(rows)
    clustered = rows.join(_hierarchy(s), "CustomerId")
    return mo.explain_clusters_tree(materialize(clustered), columns)[1].select("CustomerId", "Cluster", "Predicted")


add("explain_clusters_tree", _explained)


# ---------------------------------------------------------------- classifiers
def _sessions(s):
    return flows.session_table(s.stored_first_summary, s.clean, s.raw("bigquery_events"), views.FIRST_ORDER_CUTOFF,
                               {"PctOrdersWithLabel": 1.0})


def _classifier(s):
    return _once(s, "sessions", lambda: flows.one_and_done_classifier(_sessions(s), trees=TREES))


def _churn_rows(s):
    return materialize(fe.drop_incomplete(s.cluster_table, flows.CLUSTER_FEATURES))


def _split(s):
    rows = fe.random_split(_churn_rows(s))
    return rows.filter(~F.col("IsTest")), rows.filter("IsTest")


def _regularised(s):
    def fit():
        train, test = _split(s)
        return mo.boosted_regularised(train, flows.CLUSTER_FEATURES, "LikelyChurned", trees=TREES), train, test
    return _once(s, "regularised", fit)


def _in_sample(s):
    return _once(s, "in sample", lambda: mo.boosted_in_sample(
        _log_scaled(s), flows.SCALE_FEATURES, "LikelyChurned", trees=TREES)[1])


def _validated(s):
    return _once(s, "validated", lambda: mo.cross_validate(
        _churn_rows(s), flows.CLUSTER_FEATURES, "LikelyChurned", k=5, trees=TREES))


def _log_scaled(s):
    return materialize(fe.log_robust(s.cluster_table, flows.SCALE_FEATURES, low=0.001, some_positive=False))


add("boosted_churn", lambda s: _classifier(s)["scored"].select("CustomerId", "label", "score", "prediction"))
add("boosted_churn_report", lambda s: _classifier(s)["report"])
add("boosted_first_order", lambda s: flows.first_order_classifier(
    _first_order_rows(s), trees=TREES)["scored"].select("CustomerId", "label", "score", "prediction"))


def _boosted_regularised(s):
    model, _, test = _regularised(s)
    return mo.score(model, test, flows.CLUSTER_FEATURES, "LikelyChurned").select("CustomerId", "label", "score")


add("boosted_regularised", _boosted_regularised)
add("boosted_in_sample", lambda s: _in_sample(s).select("CustomerId", "label", "score"))
add("logistic_churn", lambda s: mo.odds_table(
    mo.logistic_churn(_log_scaled(s), flows.SCALE_FEATURES, "LikelyChurned"), flows.SCALE_FEATURES, s.spark))


def _warning_rows(s):
    from ..operators import churn, warning

    z = list(warning.DEVIATIONS)
    rows = warning.latest_warning(s.stored, churn.churn_profile(s.stored))
    return materialize(fe.fill_zero(rows, z)), z


def _warning_model(s):
    rows, z = _warning_rows(s)
    split = fe.stratified_split(rows, "LikelyChurned")
    train, test = split.filter(~F.col("IsTest")), split.filter("IsTest")
    return mo.score(mo.logistic_churn(train, z, "LikelyChurned", balanced=False), test, z, "LikelyChurned")


add("warning_components", lambda s: mo.pca_by_variance(*_warning_rows(s), 1.0)[1])
add("boosted_warning", lambda s: flows.warning_classifier(
    _warning_rows(s)[0], trees=TREES)["scored"].select("CustomerId", "label", "score", "prediction"))
add("warning_logistic", lambda s: _warning_model(s).select("CustomerId", "label", "score"))
add("feature_importance", lambda s: mo.feature_importance(
    _regularised(s)[0], flows.CLUSTER_FEATURES, s.spark))


def _shap(s):
    model, train, test = _regularised(s)
    return ab.shap_values(model, test, train, flows.CLUSTER_FEATURES)


add("shap_values", _shap)
add("shap_summary", lambda s: ab.shap_summary(_shap(s), flows.CLUSTER_FEATURES))


def _interactions(s):
    def compute():
        model, train, test = _regularised(s)
        return materialize(ab.shap_interactions(model, test, train, flows.CLUSTER_FEATURES))
    return _once(s, "interactions", compute)


def _dependence(s):
    partners = {r["Feature"]: r["Partner"] for r in ab.interaction_partners(_interactions(s)).collect()}
    return ab.shap_dependence(materialize(_shap(s)), flows.CLUSTER_FEATURES, partners)


add("shap_interactions", _interactions)
add("shap_partners", lambda s: ab.interaction_partners(_interactions(s)))
add("shap_dependence", _dependence)
add("cross_validate", _validated)


# ---------------------------------------------------------------- checks of models
# A model's numbers have no statement, but much about them is known: how many rows it has
# to cover, and properties of which no row may be an exception.
_CLUSTERED = "from cluster_data where TotalOrders is not null and AvgOrderValue is not null and AvgPromoDiscount is not null"


def _one(s, **values):
    return s.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def _check_components(s):
    _, table = mo.pca_by_variance(flows.pca_table(s.stored_summary), _pca_columns(s))
    return table.agg(F.count("*").alias("components"), (F.abs(F.sum("Ratio") - 1) < 1e-6).alias("whole"),
                     (F.min("Ratio") >= -1e-9).alias("positive"))


add("check_pca_by_variance", _check_components, f"select {len(PCA_NAMES) + 1}::bigint as components, true as whole, true as positive")  # and the spread of gaps


def _check_loadings(s):
    loadings = _pca_mixed(s)
    norms = loadings.groupBy("Component").agg(F.sum(F.col("Loading") ** 2).alias("n"))
    top = mo.top_loadings(loadings).groupBy("Component").count()
    return norms.join(top, "Component").agg(F.count("*").alias("components"), F.count_if(F.abs(F.col("n") - 1) > 1e-6).alias("not_unit"),
                                            F.count_if(F.col("count") != 5).alias("not_five"))


add("check_pca_mixed", _check_loadings, "select 5::bigint as components, 0::bigint as not_unit, 0::bigint as not_five")


def _check_kmeans(s):
    rows = _scaled(s)
    model = mo.fit_kmeans(rows, flows.SCALE_FEATURES, 3)
    centres = [[float(x) for x in c] for c in model.clusterCenters()]
    gap = F.array(*[sum((F.col(f) - x) ** 2 for f, x in zip(flows.SCALE_FEATURES, c)) for c in centres])
    found = mo.kmeans(rows, flows.SCALE_FEATURES, 3).withColumn("_d", gap)
    far = F.col("_d")[F.col("Cluster")] > F.array_min("_d") + 1e-9
    return found.agg(F.count("*").alias("rows"), F.count_distinct("Cluster").alias("clusters"), F.count_if(far).alias("not_nearest"))


_SCALED_ROWS = _CLUSTERED + " and greatest(TotalOrders, AvgOrderValue, AvgPromoDiscount) > 0"
add("check_kmeans", _check_kmeans, f"select count(*) as rows, 3::bigint as clusters, 0::bigint as not_nearest {_SCALED_ROWS}")
add("check_kmeans_masked", lambda s: mo.kmeans_masked(s.cluster_table, flows.SCALE_FEATURES)[0].agg(
        F.count("*").alias("rows"), F.count_if("LikelyChurned").alias("churned")),
    f"select count(*) as rows, 0::bigint as churned {_SCALED_ROWS} and not LikelyChurned")


def _check_prototypes(s):
    rows = _mixed(s)
    model = mc.kprototypes(rows, flows.TREE_NUMERIC, flows.TREE_CATEGORICAL, 4)
    falls = all(b <= a + 1e-9 for a, b in zip(model.costs, model.costs[1:]))
    far = F.col("Distance") > F.array_min(model.distances()) + 1e-9
    return model.assign(rows).agg(F.count("*").alias("rows"), F.count_if(far).alias("not_nearest"),
                                  F.lit(falls).alias("cost_falls"), F.lit(model.converged).alias("converged"))


add("check_kprototypes", _check_prototypes,
    "select count(*) as rows, 0::bigint as not_nearest, true as cost_falls, true as converged from proto_data")
add("check_hierarchical_segments", lambda s: _hierarchy(s).agg(
        F.count("*").alias("rows"), F.count_distinct("CustomerId").alias("customers"), F.count_distinct("Cluster").alias("clusters")),
    "select count(*) as rows, count(*) as customers, least(5, count(*)) as clusters from proto_data")


def _check_tree(s):
    leaves = _tree(s).groupBy("LeafID").agg(F.count("*").alias("n"), F.count_distinct("Predicted").alias("p"))
    return leaves.agg(F.sum("n").alias("rows"), (F.min("n") >= 20).alias("large_enough"),
                      ((F.count("*") > 1) | (F.sum("n") < 400)).alias("split"),  # few rows may allow no split
                      (F.max("p") == 1).alias("one_answer"), (F.count("*") <= 16).alias("shallow"))


add("check_decision_tree", _check_tree,
    "select count(*)::bigint as rows, true as large_enough, true as split, true as one_answer, true as shallow from tree_data")
add("check_explain_clusters_tree", lambda s: _explained(s).agg(
        F.count("*").alias("rows"), F.count_if(F.col("Predicted").between(1, 5)).alias("named")),
    "select count(*) as rows, count(*) as named from tree_data join proto_data using (CustomerId)")


def _scores_in_range(scored):
    return scored.agg(F.count("*").alias("rows"), F.count_if(~F.col("score").between(0, 1)).alias("out_of_range"),
                      F.count_if((F.col("margin") > 0) != (F.col("score") > 0.5)).alias("sign_differs"))


add("check_boosted_in_sample", lambda s: _scores_in_range(_in_sample(s)),
    f"select count(*) as rows, 0::bigint as out_of_range, 0::bigint as sign_differs {_CLUSTERED}")


def _check_logistic(s):
    rows = _log_scaled(s)
    model = mo.logistic_churn(rows, flows.SCALE_FEATURES, "LikelyChurned")
    table = mo.odds_table(model, flows.SCALE_FEATURES, s.spark)
    weighted = fe.class_weights(rows, "LikelyChurned", "balanced")
    z = sum((F.col(f) * float(c) for f, c in zip(flows.SCALE_FEATURES, model.coefficients.toArray())), F.lit(float(model.intercept)))
    error = F.col("Weight") * (1 / (1 + F.exp(-z)) - F.col("LikelyChurned").cast("int"))
    sums = weighted.agg(F.count("*").alias("n"), *[F.sum(error * F.col(f)).alias(f) for f in flows.SCALE_FEATURES]).first()
    steep = max(abs(sums[f] + float(c)) / sums["n"] for f, c in zip(flows.SCALE_FEATURES, model.coefficients.toArray()))
    return table.agg(F.count("*").alias("features"), F.count_if(F.abs(F.col("OddsRatio") - F.exp("Coefficient")) > 1e-9).alias("wrong_ratio"),
                     F.lit(sums["n"]).cast("long").alias("rows"), F.lit(bool(steep < 1e-4)).alias("solved"))


add("check_logistic_churn", _check_logistic,
    f"select 3::bigint as features, 0::bigint as wrong_ratio, count(*) as rows, true as solved {_CLUSTERED}")


def _check_shap(s):
    model, train, test = _regularised(s)
    values = ab.shap_values(model, test, train, flows.CLUSTER_FEATURES)
    margins = mo.score(model, test, flows.CLUSTER_FEATURES, "LikelyChurned").select("CustomerId", "margin")
    total = sum((F.col(f"Attr_{f}") for f in flows.CLUSTER_FEATURES), F.col("Base"))
    base = values.agg(F.max("Base")).first()[0]
    mean = mo.score(model, train, flows.CLUSTER_FEATURES, "LikelyChurned").agg(F.avg("margin")).first()[0]
    found = values.join(margins, "CustomerId")
    return found.agg(F.count("*").alias("rows"), F.count_if(F.abs(total - F.col("margin")) > 1e-6).alias("not_additive"),
                     F.lit(bool(abs(base - mean) < 1e-6)).alias("base_is_mean"))


_TESTED = f"from cluster_data where {fq.u('CustomerId', 42)} < 0.2 and " + " and ".join(f"{c} is not null" for c in flows.CLUSTER_FEATURES)
add("check_shap_values", _check_shap, f"select count(*) as rows, 0::bigint as not_additive, true as base_is_mean {_TESTED}")
def _check_dependence(s):
    """Every row must hold the values of ``shap_values`` and the strongest partner."""
    values = materialize(_shap(s))
    long = values.select("CustomerId", F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f).alias("x"), F.col(f"Attr_{f}").alias("a")) for f in flows.CLUSTER_FEATURES])).alias("v"))
    strength = (_interactions(s).filter("Feature <> Other").groupBy("Feature", "Other").agg(F.avg(F.abs("Interaction")).alias("m")))
    best = strength.groupBy(F.col("Feature").alias("_f")).agg(F.max("m").alias("most"))
    strongest = strength.join(best, F.col("Feature") == F.col("_f")).filter("m = most").select("_f", F.col("Other").alias("_o"))
    rows = _dependence(s).alias("d").join(
        long.select(F.col("CustomerId").alias("_k"), F.col("v.f").alias("_w"), F.col("v.x").alias("_v"), F.col("v.a").alias("_a")),
        (F.col("d.CustomerId") == F.col("_k")) & (F.col("d.Feature") == F.col("_w")))
    rows = rows.join(long.select(F.col("CustomerId").alias("_c"), F.col("v.f").alias("_p"), F.col("v.x").alias("_x")),
                     (F.col("d.CustomerId") == F.col("_c")) & (F.col("InteractingFeature") == F.col("_p")))
    rows = rows.join(strongest, (F.col("d.Feature") == F.col("_f")) & (F.col("InteractingFeature") == F.col("_o")), "left")
    wrong = (F.col("Value") != F.col("_v")) | (F.abs(F.col("Attribution") - F.col("_a")) > 1e-12) | (F.col("InteractingValue") != F.col("_x"))
    return rows.groupBy("d.Feature").agg(
        F.count("*").alias("rows"), F.count_if(wrong).alias("wrong"), F.count_if(F.col("_o").isNull()).alias("not_strongest"))


add("check_shap_dependence", _check_dependence,
    "select unnest([" + ", ".join(f"'{c}'" for c in flows.CLUSTER_FEATURES) + f"]) as Feature, (select count(*) {_TESTED}) as rows, "
    "0::bigint as wrong, 0::bigint as not_strongest")


def _check_interactions(s):
    """A feature's rows add up to its attribution, and a pair's two halves are equal."""
    model, train, test = _regularised(s)
    found = _interactions(s)
    values = ab.shap_values(model, test, train, flows.CLUSTER_FEATURES)
    single = values.select(F.col("CustomerId").alias("_c"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("f"), F.col(f"Attr_{f}").alias("a")) for f in flows.CLUSTER_FEATURES])).alias("v")).select("_c", "v.*")
    whole = found.groupBy("CustomerId", "Feature").agg(F.sum("Interaction").alias("n"))
    # Spark's size estimate leaves the exploded rows out, so they may not become a broadcast.
    sums = whole.join(single.hint("merge"), (F.col("CustomerId") == F.col("_c")) & (F.col("Feature") == F.col("f")))
    pair = found.groupBy("CustomerId", F.least("Feature", "Other").alias("a"), F.greatest("Feature", "Other").alias("b")).agg(
        (F.max("Interaction") - F.min("Interaction")).alias("gap"))
    return sums.agg(F.count("*").alias("rows"), F.count_if(F.abs(F.col("n") - F.col("a")) > 1e-9).alias("not_additive")).crossJoin(
        pair.agg(F.count_if(F.col("gap") > 1e-9).alias("not_symmetric"), F.countDistinct("a", "b").alias("pairs")))


add("check_shap_interactions", _check_interactions,
    f"select {len(flows.CLUSTER_FEATURES)} * count(*) as rows, 0::bigint as not_additive, 0::bigint as not_symmetric, "
    f"{len(flows.CLUSTER_FEATURES) * (len(flows.CLUSTER_FEATURES) + 1) // 2}::bigint as pairs {_TESTED}")

_TRAINED = _TESTED.replace("< 0.2", ">= 0.2")


def _best_single(rows, label="LikelyChurned"):
    """The largest AUC of one feature alone, in either direction."""
    from ..operators.metrics import roc_auc

    found = [roc_auc(rows.select(F.col(label).cast("int").alias("label"), F.col(f).alias("score"))).first()[0] for f in flows.CLUSTER_FEATURES]
    return max(max(a, 1 - a) for a in found if a is not None)


def _best_single_sql(rows: str) -> str:
    """The same from mid-ranks: (sum of ranks of churned - n1 (n1 + 1) / 2) / (n1 n0)."""
    def one(c):
        return f"""select (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y)) as a from (
          select LikelyChurned::int as y, rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as r {rows})"""
    return "(select max(greatest(a, 1 - a)) from (" + " union all ".join(map(one, flows.CLUSTER_FEATURES)) + "))"


def _check_regularised(s):
    """At every leaf of a tree the gradient sum, the curvature times the weight and both
    penalties must cancel; the loss must fall; training AUC must beat any single feature."""
    from ..operators import boosting as bo, metrics as me

    model, train, test = _regularised(s)
    p = 1 / (1 + F.exp(-F.col("margin")))
    sums = []
    for number in (0, TREES // 2, TREES - 1):
        leaf = bo.leaf_rows(model, train, number).groupBy("leaf", "weight").agg(
            F.sum(p - F.col("y")).alias("g"), F.sum(p * (1 - p)).alias("h"))
        left_over = F.when(F.col("weight") == 0, F.greatest(F.abs("g") - model.params["l1"], F.lit(0.0))).otherwise(
            F.abs(F.col("g") + (F.col("h") + model.params["l2"]) * F.col("weight") + model.params["l1"] * F.signum("weight")))
        sums.append(leaf.agg(F.count("*").alias("leaves"), F.count_if(left_over > 1e-6).alias("unsolved")))
    leaves = sums[0].unionByName(sums[1]).unionByName(sums[2]).agg(F.max("leaves").alias("leaves"), F.sum("unsolved").alias("unsolved"))
    falls = all(b < a for a, b in zip(model.losses[:-1:10], model.losses[10::10])) and len(model.losses) == TREES + 1
    auc = me.roc_auc(mo.score(model, train, flows.CLUSTER_FEATURES, "LikelyChurned")).first()[0]
    single = _best_single(train)
    scored = _boosted_regularised(s).agg(F.count("*").alias("rows"), F.count_if(~F.col("score").between(0, 1)).alias("out_of_range"))
    return scored.crossJoin(leaves).select(
        "rows", "out_of_range", "unsolved", (F.col("leaves") > 1).alias("split"), F.lit(falls).alias("loss_falls"),
        F.lit(single).alias("best_single"), F.lit(bool(auc > single)).alias("better"))


add("check_boosted_regularised", _check_regularised,
    f"select (select count(*) {_TESTED}) as rows, 0::bigint as out_of_range, 0::bigint as unsolved, true as split, true as loss_falls, "
    f"{_best_single_sql(_TRAINED)} as best_single, true as better", "best_single")


def _check_boosted(s):
    """Class-weighted boosting (I10) on the same rows: training AUC and weighted loss."""
    from ..operators import metrics as me

    train, _ = _split(s)
    weighted = fe.class_weights(train, "LikelyChurned")
    few, many = (mo.score(mo.boosted_churn(weighted, flows.CLUSTER_FEATURES, "LikelyChurned", trees=n, depth=3),
                          weighted, flows.CLUSTER_FEATURES, "LikelyChurned") for n in (2, 20))

    def loss(rows):
        y = F.col("label")
        return rows.agg(F.sum(F.col("Weight") * -(y * F.log("score") + (1 - y) * F.log(1 - F.col("score"))))).first()[0]

    single, auc = _best_single(train), me.roc_auc(many).first()[0]
    return many.agg(F.count("*").alias("rows"), F.count_if((F.col("margin") > 0) != (F.col("score") > 0.5)).alias("sign_differs")).select(
        "rows", "sign_differs", F.lit(bool(loss(many) < loss(few))).alias("loss_falls"), F.lit(single).alias("best_single"),
        F.lit(bool(auc > single)).alias("better"))


add("check_boosted_churn", _check_boosted,
    f"select (select count(*) {_TRAINED}) as rows, 0::bigint as sign_differs, true as loss_falls, "
    f"{_best_single_sql(_TRAINED)} as best_single, true as better", "best_single")


def _check_importance(s):
    """Shares of mean gains: they add up, a feature no tree splits on has none, and the first
    split's gain is the one its gradient sums give."""
    from ..operators import boosting as bo

    model, train, _ = _regularised(s)
    table = mo.feature_importance(model, flows.CLUSTER_FEATURES, s.spark)
    used = sorted({flows.CLUSTER_FEATURES[f] for t in model.trees for f in t.feature if f >= 0})
    first, p = model.trees[0], model.params
    rows = bo.leaf_rows(model, train, 0).join(
        train.select(F.col("CustomerId").alias("_c"), F.col(flows.CLUSTER_FEATURES[first.feature[0]]).alias("_x")), F.col("key") == F.col("_c"))
    side = rows.groupBy((F.col("_x") <= first.threshold[0]).alias("low")).agg(F.sum(0.5 - F.col("y")).alias("g"), (F.count("*") / 4).alias("h")).collect()
    score = lambda g, h: max(abs(g) - p["l1"], 0) ** 2 / (h + p["l2"])
    gain = sum(score(r["g"], r["h"]) for r in side) - score(sum(r["g"] for r in side), sum(r["h"] for r in side))
    return table.agg(F.count("*").alias("features"), (F.abs(F.sum("Importance") - 1) < 1e-6).alias("whole"),
                     F.count_if((F.col("Importance") > 0) != F.col("Feature").isin(used)).alias("wrong"),
                     F.lit(bool(abs(gain - first.gain[0]) < 1e-6 * max(1, gain))).alias("gain_from_sums"))


add("check_feature_importance", _check_importance,
    "select 4::bigint as features, true as whole, 0::bigint as wrong, true as gain_from_sums")


def _check_folds(s):
    """Fold sizes per class from the table of folds, and AUCs that beat a coin."""
    table, own = _validated(s), F.col("Rows") - F.col("Positives")
    return table.filter("Fold >= 0").agg(
        F.count("*").alias("folds"), F.sum("Rows").alias("rows"), F.sum("Positives").alias("positives"),
        (F.max("Positives") - F.min("Positives") <= 1).alias("even_positives"), (F.max(own) - F.min(own) <= 1).alias("even_negatives"),
        (F.min("AUC") > 0.5).alias("better_than_chance")).crossJoin(
        table.agg((F.abs(F.avg(F.when(F.col("Fold") >= 0, F.col("AUC"))) - F.max(F.when(F.col("Fold") < 0, F.col("AUC")))) < 1e-9).alias("mean_right")))


_COMPLETE = "from cluster_data where " + " and ".join(f"{c} is not null" for c in flows.CLUSTER_FEATURES)
add("check_cross_validate", _check_folds,
    f"select 5::bigint as folds, count(*)::bigint as rows, count(*) filter (LikelyChurned) as positives, true as even_positives, true as even_negatives, "
    f"true as better_than_chance, true as mean_right {_COMPLETE}")


def _predict_report(s):
    return _once(s, "predict report", lambda: materialize(flows.predict_classifier(
        fe.predict_dataset("LikelyChurned", s.stored_summary, fq._sample_only(s)), "LikelyChurned", trees=TREES)["report"]))


add("predict_report", _predict_report)
add("predict_report_one_and_done", lambda s: flows.predict_classifier(
    fe.predict_dataset("OneAndDone", fq._last_one(s)), "OneAndDone", trees=TREES)["report"])
add("predict_importance_two_and_churned", lambda s: flows.predict_classifier(
    fe.predict_dataset("TwoAndChurned", fq._first_two(s), fq._sample_only(s)), "TwoAndChurned", trees=TREES)["importance"])



# ---------------------------------------------------------------- checks of tables that describe models
def _totals(table, size, done, value=None):
    """Rows, one-and-done customers and value, put together again from a table of groups."""
    found = [F.sum(size).cast("long").alias("rows"), F.round(F.sum(F.col(size) * F.col(done))).cast("long").alias("done")]
    return table.agg(*found, *([F.sum(value).alias("value")] if value else []))


_PROTO = "proto_data join (select CustomerId, OneAndDone from first_summary) using (CustomerId)"
_TOTALS = "select count(*) as rows, count(*) filter (OneAndDone) as done, sum(AvgOrderItemTotal) as value from {}"
add("check_decision_tree_leaves", lambda s: _totals(rp.leaf_summary(_tree(s)), "LeafSize", "PctOneAndDone", "LeafValue"),
    _TOTALS.format("tree_data"), "value")
add("check_hierarchical_values", lambda s: _totals(rp.cluster_value_summary(
        materialize(s.prototype_table).join(_hierarchy(s), "CustomerId")), "ClusterSize", "PctOneAndDone", "ClusterValue"),
    _TOTALS.format(_PROTO), "value")


def _check_cluster_churn(s):
    rows = materialize(_prototypes(s))
    shares = rp.churn_by_cluster(rows).join(rp.cluster_sizes(rows), "Cluster")
    return _totals(shares, "Size", "ShareTrue").crossJoin(shares.agg(
        F.count_if(F.abs(F.col("ShareTrue") + F.col("ShareFalse") - 1) > 1e-9).alias("not_whole"), (F.count("*") <= 4).alias("few")))


add("check_kprototypes_churn", _check_cluster_churn,
    f"select count(*) as rows, count(*) filter (OneAndDone) as done, 0::bigint as not_whole, true as few from {_PROTO}")


def _check_value_bins(s):
    """Every clustered row with a known value is in one bin, and a cluster's shares are whole."""
    rows = materialize(_first_order_prototypes(s))
    bins = rp.crosstab_share(rp.with_bucket(rows, "ValueBin", "AvgOrderValue", k.ORDER_VALUE_EDGES, k.ORDER_VALUE_LABELS,
                                            include_lowest=False), "Cluster", "ValueBin")
    shares = bins.groupBy("Cluster").agg(F.sum("Share").alias("whole"), F.sum("N").alias("n"))
    known = rows.filter("AvgOrderValue > 0").count()
    return shares.agg(F.count_if(F.abs(F.col("whole") - 1) > 1e-9).alias("not_whole"), (F.sum("n") - F.lit(known)).cast("long").alias("missing"),
                      (F.count("*") <= 4).alias("few"))


add("check_kprototypes_value_bins", _check_value_bins, "select 0::bigint as not_whole, 0::bigint as missing, true as few")


def _check_warning_components(s):
    table = mo.pca_by_variance(*_warning_rows(s), 1.0)[1]
    falls = F.count_if(F.col("Ratio") > F.col("_before") + 1e-12).alias("rises")
    from pyspark.sql import Window
    ordered = table.withColumn("_before", F.lag("Ratio").over(Window.orderBy("Component")))  # one row per component
    return ordered.agg(F.count("*").alias("components"), (F.abs(F.sum("Ratio") - 1) < 1e-9).alias("whole"), falls)


add("check_warning_components", _check_warning_components, "select 4::bigint as components, true as whole, 0::bigint as rises")


add("check_shap_summary", lambda s: ab.shap_summary(_shap(s), flows.CLUSTER_FEATURES).alias("m").join(
        _interactions(s).groupBy("CustomerId", "Feature").agg(F.sum("Interaction").alias("a")).groupBy(F.col("Feature").alias("_f")).agg(
            F.avg(F.abs("a")).alias("_m")), F.col("Feature") == F.col("_f")).agg(
        F.count("*").alias("features"), F.count_if(F.abs(F.col("MeanAbs") - F.col("_m")) > 1e-9).alias("wrong")),
    "select 4::bigint as features, 0::bigint as wrong")


def _check_predict_report(s):
    """Supports are the sizes of the stratified test part; a weighted recall is the accuracy."""
    rows = {r["class"]: r for r in _predict_report(s).collect()}
    return _one(s, negatives=rows["0"]["support"], positives=rows["1"]["support"],
                whole=bool(rows["accuracy"]["support"] == rows["0"]["support"] + rows["1"]["support"]),
                recall_is_accuracy=bool(abs(rows["weighted avg"]["recall"] - rows["accuracy"]["f1"]) < 1e-9)).select(
        F.col("negatives").cast("long").alias("negatives"), F.col("positives").cast("long").alias("positives"), "whole", "recall_is_accuracy")


_PREDICTED = """(select LikelyChurned from summary join sample_only using (CustomerId)
    where TotalOrders >= 2 and AvgOrderItemTotal is not null and AvgPromoDiscount is not null and PctNormalShipping is not null)"""
add("check_predict_report", _check_predict_report, f"""
select ceil(0.2::double * (count(*) filter (not LikelyChurned) - 1))::bigint as negatives,
  ceil(0.2::double * (count(*) filter (LikelyChurned) - 1))::bigint as positives, true as whole, true as recall_is_accuracy from {_PREDICTED}""")


# ---------------------------------------------------------------- streams
def streamed(s, build, slices=4, delay_days=20, keep_clock=st.LATENESS):
    """Store the order features as they might arrive - each order up to ``delay_days`` late,
    slice by slice of the time of arrival - and run the stream again after each slice, as
    a scheduled job would; what has not been emitted waits in the checkpointed state. The
    last slice ends with a clock row ``keep_clock`` after the newest order."""
    base, at = s.scratch(), F.unix_timestamp("PlacedDateTime")
    late = F.floor(uniform("OrderNumber", seed=3) * (delay_days * 86_400))
    arrival = s.stored.withColumn("_arrival", at + late)
    low, high = arrival.agg(F.min("_arrival"), F.max("_arrival")).first()
    part = F.coalesce(F.floor((F.col("_arrival") - (low or 0)) / (((high or 0) - (low or 0)) / slices + 1)), F.lit(0))
    for i in range(slices):
        arrival.filter(part == i).drop("_arrival").write.mode("append").parquet(f"{base}/orders")
        if i == slices - 1:
            st.clock_row(s.stored, keep_clock).write.mode("append").parquet(f"{base}/orders")
        out = st.run_available(build(st.read_order_stream(s.spark, f"{base}/orders")), f"{base}/out", f"{base}/checkpoint")
    return s.spark.read.parquet(out)


from . import customer_queries as cq  # noqa: E402  (defines the warning blocks)

add("stream_early_warning", lambda s: streamed(s, st.stream_early_warning),
    f"select CustomerId, OrderNumber, PlacedDateTime as OrderDate, {', '.join(cq.Z)}, {cq.FLAGS} from deviated_all",
    " ".join(cq.Z), "OrderDate")
# Silence after each order, until the next one or the end of the data.
add("stream_overdue", lambda s: streamed(s, st.stream_overdue), """
select CustomerId, LastOrderDate, LastOrderDate + to_days(silence::int) as OverdueSince, MeanDays from (
  select *, greatest(floor(1.5 * MeanDays) + 1, 36) as silence from (
    select CustomerId, PlacedDateTime as LastOrderDate,
      avg(DaysSincePrevOrder) over (partition by CustomerId order by PlacedDateTime, OrderNumber) as MeanDays,
      date_sub('day', PlacedDateTime, coalesce(lead(PlacedDateTime) over (partition by CustomerId order by PlacedDateTime, OrderNumber),
        (select max(PlacedDateTime) from feat))) as quiet
    from gapped_all))
where MeanDays is not null and quiet >= silence""", "MeanDays", "LastOrderDate OverdueSince")
