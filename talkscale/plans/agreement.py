"""One run of the validation against a survey: from scored speeches of party-waves and the ratings of experts to the table of points and the summary by scale."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkscale.operators import validation
from talkscale.operators.store import once
from talkscale.plans import estimate
from talkscale.settings import SETTINGS, Settings

POINTS = ["scale", "party_wave", "ches_year", "ches_party_id", "cluster_id", "bloc", "estimate", "se", "ches", "n_experts"]
KEY = ["ches_year", "ches_party_id", "scale"]


def run(speeches: DataFrame, waves: DataFrame, ratings: DataFrame, replicates: int | None = None, draws: int = 2000, least_clusters: int | None = None, settings: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """(points, summary) of all scales in one pass.

    speeches: scale, ches_year, party_wave, member, sitting, weight, score. waves: party_wave, ches_year, ches_party_id,
    cluster_id, bloc. ratings: KEY and rating, one row for each expert. replicates are the estimator's (that of settings by
    default, none with 0, and then x moves by its error), draws those of the interval.
    """
    replicates = settings.replicates if replicates is None else replicates
    made = estimate.estimate_groups(speeches, ["scale", "ches_year"], ["member"], "party_wave", "sitting", replicates=replicates, settings=settings)
    cells = validation.expert_cells(ratings, KEY, "rating")
    points = once(validation.points(made.drop("ches_year"), waves, cells, settings.validation_experts), "points")
    own = ratings.where(F.col("rating").isNotNull()).groupBy(*KEY).agg(F.sort_array(F.collect_list("rating")).alias("ratings"))  # a cell's experts are few
    least = settings.validation_clusters if least_clusters is None else least_clusters
    summary = validation.summary(points.join(own, KEY), "scale", "estimate", "se", "ches", "ratings", "cluster_id", "bloc", "replicates" if replicates else None, least, draws, settings.seed)
    return points.select(*POINTS), summary
