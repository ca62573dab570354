"""Query of the quality classifier."""

from ragtables.llm.catalog import query, table
from ragtables.llm.quality import score_quality


@query("op6_quadratic_quality")
def op6(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
