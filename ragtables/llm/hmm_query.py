"""Query of the language model."""

from ragtables.llm.catalog import query, table
from ragtables.llm.hmm_lm import score_texts


@query("op4_hidden_markov_scores")
def op4(spark, sf_dir):
    return score_texts(table(spark, sf_dir, "documents"))
