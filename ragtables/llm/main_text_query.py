"""Query of the text extraction from pages."""

from ragtables.llm.catalog import query, table
from ragtables.llm.main_text import extract_pages


@query("op7_crf_main_text")
def op7(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))
