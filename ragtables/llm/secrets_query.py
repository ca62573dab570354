"""Query of the scan for secrets."""

from ragtables.llm.catalog import query, table
from ragtables.llm.secrets import scan_secrets


@query("op8_secret_spans")
def op8(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))
