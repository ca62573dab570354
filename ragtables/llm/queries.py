"""Import the modules that register queries."""

from ragtables.llm import (  # noqa: F401
    decontamination_query,
    fill_middle_query,
    hmm_query,
    main_text_query,
    mixing_query,
    mtree_query,
    near_dedup_query,
    prefix_trie_query,
    quality_query,
    secrets_query,
    token_files_query,
    tree_bpe_query,
    warc_query,
)
from ragtables.llm.catalog import ORACLES, QUERIES  # noqa: F401
