"""Text cleaning and token counting as built-in column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# All characters that count as white space at the ends of a line.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Texts made only of these characters are in NFKC already: ASCII, Latin letters that have no compatibility form,
# Cyrillic, plain dashes and quotes, CJK ideographs. Tested character by character against unicodedata. The possessive
# form is one pass over the text; a search for a character outside the set takes several times as long.
IN_NFKC = (
    r"^[\x{00}-\x{7F}\x{C0}-\x{131}\x{134}-\x{13E}\x{141}-\x{148}\x{14A}-\x{17E}"
    r"\x{400}-\x{482}\x{48A}-\x{4FF}\x{2012}-\x{2014}\x{2018}-\x{201D}\x{4E00}-\x{9FFF}]*+\z"
)

# Letters, groups of up to three digits, and runs of other visible characters.
TOKEN_PATTERN = r"\p{L}+|\p{N}{1,3}|[^\s\p{L}\p{N}]+"


@F.pandas_udf(T.StringType())
def _nfkc_batch(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC. Spark has no built-in, so only rows that can change are sent to Python; others go as NULL."""
    return F.coalesce(_nfkc_batch(F.when(~text.rlike(IN_NFKC), text)), text)


def strip(text: Column) -> Column:
    """Remove white space, in the Unicode sense, from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def drop_nul(text: Column) -> Column:
    return F.replace(text, F.lit("\0"), F.lit(""))


def unify_newlines(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def drop_zero_width(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\u200b"), F.lit("")), F.lit("\ufeff"), F.lit(""))


def collapse_blanks(text: Column) -> Column:
    """Runs of spaces and tabs become one space; a single space needs no replacement."""
    return F.regexp_replace(text, r"[ \t]{2,}|\t", " ")


def collapse_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def drop_noise_lines(text: Column) -> Column:
    """Strip each line; keep empty ones; drop those under three characters or without any letter or digit."""
    lines = F.transform(F.split(text, "\n"), strip)
    kept = F.filter(lines, lambda x: (x == "") | ((F.length(x) >= 3) & x.rlike(r"[\p{L}\p{N}]")))
    return F.array_join(kept, "\n")


def normal_form(text: Column) -> Column:
    """First half of the cleaning, the one that may have to call Python."""
    return nfkc(drop_nul(text))


def tidy(text: Column) -> Column:
    """Second half, on the JVM. Lines are stripped when noise is dropped, and blank lines are pooled after that, so
    neither is done before."""
    for step in (unify_newlines, drop_zero_width, collapse_blanks, drop_noise_lines, collapse_newlines, strip):
        text = step(text)
    return text


def clean_text(text: Column) -> Column:
    """Normalise scraped or uploaded text for chunking.

    Do not filter on the result in the same plan: the filter would be pushed below the projection and run the whole
    cleaning once more. Write the cleaned texts first, or filter on a column of a later step.
    """
    return tidy(normal_form(text))


def count_tokens(text: Column) -> Column:
    """Number of pre-tokens. Replace by :func:`bpe_token_counter` where a vocabulary is at hand."""
    return F.regexp_count(text, F.lit(TOKEN_PATTERN))


def bpe_token_counter(rank_file: str, pattern: str):
    """Hook for a real tokenizer: a pandas UDF counting byte-pair tokens of a vocabulary in rank-file format.

    ``rank_file`` must be readable on every worker. The encoder is built once per Python worker task, not per row.
    """

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import base64

        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, lines)}
        encoder = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for texts in batches:
            known = texts.dropna()
            sizes = [len(ids) for ids in encoder.encode_ordinary_batch(known.tolist(), num_threads=1)]
            yield pd.Series(sizes, index=known.index, dtype="Int32").reindex(texts.index)

    return count
