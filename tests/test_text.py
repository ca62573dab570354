import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from ragtables.functions import text as X
from ragtables.functions.names import file_extension, has_host, mime_extension, reader_extension


def plain_clean(text):
    """The cleaning rules told line by line, without Spark."""
    text = unicodedata.normalize("NFKC", "".join(c for c in text if c != "\0"))
    text = re.sub("\r\n?", "\n", text).translate({0x200B: None, 0xFEFF: None})
    kept, blanks = [], 0
    for line in (re.sub("[ \t]+", " ", raw).strip() for raw in text.split("\n")):
        if line and (len(line) < 3 or not any(unicodedata.category(c)[0] in "LN" for c in line)):
            continue
        blanks = blanks + 1 if not line else 0
        if blanks <= 1:
            kept.append(line)
    return "\n".join(kept).strip()


CASES = [
    "", "ab", "abc", "a\0bc", "x" * 5 + "\r\nline two\rline three", "​zero﻿width", "tab\t\tand   spaces here",
    "one line\n     indented line", "para one\n\n\n\n\npara two", "keep me\n--\n***\n___\n..\nab\n12\n123\nkeep too",
    "    padded 　 \x1c", "ﬁligature ① ＡＢＣ ½", "é combined", "\n\n\nabc\n\n\n",
    "line\x0bwith\x0cfeeds", "first second", "a\n\n--\n\n\nbcd\nefg", "١٢٣", "你好世界", "café naïve",
    "אבג", "abc\u0085", "̀́̂ marks", "\U0001d400\U0001d401\U0001d402", "x²y³z",
]


def random_texts(n, seed=5):
    rnd = random.Random(seed)
    alphabet = ["a", "bc", "Def ", " ", "  ", "\t", "\n", "\n\n", "\r", "\r\n", "--", "_", " ", "​", "﻿", "é",
                "…", "ﬂ", "7", "\0", "\x1d", "　", ".", "ß"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 80))) for _ in range(n)]


def cleaned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    rows = df.select("i", X.clean_text(F.col("text")).alias("t")).collect()
    return [r.t for r in sorted(rows, key=lambda r: r.i)]


def test_clean_text_equals_the_rules_line_by_line(spark):
    texts = CASES + random_texts(800)
    assert cleaned(spark, texts) == [plain_clean(t) for t in texts]


def test_clean_text_is_idempotent(spark):
    once = cleaned(spark, CASES + random_texts(300, seed=9))
    assert cleaned(spark, once) == once


def test_cleaning_parts_equals_cleaning_the_joined_text(spark):
    texts = [t for t in random_texts(400, seed=11)]
    groups = [texts[i:i + 4] for i in range(0, len(texts), 4)]
    parts = dict(zip(texts, cleaned(spark, texts)))
    joined = cleaned(spark, ["\n\n".join(g) for g in groups])
    assert ["\n\n".join(parts[t] for t in g if parts[t]) for g in groups] == joined


def test_null_stays_null(spark):
    assert cleaned(spark, [None, "abc"]) == [None, "abc"]


def test_white_space_set_is_that_of_unicode():
    assert set(X.WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_characters_that_skip_normalisation_never_change(spark):
    letters = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c <= 0xDFFF]
    df = spark.createDataFrame([(c,) for c in letters], "c string")
    skipped = [r.c for r in df.filter(F.col("c").rlike(X.IN_NFKC)).collect()]
    assert len(skipped) > 20000
    assert all(unicodedata.normalize("NFKC", c) == c and unicodedata.combining(c) == 0 for c in skipped)
    joined = "".join(skipped)
    assert unicodedata.is_normalized("NFKC", joined)
    assert unicodedata.is_normalized("NFKC", joined[::-1])


@pytest.mark.parametrize("text,n", [("", 0), ("one two", 2), ("Hello, world!", 4), ("12345 abc", 3), ("a--b", 3)])
def test_count_tokens(spark, text, n):
    assert spark.range(1).select(X.count_tokens(F.lit(text)).alias("n")).first().n == n


def test_vocabulary_counter(spark, sf):
    tokenizers = pytest.importorskip("public_tokenizers")
    tokenizer = pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    counter = X.bpe_token_counter(tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "i int, t string")
    assert {r.i: r.n for r in df.select("i", counter("t").alias("n")).collect()} == {1: 2, 2: None, 3: 0}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("text", counter("text").alias("n")).collect()
    encoded = tokenizer.encode_batch([r.text for r in rows], add_special_tokens=False)
    assert [r.n for r in rows] == [len(e.ids) for e in encoded]


@pytest.mark.parametrize("url,ok", [
    ("https://a.example/x", True), ("a.example/x", False), ("  http://a.example", True), ("http://", False),
    ("http:///path", False), ("mailto:someone", False), ("ftp://host with blank/", True), ("1http://a", False),
    ("", False), (None, False), ("//host/path", False), ("x+y.z-1://h", True), ("ht\ntp://a", True)])
def test_has_host(spark, url, ok):
    assert spark.range(1).select(has_host(F.lit(url).cast("string")).alias("v")).first().v is ok


@pytest.mark.parametrize("name,ext", [
    ("a.PDF", ".pdf"), ("c.tar.md", ".md"), ("noext", ""), (".csv", ""), ("dir.d/file", ""), ("dir/x.TXT", ".txt"),
    ("trailing.", ""), ("a.b.", ""), (".hidden.md", ".md"), ("", "")])
def test_file_extension(spark, name, ext):
    assert spark.range(1).select(file_extension(F.lit(name)).alias("v")).first().v == ext


@pytest.mark.parametrize("mime,ext", [
    (" Text/CSV;charset=utf-8", ".csv"), ("text/csv ;x", None), ("application/pdf", ".pdf"), ("text/x-markdown", ".md"),
    ("image/png", None), (None, None)])
def test_mime_extension(spark, mime, ext):
    assert spark.range(1).select(mime_extension(F.lit(mime).cast("string")).alias("v")).first().v == ext


def test_file_name_goes_before_mime_type(spark):
    df = spark.createDataFrame([("a.docx", "text/csv"), ("a", "text/csv"), (None, None)], "n string, m string")
    got = [r.e for r in df.select(reader_extension(F.col("n"), F.col("m")).alias("e")).collect()]
    assert got == [".docx", ".csv", ""]
