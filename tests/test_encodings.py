"""Encodings told from bytes."""

from pyspark.sql import functions as F

from ragtables.functions.encodings import decode_bytes, detect_encoding

LATIN, CYRILLIC, MIXED = "Grüße aus Köln, 50 £.\nÀ bientôt", "Съешь ещё этих мягких булок", "naïve 😀 текст 日本 end of it"


def told(spark, contents):
    df = spark.createDataFrame([(i, None if c is None else bytearray(c)) for i, c in enumerate(contents)], "i int, content binary")
    df = df.withColumn("charset", detect_encoding(F.col("content"))).withColumn("text", decode_bytes(F.col("content"), F.col("charset")))
    return [(r.charset, r.text) for r in df.orderBy("i").collect()]


def test_each_encoding_is_found_and_read(spark):
    rows = [(text.encode(c), c.upper(), text) for text in (LATIN, CYRILLIC, MIXED, LATIN * 5000, "a", "a\nb") for c in ("utf-8", "utf-16le", "utf-16be", "utf-32le", "utf-32be")]
    rows += [(b"\xff\xfe" + "日本".encode("utf-16le"), "UTF-16", "日本"), (b"\xfe\xff" + "日本".encode("utf-16be"), "UTF-16", "日本"),
             (b"\xff\xfe\0\0" + MIXED.encode("utf-32le"), "UTF-32", MIXED), (LATIN.encode("latin-1"), "WINDOWS-1252", LATIN),
             ("„100 €“ – naïve…".encode("cp1252"), "WINDOWS-1252", "„100 €“ – naïve…"), (b"", "UTF-8", ""), (b"plain", "UTF-8", "plain")]
    assert [(c.upper(), t) for c, t in told(spark, [r[0] for r in rows])] == [r[1:] for r in rows]


def test_damaged_bytes_never_fail(spark):
    odd = LATIN.encode("utf-16le")[:-1]
    alone = "ab".encode("utf-16le") + b"\x00\xd8" + "cd ef gh".encode("utf-16le")
    got = told(spark, [None, odd, b"\xff\xfe" + alone, alone, b"\xff\xfe\x00", b"\x00\x00\x00", b"\x81\x8d caf\xe9"])
    assert got[0] == (None, None) and got[-1] == ("windows-1252", "\x81\x8d café")
    assert all(c not in ("UTF-16", "UTF-16LE") and t is not None for c, t in got[1:])


def test_files_are_told_apart_once_each(spark, tmp_path):
    """The encoding is found in one place of the plan; a copy in every branch of the decoding was too much code to compile."""
    from ragtables.sources.files import read_text_files

    texts = {"a": "héllo".encode(), "b": "héllo wörld".encode("utf-16-le"), "c": "né".encode("latin-1"), "d": "Привет".encode("utf-32")}
    for name, content in texts.items():
        (tmp_path / name).write_bytes(content)
    df = read_text_files(spark, str(tmp_path)).select("path", F.length("text").alias("n"), F.sha2("text", 256).alias("hash"))
    alone = spark.read.format("binaryFile").load(str(tmp_path)).select(detect_encoding(F.col("content")))
    copies, once = (str(x._jdf.queryExecution().optimizedPlan()).count("hex(content") for x in (df, alone))
    assert 0 < copies <= once
    assert {r.path[-1]: r.n for r in df.collect()} == {"a": 5, "b": 11, "c": 2, "d": 6}


def test_a_task_reads_many_small_files(spark, tmp_path):
    from ragtables.sources.files import read_text_files

    for i in range(400):
        (tmp_path / f"{i}.txt").write_text(f"text {i}")
    texts = read_text_files(spark, str(tmp_path))
    assert texts.sparkSession is spark and texts.rdd.getNumPartitions() <= 8  # half of them of the empty table
    assert sorted(r.text for r in texts.collect()) == sorted(f"text {i}" for i in range(400))
