"""Sources, jobs, uploads and clean-up on hand-made rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from ragtables.fixed_values import SYSTEM_PROMPT
from ragtables.operators import cleanup as C
from ragtables.operators import filters as B
from ragtables.operators import training as D
from ragtables.operators import uploads as U
from ragtables.sources.files import list_objects, merge_parts, read_csv_as_text, read_text_files, route_files
from ragtables.sources.pages import admit_pages, judge_pages
from tests.conftest import plan

NOW = datetime.datetime(2026, 2, 1)
OLD = datetime.datetime(2026, 1, 1)


def now():
    return F.lit(NOW)


def by(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_admission_of_pages(spark):
    pages = spark.createDataFrame([
        (1, 200, "text/html"), (2, 399, ""), (3, 400, "text/html"), (4, 200, "application/xhtml+xml"),
        (5, 200, "application/json"), (6, 200, "TEXT/HTML"), (7, None, None)],
        "page_id int, status_code int, content_type string")
    assert sorted(r.page_id for r in admit_pages(pages).collect()) == [1, 2, 4, 7]
    reasons = by(judge_pages(pages), "page_id", "reason")
    assert reasons[3] == "Failed to fetch URL (status=400)" and reasons[6] == "Unsupported content-type: TEXT/HTML"
    assert admit_pages(pages.select("page_id")).count() == 7


def test_first_broken_rule_of_a_source(spark):
    rows = spark.createDataFrame([
        (1, None, "org", "url", "http://a.example"), (2, 1, None, "url", "nonsense"), (3, 1, "org", "url", "nonsense"),
        (4, 1, "org", "url", None), (5, 1, "org", "url", "http://a.example"), (6, None, None, "file", ""),
        (7, None, None, "file", "x"), (8, 1, "org", None, None)],
        "source_id int, bot_id int, organization_id string, type string, source_value string")
    got = by(B.source_errors(rows), "source_id", "error_message")
    assert got == {1: "Training source missing bot_id/organization_id",
                   2: "Training source missing bot_id/organization_id", 3: "Invalid URL: nonsense", 4: "Invalid URL: ",
                   5: None, 6: "Missing file information for this training source.", 7: None,
                   8: "Missing file information for this training source."}


def test_length_gate(spark):
    rows = spark.createDataFrame([(1, "url", 199), (2, "url", 200), (3, "file", 49), (4, None, 50), (5, "file", None)],
                                 "i int, type string, n_chars int")
    got = by(B.min_length_gate(rows), "i", "error_message")
    assert [got[i] is None for i in range(1, 6)] == [False, True, False, True, False]


def test_file_lookup_needs_exactly_one_record(spark):
    files = spark.createDataFrame([(1, "b", "p/one", "a.md", None), (2, "b", "p/two", "a.md", None),
                                   (3, "b", "p/two", "a.md", None), (4, None, "p/bare", "a.md", None)],
                                  "file_id int, bucket string, path string, original_filename string, mime_type string")
    sources = spark.createDataFrame([(i, p) for i, p in enumerate(["p/one", "p/two", "p/none", "p/bare", None])],
                                    "source_id int, source_value string")
    got = {r.source_id: (r.file_id, r.lookup_error) for r in D.source_file_lookup(sources, files).collect()}
    unclear, bare = ("Unable to locate the uploaded file for this training source.",
                     "Uploaded file metadata is incomplete.")
    assert got == {0: (1, None), 1: (None, unclear), 2: (None, bare), 3: (4, bare), 4: (None, bare)}


def test_reader_routing(spark):
    files = spark.createDataFrame([("a.PDF", None), ("x.docx", "text/csv"), ("x", "text/csv"), (None, "image/png")],
                                  "original_filename string, mime_type string")
    got = [(r.extension, r.reader, r.reason) for r in route_files(files).collect()]
    assert got == [(".pdf", "pages", None), (".docx", None, "Unsupported file type"), (".csv", "csv", None),
                   ("", None, "Unsupported file type")]


@pytest.mark.parametrize("outcomes,status", [
    ([], "failed"), ([True], "completed"), ([False], "failed"), ([True, False], "partially_completed"),
    ([True, True], "completed"), ([False, False], "failed")])
def test_job_status(spark, outcomes, status):
    jobs = spark.createDataFrame([(1, "processing")], "job_id int, status string")
    rows = spark.createDataFrame([(1, ok) for ok in outcomes], "job_id int, ok boolean")
    assert D.job_status_rollup(jobs, rows).first().status == status


def test_enqueue_skips_busy_bots_and_bots_without_sources(spark):
    sources = spark.createDataFrame([
        (1, 1, "o", "created", None), (2, 1, "o", "created", None), (3, 1, "o", "trained", None),
        (4, 1, "o", "created", OLD), (5, 2, "o", "created", None), (6, 3, "o", "pending", None)],
        "source_id int, bot_id int, organization_id string, status string, deleted_at timestamp")
    jobs = spark.createDataFrame([(1, 2, "processing"), (2, 1, "failed"), (3, 1, "cleanup_completed")],
                                 "job_id int, bot_id int, status string")
    queued, links = D.enqueue_jobs(sources, jobs, "r")
    job = queued.first()
    assert queued.count() == 1 and (job.bot_id, job.n_sources, job.status) == (1, 2, "queued")
    assert sorted(r.source_id for r in links.collect()) == [1, 2]
    assert by(D.queue_sources(sources, links), "source_id", "status")[1] == "queued_for_training"
    assert "LeftAnti" in plan(queued)
    # The same run gives the same ids, another run other ones.
    assert D.enqueue_jobs(sources, jobs, "r")[0].first().job_id == job.job_id
    assert D.enqueue_jobs(sources, jobs, "s")[0].first().job_id != job.job_id


def test_outcome_touches_only_sources_worked_on(spark):
    sources = spark.createDataFrame([(1, "training", "old"), (2, "training", "old"), (3, "pending", "old")],
                                    "source_id int, status string, error_message string")
    results = spark.createDataFrame([(1, None), (2, "Invalid URL: x")], "source_id int, error_message string")
    got = {r.source_id: (r.status, r.error_message) for r in D.apply_source_outcome(sources, results).collect()}
    assert got == {1: ("trained", "old"), 2: ("training_failed", "Invalid URL: x"), 3: ("pending", "old")}


def chunks(spark, rows):
    return spark.createDataFrame(rows, "document_id string, source_id int, chunk_index int, embedding_model string,"
                                       " embedding_version string, content string, is_active boolean,"
                                       " deleted_at timestamp")


def test_deleted_rows_still_block_their_key(spark):
    stored = chunks(spark, [("a", 1, 0, "m", "v", "x", True, OLD)])
    incoming = chunks(spark, [("b", 1, 0, "m", "v", "y", False, None), ("c", 1, 1, "m", "v", "y", False, None),
                              ("d", 1, 1, "m", "v", "z", False, None), ("e", 1, 0, "m", "w", "y", False, None)])
    got = D.dedupe_chunk_inserts(incoming, stored)
    assert sorted(r.document_id for r in got.collect()) == ["c", "e"]
    assert got.columns == incoming.columns


def test_deduplication_on_stored_keys_shuffles_no_stored_text(spark, sf):
    from ragtables.catalog.fixtures import view

    chunks_ = view(spark, sf, "v_chunks")
    text = plan(D.fresh_chunk_keys(chunks_.filter("is_active").withColumn("_hash", F.xxhash64("content")), chunks_))
    assert "LeftAnti" in text and text.count("text#") >= 1
    stored_scan = text[text.rindex("FileScan"):]
    assert "text" not in stored_scan[stored_scan.index("ReadSchema"):].split("\n")[0]
    # Contents of keys that come once meet the kept keys where they are scanned; only rows of repeated keys are moved.
    whole = plan(D.dedupe_chunk_inserts(chunks_.filter("is_active"), chunks_))
    assert "BroadcastHashJoin" in whole and whole.count("Exchange hashpartitioning") <= 1


def test_soft_deletion_twice_equals_once(spark):
    rows = chunks(spark, [("a", 1, 0, "m", "v", "x", True, None), ("b", 1, 1, "m", "v", "x", False, OLD),
                          ("c", 2, 0, "m", "v", "x", True, None)])
    vectors = spark.createDataFrame([("a", None), ("b", None), ("c", None), ("z", OLD)],
                                    "document_id string, deleted_at timestamp")
    doomed = spark.createDataFrame([(1,), (1,), (7,)], "source_id int")
    v1, c1 = C.soft_delete_source(rows, vectors, doomed, now())
    assert by(c1, "document_id", "deleted_at") == {"a": NOW, "b": OLD, "c": None}
    assert by(c1, "document_id", "is_active") == {"a": True, "b": False, "c": True}
    assert by(v1, "document_id", "deleted_at") == {"a": NOW, "b": NOW, "c": None, "z": OLD}
    v2, c2 = C.soft_delete_source(c1, v1, doomed, F.lit(datetime.datetime(2027, 1, 1)))
    assert by(c2, "document_id", "deleted_at") == by(c1, "document_id", "deleted_at")
    assert by(v2, "document_id", "deleted_at") == by(v1, "document_id", "deleted_at")


def test_cleanup_ladder(spark):
    jobs = spark.createDataFrame([(1, 1, "o", 1), (2, 2, "o", 1), (3, 3, "o", 1), (4, 4, "o", 1)],
                                 "job_id int, source_id int, organization_id string, bot_id int")
    sources = spark.createDataFrame([(1, "o", 1, None), (2, "o", 1, OLD), (4, "other", 9, OLD)],
                                    "source_id int, organization_id string, bot_id int, deleted_at timestamp")
    targets = C.cleanup_target(jobs, sources)
    assert by(targets, "job_id", "action") == {1: "not_deleted", 2: "run", 3: "source_gone", 4: "run"}
    assert by(C.cleanup_target(jobs, sources, same_tenant=True), "job_id", "action")[4] == "source_gone"
    done = C.apply_cleanup_outcome(targets, now())
    assert by(done, "job_id", "status") == {1: "failed", 2: "cleanup_completed", 3: "cleanup_completed",
                                            4: "cleanup_completed"}
    assert set(by(done, "job_id", "completed_at").values()) == {NOW}


def test_manifest_lists_only_stored_files(spark):
    targets = spark.createDataFrame([(1, "file", "p"), (2, "file", "q"), (3, "url", "p"), (4, "file", ""),
                                     (5, "file", None)], "source_id int, type string, source_value string")
    objects = spark.createDataFrame([("bot-files", "p"), ("other", "q")], "bucket string, path string")
    got = C.deletion_manifest(targets, objects)
    assert [tuple(r) for r in got.collect()] == [(1, "bot-files", "p")] and "LeftSemi" in plan(got)


def test_uploads(spark):
    known = spark.createDataFrame([(10, 1, "h"), (11, 1, "h"), (12, 2, "k")],
                                  "source_id int, bot_id int, content_hash string")
    uploads = spark.createDataFrame([("a", 1, "h"), ("b", 2, "h"), ("c", 2, "h"), ("d", 2, "k")],
                                    "name string, bot_id int, content_hash string")
    got = {r.name: r for r in U.match_by_content_hash(uploads, known).collect()}
    assert got["a"].source_id == "10" and got["d"].source_id == "12" and not got["a"].is_new
    assert got["b"].is_new and got["b"].source_id == got["c"].source_id and got["b"].status == "pending"

    sources = spark.createDataFrame([(1, "file", "pending", "p"), (2, "file", "pending", "q"),
                                     (3, "file", "created", "r"), (4, "url", "pending", "p")],
                                    "source_id int, type string, status string, source_value string")
    objects = spark.createDataFrame([("b", "p"), ("b", "s"), ("x", "q")], "bucket string, path string")
    done = {r.source_id: (r.status, r.file_status) for r in U.verify_uploads(sources, objects, "b").collect()}
    assert done == {1: ("created", "uploaded"), 2: ("upload_failed", None), 3: ("created", None), 4: ("pending", None)}
    orphans = sorted(tuple(r) for r in U.orphan_uploads(sources, objects, "b").collect())
    assert orphans == [("object_without_source", "s"), ("source_without_object", "2")]


def test_message_contract(spark):
    rows = spark.createDataFrame([
        (1, "hi", None, None, "c", None), (2, "", "bot", None, "c", OLD), (3, None, None, None, "", None),
        (4, "hi", "bot", "x", "", None), (5, "hi", "system", "x", "c", None), (6, "hi", "user", "file", None, None)],
        "i int, content string, role string, content_type string, conversation_id string, timestamp timestamp")
    got = {r.i: r for r in B.message_contract(rows, NOW).collect()}
    assert [got[i].reason for i in range(1, 7)] == [None, "content", "content", "role", "content_type",
                                                    "conversation_id"]
    assert (got[1].role, got[1].content_type, got[1].created_at) == ("user", "text", NOW)
    assert got[2].created_at == OLD


def test_prompt(spark):
    rows = spark.createDataFrame([("m", "c"), ("", "c"), (None, "c"), ("", ""), (None, None)],
                                 "message string, content string")
    prompts = [r.prompt for r in B.prompt_projection(rows).collect()]
    assert [p[1].content for p in prompts] == ["m", "c", "c", "", ""]
    assert prompts[0][0].role == "system" and prompts[0][0].content == SYSTEM_PROMPT


def test_text_files_in_three_encodings(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\nwörld".encode())
    (tmp_path / "b.txt").write_bytes("héllo".encode("latin-1"))
    (tmp_path / "c.md").write_bytes("héllo".encode("utf-16"))
    (tmp_path / "d.md").write_bytes(b"")
    got = {r.path[-5:]: r.text for r in read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "héllo\nwörld", "b.txt": "héllo", "/c.md": "héllo"}  # Spark lists no empty files


@pytest.mark.parametrize("multiline", [True, False])
def test_csv_records_become_texts_in_order(spark, tmp_path, multiline):
    (tmp_path / "t.csv").write_text(' name ,note\n Ann , x \n"B, Co",\n' + "".join(f"r{i},{i}\n" for i in range(50)))
    rows = read_csv_as_text(spark, str(tmp_path), [" name ", "note"], multiline).collect()
    texts = [r.text for r in sorted(rows, key=lambda r: tuple(r.part_no))]
    assert texts[:2] == ["name: Ann\nnote: x", "name: B, Co\nnote: "]
    assert texts[2:] == [f"name: r{i}\nnote: {i}" for i in range(50)]


def test_quoted_newline_in_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"one\ntwo",x\n')
    assert [r.text for r in read_csv_as_text(spark, str(tmp_path), ["a", "b"]).collect()] == ["a: one\ntwo\nb: x"]


def test_merging_leaves_out_empty_parts_and_gives_one_text_per_file(spark):
    parts = spark.createDataFrame([(1, 2, "c"), (1, 0, "a"), (1, 1, ""), (2, 0, None)]
                                  + [(3, i, f"p{i}") for i in range(700)], "file_id int, part_no int, text string")
    got = {r.file_id: r.text for r in merge_parts(parts).collect()}
    assert got == {1: "a\n\nc", 3: "\n\n".join(f"p{i}" for i in range(700))}


def test_parts_of_csv_files_merge(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n\t1 ,"x\n"\n2,y\n')
    parts = read_csv_as_text(spark, str(tmp_path), ["a", "b"]).withColumnRenamed("path", "file_id")
    assert [r.text for r in merge_parts(parts).collect()] == ["a: 1\nb: x\n\na: 2\nb: y"]


def test_listing(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "f.txt").write_text("12345")
    (tmp_path / "g.bin").write_text("1")
    got = sorted(tuple(r) for r in list_objects(spark, f"file:{tmp_path}", "b").collect())
    assert got == [("b", "g.bin", 1), ("b", "x/y/f.txt", 5)]
