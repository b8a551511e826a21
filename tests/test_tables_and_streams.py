"""Sources, sinks, saved models, streams and the intake job on small tables."""

from pathlib import Path

import datetime as dt

from pyspark.sql import functions as F

from pressroom import schemas, session
from pressroom.functions.text import moderation_text
from pressroom.operators import catalogue, moderation, topics
from pressroom.plans.ingest import ingest
from pressroom.sources import tables
from pressroom.streaming import comments as streams


def test_comment_files_take_their_day_from_the_name(spark, tmp_path):
    line = '{"content": "chào", "source": "user_comment", "article_id": "BB-1", "timestamp": "2025-07-19T21:04:53.716024"}\n'
    (tmp_path / "comments_2025-07-19.jsonl").write_text(line * 2, encoding="utf-8")
    (tmp_path / "comments_2025-07-20.jsonl").write_text(line, encoding="utf-8")
    rows = tables.read_comment_files(spark, str(tmp_path)).groupBy("day").count().collect()
    assert {r.day: r["count"] for r in rows} == {dt.date(2025, 7, 19): 2, dt.date(2025, 7, 20): 1}


def test_csv_keeps_quotes_breaks_and_blanks(spark, tmp_path):
    rows = [("1", 'a "b", c\nd ', "t"), ("2", " lead\\", "t")]
    frame = spark.createDataFrame(rows, schemas.PENDING_CSV)
    tables.add_pending(frame, str(tmp_path / "p"), "one")
    tables.add_pending(frame, str(tmp_path / "p"), "one")
    tables.add_pending(frame, str(tmp_path / "p"), "two")
    names = schemas.PENDING_CSV.names
    back = tables.read_pending(spark, str(tmp_path / "p"), done=["two"]).select(*names)
    assert sorted(map(tuple, back.collect())) == sorted(rows * 2)
    assert tables.read_pending(spark, str(tmp_path / "p")).count() == 6


def test_model_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("b", "một hai"), ("a", "hai bốn"), ("a", "năm")], "label string, body string")
    model = topics.fit(docs, "body", "label", stopwords=())
    topics.save_model(model, str(tmp_path / "m"))
    loaded = topics.load_model(spark, str(tmp_path / "m"))
    assert (loaded.labels, loaded.n_docs, loaded.n_words, loaded.vocabulary_size) == (
        model.labels, model.n_docs, model.n_words, model.vocabulary_size)
    assert sorted(map(str, loaded.words.collect())) == sorted(map(str, model.words.collect()))


def test_stored_tables_are_read_by_schema(spark, tmp_path):
    """Columns outside the schema are not read, missing ones are NULL."""
    for name, schema, read in (
        ("users", schemas.USERS, tables.read_users), ("settings", schemas.SETTINGS, tables.read_settings),
        ("comments", schemas.COMMENTS, tables.read_comments), ("articles", schemas.ARTICLES, tables.read_articles),
    ):
        path = str(tmp_path / name)
        spark.range(3).selectExpr("'x' AS surplus", f"CAST(NULL AS {schema[0].dataType.simpleString()}) AS {schema[0].name}").write.parquet(path)
        frame = read(spark, path)
        assert frame.schema.names == schema.names and frame.count() == 3


def test_list_pages_show_the_first_image(spark):
    rows = spark.createDataFrame([(1, "a.jpg , b.jpg"), (2, ""), (3, None)], "id int, image_urls string")
    assert [r.image_urls for r in catalogue.list_row(rows).orderBy("id").collect()] == ["a.jpg", "", ""]


def test_shared_path_follows_the_setting(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = session.shared_path(spark, "x")
    assert "/x-" in path and (base is None or path.startswith(base))


COMMENTS = [(i, "BB-1", 1, None, text) for i, text in enumerate(["tốt lắm", "rác quá", "###", "mail a@b.c nhé", "không điểm"])]
SCORES = [(i, 5.0, 0.0, 0.0) for i in range(4)]


def comment_frame(spark, rows):
    ddl = "id bigint, article_id string, user_id bigint, parent_id bigint, content string"
    stamped = spark.createDataFrame(rows, ddl).withColumn("created_at", F.lit("2025-07-19 10:00:00").cast("timestamp"))
    return stamped.withColumn("day", F.to_date("created_at"))


def test_moderation_stream_equals_batch_and_ignores_redelivery(spark, tmp_path):
    inbox, sink, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    scores = spark.createDataFrame(SCORES, "comment_id bigint, logit_0 double, logit_1 double, logit_2 double")
    for rows in (COMMENTS[:3], COMMENTS[2:]):  # comment 2 arrives twice
        tables.write_comment_days(comment_frame(spark, rows), inbox)
        incoming = streams.read_comment_stream(spark, inbox)
        streams.moderate_stream(incoming, scores, sink, offsets).awaitTermination()
    rows = streams.read_decisions(spark, sink).collect()
    assert len(rows) == len(COMMENTS) == spark.read.parquet(sink).count(), "a comment is in the sink once"
    got = {r.id: (r.label, r.decision, r.reason) for r in rows}
    batch = moderation.moderate(comment_frame(spark, COMMENTS), scores)
    assert got == {r.id: (r.label, r.decision, r.reason) for r in batch.collect()}
    assert got[0][1] == "approve" and got[1][1] == got[4][1] == "reject" and got[2][1] is None


def test_redelivery_under_a_new_checkpoint_keeps_decisions(spark, tmp_path):
    inbox, sink = str(tmp_path / "in"), str(tmp_path / "out")
    scores = spark.createDataFrame(SCORES, "comment_id bigint, logit_0 double, logit_1 double, logit_2 double")
    tables.write_comment_days(comment_frame(spark, COMMENTS), inbox)
    for name in ("one", "two"):
        streams.moderate_stream(streams.read_comment_stream(spark, inbox), scores, sink, str(tmp_path / name)).awaitTermination()
    assert len(list((tmp_path / "out").glob("run=*/batch=0"))) == 2
    assert streams.read_decisions(spark, sink).count() == len(COMMENTS)


def test_title_stream_loses_nothing(spark, tmp_path):
    """Old dates, missing titles and repeats over batches; a batch that runs again doubles nothing."""
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    ddl = "title string, date_posted timestamp, n int"
    stored = spark.createDataFrame([("known",)], "title string")
    batches = [
        [("a", 30, 1), ("a", 2, 2), (None, 5, 3), (None, 5, 4), ("known", 4, 5)],
        [("old", 1, 6), ("a", 40, 7), (None, 1, 8), ("x" * 600, 9, 9)],
        [("old", 50, 10), ("x" * 700, 1, 11), ("new", 3, 12)],
    ]
    for rows in batches:
        frame = spark.createDataFrame(rows, "title string, t int, n int").select("title", F.timestamp_seconds("t").alias("date_posted"), "n")
        frame.write.mode("append").parquet(inbox)
        incoming = spark.readStream.schema(ddl).parquet(inbox)
        streams.keep_new_titles(incoming, stored, out, offsets, ["n"]).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 3, 4, 6, 8, 9, 12]
    # The last batch again, as after a failure between the write and the commit.
    (tmp_path / "offsets" / "commits" / "2").unlink()
    (tmp_path / "offsets" / "commits" / ".2.crc").unlink(missing_ok=True)
    streams.keep_new_titles(spark.readStream.schema(ddl).parquet(inbox), stored, out, offsets, ["n"]).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 3, 4, 6, 8, 9, 12]


def title_rows(spark, rows):
    frame = spark.createDataFrame(rows, "title string, t int, n int")
    return frame.select("title", F.timestamp_seconds("t").alias("date_posted"), "n")


def test_title_stream_reads_nothing_that_it_has_written(spark, tmp_path):
    """Earlier output may even be gone: what was seen stands in the state store."""
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    stored = spark.createDataFrame([("known",)], "title string")
    kept = []
    for number, rows in enumerate(([("a", 1, 1), ("a", 2, 0)], [("a", 3, 2), ("b", 3, 3)], [("b", 1, 4), ("known", 1, 5), ("c", 1, 6)])):
        title_rows(spark, rows).write.mode("append").parquet(inbox)
        incoming = spark.readStream.schema("title string, date_posted timestamp, n int").parquet(inbox)
        # Stored titles are the state of a new checkpoint only.
        streams.keep_new_titles(incoming, stored if number == 0 else stored.limit(0), out, offsets, ["n"]).awaitTermination()
        kept += [r.n for r in spark.read.schema(incoming.schema).parquet(out).collect()]
        for folder in (tmp_path / "out").glob("run=*/batch=*"):
            folder.rename(tmp_path / f"moved-{number}")
    assert sorted(kept) == [0, 3, 6]


def test_first_batch_again_after_a_failure(spark, tmp_path):
    """The first batch has written, but was not committed: it comes again and must not see itself."""
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    title_rows(spark, [("a", 1, 1), ("known", 2, 2)]).write.parquet(inbox)
    stored = spark.createDataFrame([("known",)], "title string")
    run = lambda: streams.keep_new_titles(
        spark.readStream.schema("title string, date_posted timestamp, n int").parquet(inbox), stored, out, offsets, ["n"]
    ).awaitTermination()
    run()
    for name in ("0", ".0.crc"):
        (tmp_path / "offsets" / "commits" / name).unlink(missing_ok=True)
    run()
    assert [r.n for r in spark.read.parquet(out).collect()] == [1]


def test_bounded_title_stream_forgets(spark, tmp_path):
    inbox, out, offsets = (str(tmp_path / n) for n in ("in", "out", "offsets"))
    stored = spark.createDataFrame([("known",), (None,)], "title string")
    batches = [
        [("a", 100, 1), ("known", 100, 2), (None, 100, 3), (None, 100, 4)],
        [("a", 105, 5), ("b", 130, 6)],  # within ten seconds: dropped
        [("a", 131, 7), ("b", 125, 8), ("c", 1, 9)],  # a is forgotten, c too late
    ]
    for rows in batches:
        title_rows(spark, rows).write.mode("append").parquet(inbox)
        incoming = spark.readStream.schema("title string, date_posted timestamp, n int").parquet(inbox)
        streams.keep_new_titles_within(incoming, stored, out, offsets, "date_posted", "10 seconds").awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [1, 3, 4, 6, 7]


def test_scratch_tables_go_with_their_scope(spark):
    from pressroom import session

    there = lambda paths: [Path(p.removeprefix("file:")).exists() for p in paths]
    with session.scratch(spark):
        outer = session._scopes[-1]
        frame = session.settle(spark.range(10).toDF("id"), "kept")
        frame.write.parquet(session.shared_path(spark, "other"))
        with session.scratch(spark):
            inner = session._scopes[-1]
            session.settle(frame, "inner")
            assert there(inner) == [True]
        assert frame.count() == 10 and there(inner) == [False] and there(outer) == [True, True]
    assert there(outer) == [False, False]


def test_scorer_sees_cleaned_text(spark):
    import pandas as pd

    def scorer(texts):
        n = texts.str.len().astype(float)
        return pd.DataFrame({"logit_0": n, "logit_1": n * 0, "logit_2": n * 0})

    frame = comment_frame(spark, COMMENTS)
    got = {r.comment_id: r.logit_0 for r in moderation.score_with(frame, scorer).collect()}
    want = {r.id: float(r.n) for r in frame.select("id", F.length(moderation_text(F.col("content"))).alias("n")).collect()}
    assert got == {key: n for key, n in want.items() if n}, "an empty text is never scored"


def page(title, *paragraphs):
    inner = "".join(f"<p>{p}</p>" for p in paragraphs)
    return f"<h1>{title}</h1><div class='detail-content afcbc-body'>{inner}</div>"


def test_intake_end_to_end(spark):
    model = topics.fit(spark.createDataFrame([("sport", "goal ball team"), ("money", "bank rate loan")], "label string, body string"), "body", "label")
    near = "lãi suất ngân hàng tăng mạnh trong tháng này theo báo cáo mới nhất"
    stored_html = f'<div class="article-contents">\n<p class="article-paragraph">{near}</p>\n</div>'
    stored = spark.createDataFrame(
        [("BB-7", "Stored", "", stored_html, None, "", "", "published", "money", "", "")], schemas.ARTICLES)
    crawled = spark.createDataFrame(
        [
            (1, "https://tuoitre.vn/1", page("Second", "team goal ball")),
            (2, "https://nld.com.vn/2", page("First", "bank loan rate rate")),
            (3, "https://nld.com.vn/3", page("First", "another text about ball")),
            (4, "https://nld.com.vn/4", page("Copy", near)),
            (5, "https://nld.com.vn/5", page("Stored", "quite different words")),
            (6, "https://unknown.test/6", page("Lost", "x")),
            (7, "https://tuoitre.vn/7", page("Long", "goal " * 3000)),
        ],
        schemas.PAGES,
    )
    rows = ingest(crawled, stored, model, F.lit("2025-01-01 00:00:00").cast("timestamp")).collect()
    got = {r.article_id: (r.title, r.type) for r in rows}
    assert got == {"BB-8": ("First", "money"), "BB-9": ("Second", "sport"), "BB-10": ("Long", "sport")}
    assert max(len(r.content) for r in rows) == 8000 and {r.image_urls for r in rows} == {""}
