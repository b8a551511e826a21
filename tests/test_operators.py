"""Operators against brute force on small fixtures, with hot groups and forced slow paths."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from pressroom.functions.text import STOPWORDS
from pressroom.operators import catalogue, commands, comments, dedupe, moderation, ranking, topics


# Ranking


def test_rank_with_a_hot_group_matches_a_window(spark):
    rows = [(i, "hot" if i % 3 else f"g{i % 40}", (i * 7919) % 1000) for i in range(6000)]
    frame = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    got = {r.id: r.n for r in ranking.with_rank(frame, ["v", "id"], "n", within=["g"]).collect()}
    seen = Counter()
    want = {}
    for id_, g, v in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        seen[g] += 1
        want[id_] = seen[g]
    assert got == want


def test_rank_keeps_null_groups_and_null_order(spark):
    frame = spark.createDataFrame([(1, None, None), (2, None, 5), (3, "a", None)], "id int, g string, v int")
    got = ranking.with_rank(frame, [F.col("v").desc_nulls_first(), "id"], "n", within=["g"]).collect()
    assert {r.id: r.n for r in got} == {1: 1, 2: 2, 3: 1}


def test_rank_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BROADCAST_OFFSETS", 0)
    frame = spark.range(500).withColumn("g", F.col("id") % 3)
    got = {r.id: r.n for r in ranking.with_rank(frame, ["id"], "n", within=["g"]).collect()}
    assert got == {i: i // 3 + 1 for i in range(500)}


def test_first_rows_are_limited_before_the_shuffle(spark):
    frame = spark.range(1000).select("id", (F.col("id") % 2).alias("k"))
    plan = ranking.first_n_per_key(frame, ["k"], ["id"], 20)
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()
    assert plan.count() == 40


def test_numbering_keeps_to_keys(spark):
    """A deep page numbers dates and keys only; its rows come back in order."""
    frame = spark.range(30_000).select(
        F.concat(F.lit("k"), F.lpad(F.col("id").cast("string"), 6, "0")).alias("article_id"),
        F.timestamp_seconds(F.col("id") % 977).alias("date_posted"), F.repeat(F.lit("x"), 50).alias("content"),
    )
    got = [r.article_id for r in catalogue.page(frame, 1_500).collect()]
    rows = sorted(((i % 977, f"k{i:06d}") for i in range(30_000)), key=lambda r: (-r[0], r[1]))
    assert got == [key for _, key in rows[14_990:15_000]]


# Search, toggles, decisions


def test_backslash_in_a_search(spark):
    frame = spark.createDataFrame([("ab",), ("a\\b",), ("a%b",), ("axb",)], "title string")
    found = lambda text: {r.title for r in frame.filter(catalogue.contains_text(F.col("title"), text)).collect()}
    assert found("a\\b") == {"ab"} and found("a\\\\b") == {"a\\b"} and found("a\\%b") == {"a%b"}
    assert found("a%b") == {"ab", "a\\b", "a%b", "axb"} and found("b\\") == {"ab", "a\\b", "a%b", "axb"}


def test_toggle_of_a_user_without_status(spark):
    users = spark.createDataFrame([(1, None), (2, "Active"), (3, None)], "id bigint, status string")
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 3), (5, 9)], "seq bigint, id bigint")
    change = commands.toggle_users(users, asked)
    assert {r.id: r.status for r in change.table.collect()} == {1: "Inactive", 2: "Inactive", 3: "Active"}
    assert {r.id: r.outcome for r in change.outcomes.collect()} == {1: "toggled", 2: "toggled", 3: "toggled", 9: "not_found"}


def test_empty_text_needs_no_score(spark):
    rows = spark.createDataFrame([(1, ""), (2, " \n "), (3, "words")], "id bigint, content string")
    none = spark.createDataFrame([], "comment_id bigint, logit_0 double, logit_1 double, logit_2 double")
    got = {r.id: (r.label, r.confidence, r.decision) for r in moderation.moderate(rows, none).collect()}
    assert got == {1: (0, 0.5, None), 2: (0, 0.5, None), 3: (2, 0.0, "reject")}


def test_pending_table_after_verdicts(spark):
    waiting = spark.createDataFrame([("a", "t", "pending"), ("b", "t", "pending"), ("c", "t", "pending")], "comment_id string, content string, status string")
    waiting = waiting.selectExpr("*", "'x' AS article_id", "1 AS user_id", "CAST(NULL AS BIGINT) AS parent_id")
    verdicts = spark.createDataFrame([("a", 0), ("b", 2), ("b", 1), ("z", 0)], "comment_id string, label int")
    after = moderation.apply_verdicts(verdicts, waiting, now=F.lit("2024-06-01 00:00:00").cast("timestamp")).pending
    got = {r.comment_id: (r.status, r.phobert_label, r.processed_at is not None) for r in after.collect()}
    assert got == {"a": ("processed", 0, True), "b": ("processed", 2, True), "c": ("pending", None, False)}


# Near-duplicates


def word_counts(text):
    return Counter(re.findall(r"\w{2,}", (text or "").lower()))


def brute_flags(new, stored, threshold=Fraction(4, 5)):
    stored_counts = [word_counts(t) for t in stored]
    vocabulary = set().union(*stored_counts) if stored_counts else set()
    flags = []
    for text in new:
        a = {w: n for w, n in word_counts(text).items() if w in vocabulary}
        flags.append(
            any(
                (dot := sum(n * b.get(w, 0) for w, n in a.items())) > 0
                and threshold.denominator**2 * dot**2
                >= threshold.numerator**2 * sum(n * n for n in a.values()) * sum(n * n for n in b.values())
                for b in stored_counts
            )
        )
    return flags


def texts(seed, size):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(size // 3)]
    near = [" ".join([*t.split()[:-1], rng.choice(words)]) for t in base]
    return base + near + ["", "a b", "rare unseen"] + base[:5]


@pytest.mark.parametrize("index_pairs", [dedupe.INDEX_PAIRS, 400])
def test_near_duplicates_match_brute_force(spark, index_pairs):
    new, stored = texts(1, 90), texts(1, 60)[20:] + [None]
    new_frame = spark.createDataFrame(list(enumerate(new)), "id bigint, body string")
    stored_frame = spark.createDataFrame(list(enumerate(stored)), "id bigint, body string")
    flags = dedupe.flag_near_duplicates(new_frame, stored_frame, "id", "body", index_pairs=index_pairs)
    got = {r.id: r.near_duplicate for r in flags.collect()}
    want = dict(enumerate(brute_flags(new, [t or "" for t in stored])))
    assert got == want
    assert 0 < sum(want.values()) < len(want)


def test_cosine_at_the_threshold_counts(spark):
    # (4, 3) against (1, 0): exactly 4/5.
    new = spark.createDataFrame([(1, "xx xx xx xx yy yy yy"), (2, "xx xx xx yy yy yy")], "id bigint, body string")
    stored = spark.createDataFrame([(1, "xx"), (2, "yy zz zz zz zz")], "id bigint, body string")
    flags = {r.id: r.near_duplicate for r in dedupe.flag_near_duplicates(new, stored, "id", "body").collect()}
    assert flags == {1: True, 2: False}


def test_no_stored_rows_keep_everything(spark):
    new = spark.createDataFrame([(1, "a b c")], "id bigint, body string")
    assert dedupe.drop_near_duplicates(new, new.limit(0), "id", "body").count() == 1


# Titles and ids


def test_first_title_wins_and_stored_titles_are_known(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "x" * 600), (7, "x" * 500 + "y")], "id int, title string")
    stored = spark.createDataFrame([("b",), ("z",)], "title string")
    kept = lambda **o: sorted(r.id for r in dedupe.drop_known_titles(new, stored, ["id"], **o).collect())
    assert kept() == [1, 4, 5, 6]
    assert kept(compat=True) == [1, 4, 5, 6, 7]


def test_ids_follow_the_largest_number(spark):
    stored = spark.createDataFrame([("BB-999",), ("BB-1846",), ("BB-x",), ("QQ-5000",)], "article_id string")
    new = spark.createDataFrame([(2,), (1,)], "seq int")
    got = {r.seq: r.article_id for r in dedupe.with_article_ids(new, stored, ["seq"]).collect()}
    assert got == {1: "BB-1847", 2: "BB-1848"}
    assert dedupe.max_article_number(stored.filter("false")).first()[0] == 0


# Topics


CORPUS = [("sport", "ball goal ball team"), ("sport", "goal! Team, win"), ("sport", "ball ball"), ("money", "bank rate win và")]


def brute_scores(train, words, vocabulary):
    labels = sorted({label for label, _ in train})
    out = []
    for label in labels:
        mine = [t for l, t in train if l == label]
        counts = Counter(w for t in mine for w in t)
        total = sum(counts[w] for w in vocabulary)
        score = math.log(len(mine) / len(train))
        score += sum(math.log((counts[w] + 1) / (total + len(vocabulary))) for w in words if w in vocabulary)
        out.append(score)
    return labels, out


@pytest.mark.parametrize("cells,share", [(topics.BROADCAST_CELLS, topics.HOT_SHARE), (0, 3)])
def test_scores_match_brute_force(spark, monkeypatch, cells, share):
    monkeypatch.setattr(topics, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(topics, "HOT_SHARE", share)
    frame = spark.createDataFrame(CORPUS, "label string, body string")
    model = topics.fit(frame, "body", "label")
    split = [(l, [w.strip("!,").lower() for w in t.split()]) for l, t in CORPUS]
    vocabulary = {w for _, t in split for w in t if len(w) > 2 and w not in STOPWORDS}
    docs = {1: "ball ball rate", 2: "unknown words", 3: "bank bank win", 4: ""}
    rated = topics.classify(spark.createDataFrame(list(docs.items()), "id int, body string"), "body", ("id",), model)
    for row in rated.collect():
        labels, want = brute_scores(split, docs[row.id].split(), vocabulary)
        assert row.scores == pytest.approx(want, abs=1e-9)
        assert row.predicted == labels[want.index(max(want))]
        assert row.confidence == pytest.approx(1 / sum(math.exp(s - max(want)) for s in want))
    priors = {r.label: r.log_prior for r in model.priors_frame().collect()}
    assert priors == pytest.approx({"sport": math.log(0.75), "money": math.log(0.25)})


def test_ties_go_to_the_smallest_class(spark):
    model = topics.fit(spark.createDataFrame([("b", "one"), ("a", "two")], "label string, body string"), "body", "label")
    row = topics.classify(spark.createDataFrame([(1, "none")], "id int, body string"), "body", ("id",), model).first()
    assert (row.predicted, row.confidence) == ("a", 0.5)


def test_report_is_zero_without_predictions(spark):
    frame = spark.createDataFrame([("a", "a"), ("a", "a"), ("b", "a")], "label string, predicted string")
    rows = {r.label: (r.precision, r.recall, r.f1, r.support) for r in topics.classification_report(frame, "label").collect()}
    assert rows["b"] == (0.0, 0.0, 0.0, 1)
    assert rows["a"] == pytest.approx((2 / 3, 1.0, 0.8, 2))
    assert rows["macro avg"][1] == 0.5 and rows["weighted avg"][2] == pytest.approx(1.6 / 3)


def test_folds_are_even_runs_of_each_class(spark):
    frame = spark.createDataFrame([(i, "x" if i < 13 else "y") for i in range(16)], "id int, label string")
    got = topics.with_folds(frame, "id", "label").collect()
    sizes = Counter((r.label, r.fold) for r in got)
    assert [sizes[("x", f)] for f in range(1, 6)] == [3, 3, 3, 2, 2]
    assert [sizes[("y", f)] for f in range(1, 6)] == [1, 1, 1, 0, 0]


# Moderation


def decisions(spark, rows, **options):
    frame = spark.createDataFrame(rows, "id int, content string, label int, confidence double")
    return {r.id: (r.label, r.confidence, r.decision, r.reason) for r in moderation.decide(frame, **options).collect()}


def test_decision_rules_in_order(spark):
    rows = [(1, "tốt", 0, 0.71), (2, "tốt", 0, 0.7), (3, "tốt", 1, 0.99), (4, "gọi admin", 0, 0.99), (5, "   ", 2, 0.9),
            (6, "###", 2, 0.9), (7, "tốt", None, None), (8, None, None, None), (9, "tốt", 2, 0.4)]
    got = decisions(spark, rows)
    assert got[1] == (0, 0.71, "approve", "Bình luận tích cực (Label 0)")
    assert got[2] == (0, 0.7, "reject", "Độ tin cậy thấp (0.70)")
    assert got[3][2:] == ("reject", "Bình luận tiêu cực/độc hại (Label 1)")
    assert got[4][2:] == ("reject", moderation.REASON_KEYWORD)
    assert got[5] == got[6] == got[8] == (0, 0.5, None, None)
    assert got[7] == (2, 0.0, "reject", moderation.REASON_NO_MODEL)
    assert got[9][3] == "Bình luận tiêu cực/độc hại (Label 2)"
    assert decisions(spark, rows[6:7], model_missing="none")[7] == (1, 0.0, None, None)


def test_softmax_survives_large_logits(spark):
    frame = spark.createDataFrame([(1, 1000.0, 999.0, 0.0), (2, 1.0, 1.0, 1.0)], "comment_id int, logit_0 double, logit_1 double, logit_2 double")
    rows = {r.comment_id: r for r in moderation.with_probabilities(frame).collect()}
    assert rows[1].label == 0 and rows[1].confidence == pytest.approx(1 / (1 + math.exp(-1)))
    assert rows[2].label == 0 and rows[2].probabilities == pytest.approx([1 / 3] * 3)


def test_verdicts_keep_repeats_and_report_unknown_ids(spark):
    verdicts = spark.createDataFrame([("a", 0), ("a", 0), ("b", 1), ("c", 2), ("d", 5), ("zz", 0)], "comment_id string, label int")
    pending = spark.createDataFrame([(k, "BB-1", 1, "x" * 60, None) for k in "abcd"], "comment_id string, article_id string, user_id int, content string, parent_id int")
    outcome = moderation.apply_verdicts(verdicts, pending)
    assert moderation.verdict_statistics(outcome.rows).first().asDict() == {"total_processed": 6, "saved_to_db": 3, "deleted": 1, "errors": 1}
    assert [r.content for r in outcome.deleted.collect()] == ["x" * 50 + "..."]
    assert Counter(r.sentiment for r in outcome.new_comments.collect()) == {"positive": 2, "negative": 1}
    gone = moderation.apply_verdicts(verdicts, pending, spark.createDataFrame([("BB-2",)], "article_id string"))
    assert moderation.verdict_statistics(gone.rows).first().errors == 4


def test_sentiment_statistics_round_half_to_even_and_allow_no_rows(spark):
    rows = [("positive",)] * 1 + [("negative",)] * 15
    row = moderation.sentiment_statistics(spark.createDataFrame(rows, "sentiment string")).first()
    assert (row.positive_percent, row.negative_percent, row.total) == (6.2, 93.8, 16)
    empty = moderation.sentiment_statistics(spark.createDataFrame([], "sentiment string")).first()
    assert (empty.positive, empty.total, empty.positive_percent) == (0, 0, None)


def test_empty_text_is_neutral(spark):
    model = topics.fit(spark.createDataFrame([("positive", "vui lắm"), ("negative", "buồn lắm")], "label string, body string"), "body", "label")
    got = moderation.sentiment(spark.createDataFrame([(1, "123 !!"), (2, "vui")], "id int, content string"), model)
    rows = {r.id: (r.sentiment, r.confidence) for r in got.collect()}
    assert rows[1] == ("neutral", 0.0) and rows[2][0] == "positive"


# Commands


USERS = "id bigint, status string, role string, author_requested boolean"


def test_only_the_first_review_of_a_pending_article_counts(spark):
    articles = spark.createDataFrame([("a", "Pending"), ("b", "pending"), ("c", "published")], "article_id string, status string")
    asked = spark.createDataFrame([(1, "a", "reject"), (2, "a", "approve"), (3, "b", "approve"), (4, "x", "approve")], "seq int, article_id string, action string")
    change = commands.review_articles(articles, asked)
    assert {r.article_id: r.status for r in change.table.collect()} == {"a": "rejected", "b": "pending", "c": "published"}
    assert {r.seq: r.outcome for r in change.outcomes.collect()} == {1: "applied", 2: "not_found", 3: "not_found", 4: "not_found"}


def test_toggles(spark):
    users = spark.createDataFrame([(1, "Active", "User", False), (2, "Active", "User", False), (3, "Banned", "User", False), (4, "Banned", "User", False), (5, None, "User", False)], USERS)
    asked = spark.createDataFrame([(1, 1), (2, 2), (3, 2), (4, 3), (5, 4), (6, 4), (7, 9)], "seq int, id bigint")
    change = commands.toggle_users(users, asked)
    assert {r.id: r.status for r in change.table.collect()} == {1: "Inactive", 2: "Active", 3: "Active", 4: "Inactive", 5: None}
    assert {r.id: r.outcome for r in change.outcomes.collect()}[9] == "not_found"


def test_author_requests(spark):
    users = spark.createDataFrame([(1, "Active", "User", True), (2, "Active", "User", False)], USERS)
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 7)], "seq int, id bigint")
    granted, cleared = commands.approve_author_requests(users, asked), commands.clear_author_requests(users, asked)
    assert {r.id: (r.role, r.author_requested) for r in granted.table.collect()} == {1: ("author", False), 2: ("User", False)}
    assert {r.id: (r.role, r.author_requested) for r in cleared.table.collect()} == {1: ("User", False), 2: ("User", False)}
    assert {r.seq: r.outcome for r in granted.outcomes.collect()} == {1: "applied", 2: "no_request", 3: "no_request", 4: "not_found"}
    assert {r.id: r.author_requested for r in commands.request_author(users, asked).collect()} == {1: True, 2: True}


def test_deletes_and_likes_and_settings(spark):
    rows = spark.createDataFrame([(1, 2), (2, None), (3, 0)], "id bigint, likes bigint")
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 9)], "seq int, id bigint")
    change = commands.delete_rows(rows, asked, "id")
    assert sorted(r.id for r in change.table.collect()) == [2, 3]
    assert {r.seq: r.outcome for r in change.outcomes.collect()} == {1: "deleted", 2: "not_found", 3: "not_found"}
    events = spark.createDataFrame([(1,), (1,), (2,), (8,)], "comment_id bigint")
    assert {r.id: r.likes for r in commands.like_comments(rows, events).collect()} == {1: 4, 2: 1, 3: 0}
    stored = spark.createDataFrame([("k", "old"), ("s", "same")], "setting_key string, value string")
    new = spark.createDataFrame([(1, "k", "first"), (2, "k", "last"), (3, "n", None)], "seq int, setting_key string, value string")
    assert {r.setting_key: r.value for r in commands.upsert_settings(stored, new).collect()} == {"k": "last", "s": "same", "n": None}


def test_comment_submissions(spark):
    ddl = "id bigint, article_id string, user_id bigint, content string, parent_id bigint, likes bigint, status string, sentiment string, sentiment_confidence double"
    stored = spark.createDataFrame([(5, "BB-1", 1, "old", None, 0, "active", "neutral", 0.0)], ddl)
    new = spark.createDataFrame(
        [(1, "BB-1", 1, None, "tốt"), (2, "BB-9", 1, None, "tốt"), (3, "BB-1", 1, None, "###"), (4, "BB-1", 1, 5, "###"),
         (5, "BB-1", 1, 77, "tốt"), (6, "BB-1", 2, None, "tốt"), (7, "BB-1", 1, None, "rác")],
        "seq bigint, article_id string, user_id bigint, parent_id bigint, content string",
    )
    scores = spark.createDataFrame([(i, 9.0, 0.0, 0.0) for i in range(1, 8)], "comment_id bigint, logit_0 double, logit_1 double, logit_2 double")
    change = commands.add_comments(stored, new, spark.createDataFrame([("BB-1",)], "article_id string"), spark.createDataFrame([(1,)], "id bigint"), scores, "2025-01-01 00:00:00")
    assert {r.seq: r.outcome for r in change.outcomes.collect()} == {
        1: "saved", 2: "no_article", 3: "ignored", 4: "saved", 5: "no_parent", 6: "no_user", 7: "rejected"}
    added = {r.id: (r.content, r.sentiment, r.parent_id) for r in change.table.filter("id > 5").collect()}
    assert added == {6: ("tốt", "positive", None), 7: ("###", "neutral", 5)}


# Catalogue and comments


def test_newest_first_puts_undated_rows_first_and_pages_agree(spark, monkeypatch):
    rows = [(f"a{i:03}", None if i % 10 == 0 else f"2024-01-{i % 7 + 1:02} 00:00:00") for i in range(45)]
    frame = spark.createDataFrame(rows, "article_id string, d string").select("article_id", F.to_timestamp("d").alias("date_posted"))
    want = [r[0] for r in sorted(rows, key=lambda r: (r[1] is not None, [-ord(c) for c in r[1] or ""], r[0]))]
    paged = [r.article_id for n in range(1, 6) for r in catalogue.page(frame, n).collect()]
    assert paged == want
    monkeypatch.setattr(catalogue, "DEEP_OFFSET", 5)
    deep = [r.article_id for n in range(1, 7) for r in catalogue.page(frame, n).collect()]
    assert deep == want
    numbered = {r.article_id: r.page_no for r in catalogue.with_pages(frame).collect()}
    assert numbered == {key: i // 10 + 1 for i, key in enumerate(want)}
    walked, last = [], None
    while True:
        rows = (catalogue.page(frame, 1) if last is None else catalogue.page_after(frame, last.date_posted, last.article_id)).collect()
        if not rows:
            break
        walked += [r.article_id for r in rows]
        last = rows[-1]
    assert walked == want
    assert [r.rows_on_page for r in catalogue.page_summary(frame).orderBy("page_no").collect()] == [10, 10, 10, 10, 5]
    assert catalogue.page_summary(frame.limit(0)).count() == 0


def test_search_wildcards_and_blank_query(spark):
    frame = spark.createDataFrame([("Đá Bóng", "published"), ("ĐỒNG 5%", "published"), ("x", "Pending")], "title string, status string")
    found = lambda q: sorted(r.title for r in catalogue.search_published(frame, q).collect())
    assert found(" đá ") == ["Đá Bóng"] and found("   ") == ["Đá Bóng", "ĐỒNG 5%"] and found("đ_ng") == ["ĐỒNG 5%"] and found("%") == ["Đá Bóng", "ĐỒNG 5%"]


def test_threads_show_one_level_of_active_rows(spark):
    rows = [(1, None, "active", 1), (2, 1, "active", 3), (3, 1, "hidden", 2), (4, 2, "active", 4), (5, None, "hidden", 5), (6, 5, "active", 6), (7, None, "active", 7)]
    frame = spark.createDataFrame(rows, "id bigint, parent_id bigint, status string, t int").select(
        "id", "parent_id", "status", F.timestamp_seconds("t").alias("created_at"), F.lit("BB-1").alias("article_id"))
    assert [(r.root_id, r.id) for r in comments.threads(frame).collect()] == [(7, 7), (1, 1), (1, 2)]
    assert sorted(r.id for r in comments.thread_page(frame, "BB-1", 2, 1).collect()) == [1, 2]


def test_the_most_frequent_words_within_the_bound_are_broadcast(spark, monkeypatch):
    words = spark.createDataFrame([(f"w{i}", n) for i, n in enumerate([9, 9, 7, 5, 5, 5, 1])], "term string, total bigint")
    assert [topics._least_frequent(words, most) for most in (0, 1, 2, 3, 5, 6, 7)] == [100_001, 100_001, 9, 7, 7, 5, 1]
    # No word has a 1/HOT_SHARE share: the bound alone decides, and words beyond it are still found.
    monkeypatch.setattr(topics, "BROADCAST_CELLS", 3)
    monkeypatch.setattr(topics, "HOT_SHARE", 1)
    bag = spark.createDataFrame([(1, "w0"), (1, "w0"), (2, "w2"), (2, "w6"), (3, "none"), (4, None)], "id int, term string")
    found = topics._look_up(bag, words, 7, 1, 41).select("id", "term", "total").collect()
    assert sorted(found, key=str) == sorted([(1, "w0", 9), (1, "w0", 9), (2, "w2", 7), (2, "w6", 1), (3, "none", None), (4, None, None)], key=str)


def test_accuracy_reads_its_predictions_once_computed(spark):
    from pressroom.plans import QUERIES

    files = QUERIES["c6_accuracy"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/evaluated-" in name for name in files)
