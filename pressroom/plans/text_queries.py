"""Queries over text rules, topic classification and comment moderation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from pressroom.functions import dates, text
from pressroom.operators import moderation, topics
from pressroom.plans.catalogue_queries import IS_WORD_SQL, TRAINING_WORDS_SQL
from pressroom.plans.registry import query
from pressroom.session import settle, spread
from pressroom.sources import fixtures as fx

LABELS = ("de", "en", "es", "fr")
KEYWORDS = ("nicht", "thing", "eleve", "ouai")


def strip_sql(c):
    return f"regexp_replace({c}, '^[@SPACE]+|[@SPACE]+$', '', 'g')"


def squash_sql(c):
    return f"regexp_replace({strip_sql(c)}, '[@SPACE]+', ' ', 'g')"


def clean_sql(c):
    return strip_sql(
        f"lower(regexp_replace(regexp_replace(coalesce({c}, ''), '<[^\\n]*?>', '', 'g'), '[^@WORD@SPACE]', '', 'g'))"
    )


def moderation_sql(c):
    c = f"regexp_replace(coalesce({c}, ''), 'https?://[^@SPACE]+', ' ', 'g')"
    c = f"regexp_replace({c}, 'www\\.[^@SPACE]+', ' ', 'g')"
    c = f"regexp_replace({c}, '[^@SPACE]+@[^@SPACE]+', ' ', 'g')"
    for _ in range(2):  # without look-around, neighbours that share a separator need a second pass
        c = f"regexp_replace({c}, '(^|[^@WORD])\\p{{Nd}}{{10,11}}([^@WORD]|$)', '\\1 \\2', 'g')"
    return squash_sql(f"regexp_replace({c}, '[^@WORD@SPACE.,!?]', ' ', 'g')")


def sentiment_sql(c):
    c = f"regexp_replace(coalesce({c}, ''), 'http[^@SPACE]+|www[^@SPACE]+', ' ', 'g')"
    c = f"lower(regexp_replace({c}, '[{text.EMOJI}]+', ' ', 'g'))"
    c = f"string_split({c}, '')"
    pairs = f"list_zip({c}, list_prepend(NULL, {c}))"
    kept = f"list_filter({pairs}, lambda p: p[1] IS DISTINCT FROM p[2] OR p[1] = chr(10))"
    c = f"array_to_string(list_transform({kept}, lambda p: p[1]), '')"
    return squash_sql(f"regexp_replace({c}, '[^{text.SENTIMENT_LETTERS}@SPACE]', ' ', 'g')")


def _documents(spark, folder):
    return spread(fx.table(spark, folder, "documents").select("doc_id", "text"))


# Text functions


@query("t1_clean_comment", f"SELECT doc_id, {clean_sql('text')} AS cleaned FROM documents")
def t1(spark, folder):
    return _documents(spark, folder).select("doc_id", text.clean_comment(F.col("text")).alias("cleaned"))


@query("t2_moderation_text", f"SELECT doc_id, {moderation_sql('text')} AS cleaned FROM documents")
def t2(spark, folder):
    return _documents(spark, folder).select("doc_id", text.moderation_text(F.col("text")).alias("cleaned"))


@query("t3_sentiment_text", f"SELECT doc_id, {sentiment_sql('text')} AS cleaned FROM documents")
def t3(spark, folder):
    return _documents(spark, folder).select("doc_id", text.sentiment_text(F.col("text")).alias("cleaned"))


@query(
    "t4_training_words",
    f"""SELECT d.doc_id, coalesce(t.words, '') AS words, coalesce(t.n, 0) AS n FROM documents d LEFT JOIN (
        SELECT doc_id, string_agg(term, ' ' ORDER BY i) AS words, count(*) AS n FROM (
          SELECT doc_id, i, lower(trim(w[i], '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) AS term FROM (
            SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (
              SELECT doc_id, regexp_split_to_array({strip_sql('text')}, '[@SPACE]+') AS w FROM documents
              WHERE {strip_sql('text')} <> '')))
        GROUP BY doc_id) t ON t.doc_id = d.doc_id""",
)
def t4(spark, folder):
    words = text.training_words(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.array_join(words, " ").alias("words"), F.size(words).cast("bigint").alias("n")
    )


@query(
    "t5_serving_words",
    """SELECT doc_id, array_to_string(w, ' ') AS words, CAST(len(w) AS BIGINT) AS n FROM (
         SELECT doc_id, regexp_extract_all(lower(text), '[@WORD]{2,}') AS w FROM documents)""",
)
def t5(spark, folder):
    words = text.serving_words(F.col("text"))
    return _documents(spark, folder).select(
        "doc_id", F.array_join(words, " ").alias("words"), F.size(words).cast("bigint").alias("n")
    )


@query(
    "t6_vocabulary_words",
    f"SELECT doc_id, count(*) AS words FROM ({TRAINING_WORDS_SQL}) WHERE {IS_WORD_SQL} GROUP BY doc_id",
)
def t6(spark, folder):
    kept = F.filter(text.training_words(F.col("text")), lambda word: text.is_vocabulary_word(word))
    sizes = _documents(spark, folder).select("doc_id", F.size(kept).cast("bigint").alias("words"))
    return sizes.filter("words > 0")


@query("t7_epoch_seconds", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds FROM events")
def t7(spark, folder):
    return fx.table(spark, folder, "events").select("event_id", dates.epoch_seconds(F.col("ts")).alias("seconds"))


TOXIC_SQL = " OR ".join(f"contains(lower(clean), '{word}')" for word in KEYWORDS)


@query(
    "t8_toxic_keywords",
    f"SELECT doc_id, {TOXIC_SQL} AS toxic FROM (SELECT doc_id, {moderation_sql('text')} AS clean FROM documents)",
)
def t8(spark, folder):
    clean = text.moderation_text(F.col("text"))
    return _documents(spark, folder).select("doc_id", text.has_keyword(clean, KEYWORDS).alias("toxic"))


# Topic classification


def model_sql(train: str, labels=LABELS) -> str:
    """CTEs of the model fitted on ``train`` (label, text): cls, logp."""
    return f"""train AS ({train}),
      tw AS (SELECT label, lower(trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) AS term
             FROM (SELECT label, unnest(regexp_split_to_array(text, '[@SPACE]+')) AS w FROM train)),
      cnt AS (SELECT label, term, count(*) AS n FROM tw WHERE {IS_WORD_SQL} GROUP BY label, term),
      voc AS (SELECT DISTINCT term FROM cnt),
      cls AS (SELECT t.label, ln(t.docs / CAST((SELECT count(*) FROM train) AS DOUBLE)) AS prior, coalesce(s.nc, 0) AS nc
              FROM (SELECT label, count(*) AS docs FROM train GROUP BY label) t
              LEFT JOIN (SELECT label, sum(n) AS nc FROM cnt GROUP BY label) s ON s.label = t.label),
      logp AS (SELECT v.term, c.label, ln((coalesce(k.n, 0) + 1) / CAST(c.nc + (SELECT count(*) FROM voc) AS DOUBLE)) AS lp
               FROM voc v CROSS JOIN cls c LEFT JOIN cnt k ON k.term = v.term AND k.label = c.label)"""


def scored_sql(docs: str, words: str = "serving") -> str:
    """CTEs that score ``docs`` (id, text) with the model CTEs: pred (id, predicted, confidence)."""
    split = {
        "serving": "SELECT id, unnest(regexp_extract_all(lower(text), '[@WORD]{2,}')) AS term FROM todo",
        "training": """SELECT id, lower(trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~')) AS term
                       FROM (SELECT id, unnest(regexp_split_to_array(text, '[@SPACE]+')) AS w FROM todo)""",
    }[words]
    return f"""todo AS ({docs}),
      sw AS (SELECT id, term, count(*) AS n FROM ({split}) GROUP BY id, term),
      lik AS (SELECT sw.id, logp.label, sum(sw.n * logp.lp) AS s FROM sw JOIN logp ON logp.term = sw.term GROUP BY ALL),
      sc AS (SELECT d.id, c.label, c.prior + coalesce(lik.s, 0) AS s
             FROM todo d CROSS JOIN cls c LEFT JOIN lik ON lik.id = d.id AND lik.label = c.label),
      best AS (SELECT id, max(s) AS top FROM sc GROUP BY id),
      pred AS (SELECT sc.id, min(sc.label) FILTER (sc.s = b.top) AS predicted, 1 / sum(exp(sc.s - b.top)) AS confidence
               FROM sc JOIN best b ON b.id = sc.id GROUP BY sc.id)"""


TRAIN_SQL = "SELECT lang AS label, text FROM documents WHERE doc_id % 5 <> 0"
ALL_SQL = "SELECT lang AS label, text FROM documents"
DOCS_SQL = "SELECT doc_id AS id, text FROM documents"


def _split(spark, folder):
    return topics.split_by_id(fx.table(spark, folder, "documents"), "doc_id")


@query(
    "a12_vocabulary",
    f"""SELECT term, count(*) AS total FROM ({TRAINING_WORDS_SQL}) WHERE {IS_WORD_SQL}
        GROUP BY term HAVING count(*) >= 3""",
)
def a12(spark, folder):
    return topics.vocabulary(fx.table(spark, folder, "documents"), "text", cutoff=3)


@query(
    "c1_count_vectors",
    f"""SELECT doc_id, term, count(*) AS n FROM ({TRAINING_WORDS_SQL}) WHERE {IS_WORD_SQL}
        AND term IN (SELECT term FROM ({TRAINING_WORDS_SQL}) GROUP BY term HAVING count(*) >= 3)
        GROUP BY doc_id, term""",
)
def c1(spark, folder):
    docs = fx.table(spark, folder, "documents")
    return topics.count_vectors(docs, "text", "doc_id", topics.vocabulary(docs, "text", cutoff=3))


@query(
    "c2_train_test_split",
    "SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM documents",
)
def c2(spark, folder):
    train, test = _split(spark, folder)
    return train.select("doc_id", "lang", F.lit("train").alias("part")).unionByName(
        test.select("doc_id", "lang", F.lit("test").alias("part"))
    )


@query(
    "c3_fit_words",
    f"WITH {model_sql(TRAIN_SQL)} SELECT term, "
    + ", ".join(f"round(max(lp) FILTER (label = '{name}'), 6) AS lp_{name}" for name in LABELS)
    + " FROM logp GROUP BY term",
)
def c3(spark, folder):
    model = topics.fit(_split(spark, folder)[0], "text", "lang")
    return model.scored_words().select(
        "term", *[F.round(F.col("log_p")[i], 6).alias(f"lp_{name}") for i, name in enumerate(model.labels)]
    )


@query(
    "c3_fit_priors",
    f"WITH {model_sql(TRAIN_SQL)} SELECT label, round(prior, 6) AS log_prior, CAST(nc AS BIGINT) AS n_words FROM cls",
)
def c3_priors(spark, folder):
    model = topics.fit(_split(spark, folder)[0], "text", "lang")
    return model.priors_frame().select("label", F.round("log_prior", 6).alias("log_prior"), "n_words")


@query(
    "c4_predict",
    f"WITH {model_sql(TRAIN_SQL)}, {scored_sql(DOCS_SQL)} SELECT p.id AS doc_id, p.predicted, "
    + ", ".join(f"round(max(s.s) FILTER (s.label = '{name}'), 4) AS s_{name}" for name in LABELS)
    + " FROM pred p JOIN sc s ON s.id = p.id GROUP BY p.id, p.predicted",
)
def c4(spark, folder):
    docs = fx.table(spark, folder, "documents")
    model = topics.fit(_split(spark, folder)[0], "text", "lang")
    rated = topics.classify(docs, "text", ("doc_id",), model)
    return rated.select(
        "doc_id", "predicted",
        *[F.round(F.col("scores")[i], 4).alias(f"s_{name}") for i, name in enumerate(model.labels)],
    )


@query(
    "c5_confidence",
    f"""WITH {model_sql(TRAIN_SQL)}, {scored_sql(DOCS_SQL)}
        SELECT id AS doc_id, predicted, round(confidence, 6) AS confidence FROM pred""",
)
def c5(spark, folder):
    docs = fx.table(spark, folder, "documents")
    model = topics.fit(_split(spark, folder)[0], "text", "lang")
    rated = topics.classify(docs, "text", ("doc_id",), model)
    return rated.select("doc_id", "predicted", F.round("confidence", 6).alias("confidence"))


def _evaluated(spark, folder):
    """Predictions of all documents with the training tokeniser, with their true class."""
    docs = fx.table(spark, folder, "documents")
    model = topics.fit(_split(spark, folder)[0], "text", "lang")
    return topics.classify(docs, "text", ("doc_id", "lang"), model, text.training_words)


EVALUATED_SQL = f"""{model_sql(TRAIN_SQL)}, {scored_sql(DOCS_SQL, 'training')},
  ev AS (SELECT d.doc_id, d.lang, p.predicted FROM pred p JOIN documents d ON d.doc_id = p.id)"""


@query(
    "c6_accuracy",
    f"""WITH {EVALUATED_SQL}
        SELECT CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part, count(*) FILTER (predicted = lang) AS hits,
               count(*) AS docs, round(avg(CASE WHEN predicted = lang THEN 1.0 ELSE 0.0 END), 6) AS accuracy
        FROM ev GROUP BY 1""",
)
def c6(spark, folder):
    rated = settle(_evaluated(spark, folder).select("doc_id", "lang", "predicted"), "evaluated")  # both parts read it
    train, test = topics.split_by_id(rated, "doc_id")
    parts = [topics.accuracy(rows, "lang").withColumn("part", F.lit(name)) for rows, name in ((train, "train"), (test, "test"))]
    return parts[0].unionByName(parts[1]).withColumn("accuracy", F.round("accuracy", 6))


@query(
    "c7_classification_report",
    f"""WITH {EVALUATED_SQL},
        te AS (SELECT lang, predicted FROM ev WHERE doc_id % 5 = 0),
        names AS (SELECT lang AS label FROM te UNION SELECT predicted FROM te),
        per AS (SELECT label, (SELECT count(*) FROM te WHERE lang = label) AS support,
                  (SELECT count(*) FROM te WHERE predicted = label) AS chosen,
                  (SELECT count(*) FROM te WHERE lang = label AND predicted = label) AS hits FROM names),
        pr AS (SELECT label, support, CASE WHEN chosen = 0 THEN 0.0 ELSE hits / CAST(chosen AS DOUBLE) END AS precision,
                  CASE WHEN support = 0 THEN 0.0 ELSE hits / CAST(support AS DOUBLE) END AS recall FROM per),
        f AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0
                  ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM pr),
        allrows AS (SELECT label, precision, recall, f1, support FROM f
          UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM f
          UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                           sum(f1 * support) / sum(support), sum(support) FROM f)
        SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM allrows""",
)
def c7(spark, folder):
    test = _evaluated(spark, folder).filter(F.pmod("doc_id", F.lit(5)) == 0)
    report = topics.classification_report(test, "lang")
    return report.select(
        "label", *[F.round(name, 6).alias(name) for name in ("precision", "recall", "f1")], "support"
    )


@query(
    "c8_cross_validation",
    f"""WITH fd AS (SELECT doc_id, lang, text, ntile(5) OVER (PARTITION BY lang ORDER BY doc_id) AS fold
                    FROM documents WHERE doc_id % 5 <> 0),
        tw AS (SELECT doc_id, lang, fold, lower(trim(w, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) AS term
               FROM (SELECT doc_id, lang, fold, unnest(regexp_split_to_array(text, '[@SPACE]+')) AS w FROM fd)),
        cnt AS (SELECT lang, fold, term, count(*) AS n FROM tw WHERE {IS_WORD_SQL} GROUP BY ALL),
        folds AS (SELECT DISTINCT fold FROM fd), langs AS (SELECT DISTINCT lang FROM fd),
        voc AS (SELECT DISTINCT term FROM cnt),
        tot AS (SELECT lang, term, sum(n) AS n FROM cnt GROUP BY ALL),
        size AS (SELECT l.lang, f.fold, sum(c.n) FILTER (c.fold <> f.fold) AS nc
                 FROM langs l CROSS JOIN folds f JOIN cnt c ON c.lang = l.lang GROUP BY ALL),
        prior AS (SELECT l.lang, f.fold, ln((SELECT count(*) FROM fd WHERE fd.lang = l.lang AND fd.fold <> f.fold)
                    / CAST((SELECT count(*) FROM fd WHERE fd.fold <> f.fold) AS DOUBLE)) AS p
                  FROM langs l CROSS JOIN folds f),
        logp AS (SELECT v.term, s.lang, s.fold,
                   ln((coalesce(t.n, 0) - coalesce(c.n, 0) + 1) / CAST(s.nc + (SELECT count(*) FROM voc) AS DOUBLE)) AS lp
                 FROM voc v CROSS JOIN size s LEFT JOIN tot t ON t.term = v.term AND t.lang = s.lang
                 LEFT JOIN cnt c ON c.term = v.term AND c.lang = s.lang AND c.fold = s.fold),
        lik AS (SELECT w.doc_id, l.lang, sum(l.lp) AS s FROM tw w JOIN logp l ON l.term = w.term AND l.fold = w.fold GROUP BY ALL),
        sc AS (SELECT d.doc_id, d.fold, d.lang AS truth, p.lang, p.p + coalesce(k.s, 0) AS s
               FROM fd d JOIN prior p ON p.fold = d.fold LEFT JOIN lik k ON k.doc_id = d.doc_id AND k.lang = p.lang),
        pick AS (SELECT doc_id, fold, truth, arg_max(lang, s) AS predicted FROM sc GROUP BY ALL)
        SELECT CAST(fold AS INT) AS fold, count(*) AS docs, count(*) FILTER (predicted = truth) AS hits FROM pick GROUP BY fold""",
)
def c8(spark, folder):
    return topics.cross_validate(_split(spark, folder)[0], "text", "doc_id", "lang")


@query(
    "a13_category_quality",
    f"""WITH {model_sql(TRAIN_SQL)}, {scored_sql(DOCS_SQL)}
        SELECT predicted, count(*) AS articles, round(avg(confidence), 6) AS mean_confidence,
               count(*) FILTER (confidence < 0.7) AS doubtful FROM pred GROUP BY predicted""",
)
def a13(spark, folder):
    docs = fx.table(spark, folder, "documents")
    model = topics.fit(_split(spark, folder)[0], "text", "lang")
    quality = topics.category_quality(topics.classify(docs, "text", ("doc_id",), model))
    return quality.withColumn("mean_confidence", F.round("mean_confidence", 6))


# Moderation


PROBABILITY_SQL = """pr AS (SELECT comment_id, logit_0, logit_1, logit_2, greatest(logit_0, logit_1, logit_2) AS m,
     exp(logit_0 - m) + exp(logit_1 - m) + exp(logit_2 - m) AS z FROM scores),
   rated AS (SELECT comment_id, CASE WHEN logit_0 = m THEN 0 WHEN logit_1 = m THEN 1 ELSE 2 END AS label, 1 / z AS confidence,
     exp(logit_0 - m) / z AS p0, exp(logit_1 - m) / z AS p1, exp(logit_2 - m) / z AS p2 FROM pr)"""


@query(
    "c9_softmax",
    f"""WITH {PROBABILITY_SQL} SELECT comment_id, label, round(confidence, 6) AS confidence, round(p0, 6) AS p0,
        round(p1, 6) AS p1, round(p2, 6) AS p2 FROM rated""",
    "comments scores",
)
def c9(spark, folder):
    rated = moderation.with_probabilities(fx.scores(spark, folder))
    return rated.select(
        "comment_id", "label", F.round("confidence", 6).alias("confidence"),
        *[F.round(F.col("probabilities")[i], 6).alias(f"p{i}") for i in range(3)],
    )


DECIDED_SQL = f"""{PROBABILITY_SQL},
   cl AS (SELECT c.*, {moderation_sql('c.content')} AS clean, r.label AS lb, r.confidence AS cf
          FROM comments c LEFT JOIN rated r ON r.comment_id = c.id),
   decided AS (SELECT id, article_id, user_id, parent_id, content,
     CASE WHEN clean = '' THEN 0 WHEN lb IS NULL THEN 2 ELSE lb END AS label,
     CASE WHEN clean = '' THEN 0.5 WHEN lb IS NULL THEN 0.0 ELSE cf END AS confidence,
     CASE WHEN {strip_sql("coalesce(content, '')")} = '' THEN '{moderation.DESCRIPTION_EMPTY}'
          WHEN clean = '' THEN '{moderation.DESCRIPTION_EMPTY_AFTER}'
          WHEN lb IS NULL THEN '{moderation.DESCRIPTION_NO_MODEL}'
          WHEN lb = 0 THEN '{moderation.DESCRIPTIONS[0]}' WHEN lb = 1 THEN '{moderation.DESCRIPTIONS[1]}'
          ELSE '{moderation.DESCRIPTIONS[2]}' END AS description,
     CASE WHEN clean = '' THEN NULL WHEN lb IS NULL THEN 'reject' WHEN {TOXIC_SQL} THEN 'reject'
          WHEN lb = 0 AND cf > 0.7 THEN 'approve' ELSE 'reject' END AS decision,
     CASE WHEN clean = '' THEN NULL WHEN lb IS NULL THEN '{moderation.REASON_NO_MODEL}'
          WHEN {TOXIC_SQL} THEN '{moderation.REASON_KEYWORD}'
          WHEN lb = 0 AND cf > 0.7 THEN '{moderation.REASON_POSITIVE}'
          WHEN lb IN (1, 2) THEN 'Bình luận tiêu cực/độc hại (Label ' || lb || ')'
          ELSE 'Độ tin cậy thấp (' || printf('%.2f', cf) || ')' END AS reason,
     CASE WHEN length(clean) > 100 THEN substring(clean, 1, 100) || '...' ELSE clean END AS processed_text
   FROM cl)"""


def _decided(spark, folder):
    return moderation.moderate(fx.comments(spark, folder), fx.scores(spark, folder), KEYWORDS)


@query(
    "c10_decisions",
    f"""WITH {DECIDED_SQL} SELECT id, CAST(label AS INT) AS label, round(confidence, 6) AS confidence, description,
        decision, reason, processed_text FROM decided""",
    "comments scores",
)
def c10(spark, folder):
    return _decided(spark, folder).select(
        "id", "label", F.round("confidence", 6).alias("confidence"), "description", "decision", "reason", "processed_text"
    )


def length_scorer(texts: pd.Series) -> pd.DataFrame:
    """Stand-in for a model: logits from the text length."""
    size = texts.str.len()
    return pd.DataFrame({"logit_0": size % 7 * 1.0, "logit_1": size % 5 * 1.0, "logit_2": size % 3 * 1.0})


@query(
    "c11_batch_scoring",
    f"""SELECT id AS comment_id, CAST(n % 7 AS DOUBLE) AS logit_0, CAST(n % 5 AS DOUBLE) AS logit_1,
               CAST(n % 3 AS DOUBLE) AS logit_2
        FROM (SELECT id, length({moderation_sql('content')}) AS n FROM comments) WHERE n > 0""",
    "comments",
)
def c11(spark, folder):
    return moderation.score_with(fx.comments(spark, folder), length_scorer)


def _sentiment_training(spark, folder):
    labels = fx.table(spark, folder, "labels")
    docs = fx.table(spark, folder, "documents").select("doc_id", "text")
    name = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return docs.join(labels, "doc_id").select("text", name.alias("label"))


SENTIMENT_SQL = f"""{model_sql('''SELECT CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
       ELSE 'neutral' END AS label, d.text FROM documents d JOIN labels l ON l.doc_id = d.doc_id''')},
   {scored_sql(f"SELECT id, {sentiment_sql('content')} AS text FROM comments")},
   felt AS (SELECT p.id, CASE WHEN t.text = '' THEN 'neutral' ELSE p.predicted END AS sentiment,
              CASE WHEN t.text = '' THEN 0.0 ELSE p.confidence END AS confidence, t.text
            FROM pred p JOIN todo t ON t.id = p.id)"""


def _sentiments(spark, folder):
    model = topics.fit(_sentiment_training(spark, folder), "text", "label")
    return moderation.sentiment(fx.comments(spark, folder), model)


@query(
    "c12_sentiment",
    f"""WITH {SENTIMENT_SQL} SELECT id, sentiment, round(confidence, 6) AS confidence,
        CASE WHEN text = '' THEN NULL WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END
        AS processed_text FROM felt""",
    "comments",
)
def c12(spark, folder):
    return _sentiments(spark, folder).withColumn("confidence", F.round("confidence", 6))


@query(
    "a8_sentiment_statistics",
    f"""WITH {SENTIMENT_SQL},
        n AS (SELECT count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'negative') AS negative,
                count(*) FILTER (sentiment = 'neutral') AS neutral, count(*) AS total FROM felt)
        SELECT *, round_even(100.0 * positive / total, 1) AS positive_percent,
               round_even(100.0 * negative / total, 1) AS negative_percent,
               round_even(100.0 * neutral / total, 1) AS neutral_percent FROM n""",
    "comments",
)
def a8(spark, folder):
    return moderation.sentiment_statistics(_sentiments(spark, folder))


OUTCOME_SQL = """outcomes AS (
   SELECT v.comment_id, CAST(v.label AS INT) AS label, c.content,
     CASE WHEN c.id IS NULL THEN 'error'
          WHEN v.label IN (0, 1) AND NOT EXISTS (SELECT 1 FROM articles a WHERE a.article_id = c.article_id) THEN 'error'
          WHEN v.label IN (0, 1) THEN 'saved' WHEN v.label = 2 THEN 'deleted' ELSE 'processed' END AS outcome
   FROM verdicts v LEFT JOIN comments c ON c.id = v.comment_id)"""


def _outcome(spark, folder):
    waiting = fx.comments(spark, folder).select(
        F.col("id").alias("comment_id"), "article_id", "user_id", "parent_id", "content"
    )
    now = F.lit("2024-06-01 00:00:00").cast("timestamp")
    waiting = waiting.withColumn("status", F.lit("pending"))
    return moderation.apply_verdicts(fx.verdicts(spark, folder), waiting, fx.articles(spark, folder), now)


@query(
    "a9_verdict_statistics",
    f"""WITH {OUTCOME_SQL} SELECT count(*) AS total_processed, count(*) FILTER (outcome = 'saved') AS saved_to_db,
        count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (outcome = 'error') AS errors FROM outcomes""",
    "articles comments verdicts",
)
def a9(spark, folder):
    return moderation.verdict_statistics(_outcome(spark, folder).rows)


@query(
    "a9_verdict_details",
    f"""WITH {OUTCOME_SQL} SELECT comment_id, substring(content, 1, 50) || '...' AS content, outcome,
        CASE WHEN outcome = 'deleted' THEN 'Label 2 - Content filtered' END AS reason
        FROM outcomes WHERE outcome IN ('saved', 'deleted')""",
    "articles comments verdicts",
)
def a9_details(spark, folder):
    outcome = _outcome(spark, folder)
    saved = outcome.saved.select(
        "comment_id", "content", F.lit("saved").alias("outcome"), F.lit(None).cast("string").alias("reason")
    )
    return saved.unionByName(outcome.deleted.select("comment_id", "content", F.lit("deleted").alias("outcome"), "reason"))


@query("c13_apply_verdicts", f"WITH {OUTCOME_SQL} SELECT comment_id, label, outcome FROM outcomes", "articles comments verdicts")
def c13(spark, folder):
    return _outcome(spark, folder).rows.withColumn("label", F.col("label").cast("int"))


@query(
    "c13_new_comments",
    f"""WITH {OUTCOME_SQL} SELECT c.article_id, c.user_id, c.content, c.parent_id,
          CASE WHEN o.label = 0 THEN 'positive' ELSE 'negative' END AS sentiment,
          CAST(0.9 AS DOUBLE) AS sentiment_confidence
        FROM outcomes o JOIN comments c ON c.id = o.comment_id WHERE o.outcome = 'saved'""",
    "articles comments verdicts",
)
def c13_new(spark, folder):
    return _outcome(spark, folder).new_comments


@query(
    "c13_pending_after",
    f"""WITH {OUTCOME_SQL}, done AS (SELECT comment_id, max(label) AS label FROM outcomes WHERE outcome <> 'error' GROUP BY 1)
        SELECT c.id AS comment_id, c.article_id, CASE WHEN d.label IS NULL THEN 'pending' ELSE 'processed' END AS status,
               d.label AS phobert_label, CASE WHEN d.label IS NOT NULL THEN '2024-06-01 00:00:00' END AS processed_at
        FROM comments c LEFT JOIN done d ON d.comment_id = c.id""",
    "articles comments verdicts",
)
def c13_pending(spark, folder):
    after = _outcome(spark, folder).pending
    return after.select(
        "comment_id", "article_id", "status", "phobert_label", F.date_format("processed_at", "yyyy-MM-dd HH:mm:ss").alias("processed_at")
    )


@query(
    "c13_status_counts_after",
    f"""WITH {OUTCOME_SQL}, done AS (SELECT DISTINCT comment_id FROM outcomes WHERE outcome <> 'error')
        SELECT CASE WHEN d.comment_id IS NULL THEN 'pending' ELSE 'processed' END AS status, count(*) AS comments
        FROM comments c LEFT JOIN done d ON d.comment_id = c.id GROUP BY 1""",
    "articles comments verdicts",
)
def c13_counts(spark, folder):
    return moderation.status_counts(_outcome(spark, folder).pending)


@query(
    "c14_saved_sentiment",
    "SELECT comment_id, CASE WHEN label = 0 THEN 'positive' ELSE 'negative' END AS sentiment FROM verdicts",
    "verdicts",
)
def c14(spark, folder):
    return fx.verdicts(spark, folder).select(
        "comment_id", moderation.saved_sentiment(F.col("label")).alias("sentiment")
    )


@query("a10_status_counts", "SELECT status, count(*) AS comments FROM comments GROUP BY status", "comments")
def a10(spark, folder):
    return moderation.status_counts(fx.comments(spark, folder))
