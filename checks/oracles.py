"""DuckDB statement per registered query."""

from __future__ import annotations

from checks.sql_parts import EMOJI, URL, WS, label, rnd, statement


def top(table: str, term: str, n: int) -> str:
    return statement(
        f"""
SELECT chat_id, {term}, count, rank::INT AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, {term}) AS rank FROM {table})
WHERE rank <= {n}""",
        table,
    )


def over_domain(column: str, domain: str, name: str) -> str:
    return statement(
        f"""
SELECT c.chat_id, d.*, count(m.msg_seq) AS messages
FROM (SELECT DISTINCT chat_id FROM messages) c CROSS JOIN ({domain}) d
LEFT JOIN messages m ON m.chat_id = c.chat_id AND m.{column} = d.{name}
GROUP BY ALL""",
        "messages",
    )


WEEKDAYS = (
    "SELECT * FROM (VALUES (0, 'Monday'), (1, 'Tuesday'), (2, 'Wednesday'), (3, 'Thursday'),"
    " (4, 'Friday'), (5, 'Saturday'), (6, 'Sunday')) t(position, day_name)"
)


def trend(period: str) -> str:
    return statement(
        f"""
SELECT chat_id, {period}::DATE AS date, count(*) AS message_count,
       {rnd('sum(sentiment_score::DECIMAL(18,4))::DOUBLE / count(*)', 4)} AS avg_score
FROM text_scored GROUP BY ALL""",
        "text_scored",
    )


def pct(part: str, whole: str) -> str:
    return rnd(f"{part} / {whole} * 100", 1)


def distribution(table: str) -> str:
    return statement(
        f"""
SELECT c.chat_id, l.label, count(s.msg_seq) AS messages, {pct('count(s.msg_seq)', 'any_value(c.n)')} AS share_pct
FROM (SELECT chat_id, count(*) AS n FROM {table} GROUP BY ALL) c
CROSS JOIN (VALUES ('Positive'), ('Neutral'), ('Negative')) l(label)
LEFT JOIN {table} s ON s.chat_id = c.chat_id AND s.sentiment_label = l.label
GROUP BY ALL""",
        table,
    )


MEAN = "sum(sentiment_score::DECIMAL(18,4))::DOUBLE / count(*)"

ORACLES: dict[str, str] = {
    "message_table": statement("SELECT * FROM messages", "messages"),
    "enriched_messages": statement(
        "SELECT chat_id, msg_seq, array_to_string(emoji_list, '|') AS emoji_list, emoji_count, has_url,"
        " cleaned_message FROM enriched",
        "enriched",
    ),
    "scored_messages": statement(
        "SELECT chat_id, msg_seq, sentiment_label, sentiment_score, subjectivity, sentiment_confidence,"
        " vader_pos, vader_neg, vader_neu FROM scored",
        "scored",
    ),
    "chat_summary": statement(
        f"""
SELECT m.chat_id, count(*) AS total_messages,
       count(*) FILTER (NOT is_media AND NOT is_deleted) AS total_text_msgs,
       count(*) FILTER (is_media) AS total_media_msgs, count(*) FILTER (is_deleted) AS total_deleted,
       count(DISTINCT sender) AS total_senders, min(date) AS date_start, max(date) AS date_end,
       date_diff('day', min(date), max(date))::INT AS total_days, sum(word_count)::BIGINT AS total_words,
       {rnd('sum(word_count) FILTER (NOT is_media AND NOT is_deleted) / count(*) FILTER (NOT is_media AND NOT is_deleted)', 2)}
         AS avg_words_per_msg,
       any_value(a.sender_name) AS most_active_user
FROM messages m JOIN (
  SELECT chat_id, sender AS sender_name FROM messages GROUP BY chat_id, sender
  QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, sender) = 1) a USING (chat_id)
GROUP BY m.chat_id""",
        "messages",
    ),
    "chat_senders": statement(
        """
SELECT chat_id, sender, datetime AS first_datetime, msg_seq AS first_msg_seq FROM messages
QUALIFY row_number() OVER (PARTITION BY chat_id, sender ORDER BY datetime, msg_seq) = 1""",
        "messages",
    ),
    "processing_stats": statement(
        f"""
SELECT e.chat_id, count(*) AS total_messages,
       count(*) FILTER (cleaned_message <> '') AS processable_messages,
       count(*) FILTER (emoji_count > 0) AS messages_with_emoji, sum(emoji_count)::BIGINT AS total_emojis,
       count(*) FILTER (has_url) AS messages_with_url, coalesce(any_value(w.n), 0) AS unique_words,
       {rnd("sum(n_words) / count(*) FILTER (cleaned_message <> '')", 2)} AS avg_words_after_clean
FROM enriched e LEFT JOIN (SELECT chat_id, count(DISTINCT word) AS n FROM terms GROUP BY ALL) w USING (chat_id)
GROUP BY e.chat_id""",
        "enriched", "terms",
    ),
    "sender_stats": statement(
        f"""
SELECT e.chat_id, e.sender, count(*) AS total_messages, count(*) FILTER (is_text) AS text_messages,
       count(*) FILTER (is_media) AS media_messages, count(*) FILTER (is_deleted) AS deleted_messages,
       sum(word_count)::BIGINT AS total_words,
       coalesce({rnd('sum(word_count) FILTER (is_text) / count(*) FILTER (is_text)', 2)}, 0.0) AS avg_words_per_msg,
       sum(emoji_count)::BIGINT AS total_emojis, {rnd('sum(emoji_count) / count(*)', 2)} AS avg_emojis_per_msg,
       count(*) FILTER (has_url) AS urls_shared,
       {rnd('count(*) / any_value(t.n) * 100', 2)} AS message_share_pct, any_value(h.hour) AS most_active_hour
FROM enriched e JOIN (SELECT chat_id, count(*) AS n FROM enriched GROUP BY ALL) t USING (chat_id)
JOIN (SELECT chat_id, sender, hour FROM enriched GROUP BY chat_id, sender, hour
      QUALIFY row_number() OVER (PARTITION BY chat_id, sender ORDER BY count(*) DESC, hour) = 1) h
  USING (chat_id, sender)
GROUP BY e.chat_id, e.sender""",
        "enriched",
    ),
    "participation": statement(
        f"""
SELECT chat_id, sender, count(*) AS messages, any_value(n) AS chat_messages,
       {pct('count(*)', 'any_value(n)')} AS share_pct
FROM messages JOIN (SELECT chat_id, count(*) AS n FROM messages GROUP BY ALL) USING (chat_id)
GROUP BY chat_id, sender""",
        "messages",
    ),
    "monthly_volume_by_sender": statement(
        "SELECT chat_id, month, month_name, sender, count(*) AS messages FROM messages GROUP BY ALL", "messages"
    ),
    "monthly_volume_estimate": statement(
        """
SELECT m.chat_id, m.month, m.month_name, s.sender, floor(m.n * s.n / (c.n + 1) + 0.5)::BIGINT AS messages
FROM (SELECT chat_id, month, month_name, count(*) AS n FROM messages GROUP BY ALL) m
JOIN (SELECT chat_id, sender, count(*) AS n FROM messages GROUP BY ALL) s USING (chat_id)
JOIN (SELECT chat_id, count(*) AS n FROM messages GROUP BY ALL) c USING (chat_id)""",
        "messages",
    ),
    "word_frequency": statement("SELECT * FROM word_counts", "word_counts"),
    "vocabulary_totals": statement(
        "SELECT chat_id, count(*) AS total_words, count(DISTINCT word) AS unique_words FROM terms GROUP BY ALL",
        "terms",
    ),
    "bigram_frequency": statement("SELECT * FROM bigrams", "bigrams"),
    "trigram_frequency": statement("SELECT * FROM trigrams", "trigrams"),
    "emoji_frequency": statement("SELECT * FROM emojis", "emojis"),
    "top_words": top("word_counts", "word", 20),
    "top_bigrams": top("bigrams", "phrase", 10),
    "top_trigrams": top("trigrams", "phrase", 10),
    "top_emojis": top("emojis", "emoji", 10),
    "word_weights": statement(
        """
SELECT chat_id, word, count, rank::INT AS rank, count / max(count) OVER (PARTITION BY chat_id) AS weight
FROM (SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, word) AS rank FROM word_counts)
WHERE rank <= 150""",
        "word_counts",
    ),
    "sender_keywords": statement(
        f"""
, tf AS (SELECT m.chat_id, m.sender, t.word AS term, count(*) AS n
         FROM terms t JOIN messages m USING (chat_id, msg_seq) GROUP BY ALL),
docs AS (SELECT chat_id, count(DISTINCT sender) AS d FROM tf GROUP BY ALL HAVING count(DISTINCT sender) >= 2),
vocab AS (SELECT chat_id, term, count(*) AS df FROM tf GROUP BY chat_id, term
          QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY sum(n) DESC, term) <= 500),
w AS (SELECT tf.chat_id, tf.sender, tf.term,
             (1 + ln(tf.n)) * (ln((1 + docs.d) / (1 + vocab.df)) + 1) AS w
      FROM tf JOIN vocab USING (chat_id, term) JOIN docs USING (chat_id)),
s AS (SELECT chat_id, sender, term, w / sqrt(sum(w * w) OVER (PARTITION BY chat_id, sender)) AS s FROM w)
SELECT chat_id, sender, term, {rnd('s', 4)} AS score,
       (row_number() OVER (PARTITION BY chat_id, sender ORDER BY s DESC, term))::INT AS rank
FROM s WHERE s > 0 QUALIFY rank <= 10""",
        "terms", "messages",
    ),
    "hourly_activity": over_domain("hour", "SELECT range::INT AS hour FROM range(24)", "hour"),
    "weekday_activity": over_domain("day_name", WEEKDAYS, "day_name"),
    "monthly_activity": statement(
        "SELECT chat_id, month, month_name, count(*) AS messages FROM messages GROUP BY ALL", "messages"
    ),
    "monthly_activity_by_year": statement(
        "SELECT chat_id, year, month, month_name, count(*) AS messages FROM messages GROUP BY ALL", "messages"
    ),
    "daily_activity": statement(
        "SELECT chat_id, date, count(*) AS messages FROM messages GROUP BY ALL", "messages"
    ),
    "activity_peaks": statement(
        """
SELECT chat_id, hour AS peak_hour, n AS peak_hour_messages, day_name AS most_active_day
FROM (SELECT chat_id, hour, count(*) AS n FROM messages GROUP BY chat_id, hour
      QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, hour) = 1)
JOIN (SELECT chat_id, day_name FROM messages GROUP BY chat_id, day_name
      QUALIFY row_number() OVER (PARTITION BY chat_id
              ORDER BY count(*) DESC, any_value(isodow(datetime))) = 1) USING (chat_id)""",
        "messages",
    ),
    "reply_gaps": statement("SELECT * EXCLUDE (gap) FROM replies", "replies"),
    "reply_times": statement(
        f"""
SELECT chat_id, sender, count(*) AS n_replies, {rnd('sum(gap)::DOUBLE / count(*) / 6e7', 2)} AS avg_minutes,
       {rnd('sum(gap)::DOUBLE / count(*) / 1e6', 2)} AS avg_seconds
FROM replies GROUP BY ALL""",
        "replies",
    ),
    "sentiment_by_sender": statement(
        f"""
SELECT chat_id, sender, count(*) FILTER (sentiment_label = 'Positive') AS "Positive",
       count(*) FILTER (sentiment_label = 'Negative') AS "Negative",
       count(*) FILTER (sentiment_label = 'Neutral') AS "Neutral", count(*) AS total,
       {pct("count(*) FILTER (sentiment_label = 'Positive')", 'count(*)')} AS positive_pct,
       {pct("count(*) FILTER (sentiment_label = 'Negative')", 'count(*)')} AS negative_pct,
       {pct("count(*) FILTER (sentiment_label = 'Neutral')", 'count(*)')} AS neutral_pct,
       {rnd(MEAN, 4)} AS avg_score
FROM text_scored GROUP BY ALL""",
        "text_scored",
    ),
    "sentiment_daily": trend("date"),
    "sentiment_weekly": trend("(date + (7 - isodow(date))::INT)"),
    "sentiment_monthly": trend("last_day(date)"),
    "overall_mood": statement(
        f"""
, per_sender AS (SELECT chat_id, sender, {MEAN} AS m FROM text_scored GROUP BY ALL),
per_day AS (SELECT chat_id, day_name, {MEAN} AS m FROM text_scored GROUP BY ALL),
total AS (
  SELECT chat_id, count(*) FILTER (is_text) AS n,
         coalesce({rnd('(sum(sentiment_score::DECIMAL(18,4)) FILTER (is_text))::DOUBLE / count(*) FILTER (is_text)', 4)}, 0.0) AS s,
         count(*) FILTER (is_text AND sentiment_label = 'Positive') AS p,
         count(*) FILTER (is_text AND sentiment_label = 'Negative') AS g,
         count(*) FILTER (is_text AND sentiment_label = 'Neutral') AS u,
         count(*) FILTER (is_text AND sentiment_confidence = 'High') AS h
  FROM scored GROUP BY chat_id)
SELECT t.chat_id, {label('s')} AS overall_label, s AS overall_score,
       CASE WHEN n > 0 THEN {pct('p', 'n')} END AS positive_pct,
       CASE WHEN n > 0 THEN {pct('g', 'n')} END AS negative_pct,
       CASE WHEN n > 0 THEN {pct('u', 'n')} END AS neutral_pct,
       (SELECT sender FROM per_sender x WHERE x.chat_id = t.chat_id ORDER BY m DESC, sender LIMIT 1) AS most_positive_user,
       (SELECT sender FROM per_sender x WHERE x.chat_id = t.chat_id ORDER BY m, sender LIMIT 1) AS most_negative_user,
       (SELECT day_name FROM per_day x WHERE x.chat_id = t.chat_id ORDER BY m DESC, day_name LIMIT 1) AS happiest_day,
       CASE WHEN n = 0 THEN NULL WHEN s >= 0.3 THEN 'Very Positive 😊' WHEN s >= 0.05 THEN 'Generally Positive 🙂'
            WHEN s <= -0.3 THEN 'Very Negative 😔' WHEN s <= -0.05 THEN 'Generally Negative 😐'
            ELSE 'Mostly Neutral 😶' END AS mood_description,
       n AS total_analysed, h AS high_confidence
FROM total t""",
        "scored", "text_scored",
    ),
    "label_distribution": distribution("text_scored"),
    "label_distribution_all": distribution("scored"),
}


# --- parsing ---------------------------------------------------------------------------

ORACLES["parsed_messages"] = statement(
    "SELECT * REPLACE (row_number() OVER (PARTITION BY chat_id ORDER BY datetime, msg_seq) AS msg_seq,"
    " date_trunc('second', datetime) AS datetime)"
    " FROM messages",
    "messages",
)
ORACLES["parse_report"] = statement(
    """
, hours AS (
  SELECT count(DISTINCT h) FILTER (h % 3 = 0) AS notices, count(DISTINCT h) FILTER (h % 5 = 0) AS unread
  FROM (SELECT floor(epoch(datetime) / 3600)::BIGINT AS h FROM messages WHERE chat_id = 'fr')),
chats AS (
  SELECT chat_id, CASE chat_id WHEN 'de' THEN 'android 12-hour' WHEN 'team' THEN 'ios 12-hour'
                               ELSE 'android 24-hour' END AS layout,
         CASE WHEN chat_id = 'fr' THEN (SELECT unread FROM hours) ELSE 0 END AS bad_timestamps,
         CASE WHEN chat_id = 'fr' THEN (SELECT notices FROM hours) ELSE 0 END AS system_notices,
         count(*) AS parsed_messages, count(DISTINCT sender) AS senders, min(date) AS date_start, max(date) AS date_end
  FROM messages GROUP BY chat_id)
SELECT chat_id, layout, parsed_messages + bad_timestamps + system_notices AS message_blocks, bad_timestamps,
       system_notices, parsed_messages, senders, date_start, date_end, 'ok' AS status
FROM chats
UNION ALL SELECT 'yy', 'android 24-hour', 1, 1, 0, 0, 0, NULL, NULL, 'empty'
UNION ALL SELECT 'zz', NULL, 0, 0, 0, 0, 0, NULL, NULL, 'unsupported'""",
    "messages",
)

# --- training --------------------------------------------------------------------------

GRAMS = """
SELECT chat_id, msg_seq, term, count(*) AS n
FROM (SELECT t.chat_id, t.msg_seq, t.word AS term FROM terms t SEMI JOIN {rows} USING (chat_id, msg_seq)
      UNION ALL
      SELECT t.chat_id, t.msg_seq,
             t.word || ' ' || lead(t.word) OVER (PARTITION BY t.chat_id, t.msg_seq ORDER BY t.pos)
      FROM terms t SEMI JOIN {rows} USING (chat_id, msg_seq))
WHERE term IS NOT NULL GROUP BY ALL"""


def hashed(purpose: str) -> str:
    return f"md5('{purpose}|42|' || chat_id || '|' || msg_seq)"


TRAINING: dict[str, tuple[str, tuple[str, ...]]] = {
    "base": ("SELECT * FROM scored WHERE is_text AND cleaned_message <> ''", ("scored",)),
    "tier": (
        """
SELECT CASE WHEN count(*) FILTER (sentiment_confidence = 'High') >= 30
             AND count(DISTINCT sentiment_label) FILTER (sentiment_confidence = 'High') >= 2 THEN 1
            WHEN count(*) FILTER (sentiment_confidence <> 'Low') >= 30
             AND count(DISTINCT sentiment_label) FILTER (sentiment_confidence <> 'Low') >= 2 THEN 2
            ELSE 3 END AS t FROM base""",
        ("base",),
    ),
    "chosen": (
        """
SELECT base.* FROM base, tier
WHERE t = 3 OR sentiment_confidence = 'High' OR (t = 2 AND sentiment_confidence = 'Medium')""",
        ("base", "tier"),
    ),
    "sample": (
        f"""
SELECT chat_id, msg_seq, cleaned_message, sentiment_label
FROM (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY {hashed('sample')}) AS r FROM chosen)
WHERE r <= (SELECT least(300, min(n)) FROM (SELECT count(*) AS n FROM chosen GROUP BY sentiment_label))""",
        ("chosen",),
    ),
    "quota": (
        """
SELECT sentiment_label, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, sentiment_label)
                                             <= t - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS q
FROM (SELECT sentiment_label, ceil(sum(c) OVER () * 0.2::DOUBLE) AS t,
             ceil(sum(c) OVER () * 0.2::DOUBLE) * c / sum(c) OVER () AS e
      FROM (SELECT sentiment_label, count(*) AS c FROM sample GROUP BY ALL))""",
        ("sample",),
    ),
    "split": (
        f"""
SELECT chat_id, msg_seq, sentiment_label, CASE WHEN r <= q THEN 'test' ELSE 'train' END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY sentiment_label ORDER BY {hashed('split')}) AS r FROM sample)
JOIN quota USING (sentiment_label)""",
        ("sample", "quota"),
    ),
    "folds": (
        f"""
SELECT chat_id, msg_seq, sentiment_label,
       (ntile(5) OVER (PARTITION BY sentiment_label ORDER BY {hashed('fold')}) - 1)::INT AS fold
FROM sample""",
        ("sample",),
    ),
    "runs": (
        """
SELECT 0 AS run, part, chat_id, msg_seq, sentiment_label FROM split
UNION ALL
SELECT r::INT, CASE WHEN fold = r - 1 THEN 'test' ELSE 'train' END, chat_id, msg_seq, sentiment_label
FROM folds, range(1, 6) t(r)""",
        ("split", "folds"),
    ),
    "counts": (GRAMS.format(rows="sample"), ("terms", "sample")),
    "vocab": (
        """
SELECT run, term, position, ln((1 + d.n) / (1 + df)) + 1 AS idf
FROM (SELECT run, term, count(*) AS df,
             row_number() OVER (PARTITION BY run ORDER BY sum(n) DESC, term) AS position
      FROM counts JOIN runs USING (chat_id, msg_seq) WHERE part = 'train'
      GROUP BY run, term HAVING count(*) >= 2)
JOIN (SELECT run, count(*) AS n FROM runs WHERE part = 'train' GROUP BY run) d USING (run)
WHERE position <= 5000""",
        ("counts", "runs"),
    ),
    "weighted": (
        """
SELECT run, part, chat_id, msg_seq, sentiment_label, term,
       w / sqrt(sum(w * w) OVER (PARTITION BY run, chat_id, msg_seq)) AS weight
FROM (SELECT *, (1 + ln(n)) * idf AS w FROM counts JOIN runs USING (chat_id, msg_seq)
      JOIN vocab USING (run, term))""",
        ("counts", "runs", "vocab"),
    ),
    "priors": (
        """
SELECT run, sentiment_label AS label, ln(count(*) / sum(count(*)) OVER (PARTITION BY run)) AS bias
FROM runs WHERE part = 'train' GROUP BY run, sentiment_label""",
        ("runs",),
    ),
    "bayes": (
        """
SELECT run, label, term,
       ln((s + 0.1::DOUBLE) / (sum(s) OVER c + 0.1::DOUBLE * count(*) OVER c)) AS weight
FROM (SELECT v.run, p.label, v.term, coalesce(x.s, 0.0::DOUBLE) AS s
      FROM vocab v JOIN priors p USING (run)
      LEFT JOIN (SELECT run, sentiment_label, term, sum(weight) AS s FROM weighted
                 WHERE part = 'train' GROUP BY ALL) x
        ON x.run = v.run AND x.sentiment_label = p.label AND x.term = v.term)
WINDOW c AS (PARTITION BY run, label)""",
        ("vocab", "priors", "weighted"),
    ),
    "guesses": (
        """
SELECT run, chat_id, msg_seq, sentiment_label AS label, p.label AS prediction
FROM runs JOIN priors p USING (run)
LEFT JOIN (SELECT w.run, chat_id, msg_seq, b.label, sum(w.weight * b.weight) AS e
           FROM weighted w JOIN bayes b ON w.run = b.run AND w.term = b.term WHERE part = 'test' GROUP BY ALL) x
  USING (run, chat_id, msg_seq, label)
WHERE part = 'test'
QUALIFY row_number() OVER (PARTITION BY run, chat_id, msg_seq
                           ORDER BY bias + coalesce(e, 0) DESC, p.label) = 1""",
        ("runs", "priors", "weighted", "bayes"),
    ),
    "confusion": (
        "SELECT run, label, prediction, count(*) AS n FROM guesses GROUP BY ALL", ("guesses",)
    ),
    "report": (
        """
SELECT a.run, a.label, a.support, a.hits, coalesce(a.hits / p.predicted, 0.0) AS precision,
       a.hits / a.support AS recall,
       CASE WHEN a.hits > 0 THEN 2 * a.hits / (a.support + p.predicted) ELSE 0.0 END::DOUBLE AS f1
FROM (SELECT run, label, count(*) AS support, count(*) FILTER (label = prediction) AS hits
      FROM guesses GROUP BY run, label) a
LEFT JOIN (SELECT run, prediction AS label, count(*) AS predicted FROM guesses GROUP BY run, prediction) p
  USING (run, label)""",
        ("guesses",),
    ),
    "run_scores": (
        """
SELECT run, sum(hits) / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS weighted_f1
FROM report GROUP BY run""",
        ("report",),
    ),
    "known": (
        f"""
SELECT chat_id, msg_seq, label, e / sqrt(sq) AS evidence
FROM (SELECT chat_id, msg_seq, label, sum((1 + ln(n)) * idf * b.weight) AS e,
             sum(((1 + ln(n)) * idf) ^ 2) AS sq
      FROM ({GRAMS.format(rows='messages')}) g
      JOIN vocab v ON v.run = 0 AND v.term = g.term JOIN bayes b ON b.run = 0 AND b.term = g.term
      GROUP BY ALL)""",
        ("terms", "messages", "vocab", "bayes"),
    ),
    "likelihood": (
        """
SELECT m.chat_id, m.msg_seq, p.label, p.bias + coalesce(k.evidence, 0) AS score
FROM messages m CROSS JOIN (SELECT * FROM priors WHERE run = 0) p
LEFT JOIN known k ON k.chat_id = m.chat_id AND k.msg_seq = m.msg_seq AND k.label = p.label""",
        ("messages", "priors", "known"),
    ),
    "best": (
        """
SELECT chat_id, msg_seq, label FROM likelihood
QUALIFY row_number() OVER (PARTITION BY chat_id, msg_seq ORDER BY score DESC, label) = 1""",
        ("likelihood",),
    ),
    "predicted": (
        """
SELECT s.*, CASE WHEN is_text AND cleaned_message <> '' THEN b.label ELSE 'Neutral' END AS predicted_sentiment
FROM scored s JOIN best b USING (chat_id, msg_seq)""",
        ("scored", "best"),
    ),
}


def trained(final: str, *needs: str) -> str:
    return statement(final, *needs, extra=TRAINING)


ORACLES |= {
    "run_modes": statement(
        """
SELECT chat_id, count(*) FILTER (NOT is_media AND NOT is_deleted) AS text_messages,
       CASE WHEN count(*) FILTER (NOT is_media AND NOT is_deleted) < 50 THEN 'NO_ML' ELSE 'FULL' END AS mode
FROM messages GROUP BY chat_id""",
        "messages",
    ),
    "training_sample": trained("SELECT * FROM sample", "sample"),
    "train_test_split": trained("SELECT * FROM split", "split"),
    "cross_validation_folds": trained("SELECT * FROM folds", "folds"),
    "model_vocabulary": trained(f"SELECT * REPLACE ({rnd('idf', 6)} AS idf, position::INT AS position) FROM vocab", "vocab"),
    "tfidf_features": trained(
        f"SELECT * REPLACE ({rnd('weight', 6)} AS weight) FROM weighted", "weighted"
    ),
    "naive_bayes_weights": trained(
        f"SELECT * REPLACE ({rnd('weight', 6)} AS weight) FROM bayes", "bayes"
    ),
    "class_priors": trained(f"SELECT * REPLACE ({rnd('bias', 6)} AS bias) FROM priors", "priors"),
    "naive_bayes_confusion": trained("SELECT * FROM confusion", "confusion"),
    "class_report": trained(
        f"SELECT * REPLACE ({rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall,"
        f" {rnd('f1', 6)} AS f1) FROM report",
        "report",
    ),
    "run_scores": trained(
        f"SELECT run, {rnd('accuracy', 6)} AS accuracy, {rnd('weighted_f1', 6)} AS weighted_f1 FROM run_scores",
        "run_scores",
    ),
    "cross_validation": trained(
        f"SELECT count(*) AS folds, {rnd('avg(weighted_f1)', 4)} AS cross_val_mean,"
        f" {rnd('stddev_pop(weighted_f1)', 4)} AS cross_val_std FROM run_scores WHERE run > 0",
        "run_scores",
    ),
    "predicted_messages": trained(
        "SELECT chat_id, msg_seq, predicted_sentiment FROM predicted", "predicted"
    ),
    "agreement": trained(
        f"""
SELECT chat_id, count(*) AS messages, count(*) FILTER (is_text AND cleaned_message <> '') AS scored_messages,
       {pct("count(*) FILTER (is_text AND cleaned_message <> '' AND sentiment_label = predicted_sentiment)",
            "nullif(count(*) FILTER (is_text AND cleaned_message <> ''), 0)")} AS agreement_scored_pct,
       {pct('count(*) FILTER (is_text AND sentiment_label = predicted_sentiment)', 'count(*)')} AS agreement_all_pct
FROM predicted GROUP BY chat_id""",
        "predicted",
    ),
    "feature_summary": statement(
        """
SELECT p.chat_id, t.total_words, t.unique_words, p.peak_hour, d.most_active_day, w.top_word, b.top_bigram,
       f.fastest_responder, f.fastest_resp_mins
FROM (SELECT chat_id, hour AS peak_hour FROM messages GROUP BY chat_id, hour
      QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC, hour) = 1) p
JOIN (SELECT chat_id, day_name AS most_active_day FROM messages GROUP BY chat_id, day_name
      QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count(*) DESC,
              any_value(isodow(datetime))) = 1) d USING (chat_id)
LEFT JOIN (SELECT chat_id, sum(count)::BIGINT AS total_words, count(*) AS unique_words
           FROM word_counts GROUP BY ALL) t USING (chat_id)
LEFT JOIN (SELECT chat_id, word AS top_word FROM word_counts
           QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, word) = 1) w USING (chat_id)
LEFT JOIN (SELECT chat_id, phrase AS top_bigram FROM bigrams
           QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY count DESC, phrase) = 1) b USING (chat_id)
LEFT JOIN (SELECT chat_id, sender AS fastest_responder, m AS fastest_resp_mins
           FROM (SELECT chat_id, sender, """
        + rnd("sum(gap)::DOUBLE / count(*) / 6e7", 2)
        + """ AS m FROM replies GROUP BY ALL)
           QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY m, sender) = 1) f USING (chat_id)""",
        "messages", "word_counts", "bigrams", "replies",
    ),
}


def wrapped(name: str, final: str) -> str:
    """A statement over the result of another one."""
    return f"WITH inner_result AS ({ORACLES[name]})\n{final}"


def feed(name: str, place: str) -> str:
    return wrapped(
        name,
        f"SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY messages DESC, {place}) = 1 AS is_peak"
        " FROM inner_result",
    )


ORACLES |= {
    "hourly_feed": feed("hourly_activity", "hour"),
    "weekday_feed": feed("weekday_activity", "position"),
    "sentiment_trend_feed": wrapped(
        "sentiment_weekly",
        "SELECT *, avg_score >= 0 AS is_positive FROM inner_result"
        " QUALIFY count(*) OVER (PARTITION BY chat_id) >= 2",
    ),
    "sender_split_feed": wrapped(
        "sentiment_by_sender",
        "SELECT chat_id, sender, positive_pct, neutral_pct, negative_pct FROM inner_result",
    ),
    "sentiment_split_feed": (
        f"WITH split AS ({ORACLES['label_distribution']}), mood AS ({ORACLES['overall_mood']})\n"
        "SELECT split.*, mood_description, overall_score FROM split JOIN mood USING (chat_id) WHERE messages > 0"
    ),
    "detailed_results": (
        f"WITH a AS ({ORACLES['sender_stats']}), b AS ({ORACLES['reply_times']}),"
        f" c AS ({ORACLES['sentiment_by_sender']}), d AS ({ORACLES['sender_keywords']})\n"
        'SELECT a.*, b.* EXCLUDE (chat_id, sender), c.* EXCLUDE (chat_id, sender, total), d.keywords FROM a'
        " LEFT JOIN b USING (chat_id, sender) LEFT JOIN c USING (chat_id, sender)"
        " LEFT JOIN (SELECT chat_id, sender, string_agg(term, ', ' ORDER BY rank) AS keywords FROM d GROUP BY ALL) d"
        " USING (chat_id, sender)"
    ),
    "live_scores": trained(
        f"""
, texts AS (SELECT chat_id, msg_seq, regexp_replace(message, '^[{WS}]+|[{WS}]+$', '', 'g') AS t FROM chat_messages),
checked AS (SELECT chat_id, msg_seq, CASE WHEN t = '' THEN 'Text is empty.' END AS error FROM texts),
unskipped AS (
  SELECT chat_id, msg_seq, unnest(ws) AS word, generate_subscripts(ws, 1) AS idx
  FROM (SELECT chat_id, msg_seq, string_split(trim(regexp_replace(regexp_replace(regexp_replace(
               lower(message), '{URL}', '', 'g'), '{EMOJI}', '', 'g'), '[^a-z]+', ' ', 'g')), ' ') AS ws
        FROM messages)),
live_words AS (
  SELECT chat_id, msg_seq, w AS word, row_number() OVER (PARTITION BY chat_id, msg_seq ORDER BY idx) AS pos
  FROM (SELECT u.chat_id, u.msg_seq, u.idx, coalesce(l.lemma, u.word) AS w
        FROM unskipped u LEFT JOIN lemmas l ON u.word = l.word
        WHERE u.word NOT IN (SELECT word FROM stopwords)) WHERE length(w) > 2),
live_grams AS (
  SELECT chat_id, msg_seq, term, count(*) AS n FROM (
    SELECT chat_id, msg_seq, word AS term FROM live_words
    UNION ALL
    SELECT chat_id, msg_seq, word || ' ' || lead(word) OVER (PARTITION BY chat_id, msg_seq ORDER BY pos)
    FROM live_words) WHERE term IS NOT NULL GROUP BY ALL),
live_known AS (
  SELECT chat_id, msg_seq, label, sum((1 + ln(n)) * idf * b.weight) / sqrt(sum(((1 + ln(n)) * idf) ^ 2)) AS e
  FROM live_grams g JOIN vocab v ON v.run = 0 AND v.term = g.term JOIN bayes b ON b.run = 0 AND b.term = g.term
  GROUP BY ALL),
live_scores AS (
  SELECT c.chat_id, c.msg_seq, c.error, p.label, p.bias + coalesce(k.e, 0) AS s
  FROM checked c CROSS JOIN (SELECT * FROM priors WHERE run = 0) p
  LEFT JOIN live_known k ON k.chat_id = c.chat_id AND k.msg_seq = c.msg_seq AND k.label = p.label),
soft AS (
  SELECT *, row_number() OVER (PARTITION BY chat_id, msg_seq ORDER BY s DESC, label) AS place,
         max(s) OVER w AS top
  FROM live_scores WINDOW w AS (PARTITION BY chat_id, msg_seq)),
shares AS (
  SELECT chat_id, msg_seq, error, label, place,
         exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY chat_id, msg_seq) AS p FROM soft)
SELECT chat_id, msg_seq, error,
       CASE WHEN error IS NULL THEN max(label) FILTER (place = 1) END AS label,
       CASE WHEN error IS NULL THEN {rnd('max(p)', 4)} END AS confidence,
       CASE WHEN error IS NULL THEN coalesce({rnd("max(p) FILTER (label = 'Positive')", 4)}, 0.0) END AS prob_positive,
       CASE WHEN error IS NULL THEN coalesce({rnd("max(p) FILTER (label = 'Neutral')", 4)}, 0.0) END AS prob_neutral,
       CASE WHEN error IS NULL THEN coalesce({rnd("max(p) FILTER (label = 'Negative')", 4)}, 0.0) END AS prob_negative
FROM shares GROUP BY chat_id, msg_seq, error""",
        "chat_messages", "messages", "lemmas", "stopwords", "vocab", "bayes", "priors",
    ),
}


def section(name: str, title: str, columns: dict[str, str], prefix: str = "''") -> str:
    """Columns of a statement as rows; fractions in plain notation, four decimals."""
    rows = " UNION ALL ".join(
        f"SELECT chat_id, '{title}' AS section, {prefix} || '{c}' AS key, "
        + (f"({c})::DECIMAL(18,4)::VARCHAR" if kind == "double" else f'"{c}"::VARCHAR')
        + " AS value FROM inner_result"
        for c, kind in columns.items()
    )
    return f"SELECT * FROM (WITH inner_result AS ({ORACLES[name]}) {rows})"


def kinds(text: str, fractions: str = "") -> dict[str, str]:
    return {c: "text" for c in text.split()} | {c: "double" for c in fractions.split()}


ORACLES["written_report"] = "\nUNION ALL\n".join(
    [
        section(
            "chat_summary", "chat_summary",
            kinds(
                "total_messages total_text_msgs total_media_msgs total_deleted total_senders date_start"
                " date_end total_days total_words most_active_user",
                "avg_words_per_msg",
            ),
        ),
        section(
            "overall_mood", "overall_sentiment",
            kinds(
                "overall_label most_positive_user most_negative_user happiest_day mood_description"
                " total_analysed high_confidence",
                "overall_score positive_pct negative_pct neutral_pct",
            ),
        ),
        section(
            "sentiment_by_sender", "sentiment_by_sender",
            kinds("Positive Negative Neutral total", "positive_pct negative_pct neutral_pct avg_score"),
            "sender || '.'",
        ),
        section(
            "feature_summary", "feature_summary",
            kinds(
                "total_words unique_words peak_hour most_active_day top_word top_bigram fastest_responder",
                "fastest_resp_mins",
            ),
        ),
    ]
)


ORACLES["report_lines"] = wrapped(
    "written_report",
    """
SELECT section, CASE WHEN length(chat_id) < 20 THEN rpad(chat_id, 20, ' ') ELSE chat_id END || '  '
       || CASE WHEN length(key) < 35 THEN rpad(key, 35, ' ') ELSE key END || ': ' || coalesce(value, '–') AS value
FROM inner_result""",
)

ORACLES |= {
    "senders_by_volume": wrapped("sender_stats", "SELECT chat_id, sender, total_messages FROM inner_result"),
    "senders_by_mood": wrapped("sentiment_by_sender", "SELECT chat_id, sender, avg_score FROM inner_result"),
    "saved_model": trained(
        f"""
SELECT b.term, b.label, {rnd('v.idf', 6)} AS idf, {rnd('b.weight', 6)} AS weight
FROM bayes b JOIN vocab v ON v.run = b.run AND v.term = b.term WHERE b.run = 0""",
        "bayes", "vocab",
    ),
    # At the optimum the penalised gradient vanishes; rows and terms are those of each run.
    "regression_certificate": trained(
        """
SELECT run, (SELECT count(*) FROM runs r WHERE r.run = v.run AND part = 'train') AS rows,
       count(*) + 1 AS terms, true AS optimal
FROM vocab v GROUP BY run""",
        "runs", "vocab",
    ),
    "live_stream": ORACLES["live_scores"],
    "trend_stream": wrapped("sentiment_weekly", "SELECT chat_id, date, avg_score, message_count FROM inner_result"),
    "late_stream": wrapped("sentiment_weekly", "SELECT chat_id, date, message_count AS messages FROM inner_result"),
}


# --- the dashboard's documents, written out by hand -----------------------------------------


def document(*fields: tuple[str, str]) -> str:
    """A JSON object; every field is a name and how its value is written."""
    parts = [f"'{',' if n else ''}\"{name}\":' || {value}" for n, (name, value) in enumerate(fields)]
    return "'{' || " + " || ".join(parts) + " || '}'"


def whole(name: str) -> tuple[str, str]:
    return name, f"{name}::VARCHAR"


def fraction(name: str) -> tuple[str, str]:
    return name, f"{name}::DECIMAL(18,4)::VARCHAR"


def words(name: str) -> tuple[str, str]:
    return name, f"to_json({name})::VARCHAR"


def one(section: str, name: str, order: str, *fields: tuple[str, str]) -> str:
    return (
        f"SELECT chat_id, '{section}' AS section, '' AS key, '[' || string_agg({document(*fields)}, ',' ORDER BY {order}) || ']'"
        f" AS payload FROM ({ORACLES[name]}) GROUP BY chat_id"
    )


def each(section: str, name: str, key: str, *fields: tuple[str, str]) -> str:
    return f"SELECT chat_id, '{section}', {key}::VARCHAR, {document(*fields)} FROM ({ORACLES[name]})"


KEYWORDS = (
    "SELECT chat_id, 'tfidf', sender, '{\"terms\":' || to_json(list(term ORDER BY rank))::VARCHAR || '}'"
    f" FROM ({ORACLES['sender_keywords']}) GROUP BY chat_id, sender"
)
ORACLES["dashboard"] = "\nUNION ALL\n".join([
    one("hourly", "hourly_activity", "hour", whole("hour"), whole("messages")),
    one("daily", "weekday_activity", "position", whole("position"), words("day_name"), whole("messages")),
    one("monthly", "monthly_activity", "month", whole("month"), words("month_name"), whole("messages")),
    one("top_words", "top_words", "rank", whole("rank"), words("word"), whole("count")),
    one("bigrams", "top_bigrams", "rank", whole("rank"), words("phrase"), whole("count")),
    one("emojis", "top_emojis", "rank", whole("rank"), words("emoji"), whole("count")),
    one("sentiment_dist", "label_distribution", "label", words("label"), fraction("share_pct")),
    KEYWORDS,
    each("response_times", "reply_times", "sender", fraction("avg_minutes"), fraction("avg_seconds")),
    each("user_msgs", "participation", "sender", whole("messages"), fraction("share_pct")),
    each(
        "monthly_by_sender", "monthly_volume_by_sender", "sender",
        whole("month"), words("month_name"), whole("messages"),
    ),
    each(
        "sentiment_by_sender", "sentiment_by_sender", "sender",
        fraction("positive_pct"), fraction("neutral_pct"), fraction("negative_pct"), fraction("avg_score"),
    ),
    each("sentiment_trend", "sentiment_weekly", "date", fraction("avg_score"), whole("message_count")),
])

FEEDS = {
    "word_cloud": "word_weights", "top_words": "top_words", "hourly_activity": "hourly_feed",
    "weekday_activity": "weekday_feed", "monthly_activity": "monthly_activity", "participation": "participation",
    "top_bigrams": "top_bigrams", "sentiment_split": "sentiment_split_feed", "sentiment_trend": "sentiment_trend_feed",
    "sentiment_by_sender": "sender_split_feed",
}
ORACLES["feed_ledger"] = "\nUNION ALL\n".join(
    [f"SELECT '{feed}' AS feed, 'ok' AS status, count(*) AS rows FROM ({ORACLES[name]})" for feed, name in FEEDS.items()]
    + ["SELECT 'broken', 'failed', NULL"]
)
