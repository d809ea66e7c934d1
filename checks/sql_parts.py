"""Building blocks of the DuckDB statements the Spark results are compared with.

The statements are written independently of the Spark plans: tokens are unnested,
joined with the word lists and aggregated, windows give the neighbours.  Only the
word lists come from the same seed.
"""

from __future__ import annotations

from chatframe.functions import lexicon as lx
from chatframe.functions import text as tx
from chatframe.functions.lists import WordLists
from chatframe.sources.tables import CENTURY, CHAT_MESSAGES, MINUTES

LISTS = WordLists()

WS = (
    r"\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
EMOJI = r"[\x{200d}\x{231a}\x{23cf}\x{23e9}\x{24c2}-\x{10ffff}]+"
URL = rf"https?://[^{WS}]+|www\.[^{WS}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(quoted(w) for w in sorted(words))


def values(rows) -> str:
    def cell(v):
        return quoted(v) if isinstance(v, str) else f"{v!r}::DOUBLE"

    return "VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows)


def rnd(expr: str, digits: int) -> str:
    return f"(round_even(({expr}) * 1e{digits}, 0) / 1e{digits})"


def any_contains(phrases) -> str:
    return "(" + " OR ".join(f"contains(lower(message), {quoted(p)})" for p in phrases) + ")"


def label(expr: str) -> str:
    return (
        f"CASE WHEN {expr} >= 0.05 THEN 'Positive' WHEN {expr} <= -0.05 THEN 'Negative'"
        " ELSE 'Neutral' END"
    )


def duck_messages() -> str:
    """The Spark view text with the two expressions that differ."""
    sql = MINUTES.sub(
        lambda m: f"TIMESTAMP '{m[1]} 00:00:00' + to_minutes((({m[2]}) % {CENTURY})::BIGINT)", CHAT_MESSAGES
    )
    return sql.replace(":wall_clock(ts)", "ts::TIMESTAMP")


def _step(v: str, d: int) -> str:
    """Valence after looking at the word ``d`` places before."""
    prev = f"p{d}"
    never = {
        1: "",
        2: f"WHEN {prev} = 'never' AND p1 IN ('so', 'this') THEN 1.5",
        3: f"WHEN {prev} = 'never' AND (p1 IN ('so', 'this') OR p2 IN ('so', 'this')) THEN 1.25",
    }[d]
    weight = lx.DISTANCE_WEIGHT[d - 1]
    return f"""
      CASE WHEN {prev} IS NULL OR {prev} IN (SELECT token FROM valence) THEN {v}
           ELSE ({v} + {weight}::DOUBLE * CASE WHEN b{d}.delta IS NULL THEN 0.0::DOUBLE ELSE
                  CASE WHEN {v} < 0 THEN -b{d}.delta ELSE b{d}.delta END
                  + CASE WHEN mixed AND u{d} THEN
                         CASE WHEN {v} > 0 THEN 0.733::DOUBLE ELSE -0.733::DOUBLE END
                         ELSE 0.0::DOUBLE END END)
                * CASE {never}
                       WHEN {prev} IN ({listed(LISTS.negations)}) OR contains({prev}, 'n''t')
                       THEN -0.74 ELSE 1.0 END::DOUBLE END"""


PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "chat_messages": (duck_messages(), ()),
    "messages": (
        f"""
SELECT chat_id, msg_seq, datetime, CAST(datetime AS DATE) AS date,
       strftime(datetime, '%H:%M:%S') AS "time",
       CAST(year(datetime) AS INT) AS year, CAST(month(datetime) AS INT) AS month,
       monthname(datetime) AS month_name, CAST(day(datetime) AS INT) AS day,
       dayname(datetime) AS day_name, CAST(hour(datetime) AS INT) AS hour, sender, message,
       {any_contains(tx.MEDIA_PHRASES)} AS is_media,
       {any_contains(tx.DELETED_PHRASES)} AS is_deleted,
       CASE WHEN {any_contains(tx.MEDIA_PHRASES)} THEN 0
            ELSE len(regexp_extract_all(message, '[^{WS}]+')) END::INT AS word_count,
       CASE WHEN {any_contains(tx.MEDIA_PHRASES)} THEN 0 ELSE length(message) END::INT
         AS char_count
FROM chat_messages""",
        ("chat_messages",),
    ),
    "flagged": (
        f"""
SELECT *, lower(regexp_replace(message, '^[{WS}]+|[{WS}]+$', '', 'g')) IN ({listed(tx.SKIPPED_MESSAGES)})
          OR length(replace(lower(regexp_replace(message, '^[{WS}]+|[{WS}]+$', '', 'g')), ' ', '')) <= 2
          AS skippable
FROM messages""",
        ("messages",),
    ),
    "stopwords": ("SELECT * FROM (" + values([(w,) for w in sorted(LISTS.stopwords)]) + ") t(word)", ()),
    "lemmas": (
        "SELECT * FROM (" + values(sorted(LISTS.lemmas.items())) + ") t(word, lemma)", ()
    ),
    "split_words": (
        f"""
SELECT chat_id, msg_seq, unnest(ws) AS word, generate_subscripts(ws, 1) AS idx
FROM (SELECT chat_id, msg_seq, string_split(trim(regexp_replace(regexp_replace(regexp_replace(
             lower(message), '{URL}', '', 'g'), '{EMOJI}', '', 'g'), '[^a-z]+', ' ', 'g')), ' ') AS ws
      FROM flagged WHERE NOT skippable)""",
        ("flagged",),
    ),
    "terms": (
        """
SELECT chat_id, msg_seq, w AS word, row_number() OVER (PARTITION BY chat_id, msg_seq ORDER BY idx) AS pos
FROM (SELECT s.chat_id, s.msg_seq, s.idx, coalesce(l.lemma, s.word) AS w
      FROM split_words s LEFT JOIN lemmas l ON s.word = l.word
      WHERE s.word NOT IN (SELECT word FROM stopwords))
WHERE length(w) > 2""",
        ("split_words", "stopwords", "lemmas"),
    ),
    "cleaned": (
        """
SELECT chat_id, msg_seq, string_agg(word, ' ' ORDER BY pos) AS cleaned_message, count(*) AS n_words
FROM terms GROUP BY ALL""",
        ("terms",),
    ),
    "enriched": (
        f"""
SELECT f.*, CASE WHEN skippable THEN [] ELSE regexp_extract_all(message, '{EMOJI}') END AS emoji_list,
       CASE WHEN skippable THEN 0 ELSE len(regexp_extract_all(message, '{EMOJI}')) END::INT AS emoji_count,
       NOT skippable AND regexp_matches(message, '(?i){URL}') AS has_url,
       coalesce(c.cleaned_message, '') AS cleaned_message, coalesce(c.n_words, 0) AS n_words,
       NOT is_media AND NOT is_deleted AS is_text
FROM flagged f LEFT JOIN cleaned c USING (chat_id, msg_seq)""",
        ("flagged", "cleaned"),
    ),
    "valence": (
        "SELECT * FROM (" + values(sorted(LISTS.scoring_valence().items())) + ") t(token, valence)", ()
    ),
    "boosters": (
        "SELECT * FROM (" + values(sorted(LISTS.boosters.items())) + ") t(token, delta)", ()
    ),
    "idioms": ("SELECT * FROM (" + values(sorted(LISTS.idioms.items())) + ") t(phrase, valence)", ()),
    "rule_tokens": (
        f"""
SELECT chat_id, msg_seq, tok, lower(tok) AS low,
       upper(tok) = tok AND lower(tok) <> tok AS shouted,
       row_number() OVER (PARTITION BY chat_id, msg_seq ORDER BY idx) AS pos
FROM (SELECT chat_id, msg_seq, idx,
             CASE WHEN length(trim(w, {quoted(lx.PUNCTUATION)})) > 1
                  THEN trim(w, {quoted(lx.PUNCTUATION)}) ELSE w END AS tok
      FROM (SELECT chat_id, msg_seq, unnest(ws) AS w, generate_subscripts(ws, 1) AS idx
            FROM (SELECT chat_id, msg_seq, string_split_regex(message, '[{WS}]+') AS ws
                  FROM messages WHERE NOT is_media AND NOT is_deleted))
      WHERE length(w) > 1)""",
        ("messages",),
    ),
    "token_totals": (
        """
SELECT chat_id, msg_seq, count(*) AS n_tokens,
       bool_or(shouted) AND NOT bool_and(shouted) AS mixed,
       min(pos) FILTER (low = 'but') AS but_at
FROM rule_tokens GROUP BY ALL""",
        ("rule_tokens",),
    ),
    "neighbours": (
        """
SELECT chat_id, msg_seq, pos, low, shouted,
       lag(low, 1) OVER w AS p1, lag(low, 2) OVER w AS p2, lag(low, 3) OVER w AS p3,
       lag(shouted, 1) OVER w AS u1, lag(shouted, 2) OVER w AS u2, lag(shouted, 3) OVER w AS u3,
       lead(low, 1) OVER w AS n1, lead(low, 2) OVER w AS n2
FROM rule_tokens WINDOW w AS (PARTITION BY chat_id, msg_seq ORDER BY pos)""",
        ("rule_tokens",),
    ),
    "hits": (
        f"""
WITH base AS (
  SELECT n.*, t.mixed, t.but_at,
         v.valence + CASE WHEN t.mixed AND n.shouted THEN sign(v.valence) * 0.733::DOUBLE
                          ELSE 0.0::DOUBLE END AS v0
  FROM neighbours n JOIN valence v ON n.low = v.token
  JOIN token_totals t USING (chat_id, msg_seq)),
one AS (SELECT base.*, {_step('v0', 1)} AS v1 FROM base LEFT JOIN boosters b1 ON p1 = b1.token),
two AS (SELECT one.*, {_step('v1', 2)} AS v2 FROM one LEFT JOIN boosters b2 ON p2 = b2.token),
three AS (SELECT two.*, {_step('v2', 3)} AS v3 FROM two LEFT JOIN boosters b3 ON p3 = b3.token),
-- idioms and weakening phrases look at whole runs of words around the scored one
phrased AS (
  SELECT three.*, p3 IS NOT NULL AND p3 NOT IN (SELECT token FROM valence) AS looks,
         p3 || ' ' || p2 AS q32, p3 || ' ' || p2 || ' ' || p1 AS q321, p2 || ' ' || p1 AS q21,
         p2 || ' ' || p1 || ' ' || low AS q210, p1 || ' ' || low AS q10, low || ' ' || n1 AS q01,
         low || ' ' || n1 || ' ' || n2 AS q012
  FROM three),
idiomatic AS (
  SELECT phrased.* EXCLUDE (v3),
         coalesce(i012.valence, i01.valence, i10.valence, i210.valence, i21.valence, i321.valence, i32.valence, v3)
         + coalesce(least(w32.delta, w21.delta), 0.0::DOUBLE) AS v3
  FROM phrased
  LEFT JOIN idioms i012 ON looks AND q012 = i012.phrase LEFT JOIN idioms i01 ON looks AND q01 = i01.phrase
  LEFT JOIN idioms i10 ON looks AND q10 = i10.phrase LEFT JOIN idioms i210 ON looks AND q210 = i210.phrase
  LEFT JOIN idioms i21 ON looks AND q21 = i21.phrase LEFT JOIN idioms i321 ON looks AND q321 = i321.phrase
  LEFT JOIN idioms i32 ON looks AND q32 = i32.phrase
  LEFT JOIN boosters w32 ON looks AND q32 = w32.token LEFT JOIN boosters w21 ON looks AND q21 = w21.token)
SELECT chat_id, msg_seq, pos,
       v3 * CASE WHEN p1 = 'least' AND coalesce(p2 NOT IN ('at', 'very'), true) THEN -0.74 ELSE 1.0 END::DOUBLE
          * CASE WHEN low = 'kind' AND n1 = 'of' THEN 0.0 ELSE 1.0 END::DOUBLE
          * CASE WHEN pos < but_at THEN 0.5 WHEN pos > but_at THEN 1.5 ELSE 1.0 END::DOUBLE AS v
FROM idiomatic""",
        ("neighbours", "valence", "boosters", "idioms", "token_totals"),
    ),
    "rule_scores": (
        f"""
WITH sums AS (
  SELECT m.chat_id, m.msg_seq, any_value(t.n_tokens) AS n_tokens, any_value(m.message) AS message,
         coalesce(sum(h.v ORDER BY h.pos), 0.0::DOUBLE) AS total,
         coalesce(sum(CASE WHEN h.v > 0 THEN h.v + 1 END ORDER BY h.pos), 0.0::DOUBLE) AS plus,
         coalesce(sum(CASE WHEN h.v < 0 THEN 1 - h.v END ORDER BY h.pos), 0.0::DOUBLE) AS minus,
         coalesce(any_value(t.n_tokens), 0) - count(*) FILTER (h.v <> 0) AS plain
  FROM messages m LEFT JOIN token_totals t USING (chat_id, msg_seq)
  LEFT JOIN hits h USING (chat_id, msg_seq)
  WHERE NOT m.is_media AND NOT m.is_deleted
  GROUP BY m.chat_id, m.msg_seq),
marks AS (
  SELECT *, length(message) - length(replace(message, '!', '')) AS excl,
         length(message) - length(replace(message, '?', '')) AS quest FROM sums),
emph AS (
  SELECT *, least(excl, 4) * 0.292::DOUBLE
            + CASE WHEN quest > 3 THEN 0.96 WHEN quest > 1 THEN quest * 0.18 ELSE 0.0 END::DOUBLE AS e
  FROM marks),
moved AS (
  SELECT chat_id, msg_seq, n_tokens, message, plain, total + sign(total) * e AS total,
         plus + CASE WHEN plus > minus THEN e ELSE 0.0::DOUBLE END AS plus,
         minus + CASE WHEN plus < minus THEN e ELSE 0.0::DOUBLE END AS minus
  FROM emph)
SELECT chat_id, msg_seq, {rnd('total / sqrt(total * total + 15.0::DOUBLE)', 4)} AS compound,
       CASE WHEN n_tokens > 0 THEN {rnd('plus / (plus + minus + plain)', 3)} ELSE 0.0 END::DOUBLE AS pos,
       CASE WHEN n_tokens > 0 THEN {rnd('minus / (plus + minus + plain)', 3)} ELSE 0.0 END::DOUBLE AS neg,
       CASE WHEN n_tokens > 0 THEN {rnd('plain / (plus + minus + plain)', 3)} ELSE 0.0 END::DOUBLE AS neu
FROM moved WHERE regexp_matches(message, '[^{WS}]')""",
        ("messages", "token_totals", "hits"),
    ),
    "subjectivity": (
        "SELECT * FROM ("
        + values([(w, *v) for w, v in sorted(LISTS.subjectivity.items())])
        + ") t(word, polarity, subjectivity, intensity)",
        (),
    ),
    "subjective": (
        f"""
WITH near AS (
  SELECT t.*, lag(t.word, 1) OVER w AS p1, lag(t.word, 2) OVER w AS p2, lead(t.word, 1) OVER w AS n1
  FROM terms t JOIN messages m USING (chat_id, msg_seq)
  WHERE NOT m.is_media AND NOT m.is_deleted
  WINDOW w AS (PARTITION BY t.chat_id, t.msg_seq ORDER BY t.pos)),
rated AS (
  SELECT n.chat_id, n.msg_seq, n.pos,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s.polarity * coalesce(i.intensity, 1.0::DOUBLE)))
         * CASE WHEN n.p1 IN ('no', 'not', 'never')
                  OR (i.word IS NOT NULL AND n.p2 IN ('no', 'not', 'never')) THEN -0.5 ELSE 1.0 END::DOUBLE AS pol,
         greatest(-1.0::DOUBLE, least(1.0::DOUBLE, s.subjectivity * coalesce(i.intensity, 1.0::DOUBLE))) AS sub
  FROM near n JOIN subjectivity s ON n.word = s.word
  LEFT JOIN (SELECT * FROM subjectivity WHERE intensity <> 1) i ON n.p1 = i.word
  WHERE NOT (s.intensity <> 1 AND coalesce(n.n1 IN (SELECT word FROM subjectivity), false)))
SELECT chat_id, msg_seq, {rnd('sum(pol ORDER BY pos) / count(*)', 4)} AS polarity,
       {rnd('sum(sub ORDER BY pos) / count(*)', 4)} AS subjectivity
FROM rated GROUP BY ALL""",
        ("terms", "messages", "subjectivity"),
    ),
    "scored": (
        f"""
SELECT *, CASE WHEN is_text THEN {label('sentiment_score')} ELSE 'Neutral' END AS sentiment_label,
       CASE WHEN NOT is_text THEN 'Low'
            WHEN abs(sentiment_score) >= 0.35 AND sign(sentiment_score)
                 = CASE WHEN polarity > 0.05 THEN 1 WHEN polarity < -0.05 THEN -1 ELSE 0 END THEN 'High'
            WHEN abs(sentiment_score) >= 0.15 THEN 'Medium' ELSE 'Low' END AS sentiment_confidence
FROM (SELECT e.*, coalesce(r.compound, 0.0) AS sentiment_score, coalesce(s.polarity, 0.0) AS polarity,
             coalesce(s.subjectivity, 0.0) AS subjectivity, coalesce(r.pos, 0.0) AS vader_pos,
             coalesce(r.neg, 0.0) AS vader_neg, coalesce(r.neu, 1.0) AS vader_neu
      FROM enriched e LEFT JOIN rule_scores r USING (chat_id, msg_seq)
      LEFT JOIN subjective s USING (chat_id, msg_seq))""",
        ("enriched", "rule_scores", "subjective"),
    ),
    "text_scored": ("SELECT * FROM scored WHERE is_text", ("scored",)),
    "word_counts": (
        "SELECT chat_id, word, count(*) AS count FROM terms GROUP BY ALL", ("terms",)
    ),
    "bigrams": (
        """
SELECT chat_id, phrase, count(*) AS count
FROM (SELECT chat_id, word || ' ' || lead(word, 1) OVER (PARTITION BY chat_id, msg_seq ORDER BY pos) AS phrase
      FROM terms) WHERE phrase IS NOT NULL GROUP BY ALL""",
        ("terms",),
    ),
    "trigrams": (
        """
SELECT chat_id, phrase, count(*) AS count
FROM (SELECT chat_id, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w AS phrase
      FROM terms WINDOW w AS (PARTITION BY chat_id, msg_seq ORDER BY pos))
WHERE phrase IS NOT NULL GROUP BY ALL""",
        ("terms",),
    ),
    "emojis": (
        "SELECT chat_id, emoji, count(*) AS count FROM (SELECT chat_id, unnest(emoji_list) AS emoji"
        " FROM enriched) GROUP BY ALL",
        ("enriched",),
    ),
    "replies": (
        """
SELECT chat_id, msg_seq, sender, previous_sender, gap, gap / 1e6::DOUBLE AS gap_seconds
FROM (SELECT chat_id, msg_seq, sender, lag(sender) OVER w AS previous_sender,
             epoch_us(datetime) - lag(epoch_us(datetime)) OVER w AS gap
      FROM messages WINDOW w AS (PARTITION BY chat_id ORDER BY datetime, msg_seq))
WHERE sender <> previous_sender AND gap > 0 AND gap <= 43200000000""",
        ("messages",),
    ),
}


def statement(final: str, *needs: str, extra: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> str:
    """``WITH`` the parts that ``needs`` reach, in order, followed by ``final``."""
    parts = PARTS | (extra or {})
    ordered: list[str] = []

    def add(name: str) -> None:
        if name in ordered:
            return
        for dep in parts[name][1]:
            add(dep)
        ordered.append(name)

    for name in needs:
        add(name)
    ctes = ",\n".join(f"{name} AS ({parts[name][0]})" for name in ordered)
    return f"WITH {ctes}\n{final}"
