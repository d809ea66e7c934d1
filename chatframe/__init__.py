"""Analytics over chat transcripts, as Spark DataFrame functions keyed by chat."""

from chatframe.functions.lists import WordLists
from chatframe.operators.activity import reply_gaps, reply_times
from chatframe.operators.enrich import enrich, message_table, score
from chatframe.operators.mood import overall_mood, sentiment_by_sender, sentiment_over_time
from chatframe.operators.scoring import check_texts, predict_messages, predict_texts
from chatframe.operators.stats import chat_summary, processing_stats, sender_stats
from chatframe.operators.terms import (
    sender_keywords, top_bigrams, top_emojis, top_trigrams, top_words,
)
from chatframe.operators.training import (
    ClassifierResult, SentimentModel, train_classifier, training_sample,
)
from chatframe.plans.analysis import Analysis, Features, analyze, feature_summary, features
from chatframe.plans.outputs import (
    chart_feeds, dashboard, detailed_results, report, save_dashboard, save_report,
)
from chatframe.sources.exports import parse_chats, parse_lines, parse_texts
from chatframe.sources.models import load_model, model_exists, model_metadata, save_model

__all__ = [
    "Analysis", "ClassifierResult", "Features", "SentimentModel", "WordLists", "analyze",
    "chart_feeds", "chat_summary", "check_texts", "dashboard", "detailed_results", "enrich",
    "feature_summary", "features", "load_model", "message_table", "model_exists",
    "model_metadata", "overall_mood", "parse_chats", "parse_lines", "parse_texts",
    "predict_messages", "predict_texts", "processing_stats", "reply_gaps", "reply_times",
    "report", "save_dashboard", "save_model", "save_report", "score", "sender_keywords",
    "sender_stats", "sentiment_by_sender", "sentiment_over_time", "top_bigrams", "top_emojis",
    "top_trigrams", "top_words", "train_classifier", "training_sample",
]
