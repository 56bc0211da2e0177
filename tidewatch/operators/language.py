"""Tokens, n-grams, phrase sentiment and rule vocabularies of posts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import text

# Words left out of token lists, and words never left out.
STOPWORDS = [
    "the", "and", "for", "with", "from", "this", "that", "have", "has", "had", "are", "was", "were", "you", "your", "they",
    "them", "our", "but", "can", "just", "about", "into", "like", "what", "when", "where", "there", "here", "would", "could",
    "should",
]
PROTECTED = [
    "not", "no", "never", "too", "very", "really", "so", "barely", "hardly", "without", "against", "love", "hate", "bad",
    "good", "great", "terrible", "amazing", "disappointed", "worth", "overrated", "underrated", "dupe", "return", "refund",
    "broken",
]
# Phrases whose presence is counted, by what they signal.
PHRASES = {
    "positive": ["love", "amazing", "great", "holy grail", "worth it", "recommend", "repurchase"],
    "negative": [
        "hate", "bad", "terrible", "broke", "broken", "disappointed", "overpriced", "scam", "regret", "waste of money",
    ],
    "purchase_intent": ["buy", "bought", "ordered", "worth it", "recommend", "dupe", "alternative"],
    "complaint": ["returned", "refund", "broke", "doesn't work", "does not work", "waste of money"],
    "comparison": ["better than", " vs ", "compared to", "alternative to", "dupe for"],
    "viral": ["viral", "trending", "tiktok made me buy it", "everyone is talking about"],
}


def without_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(STOPWORDS) | t.isin(PROTECTED))


def token_lists(df: DataFrame, token_text: Column) -> DataFrame:
    """Tokens and lemmas (the tokens themselves without a tagger), both also without stop words, noun phrases (bigrams of
    four letters and more, 40 at most, of which 80 would be kept), bigrams and trigrams (120 each at most)."""
    with_tokens = df.withColumn("tokens", text.words(token_text))
    kept = with_tokens.withColumn("tokens_no_stopwords", without_stopwords(F.col("tokens")))
    phrases = F.slice(F.filter(text.grams(F.col("tokens"), 2), lambda g: F.length(g) > 3), 1, 40)
    return kept.withColumns(
        {
            "lemmas": F.col("tokens"),
            "lemmas_no_stopwords": F.col("tokens_no_stopwords"),
            "noun_phrases": phrases,
            "bigrams": F.slice(text.grams(F.col("tokens_no_stopwords"), 2), 1, 120),
            "trigrams": F.slice(text.grams(F.col("tokens_no_stopwords"), 3), 1, 120),
        }
    )


def phrase_hits(low: Column, phrases: list[str]) -> Column:
    """The phrases that occur anywhere in lower-case text, also within words."""
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), F.lit(p)) for p in phrases]))


def sentiment(df: DataFrame, body: Column) -> DataFrame:
    """Compound score, shares, label, a counter per signal and all matched phrases, sorted. Null text counts as empty."""
    low = F.lower(F.coalesce(body, F.lit("")))
    hits = df.withColumns({f"_{k}": phrase_hits(low, v) for k, v in PHRASES.items()})
    pos, neg = F.size("_positive").cast("double"), F.size("_negative").cast("double")
    compound = (pos - neg) / F.greatest(pos + neg, F.lit(1.0))
    out = hits.withColumns(
        {
            "sentiment_compound": compound,
            "sentiment_pos": pos,
            "sentiment_neg": neg,
            "sentiment_neu": F.when((pos == 0) & (neg == 0), 1.0).otherwise(0.0),
            "sentiment_label": F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral"),
            "positive_word_count": F.size("_positive"),
            "negative_word_count": F.size("_negative"),
            **{f"{k}_count": F.size(f"_{k}") for k in ("purchase_intent", "complaint", "comparison")},
            "viral_signal_count": F.size("_viral"),
            "matched_sentiment_phrases": F.array_sort(F.array_distinct(F.concat(*[f"_{k}" for k in PHRASES]))),
        }
    )
    return out.drop(*[f"_{k}" for k in PHRASES])
