"""How much an answer can be trusted by its own words: alignment with its context, length, coherence and certainty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content, phrases of doubt, words that connect sentences.
STOPWORDS = (
    "the", "and", "for", "are", "was", "were", "this", "that", "with", "from", "have", "has", "had", "not", "but", "you", "your",
    "và", "là", "có", "của", "được", "cho", "này", "đó", "các", "một", "những", "với", "để", "trong", "khi", "sẽ", "đã", "không", "nếu",
    "thì", "nên", "vì", "như", "về", "tại", "đến", "từ", "còn", "ra", "đi", "lên", "xuống", "rồi", "hay", "hoặc", "mà", "nữa", "cũng",
)
DOUBT = (
    "i think", "i believe", "possibly", "maybe", "perhaps", "might be", "could be", "seems like", "appears to", "not sure", "uncertain",
    "unclear", "unknown", "i don't know", "i'm not certain", "it depends", "to the best of my knowledge", "as far as i know",
    "có lẽ", "hình như", "dường như", "không chắc", "không rõ", "chưa rõ", "không biết", "tôi nghĩ", "theo tôi",
)
CONNECTORS = (
    "however", "therefore", "furthermore", "additionally", "moreover", "consequently", "thus", "hence", "also", "first", "second", "third",
    "finally", "in conclusion", "tuy nhiên", "do đó", "vì vậy", "vì thế", "ngoài ra", "hơn nữa", "bên cạnh đó", "đầu tiên", "thứ hai",
    "thứ ba", "cuối cùng", "tóm lại", "như vậy",
)
#: Weights of the factors and of the parts of two of them; bands of answer words for questions of up to so many
#: words; the band of the answer's length as a share of the context's; scores of 0 to 3 phrases of doubt; levels.
WEIGHTS = {"alignment": 0.40, "length": 0.20, "coherence": 0.30, "certainty": 0.10}
ALIGNED, COHERENT = (0.4, 0.3, 0.3), (0.6, 0.4)
LENGTHS = ((5, 10, 50), (15, 20, 100), (None, 30, 200))
SHARE = (0.1, 0.5)
DOUBTS = (1.0, 0.8, 0.6, 0.4)
LEVELS = (("High", 0.8), ("Moderate", 0.6), ("Low", 0.4))
NO_CONTEXT, NEUTRAL = 0.3, 0.5


def _words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+"))


def keywords(c: Column) -> Column:
    """Distinct words of two characters and more that carry content."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{N}_]+)"), 1))
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def band(x: Column, least: float, most: float) -> Column:
    """1 between least and most; below, the share of least; above, less by the excess as a share of most."""
    return F.when(x < least, x / least).when(x <= most, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (x - most) / most))


def _phrases(c: Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases a lower-case text has."""
    return F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: F.contains(c, p)))


def alignment(answer: Column, context: Column, found: Column) -> Column:
    """Shared content words, length beside the context's, and the mean score ``found`` of what was retrieved, null for nothing."""
    own = keywords(context)
    shared = F.least(F.lit(1.0), F.size(F.array_intersect(own, keywords(answer))) / F.size(own))
    length = band(F.length(answer) / F.length(context), *SHARE)
    score = F.when(found.isNull(), NEUTRAL).otherwise(F.least(F.lit(1.0), found))  # least() passes over nulls
    value = sum(w * part for w, part in zip(ALIGNED, (shared, length, score)))
    blank = F.coalesce(F.regexp_replace(context, r"\s+", ""), F.lit("")) == ""
    return F.when(blank, NO_CONTEXT).when(F.size(own) == 0, NEUTRAL).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def length(answer: Column, question: Column) -> Column:
    """Whether an answer has as many words as a question of that length asks for."""
    n, asked, out = _words(answer), _words(question), None
    for most, lo, hi in LENGTHS:
        score = band(n, lo, hi)
        out = F.when(asked <= most, score) if out is None else out.otherwise(score) if most is None else out.when(asked <= most, score)
    return out


def coherence(answer: Column) -> Column:
    """Connected sentences without repeated words; one sentence is coherent."""
    sentences = F.filter(F.transform(F.split(F.lower(answer), r"[.!?]+"), F.trim), lambda s: F.regexp_replace(s, r"\s+", "") != "")
    connected = F.aggregate(sentences, F.lit(0), lambda n, s: n + _phrases(s, CONNECTORS))
    words = F.regexp_extract_all(F.lower(answer), F.lit(r"(\S+)"), 1)
    parts = F.least(F.lit(1.0), connected / F.size(sentences)), F.size(F.array_distinct(words)) / F.size(words)
    return F.when(F.size(sentences) <= 1, F.lit(1.0)).otherwise(F.least(F.lit(1.0), sum(w * part for w, part in zip(COHERENT, parts))))


def certainty(answer: Column) -> Column:
    """1 without a phrase of doubt, less with each."""
    n = _phrases(F.lower(answer), DOUBT)
    out = F
    for k, score in enumerate(DOUBTS):
        out = out.when(n == k, score)
    return out.otherwise(F.greatest(F.lit(0.0), 1 - 0.1 * (n - len(DOUBTS) + 1)))


def factors(question: Column, answer: Column, context: Column, found: Column) -> dict[str, Column]:
    """Every factor of an answer; null texts are empty."""
    q, a, c = (F.coalesce(x, F.lit("")) for x in (question, answer, context))
    return {"alignment": alignment(a, c, found), "length": length(a, q), "coherence": coherence(a), "certainty": certainty(a)}


def overall(parts: dict[str, Column]) -> Column:
    return sum(WEIGHTS[name] * part for name, part in parts.items())


def level(score: Column) -> Column:
    out = F
    for name, least in LEVELS:
        out = out.when(score >= least, name)
    return out.otherwise("Very Low")
