"""Fixed values of the coverage model. They must equal the values the results are compared with."""

from __future__ import annotations

SEGMENTS = ["young_urban", "family", "senior", "b2b"]
SIGNALS = ["concern_level", "purchase_intent", "avoidance_signals"]

# Weight of each signal in the drift of a domain.
DOMAIN_WEIGHTS = {
    "commerce": {"concern_level": 0.4, "purchase_intent": 0.4, "avoidance_signals": 0.2},
    "civic": {"concern_level": 0.6, "purchase_intent": 0.0, "avoidance_signals": 0.4},
    "health": {"concern_level": 0.6, "purchase_intent": 0.0, "avoidance_signals": 0.4},
    "generic": {"concern_level": 1.0, "purchase_intent": 0.0, "avoidance_signals": 0.0},
}
DEFAULT_DOMAIN = "generic"

# A topic that contains a keyword belongs to the domain; the first rule that fits counts.
DOMAIN_KEYWORDS = {
    "commerce": ["ceny", "energie", "nafta", "benzin", "inflace", "nakup", "obchod", "trh", "ekonomika", "hdp", "spotreba"],
    "civic": ["politika", "volby", "vlade", "parlament", "demokracie", "protest", "bezpecnost", "migrace", "eu"],
    "health": ["zdravi", "nemoc", "covid", "vakcina", "nemocnice", "leky", "epidemie", "psychologie"],
}

# Catalogued topics with their domain and aliases by language.
TOPIC_SEEDS = [
    {"topic": "energy", "name": "Energy", "domain": "commerce", "cs": ["energie", "energetika", "ceny energii", "ceny energií"], "en": ["energy", "energy prices"], "de": ["energiepreise"]},
    {"topic": "inflation", "name": "Inflation", "domain": "commerce", "cs": ["inflace"], "en": ["inflation", "inflation rate"], "de": ["inflationsrate"]},
    {"topic": "healthcare", "name": "Healthcare", "domain": "health", "cs": ["zdravotnictvi", "zdravotnictví", "zdravi", "zdraví"], "en": ["healthcare", "health"], "de": ["gesundheit"]},
    {"topic": "politics", "name": "Politics", "domain": "civic", "cs": ["politika"], "en": ["politics", "policy"], "de": ["politik"]},
]
SEED_LANGUAGES = ["cs", "en", "de"]
# Topics whose baselines are seeded, "" meaning all topics.
SEED_TOPICS = ["", "energie", "inflace", "bydleni", "zdravi", "politika", "ekonomika"]

# Prior of each segment: concern, purchase, avoidance, frame.
SEED_PRIORS = {
    "young_urban": (0.38, 0.31, 0.18, "opportunity"),
    "family": (0.52, 0.27, 0.29, "fear"),
    "senior": (0.61, 0.14, 0.41, "fear"),
    "b2b": (0.44, 0.48, 0.21, "conflict"),
}

# Frames, and the frame of each spelling; others stand for themselves.
FRAMES = ["fear", "opportunity", "conflict", "neutral"]
FRAME_ALIASES = {
    "alert": "fear",
    "anxiety": "fear",
    "concern": "fear",
    "fear": "fear",
    "risk": "fear",
    "threat": "fear",
    "benefit": "opportunity",
    "growth": "opportunity",
    "opportunity": "opportunity",
    "solution": "opportunity",
    "controversy": "conflict",
    "conflict": "conflict",
    "debate": "conflict",
    "dispute": "conflict",
    "explanatory": "neutral",
    "informational": "neutral",
    "mixed": "neutral",
    "neutral": "neutral",
}
# The finer frames of clusters with the frame each counts as, and their spellings.
FRAME_DETAILS = {
    "fear": "fear",
    "opportunity": "opportunity",
    "conflict": "conflict",
    "neutral": "neutral",
    "human_interest": "neutral",
    "economic_impact": "neutral",
    "policy": "neutral",
    "moral_concern": "fear",
    "uncertainty": "fear",
}
FRAME_DETAIL_ALIASES = {
    "alert": "fear",
    "anxiety": "fear",
    "concern": "fear",
    "fear": "fear",
    "risk": "fear",
    "threat": "fear",
    "benefit": "opportunity",
    "growth": "opportunity",
    "opportunity": "opportunity",
    "solution": "opportunity",
    "controversy": "conflict",
    "conflict": "conflict",
    "debate": "conflict",
    "dispute": "conflict",
    "explanatory": "neutral",
    "informational": "neutral",
    "mixed": "neutral",
    "neutral": "neutral",
    "human": "human_interest",
    "human_interest": "human_interest",
    "economic": "economic_impact",
    "economic_impact": "economic_impact",
    "policy": "policy",
    "regulation": "policy",
    "regulatory": "policy",
    "moral": "moral_concern",
    "moral_concern": "moral_concern",
    "uncertainty": "uncertainty",
    "unclear": "uncertainty",
    "unknown": "uncertainty",
}

# Share of each segment that an outlet's affinity suggests, in the order of SEGMENTS.
AFFINITY_PRIORS = {
    "mainstream": (0.30, 0.30, 0.25, 0.15),
    "young_urban": (0.60, 0.15, 0.10, 0.15),
    "family": (0.10, 0.60, 0.20, 0.10),
    "b2b": (0.15, 0.10, 0.10, 0.65),
    "senior": (0.10, 0.20, 0.60, 0.10),
}

# Fields that are labelled, in groups, and the labels of each.
LABEL_FIELDS = {
    "topic": ["topic_relevance"],
    "frame_concern": ["dominant_frame", "concern_bucket"],
    "action": ["purchase_relevance", "avoidance_relevance"],
    "segments": ["seg_young_urban_relevance", "seg_family_relevance", "seg_senior_relevance", "seg_b2b_relevance"],
}
FRAME_LABELS = ["fear", "opportunity", "conflict", "neutral", "other"]
BUCKET_LABELS = ["low", "medium", "high"]

# Thresholds.
MIN_BASELINE_ARTICLES = 30
EMA_OLD, EMA_NEW = 0.8, 0.2
CONFIDENCE_WEIGHTS = (0.5, 0.5)
CONFIDENCE_SCALE = 50
UNLEARNED_QUALITY = 0.3
READY_CONFIDENCE = 0.4
MILD_ALERT, STRONG_ALERT = 0.20, 0.45
MIX_SHIFT, MIX_LOW_SAMPLE = 0.25, 5
EFFECT_MARGIN = 0.05
RELEVANCE_THRESHOLD, RELEVANCE_HIGH = 0.55, 0.80
DUPLICATE_RULES = ((0.97, 0.20), (0.93, 0.60))
MATCH_GATE = 0.25
UNMATCHED_COST = 0.5
MATCH_WEIGHTS = (0.75, 0.15, 0.10)
RISING, MIXED_STEP = 0.08, 0.03
MAX_MISSED_RUNS = 3
BANDIT_ALPHA = 0.85
BUCKET_HOURS = 6
YIELD_TARGET = 8
# Words that carry no meaning in titles, and phrases of sentences that say nothing.
TITLE_STOPWORDS = "article body headline news story summary title".split()
BOILERPLATE = ["read more", "cookie", "subscribe", "click here", "sign up", "newsletter"]

# Outlets of the fixed panels by country, and those that a domain adds.
PANELS = {"CZ": ["irozhlas", "ct24", "idnes", "e15"], "DE": ["tagesschau", "spiegel"], "GLOBAL": ["bbc_world", "bbc", "nytimes", "the_guardian"]}
PANEL_EXTRAS = {"commerce": ["irozhlas_eko", "e15"], "health": ["irozhlas", "ct24"], "civic": ["irozhlas", "ct24", "idnes"]}

# Spellings of a segment and of a drift type in given briefs.
SEGMENT_ALIASES = {
    "young_urban": "young_urban",
    "young_urban_adults": "young_urban",
    "young_urban_adult": "young_urban",
    "young_adults": "young_urban",
    "family": "family",
    "families": "family",
    "family_household": "family",
    "family_households": "family",
    "senior": "senior",
    "seniors": "senior",
    "senior_citizen": "senior",
    "senior_citizens": "senior",
    "b2b": "b2b",
}
DRIFT_TYPE_ALIASES = {
    "concern_spike": "concern_spike",
    "concern": "concern_spike",
    "purchase_surge": "purchase_surge",
    "purchase": "purchase_surge",
    "avoidance_rise": "avoidance_rise",
    "avoidance": "avoidance_rise",
    "frame_shift": "frame_shift",
    "frame": "frame_shift",
    "mixed": "mixed",
    "stable": "stable",
}
