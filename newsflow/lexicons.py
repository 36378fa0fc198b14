"""Default word lists, topic terms and source rules.

Fixed values: results depend on every entry, so they are stated here as they
must be. All of them are defaults of parameters; pass your own to replace them.
"""

# Fixed values.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "for", "to", "of", "in", "on", "at", "by", "from", "with", "as",
    "is", "are", "was", "were", "be", "been", "being", "this", "that", "these", "those", "it", "its",
    "they", "them", "their", "you", "your", "we", "our", "he", "she", "his", "her", "i", "me", "my",
    "not", "no", "yes", "do", "does", "did", "done", "can", "could", "will", "would", "should", "may", "might", "must",
    "about", "into", "over", "after", "before", "more", "most", "up", "down", "out", "just", "than", "too", "very",
)

# Fixed values.
NOISE_WORDS = (
    "top", "better", "best", "worst",
    "said", "says", "say",
    "new", "latest", "update", "updates",
    "report", "reports", "reported", "according",
    "confirmed", "announcement", "official",
    "statement", "claims", "sources",
    "today", "yesterday", "tomorrow",
    "week", "weeks", "month", "months", "year", "years",
    "time", "day", "days", "hours", "minutes",
    "amid", "after", "before", "during", "while",
    "following", "around", "over", "under",
    "more", "most", "less", "many", "several",
    "news", "media", "article", "story", "stories",
    "video", "videos", "image", "images",
)

# Fixed values.
POSITIVE_WORDS = (
    "good", "great", "positive", "success", "win", "wins", "winning", "growth", "improve", "improved", "improvement",
    "benefit", "benefits", "hope", "peace", "stable", "stability", "agreement", "deal", "recovery", "support",
    "boost", "strong", "record", "best", "profit", "profits", "safe", "safer", "resolved", "solution", "progress",
    "breakthrough", "aid", "relief", "approval", "celebrate", "bullish",
)

# Fixed values.
NEGATIVE_WORDS = (
    "bad", "worse", "worst", "negative", "loss", "losses", "down", "drop", "crash", "collapse", "recession", "inflation",
    "war", "attack", "bomb", "strike", "killed", "dead", "deaths", "injured", "violence", "protest", "riot", "terror",
    "earthquake", "disaster", "emergency", "crisis", "fear", "threat", "sanction", "conflict", "shutdown", "layoff",
    "fraud", "scandal", "arrest", "accident", "outage", "fire", "flood", "drought", "bearish",
)

# Topic -> terms, in priority order. A term matches as a substring; "s?" marks
# an optional plural letter.
TOPIC_TERMS = {
    "politics": (
        "election", "president", "government", "parliament", "minister", "senate",
        "war", "ceasefire", "gaza", "israel", "ukraine", "diplomacy",
        "sanctions?", "embargo", "airstrike", "missile", "military",
    ),
    "tech": (
        "ai", "artificial intelligence", "openai", "google", "apple", "microsoft",
        "software", "hardware", "chip", "cloud", "streaming", "platform",
        "telecom", "mobile", "broadband", "5g", "cybersecurity", "app", "subscription",
    ),
    "sports": (
        "match", "league", "tournament", "goal",
        "football", "soccer", "nba", "nfl", "tennis", "cricket",
        "boxing", "ufc", "mma", "coach", "retired", "knockout",
    ),
    "business": (
        "market", "stocks?", "shares?", "inflation", "bank",
        "deal", "acquisition", "merger", "ipo", "earnings",
        "pricing", "revenue", "subscription",
    ),
    "science": (
        "research", "study", "nasa", "space", "climate",
        "physics", "biology", "medical", "health", "vaccine", "genome",
    ),
}

# Points for a topic hit, points for a bonus keyword, and the score a topic needs.
TOPIC_HIT_SCORE = 3
TOPIC_BONUS_KEYWORDS = {"politics": ("war", 1), "tech": ("ai", 1)}
TOPIC_THRESHOLDS = {"politics": 3, "tech": 2, "sports": 2, "business": 2, "science": 2}
NO_TOPIC = "other"

# Fixed values: (text in the link, source name), first match wins.
SOURCE_RULES = (
    ("ft.com", "Financial Times"),
    ("wired.com", "Wired"),
    ("engadget.com", "Engadget"),
    ("aljazeera.com", "Al Jazeera"),
    ("bbc.co", "BBC"),
    ("bbc.com", "BBC"),
)
NO_SOURCE = "Unknown"
