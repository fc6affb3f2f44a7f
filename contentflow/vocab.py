"""Fixed vocabularies. All of them are defaults that callers may replace."""

# Common English function words, lower case.
ENGLISH_STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below "
    "between both but by can could did do does doing down during each few for from further had has have "
    "having he her here hers herself him himself his how i if in into is it its itself just me more most "
    "my myself no nor not now of off on once only or other our ours ourselves out over own same she should "
    "so some such than that the their theirs them themselves then there these they this those through to "
    "too under until up very was we were what when where which while who whom why will with would you your "
    "yours yourself yourselves"
).split()

# Frequent function words used as language profiles.
LANGUAGE_PROFILES = {
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es".split(),
    "en": "the of and to in a is that for it as was with be by on not he this are or his from at which".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se avec".split(),
}

# Opinion words for the rule-based sentiment default.
POSITIVE_WORDS = (
    "good great excellent amazing wonderful best better love happy positive success successful win improve "
    "improved strong reliable efficient innovative impressive outstanding helpful"
).split()
NEGATIVE_WORDS = (
    "bad terrible awful worst worse hate sad negative failure fail failed poor weak broken slow unreliable "
    "idiot stupid loser moron trash worthless garbage"
).split()

# Aspects and the words that point at them.
ASPECT_KEYWORDS = {
    "quality": ["quality", "standard", "excellence"],
    "reliability": ["reliable", "consistent", "dependable"],
    "performance": ["performance", "speed", "efficiency"],
    "usability": ["usable", "user-friendly", "accessible"],
    "value": ["value", "worth", "cost-effective"],
}

# Content categories in rank order of ties.
CATEGORIES = [
    "technology", "business", "science", "health", "politics",
    "entertainment", "sports", "education", "lifestyle", "travel",
]

# Taxonomy nodes as (category, parent or None, keywords).
TAXONOMY = [
    ("technology", None, ["software", "hardware", "programming", "artificial intelligence", "machine learning",
                          "cybersecurity", "blockchain", "cloud computing"]),
    ("ai", "technology", ["machine learning", "deep learning", "neural networks", "artificial intelligence",
                          "nlp", "computer vision"]),
    ("cybersecurity", "technology", ["security", "hacking", "encryption", "privacy", "cyber attack", "malware",
                                     "ransomware", "data breach"]),
    ("business", None, ["finance", "economy", "market", "startup", "investment", "entrepreneurship",
                        "management", "strategy"]),
    ("finance", "business", ["investing", "stock market", "cryptocurrency", "banking", "financial markets",
                             "trading", "investment"]),
    ("startups", "business", ["startup", "venture capital", "entrepreneurship", "funding", "seed round",
                              "series a", "angel investor"]),
    ("science", None, ["research", "discovery", "experiment", "scientific", "innovation", "laboratory", "study"]),
    ("physics", "science", ["quantum", "particle physics", "theoretical physics", "astrophysics",
                            "physics research"]),
    ("biology", "science", ["genetics", "molecular biology", "evolution", "cell biology", "biotechnology",
                            "microbiology"]),
]

# Hosts that decide the content type of a link.
VIDEO_HOSTS = ["youtube.com", "vimeo.com", "dailymotion.com"]
SOCIAL_HOSTS = ["twitter.com", "linkedin.com", "facebook.com", "instagram.com"]

# Error categories and the retry limits per service.
ERROR_CATEGORIES = ["api_error", "processing_error", "delivery_error", "rate_limit_error", "system_error"]
RETRY_LIMITS = [
    ("inoreader", "rate_limit_error", 5), ("inoreader", "api_error", 3), ("inoreader", "system_error", 2),
    ("webhook", "rate_limit_error", 5), ("webhook", "delivery_error", 3), ("webhook", "system_error", 2),
    ("test_service", "processing_error", 1), ("test_service", "system_error", 1),
]

# Presentation maps.
LOG_LEVELS = {"critical": "CRITICAL", "high": "ERROR", "medium": "WARNING", "low": "INFO"}
NOTICE_COLOURS = {"info": "#36a64f", "warning": "#ffa500", "error": "#ff0000", "critical": "#7b001c"}
NOTICE_RANKS = {"info": 0, "warning": 1, "error": 2, "critical": 3}
MIME_TYPES = {
    ".json": "application/json",
    ".txt": "text/plain",
    ".md": "text/markdown",
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
}
SENSITIVE_KEYS = ["api_key", "password", "token", "secret", "user_id"]
IDEA_AREAS = ["research", "drafts", "media", "reviews", "final", "archive"]

# Histogram bounds.
DURATION_BOUNDS = [0.1, 0.5, 1.0, 2.0, 5.0]
SIZE_BOUNDS = [1000.0, 10000.0, 100000.0, 1000000.0]
