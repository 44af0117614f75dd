"""Defaults of the text operators; all are parameters of the functions that use them."""

# Weighted terms, in the order in which matched terms are listed.
LEXICON = {
    "sanction": 2, "sanctions": 2, "tariff": 2, "tariffs": 2, "embargo": 2, "invasion": 2, "airstrike": 2, "ceasefire": 2,
    "warfare": 2, "geopolitical": 2, "opec": 2, "nato": 2, "annexation": 2, "coup": 2, "export controls": 2, "trade war": 2,
    "missile": 2, "warship": 2, "hormuz": 2, "red sea": 2, "houthi": 2, "zelenskyy": 2, "putin": 2, "kyiv": 2, "moscow": 1,
    "hamas": 2, "hezbollah": 2, "netanyahu": 1, "tehran": 2, "pyongyang": 2, "xi jinping": 1, "geopolitics": 2, "trade deal": 1,
    "import duty": 2, "export ban": 2, "opec+": 2, "strait": 1, "annex": 2, "proxy war": 2, "arms": 1, "beijing": 1,
    "us china tensions": 2, "chinese military": 2, "south china sea": 2, "chip export": 2, "war": 1, "conflict": 1, "military": 1,
    "troops": 1, "diplomatic": 1, "tension": 1, "tensions": 1, "retaliation": 1, "escalation": 1, "russia": 1, "ukraine": 1,
    "israel": 1, "gaza": 1, "iran": 1, "taiwan": 1, "north korea": 1, "kremlin": 1, "oil": 1, "crude": 1, "pipeline": 1,
    "blockade": 1, "treaty": 1, "summit": 1, "border": 1, "defense": 1, "security council": 1,
}
# Keywords by group.
KEYWORD_GROUPS = {
    "conflict": (
        "war", "invasion", "military strike", "airstrike", "ceasefire", "troops deployed", "armed conflict", "missile attack", "border clash",
        "Russia Ukraine", "Israel Gaza", "Middle East conflict", "Taiwan tensions", "South China Sea", "North Korea missile",
    ),
    "policy": (
        "sanctions", "tariffs", "trade war", "export controls", "embargo", "trade restrictions", "geopolitical risk", "diplomatic crisis",
        "US China tensions", "chip export ban", "asset freeze", "NATO", "summit talks", "peace deal",
    ),
    "energy_supply": (
        "OPEC", "oil supply", "oil prices surge", "energy crisis", "gas pipeline", "crude output cut", "shipping disruption", "Red Sea shipping",
        "Strait of Hormuz", "supply chain disruption",
    ),
    "macro_control": (
        "Federal Reserve", "interest rate decision", "US inflation", "dollar index", "Treasury yields", "rupiah exchange rate", "Bank Indonesia",
        "emerging market currency",
    ),
}
# Phrases that reject a text.
NEGATIVE = (
    "best credit card", "recipe", "celebrity", "box office", "nfl", "nba", "super bowl", "how to save money", "gift guide",
    "black friday deal", "horoscope", "royal family", "movie review", "album review", "fantasy football", "product review",
    "prime day", "gaming stocks", "hire", "hiring", "holiday season", "earnings beat", "quarterly results", "stocks to buy",
    "analyst upgrade",
)
# Types and sections that are not text articles, and paid sections.
DROP_TYPES = ("cnbcvideo", "video", "slideshow", "livestream", "wildcard", "blog")
DROP_SECTIONS = ("pro:", "quote", "make it", "select", "press release")
PAID_SECTIONS = ("pro:", "investing club")
# Words that the normal form leaves out.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "while", "of", "at", "by", "for", "with", "about", "into", "through", "during",
    "to", "from", "in", "on", "off", "over", "under", "again", "then", "once", "here", "there", "all", "any", "both", "each",
    "few", "more", "most", "other", "some", "such", "than", "too", "very", "can", "will", "just", "should", "now", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "doing", "would", "could", "this", "that",
    "these", "those", "i", "you", "he", "she", "it", "we", "they", "them", "his", "her", "its", "their", "our", "as", "so",
    "up", "out", "also", "said",
)
# Boilerplate of the term-weight chain.
BOILERPLATE_TERMS = (
    r"Sign up (for|now)[^.]*\.",
    r"Subscribe to CNBC[^.]*\.",
    r"Got a confidential news tip\?[^.]*\.?",
    r"[—\-]\s*CNBC'?s [^.]*contributed to this (report|story)\.",
    r"Watch CNBC'?s full interview[^.]*\.",
    r"Read more:[^.]*\.?",
    r"Correction:\s*This (story|article)[^.]*\.",
    r"Disclosure:[^.]*\.",
    r"This is breaking news\.?\s*(Please )?check back for updates\.?",
    r"In this article:?",
    r"Don'?t miss[^.]*\.",
)
#: Rest of a sentence that steps over U.S., U.K., U.N. and E.U.; no alternation is repeated, so long sentences need no stack.
SENTENCE_END = r"[^.]*(?:(?<=U)\.[SKN]\.[^.]*|(?<=E)\.U\.[^.]*)*\."
# Boilerplate of the transformer chain.
BOILERPLATE_TRANSFORMER = (
    r"Sign up (for|now)" + SENTENCE_END,
    r"Subscribe to CNBC on YouTube\.",
    r"Subscribe to CNBC PRO for exclusive insights and analysis, and live business day programming from around the world\.",
    r"[—\-]\s*CNBC'?s [^.]*contributed to this (report|story)\.",
    r"Correction:\s*This (story|article)" + SENTENCE_END,
    r"Disclosure:" + SENTENCE_END,
    r"This is breaking news\.?\s*(Please )?check back for updates\.?",
    r"This report is from today'?s CNBC Daily Open[^.]*\.\s*CNBC Daily Open brings investors up to speed[^.]*\.\s*"
    r"Like what you see\?\s*You can subscribe here\s*\.",
)
# Of these, in lower case, every text that the patterns take holds one.
BOILERPLATE_HINTS = (
    "sign up ", "subscribe to cnbc", "confidential news tip", "contributed to this", "watch cnbc", "read more:", "correction:", "disclosure:",
    "this is breaking news", "in this article", "t miss", "this report is from today",
)
# A label at the start and a footer to the end that the transformer chain cuts.
LEADING_LABEL = r"^\s*In this article\s*"
TRAILING_FOOTER = r"Click here to read Jim Cramer's Guide to Investing.*$"
# Signs and their plain forms.
CURLY = {"‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-", "\u00a0": " "}
# Month names and abbreviations of the rate file.
RATE_MONTHS = {
    "januari": 1, "februari": 2, "maret": 3, "april": 4, "mei": 5, "juni": 6, "juli": 7, "agustus": 8, "september": 9, "oktober": 10,
    "november": 11, "desember": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "agu": 8, "ags": 8, "sep": 9,
    "okt": 10, "nov": 11, "des": 12,
}
# English month names and abbreviations.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10,
    "november": 11, "december": 12, "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12,
}
# Study period, cut-off hour, zone shift of the fixing, dead zone of the direction label, thresholds.
FIRST_DAY, LAST_DAY = "2021-09-01", "2026-09-01"
CUTOFF_HOUR, MARKET_ZONE, FLAT = 8, "Asia/Jakarta", 0.0005
MIN_TOKENS, MIN_SCORE, MIN_TITLE_SCORE, MIN_RATE = 5, 2, 1, 1000
CHUNK_TOKENS, CHUNK_OVERLAP = 512, 50
LIVE_BLOG = "live updates|live blog|war updates|live-updates|live-blog"
TOPIC = "ukraine|russia|putin|kyiv|zelenskyy"
