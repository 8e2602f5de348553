"""Word lists, tables and constants that results depend on, as defaults of the functions that use them."""

# Keywords of each policy stance, matched as substrings.
STANCE_KEYWORDS = {
    "tightening": ["increase", "increased", "raise", "raised", "hike", "restrictive", "inflation", "tightening", "vigilant"],
    "easing": ["decrease", "decreased", "cut", "lower", "reduced", "accommodative", "stimulus", "easing", "support growth"],
    "hold": ["maintain", "unchanged", "held", "hold", "pause", "kept"],
}

# Keywords of each instrument, first instrument first.
INSTRUMENT_KEYWORDS = {
    "policy_rate": ["rate", "bank rate", "federal funds", "key rate", "lpr"],
    "asset_purchase": ["asset purchase", "qe", "quantitative easing", "purchase programme", "balance sheet"],
    "reserve_requirement": ["reserve requirement", "rrr"],
    "forward_guidance": ["forward guidance", "guidance", "communication"],
    "macroprudential": ["macroprudential", "financial stability", "capital buffer"],
}

# Document types by keyword, first keyword first.
DOC_KEYWORDS = {
    "minutes": "minutes",
    "statement": "statement",
    "press release": "statement",
    "monetary policy summary": "decision",
    "rate": "decision",
    "key rate": "decision",
    "speech": "speech",
    "testimony": "testimony",
    "report": "report",
    "projection": "projection",
    "sep": "projection",
    "transcript": "transcript",
    "press conference": "press_conference",
    "open market": "operation",
    "reserve requirement": "operation",
    "lpr": "operation",
    "mlf": "operation",
}

# Country, actor and the substrings of padded lower-case text that name it, first row first.
ACTOR_PATTERNS = [
    ("CHN", "People's Bank of China", ["people's bank of china", "people’s bank of china", "pboc", "pbc"]),
    ("GBR", "Bank of England", ["bank of england", "monetary policy committee", " mpc "]),
    ("USA", "Federal Reserve", ["federal reserve", "fomc", "board of governors"]),
    ("RUS", "Bank of Russia", ["bank of russia", "central bank of the russian federation", "central bank of russia"]),
    ("FRA", "Banque de France", ["banque de france", "bank of france"]),
    ("FRA", "European Central Bank", ["european central bank", " ecb "]),
]

# Titles of navigation links.
NAVIGATION_TITLES = [
    "skip to main content", "back to home", "subscribe to rss", "subscribe to email", "recent postings", "calendar",
    "publications", "site map", "a-z index", "careers", "faqs", "videos", "contact", "advanced",
]

# Forecast classes, in the order in which the first wins a tie.
CLASSES = ("hike_25bp", "hold", "cut_25bp")

# Weight of each reward component.
REWARD_WEIGHTS = {
    "schema_valid": 1.0,
    "no_future_leakage": 1.0,
    "evidence_traceable": 0.8,
    "fed_probability_calibrated": 1.2,
    "lower_regret": 0.8,
    "fewer_convergence_rounds": 0.5,
    "stable_after_10_rounds": 0.7,
    "role_consistency": 0.8,
    "unsupported_claims": 0.7,
    "overconfident_wrong_prediction": 1.0,
    "not_always_hold": 1.0,
}
