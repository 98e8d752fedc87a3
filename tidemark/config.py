"""Lexicons, policies and thresholds."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists and tables that results depend on.
AGGREGATOR_HINTS = ["google news"]
OFFICIAL_HINTS = ["white house", "pentagon", "department of defense", "dod", "state department", "congress", "senate", "house", "doj", "fbi", "cia", "nasa", "aaro"]
TRACKING_KEYS = ["fbclid", "gclid", "oc", "ref", "source", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content"]
SPAM_PATTERNS = [r"!{3,}", r"\?{3,}", r"^[A-Z0-9\W]{16,}$"]
CLAIM_STOPWORDS = [
    "the", "and", "for", "with", "from", "that", "this", "into", "about", "after", "over", "under", "amid", "says", "said", "will", "would",
    "could", "should", "have", "has", "had", "his", "her", "their", "its", "who", "what", "when", "where", "why", "how", "than", "then",
    "news", "report", "reports", "official", "officials", "government", "president", "white", "house", "pentagon", "new", "latest",
    "update",
]
UFO_KEYWORDS = [
    "ufo", "ufos", "uap", "uaps", "alien", "extraterrestrial", "flying saucer",
    "unidentified aerial", "unidentified flying", "disclosure",
    "non-human", "nonhuman", "roswell", "area 51", "crash retrieval",
    "bob lazar", "grusch", "elizondo", "aaro", "aatip",
    "non-human intelligence", "ufo files", "uap task force",
    "ufo hearing", "uap hearing", "declassified ufo",
    "pentagon ufo", "navy ufo", "senate ufo", "congress ufo",
    "whistleblower ufo", "tic tac ufo", "nimitz incident",
    "gimbal ufo", "go fast ufo", "skinwalker",
    "unidentified domain awareness", "transmedium",
    "unidentified anomalous", "novel aerial", "aerial phenomena",
    "unexplained aerial", "unidentified objects", "unknown aerial",
    "recovered materials", "non-human craft", "reverse engineering",
]
AMBIGUOUS_KEYWORDS = ["reverse engineering", "recovered materials", "non-human craft", "transmedium", "novel aerial"]
STRONG_KEYWORDS = [
    "ufo", "ufos", "uap", "uaps", "ufo hearing", "uap hearing", "unidentified anomalous", "unidentified aerial", "unidentified flying", "ufo files",
    "uap task force", "aaro", "aatip", "tic tac ufo", "gimbal ufo", "go fast ufo", "non-human intelligence",
]
GOVERNANCE_KEYWORDS = [
    "white house", "pentagon", "department of defense", "dod", "congress", "senate", "house", "committee", "hearing", "testimony", "briefing",
    "declassify", "disclosure", "report", "uap task force", "aaro", "government", "official",
]
GOVERNANCE_HARD_KEYWORDS = ["white house", "pentagon", "department of defense", "dod", "congress", "senate", "house", "committee", "hearing", "testimony", "briefing", "uap task force", "aaro", "nasa"]
ACTOR_KEYWORDS = ["trump", "biden", "white house", "pentagon", "dod", "department of defense", "congress", "senate", "house", "nasa", "aaro", "navy", "air force"]
ACTOR_GROUPS = {
    "trump": "us_executive", "biden": "us_executive", "white house": "us_executive", "pentagon": "dod", "dod": "dod", "department of defense": "dod",
    "congress": "us_congress", "senate": "us_congress", "house": "us_congress", "navy": "us_military", "air force": "us_military", "nasa": "nasa", "aaro": "aaro",
}
CRISIS_ACTORS = ["trump", "biden", "white house", "congress", "senate", "house", "supreme court", "doj", "department of justice", "fbi", "pentagon"]
ACTIONS = {
    "disclosure": ["declassify", "declassified", "release files", "ufo files", "disclosure", "disclose", "unseal"],
    "hearing": ["hearing", "testify", "testimony", "briefing"],
    "report": ["report", "assessment", "memo", "review"],
    "sighting": ["sighting", "encounter", "incursion", "anomalous object"],
}
TOPIC_UFO = ["ufo", "ufos", "uap", "uaps", "ufo files", "uap hearing", "ufo hearing", "unidentified anomalous", "aerial phenomena"]
TOPIC_NHI = ["alien", "aliens", "extraterrestrial", "non-human intelligence", "non-human"]
TOPIC_NHI_ANCHORS = ["extraterrestrial", "non-human intelligence", "non-human", "ufo", "uap", "unidentified anomalous"]
TOPIC_RETRIEVAL = ["crash retrieval", "recovered materials", "non-human craft"]
ALIEN_ANCHORS = ["ufo", "uap", "extraterrestrial", "non-human intelligence", "unidentified anomalous"]
IMMIGRATION_CONTEXT = ["illegal alien", "criminal alien", "deport", "deportation", "deporting", "immigration", "migrant", "border", "asylum", "ice", "customs and border protection", "cbp", "homeland security"]
CRISIS_KEYWORDS = [
    "indictment", "impeach", "scandal", "arrest", "investigation",
    "mueller", "epstein", "classified documents", "whistleblower",
    "coverup", "corruption", "resign", "crisis", "special counsel",
    "grand jury", "subpoena", "contempt of congress", "obstruction",
    "hush money", "felony", "federal charges", "pardon", "abuse of power",
    "emoluments", "insurrection", "sedition", "bribery",
    "perjury", "money laundering", "obstruction of justice",
]
CRISIS_HARD_KEYWORDS = [
    "indictment", "impeach", "scandal", "special counsel", "grand jury",
    "subpoena", "federal charges", "classified documents", "whistleblower",
    "obstruction", "obstruction of justice", "insurrection", "sedition",
    "bribery", "perjury", "money laundering", "abuse of power",
    "emoluments", "coverup", "corruption", "epstein",
]
OFFICIAL_ACTIONS = [
    "supreme court", "appeals court", "court order", "court ruling", "ruling",
    "ruled", "rules", "strikes down", "struck down", "overturn", "overturned",
    "injunction", "injunctive", "enjoined", "blocked", "veto", "signed into law",
    "executive order", "hearing", "committee vote", "vote to", "passed bill",
    "filed lawsuit", "lawsuit", "charged", "convicted", "sentenced", "plea deal",
]
CRISIS_TOPICS = ["tariff", "tariffs", "immigration", "border", "epstein", "iran", "russia", "ukraine", "china", "israel", "gaza", "tax", "budget", "deficit", "inflation", "election", "campaign", "supreme court", "doj", "fbi"]
POLITICAL_KEYWORDS = [
    "president", "white house", "congress", "senate", "house",
    "doj", "department of justice", "fbi", "federal", "supreme court",
    "attorney general", "administration", "campaign", "election",
    "impeach", "indictment", "subpoena", "grand jury",
    "democrat", "democrats", "republican", "republicans",
    "trump", "biden", "obama", "governor", "mayor", "parliament",
    "minister", "cabinet", "state department", "pentagon",
]
NATIONAL_KEYWORDS = ["president", "white house", "congress", "senate", "house", "doj", "department of justice", "fbi", "federal", "supreme court", "campaign", "election", "state department", "pentagon", "trump", "biden", "obama"]
TITLE_NATIONAL_KEYWORDS = ["president", "white house", "congress", "senate", "house", "supreme court", "doj", "department of justice", "fbi", "federal", "state department", "pentagon", "campaign", "election", "trump", "biden", "obama", "democrat", "republican"]
OPINION_HINTS = ["opinion:", "analysis:", "editorial:", "commentary:", "guest essay:"]
ROUNDUP_HINTS = [". and,", "; and ", " and, "]
CONTROL_TOPICS = {
    "economy": ["economy", "economic", "inflation", "tariff", "gdp", "recession", "jobs", "unemployment", "market", "trade"],
    "security": ["war", "iran", "russia", "china", "military", "missile", "drone", "nato", "defense", "security"],
    "immigration": ["immigration", "immigrant", "border", "refugee", "asylum", "deport", "deportation", "migrant"],
}
PANEL_TOPICS = {
    "sports": ["nfl", "nba", "mlb", "nhl", "soccer", "olympics", "championship", "super bowl", "fifa"],
    "entertainment": ["movie", "film", "tv", "television", "music", "celebrity", "hollywood", "award", "netflix"],
    "weather": ["weather", "storm", "hurricane", "tornado", "flood", "heatwave", "blizzard", "rainfall", "wildfire"],
    "technology": ["ai", "artificial intelligence", "chip", "software", "technology", "apple", "google", "microsoft", "openai"],
}
#: What the country controls look for.
COUNTRY_UFO = ["ufo", "uap", "alien", "extraterrestrial", "non-human", "nonhuman", "unidentified aerial"]
COUNTRY_POLICY = ["government", "congress", "senate", "house", "pentagon", "defense", "official", "ministry", "parliament", "doj", "fbi", "hearing", "committee", "white house"]
COUNTRY_CRISIS = ["indictment", "scandal", "investigation", "arrest", "impeach", "subpoena", "corruption", "charges", "special counsel", "grand jury", "obstruction", "classified"]

WINDOWS = (3, 7, 10, 14, 30)
MEAN_WINDOWS = (7, 14, 30)
SHOCK_FLOOR = 2.0
SEED = 20260221
RANKS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}


@dataclass(frozen=True)
class Policy:
    """Which rules of the item filter hold."""

    name: str
    min_score: int
    crisis_title_actor: bool = False
    crisis_title_hard_signal: bool = False
    ufo_title_signal: bool = False
    opinion: bool = True
    roundup: bool = True
    source_rules: bool = True
    crisis_national_context: bool = True
    crisis_hard_signal: bool = False
    ufo_strong_signal: bool = True
    ufo_government_context: bool = True


STRICT = Policy("strict", 65, crisis_title_actor=True, crisis_title_hard_signal=True, ufo_title_signal=True, crisis_hard_signal=True)
STRICT_BALANCED = Policy("strict-balanced", 55)
LENIENT = Policy("lenient", 45, opinion=False, roundup=False, source_rules=False, crisis_national_context=False, ufo_strong_signal=False, ufo_government_context=False)
POLICIES = {p.name: p for p in (STRICT, STRICT_BALANCED, LENIENT)}


def policy(name: str | None) -> Policy:
    """The policy of a name; unknown names mean strict."""
    return POLICIES.get((name or "").strip().lower(), STRICT)


def listed(raw: str | None) -> list[str]:
    """The parts of a list with commas, without blanks around them or empty ones, each once."""
    return list(dict.fromkeys(p for x in str(raw or "").split(",") if (p := x.strip())))


def gap_list(raw: str | None, fallback: int) -> list[int]:
    """The positive whole numbers of a list and the fallback, if it is positive, in order; other parts are ignored."""
    numbers = {int(p) for p in listed(raw) if p.removeprefix("+").isdecimal() and p.isascii()}
    return sorted(n for n in numbers | {fallback} if n > 0)


def category_filter(raw: str | None) -> set[str]:
    return {p.lower() for p in listed(raw)}


def selected_queries(raw: str | None, known: list[str]) -> list[str]:
    """The queries of a list; an error for none, or for one that isn't known."""
    asked = listed(raw)
    odd = [q for q in asked if q not in known]
    if odd or not asked:
        raise ValueError(f"unknown queries: {odd}; known are {sorted(known)}" if odd else "no queries")
    return asked
