"""Fixed values of the review domain: orders, labels, rubrics, limits and prices, as the domain defines them."""

# Fixed values, in natural order.
COMING_UP = (
    "rush", "college_apps", "job_interviews", "internships", "career_change", "background_check", "friends_family",
    "just_concerned", "something_else",
)
CONCERNS = (
    "inappropriate_language", "underage_drinking", "drug_use", "hate", "drinking_drugs", "political_takes",
    "controversial_topics", "negativity", "public_image", "other",
)
PLATFORM_LABELS = {"x": "X", "reddit": "Reddit", "facebook": "Facebook", "instagram": "Instagram", "tiktok": "TikTok"}
#: Platforms whose archives can be imported, and the version of the disclosure that is to be accepted.
ARCHIVE_PLATFORMS, DISCLOSURE = ("reddit", "x"), "2026-07-23"
FOCUS_SYMBOLS = {
    "rush": "⌂", "college_apps": "🎓", "job_interviews": "💼", "friends_family": "👥", "just_concerned": "🔍",
    "something_else": "•", "internships": "🧑‍💻", "career_change": "🚀", "background_check": "📋",
}
GAUGES = {"none": 0, "high": 320, "medium": 245, "low": 180}
RISK_RANKS = {"high": 4, "medium": 3, "low": 2, "none": 1}
#: concern, most serious risk, reason codes; ties go to the earlier concern.
RUBRICS = (
    ("inappropriate_language", "high", ("targeted_insult", "slur_or_dehumanization", "threat_or_incitement", "explicit_sexual_language")),
    ("hate", "high", ("hateful_or_dehumanizing_content", "targeted_harassment")),
    ("underage_drinking", "medium", ("underage_drinking_evidence",)),
    ("drug_use", "high", ("risky_drug_use",)),
    ("drinking_drugs", "high", ("risky_alcohol_or_drug_content",)),
    ("negativity", "high", ("sustained_hostility",)),
    ("political_takes", "medium", ("political_advocacy",)),
    ("controversial_topics", "low", ("polarizing_advocacy",)),
    ("public_image", "high", ("admitted_misconduct", "serious_unprofessional_conduct")),
)
#: What the stub classifier gives as the reason for a concern.
STUB_REASONS = {
    "inappropriate_language": "targeted_insult",
    "hate": "hateful_or_dehumanizing_content",
    "underage_drinking": "underage_drinking_evidence",
    "drug_use": "risky_drug_use",
    "drinking_drugs": "risky_alcohol_or_drug_content",
    "political_takes": "political_advocacy",
    "controversial_topics": "polarizing_advocacy",
    "public_image": "admitted_misconduct",
    "negativity": "sustained_hostility",
}
AUDIENCES = {
    "rush": "peers in a student organization",
    "college_apps": "college admissions and scholarship reviewers",
    "job_interviews": "recruiters and employers",
    "internships": "internship recruiters and supervisors",
    "career_change": "hiring managers and professional contacts",
    "background_check": "background-check screeners and employers",
    "friends_family": "friends and family",
}
GENERAL_AUDIENCE = "a general audience"
FORBIDDEN_AMPLIFIED = ("you wrote", "you said", "you posted")
#: Concerns of the three-step questionnaire.
STEP_CONCERNS = (
    "inappropriate_language", "underage_drinking", "drug_use", "hate", "political_takes", "controversial_topics", "negativity", "public_image",
)
#: USD per million tokens at peak hours.
PRICE_MISS, PRICE_HIT, PRICE_OUTPUT, PRICE_SCREEN = 0.30, 0.006, 1.20, 0.042
#: Batches: items, tokens with BASE for the prompt and PER_ITEM each, output tokens at OUT each, characters of an item.
MAX_ITEMS, MAX_TOKENS, BASE, PER_ITEM, MAX_OUTPUT, OUT, MAX_SCALARS = 16, 12_000, 2_500, 24, 4_096, 80, 6_000
#: Screening requests: posts, tokens of posts, tokens in all, tokens of one post.
SCREEN_POSTS, SCREEN_STATE, SCREEN_REQUEST, SCREEN_POST = 8, 20_000, 48_000, 4_000
ESCALATE_AT, FLAG_AT, NEAR_BEST = 0.15, 0.3, 0.10
