"""Word lists, patterns and limits that define the results.

They are defaults; every function that uses one takes it as an argument.
"""

# Function words by category (a word in two lists counts twice).
FUNCTION_WORDS = {
    "article": ["a", "an", "the"],
    "preposition": ["in", "on", "at", "by", "for", "with", "to", "from", "of", "about"],
    "pronoun": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"],
    "conjunction": ["and", "or", "but", "so", "yet", "for", "nor"],
    "auxiliary_verb": [
        "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    ],
}

# Function words of the profile features.
PROFILE_FUNCTION_WORDS = {
    "articles": ["the", "a", "an"],
    "prepositions": ["in", "on", "at", "by", "for", "with", "to", "of", "from"],
    "pronouns": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "her", "us", "them"],
    "conjunctions": ["and", "or", "but", "so", "yet", "for", "nor"],
    "auxiliary_verbs": [
        "is", "are", "was", "were", "have", "has", "had", "will", "would", "could", "should",
    ],
}

# Characters counted as punctuation, by feature.
PUNCTUATION = {
    "comma": [","],
    "period": ["."],
    "exclamation": ["!"],
    "question": ["?"],
    "semicolon": [";"],
    "colon": [":"],
    "dash": ["-", "—"],
    "quotation": ['"', "'"],
}
PROFILE_PUNCTUATION = {
    "comma": [","],
    "semicolon": [";"],
    "colon": [":"],
    "exclamation": ["!"],
    "question": ["?"],
    "dash": ["--", "—"],
    "parentheses": ["(", ")"],
}

# Part-of-speech tags by ratio.
POS_GROUPS = {
    "noun": ["NN", "NNS", "NNP", "NNPS"],
    "verb": ["VB", "VBD", "VBG", "VBN", "VBP", "VBZ"],
    "adjective": ["JJ", "JJR", "JJS"],
    "adverb": ["RB", "RBR", "RBS"],
    "pronoun": ["PRP", "PRP$", "WP", "WP$"],
    "preposition": ["IN"],
    "conjunction": ["CC"],
    "determiner": ["DT", "WDT"],
}

# Phrases and words of the AI-likeness scores.
STOCK_PHRASES = [
    "it is important to note", "in conclusion", "furthermore", "moreover", "in addition",
    "on the other hand", "it should be noted", "as mentioned earlier",
]
TRANSITION_WORDS = [
    "however", "therefore", "furthermore", "moreover", "additionally", "consequently",
    "nevertheless", "nonetheless", "meanwhile",
]
FORMAL_WORDS = [
    "utilize", "facilitate", "implement", "demonstrate", "establish", "furthermore", "moreover",
    "consequently", "therefore", "thus",
]
HEDGES = [
    "might", "could", "may", "perhaps", "possibly", "potentially", "seems", "appears", "tends to",
    "generally", "typically",
]
GENERIC_PHRASES = [
    "various aspects", "different ways", "important factors", "significant impact", "crucial role",
    "essential elements", "key components", "fundamental principles",
]
PERSONAL_PHRASES = [
    "i think", "i believe", "in my opinion", "from my experience", "i have seen", "i noticed",
    "personally", "my view",
]
STRUCTURE_MARKERS = [
    "firstly", "secondly", "thirdly", "finally", "in conclusion", "to summarize", "in summary",
    "to begin with", "next",
]

# Content checks.
SUSPICIOUS_PATTERNS = [
    r"lorem ipsum",
    r"test test test",
    r"(.)\1{20,}",
    r"(\w+\s+)\1{10,}",
]
COMMON_ENGLISH = ["the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by"]

# User-agent patterns of automated clients.
AUTOMATION_MARKS = ["bot", "crawler", "spider", "scraper", "scanner", "exploit", "hack"]

# Similarity presets, (semantic, lexical) per sensitivity level.
SENSITIVITY = {
    "strict": (0.90, 0.85),
    "moderate": (0.80, 0.75),
    "sensitive": (0.70, 0.65),
}

# Retention policies, (data type, days, action).
RETENTION_POLICIES = [
    ("academic_records", 1825, "ARCHIVE"),
    ("personal_data", 730, "ANONYMIZE"),
    ("audit_logs", 365, "ANONYMIZE"),
    ("session_data", 30, "HARD_DELETE"),
]

# Two-sided 95 % Student t quantiles for 1..30 degrees of freedom, then the normal one.
T_QUANTILES_95 = [
    12.706205, 4.302653, 3.182446, 2.776445, 2.570582, 2.446912, 2.364624, 2.306004, 2.262157,
    2.228139, 2.200985, 2.178813, 2.160369, 2.144787, 2.131450, 2.119905, 2.109816, 2.100922,
    2.093024, 2.085963, 2.079614, 2.073873, 2.068658, 2.063899, 2.059539, 2.055529, 2.051831,
    2.048407, 2.045230, 2.042272,
]
NORMAL_QUANTILE_95 = 1.959964

# The English stop words that Spark ships (StopWordsRemover), for SQL that is made without a session.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing a an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very s t can will just don should now i'll "
    "you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't "
    "won't wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's "
    "there's what's when's where's who's why's would"
).split()
