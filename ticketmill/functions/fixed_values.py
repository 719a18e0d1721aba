"""Fixed values. They decide results, so they are stated as they are and not derived."""

# Characters that Python's str.strip() removes.
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Texts a model puts in front of a cleaned answer, tried in this order.
ANSWER_PREFIXES = [
    "Here is the cleaned answer:",
    "Cleaned Answer:",
    "Cleaned:",
    "Here's the cleaned version:",
]

# Cleaning and sampling rules.
MIN_TEXT_LENGTH = 50
EXCLUDE_PATTERNS = ["tag"]
EXCLUDE_COLUMNS = ["version"]
KEEP_COLUMNS = ["tag_1", "tag_2"]
SAMPLES_PER_COMBINATION = 5
STRATIFY_COLUMNS = ["type", "priority", "language"]
SEED = 42
CURATED_SAMPLE = 1000
EVAL_SAMPLE = 50
NEAR_DUPLICATE_COSINE = 0.92

# Retrieval limits.
TOP_K = 8
TOOL_TOP_K = 5
TOOL_TOP_K_MAX = 10

# Label sets.
TOPICS = ["login", "billing", "bug", "feature_request", "how_to", "account", "other"]
INTENTS = ["question", "complaint", "request", "incident"]
PRIORITIES = ["URGENT", "HIGH", "MEDIUM", "LOW"]
ANSWER_TYPES = ["RESOLUTION", "CLARIFICATION", "ESCALATION", "PARTIAL"]

# Texts and defaults written into results.
NO_CONTEXT = "No context retrieved"
NO_CONTEXT_MARK = "NO_CONTEXT_FOUND"
CHUNK_SEPARATOR = "\n\n---\n\n"
INVALID_RESPONSE = "Invalid response"
PARSE_FAILED = "Failed to parse"
SEARCH_TOOL = "article_search"
MISSING_COLUMN = "N/A"
DEFAULT_PRIORITY = "UNKNOWN"
DEFAULT_TOPIC = "other"
DEFAULT_INTENT = "question"
FALLBACK_LABEL = "fallback"

# Share of each letter in English and German text.
LETTERS = list("abcdefghijklmnopqrstuvwxyzäöüß")
LETTER_SHARE_EN = [
    0.0812742939357567, 0.011499725761706795, 0.039511180178533105, 0.0388297576369403,
    0.12072327368981661, 0.017154598856943, 0.022526489829336343, 0.027986415268316335,
    0.083532785386676, 0.0008799472190647282, 0.0056667964992885705, 0.03608816959849924,
    0.025642870201823487, 0.07019288093288713, 0.07140111921019371, 0.02970418034546076,
    0.0015474591225964405, 0.06421488358783177, 0.07465104170806737, 0.09700265494463566,
    0.03674475171498295, 0.01231250447127652, 0.01182583086253905, 0.0013397931686843715,
    0.01620330993696494, 0.0015273880591082883, 6.3591488279293815e-06, 2.384680810473518e-06,
    7.154042431420554e-06, 0.0,
]
LETTER_SHARE_DE = [
    0.052205849756795895, 0.019728347616270177, 0.027466501845993092, 0.04178185507277323,
    0.16061706557772376, 0.01921587477466165, 0.027041994224932406, 0.035892130965591205,
    0.08029483899463412, 0.0008696719825666394, 0.013260698973035062, 0.032250277995627734,
    0.02520656160199753, 0.09607194673067626, 0.03396107388126923, 0.015231444850796827,
    0.0005226851627275346, 0.07431250770275925, 0.06449869920559746, 0.07614236996872012,
    0.04593061052737123, 0.010199323619404432, 0.012698557115074987, 0.0005319690910175441,
    0.004951118957062064, 0.013301084061096603, 0.0037219268514648066, 0.004827874809012187,
    0.006426335162344573, 0.0008388028210023579,
]
LETTER_PROFILES = {"de": LETTER_SHARE_DE, "en": LETTER_SHARE_EN}
