"""Settings and fixed values.

Everything that has to equal the behaviour we reproduce is listed here once, as
plain text, and the operators take it as arguments so users can swap it."""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES (must stay as written for matching results)
# ---------------------------------------------------------------------------

# Tokenizer: words, plus a one-word section marker such as "=== location ===".
# [\p{L}\p{N}_] is the Unicode word class; it reads the same in Java and RE2.
TOKEN_PATTERN = r"===\s*[\p{L}\p{N}_]+\s*===|[\p{L}\p{N}_]+"

# Retrieval sizes: candidates per source, and the fused size.
COURSE_K = 15
REVIEW_K = 15
FINAL_K = 10

# Staged pipeline bounds and defaults.
TOTAL_K = 15
DEFAULT_COURSE_K = 5
DEFAULT_REVIEW_K = 5
MAX_ATTEMPTS = 4
CONTEXT_MAX_ITERATIONS = 2

# Token-limit guard default.
TOKEN_LIMIT = 4096

# Gibberish guard threshold.
GIBBERISH_THRESHOLD = 0.50

# Query structuring rules: (field, priority, needle, value); first hit per field wins.
QUERY_RULES = [
    ("course", 1, "algorithms", "algorithms"),
    ("course", 2, "artificial intelligence", "artificial intelligence"),
    ("professor", 1, "rajagopal", "venkatesaramani, rajagopal"),
    ("professor", 2, "venkatesaramani", "venkatesaramani, rajagopal"),
    ("term", 1, "spring 2025", "spring 2025"),
    ("campus", 1, "boston", "boston"),
]
# The batch module has no professor rule; the notebook variant has it.
MODULE_RULE_FIELDS = ("course", "term", "campus")

# Query enhancement clause per found part, in this order.
ENHANCE_CLAUSES = [
    ("course", " === course metadata === title: "),
    ("professor", " === instructor === professor: "),
    ("term", " === course details === term: "),
    ("campus", " === location === campus: "),
]

# BM25 section weights (the experiment's intended section names) and parameters.
BM25_SECTION_WEIGHTS = {
    "metadata": 2.0,
    "instructor": 2.0,
    "details": 1.5,
    "location": 1.5,
    "description": 0.5,
}
BM25_SECTIONS = ["course metadata", "instructor", "course details", "location"]
BM25_SECTION_KEYS = {"course metadata": "metadata", "instructor": "instructor",
                     "course details": "details", "location": "location"}
BM25_QUERY_PART_WEIGHTS = {"course": 2.0, "professor": 2.0, "term": 1.5, "campus": 1.5}
BM25_K1 = 1.5
BM25_B = 0.75
BM25_EPSILON = 0.25

# Source labels for fused candidate lists.
COURSE_LABEL = "[COURSE INFO] "
REVIEW_LABEL = "[STUDENT REVIEW] "

# Review document template (body lines carry a 4-space indent).
REVIEW_TEMPLATE = (
    "Metadata:\n"
    "    CRN: %s, Course Name: %s, Instructor: %s,\n"
    "    Course Number: %s%s\n"
    "\n"
    "    Question:\n"
    "    %s\n"
    "\n"
    "    Review:\n"
    "    %s\n"
    "    "
)

# Prompt layout.
PROMPT_WITH_CONTEXT = "Context:\n{context}\n\nQuery: {query}\n\nAnswer:"

# Report line markers, in classification order (first match wins).
REPORT_TERM_MARKER = "(Spring 2024)"
REPORT_MARKERS = [
    ("course_name", None),
    ("instructor", "Instructor: "),
    ("subject", "Subject: "),
    ("course_number", "Catalog & Section: "),
    ("crn", "Course ID: "),
    ("q", "Q: "),
]

# Input guard scanners, in run order; output guard scanners, in run order.
INPUT_SCANNERS = ["Gibberish", "BanSubstrings", "PromptInjection", "TokenLimit"]
OUTPUT_SCANNERS = ["Bias", "NoRefusal", "Gibberish"]

# Banned substrings (44 entries).
BANNED_SUBSTRINGS = [
    "chink", "gook", "nip", "paki", "spic", "kike", "faggot", "dyke", "tranny",
    "retard", "spaz", "fuck", "motherfucker", "shit", "bitch", "cunt", "porn",
    "incest", "bestiality", "necrophilia", "kill you", "i will kill you",
    "die in a fire", "shoot you", "stab you", "bomb them", "go kill yourself",
    "you're worthless", "everyone hates you", "i hate you", "kill yourself",
    "cut yourself", "take your own life", "how to make a bomb", "terrorist manual",
    "join extremist group", "sell drugs", "buy fake ids", "steal credit cards",
    "social security number", "passport number", "credit card number",
    "bank account", "cvv code",
]

# ---------------------------------------------------------------------------
# OUR OWN RULES (heuristics in place of model-based scanners)
# ---------------------------------------------------------------------------

# Prompt-injection rules: (pattern, weight).
INJECTION_RULES = [
    (r"ignore (all |any )?(the )?(previous|prior|above) (instructions|prompts?)", 1.0),
    (r"disregard (all |any )?(the )?(previous|prior|above)", 1.0),
    (r"you are now", 0.6),
    (r"system prompt", 0.8),
    (r"pretend (to be|you are)", 0.6),
    (r"jailbreak", 1.0),
    (r"do anything now", 1.0),
    (r"reveal (your|the) (instructions|prompt)", 0.9),
]
INJECTION_THRESHOLD = 0.5

# Refusal phrases for the output guard.
REFUSAL_PATTERNS = [
    r"i('m| am) sorry,? but",
    r"i can(no|')t (help|assist|provide)",
    r"i('m| am) (not able|unable) to",
    r"as an ai( language model)?",
    r"i apologi[sz]e,? but",
]

# ---------------------------------------------------------------------------
# FIXED VALUES, continued
# ---------------------------------------------------------------------------

# Relevance verdict text and gate outcomes.
RELEVANT = "RELEVANT"
GATE_POLICY = "CONTENT POLICY VIOLATION"
GATE_NOT_RELEVANT = "NOT RELEVANT"
GATE_VALID = "VALID"
GATE_VALID_MESSAGE = "Query is valid and relevant"

# Staged pipeline fixed messages.
MSG_VALIDATION_PARSE = "Error in validation process"
MSG_INTENT_PARSE = "Failed to parse intent analysis"
MSG_RESPONSE_MISSING = "I apologize, but I'm unable to provide a response due to missing information."
MSG_RESPONSE_PARSE = ("I apologize, but I encountered an error while generating the response. "
                      "Please try rephrasing your question.")
MSG_RESPONSE_PARSE_ERROR = "Failed to parse response generation"
MSG_RESPONSE_ERROR = ("I apologize, but I encountered an error while generating the response. "
                      "Please try again.")
MSG_ENHANCEMENT_PARSE = "Failed to generate enhanced queries"
MSG_JSON_ARRAY = "list indices must be integers or slices, not str"
MSG_STRATEGY_DEFAULT = "Default balanced strategy due to error"
MSG_CONTEXT_MAX = "Max retrieval iterations reached - forcing exit."
MSG_CONTEXT_PARSE = "Error parsing context analysis response"

# Dataset creation: semester, topics, course names, seed templates.
SEMESTER = "Spring 2025"
TOPICS = ["Machine Learning", "Deep Learning", "Data Science", "Computer Systems",
          "Programming", "Development"]
COURSE_NAMES = [
    "Foundations of Artificial Intelligence", "Algorithms", "Programming Design Paradigm",
    "Pattern Recognition and Computer Vision", "Natural Language Processing",
    "Deep Learning", "Machine Learning", "Information Retrieval", "Computer Systems",
    "Database Management", "Recitation for CS5010", "Foundations of Software Engineering",
    "Reinforcement Learning", "Computer/Human Interaction", "Web Development", "Compilers",
    "Mobile Application Development", "Discrete Structures", "Data Mining Techniques",
    "Fundamentals of Cloud Computing", "Object-Oriented Design", "Computer Systems",
]
SEED_TEMPLATES = [
    "What courses are being offered for the {semester} semester?",
    "Which professor is taking the course {course_name}?",
    "What are the courses available related to {topic}?",
    "Can you please suggest online courses to take?",
    "Can you suggest research or seminar-based courses?",
    "Can you suggest courses without exams?",
    "Can you suggest courses which are not too hectic and easy to get good grades?",
    "What are the class timings for the course {course_name}?",
    "Are there any prerequisite courses for {course_name}?",
    "Has the course {course_name} been offered in the past? If so, could you summarize the reviews?",
    "How's the course {course_name} based on the reviews?",
    "How difficult is the course {course_name}?",
    "What courses are being offered by Professor {professor_name}?",
    "How is Professor {professor_name} in terms of grading?",
]
# Slot priority when a template is expanded.
SLOT_PRIORITY = ["professor_name", "semester", "course_name", "topic"]
N_PROFESSORS = 50
N_SAMPLED_QUESTIONS = 250
SAMPLE_SEED = 3
VARIANTS_PER_QUESTION = 10
