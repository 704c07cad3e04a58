"""Fixed values.

Everything here must have exactly these values for results to agree with the published behaviour of the
ranking method, the tokenizer, the result table and the prompt. Nothing in this module is logic.
"""

# Word tokens are runs of two or more letters, digits or underscores, in lower case.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"

# Search terms also keep one-character words ("kv 1.1" is three words).
SEARCH_WORD_PATTERN = r"[\p{L}\p{N}_]+"

# English stop words removed before ranking.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then there these "
    "they this to was will with"
).split()

# BM25 parameters, and the digits a score is rounded to before it is compared.
BM25_K1 = 1.5
BM25_B = 0.75
SCORE_DIGITS = 6

# Limits used when the caller gives none.
TOP_ARTICLES_PER_SEARCH = 10
TOP_SECTIONS_PER_ARTICLE = 5
MIN_FULL_TEXT_SECTIONS = 2
MIN_PDF_BYTES = 10_000
EXTRACTOR_ATTEMPTS = 5
EXTRACTOR_WAIT = (0.1, 0.5)
EXTRACTOR_CONCURRENCY = 5

# Tags that say where an article's text came from.
FORMAT_FULL_TEXT = "PMC"
FORMAT_ABSTRACT = "PUBMED"
FORMAT_ABSTRACT_AND_PDF = "PUBMED | PDF"

# Metadata columns of the result table; the article id always comes first.
ARTICLE_KEY = "pubmed_id"
METADATA_COLUMNS = ("pubmed_id", "format", "sections")

# Keys of an open-access location record that hold a PDF address.
LOCATION_SUFFIX = "oa_location"
LOCATION_FIELD = "url_for_pdf"

# The prompt's opening text and the layout of a question with its sections.
PROMPT_OPENING = (
    "Given the following extracted parts of a scientific paper. The goal is to generate a detailed summary in JSON "
    "format aiming {research_goal}.\n"
    "Only respond when there is strong evidence that the paper reports thorough answer.{information_to_exclude}\n"
    "For your reasoning and answering keep in mind that some sections may contain syntax errors (symbols, math "
    "equations, formulas, abbreviations, punctuation marks etc.)\n"
    "{format_instructions}"
)
QUESTION_PREFIX = "QUESTION: "
PROMPT_SEPARATOR = "\n\n"

# The published English (Porter2) stemming rules. Each step maps a suffix to its replacement.
STEM_VOWELS = "aeiouy"
STEM_DOUBLES = "bb dd ff gg mm nn pp rr tt".split()
STEM_LI_LETTERS = "cdeghkmnrt"
STEM_R1_PREFIXES = ("gener", "commun", "arsen")
STEM_WHOLE_WORDS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl",
    "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias",
    "andes": "andes",
}
STEM_KEPT_AFTER_PLURAL = "inning outing canning herring earring proceed exceed succeed".split()
STEM_STEP_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize",
    "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al",
    "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble",
    "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
STEM_STEP_3 = {
    "tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "",
    "ness": "", "ative": "",
}
STEM_STEP_4 = (
    "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion"
).split()
