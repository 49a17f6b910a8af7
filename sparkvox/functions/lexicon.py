"""Fixed values.

Two kinds of constants live here:

1. Values that must equal the behaviour being reproduced (marked
   "fixed values — behaviour"). They are stated plainly, in natural order.
2. The tables of the built-in rule tokeniser (marked "fixed values — rule
   tokeniser"). They are this library's own choice; the same tables feed the
   Spark operators and the DuckDB oracle SQL, so both sides agree exactly.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# fixed values — behaviour
# ---------------------------------------------------------------------------

# Text normalisation limits (characters processed / characters stored), off by
# default in this library; see README.
MAX_CHARS_TO_PROCESS = 2000
MAX_CHARS_TO_STORE = 1200

# Characters replaced by a single space before collapsing runs of spaces:
# ideographic space, group separator, tab, carriage return.
REPLACED_CHARS = "　\u001d\t\r"

# Whitespace class stripped at both ends (what Python's str.strip removes).
STRIP_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)

# The same whitespace set as explicit characters (for btrim).
STRIP_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# Delimiter joining lemmas of a document (group separator, 0x1D).
DELIMITER = "\u001d"

# Content-word filter: POS tags kept, and lemmas always dropped.
RELEVANT_POS = ["VERB", "PROPN", "NOUN", "AUX", "ADV", "ADJ"]
ALWAYS_DROPPED_LEMMAS = ["ます", "てる", "事", "です", "思う", "他"]
# The one AUX lemma that is kept.
KEPT_AUX_LEMMA = "ない"

# Word-statistics defaults.
MIN_DOCUMENT_FREQUENCY = 0.02
MAX_DOCUMENT_FREQUENCY = 0.98
MAX_VOCAB_SIZE = 20000
N_WIDE_WORDS = 1000
N_EDGE = 100
MIN_CO_OCCURRENCE = 0.01

# Co-occurrence network display: node colour by POS, fallback colour, and
# the node/edge display scale factors.
POS_COLORS = {
    "VERB": "#4e79a7",
    "NOUN": "#f28e2b",
    "AUX": "#e15759",
    "ADV": "#e15759",
    "ADJ": "#e15759",
}
OTHER_POS_COLOR = "#bab0ac"
NODE_SIZE_SCALE = 30
EDGE_WIDTH_SCALE = 12
EMPTY_NETWORK_LABEL = "表示できる共起表現がありません。\n\n表示する対象の条件を緩めてください"
EMPTY_NETWORK_COLOR = "#ffffff00"

# Categorical palettes (10 and 20 colours); <= 10 groups use the first.
PALETTE_10 = [
    "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd",
    "#8c564b", "#e377c2", "#7f7f7f", "#bcbd22", "#17becf",
]
PALETTE_20 = [
    "#1f77b4", "#aec7e8", "#ff7f0e", "#ffbb78", "#2ca02c",
    "#98df8a", "#d62728", "#ff9896", "#9467bd", "#c5b0d5",
    "#8c564b", "#c49c94", "#e377c2", "#f7b6d2", "#7f7f7f",
    "#c7c7c7", "#bcbd22", "#dbdb8d", "#17becf", "#9edae5",
]

# Document table placeholders shown when nothing is selected.
EMPTY_TABLE_TEXT = "点を選択するとここに文書が表示されます"
EMPTY_TABLE_LABEL = "-"
N_EMPTY_ROWS = 3

# Worker status values, staleness limits and worker board symbols.
FINAL_STATUSES = ["done", "error at app", "error at worker"]
STALE_STATUS = "error at worker"
STALE_AFTER_SECONDS = 300
INFO_TTL_SECONDS = 0.5
MAX_N_WORKERS = 2
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
ALIVE_SYMBOL = "🚗"
NOT_ALIVE_SYMBOL = "－"

# Tree paths.
TREE_DELIMITER = "/"

# Cluster sweep and word-cloud canvas constants.
MAX_CLUSTER = 14
KMEANS_SEED = 0
CANVAS_WIDTH = 1000
CANVAS_HEIGHT = 600
CANVAS_MARGIN = 50
CANVAS_SPREAD = 0.65
CLOUD_SIZE_FACTOR = 0.06
CLOUD_DIAMETER = 800          # 900 px cloud image minus 2 x 50 px margin
CLOUD_CANVAS = 900
CLOUD_OFFSET = 450
FONT_SCALE = 1.04
BUBBLE_SCALE = 1.05

# ---------------------------------------------------------------------------
# fixed values — rule tokeniser (this library's own tables)
# ---------------------------------------------------------------------------

SENTENCE_SPLIT = "[.!?。！？\n]+"
WORD_PATTERN = r"[\p{L}\p{M}\p{N}]+"
CAPITALISED = r"^\p{Lu}"
# Scripts written without spaces, with the sound marks that several scripts share.
UNSPACED_SCRIPTS = ["Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar"]
UNSPACED_JAVA = "[" + "".join(f"\\p{{Is{s}}}" for s in UNSPACED_SCRIPTS) + "\u30fc\u3099\u309a]"
UNSPACED_DUCK = "[" + "".join(f"\\p{{{s}}}" for s in UNSPACED_SCRIPTS) + "\u30fc\u3099\u309a]"
DIGITS_ONLY = "^[0-9]+$"

STOP_WORDS = {
    "en": ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from",
           "he", "i", "in", "is", "it", "not", "of", "on", "or", "she", "that",
           "the", "they", "this", "to", "was", "we", "were", "with", "you"],
    "fr": ["au", "aux", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et",
           "il", "la", "le", "les", "ou", "par", "pas", "pour", "que", "qui",
           "sont", "sur", "un", "une", "avec"],
    "de": ["auf", "den", "der", "des", "dem", "die", "das", "ein", "eine", "er", "es",
           "für", "im", "in", "ist", "mit", "nicht", "oder", "sie", "sind", "und",
           "von", "zu"],
    "es": ["al", "con", "de", "del", "el", "en", "es", "la", "las", "lo", "los", "no",
           "o", "para", "por", "que", "se", "son", "su", "un", "una", "y"],
}

LEXICON = {
    "en": {"is": "AUX", "are": "AUX", "was": "AUX", "were": "AUX", "be": "AUX",
           "can": "AUX", "will": "AUX", "not": "PART", "and": "CCONJ", "or": "CCONJ",
           "but": "CCONJ", "the": "DET", "a": "DET", "an": "DET", "this": "DET",
           "that": "PRON", "it": "PRON", "he": "PRON", "she": "PRON", "they": "PRON",
           "we": "PRON", "you": "PRON", "i": "PRON", "of": "ADP", "to": "ADP",
           "in": "ADP", "on": "ADP", "at": "ADP", "for": "ADP", "with": "ADP",
           "by": "ADP", "from": "ADP", "as": "ADP", "good": "ADJ", "new": "ADJ",
           "very": "ADV"},
    "fr": {"est": "AUX", "sont": "AUX", "et": "CCONJ", "ou": "CCONJ", "le": "DET",
           "la": "DET", "les": "DET", "un": "DET", "une": "DET", "des": "DET",
           "du": "ADP", "de": "ADP", "dans": "ADP", "pour": "ADP", "par": "ADP",
           "avec": "ADP", "sur": "ADP", "au": "ADP", "aux": "ADP", "il": "PRON",
           "elle": "PRON", "qui": "PRON", "que": "PRON", "ce": "PRON", "pas": "ADV"},
    "de": {"ist": "AUX", "sind": "AUX", "und": "CCONJ", "oder": "CCONJ", "der": "DET",
           "die": "DET", "das": "DET", "ein": "DET", "eine": "DET", "den": "DET",
           "dem": "DET", "des": "DET", "zu": "ADP", "in": "ADP", "im": "ADP",
           "mit": "ADP", "von": "ADP", "auf": "ADP", "für": "ADP", "es": "PRON",
           "sie": "PRON", "er": "PRON", "nicht": "PART"},
    "es": {"es": "AUX", "son": "AUX", "y": "CCONJ", "o": "CCONJ", "el": "DET",
           "la": "DET", "los": "DET", "las": "DET", "un": "DET", "una": "DET",
           "de": "ADP", "del": "ADP", "en": "ADP", "con": "ADP", "por": "ADP",
           "para": "ADP", "al": "ADP", "que": "PRON", "se": "PRON", "su": "DET",
           "lo": "PRON", "no": "ADV"},
}

# Ordered suffix rules: the first suffix that matches a lemma longer than
# the suffix by at least two characters decides the POS.
SUFFIX_RULES = [
    ("mente", "ADV"), ("ment", "ADV"), ("ly", "ADV"), ("ing", "VERB"),
    ("ed", "VERB"), ("ieren", "VERB"), ("ir", "VERB"), ("ar", "VERB"),
    ("ous", "ADJ"), ("ful", "ADJ"), ("ive", "ADJ"), ("able", "ADJ"),
    ("lich", "ADJ"), ("isch", "ADJ"), ("eux", "ADJ"), ("oso", "ADJ"),
    ("tion", "NOUN"), ("ung", "NOUN"),
]
DEFAULT_POS = "NOUN"
NUM_POS = "NUM"
ENTITY_TYPE = "PROPER"
COMPOUND_DEP = "compound"
OTHER_DEP = "dep"


def stop_keys() -> list[str]:
    """``lang|lemma`` keys of all stop words."""
    return [f"{lang}|{w}" for lang, words in STOP_WORDS.items() for w in words]


def lexicon_items() -> list[tuple[str, str]]:
    """``(lang|lemma, pos)`` pairs of the lexicon."""
    return [(f"{lang}|{w}", pos) for lang, d in LEXICON.items() for w, pos in d.items()]
