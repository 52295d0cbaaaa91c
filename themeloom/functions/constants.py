"""They must stay as they are for results to be comparable across runs and tools."""

# --- Fixed values: whitespace, spelled out because engines differ in what \s covers --------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
LINE_ENDS = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"

# --- Fixed values: cleaning patterns, applied in this order to lower-cased text in which -----
# --- every whitespace character has become a space ------------------------------------------
REDACTION_RUN = r"x{2,}"
DOLLAR_AMOUNT = r"\$[\p{Nd},]+\.?\p{Nd}*"
URL = r"http[^ ]+|www\.[^ ]+"
EMAIL = r"[^ ]+@[^ ]+"
NON_LETTERS = r"[^a-z]+"

# --- Fixed values: display patterns -------------------------------------------------------
MASKED_RUN = r"X{2,}(?:[/\-]X{2,})*"
BRACED_AMOUNT = r"\{(\$[\p{Nd},.]+)\}"
REDACTED = "[redacted]"

# --- Fixed values: contractions that the tokeniser splits, as (head, tail) ----------------
CONTRACTIONS = [
    ("can", "not"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"), ("wan", "na"),
]

# --- Fixed values: stopwords --------------------------------------------------------------
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she
her hers herself it its itself they them their theirs themselves what which who whom this that
these those am is are was were be been being have has had having do does did doing a an the and
but if or because as until while of at by for with about against between into through during
before after above below to from up down in out on off over under again further then once here
there when where why how all any both each few more most other some such no nor not only own same
so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn hadn
hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn
""".split()
DOMAIN_STOPWORDS = """
company consumer account would told said also get got im ive us please even still back make made
much since
""".split()

# --- Fixed values: noun endings, as (ending, replacement) ---------------------------------
NOUN_ENDINGS = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"),
    ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
# Words on -s that are no plurals.
INVARIANT_NOUNS = (
    "news series species means perhaps always besides thus plus bus gas lens status bonus virus campus census focus "
    "basis analysis crisis thesis physics mathematics economics politics ethics yes"
).split()
IRREGULAR_NOUNS = {
    "women": "woman", "children": "child", "feet": "foot", "teeth": "tooth", "geese": "goose",
    "mice": "mouse", "lives": "life", "wives": "wife", "knives": "knife", "selves": "self",
    "thieves": "thief", "halves": "half", "analyses": "analysis", "bases": "basis",
    "crises": "crisis", "criteria": "criterion", "indices": "index", "matrices": "matrix",
}

# --- Fixed values: words read as a missing value in delimited files -----------------------
MISSING_WORDS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: the sentence that opens every report (total, model, topic name, percent,
# --- documents in it, remaining documents, other topics) ------------------------------------
SUMMARY_SENTENCE = (
    "Across %s complaints analyzed with %s, the largest topic — \"%s\" — accounts for %d%% of documents "
    "(%s complaints). The remaining %s complaints are distributed across the other %d topics, "
    "suggesting a mix of dominant and long-tail complaint themes."
)

# --- Fixed values: parameters -------------------------------------------------------------
MIN_WORDS, SAMPLE_SIZE, SEED = 15, 30_000, 42
MIN_TOKEN_LENGTH = 3
MAX_FEATURES, MIN_DF, MAX_DF = 5_000, 5, 0.9
N_TOPICS, SWEEP_RANGE = 11, range(4, 13)
LDA_PASSES, LDA_BATCH, LDA_OFFSET, LDA_DECAY = 20, 128, 10.0, 0.7
NMF_MAX_ITERATIONS, NMF_TOLERANCE = 500, 1e-4
COHERENCE_WINDOW, COHERENCE_EPSILON = 110, 1e-12
TOP_WORDS, MAP_TERMS = 10, 30
NEAR_EMPTY_SHARE = 0.02
SHEET_EXAMPLES, SHEET_CHARS, SHEET_SEED = 3, 350, 2026
QUOTE_CHARS = 700
LENGTH_BINS = 40
MODELS = ["NMF", "LDA"]
