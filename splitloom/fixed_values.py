"""Given by the corpora and their published experiment settings."""

# Category directories of the CMCC corpus, and the one directory read inside each.
CMCC_CATEGORIES = ("Blogs", "Chat", "Discussion", "Emails", "Essays", "Interviews")
CMCC_SUBDIRECTORY = "Correlated"

# Coding of CMCC file names: author, genre, number, topic, number.
CMCC_FILE_NAME = r"^([A-Z]\d+)([A-Z])\d+([A-Z])\d+.txt"

# The one CMCC file name with a digit where a letter belongs.
CMCC_RENAMED_FILES = {"S1D113.txt": "S1D1I3.txt"}

# Columns of the headerless IMDb62 table.
IMDB_COLUMNS = ("review_id", "author", "item_id", "rating", "title", "text_raw")

# Language codes that differ from ISO 639-1 in the PAN18 collection.
LANGUAGE_CODES = {"sp": "es"}

# Language assumed for corpora that do not state one.
DEFAULT_LANGUAGE = "en"

# Separator of truth files.
TRUTH_SEPARATOR = ":::"

# Sentences per chunk of a novel.
SENTENCES_PER_CHUNK = 500

# Folds when the caller names none.
DEFAULT_FOLDS = 5

# Training documents per author in the limited experiments.
DOCUMENT_CAPS = (5, 10, 15, 20, 30, 40, 50)

# Held-out values of the CMCC experiments.
CMCC_TOPICS = ("C", "G", "I", "M", "P", "S")
CMCC_GENRES = ("B", "C", "D", "E", "P", "S")

# Guardian sections: four topics of opinion pieces, and one other genre.
GUARDIAN_TOPICS = ("Politics", "Society", "World", "UK")
GUARDIAN_GENRES = ("Books",)

# Test languages of the novel experiments.
NOVEL_LANGUAGES = ("es", "en")

# Problems of the PAN18 experiments.
PAN18_PROBLEMS = 10

# Reddit corpora and the language each one pairs with English.
REDDIT_CORPORA = {
    "R-CL1-DE": "de",
    "R-CL2-ES": "es",
    "R-CL3-PT": "pt",
    "R-CL4-NL": "nl",
    "R-CL5-FR": "fr",
}

# A document of R-CL5-FR known to carry a wrong language.
REDDIT_MISLABELLED = ("text_raw/jeannaimard_en_000176.txt",)
REDDIT_MISLABELLED_CORPUS = "R-CL5-FR"

# Texts that a CSV reader of the pandas family takes for a missing value.
MISSING_MARKERS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
