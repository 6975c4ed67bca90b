"""Secret scans: candidates by shape, false positives removed by a random forest."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from splitloom.llm.common import kept, let, texts_of, words_of

LEAST_LENGTH = 16
#: Bound of the labelled findings that fit the forest, and its size.
LABELLED, TREES, DEPTH = 20_000, 20, 6
DICTIONARY_WORDS = 400
THRESHOLD = 0.5
MASK = "[SECRET]"

RUN = "[A-Za-z0-9+/_-]{16,}"
#: Words that name secrets, and words that name other long tokens.
SECRET_NAMES = "token|secret|passw|pwd|api.?key|access.?key|auth|bearer|credential|private"
OTHER_NAMES = "sha|md5|commit|hash|digest|checksum|uuid|guid|example|sample|dummy|placeholder|version|id"
#: Shapes of keys that their issuers publish.
ISSUED = (
    "^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^sk_(live|test)_[A-Za-z0-9]{16,}$"
    "|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{35}$"
)

#: The same shapes within a word.
ISSUED_WITHIN = (
    "(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]{16,}"
    "|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})(?![A-Za-z0-9])"
)
#: A character of a name, and what may close one; each run of such characters is read once.
_IN_NAME, _CLOSE = "[^\\s\"'`=:,;{}()\\[\\]&?<>|\\\\]", "[\"'`)\\]\\\\]*+"
_NAME = f"(?<!{_IN_NAME})(?={_IN_NAME}*?(?:{SECRET_NAMES})){_IN_NAME}++"
_SIGN = "(?:=>|:=|={1,3}|:)"
#: A value after its opening quote, if any: up to the closing quote, else all that is no white space or quote
#: but punctuation at the end.
_VALUE = (
    "\\\\?[\"'`]?((?<=\")[^\\s\"]+(?=\")|(?<=')[^\\s']+(?=')|(?<=`)[^\\s`]+(?=`)|(?<=[\"'`])[^\\s\"'`]+"
    "|(?<![\"'`])[^\\s\"'`]*[^\\s\"'`,;.:?()\\[\\]{}<>])"
)
#: Names and values in one word; then the ends of the words before, with what the word itself must begin with.
ASSIGNED_WITHIN = f"(?i){_NAME}{_CLOSE}{_SIGN}(?={_VALUE})"
ASSIGNED_AFTER = (
    (f"(?i){_NAME}(?:\\s++{_IN_NAME}++)?{_CLOSE}\\s*{_SIGN}$", f"^{_VALUE}"),
    (f"(?i){_NAME}(?:\\s++{_IN_NAME}++)?{_CLOSE}$", f"^{_SIGN}{_VALUE}"),
    ("(?i)(api|access)$", f"(?i)^key{_IN_NAME}*+{_CLOSE}{_SIGN}{_VALUE}"),
)
#: The password of a URL.
URL_VALUE = "://[^\\s/:@\"']*:([^\\s/\"'<>]+)@"
#: Texts without any of these have runs only.
SOME = f"(?i){SECRET_NAMES}|://|xox|AKIA|ASIA|gh[pousr]_|sk_|AIza"

FEATURES = (
    "length", "digits", "uppers", "lowers", "signs", "transitions", "variety", "coverage", "in_path",
    "secret_name", "other_name", "assigned", "quoted", "credential",
)


def _beyond_runs(word: Column, head: Column) -> Column:
    """Values of a word by what names them or by an issued shape, whatever their length; `head` is the words before."""
    after = [
        F.when(head.rlike(names), F.regexp_extract_all(word, F.lit(begin), F.lit(1))).otherwise(F.array().cast("array<string>"))
        for names, begin in ASSIGNED_AFTER
    ]
    within = [F.regexp_extract_all(word, F.lit(shape), F.lit(1)) for shape in (ASSIGNED_WITHIN, URL_VALUE, ISSUED_WITHIN)]
    return F.filter(F.concat(*within, *after), lambda value: value != "")


def candidates(text: Column) -> Column:
    """An array of structs for what may be a secret: its place, word and neighbours.

    These are the runs of at least 16 token characters, and, of any length and with any signs, values that
    follow the name of a secret, passwords of URLs and issued shapes. A value ends with its word.
    """

    def places(words: Column, test) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), test)

    def runs_of(word: Column) -> Column:
        return F.regexp_extract_all(word, F.lit(f"({RUN})"), F.lit(1))

    def listed(words: Column, i: Column, values: Column, first: Column) -> Column:
        return F.transform(
            values,
            lambda value, n: F.struct(
                i.alias("word"),
                (first + n).alias("part"),
                value.alias("value"),
                F.get(words, i).alias("around"),
                F.concat_ws(" ", F.get(words, i - 2), F.get(words, i - 1)).alias("before"),
                F.coalesce(F.get(words, i + 1), F.lit("")).alias("after"),
            ),
        )

    def long_runs(words: Column) -> Column:
        long = places(words, lambda i: (F.octet_length(F.get(words, i)) >= LEAST_LENGTH) & F.get(words, i).rlike(RUN))
        return F.flatten(F.transform(long, lambda i: listed(words, i, runs_of(F.get(words, i)), F.lit(0))))

    def others(words: Column) -> Column:
        some = places(
            words,
            lambda i: F.get(words, i).rlike(f"[=:]|{ISSUED_WITHIN}")
            | F.coalesce(F.get(words, i - 1).rlike("[=:]>?$"), F.lit(False)),
        )

        def rest(i: Column) -> Column:
            head = F.concat_ws(" ", F.get(words, i - 3), F.get(words, i - 2), F.get(words, i - 1))
            runs = runs_of(F.get(words, i))
            values = F.array_except(_beyond_runs(F.get(words, i), head), runs)
            return listed(words, i, values, F.size(runs))

        return F.flatten(F.transform(some, rest))

    def found(words: Column) -> Column:
        return F.when(text.rlike(SOME), F.concat(long_runs(words), others(words))).otherwise(long_runs(words))

    return let(words_of(text), lambda w: F.when(F.size(w) > 0, found(w)))


def common_words(texts: DataFrame, most: int = DICTIONARY_WORDS) -> list[str]:
    """The words of two to eight letters that occur most often in all texts; ties in order of the words."""
    words = texts.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    counts = words.where(F.length("word").between(2, 8)).groupBy("word").count()
    return [row.word for row in counts.orderBy(F.desc("count"), "word").limit(most).collect()]


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def _quoted(value: Column) -> Column:
    """A pattern for the value itself."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def with_features(findings: DataFrame, dictionary: list[str]) -> DataFrame:
    """Add what the forest sees of value, around, before and after."""
    value, around = F.col("value"), F.col("around")
    # Short values may also be part of their name.
    assigned = F.regexp_substr(around, F.concat(F.lit("(?s)^.*?[=:][\"'`\\\\]*"), _quoted(value)))
    ahead = F.left(assigned, F.length(assigned) - F.length(value))
    named = F.concat_ws(" ", "before", F.coalesce(ahead, F.expr("substring_index(around, value, 1)")))
    credential = around.rlike(URL_VALUE) & F.array_contains(F.regexp_extract_all(around, F.lit(URL_VALUE), F.lit(1)), value)
    known = "|".join(sorted(dictionary, key=lambda w: (-len(w), w))) or "(?!)"
    covered = 1 - F.length(F.regexp_replace(F.lower(value), known, "")) / F.length(value)
    changes = "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"
    return findings.withColumns(
        {
            "length": F.length(value).cast("double"),
            "digits": _share(value, "[0-9]"),
            "uppers": _share(value, "[A-Z]"),
            "lowers": _share(value, "[a-z]"),
            "signs": _share(value, "[+/_-]"),
            "transitions": F.regexp_count(value, F.lit(changes)) / F.greatest(F.length(value) - 1, F.lit(1)),
            "variety": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
            "coverage": covered,
            "in_path": around.rlike("://|@|/[^/]+/|\\.(com|org|net|html?)").cast("double"),
            "secret_name": named.rlike(f"(?i)({SECRET_NAMES})").cast("double"),
            "other_name": named.rlike(f"(?i)\\b({OTHER_NAMES})\\b").cast("double"),
            "assigned": named.rlike("[=:]\\s*[\"']?$").cast("double"),
            "quoted": around.rlike("^[\"'`]|=[\"'`]").cast("double"),
            "credential": credential.cast("double"),
        }
    )


def labels_by_shape() -> Column:
    """Labels of findings that need no judgement: 1 for issued key shapes, passwords of URLs and named, assigned
    random values, 0 for words, numbers and addresses; else NULL, as for the rest of a URL with a password and
    for quoted words that a secret's name is given."""
    value, around, digits = F.col("value"), F.col("around"), F.col("digits")
    given = (F.col("secret_name") == 1) & (F.col("assigned") == 1)
    named = given & (digits > 0.1)
    open_ = around.rlike(URL_VALUE) | given & (F.col("quoted") == 1) & (digits == 0)
    return (
        F.when(value.rlike(ISSUED) | (F.col("credential") == 1) | named & ~value.rlike("^[0-9]+$"), F.lit(1.0))
        .when(open_, F.lit(None).cast("double"))
        .when((digits == 0) | value.rlike("^[0-9/+_-]+$") | around.contains("@"), F.lit(0.0))
    )


def fit_forest(labelled: DataFrame, most: int = LABELLED) -> PipelineModel | float:
    """A forest over at most `most` findings with `label`; with one class or none, its constant probability.

    Half of the sample at most is of one class, so that rare secrets count.
    """
    known = labelled.where("label IS NOT NULL").select("label", *FEATURES, "value", "around", "before")
    order = [F.xxhash64("value", "around", "before"), "value", "around", "before"]
    halves = [known.where(F.col("label") == side).orderBy(*order).limit(most // 2) for side in (0.0, 1.0)]
    sample = kept(halves[0].unionByName(halves[1]), "secrets-sample")
    classes = [row.label for row in sample.select("label").distinct().collect()]
    if len(classes) < 2:
        return classes[0] if classes else 0.0
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="__x")
    forest = RandomForestClassifier(
        featuresCol="__x", labelCol="label", probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__got",
        numTrees=TREES, maxDepth=DEPTH, seed=7,
    )
    return PipelineModel([assembler, forest.fit(assembler.transform(sample))])


def rated(findings: DataFrame, model: PipelineModel | float) -> DataFrame:
    """Add probability and is_secret; the forest has no say over shapes that only an issued key has."""
    if isinstance(model, float):
        scored = findings.withColumn("probability", F.lit(model))
    else:
        got = model.transform(findings).withColumn("probability", F.get(vector_to_array("__p"), F.lit(1)))
        scored = got.drop("__x", "__p", "__raw", "__got")
    return scored.withColumn("is_secret", (F.col("probability") >= THRESHOLD) | F.col("value").rlike(ISSUED))


def _listed(rows: DataFrame, *keys: str) -> DataFrame:
    found = rows.select(*keys, F.explode(candidates(F.col("text"))).alias("found"))
    return found.select(*keys, "found.*")


def scan(docs: DataFrame, labelled: DataFrame | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per candidate: doc_id, word, part, value, around, before, after, features, probability, is_secret.

    `labelled` holds earlier findings (value, around, before, after, label); without it,
    those of the scan whose shape needs no judgement are learnt from. NULL and empty
    texts have no candidates. Every row of a repeated id is scanned. Further
    columns of the input are left out.
    """
    texts = texts_of(docs, id_column, text_column)
    dictionary = common_words(texts)
    found = kept(with_features(_listed(texts, "doc_id"), dictionary), "secrets")
    known = found.withColumn("label", labels_by_shape()) if labelled is None else with_features(labelled, dictionary)
    return rated(found, fit_forest(known))


def _masked(text: Column, secrets: Column) -> Column:
    """The text with its secrets, structs of word and value, replaced.

    Long values, and those of letters and digits, are replaced wherever the text has them, the longest first;
    others, that may be words of the text, in their own word only.
    """
    value = lambda s: s["value"]
    rare = lambda v: (F.length(v) >= LEAST_LENGTH) | (F.length(v) >= 8) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    longest = lambda values: F.transform(
        F.sort_array(F.transform(values, lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), lambda x: x["v"]
    )

    def placed(pieces: Column) -> Column:
        own = lambda i: F.transform(F.filter(secrets, lambda s: s["word"] == i), value)
        shape = lambda values: F.concat_ws("|", F.transform(longest(values), _quoted))
        masked = lambda p, i: let(
            own(i), lambda values: F.when(F.size(values) > 0, F.regexp_replace(p, shape(values), F.lit(MASK))).otherwise(p)
        )
        return F.array_join(F.transform(pieces, masked), "")

    space = "[ \\t-\\r]"
    pieces = F.regexp_extract_all(text, F.lit(f"{space}*[^ \\t-\\r]+|{space}+"), F.lit(0))
    at_place = F.when(F.exists(secrets, lambda s: ~rare(value(s))), placed(pieces)).otherwise(text)
    anywhere = longest(F.array_distinct(F.filter(F.transform(secrets, value), rare)))
    return F.aggregate(anywhere, at_place, lambda t, v: F.replace(t, v, F.lit(MASK)))


def redact(docs: DataFrame) -> DataFrame:
    """`docs` with each secret in `text` replaced by a mask; all rows and columns stay, n_chars follows the text.

    Rows without candidates go through as they are; the others meet their secrets
    again by row, and only they are shuffled.
    """
    columns = docs.columns
    texts = texts_of(docs)
    dictionary = common_words(texts)
    marked = docs.withColumn("__found", candidates(F.coalesce("text", F.lit(""))))
    some = F.coalesce(F.size("__found") > 0, F.lit(False))
    plain = marked.where(~some).drop("__found")
    hit = kept(marked.where(some), "secrets-rows")
    hit = hit.withColumns({"__file": F.col("_metadata.file_path"), "__row": F.col("_metadata.row_index")})
    found = hit.select("__file", "__row", F.explode("__found").alias("found")).select("__file", "__row", "found.*")
    found = kept(with_features(found, dictionary), "secrets")
    model = fit_forest(found.withColumn("label", labels_by_shape()))
    values = rated(found, model).where("is_secret").groupBy("__file", "__row").agg(
        F.collect_set(F.struct("word", "value")).alias("__values")
    )
    joined = hit.join(values, ["__file", "__row"], "left")
    text = F.when(F.col("__values").isNull(), F.col("text")).otherwise(_masked(F.col("text"), F.col("__values")))
    changed = {"text": text}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("__values").isNull(), F.col("n_chars")).otherwise(F.length(text).cast("long"))
    masked = joined.withColumns(changed)
    names = [f"`{c}`" for c in columns]
    return plain.select(*names).unionByName(masked.select(*names))
