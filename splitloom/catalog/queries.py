"""One query per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom.catalog.tables import all_corpora, documents, read
from splitloom.fixed_values import CMCC_RENAMED_FILES, GUARDIAN_GENRES, GUARDIAN_TOPICS, LANGUAGE_CODES
from splitloom.functions.text import encode_cp1252, remap
from splitloom.operators import audit, sentences, targets, validate
from splitloom.operators.cap import cap_docs_per_target as cap
from splitloom.operators.folds import attach_folds, fold_cuts
from splitloom.operators.folds import stratified_kfold as kfold
from splitloom.operators.heldout import split_heldout_titles
from splitloom.operators.heldout import title_overlap as overlap
from splitloom.operators.heldout import title_plan
from splitloom.operators.heldout import untested_titles as untested
from splitloom.operators.joins import attach_lookup, stored
from splitloom.operators.predicates import by_value_sets, leave_one_out, predefined
from splitloom.operators.predicates import exclude_rows as exclude
from splitloom.operators.prepare import chunk_documents as chunk
from splitloom.operators.prepare import drop_incomplete as drop_missing
from splitloom.operators.prepare import externalize_text as externalize
from splitloom.operators.prepare import with_doc_ids
from splitloom.plans import matrix
from splitloom.plans import splits as builders
from splitloom.plans.configs import all_configs, configs_frame
from splitloom.session import scratch_path
from splitloom.sources import trees
from splitloom.sources.corpora import load_corpus, write_corpus
from splitloom.sources.files import decoded, read_files, write_files
from splitloom.sources.problems import problem_documents
from splitloom.sources.tables import parse_truth, read_metadata, read_tsv
from splitloom.sources.xml import language_availability, xml_documents

LANGUAGES = ("de", "en", "es", "fr")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _in_language(docs: DataFrame, language: str) -> DataFrame:
    return docs.where(F.col("language") == language)


def _sides(sides: tuple[DataFrame, DataFrame], *columns: str) -> DataFrame:
    train, test = sides
    return builders.union_sides(train.select(*columns), test.select(*columns))


# --- builders -------------------------------------------------------------


@query
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return builders.train_test_split(
        _in_language(docs, "en"), _in_language(docs, "de"),
        max_targets=4, max_docs_per_target=7, on_short="keep",
    )


@query
def train_test_split_all_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train, test = leave_one_out(docs, "language", "fr")
    return builders.train_test_split(train, test, target="novelist")


@query
def cv_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return builders.cv_split(documents(spark, sf_dir))


@query
def cv_split_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return builders.cv_split(docs, max_targets=4, max_docs_per_target=7)


@query
def split_heldout_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "language", "title", "novelist")
    return split_heldout_titles(docs, LANGUAGES, author="novelist")


@query
def heldout_title_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_plan(documents(spark, sf_dir), LANGUAGES, author="novelist")


@query
def heldout_title_plan_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return title_plan(documents(spark, sf_dir), LANGUAGES, require_coverage=True, author="novelist")


# --- targets and caps -----------------------------------------------------


@query
def attach_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "author", F.col("language").alias("y_0"))
    attached, name = targets.attach_target(docs, F.col("author"))
    return attached.select("doc_id", "y_0", name)


@query
def distinct_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.distinct_targets(documents(spark, sf_dir), "novelist")


@query
def select_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = targets.distinct_targets(documents(spark, sf_dir))
    return targets.select_targets(authors, 7)


@query
def restrict_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "language", "novelist")
    train = targets.distinct_targets(_in_language(docs, "de"), "novelist")
    return targets.restrict_targets(_in_language(docs, "en"), train, "novelist")


@query
def cap_docs_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "author")
    return cap(docs, 10)


@query
def cap_orders_per_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return cap(orders, 50, "o_orderpriority", "o_orderkey", ["o_orderstatus"], on_short="keep")


@query
def docs_per_target_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return targets.docs_per_target_bounds(documents(spark, sf_dir), "novelist", "language")


@query
def union_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    train = _in_language(docs, "en").select("doc_id", "author")
    test = _in_language(docs, "de").select("title", "author", "doc_id")
    return builders.union_sides(train, test)


# --- split predicates -----------------------------------------------------


@query
def split_predefined(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _sides(predefined(docs, "data_type"), "problem", "doc_id", "author")


@query
def split_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return _sides(leave_one_out(docs, "topic", "C"), "doc_id", "topic", "author")


@query
def split_by_value_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    sides = by_value_sets(docs, "category", GUARDIAN_TOPICS, GUARDIAN_GENRES)
    return _sides(sides, "doc_id", "category", "author")


@query
def exclude_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = read(spark, sf_dir, "labels").where("toxic = 1")
    return exclude(documents(spark, sf_dir).select("doc_id", "author"), "doc_id", toxic)


@query
def resolve_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.regexp_extract("url", r"://[^/]+/([a-z]+)/", 1)
    pages = read(spark, sf_dir, "pages").select(url.alias("language"))
    return language_availability(documents(spark, sf_dir), pages, "language")


# --- folds ----------------------------------------------------------------


@query
def stratified_kfold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(documents(spark, sf_dir))


@query
def stratified_kfold_novelists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(documents(spark, sf_dir), "novelist", 2)


@query
def stratified_kfold_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(documents(spark, sf_dir), "language", 7)


@query
def stratified_kfold_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").withColumn(
        "doc_id", F.col("conv_id") * 1_000_000 + F.col("turn")
    )
    return kfold(turns, "role")


@query
def stratified_kfold_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold(read(spark, sf_dir, "embeddings"), "label", 10, "vec_id")


@query
def stratified_kfold_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    # Small buckets, so that the ranges of order keys matter at every scale.
    return kfold(orders, "o_orderpriority", 5, "o_orderkey", rows_per_bucket=1000)


@query
def fold_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folded = attach_folds(docs, fold_cuts(docs))
    return folded.select("doc_id", "fold", "title", F.md5("text").alias("text_md5"))


# --- titles ---------------------------------------------------------------


@query
def title_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = leave_one_out(documents(spark, sf_dir), "language", "de")
    return overlap(train, test)


@query
def untested_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return untested(documents(spark, sf_dir), ("es", "en"), author="novelist")


# --- validation -----------------------------------------------------------


def _raw_sides(docs: DataFrame, *columns: str) -> DataFrame:
    """Splits by problem as they are, unseen targets included."""
    return docs.select(
        F.col("problem").alias("split_id"), F.col("data_type").alias("role"), "doc_id",
        F.col("novelist").alias("target"), *columns,
    )


@query
def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.split_summary(_raw_sides(documents(spark, sf_dir)))


@query
def validate_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.validate_splits(_raw_sides(documents(spark, sf_dir)))


@query
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    splits = _raw_sides(documents(spark, sf_dir), F.md5("text").alias("text_md5"))
    return validate.split_leakage(splits, "text_md5")


@query
def fold_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    folded = attach_folds(docs.select("doc_id", "author", F.md5("text").alias("text_md5")), fold_cuts(docs))
    return validate.fold_leakage(folded, "text_md5", 5)


@query
def validate_language_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    test = F.col("language") == "de"
    clean = docs.select(
        F.lit("held out").alias("split_id"),
        F.when(test, F.lit("test")).otherwise(F.lit("train")).alias("role"), "language",
    )
    mixed = docs.select(F.col("problem").alias("split_id"), F.col("data_type").alias("role"), "language")
    return validate.validate_language_split(clean.unionByName(mixed))


@query
def validate_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("target", F.col("author"))
    # Titles start with the author; as paths of novels they lack the novelist.
    docs = docs.withColumn("stanza", F.concat(F.lit("stanza/"), "title"))
    by_author = validate.validate_paths(docs).withColumn("check", F.lit("author"))
    by_novelist = validate.validate_paths(docs, target="novelist").withColumn("check", F.lit("novelist"))
    return by_author.unionByName(by_novelist)


def _titles_in_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return split_heldout_titles(docs, LANGUAGES, author="novelist")


@query
def title_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and targets of every held-out title split, from the compact form."""
    return validate.title_split_summary(_titles_in_languages(spark, sf_dir))


@query
def validate_title_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = validate.title_split_summary(_titles_in_languages(spark, sf_dir))
    return validate.violations(summary, ("test_language", "split_id"))


@query
def validate_title_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    languages = documents(spark, sf_dir).select("doc_id", "language")
    assigned = _titles_in_languages(spark, sf_dir).join(languages, "doc_id")
    return validate.title_split_languages(assigned)


@query
def language_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.language_audit(documents(spark, sf_dir))


@query
def detect_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles are learnt from thirteen sixteenths of the documents and applied to all."""
    docs = documents(spark, sf_dir).withColumn("held_out", F.md5(F.col("doc_id").cast("string")) < "3")
    profiles = audit.train_profiles(docs.where("NOT held_out"))
    found = audit.detect_language(docs, profiles)
    return docs.select("doc_id", "language", "held_out").join(found, "doc_id")


# --- preparation ----------------------------------------------------------


@query
def scan_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "metadata")
    table = documents(spark, sf_dir).select(
        F.col("doc_id").alias("Unnamed: 0"), "author", "language", "topic",
        F.col("text_path").alias("text_raw"),
        F.concat(F.lit("/parsed/"), F.col("doc_id").cast("string"), F.lit(".pckl")).alias("stanza"),
    )
    table.write.option("header", "true").csv(f"{root}/dataset.csv")
    return read_metadata(spark, root).select(
        "author", "language", "topic",
        F.substring_index("text_raw", "/", -2).alias("text_raw"),
        F.col("text_raw").startswith(root).alias("under_root"), "stanza",
    )


@query
def drop_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "author", "topic", "text")
    labelled = attach_lookup(docs, read(spark, sf_dir, "labels"), {"doc_id": "doc_id"}, "keep")
    return drop_missing(labelled).select("doc_id", "author", "topic", "quality", F.md5("text").alias("text_md5"))


@query
def remap_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    raw = F.when(F.col("language") == "es", F.lit("sp")).otherwise(F.col("language"))
    coded = docs.select("doc_id", raw.alias("code"))
    return coded.select("doc_id", "code", remap(F.col("code"), LANGUAGE_CODES).alias("language"))


@query
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "author", "language", "title", "text")
    return chunk(docs, 5).select("doc_id", F.col("chunk").cast("long").alias("chunk"), "text_path", "text")


def _abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with an abbreviation and an ellipsis in place of some commas, as they have none of their own."""
    docs = documents(spark, sf_dir).select("doc_id", "author", "language", "title", "text")
    short = F.when(F.col("language") == "de", F.lit(" bzw. ")).otherwise(F.lit(", Mr. "))
    kinds = F.when(F.col("doc_id") % 3 == 0, F.lit("... ")).when(F.col("doc_id") % 3 == 1, short).otherwise(F.lit(", "))
    return docs.withColumn("text", F.replace("text", F.lit(", "), kinds))


@query
def train_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abbreviations and sentence starters of each language, with the counts that they follow from."""
    docs = _abbreviated(spark, sf_dir)
    counts = stored(sentences.word_counts(docs))
    short = sentences.abbreviations(counts)
    known = sentences.words_by_language(short)
    starters = sentences.sentence_starters(docs, counts, known)
    return short.select("language", F.lit("abbreviation").alias("kind"), "word", F.col("n_period").alias("n"), F.col("n_plain").alias("n_other")).unionByName(
        starters.select("language", F.lit("starter").alias("kind"), "word", F.col("n_after").alias("n"), F.col("n_all").alias("n_other"))
    )


@query
def split_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _abbreviated(spark, sf_dir)
    model = sentences.train_sentences(docs)
    found = docs.select("doc_id", sentences.split_sentences(F.col("text"), F.col("language"), model).alias("found"))
    return found.select(
        "doc_id", F.size("found").cast("long").alias("n_sentences"), F.md5(F.array_join("found", "|")).alias("sentences_md5")
    )


@query
def externalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "author", "topic", "text")
    output = scratch_path(spark, "corpus")
    write_corpus(externalize(docs), output)
    return load_corpus(spark, output, with_text=True)


@query
def number_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each path with its number in the order of the paths."""
    return with_doc_ids(documents(spark, sf_dir).select(F.col("text_path").alias("path")))


# --- raw corpora ----------------------------------------------------------


def _packed(docs: DataFrame, *parts: object) -> DataFrame:
    """Documents as raw files: a path and windows-1252 or UTF-8 bytes."""
    return docs.select(F.concat_ws("/", *parts).alias("path"), F.encode("text", "UTF-8").alias("content"))


def _file_name(prefix: str = "", suffix: str = ".txt"):
    return F.concat(F.lit(prefix), F.col("doc_id").cast("string"), F.lit(suffix))


@query
def decode_cp1252(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = F.concat(F.lit("“"), F.replace("text", F.lit(", "), F.lit(" – ")), F.lit("”"))
    files = documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("path"), encode_cp1252(quoted).alias("content")
    )
    raw = files.withColumn("n_bytes", F.octet_length("content"))
    return decoded(raw, "cp1252").select("path", F.col("n_bytes").cast("long").alias("n_bytes"), "text")


@query
def scan_labelled_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    files = docs.select(
        F.concat_ws("/", "category", "author", _file_name()).alias("path"), encode_cp1252(F.col("text")).alias("content")
    )
    return trees.labelled_tree(files)


@query
def scan_train_test_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return trees.train_test_tree(_packed(docs, F.concat(F.lit("C50"), "data_type"), "author", _file_name()))


@query
def scan_language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    name = F.concat("title", F.lit(" vol."), F.col("doc_id").cast("string"), F.lit(".txt"))
    return trees.language_tree(_packed(docs, "author", "language", name))


@query
def filename_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    code = F.concat(
        F.lit("S"), F.substring("author", 4, 9), "genre", F.lit("1"),
        F.coalesce("topic", F.lit("X")), (F.col("n_chars") % 4).cast("string"), F.lit(".txt"),
    )
    typos = {right: wrong for wrong, right in CMCC_RENAMED_FILES.items()}
    files = docs.select("doc_id", F.concat_ws("/", F.lit("Chat"), F.lit("Correlated"), remap(code, typos)).alias("path"))
    return trees.filename_attributes(files)


@query
def scan_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    table = documents(spark, sf_dir).select("doc_id", "author", "title", "n_chars", "language", "text")
    table.write.options(
        sep="\t", quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    ).csv(path)
    # Texts have line breaks in quotes; the parts Spark wrote are read in parallel.
    return read_tsv(spark, path, multi_line=True)


@query
def scan_xml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    # Every line is a document of its own.
    body = F.replace(text, F.lit("\n"), F.lit("</document><document>"))
    xml = F.concat(
        F.lit("<author><documents><document>"), body, F.lit("</document></documents></author>")
    )
    files = documents(spark, sf_dir).select(
        F.concat_ws("/", F.lit("pan-train"), "language", F.concat("author", F.lit(".xml"))).alias("path"),
        F.encode(xml, "UTF-8").alias("content"),
    )
    found = xml_documents(files, "documents/document")
    return found.select("language", "author", F.col("position").cast("long").alias("position"), "text")


@query
def scan_xml_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text before the first child, and none in empty elements, at any depth of each document's own file."""
    text = F.col("text")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    # Of each line the first word stands before a child; every line is followed by an empty element.
    line = F.concat(
        F.lit("<s><p>"), F.substring_index(F.col("line"), " ", 1), F.lit("<b>inner</b>"), F.col("line"), F.lit("</p></s><p/>")
    )
    lines = documents(spark, sf_dir).select("doc_id", "language", F.posexplode(F.split(text, "\n")).alias("i", "line"))
    grouped = lines.select("doc_id", "language", "i", line.alias("xml")).groupBy("doc_id", "language").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("i", "xml"))).getField("xml"), "").alias("xml")
    )
    files = grouped.select(
        F.concat_ws("/", F.lit("pan-train"), "language", F.concat(F.col("doc_id").cast("string"), F.lit(".xml"))).alias("path"),
        F.encode(F.concat(F.lit("<a>"), "xml", F.lit("</a>")), "UTF-8").alias("content"),
    )
    found = xml_documents(files, ".//p")
    return found.select("language", F.col("author").cast("long").alias("author"), F.col("position").cast("long").alias("position"), "text")


@query
def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a file of its own, some with names that a scan skips, some hidden; written, listed and read."""
    number = F.col("doc_id") % 7
    author = F.when(number == 0, F.concat(F.lit("_"), "author")).when(number == 3, F.concat(F.lit("."), "author")).otherwise(F.col("author"))
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, "_").otherwise(""), "title", F.col("doc_id").cast("string"), F.lit(".txt"))
    root = scratch_path(spark, "files")
    write_files(_packed(documents(spark, sf_dir), author, "language", name), root)
    return trees.language_tree(read_files(spark, root))


@query
def parse_delimited_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").where("quality is not null and toxic is not null")
    stale = labels.select(F.concat_ws(":::", "doc_id", F.lit("9"), F.lit("9")).alias("value"), F.lit(0).alias("position"))
    fresh = labels.select(
        F.concat(F.lit("  "), F.concat_ws(":::", "doc_id", "quality", "toxic"), F.lit(" ")).alias("value"),
        F.lit(1).alias("position"),
    )
    return parse_truth(fresh.unionByName(stale), ["author", "quality", "toxic"])


@query
def join_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "author", "language")
    return attach_lookup(docs, read(spark, sf_dir, "labels"), {"doc_id": "doc_id"}, "keep")


@query
def scan_problem_collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    spanish = F.col("problem").substr(-1, 1).isin("2", "4", "6", "8", "0")
    collection = docs.select("problem").distinct().withColumn(
        "language", F.when(spanish, F.lit("sp")).otherwise(F.lit("en"))
    )
    candidate = F.concat(F.lit("candidate"), "author")
    train, test = predefined(docs, "data_type")
    files = _packed(train, "problem", candidate, _file_name("known")).unionByName(
        _packed(test, "problem", F.lit("unknown"), _file_name("unknown"))
    )
    entry = F.struct(_file_name("unknown").alias("unknown-text"), candidate.alias("true-author"))
    raw_truth = test.select("problem", F.to_json(F.struct(F.array(entry).alias("ground_truth"))).alias("json"))
    schema = "ground_truth ARRAY<STRUCT<`unknown-text`: STRING, `true-author`: STRING>>"
    truth = raw_truth.select("problem", F.from_json("json", schema).getField("ground_truth").alias("ground_truth"))
    return problem_documents(collection, truth, files)


# --- the matrix -----------------------------------------------------------


@query
def config_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    configs = all_configs()
    listed = configs_frame(spark, configs).select(
        "config_id", "loader", "path", "domain", "test_domain",
        F.array_join("train_values", ",").alias("train_values"),
        F.array_join("test_values", ",").alias("test_values"),
        "problem", "test_language", "n_splits", "max_docs_per_target",
    )
    matching = matrix.matching_documents(all_corpora(spark, sf_dir), configs, "corpus")
    return listed.join(matching, "config_id", "left")


@query
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = all_corpora(spark, sf_dir)
    return matrix.matrix_summary(docs, all_configs(), corpus="corpus")


@query
def matrix_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = all_corpora(spark, sf_dir)
    return matrix.matrix_splits(docs, all_configs(), corpus="corpus", on_short="keep")
