from collections import Counter

import pytest
from pyspark.sql import functions as F

from splitloom.operators.heldout import REST
from splitloom.plans.configs import (
    SplitConfig,
    all_configs,
    configs_frame,
    guardian_configs,
    novel_configs,
    pan18_configs,
    reddit_configs,
    usable,
)
from splitloom.plans.matrix import matrix_splits, matrix_summary, run_config


def test_published_list(spark):
    configs = all_configs()
    assert Counter(c.loader for c in configs) == {
        "reuters": 8, "cmcc": 12, "guardian": 6, "imdb62": 8, "cl_novels": 2, "pan18": 10, "reddit": 10,
    }
    assert len({c.config_id for c in configs}) == 56
    frame = configs_frame(spark, configs)
    assert frame.count() == 56
    books = frame.where("config_id = 'guardian/Books>Politics+Society+World+UK'").first()
    assert books.train_values == ["Books"] and books.test_values == ["Politics", "Society", "World", "UK"]
    assert pan18_configs()[-1].problem == "problem00010"
    assert reddit_configs()[5].config_id == "reddit/R-CL3-PT/pt>en"
    assert reddit_configs()[5].corpus == "R-CL3-PT"
    world = [c for c in guardian_configs() if c.test_values == ("World",)]
    assert [c.train_values for c in world] == [("Politics", "Society", "UK")]


def test_bad_configurations():
    with pytest.raises(ValueError, match="both sides"):
        SplitConfig("x", "x", "x", domain="d", train_values=("a",), test_values=("a",))
    with pytest.raises(ValueError, match="no limits"):
        SplitConfig("x", "x", "x", test_language="en", max_targets=3)


@pytest.fixture(scope="module")
def docs(spark):
    """All corpora in one table; one author has a third of the documents."""
    i = F.col("doc_id")

    def pick(values, number):
        return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))

    corpora = sorted({c.corpus for c in all_configs()})
    mix = F.abs(F.xxhash64(i))

    def bits(divisor):
        return F.expr(f"abs(xxhash64(doc_id)) div {divisor}")

    table = spark.range(0, 6600, 1, 4).select(
        F.col("id").alias("doc_id"), pick(corpora, F.col("id")).alias("corpus")
    )
    table = table.select(
        "*",
        F.when(mix % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), mix % 5)).alias("author"),
        pick(["train", "test"], bits(7)).alias("data_type"),
        F.when(F.col("corpus") == "reuters-c50", pick(["train", "test"], bits(7)))
        .otherwise(pick(["Politics", "Society", "World", "UK", "Books"], bits(11))).alias("category"),
        pick(["B", "C", "D", "E", "P", "S", None], bits(13)).alias("genre"),
        pick(["C", "G", "I", "M", "P", "S", None], bits(17)).alias("topic"),
        F.format_string("problem%05d", bits(19) % 10 + 1).alias("problem"),
        F.when(F.col("corpus").startswith("R-CL"), F.lower(F.substring("corpus", 7, 2)))
        .otherwise(pick(["es", "de"], bits(23))).alias("other"),
        pick(["t1", "t2", "t3", "t4", "t5", "t6", "t7", "t8", "t9", None], bits(29)).alias("title"),
        bits(31).alias("draw"),
    )
    language = F.when(F.col("draw") % 2 == 0, "en").otherwise(F.col("other"))
    table = table.withColumn("language", language).drop("other", "draw")
    path = F.concat(F.lit("text_raw/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    bad = F.lit("text_raw/jeannaimard_en_000176.txt")
    return table.withColumn("text_path", F.when(F.col("doc_id") == 22, bad).otherwise(path)).cache()


def _own(docs, config):
    return docs.where(F.col("corpus") == config.corpus)


def test_matrix_equals_single_runs(docs):
    configs = all_configs()
    names = [c for c in configs if c.rule == "sides" and c.max_docs_per_target in (None, 5, 50)]
    names = names[:3] + names[5::6] + [c for c in configs if c.rule == "folds" and c.max_docs_per_target in (None, 20)]
    names += novel_configs()
    columns = ["config_id", "split_id", "role", "doc_id", "target"]
    found = matrix_splits(docs, configs, corpus="corpus", on_short="keep")
    found = found.where(F.col("config_id").isin([c.config_id for c in names]))
    together = Counter(tuple(r) for r in found.select(*columns, "not_in_split").collect())
    alone = Counter()
    for config in names:
        rows = run_config(_own(docs, config), config, on_short="keep")
        titled = "not_in_split" if config.rule == "titles" else F.lit(None)
        alone.update(tuple(r) for r in rows.select(*columns, titled).collect())
    assert together == alone
    assert {key[0] for key in together} == {c.config_id for c in names}


def test_summary_counts_what_the_runs_give(docs):
    configs = all_configs()
    summary = {r.config_id: r for r in matrix_summary(docs, configs, corpus="corpus").collect()}
    assert len(summary) == 56
    long = matrix_splits(docs, configs, corpus="corpus", on_short="keep")
    assert long.select("config_id").distinct().count() == 56
    long = long.where(~F.col("config_id").startswith("cl_novels/"))
    counted = long.groupBy("config_id").agg(
        F.countDistinct("split_id").alias("n_splits"),
        F.count_if(F.col("role") == "train").alias("n_train"),
        F.count_if(F.col("role") == "test").alias("n_test"),
    )
    for row in counted.collect():
        assert tuple(summary[row.config_id]) == tuple(row)
    for config in novel_configs():
        splits = run_config(_own(docs, config), config)
        sizes = Counter((r.role, r.split_id) for r in splits.collect())
        removed = Counter(r.not_in_split for r in splits.where("not_in_split is not null").collect())
        n_train = sum(n for (role, _), n in sizes.items() if role == "train")
        ids = {split for (role, split) in sizes if role == "test"} | {REST}
        found = summary[config.config_id]
        assert found.n_splits == len(ids)
        assert found.n_test == sum(n for (role, _), n in sizes.items() if role == "test")
        assert found.n_train == n_train * len(ids) - sum(removed.values())


def test_short_targets_are_errors_in_the_matrix(docs):
    configs = [SplitConfig("r", "reuters", "data/reuters-c50/processed", domain="category",
                           train_values=("train",), test_values=("test",), max_docs_per_target=5000)]
    with pytest.raises(Exception, match="fewer than 5000 documents of r, 0"):
        matrix_splits(docs, configs, corpus="corpus").collect()
    with pytest.raises(ValueError, match="max_targets"):
        matrix_splits(docs, [SplitConfig("r", "r", "x", n_splits=3, max_targets=2)])


def test_mislabelled_document_is_left_out(docs):
    path = docs.where(F.col("doc_id") == 22)
    for corpus, left in (("R-CL5-FR", 0), ("imdb62", 1), ("R-CL1-DE", 1)):
        assert usable(path.withColumn("corpus", F.lit(corpus)), F.col("corpus")).count() == left


def test_unknown_language_is_an_error(docs):
    config = reddit_configs()[0]
    with pytest.raises(ValueError, match="invalid test values of language: de"):
        run_config(_own(docs, config).where("language = 'en'"), config)
