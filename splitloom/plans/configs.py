"""Split configurations as data, and the published list of them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from splitloom import schema
from splitloom.fixed_values import (
    CMCC_GENRES,
    CMCC_TOPICS,
    DEFAULT_FOLDS,
    DOCUMENT_CAPS,
    GUARDIAN_GENRES,
    GUARDIAN_TOPICS,
    NOVEL_LANGUAGES,
    PAN18_PROBLEMS,
    REDDIT_CORPORA,
    REDDIT_MISLABELLED,
    REDDIT_MISLABELLED_CORPUS,
)


@dataclass(frozen=True)
class SplitConfig:
    """One way to split one corpus. The fields that are set decide the rule.

    `test_domain`: leave one value of the column `domain` out. `train_values` and
    `test_values`: sides as sets of values of that column, within one `problem`
    if given. `n_splits`: stratified folds. `test_language`: held-out titles.
    """

    config_id: str
    loader: str
    path: str
    domain: str | None = None
    test_domain: str | None = None
    train_values: tuple[str, ...] | None = None
    test_values: tuple[str, ...] | None = None
    problem: str | None = None
    test_language: str | None = None
    n_splits: int | None = None
    max_targets: int | None = None
    max_docs_per_target: int | None = None

    def __post_init__(self) -> None:
        shared = set(self.train_values or ()) & set(self.test_values or ())
        if shared:
            raise ValueError(f"values on both sides: {', '.join(sorted(shared))}")
        if self.test_language and (self.max_targets or self.max_docs_per_target):
            raise ValueError("held-out titles take no limits")

    @property
    def rule(self) -> str:
        if self.test_language:
            return "titles"
        return "folds" if self.n_splits else "sides"

    @property
    def corpus(self) -> str:
        """Name of the corpus directory, which holds the processed one."""
        return self.path.rstrip("/").removesuffix("/processed").rsplit("/", 1)[-1]

    def side_conditions(self) -> tuple[Column, Column]:
        """What puts a document on the train and on the test side."""
        column = F.col(self.domain)
        if self.test_domain is not None:
            test = column.eqNullSafe(self.test_domain)
            return ~test, test
        train, test = column.isin(*self.train_values), column.isin(*self.test_values)
        if self.problem is not None:
            train, test = [(F.col("problem") == self.problem) & side for side in (train, test)]
        return train, test


def _with_caps(config: SplitConfig) -> list[SplitConfig]:
    """A configuration, and one per published limit on training documents."""
    fields = asdict(config)
    limited = [
        SplitConfig(**{**fields, "config_id": f"{config.config_id}/max{cap}", "max_docs_per_target": cap})
        for cap in DOCUMENT_CAPS
    ]
    return [config, *limited]


def reuters_configs(path: str = "data/reuters-c50/processed") -> list[SplitConfig]:
    return _with_caps(
        SplitConfig(
            "reuters", "reuters", path,
            domain="category", train_values=("train",), test_values=("test",),
        )
    )


def leave_one_out_configs(
    loader: str, path: str, domain: str, values: Sequence[str]
) -> list[SplitConfig]:
    return [
        SplitConfig(f"{loader}/{domain}/{value}", loader, path, domain=domain, test_domain=value)
        for value in values
    ]


def cmcc_configs(path: str = "data/cmcc/processed") -> list[SplitConfig]:
    by_topic = leave_one_out_configs("cmcc", path, "topic", CMCC_TOPICS)
    return by_topic + leave_one_out_configs("cmcc", path, "genre", CMCC_GENRES)


def guardian_configs(path: str = "data/guardian/processed") -> list[SplitConfig]:
    across_genres = [(GUARDIAN_TOPICS, GUARDIAN_GENRES), (GUARDIAN_GENRES, GUARDIAN_TOPICS)]
    across_topics = [
        (tuple(other for other in GUARDIAN_TOPICS if other != topic), (topic,))
        for topic in GUARDIAN_TOPICS
    ]
    return [
        SplitConfig(
            f"guardian/{'+'.join(train)}>{'+'.join(test)}", "guardian", path,
            domain="category", train_values=train, test_values=test,
        )
        for train, test in across_genres + across_topics
    ]


def imdb_configs(path: str = "data/imdb62/processed") -> list[SplitConfig]:
    return _with_caps(SplitConfig("imdb62", "imdb62", path, n_splits=DEFAULT_FOLDS))


def novel_configs(path: str = "data/cl_novels/processed") -> list[SplitConfig]:
    return [
        SplitConfig(f"cl_novels/{language}", "cl_novels", path, test_language=language)
        for language in NOVEL_LANGUAGES
    ]


def pan18_configs(path: str = "data/pan18_attribution/processed") -> list[SplitConfig]:
    problems = [f"problem{number:05d}" for number in range(1, PAN18_PROBLEMS + 1)]
    return [
        SplitConfig(
            f"pan18/{problem}", "pan18", path, problem=problem,
            domain="data_type", train_values=("train",), test_values=("test",),
        )
        for problem in problems
    ]


def reddit_configs(folder: str = "data") -> list[SplitConfig]:
    return [
        SplitConfig(
            f"reddit/{corpus}/{train}>{test}", "reddit", f"{folder}/{corpus}/processed",
            domain="language", train_values=(train,), test_values=(test,),
        )
        for corpus, other in REDDIT_CORPORA.items()
        for train, test in (("en", other), (other, "en"))
    ]


def all_configs() -> list[SplitConfig]:
    return [
        *reuters_configs(),
        *cmcc_configs(),
        *guardian_configs(),
        *imdb_configs(),
        *novel_configs(),
        *pan18_configs(),
        *reddit_configs(),
    ]


def configs_frame(spark: SparkSession, configs: Sequence[SplitConfig]) -> DataFrame:
    names = [field.split()[0] for field in schema.CONFIGS.split(", ")]
    rows = [tuple(asdict(config)[name] for name in names) for config in configs]
    return spark.createDataFrame(
        [tuple(list(v) if isinstance(v, tuple) else v for v in row) for row in rows], schema.CONFIGS
    )


def usable(docs: DataFrame, corpus: Column) -> DataFrame:
    """Leave out documents that are known to be mislabelled: one of a single corpus.

    `corpus` names the corpus of each document.
    """
    if "text_path" not in docs.columns:
        return docs
    bad = [F.col("text_path").endswith(path) for path in REDDIT_MISLABELLED]
    for condition in bad:
        docs = docs.where(~F.coalesce((corpus == REDDIT_MISLABELLED_CORPUS) & condition, F.lit(False)))
    return docs
