"""Fitted models on shared storage: their parameters, and a card that says how to use them. Both are one-row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortspark.operators.logistic import linear_score

FORMAT = "1.0"
#: The named feature sets and their order.
_TISSUE = ("grey_matter_fraction", "csf_fraction", "white_matter_fraction", "gm_csf_ratio", "gm_wm_ratio", "brain_csf_ratio")
FEATURE_SETS = {"age_only": ("age",), "tissue_only": _TISSUE, "tissue_plus_age": (*_TISSUE, "age"), "atrophy_plus_age": ("brain_csf_ratio", "age")}

CARD = "name string, inputs array<string>, source string, target string, subjects bigint, decision double, scores map<string, double>, settings map<string, string>, format string, made_at timestamp"
PARAMETERS = "features array<string>, mean array<double>, std array<double>, coefficients array<double>, intercept double"
#: What a card must fulfil, as conditions on its row.
RULES = {"inputs must not be empty": "size(inputs) > 0", "decision must lie strictly between 0 and 1": "decision > 0 and decision < 1"}


def feature_set(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """The `keep` columns of `df`, then those of a named feature set in its order; ValueError for an unknown name."""
    try:
        wanted = FEATURE_SETS[name]
    except KeyError:
        raise ValueError(f"no feature set {name}; there are {', '.join(FEATURE_SETS)}") from None
    return df.select(*keep, *arranged(wanted, df.columns))


def arranged(inputs: list[str] | tuple[str, ...], columns: list[str]) -> list[str]:
    """`inputs` in their own order, whatever else `columns` has; ValueError that names the first ten that it lacks."""
    lacking = list(dict.fromkeys(c for c in inputs if c not in set(columns)))
    if lacking:
        raise ValueError(f"{len(lacking)} inputs are missing: {', '.join(lacking[:10])}")
    return list(inputs)


def card(spark: SparkSession, name: str, inputs: list[str], **about) -> Row:
    """The card of a model; `about` sets other columns of CARD. ValueError where it breaks one of RULES.

    Unset, decision is 0.5, made_at the present, format the one that `load` reads.
    """
    given = {"name": name, "inputs": list(inputs), "decision": 0.5, "format": FORMAT, **about}
    names = [c.split()[0] for c in CARD.replace("map<string, ", "map<string,").split(", ")]
    row = spark.createDataFrame([tuple(given.get(c) for c in names)], CARD).withColumn("made_at", F.coalesce("made_at", F.current_timestamp()))
    held = row.select(*[F.coalesce(F.expr(rule), F.lit(False)) for rule in RULES.values()]).first()
    broken = [text for text, ok in zip(RULES, held) if not ok]
    if broken:
        raise ValueError("; ".join(broken))
    return row.first()


def save(spark: SparkSession, folder: str, model: dict, about: Row) -> None:
    """Writes both tables below `folder`, wherever Spark can write."""
    spark.createDataFrame([about], CARD).coalesce(1).write.mode("overwrite").json(f"{folder}/card")
    spark.createDataFrame([tuple(model[c.split()[0]] for c in PARAMETERS.split(", "))], PARAMETERS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/parameters")


def load(spark: SparkSession, folder: str) -> tuple[dict, Row]:
    """(model, card). FileNotFoundError where a part isn't there, found before anything is read; ValueError for another format."""
    lacking = []
    for part in ("card", "parameters"):
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}/_SUCCESS")
        if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
            lacking.append(part)
    if lacking:
        raise FileNotFoundError(f"artifact in {folder} is incomplete: {', '.join(lacking)}")
    about = spark.read.schema(CARD).json(f"{folder}/card").first()
    if about["format"] != FORMAT:
        raise ValueError(f"artifact of format {about['format']}; {FORMAT} is needed")
    return spark.read.schema(PARAMETERS).parquet(f"{folder}/parameters").first().asDict(), about


def apply_model(df: DataFrame, model: dict, about: Row) -> DataFrame:
    """`df` with y_score and y_pred of a fitted linear model, as one JVM expression."""
    arranged(about["inputs"], df.columns)
    score = linear_score(model | {"features": about["inputs"]})
    return df.withColumns({"y_score": score, "y_pred": (score >= about["decision"]).cast("int")})
