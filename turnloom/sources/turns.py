"""Reading and writing turns, logs and id lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_SCHEMA = (
    "ID string, turn_id int, domains array<string>, dialog struct<sys: array<string>, usr: array<string>>, "
    "slot_values map<string,string>, turn_slot_values map<string,string>, last_slot_values map<string,string>"
)
LOG_SCHEMA = TURN_SCHEMA + ", pred map<string,string>, pred_delta_slot_values map<string,string>, completion string, final_scores map<string,map<string,double>>"


def read_turns(spark: SparkSession, *paths: str, domains: tuple[str, ...] | None = None) -> DataFrame:
    """Turns of JSON-array files, with label; with ``domains`` only turns all of whose domains are among them."""
    t = reduce(DataFrame.unionByName, (spark.read.schema(TURN_SCHEMA).option("multiLine", True).json(p) for p in paths))
    t = t.withColumn("label", F.concat_ws("_turn_", "ID", F.col("turn_id").cast("string")))
    return t.where(F.size(F.array_except("domains", F.array(*map(F.lit, domains)))) == 0) if domains else t


def read_logs(spark: SparkSession, pattern: str) -> DataFrame:
    """Running logs below a glob, a run being its folder."""
    log = spark.read.schema(LOG_SCHEMA).option("multiLine", True).json(pattern)
    return log.withColumn("run", F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]+$", 1))


def scored_pool(log: DataFrame, metric: str) -> DataFrame:
    """qlabel, exlabel, score of a scored log's examples; a log without scores is an error."""
    scores = F.element_at("final_scores", F.lit(metric))
    if log.where(scores.isNotNull() & (F.size(scores) > 0)).isEmpty():
        raise ValueError(f"no final_scores for {metric}")
    label = F.concat_ws("_turn_", "ID", F.col("turn_id").cast("string"))
    return log.select(label.alias("qlabel"), F.explode(scores).alias("exlabel", "score"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The strings of a JSON array."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("ID"))


def read_replacements(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Pairs of a file with a tab between what is replaced and by what, in the file's order: a configured list, a line each.
    A line without a tab is an error."""
    lines = spark.read.text(path, wholetext=True).first()
    pairs = [tuple(x.split("\t")) for x in (lines.value if lines else "").splitlines() if x]
    if any(len(p) != 2 for p in pairs):
        raise ValueError(f"a line of {path} is not a pair")
    return pairs


def write_log(df: DataFrame, path: str, mode: str = "append") -> None:
    """A log grows by appending; nothing that was written is written again."""
    df.write.mode(mode).json(path)


def write_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def frames_to_states(dialogues: DataFrame) -> DataFrame:
    """ID, turn_id, slot, value of schema-guided dialogues (dialogue_id, turns): user turns' frame states, first values."""
    t = dialogues.select(F.col("dialogue_id").alias("ID"), F.posexplode("turns").alias("at", "turn")).where("turn.speaker = 'USER'")
    f = t.select("ID", F.floor(F.col("at") / 2).cast("int").alias("turn_id"), F.explode("turn.frames").alias("frame"))
    v = f.select("ID", "turn_id", "frame.service", F.explode("frame.state.slot_values").alias("slot", "values"))
    return v.select("ID", "turn_id", F.concat_ws("-", "service", "slot").alias("slot"), F.col("values")[0].alias("value"))
