"""Answers with sources: asking, filling forms, evaluating."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def validate_checks(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Non-blank texts of at most 20,000 characters, and the rest with a reason."""
    reason = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "text is required").when(F.char_length("text") > 20000, "text is too long")
    judged = requests.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def validate_fields(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """requests(fields array<string>): trimmed, blanks dropped; 1 to 50 must remain."""
    clean = F.filter(F.transform("fields", lambda f: F.trim(f)), lambda f: f != "")
    judged = requests.withColumn("fields", clean).withColumn("n_fields", F.size("fields"))
    return judged.where("n_fields between 1 and 50"), judged.where("n_fields not between 1 and 50 or n_fields is null")


def passages_json(hits: DataFrame) -> DataFrame:
    """(query_id, passages): the JSON array a model reads, by rank; an empty file name is left out."""
    name = F.when(F.col("file_name") != "", F.col("file_name"))
    view = F.struct(F.col("file_id").alias("fileId"), name.alias("fileName"), "text")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", view.alias("v")))), lambda x: x["v"])
    return hits.groupBy("query_id").agg(F.to_json(listed).alias("passages"))


def load_cited(answers: DataFrame, files: DataFrame) -> DataFrame:
    """answers(query_id, owner_id, file_ids) -> cited files that the owner has, in citation order; repeats stay."""
    cited = answers.select("query_id", "owner_id", F.posexplode("file_ids").alias("pos", "id"))
    return cited.join(files.select("id", "owner_id", "name"), ["id", "owner_id"]).select("query_id", "pos", F.col("id").alias("file_id"), "name")


def fill_answers(forms: DataFrame, results: DataFrame) -> DataFrame:
    """forms(form_id, fields), results(form_id, pos, value, sources, error) -> one row per field in the form's order.

    found: it has sources; a value without sources is empty; an error is not a miss.
    """
    fields = forms.select("form_id", F.posexplode_outer("fields").alias("pos", "field"))
    joined = fields.join(results, ["form_id", "pos"], "left")
    found = F.coalesce(F.size("sources") > 0, F.lit(False)) & F.col("error").isNull()
    return joined.select("form_id", "pos", "field", F.when(found, F.col("value")).otherwise("").alias("value"), found.alias("found"), F.coalesce("error", F.lit("")).alias("error"))


def eval_report(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """cases(case, expected_ids, contains), answers(case, answer, cited) -> n_expected, n_cited, passed."""
    joined = cases.join(answers, "case", "left")
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    all_cited = F.size(F.array_except("expected_ids", cited)) == 0
    all_said = F.forall("contains", lambda s: F.coalesce(F.contains(F.col("answer"), s), F.lit(False)))
    return joined.select("case", F.size("expected_ids").alias("n_expected"), F.size(cited).alias("n_cited"), (all_cited & all_said).alias("passed"))


def in_order(df: DataFrame, key: str, order: str) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1)
