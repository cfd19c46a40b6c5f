"""The jobs as queries: each runs twice into one new folder and returns what then stands there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import region_atlas, word_background
from tidemark.session import shared_folder


def job1_region_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    output = f"{shared_folder(spark)}/atlas-{uuid.uuid4().hex}"
    for _ in range(2):
        region_atlas.run(spark, f"{sf_dir}/lineitem.parquet", output)
    return region_atlas.atlas(spark, output)


def job2_word_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = f"{shared_folder(spark)}/background-{uuid.uuid4().hex}"
    for _ in range(2):
        word_background.run(spark, f"{sf_dir}/documents.parquet", f"{base}/output", f"{base}/checkpoint")
    return word_background.background(spark, f"{base}/output")


QUERIES = {"job1_region_atlas": job1_region_atlas, "job2_word_background": job2_word_background}
SQL = {"job1_region_atlas": region_atlas.SQL, "job2_word_background": word_background.SQL}
