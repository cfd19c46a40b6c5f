"""Background of words. Keeps the word counts and Markov model of a growing collection of sequences up to date.

Motif searches compare what they find with a background model of the sequences. This job reads the files that came
since its last run, counts the words of 1 to ``letters`` letters in their sequences by group, and publishes for every
word its count, the probability of its last letter after those before it, and the count that the words one letter
shorter let expect, with the logarithm of the ratio.

    python -m jobs.word_background --input FOLDER --output PATH --checkpoint PATH [--config PATH]

A file stream with a checkpoint finds the new files; each micro-batch writes its counts (``increments``) and the ids it
took (``ledger``) under the number of the batch, so a batch that is repeated replaces what it wrote. A sequence whose id
was taken by another batch is not counted again, so files that are delivered twice, also after the loss of a checkpoint,
change nothing. ``words`` is made anew from the increments and is partitioned by group; running the job again gives the
same rows.

Rows without an id, and those without a sequence, are left out. Of rows with one id in a batch the one whose group and
sequence come first counts. Letters other than A, C, G and T are gaps, and no word holds one.
"""

from __future__ import annotations

import argparse
import logging
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobs.common import command_line, settings
from tidemark.operators import sequences as Q

log = logging.getLogger("tidemark.jobs.word_background")
SETTINGS = {"id", "group", "sequence", "letters", "files_per_batch"}
CONFIG = Path(__file__).with_suffix(".json")
LEDGER = "id string, letters long, batch long"
INCREMENTS = "`group` string, word string, n long, batch long"


def windows(rows: DataFrame, letters: int) -> DataFrame:
    """(group, word, n): windows of so many letters that begin at each letter; beyond the end there are gaps.

    The words of fewer letters are the beginnings of these windows, so one pass counts the words of all lengths.
    """
    padded = rows.select("group", F.concat("sequence", F.lit("-" * (letters - 1))).alias("sequence"))
    return Q.kmers(padded, letters, "group", "sequence").groupBy("group", F.col("kmer").alias("word")).agg(F.count("*").alias("n"))


def ingest(batch: DataFrame, number: int, output: str, s: dict) -> None:
    """Counts the sequences of a micro-batch that no other batch took."""
    spark = batch.sparkSession
    rows = batch.select(F.expr(s["id"]).cast("string").alias("id"), F.struct(F.expr(s["group"]).cast("string").alias("group"), F.expr(s["sequence"]).alias("sequence")).alias("row"))
    rows = rows.filter("id is not null and row.sequence is not null and length(row.sequence) > 0")
    taken = spark.read.schema(LEDGER).parquet(f"{output}/ledger").filter(F.col("batch") != number)
    rows = rows.groupBy("id").agg(F.min("row").alias("row")).join(taken.select("id"), "id", "left_anti").select("id", "row.*").persist()
    try:
        windows(rows, s["letters"]).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/increments")
        rows.select("id", F.length("sequence").cast("long").alias("letters"), F.lit(number).alias("batch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/ledger")
    finally:
        rows.unpersist()
    got = spark.read.schema(LEDGER).parquet(f"{output}/ledger").filter(F.col("batch") == number).agg(F.count("*"), F.coalesce(F.sum("letters"), F.lit(0))).first()
    log.info("batch %d: took %d new sequences of %d letters", number, *got)


def model(increments: DataFrame, letters: int) -> DataFrame:
    """(group, length, word, n, prob, expected, log2_ratio) of all words of 1 to ``letters`` letters that occur."""
    whole = increments.groupBy("group", "word").agg(F.sum("n").alias("n"))
    cut = whole.select("group", "n", F.explode(F.sequence(F.lit(1), F.lit(letters))).alias("length"), F.col("word").alias("w")).select("group", "length", F.expr("left(w, length)").alias("word"), "n")
    words = cut.filter(F.translate("word", Q.BASES, "") == "").groupBy("group", "length", "word").agg(F.sum("n").alias("n"))

    def counts(of: str, name: str) -> DataFrame:
        return words.select("group", F.col("length").alias(f"{of}_length"), F.col("word").alias(of), F.col("n").alias(name))

    total = words.filter("length = 1").groupBy("group").agg(F.sum("n").alias("letters_in_all"))
    inner = words.withColumns({"context": F.expr("left(word, length - 1)"), "ending": F.expr("right(word, length - 1)"), "middle": F.expr("substring(word, 2, length - 2)")})
    after = inner.groupBy("group", "length", "context").agg(F.sum("n").alias("n_context"))
    out = inner.join(after, ["group", "length", "context"]).join(total, "group")
    for part in ("context", "ending", "middle"):  # a part has its own length, which its word implies
        out = out.join(counts(part, f"n_{part}_all").drop(f"{part}_length"), ["group", part], "left")
    expected = F.when(F.col("length") == 2, F.col("n_context_all") * F.col("n_ending_all") / F.col("letters_in_all")).when(F.col("length") > 2, F.col("n_context_all") * F.col("n_ending_all") / F.col("n_middle_all"))
    return out.select("group", "length", "word", "n", F.round(F.col("n") / F.col("n_context"), 6).alias("prob"), F.round(expected, 3).alias("expected"), F.round(F.log2(F.col("n") / expected), 4).alias("log2_ratio"))


def pattern(path: str) -> str:
    """The path as a pattern of itself: as such a stream takes a single file as well as a folder."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, input: str, output: str, checkpoint: str, config: str | Path = CONFIG) -> None:
    s = settings(config, SETTINGS)
    for name, schema in (("ledger", LEDGER), ("increments", INCREMENTS)):  # so that they can be read before the first batch
        spark.createDataFrame([], schema).write.mode("append").partitionBy("batch").parquet(f"{output}/{name}")
    stream = spark.readStream.schema(spark.read.parquet(input).schema).option("maxFilesPerTrigger", s["files_per_batch"]).parquet(pattern(input))
    query = stream.writeStream.foreachBatch(lambda batch, number: ingest(batch, number, output, s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %s: %d new rows in this run", input, sum(p["numInputRows"] for p in query.recentProgress))
    increments = spark.read.schema(INCREMENTS).parquet(f"{output}/increments")
    model(increments, s["letters"]).repartition("group").write.mode("overwrite").partitionBy("group").parquet(f"{output}/words")
    log.info("wrote %d words to %s/words", background(spark, output).count(), output)


def background(spark: SparkSession, output: str) -> DataFrame:
    """The published words of an output."""
    return spark.read.schema("length int, word string, n long, prob double, expected double, log2_ratio double, `group` string").parquet(f"{output}/words")


#: The same over documents with the settings beside this file.
SQL = """with sq as (select doc_id, coalesce(lang, 'und') as g, upper(regexp_replace(text, '[^acgt]', '', 'g')) as seq from documents where doc_id is not null and text is not null),
one as (select doc_id, min({'g': g, 'seq': seq}) as r from sq where length(seq) > 0 group by doc_id),
k as (select r.g as g, length, substr(r.seq, cast(i as int), length) as word from one, (select cast(unnest(range(1, 6)) as int) as length), lateral (select unnest(range(1, length(r.seq) - length + 2)) as i)),
w as (select g, length, word, count(*) as n from k group by all),
c as (select g, length, left(word, length - 1) as context, sum(n) as nc from w group by all),
t as (select g, sum(n) as total from w where length = 1 group by g),
e as (select w.*, c.nc, case when w.length = 2 then a.n * b.n / t.total when w.length > 2 then a.n * b.n / m.n end as expected
  from w join c on c.g = w.g and c.length = w.length and c.context = left(w.word, w.length - 1) join t on t.g = w.g
  left join w a on a.g = w.g and a.word = left(w.word, w.length - 1) left join w b on b.g = w.g and b.word = right(w.word, w.length - 1) left join w m on m.g = w.g and m.word = substr(w.word, 2, w.length - 2))
select g as "group", length, word, n, round(n / nc, 6) as prob, round(expected, 3) as expected, round(log2(n / expected), 4) as log2_ratio from e"""


def main() -> None:
    def job(spark: SparkSession, args: argparse.Namespace) -> None:
        run(spark, args.input, args.output, args.checkpoint, args.config or CONFIG)

    command_line(__doc__, job, input="folder of Parquet files that grows, or a pattern of files", output="folder for counts and words", checkpoint="folder for the mark of the stream", config="JSON file with settings")


if __name__ == "__main__":
    main()
