"""Keeps a search index of texts up to date and ranks them for a set of passages.

    python -m jobs.passage_search --documents IN --queries PASSAGES --out OUT --checkpoint PLACE [--config FILE]

Texts are taken from a folder of Parquet files as a stream that ends when there is nothing new; the checkpoint holds which files were taken.  A batch's texts of enough
words are encoded and written as folders index/batch=N/lang=L.  A batch that is taken again, after a failure, replaces its own folders, so each text is
there once.  Then passages are scored against batches that they haven't met: the best of them go to best/queries=H/batch=N, where H tells the set of
passages and N the last batch that they have met, and ranking is what is best of all.  A changed set of passages is thus scored against the whole index, an unchanged one against new batches only.

Texts are encoded by their words, whatever the order, so texts of the same words score the same; scores count on six decimals, ties go by doc_id.
"""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import load, log, main, written
from nichefold.functions.exprs import l2_normalise
from nichefold.operators.encoders import encode_texts
from nichefold.operators.expression import qc_filter
from nichefold.operators.vectors import cosine_top

DEFAULTS = {"dim": 64, "min_words": 5, "top": 20, "files_a_batch": 1000}
INDEX = "doc_id long, source string, n_words long, vec array<float>, batch long, lang string"
BEST = "query_id long, item_id long, score double, rnk int, queries string, batch long"
DIGITS = 6
SPACE = r"[\x09-\x0D\x20]+"


def encoded(rows: DataFrame, dim: int, min_words: int = 0) -> DataFrame:
    """rows of enough words, with n_words and, instead of text, vec: its unit vector."""
    text = F.lower(F.coalesce("text", F.lit("")))
    counted = rows.withColumns({"text": text, "n_words": F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")})
    kept = qc_filter(counted, min_words, counts_col="n_words")
    return encode_texts(kept, "hash", keep_text=False, dim=dim).withColumn("vec", l2_normalise(F.col("vec")).cast("array<float>"))


def index_batch(batch: DataFrame, number: int, out: str, config: dict) -> None:
    """Writes a batch's texts of enough words, by language; written again they replace themselves."""
    rows = encoded(batch.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "text"), config["dim"], config["min_words"])
    written(rows.withColumn("batch", F.lit(number).cast("long")).select("doc_id", "source", "n_words", "vec", "batch", "lang"), f"{out}/index", "batch", "lang", dynamic=True)
    log.info("batch %d: wrote %d texts to %s/index", number, table(batch.sparkSession, out, "index", INDEX, "batch", "lang").filter(F.col("batch") == number).count(), out)


def table(spark: SparkSession, out: str, name: str, schema: str, *by: str) -> DataFrame:
    """A table of the output; it is made, empty, where it isn't there yet."""
    written(spark.createDataFrame([], schema), f"{out}/{name}", *by, mode="ignore")
    return spark.read.schema(schema).parquet(f"{out}/{name}")


def as_glob(path: str) -> str:
    """A pattern for just this path: a stream takes a folder or a pattern, but no path of a single file."""
    return path if any(c in path for c in "*?[{") else f"{path.rstrip('/')[:-1]}[{path.rstrip('/')[-1]}]"


def take_new(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict) -> None:
    """Indexes the files that the checkpoint doesn't know, and returns when all are done."""
    schema = spark.read.parquet(documents).select("doc_id", "text", "lang", "source").schema
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config["files_a_batch"]).parquet(as_glob(documents))
    stream = files.writeStream.foreachBatch(lambda batch, n: index_batch(batch, n, out, config)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    stream.awaitTermination()
    for p in stream.recentProgress:
        log.info("batch %d: read %d rows of %s", p.batchId, p.numInputRows, documents)


def rank(spark: SparkSession, queries: str, out: str, config: dict) -> None:
    """Scores passages against batches that they haven't met, and ranks the best of all batches."""
    passages = spark.read.parquet(queries).select(F.col("item_id").cast("long").alias("query_id"), "text")
    known = passages.agg(F.count("*").alias("n"), F.sum(F.xxhash64("query_id", "text").cast("decimal(38,0)")).alias("h")).first()
    name = f"{known.n}-{known.h}-{config['dim']}-{config['top']}"
    index = table(spark, out, "index", INDEX, "batch", "lang")
    mine = lambda: table(spark, out, "best", BEST, "queries", "batch").filter(F.col("queries") == name)
    mark = mine().agg(F.max("batch")).first()[0]
    new = index if mark is None else index.filter(F.col("batch") > mark)
    last = new.agg(F.max("batch")).first()[0]
    log.info("%d passages of %s: scored up to batch %s, there are batches up to %s", known.n, queries, mark, last if last is not None else mark)
    if last is not None:
        vectors = encoded(passages, config["dim"]).select("query_id", F.col("vec").alias("qvec"))
        found = cosine_top(new, vectors, config["top"], i_id="doc_id", i_vec="vec", digits=DIGITS)
        written(found.select("query_id", "item_id", "score", "rnk", F.lit(name).alias("queries"), F.lit(last).cast("long").alias("batch")), f"{out}/best", "queries", "batch", dynamic=True)
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    ranking = mine().withColumn("rnk", F.row_number().over(place)).filter(F.col("rnk") <= config["top"])
    written(ranking.select("query_id", F.col("item_id").alias("doc_id"), "score", "rnk"), f"{out}/ranking")
    log.info("wrote %d rows to %s/ranking", spark.read.parquet(f"{out}/ranking").count(), out)


def run(spark: SparkSession, documents: str, queries: str, out: str, checkpoint: str, config: dict | None = None) -> None:
    """Takes new texts, then ranks; run again it takes only what has come since."""
    config = DEFAULTS | (config or {})
    take_new(spark, documents, out, checkpoint, config)
    rank(spark, queries, out, config)


def result(spark: SparkSession, out: str) -> DataFrame:
    """The output read back: each text of the index, with each place that it has in a ranking, or none."""
    index = table(spark, out, "index", INDEX, "batch", "lang").select("doc_id", "lang", "source", "n_words", F.aggregate(F.zip_with("vec", F.sequence(F.lit(1), F.size("vec")), lambda v, i: v.cast("double") * i), F.lit(0.0), lambda a, x: a + x).alias("check"))
    return index.join(spark.read.parquet(f"{out}/ranking"), "doc_id", "left")


if __name__ == "__main__":
    main(
        sys.modules[__name__].__doc__,
        {"documents": "folder of Parquet files, or a pattern: doc_id, text, lang, source", "queries": "Parquet: item_id, text", "out": "folder of the output", "checkpoint": "folder that tells what was taken"},
        "passage_search.json",
        lambda spark, a: run(spark, a.documents, a.queries, a.out, a.checkpoint, load(spark, a.config, DEFAULTS)),
    )
