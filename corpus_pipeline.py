"""From documents to packed training sequences, in five stages.

Each stage reads all that its predecessor kept, its decisions take effect, and
all but the last return the columns of ``documents``. ``run`` writes each
stage's rows below the shared folder, reads them again for the next, and
removes what a stage needed once its rows stand.

In every stage a null or empty text is a text without words, texts count
whole, null ids and rows that share an id are rows like any other, columns
beyond those of ``documents`` are not read, and an empty table gives an empty
result. What a stage decides about such rows stands at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import scope, scratch, written
from lodestone.llm.encoding import default_tokenizer
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.near_copies import near_copies
from lodestone.llm.packing import pack
from lodestone.llm.quality_crf import fit_quality, score_quality
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.soft_mixing import label_domain, mix

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents below this quality are rejected.
MIN_QUALITY = 0.3
#: Near copies: words of a shingle, and the least Jaccard similarity.
WIDTH, SIMILARITY = 5, 0.8
#: Wanted shares of expected tokens: good documents keep the tokens they have, and the others shrink to these shares.
MIX_WEIGHTS = {"good": 0.97, "low": 0.01, "toxic": 0.02}
#: A rate this close to a whole number of copies is that number, so that good documents stay once.
WHOLE_COPIES = 0.02
#: No document comes more often than this, whatever the targets ask.
MAX_RATE = 4.0


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF rejects go.

    A text without words is scored as one empty line. Rows of equal text are
    kept or go together, whatever their ids. Without labels every score is 0.5
    and every document stays.
    """
    model = fit_quality(docs, _labels(spark, sf_dir))
    out = score_quality(docs, model, keep=COLUMNS[1:])
    return out.where(F.col("score") >= MIN_QUALITY).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in at least ten documents go from every document; n_chars follows the text.

    Every row counts as a document. No row goes, even if none of its lines is
    left; a null text becomes ''.
    """
    out = dedup_lines(docs, min_docs=10, keep=("lang", "source"))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles) the row of the smallest id stays, a null id last.

    The SimHash operator gives candidates: rows whose fingerprints are linked.
    Its bits do not tell pairs of similarity 0.8 from others (the README has
    the figures), so ``near_copies`` adds the candidates of MinHash, and every
    link has to hold by exact Jaccard similarity of 0.8 or more.

    Rows are numbered and go by their number: of rows with the same id and
    different texts each is kept or goes with its own group. Documents without
    words are no copies of each other's content: each of them stays.
    """
    numbered = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), scratch(spark, "numbered"))
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    close = near_duplicates(numbered.where(worded), WIDTH, id_col="row").where("row <> component_id").select("row", "component_id")
    groups = near_copies(numbered.where(worded), WIDTH, SIMILARITY, id_col="row", also=close)
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")
    first = groups.join(numbered.select("row", "doc_id"), "row").groupBy("component").agg(F.min(order).alias("least")).select("least.row")
    return numbered.where(worded).join(first, "row", "left_semi").unionByName(numbered.where(~worded)).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its rate says: good ones stay, toxic and low ones thin out.

    No document comes more than four times. Rows of equal id and text are drawn
    together. Without labels all rates are equal and nothing is thinned by domain.
    """
    labelled = _labels(spark, sf_dir).select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    out = mix(docs, labelled, MIX_WEIGHTS, keep_total_of="good", keep=COLUMNS[1:], slack=WHOLE_COPIES, max_rate=MAX_RATE)
    # An empty array gives no row: a filter of copies would be pushed below the rates and work each out again.
    return out.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(*COLUMNS)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, packed into sequences of 2048 tokens; a text without words is its end id."""
    return pack(docs, default_tokenizer(), end_id=0, size=2048, with_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("mixing sources to target weights", mixing),
    ("best-fit packing", best_fit_packing),
]

#: The classifier, the fingerprints and the tokens are beyond SQL; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before: list[str] = []
    for _, stage in STAGES[:-1]:
        with scope(spark) as made:
            at = scratch(spark, "stage")
            docs = written(stage(spark, docs, sf_dir), at)
            made.remove(at)
            made.extend(before)
            before = [at]
    return STAGES[-1][1](spark, docs, sf_dir)
