"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All
but the last return the columns of `documents`; `n_chars` follows the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontam, minhash, suffix, toxicity
from lodestone.llm.common import drop_path, quoted, read, work_dir
from lodestone.llm.queries import vocabulary

#: A document of this score or more is rejected.
TOXIC = 0.5


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table under names that no operator's output has, and the new name of each column."""
    names = {c: f"__doc_{k}" for k, c in enumerate(docs.columns)}
    return docs.select(*(F.col(quoted(c)).alias(n) for c, n in names.items())), names


def _back(rows: DataFrame, names: dict[str, str], **changed: Column) -> DataFrame:
    return rows.select(*((changed[c] if c in changed else F.col(n)).alias(c) for c, n in names.items()))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of a toxicity score of TOXIC or more; learns from this stage's own documents.

    Rows of null ids and null or empty texts are scored like others; repeated rows go or stay together.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    # the text passes through beside the score, so nothing is joined
    own, names = _apart(docs)
    return _back(toxicity.score(own, model, text_col=names["text"], carry=own.columns).where(F.col("score") < TOXIC), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least id of each group; rows of a null id stay, and rows of one id go or stay together."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text")).where(~F.col("kept")).select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*map(quoted, docs.columns))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of a smaller document out; a character that a cut runs through goes whole, and documents with nothing left go.

    Rows of null ids, and null and empty texts, stay as they are. `n_chars`, where there
    is such a column, follows the text.
    """
    own, names = _apart(docs)

    # one Python operator a task: two would keep twice as many workers, each with its models
    out = suffix.remove_repeats(own, names["doc_id"], names["text"], carry=own.columns, as_text=True)
    out = out.where((F.col("n_removed") == 0) | (F.length("kept") > 0))
    new = {"text": F.when(F.col("n_removed") == 0, F.col(names["text"])).otherwise(F.col("kept"))}
    if "n_chars" in names:
        new["n_chars"] = F.when(F.col("n_removed") == 0, F.col(names["n_chars"])).otherwise(F.length("kept").cast(docs.schema["n_chars"].dataType))
    return _back(out, names, **new)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts hold none."""
    own, names = _apart(docs)
    found = decontam.contamination(own, read(spark, sf_dir, "benchmark"), text_col=names["text"], carry=own.columns, nameless=True)
    return _back(found.where(F.size("hit_words") == 0), names)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds `n_tokens`, `ids` (little-endian unsigned 32-bit) and `decoded`, in place of the text and of columns of these names."""
    own, names = _apart(docs.select(*(quoted(c) for c in docs.columns if c not in ("n_tokens", "ids", "decoded"))))
    text = names.pop("text")
    made = bpe.encode_decode(own, vocabulary(), text_col=text, carry=list(names.values()))
    return made.select(*(F.col(n).alias(c) for c, n in names.items()), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("suffix_array", cut_repeats),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: Neighbour votes, suffix arrays and byte-pair merges are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written to the shared folder and read again.

    The table needs `doc_id` and `text`; other columns pass through, whatever their
    names. An empty table gives an empty result.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
