"""The training-data pipeline: five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrel.llm import classifier, mixing, neardup, pieces, secrets
from quadrel.llm.common import materialise, table


def quality(spark, docs, sf_dir):
    """Rows whose text the quality classifier rejects go.

    The model learns from ``labels`` outside fold 0; without usable labels
    every text scores 0.5 and stays. A null text is judged as an empty one;
    ids and other columns are not read, so rows with equal texts stay or go
    together. An empty table gives no rows.
    """
    model = classifier.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality"))
    return classifier.accepted(docs, model)


def near_dedup(spark, docs, sf_dir):
    """Of each group of near-duplicates, the lowest id stays (five-word shingles, similarity of 0.8 or more).

    Rows with a null id, a null text or no words are in no group and stay.
    Rows that repeat both id and text stay or go together. An empty table
    gives no rows.
    """
    return neardup.without_duplicates(docs, words=5, percent=80)


def secret_scan(spark, docs, sf_dir):
    """Secrets in the text become a mark, and ``n_chars`` follows the new text.

    Every row stays. Null and empty texts stay as they are (``n_chars`` of a
    null text is null); equal texts change alike. An empty table gives no
    rows.
    """
    clean = secrets.redacted(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark, docs, sf_dir):
    """Rows are left out or repeated so that sources come near their targets.

    A row comes at most twice. Rows that share an id, null ids among them,
    come equally often; a null source is a source of its own, and a null text
    has no words. An empty table gives no rows.
    """
    return mixing.repeated(docs)


def tokenise(spark, docs, sf_dir):
    """(doc_id, ids): the piece ids of each row's text.

    One row per row, repeated ones too. Null text gives null ids, an empty
    one no ids. An empty table gives no rows.
    """
    return pieces.encode(docs)


#: (name, function), in order.
STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("secret_scans", secret_scan),
    ("mixing", mix),
    ("sentencepiece", tokenise),
]

#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
