"""From raw documents to packed training sequences, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir); its rows are written as Parquet and read
again as the next stage's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import Scratch
from quern.llm.jaccard import keep_one_each
from quern.llm.lines import dedup_lines
from quern.llm.mixing import mixed_documents
from quern.llm.packing import pack
from quern.llm.queries import table, vocabulary
from quern.llm.toxicity import toxicity


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of the names that an operator adds renamed, and how to name them back."""
    held = {c: f"__aside{k}" for k, c in enumerate(docs.columns) if c.lower() in names}
    return docs.withColumnsRenamed(held), {v: k for k, v in held.items()}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; the model is fitted on the labelled ones.

    Null and empty texts have no event and stay; repeated rows go or stay
    together; columns stay as they are, whatever their names; an empty table
    gives an empty table.
    """
    rows, back = _aside(docs, "held_out", "score", "predicted")
    return toxicity(rows, table(spark, sf_dir, "labels")).where("predicted = 0").select(*rows.columns).withColumnsRenamed(back)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one holds; n_chars, where there is one, follows the text.

    No row goes.  A null text becomes an empty one; null ids come after all
    others, and rows of one id are one document; other columns stay as they are;
    an empty table gives an empty table.
    """
    rows, back = _aside(docs, "n_lines", "n_dropped")
    kept = dedup_lines(rows)
    return kept.selectExpr(*[f"cast(length(text) as {kept.schema[c].dataType.simpleString()}) as n_chars" if c == "n_chars" else f"`{c}`" for c in rows.columns]).withColumnsRenamed(back)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that of the smallest id.

    Texts without words all stay; rows alike in id and text are copies; rows that
    share an id but not their text, or have none, are told apart by their texts;
    columns stay as they are; an empty table gives an empty table.
    """
    return keep_one_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, the last time round perhaps their first words only.

    A null source is one of its own, the last; null and empty texts have nothing
    to take and go; repeated rows take their turns one after the other; other
    columns stay as they are, but for n_chars, which follows the text; an empty
    table gives an empty table.
    """
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids.

    A null text is an empty one, a piece of the end id alone; null ids stay null;
    repeated rows are packed as often as they stand; other columns play no part;
    an empty table gives an empty table.
    """
    return pack(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("near copies", drop_copies), ("mixing", mix_sources), ("packing", pack_sequences)]
#: SQL can express neither the fitted score nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), str(k))
        scratch.drop(str(k - 1))
    return STAGES[-1][1](spark, docs, sf_dir)
