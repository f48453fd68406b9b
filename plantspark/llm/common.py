"""Helpers that the training-data operators share.

Words are maximal runs of characters outside ``[\\x20\\x09-\\x0D]``. A null text counts as
an empty one unless an operator says otherwise.
"""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words, and the pattern of a word.
BLANKS = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column, F.lit(""))


def words(column: Column) -> Column:
    """The words of a text as an array; no words for an empty or null text."""
    return F.regexp_extract_all(whole_text(column), F.lit(WORD), F.lit(0))


def word_count(column: Column) -> Column:
    """The number of words as a long, without building an array of them."""
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset, as in
    local tests, a temporary folder of this machine takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        own = spark.sparkContext.getCheckpointDir()
        named = own or f"file://{tempfile.mkdtemp(prefix='plantspark-')}"
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{what}-{os.getpid()}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder, so that later steps don't depend on lost tasks."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, what)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(*tables: DataFrame) -> None:
    """Removes tables that ``written`` made, once nothing that is still to be computed reads them.

    Then the driver forgets plans that nothing refers to, so Spark's cleaner takes their shuffles and broadcasts too.
    """
    for df in tables:
        files = df.inputFiles()
        if files:
            jvm = df.sparkSession._jvm
            folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)
    gc.collect()
    for df in tables[:1]:
        df.sparkSession._jvm.System.gc()


def fresh(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that is none of ``taken``, in any case of letters."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


#: Rows of a batch that goes to a Python worker, where the session has Spark's default of 10,000.
BATCH_ROWS = 1024
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with batches small enough that texts don't fill workers and executors twice over.

    A worker serves many tasks: at the end of each it gives the system back what it doesn't use.
    """
    conf = df.sparkSession.conf
    if conf.get(_ROWS_KEY, _ROWS_DEFAULT) == _ROWS_DEFAULT:
        conf.set(_ROWS_KEY, str(BATCH_ROWS))

    def released(batches):
        yield from function(batches)
        give_back()

    return df.mapInArrow(released, schema)


def give_back() -> None:
    """Unused memory of this process goes back to the system, where its C library has a call for that."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def crc32_mod(column: Column, n: int) -> Column:
    """crc32 of a number's decimal digits, modulo ``n``; null for null."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


#: Fixed value: the pattern that many byte-level vocabularies split texts by. ``parts`` is proven for it.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space besides blank and line feed, and the mark between parts.
_ODD = "\0" + "".join(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
#: A comma or full stop that doesn't follow a letter or number, and marks that do.
_LOOSE = re.compile(r"[.,](?<![^\W_][.,])")
_MARKS = re.compile(r"(?<=[^\W_])(?=[!#$%&*,.:;?])")


def marked(text: str) -> str | None:
    """The text with a zero character between its parts (see ``parts``); None where the quick way can't tell."""
    if not text or any(c in text for c in _ODD):
        return None
    out = text.replace(" ", "\0 ").replace("\n", "\0\n\0")
    if any(c in text for c in "!#$%&*:;?") or _LOOSE.search(text):
        return _MARKS.sub("\0", out)
    return out.replace(",", "\0,").replace(".", "\0.")


def parts(text: str) -> list[str] | None:
    """Parts of a text whose matches of SPLIT_PATTERN are those of the text; None where this quick way can't tell.

    The pattern always cuts before a blank that has other characters than white space at both
    sides, around a line feed that does, and before a punctuation mark (but an apostrophe) after a
    letter or number. Empty texts, and texts with white space in other places, give None.
    """
    found = (marked(text) or "").split("\0")
    # White space that doesn't stand alone between other characters leaves an empty part or a blank.
    return None if "" in found or " " in found else found
