"""Fill-in-the-middle training texts, with DataFrame functions only.

A text is cut into units (a word with the white space before it, or white space at the end), two cuts
drawn from a digest of ``doc_id`` split them into prefix, middle and suffix, and sentinels arrange the
parts: ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle). A digest also says which
texts stay as they are (``plain``). ``restored`` gets the text back from output and form alone.

A null text counts as empty; empty texts, and texts that hold a sentinel, stay plain, so that reading the
sentinels back is never ambiguous. A null ``doc_id``, or one that is no number, has the digest of the bare
seed; repeated rows, and rows that share an id, are drawn alike and each keep a row. Parts may be empty
(cuts at an end, or tied). An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import id_and_text

# A unit, the sentinels of prefix, suffix and middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four numbers from 0 to 2^32 - 1: the first groups of 8 digits of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{int(seed)}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix, middle, suffix, output): each text rearranged, or as it is.

    ``percent`` of the texts are rearranged, ``spm_percent`` of these as spm. ``n`` counts units; the three
    parts are null where the form is plain.
    """
    first, second, third, fourth = draws(seed, F.col("doc_id"))
    rows = id_and_text(docs).select("doc_id", "text", F.regexp_extract_all("text", F.lit(UNIT), F.lit(0)).alias("units"), first.alias("h1"), second.alias("h2"), third.alias("h3"), fourth.alias("h4"))
    rows = rows.withColumn("n", F.size("units").cast("long"))
    a, b = F.col("h1") % (F.col("n") + 1), F.col("h2") % (F.col("n") + 1)
    rows = rows.withColumns({"begin": F.least(a, b).cast("int"), "end": F.greatest(a, b).cast("int")})
    held = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    form = F.when((F.col("n") == 0) | held | (F.col("h3") % 100 >= percent), "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    part = lambda at, length: F.when(F.col("form") != "plain", F.array_join(F.slice("units", at + 1, length), ""))
    rows = rows.select(
        "doc_id", "text", "n", "form",
        part(F.lit(0), F.col("begin")).alias("prefix"), part(F.col("begin"), F.col("end") - F.col("begin")).alias("middle"), part(F.col("end"), F.size("units") - F.col("end")).alias("suffix"),
    )
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "spm", spm).otherwise(psm)
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text again: an output is parted at its three sentinels, which a rearranged text holds nowhere else."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
