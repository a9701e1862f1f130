"""The corpus pipeline: language ID, near-dedup, suffix dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and gives what is left of docs, with the
columns of documents; the last gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from loomlight.llm.cluster import CARRIED, table, written
from loomlight.llm.decontamination import decontaminate
from loomlight.llm.langid import UNKNOWN, identify
from loomlight.llm.near_dups import few, group
from loomlight.llm.packing import pack
from loomlight.llm.suffixes import remove_repeats


def language(spark, docs, sf_dir):
    """Documents with a language; those without text or letters go."""
    return identify(docs, carry=True).where(F.col("lang_pred") != UNKNOWN).select(f"{CARRIED}.*")


def near_dedup(spark, docs, sf_dir):
    """The row of smallest id of each near-duplicate group."""
    gone = written(group(docs, stable=True, rows=True).where("not stays").select("row"), "dropped")
    numbered = docs.select(F.struct("*").alias(CARRIED), F.monotonically_increasing_id().alias("row"))
    return numbered.join(few(gone), "row", "left_anti").select(f"{CARRIED}.*")


def suffix_dedup(spark, docs, sf_dir):
    """Texts without the passages of over 50 words that another document holds too.

    Every string of 50 words is looked at, so that a passage whose first or last word touches other signs is found as well."""
    out = remove_repeats(docs, length=50, gram=20, unit="word", across=True, stable=True, carry=True)
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"{CARRIED}.`{c}`") for c in docs.columns])


def decontamination(spark, docs, sf_dir):
    """Documents that aren't contaminated by the benchmark."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True).where("not contaminated").select(f"{CARRIED}.*")


def packing(spark, docs, sf_dir):
    """Token pieces in sequences."""
    return pack(docs)


STAGES = [
    ("language ID", language),
    ("near-duplicate removal", near_dedup),
    ("suffix-array dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("best-fit packing", packing),
]

#: The stages need models, hashing of bytes and tokenizers: no SQL. test_pipeline_against_brute_force in tests/llm holds the whole against plain sets, windows and the tokenizers library.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
