"""The queries of the operators in this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, langid, maintext, media, minhash, packing, sharding, toxicity, warc
from .common import table


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": lambda s, d: packing.documents_packed(table(s, d, "documents")),
        "op2_media": lambda s, d: media.documents_media(table(s, d, "documents")),
        "op3_minhash": lambda s, d: minhash.documents_classes(table(s, d, "documents")),
        "op4_warc": lambda s, d: warc.pages_archive(table(s, d, "pages")),
        "op5_chat": lambda s, d: chat.render(table(s, d, "conversations")),
        "op6_langid": lambda s, d: langid.documents_languages(table(s, d, "documents")),
        "op7_toxicity": lambda s, d: toxicity.documents_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op8_maintext": lambda s, d: maintext.pages_text(table(s, d, "pages")),
        "op9_decontam": lambda s, d: decontam.documents_overlaps(table(s, d, "documents"), table(s, d, "benchmark")),
        "op10_sharding": lambda s, d: sharding.documents_shards(table(s, d, "documents")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_warc": warc.ORACLE, "op5_chat": chat.ORACLE, "op9_decontam": decontam.ORACLE}
