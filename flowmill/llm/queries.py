"""The operators' queries and, where SQL can express them, their SQL."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .bpe import op2_byte_bpe
from .chat import OP10_SQL, op10_chat_formatting
from .embeddings import op5_embedding_near_duplicates
from .fingerprints import OP12_SQL, op12_fingerprints
from .infilling import OP13_SQL, op13_fill_in_middle
from .jaccard import op1_ngram_jaccard_join
from .language import op4_language_id
from .licenses import OP9_SQL, op9_license_scan
from .media import op8_ogg_media
from .mixing import OP6_SQL, op6_mix_sources
from .prefixes import OP11_SQL, op11_prefix_trie
from .quality import op7_quality
from .sharding import op3_shard_documents


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, run with this package on the executors."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_shard_documents": op3_shard_documents,
    "op4_language_id": op4_language_id,
    "op5_embedding_near_duplicates": op5_embedding_near_duplicates,
    "op6_mix_sources": op6_mix_sources,
    "op7_quality": op7_quality,
    "op8_ogg_media": op8_ogg_media,
    "op9_license_scan": op9_license_scan,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_fingerprints": op12_fingerprints,
    "op13_fill_in_middle": op13_fill_in_middle,
}
QUERIES = {name: shipped(query) for name, query in QUERIES.items()}
ORACLE_SQL = {
    "op6_mix_sources": OP6_SQL,
    "op9_license_scan": OP9_SQL,
    "op10_chat_formatting": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_fingerprints": OP12_SQL,
    "op13_fill_in_middle": OP13_SQL,
}
