"""Queries of ranked search, the transducer lexicon and the conversation trie."""

from __future__ import annotations

from tidemill.llm.lexicon import build, encoder
from tidemill.llm.prefix_trie import TRIE_SQL, numbered, rebuilt, trie
from tidemill.llm.ranked import SEARCH_SQL, search
from tidemill.llm.registry import query, table

BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"


@query("op11_ranked_search", SEARCH_SQL)
def ranked_search(spark, sf_dir):
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_bpe")
def bpe(spark, sf_dir, model_path: str = BYTE_BPE):
    """Also lossless: whether the decoded text is the text."""
    docs = table(spark, sf_dir, "documents")
    done = docs.select("doc_id", encoder(build(docs, model_path))("text").alias("e"))
    return done.select("doc_id", "e.n_tokens", "e.ids_sha256", "e.decoded_sha256", "e.lossless")


@query("op13_conversation_trie", TRIE_SQL)
def conversation_trie(spark, sf_dir):
    rows, convs = rebuilt(numbered(table(spark, sf_dir, "conversations")), group=100, most=5)
    return trie(rows, convs).drop("k1", "k2")
