"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from quernstone.llm.chat import OP9_SQL, op9_chat
from quernstone.llm.kdclusters import OP12_SQL, op12_clusters
from quernstone.llm.langid import op2_langid
from quernstone.llm.licenses import op10_licenses
from quernstone.llm.media import op5_media
from quernstone.llm.mixing import OP4_SQL, op4_mixing
from quernstone.llm.sentpieces import op7_sentencepiece
from quernstone.llm.simhash import op1_simhash
from quernstone.llm.syncmers import op6_syncmers
from quernstone.llm.tokenfiles import op3_token_files
from quernstone.llm.unitdedup import op8_substring_dedup
from quernstone.llm.warc import OP13_SQL, op13_warc
from quernstone.llm.whitening import op11_whitening

LLM_QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_langid": op2_langid,
    "op3_token_files": op3_token_files,
    "op4_mixing": op4_mixing,
    "op5_media": op5_media,
    "op6_syncmers": op6_syncmers,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_chat": op9_chat,
    "op10_licenses": op10_licenses,
    "op11_whitening": op11_whitening,
    "op12_clusters": op12_clusters,
    "op13_warc": op13_warc,
}

#: SQL can't express the others: hashing with a given seed and reachability, trained or learned models, files, automata.
LLM_ORACLE = {"op4_mixing": OP4_SQL, "op9_chat": OP9_SQL, "op12_clusters": OP12_SQL, "op13_warc": OP13_SQL}
