"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from hydroframe.llm.bitslice import OP13_SQL, op13_bit_sliced_search
from hydroframe.llm.chat import OP3_SQL, op3_chat_format
from hydroframe.llm.exact_dedup import OP1_SQL, op1_exact_dedup
from hydroframe.llm.fim import OP12_SQL, op12_fill_in_middle
from hydroframe.llm.fixity import OP7_SQL, op7_warc_fixity
from hydroframe.llm.jaccard import op6_jaccard_join
from hydroframe.llm.mixing import OP8_SQL, op8_mix_sources
from hydroframe.llm.packing import op2_pack
from hydroframe.llm.pii import op4_personal_data
from hydroframe.llm.quality import op5_quality_rules
from hydroframe.llm.secrets import op9_secret_scan
from hydroframe.llm.toxicity import op10_toxicity
from hydroframe.llm.trie import OP11_SQL, op11_conversation_trie

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_pack": op2_pack,
    "op3_chat_format": op3_chat_format,
    "op4_personal_data": op4_personal_data,
    "op5_quality_rules": op5_quality_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_warc_fixity": op7_warc_fixity,
    "op8_mix_sources": op8_mix_sources,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_bit_sliced_search": op13_bit_sliced_search,
}

ORACLES = {
    "op1_exact_dedup": OP1_SQL,
    "op3_chat_format": OP3_SQL,
    "op7_warc_fixity": OP7_SQL,
    "op8_mix_sources": OP8_SQL,
    "op11_conversation_trie": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_bit_sliced_search": OP13_SQL,
}
