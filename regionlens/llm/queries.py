"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .ann import op6_ann
from .curriculum import op11_mix
from .decontaminate import op4_decontaminate
from .langid import op8_language
from .licences import op2_licences
from .packing import op9_packing
from .quality import op1_quality
from .quotes import op3_chat
from .repair import op13_repair
from .secrets import op10_secrets
from .sharding import op7_sharding
from .simhash import op5_simhash
from .trie import op12_trie

QUERIES = {
    "op1_quality": op1_quality,
    "op2_licences": op2_licences,
    "op3_chat": op3_chat,
    "op4_decontaminate": op4_decontaminate,
    "op5_simhash": op5_simhash,
    "op6_ann": op6_ann,
    "op7_sharding": op7_sharding,
    "op8_language": op8_language,
    "op9_packing": op9_packing,
    "op10_secrets": op10_secrets,
    "op11_mix": op11_mix,
    "op12_trie": op12_trie,
    "op13_repair": op13_repair,
}

ORACLES = {
    "op3_chat": oracles.CHAT,
    "op4_decontaminate": oracles.DECONTAMINATE,
    "op10_secrets": oracles.SECRETS,
    "op11_mix": oracles.MIX,
    "op12_trie": oracles.TRIE,
    "op13_repair": oracles.REPAIR,
}
