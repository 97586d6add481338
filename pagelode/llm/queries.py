"""The queries of the operators of this subpackage, by name."""

from .bpe import op2_bpe
from .chat import OP1_SQL, op1_chat
from .embdedup import OP8_SQL, op8_embdedup
from .hmm import op10_hmm
from .langid import op9_langid
from .licenses import op4_licenses
from .linedup import op6_linedup
from .minhash import OP3_SQL, op3_minhash
from .mixing import op5_mixing
from .topk import OP7_SQL, op7_topk

QUERIES = {
    "op1_chat": op1_chat,
    "op2_bpe": op2_bpe,
    "op3_minhash": op3_minhash,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_linedup": op6_linedup,
    "op7_topk": op7_topk,
    "op8_embdedup": op8_embdedup,
    "op9_langid": op9_langid,
    "op10_hmm": op10_hmm,
}

ORACLES: dict[str, str] = {"op1_chat": OP1_SQL, "op3_minhash": OP3_SQL, "op7_topk": OP7_SQL, "op8_embdedup": OP8_SQL}
