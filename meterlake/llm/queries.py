"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from . import conversations, decontaminate, filteraudit, jaccardjoin, langid, linededup, mixing, packing, quality, secrets, suffixdedup, topk, urlfilter

QUERIES = {
    "op1_urlfilter": urlfilter.op1_urlfilter,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_language": langid.op3_language,
    "op4_secrets": secrets.op4_secrets,
    "op5_linededup": linededup.op5_linededup,
    "op6_quality": quality.op6_quality,
    "op7_mixing": mixing.op7_mixing,
    "op8_suffixdedup": suffixdedup.op8_suffixdedup,
    "op9_jaccardjoin": jaccardjoin.op9_jaccardjoin,
    "op10_topk": topk.op10_topk,
    "op11_conversations": conversations.op11_conversations,
    "op12_filteraudit": filteraudit.op12_filteraudit,
    "op13_packing": packing.op13_packing,
}

ORACLES = {
    "op1_urlfilter": urlfilter.OP1_SQL,
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op5_linededup": linededup.OP5_SQL,
    "op8_suffixdedup": suffixdedup.OP8_SQL,
    "op9_jaccardjoin": jaccardjoin.OP9_SQL,
    "op10_topk": topk.OP10_SQL,
    "op12_filteraudit": filteraudit.OP12_SQL,
}
