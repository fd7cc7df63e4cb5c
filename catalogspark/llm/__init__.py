"""Training-data operators. Each module holds one operator, its query and, where SQL can say it, its SQL."""

from importlib import import_module
from importlib.util import find_spec

_NAMES = ("op1_bpe", "op2_jaccard", "op3_toxicity", "op4_embedding", "op5_packing", "op6_license", "op7_quality", "op8_url", "op9_langid", "op10_lm", "op11_whitening", "op12_codes", "op13_fim")


def modules():
    return [import_module(f"{__name__}.{n}") for n in _NAMES if find_spec(f"{__name__}.{n}")]


def queries():
    return {m.NAME: m.query for m in modules()}


def oracle_sql():
    return {m.NAME: m.ORACLE_SQL for m in modules() if getattr(m, "ORACLE_SQL", None)}
