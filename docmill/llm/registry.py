"""The queries of this package and, where SQL can express them, their SQL."""

from docmill.llm import ann, bpe, lattice, licenses, maxscore, mixing, quality, simhash, substrings, toxicity

_QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_ann": ann.op2_ann,
    "op3_licenses": licenses.op3_licenses,
    "op4_bpe": bpe.op4_bpe,
    "op5_lattice": lattice.op5_lattice,
    "op6_substrings": substrings.op6_substrings,
    "op7_simhash": simhash.op7_simhash,
    "op8_quality": quality.op8_quality,
    "op9_maxscore": maxscore.op9_maxscore,
    "op10_toxicity": toxicity.op10_toxicity,
}
_SQL = {"op1_mixing": mixing.OP1_SQL, "op3_licenses": licenses.OP3_SQL, "op6_substrings": substrings.OP6_SQL, "op9_maxscore": maxscore.OP9_SQL}


def llm_queries():
    return dict(_QUERIES)


def llm_oracle_sql():
    return dict(_SQL)
