"""Importing this module registers the corpus queries."""

from quarry.llm import op1_site_template  # noqa: F401
from quarry.llm import op2_cross_polytope  # noqa: F401
from quarry.llm import op3_temperature_mixing  # noqa: F401
from quarry.llm import op4_merkle_fixity  # noqa: F401
from quarry.llm import op5_exact_topk  # noqa: F401
from quarry.llm import op6_lsh_forest  # noqa: F401
from quarry.llm import op7_bpe  # noqa: F401
from quarry.llm import op8_rendezvous  # noqa: F401
from quarry.llm import op9_toxicity_chain  # noqa: F401
from quarry.llm import op10_weak_quality  # noqa: F401
from quarry.llm import op11_zone_mapped_negatives  # noqa: F401
from quarry.llm import op12_risk_controlled_rules  # noqa: F401
from quarry.llm import op13_collocations  # noqa: F401
