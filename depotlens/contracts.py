"""Fixed vocabularies shared by the operators."""
from __future__ import annotations

# The six demand tiers, in report order.
TIERS = ["HD_Critical", "HD_Variable", "MD_Regular", "MD_Seasonal", "LD_Stable", "LD_Sporadic"]
