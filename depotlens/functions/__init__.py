"""Column-level helpers (pure expressions, all JVM-side)."""
from depotlens.functions.rounding import round_half_even, trunc_long, finite_or_zero  # noqa: F401
from depotlens.functions.dates import parse_any_date  # noqa: F401
from depotlens.functions.text import month_name, clip_text, float_text, word_count  # noqa: F401
