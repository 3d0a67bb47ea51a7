"""DataFrame to DataFrame steps."""

from ledgerline.operators.pricing import shipped_by, summarize_pricing

__all__ = ["shipped_by", "summarize_pricing"]
