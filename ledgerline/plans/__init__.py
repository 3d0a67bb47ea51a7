"""Whole queries, from stored tables to a result."""

from ledgerline.plans.pricing_summary import PRICING_SUMMARY_SQL, pricing_summary

__all__ = ["PRICING_SUMMARY_SQL", "pricing_summary"]
