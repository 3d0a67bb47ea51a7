"""Column expressions."""

from ledgerline.functions.fixed_point import from_hundredths, from_ten_thousandths, hundredths, product, wide_sum

__all__ = ["from_hundredths", "from_ten_thousandths", "hundredths", "product", "wide_sum"]
