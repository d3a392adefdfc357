"""Column-expression helpers that reproduce the warehouse's arithmetic exactly."""

from salesengine.functions.money import (
    FINE_UNITS, MONEY, UNITS, discounted_fine, fine_to_double, int_avg, int_avg_from, int_div, line_total, money, money_avg,
    money_avg_from, money_avg_units, money_units, units_sum, units_to_double, units_to_money,
)

__all__ = [
    "FINE_UNITS", "MONEY", "UNITS", "discounted_fine", "fine_to_double", "int_avg", "int_avg_from", "int_div", "line_total", "money",
    "money_avg", "money_avg_from", "money_avg_units", "money_units", "units_sum", "units_to_double",
    "units_to_money",
]
